"""Log-probabilities of texts under a weighted backoff automaton of smoothed word n-grams.

States are the root and the histories (the start of a text, a word, two words, ... up to `order` - 1) that training
texts hold twice or more. The arcs of a state are the n-grams seen from it; each leads to the longest suffix that is
a state. A state without an arc for a token takes its failure arc, at that arc's weight, to the state of its history
less the first word. Texts are traversed from left to right: a state is carried, and logarithms are added up.

The automaton grows with the corpus, so it is never in one place. Texts are gathered to blocks of about `block_bytes`.
Order by order, each block sends its distinct n-grams (64-bit keys, sorted, as differences) to the parts that
own ranges of the keys; a part sums up what all blocks have sent, and sends the totals back in the order in which the
keys came, so no key travels twice. With them a block knows all states and arcs that its texts can meet: its own part
of the automaton, on which it scores its texts. N-grams are sent on only where their history is a state. No n-gram of
a state is left out, however rare its words are, and nothing that grows with the corpus is sent to the driver or to
all executors. A hot n-gram has one key a block, and keys are hashes, so blocks and parts are even.

Smoothing: a root arc has (c + 0.1) / (N + 0.1 (V + 1)), the last one for unknown tokens. An arc of history h has
(1 - f) c(hw) / c(h) + f p(w | h less its first word), and h's failure arc has f, which depends on c(h) alone:
for all histories seen about as often it is the share of their tokens that follow them once only (the Good-Turing
estimate of what is yet unseen). So each state's probabilities sum up to 1. Histories seen once would have f = 1 by
that estimate, which is why they are no states.

Defined cases: a null text is empty and scores the end token alone; a null doc_id counts as the empty string in
the split between training and held-out rows; repeated rows are each counted and scored; without training
tokens every token is unknown; texts of any length are scored whole; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave.llm import base
from oreweave.llm.parts import ALL, SENT, SENT_DDL, Distinct, U, added, by_part, coded, gathered, longer, mixed, parts_for, summed, unpack, word_hashes

START, END = -1, 1
SMOOTH = 0.1
#: A history is a state if training texts hold it so often.
LEAST = 2
BUCKETS = 96
#: Tokens that a lane of the traversal has at most.
LANE = 512


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the number of tokens of each."""
    flat, sizes = word_hashes(texts)
    sizes += 1
    out = np.full(int(sizes.sum()), END, dtype=np.int64)
    inner = np.ones(len(out), dtype=bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = flat
    return out, sizes


def bucket_of(count: np.ndarray) -> np.ndarray:
    """Exact below 8, then four buckets for each power of two."""
    c = np.maximum(count, 1).astype(float)
    return np.where(count < 8, count, np.minimum(8 + 4 * (np.log2(c) - 3), BUCKETS - 1)).astype(np.int64)


class Block:
    """The tokens of some texts, and order by order their n-grams and counts in all training texts.

    Of each order: keys (sorted, distinct), `at` (the number among them of the n-gram that ends at each token, -1 for
    none), a place where each ends, its token and history (number in the order below), and its count. Number `start` of
    order 1 is the start of a text.
    """

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
        self.tokens, self.sizes = tokens, sizes
        self.first = np.cumsum(sizes) - sizes
        self.word, self.end = mixed(vocabulary.view(U)), int(np.flatnonzero(vocabulary == END)[0])
        found = Distinct(np.append(self.word, mixed(np.array([START]).view(U))))
        self.start, self.own = int(found.number[-1]), found.number[:-1]
        self.keys, self.at, self.token, self.history, self.ends, self.count = [found.keys], [self.own[tokens]], [found.place], [None], [None], []
        self.known = found

    def learn(self, count: np.ndarray) -> None:
        self.count.append(count.astype(np.int64))

    def grow(self) -> None:
        """The n-grams of the next order whose history is a state."""
        before = np.empty(len(self.tokens), dtype=np.int64)
        before[1:] = self.at[-1][:-1]
        before[self.first] = self.start if len(self.keys) == 1 else -1
        some = np.flatnonzero((before >= 0) & (self.count[-1][before] >= LEAST)) if len(self.keys[-1]) else np.empty(0, dtype=np.int64)
        before, token = before[some], self.tokens[some]
        self.known = found = Distinct(longer(self.keys[-1][before], self.word[token]))
        at = np.full(len(self.tokens), -1, dtype=np.int64)
        at[some] = found.number
        self.some = some
        self.keys.append(found.keys)
        self.ends.append(some[found.place])
        self.at.append(at)
        self.token.append(token[found.place])
        self.history.append(before[found.place])

    def training(self, train: np.ndarray) -> np.ndarray:
        """How often each n-gram of the last order is in texts where train (a flag for each) is set."""
        weight = np.repeat(train, self.sizes).astype(np.int64)
        if len(self.keys) > 1:
            return self.known.total(weight[self.some])
        out = np.zeros(len(self.known.keys), dtype=np.int64)
        out[self.own] = np.bincount(self.tokens, weights=weight, minlength=len(self.word)).astype(np.int64)
        out[self.start] = int(train.sum())
        return out

    def buckets(self) -> np.ndarray:
        """Of each n-gram of the last order, the bucket of its history's count; for words 0, for the start of a text 1."""
        if len(self.keys) > 1:
            return bucket_of(self.count[-1][self.history[-1]])
        return (np.arange(len(self.known.keys)) == self.start).astype(np.int64)


def blocks(docs: DataFrame, modulus: int, block_bytes: int) -> DataFrame:
    """block, n_tokens, ids, held, sizes, vocabulary and tokens of the texts of each block, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, columns in gathered(batches, block_bytes):
            hashes, sizes = tokens_of(columns["text"])
            values = [number, len(hashes), columns["doc_id"], columns["held"], sizes.tolist(), *coded(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, BLOCK, strict=True)], schema=BLOCK)

    rows = docs.select("doc_id", "text", (base.crc_bucket("doc_id", modulus) == 0).alias("held"))
    return base.cut(rows.mapInArrow(run, "block long, n_tokens long, ids array<long>, held array<boolean>, sizes array<long>, vocabulary binary, tokens binary"))


BLOCK = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("tokens", pa.binary())])

def block_of(rows: pa.Table | pa.RecordBatch, i: int = 0) -> tuple[Block, np.ndarray]:
    """A row of blocks(), and which texts are for training."""
    base.tidy()
    get = lambda name: rows.column(rows.schema.get_field_index(name))[i].as_py()
    vocabulary, tokens = np.frombuffer(get("vocabulary"), dtype=np.int64), unpack(get("tokens"), get("n_tokens")).view(np.int64)
    return Block(vocabulary, tokens, np.array(get("sizes"), dtype=np.int64)), ~np.array(get("held"), dtype=bool)


def sent(number: int, block: Block, train: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    return by_part(number, block.keys[-1], block.training(train), parts, block.buckets())


class Smoothing:
    """Totals, and the weights of failure arcs by order (of their history) and bucket."""

    def __init__(self, figures: list[np.ndarray]):
        """figures: of each order, three rows of BUCKETS numbers."""
        self.n, self.v = (int(figures[0][i, 0]) for i in (0, 2)) if figures else (0, 0)
        self.fail = [(f[1] + 1.0) / (f[0] + 2.0) for f in figures[1:]]

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + SMOOTH) / (self.n + SMOOTH * (self.v + 1))


class Automaton:
    """The part of the automaton that a block can meet. State 0 is the root."""

    def __init__(self, block: Block, smoothing: Smoothing):
        orders, words = len(block.keys), len(block.word)
        count = block.count[0][block.own]
        self.known = count > 0
        p = np.zeros(len(block.keys[0]))
        p[block.own] = smoothing.root(count.astype(float))
        self.base = self.root = np.log10(p[block.own])
        # Histories of each order that are states get numbers; an n-gram leads to its longest suffix that is one.
        self.states, state = 1, []
        for k in range(max(1, orders - 1)):
            is_state = (block.count[k] >= LEAST) & (block.token[k] != block.end)
            state.append(np.where(is_state, self.states + np.cumsum(is_state) - 1, 0))
            self.states += int(is_state.sum())
        self.fail_to, self.fail = np.zeros(self.states, dtype=np.int64), np.zeros(self.states)
        keys, weights, targets = [], [], []
        leads = state[0]
        self.root_to = leads[block.own]
        for k in range(1, orders):
            c, history = block.count[k].astype(float), block.history[k]
            # The suffix of each n-gram, in the order below.
            suffix = block.at[k - 1][block.ends[k]]
            times = block.count[k - 1]
            fail = smoothing.fail[k - 1][bucket_of(times)]
            own = state[k - 1] > 0
            self.fail[state[k - 1][own]] = np.log10(fail[own])
            f = fail[history]
            p = (1 - f) * c / times[history] + f * p[suffix]
            arcs = c > 0
            lower = leads[suffix]
            leads = np.where(state[k] > 0, state[k], lower) if k < orders - 1 else lower
            if k < orders - 1:
                at = state[k] > 0
                self.fail_to[state[k][at]] = lower[at]
            keys.append((state[k - 1][history] * words + block.token[k])[arcs])
            weights.append(np.log10(p, where=arcs, out=np.zeros(len(p)))[arcs])
            targets.append(leads[arcs])
        key = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        order = np.argsort(key)
        self.arcs = key[order]
        self.weight, self.to = (np.concatenate(x)[order] if x else np.empty(0) for x in (weights, targets))
        self.words, self.start, self.reach = words, int(state[0][block.start]), max(1, orders - 1)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after the tokens, and the logarithms that lead there."""
        score, to = np.zeros(len(state)), np.zeros(len(state), dtype=np.int64)
        todo, state = np.arange(len(state)), state.copy()
        while len(todo):
            s, w = state[todo], token[todo]
            at_root = s == 0
            arc = np.zeros(len(todo), dtype=np.int64)
            found = at_root.copy()
            if len(self.arcs):
                key = s * self.words + w
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                found |= self.arcs[arc] == key
                by_arc = found & ~at_root
                score[todo[by_arc]] += self.weight[arc[by_arc]]
                to[todo[by_arc]] = self.to[arc[by_arc]]
            score[todo[at_root]] += self.root[w[at_root]]
            to[todo[at_root]] = self.root_to[w[at_root]]
            todo, s = todo[~found], s[~found]
            score[todo] += self.fail[s]
            state[todo] = self.fail_to[s]
        return to, score

    def traverse(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The score of each text, from left to right; many lanes take their steps side by side.

        A text longer than a lane goes on in the next one, which finds its state on the last tokens of the lane before.
        """
        n = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(sizes) - sizes)[text] + nth * LANE
        size = np.minimum(sizes[text] - nth * LANE, LANE)
        order = np.argsort(-size, kind="stable")
        start, size, later = start[order], size[order], nth[order] > 0
        state, score = np.where(later, 0, self.start), np.zeros(len(order))
        for back in range(self.reach, 0, -1):
            state[later], _ = self.step(state[later], tokens[start[later] - back])
        # Lanes are sorted by length: those that go on come first.
        live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        for i, m in enumerate(live.tolist()):
            state[:m], new = self.step(state[:m], tokens[start[:m] + i])
            score[:m] += new
        return np.bincount(text[order], weights=score, minlength=len(sizes))


def score(docs: DataFrame, modulus: int = 10, order: int = 3, block_bytes: int = 8 << 20, least_part: int = 1 << 20, most_part: int = 1 << 24) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the documents whose crc32(doc_id as text) mod modulus is not 0. A part sums up between least_part and
    most_part n-grams at a time, the more the larger the corpus is.
    """
    table = blocks(docs, modulus, block_bytes)
    tokens = table.agg(F.sum("n_tokens")).first()[0] or 0
    parts = parts_for(tokens, least_part, most_part)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield from sent(batch.column(0)[i].as_py(), *block_of(batch, i), parts)

    def learnt(texts: pa.Table, totals: pa.Table) -> tuple[Block, np.ndarray]:
        block, train = block_of(texts)
        rows = sorted((r["order"], r["part"], r["n"], r["totals"]) for r in totals.to_pylist())
        for k in range(1, rows[-1][0] + 1):
            if k > 1:
                block.grow()
            block.learn(np.concatenate([unpack(data, n) for o, _, n, data in rows if o == k] or [np.empty(0, dtype=U)]))
        return block, train

    def more(key: tuple, texts: pa.Table, totals: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return SENT.empty_table()
        block, train = learnt(texts, totals)
        block.grow()
        return pa.Table.from_batches(sent(key[0].as_py(), block, train, parts), schema=SENT)

    totals = summed(table.mapInArrow(first, SENT_DDL), 1, BUCKETS)
    for k in range(2, order + 1):
        rows = table.groupBy("block").cogroup(totals.where(F.col("block") != ALL).groupBy("block")).applyInArrow(more, SENT_DDL)
        totals = totals.unionByName(summed(rows, k, BUCKETS))
    figures = [np.zeros((3, BUCKETS), dtype=np.int64) for _ in range(order)]
    sums = totals.where(F.col("block") == ALL).mapInArrow(added, "order long, figures array<long>").select("order", F.posexplode("figures"))
    for r in sums.groupBy("order", "pos").agg(F.sum("col").alias("n")).collect():
        figures[r["order"] - 1].flat[r["pos"]] = r["n"]
    smoothing = Smoothing(figures)

    def run(key: tuple, texts: pa.Table, totals: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return out.empty_table()
        block, _ = learnt(texts, totals)
        automaton = Automaton(block, smoothing)
        heads, sizes = block.first, block.sizes
        known, low = (np.add.reduceat(x[block.tokens], heads) for x in (automaton.known.astype(np.int64), automaton.base))
        columns = [texts["ids"].combine_chunks().flatten(), texts["held"].combine_chunks().flatten(), sizes, known, np.full(len(sizes), smoothing.n), low, automaton.traverse(block.tokens, sizes)]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return table.groupBy("block").cogroup(totals.where(F.col("block") != ALL).groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
