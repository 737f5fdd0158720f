"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are at most `examples` labelled documents, half of each class as far as there are (documented bound,
those with the smallest hashes); everything that is sent to executors is bounded by them. The space is that of
all terms of the examples: words in lower case, less the ASCII punctuation around them (words of nothing else stay as
they are). Their document frequencies are counted over all documents; weights are
(1 + log tf) log((1 + n) / (1 + df)), vectors have length one.

Examples of like vocabulary stand side by side in blocks. For each term and block the index has the largest
weight, so the sum over a text's terms bounds every cosine in the block. The blocks of the highest bounds are
searched first, then only those whose bound exceeds the k-th best cosine so far: neighbours are exact. Their
votes, weighted by squared cosine, are turned into probabilities by a logistic curve of the vote and of how many
telling terms the text has (terms whose presence depends on the label: chi-square of one degree of freedom of at least
`least_chi2`, in three examples or more; they bear on the curve alone, not on the neighbours), fitted to the votes that examples get from the other examples, with classes weighted as
in all labels. The neighbours are the evidence.

Defined cases: a null text is empty; texts without a term of another example get the weighted share of label 1 among
examples without one, and no evidence; ties of cosines go to the example with the smaller doc_id; repeated label rows
give repeated examples; without examples of both classes every score is the share of label 1 (0.5 without
labels); no rows give no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave.llm import base

BLOCK = 64
PUNCTUATION = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    return [w.strip(PUNCTUATION) or w for w in text.encode().lower().split()]


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes (64 bits) and their counts."""
    words = words_of(text)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)
    return np.unique(hashes, return_counts=True)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Examples as postings by term and block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], vocabulary: np.ndarray, df: np.ndarray, n: int, prior: float, k: int = 24, telling: np.ndarray | None = None):
        self.vocabulary, self.prior, self.k = vocabulary, prior, k
        self.telling = np.ones(len(vocabulary), bool) if telling is None else np.isin(vocabulary, telling)
        self.idf = np.log((1.0 + n) / (1.0 + df))
        order = self._side_by_side(ids, terms, counts)
        self.ids, self.labels = ids[order], labels[order].astype(float)
        vectors = [self.vector(terms[i], counts[i]) for i in order]
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        by_term = np.lexsort((example, term))
        term, self.example, self.weight = term[by_term], example[by_term], weight[by_term]
        blocks = self.example // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (blocks[1:] != blocks[:-1])
        self.entry = np.flatnonzero(new)
        self.entry_size = np.diff(np.append(self.entry, len(term)))
        self.entry_block = blocks[self.entry]
        self.entry_max = np.maximum.reduceat(self.weight, self.entry) if len(term) else self.weight
        self.term_entry = np.searchsorted(term[self.entry], np.arange(len(vocabulary) + 1))
        self.blocks = -(-len(ids) // BLOCK)
        self.silent = prior
        self.curve = np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))])
        self._calibrate([terms[i] for i in order], [counts[i] for i in order])

    def _side_by_side(self, ids: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]) -> list[int]:
        """Sorted by each example's heaviest term, then by id."""
        keys = []
        for t, c in zip(terms, counts, strict=True):
            at, weight = self.vector(t, c)
            keys.append(int(at[np.argmax(weight)]) if len(at) else -1)
        return sorted(range(len(ids)), key=lambda i: (keys[i], int(ids[i])))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of a text, of length one."""
        if not len(self.vocabulary) or not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms
        at = at[known]
        weight = (1 + np.log(counts[known])) * self.idf[at]
        length = np.sqrt((weight**2).sum())
        return (at, weight / length) if length > 0 else (at[:0], weight[:0])

    def mass(self, terms: np.ndarray, counts: np.ndarray) -> float:
        """How much of the telling terms a text holds: the logarithm of their vector's length before scaling."""
        at, _ = self.vector(terms, np.ones_like(counts))
        at = at[self.telling[at]]
        return float(np.log1p(np.sqrt((self.idf[at] ** 2).sum()))) if len(at) else 0.0

    def search(self, terms: np.ndarray, weights: np.ndarray, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest cosine above 0, best first, and the cosines."""
        scores = np.zeros(len(self.ids))
        if len(terms):
            first = self.term_entry[terms]
            size = self.term_entry[terms + 1] - first
            entries, query = _ranges(first, size), np.repeat(weights, size)
            block = self.entry_block[entries]
            bounds = np.bincount(block, weights=query * self.entry_max[entries], minlength=self.blocks)
            order = np.argsort(-bounds, kind="stable")
            todo = np.zeros(self.blocks, bool)
            todo[order[: max(1, self.blocks // 4)]] = True
            done = np.zeros(self.blocks, bool)
            while todo.any():
                take = todo[block]
                part, sizes = entries[take], self.entry_size[entries[take]]
                postings = _ranges(self.entry[part], sizes)
                scores += np.bincount(self.example[postings], weights=self.weight[postings] * np.repeat(query[take], sizes), minlength=len(scores))
                done |= todo
                if but >= 0:
                    scores[but] = 0
                kth = np.partition(scores, -self.k)[-self.k] if len(scores) >= self.k else 0.0
                todo = ~done & (bounds >= kth) & (bounds > 0)
        positive = np.flatnonzero(scores > 0)
        if len(positive) > self.k:
            kth = np.partition(scores[positive], -self.k)[-self.k]
            positive = positive[scores[positive] >= kth]
        best = positive[np.lexsort((self.ids[positive], -scores[positive]))][: self.k]
        return best, scores[best]

    def vote(self, best: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 by squared cosine; of no neighbours, nan."""
        weight = cosines**2
        return float((weight * self.labels[best]).sum() / weight.sum()) if len(best) else float("nan")

    @staticmethod
    def _inputs(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
        return np.column_stack([votes, mass, votes * mass, np.ones(len(votes))])

    def _calibrate(self, terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """A logistic curve over the votes of the other examples, classes weighted to the prior."""
        if not len(self.labels) or self.labels.min() == self.labels.max():
            return
        votes = np.array([self.vote(*self.search(*self.vector(t, c), but=i)) for i, (t, c) in enumerate(zip(terms, counts, strict=True))])
        mass = np.array([self.mass(t, c) for t, c in zip(terms, counts, strict=True)])
        some = np.isfinite(votes)
        share = self.labels.mean()
        weight = np.where(self.labels == 1, self.prior / share, (1 - self.prior) / (1 - share))
        quiet = weight[~some]
        self.silent = float((quiet @ self.labels[~some] + self.prior) / (quiet.sum() + 1))
        x, y = self._inputs(votes[some], mass[some]), self.labels[some]
        weight = weight[some]
        beta = self.curve
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + 0.01 * beta
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(beta))
            step = np.linalg.solve(hessian, gradient)
            # Short steps: from far off, Newton's own overshoot.
            step *= min(1.0, 1.0 / np.abs(step).max())
            beta = beta - step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = beta

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability of label 1, and the evidence: neighbours and cosines."""
        terms, counts = term_counts(text)
        best, cosines = self.search(*self.vector(terms, counts))
        vote = self.vote(best, cosines)
        if vote != vote:
            return self.silent, best, cosines
        x = self._inputs(np.array([vote]), np.array([self.mass(terms, counts)]))
        return float(1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))[0]), best, cosines


def _examples(docs: DataFrame, known: DataFrame, sizes: dict[int, int], examples: int, seed: int) -> DataFrame:
    half = examples // 2
    limit = {c: int(min(1.0, half / max(sizes.get(c, 0), 1)) * (1 << 30)) for c in (0, 1)}
    hashed = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    picked = known.where(hashed < F.when(F.col("label") == 1, limit[1]).otherwise(limit[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_chunks(batches):
            found = [term_counts(t) for t in base.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "label")] + [pa.array([list(x[i]) for x in found], pa.list_(pa.int64())) for i in (0, 1)], ["doc_id", "label", "terms", "counts"])

    # At most about `examples` rows of two numbers: small enough for every executor by that bound.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, terms array<long>, counts array<long>")


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in base.text_chunks(batches):
            for text in base.texts_of(batch):
                n += 1
                words = set(words_of(text))
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                df[at[vocabulary[at] == hashes]] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums["term"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def telling_terms(terms: list[np.ndarray], labels: np.ndarray, least_chi2: float) -> np.ndarray:
    """The sorted terms whose presence in examples depends on the label."""
    if not terms:
        return np.empty(0, np.int64)
    term, at = np.unique(np.concatenate(terms), return_inverse=True)
    label = np.repeat(labels.astype(float), [len(t) for t in terms])
    in_one, in_all = np.bincount(at, weights=label, minlength=len(term)), np.bincount(at, minlength=len(term)).astype(float)
    n, ones = float(len(labels)), float(labels.sum())
    spread = in_all * (n - in_all) * ones * (n - ones)
    chi2 = np.where(spread > 0, n * (in_one * (n - ones) - (in_all - in_one) * ones) ** 2 / np.maximum(spread, 1), 0.0)
    return term[(chi2 >= least_chi2) & (in_all >= 3)]


def build(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = 2048, seed: int = 6, least_chi2: float = 20.0) -> Index:
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    prior = min(max(prior, 0.001), 0.999)
    rows = _examples(docs, known, sizes, examples, seed).toArrow().sort_by("doc_id")
    terms, counts = ([x.values.to_numpy(zero_copy_only=False) for x in rows[c]] for c in ("terms", "counts"))
    own = rows["label"].to_numpy().astype(np.int64)
    vocabulary = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.int64)
    df, n = frequencies(docs, vocabulary) if len(vocabulary) else (vocabulary, 0)
    return Index(rows["doc_id"].to_numpy(), own, terms, counts, vocabulary, df, n, prior, telling=telling_terms(terms, own, least_chi2))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, threshold: float = 0.7, label: str = "toxic", shown: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (the nearest examples' doc_id, label, cosine) of every document."""
    held = base.crc_bucket("doc_id", modulus) == rest
    index = docs.sparkSession.sparkContext.broadcast(build(docs, labels.where(~held), label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in base.text_chunks(batches):
            found = [own.score(t) for t in base.texts_of(batch)]
            p = np.array([x[0] for x in found], dtype=float)
            evidence = [[{"doc_id": int(own.ids[i]), "label": int(own.labels[i]), "cosine": float(c)} for i, c in zip(best[:shown], cosines[:shown], strict=True)] for _, best, cosines in found]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")] + [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, label: int, cosine: double>>")
