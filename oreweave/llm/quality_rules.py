"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated without labels.

Every rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). The votes of all
documents are summed up to patterns (at most 3 to the number of rules, whatever the corpus holds); expectation
maximisation over the counted patterns estimates the share of good documents and each rule's accuracy on good
and on bad ones. A document's verdict is the posterior probability of being good given its votes. The posterior
is a sum of constants, so it is applied as a column expression and nothing is joined.

Defined cases: a null text has no words and fails the base rules; texts of any length are counted whole;
repeated rows each count and get the same verdict; no rows give no rows; columns besides `text` pass through
`filter_documents` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreweave.llm import base

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct", "n_upper", "n_lower", "n_other"]

_UPPER, _LOWER = slice(65, 91), slice(97, 123)


def repeat_words(hashes: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Of each document, its words in windows that the same document holds twice or more."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(n_docs, dtype=np.int64)
    key = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(window):
        key = (key ^ hashes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + window, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def count_batch(texts: list[str]) -> np.ndarray:
    """A row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)), dtype=np.int64)
    words_of = []
    for row, text in zip(out, texts, strict=True):
        raw = text.encode()
        words = raw.split()  # bytes split at exactly the space and the controls 9 to 13
        words_of.append(words)
        kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        white = int(kinds[32] + kinds[9:14].sum())
        letters_more = len(raw) - int(kinds[128:].sum())
        upper, lower = int(kinds[_UPPER].sum()), int(kinds[_LOWER].sum())
        row[0] = len(words)
        row[1] = len(text) - white
        row[2] = sum(int(kinds[c]) for c in SYMBOLS)
        row[3] = len(lines) - len(set(lines))
        row[5:] = len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines), len(set(words)), upper, lower, letters_more - white - upper - lower
    flat = [w for words in words_of for w in words]
    hashes = np.fromiter(map(hash, flat), dtype=np.int64, count=len(flat)).view(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), out[:, 0])
    out[:, 4] = repeat_words(hashes, doc, len(texts))
    return out


def with_stats(docs: DataFrame) -> DataFrame:
    """The columns of docs and STATS, of each whole text."""
    docs = docs.drop(*STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_chunks(batches):
            stats = count_batch(base.texts_of(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(stats[:, i]) for i in range(len(STATS)))], [*batch.schema.names, *STATS])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in STATS)]))


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _share(part: str, whole: Column) -> Column:
    return F.when(whole > 0, F.col(part) / whole).otherwise(F.lit(0.0))


def rules() -> dict[str, Column]:
    """Votes of each rule."""
    words, lines = F.col("n_words"), F.col("n_lines")
    letters = F.col("n_upper") + F.col("n_lower")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    repeats, symbols, ended = _share("n_repeat_words", words), _share("n_symbols", words), _share("n_ended_lines", lines)
    dup, caps, distinct, other = _share("n_dup_lines", lines), _share("n_upper", letters), _share("n_distinct", words), _share("n_other", F.col("word_chars"))
    length = _share("word_chars", words)
    return {
        "length": vote(words < 10, words >= 40),
        "word_length": vote((length < 2) | (length > 14), (length >= 3) & (length <= 10)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "symbol_runs": vote(symbols > 0.25, symbols < 0.05),
        "dup_lines": vote(dup > 0.3, (lines >= 2) & (dup < 0.1)),
        "repeats": vote(repeats > 0.2, (words >= 40) & (repeats < 0.05)),
        "capitals": vote(caps > 0.5, caps < 0.25),
        "variety": vote((words >= 40) & (distinct < 0.15), (words >= 40) & (distinct > 0.3)),
        "line_ends": vote((lines >= 3) & (ended < 0.1), (lines >= 2) & (ended > 0.5)),
        "punctuation": vote(other > 0.25, other < 0.12),
    }


class LabelModel:
    """Two classes, conditionally independent rules; a rule's abstention says nothing.

    A rule is an expert on one kind of fault: it seldom speaks against a good document, and a bad document is
    found by few rules. So the two accuracies of a rule are estimated apart: on good documents between `honest`
    and 1, on bad ones (where most rules see nothing wrong) from `seen` up.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, honest: float = 0.9, seen: float = 0.02):
        """patterns: votes (-1, 0, 1), a row each; counts: documents of each.

        Starts from the documents that no rule speaks against as good ones, which also fixes which class is which.
        """
        weight = counts.astype(float)
        good = np.where((patterns == -1).any(axis=1), 0.1, 0.95)
        self.prior, self.right = 0.5, np.full((2, patterns.shape[1]), 0.7)
        low, high = np.array([[honest], [seen]]), np.array([[0.9995], [0.98]])
        for _ in range(rounds if weight.sum() else 0):
            self.prior = float(np.clip((weight * good).sum() / weight.sum(), 0.02, 0.98))
            right = np.empty_like(self.right)
            for k, (p, sign) in enumerate(((good, 1), (1 - good, -1))):
                cast = (weight * p) @ (patterns != 0)
                right[k] = ((weight * p) @ (patterns == sign) + 1.0) / (cast + 2.0)
            right = np.clip(right, low, high)
            done = np.abs(right - self.right).max() < 1e-9
            self.right = right
            good = self.posterior(patterns)
            if done:
                break

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of the prior, of a good vote and of a bad vote of each rule."""
        right_good, right_bad = self.right
        return math.log(self.prior / (1 - self.prior)), np.log(right_good / (1 - right_bad)), np.log((1 - right_good) / right_bad)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        prior, up, down = self.weights()
        return 1 / (1 + np.exp(-(prior + (patterns == 1) @ up + (patterns == -1) @ down)))

    def expression(self, votes: dict[str, Column]) -> Column:
        prior, up, down = self.weights()
        odds = F.lit(prior)
        for vote, u, d in zip(votes.values(), up.tolist(), down.tolist(), strict=True):
            odds = odds + F.when(vote == 1, u).when(vote == -1, d).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(stats: DataFrame) -> LabelModel:
    """The label model of all rows. Collected: one row for each pattern of votes, 3^10 at most."""
    votes = rules()
    rows = stats.select(*(c.alias(name) for name, c in votes.items())).groupBy(*votes).agg(F.count("*").alias("n")).orderBy(*votes).collect()
    patterns = np.array([[r[name] for name in votes] for r in rows], dtype=np.int64).reshape(-1, len(votes))
    return LabelModel(patterns, np.array([r["n"] for r in rows], dtype=np.int64))


def judge(stats: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Adds quality (the posterior), base_failed and kept."""
    out = stats.drop("quality", "base_failed", "kept").withColumns({"quality": model.expression(rules()), "base_failed": base_failed()})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, STATS, quality, base_failed, kept of every document."""
    stats = base.cut(with_stats(docs.select("doc_id", "text")).drop("text"))
    return judge(stats, fit(stats))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of docs, with its columns. Texts are counted once: rows and counts are written, and read twice."""
    rows = base.cut(with_stats(base.wrap(docs, "text")))
    return base.unwrap(judge(rows, fit(rows.select(*STATS))).where("kept"), docs.columns, "text")
