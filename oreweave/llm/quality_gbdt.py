"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are counts and shares of the whole text (`quality_rules.count_batch` and a few more). Trees are grown
on at most `sample` labelled rows (documented bound: those with the smallest hashes), on features binned to 255
quantiles, by Newton steps on the logistic loss. The finished trees are flattened into arrays, a few hundred
kilobytes whatever the corpus holds, and all texts of a batch descend all trees together in numpy.

Defined cases: a null text is empty, and an empty one is scored as any other; rows without a label aren't
learnt from; repeated label rows count each; without usable labels of both classes the score is the share of
label 1 (0.5 without labels); no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave.llm import base, quality_rules

FEATURES = ["log_words", "log_chars", "word_length", "symbols", "dup_lines", "repeat_words", "log_lines", "ended_lines", "distinct", "capitals", "other", "digits", "bars", "marks", "not_ascii", "commas", "stops", "line_length", "longest_run", "numbers_in_words"]


def features(texts: list[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    counts = quality_rules.count_batch(texts).astype(float)
    words, chars, symbols, dup, repeat, lines, ended, distinct, upper, lower, other = counts.T
    more = np.zeros((len(texts), 8))
    for row, text in zip(more, texts, strict=True):
        raw = text.encode()
        kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        longest = max(map(len, raw.split()), default=0)
        row[:] = kinds[48:58].sum(), kinds[124], kinds[33] + kinds[63], kinds[128:].sum(), kinds[44], kinds[46], longest, len(raw)
    share = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log1p(words), np.log1p(chars), share(chars, words), share(symbols, words), share(dup, lines), share(repeat, words), np.log1p(lines), share(ended, lines),
        share(distinct, words), share(upper, upper + lower), share(other, chars), share(more[:, 0], chars), share(more[:, 1], words), share(more[:, 2], words), share(more[:, 3], more[:, 7]),
        share(more[:, 4], words), share(more[:, 5], words), share(chars, lines), np.log1p(more[:, 6]), share(more[:, 0], words),
    ])


class Trees:
    """Complete binary trees of one depth as arrays: inner nodes' feature and threshold, leaves' values."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 255, l2: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.start = 0.0
        self.feature = np.empty((0, 2**depth - 1), dtype=np.int64)
        self.threshold = np.empty((0, 2**depth - 1))
        self.leaf = np.empty((0, 2**depth))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            return self
        share = float(np.clip(y.mean(), 0.001, 0.999))
        self.start = float(np.log(share / (1 - share)))
        if y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        total, grown = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            feature, threshold, leaf, at = self._tree(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6))
            total += leaf[at]
            grown.append((feature, threshold, leaf))
        self.feature, self.threshold, self.leaf = (np.stack(v) for v in zip(*grown, strict=True))
        return self

    def _tree(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        size, width = 2**self.depth - 1, self.bins + 1
        feature, threshold = np.zeros(size, dtype=np.int64), np.full(size, np.inf)
        node = np.zeros(len(g), dtype=np.int64)
        for level in range(self.depth):
            first, nodes = 2**level - 1, 2**level
            best, where = np.full(nodes, 1e-6), np.full((nodes, 2), -1, dtype=np.int64)
            for f, column in enumerate(binned):
                key = (node - first) * width + column
                sums_g, sums_h = (np.bincount(key, weights=v, minlength=nodes * width).reshape(nodes, width).cumsum(1) for v in (g, h))
                all_g, all_h = sums_g[:, -1:], sums_h[:, -1:]
                gain = sums_g**2 / (sums_h + self.l2) + (all_g - sums_g) ** 2 / (all_h - sums_h + self.l2) - all_g**2 / (all_h + self.l2)
                gain[(sums_h < self.least) | (all_h - sums_h < self.least)] = 0
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    cut = gain.argmax(1)
                    value = gain[np.arange(nodes), cut]
                    better = value > best
                    best[better] = value[better]
                    where[better] = np.column_stack([np.full(nodes, f), cut])[better]
            for i, (f, cut) in enumerate(where.tolist()):
                if f >= 0:
                    feature[first + i], threshold[first + i] = f, edges[f][cut]
            split = where[node - first]
            right = (split[:, 0] >= 0) & (binned[np.maximum(split[:, 0], 0), np.arange(len(g))] > split[:, 1])
            node = 2 * node + 1 + right
        at = node - size
        sums = [np.bincount(at, weights=v, minlength=size + 1) for v in (g, h)]
        return feature, threshold, -self.rate * sums[0] / (sums[1] + self.l2), at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows go down all trees at once, level by level."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.leaf))[None, :]
        if len(self.leaf):
            node = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total = total + self.leaf[trees, node - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, seed: int) -> DataFrame:
    """doc_id, label, text of at most about `sample` labelled documents: those with the smallest hashes."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # At most about `sample` rows of two numbers: small enough for every executor by that bound.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, seed: int = 7) -> Trees:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_chunks(batches):
            x = features(base.texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    rows = labelled_sample(docs, labels, label, sample, seed).select("text", "label").mapInArrow(run, "label int, x array<double>").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same trees however the rows arrive
    return Trees().fit(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Labels are learnt from rows that aren't held out."""
    held = base.crc_bucket("doc_id", modulus) == rest
    trees = fit(docs, labels.where(~held), label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_chunks(batches):
            p = trees.predict(features(base.texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
