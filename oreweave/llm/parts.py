"""Counts of distinct keys over the whole corpus, for blocks of texts that each know their own keys only.

Each block sends its distinct keys, sorted, as differences, to the parts that own ranges of the keys. A part sums up
what all blocks have sent and sends the totals back in the order in which the keys came, so no key travels twice.
Keys are hashes of 64 bits: parts are even, and a hot key has one entry a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from oreweave.llm import base

U = np.uint64
#: Of a block that is none: rows for all blocks together.
ALL = -1
SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("buckets", pa.binary())])
SENT_DDL = "part long, block long, n long, least long, keys binary, counts binary, buckets binary"
TOTALS = pa.schema([("block", pa.int64()), ("order", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("totals", pa.binary())])
TOTALS_DDL = "block long, order long, part long, n long, totals binary"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def longer(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys of histories followed by tokens, both given by their keys."""
    return mixed(history * U(0x9E3779B97F4A7C15) + token)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers, lowest bytes of all first; as many bytes each as the largest needs."""
    x = np.ascontiguousarray(x, dtype=U)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : data[0]] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], n).T
    return out.reshape(-1).view(U)


class Distinct:
    """Sorted distinct keys; a place of each among the keys given, and each one's number."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        s = keys[self.order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        self.heads = np.flatnonzero(new)
        self.keys, self.place = s[self.heads], self.order[self.heads]
        self.number = np.empty(len(s), dtype=np.int64)
        self.number[self.order] = np.cumsum(new) - 1

    def total(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.order], self.heads) if len(self.heads) else np.zeros(0, dtype=np.int64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and how many each text has."""
    words = [t.encode().lower().split() for t in texts]  # bytes: A-Z and white space 9 to 13 and 32 only
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((h for w in words for h in map(digest, w)), dtype=U, count=int(sizes.sum())).view(np.int64), sizes


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, dict[str, list]]]:
    """A number of its own and the columns (`text` without nulls) of blocks of rows with about `most` characters of text."""
    number, size, out = TaskContext.get().partitionId() << 32, 0, {}
    for batch in base.text_chunks(batches):
        for name in batch.schema.names:
            new = base.texts_of(batch) if name == "text" else batch.column(batch.schema.get_field_index(name)).to_pylist()
            out.setdefault(name, []).extend(new)
            size += sum(map(len, new)) if name == "text" else 0
        if size >= most:
            yield number, out
            number, size, out = number + 1, 0, {}
            base.tidy()
    if out:
        yield number, out


def coded(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct hashes, and their packed numbers. Frequent ones get small numbers, whose upper bytes compress well."""
    vocabulary, number, times = np.unique(hashes, return_inverse=True, return_counts=True)
    often = np.argsort(-times, kind="stable")
    rank = np.empty_like(often)
    rank[often] = np.arange(len(often))
    return vocabulary[often].tobytes(), pack(rank[number])


def parts_for(keys: int, least: int, most: int) -> int:
    """How many parts sum up so many keys: between least and most at a time, the more the more there are."""
    return max(1, math.ceil(keys / min(max(least, 64 * math.isqrt(keys)), most)))


def by_part(number: int, keys: np.ndarray, counts: np.ndarray, parts: int, buckets: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys, their counts and buckets, cut by the parts that own them."""
    buckets = np.zeros(len(keys), dtype=np.int64) if buckets is None else buckets
    part = (((keys >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(keys) else np.empty(0, dtype=np.int64)
    start, out = 0, []
    for end in ends.tolist():
        own = keys[start:end]
        out.append((int(part[start]), number, end - start, int(own[:1].view(np.int64)[0]), pack(np.diff(own)), pack(counts[start:end]), pack(buckets[start:end])))
        start = end
    for i in range(0, len(out), 64):
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out[i : i + 64], strict=True), SENT, strict=True)], schema=SENT)


def summed(rows: DataFrame, order: int = 1, buckets: int = 1) -> DataFrame:
    """Totals of what the blocks have sent, as they have sent it; rows of block ALL have the figures of the buckets.

    These are, for each bucket: the sum of all counts, keys counted once, keys counted at all.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, who, sizes, keys, counts, of = key[0].as_py(), [], [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                n, least = r["n"], np.array([r["least"]]).view(U)
                who.append(r["block"])
                sizes.append(n)
                keys.append(np.cumsum(np.concatenate([least, unpack(r["keys"], n - 1)]), dtype=U))
                counts.append(unpack(r["counts"], n).astype(np.int64))
                of.append(unpack(r["buckets"], n).astype(np.uint8))
        found = Distinct(np.concatenate(keys))
        sums, bucket = found.total(np.concatenate(counts)), np.concatenate(of)[found.place]
        figures = np.stack([np.bincount(bucket, weights=w, minlength=buckets) for w in (sums, sums == 1, sums > 0)]).astype(np.int64)
        totals = sums[found.number]
        out, start = [(ALL, order, part, figures.size, figures.tobytes())], 0
        for block, n in zip(who, sizes, strict=True):
            out.append((block, order, part, n, pack(totals[start : start + n])))
            start += n
        for i in range(0, len(out), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out[i : i + 1024], strict=True), TOTALS, strict=True)], schema=TOTALS)
        base.tidy()

    return base.cut(rows.groupBy("part").applyInArrow(run, TOTALS_DDL))


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The figures of each order, added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            sums[r["order"]] = sums.get(r["order"], 0) + np.frombuffer(r["totals"], dtype=np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()])], ["order", "figures"])
