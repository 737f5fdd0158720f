"""Exact repeated windows across documents by a depth-limited, most-significant-digit radix sort of suffixes.

Every window of `width` bytes that also starts in a document with a smaller id is to go. Suffixes need to be
ordered through `width` bytes only, and few of them: of each window's `width - digit + 1` substrings of `digit`
bytes, the one with the smallest hash (leftmost of equals) is its anchor. The anchor depends on the window's
bytes alone, so equal windows have equal anchors at equal offsets, and suffixes are sorted from the anchors, one
for about every fourteen bytes.

Pass 1 orders anchors by their first digit (a hash of the anchor's bytes) and within it by the second (a hash of
all bytes of the anchor's windows). A first digit that one document has alone ends there. Of equal first and second
digits all but the smallest document lose all windows of the anchor. What is left in groups of unlike second
digits goes to pass 2, which orders single windows by a 128-bit hash of their `width` bytes. In both passes equal
rows within a block of text are reduced to the smallest document before anything is shuffled, so the rows of a
passage that a third of all documents share are few; anchors of periodic text that follow one upon the other are one row.
Sorted rows are read as a stream: of a group only the rows of its first key wait, `HELD` at most. Texts are shuffled twice,
by document, to meet what was found in them.

Digits are hashes of bytes, as equality of windows counts and not their order. Unlike windows are taken for equal with a
probability of 2^-128 a pair, and of 2^-64 if they have the bytes of their anchor in common. Defined cases: a null text is empty; texts
shorter than `width` lose nothing; rows with a null doc_id keep all and take nothing from others; rows of equal
doc_id aren't compared with each other, and each is resolved by its own text; periodic texts and very long texts
are treated whole; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oreweave.llm import base

U = np.uint64
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A place in a text as one long: 24 bits of the text's hash (rows of one doc_id may have different texts),
#: 31 bits of offset (no text of Spark's is longer), 8 bits for the number of windows from there.
_TAG, _AT, _COUNT = 39, 8, 0xFF
#: Rows that may wait for a second key of their digit.
HELD = 1 << 16
BLOCK = 1 << 20


class Powers:
    """Powers of an odd multiplier modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, multiplier: int):
        self.multiplier, self.inverse = U(multiplier), U(pow(multiplier, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n + n // 4, BLOCK + BLOCK // 4)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, m, dtype=U)])) for m in (self.multiplier, self.inverse))


_powers = tuple(map(Powers, _MULTIPLIERS))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Hashes:
    """Prefix hashes of a block of bytes; any substring's hash is a difference, moved to the origin."""

    def __init__(self, data: np.ndarray, which: int):
        self.p, n = _powers[which], len(data)
        self.p.grow(n + 1)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * self.p.up[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[: len(self.sums) - length]) * self.p.down[: len(self.sums) - length]

    def some(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.p.down[starts]


def windowed_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[: len(x) - size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(data: np.ndarray, doc: np.ndarray, width: int, digit: int) -> tuple[np.ndarray, ...]:
    """first digit, second digit, start of the first window, number of windows, of each anchor in a block of texts."""
    n = len(data)
    empty = np.empty(0, dtype=np.int64)
    if n < width:
        return empty.view(U), empty.view(U), empty, empty
    one, two = Hashes(data, 0), Hashes(data, 1)
    h = mixed(one.every(digit))
    bits = U(max(20, int(n).bit_length()))
    order = (h >> bits << bits) | np.arange(len(h), dtype=U)
    least = windowed_min(order, width - digit + 1)
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    if not len(starts):
        return empty.view(U), empty.view(U), empty, empty
    at = (least[starts] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.empty(len(starts), dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin, anchor = starts[first], at[first]
    second = mixed(two.some(begin, width + count - 1) ^ (U(1) + (anchor - begin).astype(U) * U(0x632BE59BD9B4E019) + count.astype(U)))
    return joined(h[anchor], second, begin, count, doc)


def joined(key1: np.ndarray, key2: np.ndarray, begin: np.ndarray, count: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors with those of the same digits that follow one upon the other made one: periodic text has few."""
    more = np.zeros(len(begin), dtype=bool)
    more[1:] = (key1[1:] == key1[:-1]) & (key2[1:] == key2[:-1]) & (begin[1:] == begin[:-1] + count[:-1]) & (doc[begin[1:]] == doc[begin[:-1]])
    if not more.any():
        return key1, key2, begin, count
    before = np.cumsum(count) - count
    first = np.maximum.accumulate(np.where(more, 0, np.arange(len(begin))))
    # As many windows as a place can tell, less one anchor's.
    part = (before - before[first]) // (_COUNT - int(count.max()))
    heads = np.flatnonzero(~more | (part != np.append(-1, part[:-1])))
    return key1[heads], key2[heads], begin[heads], np.add.reduceat(count, heads)


def reduced(key1: np.ndarray, key2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the rows whose key also has a smaller document in this block."""
    order = np.lexsort((doc, key2, key1))
    a, b, d = key1[order], key2[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else d
    out = np.zeros(len(order), dtype=bool)
    out[order] = d > least
    return out


def text_tag(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=3).digest(), "big")


class Block:
    """Some texts as one array of bytes."""

    def __init__(self, ids: list[int], raws: list[bytes]):
        sizes = np.array([len(r) for r in raws], dtype=np.int64)
        self.data = np.frombuffer(b"".join(raws), dtype=np.uint8)
        self.doc = np.repeat(np.arange(len(raws), dtype=np.int32), sizes)
        self.base = np.cumsum(sizes) - sizes
        self.ids = np.array(ids, dtype=np.int64)
        self.tags = np.array([text_tag(r) for r in raws], dtype=np.int64)

    def place(self, starts: np.ndarray, count: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and packed place of window starts in the block."""
        doc = self.doc[starts]
        return self.ids[doc], (self.tags[doc] << _TAG) | ((starts - self.base[doc]) << _AT) | count


ROWS = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("gone", pa.bool_())])
ROWS_DDL = "key1 long, key2 long, doc long, place long, gone boolean"
FOUND = pa.schema([("doc", pa.int64()), ("place", pa.int64()), ("gone", pa.bool_())])
FOUND_DDL = "doc long, place long, gone boolean"


def _rows(key1: np.ndarray, key2: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    gone = reduced(key1, key2, doc)
    # Settled rows only pass by; they are dealt by document.
    key1 = np.where(gone, mixed(doc.view(U)), key1)
    return pa.RecordBatch.from_arrays([pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(doc), pa.array(place), pa.array(gone)], schema=ROWS)


def _blocks(batches: Iterator[pa.RecordBatch], with_ids: bool = True) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    for batch in base.text_chunks(batches, BLOCK):
        yield batch, batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), [t.encode() for t in base.texts_of(batch)]


def first_pass(docs: DataFrame, width: int, digit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, raws in _blocks(batches):
            keep = [i for i, (d, r) in enumerate(zip(ids, raws, strict=True)) if d is not None and len(r) >= width]
            if keep:
                block = Block([ids[i] for i in keep], [raws[i] for i in keep])
                key1, key2, begin, count = anchors(block.data, block.doc, width, digit)
                yield _rows(key1, key2, *block.place(begin, count))

    return docs.select("doc_id", "text").mapInArrow(run, ROWS_DDL)


def settle(rows: DataFrame, deepen: bool) -> DataFrame:
    """doc, place, gone of the rows that have something to say.

    gone: a smaller document has the same key. With deepen, also (gone false) the smallest of each key wherever
    the first digit goes on in more than one way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is open at the end of a batch: the digit, the key, its smallest document, how many keys the digit
        # has had, its documents' range, and rows that wait for a second key of the digit.
        last = None
        waiting: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            k1, k2, doc, place = (batch.column(i).to_numpy() for i in range(4))
            settled = batch.column(4).to_numpy(zero_copy_only=False)
            out_doc, out_place = [doc[settled]], [place[settled]]
            k1, k2, doc, place = (x[~settled] for x in (k1, k2, doc, place))
            n = len(k1)
            deep_doc, deep_place = [], []
            if n:
                new1, new2 = np.ones(n, bool), np.ones(n, bool)
                new1[1:] = k1[1:] != k1[:-1]
                new2[1:] = new1[1:] | (k2[1:] != k2[:-1])
                goes_on = last is not None and last["k1"] == k1[0]
                same_key = goes_on and last["k2"] == k2[0]
                first = np.maximum.accumulate(np.where(new2, np.arange(n), 0))
                least = doc[first]
                if same_key:
                    least[first == 0] = last["least"]
                gone = doc > least
                out_doc.append(doc[gone])
                out_place.append(place[gone])
                heads = np.flatnonzero(new1)
                keys = np.add.reduceat(new2.astype(np.int64), heads)
                low, high = np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)
                if goes_on:
                    keys[0] += last["keys"] - same_key
                    low[0], high[0] = min(low[0], last["low"]), max(high[0], last["high"])
                if deepen:
                    # The last digit may go on in the next batch: its first key waits, more keys are taken as shared.
                    many = (keys > 1) & (low < high)
                    many[-1] = keys[-1] > 1
                    group = np.cumsum(new1) - 1
                    take = ~gone & many[group]
                    deep_doc.append(doc[take])
                    deep_place.append(place[take])
                    if goes_on and many[0] and len(waiting[0]):
                        deep_doc.append(waiting[0])
                        deep_place.append(waiting[1])
                    hold = ~gone & (group == group[-1]) if keys[-1] == 1 else np.zeros(n, bool)
                    kept = waiting if goes_on and len(heads) == 1 and keys[-1] == 1 else (waiting[0][:0], waiting[1][:0])
                    waiting = (np.concatenate([kept[0], doc[hold]]), np.concatenate([kept[1], place[hold]]))
                    if len(waiting[0]) > HELD:
                        # Deeper places than needed are only more work.
                        deep_doc.append(waiting[0])
                        deep_place.append(waiting[1])
                        waiting = (waiting[0][:0], waiting[1][:0])
                last = {"k1": k1[-1], "k2": k2[-1], "least": least[-1], "keys": keys[-1], "low": low[-1], "high": high[-1]}
            d = np.concatenate(out_doc + deep_doc)
            p = np.concatenate(out_place + deep_place)
            done = np.arange(len(d)) < sum(map(len, out_doc))
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(p), pa.array(done)], schema=FOUND)

    return rows.repartition("key1").sortWithinPartitions("key1", "key2", "doc").mapInArrow(run, FOUND_DDL)


def _with_places(docs: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """docs with the arrays of places that were found in them."""
    lists = found.groupBy("doc").agg(*(F.collect_list(F.when(F.col("kind") == i, F.col("place"))).alias(name) for i, name in enumerate(names)))
    return docs.join(lists, docs["doc_id"] == lists["doc"], "left").drop("doc")


def _places(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of arrays."""
    column = batch.column(batch.schema.get_field_index(name))
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def second_pass(docs: DataFrame, deeper: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, raws in _blocks(batches):
            flat, cut = _places(batch, "deeper")
            block = Block([i if i is not None else -1 for i in ids], raws)
            row = np.repeat(np.arange(len(ids)), np.diff(cut))
            own = (flat >> _TAG) == block.tags[row]
            flat, row = flat[own], row[own]
            if not len(flat):
                continue
            count = flat & _COUNT
            begin = block.base[row] + ((flat >> _AT) & ((1 << (_TAG - _AT)) - 1))
            starts = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
            one, two = (mixed(Hashes(block.data, i).some(starts, width)) for i in (0, 1))
            yield _rows(one, two, *block.place(starts, 1))

    joined = _with_places(docs.select("doc_id", "text").where("doc_id is not null"), deeper.withColumn("kind", F.lit(0)), ["deeper"])
    return joined.where("deeper is not null").mapInArrow(run, ROWS_DDL)


def spans(places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the places' windows cover."""
    start = (places >> _AT) & ((1 << (_TAG - _AT)) - 1)
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + (places & _COUNT) + width - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return start[heads], reach[np.append(heads[1:], len(start)) - 1] if len(start) else end


def repeated(docs: DataFrame, width: int = 50, digit: int = 24) -> DataFrame:
    """The columns of docs and `places`: the windows (packed) that also start in a document with a smaller doc_id."""
    docs = docs.drop("places", "doc", "deeper")
    found = base.cut(settle(first_pass(docs, width, digit), deepen=True))
    deep = base.cut(settle(second_pass(docs, found.where("not gone"), width), deepen=False))
    return _with_places(docs, found.where("gone").unionByName(deep).withColumn("kind", F.lit(0)), ["places"])


def _own(places: np.ndarray, raw: bytes) -> np.ndarray:
    return places[(places >> _TAG) == text_tag(raw)] if len(places) else places


def report(docs: DataFrame, width: int = 50, digit: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, raws in _blocks(batches):
            flat, cut = _places(batch, "places")
            removed, runs, digests = [], [], []
            for raw, a, b in zip(raws, cut, cut[1:], strict=False):
                start, end = spans(_own(flat[a:b], raw), width)
                kept, at = hashlib.sha256(), 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                removed.append(int((end - start).sum()))
                runs.append(len(start))
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated(docs.select("doc_id", "text"), width, digit).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, width: int = 50, digit: int = 24) -> DataFrame:
    """docs with the repeated bytes taken out of `text`; a character goes if all of its bytes go. n_chars follows, if there is one."""
    plain = ("doc_id", "text", "n_chars")
    rows = base.wrap(docs, *plain)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, raws in _blocks(batches):
            flat, cut = _places(batch, "places")
            texts = []
            for raw, a, b in zip(raws, cut, cut[1:], strict=False):
                parts, at = [], 0
                for s, e in zip(*(x.tolist() for x in spans(_own(flat[a:b], raw), width)), strict=True):
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    parts.append(raw[at:s])
                    at = e
                texts.append(b"".join([*parts, raw[at:]]).decode())
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in names], names)

    schema = T.StructType([T.StructField("n_chars", T.LongType()) if f.name == "n_chars" else f for f in rows.schema.fields])
    return base.unwrap(repeated(rows, width, digit).select(*names, "places").mapInArrow(run, schema), docs.columns, *plain)
