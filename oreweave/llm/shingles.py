"""Near copies by word shingles: operator 4's near pairs of SimHash fingerprints, completed to all pairs of texts whose sets of
shingles have a Jaccard similarity of `share` or more.

Equal texts are merged first, by 64-bit hashes. Texts are gathered to blocks, and the texts that hold each shingle are
counted over all blocks, as the n-grams of op1 are. Fingerprints of the sets of shingles are paired by vantage-point trees
within `radius` bits. That leaves most near copies apart (their fingerprints differ in 3 to 11 bits), so an exact search
follows. The shingles of each text are put in one order, rare ones first. Of the m shingles of a text, two texts can only
be similar if they share one of their first m - ceil(share m) + 1; these are met by shingle, in two steps:

1. The text with the smallest part of shingles of its own is the hub of a shingle, and is compared with the others that
   have it: one row a text and shingle, however many texts are near copies of each other. Links join them up.
2. Where a shingle's texts are then in more than one component, those outside its largest component meet the texts of
   other components, once a pair. Texts that are similar to none of a group seldom come so far: shingles of their own are
   in no other text, and places and sizes bound what a pair can share.

Pairs that are met are compared by their whole sets. Nothing is left out: the links that are not looked for are within
components. Pairs, sets and links are exact but for hashes of 64 bits.

Defined cases: a null text is empty; no words are one shingle, of no bytes; with fewer words than a shingle the whole
sequence is the one shingle; rows without a doc_id never name a component unless all of its rows have none; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreweave.llm import base, simhash
from oreweave.llm.parts import ALL, SENT, SENT_DDL, Distinct, U, by_part, coded, gathered, longer, mixed, parts_for, summed, unpack, word_hashes

SHARE = Fraction(4, 5)
BLOCK = pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("fps", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("tokens", pa.binary())])
LISTS = pa.list_(pa.int64())
TEXTS = pa.schema([("fp", pa.int64()), ("size", pa.int64()), ("lone", pa.int64()), ("print", pa.int64()), ("keys", LISTS), ("at", LISTS), ("shingles", LISTS)])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Ids, text hashes and words of the texts of each block, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, columns in gathered(batches, block_bytes):
            hashes, sizes = word_hashes(columns["text"])
            values = [number, len(hashes), columns["doc_id"], columns["fp"], sizes.tolist(), *coded(hashes)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, BLOCK, strict=True)], schema=BLOCK)

    rows = docs.select("doc_id", "text", text_hash(F.col("text")).alias("fp"))
    return base.cut(rows.mapInArrow(run, "block long, n_tokens long, ids array<long>, fps array<long>, sizes array<long>, vocabulary binary, tokens binary"))


def shingles(word: np.ndarray, sizes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of the distinct shingles of each text, sorted; word: keys of all texts' words, one after another."""
    text, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    at = np.flatnonzero(text[: max(0, len(word) - words + 1)] == text[words - 1 :])
    key = word[at]
    for i in range(1, words):
        key = longer(key, word[at + i])
    owners, keys = [text[at]], [key]
    for n in range(words):
        few = np.flatnonzero(sizes == n)
        key = mixed(np.full(len(few), n, dtype=U))
        for i in range(n):
            key = longer(key, word[ends[few] - n + i])
        owners.append(few)
        keys.append(key)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(key)
    order = order[np.argsort(owner[order], kind="stable")]
    owner, key = owner[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[new], key[new]


def _of(texts: pa.Table, own: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text hashes, and text and key of the shingles, of the block's texts at the places own."""
    base.tidy()
    get = lambda name: texts.column(name)[0].as_py()
    word = mixed(np.frombuffer(get("vocabulary"), dtype=np.int64).view(U))[unpack(get("tokens"), get("n_tokens")).view(np.int64)]
    sizes = np.array(get("sizes"), dtype=np.int64)
    keep = np.zeros(len(sizes), dtype=bool)
    keep[own] = True
    return np.array(get("fps"), dtype=np.int64)[keep], *shingles(word[np.repeat(keep, sizes)], sizes[keep], words)


def prefix_size(m: np.ndarray, share: Fraction) -> np.ndarray:
    return m - -(-share.numerator * m // share.denominator) + 1


def prints_of(key: np.ndarray, sizes: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """SimHash fingerprints of texts with so many keys each."""
    out, ends, start = [], np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        out.append(simhash.of_hashes(key[before : ends[stop - 1]], sizes[start:stop]))
        start = stop
    return np.concatenate(out) if out else np.empty(0, dtype=U)


def described(table: DataFrame, words: int, share: Fraction, least_part: int = 1 << 20, most_part: int = 1 << 24) -> DataFrame:
    """TEXTS: a row for each distinct text, as a written table.

    lone: shingles that no other text has; print: the fingerprint; keys, at: the shingles of the prefix that other texts
    have too, and their places in the order; shingles: all of them, where there are keys.
    """
    places = table.select("block", F.posexplode("fps").alias("pos", "fp")).groupBy("fp").agg(F.min(F.struct("block", "pos")).alias("own"))
    own = base.cut(places.groupBy("own.block").agg(F.collect_list("own.pos").alias("own")))

    def count(key: tuple, texts: pa.Table, first: pa.Table) -> pa.Table:
        if not texts.num_rows or not first.num_rows:
            return SENT.empty_table()
        _, _, keys = _of(texts, np.array(first.column("own")[0].as_py(), dtype=np.int64), words)
        found = Distinct(keys)
        return pa.Table.from_batches(by_part(key[0].as_py(), found.keys, found.total(np.ones(len(keys), dtype=np.int64)), parts), schema=SENT)

    def describe(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        rows = known.to_pylist()
        first = [r["own"] for r in rows if r["own"] is not None]
        if not texts.num_rows or not first:
            return TEXTS.empty_table()
        fps, text, keys = _of(texts, np.array(first[0], dtype=np.int64), words)
        found = Distinct(keys)
        rows = sorted((r["part"], r["n"], r["totals"]) for r in rows if r["own"] is None)
        times = np.concatenate([unpack(data, n) for _, n, data in rows]).astype(np.int64)[found.number]
        size = np.bincount(text, minlength=len(fps))
        start = np.cumsum(size) - size
        order = np.argsort(times, kind="stable")
        order = order[np.argsort(text[order], kind="stable")]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order)) - start[text[order]]
        lone = np.bincount(text[times == 1], minlength=len(fps))
        met = order[(times[order] > 1) & (place[order] < prefix_size(size, share)[text[order]])]
        n = np.bincount(text[met], minlength=len(fps))
        ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        # Whole sets only of texts that can meet another: nulls for the others.
        whole = [keys[a:b].view(np.int64) if c else None for a, b, c in zip(start.tolist(), (start + size).tolist(), n.tolist(), strict=True)]
        columns = [fps, size, lone, prints_of(keys, size).view(np.int64)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(keys[met].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place[met])), pa.array(whole, LISTS)]
        return pa.table([*map(pa.array, columns), *lists], schema=TEXTS)

    parts = parts_for(table.agg(F.sum("n_tokens")).first()[0] or 0, least_part, most_part)
    totals = summed(table.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(count, SENT_DDL))
    known = totals.where(F.col("block") != ALL).select("block", "part", "n", "totals", F.lit(None).cast("array<int>").alias("own"))
    known = known.unionByName(own.select("block", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("totals"), "own"))
    ddl = "fp long, size long, lone long, print long, keys array<long>, at array<long>, shingles array<long>"
    return base.cut(table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(describe, ddl))


def by_prints(texts: DataFrame, radius: int) -> DataFrame:
    """a, b: near pairs that join up texts by their fingerprints; texts of one fingerprint are paired with the smallest of them."""
    first = base.cut(texts.groupBy("print").agg(F.min("fp").alias("first")))
    near = base.cut(simhash.links(first.select(F.col("print").alias("fp")), radius))
    x, y = (first.select(F.col("print").alias(p), F.col("first").alias(f)) for p, f in (("a", "x"), ("b", "y")))
    same = texts.join(first, "print").where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    return same.unionByName(near.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def may_link(a: str, b: str, share: Fraction) -> Column:
    """Whether texts can be similar whose first common shingle is the one at their places: a, b are structs of size, lone, at.

    All shingles before the first common one are not shared, and those that no other text has are not: what is left must do.
    """
    up, down = share.numerator, share.denominator
    m, n, i, j, u, v = (F.col(f"{x}.{c}") for c in ("size", "at", "lone") for x in (a, b))
    enough = lambda common: (up + down) * common >= up * (m + n)
    most = F.least(i - u, j - v) + 1 + F.least(m - i - 1, n - j - 1)
    return (down * F.least(m, n) >= up * F.greatest(m, n)) & enough(F.least(m - i, n - j)) & enough(most)


def similar(pairs: DataFrame, texts: DataFrame, share: Fraction) -> DataFrame:
    """The pairs a, b whose whole sets are."""
    up, down = share.numerator, share.denominator
    sets = texts.where("shingles is not null")
    x, y = (sets.select(F.col("fp").alias(f), F.col("shingles").alias(s)) for f, s in (("a", "x"), ("b", "y")))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where((up + down) * both >= up * (F.size("x") + F.size("y"))).select("a", "b")


def links(table: DataFrame, words: int = 5, share: Fraction = SHARE, radius: int = 2) -> DataFrame:
    """a, b: similar pairs (text hashes) that join up all similar pairs."""
    texts = described(table, words, share)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    met = texts.where(F.size("keys") > 0).select("fp", "size", "lone", F.explode(F.arrays_zip("keys", "at")).alias("z"))
    own = F.struct("size", F.col("z.at").alias("at"), "lone", "fp")
    met = met.select(F.col("z.keys").alias("shingle"), own.alias("t"))
    hubs = met.groupBy("shingle").agg(F.min(F.struct((F.col("t.lone") / F.col("t.size")).alias("part"), F.col("t.fp"), "t")).alias("least"), F.count("*").alias("n"))
    # As a table: both sides of the join are then plain exchanges, of which hot shingles can be split.
    hubs = base.cut(hubs.where("n > 1").select("shingle", F.col("least.t").alias("hub")))
    by_hub = met.join(hubs, "shingle").where((F.col("t.fp") != F.col("hub.fp")) & may_link("t", "hub", share))
    by_hub = base.cut(by_hub.select(F.col("t.fp").alias("a"), F.col("hub.fp").alias("b")).select(*pair).distinct())
    near = by_prints(texts, radius).select(*pair)
    found = base.cut(similar(by_hub.unionByName(near).distinct(), texts, share))
    named = simhash.components(found)
    keyed = met.join(named.select(F.col("node").alias("_node"), "root"), F.col("t.fp") == F.col("_node"), "left")
    keyed = base.cut(keyed.select("shingle", "t", F.coalesce("root", "t.fp").alias("of")))
    groups = keyed.groupBy("shingle", "of").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "of")).alias("most"), F.count("*").alias("n"))
    groups = base.cut(groups.where("n > 1").select("shingle", F.col("most.of").alias("most")))
    # Texts outside the largest component of a shingle meet all others; of two such, only one is the first.
    few = base.cut(keyed.join(groups, "shingle").where("of <> most").select("shingle", F.col("t").alias("s"), F.col("of").alias("few"), "most"))
    rest = keyed.join(few, "shingle").where((F.col("of") != F.col("few")) & ((F.col("of") == F.col("most")) | (F.col("s.fp") < F.col("t.fp"))) & may_link("s", "t", share))
    rest = base.cut(rest.select(F.col("s.fp").alias("a"), F.col("t.fp").alias("b")).select(*pair).distinct())
    return found.unionByName(similar(rest, texts, share))


def groups(docs: DataFrame, words: int = 5, share: Fraction = SHARE, radius: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, fp (a hash of the text), component_id: the smallest doc_id of the documents reachable over links."""
    table = blocks(docs, block_bytes)
    prints = base.cut(table.select(F.explode(F.arrays_zip("ids", "fps")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.fps").alias("fp")))
    return simhash.joined_up(prints, lambda distinct: links(table, words, share, radius))


def deduplicate(docs: DataFrame, words: int = 5, share: Fraction = SHARE, radius: int = 2) -> DataFrame:
    """The rows of docs that name their component; of rows with the same doc_id and text, one stays.

    Rows without a doc_id stay only in components of nothing else.
    """
    named = groups(docs, words, share, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    row = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0)), F.col("doc_id").isNull(), F.col("_fp"))
    named = named.select("doc_id", F.col("fp").alias("_fp")).select(row.alias("_row_key")).distinct()
    rows = base.wrap(docs, "doc_id", "text").withColumn("_fp", text_hash(F.col("text"))).withColumn("_row_key", row)
    # One exchange by the row's key for both; the key holds the id and the text's hash.
    kept = rows.join(named, "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return base.unwrap(kept, docs.columns, "doc_id", "text")
