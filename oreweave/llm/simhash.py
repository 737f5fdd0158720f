"""SimHash fingerprints and their exact near pairs by vantage-point trees.

Fingerprints count the bits of the XXH64 hashes of all word shingles of a text. Equal fingerprints are merged
first, so a group of copies of any size is one point. A tree of vantage points is drawn from a bounded sample
(`sample`, documented and hashed, so always the same); every point is then routed to the one leaf that owns it. Where
that sample is too small for leaves of `leaf` points, each leaf gets a tree of its own from as large a sample of its
points, and so on: leaves stay as small however many points there are, and no sample grows with their number.
A point whose distance to a vantage point is within the radius of the node's bound may have partners on the
other side, and by the triangle inequality only then: it is sent there too, as a visitor. Owners that lie at or
below the bound visit the upper side and not the other way round, so every near pair meets in exactly one leaf
of its deepest common node. Leaves compare owners with owners and visitors and give a spanning forest of the
pairs, linear in their points. Components are then joined up by star contraction over tables in the shared
folder; no links or fingerprints but the sample are brought to the driver.

Defined cases: a null text is empty; no words give fingerprint zero, which links like any other; with fewer
words than a shingle the whole sequence is the one shingle; repeated rows share a fingerprint; rows with a null
doc_id are fingerprinted, but never name a component unless all of its rows have none; no rows give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.llm import base

SEED = 42


def of_hashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of texts from the hashes (uint64) of their shingles, one text's after another's; each has one at least."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # The sums' type is that of a copy of all bits: no wider than it must be.
    ones = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int32)
    return np.packbits(ones > sizes[:, None] // 2, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_batch(texts: list[str], words: int = 3) -> np.ndarray:
    """uint64 for each text."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), dtype=np.uint64)
    hashes, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        tokens = text.encode().lower().split()  # bytes: A-Z only, and white space 9 to 13 and 32 only
        if not tokens:
            continue
        joined = b" ".join(tokens)
        if len(tokens) <= words:
            own = [digest(joined, SEED)]
        else:
            starts = list(accumulate(map(len, tokens), lambda at, n: at + n + 1, initial=0))
            own = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[words:], strict=False)]
        sizes[i] = len(own)
        hashes.append(np.array(own, dtype=np.uint64))
    if hashes:
        full = np.flatnonzero(sizes)
        out[full] = of_hashes(np.concatenate(hashes), sizes[full])
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.text_chunks(batches):
            fp = fingerprint_batch(base.texts_of(batch), words)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Node:
    __slots__ = ("pivot", "bound", "low", "high", "leaf")

    def __init__(self, pivot=None, bound=0, low=None, high=None, leaf=-1):
        self.pivot, self.bound, self.low, self.high, self.leaf = pivot, bound, low, high, leaf

    def __getstate__(self):
        return tuple(getattr(self, s) for s in self.__slots__)

    def __setstate__(self, state):
        for s, v in zip(self.__slots__, state, strict=True):
            setattr(self, s, v)


def distance(points: np.ndarray, pivot) -> np.ndarray:
    return np.bitwise_count(points ^ pivot)


def best_split(points: np.ndarray, radius: int, tries: int = 12) -> tuple[np.uint64, int] | None:
    """The vantage point and bound with the fewest points within radius of the bound; None if none divides well."""
    best = None
    for pivot in points[:: max(1, len(points) // tries)][:tries]:
        d = distance(points, pivot)
        for bound in np.unique(np.quantile(d, (0.35, 0.5, 0.65), method="nearest")).tolist():
            low = np.count_nonzero(d <= bound)
            if not 0.2 * len(d) <= low <= 0.8 * len(d):
                continue
            crossing = np.count_nonzero((d > bound - radius) & (d <= bound + radius)) / len(d)
            if best is None or crossing < best[0]:
                best = (crossing, pivot, int(bound))
    return best and best[1:]


def build(points: np.ndarray, radius: int, most: float) -> tuple[Node, int]:
    """A tree whose leaves hold at most `most` sample points each, as far as vantage points divide them."""
    leaves = 0

    def grow(part: np.ndarray) -> Node:
        nonlocal leaves
        split = best_split(part, radius) if len(part) > most else None
        if split is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        low = distance(part, split[0]) <= split[1]
        return Node(split[0], split[1], grow(part[low]), grow(part[~low]))

    return grow(points), leaves


def route(root: Node, points: np.ndarray, radius: int, owner: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, indices, owners or visitors). owner: which points are no visitors as they come; None: all."""
    own = np.arange(len(points)) if owner is None else np.flatnonzero(owner)
    todo = [(root, own, np.empty(0, dtype=np.int64) if owner is None else np.flatnonzero(~owner))]
    while todo:
        node, own, visit = todo.pop()
        if not len(own) + len(visit):
            continue
        if node.leaf >= 0:
            if len(own):
                yield node.leaf, own, True
            if len(visit):
                yield node.leaf, visit, False
            continue
        d = distance(points[own], node.pivot).astype(np.int64)
        e = distance(points[visit], node.pivot).astype(np.int64)
        low = d <= node.bound
        todo.append((node.low, own[low], visit[e - radius <= node.bound]))
        todo.append((node.high, own[~low], np.concatenate([visit[e + radius > node.bound], own[low & (d + radius > node.bound)]])))


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels (the smallest index of each component) after linking a[i] with b[i], and those of the pairs that join them up."""
    used = [(a[:0], b[:0])]
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels, *map(np.concatenate, zip(*used, strict=True))
        a, b, low, high = a[differ], b[differ], np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(labels, high, low)
        won = np.flatnonzero(labels[high] == low)
        won = won[np.unique(high[won], return_index=True)[1]]
        used.append((a[won], b[won]))
        while (jumped := labels[labels]).tobytes() != labels.tobytes():
            labels = jumped


def leaf_links(own: np.ndarray, visit: np.ndarray, radius: int, small: int = 4096, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Of all near pairs over own + visit that have an owner, those of a spanning forest; large leaves divide further."""
    points = np.concatenate([own, visit])
    labels, used = np.arange(len(points)), [(np.empty(0, np.int64),) * 2]
    todo = [(np.arange(len(own)), np.arange(len(own), len(points)))]
    while todo:
        o, v = todo.pop()
        split = best_split(points[o[:: max(1, len(o) // 4096)]], radius) if len(o) > small else None
        if split is not None:
            d, e = (distance(points[x], split[0]).astype(np.int64) for x in (o, v))
            low = d <= split[1]
            todo.append((o[low], v[e - radius <= split[1]]))
            todo.append((o[~low], np.concatenate([v[e + radius > split[1]], o[low & (d + radius > split[1])]])))
            continue
        others = np.concatenate([o, v])
        rows = max(1, cells // max(1, len(others)))
        for at in range(0, len(o), rows):
            part = o[at : at + rows]
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[others][None, :]) <= radius)
            labels, x, y = forest(labels, part[i], others[j])
            used.append((x, y))
    return tuple(map(np.concatenate, zip(*used, strict=True)))


#: Leaves that one tree can number.
_LEAVES = 1 << 16
DEALT = "leaf long, fp long, owner boolean"


def _dealt(root: Node, above: int, fp: np.ndarray, radius: int, owner: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Columns of DEALT for points that have come to leaf `above` of the trees before."""
    for at, index, owns in route(root, fp.view(np.uint64), radius, owner):
        yield {"leaf": np.full(len(index), above * _LEAVES + at, dtype=np.int64), "fp": fp[index], "owner": np.full(len(index), owns)}


def _deeper(dealt: DataFrame, n: int, leaves: int, radius: int, leaf: int, sample: int, least: int) -> tuple[DataFrame, int, float]:
    """dealt by a tree for each leaf, from about `sample` of its owners; the number of leaves and the share of the points."""
    share = min(1.0, sample * leaves / n)
    few = dealt.where(F.col("owner") & (F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        root, count = build(np.sort(part["fp"].to_numpy(dtype=np.int64)).view(np.uint64), radius, max(least, leaf * share))
        return pd.DataFrame({"leaf": part["leaf"].iloc[:1], "tree": [pickle.dumps(root)], "n": [count]})

    trees = base.cut(few.groupBy("leaf").applyInPandas(grow, "leaf long, tree binary, n long"))
    salts = max(1, round(n / leaves / (1 << 20)))
    shares = dealt.withColumn("salt", F.pmod(F.xxhash64("fp", "owner"), F.lit(salts))).groupBy("leaf", "salt")
    copies = trees.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).groupBy("leaf", "salt")

    def deal(points: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(points):
            return pd.DataFrame({"leaf": [], "fp": [], "owner": []}).astype({"leaf": "int64", "fp": "int64", "owner": "bool"})
        root = pickle.loads(tree["tree"].iloc[0]) if len(tree) else Node(leaf=0)
        fp, owner = points["fp"].to_numpy(dtype=np.int64), points["owner"].to_numpy(dtype=bool)
        return pd.concat(map(pd.DataFrame, _dealt(root, int(points["leaf"].iloc[0]), fp, radius, owner)))

    return shares.cogroup(copies).applyInPandas(deal, DEALT), trees.agg(F.sum("n")).first()[0] or 1, share


def links(distinct: DataFrame, radius: int, leaf: int = 8192, sample: int = 1 << 16, least: int = 64) -> DataFrame:
    """a, b: near pairs that are a spanning forest, leaf by leaf, of all pairs of distinct fingerprints within radius.

    distinct: column fp, each value once, as a written table. A tree is drawn from at most about `sample` points (those
    with the smallest hashes), and no leaf from fewer than `least` of them.
    """
    n = distinct.count()
    share = min(1.0, sample / max(n, 1))
    few = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toPandas()["fp"].to_numpy(dtype=np.int64)
    root, leaves = build(np.sort(few).view(np.uint64), radius, max(least, leaf * share))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _dealt(root, 0, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), radius):
                yield pa.RecordBatch.from_pydict(part)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        fp, owner = part["fp"].to_numpy(dtype=np.int64), part["owner"].to_numpy(dtype=bool)
        points = np.concatenate([fp[owner], fp[~owner]])
        if not owner.any():
            return pd.DataFrame({"a": fp[:0], "b": fp[:0]})
        x, y = leaf_links(points[: owner.sum()].view(np.uint64), points[owner.sum() :].view(np.uint64), radius)
        return pd.DataFrame({"a": points[x], "b": points[y]})

    dealt = distinct.select("fp").mapInArrow(deal, DEALT)
    while leaf * share < least:
        before = leaves
        dealt, leaves, share = _deeper(base.cut(dealt), n, leaves, radius, leaf, sample, least)
        if leaves <= before:
            break  # points that no vantage point divides
    return dealt.groupBy("leaf").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of every node that edges (a, b) name.

    Alternating large and small stars; each round is a table in the shared folder. Stops when a round changes
    nothing.
    """
    edges = base.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = base.per_key_join(both, ["u"], F.col("v"), {"m": ("min", F.least("u", "v"))})
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = base.per_key_join(large, ["u"], F.col("v"), {"m": ("min", F.col("v"))})
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = base.cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit((1 << 31) - 1)))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not joined up after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(docs: DataFrame, words: int = 3, radius: int = 2, salts: int = 64) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id of the documents reachable over links."""
    return joined_up(base.cut(fingerprints(docs, words)), lambda distinct: links(distinct, radius), salts)


def joined_up(prints: DataFrame, links_of: Callable[[DataFrame], DataFrame], salts: int = 64) -> DataFrame:
    """prints (doc_id, fp) with component_id, by the links (a, b) between distinct fp."""
    salted = prints.withColumn("salt", base.salt_of(F.col("doc_id"), salts=salts))
    distinct = salted.groupBy("fp", "salt").agg(F.min("doc_id").alias("first")).groupBy("fp").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    distinct = base.cut(distinct)
    linked = components(links_of(distinct))
    # The root itself is a node of its component too.
    named = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    joined = distinct.join(named, distinct["fp"] == named["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    whole = base.per_key_join(joined.select("fp", "salts", "root", "first"), ["root"], F.col("fp"), {"component_id": ("min", F.col("first"))})
    table = whole.select(F.col("fp").alias("_fp"), F.explode("salts").alias("_salt"), "component_id")
    return salted.join(table, (salted["fp"] == table["_fp"]) & (salted["salt"] == table["_salt"])).select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
