"""Byte-level BPE encoding by speculation and verification, and decoding.

A text is cut into pieces by the tokenizer's own pattern. For every new piece a greedy longest match proposes
tokens; numpy then tests all adjacent pairs of all new pieces at once: a proposal is the exact result if and only
if no merge can cross any of its boundaries. Only pieces with a failing pair are merged exactly (by heap). A
worker keeps the results of frequent pieces in two generations of bounded size.

Why pairs suffice: BPE merges the pair of lowest rank first, leftmost first among equals. At each boundary, the
tokens that stand at its two sides over time are the right edge of the left token's merge tree and the left edge
of the right token's. A merge across comes about when two of these stand there together and their pair ranks
below the merge that ends the left one, and not above the merge that ends the right one (on equal ranks the
merge further left goes first). Tokens that exact merging doesn't give back for their own bytes are unsound and
never proposed.

Defined cases: a null text is empty and has no tokens; texts of any length are encoded whole; a special token's
text becomes its id; repeated rows give repeated results; columns besides the id and `text` pass through
`encode` untouched, and `ids`, `n_tokens` replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from oreweave.llm import base

#: The published pattern of this family of tokenizers (fixed value), and the white space its \\s stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers below U+0250, where Python's faster `re` can do.
NEAR_LETTERS, NEAR_NUMBERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_FAR = re.compile("[^\u0000-\u024f]")


def _pattern(letters: str, numbers: str) -> str:
    """PATTERN with the classes spelt out."""
    spelt = {r"[^\s\p{L}\p{N}]": f"[^{SPACES}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]", r"\S": f"[^{SPACES}]", r"\s": f"[{SPACES}]"}
    return re.sub("|".join(map(re.escape, spelt)), lambda m: spelt[m[0]], PATTERN)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, data: bytes, cached: int = 80_000):
        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or spec["post_processor"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE file")
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(*vocab.values(), *self.special.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.vocab, self.longest = vocab, max(map(len, vocab))
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        # pair -> (rank, merged); of each token the pair it came from and the rank of that merge.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts = np.full((size, 2), -1, dtype=np.int64)
        self.born = np.full(size, -1, dtype=np.int64)
        ids = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key, whole = (ids[a], ids[b]), ids[a + b]
            if key not in self.merge:
                self.merge[key] = (rank, whole)
            if self.born[whole] < 0:
                self.parts[whole], self.born[whole] = key, rank
        self.rank = {pair: rank for pair, (rank, _) in self.merge.items()}
        self.merged = [0] * len(model["merges"])
        for rank, whole in self.merge.values():
            self.merged[rank] = whole
        keys = np.array([a << 32 | b for a, b in self.merge], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()], dtype=np.int64)[order]
        self.sound: dict[int, bool] = {}
        self.near = re.compile(_pattern(NEAR_LETTERS, NEAR_NUMBERS))
        self.far = regex.compile(_pattern(r"\p{L}", r"\p{N}"))
        self.specials = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.cached, self.young, self.old = cached, {}, {}
        self.digits = [str(i) for i in range(size)]

    # -- exact merging

    def exact(self, piece: bytes) -> list[int]:
        return self._exact_long(piece) if len(piece) > 48 else self._exact_short(piece)

    def _exact_short(self, piece: bytes) -> list[int]:
        """Merging by lists; the first of the lowest ranks is the leftmost."""
        rank_of, merged, none = self.rank.get, self.merged, len(self.merged)
        ids = [self.byte_ids[b] for b in piece]
        ranks = [rank_of(x, none) for x in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
        return ids

    def _exact_long(self, piece: bytes) -> list[int]:
        """Merging by heap, for pieces of any length."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := self.merge.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[k]))
            if (k := before[i]) >= 0 and (found := self.merge.get((ids[k], ids[i]))):
                heapq.heappush(heap, (found[0], k, ids[k], ids[i]))
        return [x for x in ids if x >= 0]

    # -- speculation and verification

    def propose(self, piece: bytes) -> list[int]:
        out, at, n, vocab, sound = [], 0, len(piece), self.vocab, self.sound
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                token = vocab.get(piece[at:end])
                if token is not None:
                    good = sound.get(token)
                    if good is None:
                        good = sound[token] = end - at == 1 or self.exact(piece[at:end]) == [token]
                    if good:
                        out.append(token)
                        at = end
                        break
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether exact merging leaves the boundary between each two tokens alone.

        Both edges are walked back in time together: whichever token was merged later is opened first, and the
        rank of that merge becomes the end of the parts that it uncovers.
        """
        ok = np.ones(len(left), dtype=bool)
        never = np.iinfo(np.int64).max
        live, a, b = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        end_a, end_b = np.full(len(a), never), np.full(len(b), never)
        while len(live):
            rank = self.rank_of(a, b)
            crossed = (rank < end_a) & (rank <= end_b) & (rank < never)
            ok[live[crossed]] = False
            born_a, born_b = self.born[a], self.born[b]
            go = ~crossed & ((born_a >= 0) | (born_b >= 0))
            live, a, b, end_a, end_b, born_a, born_b = (x[go] for x in (live, a, b, end_a, end_b, born_a, born_b))
            # Of equal ranks the left one happened first, so the right one is undone first.
            open_a = born_a > born_b
            end_a, end_b = np.where(open_a, born_a, end_a), np.where(open_a, end_b, born_b)
            a, b = np.where(open_a, self.parts[a, 1], a), np.where(open_a, b, self.parts[b, 0])
        return ok

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The token ids of distinct pieces."""
        pieces = list(pieces)
        raw = [p.encode() for p in pieces]
        proposed = [self.propose(r) for r in raw]
        sizes = np.array([len(p) for p in proposed], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.arange(len(pieces)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        good = self.compatible(keys >> 32, keys & 0xFFFFFFFF)[back]
        out = dict(zip(pieces, map(tuple, proposed), strict=True))
        for i in np.unique(word[inner[~good]]).tolist():
            out[pieces[i]] = tuple(self.exact(raw[i]))
        return out

    # -- texts

    def split(self, text: str) -> list[str]:
        return (self.far if _FAR.search(text) else self.near).findall(text)

    def pieces(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.split(text)
        parts = self.specials.split(text)
        # A special token stands as a piece of its own, which no pattern can give: it starts with a NUL mark.
        return list(chain.from_iterable(["\0" + x] if i % 2 else self.split(x) for i, x in enumerate(parts)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pieces(t) for t in texts]
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = set(chain.from_iterable(cut)).difference(young)
        kept = {p: old[p] for p in new if p in old}
        young.update(kept)
        new.difference_update(kept)
        for p in [p for p in new if p[0] == "\0" and p[1:] in self.special]:
            young[p] = (self.special[p[1:]],)
            new.discard(p)
        young.update(self.encode_pieces(new))
        return [list(chain.from_iterable(map(young.__getitem__, c))) for c in cut]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    return ByteBpe(Path(path).read_bytes())


class Shipped:
    """A tokenizer file that the driver reads and workers get by broadcast (a vocabulary, of a few MB); parsed once a process."""

    def __init__(self, spark: SparkSession, path: str):
        data = Path(path).read_bytes()
        self.name, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def tokenizer(self) -> ByteBpe:
        if self.name not in _loaded:
            _loaded[self.name] = ByteBpe(self.data.value)
        return _loaded[self.name]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    shipped = Shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped.tokenizer()
        for batch in base.text_chunks(batches):
            encoded = bpe.encode_batch(base.texts_of(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(x) for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(bpe.digits.__getitem__, x)).encode()).hexdigest() for x in encoded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in encoded], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _with(docs: DataFrame, path: str, columns: dict[str, T.DataType], make) -> DataFrame:
    """docs and new columns; make(tokenizer, texts) gives them as Arrow arrays."""
    docs = docs.drop(*columns)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in columns.items())])
    shipped = Shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped.tokenizer()
        for batch in base.text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(bpe, base.texts_of(batch))], [*batch.schema.names, *columns])

    return docs.mapInArrow(run, schema)


_IDS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs with ids (array of int) and n_tokens."""

    def make(bpe: ByteBpe, texts: list[str]) -> list[pa.Array]:
        encoded = bpe.encode_batch(texts)
        return [pa.array(encoded, pa.list_(pa.int32())), pa.array([len(x) for x in encoded], pa.int64())]

    return _with(docs, path, _IDS, make)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """As encode, with `decoded`, the text that the ids give back."""

    def make(bpe: ByteBpe, texts: list[str]) -> list[pa.Array]:
        encoded = bpe.encode_batch(texts)
        return [pa.array(encoded, pa.list_(pa.int32())), pa.array([len(x) for x in encoded], pa.int64()), pa.array(map(bpe.decode, encoded), pa.string())]

    return _with(docs, path, _IDS | {"decoded": T.StringType()}, make)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded with `decoded`, the text of column `ids` (null ids: empty)."""
    encoded = encoded.drop("decoded")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    shipped = Shipped(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shipped.tokenizer()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bpe.decode(x or ()) for x in ids], pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
