"""Each corpus operator against a brute-force version, with nulls, ties, repeated rows, long and empty texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oreweave.llm import bpe, fingerprint, lm_score, mixing, parts, quality_gbdt, quality_rules, simhash, suffix_dedup, toxicity, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, n_words int, copy string, block string, fp double"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(seed=3, n=160):
    """Ids with gaps, one null id, repeated rows, copies, near copies, periodic, empty, null and long texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abdeghinorstuü") for _ in range(r.randint(1, 9))) for _ in range(200)]
    passage = " ".join(r.choice(words) for _ in range(30))
    out = []
    for i in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 14))).capitalize() + r.choice([".", "!", ""]) for _ in range(r.randint(1, 6))]
        if r.random() < 0.2:
            lines.insert(r.randrange(len(lines) + 1), passage)
        out.append((3 * i + 1, "\n".join(lines)))
    out += [(2, out[0][1]), (5, out[0][1] + " x"), (6, ""), (8, None), (9, None), (11, "x" * 5000), (12, " \n\t "), (14, "ab" * 300), (None, out[3][1]), (None, None), (15, "<|endoftext|> it's  ok　né z")]
    out += [out[1], out[1], (17, " ".join(r.choice(words) for _ in range(20_000)))]
    return [(a, b, r.choice(["en", None]), r.choice(["s1", "s1", "s1", "s2", None]), None if b is None else len(b), "p", 1, "c", "b", 0.5) for a, b in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def backoff_model(texts, order=3):
    """Plain backoff: p(history, word) over dictionaries of all n-grams of training texts (lists of words)."""
    counts = [Counter() for _ in range(order + 1)]
    for w in texts:
        counts[1].update((x,) for x in w)
        counts[1]["<s>",] += 1
        for k in range(2, order + 1):
            line = ["<s>", *w]
            counts[k].update(tuple(line[i : i + k]) for i in range(len(line) - k + 1))
    n, v = sum(len(w) for w in texts), len(counts[1]) - bool(texts)
    bucket = lambda c: c if c < 8 else min(int(8 + 4 * (math.log2(c) - 3)), 95)
    seen, once = Counter(), Counter()
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            if counts[k - 1][g[:-1]] >= 2:
                at = k, bucket(counts[k - 1][g[:-1]])
                seen[at] += c
                once[at] += c == 1

    def p(history, word):
        if not history:
            return (counts[1][word,] + 0.1) / (n + 0.1 * (v + 1))
        k, c = len(history), counts[len(history)][history]
        if c < 2:
            return p(history[1:], word)
        at = k + 1, bucket(c)
        f = (once[at] + 1) / (seen[at] + 2)
        return (1 - f) * counts[k + 1][(*history, word)] / c + f * p(history[1:], word)

    return p, counts[1], n


def test_lm_score_matches_brute_force(docs, empty):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    texts = [(i, [*WORD.findall(lower(t)), None]) for i, t in data]
    for order, sizes in ((3, ((8 << 20, 1 << 20), (3000, 500))), (2, ((3000, 1 << 20),)), (4, ((3000, 5000),))):
        p, one, n = backoff_model([w for i, w in texts if not held(i)], order)
        want = []
        for i, w in texts:
            line = ["<s>", *w]
            high = sum(math.log10(p(tuple(line[max(0, j - order + 1) : j]), line[j])) for j in range(1, len(line)))
            want.append((str(i), held(i), len(w), sum(one[x,] > 0 for x in w), n, round(sum(math.log10(p((), x)) for x in w), 4), round(high, 4)))
        for block, part in sizes:
            rows = lm_score.score(docs, order=order, block_bytes=block, least_part=part, most_part=part).collect()
            got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in rows]
            assert sorted(got) == sorted(want)
    assert lm_score.score(empty).count() == 0


def test_lm_all_held_out(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = lm_score.score(spark.createDataFrame([(i, "a b a") for i in held], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(4, 0, 0)}
    assert all(r.score == r.base_score == pytest.approx(0) for r in got)


def test_lm_rare_words_have_arcs(spark):
    """n-grams of words seen twice count in a corpus of any number of tokens."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10][:3]
    data = [(ids[0], "a " * 1_200_000), (ids[1], "x y"), (ids[2], "x y")]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    p, _, _ = backoff_model([["x", "y", None], ["x", "y", None], ["a"] * 1_200_000 + [None]])
    line = ["<s>", "x", "y", None]
    want = sum(math.log10(p(tuple(line[max(0, j - 2) : j]), line[j])) for j in (1, 2, 3))
    assert got[ids[1]].score == got[ids[2]].score == pytest.approx(want)
    assert want > got[ids[1]].base_score + 8


def test_lm_states_are_distributions():
    """From every state that a text can reach, the probabilities of all words, the end and an unknown word sum up to 1."""
    import numpy as np

    texts = ["a b c a b d", "a b c", "b c a b", "d d d a", "a b c a"]
    # All continuations of two words, as texts of their own: arcs exist only for n-grams of the block.
    words = ["a", "b", "c", "d", "zz"]
    more = [f"{x} {y} {z}" for x in words for y in words for z in words] + [f"{x} {y}" for x in words for y in words]
    tokens, sizes = lm_score.tokens_of([*texts, *more])
    vocabulary, at = np.unique(tokens, return_inverse=True)
    train = np.arange(len(sizes)) < len(texts)
    block, figures = lm_score.Block(vocabulary, at, sizes), []
    for k in range(3):
        if k:
            block.grow()
        bucket, count = block.buckets(), block.training(train)
        figures.append(np.stack([np.bincount(bucket, weights=w, minlength=lm_score.BUCKETS) for w in (count, count == 1, count > 0)]))
        block.learn(count)
    automaton = lm_score.Automaton(block, lm_score.Smoothing(figures))
    assert automaton.states > 6 and len(automaton.arcs) > 15
    for state in range(automaton.states):
        _, score = automaton.step(np.full(len(vocabulary), state), np.arange(len(vocabulary)))
        assert (10**score).sum() == pytest.approx(1)


def test_lm_packs_numbers():
    import numpy as np

    for x in ([], [0], [0, 255, 256, 1], [2**63, 2**64 - 1, 0]):
        x = np.array(x, dtype=np.uint64)
        assert (parts.unpack(parts.pack(x), len(x)) == x).all()


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (6, "v", "é\r\n\r\nWARC/1.1\r\n"), (7, "w", "z" * 300_000), (7, "w", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    mark = warc.write(warc.resolve(df), str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a"), mark).collect()
    assert all(r.intact for r in got)
    found = sorted((str(r.page_id), r.record_type, r.payload_bytes, str(r.refers_to)) for r in got)
    assert found == sorted([("1", "revisit", 8, "2"), ("2", "response", 8, "None"), ("None", "revisit", 8, "2"), ("3", "revisit", 0, "4"), ("4", "response", 0, "None"), ("6", "response", 16, "None"), ("7", "response", 300_000, "None"), ("7", "response", 300_000, "None")])
    import base64

    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    records = [x for f in Path(tmp_path / "a").glob("part-*") for x in warc.parse_archive(f.read_bytes())]
    assert len(records) == len(pages)
    assert {f["warc-type"] for f, _ in records} == {"response", "revisit"}
    assert all(int(f["content-length"]) == len(b) for f, b in records)
    mark = warc.write(warc.resolve(df.limit(0)), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b"), mark).count() == 0
    limited = warc.resolve(df, min_payload=1).where("payload_bytes = 0").collect()
    assert {r.record_type for r in limited} == {"response"}


def test_repeated_windows_match_brute_force(docs, empty):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    least = {}
    for d, t in data:
        raw = (t or "").encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            w = raw[i : i + 50]
            least[w] = min(d, least.get(w, d))
    want = []
    for d, t in data:
        raw = (t or "").encode()
        gone = bytearray(len(raw) + 1)
        for i in range(len(raw) - 49 if d is not None else 0):
            if least[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        want.append((str(d), len(raw), sum(gone), bytes(gone).count(b"\1\0"), hashlib.sha256(kept).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.report(empty).count() == 0
    assert suffix_dedup.remove(docs).columns == docs.columns


def test_simhash_components_match_brute_force(docs, empty):
    def print_of(text):
        words = WORD.findall(lower(text))
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    data = [(r.doc_id, print_of(r.text)) for r in docs.collect()]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if (data[i][1] ^ data[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((str(d), f"{p:016x}", str(least.get(find(i)))) for i, (d, p) in enumerate(data))
    assert sorted((str(r.doc_id), r.h, str(r.component_id)) for r in simhash.groups(docs).withColumn("h", simhash.as_hex(F.col("fp"))).collect()) == want
    assert simhash.groups(empty).count() == 0


def test_trees_below_trees_lose_no_pair(spark):
    """Samples too small for one tree: leaves get trees of their own, and the forest joins up what all pairs do."""
    import numpy as np

    r = np.random.default_rng(12)
    centres = r.integers(0, 2**63, 1500, dtype=np.int64)
    flips = [1 << int(i) | 1 << int(j) for i, j in r.integers(0, 62, (1500, 2))]
    points = np.unique(np.concatenate([centres, centres ^ np.array(flips), centres ^ np.array(flips[::-1])]))
    table = spark.createDataFrame([(int(x),) for x in points], "fp long")
    found = simhash.links(table, 2, leaf=40, sample=200, least=16).collect()
    assert all((x.a ^ x.b).bit_count() <= 2 for x in found)
    place = {int(x): i for i, x in enumerate(points)}
    near = [np.flatnonzero(np.bitwise_count(points ^ x) <= 2) for x in points]
    a, b = np.repeat(np.arange(len(points)), list(map(len, near))), np.concatenate(near)
    want, _, _ = simhash.forest(np.arange(len(points)), a, b)
    got, _, _ = simhash.forest(np.arange(len(points)), *(np.array([place[x[c]] for x in found]) for c in "ab"))
    assert (want == got).all() and len(np.unique(want)) < len(points) - 1000


def test_vantage_points_lose_no_pair():
    import numpy as np

    r = np.random.default_rng(5)
    centre = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([centre] + [centre ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4)]))
    for radius in (0, 2, 5):
        joined = lambda pairs: simhash.forest(np.arange(len(points)), *pairs)[0]
        forest = simhash.leaf_links(points, points[:0], radius, small=1 << 30)
        whole = joined(forest)
        assert len(forest[0]) == len(points) - len(np.unique(whole)) and (np.bitwise_count(points[forest[0]] ^ points[forest[1]]) <= radius).all()
        assert (joined(simhash.leaf_links(points, points[:0], radius, small=32)) == whole).all()
        root, leaves = simhash.build(points[::3], radius, 20)
        parts = defaultdict(lambda: ([], []))
        for leaf, index, owner in simhash.route(root, points, radius):
            parts[leaf][not owner].append(index)
        labels = np.arange(len(points))
        for own, visit in parts.values():
            if own:
                index = np.concatenate(own + visit)
                n = sum(map(len, own))
                a, b = simhash.leaf_links(points[index[:n]], points[index[n:]], radius)
                labels, _, _ = simhash.forest(labels, index[a], index[b])
        assert leaves > 1 and (labels == whole).all()


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1300)}


def test_bpe_matches_the_library(docs, empty):
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.digests(docs, TOKENIZER).collect()) == sorted(want)
    assert bpe.digests(empty, TOKENIZER).count() == 0
    back = bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER)
    assert back.where("coalesce(text, '') <> decoded").count() == 0


def test_bpe_on_random_texts():
    own, library, r = bpe.ByteBpe(Path(TOKENIZER).read_bytes(), cached=50), Tokenizer.from_file(TOKENIZER), random.Random(4)
    pools = ["abcdehilmnorst '", " \n\t\r  x'", "aé½²٣中\U0001f600 .", "!-=*#  \n", "".join(map(chr, range(32, 600)))]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 50))) for _ in range(800)] + ["".join(r.choice("etaoin") for _ in range(400)), "<|endoftext|>a<|endoftext|>"]
    assert own.encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    pieces = {p for t in texts for p in own.split(t)}
    assert all(list(v) == own.exact(k.encode()) == own._exact_long(k.encode()) for k, v in own.encode_pieces(pieces).items())


def labelled(spark, n=600):
    r = random.Random(9)
    words = ["".join(r.choice("abdeghinorst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        good, bad = r.random() < 0.7, r.random() < 0.3
        body = [r.choice(words) for _ in range(r.randint(20, 80))] if good else [r.choice(words)] * 40 + ["###"] * 20
        if bad:
            body[5:5] = r.sample(["grumb", "snark", "vile", "gorp"], 3)
        texts.append((i, " ".join(body), "en", "s", 0))
        labels.append((i, int(good), int(bad)))
    texts += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "a b", "en", "s", 0), (n + 2, "q" * 100_000, "en", "s", 0), texts[4]]
    labels += [(n, None, None), (None, 1, 1), labels[4], (10**6, 1, 0)]
    return spark.createDataFrame(texts, "doc_id long, text string, score string, label string, terms long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, which):
    docs, labels = labelled(spark)
    run = quality_gbdt.score if which == "quality" else toxicity.score
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    truth = labels.toPandas().dropna().drop_duplicates("doc_id").set_index("doc_id")[which]
    held = got[got["held_out"] & got["doc_id"].isin(truth.index)]
    assert len(held) > 80
    assert (held["predicted"].to_numpy() == truth.loc[held["doc_id"]].to_numpy()).mean() > 0.93
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_toxic_evidence_is_over_all_terms(spark):
    """Evidence against cosines over all words of all texts, and a telling word that only four examples have."""
    import numpy as np

    docs, labels = labelled(spark, 300)
    bucket = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    train, held = [i for i in range(1000, 1100) if not bucket(i)][:4], next(i for i in range(1000, 1100) if bucket(i))
    more = [(i, f"zorch### q{i} r{i}", "en", "s", "") for i in train] + [(held, "some zorch!!", "en", "s", "")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([r[:2] for r in more], "doc_id long, text string"))
    labels = labels.unionByName(spark.createDataFrame([(i, 0, 1) for i in train], labels.schema))
    words = [(r.doc_id, Counter(w.strip("!#") or w for w in WORD.findall(lower(r.text)))) for r in docs.collect()]
    df = Counter(w for _, c in words for w in c)
    weigh = lambda c: {w: (1 + math.log(k)) * math.log((1 + len(words)) / (1 + df[w])) for w, k in c.items()}
    marked = {r.doc_id for r in labels.collect() if r.toxic is not None and r.doc_id is not None and not bucket(r.doc_id)}
    examples = [(i, weigh(c)) for i, c in words if i in marked]
    inside = {w for _, v in examples for w in v}
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    for i, c in [x for x in words if x[0] is not None and bucket(x[0])][-20:]:
        q = {w: x for w, x in weigh(c).items() if w in inside}
        norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
        want = sorted((sum(x * v.get(w, 0) for w, x in q.items()) / norm(q) / norm(v) for _, v in examples), reverse=True)
        found = [e.cosine for e in got[i].evidence]
        assert np.allclose(found, want[: len(found)]) and len(found) == min(5, sum(x > 0 for x in want))
    assert {e.doc_id for e in got[held].evidence} >= set(train)


def test_block_max_search_is_exact():
    import numpy as np

    r = np.random.default_rng(3)
    vocabulary = np.arange(40)
    terms = [np.sort(r.choice(40, r.integers(1, 12), replace=False)) for _ in range(400)]
    counts = [r.integers(1, 5, len(t)) for t in terms]
    index = toxicity.Index(np.arange(400), r.integers(0, 2, 400), terms, counts, vocabulary, r.integers(1, 90, 40), 100, 0.3, k=7)
    vectors = np.zeros((400, 40))
    for i in range(400):
        t, w = index.vector(terms[index.ids[i]], counts[index.ids[i]])
        vectors[i, t] = w
    for i in range(60):
        q = np.zeros(40)
        t, w = index.vector(terms[i], counts[i])
        q[t] = w
        cosines = vectors @ q
        best, found = index.search(t, w)
        assert np.allclose(found, np.sort(cosines)[::-1][:7])
        assert np.allclose(cosines[best], found)


def test_windows_of_periodic_texts(spark):
    """Long periodic texts are few rows, lose what a smaller document has, and count every span."""
    import numpy as np

    data = [(1, "q" * 70 + "x" * 3000), (2, "ab" * 4000), (3, "z" + "x" * 60_000 + "end"), (4, "ba" * 300 + "!"), (5, "abc" * 2000), (6, "cab" * 40), (7, "x" * 49)]
    got = {r.doc_id: r for r in suffix_dedup.report(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    seen = {}
    for d, t in data:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        assert (got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (sum(gone), spans, hashlib.sha256(kept).hexdigest()), d
    raw = np.frombuffer(b"x" * 200_000, np.uint8)
    *_, begin, count = suffix_dedup.anchors(raw, np.zeros(len(raw), np.int32), 50, 24)
    assert len(begin) < 900 and count.sum() == len(raw) - 49 and count.max() < 256
    assert (begin[1:] == begin[:-1] + count[:-1]).all()


def test_mixing_counts_and_draws(docs, empty):
    weights = {"s1": 1.0, "s2": 3.0}
    out = mixing.mix(docs, weights, epochs=2.0)
    again = mixing.mix(docs.repartition(3), weights, epochs=2.0)
    key = lambda d: sorted((str(r.doc_id), r.source, r["copy"]) for r in d.collect())
    assert key(out) == key(again)
    per = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = docs.count() * 2
    assert set(per) == {"s1", "s2"}
    assert abs(per["s1"] - total / 4) < 6 * math.sqrt(total / 4) and abs(per["s2"] - total * 3 / 4) < 6 * math.sqrt(total * 12)
    assert key(mixing.mix(docs, weights, epochs=2.0, broadcast_bytes=0)) == key(out)
    assert mixing.mix(empty).count() == 0
    cdf = mixing.rates(docs, None, 1.0).collect()
    for r in cdf:
        p, total = math.exp(-r.rate), 0.0
        for k, c in enumerate(r.cdf):
            total += p
            assert c == pytest.approx(total, abs=1e-12)
            p *= r.rate / (k + 1)
        assert r.chunks == 1


def test_mixing_repeats_a_rare_source_in_chunks(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") == 7, "rare").otherwise("s").alias("source"), F.lit(5).alias("copy"), F.lit("x").alias("rate"))
    rate, want = 3000.0, []
    each = rate / 6
    for chunk in range(6):
        u = int(hashlib.md5(f"mix:7{f'#{chunk}' if chunk else ''}".encode()).hexdigest()[:13], 16) / 2**52
        p = total = math.exp(-each)
        k = 0
        while total <= u:
            k += 1
            p *= each / k
            total += p
        want += [2000 * chunk + i for i in range(1, k + 1)]
    out = mixing.mix(df)
    assert sorted(r["copy"] for r in out.where("doc_id = 7").collect()) == want
    assert abs(len(want) - rate) < 6 * math.sqrt(rate)
    assert out.columns == ["doc_id", "text", "source", "rate", "copy", "mix_key"] and {r.rate for r in out.take(3)} == {"x"}
    assert max(len(r.cdf) for r in mixing.rates(df, None, 1.0).collect()) < 900


def test_mixing_spreads_equal_rows(spark):
    """Rows that are all the same, and rows without an id, aren't all in one partition."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 1).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("t")).otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source")).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = mixing.mix(df, epochs=3.0).select("doc_id", F.spark_partition_id().alias("at")).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for doc_id in (1, None):
        assert len({r["at"] for r in out if r.doc_id == doc_id}) > 1, doc_id


def test_rule_counts_match_brute_force(docs, empty):
    def brute(text):
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed

    got = quality_rules.report(docs).collect()
    want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.report(empty).count() == 0
    assert quality_rules.filter_documents(docs).columns == docs.columns


def test_toxic_scores_match_brute_force(spark, docs):
    """Cosines, neighbours, votes and the calibrated score with dictionaries; the curve is where its loss is flat."""
    import string

    r = random.Random(11)
    bad = ["vile", "awful,", "(vile)", "trash"]
    data = {x.doc_id: (x.text or "")[:3000] for x in docs.collect() if x.doc_id is not None}
    marked = {i: int(r.random() < 0.3) for i in data}
    texts = {i: t + " " + " ".join(r.choice(bad) for _ in range(3)) if marked[i] and r.random() < 0.9 else t for i, t in data.items()}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labelled = {i: y for i, y in marked.items() if r.random() < 0.9}
    index = toxicity.build(table, spark.createDataFrame(list(labelled.items()), "doc_id long, toxic int"))

    def counts(text):
        words = [w.strip(string.punctuation) or w for w in re.findall("[^\x20\x09-\x0d]+", lower(text))]
        return Counter(words)

    bags = {i: counts(t) for i, t in texts.items()}
    df = Counter(w for b in bags.values() for w in b)
    known = {w for i in labelled for w in bags[i]}
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) for w in known}

    def vector(bag):
        v = {w: (1 + math.log(c)) * idf[w] for w, c in bag.items() if w in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    vectors = {i: vector(b) for i, b in bags.items()}
    ones, n = sum(labelled.values()), len(labelled)
    telling = set()
    for w in known:
        a, b = sum(w in bags[i] and y for i, y in labelled.items()), sum(w in bags[i] for i in labelled)
        spread = b * (n - b) * ones * (n - ones)
        if spread and n * (a * (n - ones) - (b - a) * ones) ** 2 / spread >= 20 and b >= 3:
            telling.add(w)
    assert telling

    def inputs(i, but=None):
        cosines = {j: sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) for j in labelled if j != but}
        best = sorted((j for j, c in cosines.items() if c > 1e-12), key=lambda j: (-round(cosines[j], 12), j))[:24]
        weight = [cosines[j] ** 2 for j in best]
        vote = sum(w * labelled[j] for w, j in zip(weight, best, strict=True)) / sum(weight) if best else None
        mass = math.log1p(math.sqrt(sum(idf[w] ** 2 for w in bags[i] if w in telling)))
        return vote, mass

    prior = ones / n
    for i, t in texts.items():
        vote, mass = inputs(i)
        got = index.score(t)[0]
        want = index.silent if vote is None else 1 / (1 + math.exp(-sum(b * x for b, x in zip(index.curve, (vote, mass, vote * mass, 1), strict=True))))
        assert got == pytest.approx(want, abs=1e-6), i
    slope = [0.01 * b for b in index.curve]
    for i, y in labelled.items():
        vote, mass = inputs(i, but=i)
        if vote is not None:
            x = (vote, mass, vote * mass, 1)
            p = 1 / (1 + math.exp(-sum(b * v for b, v in zip(index.curve, x, strict=True))))
            weight = prior / prior if y else 1.0
            slope = [s + weight * (p - y) * v for s, v in zip(slope, x, strict=True)]
    assert max(map(abs, slope)) < 1e-4


def test_quality_posterior_matches_brute_force(docs):
    """Expectation maximisation and the posterior in plain loops, from the votes that the rules give."""
    votes = quality_rules.rules()
    stats = quality_rules.with_stats(docs.select("doc_id", "text")).select("doc_id", *(c.alias(k) for k, c in votes.items()), quality_rules.base_failed().alias("failed")).collect()
    cast = [[r[k] for k in votes] for r in stats]
    good = [0.1 if -1 in v else 0.95 for v in cast]
    right = None
    for _ in range(500):
        prior = min(max(sum(good) / len(good), 0.02), 0.98)
        new = []
        for sign, low, high, weight in ((1, 0.9, 0.9995, good), (-1, 0.02, 0.98, [1 - g for g in good])):
            row = []
            for k in range(len(votes)):
                heard = sum(w for w, v in zip(weight, cast, strict=True) if v[k])
                row.append(min(max((sum(w for w, v in zip(weight, cast, strict=True) if v[k] == sign) + 1) / (heard + 2), low), high))
            new.append(row)
        done = right is not None and max(abs(a - b) for x, y in zip(new, right, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9
        right = new
        odds = [math.log(prior / (1 - prior)) + sum(math.log(a / (1 - b)) if x == 1 else math.log((1 - a) / b) if x == -1 else 0 for x, a, b in zip(v, *right, strict=True)) for v in cast]
        good = [1 / (1 + math.exp(-o)) for o in odds]
        if done:
            break
    want = sorted((str(r.doc_id), round(g, 6), bool(not r.failed and g >= 0.5)) for r, g in zip(stats, good, strict=True))
    got = sorted((str(r.doc_id), round(r.quality, 6), r.kept) for r in quality_rules.report(docs).collect())
    assert [x[::2] for x in got] == [x[::2] for x in want]
    assert all(a[1] == pytest.approx(b[1], abs=2e-6) for a, b in zip(got, want, strict=True))


def test_trees_match_exhaustive_splits():
    """Each split is the best of all thresholds of all features; a row's score is the sum of the leaves that it falls to."""
    import numpy as np

    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(80, 4)), 1)
    y = (x[:, 1] + 0.5 * x[:, 2] + r.normal(scale=0.5, size=80) > 0).astype(float)
    trees = quality_gbdt.Trees(rounds=4, depth=3, bins=40).fit(x, y)
    share = y.mean()
    total = np.full(80, math.log(share / (1 - share)))
    edges = [sorted(set(np.quantile(c, np.linspace(0, 1, 41)[1:-1], method="nearest").tolist())) for c in x.T]
    for k in range(4):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        nodes = {0: list(range(80))}
        for level in range(3):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = nodes.get(node, [])
                best = (1e-6, 0, math.inf)
                for f in range(4):
                    for t in edges[f]:
                        left = [i for i in rows if x[i, f] <= t]
                        rest = [i for i in rows if x[i, f] > t]
                        if sum(h[left]) < 1 or sum(h[rest]) < 1:
                            continue
                        worth = lambda part: sum(g[part]) ** 2 / (sum(h[part]) + 1)
                        gain = worth(left) + worth(rest) - worth(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, t)
                assert (trees.feature[k, node], trees.threshold[k, node]) == best[1:], (k, node)
                nodes[2 * node + 1], nodes[2 * node + 2] = [i for i in rows if x[i, best[1]] <= best[2]], [i for i in rows if x[i, best[1]] > best[2]]
        for leaf in range(8):
            rows = nodes.get(7 + leaf, [])
            assert trees.leaf[k, leaf] == pytest.approx(-0.1 * sum(g[rows]) / (sum(h[rows]) + 1))
            total[rows] += trees.leaf[k, leaf]
    assert np.allclose(trees.predict(x), 1 / (1 + np.exp(-total)))


def test_quality_query_scores_by_its_trees(spark, docs):
    """Every score of the table by a scalar descent of the trees, on features counted in plain Python."""
    r = random.Random(5)
    labels = spark.createDataFrame([(i, len(t or "") % 2, 0) for i, t in {x.doc_id: x.text for x in docs.collect()}.items() if r.random() < 0.8], "doc_id long, quality int, toxic int")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    from oreweave.llm import base

    trees = quality_gbdt.fit(docs, labels.where(base.crc_bucket("doc_id", 5) != 0))
    assert len(trees.leaf) == 120
    for x in quality_gbdt.score(docs.select("doc_id", "text").withColumn("lang", F.lit("q")), labels).collect():
        assert x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3)
    scores = Counter((str(x.doc_id), round(x.score, 9)) for x in quality_gbdt.score(docs, labels).collect())
    want = Counter()
    for d in docs.collect():
        row, total = quality_gbdt.features([d.text or ""])[0], trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        want[str(d.doc_id), round(1 / (1 + math.exp(-total)), 9)] += 1
    assert scores == want


def test_quality_features_by_plain_counts():
    text = "Ab, cd!\n12|é x.\nAb, cd!\n\n" + "w " * 12
    words = WORD.findall(text)
    f = dict(zip(quality_gbdt.FEATURES, quality_gbdt.features([text])[0], strict=True))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    assert f["log_words"] == pytest.approx(math.log1p(len(words))) and f["word_length"] == pytest.approx(sum(map(len, words)) / len(words))
    assert f["dup_lines"] == pytest.approx((len(lines) - len(set(lines))) / len(lines)) and f["bars"] == pytest.approx(1 / len(words))
    assert f["not_ascii"] == pytest.approx(2 / len(text.encode())) and f["digits"] == pytest.approx(2 / sum(map(len, words)))
    assert f["distinct"] == pytest.approx(len(set(words)) / len(words)) and f["longest_run"] == pytest.approx(math.log1p(max(len(w.encode()) for w in words)))


def test_label_model_finds_the_rare_class():
    import numpy as np

    r = np.random.default_rng(1)
    truth = r.random(5000) < 0.9
    votes = np.where(truth[:, None], np.where(r.random((5000, 6)) < 0.002, -1, 1), np.where(r.random((5000, 6)) < 0.4, -1, 1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.LabelModel(patterns, counts)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.97
    assert model.prior == pytest.approx(0.9, abs=0.03)


def test_fingerprints(spark, docs, empty):
    got = fingerprint.report(spark, docs).collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    # Rows of one doc_id follow each other by their texts' hashes, those without one in the other direction.
    part = lambda r: xxhash.xxh64_intdigest((r.text or "").encode(), 42) >> 11
    order.sort(key=lambda r: part(r) if r.doc_id is None else -part(r))
    order.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    want = []
    for i, r in enumerate(order):
        own, other = r.text or "", order[(i + 1) % len(order)].text or ""
        half = len(own) // 2
        want.append((str(r.doc_id), len(own), hashlib.sha256((own[: len(own) - half] + other[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = defaultdict(set)
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text or "")
    for r in got:
        if len(texts[r.doc_id]) == 1:
            by_text[next(iter(texts[r.doc_id]))].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert sum(r.near_edited for r in got) > 1.5 * sum(r.near_next for r in got)
    want = []
    for i, r in enumerate(order):
        own, other = r.text or "", order[(i + 1) % len(order)].text or ""
        a, b, c = (multiset_hash(t) for t in (own, own[: len(own) - len(own) // 2] + other[: len(own) // 2], other))
        want.append((str(r.doc_id), a[0], b[0], round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    assert sorted((str(r.doc_id), r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    assert fingerprint.report(spark, empty).count() == 0
    assert fingerprint.report(spark, docs.where("doc_id = 7").limit(1)).count() == 1


def multiset_hash(text):
    """Fingerprint, number of pieces and counts of set bits, by the definition."""
    found = [x.encode() for x in re.split("(?<=[.!?,;|\n])", text) if x]
    seeds = [xxhash.xxh64_intdigest(struct.pack("<i", i), 42) for i in range(6)]
    hashes = [[xxhash.xxh64_intdigest(x, s) for x in found] for s in seeds]
    equal = [v for h in hashes[:4] for v in (sum(x & 0xFFFFFFFF for x in h) % 2**32, sum(x >> 32 for x in h) % 2**32)]
    counts = [sum(x >> i + k & 1 for x in h) for h in hashes[4:] for i in range(32) for k in (0, 32)]
    return "".join(f"{x:08x}" for x in (len(found), *equal, *counts)), len(found), counts


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    u, v = ([2 * c - x[1] for c in x[2]] for x in (a, b))
    norm = math.sqrt(sum(x * x for x in u) * sum(x * x for x in v))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(u, v, strict=True)) / norm)) if norm else 0.0


def test_likeness_of_very_long_texts(spark):
    """More pieces than 2^17, unlike and all alike."""
    texts = {"x": "".join(f"{i}." for i in range(140_000)), "y": "".join(f"{i}!" for i in range(140_000)), "z": "a." * 200_000, "w": "a." * 200_000 + "b."}
    lanes = fingerprint.fingerprints(spark.createDataFrame([(1, *texts.values())], "k int, x string, y string, z string, w string"), ["k"], {c: c for c in texts})
    pairs = ("xy", "zw", "xz")
    got = lanes.select(*(fingerprint.likeness(F.col(p[0]), F.col(p[1])).alias(p) for p in pairs)).first()
    plain = {c: multiset_hash(t) for c, t in texts.items()}
    for p in pairs:
        assert got[p] == pytest.approx(plain_likeness(plain[p[0]], plain[p[1]]), abs=1e-9)
    assert got.xy < 0.4 and 0.99 < got.zw < 1


def test_fingerprints_are_homomorphic(spark):
    """Order doesn't matter, and pieces can be put in and taken out."""
    texts = {"x": "a. b. c.", "y": " b.a. c.", "z": " c.", "w": "a. b."}
    df = spark.createDataFrame([(1, *texts.values())], "k int, x string, y string, z string, w string")
    lanes = fingerprint.fingerprints(df, ["k"], {c: c for c in texts})
    text = lambda c: fingerprint.as_text(c)
    x, y, z, w = (F.col(c) for c in texts)
    r = lanes.select(
        (text(x) == text(y)).alias("order"), (text(fingerprint.insert(w, z)) == text(x)).alias("put"), (text(fingerprint.delete(x, z)) == text(w)).alias("taken"),
        (text(fingerprint.insert(fingerprint.delete(x, z), z)) == text(x)).alias("back"), fingerprint.likeness(x, y).alias("one"), (text(x) == text(w)).alias("other"),
    ).first()
    assert r.order and r.put and r.taken and r.back and r.one == 1 and not r.other


def test_ranges_of_one_id(spark):
    """An id, and no id, with most of the rows are dealt to many ranges; every row still meets the one after it."""
    r = random.Random(4)
    data = [(i, f"t{i}") for i in range(40)] + [(20, f"same {r.random()}") for _ in range(400)] + [(None, f"none {r.random()}") for _ in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for ranges in (1, 2, 37):
        rows = fingerprint.edited(df, ranges).collect()
        assert len(rows) == len(data)
        held = Counter(x.range for x in rows)
        assert max(held.values()) <= (740 if ranges == 1 else 480 if ranges == 2 else 80)
        part = lambda x: xxhash.xxh64_intdigest(x[1].encode(), 42) >> 11
        order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), part(x) if x[0] is None else -part(x)))
        want = {(d, t, t[: len(t) - len(t) // 2] + order[(i + 1) % len(order)][1][: len(t) // 2]) for i, (d, t) in enumerate(order)}
        assert {(x.doc_id, x.text, x.edited) for x in rows} == want


def test_near_duplicate_stage_matches_brute_force(spark, docs):
    """Kept ids by all pairs of shingle sets, with planted near copies and a passage that many texts share."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abdeghinorst") for _ in range(r.randint(2, 8)))
    passage, data = [word() for _ in range(40)], []
    for i in range(60):
        body = [word() for _ in range(r.randint(30, 200))] + passage
        data.append((10_000 + 10 * i, " ".join(body)))
        for k in range(1, r.randint(1, 5)):
            near = list(body)
            for _ in range(k):
                near[r.randrange(len(near))] = word()
            data.append((10_000 + 10 * i + k, " ".join(near).upper()))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(data, "doc_id long, text string"))

    def cut(text):
        w = WORD.findall(lower(text))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    found = [(x.doc_id, cut(x.text)) for x in table.collect()]
    group = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][1], found[j][1]
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(found, group, strict=True):
        least[g] = min(x for x in (d, least.get(g)) if x is not None) if (d, least.get(g)) != (None, None) else None
    want = {d for (d, _), g in zip(found, group, strict=True) if d == least[g]}
    got = corpus_pipeline.STAGES[1][1](spark, table, "").collect()
    assert {x.doc_id for x in got} == want
    assert 60 < len({d for d in want if d and d >= 10_000}) < len(data)


def test_pipeline_stages(spark, docs, empty, tmp_path):
    """Every stage on awkward rows, and the whole run against the operators' brute-force rules."""
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == columns, name
        assert stage(spark, empty, "").count() == 0, name
        assert stage(spark, docs, "").count() > 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, empty, "").count() == 0
    decoded = Counter((x.doc_id, x.decoded) for x in last(spark, docs, "").collect())
    assert decoded == Counter((x.doc_id, x.text or "") for x in docs.collect())
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(TOKENIZER)
    assert out and all(r.ids == library.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in out)
    kept = {r.doc_id for r in quality_rules.report(docs).where("kept").collect()}
    assert {r.doc_id for r in out} <= kept


def test_pipeline_rows_match_brute_force(spark, docs, tmp_path):
    """All rows of the run, stage by stage in plain Python from the rows that the rules keep."""
    r, data = random.Random(8), {}
    for d in docs.select("doc_id", "text", "lang", "source", "n_chars").collect():
        if d.doc_id is not None:
            data.setdefault(d.doc_id, d)
    data = list(data.values())
    for d in data[:60]:
        w = (d.text or "").split(" ")
        if len(w) > 8:
            w[r.randrange(len(w))] = "changed"
            data.append(d.__class__(**{**d.asDict(), "doc_id": 20_000 + d.doc_id, "text": " ".join(w)}))
    table = spark.createDataFrame([tuple(d) for d in data], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {d.doc_id: d for d in quality_rules.filter_documents(table).collect()}

    def cut(text):
        w = WORD.findall(lower(text))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    ids = sorted(rows)
    group, sets = {i: i for i in ids}, {i: cut(rows[i].text) for i in ids}
    for i in ids:
        for j in ids:
            if j < i and group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    kept = [i for i in ids if group[i] == i]
    assert 10 < len(kept) < len(ids) < len(data)
    least, texts = {}, {}
    for i in kept:
        raw = (rows[i].text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - 49):
            if least.setdefault(raw[at : at + 50], i) < i:
                gone[at : at + 50] = b"\1" * 50
        at, left = 0, []
        for c in rows[i].text or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        texts[i] = "".join(left)
    sources = Counter(rows[i].source for i in kept)
    library, want = Tokenizer.from_file(TOKENIZER), []
    for i in kept:
        rate = len(kept) / (len(sources) * sources[rows[i].source])
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        copies, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            copies += 1
            p *= rate / copies
            total += p
        code = library.encode(texts[i], add_special_tokens=False).ids
        want += [(i, rows[i].lang or "", rows[i].source or "", len(texts[i]), len(code), code, texts[i])] * copies
    got = [(x.doc_id, x.lang or "", x.source or "", x.n_chars, x.n_tokens, list(x.ids), x.decoded) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
