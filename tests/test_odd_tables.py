"""Queries on small odd tables against their twins."""

from __future__ import annotations

import duckdb
import pytest

from oreweave.plans import registry

QUERIES, TWINS = registry.queries(), registry.oracle_sql()


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query and its twin return the same rows of one table; what they return."""

    def run(name: str, table: str, rows: str) -> list[tuple]:
        db = duckdb.connect()
        db.sql(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        twin = db.sql(TWINS[name])
        got = QUERIES[name](spark, str(tmp_path)).select(*twin.columns).collect()
        assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in twin.fetchall())
        return sorted(map(tuple, got))

    return run


def test_fields_keep_line_ends(same):
    texts = ["Thing.\nErl of some length", "  a b \t and more text", "abc", "\tab  ", "       spaces only", "", " \n"]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS item_id, '{t}' AS text" for i, t in enumerate([*texts, *texts], 3))
    assert (3, "Thing.\nErlÿ of some length", "Thing.\n") in same("f06_decoded_texts", "benchmark", rows)


def test_phrases_have_the_words_of_the_twin(same):
    found = ["x of the y", "OF THE cat, froming and froms", "éof theé", "of the fromage", "of_the, or _of the_"]
    others = ["of\nthe y", "of  the", "of the y from\nz", "fromé of the", "of thes", "ofs the", "of-the", "", "the of", "of theİ", "İof the", "of the from"]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, '{t}' AS text" for i, t in enumerate([*found, *others]))
    assert same("j01_full_text_phrase", "documents", f"{rows} UNION ALL SELECT 99, NULL") == [(i,) for i in range(len(found))]


@pytest.mark.parametrize("name", ["j20_key_profiles", "f25_key_margins"])
def test_keys_of_many_vectors(same, name):
    """In seconds, which took hours; and of vectors of which one pitch class alone is heard."""
    many = "SELECT i AS vec_id, [(hash(i * 64 + j) % 2000 / 1000.0 - 1)::FLOAT for j in range(64)] AS embedding FROM range(20000) t(i)"
    odd = "SELECT -1, [1 - abs(sign(j % 12 - 4)) for j in range(64)] UNION ALL SELECT -2, [1 for j in range(60)] || [1, 1, 1, 1]"
    assert len(same(name, "embeddings", f"{many} UNION ALL {odd}")) == 20002
