"""Every query with SQL gives the rows of that SQL; the others give what plain code does."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from tessera.functions import markup
from tessera.plans import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    ours = queries.QUERIES[name](spark, sf)
    want = duck.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(ours.columns) == sorted(want.column_names)
    got = [tuple(r[n] for n in sorted(ours.columns)) for r in ours.collect()]
    plain = lambda rows: sorted((tuple(round(float(x), 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(got) == plain([tuple(r[n] for n in sorted(r)) for r in want.to_pylist()])


def test_pages_markdown(spark, sf):
    got = {r.page_id: (r.title, r.text) for r in queries.QUERIES["pages_markdown"](spark, sf).collect()}
    assert got == {r.page_id: markup.render(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}


def test_chunk_report(spark, sf):
    by = defaultdict(list)
    for r in queries.QUERIES["wiki_chunks"](spark, sf).collect():
        by[r.content_kind].append(r.token_count)
        by[None].append(r.token_count)
    rank = lambda x, p: sorted(x)[-(-len(x) * p // 100) - 1]
    want = {k: (len(x), min(x), max(x), rank(x, 50), rank(x, 95)) for k, x in by.items()}
    assert {r.content_kind: (r.chunks, r.least, r.most, r.p50, r.p95) for r in queries.QUERIES["chunk_report"](spark, sf).collect()} == want


def test_all_others_have_sql():
    """Chunks are held against a plain version in test_wiki_chunks.py."""
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"pages_markdown", "chunk_report", "wiki_chunks"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["vec_id", "score", "lang", "source"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
