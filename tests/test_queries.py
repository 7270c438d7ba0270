"""Every registered query of the library against its SQL in DuckDB."""

import hashlib
import os
import unicodedata

import duckdb
import pytest

from tabkit import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DIR)):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{DIR}/{f}')")
    return con


def _rows(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, DIR)
    names = sorted(df.columns)
    want = duck.sql(core.oracle_sql()[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert _rows([tuple(r[c] for c in names) for r in df.collect()]) == _rows([tuple(r[i] for i in at) for r in want.fetchall()])


def test_all_queries_have_sql():
    assert set(core.queries()) == set(core.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_concat_over_the_whole_table(spark, duck):
    got = core.queries()["concat_union_whole"](spark, DIR)
    assert _rows([(r.c_custkey,) for r in got.collect()]) == _rows(duck.sql("select c_custkey from customer").fetchall())


def test_cleaning_with_the_normal_form(spark, duck, tmp_path):
    import __spark_entry__

    texts = [None, "", " \uff21\uff11\u3000x ", "\ufb01ne\u00a0\u200bprint", "\u3000\u2460\u3000", "e\u0301", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.cleaned for r in __spark_entry__.queries()["clean_cells_normal_form"](spark, str(tmp_path)).collect()}
    clean = lambda t: unicodedata.normalize("NFKC", "".join(c for c in t or "" if c not in "\ufeff\u00a0\u200b\u200c\u200d")).strip()
    assert got == {i: hashlib.md5(clean(t).encode()).hexdigest() for i, t in enumerate(texts)}
    names = [(3, "  "), (7, "\uff2e\uff11"), (11, "\ufb01"), (1, "q"), (2, "q"), (4, "q")]
    spark.createDataFrame(names, "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    reasons = {r.reason: r.n for r in __spark_entry__.queries()["concat_row_hygiene_normal_form"](spark, str(tmp_path)).collect()}
    assert reasons == {"too few cells": 2, "kept": 2, "number alone": 1, "blank row": 1}
    rows = spark.createDataFrame([("\uff12\uff10\uff12\uff14", "")], "a string, b string")
    assert core.concat.with_reason(rows).first().drop_reason == "number alone" and core.concat.with_reason(rows).first().a == "2024"
