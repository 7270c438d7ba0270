"""Writers, checks and styles that no query shows."""

from tabkit.operators import keyjoin, ordering, profile
from tabkit.plans.job import JobSpec
from tabkit.plans.reports import run_log
from tabkit.sources import delimited


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_writers(spark, tmp_path):
    df, path = spark.createDataFrame([("1", "a;b"), ("2", "c\\")], "id string, t string").coalesce(1), str(tmp_path / "x")
    delimited.write_delimited(df, path, ";", quoting=False)
    assert lines(spark, path) == ["1;a\\;b", "2;c\\\\", "id;t"]
    delimited.write_like(df, path, delimited.Preview("s", ["id", "t"], "|", quoted=[True, False]))
    assert lines(spark, path) == ['"1"|a;b', '"2"|c\\', "id|t"]
    assert [r.value for r in delimited.read_lines(spark, path).collect()][0] == "id|t"
    out = delimited.write_deduped(df, f"{path}.csv")
    assert out == f"{path}_DEDUPED.csv" and lines(spark, out) == ["1,a;b", "2,c\\", "id,t"]
    delimited.write_split(df.selectExpr("*", "id = '1' matched"), path)
    assert lines(spark, f"{path}/matched=true") == ["1,a;b", "id,t"] and len(lines(spark, f"{path}/matched=false")) == 2
    assert delimited.path_problems(spark, [path, f"{path}/none"], [f"{path}/none/out", f"{path}/out"]) == [f"no input '{path}/none'", f"no folder for output '{path}/none/out'"]
    with run_log(str(tmp_path / "log.txt")) as log:
        log.info("read %d", 3)
    assert (tmp_path / "log.txt").read_text().endswith("INFO read 3\n")


def test_profiles_to_fill_in():
    p = profile.blank_profile(["a", "b"])
    assert [(f.name, f.kind, f.flag) for f in p.fields] == [("a", "str", profile.SKIP), ("b", "str", profile.SKIP)] and profile.problems(p, ["a", "b"]) == []
    bad = profile.Profile([profile.FieldProfile("a", length=-1), profile.FieldProfile("a"), profile.FieldProfile("x", precision=2)])
    assert profile.problems(bad, ["a", "b"]) == ["no field 'x'", "field 'b' has no profile", "field 'a' is repeated", "field 'a': length -1, precision 0", "field 'x': length 0, precision 2"]


def test_jobs_that_fail(spark):
    df = spark.createDataFrame([("1",)], "a string")
    out = JobSpec([{"op": "nothing"}, {"op": "sort", "fields": ["none"]}, {"op": "add_constant", "values": {"b": "x"}}]).run(df)
    assert out.df.columns == ["a", "b"] and out.errors[0] == "unknown step 'nothing'" and out.errors[1].startswith("step 2, sort") and len(out.errors) == 2


def test_orders_and_styles(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "")], "i int, v string").coalesce(1)
    order = lambda **k: [r.i for r in ordering.sort_records(df, ["v"], **k).collect()]
    assert order(nulls_first=True, numeric_aware=False) == [1, 4, 3, 2] and order(nulls_first=False, numeric_aware=False) == [4, 3, 2, 1]
    assert order(nulls_first=True, numeric_aware=False, descending=True) == [1, 2, 3, 4]
    key = spark.createDataFrame([(" a ",)], "v string")
    found = lambda style: [r.v for r in keyjoin.keep_matching(spark.createDataFrame([("a",), ("A",), (" a",), ("b",)], "v string"), key, [("v", "v")], style).collect()]
    assert sorted(found(keyjoin.PROFILES["key_record"])) == [" a", "a"] and sorted(found(keyjoin.PROFILES["key_denorm"])) == [" a", "A", "a"]
