"""State between batches of a stream, against Python."""

import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from tabkit.operators import profile
from tabkit.operators.keyjoin import KeyStyle
from tabkit.streaming import files


def test_lookup_that_uses_rows_up(spark, tmp_path):
    """One key holds half of all rows; parts arrive one by one; the last batch is run twice."""
    r = random.Random(3)
    table = [(i, r.choice([" A ", "a", "b", "", None]), f"v{i}") for i in range(300)]
    rest = defaultdict(deque)
    for i, k, v in table:
        rest[(k or "").strip().lower()].append(v)
    t = spark.createDataFrame(table, "at long, k string, v string").repartition(3)
    want, at, path = {}, 0, str(tmp_path)
    schema = "at long, key string, v string"

    def run():
        return files.lookup_fifo(spark.readStream.schema(schema).parquet(f"{path}/in"), t, [("key", "k")], ["v"], ["at"], ["at"], f"{path}/out", f"{path}/check", f"{path}/state").awaitTermination()

    for size in (150, 1, 200, 40):
        rows = [(at + i, r.choice(["a", "A", "a", "b", "c", None]), "own") for i in range(size)]
        at += size
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{path}/in")
        for i, k, _ in rows:
            left = rest[(k or "").strip().lower()]
            want[i] = left.popleft() if left else None
        run()
    got = spark.read.parquet(f"{path}/out")
    assert got.columns[:4] == ["at", "key", "v", "v (stub)"]
    assert {x[0]: x[3] for x in got.collect()} == want and got.count() == at
    assert files._versions(spark, f"{path}/state/used") == [2, 3]
    (tmp_path / "check" / "commits" / "3").unlink()  # as if the driver had died before it was committed
    for crc in (tmp_path / "check" / "commits").glob(".3.crc"):
        crc.unlink()
    run()
    assert {x[0]: x[3] for x in spark.read.parquet(f"{path}/out").collect()} == want and spark.read.parquet(f"{path}/out").count() == at
    try:
        files.lookup_fifo(spark.readStream.schema(schema).parquet(f"{path}/in"), t, [("key", "k")], ["v"], ["at"], ["at"], path, path, path, KeyStyle(zero_pad=True))
        raise AssertionError
    except ValueError as e:
        assert "max_width" in str(e)


def test_profile_of_a_stream(spark, tmp_path):
    rows = [[("1", "-2.50", "x")], [("22", "(3.125)", "yy"), ("", "4", "3")], [(None, "-1.0", "zzzz")]]
    schema, path = "n string, balance string, t string", str(tmp_path)
    assert files.profile_so_far(spark, f"{path}/state") is None
    for part in rows:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{path}/in")
        files.profile_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/check", f"{path}/state").awaitTermination()
    whole = spark.createDataFrame([x for part in rows for x in part], schema)
    for strict in (False, True):
        assert files.profile_so_far(spark, f"{path}/state", strict) == profile.build_profile(whole, strict=strict)
    empty = profile.profile_state(whole.limit(0))
    assert profile.profile_of(profile.merge_states(empty, profile.profile_state(whole))) == profile.build_profile(whole)
    more = profile.merge_states(profile.profile_state(whole), profile.profile_state(whole.select(F.lit("new").alias("u"), "n")))
    assert {f.name for f in profile.profile_of(more).fields} == {"n", "balance", "t", "u"}


def test_repeats_within_a_watermark(spark, tmp_path):
    schema, path = "k string, at timestamp", str(tmp_path)
    for part in ([("a", "2024-01-01 00:00:00"), ("A ", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")], [("a", "2024-01-01 00:00:05"), ("c", "2024-01-01 00:00:06")]):
        spark.createDataFrame(part, "k string, at string").selectExpr("k", "cast(at as timestamp) at").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        files.run_available(stream, f"{path}/out", f"{path}/check", lambda df: files.dedupe_within(df, ["k"], "at", "1 hour")).awaitTermination()
    assert sorted(r.k.strip().lower() for r in spark.read.parquet(f"{path}/out").collect()) == ["a", "b", "c"]
