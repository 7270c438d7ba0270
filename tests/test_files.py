"""Records across splits, heads of files and exact order of numbers, against Python."""

import csv
import io
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabkit.operators import ordering, profile
from tabkit.sources import delimited, records


def odd_file(seed, n=3000):
    r = random.Random(seed)
    cells = ["", "plain", 'quo"ted', "a,b", "line\nbreak", "\n\n", '"', '""\n"', "é\r\nü", "x" * 700, " lead", 'in "the" mid', "\n,\n"]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
    w.writerow(["id", "a", "b"])
    for i in range(n):
        w.writerow([i, *(r.choice(cells) for _ in range(r.choice([2, 2, 2, 1, 3, 0])))])
        if r.random() < 0.02:
            out.write("\n")
        if r.random() < 0.02:
            out.write(f'{i},5" pipe,6" pipe\n')
    return out.getvalue()


@pytest.mark.parametrize(("seed", "split"), [(1, 1000), (2, 300), (3, 20_000)])
def test_records_across_splits(spark, tmp_path, seed, split):
    files = {"x.csv": odd_file(seed), "y.csv": odd_file(seed + 10, 40) + '9,"never closed\nand on', "z.csv": "﻿\n \n" + '"id","a\nb"\n1,2'}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    old = [spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    try:
        got = records.read_records(spark, str(tmp_path)).collect()
        kept = delimited.read_delimited(spark, str(tmp_path / "x.csv"), ordinal="at").orderBy("at").drop("at").collect()
    finally:
        for k, v in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), old, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name, text in files.items():
        want = list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))
        own = sorted((r.start, r.row, r.cells, r.n_cells, r.header, r.raw) for r in got if r.file.endswith(name))
        assert [x[2] for x in own] == want, name
        assert [x[3] for x in own] == [len(x) for x in want]
        assert [i for i, x in enumerate(own) if x[4]] == [next(i for i, x in enumerate(want) if any(c.strip() for c in x))]
    if split < 20_000:
        assert len({r.start for r in got}) > 20
    rows = [x for x in csv.reader(io.StringIO(files["x.csv"], newline="")) if x][1:]
    assert [tuple(r) for r in kept] == [tuple((x + [""] * 3)[:3]) for x in rows]


def test_lone_carriage_returns(spark, tmp_path):
    text = 'a,b\r1,2\r3,"x\ry"\r\n5,6\r7,"8\n\r9"\n'
    (tmp_path / "m.csv").write_bytes(text.encode())
    got = records.read_records(spark, str(tmp_path / "m.csv")).collect()
    assert [r.cells for r in sorted(got, key=lambda r: (r.start, r.row))] == list(csv.reader(io.StringIO(text, newline="")))
    assert sum(r.header for r in got) == 1


def test_head_of_a_file(spark, tmp_path):
    text = "n,t\n9,z\n100,a\n" + "".join(f'{i},"{"y" * 500}\n{i}"\n' for i in range(50))
    (tmp_path / "h.csv").write_text(text)
    want = list(csv.reader(io.StringIO(text)))[1:]
    for n in (1, 2, 26, 5000):
        assert [list(r) for r in delimited.head(spark, str(tmp_path / "h.csv"), n).collect()] == want[:n]
    df = delimited.read_delimited(spark, str(tmp_path / "h.csv"))
    first = profile.sample_head(delimited.read_delimited(spark, str(tmp_path / "h.csv"), multi_line=False), 1)
    assert tuple(first.first()) == ("9", "z") and "Sort" not in first._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 52
    (tmp_path / "e.csv").write_text("")
    assert delimited.preview(spark, str(tmp_path / "e.csv")).empty


def test_exact_order_of_numbers(spark):
    r = random.Random(1)
    numbers = ["9007199254740993", "9007199254740992", "-9007199254740993", "-9007199254740992", "0", "-0", "0.000", "1e3", "1000.0001", "-1e-30", "1E-30", ".5", "5.", "+7", "inf", "-inf", "1e400", "-1e400", "0.1", "0.10000000000000000000000000000001"]
    numbers += [r.choice(["", "-", "+"]) + "".join(r.choice("0123456789") for _ in range(r.randint(17, 40))) + r.choice(["", "." + "".join(r.choice("0123456789") for _ in range(r.randint(0, 30)))]) for _ in range(400)]
    rows = [(i, x) for i, x in enumerate(numbers + ["", " ", "text", "nan", "1d"])]
    got = [x.v for x in ordering.sort_records(spark.createDataFrame(rows, "i int, v string").repartition(4), ["v"], ordinal=["i"]).collect()]
    want = sorted(rows[: len(numbers)], key=lambda x: (Decimal(x[1]), x[0]))
    assert got[2 : 2 + len(numbers)] == [x[1] for x in want]
    assert got[:2] == ["", " "] and got[2 + len(numbers) :] == ["nan", "1d", "text"]
    down = [x.v for x in ordering.sort_records(spark.createDataFrame(rows[: len(numbers)], "i int, v string"), ["v"], ordinal=["i"], descending=True).collect()]
    assert [Decimal(x) for x in down] == sorted((Decimal(x) for x in numbers), reverse=True)


def test_one_file_by_many_tasks(spark, tmp_path):
    df = spark.range(0, 5000, 1, 7).selectExpr("cast(id as string) id", "concat('\"', id, '\n,', repeat('x', cast(id % 90 as int))) `a,b`")
    want = [["id", "a,b"], *([str(i), f'"{i}\n,{"x" * (i % 90)}'] for i in range(5000))]
    out = tmp_path / "one file.csv"
    for _ in range(2):  # the second time it is there
        delimited.write_file(df, str(out))
        with open(out, newline="") as f:
            assert list(csv.reader(f)) == want
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one file.csv"]
    assert delimited.read_delimited(spark, str(out)).count() == 5000
    delimited.write_file(df.orderBy("`a,b`"), str(out), quoted_columns=["id"], delimiter=";", header=False)
    with open(out, newline="") as f:
        assert list(csv.reader(f, delimiter=";")) == sorted(want[1:], key=lambda x: x[1])
    delimited.write_file(df.limit(0), str(out))
    assert out.read_text() == 'id,"a,b"\n'
    lines = spark.range(0, 100, 1, 9).selectExpr("concat('l', id) value")
    delimited.write_lines(lines, str(out), "é")
    assert out.read_text("utf-8").splitlines() == ["é", *(f"l{i}" for i in range(100))]
    delimited.write_lines(lines.where("value = 'none'"), str(out))
    assert out.read_text() == ""


def test_folder_in_one_scan(spark, tmp_path):
    r, want, plans = random.Random(4), [], {}
    for n in (20, 200):
        folder = tmp_path / str(n)
        folder.mkdir()
        want = []
        for i in range(n):
            d, breaks, encoding = ",;"[i % 2], i % 3 == 0, "cp1252" if i % 5 == 0 else "utf-8"
            rows = [[str(k), f"é{i}" + "\nnext" * breaks, f"c{d}{r.random()}"] for k in range(r.randint(1, 4))]
            out = io.StringIO(newline="")
            csv.writer(out, delimiter=d, lineterminator="\n").writerows([["id", "na me", "z"], *rows])
            (folder / f"file {i}.csv").write_bytes(("\n" * (i % 2) + out.getvalue()).encode(encoding))
            want += [(*x, f"file {i}.csv") for x in rows]
        (folder / "other.csv").write_text("id,x,z\n1,2,3\n")
        (folder / "narrow.csv").write_text("id;x\n1;2\n")
        (folder / "blank.csv").write_text("\n \n")
        (folder / "long.csv").write_text("id,na me,z\n")
        used, skipped = delimited.scan_directory(spark, str(folder))
        assert skipped == [("blank.csv", "empty")] and len(used) == n + 3
        got = delimited.read_files(spark, used, source="from", ordinal="at")
        assert got.skipped == [("narrow.csv", "header differs"), ("other.csv", "header differs")]
        assert [tuple(x) for x in got.df.orderBy("at").drop("at").collect()] == want
        plans[n] = got.df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plans[20] == plans[200]
    assert delimited.read_files(spark, used, on_mismatch="abort").df.count() == len(want)
    each = {p.path: delimited.preview(spark, p.path) for p in used[:6]}
    assert all((p.header, p.delimiter, p.encoding, p.quoted) == (q.header, q.delimiter, q.encoding, q.quoted) for p in used[:6] for q in [each[p.path]])
    assert delimited.read_files(spark, []).df is None


def test_totals_of_a_write(spark, tmp_path):
    from tabkit.plans.job import JobError, JobSpec
    from tabkit.plans.reports import Totals, balanced

    df = spark.range(0, 1000, 1, 4).selectExpr("cast(id as string) id", "cast(id % 10 as string) k", "'' note")
    steps = [{"op": "filter_select", "rules": [{"kind": "text", "field": "k", "operator": "equals", "values": ["3", "4"]}]}, {"op": "dedupe", "fields": ["k"], "order_by": ["id"]}, {"op": "sort", "fields": ["id"]}]
    report = JobSpec(steps, delimiter=";").write(df, str(tmp_path / "out"))
    assert report.totals == {"rows read": 1000, "after 1 filter_select": 200, "after 2 dedupe": 2, "after 3 sort": 2, "rows written": 2}
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep=";", header=True).orderBy("id").collect()] == [("103", "3", None), ("104", "4", None)]
    text = report.text("Control", {"input": "x"})
    assert "rows read:" in text and "1,000" in text and "fields: id, k, note" in text and str(tmp_path / "out") in text
    none = JobSpec([{"op": "filter_select", "rules": [{"kind": "text", "field": "k", "operator": "equals", "values": "none"}]}]).write(df, str(tmp_path / "none"))
    assert list(none.totals.values()) == [1000, 0, 0]
    empty = JobSpec([]).write(df.where("false"), str(tmp_path / "empty"))
    assert empty.totals == {"rows read": 0, "rows written": 0}
    with pytest.raises(JobError):
        JobSpec([{"op": "nothing"}]).write(df, str(tmp_path / "bad"))
    totals, three = Totals(), F.col("k") == "3"
    seen = totals.watch(df, read=F.count("*"), matched=F.count_if(three), nonmatched=F.count_if(~three)).where(three)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("Range") == 1
    seen.write.parquet(str(tmp_path / "three"))
    assert totals.get() == {"read": 1000, "matched": 100, "nonmatched": 900} and balanced(totals.get(), "read", ["matched", "nonmatched"])
