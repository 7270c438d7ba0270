"""Dirty input that the test tables lack: ragged rows, quotes, encodings, blanks, padding."""

import pytest
from pyspark.sql import functions as F

from tabkit.functions import dates, fields, text
from tabkit.functions.rules import DateRule, Flags, NumericRule, RuleSet, TextRule
from tabkit.operators import columns, compare, concat, filtering, keyjoin, normalize, ordering, profile
from tabkit.plans.job import JobSpec
from tabkit.plans.reports import balanced, control_report
from tabkit.sources import delimited
from tabkit.streaming import files


def frame(spark, names, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def values(df):
    return [tuple(r) for r in df.collect()]


def test_zero_padded_keys(spark):
    main = frame(spark, ["id", "name"], [("7", "a"), ("007", "b"), ("0012", "c"), ("ABC", "d"), ("", "e"), (None, "f")])
    key = frame(spark, ["id"], [("007",), ("0012",)])
    style = keyjoin.KeyStyle(zero_pad=True)
    assert keyjoin.learn_widths(key, ["id"], style) == (4,)
    hit, miss = keyjoin.split_by_key(main, key, [("id", "id")], style)
    assert sorted(r["name"] for r in hit.collect()) == ["a", "b", "c"]
    assert sorted(r["name"] for r in miss.collect()) == ["d", "e", "f"]


def test_dirty_keys_and_empty_key(spark):
    main = frame(spark, ["k"], [("﻿Ab c",), (" ab​C ",), ("１２",), (" ",), ("x",)])
    key = frame(spark, ["k"], [("abc",), ("12",), ("",)])
    assert keyjoin.keep_matching(main, key, [("k", "k")], keyjoin.KeyStyle(clean=True)).count() == 4


def test_lookup_modes(spark):
    main = frame(spark, ["k", "amt"], [("1", "a"), ("1", "b"), ("2", "c")])
    table = frame(spark, ["k", "amt", "n"], [("1", "x", "1"), ("1", "y", "2")])
    first = keyjoin.lookup(main, table, [("k", "k")], ["amt"], ["n"])
    assert first.columns == ["k", "amt", "amt (stub)"]
    assert sorted(values(first)) == [("1", "a", "x"), ("1", "b", "x")]
    assert keyjoin.lookup(main, table, [("k", "k")], ["amt"], ["n"], "all").count() == 5
    fifo = keyjoin.lookup(main, table, [("k", "k")], ["amt"], ["n"], "fifo", main_order=["amt"])
    assert sorted(values(fifo)) == [("1", "a", "x"), ("1", "b", "y"), ("2", "c", None)]


def test_lookup_pads_to_the_wider_side(spark):
    main = frame(spark, ["k", "amt"], [("0007", "a"), ("12", "b"), ("x", "c")])
    style = keyjoin.KeyStyle(zero_pad=True)
    for keys in (("7", "12"), ("7", "00012")):
        table = frame(spark, ["k", "n"], [(keys[0], "1"), (keys[1], "2")])
        got = {m: sorted(values(keyjoin.lookup(main, table, [("k", "k")], ["n"], ["n"], m, style, ["amt"]))) for m in ("first", "all", "fifo")}
        assert got["first"] == [("0007", "a", "1"), ("12", "b", "2")]
        assert got["all"] == [("0007", "a", "1", True), ("12", "b", "2", True), ("x", "c", None, False)]
        assert got["fifo"] == [("0007", "a", "1"), ("12", "b", "2"), ("x", "c", None)]


def test_sort_blank_number_text(spark):
    df = frame(spark, ["v"], [("10",), ("9",), ("2.5",), ("",), ("abc",)])
    assert [r.v for r in ordering.sort_records(df, ["v"]).collect()] == ["", "2.5", "9", "10", "abc"]
    assert [r.v for r in ordering.sort_records(df, ["v"], numeric_aware=False).collect()] == ["", "10", "2.5", "9", "abc"]


def test_dedupe(spark):
    df = frame(spark, ["n", "state"], [("1", "Kansas"), ("2", " kansas"), ("3", "KANSAS"), ("4", "Texas")])
    assert sorted(values(ordering.dedupe_first(df, ["state"], ["n"]))) == [("1", "Kansas"), ("4", "Texas")]
    assert sorted(values(ordering.dedupe_first(df, ["state"], ["n"], rewrite_keys=True))) == [("1", "kansas"), ("4", "texas")]
    assert ordering.duplicates_only(df, ["state"]).count() == 3
    assert values(ordering.dedupe_counts(df, ["state"])) == [(4, 2, 2)]


def test_numeric_rules_on_text(spark):
    df = frame(spark, ["v"], [("12",), (" 12 ",), ("1e5",), ("nan",), ("1_000",), ("$1",), ("",), ("1d",), (None,)])
    got = lambda *r: sorted(x.v for x in filtering.filter_select(df, RuleSet((NumericRule("v", *r),))).collect())
    assert got("equals", 12) == [" 12 ", "12"]
    assert got("greater_than", 100) == ["1e5", "nan"]
    assert got("between", 0, 1e6) == [" 12 ", "12", "1e5"]
    assert filtering.filter_omit(df, RuleSet((NumericRule("v", "equals", 12),))).count() == 7


def test_text_rules(spark):
    df = frame(spark, ["v"], [('"Abc"',), ("'abc'",), ("xabc",)])
    assert filtering.filter_select(df, RuleSet((TextRule("v", "equals", ("ABC",)),), Flags(strip_quotes=True))).count() == 2
    assert filtering.filter_select(df, RuleSet((TextRule("0", "contains", ("ab", "q")),), Flags(case_sensitive=True))).count() == 2
    assert filtering.filter_select(df, RuleSet(())).count() == 3


def test_date_rules(spark):
    df = frame(spark, ["d"], [("01/05/2024",), ("1/5/2024",), ("bad",)])
    assert filtering.filter_select(df, RuleSet((DateRule("d", "exact", "01/05/2024", format="%m/%d/%Y"),))).count() == 2
    serial = frame(spark, ["e", "j", "p"], [("45555", "24139", "DT25139"), ("x", "24400", "DT")])
    got = serial.select(*(dates.parsed(c, f).cast("date").cast("string") for c, f in (("e", dates.EXCEL), ("j", dates.JULIAN), ("p", dates.PREFIXED_JULIAN))))
    assert values(got) == [("2024-09-20", "2024-05-18", "2025-05-19"), (None, None, None)]
    assert dates.parse_literal("45555", dates.EXCEL).date().isoformat() == "2024-09-20"


def test_replace(spark):
    df = frame(spark, ["v"], [(" Old Value ",), ("old",), ("oLd-old",)])
    run = lambda *r: [x.v for x in columns.replace_values(df, [columns.Replacement("v", *r)])[0].collect()]
    assert run("OLD", "n") == [" Old Value ", "n", "oLd-old"]
    assert run("old", "n\\1", False) == ["n\\1 Value", "n\\1", "n\\1-n\\1"]
    assert run("old", "n", False, True) == [" Old Value ", "n", "oLd-n"]
    assert columns.replace_values(df, [columns.Replacement("zz", "a", "b")])[1]


def test_columns(spark):
    df = frame(spark, ["A", "b"], [(" x ", "１"), ("", " ")])
    out, warn = columns.choose_columns(df, ["a", 1, "B", "nope"], clean=True)
    assert out.columns == ["A", "b", "b (stub)"] and len(warn) == 1
    assert values(out)[0] == ("x", "1", "1")
    assert columns.drop_blank_rows(df).count() == 1
    with pytest.raises(fields.UnknownField):
        columns.choose_columns(df, ["nope"])


def test_concat(spark):
    a, b, c = frame(spark, ["x", "y"], [("1", "2")]), frame(spark, ["X", "Y"], [("3", "4")]), frame(spark, ["y", "x"], [("5", "6")])
    strict = concat.concat_frames([("a", a), ("b", b), ("c", c)])
    assert strict.used == ["a"] and len(strict.skipped) == 2
    assert concat.concat_frames([("a", a), ("b", b), ("c", c)], concat.COMPATIBLE).used == ["a", "b"]
    assert concat.concat_frames([("a", a), ("b", b), ("c", c)], concat.NONE).df.count() == 3
    rows = frame(spark, ["p", "q", "r", "year"], [("a", "b", "c", "2025"), ("", " ", "", ""), ("", "", "", "2025"), ("z", "", "", "")])
    keep, drop = concat.hygiene(rows)
    assert keep.count() == 1
    assert sorted(r.drop_reason for r in drop.collect()) == ["blank row", "too few cells", "year alone"]


def test_number_alone_is_a_line_of_one_cell(spark):
    rows = spark.createDataFrame([("999", "", "", 3), ("1000", "", "", 3), ("1001", "", "", 1), ("1002", "", "", None)], "a string, b string, c string, width int")
    reasons = {r.a: r.drop_reason for r in concat.with_reason(rows, width="width").collect()}
    assert reasons == {"999": "too few cells", "1000": "too few cells", "1001": "wrong width", "1002": "number alone"}


def test_compare(spark):
    a = frame(spark, ["n", "v", "w"], [("1", "a", "p"), ("2", "b", "q"), ("3", "c", "r"), ("4", "d", "s")])
    b = frame(spark, ["n", "v"], [("1", "a"), ("2", "X"), ("3", "c")])
    pairs = compare.paired(a, b, [F.col("n")], [F.col("n")])
    assert values(compare.compare_counts(pairs)) == [(2, 1, 1, 0)]
    report = compare.compare_report(pairs)
    assert "differed: 1" in report and "~" in report


def test_profile_and_normalize(spark):
    df = frame(spark, ["ID", "Amount", "Notes"], [("123", "$12.30", "  abc"), ("456", "(45.00)", "xyz "), ("789", "67.89", "123")])
    p = profile.build_profile(df)
    assert [(f.kind, f.length, f.precision) for f in p.fields] == [("int", 3, 0), ("float", 7, 2), ("str", 3, 0)]
    assert {r["field"]: r["sign"] for r in profile.sign_styles(df, ["Amount"]).collect()}
    text_only = profile.Profile([profile.FieldProfile(c, "str", n) for c, n in (("ID", 3), ("Amount", 7), ("Notes", 5))])
    assert values(normalize.normalize(df, text_only, "batch"))[0] == ("123", "$12.30 ", "abc  ")
    strict = profile.Profile([profile.FieldProfile("Amount", "float", 8, 2, flag="strict")])
    assert [r.Amount for r in normalize.normalize(df, strict, "record").collect()] == ["00012.30", "00-45.00", "00067.89"]
    bad = frame(spark, ["n"], [("x",), ("5",)])
    assert [r.n for r in normalize.normalize(bad, profile.Profile([profile.FieldProfile("n", "int", 3, flag="strict")]), "record").collect()] == ["[ERROR: x]", "005"]
    assert values(normalize.warnings(bad, profile.Profile([profile.FieldProfile("n", "int", 3)]))) == [(1,)]
    assert profile.hinted_type("ZipCode") == "str" and profile.hinted_type("FiscalYear") == "int" and profile.hinted_type("Notes") is None


def test_text_helpers(spark):
    df = frame(spark, ["v"], [("(1,234.50)",), ("-5",), ("5-",), ("$3",), ("x",)])
    assert [r[0] for r in df.select(text.currency("v")).collect()] == [-1234.5, -5.0, None, 3.0, None]
    assert [r[0] for r in df.select(text.sign_style("v")).collect()] == ["paren", "leading", "trailing", "none", "str"]
    assert [r[0] for r in df.select(text.left_fill("v", 3)).collect()] == ["(1,234.50)", "0-5", "05-", "0$3", "00x"]
    assert text.mismatch_mask("abc", "abd") == "  ~" and text.chunks("") == [""]


def test_field_helpers():
    assert fields.unique_header(["a", "A", "a"]) == ["a", "A (stub)", "a (stub2)"]
    assert fields.parse_list("a; b,a\tc") == ["a", "b", "c"]
    assert fields.auto_map(["Id", "x"], ["ID "]) == [("Id", "ID ")]
    assert sorted(["file10.csv", "file2.csv"], key=fields.natural_key) == ["file2.csv", "file10.csv"]
    assert fields.parse_ints("1, 2") == [1, 2] and fields.parse_ints("x") is None


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id;name\n1;"x;""y"""\n2; b \n3\n'.encode())
    df = delimited.read_delimited(spark, str(tmp_path / "a.csv"), ordinal="at")
    assert [(r.id, r.name) for r in df.orderBy("at").collect()] == [("1", 'x;"y"'), ("2", " b "), ("3", "")]
    (tmp_path / "c.csv").write_bytes("k,v\n1,caf\xe9 \x80\n".encode("latin-1"))
    assert delimited.read_delimited(spark, str(tmp_path / "c.csv")).first().v == "café €"
    (tmp_path / "n.csv").write_bytes(b"1,2,3\n4,5,6\n")
    assert delimited.read_delimited(spark, str(tmp_path / "n.csv"), has_header=False).columns == ["COL_0", "COL_1", "COL_2"]
    out = str(tmp_path / "out")
    delimited.write_delimited(df.drop("at"), out, ";", single_file=True)
    assert values(delimited.read_delimited(spark, out_file(out), ";")) == values(df.drop("at"))
    delimited.write_delimited(df.drop("at"), out, ";", quoted_columns=["id"])
    assert '"1";"x;""y"""' in open(out_file(out)).read()
    delimited.write_delimited(df.limit(0).drop("at"), out, single_file=True)
    assert open(out_file(out)).read().strip() == "id,name"
    assert delimited.probe_encoding(b"\x81\x80") == "ISO-8859-1"
    assert delimited.quote_pattern('a,b\n"1",2', ",") == [True, False]


def test_malformed_lines_whatever_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "widths.csv")
    (tmp_path / "widths.csv").write_text("k,v\n1,a\n2,b,more\n3\n4,d\n")
    kept = delimited.read_delimited(spark, path, skip_malformed=True)
    assert kept.count() == 2 and [r.k for r in kept.select("k").collect()] == ["1", "4"] and [r.v for r in kept.select("v").collect()] == ["a", "d"]
    flagged = delimited.read_delimited(spark, path, corrupt="bad")
    assert [r.bad for r in flagged.select("k", "bad").collect()] == [None, "2,b,more", "3", None]
    assert sorted(r.value for r in spark.read.text(delimited.write_rejects(flagged, path, "bad")).collect()) == ["2,b,more", "3"]


def test_delimited_beyond_the_first_probe(spark, tmp_path):
    names = [f"column_{i:04d}" for i in range(400)]
    (tmp_path / "wide.csv").write_text(";".join(names) + "\n" + ";".join(str(i) for i in range(400)) + "\n")
    p = delimited.preview(spark, str(tmp_path / "wide.csv"))
    assert p.header == names and p.delimiter == ";" and len(p.quoted) == 400
    df = delimited.read_delimited(spark, str(tmp_path / "wide.csv"), corrupt="bad")
    assert df.columns == [*names, "bad"] and list(df.first())[:-1] == [str(i) for i in range(400)] and df.first().bad is None
    (tmp_path / "quoted.csv").write_text('k,"' + "x\n" * 3000 + 'y",z\n1,2,3\n')
    assert [len(c) for c in delimited.preview(spark, str(tmp_path / "quoted.csv")).header] == [1, 6001, 1]
    plain = "".join(f"{i},plain\n" for i in range(2000)).encode()
    for name, tail, value, encoding in (("late[1].csv", b"9,caf\xe9 \x80\n", "caf\xe9 \u20ac", "windows-1252"), ("latin.csv", b"9,caf\xe9 \x81\n", "caf\xe9 \x81", "ISO-8859-1"), ("utf8.csv", "9,caf\xe9\n".encode(), "caf\xe9", "UTF-8"), ("cut.csv", b"9,caf\xc3", "caf\xc3", "windows-1252")):
        (tmp_path / name).write_bytes(b"k,v\n" + plain + tail)
        assert delimited.preview(spark, str(tmp_path / name)).encoding == encoding
        if "[" not in name:
            got = delimited.read_delimited(spark, str(tmp_path / name))
            assert got.count() == 2001 and got.where("v <> 'plain'").first().v == value
    used, _ = delimited.scan_directory(spark, str(tmp_path))
    assert {u.path.rsplit("/", 1)[1]: u.encoding for u in used}["late[1].csv"] == "windows-1252"
    assert max(len(u.header) for u in used) == 400
    huge = [f"name_{i:09d}" for i in range(25000)]
    (tmp_path / "huge.csv").write_text("|".join(huge) + "\n" + "|".join("1" * 25000) + "\n")
    assert len(delimited.head_bytes(spark, str(tmp_path / "huge.csv"), 1 << 20)) > 131072
    assert delimited.sniff_delimiter("|".join(huge)) == "|" and delimited.first_record("|".join(huge) + "\na\n", "|") == (huge, True)


def out_file(folder):
    import glob

    return sorted(glob.glob(folder + "/part-*"), key=lambda p: -len(open(p).read()))[0]


def test_directory(spark, tmp_path):
    for name, body in {"file10.csv": "a,b\n1,2\n", "file2.csv": "a,b\n3,4\n", "e.csv": "", ".hidden.csv": "a\n", "x.dat": "q"}.items():
        (tmp_path / name).write_text(body)
    used, skipped = delimited.scan_directory(spark, str(tmp_path))
    assert [u.path.rsplit("/", 1)[1] for u in used] == ["file2.csv", "file10.csv"]
    assert dict(skipped)["e.csv"] == "empty" and dict(skipped)["x.dat"] == "extension" and dict(skipped)[".hidden.csv"] == "hidden"
    assert delimited.extension_patterns("csv; .txt | *.d?t") == ["*.csv", "*.txt", "*.d?t"]
    assert delimited.output_name("/d/main.csv", "matched") == "/d/main_MATCHED.csv"


def test_job(spark):
    df = frame(spark, ["k", "v"], [("1", "a"), ("2", "b"), ("2", "c")])
    spec = JobSpec([{"op": "merge_by_key", "table": "t", "on": [["k", "k"]]}, {"op": "dedupe", "fields": ["k"], "order_by": ["v"]}, {"op": "replace", "rules": [{"field": "v", "old": "b", "new": "B"}, {"field": "no", "old": "x", "new": "y"}]}])
    out, warn = JobSpec.from_json(spec.to_json()).apply(df, {"t": frame(spark, ["k"], [("2",)])})
    assert values(out) == [("2", "B")] and warn
    with pytest.raises(ValueError):
        JobSpec([{"op": "none"}]).apply(df)
    assert "rows read" in control_report("T", {"main": "x"}, {"rows read": 3}, ["k"], ["w"])
    assert balanced({"a": 3, "b": 1, "c": 2}, "a", ["b", "c"])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n1,a\n2,b\n")
    stream = files.read_stream(spark, str(tmp_path / "in"), ["k", "v"])
    key = frame(spark, ["k"], [("2",)])
    q = files.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"), lambda df: keyjoin.keep_matching(columns.add_constant(df, {"c": "x"}), key, [("k", "k")]))
    q.awaitTermination(120)
    assert values(spark.read.parquet(str(tmp_path / "out"))) == [("2", "b", "x")]


def test_numbered_is_dense(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 7919) % 1000)
    got = ordering.numbered(df, [F.col("v")])
    assert got.where("v + 1 <> pos").count() == 0 and got.count() == 1000
    assert ordering.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_fifo_lookup_of_a_hot_key(spark):
    """A key with a third of all rows, and null keys, are numbered in parts: no window sees a key whole."""
    main = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', if(id % 50 = 1, null, cast(id % 700 as string))) as k", "id as n").repartition(5)
    table = spark.range(5000).selectExpr("if(id % 2 = 0, 'Hot', cast(id % 900 as string)) as k", "10000 - id as v")
    out = keyjoin.lookup(main, table, [("k", "k")], ["v"], ["v"], "fifo", main_order=["n"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    queues = {}
    for r in sorted(table.collect(), key=lambda r: r.v):
        queues.setdefault(r.k.lower(), []).append(r.v)
    want = [(r.k, r.n, queues[r.k].pop(0) if queues.get(r.k) else None) for r in sorted(main.collect(), key=lambda r: r.n)]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    within = ordering.numbered_within(main, ["k"], [main["n"]])
    assert within.where("k is null").agg({"pos": "max"}).first()[0] == main.where("k is null").count()
