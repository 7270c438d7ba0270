"""Registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions.rules import DateRule, Flags, NumericRule, RuleSet, TextRule
from .functions.text import clean_cell, collapse_spaces, currency, is_digits, left_fill, strip_quotes
from .operators import columns as C
from .operators import compare, concat, filtering, keyjoin, normalize, ordering, profile
from .operators.checkpoints import new_path
from .operators.profile import FieldProfile, Profile
from .sources import delimited, records
from .streaming import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Queries that SQL cannot say; tests compare them with Python.
_NO_SQL: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def queries_without_sql() -> dict[str, Query]:
    return dict(_NO_SQL)


def without_sql(f: Query) -> Query:
    _NO_SQL[f.__name__] = f
    return f


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""select o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderpriority from orders o
where starts_with(lower(trim(o.o_orderpriority)), '1') and o.o_totalprice > 100000
and exists (select 1 from customer c where lower(trim(c.c_mktsegment)) = 'building' and c.c_custkey = o.o_custkey)""")
def flagship(spark, d):
    """Filter, key match, sort, choose."""
    chosen = filtering.filter_select(table(spark, d, "orders"), RuleSet((TextRule("o_orderpriority", "starts_with", ("1",)), NumericRule("o_totalprice", "greater_than", 100000))))
    key = filtering.filter_select(table(spark, d, "customer"), RuleSet((TextRule("c_mktsegment", "equals", ("building",)),)))
    kept = keyjoin.keep_matching(chosen, key, [("o_custkey", "c_custkey")])
    out, _ = C.choose_columns(ordering.sort_records(kept, ["o_totalprice"], ordinal=["o_orderkey"]), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"])
    return out


# filters


@query("select c_custkey, c_name, c_mktsegment from customer where lower(trim(c_mktsegment)) in ('building', 'machinery')")
def filter_equals_ci(spark, d):
    return filtering.filter_select(table(spark, d, "customer"), RuleSet((TextRule("c_mktsegment", "equals", ("building", " Machinery ")),))).select("c_custkey", "c_name", "c_mktsegment")


@query("select p_partkey, p_name, p_type from part where contains(lower(p_type), 'econ') or contains(lower(p_type), 'small')")
def filter_contains(spark, d):
    return filtering.filter_select(table(spark, d, "part"), RuleSet((TextRule("p_type", "contains", ("econ", "SMALL")),))).select("p_partkey", "p_name", "p_type")


@query("select o_orderkey, o_orderpriority from orders where starts_with(o_orderpriority, '1') or starts_with(o_orderpriority, '5')")
def filter_starts_with(spark, d):
    return filtering.filter_select(table(spark, d, "orders"), RuleSet((TextRule("o_orderpriority", "starts_with", ("1", "5")),), Flags(case_sensitive=True))).select("o_orderkey", "o_orderpriority")


def _numeric(name, operator, value, condition, upper=None):
    def f(spark, d):
        rule = NumericRule("l_quantity", operator, value, upper)
        return filtering.filter_select(table(spark, d, "lineitem"), RuleSet((rule,))).select("l_orderkey", "l_linenumber", "l_quantity")

    query(f"select l_orderkey, l_linenumber, l_quantity from lineitem where {condition}", name)(f)


_numeric("filter_num_eq", "equals", 17, "l_quantity = 17")
_numeric("filter_num_gt", "greater_than", 45, "l_quantity > 45")
_numeric("filter_num_ge", "greater_than_or_equal", 45, "l_quantity >= 45")
_numeric("filter_num_lt", "less_than", 5, "l_quantity < 5")
_numeric("filter_num_le", "less_than_or_equal", 5, "l_quantity <= 5")
_numeric("filter_num_between", "between", 10, "l_quantity between 10 and 12", 12)


def _dated(name, operator, value, condition, upper=None):
    def f(spark, d):
        rule = DateRule("o_orderdate", operator, value, upper)
        return filtering.filter_select(table(spark, d, "orders"), RuleSet((rule,))).select("o_orderkey", "o_orderdate")

    query(f"select o_orderkey, o_orderdate from orders where {condition}", name)(f)


_dated("filter_date_exact", "exact", "1996-01-02", "cast(o_orderdate as date) = date '1996-01-02'")
_dated("filter_date_before", "before", "1995-06-30", "o_orderdate <= timestamp '1995-06-30'")
_dated("filter_date_after", "after", "1997-06-30", "o_orderdate >= timestamp '1997-06-30'")
_dated("filter_date_range", "range", "1995-01-01", "o_orderdate between timestamp '1995-01-01' and timestamp '1995-03-31'", "1995-03-31")


@query("select event_id, ts, event_type from events where cast(ts as date) = (select cast(min(ts) as date) from events)")
def filter_date_of_text(spark, d):
    """A date rule on a text column in another format."""
    e = table(spark, d, "events")
    day = e.agg(F.date_format(F.min("ts"), "MM/dd/yyyy")).first()[0]
    text = e.withColumn("day", F.date_format("ts", "MM/dd/yyyy"))
    return filtering.filter_select(text, RuleSet((DateRule("day", "exact", day, format="%m/%d/%Y"),))).select("event_id", "ts", "event_type")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where not (lower(o_orderstatus) = 'f' and o_totalprice > 50000)")
def filter_omit_conjunction(spark, d):
    rules = RuleSet((TextRule("o_orderstatus", "equals", ("F",)), NumericRule("o_totalprice", "greater_than", 50000)))
    return filtering.filter_omit(table(spark, d, "orders"), rules).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select event_id, props from events where coalesce(try_cast(regexp_extract(props, '[0-9]+') as double) > 50, false) and event_id % 3 = 0 or false")
def filter_number_in_text(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(F.col("event_id") % 3 == 0, F.regexp_extract("props", "[0-9]+", 0)).otherwise(F.col("props")))
    return filtering.filter_select(e, RuleSet((NumericRule("k", "greater_than", 50),))).select("event_id", "props")


@query("select p_partkey, p_name from part")
def omit_unparsable_kept(spark, d):
    """Names are no numbers, so the rule is false and nothing is omitted."""
    return filtering.filter_omit(table(spark, d, "part"), RuleSet((NumericRule("p_name", "less_than", 5),))).select("p_partkey", "p_name")


@query("select (o_orderstatus = 'O' and o_totalprice >= 200000) as matched, count(*) as n from orders group by 1")
def split_by_rules_counts(spark, d):
    rules = RuleSet((TextRule("o_orderstatus", "equals", ("o",)), NumericRule("o_totalprice", "greater_than_or_equal", 200000)))
    return filtering.flag_by_rules(table(spark, d, "orders"), rules).groupBy("matched").agg(F.count("*").alias("n"))


@query("select count(*) as rows_read, count(*) filter (where lower(o_orderstatus) = 'p') as rows_kept from orders")
def filter_counts(spark, d):
    return filtering.keep_counts(table(spark, d, "orders"), RuleSet((TextRule("o_orderstatus", "equals", ("P",)),)))


# columns


@query("select c_name, c_custkey, c_mktsegment from customer")
def choose_columns_by_name(spark, d):
    return C.choose_columns(table(spark, d, "customer"), ["C_NAME", "c_custkey", "none such", "c_mktsegment"])[0]


@query('select c_acctbal, c_custkey, c_custkey as "c_custkey (stub)" from customer')
def choose_columns_by_index(spark, d):
    return C.choose_columns(table(spark, d, "customer"), [3, 0, 0, 99])[0]


@query("select n_nationkey, n_name, 'x' as origin, 'y' as \"n_name (stub)\" from nation")
def add_constant(spark, d):
    return C.add_constant(table(spark, d, "nation").select("n_nationkey", "n_name"), {"origin": "x", "n_name": "y"})


@query("select p_partkey, p_type, case when contains(lower(p_type), 'promo') then 'metal' else '' end as kind from part")
def add_conditional_text(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return C.add_conditional(p, {"kind": "metal"}, C.text_condition(p, "p_type", "PROMO"))


@query("select o_orderkey, o_totalprice, case when o_totalprice >= 150000 then 'large' else '' end as size from orders")
def add_conditional_numeric(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return C.add_conditional(o, {"size": "large"}, C.numeric_condition(o, "o_totalprice", ">=", 150000))


@query("select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m from orders")
def add_date_parts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return C.add_date_part(C.add_date_part(o, "y", "o_orderdate", "year"), "m", "o_orderdate", "month").drop("o_orderdate")


@query("select p_partkey, case when p_size between 1 and 10 then 'small' when p_size between 10 and 30 then 'middle' else 'large' end as class from part")
def add_range_label(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return C.add_range_label(p, "class", "p_size", [(1, 10, "small"), (10, 30, "middle")], "large").drop("p_size")


@query("select c_custkey, case when lower(trim(c_mktsegment)) = 'building' then 'HOUSES' else c_mktsegment end as c_mktsegment from customer")
def replace_exact_ci(spark, d):
    return C.replace_values(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), [C.Replacement("c_mktsegment", "building", "HOUSES")])[0]


@query("select p_partkey, replace(p_type, 'ECON', 'IRON') as p_type from part")
def replace_substring_cs(spark, d):
    return C.replace_values(table(spark, d, "part").select("p_partkey", "p_type"), [C.Replacement("p_type", "ECON", "IRON", False, True)])[0]


@query("select p_partkey, replace(p_type, 'ECON', '$1\\1') as p_type from part")
def replace_substring_ci(spark, d):
    """The new text is literal."""
    return C.replace_values(table(spark, d, "part").select("p_partkey", "p_type"), [C.Replacement("p_type", "econ", "$1\\1", False)])[0]


@query("select n_nationkey, case when lower(replace(n_name, 'A', 'E')) = 'netion_3' then 'C' else replace(n_name, 'A', 'E') end as n_name from nation")
def replace_chain(spark, d):
    rules = [C.Replacement("n_name", "A", "E", False, True), C.Replacement("n_name", "NETION_3", "C")]
    return C.replace_values(table(spark, d, "nation").select("n_nationkey", "n_name"), rules)[0]


@query("select count(*) filter (where contains(p_type, 'LARGE')) as rows_changed, count(*) as rows_read from part")
def replace_counts(spark, d):
    return C.changed_rows(table(spark, d, "part"), [C.Replacement("p_type", "LARGE", "BIG", False, True)])


@query("select doc_id, md5(regexp_replace(translate(text, chr(65279) || chr(160) || chr(8203) || chr(8204) || chr(8205), ''), '^[\\s\\x{0085}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s]+$', '', 'g')) as cleaned from documents")
def clean_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(clean_cell("text", normal_form=False)).alias("cleaned"))


@without_sql
def clean_cells_normal_form(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(clean_cell("text")).alias("cleaned"))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as squeezed from documents")
def collapse_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(collapse_spaces("text")).alias("squeezed"))


@query("select event_id, event_type as bare from events")
def strip_quotes_cells(spark, d):
    quoted = F.concat(F.lit("\"'"), F.col("event_type"), F.lit("'\""))
    return table(spark, d, "events").select("event_id", strip_quotes(quoted).alias("bare"))


# keys

_KEY = "lower(trim(cast({} as varchar)))"


@query(f"select o_orderkey, o_custkey from orders where exists (select 1 from customer c where c.c_mktsegment = 'BUILDING' and {_KEY.format('c.c_custkey')} = {_KEY.format('o_custkey')})")
def key_semi(spark, d):
    key = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return keyjoin.merge_by_key(table(spark, d, "orders"), key, [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey")


@query(f"select o_orderkey, o_custkey from orders where not exists (select 1 from customer c where c.c_mktsegment = 'BUILDING' and {_KEY.format('c.c_custkey')} = {_KEY.format('o_custkey')})")
def key_anti(spark, d):
    key = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return keyjoin.merge_by_key(table(spark, d, "orders"), key, [("o_custkey", "c_custkey")], "anti").select("o_orderkey", "o_custkey")


@query("select count(*) as rows_read, count(*) filter (where o_custkey in (select c_custkey from customer where c_acctbal > 5000)) as rows_matched, count(*) filter (where o_custkey not in (select c_custkey from customer where c_acctbal > 5000)) as rows_nonmatched from orders")
def key_split_counts(spark, d):
    key = table(spark, d, "customer").where("c_acctbal > 5000")
    return keyjoin.match_counts(keyjoin.flag_by_key(table(spark, d, "orders"), key, [("o_custkey", "c_custkey")]))


@query("select o_orderkey, coalesce(o_custkey in (select c_custkey from customer where c_acctbal > 5000), false) as matched from orders")
def key_split_flags(spark, d):
    key = table(spark, d, "customer").where("c_acctbal > 5000")
    return keyjoin.flag_by_key(table(spark, d, "orders"), key, [("o_custkey", "c_custkey")]).select("o_orderkey", "matched")


@query("select l_orderkey, l_partkey, l_linenumber from lineitem l where exists (select 1 from lineitem k where k.l_quantity = 1 and k.l_partkey = l.l_partkey and k.l_returnflag = l.l_returnflag)")
def key_semi_composite(spark, d):
    li = table(spark, d, "lineitem")
    return keyjoin.keep_matching(li, li.where("l_quantity = 1"), [("l_partkey", "l_partkey"), ("l_returnflag", "l_returnflag")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def key_zero_pad_match(spark, d):
    """Keys 7 and 007 are one when digits are padded to the width of the key side."""
    key = table(spark, d, "nation").where("n_regionkey = 1").select(left_fill(F.col("n_nationkey").cast("string"), 6).alias("nation"))
    return keyjoin.keep_matching(table(spark, d, "customer"), key, [("c_nationkey", "nation")], keyjoin.KeyStyle(zero_pad=True)).select("c_custkey")


@query("select count(*) as distinct_keys from (select distinct p_brand, p_size from part)")
def key_distinct(spark, d):
    return keyjoin.distinct_keys(table(spark, d, "part"), ["p_brand", "p_size"])


@query("select max(length(cast(c_custkey as varchar))) as width_1, max(length(cast(c_nationkey as varchar))) as width_2 from customer")
def key_widths(spark, d):
    cells = [keyjoin.key_cell(c, keyjoin.KeyStyle()) for c in ("c_custkey", "c_nationkey")]
    return table(spark, d, "customer").agg(*(F.max(F.when(is_digits(c), F.length(c))).cast("long").alias(f"width_{i}") for i, c in enumerate(cells, 1)))


@query("select n.n_nationkey, n.n_name, k.c_name, k.c_custkey from nation n join (select c_nationkey, c_name, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) k on k.rn = 1 and k.c_nationkey = n.n_nationkey")
def lookup_first(spark, d):
    return keyjoin.lookup(table(spark, d, "nation").select("n_nationkey", "n_name"), table(spark, d, "customer"), [("n_nationkey", "c_nationkey")], ["c_name", "c_custkey"], ["c_custkey"])


@query("select n.n_nationkey, s.s_name, s.s_suppkey is not null as matched from nation n left join supplier s on s.s_nationkey = n.n_nationkey")
def lookup_all(spark, d):
    return keyjoin.lookup(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "supplier"), [("n_nationkey", "s_nationkey")], ["s_name"], ["s_suppkey"], "all")


@query("""with a as (select *, row_number() over (partition by user_id order by event_id) as rn from events where event_type = 'click'),
b as (select *, row_number() over (partition by user_id order by event_id) as rn from events where event_type = 'view')
select a.event_id, a.user_id, b.event_id as view_id from a left join b on a.user_id = b.user_id and a.rn = b.rn""")
def lookup_fifo(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"))
    return keyjoin.lookup(e.where("event_type = 'click'").drop("event_type"), views, [("user_id", "user_id")], ["view_id"], ["view_id"], "fifo", main_order=["event_id"])


# order and repeats


@query("select p_partkey, p_brand, p_type from (select *, row_number() over (partition by lower(trim(p_brand)) order by p_partkey) as rn from part) where rn = 1")
def dedupe_first(spark, d):
    return ordering.dedupe_first(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand"], ["p_partkey"])


@query("select p_partkey, lower(p_brand) as p_brand, lower(p_type) as p_type from (select *, row_number() over (partition by lower(p_brand), lower(p_type) order by p_partkey) as rn from part) where rn = 1")
def dedupe_first_composite(spark, d):
    return ordering.dedupe_first(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], ["p_partkey"], rewrite_keys=True)


@query("select doc_id, source from documents where lower(trim(text)) in (select lower(trim(text)) from documents group by 1 having count(*) > 1)")
def duplicates_only(spark, d):
    return ordering.duplicates_only(table(spark, d, "documents"), ["text"]).select("doc_id", "source")


@query("select count(*) as rows_before, count(distinct lower(trim(text))) as rows_after, count(*) - count(distinct lower(trim(text))) as rows_removed from documents")
def dedupe_counts(spark, d):
    return ordering.dedupe_counts(table(spark, d, "documents"), ["text"])


@query("select p_partkey, row_number() over (order by p_size, p_partkey) as pos from part")
def sort_numeric_aware(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    return ordering.numbered(p, [*ordering.sort_keys(["size"]), F.col("p_partkey")]).select("p_partkey", "pos")


_BIG = "case when o_orderkey % 3 = 0 then -1 else 1 end * (9007199254740992::hugeint + o_orderkey * case when o_orderkey % 2 = 0 then 1 else 100000000000000000000::hugeint end)"


@query(f"select o_orderkey, row_number() over (order by {_BIG}, o_orderkey) as pos from orders")
def sort_big_numbers(spark, d):
    """Numbers in text of 16 to 28 digits, which a double cannot tell apart."""
    k = F.col("o_orderkey")
    n = F.lit("9007199254740992").cast("decimal(38,0)") + k.cast("decimal(12,0)") * F.when(k % 2 == 0, F.lit(1).cast("decimal(21,0)")).otherwise(F.lit("1" + "0" * 20).cast("decimal(21,0)"))
    text = F.concat(F.when(k % 3 == 0, "-").otherwise(""), n.cast("string"))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("number"))
    return ordering.numbered(o, [*ordering.sort_keys(["number"]), F.col("o_orderkey")]).select("o_orderkey", "pos")


@query("select p_partkey, row_number() over (order by cast(p_size as varchar), p_partkey) as pos from part")
def sort_lexicographic(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    return ordering.numbered(p, [F.col("size"), F.col("p_partkey")]).select("p_partkey", "pos")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25")
def sort_top(spark, d):
    return ordering.top_records(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 25, ordinal=["o_orderkey"])


# files as tables


@query("select c_custkey, c_name, 'a' as origin from customer where c_nationkey < 5 union all select c_custkey, c_name, 'b' from customer where c_nationkey >= 20")
def concat_union_all(spark, d):
    c = table(spark, d, "customer")
    parts = [("a", c.where("c_nationkey < 5").select("c_custkey", "c_name")), ("b", c.where("c_nationkey >= 20").select("c_custkey", "c_name")), ("other", c.select("c_name", "c_custkey"))]
    return concat.concat_frames(parts, source="origin").df


@query("select c_custkey, c_name, 'a' as origin from customer where c_nationkey < 5 union all select c_custkey, c_name, 'b' from customer where c_nationkey >= 5 or c_nationkey is null")
def concat_union_whole(spark, d):
    """Parts that together hold every row."""
    c = table(spark, d, "customer")
    parts = [("a", c.where("c_nationkey < 5").select("c_custkey", "c_name")), ("b", c.where("c_nationkey >= 5 or c_nationkey is null").select("c_custkey", "c_name")), ("other", c.select("c_name", "c_custkey"))]
    return concat.concat_frames(parts, source="origin").df


@query("""select reason, count(*) as n from (select case when n_nationkey % 4 = 0 then 'blank row' when n_nationkey % 4 = 1 then 'number alone' when n_nationkey % 4 = 2 then 'too few cells' else 'kept' end as reason from nation) group by 1""")
def concat_row_hygiene(spark, d):
    return _reasons(concat.with_reason(_ragged(spark, d), normal_form=False))


@without_sql
def concat_row_hygiene_normal_form(spark, d):
    return _reasons(concat.with_reason(_ragged(spark, d)))


def _ragged(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 4
    return n.select(F.when(k == 3, F.col("n_name")).otherwise("  ").alias("a"), F.when(k == 1, "2024").when(k == 2, "some").otherwise("").alias("b"), F.when(k == 3, "x").alias("c"))


def _reasons(rows):
    return rows.select(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("select event_type as source, count(*) as rows_appended from events group by 1")
def file_counts(spark, d):
    return concat.source_counts(table(spark, d, "events"), "event_type")


def _two(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    other = o.where("o_orderkey > 10").withColumn("o_orderstatus", F.when(F.col("o_custkey") % 7 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return compare.paired(o, other, [F.col("o_orderkey")], [F.col("o_orderkey")], omit=["o_orderkey"])


_PAIRS = """with a as (select o_custkey, o_orderstatus, row_number() over (order by o_orderkey) as pos from orders),
b as (select o_custkey, case when o_custkey % 7 = 0 then 'Z' else o_orderstatus end as o_orderstatus, row_number() over (order by o_orderkey) as pos from orders where o_orderkey > 10) """


@query(_PAIRS + "select a.pos, (a.o_custkey <> b.o_custkey or a.o_orderstatus <> b.o_orderstatus) as differs from a join b on a.pos = b.pos")
def compare_positional(spark, d):
    return _two(spark, d).where("in_1 and in_2").select("pos", "differs")


@query(_PAIRS + "select count(*) filter (where a.pos = b.pos and a.o_custkey = b.o_custkey and a.o_orderstatus = b.o_orderstatus) as matched, count(*) filter (where a.pos = b.pos and (a.o_custkey <> b.o_custkey or a.o_orderstatus <> b.o_orderstatus)) as differed, count(*) filter (where b.pos is null) as only_in_1, count(*) filter (where a.pos is null) as only_in_2 from a full join b on a.pos = b.pos")
def compare_counts(spark, d):
    return compare.compare_counts(_two(spark, d))


# profiles


@query("select 'c_name' as field, max(length(c_name)) as max_length from customer union all select 'c_mktsegment', max(length(c_mktsegment)) from customer union all select 'c_custkey', max(length(cast(c_custkey as varchar))) from customer")
def profile_lengths(spark, d):
    return profile.lengths(table(spark, d, "customer"), ["c_name", "c_mktsegment", "c_custkey"]).select("field", F.col("max_length").cast("long").alias("max_length"))


@query("select 'p_partkey' as field, 'int' as kind union all select 'p_name', 'str' union all select 'price', 'float'")
def profile_types(spark, d):
    p = table(spark, d, "part").withColumn("price", F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    return profile.types(p, ["p_partkey", "p_name", "price"])


@query("select case when s < 0 then 'leading' else 'none' end as sign, count(*) as n from (select cast(s_acctbal as decimal(18,2)) as s from supplier) group by 1")
def profile_sign_style(spark, d):
    from .functions.text import sign_style

    s = table(spark, d, "supplier").select(sign_style(F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("sign"))
    return s.groupBy("sign").agg(F.count("*").alias("n"))


@query("select p_partkey, rpad(p_brand, 12, ' ') as p_brand, lpad(cast(p_size as varchar), 5, ' ') as p_size from part")
def normalize_pad(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return normalize.normalize(p, Profile([FieldProfile("p_brand", "str", 12), FieldProfile("p_size", "int", 5, flag="strict")]))


@query("select p_partkey, lpad(cast(p_size as varchar), 6, '0') as p_size from part")
def normalize_int_zero(spark, d):
    return normalize.normalize(table(spark, d, "part").select("p_partkey", "p_size"), Profile([FieldProfile("p_size", "int", 6, flag="strict")]), "record")


@query("select s_suppkey, cast(round(cast(s_acctbal as decimal(18,2)) * 100) as bigint) as cents from supplier")
def normalize_currency(spark, d):
    v = F.col("s_acctbal").cast("decimal(18,2)")
    text = F.when(v < 0, F.concat(F.lit("($"), F.format_number(-v, 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(v, 2)))
    return table(spark, d, "supplier").select("s_suppkey", F.round(currency(text) * 100).cast("long").alias("cents"))


@query("select s_suppkey, rpad(s_name, (select max(length(s_name))::integer from supplier), ' ') as s_name from supplier")
def normalize_batch(spark, d):
    """All cells are text, as wide as the longest of their column."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    width = profile.lengths(s, ["s_name"]).first()["max_length"]
    return normalize.normalize(s, Profile([FieldProfile("s_name", "str", width)]), "batch")


@query("select count(*) as p_name, 0 as p_size from part")
def normalize_warnings(spark, d):
    """Names are no numbers, sizes are."""
    return normalize.warnings(table(spark, d, "part"), Profile([FieldProfile("p_name", "float", 8), FieldProfile("p_size", "int", 4)]))


@query("select 'amount' as field, max(length(cast(abs(cast(s_acctbal as decimal(18,2))) as varchar))) as max_length from supplier")
def profile_amounts(spark, d):
    v = F.col("s_acctbal").cast("decimal(18,2)")
    amount = F.when(v < 0, F.concat(F.lit("($"), F.format_number(-v, 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(v, 2)))
    return profile.amount_lengths(table(spark, d, "supplier").select(amount.alias("amount")), ["amount"]).select("field", F.col("max_length").cast("long").alias("max_length"))


@query("select upper(c_name) as c_name, upper(c_mktsegment) as c_mktsegment from customer")
def normalize_rows_upper(spark, d):
    padded = [F.concat(F.lit(" "), F.col(c), F.lit("  ")).alias(c) for c in ("c_name", "c_mktsegment")]
    return ordering.normalize_rows(table(spark, d, "customer").select(*padded), upper=True)


@query("select status, count(*) as n from (select unnest([case when length(n_name) >= 9 then 'same' else 'changed' end, case when n_regionkey >= 10 then 'same' else 'changed' end]) as status from nation) group by 1")
def normalize_change_log(spark, d):
    p = Profile([FieldProfile("n_name", "str", 9), FieldProfile("n_regionkey", "int", 2, flag="strict")])
    return normalize.change_log(table(spark, d, "nation"), p, "n_nationkey").groupBy("status").agg(F.count("*").alias("n"))


@query("select s_suppkey, lpad(format('{:,.1f}', s_acctbal), 12, ' ') as s_acctbal from (select s_suppkey, round(cast(s_acctbal as decimal(18,2)), 1) as s_acctbal from supplier)")
def normalize_float(spark, d):
    """A strict float field has its precision, thousands and width."""
    s = table(spark, d, "supplier").select("s_suppkey", F.round(F.col("s_acctbal").cast("decimal(18,2)"), 1).cast("string").alias("s_acctbal"))
    return normalize.normalize(s, Profile([FieldProfile("s_acctbal", "float", 12, 1, flag="strict")]))


@query("select p_partkey, case when p_size % 3 = 0 then '' else lpad(cast(p_size as varchar), 4, ' ') end as model_year from part")
def normalize_nullable_int(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")).otherwise("").alias("model_year"))
    kind, flag = profile.hint("model_year")
    return normalize.normalize(p, Profile([FieldProfile("model_year", kind, 4, flag=flag)]))


@query("select s_suppkey, case when s_suppkey % 4 = 0 then '[ERROR: none]' else lpad(cast(cast(s_acctbal as decimal(18,2)) as varchar), 14, '0') end as amount from supplier where s_acctbal >= 0")
def normalize_record_float(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal >= 0")
    s = s.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "none").otherwise(F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("amount"))
    return normalize.normalize(s, Profile([FieldProfile("amount", "float", 14, 2, flag="strict")]), "record")


@query("select * from (values ('state_total', 'float', 'pad_only'), ('yearly_amount', 'float', 'pad_only'), ('model_year', 'int', 'nullable_int'), ('zip_year', 'str', 'pad_only'), ('abbr', 'str', 'pad_only'), ('n_nationkey', 'int', 'strict')) t(field, kind, flag)")
def profile_hints(spark, d):
    n = F.col("n_nationkey").cast("string")
    names = ["state_total", "yearly_amount", "model_year", "zip_year", "abbr", "n_nationkey"]
    got = profile.build_profile(table(spark, d, "nation").select(*(n.alias(c) for c in names)))
    return spark.createDataFrame([(f.name, f.kind, f.flag) for f in got.fields], "field string, kind string, flag string")


@query("select 'p_retailprice' as field, 'float' as kind, max(length(p)) as length, max(length(rtrim(split_part(p, '.', 2), '0'))) as \"precision\" from (select cast(cast(p_retailprice as decimal(18,2)) as varchar) as p from part) union all select 'p_type', 'str', max(length(p_type)), 0 from part")
def profile_built(spark, d):
    """A strict profile: type, length and precision of each field, in one aggregate."""
    p = table(spark, d, "part").select(F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("p_retailprice"), "p_type")
    got = profile.build_profile(p, strict=True)
    return spark.createDataFrame([(f.name, f.kind, f.length, f.precision) for f in got.fields], "field string, kind string, length long, precision long")


@query(_SQL["profile_built"])
def profile_merged(spark, d):
    """The same profile from the stored states of two parts of the table."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("p_retailprice"), "p_type")
    path = new_path(spark)
    for k in range(2):
        profile.profile_state(p.where(F.col("p_partkey") % 2 == k).drop("p_partkey")).write.parquet(f"{path}/{k}")
    got = profile.profile_of(profile.merge_states(*(spark.read.parquet(f"{path}/{k}") for k in range(2))), strict=True)
    return spark.createDataFrame([(f.name, f.kind, f.length, f.precision) for f in got.fields], "field string, kind string, length long, precision long")


# streams


@query(_SQL["lookup_fifo"])
def stream_lookup_fifo(spark, d):
    """A lookup that uses rows up, on a stream that arrives in two parts, the second after a restart: equal to the batch result."""
    e, path = table(spark, d, "events").select("event_id", "user_id", "event_type"), new_path(spark)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"))
    clicks = e.where("event_type = 'click'").drop("event_type")
    middle = clicks.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("m")).first().m
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        clicks.where(part).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(clicks.schema).parquet(f"{path}/in")
        files.lookup_fifo(stream, views, [("user_id", "user_id")], ["view_id"], ["view_id"], ["event_id"], f"{path}/out", f"{path}/check", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch")


@query("select c_custkey, c_nationkey in (select n_nationkey from nation where n_regionkey = 1) as matched from customer")
def stream_split(spark, d):
    """A stream parted by the keys of a table."""
    c, path = table(spark, d, "customer").select("c_custkey", "c_nationkey"), new_path(spark)
    key = table(spark, d, "nation").where("n_regionkey = 1")
    c.write.parquet(f"{path}/in")
    for side, name in ((keyjoin.keep_matching, "hit"), (keyjoin.keep_nonmatching, "miss")):
        stream = spark.readStream.schema(c.schema).parquet(f"{path}/in")
        files.run_available(stream, f"{path}/{name}", f"{path}/check-{name}", lambda df, side=side: side(df, key, [("c_nationkey", "n_nationkey")])).awaitTermination()
    both = [spark.read.schema(c.schema).parquet(f"{path}/{n}").select("c_custkey", F.lit(n == "hit").alias("matched")) for n in ("hit", "miss")]
    return both[0].unionAll(both[1])


# more of keys, order and columns


@query("select o_orderkey from orders where not (o_orderstatus = 'F')")
def delete_by_condition(spark, d):
    return filtering.delete_by_condition(table(spark, d, "orders"), RuleSet((TextRule("o_orderstatus", "equals", ("f",)),))).select("o_orderkey")


@query("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey")
def lookup_zero_pad_both(spark, d):
    """Main keys are padded wider than the lookup's."""
    main = table(spark, d, "orders").select("o_orderkey", left_fill(F.col("o_custkey").cast("string"), 9).alias("cust"))
    return keyjoin.lookup(main, table(spark, d, "customer"), [("cust", "c_custkey")], ["c_name"], ["c_custkey"], style=keyjoin.KeyStyle(zero_pad=True)).select("o_orderkey", "c_name")


@query("select count(*) filter (where n_nationkey % 3 <> 0 and n_regionkey = 1) as matched, count(*) filter (where n_nationkey % 3 <> 0 and n_regionkey <> 1) as nonmatched from nation")
def split_skips_blank(spark, d):
    """Rows of blank cells are on neither side, though a blank key would match a blank key."""
    n = table(spark, d, "nation")
    blank = F.col("n_nationkey") % 3 == 0
    main = n.select(F.when(blank, " ").otherwise(F.col("n_regionkey").cast("string")).alias("k"), F.when(~blank, F.col("n_name")).alias("name"))
    key = spark.range(1).select(F.lit("1").alias("k")).union(spark.range(1).select(F.lit("")))
    hit, miss = keyjoin.split_by_key(main, key, [("k", "k")])
    return hit.agg(F.count("*").alias("matched")).crossJoin(miss.agg(F.count("*").alias("nonmatched")))


@query("select c_custkey from customer where c_mktsegment = 'BUILDING'")
def key_profile_clean(spark, d):
    """Invisible characters and full-width letters in keys do not matter to the style ``key_clean``."""
    main = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("\ufeff"), F.translate("c_mktsegment", "BU", "\uff22\uff35"), F.lit("\u00a0")).alias("seg"))
    key = spark.range(1).select(F.lit(" building").alias("seg"))
    return keyjoin.keep_matching(main, key, [("seg", "seg")], keyjoin.PROFILES["key_clean"]).select("c_custkey")


@query("select count(*) as rows_read, count(*) filter (where s_nationkey is not null) as hits, count(*) filter (where s_nationkey is null) as misses from nation left join (select distinct s_nationkey from supplier where s_acctbal > 0) on n_nationkey = s_nationkey")
def lookup_hits(spark, d):
    return keyjoin.lookup_counts(table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 0"), [("n_nationkey", "s_nationkey")])


@query("select n.n_nationkey, k.c_name from nation n join (select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) as rn from customer) k on k.rn = 1 and k.c_nationkey = n.n_nationkey")
def lookup_in_key_order(spark, d):
    return keyjoin.lookup_sorted(table(spark, d, "nation").select("n_nationkey"), table(spark, d, "customer"), [("n_nationkey", "c_nationkey")], ["c_name"], ["c_custkey"], style=keyjoin.KeyStyle(zero_pad=True))


@query("select p_partkey, p_brand, p_size from part order by p_brand desc, p_size, p_partkey limit 40")
def sort_directions(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return ordering.sort_records(p, ["p_brand", "p_size", "p_partkey"], descending=[True, False, False]).limit(40)


@query("select doc_id from documents where lower(trim(text)) in (select lower(trim(text)) from documents group by 1 having count(*) > 1)")
def dedupe_mode_duplicates(spark, d):
    return ordering.dedupe(table(spark, d, "documents"), ["text"], "keep_duplicates_only").select("doc_id")


@query("select n_name, n_nationkey from nation")
def choose_columns_from_one(spark, d):
    return C.choose_columns(table(spark, d, "nation"), ["2", "1", "9"], from_one=True)[0]


@query("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'Y' else '' end as trade from customer")
def add_membership(spark, d):
    return C.add_membership(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "trade", "c_mktsegment", ["building", " Machinery "]).drop("c_mktsegment")


@query("select r_regionkey, r_name from region union all select 99, 'NOWHERE'")
def add_fixed_row(spark, d):
    return C.add_fixed_row(table(spark, d, "region"), {"R_REGIONKEY": "99", "r_name": "NOWHERE"})


@query("select n_nationkey, 'Stub' as \"APPENDED\" from nation")
def add_default_constant(spark, d):
    return C.add_constant(table(spark, d, "nation").select("n_nationkey"))


@query("select p_partkey, replace(p_type, 'ECON', 'iron') as p_type from part")
def replace_substring_mixed_case(spark, d):
    """Old text and cells differ in case."""
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return C.replace_values(p, [C.Replacement("p_type", "eCoN", "iron", False)])[0]


@query("select cast(n_regionkey as varchar) as source, count(*) filter (where n_nationkey % 3 = 0) as rows_appended, count(*) filter (where n_nationkey % 3 = 1) as rows_dropped from nation group by 1")
def concat_file_counts(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 3
    rows = n.select(F.col("n_regionkey").cast("string").alias("file"), F.when(k == 0, F.col("n_name")).otherwise("").alias("a"), F.when(k == 0, "x").when(k == 1, "2024").otherwise("").alias("b"))
    return concat.hygiene_counts(rows, "file", normal_form=False)


@query("select case when n_nationkey % 5 = 0 then 'year alone' when n_nationkey % 5 = 1 then 'wrong width' when n_nationkey % 5 = 2 then 'blank row' when n_nationkey % 5 = 3 then 'too few cells' else 'kept' end as reason, count(*) as n from nation group by 1")
def concat_wrong_width(spark, d):
    k = F.col("n_nationkey") % 5
    cell = lambda *of: F.when(k.isin(*of), F.col("n_name")).otherwise("")
    rows = table(spark, d, "nation").select(cell(1, 3, 4).alias("a"), cell(1, 4).alias("b"), cell(1, 4).alias("c"), F.when(k == 0, "2025").otherwise("").alias("d"), F.when(k == 1, 5).otherwise(4).alias("cells"))
    return _reasons(concat.with_reason(rows, normal_form=False, width="cells"))


@query("select cast(r_regionkey as varchar) as a, r_name as b from region union all select 'n_nationkey', 'n_name' union all select cast(n_nationkey as varchar), n_name from nation")
def concat_two_headers(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("a"), F.col("r_name").alias("b"))
    return concat.concat_two(r, table(spark, d, "nation").select("n_nationkey", "n_name"))[0]


# files


def _odd(spark, d):
    """Cells with delimiters, quotes, line breaks, blanks at the ends and none at all."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 5
    odd = F.when(k == 0, F.concat(F.col("c_name"), F.lit(', "x"'))).when(k == 1, F.concat(F.lit(" "), F.col("c_name"), F.lit("  "))).when(k == 2, F.concat(F.lit("a;|b\t"), F.col("c_name"))).when(k == 3, F.lit("")).otherwise(F.col("c_name"))
    return c.select(F.col("c_custkey").cast("string").alias("id"), odd.alias("note"), F.col("c_mktsegment").alias("segment"))


_ODD = """select cast(c_custkey as varchar) as id, case c_custkey % 5 when 0 then c_name || ', "x"' when 1 then ' ' || c_name || '  ' when 2 then 'a;|b' || chr(9) || c_name when 3 then '' else c_name end as note, c_mktsegment as segment from customer"""


@query(_ODD)
def csv_round_trip(spark, d):
    """Written as delimited text and read again, probed from the files."""
    path = new_path(spark)
    delimited.write_file(_odd(spark, d).repartition(4), f"{path}/x.csv")
    return delimited.read_delimited(spark, f"{path}/x.csv")


@query(_ODD)
def csv_quoted_columns(spark, d):
    """Chosen columns always quoted; every file has its header."""
    path = new_path(spark)
    delimited.write_delimited(_odd(spark, d).repartition(3), path, delimiter="|", quoted_columns=["segment"])
    return concat.concat_frames([(f, delimited.read_delimited(spark, f, "|")) for f in _files(spark, path)]).df


@query(_ODD.replace("from customer", "from customer union all select cast(c_custkey as varchar) || 'b', c_name || chr(10) || 'second line', c_mktsegment from customer"))
def csv_line_breaks(spark, d):
    """A file whose cells have line breaks is found to be one."""
    more = table(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("b")), F.concat("c_name", F.lit("\nsecond line")), "c_mktsegment")
    path = new_path(spark)
    delimited.write_file(_odd(spark, d).unionAll(more), f"{path}/x.csv")
    return delimited.read_delimited(spark, f"{path}/x.csv")


@query("select 'kept' as what, count(*) as n from nation where n_nationkey % 4 <> 0 union all select 'rejected', count(*) from nation where n_nationkey % 4 = 0")
def csv_rejects(spark, d):
    """Lines of a wrong width are written apart; a reading that skips them has the rest."""
    path = new_path(spark)
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.when(F.col("n_nationkey") % 4 == 0, "too much"))
    name = f"{path}/x.csv"
    delimited.write_lines(table(spark, d, "nation").repartition(3).select(line.alias("value")), name, "key,name")
    rejects = delimited.write_rejects(delimited.read_delimited(spark, name, corrupt="bad"), name, "bad")
    kept = delimited.read_delimited(spark, name, skip_malformed=True).select(F.lit("kept").alias("what"))
    return kept.unionAll(spark.read.text(rejects).select(F.lit("rejected"))).groupBy("what").agg(F.count("*").alias("n"))


@query("select c_custkey, 'first' || chr(10) || chr(10) || c_name || ', \"x\"' || chr(10) as note, 3 + c_custkey % 2 as n_cells, md5(c_custkey || ',\"first' || chr(10) || chr(10) || c_name || ', \"\"x\"\"' || chr(10) || '\",' || c_mktsegment || case when c_custkey % 2 = 1 then ',more' else '' end) as raw from customer")
def csv_records(spark, d):
    """Records with line breaks in cells, of files that many tasks read: place, number of cells and raw text of each."""
    path, c = new_path(spark), table(spark, d, "customer")
    note = F.concat(F.lit("first\n\n"), "c_name", F.lit(', "x"\n'))
    quoted = F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, "c_mktsegment", F.when(F.col("c_custkey") % 2 == 1, "more"))
    c.select(line.alias("value")).write.text(path)
    got = records.as_table(records.read_records(spark, path), ["key", "note"], False, width="n_cells", raw="raw")
    return got.select(F.col("key").cast("long").alias("c_custkey"), "note", "n_cells", F.md5("raw").alias("raw"))


@query("select case when s_suppkey % 4 = 0 then 'wrong width' when s_suppkey % 4 = 1 then 'blank row' when s_suppkey % 4 = 2 then 'too few cells' else 'kept' end as reason, count(*) as n, sum(s_suppkey) as keys from supplier where s_suppkey % 4 <> 1 group by 1 union all select 'blank row', count(*), 0 from supplier where s_suppkey % 4 = 1")
def csv_ragged(spark, d):
    """Rows of a wrong width found while a file is read; dropped ones are written with their reason."""
    path, k = new_path(spark), F.col("s_suppkey") % 4
    text = F.col("s_suppkey").cast("string")
    line = F.when(k == 0, F.concat_ws(",", text, "s_name", F.lit("a"), F.lit("b"))).when(k == 1, ",,").when(k == 2, F.concat(text, F.lit(",,"))).otherwise(F.concat_ws(",", text, "s_name", F.lit('"a\nb"')))
    table(spark, d, "supplier").select(line.alias("value")).write.text(f"{path}/in")
    rows = records.as_table(records.read_records(spark, f"{path}/in"), ["key", "name", "note"], False, width="cells")
    kept, dropped = concat.hygiene(rows, width="cells")
    delimited.write_dropped(dropped, f"{path}/out.csv")
    again = spark.read.option("header", True).csv(f"{path}/out_DROPPED_RECORDS.csv").select("key", F.col("drop_reason").alias("reason"))
    both = again.unionAll(kept.select("key", F.lit("kept").alias("reason")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.try_to_number("key", F.lit("999999999999")).cast("long"), F.lit(0))).alias("keys"))


@query("select 'id' as field, 'int' as kind, 1 as length union all select 'name', 'str', max(length(c_name)) from customer where c_custkey = (select max(c_custkey) from customer)")
def profile_first_row(spark, d):
    """The profile of a file's first row in its own order, which is not the least one: only that row is read."""
    path, c = new_path(spark), table(spark, d, "customer")
    first = F.col("c_custkey") == F.lit(c.agg(F.max("c_custkey")).first()[0])
    rows = c.select(F.when(first, "9").otherwise(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).alias("id"), F.when(first, F.col("c_name")).otherwise("a\nb").alias("name"), (~first).alias("late"))
    delimited.write_file(rows.orderBy("late").drop("late"), f"{path}/in.csv")
    got = profile.build_profile(delimited.head(spark, f"{path}/in.csv", 1))
    return spark.createDataFrame([(f.name, f.kind, f.length) for f in got.fields], "field string, kind string, length long")


@query("select n_nationkey % 3 as part, count(*) as n from nation group by 1")
def csv_folder(spark, d):
    """The files of a folder, in natural order, as one table; one of another header is left out."""
    path, n = new_path(spark), table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), "n_name")
    for k in range(3):
        delimited.write_file(n.where(F.col("key").cast("int") % 3 == k), f"{path}/file{k * 5}.csv")
    delimited.write_file(n.withColumnRenamed("key", "id"), f"{path}/file99.csv")
    used, _ = delimited.scan_directory(spark, path, "csv")
    out = delimited.read_files(spark, used, source="file").df
    place = F.regexp_extract("file", "([0-9]+)", 1).cast("int") / 5
    return out.groupBy(place.cast("int").alias("part")).agg(F.count("*").alias("n"))


@query("select n_nationkey, c.c_name from nation join (select c_nationkey, min_by(c_name, c_custkey) as c_name from customer group by 1) c on c.c_nationkey = n_nationkey")
def csv_lookup(spark, d):
    """A lookup table loaded from a file."""
    path = new_path(spark)
    firsts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("c_name"), F.count("*").alias("n"))
    delimited.write_file(firsts, f"{path}/lookup.csv")
    lookup = delimited.load_lookup(spark, f"{path}/lookup.csv", ["c_nationkey"], ["c_name"])
    return keyjoin.lookup(table(spark, d, "nation").select("n_nationkey"), lookup, [("n_nationkey", "c_nationkey")], ["c_name"], ["c_name"])


@query("select c_custkey, 'x' as \"APPENDED\", case when c_acctbal between 0 and 1000 then 'low' else 'other' end as class, case when c_mktsegment = 'BUILDING' then 'Y' else '' end as trade, case when c_acctbal > 5000 then 'rich' else '' end as kind from customer where c_mktsegment <> 'AUTOMOBILE'")
def job_steps(spark, d):
    """More steps of a declarative job."""
    from .plans.job import JobSpec

    over = [{"kind": "numeric", "field": "c_acctbal", "operator": "greater_than", "value": 5000}]
    steps = [{"op": "drop_blank"}, {"op": "trim"}, {"op": "delete_by_condition", "rules": [{"kind": "text", "field": "c_mktsegment", "operator": "equals", "values": "automobile"}]}, {"op": "add_constant", "values": {"APPENDED": "x"}}, {"op": "add_range_label", "name": "class", "field": "c_acctbal", "ranges": [[0, 1000, "low"]], "otherwise": "other"}, {"op": "add_membership", "name": "trade", "field": "c_mktsegment", "values": ["building"]}, {"op": "add_conditional", "values": {"kind": "rich"}, "rules": over}, {"op": "choose", "fields": ["c_custkey", "APPENDED", "class", "trade", "kind"]}]
    return JobSpec.from_json(JobSpec(steps).to_json()).apply(table(spark, d, "customer"))[0]


@query("""with a as (select * from orders where o_orderstatus = 'F'), b as (select * from a where o_totalprice > 250000),
c as (select b.*, c_name from b join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING')
select 'rows read' as total, count(*) as n from orders union all select 'after 1 filter_select', count(*) from a union all select 'after 2 filter_omit', count(*) from b
union all select 'after 3 lookup', count(*) from c union all select 'after 4 sort', count(*) from c union all select 'after 5 choose', count(*) from c
union all select 'rows written', count(*) from c union all select 'rows in the files', count(*) from c""")
def job_report(spark, d):
    """Totals of a job's control report, counted while it writes."""
    from .plans.job import JobSpec

    path, building = new_path(spark), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    over = [{"kind": "numeric", "field": "o_totalprice", "operator": "less_than_or_equal", "value": 250000}]
    steps = [{"op": "filter_select", "rules": [{"kind": "text", "field": "o_orderstatus", "operator": "equals", "values": "f"}]}, {"op": "filter_omit", "rules": over}, {"op": "lookup", "table": "c", "on": [["o_custkey", "c_custkey"]], "append": ["c_name"], "order_by": ["c_custkey"]}, {"op": "sort", "fields": ["o_totalprice"]}, {"op": "choose", "fields": ["o_orderkey", "c_name"]}]
    report = JobSpec(steps).write(table(spark, d, "orders"), path, {"c": building}, read_only=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    files = spark.read.option("header", True).csv(path).select(F.lit("rows in the files").alias("total")).groupBy("total").agg(F.count("*").alias("n"))
    return spark.createDataFrame(list(report.totals.items()), "total string, n long").unionAll(files)


def _files(spark, path):
    """The files that a writer left in a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().toString() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if s.getPath().getName().startswith("part-")]


# dates


@query("select o_orderkey, cast(o_orderdate as date) as day from orders")
def excel_serial_date(spark, d):
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")
    return table(spark, d, "orders").select("o_orderkey", dates.parsed(serial, dates.EXCEL).cast("date").alias("day"))


@query("select o_orderkey, cast(o_orderdate + interval 10 year as date) as day from orders")
def julian_date(spark, d):
    later = F.add_months(F.col("o_orderdate").cast("date"), 120)
    text = F.date_format(later, "yyDDD")
    return table(spark, d, "orders").select("o_orderkey", dates.parsed(text, dates.JULIAN).cast("date").alias("day"))


@query("select o_orderkey, cast(o_orderdate + interval 10 year as date) as day from orders")
def prefixed_julian_date(spark, d):
    later = F.add_months(F.col("o_orderdate").cast("date"), 120)
    text = F.concat(F.lit("DT"), F.date_format(later, "yyDDD"))
    return table(spark, d, "orders").select("o_orderkey", dates.parsed(text, dates.PREFIXED_JULIAN).cast("date").alias("day"))


@query("select o_orderkey, cast(o_orderdate as date) as day from orders")
def likely_date(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", dates.likely_date(text).alias("day"))


@query("select o_orderkey, o_orderstatus, 'x' as batch from orders where o_orderstatus = 'F' and o_totalprice > 250000")
def job_chain(spark, d):
    """Steps of a declarative job."""
    from .plans.job import JobSpec

    job = JobSpec([{"op": "filter_select", "rules": [{"kind": "text", "field": "o_orderstatus", "operator": "equals", "values": "f"}]}, {"op": "filter_omit", "rules": [{"kind": "numeric", "field": "o_totalprice", "operator": "less_than_or_equal", "value": 250000}]}, {"op": "add_constant", "values": {"batch": "x"}}, {"op": "choose", "fields": ["o_orderkey", "o_orderstatus", "batch"]}])
    return JobSpec.from_json(job.to_json()).apply(table(spark, d, "orders"))[0]


