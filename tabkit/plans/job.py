"""Declarative jobs: a list of steps as JSON, composed lazily into one plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Flags, RuleSet, rule
from ..operators import columns, compare, concat, filtering, keyjoin, normalize, ordering, profile
from ..operators.checkpoints import written
from ..sources import delimited
from .reports import Totals, control_report

STEPS: dict[str, Callable] = {}


def step(name: str):
    def add(f):
        STEPS[name] = f
        return f

    return add


class JobError(ValueError):
    """A job that cannot run; ``errors`` says why, one by one."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass
class Outcome:
    """What a job made: a frame, or none, and what went wrong."""

    df: DataFrame | None
    warnings: list[str]
    errors: list[str]


@dataclass
class JobReport:
    """What a job wrote: its fields, totals by name and warnings."""

    path: str
    fields: list[str]
    totals: dict[str, int]
    warnings: list[str]

    def text(self, title: str, paths: dict[str, str] | None = None) -> str:
        return control_report(title, {**(paths or {}), "output": self.path}, self.totals, self.fields, self.warnings)


@dataclass
class JobSpec:
    """steps: dicts with ``op`` and its options, run in order; each step sees what the one before made."""

    steps: list[dict] = field(default_factory=list)
    delimiter: str = ","
    has_header: bool = True

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> JobSpec:
        return JobSpec(**json.loads(text))

    def check(self) -> list[str]:
        return [f"unknown step {s.get('op')!r}" for s in self.steps if s.get("op") not in STEPS]

    def apply(self, df: DataFrame, tables: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
        """The composed frame and warnings; nothing runs yet but what learns widths and profiles."""
        if bad := self.check():
            raise JobError(bad)
        warnings: list[str] = []
        for s in self.steps:
            options = {k: v for k, v in s.items() if k != "op"}
            out = STEPS[s["op"]](df, tables or {}, **options)
            df, new = out if isinstance(out, tuple) else (out, [])
            warnings += new
        return df, warnings

    def run(self, df: DataFrame, tables: dict[str, DataFrame] | None = None) -> Outcome:
        """The same without raising: a step that fails is left out and named among the errors."""
        out = Outcome(df, [], self.check())
        for k, s in enumerate(self.steps):
            if s.get("op") not in STEPS:
                continue
            try:
                out.df, new = JobSpec([s]).apply(out.df, tables)
                out.warnings += new
            except (ValueError, KeyError, TypeError, AnalysisException) as e:
                out.errors.append(f"step {k + 1}, {s['op']}: {e}")
        return out

    def write(self, df: DataFrame, path: str, tables: dict[str, DataFrame] | None = None, read_only: list[str] = (), **options) -> JobReport:
        """The result as a folder of delimited files (``options`` as in ``write_delimited``) and a report whose totals come from that write.

        Rows are counted as read, after each step and as written.  Steps that
        read their input more than once (sorts, duplicates, first-in first-out lookups,
        built profiles, comparisons) get a written table, so that no row is
        counted, or made, twice.  ``read_only`` names the columns to read.
        """
        if bad := self.check():
            raise JobError(bad)
        totals, warnings = Totals(), []
        df = totals.rows(df.select(*(F.col(f"`{c}`") for c in read_only)) if read_only else df, "rows read")
        for k, s in enumerate(self.steps):
            if s["op"] in ("sort", "top", "compare", "duplicates", "dedupe_by_mode") or s.get("mode") == "fifo" or s["op"] == "normalize" and not s.get("fields") or s["op"] == "lookup" and (s.get("style") or {}).get("zero_pad"):
                df = written(df)
            df, new = JobSpec([s]).apply(df, tables)
            df = totals.rows(df, f"after {k + 1} {s['op']}")
            warnings += new
        df = totals.rows(df, "rows written")
        delimited.write_delimited(df, path, options.pop("delimiter", self.delimiter), **options)
        return JobReport(path, df.columns, totals.get(), warnings)

    def preview(self, df: DataFrame, tables: dict[str, DataFrame] | None = None, rows: int = 10) -> list[dict]:
        """Some rows of the result."""
        return [r.asDict() for r in self.apply(df, tables)[0].limit(rows).collect()]


def _rules(rules: list[dict], flags: dict | None) -> RuleSet:
    return RuleSet(tuple(rule(**r) for r in rules), Flags(**(flags or {})))


@step("filter_select")
def _select(df, tables, rules, flags=None):
    return filtering.filter_select(df, _rules(rules, flags))


@step("filter_omit")
def _omit(df, tables, rules, flags=None):
    return filtering.filter_omit(df, _rules(rules, flags))


@step("replace")
def _replace(df, tables, rules):
    return columns.replace_values(df, [columns.Replacement(**r) for r in rules])


@step("add_constant")
def _constant(df, tables, values):
    return columns.add_constant(df, values)


@step("choose")
def _choose(df, tables, fields, ignore_case=True, clean=False):
    return columns.choose_columns(df, fields, ignore_case, clean)


@step("sort")
def _sort(df, tables, fields, numeric_aware=True, ordinal=None):
    return ordering.sort_records(df, fields, numeric_aware, ordinal)


@step("dedupe")
def _dedupe(df, tables, fields, order_by, rewrite_keys=False):
    return ordering.dedupe_first(df, fields, order_by, rewrite_keys)


@step("duplicates")
def _duplicates(df, tables, fields, rewrite_keys=False):
    return ordering.duplicates_only(df, fields, rewrite_keys)


@step("merge_by_key")
def _merge(df, tables, table, on, mode="inner", style=None):
    return keyjoin.merge_by_key(df, tables[table], [tuple(p) for p in on], mode, keyjoin.KeyStyle(**(style or {})))


@step("lookup")
def _lookup(df, tables, table, on, append, order_by, mode="first", style=None):
    return keyjoin.lookup(df, tables[table], [tuple(p) for p in on], append, order_by, mode, keyjoin.KeyStyle(**(style or {})))


@step("normalize")
def _normalize(df, tables, mode="stream", sample_rows=None, strict=False, fields=None):
    """By a profile that is built, or given as a list of its fields' values."""
    p = profile.Profile([profile.FieldProfile(**f) for f in fields]) if fields else profile.build_profile(df, sample_rows, strict=strict)
    return normalize.normalize(df, p, mode), profile.problems(p, df.columns) if fields else []


@step("delete_by_condition")
def _delete(df, tables, rules, flags=None):
    return filtering.delete_by_condition(df, _rules(rules, flags))


@step("flag_by_rules")
def _flag(df, tables, rules, flags=None, name="matched"):
    return filtering.flag_by_rules(df, _rules(rules, flags), name)


@step("split_by_key")
def _split(df, tables, table, on, style=None, name="matched"):
    """Both sides in one frame, by a flag."""
    return keyjoin.flag_by_key(columns.drop_blank_rows(df), tables[table], [tuple(p) for p in on], keyjoin.KeyStyle(**(style or {})), name)


@step("dedupe_by_mode")
def _by_mode(df, tables, fields, mode="dedupe", order_by=None, rewrite_keys=False):
    return ordering.dedupe(df, fields, mode, order_by, rewrite_keys)


@step("top")
def _top(df, tables, fields, n, numeric_aware=True, ordinal=None):
    return ordering.top_records(df, fields, n, numeric_aware, ordinal)


@step("add_conditional")
def _conditional(df, tables, values, rules, flags=None, otherwise=""):
    return columns.add_conditional(df, values, _rules(rules, flags).column(df), otherwise)


@step("add_date_part")
def _date_part(df, tables, name, field, part):
    return columns.add_date_part(df, name, field, part)


@step("add_range_label")
def _range_label(df, tables, name, field, ranges, otherwise=""):
    return columns.add_range_label(df, name, field, [tuple(r) for r in ranges], otherwise)


@step("add_membership")
def _membership(df, tables, name, field, values, label="Y", otherwise=""):
    return columns.add_membership(df, name, field, values, label, otherwise)


@step("add_fixed_row")
def _fixed_row(df, tables, values):
    return columns.add_fixed_row(df, values)


@step("clean")
def _clean(df, tables, normal_form=True):
    return columns.clean_cells(df, normal_form)


@step("trim")
def _trim(df, tables, upper=False):
    return ordering.normalize_rows(df, upper)


@step("drop_blank")
def _drop_blank(df, tables):
    return columns.drop_blank_rows(df)


@step("fill_missing")
def _fill(df, tables):
    return columns.fill_missing(df)


@step("concat")
def _concat(df, tables, names, mode="strict", on_mismatch="skip", source=None):
    out = concat.concat_frames([("main", df), *((n, tables[n]) for n in names)], mode, on_mismatch, source)
    return out.df, [f"{n}: {why}" for n, why in out.skipped]


@step("hygiene")
def _hygiene(df, tables, min_populated=2, header=None):
    return concat.hygiene(df, min_populated, header)[0]


@step("compare")
def _compare(df, tables, table, order_by, omit=()):
    keys = [F.col(f"`{c}`") for c in order_by]
    return compare.paired(df, tables[table], keys, keys, omit=list(omit))
