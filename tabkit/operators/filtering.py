"""Row filters and splits by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RuleSet


def filter_select(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Rows that all rules hold for; no rules keep every row."""
    return df.filter(rules.condition(df)) if rules.rules else df


def filter_omit(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Rows without those that all rules hold for."""
    return df.filter(~rules.column(df)) if rules.rules else df


def delete_by_condition(df: DataFrame, rules: RuleSet) -> DataFrame:
    """The same under its other name; a deletion without rules deletes nothing."""
    return filter_omit(df, rules)


def flag_by_rules(df: DataFrame, rules: RuleSet, name: str = "matched") -> DataFrame:
    """One scan for both sides of a split; write it partitioned by the flag."""
    return df.withColumn(name, rules.column(df))


def split_by_rules(df: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    return filter_select(df, rules), filter_omit(df, rules)


def keep_counts(df: DataFrame, rules: RuleSet) -> DataFrame:
    return df.agg(F.count("*").alias("rows_read"), F.count_if(rules.column(df)).alias("rows_kept"))
