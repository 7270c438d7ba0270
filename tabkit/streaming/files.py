"""The same row operators on a stream of delimited files.

Filters, replacements, added columns, key matches against a static table and
normalisation keep no state, so the batch functions apply as they are; sorting
and file-order dedupe do not, and ``dedupe_within`` drops repeats that arrive
within a watermark.  Lookups that use each row up, and profiles, keep what
they know between batches in a folder (``state``), one version a batch; a batch
that is run again starts from the version before it and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import unique_name
from ..functions.text import col
from ..operators.keyjoin import KeyStyle, keyed
from ..operators.ordering import dedupe_key, numbered_within
from ..operators.profile import Profile, merge_states, profile_of, profile_state


def read_stream(spark: SparkSession, folder: str, header: list[str], delimiter: str = ",", max_files: int = 1000) -> DataFrame:
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    df = spark.readStream.schema(schema).options(sep=delimiter, quote='"', escape='"', header="true", maxFilesPerTrigger=str(max_files)).csv(folder)
    return df.select(*(F.coalesce(col(h), F.lit("")).alias(h) for h in header))


def dedupe_within(df: DataFrame, fields: list[str], event_time: str, delay: str) -> DataFrame:
    names = [f"__k{i}" for i in range(len(fields))]
    keyed = df.withWatermark(event_time, delay).select("*", *(dedupe_key(f).alias(n) for f, n in zip(fields, names, strict=True)))
    return keyed.dropDuplicatesWithinWatermark(names).drop(*names)


def run_available(df: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process what has arrived and stop; a later call goes on from there."""
    df = transform(df) if transform else df
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose version is whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def _before(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """The last version of an earlier batch."""
    older = [v for v in _versions(spark, folder) if v < batch]
    return spark.read.parquet(f"{folder}/{older[-1]}") if older else None


def _store(df: DataFrame, folder: str, batch: int) -> None:
    """This batch's version; those before the last one go."""
    df.write.mode("overwrite").parquet(f"{folder}/{batch}")
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for v in [v for v in _versions(spark, folder) if v < batch][:-1]:
        old = jvm.org.apache.hadoop.fs.Path(f"{folder}/{v}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def lookup_fifo(df: DataFrame, table: DataFrame, on: list[tuple[str, str]], append: list[str], order_by: list[str], main_order: list[str], out: str, checkpoint: str, state: str, style: KeyStyle = KeyStyle(), max_width: tuple[int, ...] | None = None) -> StreamingQuery:
    """First in, first out: each arriving row of a key takes the next lookup row of it that no row has taken.

    The k-th row of a key over all batches takes its k-th lookup row; rows of
    one batch come in ``main_order``, rows that find none stay.  Rows are
    numbered by ranges, so a key with a third of a batch lies in many parts.
    The lookup table is numbered once and kept in ``state`` with the number of
    rows that each of its keys has given.  ``out`` holds a folder a batch,
    written anew where a batch is run again.  Digits are padded to
    ``max_width``, as widths cannot be learnt from rows that are still to come.
    """
    if style.zero_pad and max_width is None:
        raise ValueError("padding of keys on a stream needs max_width")
    spark, names = df.sparkSession, [f"__k{i}" for i in range(len(on))]
    widths = max_width or (0,) * len(on)
    new = {a: unique_name(a, df.columns) for a in append}
    header = df.columns
    if not _versions(spark, f"{state}/table"):
        t = keyed(table, [k for _, k in on], style, widths)
        t = t.select(*names, *(col(c).alias(f"__by{i}") for i, c in enumerate(order_by)), *(col(a).alias(f"__a{i}") for i, a in enumerate(append)))
        _store(numbered_within(t, names, [F.col(f"__by{i}") for i in range(len(order_by))], "__n").drop(*(f"__by{i}" for i in range(len(order_by)))), f"{state}/table", 0)

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        t = session.read.parquet(f"{state}/table/0")
        m = numbered_within(keyed(rows, [x for x, _ in on], style, widths), names, [*map(col, main_order)], "__n")
        counts = m.groupBy(*names).agg(F.max("__n").alias("__new"))
        used = _before(session, f"{state}/used", number)
        if used is not None:
            m = m.join(used, names, "left").withColumn("__n", F.col("__n") + F.coalesce("__used", F.lit(0))).drop("__used")
        found = m.join(t, [*names, "__n"], "left").select(*map(col, header), *(F.col(f"__a{i}").alias(new[a]) for i, a in enumerate(append)))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        counts = counts.join(t.where("__n = 1"), names, "left_semi")
        if used is not None:
            counts = counts.join(used, names, "full")
        _store(counts.select(*names, (F.coalesce("__new", F.lit(0)) + (F.coalesce("__used", F.lit(0)) if used is not None else F.lit(0))).alias("__used")), f"{state}/used", number)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profile_stream(df: DataFrame, checkpoint: str, state: str) -> StreamingQuery:
    """Keeps the state of a profile of all rows that have arrived; each batch is read once."""

    def batch(rows: DataFrame, number: int) -> None:
        seen, new = _before(rows.sparkSession, state, number), profile_state(rows)
        _store(new if seen is None else merge_states(seen, new), state, number)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def profile_so_far(spark: SparkSession, state: str, strict: bool = False) -> Profile | None:
    """The profile of what has arrived; None before the first batch."""
    whole = _versions(spark, state)
    return profile_of(spark.read.parquet(f"{state}/{whole[-1]}"), strict) if whole else None
