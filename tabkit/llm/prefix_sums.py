"""Running sums over a sorted table of any size, without bringing a group to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import partitions, written


def _running(group: str | None, values: list[str], schema: pa.Schema | None = None):
    """Sums of the earlier rows of the same group in this partition, which is sorted by group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), object(), [0] * len(values)
        for b in batches:
            if not len(b):
                continue
            if group is None:
                code, first = np.zeros(len(b), np.int64), None
            else:
                column = b.column(group).dictionary_encode("encode")
                code, first = column.indices.to_numpy(), column[0].as_py()
            head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(b))))
            if first != last:
                carried = [0] * len(values)
            columns = []
            for i, v in enumerate(values):
                x = b.column(v).to_numpy(zero_copy_only=False)
                before = np.cumsum(x) - x
                before = before - before[head][run]
                before[run == 0] += carried[i]
                columns.append(pa.array(before))
                carried[i] = before[-1] + x[-1]
            last = first if group is None else column[len(b) - 1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), *columns], [*b.schema.names, "part", *(f"before_{v}" for v in values)])

    return work


def prefix_sums(df: DataFrame, group: str | None, order: list[str | Column], values: list[str]) -> DataFrame:
    """The rows, sorted by ``group`` and ``order``, with ``before_<value>``: the sum over the earlier rows of the group.

    Rows are sorted by range, so a group that holds a third of them lies in a
    third of the partitions; of each partition and group one row of sums is
    added up in a window.  ``values`` are long or double and not null.  Rows
    that tie in ``order`` come in any order.
    """
    own = [group] if group else []
    kind = T.StructType([*df.schema, T.StructField("part", T.IntegerType()), *(T.StructField(f"before_{v}", df.schema[v].dataType) for v in values)])
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in kind])
    running = written(df.repartitionByRange(partitions(df), *own, *order).sortWithinPartitions(*own, *order).mapInArrow(_running(group, values), kind))
    parts = running.groupBy(*own, "part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    earlier = (Window.partitionBy(*own) if own else Window).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(g).alias("__group") for g in own), F.col("part").alias("__part"), *(F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0).cast(df.schema[v].dataType)).alias(f"__{v}") for v in values))
    same = F.col("part") == F.col("__part")
    if own:
        same &= F.col(group).eqNullSafe(F.col("__group"))
    out = running.join(parts, same)
    return out.select(*df.columns, *((F.col(f"before_{v}") + F.col(f"__{v}")).alias(f"before_{v}") for v in values))
