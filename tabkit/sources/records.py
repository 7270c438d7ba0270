"""Records of delimited files with line breaks in cells, read by many tasks.

A split of a file does not know whether it starts inside a quoted cell.  So each
split first says how it ends if it starts outside and if it starts inside; one
row a split is put in order, which tells every split its start.  Then tasks
parse their records by the rules of Python's csv module.  A record that crosses
a split's end leaves its pieces, which are put together by file and place.

Lines end with a line feed; a carriage return before it, or alone outside
quotes, ends a record too.  A quote opens a cell only where the cell begins.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BOM = b"\xef\xbb\xbf"
_PYTHON = {"UTF-8": "utf-8", "windows-1252": "cp1252", "ISO-8859-1": "latin-1"}
_ROW = "file string, start long, row long, header boolean, n_cells int, cells array<string>, raw string"


def _opener(delimiter: str) -> re.Pattern[bytes]:
    return re.compile(rb'(?:\A|(?<=[\r' + re.escape(delimiter.encode()) + rb']))"')


def ends_inside(line: bytes, inside: bool, opener: re.Pattern[bytes]) -> bool:
    """Whether a line that starts inside a quoted cell, or with a record, ends inside one."""
    at = 0
    while True:
        if not inside:
            m = opener.search(line, at)
            if not m:
                return False
            at = m.end()
        quote = line.find(b'"', at)
        if quote < 0:
            return True
        at = quote + 1
        inside = line[at : at + 1] == b'"'
        at += inside


def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """The lines of each split and batch, and whether the split's first are among them."""
    last = None
    for b in batches:
        if not len(b):
            continue
        file, start = b.column("file").dictionary_encode(), b.column("start")
        code = pc.add(pc.multiply(pc.cast(file.indices, pa.int64()), 1 << 50), start).to_numpy()
        edge = [0, *(i for i in range(1, len(code)) if code[i] != code[i - 1]), len(code)] if (code != code[0]).any() else [0, len(code)]
        for a, z in zip(edge, edge[1:], strict=False):
            key = (file[a].as_py(), start[a].as_py())
            yield (*key, b.column("value").slice(a, z - a), key != last)
            last = key


def _ends(delimiter: str):
    """Of each split: does it end inside a cell if it starts outside, and if it starts inside?"""

    def work(batches):
        opener, key, state = _opener(delimiter), None, [False, True]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, *state)], ["file", "start", "outside", "inside"])

        for file, start, lines, first in splits(batches):
            if first:
                if key:
                    yield row()
                key, state = (file, start), [False, True]
            for line in lines.filter(pc.match_substring(lines, b'"')).to_pylist():
                state = [ends_inside(line, s, opener) for s in state] if state[0] != state[1] else [ends_inside(line, state[0], opener)] * 2
        if key:
            yield row()

    return work


def _cells(raws: list[str], delimiter: str, closed: bool) -> list[list[list[str]]]:
    """The records of each raw text, of which a lone carriage return makes several; ``closed``: none ends inside a cell."""
    if closed and not any("\r" in r.removesuffix("\r") for r in raws):
        return [[x] for x in csv.reader(raws, delimiter=delimiter)]
    return [list(csv.reader(io.StringIO(r, newline=""), delimiter=delimiter)) or [[]] for r in raws]


def _pieces(delimiter: str, encoding: str, starts, whole: bool):
    """Whole records (``whole``) or the pieces of those that cross a split's end."""

    def work(batches):
        csv.field_size_limit(sys.maxsize)
        opener, at, inside, kept, began, number, headed = _opener(delimiter), None, False, [], False, 0, False

        def pieces(ended: bool) -> pa.RecordBatch:
            raw = b"\n".join(kept).decode(encoding, "replace")
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, first_line, began, ended, raw, began and at[1] == 0 and not headed)], ["file", "start", "row", "began", "ended", "raw", "header"])

        for file, start, lines, first in splits(batches):
            if first:
                if kept and not whole:
                    yield pieces(False)
                at, inside = (file, start), (file, start) in starts.value
                kept, began, number, first_line, headed = [], not inside, 0, 0, False
            quoted = pc.match_substring(lines, b'"').to_pylist()
            rows, raws, heads = [], [], []
            for line, q in zip(lines.to_pylist(), quoted, strict=True):
                if start == 0 and number == 0:
                    line = line.removeprefix(_BOM)
                if not kept:
                    first_line = number
                number += 1
                if q:
                    inside = ends_inside(line, inside, opener)
                if inside or kept or not began:
                    kept.append(line)
                if inside:
                    continue
                if began:
                    raw = b"\n".join(kept) if kept else line
                    if whole:
                        rows.append(first_line)
                        raws.append(raw.decode(encoding, "replace"))
                        heads.append(start == 0 and not headed and bool(raw.strip()))
                    headed = headed or bool(raw.strip())
                elif not whole:
                    yield pieces(True)
                kept, began = [], True
            if raws:
                yield _batch([at[0]] * len(rows), [at[1]] * len(rows), rows, raws, heads, delimiter, True)
        if kept and not whole:
            yield pieces(False)

    return work


def _batch(files, starts, rows, raws, headers, delimiter: str, closed: bool) -> pa.RecordBatch:
    out = []
    for f, s, r, raw, h, records in zip(files, starts, rows, raws, headers, _cells(raws, delimiter, closed), strict=True):
        out += [(f, s, r, h and not i, len(c), c, raw.removesuffix("\r")) for i, c in enumerate(records)]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["file", "start", "row", "header", "n_cells", "cells", "raw"])


def read_records(spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """file, start and row (the place, in file order), n_cells, cells and raw text of every record, and ``header``: it is its file's first that is not blank.

    Blank lines are records of no cells.  ``path`` is a file, a folder or a list
    of files, of one delimiter and encoding.  Two passes read the files, a third one
    if a record crosses splits; what the driver sees is one name and place of
    each split that starts or ends inside a cell.
    """
    lines = spark.read.option("lineSep", "\n").text([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in ([path] if isinstance(path, str) else path)])
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    ends = lines.mapInArrow(_ends(delimiter), "file string, start long, outside boolean, inside boolean")
    # a split that ends alike whatever it starts with sets the state anew; after it, those that turn it are counted
    place = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("outside") == F.col("inside")
    ends = ends.withColumn("turns", F.coalesce(F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(place), F.lit(0)))
    ends = ends.withColumn("last", F.max(F.when(known, F.struct("start", "outside", (F.col("turns")).alias("turns")))).over(place))
    inside = F.coalesce(F.col("last.outside"), F.lit(False)) != ((F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1)
    ends = ends.withColumn("within", inside).withColumn("crossed", F.when(inside, F.col("inside")).otherwise(F.col("outside")))
    edges = list(ends.where("within or crossed").select("file", "start", "within").toLocalIterator())
    starts = spark.sparkContext.broadcast({(r.file, r.start) for r in edges if r.within})
    python = _PYTHON.get(encoding, encoding)
    out = lines.mapInArrow(_pieces(delimiter, python, starts, True), _ROW)
    if not edges:
        return out
    parts = lines.mapInArrow(_pieces(delimiter, python, starts, False), "file string, start long, row long, began boolean, ended boolean, raw string, header boolean")
    order = Window.partitionBy("file").orderBy("start", "row")
    parts = parts.withColumn("record", F.sum(F.col("began").cast("int")).over(order))
    whole = parts.groupBy("file", "record").agg(F.min(F.struct("start", "row")).alias("at"), F.bool_or("header").alias("header"), F.sort_array(F.collect_list(F.struct("start", "row", "raw"))).alias("parts"))
    whole = whole.select("file", "at.start", "at.row", "header", F.array_join(F.transform("parts", lambda p: p["raw"]), "\n").alias("raw"))

    def parsed(batches):
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            yield _batch(*(b.column(c).to_pylist() for c in ("file", "start", "row", "raw", "header")), delimiter, False)

    return out.unionByName(whole.mapInArrow(parsed, _ROW))


def as_table(records: DataFrame, header: list[str], has_header: bool = True, width: str | None = None, raw: str | None = None, ordinal: str | None = None) -> DataFrame:
    """The records' cells under names, missing ones empty, without blank lines and headers; ``width``, ``raw`` and ``ordinal`` name columns for the number of cells, the raw text and the place."""
    rows = records.where("n_cells > 0 and not header" if has_header else "n_cells > 0")
    more = {width: F.col("n_cells"), raw: F.col("raw"), ordinal: F.struct("file", "start", "row")}
    return rows.select(*(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(header)), *(c.alias(n) for n, c in more.items() if n))
