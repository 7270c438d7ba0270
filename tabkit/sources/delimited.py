"""Delimited text: probing, reading with all-text columns, writing, and directories of files.

Probes read the first records through Spark's own file access, so any store
Spark reads will do; the encoding is decided over the whole file.
"""

from __future__ import annotations

import codecs
import csv
import fnmatch
import io
import os
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import natural_key, synthetic_header, unique_header
from ..functions.text import col
from ..operators.concat import STRICT, Concatenation, same_header
from ..operators.keyjoin import lookup_table
from .records import as_table, read_records, splits

DELIMITERS = [",", ";", "\t", "|"]
PROBE = 4096


def head_bytes(spark: SparkSession, path: str, n: int = PROBE) -> bytes:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def probe_encoding(data: bytes, whole: bool = False) -> str:
    """UTF-8 if it decodes (a last character may be cut short, unless the data is whole), else cp1252, else latin-1."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data, final=whole)
        return "UTF-8"
    except UnicodeDecodeError:
        pass
    try:
        data.decode("cp1252")
        return "windows-1252"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def file_encoding(spark: SparkSession, path: str) -> str:
    """As ``probe_encoding``, over all lines of a file; no line end is part of a longer character."""
    lines = spark.read.text(re.sub(r"([\\{}\[\]*?])", r"\\\1", path))
    undefined = F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike("[\\x81\\x8d\\x8f\\x90\\x9d]")
    invalid, latin = lines.agg(F.bool_or(~F.is_valid_utf8("value")), F.bool_or(undefined)).first()
    return "UTF-8" if not invalid else "ISO-8859-1" if latin else "windows-1252"


def decode(data: bytes, name: str | None = None) -> str:
    name = name or probe_encoding(data)
    return data.decode({"UTF-8": "utf-8", "windows-1252": "cp1252", "ISO-8859-1": "latin-1"}[name], "ignore").removeprefix("﻿")


def sniff_delimiter(text: str, default: str = ",") -> str:
    """The delimiter that parts the first lines into most, and equally many, cells."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    if not lines:
        return default
    best = (1, default)
    for d in DELIMITERS:
        try:
            widths = [len(r) for r in csv.reader(io.StringIO("\n".join(lines)), delimiter=d)]
        except csv.Error:  # a cell beyond the csv module's limit
            continue
        if widths and widths[0] > best[0] and sum(w == widths[0] for w in widths) >= 0.6 * len(widths):
            best = (widths[0], d)
    return best[1]


def quote_pattern(text: str, delimiter: str) -> list[bool]:
    """Which cells of the second line are quoted."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        return []
    cell = r'(\s*"(?:[^"]|"")*"\s*|[^{0}]*)(?:{0}|$)'.format(re.escape(delimiter))
    found = re.findall(cell, lines[1])
    found = found[:-1] if lines[1] and not lines[1].endswith(delimiter) else found  # the empty match at the end
    return [len(x.strip()) > 1 and x.strip()[0] == x.strip()[-1] == '"' for x in found]


def first_record(text: str, delimiter: str) -> tuple[list[str], bool]:
    """The first record that is not blank, and whether it and a line after it end within the text."""
    source, ended = io.StringIO(text, newline=""), []

    def lines():
        for line in source:
            yield line
        ended.append(True)

    row = next((r for r in csv.reader(lines(), delimiter=delimiter) if any(c.strip() for c in r)), [])
    return row, not ended and any(x.strip() and x.endswith(("\n", "\r")) for x in io.StringIO(source.read(), newline=""))


@dataclass
class Preview:
    path: str
    header: list[str] = field(default_factory=list)
    delimiter: str = ","
    encoding: str = "UTF-8"
    quoted: list[bool] = field(default_factory=list)
    size: int = 0
    breaks: bool = False

    @property
    def empty(self) -> bool:
        return not self.header


def preview(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True) -> Preview:
    """Reads on until the first record and the line after it are whole."""
    n, encoding = PROBE, None
    while True:
        data = head_bytes(spark, path, n)
        whole = len(data) < n
        encoding = encoding or (probe_encoding(data, True) if whole else file_encoding(spark, path))
        text = decode(data, encoding)
        lines = text if whole else text[: max(text.rfind("\n"), text.rfind("\r")) + 1] or text
        d = delimiter or sniff_delimiter(lines)
        record, enough = first_record(text, d)
        if whole or enough:
            break
        n *= 2
    first = [c.strip() for c in record]
    header = unique_header(first if has_header else synthetic_header(len(first))) if first else []
    return Preview(path, header, d, encoding, quote_pattern(text, d), len(data))


def breaks_in_cells(spark: SparkSession, path: str) -> bool:
    """Whether a line of a file has an odd number of quotes, so that a cell may go on in the next."""
    lines = spark.read.text(re.sub(r"([\\{}\[\]*?])", r"\\\1", path))
    odd = F.bool_or((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1)
    return bool(lines.agg(odd).first()[0])


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True, corrupt: str | None = None, ordinal: str | None = None, multi_line: bool | None = None, skip_malformed: bool = False) -> DataFrame:
    """All columns as text, missing cells empty.

    ``corrupt`` names a column for rows of a wrong width, ``skip_malformed``
    leaves them out; ``ordinal`` names a column that follows file order.  A
    file whose cells have line breaks (``multi_line``, looked up where it is not
    given) is read by ``read_records``, in parts as well.
    """
    p = preview(spark, path, delimiter, has_header)
    multi_line = breaks_in_cells(spark, path) if multi_line is None else multi_line
    if multi_line:
        df = as_table(read_records(spark, path, p.delimiter, p.encoding), p.header, has_header, "__width", "__raw", ordinal)
        wrong = F.col("__width") != len(p.header)
        df = df.where(~wrong) if skip_malformed else df
        return df.select(*map(col, p.header), *([F.when(wrong, F.col("__raw")).alias(corrupt)] if corrupt else []), *([col(ordinal)] if ordinal else []))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in p.header] + ([T.StructField(corrupt, T.StringType())] if corrupt else []))
    if p.encoding == "windows-1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.schema(schema).options(sep=p.delimiter, quote='"', escape='"', header=str(has_header).lower(), encoding=p.encoding, mode="DROPMALFORMED" if skip_malformed else "PERMISSIVE", enforceSchema="true", maxColumns=max(20480, len(p.header) + 1), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    if corrupt or skip_malformed:  # a parser of some columns alone does not see how wide a line is
        reader = reader.option("columnPruning", "false")
    df = reader.csv(path)
    if ordinal:
        df = df.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias(ordinal))
    return df.select(*(F.coalesce(col(n), F.lit("")).alias(n) for n in p.header), *(col(x) for x in (corrupt, ordinal) if x))


def head(spark: SparkSession, path: str, rows: int, delimiter: str | None = None, has_header: bool = True) -> DataFrame:
    """The first records of a file, in its order: as many bytes are read as hold them."""
    p, n = preview(spark, path, delimiter, has_header), PROBE
    while True:
        data = head_bytes(spark, path, n)
        source, ended = io.StringIO(decode(data, p.encoding), newline=""), []
        lines = (x for x in source if x.endswith(("\n", "\r")) or len(data) < n or ended.append(True))  # a last line may be cut short
        got = [r for r in csv.reader(lines, delimiter=p.delimiter) if r]
        if len(data) < n or len(got) > rows + has_header:  # the last one may be half a record
            break
        n *= 4
    if has_header:
        got = got[next((i + 1 for i, r in enumerate(got) if any(c.strip() for c in r)), 0) :]
    cells = [(r + [""] * len(p.header))[: len(p.header)] for r in got[:rows]]
    return spark.createDataFrame(cells, T.StructType([T.StructField(c, T.StringType()) for c in p.header]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def extension_patterns(text: str) -> list[str]:
    """csv, .csv, *.csv and globs, parted by , ; | or blanks, as globs."""
    out = []
    for x in re.split(r"[,;|\s]+", text.strip()):
        if x:
            out.append(x if any(ch in x for ch in "*?[") else f"*.{x.lstrip('.')}")
    return out


def is_hidden(name: str) -> bool:
    return name.startswith((".", "~", "_")) or name.lower() in ("desktop.ini", "thumbs.db")


#: Beyond this many bytes the head of a file is looked at by a probe of its own.
LONGEST_HEAD = 1 << 20


def _plain(path: str) -> str:
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _enough(data: bytes, delimiter: str | None) -> bool:
    """Whether a file's first lines hold its first record and a line after it; delimiters, quotes and breaks are the same bytes in every encoding."""
    text = data.decode("latin-1")
    return len(data) >= PROBE and first_record(text, delimiter or sniff_delimiter(text))[1]


def _probes(delimiter: str | None):
    """Of each split and batch: bytes that are no UTF-8 or no cp1252, lines with a cell that may go on; and the head, of the first split."""
    kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]

    def row(*cells) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], ["file", "invalid", "latin", "odd", "head"])

    def work(batches):
        csv.field_size_limit(sys.maxsize)
        head, file, size, next_look = None, None, 0, 0

        def closed():
            return row(file, False, False, False, b"\n".join(head))

        for name, start, lines, first in splits(batches):
            if first:
                if head is not None:
                    yield closed()
                file, head, size, next_look = name, [] if start == 0 else None, 0, PROBE
            values = lines.to_pylist()
            bad = [v for v in values if not v.isascii() and probe_encoding(v, True) != "UTF-8"]
            latin = any(probe_encoding(v, True) == "ISO-8859-1" for v in bad)
            yield row(name, bool(bad), latin, any(v.count(b'"') % 2 for v in values), None)
            for v in values if head is not None else ():
                head.append(v)
                size += len(v) + 1
                if size > LONGEST_HEAD:  # left to a probe of its own
                    head = None
                    break
                if size >= next_look:
                    next_look *= 2
                    if _enough(b"\n".join([*head, b""]), delimiter):
                        yield closed()
                        head = None
                        break
        if head is not None:
            yield closed()

    return work


def _headers(delimiter: str | None):
    """Of each file: first record, delimiter and quotes by its head, null if that is not known."""

    def work(batches):
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            for r in b.to_pylist():
                header, d, quoted = None, None, None
                if r["head"] is not None:
                    text = decode(r["head"], r["encoding"])
                    d = delimiter or sniff_delimiter(text)
                    header, quoted = first_record(text, d)[0], quote_pattern(text, d)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["encoding"]]), pa.array([r["odd"]]), pa.array([header], pa.list_(pa.string())), pa.array([d], pa.string()), pa.array([quoted], pa.list_(pa.bool_()))], ["file", "encoding", "odd", "header", "delimiter", "quoted"])

    return work


def scan_directory(spark: SparkSession, path: str, patterns: str = "*.csv;*.txt", delimiter: str | None = None) -> tuple[list[Preview], list[tuple[str, str]]]:
    """Files in natural order, and those left out with a reason; one scan looks into all files.

    The driver holds one row a file: name, header and how it is written.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    sizes, skipped, globs, used = {}, [], extension_patterns(patterns), []
    for s in sorted(where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where), key=lambda s: natural_key(s.getPath().getName())):
        name = s.getPath().getName()
        if s.isDirectory():
            continue
        if is_hidden(name):
            skipped.append((name, "hidden"))
        elif not any(fnmatch.fnmatch(name.lower(), g.lower()) for g in globs):
            skipped.append((name, "extension"))
        elif s.getLen() == 0:
            skipped.append((name, "empty"))
        else:
            sizes[s.getPath().toString()] = s.getLen()
    if not sizes:
        return [], skipped
    lines = spark.read.text([_plain(p) for p in sizes]).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    seen = lines.mapInArrow(_probes(delimiter), "file string, invalid boolean, latin boolean, odd boolean, head binary").groupBy("file")
    encoding = F.when(~F.bool_or("invalid"), "UTF-8").when(F.bool_or("latin"), "ISO-8859-1").otherwise("windows-1252")
    seen = seen.agg(encoding.alias("encoding"), F.bool_or("odd").alias("odd"), F.max("head").alias("head"))
    seen = seen.mapInArrow(_headers(delimiter), "file string, encoding string, odd boolean, header array<string>, delimiter string, quoted array<boolean>")
    found = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.file)).toUri().getPath(): r for r in seen.toLocalIterator()}
    for file, size in sizes.items():
        r = found.get(jvm.org.apache.hadoop.fs.Path(file).toUri().getPath())
        if r and r.header is None:
            p = preview(spark, file, delimiter)
        else:
            first = [c.strip() for c in r.header] if r else []
            p = Preview(file, unique_header(first), r.delimiter, r.encoding, r.quoted) if first else Preview(file)
        if p.empty:
            skipped.append((file.rsplit("/", 1)[1], "empty"))
            continue
        p.size, p.breaks = size, bool(r and r.odd)
        used.append(p)
    place = {name: i for i, name in enumerate(sorted({n for n, _ in skipped}, key=natural_key))}
    return used, sorted(skipped, key=lambda x: place[x[0]])


def read_files(spark: SparkSession, previews: list[Preview], mode: str = STRICT, on_mismatch: str = "skip", source: str | None = None, ordinal: str | None = None) -> Concatenation:
    """All rows of scanned files, by place, under the first one's header, as ``concat_frames`` of the files gives them.

    One reader for each way of writing (encoding, delimiter, breaks in cells),
    however many files there are.  ``source`` names a column for the file's
    name, ``ordinal`` one by which rows have the order of the files given.
    """
    out, ways = Concatenation(), {}
    for place, p in enumerate(previews):
        name = p.path.rsplit("/", 1)[1]
        if len(p.header) != len(previews[0].header) or not same_header(previews[0].header, p.header, mode):
            out.skipped.append((name, "header differs"))
            if on_mismatch == "abort":
                break
            continue
        ways.setdefault((p.encoding, p.delimiter, p.breaks), []).append((p, place))
        out.used.append(name)
    header, frames = previews[0].header if previews else [], []
    for (encoding, delimiter, breaks), files in ways.items():
        paths = [p.path for p, _ in files]
        if breaks:
            df = as_table(read_records(spark, paths, delimiter, encoding), header, ordinal="__at").withColumn("__file", F.col("__at.file")).withColumn("__at", F.struct(F.col("__at.start"), F.col("__at.row")))
        else:
            if encoding == "windows-1252":
                spark.conf.set("spark.sql.legacy.javaCharsets", "true")
            schema = T.StructType([T.StructField(n, T.StringType()) for n in header])
            df = spark.read.schema(schema).options(sep=delimiter, quote='"', escape='"', header="true", encoding=encoding, enforceSchema="true", maxColumns=max(20480, len(header) + 1), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv([_plain(p) for p in paths])
            df = df.select(*(F.coalesce(col(n), F.lit("")).alias(n) for n in header), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias("__at"), F.col("_metadata.file_path").alias("__file"))
        if source or ordinal:
            df = df.withColumn("__name", F.element_at(F.split("__file", "/"), -1))
        frames.append(df)
    if not frames:
        return out
    df = reduce(DataFrame.unionAll, frames)
    if source or ordinal:
        jvm = spark._jvm
        rows = [(jvm.java.net.URI(None, None, "/" + p.path.rsplit("/", 1)[1], None).getRawPath()[1:], p.path.rsplit("/", 1)[1], i) for files in ways.values() for p, i in files]
        df = df.join(spark.createDataFrame(rows, "__name string, __source string, __place int"), "__name")
    more = {source: F.col("__source") if source else None, ordinal: F.struct("__place", "__at") if ordinal else None}
    out.df = df.select(*map(col, header), *(c.alias(n) for n, c in more.items() if n))
    return out


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, quoted_columns: list[str] | None = None, quote_all: bool = False, quoting: bool = True, single_file: bool = False) -> None:
    """A folder of delimited files; cells are kept as they are.

    With ``quoted_columns`` the cells of those columns are always quoted.
    Without ``quoting``, delimiters and backslashes in cells are escaped.
    """
    text = df.select(*(F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    options = dict(sep=delimiter, header=str(header).lower(), emptyValue="", nullValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", escape='"', quoteAll=str(quote_all).lower())
    out = text.coalesce(1) if single_file else text
    if quoted_columns is None and quoting:
        out.write.mode("overwrite").options(**options).csv(path)
        return
    special = "[" + re.escape(delimiter) + '"\\r\\n]'

    def cell(c: str):
        v = col(c)
        if not quoting:
            return F.regexp_replace(v, "([\\\\" + re.escape(delimiter) + "])", r"\\$1")
        wrapped = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        return wrapped if c in quoted_columns else F.when(v.rlike(special), wrapped).otherwise(v)

    line = F.concat_ws(delimiter, *map(cell, out.columns)).alias("value")
    lines = out.select(line)
    if header:
        head = pa.RecordBatch.from_pydict({"value": pa.array([delimiter.join(out.columns)], pa.string())})

        def headed(batches):
            yield head
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

        lines = lines.mapInArrow(headed, "value string")  # each file has its header
    lines.write.mode("overwrite").text(path)


def write_file(df: DataFrame, path: str, **options) -> None:
    """One delimited file of that very name, its rows in the frame's order; options are those of ``write_delimited``.

    Parts are written by as many tasks as the frame has partitions, and put together as ``write_lines`` says.
    """
    header = options.pop("header", True)
    names = io.StringIO()
    if options.get("quoted_columns") is None and options.get("quoting", True):
        csv.writer(names, delimiter=options.get("delimiter", ","), quoting=csv.QUOTE_ALL if options.get("quote_all") else csv.QUOTE_MINIMAL, lineterminator="\n").writerow(df.columns)
    else:
        names.write(options.get("delimiter", ",").join(df.columns) + "\n")
    _one_file(df.sparkSession, path, names.getvalue() if header else "", lambda folder: write_delimited(df, folder, header=False, **options), lambda folder: write_delimited(df, folder, header=header, single_file=True, **options))


def write_lines(df: DataFrame, path: str, head: str | None = None) -> None:
    """One text file of that very name from a frame of one text column; ``head`` is its first line.

    In a store of plain paths (``file:``, on a cluster a folder that all
    executors share) each task copies its parts to their places in the file.  A
    store that joins files itself (HDFS) is told to.  In others one task writes
    the file.  It has its name only once it is whole.
    """
    _one_file(df.sparkSession, path, "" if head is None else head + "\n", lambda folder: df.write.mode("overwrite").text(folder), df)


def _copy(folder: str, to: str):
    """Copies parts to their places; to do so twice does no harm."""

    def work(batches):
        for b in batches:
            for name, at in zip(b.column("name").to_pylist(), b.column("at").to_pylist(), strict=True):
                with open(f"{folder}/{name}", "rb") as part, open(to, "r+b") as out:
                    out.seek(at)
                    while block := part.read(1 << 22):
                        out.write(block)
                    out.flush()
                    os.fsync(out.fileno())
            yield pa.RecordBatch.from_pydict({"done": pa.array([len(b)], pa.int64())})

    return work


def _one_file(spark: SparkSession, path: str, head: str, parts: Callable[[str], None], alone: Callable[[str], None]) -> None:
    """``parts`` writes a folder of parts in order, ``alone`` one of a single part with its head."""
    jvm, first = spark._jvm, head.encode()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    to = fs.makeQualified(to)
    folder = jvm.org.apache.hadoop.fs.Path(f"{to.toString()}.parts")
    plain, joins = to.toUri().getScheme() == "file", fs.hasPathCapability(to.getParent(), "fs.capability.paths.concat")
    (parts if plain or joins else alone)(folder.toString())
    found = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    if plain:
        whole, rows, at = f"{to.toUri().getPath()}.whole", [], len(first)
        for name, size in found:
            if size:
                rows.append((name, at))
            at += size
        with open(whole, "wb") as out:
            out.write(first)
            out.truncate(at)
        if rows:
            places = spark.createDataFrame(rows, "name string, at long").repartition(min(len(rows), 1000), "name")
            done = places.mapInArrow(_copy(folder.toUri().getPath(), whole), "done long").agg(F.sum("done")).first()[0]
            if done != len(rows):
                raise OSError(f"{done} of {len(rows)} parts of {path!r} copied")
        fs.delete(to, True)
        os.replace(whole, to.toUri().getPath())
    else:
        whole, paths = jvm.org.apache.hadoop.fs.Path(folder, "whole"), [jvm.org.apache.hadoop.fs.Path(folder, name) for name, size in found if size or not joins]
        if first and joins:
            out = fs.create(whole)
            out.write(bytearray(first))
            out.close()
        elif paths:
            fs.rename(paths.pop(0), whole)
        else:
            fs.create(whole).close()
        if paths:
            array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths))
            for i, x in enumerate(paths):
                array[i] = x
            fs.concat(whole, array)
        fs.delete(to, True)
        fs.rename(whole, to)
    fs.delete(folder, True)


def write_like(df: DataFrame, path: str, source: Preview) -> None:
    """With a source's delimiter, and its quotes around the columns that have them there."""
    quoted = [c for c, q in zip(source.header, source.quoted, strict=False) if q and c in df.columns]
    write_delimited(df, path, source.delimiter, quoted_columns=quoted)


def write_deduped(df: DataFrame, source: str, delimiter: str = ",") -> str:
    path = output_name(source, "deduped")
    write_delimited(df, path, delimiter)
    return path


def write_rejects(df: DataFrame, source: str, corrupt: str) -> str:
    """The lines that a read has flagged, as they were."""
    path = output_name(source, "rejects")
    other = next(c for c in df.columns if c != corrupt)  # a scan of the flagged column alone is refused
    line = F.concat(col(corrupt), F.coalesce(F.substring(col(other), 1, 0), F.lit("")))
    df.where(col(corrupt).isNotNull()).select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def write_dropped(dropped: DataFrame, source: str, delimiter: str = ",") -> str:
    """Dropped rows with their reason."""
    path = output_name(source, "dropped")
    write_delimited(dropped, path, delimiter)
    return path


def load_lookup(spark: SparkSession, path: str, keys: list[str], append: list[str], delimiter: str | None = None) -> DataFrame:
    """A file as a lookup table, whatever its size; its fields must exist, rows with a missing cell go."""
    return lookup_table(read_delimited(spark, path, delimiter), keys, append)


def path_problems(spark: SparkSession, reads: list[str] = (), writes: list[str] = ()) -> list[str]:
    """What a run would fail on: inputs that do not exist, outputs whose folder does not."""
    jvm, out = spark._jvm, []
    for path, what in [*((p, "input") for p in reads), *((p, "output") for p in writes)]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if what == "input" and not fs.exists(where):
            out.append(f"no input {path!r}")
        if what == "output" and where.getParent() is not None and not fs.exists(where.getParent()):
            out.append(f"no folder for output {path!r}")
    return out


def output_name(source: str, kind: str) -> str:
    """The default name beside a source: results, deduped, matched, nonmatched, rejects or counts."""
    base = re.sub(r"\.[^./]+$", "", source)
    return base + {"results": "_RESULTS.csv", "deduped": "_DEDUPED.csv", "matched": "_MATCHED.csv", "nonmatched": "_NONMATCHED.csv", "rejects": "_REJECTS.csv", "dropped": "_DROPPED_RECORDS.csv", "counts": "_COUNTS.txt"}[kind]


def write_split(flagged: DataFrame, path: str, flag: str = "matched", **options) -> None:
    """Both sides of a split in one job, as folders flag=true and flag=false."""
    flagged.write.mode("overwrite").partitionBy(flag).options(header="true", emptyValue="", **options).csv(path)
