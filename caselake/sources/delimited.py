"""CSV and TSV readers and the snapshot writer. Every column is read as text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..fixed_values import DAILY_COLUMNS, PROVINCE_HEADERS
from ..session import materialize


#: A quote inside a quoted field is doubled, as common writers do.
_QUOTED = {"quote": '"', "escape": '"'}
#: Lines that one step over them in their order takes together: two to this power.
PIECE = 14


def read_columns_csv(spark: SparkSession, path, columns=tuple(DAILY_COLUMNS), order: str | None = None,
                     multiline: bool | None = None) -> DataFrame:
    """Header CSV, only the named columns, all text. The header line gives the names (one
    small read); no type inference pass over the data. Column pruning reaches the parser.
    ``order`` names an extra column that grows with file name and position in the file.

    ``multiline``: whether quoted fields may hold line breaks. Such files are read by ``read_records``, which
    stays split; unless the caller knows, one scan that only counts quotes finds out."""
    if multiline is None:
        multiline = not _lines(spark, path).filter(F.col("quotes") % 2 == 1).isEmpty()
    if multiline:
        return read_records(spark, path, columns, order)[0]
    df = spark.read.options(header=True, inferSchema=False, **_QUOTED).csv(path)
    _require(columns, df.columns)
    return df.select(*columns) if order is None else _in_file_order(spark, df, columns, order)


def _require(columns, found) -> None:
    if missing := [c for c in columns if c not in found]:
        raise ValueError(f"columns not in the file: {missing}")


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file, the start of their block in it, their number in the task, their piece of the block and
    their quotes."""
    line = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return spark.read.text(path).select(
        F.regexp_replace("_metadata.file_path", "^([^:/]*):/+", "$1:/").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        line.alias("line"), F.shiftright(line, PIECE).alias("piece"), F.col("value").alias("text"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def read_records(spark: SparkSession, path, columns=tuple(DAILY_COLUMNS), order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Header CSV whose quoted fields may hold line breaks, without giving a file to one task: the wanted
    columns as text, and the records that cannot be read (file, position, record, reason).

    A line begins a record where the quotes before it, from the start of the file, are even in number. Each
    piece of a block (``PIECE``) counts its own quotes; a running sum over the pieces (one row per piece) says how
    each begins, and a running sum inside each piece says it for its lines, so no task needs a whole block. Records
    of one line, nearly all, are parsed as they are; only the lines of longer ones are brought together, one small
    group per record. The lines are stored once, so that all steps see the same blocks; so are the rows per piece,
    so that the planner knows that they are few.

    Unreadable is a record with more fields than the header, and one whose quote does not close before the
    file ends. A record with fewer fields has nulls. Lines of white space between records go."""
    names = [_clean_header(c) for c in spark.read.options(header=True, inferSchema=False, multiLine=True, **_QUOTED).csv(path).columns]
    _require(columns, names)
    lines = materialize(_lines(spark, path), "csv-lines")
    place = ["file", "block", "piece"]
    in_file = Window.partitionBy("file").orderBy("block", "piece")
    pieces = materialize(lines.groupBy(place).agg(F.sum("quotes").alias("quotes_in")).select(
        *place, (F.coalesce(F.sum("quotes_in").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).alias("open"),
        (F.sum("quotes_in").over(in_file) % 2).alias("open_after"),
        (F.sum("quotes_in").over(Window.partitionBy("file")) % 2 == 1).alias("unclosed"),
        (F.row_number().over(in_file) == 1).alias("leads")), "csv-pieces")
    in_piece = Window.partitionBy(place).orderBy("line")
    placed = lines.join(pieces, place).withColumn("before", (F.col("open") + F.sum("quotes").over(in_piece) - F.col("quotes")) % 2)
    begun = placed.withColumns({
        "begins": F.col("before") == 0, "next_before": F.lead("before").over(in_piece), "last_line": F.lead("line").over(in_piece).isNull(),
        "header": F.col("leads") & F.lag("line").over(in_piece).isNull(),
        "start_line": F.max(F.when(F.col("before") == 0, F.col("line"))).over(in_piece)})
    begun = materialize(begun.withColumn("alone", F.col("begins") & (F.coalesce("next_before", F.when(F.col("last_line"), F.col("open_after"))) == 0)),
                        "csv-records")
    # A piece that begins inside a record belongs to the last record of the pieces before it that begins one.
    starts = begun.groupBy(place).agg(F.max("start_line").alias("last_start"))
    owner = materialize(starts.select(*place, F.max(F.when(F.col("last_start").isNotNull(), F.struct("block", "last_start"))).over(
        in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("owner")), "csv-owners")
    alone = begun.filter("alone").select("file", "block", "line", "text", F.lit(False).alias("unclosed"), "header")
    parts = begun.filter("not alone").join(owner, place)
    at = F.when(F.col("start_line").isNotNull(), F.struct("block", F.col("start_line").alias("last_start"))).otherwise(F.col("owner"))
    joined = parts.select("file", at.alias("at"), F.struct("block", "line", "text").alias("part"), "unclosed", "header").groupBy("file", "at").agg(
        F.array_sort(F.collect_list("part")).alias("parts"), F.max("unclosed").alias("of_unclosed"), F.max("header").alias("header")).select(
        "file", F.col("at.block").alias("block"), F.col("at.last_start").alias("line"), F.array_join("parts.text", "\n").alias("text"),
        # Of a file that ends inside quotes only the last record is the unclosed one: its own quotes are odd.
        (F.col("of_unclosed") & ((F.length(F.array_join("parts.text", "")) - F.length(F.replace(F.array_join("parts.text", ""), F.lit('"'), F.lit("")))) % 2
                                 == 1)).alias("unclosed"), "header")
    records = alone.unionByName(joined)
    # One more field than the header shows records that are too long.
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*names, "_more"])
    parsed = records.filter(~F.col("header") & (F.trim("text") != "")).withColumn(
        "_r", F.from_csv("text", schema, {**_QUOTED, "multiLine": "true"}))
    reason = F.when(F.col("unclosed"), "quote not closed").when(F.col("_r._more").isNotNull(), "more fields than the header")
    marked = parsed.withColumns({"reason": reason, "position": F.col("block") + F.col("line")})
    bad = marked.filter("reason is not null").select("file", "position", F.col("text").alias("record"), "reason")
    good = marked.filter("reason is null")
    fields = [F.col("_r").getField(c).alias(c) for c in columns]
    if order is None:
        return good.select(*fields), bad
    numbers = _file_numbers(spark, spark.read.text(path).inputFiles())
    numbered = good.join(numbers, good["file"] == numbers["_file"])
    return numbered.select((F.shiftleft("_file_no", 42) + F.col("position")).alias(order), *fields), bad


def _file_numbers(spark: SparkSession, files) -> DataFrame:
    """Place of each file among the sorted names. Spark writes one place in two ways, file:/a and file:///a."""
    return spark.createDataFrame([(re.sub("^([^:/]*):/+", r"\1:/", name), i) for i, name in enumerate(sorted(files))],
                                 "_file string, _file_no long")


def _in_file_order(spark: SparkSession, df: DataFrame, columns, order: str) -> DataFrame:
    """Number = file's place among the sorted names, then block start plus the row's place in its task.
    A row takes more than one byte, so rows of one block stay below the start of the next."""
    files = _file_numbers(spark, df.inputFiles())
    placed = df.select(
        *columns, F.regexp_replace("_metadata.file_path", "^([^:/]*):/+", "$1:/").alias("_file"), (F.col("_metadata.file_block_start") + (
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))).alias("_at"))
    numbered = placed.join(files, "_file", "left")
    return numbered.select((F.shiftleft(F.coalesce("_file_no", F.raise_error(F.concat(F.lit("unlisted file "), "_file")).cast(
        "long")), 42) + F.col("_at")).alias(order), *columns)


def first_existing(spark: SparkSession, paths) -> str:
    """The first path that exists on the cluster's file system."""
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(hadoop_path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


#: Bytes at a file's start that are looked at.
SNIFFED = 1 << 16


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """Encoding by the file's first bytes: a byte-order mark, else UTF-16 where nearly every second byte of
    many is zero or close to it (text in UTF-16 has its high bytes on one side), else UTF-8."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        start = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(
            spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, SNIFFED)))
    finally:
        stream.close()
    if start[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16LE" if start[0] == 0xFF else "UTF-16BE"
    even, odd = start[::2], start[1::2]
    if odd and 0 in start:
        # No byte of UTF-8 text is zero.
        return "UTF-16LE" if odd.count(0) >= even.count(0) else "UTF-16BE"
    return "UTF-8"


def check_encoding(spark: SparkSession, path: str, encoding: str) -> tuple[int, str] | None:
    """Place (start of block plus number of the line in its task) and text of the first line whose bytes are
    not valid in the encoding, or None. One scan of the file."""
    if encoding == "UTF-8":
        lines, wrong = spark.read.text(path), ~F.is_valid_utf8("value")
    else:
        # The reader puts U+FFFD in place of what it cannot decode.
        lines = spark.read.options(sep="\x01", quote="", encoding=encoding, lineSep="\n").schema("value string").csv(path)
        wrong = F.col("value").contains("\ufffd")
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    first = lines.withColumn("place", place).filter(wrong).select("place", F.make_valid_utf8("value").alias("value")).orderBy("place").first()
    return None if first is None else (first.place, first.value)


def _data_files(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the files of a folder that Spark would read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(where).isFile():
        return [path]
    return sorted(s.getPath().toString() for s in fs.listStatus(where)
                  if s.isFile() and s.getPath().getName()[0] not in "._" and s.getLen() > 0)


def _clean_header(name: str) -> str:
    return name.strip("\ufeff\r\n ")


def read_tsv(spark: SparkSession, path: str, rename=None, encoding: str | None = None, fallbacks=()) -> DataFrame:
    """Tab-separated text in UTF-16 or UTF-8 (with or without mark), headers renamed. Each file of a
    folder is read in its own encoding; columns are matched by their names.

    Every file is checked before it is read: bytes that are not valid in its encoding make the reader try the
    ``fallbacks`` in their order (such as ISO-8859-1), and without one that fits the run fails and names
    file and line. A given ``encoding`` is taken as it is.

    The line separator is given in the file's own encoding, so UTF-16 files split like any
    other text; the alternative, ``multiLine``, would push each file through one task."""
    rename = PROVINCE_HEADERS if rename is None else rename
    if encoding is not None:
        return _read_encoded(spark, [path], rename, encoding)
    by_encoding: dict[str, list[str]] = {}
    for file in _data_files(spark, path):
        by_encoding.setdefault(_valid_encoding(spark, file, fallbacks), []).append(file)
    parts = [_read_encoded(spark, files, rename, kind) for kind, files in sorted(by_encoding.items())]
    return reduce(DataFrame.unionByName, parts)


def _valid_encoding(spark: SparkSession, file: str, fallbacks) -> str:
    faults = []
    for kind in dict.fromkeys([sniff_encoding(spark, file), *fallbacks]):
        fault = check_encoding(spark, file, kind)
        if fault is None:
            return kind
        faults.append(f"{kind} at {fault[0]}: {fault[1][:80]!r}")
    raise ValueError(f"{file} has bytes that are not valid text; " + "; ".join(faults))


def _read_encoded(spark: SparkSession, paths: list[str], rename, encoding: str) -> DataFrame:
    df = (
        spark.read.option("sep", "\t").option("header", True).option("inferSchema", False)
        .option("encoding", encoding).option("lineSep", "\n").csv(paths)
    )
    names = [rename.get(_clean_header(c), _clean_header(c)) for c in df.columns]
    df = df.toDF(*names)
    return df.withColumn(names[-1], F.rtrim(F.col(names[-1]), F.lit("\r"))) if names else df


#: What spreadsheet programs expect at the start of a UTF-8 file.
MARK = "\ufeff"


def write_csv_snapshot(df: DataFrame, path: str, source_url: str, snapshot_date: Column) -> None:
    """Cleaned rows plus provenance as header CSV in UTF-8, each file with a byte-order mark (one file per
    partition). The mark is the begin of the first header name, which the reader drops."""
    rows = df.withColumn("source_url", F.lit(source_url)).withColumn("snapshot_date", snapshot_date)
    first = rows.columns[0]
    rows.withColumnRenamed(first, MARK + first).write.options(header=True, encoding="UTF-8", **_QUOTED).csv(path)


def read_csv_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The header line of each file is skipped; the names are those of the schema."""
    return spark.read.schema(schema).options(header=True, enforceSchema=True, **_QUOTED).csv(path)
