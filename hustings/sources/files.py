"""File readers (IO1-IO4, IO12)."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import missing_to_null
from ..session import written

# Fixed pattern: raw files are named <entity>_<cycle>_table<n>.csv.
RAW_NAME = r"^([a-z]+)_(\d{4})_table\d+\.csv$"
# The printable characters windows-1252 puts where ISO-8859-1 has control codes, and its unused codes.
C1_CODES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
C1_PRINTED = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
C1_UNUSED = "[\x81\x8d\x8f\x90\x9d]"


class SourceError(ValueError):
    pass


def require_columns(df: DataFrame, columns: list[str], name: str = "input") -> DataFrame:
    """IO4: fail while the plan is built when columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SourceError(f"missing columns in {name}: {missing}")
    return df


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str | None = None, required: list[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """IO2 / IO4 / IO12: headed CSV with a declared schema; columns are matched by name.

    Files are read as text by their own header, then cast: strict for declared types, so bad numbers fail the job.
    A missing path fails when the plan is analysed. A byte-order mark before the first header is dropped.
    ``multi_line`` lets a quoted cell span lines, which ties a file to one task.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, inferSchema=False)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    if schema is None:
        return require_columns(raw, required or [])
    fields = [part.split(None, 1) for part in schema.split(",")]
    require_columns(raw, required if required is not None else [n for n, _ in (f for f in fields)])
    present = [(n, t) for n, t in fields if n in raw.columns]
    return raw.select(*[_strict_cast(F.col(f"`{n}`"), t.strip()).alias(n) for n, t in present])


def _strict_cast(col, kind: str):
    value = missing_to_null(col) if kind != "string" else col
    if kind in ("int", "bigint"):
        return F.regexp_replace(value, r"\.0+$", "").cast(kind)  # years may be stored as 2010.0; 2010.7 is an error
    return value.cast(kind)


def read_many(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """IO2: several cleaned files or folders of one schema, appended by name."""
    frames = [read_csv(spark, p, schema) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_raw_rows(
    spark: SparkSession, path: str | list[str], max_columns: int = 64, name_pattern: str = RAW_NAME, multi_line: bool = False,
    by_folder: bool = False,
) -> DataFrame:
    """IO1: every line of many wide files with differing headers; entity and cycle come from the file name.

    All files share one all-text schema; ragged lines are padded with NULL and cut to the file's own width. A file of
    more than ``max_columns`` columns is an error, also when the columns beyond are blank. ``multi_line`` lets a quoted
    cell span lines, which ties a file to one task.
    ``by_folder`` takes the table's name from a ``source_table=`` folder instead.
    """
    schema = ", ".join(f"c{i} string" for i in range(max_columns + 1)) + ", _line string" + (", source_table string" if by_folder else "")
    read = (
        spark.read.schema(schema)
        .csv(path, header=False, multiLine=multi_line, quote='"', escape='"', ignoreLeadingWhiteSpace=False, columnNameOfCorruptRecord="_line")
        .withColumns({"_file": F.col("_metadata.file_name"), "_id": F.monotonically_increasing_id()})
        .where(F.col("_file").rlike(name_pattern))
    )
    if not by_folder:
        read = read.withColumn("source_table", F.col("_file"))
    places = F.array(*[F.when(F.col(f"c{i}").isNotNull(), F.lit(i + 1)) for i in range(max_columns + 1)])
    # A line with another number of cells than the schema comes whole as well.
    cells = F.size(F.split(F.regexp_replace("_line", '"[^"]*"', ""), ","))
    lines = read.select(
        "source_table", "_id", F.array(*[f"c{i}" for i in range(max_columns + 1)]).alias("cells"),
        F.greatest(F.coalesce(F.array_max(places), F.lit(0)), F.when(cells > max_columns, cells)).alias("_width"),
    )
    files = lines.groupBy("source_table").agg(F.min("_id").alias("_first"), F.max("_width").alias("_cols"))
    too_wide = F.raise_error(F.concat(F.lit("more columns than max_columns in "), F.col("source_table")))
    width = F.when(F.col("_cols") > max_columns, too_wide.cast("int")).otherwise(F.col("_cols"))
    return lines.join(files, "source_table").select(
        "source_table",
        F.regexp_extract("source_table", RAW_NAME if by_folder else name_pattern, 1).alias("country"),
        F.regexp_extract("source_table", RAW_NAME if by_folder else name_pattern, 2).cast("int").alias("election_year"),
        (F.col("_id") - F.col("_first")).alias("row_idx"),
        F.slice("cells", F.lit(1), width).alias("cells"),
    )


def _encoding(valid: Column, unused: Column) -> Column:
    return F.when(valid, "utf-8").when(unused, "iso-8859-1").otherwise("windows-1252")


def file_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """IO3: (path, encoding) of each file, tried in the order utf-8, windows-1252, ISO-8859-1.

    Lines are judged where they are read and each file's verdicts are combined, so a file may be split among tasks.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return _file_encodings(lines)


def _file_encodings(lines: DataFrame) -> DataFrame:
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    judged = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("_valid"), F.bool_or(latin.rlike(C1_UNUSED)).alias("_unused"))
    return judged.select("path", _encoding(F.col("_valid"), F.col("_unused")).alias("encoding"))


def decoded(raw: Column, encoding: Column) -> Column:
    """Text of raw bytes; windows-1252 is ISO-8859-1 with its control codes turned into the characters meant."""
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    return F.when(encoding == "utf-8", raw).when(encoding == "windows-1252", F.translate(latin, C1_CODES, C1_PRINTED)).otherwise(latin)


def read_csv_any_encoding(spark: SparkSession, path: str | list[str], most_headers: int = 1000) -> DataFrame:
    """IO3 / IO12: headed CSV files of mixed encodings as one text frame, appended by column name.

    Files are read by lines, so a large one is split among tasks; a quoted cell does not span lines here. Each file's
    encoding is joined to its lines and never passes the driver; only the distinct header lines do, which are the
    columns of the result (more than ``most_headers`` are an error). A byte-order mark before a header is dropped.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value",
    )
    head = F.min(F.when(F.col("_block") == 0, F.struct("_id", "value")))
    files = written(_file_encodings(lines).join(lines.groupBy("path").agg(head.alias("_head")), "path"), "encodings")
    header = F.regexp_replace(decoded(F.col("_head.value"), F.col("encoding")), "^(\ufeff|\u00ef\u00bb\u00bf)", "")
    files = files.select("path", "encoding", F.col("_head._id").alias("_at"), F.rtrim(F.regexp_replace(header, "\r$", "")).alias("_header"))
    headers = sorted(r[0] for r in files.select("_header").distinct().limit(most_headers + 1).collect())
    if not headers:
        raise SourceError(f"no files under {path}")
    if len(headers) > most_headers:
        raise SourceError(f"more than {most_headers} different headers under {path}")
    rows = lines.join(files, "path")
    out = None
    for line in headers:
        names = [n.strip() for n in next(csv.reader([line]))]
        schema = ", ".join(f"c{i} string" for i in range(len(names)))
        own = rows.where((F.col("_header") == line) & (F.col("_id") != F.col("_at"))).select(F.regexp_replace(decoded(F.col("value"), F.col("encoding")), "\r$", "").alias("_text"))
        cells = own.where(F.col("_text") != "").select(F.from_csv("_text", schema, {"quote": '"', "escape": '"'}).alias("_c"))
        part = cells.select(*[F.col(f"_c.c{i}").alias(n) for i, n in enumerate(names)])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
