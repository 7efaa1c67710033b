"""Station files and the artefact registry."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that older files use for a parameter.
ALIASES = {"RR": "R1", "FF": "F", "DD": "D"}


def parameters(names: Sequence[str], known: Sequence[str]) -> list[str]:
    """Aliases resolved, unknown names dropped; ValueError if none is left."""
    found = [ALIASES.get(n, n) for n in names if ALIASES.get(n, n) in known]
    if not found:
        raise ValueError(f"none of {list(names)} is known")
    return list(dict.fromkeys(found))


def compact_ts(text: Column) -> Column:
    """yyyyMMddHH or yyyyMMddHHmm by length; null for anything else."""
    t = F.trim(text.cast("string"))
    full = F.when(F.length(t) == 12, t).when(F.length(t) == 10, F.concat(t, F.lit("00")))
    return F.try_to_timestamp(full, F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")


def padded_id(c: Column, width: int = 5) -> Column:
    return F.lpad(F.trim(c.cast("string")), width, "0")


def read_semicolon(spark: SparkSession, path: str, values: Sequence[str], keep_files: str | None = None) -> DataFrame:
    """Semicolon text files below a folder: station_id, ts and the values as double; codes for missing data are null.

    ``keep_files`` is a pattern of file names: others are never opened.
    """
    reader = spark.read.options(sep=";", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, recursiveFileLookup=True)
    raw = (reader.option("pathGlobFilter", keep_files) if keep_files else reader).csv(path)
    number = lambda c: F.when(~F.col(c).isin("-999", "-9999", ""), F.col(c)).try_cast("double")
    return raw.select(padded_id(F.col("STATIONS_ID")).alias("station_id"), compact_ts(F.col("MESS_DATUM")).alias("ts"), *[number(c).alias(c) for c in values])


def read_fixed_width(spark: SparkSession, path: str, widths: Sequence[int], names: Sequence[str], skip: int = 2, encoding: str = "ISO-8859-1") -> DataFrame:
    """Fixed-width text: trimmed strings of the lines behind the first ``skip`` of each file; blank lines go.

    Files are read whole, one row each, as their encoding asks; they are lists of stations, small.
    """
    lines = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(F.decode("content", encoding), "\r?\n")).alias("at", "value"))
    rows, place, out = lines.filter((F.col("at") >= skip) & (F.trim("value") != "")), 1, []
    for width, name in zip(widths, names, strict=True):
        out.append(F.trim(F.substring("value", place, width)).alias(name))
        place += width
    return rows.select(*out)


def read_registry(spark: SparkSession, path: str, names: Sequence[str] = ("S", "key", "topic", "ext")) -> DataFrame:
    """Tab-separated lines without comments (whole lines or from a # on) and blank lines."""
    text = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(text.alias("v")).filter("v <> ''").select(F.split("v", r"\t+").alias("p"))
    rows = rows.filter(F.col("p")[0] != names[0])
    return rows.select(*[F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)])


def registry_paths(df: DataFrame, root: str, folder: Column, key: Column, ext: Column) -> DataFrame:
    """A path for each entry: a folder has no extension."""
    name = F.when(ext == "dir", key).otherwise(F.concat_ws(".", key, ext))
    return df.withColumn("path", F.concat_ws("/", F.lit(root), folder, name))


def scenes(items: DataFrame, most_cloud: float) -> DataFrame:
    """Items (id, datetime, cloud, assets: map of name to link) under a cloud limit, one row for each asset."""
    kept = items.filter(F.col("cloud") < most_cloud)
    return kept.select("id", "datetime", "cloud", F.explode("assets").alias("asset", "href"))


def time_in_name(path: Column, pattern: str = r"(\d{10})") -> Column:
    """A radar composite's time from its file name, yyMMddHHmm."""
    return F.try_to_timestamp(F.regexp_extract(path, pattern, 1), F.lit("yyMMddHHmm")).cast("timestamp_ntz")


def files_of(ids: Sequence[str], before: str = "*", after: str = "*") -> str:
    """A pattern of file names that hold one of the ids, for ``keep_files``: files of other stations are never opened."""
    if not ids:
        raise ValueError("no ids")
    return f"{before}{{{','.join(ids)}}}{after}"


def read_zip_members(spark: SparkSession, path: str, member: str, keep_files: str = "*.zip", encoding: str = "ISO-8859-1", lines_at_once: int = 10_000) -> DataFrame:
    """archive, member, at (line number from 0), line: the text members of a name pattern in all archives below a folder.

    Archives are read one at a time in the tasks, lines a batch at a time; an
    archive without such a member gives no row, a damaged one fails the job.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", keep_files).load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                    for found in sorted(fnmatch.filter(archive.namelist(), member)):
                        with archive.open(found) as raw:
                            lines, at = io.TextIOWrapper(raw, encoding), 0
                            while part := [line.rstrip("\r\n") for _, line in zip(range(lines_at_once), lines)]:
                                yield pa.RecordBatch.from_pydict({"archive": [name] * len(part), "member": [found] * len(part), "at": pa.array(range(at, at + len(part)), pa.int64()), "line": part})
                                at += len(part)

    return archives.mapInArrow(read, "archive string, member string, at long, line string")


def split_semicolon(lines: DataFrame, names: Sequence[str], line: str = "line") -> DataFrame:
    """The fields of semicolon text behind each file's header: trimmed strings by position; codes for missing data are null."""
    fields = F.split(line, ";")
    value = lambda i: F.trim(F.get(fields, F.lit(i)))
    kept = lines.filter((F.col("at") > 0) & (F.trim(line) != ""))
    return kept.select("archive", "member", *[F.when(~value(i).isin("-999", "-9999", ""), value(i)).alias(n) for i, n in enumerate(names)])


def composites(files: DataFrame, start: str, end: str, path: str = "path", pattern: str = r"(\d{10})") -> DataFrame:
    """Files whose name's time lies in a closed range, with that time as ``ts``; names without a time go."""
    timed = files.withColumn("ts", time_in_name(F.col(path), pattern))
    return timed.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
