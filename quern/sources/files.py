"""File sources and sinks: manifests of folders, JSON lines, HTML text, writes that can be repeated."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of files that are read, and those of their sidecars, which are not.
SUFFIXES = ("pdf", "doc", "docx", "html", "htm", "txt", "json")
#: Rows longer than this are refused.
LONGEST_ROW = 24 * 1024 * 1024

_DROP = re.compile(r"(?is)<(script|style|noscript|svg|nav|footer|template|head)\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/td|/th|/section|/article)\b[^>]*>")
_TAG = re.compile(r"(?s)<[^>]*>")


def manifest(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(file_id, relative_path, filename, extension, size_bytes, sha256) of every file below ``folder``.

    Files are read by the tasks, one at a time; other suffixes and ``*.meta.json``
    sidecars are left out before their content is read.
    """
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    kept = files.where(extension.isin(*suffixes) & ~F.lower(name).endswith(".meta.json"))
    at = F.instr("path", root)
    rows = kept.select("path", name.alias("filename"), extension.alias("extension"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), at.alias("at"))
    relative = F.substr("path", F.col("at") + len(root))
    return rows.select(F.concat(F.lit("file_"), F.substring(F.sha1(F.concat_ws("|", relative, "sha256")), 1, 16)).alias("file_id"), relative.alias("relative_path"), "filename", "extension", "size_bytes", "sha256")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, longest: int = LONGEST_ROW) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of JSON lines by a given schema.

    Rejected (line, reason): no JSON object, or longer than ``longest`` bytes. Blank lines are neither.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", (F.octet_length("value") > longest).alias("long"), F.from_json("value", T.StructType([*schema.fields, T.StructField("__bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("row"))
    bad = F.col("long") | F.col("row").isNull() | F.col("row.__bad").isNotNull() | ~F.ltrim("value").startswith("{")
    names = [f.name for f in schema.fields]
    rejected = parsed.where(bad).select(F.col("value").alias("line"), F.when(F.col("long"), "TOO_LONG").otherwise("NO_OBJECT").alias("reason"))
    return parsed.where(~bad).select(*[F.col(f"row.{n}").alias(n) for n in names]), rejected


def visible_text(raw: str | None) -> str | None:
    """Text of an HTML page without scripts, styles, navigation and footers; one line per block, no blank lines."""
    if raw is None:
        return None
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", raw)))
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def visible_texts(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text) of HTML pages; NULL stays NULL."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(x) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, text string")


def write_new(df: DataFrame, path: str, key: list[str], settings: str) -> int:
    """Appends the rows whose key was not written with these ``settings`` before; returns how many.

    Rows lie in a folder per settings hash, so a repeated or resumed run writes
    nothing twice and other settings start anew.
    """
    import hashlib

    target = f"{path.rstrip('/')}/settings={hashlib.sha256(settings.encode()).hexdigest()[:16]}"
    try:
        done = df.sparkSession.read.parquet(target).select(*key).distinct()
        fresh = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df
    observed = F.count(F.lit(1)).alias("n")
    from pyspark.sql import Observation

    seen = Observation("written")
    fresh.observe(seen, observed).write.mode("append").parquet(target)
    return int(seen.get["n"])


def bounded(df: DataFrame, n: int | None) -> tuple[DataFrame, str]:
    """At most ``n`` rows and how the scan is to be called: FULL_SCAN or BOUNDED_SCAN."""
    return (df, "FULL_SCAN") if n is None else (df.limit(n), "BOUNDED_SCAN")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
