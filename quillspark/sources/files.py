"""File sources: discovery, validation, decoding, PDF text, evaluation sets, profiles."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SUFFIXES = ("txt", "md", "markdown", "pdf")
MOST_BYTES = 25 * 1024 * 1024
LEAST_CHARS = 40


def discover(spark: SparkSession, *paths: str) -> DataFrame:
    """Files below the paths as path, filename, suffix, modified_at, size_bytes, content.

    A file that several of the paths lead to comes once: paths below others are left out, so that no
    content has to be shuffled to find it twice.
    """
    paths = outermost(paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = reader.load(list(paths)).unionByName(_empty_files(spark, paths))
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "content")


def outermost(paths: tuple[str, ...]) -> tuple[str, ...]:
    """The paths, without those that lie below another one or repeat it."""
    out: list[str] = []
    for path in sorted({p.rstrip("/") or "/" for p in paths}, key=lambda p: (p.count("/"), p)):
        if not any(path == root or path.startswith(root.rstrip("/") + "/") for root in out):
            out.append(path)
    return tuple(out)


def _empty_files(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """Files without bytes, which a scan leaves out, from the file system's listing."""
    hadoop, conf, rows = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in map(hadoop.Path, paths):
        found = path.getFileSystem(conf).listFiles(path, True)
        while found.hasNext():
            status = found.next()
            if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
                rows.append((status.getPath().toString(), status.getModificationTime() / 1000))
    listed = spark.createDataFrame(rows, "path string, seconds double")
    return listed.select("path", F.timestamp_seconds("seconds").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def describe(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Checksum, descriptor id and an error code for files that cannot be read; ING-006 is a file of more than `most_bytes`."""
    error = F.when(~F.col("suffix").isin(*SUFFIXES), "ING-001").when(F.col("size_bytes") == 0, "ING-005").when(F.col("size_bytes") > most_bytes, "ING-006")
    checked = files.withColumns({"file_checksum": F.sha2("content", 256), "error": error})
    return checked.withColumn("descriptor_id", T.artifact_id("docume", "DocumentDescriptor", F.col("path"), F.col("file_checksum")))


def decode(content: Column) -> Column:
    """S3: UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def pdf_text(content: bytes) -> str | None:
    """Text of a PDF by whichever library is there; None without one or without text."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        return "\n\n".join(filter(None, (page.extract_text() for page in PdfReader(io.BytesIO(content)).pages))) or None
    except Exception:  # a broken file has no text
        return None


def load_texts(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine). Errors never end a load; they are rows of the quarantine."""

    @F.pandas_udf("string")
    def extracted(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: None if x is None else pdf_text(x))

    is_pdf = F.col("suffix") == "pdf"
    rows = described.where("error IS NULL")
    # contents stay where they were read: what is no PDF goes through the function as null
    raw = F.when(is_pdf, extracted(F.when(is_pdf, F.col("content")))).otherwise(decode(F.col("content")))
    rows = rows.withColumn("raw", raw).withColumn("text", T.normalize(F.coalesce("raw", F.lit(""))))
    error = F.when((F.col("suffix") == "pdf") & F.col("raw").isNull(), "ING-002").when(F.length(T.strip(F.col("text"))) < LEAST_CHARS, "ING-007")
    rows = rows.withColumn("error", error)
    keep = ["path", "filename", "suffix", "modified_at", "size_bytes", "file_checksum", "descriptor_id"]
    good = rows.where("error IS NULL").select(*keep, "text", T.document_id(F.col("descriptor_id"), F.col("filename")).alias("document_id"))
    bad = described.where("error IS NOT NULL").select(*keep, "error").unionByName(rows.where("error IS NOT NULL").select(*keep, "error"))
    return good, bad


PROBES = "corpus string, language string, version string, questions array<struct<id:string,question:string,must_contain:array<string>,must_not_contain:array<string>,match:string,expected_source:string,unanswerable:boolean,note:string>>"


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Probes with their defaults."""
    raw = spark.read.schema(PROBES).option("multiLine", True).json(path)
    rows = raw.select("language", F.explode("questions").alias("q")).select("language", "q.*")
    none = F.array().cast("array<string>")
    out = rows.withColumns({"must_contain": F.coalesce("must_contain", none), "must_not_contain": F.coalesce("must_not_contain", none), "match": F.coalesce("match", F.lit("all")), "unanswerable": F.coalesce("unanswerable", F.lit(False))})
    if raw.limit(1).count() == 0:
        raise ValueError("EVAL-001: no evaluation set at the path")
    if out.limit(1).count() == 0:
        raise ValueError("EVAL-002: the evaluation set has no questions")
    return out


def _value(text: str):
    text = text.split(" #")[0].strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    named = {"": None, "null": None, "~": None, "true": True, "false": False, "[]": [], "{}": {}}
    if text.lower() in named:
        return named[text.lower()]
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",")]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_profile(text: str) -> dict:
    """The subset of YAML that profiles use: nested maps, lists and scalars by indentation."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, indent: int):
        out = [] if rows[at][1].startswith("- ") else {}
        while at < len(rows) and rows[at][0] == indent:
            body = rows[at][1]
            if isinstance(out, list):
                out.append(_value(body[2:]))
                at += 1
                continue
            key, _, rest = body.partition(":")
            at += 1
            if rest.strip() and not rest.strip().startswith("#"):
                out[key.strip()] = _value(rest)
            elif at < len(rows) and (rows[at][0] > indent or (rows[at][0] == indent and rows[at][1].startswith("- "))):
                out[key.strip()], at = block(at, rows[at][0])
            else:
                out[key.strip()] = None
        return out, at

    return block(0, rows[0][0])[0] if rows else {}


def deep_merge(base: dict, over: dict) -> dict:
    return {**base, **{k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def load_profile(path: str, base: dict | None = None) -> dict:
    """A profile over its defaults; the required parts are checked."""
    profile = deep_merge(base or {}, parse_profile(Path(path).read_text()))
    for part in ("id", "model", "inference"):
        if part not in profile:
            raise ValueError(f"RPCB-001: profile lacks {part!r}")
    return profile
