"""Which format a file has, by its suffix alone, and what reads it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PORTABLE = {
    ".txt": "lines", ".md": "lines", ".markdown": "lines", ".log": "lines", ".tsv": "lines", ".json": "json", ".jsonl": "json",
    ".html": "html", ".htm": "html", ".odt": "odf", ".ods": "odf", ".odp": "odf", ".eml": "eml", ".epub": "epub", ".srt": "cues", ".vtt": "cues",
}
PROJECTED = {".csv": "csv", ".xlsx": "xlsx", ".docx": "docx", ".pptx": "pptx", ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image"}
ARCHIVES = {".zip": "archive", ".tar": "archive", ".gz": "archive", ".bz2": "archive", ".xz": "archive", ".tgz": "archive"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of the files under a path or glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def parser_of(path: str = "path") -> Column:
    """What reads a file of that name, or null."""
    parsers = F.create_map(*(F.lit(x) for kv in {**PORTABLE, **PROJECTED, **ARCHIVES}.items() for x in kv))
    return F.try_element_at(parsers, F.lower(F.regexp_extract(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(\.[^.]*)$", 1)))


def inspect_files(files: DataFrame) -> DataFrame:
    """(path, name, size_bytes, source_sha256, suffix, parser, admission); the content isn't judged."""
    known = {**PORTABLE, **PROJECTED, **ARCHIVES}
    parser = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    admission = F.create_map(
        *(F.lit(x) for s in known for x in (s, "portable" if s in PORTABLE else "projection" if s in PROJECTED else "optional_backend"))
    )
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    rows = files.withColumn("name", F.regexp_extract("path", r"([^/\\]*)$", 1)).withColumn("suffix", suffix)
    size = F.octet_length("content")
    return rows.select(
        "path", "name", size.alias("size_bytes"), F.sha2("content", 256).alias("source_sha256"), "suffix",
        F.try_element_at(parser, F.col("suffix")).alias("parser"),
        F.when(size == 0, "empty").otherwise(F.coalesce(F.try_element_at(admission, F.col("suffix")), F.lit("unsupported"))).alias("admission"),
    )
