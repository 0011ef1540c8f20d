"""CSV files: two contracts of reading, previews, and rows by ordinal."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.base import SourceError, parse_files

MAX_SOURCE, MAX_COLUMNS, PREVIEW = 8 << 20, 32, 10


def records(text: str, contract: str = "2") -> list[list[str]]:
    """All records. Contract 1 splits lines first, so a line end inside quotes is lost; 2 keeps it and is strict."""
    if contract == "1":
        return list(csv.reader(text.splitlines()))
    if contract != "2":
        raise SourceError("UNSUPPORTED_CONTRACT")
    try:
        return list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except csv.Error:
        raise SourceError("CSV_INVALID") from None


def _text(payload: bytes) -> str:
    if len(payload) > MAX_SOURCE:
        raise SourceError("SOURCE_TOO_LARGE")
    return payload.decode("utf-8-sig")


def csv_rows(files: DataFrame, contract: str = "2", max_columns: int = MAX_COLUMNS) -> DataFrame:
    """(path, source_sha256, error, row_index, cells, clipped): the rows below the header, from 0; the header is row -1."""

    def rows(name, payload):
        found = records(_text(payload), contract)
        if not found:
            raise SourceError("CSV_EMPTY")
        for i, r in enumerate(found, -1):
            yield i, r[:max_columns], len(r) > max_columns

    return parse_files(files, "row_index long, cells array<string>, clipped boolean", rows)


def csv_profiles(rows: DataFrame) -> DataFrame:
    """(source_sha256, header, row_count, preview): the first rows as maps; of equal headers the last counts.

    Needs spark.sql.mapKeyDedupPolicy=LAST_WIN, which ``quire.session`` sets.
    """
    good = rows.filter("error is null")
    header = good.filter("row_index = -1").select("source_sha256", F.col("cells").alias("header"))
    counts = good.groupBy("source_sha256").agg((F.count(F.lit(1)) - 1).alias("row_count"))
    head = good.filter((F.col("row_index") >= 0) & (F.col("row_index") < PREVIEW)).join(header, "source_sha256")
    n = F.least(F.size("header"), F.size("cells"))
    one = F.map_from_arrays(F.slice("header", F.lit(1), n), F.slice("cells", F.lit(1), n))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.to_json(one).alias("row")))), lambda x: x["row"])
    preview = head.groupBy("source_sha256").agg(listed.alias("preview"))
    return header.join(counts, "source_sha256").join(preview, "source_sha256", "left")
