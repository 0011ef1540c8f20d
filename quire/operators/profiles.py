"""Differences of normalised profiles: trees shredded to leaves, joined on their paths."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import collapse, strip

MAX_DEPTH, MAX_NODES, MAX_STRING, MAX_ARRAY = 20, 5000, 4096, 500


def normalized(value: Column, mode: str) -> Column:
    """A string leaf for comparison: exact, trim, collapse_whitespace or casefold."""
    if mode == "trim":
        return strip(value)
    if mode == "collapse_whitespace":
        return collapse(value)
    if mode == "casefold":
        from quire.functions.python import casefold

        return casefold(value)
    if mode != "exact":
        raise ValueError(f"unknown normalization {mode!r}")
    return value


def leaf_diff(before: DataFrame, after: DataFrame, key: list[str], mode: str = "exact") -> DataFrame:
    """Compare leaves (key..., path, type, value): added, removed, type_changed, changed.

    One full outer equi-join on key and path. Strings are compared after normalisation; what is
    reported is raw.
    """
    a = before.select(*key, "path", F.col("type").alias("before_type"), F.col("value").alias("before_value"))
    b = after.select(*key, "path", F.col("type").alias("after_type"), F.col("value").alias("after_value"))
    joined = a.join(b, [*key, "path"], "full_outer")
    text = (F.col("before_type") == "str") & (F.col("after_type") == "str")
    same = F.when(text, normalized(F.col("before_value"), mode).eqNullSafe(normalized(F.col("after_value"), mode))).otherwise(
        F.col("before_value").eqNullSafe(F.col("after_value"))
    )
    kind = (
        F.when(F.col("before_type").isNull(), "added")
        .when(F.col("after_type").isNull(), "removed")
        .when(F.col("before_type") != F.col("after_type"), "type_changed")
        .when(~same, "changed")
    )
    return joined.withColumn("kind", kind).filter("kind is not null")


def shred(value, path: str = "", depth: int = 0, keyed: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """The leaves of a JSON value as (path, type, text); empty containers are leaves.

    ``keyed`` names, by path, the field that identifies the rows of an array.
    """
    found: list[tuple[str, str, str]] = []
    _shred(value, path, depth, keyed, found)
    return found


def _part(name) -> str:
    text = str(name)
    return text.replace("~", "~0").replace("/", "~1") if "~" in text or "/" in text else text


def _shred(value, path: str, depth: int, keyed: dict[str, str] | None, found: list) -> None:
    if depth > MAX_DEPTH:
        raise ValueError("PROFILE_DEPTH_LIMIT")
    if isinstance(value, dict) and value:
        for k in value:
            _shred(value[k], f"{path}/{_part(k)}", depth + 1, keyed, found)
    elif isinstance(value, list) and (value or path in (keyed or {})):
        if len(value) > MAX_ARRAY:
            raise ValueError("PROFILE_ARRAY_LIMIT")
        name, seen = (keyed or {}).get(path), set()
        for i, item in enumerate(value):
            if name is None:
                _shred(item, f"{path}/{i}", depth + 1, keyed, found)
                continue
            k = item.get(name) if isinstance(item, dict) else None
            if isinstance(k, bool) or not isinstance(k, (str, int)) or (type(k), k) in seen:
                raise ValueError("PROFILE_ARRAY_KEY")
            seen.add((type(k), k))
            _shred(item, f"{path}/@{_part(k)}", depth + 1, keyed, found)
    else:
        if isinstance(value, str) and len(value) > MAX_STRING:
            raise ValueError("PROFILE_STRING_LIMIT")
        kind = type(value)
        found.append((path, kind.__name__, value if kind is str else str(value) if kind is int else json.dumps(value, ensure_ascii=False)))


def resolves(value, path: str) -> bool:
    """Whether a key path leads to an array; ``*`` stands for any row of an array above it."""
    held = [value]
    for part in [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]:
        held = [x for v in held for x in (v if part == "*" and isinstance(v, list) else [v[part]] if isinstance(v, dict) and part in v else [])]
    return any(isinstance(v, list) for v in held)


def unresolved_keys(pairs: DataFrame, keyed: dict[str, str]) -> DataFrame:
    """(id, path): declared key paths that lead to an array on neither side of pairs (id, before, after)."""

    @F.pandas_udf("array<string>")
    def missing(a: pd.Series, b: pd.Series) -> pd.Series:
        def load(text):
            try:
                return json.loads(text)
            except (TypeError, ValueError):
                return None

        sides = ((load(x), load(y)) for x, y in zip(a, b))
        return pd.Series([[p for p in keyed if not resolves(x, p) and not resolves(y, p)] for x, y in sides])

    return pairs.select("id", F.explode(missing("before", "after")).alias("path"))


def limited_changes(changes: DataFrame, key: list[str], limit: int = 500) -> DataFrame:
    """(key..., total, truncated, changes): at most ``limit`` changes of each group in order of their paths, with the exact number of all.

    A group's list is bounded: what is beyond the limit is dropped before the lists are made, and counted.
    """
    nth = F.row_number().over(W.partitionBy(*key).orderBy("path", "kind"))
    ranked = changes.withColumn("__n", nth).filter(F.col("__n") <= limit)
    one = F.struct("path", "kind", "before_value", "after_value")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__n", one.alias("c")))), lambda x: x["c"])
    lists = ranked.groupBy(*key).agg(listed.alias("changes"))
    totals = changes.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    return totals.join(lists, key).select(*key, "total", (F.col("total") > limit).alias("truncated"), "changes")


def shred_profiles(profiles: DataFrame, keyed: dict[str, str] | None = None) -> DataFrame:
    """Leaves (id, path, type, value, error) of profiles (id, json), a row each as the worker makes them; a profile without leaves is a row with none."""

    def leaves(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b["json"].to_pylist()):
                error, found = None, []
                try:
                    found = shred(json.loads(text), "", 0, keyed)
                    if len(found) > MAX_NODES:
                        error, found = "PROFILE_NODE_LIMIT", []
                except ValueError as e:
                    error = str(e)[:60]
                rows += [(*leaf, None) for leaf in found] or [(None, None, None, error)]
                at += [i] * max(1, len(found))
            columns = [pa.array(c, pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, pa.int64())), *columns], ["id", "path", "type", "value", "error"])

    rows = profiles.select("id", F.col("json").cast("string").alias("json"))
    fields = [T.StructField(c, T.StringType()) for c in ("path", "type", "value", "error")]
    return rows.mapInArrow(leaves, T.StructType([T.StructField("id", rows.schema["id"].dataType), *fields]))
