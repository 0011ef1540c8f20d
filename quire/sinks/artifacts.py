"""Stores of artifacts: created once by name, or addressed by content."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import artifact_id


def record_status(outputs: DataFrame, store: DataFrame) -> DataFrame:
    """Each output (output_name, sha256, ...) against a store of names: created, no_op or conflict."""
    held = store.select("output_name", F.col("sha256").alias("held_sha256"))
    status = F.when(F.col("held_sha256").isNull(), "created").when(F.col("held_sha256") == F.col("sha256"), "no_op").otherwise("conflict")
    return outputs.join(held, "output_name", "left").withColumn("status", status).drop("held_sha256")


def create_if_absent(outputs: DataFrame, store: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): of outputs with a new name the first by ``order`` is created."""
    judged = record_status(outputs, store)
    fresh = judged.filter("status = 'created'")
    ranked = fresh.withColumn("__r", F.row_number().over(W.partitionBy("output_name").orderBy(order)))
    first = ranked.filter("__r = 1").drop("__r", "status")
    later = ranked.filter("__r > 1").drop("__r")
    late = record_status(later.drop("status"), first).filter("status = 'conflict'")
    return first, judged.filter("status = 'conflict'").unionByName(late)


def materialize(outputs: DataFrame, store: DataFrame) -> DataFrame:
    """New rows of a content-addressed store: the identity is of name and digest, repeats are no-ops."""
    named = outputs.withColumn("artifact_id", artifact_id(F.col("output_name"), F.col("sha256")))
    return named.dropDuplicates(["artifact_id"]).join(store.select("artifact_id"), "artifact_id", "left_anti")


def resolve(identities: DataFrame, store: DataFrame, max_bytes: int, media_types: list[str]) -> DataFrame:
    """Resolve identities (uri, sha256, size_bytes, media_type) to content, or say why not."""
    held = store.select("uri", "content", F.sha2("content", 256).alias("held_sha256"), F.octet_length("content").alias("held_size"))
    code = (
        F.when(~F.col("media_type").isin(media_types), "MEDIA_TYPE_NOT_ALLOWED")
        .when(F.col("size_bytes") > max_bytes, "ARTIFACT_TOO_LARGE")
        .when(F.col("held_sha256").isNull(), "ARTIFACT_NOT_FOUND")
        .when((F.col("held_size") != F.col("size_bytes")) | (F.col("held_sha256") != F.col("sha256")), "ARTIFACT_DIGEST_MISMATCH")
        .otherwise("RESOLVED")
    )
    joined = identities.join(held, "uri", "left").withColumn("code", code)
    return joined.withColumn("content", F.when(F.col("code") == "RESOLVED", F.col("content"))).drop("held_sha256", "held_size")
