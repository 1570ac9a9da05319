"""Replacing a document by a new version, in an order of writes that never leaves it without an active one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import registry as V
from .sinks import set_active, upsert


def replace(spark: SparkSession, chunks_path: str, registry_path: str, old_id: str, new_chunks: DataFrame, version: DataFrame) -> str:
    """'replaced', 'unchanged' (its content is active already) or 'empty' (nothing was chunked; the old one stays).

    ``new_chunks`` (chunk_id, document_id, active, ...) and ``version``, one registry row without its links. Written in this order:
    the new chunks, the new version, the old chunks hidden, the old version superseded. A failure before the
    second write leaves the old version as it was, a later one leaves both active; running it again completes it."""
    registry = spark.read.parquet(registry_path)
    if registry.filter(F.col("document_id") == old_id).isEmpty():
        raise ValueError(f"unknown document: {old_id}")
    new = version.select("document_id", "content_hash", "user_id").first()
    if new is None or new_chunks.isEmpty():
        return "empty"
    linked = registry.filter((F.col("document_id") == old_id) & F.col("superseded_by").eqNullSafe(F.lit(new["document_id"])))
    same = registry.filter(F.col("active") & (F.col("content_hash") == new["content_hash"]) & F.col("user_id").eqNullSafe(F.lit(new["user_id"])))
    if not same.isEmpty() and (not linked.isEmpty() or same.filter(F.col("document_id") == new["document_id"]).isEmpty()):
        return "unchanged"
    upsert(spark, chunks_path, new_chunks.withColumn("active", F.lit(True)), "chunk_id")
    fill = {"supersedes": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"), "active": F.lit(True), "lineage_root": F.col("document_id")}
    upsert(spark, registry_path, version.withColumns(fill).select(V.COLUMNS), "document_id")
    if new["document_id"] == old_id:
        return "replaced"
    old = spark.createDataFrame([(old_id, new["document_id"])], "document_id string, new_id string")
    chunks = spark.read.parquet(chunks_path)
    upsert(spark, chunks_path, set_active(chunks.join(old.select("document_id"), "document_id", "left_semi"), old, False), "chunk_id")
    links = V.supersede(spark.read.parquet(registry_path), old.withColumnRenamed("document_id", "old_id"))
    upsert(spark, registry_path, links.filter(F.col("document_id").isin(old_id, new["document_id"])), "document_id")
    return "replaced"
