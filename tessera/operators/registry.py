"""Document versions: checks, supersession, lineage and reconciliation, as joins over registry tables.

A registry row: document_id, content_hash, user_id, embedding_model, created_at, supersedes, superseded_by,
active, lineage_root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

COLUMNS = ["document_id", "content_hash", "user_id", "embedding_model", "created_at", "supersedes", "superseded_by", "active", "lineage_root"]


def document_id(path):
    """The first 16 digits of a path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 16)


def status(incoming: DataFrame, registry: DataFrame, model: str) -> DataFrame:
    """Adds ``status`` by the active content of the same tenant: NEW, ALREADY_INGESTED or STALE_EMBEDDING."""
    known = registry.filter("active").groupBy("content_hash", "user_id").agg(F.max_by("embedding_model", F.struct("created_at", "document_id")).alias("known_model"), F.max_by("document_id", F.struct("created_at", "document_id")).alias("known_id"))
    out = incoming.join(known, (incoming.content_hash == known.content_hash) & incoming.user_id.eqNullSafe(known.user_id), "left").drop(known.content_hash, known.user_id)
    return out.withColumn("status", F.when(F.col("known_id").isNull(), "NEW").when(F.col("known_model").eqNullSafe(F.lit(model)), "ALREADY_INGESTED").otherwise("STALE_EMBEDDING"))


def build_versions(files: DataFrame) -> DataFrame:
    """Registry rows from (document_id, name, content_hash, user_id, embedding_model, created_at): uploads of one name are
    one lineage, each superseding the one before; only the last is active."""
    w = Window.partitionBy("user_id", "name").orderBy("created_at", "document_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = files.withColumns({"supersedes": F.lag("document_id").over(w), "superseded_by": F.lead("document_id").over(w), "lineage_root": F.first("document_id").over(whole)})
    return out.withColumn("active", F.col("superseded_by").isNull())


def supersede(registry: DataFrame, pairs: DataFrame) -> DataFrame:
    """Applies (old_id, new_id): the old version is hidden, both are linked, the new one inherits the lineage."""
    known = registry.select(F.col("document_id").alias("old_id"), F.col("lineage_root").alias("old_root"))
    fresh = pairs.join(known, "old_id").select(F.col("new_id").alias("document_id"), F.col("old_id").alias("from_id"), "old_root")
    gone = pairs.select(F.col("old_id").alias("document_id"), F.col("new_id").alias("by_id"))
    out = registry.join(gone, "document_id", "left").join(fresh, "document_id", "left")
    return out.withColumns({
        "active": F.when(F.col("by_id").isNotNull(), False).when(F.col("from_id").isNotNull(), True).otherwise(F.col("active")),
        "superseded_by": F.coalesce("by_id", "superseded_by"),
        "supersedes": F.coalesce("from_id", "supersedes"),
        "lineage_root": F.coalesce("old_root", "lineage_root"),
    }).select(registry.columns)


def unregister(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """Removes (document_id) rows; the predecessor of a removed active version becomes active again."""
    removed = registry.join(gone.select("document_id"), "document_id", "left_semi")
    back = removed.filter("active").select(F.col("supersedes").alias("document_id"), F.lit(True).alias("back")).filter("document_id is not null").distinct()
    left = registry.join(gone.select("document_id"), "document_id", "left_anti").join(back, "document_id", "left")
    dangling = removed.select(F.col("document_id").alias("superseded_by"), F.lit(True).alias("lost")).distinct()
    left = left.join(dangling, "superseded_by", "left")
    return left.withColumns({"active": F.coalesce("back", "active"), "superseded_by": F.when(F.col("lost"), None).otherwise(F.col("superseded_by"))}).select(registry.columns)


def versions(registry: DataFrame) -> DataFrame:
    """Adds the place of a version in its lineage, oldest first, and how many there are."""
    w = Window.partitionBy("lineage_root")
    return registry.withColumns({"version": F.row_number().over(w.orderBy("created_at", "document_id")), "versions": F.count("*").over(w)})


def reconcile(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Chunks whose ``active`` follows the registry; chunks of unknown documents keep theirs."""
    truth = registry.select("document_id", F.col("active").alias("truth"))
    return chunks.join(truth, "document_id", "left").withColumn("active", F.coalesce("truth", "active")).drop("truth")


def migrate(legacy: DataFrame) -> DataFrame:
    """Rows keyed by content hash (content_hash, document_id, created_at) as registry rows; running it again changes nothing."""
    rows = legacy
    fill = {"user_id": F.lit("system"), "embedding_model": F.lit(None).cast("string"), "supersedes": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"), "active": F.lit(True), "lineage_root": F.col("document_id")}
    for name, value in fill.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows.dropDuplicates(["document_id"]).select(COLUMNS)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key; writing the result twice changes nothing."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
