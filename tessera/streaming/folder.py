"""Folder ingestion as a stream: new files, parsed and chunked once, whatever is restarted."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_prose
from ..sources import files as parsers
from ..sources.files import category

STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def watch(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New files below a folder with their category and content hash, without hidden and empty ones."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    seen = files.filter((F.col("length") > 0) & ~parsers.hidden_below(spark, folder))
    return seen.withColumns({"category": category(F.col("path"), F.col("content")), "content_hash": F.sha2("content", 256)})


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 100, rejected: str | None = None, remember: str | None = None) -> StreamingQuery:
    """Chunks of new files of all formats that are parsed, appended to a Parquet table by batch; equal contents are taken once.

    Which contents have been seen is state of the stream, by their hash, in RocksDB below the checkpoint: no batch reads
    the table. With ``remember`` (an interval such as '90 days') a hash is forgotten that long after the newest file; else
    it is kept. Files that give no text go to the table ``rejected`` (by default beside the other one) with a reason, and
    don't stop their batch. A batch that is replayed overwrites what it wrote before: its rows lie below its own number."""
    rejected = rejected or f"{table.rstrip('/')}-rejected"
    packages = F.col("category").isin(*parsers.PACKAGES, "html", "json")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            known = batch.select("path", "content_hash", "category")
            pages = parsers.pages(batch.filter(~packages | (F.col("length") <= parsers.MAX_FILE))).filter(F.col("text").rlike(r"\S"))
            texts = pages.drop("category").join(known, "path").select(F.concat_ws("/", "content_hash", "page").alias("page_id"), "text").persist(StorageLevel.DISK_ONLY)
            out = lambda df, path: df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
            chunks = chunk_prose(texts, "page_id", "text")
            out(chunks.withColumns({"content_hash": F.substring_index("page_id", "/", 1), "page": F.substring_index("page_id", "/", -1).cast("int")}).drop("page_id"), table)
            read = texts.select(F.substring_index("page_id", "/", 1).alias("content_hash")).distinct()
            reason = F.when(packages & (F.col("length") > parsers.MAX_FILE), "too large to parse").when(F.col("category").isin(*parsers.PARSED), "damaged, or without text").otherwise("no parser")
            out(batch.join(read, "content_hash", "left_anti").select("path", "content_hash", "category", "length", reason.alias("reason")), rejected)
            texts.unpersist()
        finally:
            batch.unpersist()

    new = watch(spark, folder, files_per_batch)
    new = new.withWatermark("modificationTime", remember).dropDuplicatesWithinWatermark(["content_hash"]) if remember else new.dropDuplicates(["content_hash"])
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
