"""A training corpus in five stages; each stage's rows are written as Parquet and read as the next one's ``docs``.

Defined cases, for every stage: an empty table gives an empty one; columns other than those of ``documents`` are carried
through all stages but the last, whatever their names, since stages work under names of their own; ids may be
integers or strings, or null, which is an id like others to all stages but near-duplicates, where such rows come last;
null and empty texts are kept by all stages but the last, which selects documents by their tokens and has none to count;
of repeated rows one is left after the second stage; texts of any length are read whole; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontamination, minhash, mixing, suffixes, toxicity
from tessera.llm.shared import drop_cut, settled


#: The columns that stages read and, where that is their work, change.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """The stage with the caller's further columns under names that no operator uses."""

    @wraps(stage)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() not in DOCUMENT}
        return stage(spark, docs.withColumnsRenamed(own), sf_dir).withColumnsRenamed({hidden: c for c, hidden in own.items()})

    return work


@_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted to the labelled ones, doesn't reject. Without labels of both kinds none is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    return toxicity.score(docs, toxicity.train(docs, labels)).filter("predicted = 0").select(docs.columns)


@_apart
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id. Texts without words are copies of nothing."""
    return minhash.drop_near_duplicates(docs)


@_apart
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes and more that occur elsewhere; a text that goes as a whole is an empty one."""
    found = suffixes.dedup(docs)
    return found.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(docs.columns)


@_apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of words from the benchmark. With an empty benchmark all stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which documents to read in which epoch and order, at target weights: as many tokens as the corpus has."""
    docs = docs.withColumn("domain", F.expr(mixing.DOMAIN_SQL))
    return mixing.mix(docs, mixing.PATH, weights=mixing.WEIGHTS, share_of_corpus=1.0)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The first stage's machine has no SQL form; the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        if k:
            drop_cut(before)
    return docs
