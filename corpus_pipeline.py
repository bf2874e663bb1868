"""From raw documents to training shards, in stages written and read again between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from posespark.llm import decontamination, mixing, near_copies, quality_rules, sharding
from posespark.llm.common import finished, read, remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the production policy rejects; null and empty texts go, repeated rows are judged alike."""
    return quality_rules.keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that share four fifths of their five-word shingles: the least doc_id, null last; of repeated rows one.

    SimHash's links of two bits come first; its radius can't reach that share, so all other pairs follow
    by common rare shingles (posespark/llm/near_copies.py).
    """
    return near_copies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; null and empty texts stay, repeated rows are judged alike."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, equal rows are counted one by one."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mixed corpus; null dimensions take the last cell, equal rows any order."""
    return sharding.shard_documents(docs, 40, "rows", carry=("lang", "source"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Fingerprints, windows and random ranks have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are a Parquet table in the shared folder.

    Under a given run_id a run that was broken off goes on after its last finished stage. A stage's table is
    deleted when the next one is written, so the last one stays. Nulls, empty and long texts and
    repeated rows are treated as the stages' operators say; an empty table gives no rows;
    extra columns go along up to the last stage, whatever their names.
    """
    folder = f"{shared_dir(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k + 1 for k, path in enumerate(paths) if finished(spark, path)), default=0)
    docs = spark.read.parquet(paths[done - 1]) if done else read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[done:], done):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            remove(spark, paths[k - 1])
    return docs
