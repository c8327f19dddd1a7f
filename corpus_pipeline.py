"""The corpus pipeline: five filtering and packing stages over documents.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last keep the columns of documents.

  toxicity         documents that the subword model calls toxic go
  ngram_jaccard    documents of which a near copy with a smaller id stays go
  decontamination  documents that hold a benchmark item go
  personal_data    personal data are replaced by their kind
  packing          documents are packed into rows of tokens, with certificates

Null ids or texts: such rows pass the filters unchanged and aren't packed.
Repeated rows: each is judged by itself, but of rows with one id and equal or
near texts all stay or go together in ngram_jaccard, and each is packed.  Ties
go to the smaller id.  Texts of any length are read whole.  Other columns, with
whatever names, are kept up to packing; n_chars follows a redacted text if it
holds integers.  Empty tables pass through as empty results.

Intermediate tables lie in the shared folder of spark.checkpoint.dir and are
removed once the next stage is written; the last one is the result's own and
stays as long as the folder does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, ngram_jaccard, packing, pii, toxicity
from weftgraph.session import shared_checkpoints

#: No SQL: the trained models and the packing have no counterpart there.  The tests hold each stage against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.certified_packing(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_leaks), ("personal_data", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared checkpoint folder."""
    base = f"{shared_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = _table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(last)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        last = path
    return docs
