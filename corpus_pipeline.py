"""From raw documents to packed training sequences.

Each stage takes the documents that the stage before it left, and all but the last give documents with
the same columns. ``run`` writes every stage's result to the shared folder and reads it again, so a lost
executor costs no more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import decontaminate, lines, packing, simhash, toxicity
from tieout.llm.common import reachable
from tieout.llm.queries import tokenizer
from tieout.session import stored

#: Documents that score this or more are taken to be toxic.
TOXIC = 0.3


def unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the documents starts with it."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels of the documents that are here;
    without labels of both classes it knows nothing and rejects none."""
    reachable(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights.any():
        return docs
    name = unused(docs, "_toxic")
    return toxicity.score(docs, model, whole=True, name=name).filter(F.col(name) < TOXIC).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another place keeps."""
    left = lines.deduplicate(docs, counts=False)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows that repeat an id are
    one document, of which one row stays; rows without an id are in no group and stay."""
    reachable(spark)
    groups = simhash.near_duplicates(docs.filter("doc_id is not null"))
    name = unused(docs, "_id")
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(stays, F.col("doc_id") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return kept.unionAll(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which less than one word in twenty is from the benchmark."""
    reachable(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    prefix = unused(docs, "_overlap_")
    found = decontaminate.find_overlap(docs, benchmark, whole=True, prefix=prefix)
    return found.filter(~decontaminate.is_contaminated(prefix)).drop(*[c for c in found.columns if c.startswith(prefix)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens that keep the sources' shares."""
    reachable(spark)
    pieces = packing.pack(docs, tokenizer("byte_bpe_50k.json"), end=0)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hashes, components and a fitted model are beyond SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir)).read(spark)
    return docs
