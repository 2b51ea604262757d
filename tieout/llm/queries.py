"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import lexical, quality
from tieout.llm.common import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        reachable(spark)
        return fn(spark, folder)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; the base kinds apart and all kinds together."""
    from tieout.llm.common import count_of, span_digest, span_text
    from tieout.llm.secrets import BASE, find_secrets

    spans = F.col("spans")
    return find_secrets(table(spark, folder, "documents")).select(
        "doc_id",
        *[count_of(spans, rule.kind).alias(f"n_{rule.kind}") for rule in BASE],
        span_digest(spans, tuple(rule.kind for rule in BASE)).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


@query
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprint of every document and the group of documents that links of at most two bits connect."""
    from tieout.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside windows of the benchmark, and the items they come from."""
    from tieout.llm.decontaminate import find_overlap, is_contaminated

    return find_overlap(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written as grammar-compressed shards in the order of doc_id, and read back."""
    from tieout.llm.repair import read_tokens, write_tokens

    file = write_tokens(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), end=2)
    return read_tokens(file.read(spark)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens that keep the sources' shares."""
    from tieout.llm.packing import pack

    pieces = pack(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), end=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """How likely each document is toxic, by a model that has seen no held-out label."""
    from tieout.llm.toxicity import held_out, score, train

    docs = table(spark, folder, "documents")
    scored = score(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors by inner product of every fiftieth vector, exactly."""
    from tieout.llm.covertree import top_k

    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


@query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    from tieout.llm.pages import main_text

    return main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document; the base kinds apart and all kinds together."""
    from tieout.llm.common import count_of, span_digest, span_text
    from tieout.llm.pii import BASE, find_personal

    spans = F.col("spans")
    return find_personal(table(spark, folder, "documents")).select(
        "doc_id", *[count_of(spans, kind).alias(f"n_{kind}") for kind in BASE], span_digest(spans, tuple(BASE)).alias("base_sha256"), span_text(spans).alias("spans")
    )


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the lines that stay when of all similar lines one is kept."""
    from tieout.llm.lines import deduplicate

    return deduplicate(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent words of all documents, the words one edit away, and the form each is likely meant for."""
    from tieout.llm.spelling import variants

    return variants(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    """What the rules of lines and of documents say of every document."""
    from tieout.llm.quality import RULES, clean, removed_by

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    return clean(table(spark, folder, "documents")).select("doc_id", *counts, *[removed_by(rule).alias(f"n_{rule}") for rule in RULES])


@query
def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of all for every item of the benchmark."""
    from tieout.llm.lexical import build_index, search

    found = search(build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"), k=10)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("op12_quality", quality.oracle())
oracle("op13_search", lexical.oracle())
