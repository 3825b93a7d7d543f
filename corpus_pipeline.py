"""The corpus pipeline: language ID, near-dedup, secret scans, mixing, token ids.

Each stage takes the documents its predecessor kept and gives documents to the next;
the last gives token ids.  Decisions take effect:

1. ``language_id`` drops documents without a language, or with none for a third of the words.
2. ``near_dedup`` keeps one document, that with the smallest id, of each group of near copies.
3. ``secret_scan`` replaces secrets in the texts by a mark; every document stays.
4. ``mixing`` takes documents as often as their source's token budget says: those above
   it are left out, those of a second epoch come twice.
5. ``encode`` turns texts to token ids.

Defined cases: rows with a null id, or with one that stands on several texts, are judged
by their texts like any other; null or empty texts have no language and go in the first
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, langid, mixing, registry, secrets, simhash
from sparkloom.llm.common import Scratch, held_out

#: A text that switches between two languages scores about a half for each, and is no reject;
#: one in which no language has a third of the words is.
LEAST_SCORE = 1 / 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.where(~held_out(docs["doc_id"]) & docs["doc_id"].isNotNull()))
    return langid.keep(docs, model, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, registry.RANKS, registry.PATTERN)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Budgets come from a narrow table; texts are moved once, to their source's hash range."""
    extra = [*registry.leaf_columns(docs), mixing.words(docs["text"]).alias("tokens")]
    narrow = Scratch(spark, "mix").write(docs.select("doc_id", *extra))
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # kept apart from the levels' names
    mixed = mixing.mix(docs.select("doc_id", *extra, own), registry.LEVELS, registry.WEIGHTS, registry.SHARE, registry.EPOCHS, registry.SEED, narrow)
    taken = mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch"))
    return taken.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every document."""
    return bpe.encode(docs, registry.RANKS, registry.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing_stage), ("encode", encode)]

#: SQL can express neither the language model nor token ids; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with Scratch.sweep():  # a stage's own tables go once its result is written
            kept = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)  # what it has read goes too, if it was written here
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
