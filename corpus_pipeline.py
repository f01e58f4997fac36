"""Corpus pipeline: language identification, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  run() writes what a stage gives to
the shared folder of spark.checkpoint.dir and reads it again, so no stage is computed twice and a lost executor costs only
the stage at work.

Defined cases, for every stage: a null text is empty (language identification rejects it, as it has no letter); a null in any other
column stays; a null doc_id takes part as the largest; texts of any length are whole; a row that repeats is judged each, but one of
it stays behind the near-duplicate stage; columns beyond those of documents stay, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import language_id, mixing, packing, pii, shingle_join
from mensura.llm.common import Tables, checkpoint


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; what has no letter goes.  lang becomes the prediction where it is null."""
    model = language_id.train(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    # The text goes to Python and back once, beside the rest of its row.
    own = [c for c in docs.columns if c != "text" or dict(docs.dtypes)["text"] != "string"]
    found = language_id.identify(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "text"), model).where(F.col("lang_pred") != language_id.UND)
    return found.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") if c in own else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the smallest doc_id; of repeated rows, one."""
    return shingle_join.keep_one(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and words that disclose it; n_chars follows the text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Tables(spark) as table:
        for name, stage in STAGES[:-1]:
            docs = table(stage(spark, docs, sf_dir), name)
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))
