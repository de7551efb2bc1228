"""A training-corpus pipeline: five stages over `documents`, each by an operator of spanforge.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return
the columns of `documents`. run() cuts lineage between stages with checkpoint() in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, langid, mixing, simhash, substrings
from spanforge.llm.flat import shared_dir

#: Columns that stages exchange.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The part of the way from a blind guess to certainty below which a language isn't told. Low, so that clean documents stay.
UNSURE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; those without any letter, or null, go, and those that it can't place: with a
    calibrated probability less than UNSURE above that of a blind guess. A null lang becomes the predicted one."""
    model = langid.fit(docs.filter(langid.remainder("doc_id", 3) != 1))
    blind = 1 / max(len(model.languages), 1)
    out = langid.identify(docs.select(*COLUMNS), model).filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= blind + UNSURE * (1 - blind)))
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of their five-word shingles shared): the one with the smallest doc_id.

    Of rows with one doc_id in a group any but only one stays, the same in every run; repeated rows count as one.
    """
    tagged = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_rid"))
    groups = simhash.near_texts(tagged, F.col("_rid"))
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("x")).select(F.col("x.rid").alias("_rid"))
    return tagged.join(kept, "_rid", "left_semi").dropDuplicates(["_rid"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier; documents with no word left go, untouched texts stay as they are."""
    out = substrings.remove_repeats(docs.select(*COLUMNS)).filter("n_words > n_removed")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, once for each repetition."""
    out = mixing.mix(docs.select(*COLUMNS), F.array("source")).taken
    times = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0).cast("int")
    return out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    import public_tokenizers

    out = bpe.encode_decode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mixing", source_mixing), ("bpe_encoding", bpe_encoding)]

#: Trained models, fingerprints and seeded hashes aren't to be had in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs
