"""A corpus pipeline: raw documents in, packed training sequences out.

Each stage gets all that the one before it kept; all but the last return the columns of
``documents``.  ``run`` writes each stage's rows as Parquet to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm import langid, linededup, mixing, packing, simhash
from atlasframe.llm.common import forget, written
from atlasframe.llm.queries import tokenizer_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that no learned language fits, which all without a letter are, and labels the
    unlabelled; learns from the labels outside the held-out fold."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    languages = langid.learn(docs.where(~held_out))
    named = langid.identify(docs, languages).where("fits")
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines of 50 words or more that occurred before; what is left blank goes."""
    done = linededup.dedup_lines(docs).where(r"removed_lines = 0 or rlike(text, '[^\\x20\\x09-\\x0D]')")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of documents linked by a Jaccard similarity of 5-word shingles of 0.8 or more."""
    return simhash.keep_similar(docs, percent=80, words_per_shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass that the mix takes, in training order."""
    return mixing.mixed_rows(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, fingerprints and the tokenizer are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        done = written(stage(spark, docs, sf_dir))
        if n:
            forget(docs)
        docs = done
    return docs
