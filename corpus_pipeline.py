"""The training-data pipeline: STAGES, run(), and why there is no SQL for it.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it back as the next stage's docs.

1. language_id: rows whose language cannot be told (no letters, or a pooled probability under
   langid.LEAST_SCORE) go; lang becomes the predicted language.
2. near_duplicates: of each group of texts linked by a similarity of 0.8 or more the row with the smallest
   doc_id stays.
3. decontamination: documents that hold a passage of the benchmark go.
4. source_mix: the rows are laid down in the order of the mix; none goes.
5. token_output: token ids in the order of the mix, as files; the result is the digest per document.

Null text counts as empty (and goes in stage 1); empty tables give empty results; columns beside those of
documents are carried along to stage 4, whatever their names.  Rows are known by doc_id and a hash of their text, so rows
without a doc_id, and different texts that share one, are judged one by one; of a group a row with an id stays before one without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, mixing, nearjoin, shared, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    said, lang, score = langid.identify_all(docs)
    kept = said.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= langid.LEAST_SCORE))
    return shared.fewer_files(kept.withColumn("lang", F.col(lang)).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    links = shared.stored(nearjoin.near_links(docs).select("doc_id", "t", "g", "group_size"), "pipeline-links", narrow=True)
    return shared.fewer_files(nearjoin.keep_one(docs, links))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.where(F.col("best_words") >= decontam.LEAST_WORDS)  # shorter items are ordinary phrases
    leaks = shared.stored(found.select("doc_id", "t").distinct(), "pipeline-leaks", narrow=True)
    return shared.fewer_files(nearjoin.drop_rows(docs, leaks))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_in_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.token_output(*tokens.in_stored_order(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

# Not SQL: a trained network, a spanning comparison and a tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
