"""From documents to token files: five stages, each written as Parquet and read again as the next one's documents.

1 toxicity: documents that the tagger scores at its threshold or above go. Labels come from sf_dir.
2 near-duplicates: of each group of linked fingerprints the document of the smallest id stays.
3 decontamination: documents that hold an item of sf_dir's benchmark go.
4 mixing: documents are repeated or left out as the source mix takes their words.
5 tokens: the documents' ids are written to shard files and read back, one row a document.

All stages but the last return the columns of documents; no stage changes a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingmart.llm import decontam, mixing, simhash, tokenfile, toxicity
from listingmart.llm.common import discard, scratch_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return toxicity.clean_documents(docs, toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs.select(*COLUMNS))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenfile.encode_and_read(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can express no trained tagger, Feistel permutation or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)  # texts; the next stage's copy is whole
        before = path
    return docs
