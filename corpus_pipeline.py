"""The corpus pipeline: documents in, packed training sequences out.

STAGES are applied in order. Each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs; all
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.storage import ensure_checkpoint_dir
from veilscan.llm import mixing, packing, substring_dedup, toxicity
from veilscan.llm.common import table
from veilscan.llm.ngram_join import link_documents


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic. It learns from the
    labelled ones among them that are not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, all
    its rows included; documents without words and rows without an id stay."""
    linked = link_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(linked, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with
    a smaller id has; a text without any stays as it is."""
    cut = substring_dedup.cut_repeats(docs)
    changed = F.col("n_removed") > 0
    return cut.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    taken = mixing.mix(docs).where("copies > 0")
    taken = taken.groupBy("doc_id", "text_key", "source").agg(F.sum("copies").alias("copies"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit("")))).alias("d")
    same = "d.doc_id <=> t.doc_id and d.__key = t.text_key and d.source <=> t.source"
    # equal rows share their takings: all but the first of them step back
    first = keyed.dropDuplicates(["doc_id", "__key", "source"]).alias("d")
    joined = first.join(taken.alias("t"), F.expr(same))
    return joined.select("d.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a trained model: SQL cannot express it. tests/llm holds
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{ensure_checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
