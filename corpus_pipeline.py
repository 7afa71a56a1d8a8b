"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all rows that its predecessor kept.  ORACLE_SQL is None, since the learned stages
cannot be told in SQL; the tests hold each stage against a plain version, on the test data and on odd rows.

Edge cases, in every stage: a null text counts as empty; rows of one doc_id, and rows without one, are
judged one by one, by their texts; repeated rows are judged alike; an empty table gives an empty result;
without labels the first two stages use a fixed lexicon and keep every row; extra columns are kept up to the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadscope.llm import _common, decontaminate, jaccard, quality, sentencepiece_bpe, toxicity
from quadscope.llm.queries import tokenizer

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.3 or more for toxicity; empty ones hit no entry and stay."""
    lexicon = toxicity.learn(docs, _common.table(spark, sf_dir, "labels"), _common.fold("doc_id", 4) != 2)
    return toxicity.remove(docs, lexicon)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that score 0.3 or more for quality; empty ones score the share of good documents in
    the sample."""
    model = quality.learn(docs, _common.table(spark, sf_dir, "labels"), _common.fold("doc_id", 5) != 0)
    return quality.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: that of the least doc_id, one without only where no
    other is there.  Documents without words are similar to none and stay."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold any window of a benchmark item; documents without words hold none."""
    return decontaminate.remove(docs, _common.table(spark, sf_dir, "benchmark"), min_items=1)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document; of an empty one no ids."""
    return sentencepiece_bpe.encode(docs, tokenizer("piece_bpe_32k.model")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", "ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, _common.written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if k:
            _common.discard(before)
    return docs
