"""From raw documents to a tokenised training mixture: quality, exact and near copies, source weights, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import exact_dedup, minhash_dedup, mixing, quality, sentencepiece_bpe
from tidemark.llm.common import staged, table
from tidemark.llm.queries import piece_model


#: Near copies of the pipeline: hundredths of the union of their word shingles that are shared; op2 has 85.
NEAR = 80
#: Chunks and pairs of pieces that a worker remembers while it encodes: fewer than op9's, since here executors have run four stages before.
REMEMBERED, PAIRS = 150_000, 200_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of those given, predicts to be good. A null or empty text is
    scored like any other; rows that repeat stay or go together; a null id has no label; without labels of both classes
    all stay; an empty table gives an empty one; other columns, whatever their names, pass through."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: of most code points, then of least id, null last. Null
    texts count as empty, and so are one group with texts of white space; of rows that repeat id and text one stays; an empty
    table gives an empty one; other columns pass through."""
    return exact_dedup.kept_only(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that of the least id, null last, and of several texts with that id the
    one of the least digest. Texts without words are no one's copies and stay; rows that repeat id and text stay together, of which
    the stage before leaves one; an empty table gives an empty one; other columns pass through."""
    return minhash_dedup.kept_only(docs, threshold=NEAR)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's target takes them; partition and file n hold shard n, shuffled. Texts without
    words are never taken; a null source is a source; rows that repeat id, source and text are taken alike; an empty table
    gives an empty one; other columns pass through."""
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document of the mixture, one row for each copy; a null or empty text has
    no tokens; other columns are not read."""
    both = sentencepiece_bpe.encode_decode(docs, piece_model(), remembered=REMEMBERED, pairs=PAIRS)
    return both.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: The classifier, the draw of the mixture and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
