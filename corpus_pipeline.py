"""A pipeline over documents: toxicity, near duplicates, secrets, mixture, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import jaccard, mixing, pieces, secret_scan, toxicity
from vantage.llm.common import aside, read, stage

#: Ids that documents are filtered by in a broadcast; more go through a join.
BROADCAST_IDS = 2_000_000
#: Near duplicates share so many of 100 five-word shingles.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't call toxic."""
    own, back = aside(docs, "tox_score", "tox_held_out", "tox_predicted")
    rated = toxicity.rate(own, read(spark, sf_dir, "labels"))
    return rated.filter("tox_predicted = 0").select(own.columns).withColumnsRenamed(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id.

    Rows that repeat an id count as one document; of them the row of the longest text
    stays, of equal lengths the greatest text.  Rows with a null id stay.
    """
    member, _ = jaccard.join(docs, SHINGLE, PERCENT)
    away = stage(member.filter("doc_id <> component_id").select("doc_id").distinct(), "near-away")
    few = away.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(away) if few else away, "doc_id", "left_anti")
    repeated = stage(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-repeated")
    if repeated.limit(1).count():
        order = F.struct(F.length("text"), *[F.col(c) for c in ("text", "lang", "source", "n_chars") if c in docs.columns])
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        again = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(whole, order).alias("row")).select("row.*")
        left = left.join(repeated, "doc_id", "left_anti").unionByName(again)
    return left.select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked and n_chars follows."""
    own, back = aside(docs, "sec_findings", "sec_secrets", "sec_text")
    done = secret_scan.scan(own)
    new = {"text": F.col("sec_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("sec_secrets") > 0, F.length("sec_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns(new).select(own.columns).withColumnsRenamed(back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares meet the target weights."""
    own, back = aside(docs, *mixing.DIMS, "m_tokens", "m_weight", "m_prob", "m_kept")
    return mixing.mix(own).filter("m_kept").select(own.columns).withColumnsRenamed(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, variant, n_pieces, ids and lossless of each document."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("pieces", encode),
]

#: No stage but the masking can be said in SQL: networks, hashes and merges decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again for the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
