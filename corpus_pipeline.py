"""From raw documents to token ids: the stages of the corpus pipeline, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, decontaminate, simhash, substrings, toxicity
from nearfield.llm.common import materialize, table
from nearfield.llm.queries import BYTE_BPE, toxicity_model

#: Most ids that are broadcast to take their rows out; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``ids(id)``; rows with a null id stay."""
    ids = materialize(ids.select("id").distinct(), "dropped")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    return toxicity.keep_clean(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id."""
    return without(docs, simhash.similar_documents(docs).where("id <> component_id"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` for each row: its id, where that is not null and no row before has it, in the order of their
    texts; other rows have numbers beyond all ids."""
    odd_ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    odd_ids = materialize(odd_ids, "odd-ids")
    of_id = F.col("doc_id").cast("long")
    if odd_ids.isEmpty():
        return docs.withColumn("_row", of_id)
    low, top = docs.agg(F.coalesce(F.min(of_id), F.lit(0)), F.coalesce(F.max(of_id), F.lit(0))).first()
    if top >= 1 << 62 and low <= -(1 << 62):
        raise ValueError("ids leave no numbers for rows whose id is null or repeated")
    base = top + 1 if top < 1 << 62 else low - (1 << 61)
    odd = docs.where("doc_id is null").union(docs.join(odd_ids, "doc_id", "left_semi").select(*docs.columns))
    odd = materialize(odd.orderBy("doc_id", "text").withColumn("_at", F.monotonically_increasing_id()), "odd")
    first = odd.where("doc_id is not null").groupBy("doc_id").agg(F.min("_at").alias("_at")).select("_at", of_id.alias("_id"))
    odd = odd.join(first, "_at", "left").withColumn("_row", F.coalesce("_id", F.col("_at") + F.lit(base)))
    rest = docs.where("doc_id is not null").join(odd_ids, "doc_id", "left_anti").withColumn("_row", of_id)
    columns = [*docs.columns, "_row"]
    return materialize(rest.select(*columns).union(odd.select(*columns)), "numbered")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that nearly equal one of a document with a smaller id. Rows with a null id, and all but one of
    those with the same id, are documents of their own that come after all others."""
    rows = numbered(docs)
    spans = materialize(substrings.repeated_passages(rows, "_row"), "passages")
    cut = substrings.remove_passages(rows, spans, "_row").select(*docs.columns)
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.length("text").cast(kind))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("id")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), with their number and the digests of ids and text."""
    coded = bpe.encode_decode(docs, BYTE_BPE)
    return coded.select(
        "doc_id",
        "ids",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: SQL cannot express the fingerprints, the grammar or the merges; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
