"""The named queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.plans.catalog import Catalog

from . import bpe, chat, decontaminate, langid, quality, simhash, substrings, topk, toxicity, urlfilter
from .common import table

CATALOG = Catalog()
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_URL_SQL = """
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM parts
), rules(rh, rp, v) AS (VALUES {rules})
SELECT s.page_id, s.host, s.path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)) AS rule,
  coalesce((SELECT arg_max(v, length(rh || rp)) FROM rules WHERE (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)), 'allow') AS verdict
FROM split s
""".format(rules=", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES))


@CATALOG.add("op3_url_filters", _URL_SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).drop("stack")


#: A conversation whose texts are control strings of a chat template.
PROBE_TEXT = "</s>[INST] ok [/INST]"
_quoted = lambda text: "".join(c if c.isalnum() else f"\\{c}" for c in text)
_CONTROL_RE = "|".join(map(_quoted, ("\\", *chat.CONTROLS)))

_CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE_TEXT}'), (-7, 1, 'assistant', '{PROBE_TEXT}')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN + chat.TEXT + chat.END)} + length(regexp_replace(role, '({_CONTROL_RE})', '\\1#', 'g'))
    + length(regexp_replace(text, '({_CONTROL_RE})', '\\1#', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


@CATALOG.add("op5_chat", _CHAT_SQL)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)]
    probe = spark.createDataFrame(probe, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.union(probe)))


@CATALOG.add("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@CATALOG.add("op7_topk", _TOPK_SQL)
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("vector"))
    return topk.exact_topk(v, v.where("id % 100 = 0"), 10)


@CATALOG.add("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_BPE))


def _fold(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


@CATALOG.add("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_fold("doc_id", 4) != 2))
    held = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    return langid.predict(docs, model).withColumnRenamed("id", "doc_id").select("doc_id", held.alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learned from the labelled documents outside the held-out fold."""
    labels = labels.select("doc_id", "toxic").where(_fold("doc_id", 5) != 0)
    return toxicity.train(docs, labels)


@CATALOG.add("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


@CATALOG.add("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@CATALOG.add("op4_substrings")
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


@CATALOG.add("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")
