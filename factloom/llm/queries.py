"""The queries opN_<name> over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate as _decontaminate
from factloom.llm import html_text, images, langid, near_dup, ngram_lm, packing, quality, toxicity, url_filter
from factloom.llm._io import crc_mod, table

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hosts that are blocked where no rule fits.
GLOBS = tuple(("block", f"*.{name}*.*#*") for name in ("adult-", "casino-", "cheap-", "free-bets", "spam-"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES, GLOBS)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.edited_copies(images.rendered(table(spark, sf_dir, "embeddings")))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.fit(ngram_lm.training_rows(docs))
    return ngram_lm.score(docs, model).select("doc_id", _held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _held_out(n: int, is_: int):
    return F.coalesce(crc_mod("doc_id", n) == is_, F.lit(False)).alias("held_out")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid.fit(langid.training_rows(docs))
    return langid.identify(docs, trees).select("doc_id", _held_out(4, 2), "lang_pred", "score")


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1_SQL = f"""
WITH rest AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS s FROM pages),
parts AS (
  SELECT page_id, r, translate(regexp_extract(s, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(substr(s, length(regexp_extract(s, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
best AS (
  SELECT r, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(best.verdict, CASE WHEN {" OR ".join(f"('.' || host) LIKE '{g.split('#')[0].replace('*', '%')}'" for _, g in GLOBS)} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (r)
"""

_WORDS = f"list_transform(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), x -> x)"

_OP3_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS m FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
doc AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
place AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win))),
occ AS (SELECT DISTINCT r, m, i, item FROM place JOIN win USING (m, s)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM occ) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM occ GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def queries() -> dict:
    import corpus_pipeline

    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1_SQL, "op3_decontamination": _OP3_SQL}
