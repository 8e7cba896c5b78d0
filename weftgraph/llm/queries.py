"""The thin queries opN_<name> over whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontam, html, langid, minhash, mixing, nbsvm, pii, rules, sentences, warc
from weftgraph.llm.common import drop_dir, held_out, materialize, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 85, 100)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh
  FROM w),
c AS (SELECT min(doc_id) AS node, any_value(n) AS n, list_sort(sh) AS sh FROM (SELECT doc_id, len(sh) AS n, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
u AS (SELECT node, n, unnest(sh) AS x FROM c),
l AS (
  SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, root) AS (SELECT node, node FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh AND len(s.sh) > 0 LEFT JOIN m ON m.node = c.node
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    slim = materialize(planned.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.positions"))
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return slim.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id").drop("positions")


def op1_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    # records are read without payloads: lengths and digests of the payloads are taken while reading
    rows = materialize(warc.assemble(warc.read_archives(spark, path, with_payload=False)))
    drop_dir(spark, path)
    target = rows.where("capture.record_type = 'response'").groupBy(F.col("capture.record_id").alias("target")).agg(F.max("info.page_id").alias("target_page"))
    out = rows.join(target, F.col("capture.refers_to") == F.col("target"), "left")
    return out.select(
        "info.page_id", F.coalesce("capture.payload_bytes", "info.payload_bytes").alias("payload_bytes"), "capture.payload_digest", "capture.record_type",
        F.col("target_page").alias("refers_to"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s FROM p),
k AS (SELECT s, max(page_id) AS keep FROM d WHERE n >= 1000 GROUP BY s)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
  CASE WHEN k.keep IS NULL OR k.keep = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.keep IS NULL OR k.keep = d.page_id THEN NULL ELSE k.keep END AS refers_to
FROM d LEFT JOIN k ON k.s = d.s AND d.n >= 1000
"""


def op2_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, ratios = nbsvm.fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return nbsvm.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ratios).drop("text")


def op4_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "start", "end")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))
    return docs.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), "pii")


def op9_bloom_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = langid.fit(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), filters).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentence_span_dedup, op2_nbsvm_quality, op3_quality_rules, op4_edit_decontamination, op5_curriculum_mix,
        op6_minhash_near_dedup, op7_html_main_text, op8_feistel_pii, op9_bloom_language, op10_warc_transactions)
}
SQL: dict[str, str] = {"op3_quality_rules": rules.quality_sql(), "op5_curriculum_mix": mixing.plan_sql(), "op6_minhash_near_dedup": OP6_SQL, "op10_warc_transactions": OP10_SQL}
