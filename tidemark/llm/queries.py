"""Registered queries of the pipeline operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import config_packing, cover_tree, decontaminate, html_text, line_dedup, merkle, ngram_join, packing, quality, token_counts, token_store, toxicity, whitening
from tidemark.llm.vocab import vocabulary
from tidemark.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    counts = token_counts.count_tokens(_table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@_query("op4_decontaminate")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """One row per benchmark passage in a document."""
    return decontaminate.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


_LINES = """
WITH lines AS (
  SELECT doc_id, line, pos,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key
  HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT l.*, f.first_doc IS NOT NULL AND f.first_doc <> l.doc_id AS gone
  FROM lines l LEFT JOIN firsts f ON f.key = l.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@_query("op5_line_dedup", _LINES)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op6_ngram_join")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf, "documents"))


@_query("op7_cover_tree")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return cover_tree.near_vectors(_table(spark, sf, "embeddings"))


@_query("op8_pack_documents")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 1, keep_ids=False)
    return packed.drop("ids")


@_query("op9_token_store")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    target = new_path(spark, "tokens")
    token_store.write_tokens(_table(spark, sf, "documents"), target, vocabulary("word_bpe_49k.json"), 2)
    return token_store.with_crc32(token_store.read_tokens(spark, target))


def _fold(n: int):
    """Remainder that decides whether a labelled row may be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@_query("op2_html_text")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    texts = html_text.extract_text(_table(spark, sf, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query("op3_quality_cnn")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf, "labels"), _fold(5) != 0)
    return quality.score_quality(docs, model).select(
        "doc_id",
        (_fold(5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


@_query("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf, "labels"), _fold(3) != 1)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (_fold(3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
        "passages",
    )


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# crc32 as a fold over the bytes of the decimal id: -1 stands for one shift
_MANIFEST = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 3 = 0 AS touched,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
parts AS (
  SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS grp
  FROM base),
leaves AS (
  SELECT doc_id, grp, idx, n,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
      CASE WHEN touched THEN translate(text, '{_CAPITALS}', '{_SMALL}') ELSE text END END) AS altered
  FROM parts),
nodes AS (
  SELECT grp, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY grp, level, idx // 8, n),
subroots AS (
  SELECT grp, level, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS m
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, m, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (m + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE m > 1 GROUP BY level, place // 8, m),
ways AS (
  SELECT l.doc_id, l.grp, l.idx, k.level, (l.idx // CAST(pow(8, k.level) AS BIGINT)) AS own, k.digest, k.idx AS node, l.altered
  FROM leaves l JOIN nodes k ON k.grp = l.grp AND k.n > 1 AND k.idx // 8 = l.idx // CAST(pow(8, k.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, l.grp, l.idx, s.level + t.level, s.place // CAST(pow(8, t.level) AS BIGINT), t.digest, t.place, l.altered
  FROM leaves l JOIN subroots s ON s.grp = l.grp
  JOIN tops t ON t.m > 1 AND t.place // 8 = s.place // CAST(pow(8, t.level + 1) AS BIGINT)),
steps AS (
  SELECT grp, idx, level, coalesce(string_agg(digest, '' ORDER BY node) FILTER (WHERE node < own), '') AS before,
    coalesce(string_agg(digest, '' ORDER BY node) FILTER (WHERE node > own), '') AS after
  FROM ways GROUP BY grp, idx, level),
folds AS (
  SELECT grp, idx, 0 AS level, altered AS digest FROM leaves
  UNION ALL
  SELECT f.grp, f.idx, f.level + 1, sha256(s.before || f.digest || s.after)
  FROM folds f JOIN steps s ON s.grp = f.grp AND s.idx = f.idx AND s.level = f.level),
ends AS (SELECT grp, idx, arg_max(digest, level) AS folded_root FROM folds GROUP BY grp, idx),
proofs AS (SELECT grp, idx, string_agg(before || after, '' ORDER BY level) AS proof FROM steps GROUP BY grp, idx)
SELECT l.doc_id, l.leaf, s.subroot, t.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  e.folded_root, e.folded_root = t.digest AS verified
FROM leaves l JOIN subroots s ON s.grp = l.grp JOIN tops t ON t.m = 1
JOIN ends e ON e.grp = l.grp AND e.idx = l.idx LEFT JOIN proofs p ON p.grp = l.grp AND p.idx = l.idx"""


@_query("op13_merkle_manifest", _MANIFEST)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    altered = F.when(touched, F.translate("text", _CAPITALS, _SMALL))
    return merkle.verify_documents(_table(spark, sf, "documents"), altered)


@_query("op12_config_packing")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return config_packing.pack_best_fit(docs, vocabulary("word_bpe_49k.json"), 0, keep_ids=False).drop("ids")


@_query("op11_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors, whitening.fit(vectors))
