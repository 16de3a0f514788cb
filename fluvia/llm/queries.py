"""The operators' queries over whole tables; ``oracle_sql`` has those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ball_tree,
    byte_bpe,
    language_ppm,
    link_trust,
    order_minhash,
    packing,
    page_graph,
    prefix_counts,
    robust_outliers,
    set_join,
    simhash,
    toxicity_cnn,
    turn_repair,
)
from .common import crc32_mod, read

TOKEN_LIMIT = 4096


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packed(read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with a digest of their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, by rules and by trust along links."""
    return link_trust.judge(read(spark, sf_dir, "pages"), link_trust.RULES)


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether it stays."""
    return robust_outliers.judge(read(spark, sf_dir, "documents"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, from a classifier fitted outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity_cnn.fit(docs, read(spark, sf_dir, "labels"))
    held_out = (crc32_mod("doc_id", 3) == 1).alias("held_out")
    predicted = (F.col("score") >= toxicity_cnn.CUT).cast("int").alias("predicted")
    return toxicity_cnn.score(docs, model).select("doc_id", held_out, "score", predicted)


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and how much of it fits the limit."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    counts = prefix_counts.token_counts(read(spark, sf_dir, "documents"), path, TOKEN_LIMIT)
    over = (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    return counts.select("doc_id", "n_bytes", "n_tokens", over, "fitting_chars")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    made = order_minhash.edited_copies(read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text("sketch").alias("fingerprint"),
        order_minhash.as_text("edited_sketch").alias("edited_fingerprint"),
        order_minhash.likeness("sketch", "edited_sketch").alias("near_edited"),
        order_minhash.likeness("sketch", "next_sketch").alias("near_next"),
    )


def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from models fitted outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    found = language_ppm.predict(docs, language_ppm.fit_on_rest(docs, folds=4, held_out=2))
    return found.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_page_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = page_graph.main_text(read(spark, sf_dir, "pages"), page_graph.trained())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and the component that links of two bits reach."""
    docs = read(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item among all documents."""
    return ball_tree.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return turn_repair.repair(read(spark, sf_dir, "conversations"))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose four-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return set_join.join(read(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 2 what SQL can express: host, path and rule of every page's url."""
    host, path = link_trust.url_host(F.col("url")), link_trust.url_path(F.col("url"))
    pages = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = link_trust.matching_rule(F.col("host"), F.col("path"), link_trust.RULES)
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of operator 3 what SQL can express: the base statistics of every document."""
    found = robust_outliers.measured(read(spark, sf_dir, "documents"))
    failed = robust_outliers.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


URL_RULES_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS by_rule FROM r
"""

BASE_QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
n AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
x AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g WHERE g IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM x, range(5) AS t(j) WHERE k > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
q AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^ \t\n\x0b\x0c\r]') GROUP BY r)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
coalesce(q.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_words, 0) < 10 OR 100 * coalesce(c.n, 0) > 20 * n_words AS base_failed
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN q USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_harmonic_packing": op1_harmonic_packing,
        "op2_link_trust": op2_link_trust,
        "op3_robust_outliers": op3_robust_outliers,
        "op4_toxicity_cnn": op4_toxicity_cnn,
        "op5_prefix_token_counts": op5_prefix_token_counts,
        "op6_order_minhash": op6_order_minhash,
        "op7_language_ppm": op7_language_ppm,
        "op8_byte_bpe_round_trip": op8_byte_bpe_round_trip,
        "op9_page_graph": op9_page_graph,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_ball_tree_search": op11_ball_tree_search,
        "op12_turn_repair": op12_turn_repair,
        "op13_set_join": op13_set_join,
        "url_rules": url_rules,
        "base_quality": base_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_ball_tree_search": ball_tree.SQL, "url_rules": URL_RULES_SQL, "base_quality": BASE_QUALITY_SQL}
