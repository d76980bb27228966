"""The queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.llm.common import table
from plinth.llm.oracles import fill_in_middle_sql, prefix_trie_sql, quality_rules_sql, secret_scan_sql


def _vocab(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A dated block list of the corpus: (list, kind, pattern, action, date).
BLOCK_LIST = (
    ("gambling", "domain", "casino-win.example.com", "add", "2024-01-10"),
    ("gambling", "domain", "casino-win.example.com", "remove", "2024-05-01"),
    ("gambling", "domain", "casino-win.example.com", "add", "2024-07-15"),
    ("gambling", "host", "free-bets.example.com", "add", "2024-02-01"),
    ("tracking", "domain", "ads-track.example.com", "add", "2023-06-01"),
    ("tracking", "host", "m.ads-track.example.com", "add", "2024-03-01"),
    ("tracking", "host", "m.ads-track.example.com", "remove", "2024-11-01"),
    ("spam", "domain", "spam-farm.example.com", "add", "2024-01-01"),
    ("spam", "host", "www.cheap-pills.example.com", "add", "2024-04-01"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-09-01"),
    ("spam", "prefix", "tionsh.example.net/de", "add", "2024-06-01"),
    ("spam", "prefix", "blog.tionsh.example.com/es", "add", "2024-02-15"),
    ("spam", "prefix", "blog.tionsh.example.com/es", "remove", "2024-10-15"),
    ("adult", "domain", "adult-x.example.net", "add", "2023-01-01"),
    ("adult", "domain", "adult-x.example.net", "remove", "2024-08-01"),
    ("adult", "domain", "adult-x.example.net", "add", "2024-08-01"),
)
#: The tables name no fetch time: a capture's day in 2024 follows from its page_id.
FETCHED = "timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id * 37, 366) as int))"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from plinth.llm.url_filter import ENTRIES, url_filter

    rows = spark.createDataFrame(list(BLOCK_LIST), "list string, kind string, pattern string, action string, at string").withColumn("at", F.to_timestamp("at"))
    assert len(rows.columns) == len(ENTRIES.split(","))
    return url_filter(table(spark, sf_dir, "pages").withColumn("fetched_at", F.expr(FETCHED)), rows)


OP1_SQL = """
WITH entries(list, kind, pattern, action, day) AS (VALUES
  {values}),
dated AS (SELECT DISTINCT list, kind || ':' || pattern AS key, action, day::TIMESTAMP AS day FROM entries),
valid AS (SELECT list, key, action, day AS valid_from, lead(day) OVER (PARTITION BY list, key ORDER BY day, action) AS valid_to FROM dated),
captures AS (SELECT page_id, url, nullif(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
    TIMESTAMP '2024-01-01' + to_days(((page_id * 37) % 366)::INTEGER) AS fetched_at FROM pages),
hits AS (SELECT page_id, list, key FROM captures JOIN valid ON action = 'add' AND fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) AND
    (key = 'host:' || host OR key = 'domain:' || host OR ends_with('domain:' || host, '.' || substr(key, 8)) AND starts_with(key, 'domain:')
     OR starts_with(key, 'prefix:') AND (host || path = substr(key, 8) OR starts_with(host || path, substr(key, 8) || '/'))))
SELECT page_id, url, host, coalesce(string_agg(DISTINCT list || '=' || key, ',' ORDER BY list || '=' || key), '') AS matches,
    count(DISTINCT list) AS n_lists, count(list) > 0 AS blocked
FROM captures LEFT JOIN hits USING (page_id) GROUP BY page_id, url, host
""".format(values=",\n  ".join(map(str, BLOCK_LIST)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.secret_scan import report

    return report(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.tokenbin import document_digests

    return document_digests(table(spark, sf_dir, "documents"), _vocab("byte_bpe_50k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), _vocab("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("js_chars", "js_words")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.quality_model import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.toxicity import CATEGORIES, toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *[f"p_{c}" for c in CATEGORIES], "is_toxic")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.prefix_trie import shared_beginnings

    return shared_beginnings(table(spark, sf_dir, "conversations"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.piece_bpe import digests

    return digests(table(spark, sf_dir, "documents"), _vocab("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plinth.llm.fill_in_middle import digests

    return digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_files": op3_token_files,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_word_bpe": op6_word_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_text": op8_html_text,
    "op9_quality_model": op9_quality_model,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": OP1_SQL,
    "op2_secret_scan": secret_scan_sql(),
    "op7_quality_rules": quality_rules_sql(),
    "op11_prefix_trie": prefix_trie_sql(),
    "op13_fill_in_middle": fill_in_middle_sql(),
}
