"""The queries of this subpackage: op<N>_<name>(spark, sf_dir), and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulore.llm.audio_fingerprint import align_all
from tabulore.llm.common import is_held_out, table
from tabulore.llm.exact_dedup import exact_dedup
from tabulore.llm import language_id, quality
from tabulore.llm.mixing import mix
from tabulore.llm.packing import pack
from tabulore.llm.simhash import simhash_groups
from tabulore.llm.suffix_dedup import suffix_dedup
from tabulore.llm.token_file import read_tokens, token_folder, write_tokens
from tabulore.llm.url_filter import url_filter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as recordings: their UTF-8 bytes are 8-bit samples. Queries: ids divisible by 50."""
    return align_all(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~is_held_out(F.col("doc_id"))))
    out = language_id.language_id(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~is_held_out(F.col("doc_id"))))
    scored = quality.quality(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op6_token_file(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, token_folder(spark))
    return read_tokens(spark, manifest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact_dedup(table(spark, sf_dir, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def _level_sql(name: str, rows: str) -> str:
    """Rows (n, bad, prior) with the prior's strength s."""
    rho = "(sum(n * (bad / n - prior) * (bad / n - prior)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0)"
    return f"{name} AS (SELECT r.*, s FROM ({rows}) r, (SELECT 1 / least(greatest(coalesce({rho}, 0), 1e-4), 0.5) - 1 AS s FROM ({rows}) WHERE n > 0))"


_TWO_LABELS = "'ac.uk', 'co.uk', 'gov.uk', 'ltd.uk', 'me.uk', 'net.uk', 'nhs.uk', 'org.uk', 'plc.uk', 'sch.uk', 'com.au', 'edu.au', 'gov.au', 'net.au', 'org.au', 'co.nz', 'govt.nz', 'net.nz', 'org.nz', 'co.za', 'org.za', 'ac.jp', 'co.jp', 'go.jp', 'ne.jp', 'or.jp', 'co.kr', 'or.kr', 'com.cn', 'edu.cn', 'gov.cn', 'net.cn', 'org.cn', 'com.hk', 'com.sg', 'com.tw', 'ac.in', 'co.in', 'gov.in', 'net.in', 'org.in', 'com.br', 'gov.br', 'net.br', 'org.br', 'com.ar', 'com.mx', 'com.co', 'com.tr', 'com.ua', 'com.pl', 'co.il', 'co.id', 'co.th'"
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))]
OP1_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages), h AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u), r AS (
  SELECT *, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for fits, rule, _ in _FITS)} END AS rule, CASE {" ".join(f"WHEN {fits} THEN '{says}'" for fits, _, says in _FITS)} END AS says FROM h), servers AS (
  SELECT host, regexp_replace(regexp_replace(host, '^[^\\[]*@', ''), ':[0-9]*$', '') AS server, count(*) AS n, count_if(says = 'block') AS bad FROM r GROUP BY host), labels AS (
  SELECT *, string_split(server, '.') AS l, regexp_full_match(server, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') OR starts_with(server, '[') AS ip FROM servers), hosts AS (
  SELECT host, n, bad, CASE WHEN ip THEN server WHEN len(l) >= 2 AND (l[-2] || '.' || l[-1]) IN ({_TWO_LABELS}) THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix,
    CASE WHEN ip THEN server WHEN len(l) > 2 AND (l[-2] || '.' || l[-1]) IN ({_TWO_LABELS}) THEN l[-3] || '.' || l[-2] || '.' || l[-1]
      WHEN len(l) > 2 THEN l[-2] || '.' || l[-1] ELSE server END AS domain FROM labels), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL), tops AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM domains) AS prior FROM domains GROUP BY suffix),
{_level_sql("t", "SELECT * FROM tops")},
{_level_sql("d", "SELECT domains.*, (t.bad + t.prior * s) / (t.n + s) AS prior FROM domains JOIN t USING (suffix)")},
{_level_sql("k", "SELECT hosts.*, (d.bad + d.prior * s) / (d.n + s) AS prior FROM hosts JOIN d ON hosts.domain = d.domain AND hosts.suffix = d.suffix")}, j AS (
  SELECT host, (bad + prior * s) / (n + s) AS share, n + s AS weight FROM k)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN share - 1.645 * sqrt(share * (1 - share) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN j USING (host)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op8_exact_dedup": OP8_SQL}
