"""The named queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm.decontam import benchmark_hits
from panelweave.llm.importance import resample
from panelweave.llm.jaccard_join import similar_texts
from panelweave.llm.langmix import held_out_languages
from panelweave.llm.licenses import known_digests, scan_licenses, scan_sql
from panelweave.llm.line_cuckoo import dedup_lines
from panelweave.llm.merkle import audit_sql, tampered_audit
from panelweave.llm.mih import nearest_vectors
from panelweave.llm.mixing import mix
from panelweave.llm.simhash import near_duplicates
from panelweave.llm.token_align import alignment_report
from panelweave.llm.token_planes import tokens_round_trip
from panelweave.llm.url_cascade import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_planes")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, (SELECT min(o.doc_id) FROM r JOIN d o ON r.b = o.k WHERE r.a = d.k)) AS component_id
FROM d LEFT JOIN n USING (k)
"""


@query("op6_ngram_jaccard_join", _OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"), size=5, percent=80)


_OP9_WORDS = "regexp_extract_all(" + _LOWER_SQL.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_OP9_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {_OP9_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT k, item, i, pos.n FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
cover AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k),
found AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (k) LEFT JOIN found USING (k)
"""


@query("op9_benchmark_decontamination", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10).drop("items")


_OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT k, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT k, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d)),
heavy AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k, doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN heavy USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY k
"""


@query("op8_line_dedup", _OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=3, min_chars=20).drop("text")


@query("op10_language_mixture")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_languages(table(spark, sf_dir, "documents"), fold=2)


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_OP3_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS k, page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (
  SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE place = 1) AS best USING (k)
"""


@query("op3_url_cascade", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op5_multi_index_hashing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).docs.drop("th", "source")


@query("op2_license_digests", scan_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_digests(spark))


@query("op7_importance_resampling")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return resample(table(spark, sf_dir, "documents"), good, share=0.5)


@query("op12_merkle_manifest", audit_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_audit(table(spark, sf_dir, "documents"))


@query("op13_simhash_pigeonhole")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, distance=3)


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
