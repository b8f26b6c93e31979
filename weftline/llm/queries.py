"""The queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import quality_rules, toxicity
from weftline.llm.common import table
from weftline.llm.fim import fill_in_middle, restored
from weftline.llm.fingerprints import fingerprint_edits
from weftline.llm.html_text import main_text
from weftline.llm.language import identify
from weftline.llm.lattice_lm import lattice_scores
from weftline.llm.mixing import Mix
from weftline.llm.packing import pack
from weftline.llm.rolling import rolling_medians
from weftline.llm.simhash import hex_digits, near_duplicates
from weftline.llm.suffix_dedup import PASSAGE, without_repeats
from weftline.llm.url_filter import filter_urls


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = without_repeats(documents(spark, sf_dir).select("doc_id", "text"), shorter=PASSAGE)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_in_passages")


def op3_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return toxicity.score(d, toxicity.train(d, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return quality_rules.judge(d, quality_rules.train(d, table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Mix(documents(spark, sf_dir).select("doc_id", "source", "text")).taken()
    return t.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = restored(fill_in_middle(documents(spark, sf_dir)))
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return d.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op13_rolling_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_medians(table(spark, sf_dir, "clicks"))


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_lattice_scores": op3_lattice_scores,
        "op4_packing": op4_packing,
        "op5_main_text": op5_main_text,
        "op6_fingerprints": op6_fingerprints,
        "op7_toxicity": op7_toxicity,
        "op8_quality_rules": op8_quality_rules,
        "op9_mixing": op9_mixing,
        "op10_simhash": op10_simhash,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_language": op12_language,
        "op13_rolling_medians": op13_rolling_medians,
    }


#: Rules, aliases over canonical links and refreshes (connected components by recursion), verdicts.
OP1_SQL = r"""WITH RECURSIVE p AS (SELECT page_id, url, html FROM pages),
hinted AS (SELECT url, html FROM p WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')),
tags AS (SELECT url, unnest(list_concat(
  [regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) FOR t IN regexp_extract_all(html, '(?is)<link\b[^>]*>') IF regexp_matches(t, '(?is)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')],
  [regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FOR t IN regexp_extract_all(html, '(?is)<meta\b[^>]*>') IF regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')])) AS href FROM hinted),
found AS (SELECT url, replace(href, '&amp;', '&') AS href, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site,
  regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder, regexp_extract(url, '(?s)^(.*?:)//', 1) AS scheme FROM tags WHERE href <> ''),
links AS (SELECT url AS a, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN scheme || href
  WHEN starts_with(href, '/') THEN site || href ELSE CASE WHEN folder = site THEN site || '/' ELSE folder END || href END AS b FROM found),
keyed AS (SELECT regexp_replace(a, '(?s)#.*$', '') AS a, regexp_replace(b, '(?s)#.*$', '') AS b FROM links),
low AS (SELECT translate(regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(a, length(regexp_extract(a, '(?s)^(.*?://[^/?#]*)', 1)) + 1) AS a,
  translate(regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(b, length(regexp_extract(b, '(?s)^(.*?://[^/?#]*)', 1)) + 1) AS b FROM keyed),
edges AS (SELECT a, b FROM low WHERE a <> b UNION SELECT b, a FROM low WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
every AS (SELECT url AS u FROM p WHERE url IS NOT NULL UNION SELECT node FROM comp),
parts AS (SELECT u, coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM every),
rules(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (SELECT u, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS own FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1),
votes AS (SELECT component, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM comp LEFT JOIN hit ON u = node GROUP BY 1),
own_key AS (SELECT u, translate(regexp_extract(regexp_replace(u, '(?s)#.*$', ''), '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(regexp_replace(u, '(?s)#.*$', ''), length(regexp_extract(regexp_replace(u, '(?s)#.*$', ''), '(?s)^(.*?://[^/?#]*)', 1)) + 1) AS key FROM every)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN parts ON parts.u = url LEFT JOIN hit ON hit.u = url LEFT JOIN own_key k ON k.u = url LEFT JOIN comp ON node = key LEFT JOIN votes USING (component)"""

#: Every window of 400 bytes of every text, counted by digest; and those of 200 bytes.
OP2_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
n AS (SELECT r, doc_id, b, octet_length(b) AS n, hex(b) AS x FROM d),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT r, x, unnest(range(0, greatest(n - 399, 0))) AS i FROM n)),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM c)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS f FROM s),
k AS (SELECT r, i, sum(f) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
v AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM k GROUP BY 1, 2),
o AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM v),
q AS (SELECT o.r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept FROM o JOIN n USING (r) GROUP BY 1),
w2 AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT r, x, unnest(range(0, greatest(n - 199, 0))) AS i FROM n)),
s2 AS (SELECT r, i FROM w2 WHERE m IN (SELECT m FROM w2 GROUP BY m HAVING count(*) > 1)),
g2 AS (SELECT r, least(200, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -200)) AS more FROM s2),
p2 AS (SELECT r, sum(more)::BIGINT AS n_in_passages FROM g2 GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256, coalesce(n_in_passages, 0) AS n_in_passages FROM n LEFT JOIN q USING (r) LEFT JOIN p2 USING (r)"""

#: Numbers from the hash of the id; the cuts are code points.
OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t)::BIGINT AS n, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS v FROM d),
y AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR v[3] % 100 >= 90 THEN 'plain' WHEN v[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(v[1] % (n + 1), v[2] % (n + 1)) AS a, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS b FROM x),
z AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM z"""

#: Sorted lists of each window, and of the distances from its median.
OP13_SQL = """WITH c AS (SELECT click_id, kind, ts, CASE WHEN NOT isnan(value) AND abs(value) < 4e15 THEN floor(100 * value + 0.5)::BIGINT END AS cents FROM clicks),
r AS (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ts NULLS LAST, kind NULLS FIRST, cents NULLS FIRST) AS k FROM c),
w AS (SELECT click_id, kind, cents, list(cents) FILTER (cents IS NOT NULL) OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL '899.999999 seconds' PRECEDING AND CURRENT ROW) AS v FROM r WHERE k = 1 AND ts IS NOT NULL),
s AS (SELECT click_id, kind, cents, list_sort(v) AS v, coalesce(len(v), 0)::BIGINT AS n FROM w),
m AS (SELECT *, CASE WHEN n > 0 THEN v[(n + 1) // 2] + v[n // 2 + 1] END AS median2 FROM s),
d AS (SELECT *, list_sort([abs(2 * x - median2) FOR x IN v]) AS e FROM m),
f AS (SELECT click_id, kind, cents, n, median2, CASE WHEN n > 0 THEN e[(n + 1) // 2] + e[n // 2 + 1] END AS mad4 FROM d)
SELECT click_id, kind, n, median2, mad4, 2 * abs(2 * cents - median2) > 2 * mad4 AS far FROM f"""


def oracle_sql() -> dict[str, str]:
    """The other queries hash with seeds that SQL has not, tokenize, or learn: tests compare them with brute force."""
    return {"op1_url_filter": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op11_fill_in_middle": OP11_SQL, "op13_rolling_medians": OP13_SQL}
