"""URL filters with redirect equivalence.

Rules judge a url by host and path. Urls that redirect to each other or name each other as canonical
are aliases: connected components over those links carry block decisions to every alias, unless some
alias is explicitly allowed. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import lower_ascii
from weftline.llm.graph import connected_components

#: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules that are compiled into one expression at most; a longer list becomes a table.
MAX_RULES = 500


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Among rules of one text the
    first in the list counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def match_rules(df: DataFrame, rules: list[tuple[str, str, str]], most: int = MAX_RULES) -> DataFrame:
    """df (host, path) with hit: struct(rule, verdict) of the longest rule that fits, else null. A list of over
    `most` rules is grouped by host; a row is joined with the hosts above its own, one per label, each an equi-join
    key, so no row meets more rules than those of its hosts."""
    if len(rules) <= most:
        return df.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    spark = df.sparkSession
    numbered = spark.createDataFrame([(i, v, h, p) for i, (v, h, p) in enumerate(rules)], "i long, verdict string, h string, p string")
    text = F.concat("h", "p")
    table = numbered.groupBy("h").agg(F.collect_list(F.struct(F.length(text).alias("n"), (-F.col("i")).alias("i"), text.alias("rule"), "verdict", "p")).alias("rules"))
    named = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = named.select("host", "path", F.explode(above).alias("h")).join(table, "h")
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["p"]))
    best = met.select("host", "path", F.array_max(fits).alias("best")).where("best is not null")
    best = best.groupBy("host", "path").agg(F.max("best").alias("best")).select("host", "path", F.struct("best.rule", "best.verdict").alias("hit"))
    return df.join(best, ["host", "path"], "left")


def url_key(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case: what a server is asked for."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(lower_ascii(head), F.substr(bare, F.length(head) + 1))


def _resolve(href: Column, base: Column) -> Column:
    """An absolute address for a link of a page."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .otherwise(F.concat(folder, href))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) keys of canonical links and refresh redirects found in the html of pages."""
    hinted = pages.select("url", "html").where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    attr = r"""\s*=\s*["']?"""
    tags = F.concat(
        F.transform(
            F.filter(
                F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)),
                lambda t: t.rlike(rf"(?is)\brel{attr}[^\"'>]*\bcanonical\b"),
            ),
            lambda t: F.regexp_extract(t, rf"(?is)\bhref{attr}([^\"'\s>]+)", 1),
        ),
        F.transform(
            F.filter(
                F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)),
                lambda t: t.rlike(rf"(?is)\bhttp-equiv{attr}refresh\b"),
            ),
            lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1),
        ),
    )
    found = hinted.select("url", F.explode(tags).alias("href")).where("href <> ''")
    found = found.withColumn("href", F.regexp_replace("href", "&amp;", "&"))
    return found.select(url_key(F.col("url")).alias("src"), url_key(_resolve(F.col("href"), F.col("url"))).alias("dst"))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    compiled: int = MAX_RULES,
) -> DataFrame:
    """Judges every row of pages (id, url, html).

    Returns id, host, path, rule, verdict, and component (null without aliases). A url keeps the
    verdict of its own longest rule. Without one it takes that of its aliases: allow if any alias is
    explicitly allowed, else block if any is blocked, else allow. Aliases that are no page but fit a
    rule count too. redirects(src, dst) adds links known from a crawl.

    Null or malformed urls have empty host and path, fit no rule, have no alias and are allowed; null
    html has no links; rows of one url are judged alike, each row is returned; other columns are ignored.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(base)
    if redirects is not None:
        links = links.union(redirects.select(url_key(F.col("src")), url_key(F.col("dst"))))
    comp = connected_components(links, "src", "dst")

    def judged(df: DataFrame, url: str) -> DataFrame:
        parts = df.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
        hit = match_rules(parts, rules, compiled)
        return hit.withColumn("rule", F.col("hit.rule")).withColumn("own", F.col("hit.verdict")).drop("hit")

    votes = judged(comp, "node").groupBy("component").agg(
        F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked")
    )
    named = comp.join(votes, "component")
    out = judged(base.select("id", "url"), "url").withColumn("key", url_key(F.col("url")))
    out = out.join(named, F.col("key") == F.col("node"), "left")
    passed = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", passed).alias("verdict"), "component")
