"""Queries over what changes and views of documents lead to."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import consolidate, ingest, views
from weftline.plans import queries as q
from weftline.plans.queries import CHUNK_SQL, NTZ, OBS_SQL, query
from weftline.sources.fixtures import table, text_units, time_units, with_tables
from weftline.streaming import cache

TAGGED = "d AS (SELECT o_orderkey AS id, o_orderkey // 40 AS document_id FROM orders), own AS (SELECT id FROM d WHERE document_id % 50 = 7)"


@query(f"""WITH {OBS_SQL}, {TAGGED}, f AS (SELECT id, unnest(source_ids) AS s FROM ob), g AS (SELECT DISTINCT id FROM f WHERE s IN (SELECT id FROM own)),
a AS (SELECT id FROM own UNION SELECT s FROM f WHERE id IN (SELECT id FROM g))
SELECT 'tagged' AS what, id FROM own UNION ALL SELECT 'delete', id FROM g UNION ALL SELECT 'consolidate', id FROM a""")
def tag_change_cascade(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 40).alias("document_id"), F.array(F.lit("old")).alias("tags"), F.lit("2024-01-01").cast(NTZ).alias("consolidated_at"))
    changed = u.where("document_id % 50 = 7").select("document_id").distinct().withColumn("tags", F.array(F.lit("new")))
    out, gone, _ = views.tag_cascade(u, q._observations(spark, sf), changed)
    tagged = out.where(F.array_contains("tags", "new")).select(F.lit("tagged").alias("what"), "id")
    return tagged.union(gone.select(F.lit("delete"), "id")).union(out.where("consolidated_at is null").select(F.lit("consolidate"), "id"))


@query(with_tables("text_units", rest="""s AS (SELECT id FROM text_units WHERE contains(lower(text), 'the ') AND tags IS NOT NULL AND list_has_all(tags, ['en']))
SELECT 'unit' AS what, id, NULL::BIGINT AS to_id FROM s UNION ALL SELECT 'edge', a.id, b.id FROM s a JOIN s b ON b.id = a.id + 1"""))
def graph_view_filtered(spark, sf):
    u = text_units(spark, sf)
    edges = u.select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"))
    shown, kept = views.graph_view(u, edges, text="THE ", tags=["en"])
    return shown.select(F.lit("unit").alias("what"), "id", F.lit(None).cast("long").alias("to_id")).union(kept.select(F.lit("edge"), "from_id", "to_id"))


@query("WITH " + CHUNK_SQL.format(n=500, src="documents") + ", t AS (SELECT doc_id, chunk_index, length(chunk_text) AS n, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS place FROM c) SELECT doc_id, chunk_index::INT AS chunk_index, n::INT AS n, total FROM t WHERE place >= 2 AND place < 5")
def document_chunk_pages(spark, sf):
    c = ingest.fixed_chunks(table(spark, sf, "documents"), 500)
    return views.chunk_page(c, 2, 3).select("doc_id", "chunk_index", F.length("chunk_text").alias("n"), "total")


@query("""WITH e AS (SELECT event_type AS kind, coalesce(CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END, ts) AS t FROM events), s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS bucket),
g AS (SELECT date_trunc('day', t)::TIMESTAMP AS bucket, count(*) FILTER (kind = 'view') AS "view", count(*) FILTER (kind = 'purchase') AS purchase, count(*) AS total FROM e GROUP BY 1)
SELECT strftime(bucket, '%Y-%m-%d') AS bucket, coalesce("view", 0) AS "view", coalesce(purchase, 0) AS purchase, coalesce(total, 0) AS total FROM s LEFT JOIN g USING (bucket)""")
def time_series_wide(spark, sf):
    t = time_units(spark, sf).withColumn("occurred", F.when(F.col("id") % 3 == 0, F.col("event_date") + F.expr("interval 1 day")))
    s = views.wide_series(t, ["occurred", "event_date"], "fact_type", ["view", "purchase"], "7d", "2024-01-30 12:00:00")
    return s.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("""WITH t AS (SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN p_name || '*' END AS name, CASE WHEN p_size % 5 = 0 THEN p_brand END AS brand FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey + 1000000, p_name, NULL FROM part WHERE p_partkey < 20)
SELECT key, coalesce(t.name, p_name) AS name, coalesce(t.brand, p_brand) AS brand, CASE WHEN t.key IS NULL THEN NULL WHEN p_partkey IS NULL THEN 'create' WHEN coalesce(t.name, p_name) = p_name THEN 'keep' ELSE 'update' END AS action
FROM (SELECT *, p_partkey AS key FROM part) p FULL JOIN t USING (key)""")
def template_apply(spark, sf):
    p = table(spark, sf, "part")
    old = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    some = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("*"))).alias("name"), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).alias("brand"))
    new = old.where("key < 20").select(F.col("key") + 1_000_000, "name", F.lit(None).cast("string"))
    return views.with_template(old, some.union(new), "key", ["name", "brand"])


@query("SELECT CASE WHEN user_id % 3 <> 0 THEN user_id END AS document_id, count(*) AS units FROM events WHERE props->>'$.k' = '3' GROUP BY 1")
def manifest_documents(spark, sf):
    t = time_units(spark, sf).withColumnRenamed("props", "manifest").withColumn("document_id", F.when(F.col("document_id") % 3 != 0, F.col("document_id")))
    return views.documents_by_manifest(t, "k", "3")


@query("""SELECT user_id AS id, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(*) AS n,
 count(*) FILTER (epoch_us(TIMESTAMP '2024-04-05') - epoch_us(ts) < 30 * 86400000000) AS recent, round(count(*) FILTER (epoch_us(TIMESTAMP '2024-04-05') - epoch_us(ts) < 30 * 86400000000) / 30.0, 6) AS recent_density FROM events GROUP BY 1""")
def evidence_spans(spark, sf):
    e = time_units(spark, sf).withColumnRenamed("id", "event").withColumnRenamed("document_id", "id")
    t = consolidate.trend(e, "id", F.col("event_date"), F.lit("2024-04-05").cast(NTZ))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.select("id", day("first").alias("first_day"), day("last").alias("last_day"), "n", "recent", F.round(F.col("recent") / 30.0, 6).alias("recent_density"))


CACHE_SQL = """c AS (SELECT (event_id // 16)::VARCHAR AS key, event_id AS seq, CASE event_type WHEN 'view' THEN 'put' WHEN 'click' THEN 'pin' WHEN 'purchase' THEN 'release' END AS kind,
 'c' || (user_id % 3) AS command, epoch_us(ts) AS made, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) + 36 * 3600000000 END AS expires FROM events WHERE event_type IN ('view', 'click', 'purchase'))"""


def _cache_commands(spark, sf):
    t = time_units(spark, sf)
    kind = F.when(F.col("fact_type") == "view", "put").when(F.col("fact_type") == "click", "pin").when(F.col("fact_type") == "purchase", "release")
    expires = F.when(F.col("id") % 7 != 0, F.col("event_date") + F.expr("interval 36 hours"))
    return t.select(F.floor(F.col("id") / 16).cast("string").alias("key"), F.col("id").alias("seq"), kind.alias("kind"), F.concat(F.lit("c"), (F.col("document_id") % 3).cast("string")).alias("command"), expires.alias("expires"), F.col("event_date").alias("at")).where("kind is not null")


@query(f"""WITH {CACHE_SQL}, h AS (SELECT *, lag(kind) OVER (PARTITION BY key, command ORDER BY made, seq) AS was FROM c WHERE kind <> 'put'),
d AS (SELECT key, seq, made, CASE WHEN kind = 'pin' AND was IS DISTINCT FROM 'pin' THEN 1 WHEN kind = 'release' AND was = 'pin' THEN -1 ELSE 0 END AS change FROM h),
p AS (SELECT key, made, seq, expires, coalesce(lead(made) OVER w, epoch_us(TIMESTAMP '2024-02-10')) AS renewed, lead(seq) OVER w AS by_seq FROM c WHERE kind = 'put' WINDOW w AS (PARTITION BY key ORDER BY made, seq)),
m AS (SELECT key, seq, made, renewed, expires, greatest(expires, made) AS t FROM p WHERE expires IS NOT NULL
 UNION ALL SELECT p.key, p.seq, p.made, renewed, expires, d.made FROM p JOIN d ON d.key = p.key AND d.made >= p.expires AND (d.made, d.seq) > (p.made, p.seq) WHERE change = -1),
o AS (SELECT m.key, m.seq, m.expires, m.t, (SELECT coalesce(sum(change), 0) FROM d WHERE d.key = m.key AND (d.made < m.t OR d.made = m.t AND (m.t <> m.expires OR m.t = m.made OR change = -1))) AS pins FROM m WHERE m.t <= m.renewed AND m.t <= epoch_us(TIMESTAMP '2024-02-10'))
SELECT key, expires, min(t) AS removed_at FROM o WHERE pins = 0 GROUP BY key, seq, expires""")
def cache_removals(spark, sf):
    return cache.removals(_cache_commands(spark, sf), "2024-02-10")


@query("""WITH r AS (SELECT event_id - 1 AS key, event_id AS command, event_type <> 'error' AS done FROM events), c AS (SELECT event_id AS key, CASE WHEN event_id % 9 <> 0 THEN ts END AS expires_at FROM events WHERE event_type = 'view')
SELECT key, command, expires_at IS NOT NULL AND expires_at <= TIMESTAMP '2024-01-12' AS pinned FROM r JOIN c USING (key) WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-12' OR NOT done""")
def cache_lookup(spark, sf):
    t = time_units(spark, sf)
    entries = t.where("fact_type = 'view'").select(F.col("id").alias("key"), F.when(F.col("id") % 9 != 0, F.col("event_date")).alias("expires_at"))
    commands = t.select((F.col("id") - 1).alias("key"), F.col("id").alias("command"), (F.col("fact_type") != "error").alias("done"))
    return cache.lookup(commands.select("key", "command"), entries, commands, "2024-01-12").select("key", "command", "pinned")
