"""Queries over listings, details, views and small state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.vector import cosine, l2
from weftline.operators import consolidate, entities, evidence, graph, ingest, listing, rows, search, stats, vectors
from weftline.plans import queries as q
from weftline.plans.queries import CHUNK_SQL, KNN_SQL, OBS_SQL, SIM, TASK_SQL, query
from weftline.sources.fixtures import table, text_units, time_units, unit_entities, vector_units, with_tables
from weftline.streaming import jobs


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name, CASE WHEN lower(name) = 'red plate' THEN 'exact' WHEN starts_with(lower(name), 'red plate') THEN 'prefix' WHEN contains(lower(name), 'red plate') THEN 'contains' ELSE 'reverse' END AS match
FROM n WHERE contains(lower(name), 'red plate') OR starts_with('red plate', lower(name)) OR lower(name) = 'red plate'""")
def name_candidates(spark, sf):
    return listing.name_candidates(q._part_names(spark, sf), "Red Plate")


@query(with_tables("text_units", rest="s AS (SELECT id, CASE WHEN fact_type = 'observation' THEN NULL WHEN id % 4 = 0 THEN 'done' WHEN id % 5 = 0 THEN 'failed' ELSE 'pending' END AS state FROM text_units) SELECT state, count(*) AS n FROM s GROUP BY 1"))
def consolidation_states(spark, sf):
    t = F.col("event_date")
    u = text_units(spark, sf).withColumns({"consolidated_at": F.when(F.col("id") % 4 == 0, t), "failed_at": F.when(F.col("id") % 5 == 0, t)})
    return listing.consolidation_state(u).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("text_units", rest="h AS (SELECT id FROM text_units WHERE tags IS NOT NULL AND list_has_any(tags, ['en']) AND contains(id::VARCHAR, '1')) SELECT id, (SELECT count(*) FROM h) AS total FROM h ORDER BY id LIMIT 10 OFFSET 5"))
def document_listing(spark, sf):
    return listing.list_documents(text_units(spark, sf), "1", ["en"], "any_strict", 5, 10)


@query(with_tables("vector_units", rest=KNN_SQL + ", n AS (SELECT id FROM vector_units WHERE fact_type <> 'world' ORDER BY event_date DESC, id LIMIT 200) SELECT from_id, to_id, weight FROM sl WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)"))
def memory_graph_edges(spark, sf):
    return listing.memory_graph(vector_units(spark, sf), q.semantic_links(spark, sf), 200, F.col("fact_type") != "world")[1].select("from_id", "to_id", "weight")


@query(with_tables("vector_units", rest="""p AS (SELECT a.id AS s, b.id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS w FROM vector_units a JOIN vector_units b ON a.id < 4 AND b.id >= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w DESC, id) AS k FROM p WHERE w >= 0.2) SELECT id, max(w) AS score FROM r WHERE k <= 50 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60"""))
def ann_expansion(spark, sf):
    u = vector_units(spark, sf).select("id", "embedding")
    found = vectors.search(vectors.build(u.where("id >= 4")), u.where("id < 4"), 50, 0.2)
    best = found.groupBy("id").agg(F.max("similarity").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(60)


@query(f"SELECT vec_id AS id, {SIM} AS similarity FROM embeddings WHERE {SIM} >= 0.3 ORDER BY 2 DESC, 1 LIMIT 20")
def graph_seed_fallback(spark, sf):
    s = search.semantic_arm(vector_units(spark, sf), q.one_vector(spark, sf), 20)
    return s.orderBy(F.desc("similarity"), "id").limit(20).select("id", "similarity")


@query(with_tables("vector_units", rest=f"""h AS (SELECT id, fact_type, {SIM} AS similarity FROM vector_units WHERE fact_type = 'world' AND {SIM} >= 0.1)
SELECT id, fact_type, similarity, 'index' AS origin FROM h UNION ALL SELECT id, fact_type, {SIM}, 'scan' FROM vector_units WHERE fact_type NOT IN (SELECT fact_type FROM h) AND {SIM} >= 0.2"""))
def fallback_arms(spark, sf):
    s = vector_units(spark, sf).select("id", "fact_type", F.round(cosine(F.col("embedding"), q.one_vector(spark, sf)), 6).alias("similarity"))
    hits = s.where("fact_type = 'world' and similarity >= 0.1").withColumn("origin", F.lit("index"))
    return listing.missing_arms(hits, s.where("similarity >= 0.2").withColumn("origin", F.lit("scan")))


@query("""WITH o AS (SELECT doc_id AS id, doc_id AS rank, doc_id // 10 AS b FROM documents WHERE doc_id % 10 = 0), f AS (SELECT o.id, o.rank, d.doc_id AS source_id, row_number() OVER (PARTITION BY o.id ORDER BY d.doc_id) - 1 AS pos, ceil(length(d.text) / 4.0)::BIGINT AS tokens FROM o JOIN documents d ON d.doc_id // 10 = o.b),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS own FROM f), a AS (SELECT *, sum(tokens) OVER (ORDER BY rank, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM p WHERE own <= 3000)
SELECT id, source_id, tokens, spent FROM a WHERE spent <= 20000""")
def source_fact_budget(spark, sf):
    u = text_units(spark, sf)
    o = u.groupBy(F.floor(F.col("id") / 10).alias("b")).agg(F.array_sort(F.collect_list("id")).alias("source_ids"))
    o = o.select((F.col("b") * 10).alias("id"), (F.col("b") * 10).alias("rank"), "source_ids")
    return listing.source_facts(o, u, 3000, 20_000).select("id", "source_id", "tokens", "spent")


@query(f"SELECT vec_id AS id, round({SIM}, 4) AS relevance FROM embeddings WHERE vec_id NOT IN (0, 10) AND label % 2 = 0 ORDER BY {SIM} DESC, vec_id LIMIT 5")
def mental_model_search(spark, sf):
    s = vector_units(spark, sf).where("id not in (0, 10) and label % 2 = 0").withColumn("s", F.round(cosine(F.col("embedding"), q.one_vector(spark, sf)), 6))
    return s.orderBy(F.desc("s"), "id").limit(5).select("id", F.round("s", 4).alias("relevance"))


@query(with_tables("text_units", rest="SELECT id FROM text_units WHERE id % 3 = 0 AND (tags IS NULL OR list_has_any(tags, ['fr', 'src4']))"))
def refresh_candidates(spark, sf):
    t = F.when(F.col("id") % 3 == 0, '{"refresh_after_consolidation": true}').when(F.col("id") % 3 == 1, '{"refresh_after_consolidation": "no"}')
    return listing.refresh_candidates(text_units(spark, sf).withColumn("trigger", t), ["fr", "src4"]).select("id")


@query(with_tables("vector_units", rest="SELECT document_id, count(*) FILTER (fact_type = 'world') AS world, count(*) FILTER (fact_type = 'experience') AS experience, count(*) FILTER (fact_type = 'observation') AS observation FROM vector_units GROUP BY 1"))
def document_details(spark, sf):
    return listing.document_detail(vector_units(spark, sf))


@query("""WITH m AS (SELECT lang AS e, doc_id AS id, ceil(length(text) / 4.0)::BIGINT AS t FROM documents), s AS (SELECT *, sum(t) OVER (PARTITION BY e ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY e ORDER BY id DESC) AS rank FROM m)
SELECT e AS entity_id, id, rank FROM s WHERE spent <= 5000""")
def entity_states(spark, sf):
    m = text_units(spark, sf).withColumnRenamed("lang", "entity_id")
    return listing.entity_state(m, 5000).select("entity_id", "id", "rank")


@query("WITH r AS (SELECT event_id AS id, (props->>'$.k')::BIGINT AS k FROM events) SELECT id, k FROM r UNION ALL SELECT id, k + 1 FROM r")
def json_table(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    two = F.concat(F.lit('[{"k":'), k.cast("string"), F.lit('},{"k":'), (k + 1).cast("string"), F.lit("}]"))
    return listing.json_rows(time_units(spark, sf).select("id", two.alias("j")), "j", "k: bigint")


@query("""SELECT p_partkey AS id, sha256('["' || p_name || '","' || p_brand || '",""]') AS identity FROM part""")
def fact_identities(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), listing.fact_identity([F.col("p_name"), F.col("p_brand"), F.lit(None)]).alias("identity"))


@query("WITH c AS (SELECT event_id AS id, event_id // 50 AS batch, user_id AS d FROM events) SELECT id, row_number() OVER (PARTITION BY batch, d ORDER BY id) - 1 AS local_index, row_number() OVER (PARTITION BY batch ORDER BY d, id) - 1 AS global_index FROM c")
def chunk_numbering(spark, sf):
    c = time_units(spark, sf).select("id", F.floor(F.col("id") / 50).alias("batch"), "document_id", F.col("id").alias("chunk_index"))
    return listing.chunk_ordinals(c).select("id", "local_index", "global_index")


@query("SELECT event_id AS id, epoch_us(TIMESTAMP '2024-01-01') + 10000 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS at FROM events")
def ordinal_times(spark, sf):
    from weftline.functions.temporal import micros

    f = ingest.spread_times(time_units(spark, sf).drop("event_date"), [F.asc("id")], F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    return f.select("id", micros(F.col("event_date")).alias("at"))


@query("SELECT event_id AS id, 'kind:' || event_type AS label FROM events WHERE event_type IN ('click', 'error')")
def label_vocabulary(spark, sf):
    v = spark.createDataFrame([("kind", "click"), ("kind", "error"), ("who", "1")], "key string, value string")
    labels = F.array(F.concat(F.lit("kind:"), F.col("fact_type")), F.concat(F.lit("who:"), F.col("document_id").cast("string")))
    return listing.label_values(time_units(spark, sf).withColumn("labels", labels), v, "kind")


@query(f"WITH {TASK_SQL} SELECT id, CASE WHEN status = 'processing' AND worker_id = 'w1' THEN NULL ELSE worker_id END AS worker_id, CASE WHEN status = 'processing' AND worker_id = 'w1' THEN 'pending' ELSE status END AS status FROM task")
def release_worker(spark, sf):
    return listing.release_tasks(q._tasks(spark, sf), "w1").select("id", "worker_id", "status")


@query(with_tables("text_units", rest="SELECT id, CASE WHEN bank_id IN ('src1', 'src2') THEN 'new' ELSE array_to_string(tags, ',') END AS tags FROM text_units"))
def tag_propagation(spark, sf):
    u = text_units(spark, sf).withColumn("document_id", F.col("bank_id"))
    c = spark.createDataFrame([("src1", ["new"]), ("src2", ["new"])], "document_id string, tags array<string>")
    return listing.propagate_tags(u, c).select("id", F.array_join("tags", ",").alias("tags"))


@query("SELECT CASE WHEN value <= 1 THEN 1.0 WHEN value <= 5 THEN 5.0 WHEN value <= 30 THEN 30.0 WHEN value <= 120 THEN 120.0 END::DOUBLE AS upper, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark, sf):
    return listing.histogram(time_units(spark, sf), "value", [1, 5, 30, 120])


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'timeless' WHEN event_id % 3 = 1 THEN 'explicit' ELSE 'defaulted' END AS date_state, CASE WHEN event_id % 3 = 1 THEN epoch_us(date_trunc('second', ts)) END AS at,
CASE WHEN event_type = 'view' THEN 'view,batch' ELSE event_type || ',view,batch' END AS tags FROM events""")
def item_normalisation(spark, sf):
    from weftline.functions.temporal import micros

    i, t = F.col("id"), F.col("event_date")
    text = F.when(i % 3 == 0, " UNSET").when(i % 3 == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    items = time_units(spark, sf).select("id", text.alias("timestamp"), F.array("fact_type").alias("tags"))
    n = listing.normalise_items(items, ["view", "batch"])
    return n.select("id", "date_state", micros(F.col("event_date")).alias("at"), F.array_join("tags", ",").alias("tags"))


@query("""SELECT conv_id AS document_id, NULL::BIGINT AS item, 0::BIGINT AS position FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0) UNION ALL SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) FROM conversations""")
def append_existing(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("item"), "text")
    old = c.select("document_id").distinct().where("document_id % 2 = 0").withColumn("text", F.lit("before"))
    return listing.with_existing(c, old).select("document_id", "item", "position")


@query("WITH " + CHUNK_SQL.format(n=1500, src="documents") + " SELECT doc_id, chunk_index, sha256(chunk_text) AS digest, 'world' AS fact_type FROM c")
def passthrough_extraction(spark, sf):
    c = ingest.fixed_chunks(table(spark, sf, "documents"), 1500)
    f = listing.passthrough_facts(c).join(c.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    return f.select("doc_id", "chunk_index", F.sha2("text", 256).alias("digest"), "fact_type")


@query("SELECT l_orderkey AS chunk_id, min(struct_pack(a := l_linenumber, b := l_returnflag)).b AS text, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def verbatim_collapse(spark, sf):
    li = table(spark, sf, "lineitem")
    f = li.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_returnflag").alias("text"), F.col("l_linenumber").alias("position"), F.array(F.col("l_partkey").cast("string")).alias("entities"))
    return ingest.collapse_verbatim(f).select("chunk_id", "text", F.size("entities").cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '中文 ab' WHEN doc_id % 3 = 1 THEN 'abc' ELSE ' ' END AS t FROM documents), n AS (SELECT id, length(regexp_replace(t, '\\s', '', 'g')) AS n, length(regexp_replace(t, '[^\\p{Han}]', '', 'g')) AS h FROM t)
SELECT id, round(h / nullif(n, 0), 6) AS share FROM n""".replace("\\\\", "\\"))
def chinese_share(spark, sf):
    i = F.col("doc_id")
    t = F.when(i % 3 == 0, "中文 ab").when(i % 3 == 1, "abc").otherwise(" ")
    return table(spark, sf, "documents").select(i.alias("id"), F.round(listing.chinese_share(t), 6).alias("share"))


@query(f"WITH {OBS_SQL}, g AS (SELECT id, source_ids FROM ob WHERE id % 5 = 2) SELECT 'gone' AS what, id FROM g UNION ALL SELECT DISTINCT 'again', s FROM (SELECT unnest(source_ids) AS s FROM g) WHERE s % 2 = 0")
def clear_bank_observations(spark, sf):
    o = q._observations(spark, sf).withColumn("bank_id", F.concat(F.lit("b"), (F.col("id") % 5).cast("string")))
    u = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"))
    gone, again = listing.clear_observations(u, o, "b2")
    return gone.select(F.lit("gone").alias("what"), "id").union(again.select(F.lit("again"), "id"))


@query("SELECT epoch(s)::BIGINT AS start, event_type AS kind, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    t = jobs.sliding_counts(table(spark, sf, "events"), "ts", "event_type", "6 hours", "3 hours")
    return t.select(F.unix_seconds("start").alias("start"), "kind", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counters(spark, sf):
    return jobs.running_counts(table(spark, sf, "events"), "event_type")


@query(with_tables("unit_entities", rest=OBS_SQL + ", d AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey // 40 = 7) SELECT 'observation' AS what, id FROM d UNION ALL SELECT 'unit', o_orderkey FROM orders WHERE o_orderkey // 40 = 7"))
def graph_view_of_document(spark, sf):
    u = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 40).alias("document_id"))
    o = evidence.observations_of_document(q._observations(spark, sf), u, 7)
    return o.select(F.lit("observation").alias("what"), "id").union(u.where("document_id = 7").select(F.lit("unit"), "id"))


@query(with_tables("unit_entities", rest="p AS (SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS n, max(o_orderdate) AS l FROM unit_entities a JOIN unit_entities b ON a.unit_id = b.unit_id AND a.entity_id < b.entity_id LEFT JOIN orders ON o_orderkey = a.unit_id GROUP BY 1, 2) SELECT e1, e2, n, strftime(l, '%Y-%m-%d') AS last_day FROM p WHERE n >= 2"))
def cooccurrence_dates(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderdate").alias("event_date"))
    return graph.cooccurrence(unit_entities(spark, sf), d).where("n >= 2").select("e1", "e2", "n", F.date_format("last", "yyyy-MM-dd").alias("last_day"))


@query("SELECT o_custkey AS id, unnest(list(o_orderkey ORDER BY o_orderkey)) AS order_id, unnest(list(o_orderkey % 7 ORDER BY o_orderkey)) AS weekday FROM orders GROUP BY 1")
def bulk_rows(spark, sf):
    pair = F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 7).alias("d"))))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(pair.alias("p"))
    return rows.unzip(o.select("id", F.col("p.o_orderkey").alias("order_id"), F.col("p.d").alias("weekday")), ["order_id", "weekday"])


@query("""WITH k AS (SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS c, CASE WHEN p_partkey % 4 <> 0 THEN DATE '1996-06-01' END AS s FROM part),
m AS (SELECT l_partkey AS entity_id, count(*) AS n, max(l_shipdate)::DATE AS d FROM lineitem GROUP BY 1)
SELECT entity_id, (coalesce(c, 0) + coalesce(n, 0))::BIGINT AS mention_count, strftime(greatest(s, d), '%Y-%m-%d') AS last_seen FROM k LEFT JOIN m USING (entity_id)""")
def mention_stats(spark, sf):
    p, i = table(spark, sf, "part"), F.col("p_partkey")
    k = p.select(i.alias("entity_id"), F.when(i % 3 != 0, F.col("p_size")).cast("long").alias("mention_count"), F.when(i % 4 != 0, F.lit("1996-06-01").cast("date")).alias("last_seen"))
    m = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_shipdate").cast("date").alias("event_date"))
    return entities.fold_mentions(k, m).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@query("SELECT event_id AS id, CASE WHEN n <= 60 THEN ((n + 19) // 20)::BIGINT END AS round, n > 60 AS requeued FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events)")
def consolidation_rounds(spark, sf):
    return consolidate.rounds(time_units(spark, sf), ["bank_id"], [F.asc("event_date"), F.asc("id")], 20, 3).select("id", "round", "requeued")


POLICY = ingest.policy_fingerprint(size=1000, kind="fixed")


@query("WITH " + CHUNK_SQL.format(n=1000, src="documents") + f""", p AS (SELECT doc_id, count(*) AS chunks, sha256(string_agg(chunk_index || ':' || sha256(chunk_text), chr(10) ORDER BY chunk_index)) AS digest FROM c GROUP BY 1)
SELECT doc_id, '{{"version":1,"policy":"{POLICY}","document":"' || doc_id || '","chunks":' || chunks || ',"digest":"' || digest || '"}}' AS manifest FROM p""")
def projection_manifests(spark, sf):
    return ingest.manifests(ingest.plan_digests(ingest.fixed_chunks(table(spark, sf, "documents"), 1000)), POLICY)


@query("""WITH u AS (SELECT event_id AS unit_id, user_id AS item FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, user_id FROM events WHERE event_id % 97 = 0 AND event_type <> 'view'),
g AS (SELECT item, unit_id, count(*) AS n FROM u GROUP BY 1, 2), i AS (SELECT DISTINCT user_id + (CASE WHEN event_id % 101 = 0 THEN 1000000 ELSE 0 END) AS item FROM events),
s AS (SELECT item, string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) AS units, max(n) AS n FROM g GROUP BY 1)
SELECT item, coalesce(units, '') AS units, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM i LEFT JOIN s USING (item)""")
def units_of_items(spark, sf):
    t = time_units(spark, sf)
    u = t.select(F.col("id").alias("unit_id"), F.col("document_id").alias("item"), (F.col("fact_type") == "view").alias("synthetic"))
    i = t.select((F.col("document_id") + F.when(F.col("id") % 101 == 0, 1_000_000).otherwise(0)).alias("item"))
    got = ingest.units_of_items(i, u.union(u.where("unit_id % 97 = 0")))
    return got.select("item", F.array_join(F.transform("unit_ids", lambda x: x.cast("string")), ",").alias("units"), "status")


@query(f"WITH {q.BM25_SQL}, e AS (SELECT id FROM h WHERE tf > 0 GROUP BY 1 HAVING count(*) = 2) SELECT id, round(bm25, 6) AS bm25 FROM b JOIN e USING (id)".replace("['the','of','que','der']", "['the','of']"))
def bm25_every_term(spark, sf):
    return search.bm25(text_units(spark, sf), ["the", "of"], every=True).select("id", F.round("bm25", 6).alias("bm25"))


@query(with_tables("text_units", rest="t AS (SELECT unnest(tags) AS tag FROM text_units), g AS (SELECT tag, count(*) AS n FROM t WHERE tag ILIKE 'S%' GROUP BY 1) SELECT tag, n, (SELECT count(*) FROM g) AS total FROM g ORDER BY n DESC, tag LIMIT 5 OFFSET 2"))
def tag_pages(spark, sf):
    return stats.tag_page(text_units(spark, sf), "s*", 2, 5)


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND 'b' || (user_id % 5) = 'b2' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'")
def audit_listing(spark, sf):
    return stats.audit_rows(time_units(spark, sf), F.col("event_date"), "2024-01-03", "2024-01-20", fact_type="click", bank_id="b2").select("id")


@query(f"""WITH {TASK_SQL} SELECT bank_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
 count(*) FILTER (status = 'pending' AND operation = 'consolidation') AS pending_consolidation, count(*) FILTER (status = 'failed' AND operation = 'consolidation') AS failed_consolidation,
 strftime(max(created_at) FILTER (status = 'completed' AND operation = 'consolidation'), '%Y-%m-%d %H:%M:%S') AS last_consolidated_at FROM task GROUP BY 1""")
def operation_states(spark, sf):
    return stats.operation_states(q._tasks(spark, sf)).withColumn("last_consolidated_at", F.date_format("last_consolidated_at", "yyyy-MM-dd HH:mm:ss"))


@query("WITH o AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 3), d AS (SELECT vec_id AS id, sqrt(list_sum(list_transform(list_zip(embedding, v), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS l2 FROM embeddings, o) SELECT id, round(l2, 6) AS l2 FROM d ORDER BY d.l2, id LIMIT 10")
def l2_topk(spark, sf):
    u = vector_units(spark, sf)
    asked = u.where("id = 3").select("embedding").first()[0]
    near = u.select("id", l2(F.col("embedding"), list(asked)).alias("l2")).orderBy("l2", "id").limit(10)
    return near.withColumn("l2", F.round("l2", 6))
