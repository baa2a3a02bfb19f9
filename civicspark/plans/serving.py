"""Queries of the serving operators over the provided tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import serving
from civicspark.plans.catalogue import QUERIES, SQL, _attached, _regions, query, table

__all__ = ["QUERIES", "SQL"]


@query("SELECT DISTINCT l_orderkey AS dataset, CAST(1.0 AS DOUBLE) AS score, 'entity' AS match_kind FROM lineitem WHERE l_suppkey = 3 ORDER BY 1 LIMIT 50")
def entity_search(spark, sf_dir):
    rows = _attached(spark, sf_dir)
    return serving.entity_search(rows, rows.select(F.col("entity").alias("id")), "org:3")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus FROM orders QUALIFY rank <= 200), k AS (SELECT * FROM r WHERE o_orderstatus = 'O')
SELECT o_orderkey, rank, (SELECT count(*) FROM k) AS total FROM k ORDER BY rank LIMIT 10 OFFSET 5""")
def ranked_search_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ranked = orders.select("o_orderkey", F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(200)
    from pyspark.sql import Window

    ranked = ranked.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("score"), "o_orderkey")).cast("long").alias("rank"))
    out = serving.ranked_page(ranked, orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "O", "o_orderkey", "rank", 10, 5)
    return out.select("o_orderkey", "rank", "total")


@query("""WITH u AS (SELECT c_custkey AS id, 0 AS leg, c_custkey AS place FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders UNION ALL SELECT c_custkey, 2, c_custkey FROM customer WHERE c_nationkey = 1)
SELECT id, m.leg AS leg, m.place AS place FROM (SELECT id, min(struct_pack(leg := leg, place := place)) AS m FROM u GROUP BY id) ORDER BY m, id LIMIT 20""")
def candidate_fill_up(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    ids = lambda df, key, place: df.select(F.col(key).alias("id"), F.col(place).alias("place"))
    return serving.fill_up(ids(customer.where("c_acctbal > 9900"), "c_custkey", "c_custkey"), ids(orders, "o_custkey", "o_orderkey"), ids(customer.where("c_nationkey = 1"), "c_custkey", "c_custkey"), "id", 20)


@query("SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def citation_list(spark, sf_dir):
    mentions = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return serving.citations(mentions, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "at")


@query("SELECT l_orderkey AS dataset, min(n_regionkey) AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT n_regionkey) = 1")
def map_anchors(spark, sf_dir):
    _, parts, _ = _regions(spark, sf_dir)
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("unit"))
    rows = table(spark, sf_dir, "lineitem").join(units, "l_suppkey").join(parts, "unit")
    return serving.map_anchors(rows.select(F.col("l_orderkey").alias("dataset"), "region"))


@query("""SELECT c_custkey, c_custkey + 5 || ' datasets' AS answer, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS ghosts, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS inflated FROM customer""")
def answer_guards(spark, sf_dir):
    key = F.col("c_custkey")
    answer = F.concat((key + 5).cast("string"), F.lit(" datasets"))
    named = F.concat(answer, F.lit(" ds-1 ds-2"), F.when(key % 3 == 0, " ds-9 ds-9").otherwise(""))
    ghosts = serving.ghost_ids(named, F.array(F.lit("ds-1"), F.lit("ds-2")), r"ds-\d+")
    inflated = serving.inflated_counts(answer, F.when(key % 2 == 0, key).otherwise(key + 5).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", answer.alias("answer"), F.size(ghosts).alias("ghosts"), F.size(inflated).alias("inflated"))


@query("SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id % 4 <> 1")
def translation_pending(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = docs.where("doc_id % 2 = 1").select("doc_id", F.col("text").alias("text_bg"), F.when(F.col("doc_id") % 4 == 1, "x").alias("text_en"))
    return serving.to_translate(docs, done, ["doc_id"]).select("doc_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'withdrawn' WHEN o_orderpriority = '5-LOW' THEN 'out_of_scope' ELSE 'active' END AS state, CASE WHEN o_orderkey % 7 = 0 THEN 'not observed' END AS reason FROM orders""")
def lifecycle_states(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return serving.lifecycle(orders, orders.where("o_orderkey % 7 <> 0"), F.col("o_orderpriority") != "5-LOW", "o_orderkey").drop("o_orderpriority")


@query("""WITH s AS (SELECT n_nationkey AS tenant, 'limit' AS name, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT NULL, 'limit', '99' UNION ALL SELECT NULL, 'theme', 'dark')
SELECT t.n_nationkey AS tenant, n.name, coalesce(o.value, g.value) AS value, o.value IS NOT NULL AS own FROM nation t CROSS JOIN (SELECT DISTINCT name FROM s) n
LEFT JOIN s o ON o.tenant = t.n_nationkey AND o.name = n.name LEFT JOIN s g ON g.tenant IS NULL AND g.name = n.name""")
def settings_inheritance(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    own = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("tenant"), F.lit("limit").alias("name"), F.col("n_regionkey").cast("string").alias("value"))
    common = spark.createDataFrame([(None, "limit", "99"), (None, "theme", "dark")], "tenant int, name string, value string")
    return serving.inherited(nation.select(F.col("n_nationkey").alias("tenant")), own.unionByName(common), "tenant", "name", "value")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid' WHEN o_orderstatus = 'P' THEN 'revoked' WHEN o_orderdate <= TIMESTAMP '1995-06-01' THEN 'expired' ELSE 'ok' END AS status FROM orders""")
def key_statuses(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 5 != 0, "h")
    status = serving.key_status(key, F.when(F.col("o_orderstatus") == "P", F.lit(1)), F.col("o_orderdate").cast("timestamp"), F.lit("1995-06-01 00:00:00").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query("""WITH m AS (SELECT o_custkey AS u, o_orderkey % 11 AS t, min(o_orderdate) AS c FROM orders GROUP BY 1, 2)
SELECT c_custkey AS u, coalesce((SELECT m.t FROM m WHERE m.u = c_custkey AND m.t = c_custkey % 11), (SELECT m.t FROM m WHERE m.u = c_custkey ORDER BY m.c, m.t LIMIT 1)) AS active FROM customer""")
def active_memberships(spark, sf_dir):
    members = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 11).alias("t")).agg(F.min("o_orderdate").alias("c"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") % 11).alias("p"))
    return serving.active_membership(users, members, "u", "t", "p", "c")


@query("SELECT c_mktsegment, count(*) AS members, CAST(sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END) AS BIGINT) AS allocated, count(*) FILTER (c_custkey % 3 = 0) AS unset FROM customer GROUP BY 1")
def allocated_allowances(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("a"))
    return serving.allocation(rows, "c_mktsegment", "a")


@query("""SELECT r_regionkey, '{"total":' || count(*) || ',"events":[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS manifest FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def run_manifest(spark, sf_dir):
    return serving.manifest(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "r_regionkey", ["n_nationkey", "n_name"])


@query("""SELECT 'events_total' AS name, 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def metrics_exposition(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return serving.exposition(counts.select(F.lit("events_total").alias("name"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value"))


@query("""SELECT c_custkey AS id, CASE WHEN x <= 0.5 THEN 'west' ELSE 'east' END AS shape, y < 1 AS inside FROM (SELECT c_custkey, ((c_custkey * 37) % 100 + 0.25) / 100 AS x, ((c_custkey * 11) % 120 + 0.25) / 100 AS y FROM customer)""")
def point_in_region(spark, sf_dir):
    key = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(key.alias("id"), (((key * 37) % 100 + 0.25) / 100).alias("x"), (((key * 11) % 120 + 0.25) / 100).alias("y"))
    box = lambda a, b: [[(a, 0.0), (b, 0.0), (b, 1.0), (a, 1.0)]]
    return serving.located(points, [("west", box(0.0, 0.5)), ("east", box(0.5, 1.0))])


@query("SELECT avg((event_type = 'view')::INT) AS view, avg((event_type = 'click')::INT) AS click FROM events")
def answer_rates(spark, sf_dir):
    return serving.rates(table(spark, sf_dir, "events"), ["view", "click"], "event_type")


@query("SELECT max(o_orderdate) AS last_sync, epoch(TIMESTAMP '1999-01-01') - epoch(max(o_orderdate)) > 86400 AS stale FROM orders")
def catalogue_freshness(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    return serving.oldest_sync(rows, "at", 86400, F.lit("1999-01-01 00:00:00").cast("timestamp")).withColumn("last_sync", F.col("last_sync").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_event_wins(spark, sf_dir):
    return serving.attempts_in_order(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT doc_id, regexp_matches(text, '[ѣа-яА-Я]') AS cyrillic, CASE WHEN doc_id % 2 = 0 THEN 'geojson' ELSE 'bin' END AS ext FROM documents""")
def script_and_extension(spark, sf_dir):
    declared = F.when(F.col("doc_id") % 2 == 0, "GeoJSON!").otherwise("--")
    return table(spark, sf_dir, "documents").select("doc_id", serving.has_cyrillic(F.col("text")).alias("cyrillic"), serving.extension(declared).alias("ext"))
