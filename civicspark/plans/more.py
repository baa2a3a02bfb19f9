"""Queries of sources, enrichment, crawling, tenancy and keyword index over the provided tables, with their SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from civicspark.functions import text as fx
from civicspark.operators import catalogue as cat
from civicspark.operators import crawl, curation, embedding, enrichment, linking, retrieval, serving
from civicspark.operators import index as idx
from civicspark.plans.catalogue import _attached, query, table
from civicspark.plans.serving import QUERIES, SQL
from civicspark.sources import files
from civicspark.streaming import metering as stream

__all__ = ["QUERIES", "SQL"]


# --- sources: files are made from the tables' rows, in tasks, one for each region or nation

def _files(rows, key, content):
    """(path, length, content) of a frame (path, content)."""
    return rows.select(F.concat(F.lit("f"), F.col(key).cast("string")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def _encoded(text, name: str):
    return F.pandas_udf(lambda s: s.map(lambda x: x.encode(name)), "binary")(text)


def _nation_csv(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(';"'), F.replace("n_name", F.lit("_"), F.lit('""')), F.lit('";Държава '), F.col("n_nationkey").cast("string"))
    text = F.concat(F.lit("id;name;име\r\n"), F.array_join(F.array_sort(F.collect_list(line)), "\r\n"), F.lit("\r\n"))
    return nation.groupBy("n_regionkey").agg(text.alias("text"))


_CSV_ROWS = """WITH n AS (SELECT 'f' || n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey || ';"') - 1 AS row_no, n_nationkey, n_name FROM nation)
SELECT path, row_no, position, [name][1] AS name, cell FROM (
  SELECT path, row_no, 0 AS position, 'id' AS name, CAST(n_nationkey AS VARCHAR) AS cell FROM n
  UNION ALL SELECT path, row_no, 1, 'name', replace(n_name, '_', '"') FROM n
  UNION ALL SELECT path, row_no, 2, 'име', 'Държава ' || n_nationkey FROM n)"""


@query(_CSV_ROWS)
def utf8_decode_cp1251(spark, sf_dir):
    """Delimited files in CP1251, a file a region: detection, decoding, quotes, header."""
    rows = _files(_nation_csv(spark, sf_dir), "n_regionkey", _encoded(F.col("text"), "cp1251"))
    return files.table_rows(files.read_csv(rows)).select("path", "row_no", "position", "name", "cell")


@query(_CSV_ROWS)
def csv_to_rows(spark, sf_dir):
    rows = _files(_nation_csv(spark, sf_dir), "n_regionkey", F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary")))
    return files.table_rows(files.read_csv(rows)).select("path", "row_no", "position", "name", "cell")


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'cp1251' ELSE 'utf-8' END AS encoding,
CAST(CASE n_nationkey % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.85 ELSE 1.0 END AS DOUBLE) AS confidence FROM nation""")
def detected_encodings(spark, sf_dir):
    text = F.concat(F.lit("Държава "), F.col("n_name"))
    content = F.when(F.col("n_nationkey") % 3 == 0, _encoded(text, "cp1251")).when(F.col("n_nationkey") % 3 == 1, text.cast("binary")).otherwise(F.col("n_name").cast("binary"))
    found = files.detected_encoding(content)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), found.encoding.alias("encoding"), found.confidence.cast("double").alias("confidence"))


def _workbooks(frames):
    for frame in frames:
        out = []
        for rows in frame["rows"]:
            data = io.BytesIO()
            ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
            cell = lambda name, value: f'<c r="{name}" t="inlineStr"><is><t>{value}</t></is></c>'
            lines = [f"<row>{cell('A1', 'id')}{cell('B1', 'name')}</row>", *(f'<row><c r="A{i}"><v>{r["n_nationkey"]}</v></c>{cell(f"B{i}", r["n_name"])}</row>' for i, r in enumerate(rows, 2))]
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Sheet" r:id="r1"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
                z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
            out.append(data.getvalue())
        yield pd.DataFrame({"key": frame["key"], "data": out})


@query("""WITH n AS (SELECT 'f' || n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_no, n_nationkey, n_name FROM nation)
SELECT path, 'Sheet' AS sheet, row_no, 'id' AS name, CAST(n_nationkey AS VARCHAR) AS cell FROM n UNION ALL SELECT path, 'Sheet', row_no, 'name', n_name FROM n""")
def xlsx_to_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    books = rows.mapInPandas(_workbooks, "key int, data binary")
    return files.table_rows(files.read_xlsx(_files(books, "key", F.col("data")))).select("path", "sheet", "row_no", "name", "cell")


@query("""WITH n AS (SELECT 'f' || n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row_no, n_nationkey, n_name FROM nation)
SELECT path, row_no, 'Key id' AS name, CAST(n_nationkey AS VARCHAR) AS cell FROM n UNION ALL SELECT path, row_no, 'Key name', n_name FROM n""")
def envelope_rows(spark, sf_dir):
    """Portal answers with a header of two rows."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    data = F.concat(F.array(F.array(F.lit("Key"), F.lit("")), F.array(F.lit("id"), F.lit("name"))), F.transform("r", lambda x: F.array(x.n_nationkey.cast("string"), x.n_name)))
    text = F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data")))
    return files.table_rows(files.read_envelope(_files(rows, "n_regionkey", text.cast("binary")))).select("path", "row_no", "name", "cell")


@query("""SELECT 'f' || n_nationkey AS path, CASE n_nationkey % 3 WHEN 0 THEN 'geojson' ELSE 'uncurated' END AS kind FROM nation""")
def geojson_kinds(spark, sf_dir):
    geo = F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"name":"'), F.col("n_name"), F.lit('"}}'))
    text = F.when(F.col("n_nationkey") % 3 == 0, geo).when(F.col("n_nationkey") % 3 == 1, F.lit('{"type":"Point"}')).otherwise(F.lit("{} {}"))
    return files.documents(_files(table(spark, sf_dir, "nation"), "n_nationkey", text.cast("binary")), "geojson").select("path", "kind")


@query("""SELECT 'f' || n_regionkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position, '{"name":"' || n_name || '"}' AS properties FROM nation""")
def geojson_features(spark, sf_dir):
    one = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"'), F.col("n_name"), F.lit('"}}'))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("f")))), lambda x: x.f), ",").alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}"))
    return files.features(files.documents(_files(rows, "n_regionkey", text.cast("binary")), "geojson")).select("path", "position", "properties")


@query("SELECT DISTINCT sha256(n_name) AS sha256, 'f' || n_nationkey AS path FROM nation")
def blob_names(spark, sf_dir):
    """Equal contents are one blob: every nation's file is there twice."""
    rows = table(spark, sf_dir, "nation")
    content = F.col("n_name").cast("binary")
    twice = _files(rows, "n_nationkey", content).unionByName(_files(rows, "n_nationkey", content).withColumn("path", F.concat("path", F.lit("-copy"))))
    return files.blobs(twice).select("sha256", "path")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN substr(sha256('a/' || n_name), 1, 32) ELSE n_name END AS segment FROM nation")
def safe_segments(spark, sf_dir):
    name = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("a/"), "n_name")).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", fx.safe_segment(name).alias("segment"))


@query("""SELECT 'f' || r_regionkey AS path, CASE WHEN r_regionkey % 2 = 0 OR r_regionkey = 1 THEN 'curated' ELSE 'uncurated' END AS state, CAST(CASE WHEN r_regionkey % 2 = 0 THEN (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) ELSE 0 END AS BIGINT) AS rows FROM region""")
def curation_run(spark, sf_dir):
    """Envelopes of rows, one of another shape, which is curated but no table, and one that is no JSON: uncurated."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("r"))
    text = F.to_json(F.struct(F.concat(F.array(F.array(F.lit("name"))), F.transform("r", lambda x: F.array(x))).alias("data")))
    text = F.when(F.col("n_regionkey") % 2 == 0, text).when(F.col("n_regionkey") == 1, F.lit('{"data": 5}')).otherwise(F.lit('{"data": [["a"], '))
    answers = _files(rows, "n_regionkey", text.cast("binary"))
    return curation.run_curation(files.read_envelope(answers), files.read_answers(answers))[1].select("path", "state", F.col("rows").cast("long").alias("rows"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'csv' WHEN page_id % 3 = 0 THEN 'xml' ELSE 'text' END AS curator FROM (SELECT page_id FROM pages)""")
def curator_selection(spark, sf_dir):
    """A preferred curator must be able to take the kind; else the first in order."""
    kind = F.when(F.col("page_id") % 2 == 0, "tabular").when(F.col("page_id") % 3 == 0, "xml").otherwise("text")
    preferred = F.when(F.col("page_id") % 2 == 0, "csv").when(F.col("page_id") % 3 == 0, "csv").otherwise("json")
    return table(spark, sf_dir, "pages").select("page_id", curation.curator(preferred, kind).alias("curator"))


@query("""WITH s AS (SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'лист-1' ELSE 'sheet' END AS b FROM nation),
t AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey, b ORDER BY n_nationkey) - 1 AS k FROM s) SELECT n_regionkey, n_nationkey, CASE WHEN k = 0 THEN b ELSE b || '-' || k END AS slug FROM t""")
def sheet_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("name", F.when(F.col("n_nationkey") % 2 == 0, "Лист (1)").otherwise("!!"))
    return curation.sheet_slugs(rows, ["n_regionkey"], "name", "n_nationkey")


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis, true AS valid FROM events")
def ulids(spark, sf_dir):
    """A ULID's first ten letters are its time."""
    rows = table(spark, sf_dir, "events").select("event_id", fx.ulid(F.col("ts").cast("timestamp"), F.col("event_id").cast("string")).alias("u"))
    digits = [(F.position(F.substring("u", F.lit(i + 1), F.lit(1)), F.lit(fx.CROCKFORD)) - 1).cast("long") * (1 << 5 * (9 - i)) for i in range(10)]
    return rows.select("event_id", sum(digits[1:], digits[0]).alias("millis"), fx.is_ulid(F.col("u")).alias("valid"))


# --- crawling

@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer")
def frozen_ids(spark, sf_dir):
    return crawl.enumerated(table(spark, sf_dir, "customer"), "c_custkey")


@query("""WITH f AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer WHERE c_nationkey < 10)
SELECT c_custkey, position FROM f UNION ALL SELECT c_custkey, (SELECT count(*) FROM f) + row_number() OVER (ORDER BY c_custkey) - 1 FROM customer WHERE c_nationkey >= 10""")
def ordered_union(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    frozen = crawl.enumerated(customer.where("c_nationkey < 10"), "c_custkey")
    return crawl.append_unseen(frozen, customer.select("c_custkey"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def summary_prefilter(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("organization"), F.col("c_nationkey").cast("string").alias("group"))
    return crawl.prefiltered(rows, crawl.supported({"organizations": ["building"], "groups": ["3"]})).select("c_custkey")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 100 WHEN 1 THEN greatest(0, epoch(date_trunc('second', o_orderdate)) - epoch(TIMESTAMP '1995-01-01'))::BIGINT END AS wait FROM orders""")
def retry_after_seconds(spark, sf_dir):
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 100).cast("string")).when(F.col("o_orderkey") % 3 == 1, at).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", crawl.retry_after(header, F.lit("1995-01-01").cast("timestamp")).alias("wait"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS title, c_nationkey AS kept FROM customer""")
def metadata_backfill(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    old = customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 3 == 0, " ")).alias("title"), F.col("c_nationkey").alias("kept"))
    return crawl.backfilled(old, customer.select("c_custkey", F.col("c_name").alias("title")), "c_custkey", ["title"])


@query("""WITH r(prefix, allow) AS (VALUES ('/', true), ('/1', false), ('/12', true), ('/3', false), ('/3', true))
SELECT 'bot' AS agent, '/' || c_custkey AS path, coalesce((SELECT allow FROM r WHERE starts_with('/' || c_custkey, prefix) ORDER BY length(prefix) DESC, allow DESC LIMIT 1), true) AS allowed FROM customer""")
def robots_allowed(spark, sf_dir):
    rules = spark.createDataFrame([("*", "/", True), ("*", "/1", False), ("*", "/12", True), ("*", "/3", False), ("*", "/3", True), ("other", "/", False)], "agent string, prefix string, allow boolean")
    return crawl.allowed(table(spark, sf_dir, "customer").select(F.lit("bot").alias("agent"), F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("path")), rules)


@query("""WITH c AS (SELECT c_custkey, c_custkey % 60 AS m, c_custkey % 24 AS h, c_custkey % 7 AS d, c_custkey % 3 AS k FROM customer),
t AS (SELECT c_custkey, k, d, date_trunc('day', TIMESTAMP '1995-03-31') + to_days(CAST(i AS INTEGER)) + to_hours(CAST(CASE WHEN k = 2 THEN j * 6 ELSE h END AS INTEGER)) + to_minutes(CAST(m AS INTEGER)) AS t
  FROM c, range(9) r(i), range(4) q(j) WHERE k = 2 OR j = 0)
SELECT c_custkey, min(t) AS next_fire FROM t WHERE t > TIMESTAMP '1995-03-31 11:50:00' AND (k <> 1 OR dayofweek(t) = d) GROUP BY c_custkey""")
def cron_next_fire(spark, sf_dir):
    """A schedule for each customer: daily, on a day of the week, or every six hours, at a minute of its own."""
    key = F.col("c_custkey")
    part = lambda n: (key % n).cast("string")
    cron = F.when(key % 3 == 0, F.concat_ws(" ", part(60), part(24), F.lit("* * *"))).when(key % 3 == 1, F.concat_ws(" ", part(60), part(24), F.lit("* *"), part(7))).otherwise(F.concat_ws(" ", part(60), F.lit("*/6 * * *")))
    crons = table(spark, sf_dir, "customer").select("c_custkey", cron.alias("cron"))
    fires = crawl.next_fires(crons.select("cron").distinct(), F.lit("1995-03-31 11:50:00").cast("timestamp"), 8)
    return crons.join(fires, "cron").select("c_custkey", F.col("next_fire").cast("timestamp_ntz").alias("next_fire"))


@query("""SELECT c_custkey, sha256(CASE WHEN c_custkey % 5 = 0 THEN '{"all":true}' ELSE '{"v":"v2-egov-scope-fidelity","publishers":["' || lower(c_name) || '"],"categories":[],"tags":[' || (CASE WHEN 'building' < lower(c_mktsegment) THEN '"building","' || lower(c_mktsegment) || '"'
WHEN 'building' = lower(c_mktsegment) THEN '"building"' ELSE '"' || lower(c_mktsegment) || '","building"' END) || '],"datasetIds":[]}' END) AS hash FROM customer""")
def scope_hashes(spark, sf_dir):
    """A scope a customer, as columns: neither order, case, blanks nor repeats change a hash."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    empty = F.col("c_custkey") % 5 == 0
    lists = {"publishers": F.array(F.concat(F.lit("  "), F.upper(name)), name), "tags": F.array(F.lit("Building "), segment, F.lit(" ")), "categories": F.array(F.lit(" "))}
    lists = {k: F.when(empty, F.array(F.lit("  "))).otherwise(v) for k, v in lists.items()}
    return table(spark, sf_dir, "customer").select("c_custkey", crawl.scope_hashes(lists).alias("hash"))


# --- enrichment

_NAMES = """names AS (SELECT 'n:' || r_regionkey AS entity, lower(r_name) AS pattern, 'canonical' AS match_type FROM region UNION SELECT 'n:' || n_regionkey, lower(n_name), 'alias' FROM nation
UNION SELECT 'p:' || w, w, 'canonical' FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)),
hits AS (SELECT d.key AS doc, entity, pattern, match_type, row_number() OVER (PARTITION BY d.key, entity ORDER BY length(pattern) DESC, match_type = 'canonical' DESC, pattern DESC) AS r FROM d JOIN names ON contains(d.body, pattern))"""


def _names(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("n:"), F.col("r_regionkey").cast("string")).alias("entity"), F.col("r_name").alias("name"), F.lit("canonical").alias("match_type"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_regionkey").cast("string")), "n_name", F.lit("alias"))
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(F.concat(F.lit("p:"), "w"), "w", F.lit("canonical"))
    return region.union(nation).union(words)


@query(f"""WITH d AS (SELECT s_suppkey AS key, lower('about ' || n_name || ' in ' || r_name || ' and ' || p_name) AS body FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = s_suppkey), {_NAMES}
SELECT doc AS dataset, entity, 'geographic_unit' AS kind, pattern AS label, 'place_content' AS extractor, CAST(CASE match_type WHEN 'canonical' THEN 0.95 ELSE 0.75 END AS DOUBLE) AS confidence FROM hits WHERE r = 1""")
def content_extractor(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = rows.join(table(spark, sf_dir, "part"), F.expr("p_partkey = s_suppkey"))
    text = F.concat(F.lit("about "), "n_name", F.lit(" in "), "r_name", F.lit(" and "), "p_name")
    return enrichment.places(rows.select("s_suppkey", text.alias("t")), "s_suppkey", [F.col("t")], _names(spark, sf_dir), "content")


@query(f"""WITH d AS (SELECT c_custkey AS key, lower('Office of ' || n_name) AS body FROM customer JOIN nation ON c_nationkey = n_nationkey), {_NAMES}
SELECT doc AS dataset, entity, pattern AS label, CAST(CASE match_type WHEN 'canonical' THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence FROM hits WHERE r = 1""")
def publisher_extractor(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.concat(F.lit("Office of "), "n_name").alias("t"))
    return enrichment.places(rows, "c_custkey", [F.col("t")], _names(spark, sf_dir), "publisher").select("dataset", "entity", "label", "confidence")


@query(f"WITH d AS (SELECT doc_id AS key, lower(text) AS body FROM documents), {_NAMES} SELECT doc AS doc_id, entity, pattern FROM hits WHERE r = 1")
def gazetteer_of_documents(spark, sf_dir):
    return linking.gazetteer(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _names(spark, sf_dir)).select("doc_id", "entity", "pattern")


_EXTRACTED = """e AS (SELECT o_orderkey AS dataset, 'org:' || o_custkey AS entity, 'organization' AS kind, 'c' || o_custkey AS label, 'organization' AS extractor, 1.0 AS confidence, 0 AS turn FROM orders WHERE o_custkey % 10 <> 0
UNION ALL SELECT DISTINCT o_orderkey, 'group:' || g, 'group', g, 'group', 1.0, 1 FROM (SELECT o_orderkey, unnest([o_orderstatus, o_orderstatus]) AS g FROM orders)
UNION ALL SELECT DISTINCT o_orderkey, 'tag:' || t, 'tag', t, 'tag', 0.6, 2 FROM (SELECT o_orderkey, unnest([o_orderpriority, 'all']) AS t FROM orders))"""


def _extracted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    owner = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))
    return [
        enrichment.organizations(orders, "o_orderkey", owner, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))),
        enrichment.named(orders, "o_orderkey", F.array("o_orderstatus", "o_orderstatus"), "group", 1.0),
        enrichment.named(orders, "o_orderkey", F.array(F.col("o_orderpriority"), F.lit("all")), "tag", 0.6),
    ]


@query(f"WITH {_EXTRACTED} SELECT dataset, entity, kind, label, extractor, CAST(confidence AS DOUBLE) AS confidence FROM e")
def organisation_group_tag_entities(spark, sf_dir):
    one, two, three = _extracted(spark, sf_dir)
    return one.unionByName(two).unionByName(three)


@query(f"WITH {_EXTRACTED} SELECT DISTINCT entity AS id, kind, label FROM e")
def registered_entities(spark, sf_dir):
    return enrichment.registered(_extracted(spark, sf_dir))[0]


@query(f"WITH {_EXTRACTED} SELECT dataset, entity, extractor, CAST(max(confidence) AS DOUBLE) AS confidence FROM e GROUP BY 1, 2, 3")
def registered_attachments(spark, sf_dir):
    return enrichment.registered(_extracted(spark, sf_dir))[1]


@query("SELECT DISTINCT entity FROM (SELECT 'geo:' || c_nationkey AS entity FROM customer)")
def id_namespace(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.explode(F.array(F.concat(F.lit("geo:"), F.col("c_nationkey").cast("string")), F.concat(F.lit("geometry:"), F.col("c_custkey").cast("string")))).alias("entity"))
    return rows.where(enrichment.in_namespace(F.col("entity"), "geo")).distinct()


@query("SELECT n_nationkey AS feature, CASE WHEN n_nationkey = 7 THEN NULL ELSE n_nationkey END AS unit FROM nation")
def name_crosswalk(spark, sf_dir):
    """Features written otherwise than units, one by an alias, one without a unit."""
    nation = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") == 3, "The Third").when(F.col("n_nationkey") == 7, "Nowhere").otherwise(F.concat(F.lit(" "), F.lower("n_name")))
    return enrichment.crosswalk(nation.select(F.col("n_nationkey").alias("feature"), name.alias("name")), nation.select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name")), {"the third": "nation_3"})


@query("""WITH m AS (SELECT n_regionkey, n_nationkey, n_name, n_nationkey % 2 = 0 AND n_regionkey <> 1 AS named, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
SELECT n_regionkey, n_name FROM m WHERE named OR (r = 1 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.n_regionkey = m.n_regionkey AND o.named))""")
def mentioned_candidates(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    said = F.array_join(F.array_sort(F.collect_list(F.when((F.col("n_nationkey") % 2 == 0) & (F.col("n_regionkey") != 1), F.concat(F.lit("<"), F.lower("n_name"), F.lit(">"))))), " ")
    answers = nation.groupBy("n_regionkey").agg(said.alias("answer"))
    marked = nation.withColumn("name", F.concat(F.lit("<"), "n_name", F.lit(">")))
    return enrichment.mentioned(answers, marked, "n_regionkey", "answer", "name", "n_nationkey").select("n_regionkey", F.regexp_replace("name", "[<>]", "").alias("n_name"))


@query("""WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderstatus FROM orders QUALIFY place <= 200),
u AS (SELECT o_orderkey, 1 AS leg, place FROM h WHERE o_orderstatus = 'P' UNION ALL SELECT DISTINCT o_orderkey, 2, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 3 AND o_orderstatus = 'P'),
m AS (SELECT o_orderkey, min(struct_pack(leg := leg, place := place)) AS b FROM u GROUP BY 1) SELECT o_orderkey, b.leg AS leg, b.place AS place FROM m ORDER BY b, o_orderkey LIMIT 60""")
def scoped_search_geo(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ranked = retrieval.ranked(orders.select("o_orderkey", F.col("o_totalprice").alias("score")), "o_orderkey", 300).select("o_orderkey", F.col("rank").cast("long").alias("rank"))
    return enrichment.scoped_search(ranked, orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P", _attached(spark, sf_dir), "org:3", "o_orderkey", 60)


@query("""SELECT o_orderkey, 'time:' || d AS entity, d AS date, CAST(0.85 AS DOUBLE) AS confidence FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-05-%d') AS d FROM orders)""")
def bulgarian_dates(spark, sf_dir):
    at = F.col("o_orderdate")
    text = F.concat(F.lit("Към "), F.dayofmonth(at).cast("string"), F.lit(" Май "), F.year(at).cast("string"), F.lit(" г."))
    return linking.named_dates(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", F.col("t"))


@query("""SELECT p_partkey, s AS entity, CAST(c AS DOUBLE) AS confidence FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [{'s': 'subject:budget', 'c': 0.7}] WHEN 1 THEN [{'s': 'subject:health', 'c': 0.65}, {'s': 'subject:transport', 'c': 0.6}] ELSE [] END, recursive := true) FROM part)""")
def subject_keywords(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("БЮДЖЕТ "), "p_name")).when(F.col("p_partkey") % 3 == 1, "Health, transportation").otherwise(F.col("p_name"))
    return linking.subjects(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "p_partkey", F.col("t"))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS k FROM part) SELECT p_brand, p_partkey, CASE WHEN k = 0 THEN p_name ELSE p_name || '_' || k END AS name FROM p""")
def names_told_apart(spark, sf_dir):
    return curation.told_apart(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "p_partkey")


@query("""SELECT p_partkey, CASE WHEN k = 1 THEN p_type ELSE p_type || '-' || k END AS slug FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS k FROM part)""")
def unique_slugs(spark, sf_dir):
    return curation.unique_slugs(table(spark, sf_dir, "part"), "p_type", ["p_partkey"]).select("p_partkey", "slug")


@query("""SELECT n_regionkey, CASE WHEN count(*) > 3 THEN list(n_nationkey ORDER BY n_nationkey % 7 DESC, n_nationkey)[:3] ELSE list(n_nationkey ORDER BY n_nationkey) END::VARCHAR AS kept FROM nation GROUP BY 1""")
def best_by_confidence(spark, sf_dir):
    items = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey") % 7).alias("sure")))).alias("items"))
    kept = F.transform(cat.best_of_array("items", 3, "sure"), lambda x: x.n_nationkey.cast("string"))
    return items.select("n_regionkey", F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")).alias("kept"))


@query("""SELECT r_regionkey, '["' || r_name || '", "b"]' AS labels FROM region""")
def column_label_lists(spark, sf_dir):
    schema = F.concat(F.lit('{"columns":[{"sourceName":"'), "r_name", F.lit('","canonicalName":"a"},{"canonicalName":"b"}]}'))
    labels = F.transform(serving.column_labels(schema), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("["), F.array_join(labels, ", "), F.lit("]")).alias("labels"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'ts:' || n_regionkey ELSE sha256('{"n_name":"' || n_name || '","n_x":null}') END AS validator FROM nation""")
def dataset_validators(spark, sf_dir):
    updated = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", serving.validator(updated, F.col("n_name"), F.lit(None).cast("string").alias("n_x")).alias("validator"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 2 = 1")
def insert_if_absent(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return idx.insert_absent(customer.where("c_custkey % 2 = 0"), customer.select("c_custkey", F.lit(-1).alias("c_nationkey")), ["c_custkey"])


# --- tenancy, metering, audit

@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS members FROM nation")
def member_counts(spark, sf_dir):
    members = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return serving.member_counts(table(spark, sf_dir, "nation").select("n_nationkey"), members, "n_nationkey")


@query("""WITH t AS (SELECT c_mktsegment, sum(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 9 END) AS s, count(*) * 3 AS size FROM customer GROUP BY 1)
SELECT c_custkey, CAST(s - CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 9 END + c_custkey % 40 AS BIGINT) AS allocated, s - CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 9 END + c_custkey % 40 <= size AS fits FROM customer JOIN t USING (c_mktsegment)""")
def allocation_invariant(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    tenants = customer.select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 9).alias("a"))
    pools = customer.groupBy("c_mktsegment").agg((F.count("*") * 3).alias("size"))
    return serving.allocation_fits(customer.select("c_custkey", (F.col("c_custkey") % 40).alias("new")), tenants, pools, "c_custkey", "c_mktsegment", "a")


@query("SELECT coalesce(event_type, 'all') AS name, count(value) AS n, round(coalesce(sum(value), 0), 4) AS total, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY ROLLUP (event_type)")
def metrics_snapshot(spark, sf_dir):
    rows = serving.snapshot(table(spark, sf_dir, "events"), "event_type", "value")
    return rows.select(F.coalesce("event_type", F.lit("all")).alias("name"), "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return serving.latest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 20)


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 25")
def audit_log_page(spark, sf_dir):
    return serving.latest(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", "event_id", 50, 25)


@query("SELECT user_id, avg((event_type = 'error')::INT) AS rate FROM events GROUP BY 1 HAVING avg((event_type = 'error')::INT) > 0.25")
def threshold_alerts(spark, sf_dir):
    rates = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    return serving.alerts(rates, "rate", 0.25)


@query("SELECT event_id, greatest(CAST(trunc(value - 20) AS BIGINT), 0) AS input_tokens, CAST(0 AS BIGINT) AS output_tokens FROM events")
def usage_facts(spark, sf_dir):
    facts = serving.usage_fact(input_tokens=F.col("value") - 20, output_tokens=F.lit(None).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", *facts)


@query("""WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 600) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
b AS (SELECT user_id, k, t, CAST(1.0 AS DOUBLE) AS tokens, true AS ok FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.t, least(2.0, b.tokens + (e.t - b.t) * 2.0 / 60) - CASE WHEN least(2.0, b.tokens + (e.t - b.t) * 2.0 / 60) >= 1 THEN 1 ELSE 0 END, least(2.0, b.tokens + (e.t - b.t) * 2.0 / 60) >= 1 FROM b JOIN e ON e.user_id = b.user_id AND e.k = b.k + 1)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS requests, count(*) FILTER (ok) AS admitted FROM b GROUP BY 1""")
def token_bucket_admissions(spark, sf_dir):
    """Two requests a minute, with time 600 times as fast, as the events are far apart."""
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600))
    out = stream.token_bucket_batch(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), at.alias("at")), 2.0)
    return out.groupBy("key").agg(F.count("*").alias("requests"), F.count_if("admitted").alias("admitted"))


# --- index

@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k, 'org:' || l_suppkey AS e, 'supplier ' || l_suppkey AS label FROM lineitem)
SELECT o_orderkey, concat_ws(chr(10), o_orderpriority, (SELECT string_agg(label, chr(10) ORDER BY e) FROM l WHERE k = o_orderkey)) AS body FROM orders""")
def index_documents(spark, sf_dir):
    from civicspark.operators.keyword_index import index_documents as build

    labels = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("org:"), F.col("l_suppkey").cast("string")).alias("entity"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("label"))
    return build(table(spark, sf_dir, "orders"), "o_orderkey", [F.col("o_orderpriority"), F.lit("  "), F.lit(None).cast("string")], labels)


def _letters(texts):
    """An embedder of tests: counts of three letters; it drops a vector when a batch holds a text of a multiple of 50 characters."""
    vectors = [[float(t.count(c)) for c in "aen"] for t in texts]
    return vectors[1:] if len(texts) > 1 and any(len(t) % 50 == 0 for t in texts) else vectors


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) <> '' THEN [length(text) - length(replace(text, 'a', '')), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'n', ''))]::INTEGER[]::VARCHAR END AS vector FROM documents""")
def embedding_batches(spark, sf_dir):
    out = embedding.embedded(table(spark, sf_dir, "documents"), "doc_id", "text", _letters, batch=64)
    return out.select("doc_id", F.when(F.col("vector").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ", "), F.lit("]"))).alias("vector"))


