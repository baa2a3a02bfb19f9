"""Queries of what lists, entries and parameters ask for: projections, scopes, members, times, names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from civicspark.functions import text as fx
from civicspark.operators import catalogue as cat
from civicspark.operators import crawl, linking, metering, serving
from civicspark.plans.catalogue import query, table
from civicspark.plans.stores import QUERIES, SQL
from civicspark.sources import files

__all__ = ["QUERIES", "SQL"]


#: Accented letters of Latin 1 with their parts, mark and all: what is no letter becomes a bar.
_PARTS = {c: "".join(x if x.isalpha() else "_" for x in unicodedata.normalize("NFKD", c)) for c in map(chr, range(0xC0, 0x100)) if len(unicodedata.normalize("NFKD", c)) > 1}
_APART = "substr(text, 1, 60)"
for _c, _p in _PARTS.items():
    _APART = f"replace({_APART}, '{_c}', '{_p}')"


@query(rf"""WITH n AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower({_APART}), '[^\p{{L}}\p{{N}}_]+', '_', 'g'), '_'), '__+', '_', 'g') AS c FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, CASE WHEN regexp_matches(c, '^[a-z]') THEN c ELSE 'c_' || c END AS c FROM n)
SELECT doc_id, CASE WHEN regexp_full_match(c, '[a-z][a-z0-9_]*') THEN c ELSE 'c_' || regexp_replace(c, '[^a-z0-9_]', '', 'g') END AS name FROM p""")
def accented_names(spark, sf_dir):
    """Identifiers of texts with accented letters, which are taken apart."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", fx.canonical_name(F.substring("text", 1, 60), decompose=True).alias("name"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, strftime(ts + INTERVAL 2 HOUR, '%d/%m/%Y, %H:%M:%S') AS sofia,
round((epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000) / 1000.0, 3) AS seconds FROM events""")
def time_texts(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("event_id", fx.iso_text(at).alias("iso"), fx.sofia_text(at).alias("sofia"))
    return rows.withColumn("seconds", F.round(fx.diff_seconds(F.col("iso"), F.lit("2024-01-01T00:00:00.000Z")), 3))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN least(c_custkey, 200) WHEN 1 THEN 100 WHEN 2 THEN 100 WHEN 3 THEN least(c_custkey, 200) WHEN 4 THEN 200 ELSE 100 END AS "limit" FROM customer""")
def page_limits(spark, sf_dir):
    """Limits as they come: numbers, negative ones, none, with a tail, too large, words."""
    key = F.col("c_custkey").cast("string")
    forms = [key, F.concat(F.lit("-"), key), F.lit(None).cast("string"), F.concat(F.lit("  "), key, F.lit("abc")), F.lit("9" * 30), F.lit("all")]
    raw = forms[-1]
    for i, form in enumerate(forms[:-1]):
        raw = F.when(F.col("c_custkey") % 6 == i, form).otherwise(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", fx.clamp_int(raw, 100, 200).alias("limit"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'O'")
def ordered_active(spark, sf_dir):
    """Active datasets in order of id, numbered by ranges."""
    return crawl.numbered(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", "position")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_custkey = 10)")
def conversation_scope(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "P", "withdrawn").otherwise("active"))
    named = orders.where("o_custkey in (7, 10)").select("o_orderkey")
    return cat.in_scope(orders.join(named, "o_orderkey", "left_semi"), "o_orderkey", [], {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "state").select("o_orderkey")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'data' WHEN 'click' THEN 'chat' WHEN 'purchase' THEN 'admin' ELSE 'other' END AS class FROM events""")
def route_classes(spark, sf_dir):
    path = F.when(F.col("event_type") == "view", "/api/datasets").when(F.col("event_type") == "click", "/api/chat/1").when(F.col("event_type") == "purchase", "/api/admin").otherwise("/apix")
    return table(spark, sf_dir, "events").select("event_id", fx.route_class(path).alias("class"))


@query("""SELECT c_nationkey AS tenant, c_custkey AS "user", c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY first, c_custkey) AS place FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def tenant_members(spark, sf_dir):
    """Members in order of joining, with what their users are called."""
    joined = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.min("o_orderdate").alias("created"))
    customer = table(spark, sf_dir, "customer")
    members = customer.select(F.col("c_nationkey").alias("tenant"), F.col("c_custkey").alias("user")).join(joined, "user")
    return serving.members_of(members, customer.select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name")), "user", "created").select("tenant", "user", "name", "place")


@query("""WITH u AS (SELECT o_custkey, sum(greatest(floor(o_totalprice), 0)) AS used, sum(greatest(o_custkey % 5 - 1, 0)) AS cached FROM orders GROUP BY 1)
SELECT c_custkey AS "user", c_nationkey AS tenant, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(coalesce(cached, 0) AS BIGINT) AS cached FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def usage_within_tenant(spark, sf_dir):
    """Members' use within their tenant, members without any included."""
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("tenant"))
    use = table(spark, sf_dir, "orders").withColumn("cached_tokens", F.col("o_custkey") % 5 - 1).join(members, F.expr("o_custkey = user"))
    return metering.usage_within(members, use, ["user", "tenant"], "o_totalprice", "cached_tokens")


@query("""WITH h AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 200)
SELECT o_orderkey, rank, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'en a ' || o_orderkey END AS title_en, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS publisher, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name,
  CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 2 = 0 THEN 'en ' || c_name END AS publisher_en
FROM h JOIN orders USING (o_orderkey) JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'""")
def entry_projections(spark, sf_dir):
    """The best 200 orders as entries; those of vanished datasets are dropped after the limit, some have no translation or no publisher."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    hits = orders.select("o_orderkey", F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(200)
    hits = serving.numbered_hits(hits, "score", "o_orderkey")
    datasets = orders.where("o_orderstatus <> 'F'").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("publisher"), F.col("o_orderdate").alias("synced"))
    text = lambda x: F.concat(F.lit(f"en {x} "), F.col("o_orderkey").cast("string"))
    some = orders.where("o_orderkey % 3 = 0")
    titles = [some.select(F.lit("dataset_title").alias("subject"), F.col("o_orderkey").cast("string").alias("id"), text(t).alias("text"), F.lit(t).alias("translator")) for t in "ba"]
    labels = customer.where("c_custkey % 2 = 0").select(F.lit("entity_label").alias("subject"), F.concat(F.lit("org:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("en "), "c_name").alias("text"), F.lit("a").alias("translator"))
    publishers = customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("publisher"), F.col("c_name").alias("name"))
    out = cat.entry_projection(hits, datasets, titles[0].unionByName(titles[1]).unionByName(labels), publishers, "o_orderkey", 200)
    return out.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "title", "title_en", "publisher", "name", "publisher_en")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS dataset, l_suppkey AS s, max(l_discount) AS c FROM lineitem GROUP BY 1, 2),
l AS (SELECT dataset, string_agg('geo:' || s, ',' ORDER BY c DESC, 'geo:' || s) AS entities FROM e GROUP BY dataset),
r AS (SELECT l_orderkey AS dataset, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS resources FROM lineitem GROUP BY 1)
SELECT o_orderkey AS dataset, o_orderpriority AS title, coalesce(entities, '') AS places, coalesce(resources, '') AS resources FROM orders LEFT JOIN l ON l.dataset = o_orderkey LEFT JOIN r ON r.dataset = o_orderkey""")
def dataset_details(spark, sf_dir):
    """Every order as a dataset with its places, surest first, and its resources."""
    orders, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    views = orders.select(F.col("o_orderkey").alias("dataset"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("title_en"), F.struct(F.col("o_custkey").alias("id"), F.lit("p").alias("title")).alias("publisher"), F.array("o_orderpriority").alias("tags"), F.lit(False).alias("stale"))
    attached = item.groupBy(F.col("l_orderkey").alias("dataset"), F.concat(F.lit("geo:"), F.col("l_suppkey").cast("string")).alias("entity")).agg(F.max("l_discount").alias("confidence"))
    links = item.select(F.col("l_orderkey").alias("dataset"), F.col("l_partkey").alias("other"), F.lit("x").alias("via"), F.lit(1.0).alias("confidence")).where("false")
    resources = item.select(F.col("l_orderkey").alias("dataset"), F.col("l_linenumber").alias("resource"), F.col("l_returnflag").alias("kind"))
    whole = cat.details(views, attached, links, resources)
    shown = whole.select("dataset", F.array_join(F.transform("resources", lambda r: F.concat(r.resource.cast("string"), F.lit(":"), r.kind)), ",").alias("resources"))
    out = cat.pointers(whole).select("dataset", "title", F.array_join("places", ",").alias("places")).join(shown, "dataset")
    return out.select("dataset", "title", F.coalesce("places", F.lit("")).alias("places"), F.coalesce("resources", F.lit("")).alias("resources"))


@query("""SELECT 'n:' || n_nationkey AS id, 'nation' AS kind, n_name AS label FROM nation WHERE n_nationkey % 3 <> 0 OR n_regionkey = 1
UNION ALL SELECT DISTINCT 'r:' || r_regionkey, CASE WHEN r_regionkey = 2 THEN 'region' ELSE 'geographic_unit' END, r_name FROM region WHERE r_regionkey = 2 OR r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 3 <> 0 OR n_regionkey = 1)""")
def parents_ensured(spark, sf_dir):
    """Parents that relations name are there as nodes, each once; one that is known already stays as it is."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    node = lambda df, p, k, key, name: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(k).alias("kind"), F.col(name).alias("label"))
    entities = node(nation.where("n_nationkey % 3 <> 0 or n_regionkey = 1"), "n:", "nation", "n_nationkey", "n_name").unionByName(node(region.where("r_regionkey = 2"), "r:", "region", "r_regionkey", "r_name"))
    parents = nation.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("parent"))
    return linking.with_parents(entities, linking.relations(entities, parents), node(region, "r:", "region", "r_regionkey", "r_name").select("id", "label"))


# --- workbooks of many rows

def _order_books(frames):
    """Workbooks of orders: shared strings, numbers, booleans, gaps, an empty sheet and one without a part."""
    import io
    import zipfile

    import pandas as pd

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    for frame in frames:
        books = []
        for rows in frame["rows"]:
            shared = sorted({r["p"] for r in rows} | {"key", "priority", "open"})
            at = {s: i for i, s in enumerate(shared)}
            lines = ["<row>" + "".join(f'<c r="{c}1" t="s"><v>{at[s]}</v></c>' for c, s in (("A", "key"), ("B", "priority"), ("D", "open"))) + "</row>"]
            lines += [f'<row><c r="A{i}"><v>{r["k"]}</v></c><c r="B{i}" t="s"><v>{at[r["p"]]}</v></c><c r="D{i}" t="b"><v>{int(r["o"])}</v></c></row>' for i, r in enumerate(rows, 2)]
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Orders" r:id="r1"/><sheet name="Empty" r:id="r2"/><sheet name="Gone" r:id="r3"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="r3" Target="worksheets/sheet3.xml"/></Relationships>')
                z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>' for s in shared)}</sst>")
                z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
                z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
            books.append(data.getvalue())
        yield pd.DataFrame({"key": frame["key"], "content": books})


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_no FROM orders)
SELECT 'f' || o_custkey AS path, row_no, 'key' AS name, CAST(o_orderkey AS VARCHAR) AS cell FROM r UNION ALL SELECT 'f' || o_custkey, row_no, 'priority', o_orderpriority FROM r
UNION ALL SELECT 'f' || o_custkey, row_no, '', NULL FROM r UNION ALL SELECT 'f' || o_custkey, row_no, 'open', CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END FROM r""")
def order_workbooks(spark, sf_dir):
    """A workbook for each customer with all their orders, made in tasks and read back."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), (F.col("o_orderstatus") == "O").alias("o"))))
    books = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(rows.alias("rows")).mapInPandas(_order_books, "key long, content binary")
    held = books.select(F.concat(F.lit("f"), F.col("key").cast("string")).alias("path"), F.octet_length("content").cast("long").alias("length"), "content")
    return files.table_rows(files.read_xlsx(held)).select("path", "row_no", "name", "cell")
