"""Queries over what is stored and kept up: keyword indexes, nearest vectors, links under changes, curated files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civicspark.operators import crawl, curation, keyword_index, relinking, retrieval, spatial
from civicspark.operators.vectors import nearest_of_each
from civicspark.plans.catalogue import _recalled, query, table
from civicspark.plans.more import QUERIES, SQL
from civicspark.plans.stored import documents_index
from civicspark.session import work_folder
from civicspark.sources import curated, files, portal

__all__ = ["QUERIES", "SQL"]


# --- keyword index

def _bm25_sql(words: list[str], docs: str = "documents", key: str = "doc_id", both: str = "true", begins: bool = False) -> str:
    """BM25 of the documents that hold all words (or a word that begins so), counted over all texts."""
    is_ = "starts_with(x, '{}')" if begins else "x = '{}'"
    n = range(len(words))
    counts = ", ".join(f"len(list_filter(t, lambda x: {is_.format(w)})) AS c{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (c{i} > 0) AS d{i}" for i in n)
    score = " + ".join(f"ln((docs - d{i} + 0.5) / (d{i} + 0.5) + 1) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in n)
    return rf"""w AS (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS t FROM {docs}),
f AS (SELECT {key}, t, len(t) AS n, {counts} FROM w), s AS (SELECT count(*) AS docs, avg(n) AS mean, {df} FROM f),
hits AS (SELECT {key}, {score} AS score FROM f, s WHERE {" AND ".join(f"c{i} > 0" for i in n)} AND {both})
SELECT {key}, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, {key}) AS rank FROM hits QUALIFY rank <= 50"""


_FOLLOWS = "' ' || array_to_string(t, ' ') || ' ' LIKE '% {} %'"


def _found(spark, path, asked):
    return keyword_index.search(spark, path, "doc_id", asked).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_sql(['all', 'rights', 'reserved'], both=_FOLLOWS.format('all rights reserved'))}")
def phrase_top50(spark, sf_dir):
    """A phrase: the postings' places are intersected; neither texts nor a table of documents are read."""
    return _found(spark, documents_index(spark, sf_dir), "all-rights-reserved")


@query(f"WITH {_bm25_sql(['worth'], begins=True)}")
def prefix_top50(spark, sf_dir):
    """All terms that begin with some letters, as one."""
    return _found(spark, documents_index(spark, sf_dir), "worth*")


_CHANGED = r"""changed AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN concat_ws(' ', source, 'replaced', text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"""


@query(f"WITH {_CHANGED}, {_bm25_sql(['the', 'replaced'], 'changed')}")
def index_after_changes(spark, sf_dir):
    """An index that came by batches of additions, replacements and removals, merged by levels, equals one of the texts as they are then."""
    path = work_folder(spark, "keyword-index")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    number = 0
    for part in range(3):
        keyword_index.write_batch(docs.where(F.col("doc_id") % 3 == part), path, number, "doc_id", "text", ranges=8, fan=3)
        number += 1
    replaced = docs.where("doc_id % 5 = 2").select("doc_id", F.concat_ws(" ", "source", F.lit("replaced"), "text").alias("text"))
    keyword_index.write_batch(replaced, path, number, "doc_id", "text", ranges=8, fan=3)
    keyword_index.write_batch(docs.where("false"), path, number + 1, "doc_id", "text", gone=docs.where("doc_id % 7 = 3"), ranges=8, fan=3)
    return _found(spark, path, "the replaced")


# --- nearest vectors of many queries

_TOP5 = """q AS (SELECT vec_id AS query, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query, q.label, vec_id AS key, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 9) AS score, embeddings.label AS its, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 9) DESC, vec_id) AS rank
  FROM embeddings, q WHERE vec_id <> query QUALIFY rank <= 5)"""


@query(f"WITH {_TOP5} SELECT query, key, round(score, 6) AS score, rank FROM s")
def nearest_of_each_query(spark, sf_dir):
    """The five nearest of every twentieth vector, by blocks of queries."""
    vectors = table(spark, sf_dir, "embeddings")
    hits = nearest_of_each(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return hits.select("query", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_TOP5} SELECT query, CAST(label AS VARCHAR) AS label, string_agg(CAST(key AS VARCHAR), ',' ORDER BY rank) AS got FROM s GROUP BY query, label HAVING max((its = label)::INT) = 0""")
def recall_misses(spark, sf_dir):
    """Queries without a neighbour of their label among five, with what they got."""
    asked, hits, found = _recalled(table(spark, sf_dir, "embeddings"))
    out = retrieval.recall_misses(asked, found, hits, "query", "key", 5)
    return out.select("query", "label", F.array_join(F.col("got").cast("array<string>"), ",").alias("got"))


# --- files of all kinds, made from every document in tasks

def _document_files(spark, sf_dir):
    """(path, length, content, curator): each document as a file of one of nine kinds, by its number."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id") % 9
    row = lambda *x: F.array(*[F.col(c).cast("string") if c in ("doc_id", "source") else F.lit(c) for c in x])
    answer = lambda data: F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data")), {"ignoreNullFields": "false"})
    rows = F.array(F.array(F.lit("Key"), F.lit("")), F.array(F.lit("id"), F.lit("text")), F.array(F.col("doc_id").cast("string"), F.concat(F.lit("t "), text)))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    bodies = [
        (0, "datastore", answer(rows)),
        (1, "datastore", answer(text)),
        (2, "datastore", answer(F.struct(F.col("doc_id"), F.col("source")))),
        (3, "datastore", answer(F.array(F.struct(F.col("doc_id").alias("a")), F.struct(F.lit(1).cast("long").alias("a"))))),
        (4, "datastore", F.lit('{"success":true}')),
        (5, "datastore", F.concat(F.lit('{"data": ['), F.col("doc_id").cast("string"))),
        (6, "csv", F.concat(F.lit("id;text\r\n"), F.col("doc_id").cast("string"), F.lit(";"), quoted, F.lit("\r\n"))),
        (7, "geojson", F.concat(F.lit('{"type":"Feature","geometry":null,"properties":{"id":'), F.col("doc_id").cast("string"), F.lit("}}"))),
        (8, "parquet", text),
    ]
    body, curator = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, name, value in bodies:
        body, curator = F.when(i == k, value).otherwise(body), F.when(i == k, name).otherwise(curator)
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), body.cast("binary").alias("content"), curator.alias("curator"))
    return files.withColumn("length", F.octet_length("content").cast("long"))


@query("""SELECT 'f' || doc_id AS path, CASE doc_id % 9 WHEN 5 THEN 'uncurated' WHEN 8 THEN 'uncurated' ELSE 'curated' END AS state,
CASE doc_id % 9 WHEN 0 THEN 'tabular' WHEN 1 THEN 'text' WHEN 2 THEN 'json' WHEN 3 THEN 'json' WHEN 4 THEN 'json' WHEN 6 THEN 'tabular' WHEN 7 THEN 'geojson' END AS kind, CAST(doc_id % 9 IN (0, 6) AS BIGINT) AS rows FROM documents""")
def files_curated(spark, sf_dir):
    """One run over answers of all shapes, delimited files, GeoJSON and files that nothing takes."""
    return curation.curate_files(_document_files(spark, sf_dir))[2].select("path", "state", "kind", F.col("rows").cast("long").alias("rows"))


@query(r"""SELECT 'f' || doc_id AS path, CASE doc_id % 9 WHEN 1 THEN 'text' ELSE 'json' END AS kind, CASE doc_id % 9 WHEN 2 THEN 'object' WHEN 3 THEN 'array' WHEN 4 THEN 'array' END AS root,
CASE doc_id % 9 WHEN 1 THEN coalesce(text, '') WHEN 2 THEN '{' || chr(10) || '  "doc_id": ' || doc_id || ',' || chr(10) || '  "source": ' || coalesce('"' || source || '"', 'null') || chr(10) || '}' || chr(10)
  WHEN 3 THEN '[' || chr(10) || '  {' || chr(10) || '    "a": ' || doc_id || chr(10) || '  },' || chr(10) || '  {' || chr(10) || '    "a": 1' || chr(10) || '  }' || chr(10) || ']' || chr(10) WHEN 4 THEN '[]' || chr(10) END AS body
FROM documents WHERE doc_id % 9 BETWEEN 1 AND 4""")
def answer_bodies(spark, sf_dir):
    """Portal answers that are no rows: texts verbatim, other values as indented JSON."""
    return curation.curate_files(_document_files(spark, sf_dir))[1].where("kind in ('text', 'json')").select("path", "kind", "root", "body")


@query(r"""SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'Key id' ELSE 'id' END AS name, CAST(doc_id AS VARCHAR) AS cell FROM documents WHERE doc_id % 9 IN (0, 6)
UNION ALL SELECT 'f' || doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Key text' ELSE 'text' END, CASE WHEN doc_id % 9 = 0 THEN 't ' || coalesce(text, '') ELSE nullif(coalesce(text, ''), '') END FROM documents WHERE doc_id % 9 IN (0, 6)""")
def document_cells(spark, sf_dir):
    """Whole texts, with their line ends, quotes and separators, as cells of delimited files and of answers with a header of two rows."""
    held = _document_files(spark, sf_dir)
    cells = files.read_csv(held.where("curator = 'csv'")).unionByName(files.read_envelope(held.where("curator = 'datastore'")).where("row_no >= 0"))
    return files.table_rows(cells).select("path", "name", "cell")


# --- links under changes

@query("""WITH att AS (SELECT DISTINCT l_orderkey AS dataset, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'O'),
ok AS (SELECT * FROM att WHERE part IN (SELECT part FROM att GROUP BY part HAVING count(*) <= 15))
SELECT 'tag:' || x.part AS via, count(*) AS links, CAST(sum(x.dataset) AS BIGINT) AS first, CAST(sum(y.dataset) AS BIGINT) AS second FROM ok x JOIN ok y ON x.part = y.part AND x.dataset < y.dataset GROUP BY x.part""")
def links_after_changes(spark, sf_dir):
    """Links after three batches (half of the items, the rest, the orders that are taken out again) are those of what is attached then; many entities become hubs in between."""
    path = work_folder(spark, "links")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dataset"), F.concat(F.lit("tag:"), F.col("l_partkey").cast("string")).alias("entity"), F.lit("tag").alias("kind"), "l_linenumber")
    gone = items.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), F.expr("dataset = o_orderkey"), "left_semi")
    batches = [items.where("l_linenumber < 3"), items, gone]
    for number, rows in enumerate(batches):
        relinking.apply_changes(rows.select("dataset", "entity", "kind", F.lit(number < 2).alias("present")), path, number, buckets=16, fan=2, fanout=15)
    links = relinking.current_links(spark, path)
    return links.groupBy("via").agg(F.count("*").alias("links"), F.sum("a").alias("first"), F.sum("b").alias("second"))


# --- curated files, written and read back by pages

def _order_cells(spark, sf_dir):
    """Curated cells: each customer's orders as the rows of a sheet."""
    orders = table(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("cell")) for n, c in (("key", "o_orderkey"), ("status", "o_orderstatus"), ("date", "o_orderdate"))])
    rows = orders.withColumn("row_no", place).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.lit("sheet").alias("sheet"), "row_no", F.explode(cells).alias("x"))
    return rows.select("path", "sheet", "row_no", "x.*")


_ORDERS = """r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)"""


@query(f"""WITH {_ORDERS} SELECT 'c' || o_custkey AS resource, position, o_orderkey AS key, o_orderstatus AS status, total, o_custkey % 7 + 5 < total AS truncated FROM r
WHERE position >= o_custkey % 7 AND position < o_custkey % 7 + 5""")
def curated_pages(spark, sf_dir):
    """All orders written as curated files by the sink, then a page of five rows of every customer's, each from the parts that hold it."""
    path = work_folder(spark, "curated")
    cells = _order_cells(spark, sf_dir)
    curated.write_curated(curated.table_values(cells), path, 0, part_rows=4)
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("resource"), (F.col("c_custkey") % 7).alias("offset"), F.lit(5).alias("limit"))
    row = F.from_json("value", "key string, status string, date string")
    out = curated.pages(spark, path, asked).withColumn("row", row)
    return out.select("resource", "position", F.col("row.key").cast("long").alias("key"), F.col("row.status").alias("status"), "total", "truncated")


@query("SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, true AS there FROM pages WHERE html IS NOT NULL")
def blobs_written(spark, sf_dir):
    """Every page's bytes as a blob under its hash, written twice over; each is there once and whole."""
    path = work_folder(spark, "blobs")
    rows = table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    curated.write_blobs(rows, path, "html")
    named = curated.write_blobs(rows, path, "html")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/raw").select(F.sha2("content", 256).alias("sha256"), "length")
    out = named.join(held, "sha256", "left")
    return out.select(F.col("path").cast("long").alias("page_id"), "sha256", "bytes", (F.col("bytes") == F.col("length")).alias("there"))


# --- places

@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 40 AS cx, c_custkey // 40 AS cy FROM customer),
p AS (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 43000 + 0.5) / 1000 - 1 AS x, ((o_orderkey * 104729) % 27000 + 0.5) / 1000 - 1 AS y FROM orders),
h AS (SELECT id, min(k) AS k FROM p JOIN s ON cx = floor(x) AND cy = floor(y) AND x - cx < 0.9 AND y - cy < 0.9 AND NOT (x - cx >= 0.3 AND x - cx < 0.6 AND y - cy >= 0.3 AND y - cy < 0.6) GROUP BY id),
n AS (SELECT id, arg_min(k, struct_pack(d := (x - (cx + 0.45)) ** 2 + (y - (cy + 0.45)) ** 2, k := k)) AS k FROM p ANTI JOIN h USING (id), s GROUP BY id)
SELECT id, 'c' || k AS shape, true AS inside FROM h UNION ALL SELECT id, 'c' || k, false FROM n""")
def points_in_shapes(spark, sf_dir):
    """Each customer's square with a hole, as a table of shapes; orders are points, within squares, in holes, between and far outside."""
    x, y = (F.col("c_custkey") % 40).cast("double"), F.floor(F.col("c_custkey") / 40).cast("double")
    ring = lambda a, b: F.array(*[F.array(x + p, y + q) for p, q in ((a, a), (b, a), (b, b), (a, b))])
    shapes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("shape"), F.col("c_custkey").alias("place"), F.array(ring(0.0, 0.9), ring(0.3, 0.6)).alias("rings"))
    key = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(key.alias("id"), (((key * 7919) % 43000 + 0.5) / 1000 - 1).alias("x"), (((key * 104729) % 27000 + 0.5) / 1000 - 1).alias("y"))
    return spatial.located(points, shapes)


# --- a portal's pages

def _portal_pages(spark, sf_dir):
    """A folder with the web pages as a portal's answers, a hundred a page, written by tasks."""
    path = work_folder(spark, "portal")
    spark.dataSource.register(curated.BlobSink)
    spark.dataSource.register(portal.PortalSource)
    rows = crawl.numbered(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "position")
    entry = F.struct(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.array(F.struct(F.lit("web").alias("name"))).alias("tags"))
    pages = rows.groupBy(F.floor(F.col("position") / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))).alias("es"))
    answer = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.transform("es", lambda x: x.e).alias("results")).alias("result")))
    out = pages.select(F.lit("pages").alias("folder"), F.concat(F.lit("page-"), (F.col("page") + 1).cast("string"), F.lit(".json")).alias("name"), answer.cast("binary").alias("content"))
    out.write.format("civic_blobs").mode("append").option("path", path).save()
    return f"{path}/pages"


@query("SELECT page_id, url AS title, 'web' AS tag FROM pages")
def portal_datasets(spark, sf_dir):
    """All pages of a portal that does not say how many there are; a task a page."""
    held = spark.read.format("civic_portal").options(path=_portal_pages(spark, sf_dir)).load()
    return held.select(F.col("id").cast("long").alias("page_id"), "title", F.element_at("tags", 1).alias("tag"))


@query("SELECT page_id, url AS title FROM pages")
def portal_stream(spark, sf_dir):
    """The same as a stream, into a table."""
    path = _portal_pages(spark, sf_dir)
    out, stream = f"{path}-rows", spark.readStream.format("civic_portal").options(path=path).load()
    started = stream.select("id", "title").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}-check").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema("id string, title string").parquet(out).select(F.col("id").cast("long").alias("page_id"), "title")
