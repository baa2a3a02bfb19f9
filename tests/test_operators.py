from __future__ import annotations

import datetime as dt
from random import Random

from pyspark.sql import functions as F

from civicspark.operators import catalogue as cat
from civicspark.operators import crawl, curation, index, linking, metering, retrieval


def test_filters_differ_in_and_or(spark):
    rows = spark.createDataFrame([(1, ["a"], "p", "active"), (2, ["b"], None, "active"), (3, ["a"], "q", "withdrawn"), (4, ["a", "b"], "p", "out_of_scope")], "id int, tags array<string>, pub string, life string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(cat.and_filter(rows, {"tags": ["a"], "pub": ["p"]}, "life")) == [1, 4]
    assert ids(cat.and_filter(rows, {"tags": [], "pub": []}, "life")) == [1, 2, 4]
    assert ids(cat.and_filter(rows, {"life": ["withdrawn"]}, "life")) == [3]
    assert ids(cat.or_filter(rows, {"tags": ["b"], "pub": ["q"]})) == [2, 3, 4]
    assert ids(cat.or_filter(rows, {})) == [1, 2, 3, 4]


def test_grid_orders_numbers_then_text_then_blanks(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "10"), (2, ""), (3, "9"), (4, None), (5, "a")], "row_no int, x string")
    for down, expected in ((False, [3, 1, 5, 0, 2, 4]), (True, [2, 4, 0, 5, 1, 3])):
        out, order = cat.grid(rows, {"y": " "}, "x", down)
        assert [r.row_no for r in out.orderBy(*order).collect()] == expected
    out, _ = cat.grid(rows, {"x": "1"}, scan=3)
    assert [r.row_no for r in out.collect()] == [1]
    assert cat.grid(rows, {"missing": "z"})[0].count() == 0


def test_pages_and_empty_tables(spark):
    rows = spark.range(7)
    assert [(r.id, r.total) for r in cat.page(rows, [F.col("id")], 3, 5).orderBy("id").collect()] == [(5, 7), (6, 7)]
    assert cat.page(spark.range(0), [F.col("id")], 3).count() == 0
    assert metering.totals(spark.createDataFrame([], "k int, v double, at timestamp"), [], ["v"], "at").first().sum_v == 0


def test_running_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 1, 900), (1, 2, 10), (2, 1, 5), (2, 2, 6)], "k int, t int, n int")
    out = cat.running_budget(rows, ["k"], [F.col("t")], F.col("n"), 10)
    assert sorted((r.k, r.t) for r in out.collect()) == [(1, 1), (2, 1)]


def test_costs_by_exact_name_then_longest_prefix(spark):
    prices = {"gpt": (1.0, 0.0), "gpt-x": (2.0, 0.0)}
    rows = spark.createDataFrame([("gpt-x",), ("gpt-x-mini",), ("gpt-y",), ("other",)], "m string")
    out = rows.select(metering.cost(prices, F.col("m"), F.lit(1_000_000), F.lit(0), F.lit(0)).alias("c"))
    assert [r.c for r in out.collect()] == [2.0, 2.0, 1.0, 0.0]


def test_billable_and_quota(spark):
    row = spark.range(1).select(metering.billable(F.lit(10), F.lit(5), 0.1).alias("b"), metering.quota(F.lit(5), F.lit(5)).alias("q"), metering.quota(F.lit(5), F.lit(0)).alias("f")).first()
    assert row.b == 6 and row.q.exceeded and row.q.remaining == 0 and not row.f.exceeded and row.f.remaining is None


def test_a_floored_sum_is_added_in_order(spark, tmp_path):
    """Ten times 0.1, one by one, is below 1; as two sums of five it is 1."""
    import duckdb
    from conftest import same

    from civicspark.plans.entries import QUERIES, SQL

    rows = spark.range(0, 30, 1, 3).selectExpr("id AS event_id", "id % 3 AS user_id", "0.1D AS value", "'{\"k\": 7}' AS props")
    rows.repartitionByRange(6, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet') ORDER BY event_id")
    same(QUERIES["billable_quota_view"](spark, str(tmp_path)), con, SQL["billable_quota_view"])


def test_bm25_needs_every_token_and_phrases(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "beta-alpha gamma"), (4, None)], "id int, t string")
    assert sorted(r.id for r in retrieval.bm25(docs, "id", "t", "alpha beta").collect()) == [1, 3]
    assert [r.id for r in retrieval.bm25(docs, "id", "t", "beta-alpha").collect()] == [3]
    assert retrieval.bm25(docs, "id", "t", "  ").count() == 0


def test_cosine_of_unlike_and_empty_vectors_is_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "id int, v array<double>")
    assert {r.id: r.score for r in retrieval.nearest(rows, "id", "v", [1.0, 0.0]).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}


def test_fusion_prefers_keyword_hits_on_ties(spark):
    words = spark.createDataFrame([(1, 1)], "id int, rank int")
    near = spark.createDataFrame([(2, 1)], "id int, rank int")
    assert [(r.id, r.match_kind) for r in retrieval.fuse(words, near, "id").collect()] == [(1, "keyword"), (2, "semantic")]


def test_incremental_equals_full(spark):
    now = spark.createDataFrame([(i, f"c{i}", f"e{i}") for i in range(6)], "id int, content_fp string, embed_fp string")
    state = now.where("id < 4").withColumn("model_id", F.when(F.col("id") == 3, "old").otherwise("m")).withColumn("content_fp", F.when(F.col("id") == 2, "x").otherwise(F.col("content_fp")))
    out = {r.id: r.action for r in index.incremental_diff(now, state, now.where("id <> 1"), "id", "m").collect()}
    assert out == {0: "skip", 1: "update", 2: "update", 3: "reembed", 4: "insert", 5: "insert"}
    assert {r.action for r in index.incremental_diff(now, now.withColumn("model_id", F.lit("m")), now, "id", "m").collect()} == {"skip"}


def test_merge_rules(spark):
    old = spark.createDataFrame([(1, "a", "x", 1)], "id int, t string, n string, first int")
    new = spark.createDataFrame([(1, "", None, 2), (2, "b", "y", 3)], "id int, t string, n string, first int")
    out = sorted(tuple(r) for r in index.merge(old, new, ["id"], {"t": "empty", "n": "null", "first": "old"}).collect())
    assert out == [(1, "a", "x", 1), (2, "b", "y", 3)]
    assert index.insert_absent(old, new, ["id"]).count() == 2


def test_hubs_link_nothing(spark):
    rows = spark.createDataFrame([(d, "e", "tag") for d in range(51)] + [(1, "f", "group"), (2, "f", "group"), (2, "f", "group")], "dataset int, entity string, kind string")
    out = linking.links(rows).collect()
    assert [(r.a, r.b, r.via, r.heuristic, r.confidence) for r in out] == [(1, 2, "f", "shared_group", 0.7)]


def test_text_extractors(spark):
    docs = spark.createDataFrame([(1, "Бюджет от 5 май 2025 и 2024-01-02, пак 2024-01-02"), (2, "нищо"), (3, None)], "id int, t string")
    assert [(r.id, r.entity) for r in linking.subjects(docs, "id", F.col("t")).collect()] == [(1, "subject:budget")]
    assert [r.date for r in linking.iso_dates(docs, "id", F.col("t")).collect()] == ["2024-01-02"]
    assert [r.date for r in linking.named_dates(docs, "id", F.col("t")).collect()] == ["2025-05-05"]


def test_plan_with_a_lost_cursor_takes_all(spark):
    items = spark.createDataFrame([("a", 0, "complete", 1), ("b", 1, "failed", 1), ("c", 2, "pending", 0), ("d", 3, "pending", 0)], "id string, position int, outcome string, attempts int")
    cursor = lambda x: spark.createDataFrame([(x,)], "cursor string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(crawl.plan_session(items, cursor("c"), "id")) == ["d"]
    assert ids(crawl.plan_session(items, cursor("gone"), "id")) == ["c", "d"]
    assert ids(crawl.plan_session(items, cursor(None), "id", retry=True, most=2)) == ["b", "c"]
    assert crawl.progress(items).first().remaining == 3


def test_bounded_sessions_equal_one(spark):
    items = spark.createDataFrame([(f"{i:02}", i, "pending", 0) for i in range(9)], "id string, position int, outcome string, attempts int")
    seen, cursor = [], None
    while True:
        part = [r.id for r in crawl.plan_session(items, spark.createDataFrame([(cursor,)], "cursor string"), "id", 4).collect()]
        if not part:
            break
        seen, cursor = seen + part, part[-1]
    assert seen == [f"{i:02}" for i in range(9)]


def test_robots_longest_rule_and_ties(spark):
    rules = spark.createDataFrame([("*", "/", False), ("*", "/open", True), ("bot", "/x", False), ("bot", "/x", True)], "agent string, prefix string, allow boolean")
    paths = spark.createDataFrame([("any", "/open/a"), ("any", "/b"), ("bot", "/b"), ("bot", "/x/1")], "agent string, path string")
    out = {(r.agent, r.path): r.allowed for r in crawl.allowed(paths, rules).collect()}
    assert out == {("any", "/open/a"): True, ("any", "/b"): False, ("bot", "/b"): True, ("bot", "/x/1"): True}


def test_cron(spark):
    crons = spark.createDataFrame([("*/15 * * * *",), ("0 3 1 * *",), ("30 10 * * 1-5",), ("5/2 4 29 2 *",)], "cron string")
    after = F.lit("2026-01-02 10:07:30").cast("timestamp")
    out = {r.cron: r.next_fire for r in crawl.next_fires(crons, after, 1500).collect()}
    assert out["*/15 * * * *"] == dt.datetime(2026, 1, 2, 10, 15)
    assert out["0 3 1 * *"] == dt.datetime(2026, 2, 1, 3, 0)
    assert out["30 10 * * 1-5"] == dt.datetime(2026, 1, 2, 10, 30)
    assert out["5/2 4 29 2 *"] == dt.datetime(2028, 2, 29, 4, 5)


def test_scope_hash_ignores_order_and_case(spark):
    of = lambda d: spark.range(1).select(crawl.scope_hash(d).alias("h")).first().h
    assert of({"tags": ["A", "b"]}) == of({"tags": ["b ", "a", "a"]}) != of({"tags": ["b"]})
    assert of({}) == of({"tags": [" "]})


def test_votes(spark):
    columns = {
        "ints": ["1", "2", "1 000"], "nine": ["1"] * 9 + ["x"], "eight": ["1"] * 8 + ["x", "y"], "mixed": ["1", "2,5"], "flags": ["да", "не"], "ones": ["1", "0"],
        "dates": ["2024-01-01", "1.2.2024"], "blank": ["", None], "holes": ["5", ""],
    }
    cells = spark.createDataFrame([(k, v) for k, vs in columns.items() for v in vs], "name string, cell string")
    out = {r.name: (r.type, r.confidence, r.nullable) for r in curation.vote(cells, ["name"], "cell").collect()}
    assert out == {
        "ints": ("integer", 0.95, False), "nine": ("integer", 0.8, False), "eight": ("string", 0.7, False), "mixed": ("decimal", 0.95, False), "flags": ("boolean", 0.95, False), "ones": ("integer", 0.95, False),
        "dates": ("datetime", 0.95, False), "blank": ("string", 0.5, True), "holes": ("integer", 0.95, True),
    }


def test_cells_keep_what_cannot_be_cast(spark):
    rows = spark.createDataFrame([("t", i, "n", c) for i, c in enumerate(["1"] * 9 + [" x "])], "path string, row int, name string, cell string")
    out = [r.cell for r in curation.curate(rows, ["path"], "name", "cell").orderBy("row").collect()]
    assert out[0].value == "1.0" and out[0].cast and out[9].value == "x" and not out[9].cast


def test_names_told_apart(spark):
    rows = spark.createDataFrame([("t", i, n) for i, n in enumerate(["x", "x_1", "x", "x", "y"])], "path string, position int, name string")
    out = curation.told_apart(rows, ["path"], "name", "position").orderBy("position").collect()
    assert [r.name for r in out] == ["x", "x_1", "x_2", "x_3", "y"]
    slugs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "base string, i int")
    assert sorted(r.slug for r in curation.unique_slugs(slugs, "base", ["i"]).collect()) == ["a", "a-2", "b"]


def test_histogram_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double")
    assert [(r.le, r.n) for r in metering.cumulative_histogram(rows, "v", [1, 2]).orderBy("place").collect()] == [("1", 1), ("2", 2), ("+Inf", 3)]


def test_names_of_every_length_equal_contains(spark):
    import random

    from civicspark.operators.names import names_in_texts

    rng = random.Random(6)
    letters = "ab ж數é"
    names = {"".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(300)} | {"a", "ж", "aaaaaaaa", "aaaaaaaaa", "a" * 40}
    texts = [(i, "".join(rng.choices(letters.upper() + letters, k=rng.choice([0, 1, 7, 8, 9, 60, 400])))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "A" * 50), (None, "AB ж"), (102, "x"), (103, "a" * 39 + "b" + "é" * 30)]
    frame = spark.createDataFrame(texts, "id long, t string").repartition(4)
    out = names_in_texts(frame, "id", F.col("t"), spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "pattern string"))
    expected = {(i, n) for i, t in texts for n in names if n in (t or "").lower()}
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert names_in_texts(frame, "id", F.col("t"), spark.createDataFrame([], "pattern string")).count() == 0


def test_points_in_shapes_equal_brute_force(spark):
    """Stars with many corners, holes, overlaps, lines along cells' edges, points on corners and far away; cells of several sizes."""
    import math
    import random

    import numpy as np

    from civicspark.operators import spatial

    rng = random.Random(9)
    shapes = []
    for k in range(14):
        cx, cy, n = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.randint(3, 40)
        star = [[cx + rng.uniform(0.3, 3) * math.cos(2 * math.pi * i / n), cy + rng.uniform(0.3, 3) * math.sin(2 * math.pi * i / n)] for i in range(n)]
        shapes.append((f"s{k}", [star] + [[[cx - 0.1, cy - 0.1], [cx + 0.1, cy - 0.1], [cx, cy + 0.2]]] * (k % 2)))
    shapes += [("box", [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]]), ("thin", [[[6.0, -6.0], [6.0, 6.0], [6.001, 6.0], [6.001, -6.0]]])]
    points = [(i, rng.uniform(-7, 7), rng.uniform(-7, 7)) for i in range(400)] + [(1000 + i, float(rng.randint(-1, 5)), rng.choice([0.5, 1.5, 3.5])) for i in range(40)]
    points += [(2000, 1e6, -1e6), (2001, 6.0005, 0.0), (2002, None, 1.0), (2002, 0.5, 0.5), (None, 0.5, 0.5), (2003, float("nan"), 0.0)]
    edges = [spatial.edges_of(r) for _, r in shapes]
    centres = np.array([np.concatenate([np.array(r) for r in rings]).mean(0) for _, rings in shapes])
    expected = []
    for i, x, y in points:
        if x is None or x != x:
            expected.append((i, None, False))
            continue
        inside = [k for k, e in enumerate(edges) if spatial.crossed(e, np.array([x]), np.array([y]))[0]]
        near = int(((centres - [x, y]) ** 2).sum(1).argmin())
        expected.append((i, shapes[inside[0] if inside else near][0], bool(inside)))
    frame = spark.createDataFrame(points, "id int, x double, y double").repartition(3)
    table = spark.createDataFrame([(k, s, r) for k, (s, r) in enumerate(shapes)], "place long, shape string, rings array<array<array<double>>>").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    for cell in (None, 0.37, 1.0, 50.0):
        out = sorted((tuple(r) for r in spatial.located(frame, table, cell).collect()), key=key)
        assert out == sorted(expected, key=key), cell
    assert {r["shape"] for r in spatial.located(frame, table.where("false")).collect()} == {None}


def test_nearest_centres_by_tiles_equal_brute_force(spark, monkeypatch):
    """Many tiles of clustered, repeated and equally near centres; points far outside, on centres and in a tile that is looked at in parts."""
    import numpy as np

    from civicspark.operators import spatial

    monkeypatch.setattr(spatial, "TILE", 25)
    monkeypatch.setattr(spatial, "POINTS", 40)
    rng = np.random.default_rng(3)
    centres = np.concatenate([rng.normal(0, 0.01, (300, 2)), rng.uniform(-50, 50, (400, 2)) * [1, 20], [[i % 9, i // 9 % 9] for i in range(162)]])
    points = np.concatenate([rng.normal(0, 0.02, (200, 2)), rng.uniform(-60, 60, (200, 2)) * [1, 20], centres[:40], [[0.5, 0.5], [3.5, 4.0], [1e7, -1e7], [-1e7, 0.0]]])
    places = rng.permutation(len(centres))
    square = ((points[:, None] - centres) ** 2).sum(2)
    expected = {tuple(x): int(np.where(d == d.min(), places, 10**9).min()) for x, d in zip(points.tolist(), square, strict=True)}
    table = spark.createDataFrame([(int(k), *c) for k, c in zip(places, centres.tolist(), strict=True)], "place long, cx double, cy double").repartition(3)
    found = spatial.nearest_centres(spark.createDataFrame(points.tolist(), "x double, y double").distinct(), table).collect()
    assert {(r.x, r.y): r.place for r in found} == expected and len(found) == len(expected)


def test_names_told_apart_equal_one_after_the_other(spark):
    """Suffixes that meet other names' own, numbers behind numbers, null names and keys; a key of many equal names needs no array of them."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["s", "t", None]), i, rng.choice(["x", "x_1", "x_1_1", "x_2", "x_02", "x_0", "y", "_1", "", None])) for i in range(400)]
    expected, taken = [], {}
    for key, i, name in rows:
        own, turn, made = taken.setdefault(key, set()), 0, name
        while name is not None and made in own:
            turn += 1
            made = f"{name}_{turn}"
        own.add(made)
        expected.append((key, i, made))
    frame = spark.createDataFrame(rows, "path string, position int, name string").repartition(3)
    assert sorted(map(tuple, curation.told_apart(frame, ["path"], "name", "position").collect()), key=lambda r: r[1]) == expected
    many = curation.told_apart(spark.range(100_000).selectExpr("'k' AS k", "id", "'n' AS n"), ["k"], "n", "id")
    assert many.agg(F.count_distinct("name"), F.max("name")).first() == (100_000, "n_99999")


def test_hash_embeddings_unrounded(spark):
    """Shares whose fifth place is another as a 32-bit float."""
    import math

    import numpy as np

    text = {(a, b): "a" * a + "b" * b for a, b in [(23, 39), (26, 53), (26, 399)]}
    rows = spark.createDataFrame(list(enumerate(text.values())), "id int, t string")
    wide = {r.id: r.vector for r in retrieval.hash_embeddings(rows, "id", "t", kind="double").collect()}
    for i, (a, b) in enumerate(text):
        x = a / math.sqrt(a * a + b * b)
        assert wide[i][1] == x and round(wide[i][1], 5) != round(float(np.float32(x)), 5)
    assert dict(retrieval.hash_embeddings(rows, "id", "t").dtypes)["vector"] == "array<float>"


def test_links_are_counted_without_being_made(spark):
    """Datasets that share several entities, small and large sets, copies and a hub, against the links themselves."""
    random = Random(5)
    rows = [(d, f"tag:{random.randrange(60)}", "tag") for d in range(150) for _ in range(random.choice([1, 2, 3, 5, 9]))]
    rows += [(d, f"tag:{e}", "tag") for d in range(200, 206) for e in range(100, 108)] + [(d, "org:1", "organization") for d in range(0, 150, 2)] + [(900, "tag:alone", "tag"), (None, "tag:5", "tag"), (3, None, "tag")]
    frame = spark.createDataFrame(rows, "dataset long, entity string, kind string")
    links = linking.either_side(linking.links(frame, 20)).groupBy("dataset").agg(F.count("*").alias("links"), F.countDistinct("other").alias("neighbours"))
    expected = {tuple(r) for r in links.collect()}
    assert any(n < k for _, k, n in expected)
    for paired in (16, 4, 1, 0):
        out = linking.link_counts(frame, 20, paired)
        assert {tuple(r) for r in out.select("dataset", "links", "neighbours").collect()} == expected
