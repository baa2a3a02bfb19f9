"""A portal's pages from folders and over HTTP, as a table and as a stream that starts again."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from civicspark.sources import portal


def ckan(ids, count=None):
    return json.dumps({"success": True, "result": {"results": [{"id": i, "title": f"t{i}", "tags": [{"name": "x"}]} for i in ids]} | ({} if count is None else {"count": count})})


@pytest.mark.parametrize("n", [0, 1, 3, 4, 8, 9, 40, 41])
def test_the_end_is_found_without_a_count(n):
    asked = []

    def fetch(method, start, size):
        asked.append(start)
        ids = range(start, min(n, start + size))
        return ckan(ids) if ids or not start else None

    reader = portal.PortalReader({"pageSize": "4"}, fetch)
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [str(i) for i in range(n)]
    assert len(asked) <= 2 + 2 * max(1, n // 4).bit_length() + len(reader.partitions()) + 12
    told = portal.PortalReader({"pageSize": "4"}, lambda m, s, k: ckan(range(s, min(n, s + k)), n))
    assert told.end() == n


def test_errors_are_raised_in_the_portals_words():
    for body, words in (("<html>", "without JSON"), ('{"success": false, "error": {"type": "Not found"}, "errors": {"uri": ["bad"]}}', 'Not found {"uri": ["bad"]}'), ('{"success": false, "error": "closed"}', "closed"), ("[]", "error")):
        with pytest.raises(portal.PortalError, match="") as e:
            portal.entries(body, "listDatasets")
        assert words in str(e.value)


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    pages, out, check = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "check")
    pages.mkdir()
    spark.dataSource.register(portal.PortalSource)
    held = []

    def go(ids):
        held.extend(ids)
        for k in range(0, len(held), 3):
            (pages / f"page-{k // 3 + 1}.json").write_text(ckan(held[k : k + 3]))
        stream = spark.readStream.format("civic_portal").options(path=str(pages), pageSize="3").load()
        query = stream.select("id").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert go(list("abcd")) == list("abcd")
    assert go([]) == list("abcd")
    assert go(list("efgh")) == list("abcdefgh")


class Portal(BaseHTTPRequestHandler):
    def answer(self, body, status=200):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        start = int(self.path.split("start=")[1].split("&")[0])
        self.answer(ckan(range(start, min(5, start + 2)), 5))

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
        if self.path.endswith("getResourceData"):
            bad = asked["resource_uri"] == "bad"
            return self.answer('{"success": false, "error": {"type": "gone"}}' if bad else ' {"success":true, "data": [ [1.0] ]}\n', 404 if bad else 200)
        first = (asked["page_number"] - 1) * asked["records_per_page"]
        rows = [{"uri": f"u{i}", "name": f"n{i}", "org_id": 7} for i in range(first, min(3, first + asked["records_per_page"]))]
        self.answer(json.dumps({"success": True, "total_records": 3, "datasets": rows}))

    def log_message(self, *_):
        pass


def test_both_kinds_over_http(spark):
    server = HTTPServer(("127.0.0.1", 0), Portal)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        spark.dataSource.register(portal.PortalSource)
        read = spark.read.format("civic_portal")
        assert sorted(r.id for r in read.options(url=url, pageSize="2").load().collect()) == list("01234")
        rows = read.options(url=url, pageSize="2", style="rpc").load().collect()
        assert sorted((r.id, r.title, r.organization) for r in rows) == [("u0", "n0", "7"), ("u1", "n1", "7"), ("u2", "n2", "7")]
        assert portal.resource_data(url, "ok") == ' {"success":true, "data": [ [1.0] ]}\n'
        with pytest.raises(portal.PortalError, match="gone"):
            portal.resource_data(url, "bad")
    finally:
        server.shutdown()
