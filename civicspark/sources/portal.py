"""Python data sources over the pages of a portal, read by tasks, a partition a page: as a table or as a stream.

Two kinds of portal are read: `ckan` (package_search by start and rows) and `rpc`
(listDatasets by POST with a page number).  Pages come over HTTP (option url), from
files page-1.json, page-2.json, ... of a folder (option path, any of Arrow's file
systems), or from a fetcher that is given in code.

How many rows there are is what the first answer says; a portal that does not say is
asked for pages ever farther on until one is empty or short.  An answer without
success raises, with the portal's own words.  The stream's offset is the number of
rows; a stream that starts again goes on behind its last offset.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "id string, name string, title string, notes string, organization string, metadata_modified string, tags array<string>, raw string"
#: Fetches a page (method, first row, rows): the body as it is, or None where there is no such page.
Fetch = Callable[[str, int, int], "str | None"]


class PortalError(ValueError):
    """A portal's answer that is none: no JSON, or without success."""


class Page(InputPartition):
    def __init__(self, start: int, skip: int = 0, take: int | None = None):
        self.start, self.skip, self.take = start, skip, take


def parsed(body: str, method: str) -> dict:
    """An answer, or PortalError with its error's type and the fields at fault."""
    try:
        answer = json.loads(body)
    except ValueError:
        raise PortalError(f"{method} answered without JSON: {body[:200]}") from None
    if not isinstance(answer, dict) or answer.get("success") is not True:
        error = answer.get("error") if isinstance(answer, dict) else None
        kind = error.get("type", "error") if isinstance(error, dict) else error if isinstance(error, str) else "error"
        fields = f" {json.dumps(answer['errors'], ensure_ascii=False)}" if isinstance(answer, dict) and answer.get("errors") else ""
        raise PortalError(f"{method} answered without success: {kind}{fields}")
    return answer


def entries(body: str, method: str) -> tuple[list[dict], int | None]:
    """The datasets of a page, and how many there are in all if the portal says so."""
    answer = parsed(body, method)
    if method == "listDatasets":
        return answer["datasets"], answer.get("total_records")
    return answer["result"]["results"], answer["result"].get("count")


def row(x: dict) -> tuple:
    owner = x.get("organization") or {}
    tags = [t["name"] if isinstance(t, dict) else str(t) for t in x.get("tags") or []]
    text = lambda v: None if v is None else str(v)
    organization = owner.get("id") if isinstance(owner, dict) else owner
    names = (x.get("id", x.get("uri")), x.get("name", x.get("uri")), x.get("title", x.get("name")), x.get("notes", x.get("descript")), organization or x.get("org_id"), x.get("metadata_modified", x.get("updated_at")))
    return (*map(text, names), tags, json.dumps(x, ensure_ascii=False))


def packages(page: str) -> Iterator[tuple]:
    """Rows of a package_search answer; anything but success raises."""
    yield from map(row, entries(page, "package_search")[0])


def from_folder(path: str) -> Fetch:
    from pyarrow import fs

    from civicspark.sources.curated import opened

    def fetch(method: str, start: int, size: int) -> str | None:
        system, root = opened(path)
        name = f"{root}/page-{start // size + 1}.json"
        if system.get_file_info(name).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(name) as page:
            return page.read().decode()

    return fetch


def from_web(url: str, key: str | None = None, timeout: float = 60) -> Fetch:
    """Pages over HTTP; an error's body is read too, as it says what was wrong."""

    def fetch(method: str, start: int, size: int) -> str | None:
        if method == "listDatasets":
            asked = {"records_per_page": size, "page_number": start // size + 1} | ({"api_key": key} if key else {})
            request = urllib.request.Request(f"{url.rstrip('/')}/{method}", json.dumps(asked).encode(), {"content-type": "application/json"})
        else:
            asked = urllib.parse.urlencode({"start": start, "rows": size, "sort": "metadata_modified desc"})
            request = urllib.request.Request(f"{url.rstrip('/')}/api/3/action/{method}?{asked}")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            return e.read().decode()

    return fetch


def resource_data(url: str, resource: str, key: str | None = None, timeout: float = 60) -> str:
    """The body of a resource's data as the portal sent it; an error raises, nothing else is changed."""
    asked = {"resource_uri": resource} | ({"api_key": key} if key else {})
    request = urllib.request.Request(f"{url.rstrip('/')}/getResourceData", json.dumps(asked).encode(), {"content-type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            body = answer.read().decode()
    except urllib.error.HTTPError as e:
        body = e.read().decode()
    try:
        answer = json.loads(body)
    except ValueError:
        raise PortalError(f"getResourceData answered without JSON: {body[:200]}") from None
    if isinstance(answer, dict) and answer.get("success") is False:
        parsed(body, "getResourceData")
    return body


class _Pages:
    """What both readers share: the options, the pages, the end."""

    def __init__(self, options: dict[str, str], fetch: Fetch | None = None):
        self.size, self.known = int(options.get("pageSize", "100")), options.get("count")
        self.method = "listDatasets" if options.get("style") == "rpc" else "package_search"
        self.fetch = fetch or (from_web(options["url"], options.get("key")) if "url" in options else from_folder(options["path"]))

    def page(self, start: int) -> tuple[list[dict], int | None]:
        body = self.fetch(self.method, start, self.size)
        return ([], None) if body is None else entries(body, self.method)

    def end(self) -> int:
        """The number of rows: as the portal says, else found by asking for pages twice as far on, then between."""
        if self.known is not None:
            return int(self.known)
        rows, count = self.page(0)
        if count is not None or len(rows) < self.size:
            return len(rows) if count is None or not rows else count
        full, beyond = 0, 1
        while len(rows := self.page(beyond * self.size)[0]) == self.size:
            full, beyond = beyond, beyond * 2
        while not rows and beyond - full > 1:
            middle = (full + beyond) // 2
            found = self.page(middle * self.size)[0]
            if len(found) == self.size:
                full = middle
            else:
                beyond, rows = middle, found
        return beyond * self.size + len(rows)

    def between(self, first: int, last: int) -> list[Page]:
        """The pages that hold the rows first <= i < last."""
        size = self.size
        return [Page(p * size, max(first - p * size, 0), last - p * size) for p in range(first // size, -(-last // size))] if last > first else []

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from map(row, self.page(partition.start)[0][partition.skip : partition.take])


class PortalReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.between(0, self.end()) or [Page(0, 0, 0)]


class PortalStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": self.end()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.between(start["row"], end["row"])

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class PortalSource(DataSource):
    """Register with spark.dataSource.register(PortalSource).

    Options: path or url; style (ckan or rpc), pageSize, key, and count where the
    number of rows is known beforehand.
    """

    @classmethod
    def name(cls) -> str:
        return "civic_portal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PortalReader:
        return PortalReader(_options(self.options))

    def streamReader(self, schema: StructType) -> PortalStream:
        return PortalStream(_options(self.options))


def _options(options: dict[str, str]) -> dict[str, str]:
    """Options by their names here, whatever their case was given in."""
    names = {n.lower(): n for n in ("path", "url", "style", "pageSize", "key", "count")}
    return {names.get(k.lower(), k): v for k, v in options.items()}
