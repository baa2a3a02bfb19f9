"""URL filters: rules for hosts and paths, and for the rest a logistic regression.

A rule is a host and the beginning of a path (`example.com/en/`); it fits its host
and all subdomains.  Of the rules that fit a URL the longest holds (of equally long
ones that of the longer host, of equal ones `block`).  Rules are a table of any
size: the distinct pairs of a host and the beginning of a path, as long as rules
have any, ask for their host's suffixes with the beginnings of their path by an
equi-join, and the pairs with their rules are joined back to the URLs.

What no rule fits is judged by a logistic regression on hashed character n-grams of
host and path, trained by numpy on a small labelled table of URLs (at most EACH of
either label are read, those with the least hash).

Defined cases: a null URL, or one without "://", has an empty host and path and is
judged by the model's constant; rows that repeat an id or a URL are judged each;
without labels of both kinds every URL without a rule is allowed; other columns are
not looked at; an empty list of rules leaves all to the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import text as tx
from civicspark.llm.scratch import save, sent

BUCKETS, SIZES, EACH = 1 << 16, (3, 4, 5), 2000
#: Chance from which a URL without a rule is blocked; over a half, as a blocked good page is lost for good.
LEAST = 0.65
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A small labelled table: names of sites as lists of blocked and of allowed ones have them, in every one of the shapes.
BLOCKED = """
casino-royal  online-casino  lucky-casino-win  casino  bigcasino  jackpot-slots  win-big-poker  poker-bets  sports-bets  free-bets-today  bets  betting-tips  bet-win  roulette-online
adult-chat  adult-video  adult  xxx-tube  xxx-adult  hot-porn  porn-x  sex-cams  escort-girls  nude-pics
cheap-viagra  buy-pills-online  cheap-meds  pills-pharmacy  cheap-pharma  diet-pills  rx-pills  cialis-cheap
spam-links  spam  farm-links  link-farm  spam-seo  content-farm  seo-farm  cheap-backlinks
ads  ads-server  ad-track  track-click  tracker  pop-ads  adserv-track
free-money-now  get-rich-fast  payday-loans  crypto-doubler  free-prize-win  replica-watches  warez-crack  keygen-torrent
"""
ALLOWED = """
daily-news  news  weather  travel  science-journal  history-museum  city-library  university
hospital  health-service  nutrition  the-garden  cooking  recipes  farmers-market  agriculture
football-club  sports  athletics  chess  music-school  theatre  cinema  photography
government  parliament  court  tax-office  statistics  open-data  transport  railways
software  developers  code  forum  wiki  encyclopedia  dictionary  translation
bookshop  publishing  poetry  education  kindergarten  research  astronomy  biology
banking  insurance  energy  housing  architecture  engineering  environment  climate
shop  furniture  fashion  bicycles  cars  hotels  restaurants  festival  volunteers
thinking  other  nations  there  northern  weather-station  mother  the-times
station  together  action  another  solution  thread  within  shining  three  whose  thousand
"""
#: Both labels have the same shapes, so nothing is learnt from them.
SHAPES = ("{}.test/", "www.{}.test/en/1", "m.{}.test/fr/22", "blog.{}.test/de/310.html", "{}.test/es/4785/")


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label) that ships with the library; label 1 is block."""
    rows = [(f"https://{shape.format(site)}", label) for label, sites in ((1, BLOCKED), (0, ALLOWED)) for site in sites.split() for shape in SHAPES]
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: str) -> list:
    """Columns host and path of a column of URLs."""
    rest = F.when(F.coalesce(F.instr(F.col(url), "://"), F.lit(0)) > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), CAPITALS, CAPITALS.lower())
    return [host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")]


# ---- rules


def matched(pairs: DataFrame, rules: DataFrame) -> tuple[DataFrame, int]:
    """(host, head, rule, verdict) of the distinct pairs that a rule fits; a head is as much of a path as the longest rule looks at: its length, too.

    rules: (rule, verdict); a rule's host reaches to its first slash, capitals count as small there.
    """
    site = F.substring_index("rule", "/", 1)
    key = F.concat(F.translate(site, CAPITALS, CAPITALS.lower()), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)"))
    rules = rules.where("rule is not null and verdict in ('allow', 'block')").select("rule", "verdict", F.length(site).alias("own"), F.size(F.split(site, r"\.")).alias("deep"), key.alias("key"))
    rules = save(rules.groupBy("key", "own", "deep").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule")))
    sizes = sorted(size for (size,) in rules.select(F.length("key") - F.col("own")).distinct().collect())  # a number for each length of a path
    deepest, longest = rules.agg(F.max("deep")).first()[0] or 0, max(sizes, default=0)
    heads = pairs.select("host", F.substring("path", 1, longest).alias("head")).where("host <> ''").distinct()
    # a host's suffixes at dots, of as many labels as some rule's, each with the beginnings of the path that are as long as some rule's
    labels = F.split("host", r"\.", -1)
    first = F.greatest(F.lit(1), F.size(labels) - deepest + 1)
    suffix = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    begins = F.filter(F.array(*[F.lit(s) for s in sizes]).cast("array<int>"), lambda s: s <= F.length("head"))
    asked = heads.withColumn("suffix", F.explode(suffix)).withColumn("begin", F.explode(begins))
    asked = asked.select("host", "head", F.concat("suffix", F.expr("substring(head, 1, begin)")).alias("key"))
    best = F.max(F.struct(F.length("key").alias("size"), "own", "verdict", "rule"))
    found = asked.join(sent(rules), "key").groupBy("host", "head").agg(best.alias("best"))
    return found.select("host", "head", "best.rule", "best.verdict"), longest


# ---- the model


def grams(data: np.ndarray, offsets: np.ndarray, field: int, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each n-gram of `sizes` bytes of each text, the text's edges counting as a byte; equal ones of host and path differ by `field`."""
    data = tx.LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    # "^" before and "$" after each text
    padded = np.insert(data, np.repeat(offsets, 2)[1:-1], np.tile(np.frombuffer(b"^$", np.uint8), len(offsets) - 1)).astype(np.uint8)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) + 2)
    n = len(padded)
    up, down = tx._POWERS[2].upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tx._BYTE[padded] * up[:n], out=total[1:])
    for size in sizes:
        if n < size:
            continue
        i = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
        yield (tx.mix((total[i + size] - total[i]) * down[i] + np.uint64(8 * size + field)) >> np.uint64(20)).astype(np.int64) % BUCKETS, text[i]


def train(hosts: list[str], paths: list[str], labels: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weight of each bucket, constant) of the logistic regression of labels on the URLs' n-grams: gradient steps with momentum on all rows.

    A URL's features have the length 1 together.  The constant starts at, and is
    drawn to, the log odds of the labels, so what nothing is known of is judged by them.
    """
    n = len(labels)
    if not n or labels.min() == labels.max():
        return np.zeros(BUCKETS), -50.0
    batch = pa.record_batch({"host": pa.array(hosts), "path": pa.array(paths)})
    row, column, value = _design(batch)
    prior = float(np.log(labels.sum() / (n - labels.sum())))
    weights, constant, speed, push = np.zeros(BUCKETS), prior, np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(-(np.bincount(row, value * weights[column], n) + constant))) - labels
        speed = 0.9 * speed - 4.0 * (np.bincount(column, value * wrong[row], BUCKETS) / n + ridge * weights)
        push = 0.9 * push - 0.5 * (wrong.mean() + 0.1 * (constant - prior))
        weights, constant = weights + speed, constant + push
    return weights, constant


def _design(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the n-grams of a batch of hosts and paths, a row's values of length 1."""
    found = [x for field, name in enumerate(("host", "path")) for x in grams(*tx.texts(batch, name), field)]
    bucket, row = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    cell, again = np.unique(row * BUCKETS + bucket, return_counts=True)
    row, bucket = cell // BUCKETS, cell % BUCKETS
    value = 1 + np.log(again)
    return row, bucket, value / np.sqrt(np.bincount(row, value**2, batch.num_rows))[row]


def chances(weights: np.ndarray, constant: float, batch: pa.RecordBatch) -> np.ndarray:
    """The chance of label 1 of each row of (host, path)."""
    row, bucket, value = _design(batch)
    return 1 / (1 + np.exp(-(np.bincount(row, value * weights[bucket], batch.num_rows) + constant)))


_JUDGED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()), ("score", pa.float64())])


def _judged(weights: np.ndarray, constant: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(tx.texts(batch, "host")[1]) + np.diff(tx.texts(batch, "path")[1]) + 64
            ends, lo = np.cumsum(sizes), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + tx.BLOCK, "right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chances(weights, constant, part))], schema=_JUDGED)
                lo = hi

    return run


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame, least: float = LEAST, each: int = EACH, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict (allow or block) and score, the model's chance that it is to be blocked."""
    small = labels.select(*host_and_path("url"), F.col("label").cast("int").alias("label")).where("label in (0, 1)").groupBy("host", "path").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    taken = [small.where(F.col("label") == y).orderBy(F.xxhash64("host", "path"), "host", "path").limit(each).select("host", "path", "label") for y in (0, 1)]
    known = sorted(tuple(r) for r in taken[0].unionByName(taken[1]).collect())  # bounded: `each` rows of either label
    weights, constant = train([h for h, *_ in known], [p for _, p, _ in known], np.array([y for *_, y in known], float))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).select("page_id", *host_and_path("url"))
    found, longest = matched(rows, rules)
    found = sent(save(found.withColumnsRenamed({"host": "its_host", "verdict": "ruled"})))
    same = (F.col("host") == F.col("its_host")) & (F.substring("path", 1, longest) == F.col("head"))
    ruled = rows.join(found, same, "left").select("page_id", "host", "path", "rule", "ruled")
    out = ruled.mapInArrow(_judged(weights, constant), "page_id long, host string, path string, rule string, ruled string, score double")
    verdict = F.coalesce("ruled", F.when(F.col("score") >= least, "block").otherwise("allow"))
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
