"""URL filter: logistic regression on hashed character n-grams of host and path, with DataFrame functions only.

The model is fitted in plain Python on a small labelled URL table (at most MAX_TRAIN rows; SEED_URLS by default) and
has 2 * BUCKETS weights, so it goes into the plan as one array literal.  Scoring is a fold over the n-grams of each row:
no join, no exchange, no Python on the executors.

Defined cases: a null url or one without ``://`` has an empty host and path; such a url matches no rule and gets the
model's bias; texts shorter than an n-gram have none; repeated rows stay; other columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N, BUCKETS, MAX_TRAIN = 3, 1024, 10_000

#: The small labelled table.  1: block.
SEED_URLS = [
    ("https://cheap-pills.example.net/en/1", 1), ("http://www.cheap-pills.example.com/buy/now", 1), ("https://pills-online.example.org/de/7", 1),
    ("https://casino-win.example.net/en/2", 1), ("http://m.casino-win.example.com/fr/55", 1), ("https://best-casino.example.org/slots/3", 1),
    ("https://free-bets.example.net/en/9", 1), ("http://blog.free-bets.example.com/es/12", 1), ("https://bets-free.example.org/odds", 1),
    ("https://spam-farm.example.org/en/4", 1), ("http://www.spam-farm.example.net/de/8", 1), ("https://seo-spam.example.com/links/1", 1),
    ("https://adult-x.example.com/en/5", 1), ("http://m.adult-x.example.net/fr/6", 1), ("https://xxx-adult.example.org/video/77", 1),
    ("https://ads-track.example.com/en/3", 1), ("http://track.ads-server.example.net/click?id=4", 1), ("https://ads-track.example.org/pixel.gif", 1),
    ("https://poker-win.example.com/bonus", 1), ("http://replica-watches.example.net/sale", 1), ("https://free-download-crack.example.org/keygen", 1),
    ("https://viagra-shop.example.com/cheap", 1), ("http://payday-loans.example.net/apply", 1), ("https://hot-singles.example.org/meet", 1),
    ("https://www.example.org/en/100", 0), ("https://docs.example.com/en/guide/1.html", 0), ("https://blog.example.net/en/2024/05/post", 0),
    ("https://library.example.org/fr/345", 0), ("https://news.example.com/de/2210.html", 0), ("http://www.university.example.org/es/77", 0),
    ("https://museum.example.net/en/collection/8", 0), ("http://m.weather.example.com/fr/901", 0), ("https://wiki.example.org/en/Article_12", 0),
    ("https://thethe.example.com/en/825", 0), ("http://www.ththan.example.net/fr/2516", 0), ("https://m.ththre.example.org/de/685.html", 0),
    ("https://tionthe.example.com/es/44508/", 0), ("http://blog.ththin.example.net/en/21003", 0), ("https://www.therher.example.org/en/476/", 0),
    ("https://ththed.example.net/en/25688.html", 0), ("http://ththon.example.com/fr/12502", 0), ("https://tionble.example.com/en/21852", 0),
    ("https://school.example.com/en/lessons/3", 0), ("http://city.example.net/de/rathaus", 0), ("https://recipes.example.org/fr/tarte", 0),
    ("https://journal.example.com/en/issue/12", 0), ("http://www.garden.example.net/es/plantas", 0), ("https://open-data.example.org/en/sets/9", 0),
]

#: Fixed values: (host, path, verdict).  A rule holds for its host and all subdomains where the path starts with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:cut]


def grams(text: str, base: int) -> list[int]:
    """Bucket of each n-gram: a polynomial of its code points, alike in Python, Spark and SQL."""
    return [base + (ord(text[i]) * 961 + ord(text[i + 1]) * 31 + ord(text[i + 2])) % BUCKETS for i in range(len(text) - N + 1)]


def features(host: str, path: str) -> list[int]:
    return grams(f"^{host}$", 0) + grams(path, BUCKETS)


def fit(rows: list[tuple[str, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> tuple[list[float], float]:
    """Weights and bias by full-batch gradient descent on mean log loss; the score is the mean weight of the n-grams."""
    rows = rows[:MAX_TRAIN]
    data = [(features(*split_url(u)), y) for u, y in rows]
    w, b = [0.0] * (2 * BUCKETS), 0.0
    for _ in range(rounds):
        grad, gb = {}, 0.0
        for f, y in data:
            n = max(len(f), 1)
            z = b + sum(w[i] for i in f) / n
            e = (1 / (1 + math.exp(-z)) - y) / len(data)
            gb += e
            for i in f:
                grad[i] = grad.get(i, 0.0) + e / n
        for i, g in grad.items():
            w[i] -= rate * 100 * (g + decay * w[i] / len(data))
        b -= rate * gb
    return [round(x, 6) for x in w], round(b, 6)


@lru_cache(maxsize=1)
def default_model() -> tuple[list[float], float]:
    return fit(SEED_URLS)


def _grams(text: Column, base: int) -> Column:
    """One split into code points, then sums with the two that follow: a substring by place would count from the text's start."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    n = F.greatest(F.length(text) - (N - 1), F.lit(0))
    two = F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: a * 961 + b * 31)
    return F.transform(F.zip_with(two, F.slice(points, 3, n), lambda a, b: a + b), lambda x: F.lit(base) + x % BUCKETS)


def parts(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    raw = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    host = F.when(has, F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")
    return host, F.when(has, F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"(?s)^[^?#]*", 0)).otherwise("")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, model: tuple[list[float], float] | None = None) -> DataFrame:
    """page_id, host, path, rule, score, verdict of every row."""
    weights, bias = model or default_model()
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, v).otherwise(verdict)
    f = F.concat(_grams(F.concat(F.lit("^"), F.col("host"), F.lit("$")), 0), _grams(F.col("path"), BUCKETS))
    table = F.lit(weights).cast("array<double>")
    total = F.aggregate(F.transform("_f", lambda i: F.get(table, i.cast("int"))), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("_f", f)
    out = out.withColumn("score", F.lit(bias) + total / F.greatest(F.size("_f"), F.lit(1)))
    return out.select("page_id", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_sql() -> str:
    weights, bias = default_model()
    bucket = lambda s, base: f"list_transform(range(1, length({s}) - {N - 2}), lambda i: {base} + (ascii(substr({s}, i, 1)) * 961 + ascii(substr({s}, i + 1, 1)) * 31 + ascii(substr({s}, i + 2, 1))) % {BUCKETS})"
    rule = verdict = ""
    for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN"
        rule, verdict = f"{rule} {fits} '{h}{p}'", f"{verdict} {fits} '{v}'"
    return f"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM r
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), f AS (
  SELECT *, list_concat({bucket("('^' || host || '$')", 0)}, {bucket("path", BUCKETS)}) AS f FROM p
), w AS (SELECT {weights}::DOUBLE[] AS w)
SELECT page_id, host, path, CASE{rule} END AS rule,
  CASE{verdict} WHEN {bias} + coalesce(list_sum(list_transform(f, lambda i: w[i + 1])), 0) / greatest(len(f), 1) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM f, w
"""
