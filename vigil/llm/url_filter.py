"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, without

OUT = ["host", "path", "rule", "score", "verdict"]
DIMENSIONS = 1 << 16
GRAMS = (3, 4, 5)

# The rules of the contract, as (verdict, host/path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# A small labelled URL table, made of hosts and paths to block and to allow. A URL is to be
# blocked if its host or its path is. Written from general knowledge; no host of a given table is in it.
BLOCKED_HOSTS = [
    "casino-royal.test", "online-casino.example", "slots-jackpot.test", "big-win-slots.invalid", "sports-betting.test", "best-bets.example",
    "poker-stakes.test", "lucky-roulette.example", "pills-online.test", "cheap-meds.example", "viagra-store.test", "pharma-discount.invalid",
    "adult-videos.test", "adult-chat.example", "xxx-cams.test", "hot-singles.example", "link-farm.test", "seo-spam.example", "spam-links.test",
    "click-track.test", "banner-ads.example", "ad-tracker.test", "popup-ads.invalid", "free-money.test", "free-prizes.example", "win-cash.test",
    "quick-loans.example", "cheap-replica.test", "free-cracks.test", "keygen-warez.example", "torrent-warez.test", "miracle-diet.example",
]
ALLOWED_HOSTS = [
    "library.test", "museum.example", "weather.test", "garden-shop.example", "university.test", "recipes.example", "travel-guide.test",
    "news-daily.example", "city-council.test", "football-club.example", "history-archive.test", "science-review.invalid", "open-source.test",
    "bakery.example", "railway.test", "music-school.example", "hospital.test", "bookstore.example", "theatre.test", "film-club.example",
    "harbour.test", "mountain-hut.invalid", "chess.test", "astronomy.example", "freedom-press.test", "adulthood.example", "alphabet.test",
    "essex-county.example", "brothers-and-sons.test", "northern-lights.example", "tradition.test", "thinking.example", "spain-tours.test",
    "linkoping.example", "windmill.test", "cashmere.example", "leather-works.test", "nation-archive.example", "reading-room.test", "betterment.example",
]
BLOCKED_PATHS = [
    "/casino/bonus", "/free-spins", "/slots/jackpot.html", "/poker/live", "/bet/now", "/pills/order", "/buy-viagra", "/cheap-meds/buy", "/adult/gallery",
    "/xxx/videos", "/hot-singles/", "/ads/click", "/banner/track", "/win-free-prize", "/free-money/", "/loans/instant-cash", "/crack/keygen.html", "/spam/links",
]
ALLOWED_PATHS = [
    "", "/", "/en/101", "/de/27.html", "/fr/633/", "/es/58", "/en/4402/", "/about", "/index.html", "/news/2024/05/", "/contact.html", "/articles/42",
    "/docs/intro.html", "/blog/post-7", "/products/list", "/team/", "/adults/courses", "/archive/winter", "/books/better-days", "/fr/9120.html",
]
PREFIXES = ["", "www.", "m.", "blog."]


def labelled_urls(spark) -> DataFrame:
    """(url, label): label 1 is a URL to block. Each host is met with four allowed and two blocked paths."""
    rows = []
    for bad, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)):
        for k, host in enumerate(hosts):
            good = [ALLOWED_PATHS[(5 * k + 3 * j) % len(ALLOWED_PATHS)] for j in range(4)]
            worse = [BLOCKED_PATHS[(7 * k + 5 * j) % len(BLOCKED_PATHS)] for j in range(2)]
            for j, path in enumerate([*good, *worse]):
                rows.append((f"https://{PREFIXES[(k + j) % len(PREFIXES)]}{host}{path}", max(bad, int(j >= len(good)))))
    return spark.createDataFrame(rows, "url string, label int")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path; a null url or one without :// has neither."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def grams(host: str, path: str) -> np.ndarray:
    """Distinct hashed character n-grams; those of the host and of the path never share a key."""
    keys = {
        f"{kind}{text[i : i + n]}"
        for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$"))
        for n in GRAMS
        for i in range(len(text) - n + 1)
    }
    return np.fromiter({xxhash.xxh64_intdigest(k) % DIMENSIONS for k in keys}, np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        at = grams(host, path)
        z = self.weights[at].sum() / np.sqrt(max(len(at), 1)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def fit_urls(labelled: DataFrame, max_rows: int = 10_000, rounds: int = 300, ridge: float = 1e-4, share: float = 0.2) -> UrlModel:
    """Fit on (url, label) rows, at most ``max_rows`` of them in hash order (ties: of equal rows any); null labels are ignored.

    ``share`` is the share of URLs to block that is expected among all URLs. Without rows of both labels 
    every URL is allowed, or blocked if all labels say so.
    """
    host, path = url_parts(F.col("url"))
    rows = labelled.filter("label is not null").select(host.alias("h"), path.alias("p"), "label", F.xxhash64("url", "label").alias("o"))
    rows = rows.orderBy("o", "h", "p").limit(max_rows).collect()
    y = np.array([r.label for r in rows], float)
    if not 0 < y.sum() < len(y):
        return UrlModel(np.zeros(DIMENSIONS), 40.0 if y.sum() else -40.0)
    found = [grams(r.h, r.p) for r in rows]
    row, col = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
    value = np.repeat([1 / np.sqrt(max(len(f), 1)) for f in found], [len(f) for f in found])
    balance = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    weights, bias, speed, push = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        z = np.bincount(row, weights[col] * value, minlength=len(y)) + bias
        error = balance * (y - 1 / (1 + np.exp(-z)))
        speed = 0.9 * speed + 4.0 * (np.bincount(col, error[row] * value, minlength=DIMENSIONS) - ridge * weights)
        push = 0.9 * push + error.sum()
        weights, bias = weights + speed, bias + push
    return UrlModel(weights, float(bias))


def filter_urls(
    df: DataFrame, model: UrlModel, rules: list[tuple[str, str]] = RULES, url_col: str = "url", threshold: float = 0.5
) -> DataFrame:
    """All rows and columns of ``df`` plus host, path, rule, score and verdict.

    A rule "host/path" fits its host and all subdomains if the url's path starts with the rule's.
    The longest fitting rule wins; of equally long ones that with the longer host, then a block.
    Without a rule the model decides (block from ``threshold`` on). Null and odd urls have an empty
    host and path and are judged like any other. Input columns named like an output column are
    replaced. An empty table gives an empty result.
    """
    base = without(df, OUT)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(h, p) for h, p in zip(hosts, paths)], dtype="float64")

    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = base.withColumns({"host": host, "path": path})
    order = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0] != "block"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name in reversed(order):
        at = name.index("/")
        own, start = name[:at].lower(), name[at:]
        fits = ((F.col("host") == own) | F.col("host").endswith(f".{own}")) & F.col("path").startswith(start)
        rule, said = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    rows = rows.withColumns({"rule": rule, "score": scored("host", "path"), "_said": said})
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("_said", method)).drop("_said")
