"""URL filter: rules first, then a logistic regression on hashed character n-grams.

Rules name a host and a path prefix and fit the host with all its subdomains;
the longest fitting rule decides. URLs that no rule fits are judged by the
regression, trained on the driver from a small labelled table of URLs; its
weights, one float per hash bucket, go to the workers with the task.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SIZES = (3, 4, 5)

#: Labelled URLs for training: addresses to allow and addresses to block.
ALLOWED = """
http://library.example/catalogue/12 https://www.townhall.example/en/opening-hours
https://blog.gardener.example/2019/roses https://news.example/world/article-71.html
http://physics.university.example/papers/44 https://m.weather.example/en/310
https://docs.project.example/guide/install.html https://museum.example/de/exhibits/8
https://forum.carpentry.example/thread/901?page=2 http://recipes.example/fr/soup/17
https://www.railway.example/timetable/55 https://encyclopedia.example/wiki/Ocean
http://blog.teacher.example/en/lesson-3 https://journal.medicine.example/es/issue/20
https://www.parliament.example/en/debates/640 https://travel.example/en/italy/rome
https://m.northern.example/en/853 https://thinking.example/en/412#top
http://www.orchestra.example/season/7 https://interior.example/en/220?utm_source=feed
https://blog.history.example/de/77 https://www.therapy.example/fr/articles/31
http://national.example/es/533/ https://station.example/en/25?page=2&ref=x
https://blog.reading.example/en/90 https://www.sharing.example/en/118.html
https://other.example/fr/825 https://www.mountain.example/en/9/
https://thread.example/en/600 https://m.nation.example/de/73
http://blog.thunder.example/en/2 https://tension.example/fr/308.html
https://notion.example/en/999 http://www.earth.example/en/4410
https://theatre.example/en/47 https://blog.thesis.example/en/5021
""".split()
BLOCKED = """
http://www.casino-royal.example/win/12 https://best-casino.example/en/slots
https://blog.online-casino.example/bonus https://casino-bonus.example/en/3
https://cheap-pills.example/buy/now http://www.cheap-meds.example/en/41
https://buy-pills-online.example/es/7 https://pills-cheap.example/en/520
https://free-bets.example/sport http://www.bets-today.example/en/6
https://best-bets.example/odds/77 https://free-spins.example/play
https://adult-video.example/en/1 https://www.adult-chat.example/rooms/8
https://adult-x.example/en/200 http://xxx-adult.example/pics
https://ads-server.example/click?id=1 http://track-ads.example/en/pixel
https://m.ads-click.example/banner/3 https://ad-track.example/en/71
https://spam-links.example/en/5 http://www.link-farm.example/de/90
https://seo-farm.example/en/2 https://spam-blog.example/fr/61
https://content-farm.example/en/800 http://spam-farm.example/es/14
https://win-prize-now.example/claim https://you-win.example/en/free
https://payday-loans.example/apply http://quick-loans.example/en/30
https://replica-watches.example/shop https://cheap-replica.example/en/9
https://cracked-software.example/keygen http://free-warez.example/en/100
https://escort-girls.example/city/4 https://poker-win.example/en/51
""".split()


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def deciding_rule(rules: list[Rule], host: Column, path: Column, pick) -> Column:
    """``pick`` of the longest rule that fits, as a literal; null if none fits."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        inside = (host == rule.host) | host.endswith("." + rule.host)
        out = out.when(inside & path.startswith(rule.path), F.lit(pick(rule)))
    return out


def grams(host: str, path: str) -> np.ndarray:
    """Hash buckets of the character n-grams of host and path, each kept apart by a mark."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = [c.encode("utf-8", "surrogatepass") for c in text]
        for n in SIZES:
            for i in range(len(raw) - n + 1):
                found.add(zlib.crc32(b"".join(raw[i : i + n]), ord(mark)) % BUCKETS)
    return np.array(sorted(found), np.int64)


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a labelled URL, as the column functions have them."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:].partition("#")[0].partition("?")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path


def train(
    allowed: list[str] = ALLOWED,
    blocked: list[str] = BLOCKED,
    rounds: int = 1200,
    rate: float = 2.0,
    decay: float = 1e-3,
) -> np.ndarray:
    """Weights per bucket and, last, the bias: gradient descent on the labelled URLs."""
    rows = [grams(*split_url(u)) for u in [*allowed, *blocked]]
    target = np.array([0.0] * len(allowed) + [1.0] * len(blocked))
    seen = np.unique(np.concatenate(rows))
    features = np.zeros((len(rows), len(seen) + 1))
    for k, found in enumerate(rows):
        features[k, np.searchsorted(seen, found)] = 1 / np.sqrt(len(found))
    features[:, -1] = 1
    fitted = np.zeros(len(seen) + 1)
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-features @ fitted))
        fitted -= rate * (features.T @ (guess - target) / len(rows) + decay * fitted)
    weights = np.zeros(BUCKETS + 1)
    weights[seen], weights[-1] = fitted[:-1], fitted[-1]
    return weights


def judge_urls(pages: DataFrame, rules: list[Rule], weights: np.ndarray | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of every row.

    ``rule`` is the deciding rule's host and path or null, ``score`` the
    regression's probability that the address is to be blocked, and
    ``verdict`` the rule's or else ``block`` from a score of 0.5. A null url,
    or one without ``://``, has an empty host and path, which no rule fits and
    the regression judges by its bias. ``page_id`` is passed through, null or
    repeated; other columns are ignored.
    """
    weights = train() if weights is None else weights

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = np.empty(len(hosts))
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            found = grams(host, path)
            out[k] = weights[found].sum() / np.sqrt(max(len(found), 1)) + weights[-1]
        return pd.Series(1 / (1 + np.exp(-out)))

    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return parts.withColumn("score", score("host", "path")).select(
        "page_id",
        "host",
        "path",
        deciding_rule(rules, host, path, lambda r: r.text).alias("rule"),
        F.coalesce(
            deciding_rule(rules, host, path, lambda r: r.verdict),
            F.when(F.col("score") >= 0.5, "block").otherwise("allow"),
        ).alias("verdict"),
        "score",
    )
