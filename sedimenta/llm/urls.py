"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for the rest.

The model learns on the driver from LABELLED, a table of some hundred URLs; its features come from the
same column expressions that score the pages, and scoring is column expressions only. Of a URL
without rule the verdict is the model's, ``block`` from a probability of THRESHOLD on.

A null URL, or one without ``://``, has an empty host and path and fits no rule. URLs of any length
cost time in proportion to it. Rows repeat as they are; only page_id and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.tables import let

BUCKETS = 4096
GRAMS = (3, 4)
THRESHOLD = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: (host and path, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

_GOOD_HOSTS = """library.example.org museum.example.net university.example.org archive.example.net news.example.org
    science.example.net history.example.org gardening.example.net recipes.example.org weather.example.net
    docs.example.org wiki.example.net blog.travel.example.org m.journal.example.net www.cityhall.example.org
    health.example.net music.example.org physics.example.net school.example.org books.example.net
    www.transit-authority.example.org hospital.example.net blog.letters.example.org astronomy.example.net m.parliament.example.org
    www.northern-herald.example.net theatre.example.org forestry.example.net engineers.example.org www.mathematics.example.net
    m.cathedral.example.net blog.painting.example.org railway.example.net handwriting.example.org www.botany.example.org
    lighthouse.example.net registry.example.org blog.seamstress.example.net m.harbour.example.org whittling.example.net
    riverside.example.net trustees.example.org parks.example.net violins.example.org planets.example.net housing.example.org
    www.sailing.example.net ceramics.example.org blog.orchard.example.net m.gazette.example.org economics.example.net
    authors.example.org kitchen.example.net pathology.example.org climate.example.net www.heritage.example.org
    teachers.example.org www.orchestra.example.net translation.example.org m.statistics.example.net blog.athletics.example.org""".split()
_BAD_HOSTS = """casino.example.net grand-casino.example.org casinobonus.example.net casino-slots.example.org slots.example.org
    jackpot.example.net roulette-online.example.org poker-room.example.net betting.example.org sportbets.example.net bets24.example.org
    lottery-winner.example.net pills.example.org pillshop.example.net diet-pills.example.org pharmacy-discount.example.net
    viagra.example.org rx-meds.example.net adult.example.org adultchat.example.net adult-videos.example.org xxx.example.net
    porn.example.org webcam-girls.example.net escorts.example.org ads.example.net adserver.example.org popup-ads.example.net
    ads-network.example.org track.example.net tracker.example.org click-track.example.net pixel-track.example.org spam.example.net
    spammers.example.org bulk-spam.example.net link-farm.example.org backlinks.example.net cheap-loans.example.org payday-loans.example.net
    cheap-watches.example.org replica-watches.example.net warez.example.org keygen-crack.example.net freebies.example.org
    casino-games.example.net live-casino.example.org vegas-casino.example.net instant-win.example.org win-cash.example.net
    pills-express.example.org adult-dating.example.net spam-mail.example.org track-clicks.example.net free-slots.example.org
    www.free-ringtones.example.net m.win-prizes.example.org blog.cheap-meds.example.net m.casino-club.example.org www.spam-links.example.org""".split()
_PATHS = """/en/1204 /de/88 /fr/4410.html /es/73/ /en/articles/rivers /about /2019/04/harvest /en/30211?page=2 /wiki/Tides
    /de/51240.html""".split()

#: Small labelled table, written by hand from the usual topics of block lists and none of the hosts that it is to judge:
#: (url, 1 to block). Each host stands with three paths that say nothing.
LABELLED = tuple(
    (f"http://{host}{_PATHS[(i + k) % len(_PATHS)]}", y)
    for y, hosts in ((0, _GOOD_HOSTS), (1, _BAD_HOSTS))
    for i, host in enumerate(hosts)
    for k in (0, 3, 7)
) + (
    ("http://shop.example.org/out/casino-bonus", 1),
    ("http://go.example.net/redirect/free-bets", 1),
    ("http://portal.example.org/click/ads/track", 1),
    ("http://portal.example.org/en/casebook", 0),
    ("http://go.example.net/de/beschreibung", 0),
    ("http://shop.example.org/fr/pilier", 0),
)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[float, ...]


def host_of(url: Column) -> Column:
    """Behind the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Behind the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits; null if none does. One of equal length that stands earlier wins."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


def _grams(text: Column, mark: str) -> Column:
    """Buckets of all character n-grams of mark + text, repeats included."""

    def of_length(chars: Column, n: int) -> Column:
        gram = lambda c, i: F.concat(c, *(F.get(chars, i + k) for k in range(1, n)))
        return F.transform(F.slice(chars, 1, F.greatest(F.size(chars) - n + 1, F.lit(0))), lambda c, i: F.pmod(F.xxhash64(F.lit(mark), gram(c, i)), F.lit(BUCKETS)).cast("int"))

    def of(chars: Column) -> Column:
        return F.concat(*(of_length(chars, n) for n in GRAMS))

    return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), of)


def buckets_of(host: Column, path: Column) -> Column:
    return F.concat(_grams(host, "h"), _grams(path, "p"))


def _fit(rows: list[tuple[list[int], int]], rounds: int = 300, ridge: float = 1e-4) -> Model:
    """Full-batch gradient descent with Nesterov's momentum over the labelled table."""
    x = np.zeros((len(rows), BUCKETS + 1))
    for i, (found, _) in enumerate(rows):
        np.add.at(x[i], found, 1 / max(1, len(found)) ** 0.5)
        x[i, BUCKETS] = 1
    y = np.array([label for _, label in rows], dtype=float)
    rate = 4 / np.linalg.norm(x @ x.T / len(y), 2)  # the same norm as of x.T @ x, by rows instead of buckets
    w = before = np.zeros(BUCKETS + 1)
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        p = 1 / (1 + np.exp(-(x @ ahead)))
        before, w = w, ahead - rate * (x.T @ (p - y) / len(y) + ridge * ahead)
    return Model(float(w[BUCKETS]), tuple(float(v) for v in w[:BUCKETS]))


def fit(spark: SparkSession, labelled: tuple[tuple[str, int], ...] = LABELLED) -> Model:
    """labelled is small and held by the driver; its size bounds what comes back."""
    df = spark.createDataFrame(list(labelled), "url string, label int")
    found = df.select(buckets_of(host_of(F.col("url")), path_of(F.col("url"))).alias("b"), "label", "url").collect()
    return _fit([(list(r["b"]), r["label"]) for r in sorted(found, key=lambda r: (r["url"], r["label"]))])


def probability(host: Column, path: Column, model: Model) -> Column:
    """Probability that the URL is to be blocked."""
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")  # one constant, folded once
    total = let(buckets_of(host, path), lambda b: F.aggregate(b, F.lit(0.0), lambda a, k: a + F.get(weights, k)) / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")))
    return 1 / (1 + F.exp(-(total + model.bias)))


def judged(pages: DataFrame, model: Model, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """A row per page: host, path, the rule that decides or null, verdict, and the model's probability to block."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = parts.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), probability(F.col("host"), F.col("path"), model).alias("block_probability"))
    verdict = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    for rule, decided in rules:
        verdict = F.when(F.col("rule") == rule, decided).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")
