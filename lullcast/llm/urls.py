"""URL filter: longest-rule verdicts, and boosted trees on lexical features for all other URLs.

The trees are trained on labelled URLs: a bounded sample of the table's distinct
URLs (documented parameter ``SAMPLE``, taken by hash order), labelled from a short
list of host words, together with generated examples of the same two kinds, so that
an empty or one-sided table still gives a model.  The listed words are not features:
the trees see lengths, depth, digit ratio, entropy, parameter counts, hyphens and the
suffix's share of blocked labels, which is counted over all rows at any size.

Cases: a null URL, or one without ``://``, has an empty host and path and gets
the trees' verdict on its text; repeated URLs get equal verdicts; of equally long
rules the first in sort order wins; empty tables and other columns are allowed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boost
from .work import Work

#: Fixed rules: verdict, and host with path prefix.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Host words that label a URL as unwanted.
UNWANTED = ("ads", "adult", "bets", "casino", "cheap", "farm", "free", "pills", "spam", "track", "win", "xxx")
#: URLs at most that the trees are trained on.
SAMPLE = 20000
THRESHOLD = 0.5
#: Suffixes with one in so many rows are broadcast (as many at most); the others are joined.
OFTEN = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    after = F.substr(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def suffix_of(url: Column) -> Column:
    """The host's last two labels."""
    return F.substring_index(host_of(url), ".", -2)


def label_of(url: Column) -> Column:
    """1 where a word of the host is listed, else 0."""
    return F.arrays_overlap(F.split(host_of(url), "[.-]"), F.array(*map(F.lit, UNWANTED))).cast("int")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    found = verdict = F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(kind)).otherwise(verdict)
    return found, verdict


def _split(url: str) -> tuple[str, str, str]:
    scheme, sep, rest = url.partition("://")
    if not sep:
        return "", "", url
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return scheme, rest[:cut].lower(), rest[cut:]


def suffix(host: str) -> str:
    return ".".join(host.rsplit(".", 2)[-2:])


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def features(url: str | None, rate: float) -> list[float]:
    url = url or ""
    scheme, host, tail = _split(url)
    path, _, query = tail.partition("#")[0].partition("?")
    labels = host.split(".") if host else []
    longest = max(labels, key=len, default="")
    params = [p for p in query.split("&") if p]
    return [
        len(url), len(host), len(path), len(query), len(labels), path.count("/"), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host), host.count("-"), sum(c == "-" for c in path),
        entropy(host), entropy(path), len(longest), entropy(longest), len(params), any(p.startswith("utm_") for p in params), scheme == "https", "%" in url, "@" in host, sum(c in "aeiou" for c in longest) / max(1, len(longest)), rate,
    ]


def generated(n: int = 600, seed: int = 3) -> list[tuple[str, int]]:
    """Labelled URLs made by rule: plain hosts, and hosts of hyphenated come-on words."""
    rng = np.random.default_rng(seed)
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "st", "en", "es", "of", "tion", "ing")
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    out = []
    for i in range(n):
        bad = i % 4 == 0
        name = f"{pick(UNWANTED)}-{pick(UNWANTED)}" if bad else "".join(pick(syllables) for _ in range(int(rng.integers(2, 5))))
        sub = pick(("", "", "www.", "m.", "blog."))
        tail = pick(("", "/", ".html", "#top", "?page=2&ref=x", "?utm_source=feed"))
        out.append((f"{pick(('http', 'https'))}://{sub}{name}.example.{pick(('com', 'net', 'org'))}/{pick(('en', 'de', 'fr', 'es'))}/{int(rng.integers(1000))}{tail}", int(bad)))
    return out


class Filter:
    """Trees, trained from labelled URLs and their suffixes' rates; ``rare`` has the rates that are too many for ``rates``."""

    def __init__(self, labelled: list[tuple[str, int]], rates: dict[str, float] | None = None, prior: float = 0.0, rare: DataFrame | None = None, own: list[float] | None = None):
        if rates is None:
            labelled = generated() + labelled
            rates, prior = self.counted(labelled)
        self.rates, self.prior, self.rare = rates, prior, rare
        x = np.array([features(u, r) for (u, _), r in zip(labelled, own or [self.rate(u) for u, _ in labelled], strict=True)], float)
        self.trees = boost.fit(x, np.array([y for _, y in labelled], float), trees=30)

    @staticmethod
    def counted(rows: list[tuple[str, int]]) -> tuple[dict[str, float], float]:
        prior = sum(y for _, y in rows) / len(rows)
        seen: dict[str, list[int]] = {}
        for u, y in rows:
            seen.setdefault(suffix(_split(u or "")[1]), [0, 0])[y] += 1
        return {s: (b + 20 * prior) / (a + b + 20) for s, (a, b) in seen.items()}, prior

    def rate(self, url: str | None) -> float:
        return self.rates.get(suffix(_split(url or "")[1]), self.prior)

    def score(self, urls: list[str | None], rates: list[float] | None = None) -> np.ndarray:
        rates = [self.rate(u) for u in urls] if rates is None else rates
        return _scores(self.trees, urls, rates)


def _scores(trees: boost.Boosted, urls: list[str | None], rates: list[float]) -> np.ndarray:
    return trees.predict(np.array([features(u, r) for u, r in zip(urls, rates, strict=True)], float).reshape(len(urls), -1)) if urls else np.zeros(0)


def fit(pages: DataFrame, url: str = "url", sample: int = SAMPLE) -> Filter:
    """Suffix rates over all of the table's URLs, and trees from at most ``sample`` distinct ones, the first in hash order."""
    spark = pages.sparkSession
    made = spark.createDataFrame(generated(), "u string, y int").withColumn("made", F.lit(True))
    real = pages.select(F.col(url).alias("u")).filter("u is not null").withColumns({"y": label_of(F.col("u")), "made": F.lit(False)})
    stats = Work(spark).save(real.union(made).groupBy(suffix_of(F.col("u")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("y").alias("bad")))
    total, bad = stats.agg(F.sum("n"), F.sum("bad")).first()
    prior = bad / total
    stats = stats.select("suffix", ((F.col("bad") + 20 * prior) / (F.col("n") + 20)).alias("rate"), (F.col("n") * OFTEN >= total).alias("often"))
    rates = {r.suffix: r.rate for r in stats.filter("often").collect()}
    some = real.distinct().orderBy(F.xxhash64("u"), "u").limit(sample).union(made).withColumn("suffix", suffix_of(F.col("u")))
    rows = sorted(F.broadcast(some).join(stats, "suffix").select("made", "u", "y", "rate").collect())
    return Filter([(r.u, r.y) for r in rows], rates, prior, stats.filter("not often").select("suffix", "rate"), [r.rate for r in rows])


def _unused(names: list[str], stem: str) -> str:
    """A column name that the table doesn't have in any case."""
    taken = {n.lower() for n in names}
    while stem in taken:
        stem += "_"
    return stem


def judge(pages: DataFrame, url: str = "url", rules=RULES, model: Filter | None = None) -> DataFrame:
    """Adds ``host, path, rule, score, verdict``."""
    model = model or fit(pages, url)
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    plain, trees, prior = pages.select(*names), model.trees, model.prior
    suffix, rate = _unused(names, "suffix"), _unused(names, "rate")
    often = F.broadcast(pages.sparkSession.createDataFrame(list(model.rates.items()), f"`{suffix}` string, `{rate}` double"))
    rated = plain.withColumn(suffix, suffix_of(F.col(url)))
    # common suffixes stay where they are, so no key of the exchange has many rows
    seldom = rated.join(often, suffix, "left_anti")
    seldom = seldom.withColumn(rate, F.lit(None).cast("double")) if model.rare is None else seldom.join(model.rare.toDF(suffix, rate), suffix, "left")
    rated = rated.join(often, suffix).select(*names, rate).unionByName(seldom.select(*names, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rates = [prior if r is None else r for r in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_scores(trees, b.column(names.index(url)).to_pylist(), rates))], names=[*names, "score"])

    scored = rated.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    scored = scored.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})
