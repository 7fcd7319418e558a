"""URL filter: host and path rules, and a ratio of character language models for the rest.

Rules decide what they fit; the URLs that they decide are the accepted and the rejected
training sets. A smoothed variable-order Markov model of characters is counted for either
(orders 0 to ORDER, each backing off to the next lower one where its context is rare).
A URL's score is the difference of the log likelihoods divided by its length. The
threshold is calibrated on a quarter of the labelled URLs (by a hash of the URL) under
models that did not count them: the cut with the highest balanced accuracy. The models
that give the scores count all labelled URLs.

Counts are exact and grow with the corpus. Every distinct URL gives its windows of
ORDER + 1 characters; one aggregation counts them by label, and the lower orders and the
contexts are aggregations of those distinct windows. The probabilities of each order are
joins of distinct windows with their contexts and with the next lower order. Windows that
make up a large share of all (at most HOT of them, by arithmetic) are broadcast to the
URLs, the others meet them in a shuffle, so that a host's name is no hot key. All of it is
DataFrame functions.

Defined cases: null URLs, and URLs without "://", have an empty host and path and no
rule; a null or empty URL's score is 0. Repeated rows are judged alike, and count as often
as they occur. An empty table gives an empty result. Without labelled rows of both kinds
everything that no rule decides is allowed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
ORDER = 5
#: Weight of the next lower order in a context's counts, and the share of a character below order 0.
BACK_OFF, BASE = 2.0, 1 / 256
#: Stands before a URL's first character.
PAD = "\u0002"
#: Windows of which each is one in HOT of all are broadcast: HOT of them at most.
HOT = 2000
BINS = 400
SPAN = 8.0
#: Counts by label (1 allow, 0 block) of all labelled rows, and of those not laid aside.
COUNTS = ("all1", "all0", "fit1", "fit0")


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def rule_for(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) for the columns host and path; the longest rule that fits wins."""
    name = verdict = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.startswith(F.col("path"), F.lit(path))
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def windows(url: str, order: int = ORDER) -> Column:
    """Each character of a URL with the order characters before it, as strings."""
    chars = F.split(F.concat(F.lit(PAD * order), F.col(url)), "")
    of = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - order - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(order + 1)]))
    return F.when(F.length(url) > 0, F.transform(F.array(chars), of)[0]).otherwise(F.array().cast("array<string>"))


def distinct_urls(pages: DataFrame, url_col: str, label_col: str) -> DataFrame:
    """uid, url, n (rows), y (label: 1, 0 or null) and aside, of each URL that is not null."""
    u = pages.filter(F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("n"), F.max(label_col).alias("y"))
    return materialise(u.withColumns({"uid": F.monotonically_increasing_id(), "aside": F.pmod(F.xxhash64("url"), F.lit(4)) == 0}))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTS]


def count(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """w (a window), times (of all URLs) and COUNTS, for every distinct window."""
    weight = {"all1": F.col("y") == 1, "all0": F.col("y") == 0, "fit1": (F.col("y") == 1) & ~F.col("aside"), "fit0": (F.col("y") == 0) & ~F.col("aside")}
    rows = urls.select(F.explode(windows("url", order)).alias("w"), *[F.when(c, F.col("n")).otherwise(F.lit(0)).cast("double").alias(k) for k, c in weight.items()])
    return materialise(rows.groupBy("w").agg(F.count("*").alias("times"), *_sums()))


def ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """w, times, and the differences of the log probabilities of its last character: score (all), trial (not laid aside)."""
    levels = [counts]
    for _ in range(order):  # windows of one character less: aggregations of distinct windows
        levels.insert(0, levels[0].groupBy(F.expr("substring(w, 2)").alias("w")).agg(*_sums()))
    total = levels[0].agg(*_sums()).first()
    lower = levels[0].select("w", *[((F.col(c) + BACK_OFF * BASE) / F.lit((total[c] or 0.0) + BACK_OFF)).alias(f"p_{c}") for c in COUNTS])
    for k, level in enumerate(levels[1:], 1):
        level = level.withColumns({"context": F.expr(f"left(w, {k})"), "suffix": F.expr("substring(w, 2)")})
        contexts = level.groupBy("context").agg(*[F.sum(c).alias(f"c_{c}") for c in COUNTS])
        met = level.join(contexts, "context").join(lower.withColumnRenamed("w", "suffix"), "suffix")
        times = ["times"] if k == order else []
        lower = met.select("w", *times, *[((F.col(c) + BACK_OFF * F.col(f"p_{c}")) / (F.col(f"c_{c}") + BACK_OFF)).alias(f"p_{c}") for c in COUNTS])
    return materialise(lower.select("w", "times", (F.ln("p_all1") - F.ln("p_all0")).alias("score"), (F.ln("p_fit1") - F.ln("p_fit0")).alias("trial")))


def with_score(urls: DataFrame, model: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """uid, score and trial of every URL that has a character: means over its characters."""
    most = model.agg(F.sum("times")).first()[0] or 0
    common = F.broadcast(model.filter(F.col("times") * hot >= most).select("w", F.col("score").alias("hs"), F.col("trial").alias("ht")))
    rows = urls.select("uid", F.explode(windows("url", order)).alias("w")).join(common, "w", "left")
    near = rows.filter("hs IS NOT NULL").select("uid", F.col("hs").alias("score"), F.col("ht").alias("trial"))
    far = rows.filter("hs IS NULL").select("uid", "w").join(model.select("w", "score", "trial"), "w").select("uid", "score", "trial")
    return near.unionByName(far).groupBy("uid").agg(F.avg("score").alias("score"), F.avg("trial").alias("trial"))


def calibrate(scored: DataFrame) -> float:
    """The cut with the highest balanced accuracy, from a histogram of BINS bins a label (columns y, n, score)."""
    b = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN)))))
    hist = np.zeros((2, BINS))
    for r in scored.groupBy("y", b.alias("b")).agg(F.sum("n").alias("n")).collect():
        hist[r["y"], int(r["b"])] = r["n"]
    if not hist.sum(1).all():
        return float("-inf")
    below = np.concatenate([np.zeros((2, 1)), hist.cumsum(1)], 1) / hist.sum(1, keepdims=True)
    gain = below[0] + 1 - below[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best.mean() * (2 * SPAN / BINS) - SPAN)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every page with host, path, rule, verdict and score (1 labels allow, 0 block)."""
    name, says = rule_for(rules)
    p = with_host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")))
    p = p.withColumns({"rule": name, "ruled": says})
    urls = distinct_urls(p.withColumn("label", F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0)), "url", "label")
    scored = materialise(urls.join(with_score(urls, ratios(count(urls))), "uid").select("url", "y", "n", "aside", "score", "trial"))
    cut = calibrate(scored.filter("aside AND y IS NOT NULL").select("y", "n", F.col("trial").alias("score")))
    out = p.join(scored.select("url", "score"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
