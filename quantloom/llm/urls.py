r"""URL filters by character language models.

Host and path rules judge a URL first: the longest rule whose host is the URL's or one
above it and whose path begins the URL's. The URLs that rules allow and those that they
block train two smoothed variable-order Markov models over code points. A context of up
to ``order`` code points gives p_k(c) = (n(context, c) + mass * p_(k-1)(c)) / (n(context)
+ mass), from a uniform p_0 down to the longest context seen. URLs that no rule fits are
judged by the difference of the two log-likelihoods divided by the length: below the
threshold they are blocked. The threshold is calibrated on labelled URLs held out of the
training (a quarter, by the first hex digit of the URL's MD5): the one that parts the two
verdicts best.

Built-in functions only. Each distinct gram is scored once, and the URLs' grams are
counted per URL before the join; the score table is broadcast only after its rows (of
bounded size) have been counted.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule
and is judged by the method; an empty URL scores 0; if rules label no URL as blocked (or
none as allowed), all URLs without a rule are allowed. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, lower_ascii

#: Grams to broadcast at most, each a string of five code points (20 bytes at most) and a
#: double: under 10 MB. More are joined by a shuffle.
BROADCAST_GRAMS = 100_000
#: URLs whose MD5 begins with a digit below this one are held out for calibration.
HELD_BELOW = "4"


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_grams(urls: DataFrame, url: Column, order: int) -> DataFrame:
    """``urls`` with a row per position: ``g``, the code point before which stand up to ``order`` others.

    Texts begin with ``order`` marks, so that every gram has ``order`` + 1 code points.
    """
    padded = F.concat(F.lit("\x02" * order), F.coalesce(url, F.lit("")))
    grams = let(
        padded,
        lambda p: F.when(F.length(p) <= order, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(p) - order), lambda i: F.substr(p, i, F.lit(order + 1)))
        ),
    )
    return urls.withColumn("g", F.explode(grams))


def gram_scores(grams: DataFrame, mass: float = 2.0, alphabet: int = 256, order: int = 4) -> DataFrame:
    """From rows ``g, n_good, n_bad`` (distinct grams): ``g`` and ``score``, the log-ratio of the two models.

    Level k holds the distinct grams of k + 1 code points, summed from level k + 1; its
    probabilities follow from its contexts' counts and from level k - 1. So only the
    longest grams are joined at their full number, by keys of ``order`` code points; the
    short, frequent contexts are rows of small tables.
    """
    levels = [grams.select("g", "n_good", "n_bad")]
    for _ in range(order):
        short = levels[0].select(F.expr("substr(g, 2)").alias("g"), "n_good", "n_bad")
        levels.insert(0, cut(short.groupBy("g").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"))))
    lower = None
    for level in levels:
        here = level.withColumn("c", F.expr("substr(g, 1, length(g) - 1)"))
        contexts = here.groupBy("c").agg(F.sum("n_good").alias("c_good"), F.sum("n_bad").alias("c_bad"))
        here = here.join(contexts, "c")
        if lower is None:
            here = here.withColumns({"q_good": F.lit(1.0 / alphabet), "q_bad": F.lit(1.0 / alphabet)})
        else:
            shorter = lower.select(F.col("g").alias("s"), F.col("p_good").alias("q_good"), F.col("p_bad").alias("q_bad"))
            here = here.withColumn("s", F.expr("substr(g, 2)")).join(shorter, "s")
        p = lambda side: (F.col(f"n_{side}") + mass * F.col(f"q_{side}")) / (F.col(f"c_{side}") + mass)
        lower = here.select("g", p("good").alias("p_good"), p("bad").alias("p_bad"))
    return lower.select("g", (F.log("p_good") - F.log("p_bad")).alias("score"))


def calibrated(scored: DataFrame) -> float | None:
    """The threshold that parts the held-out URLs of both verdicts best.

    Scores are counted by hundredths. The cut has the largest sum of the share of allowed
    URLs at or above it and of blocked URLs below it (the lowest of equal ones); the
    threshold is in the middle of the empty range below the cut.
    Without held-out URLs of both verdicts all labelled URLs are taken; None without any
    of one verdict. The histogram that is ordered in one task has a row per hundredth.
    """
    bins = scored.where("n_good + n_bad > 0").groupBy(F.floor(F.col("score") * 100).alias("k"), "held").agg(
        F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad")
    )
    totals = {r["held"]: (r["good"], r["bad"]) for r in bins.groupBy("held").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()}
    if min(totals.get(True, (0, 0))) == 0:
        bins = bins.groupBy("k").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        good, bad = (sum(x[k] for x in totals.values()) for k in (0, 1))
    else:
        bins, (good, bad) = bins.where("held"), totals[True]
    if not good or not bad:
        return None
    below = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = bins.select("k", F.coalesce(F.lag("k").over(Window.orderBy("k")) + 1, "k").alias("low"), *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("good", "bad")])
    gain = F.col("bad") * F.lit(good) - F.col("good") * F.lit(bad)
    best = at.orderBy(gain.desc(), "k").first()
    return (best["low"] + best["k"]) / 200


def url_filter(
    pages: DataFrame, rules: dict[str, str], url: str = "url", key: str = "page_id", order: int = 4, mass: float = 2.0
) -> DataFrame:
    """``key`` and ``url`` with host, path, rule, score and verdict; one row per input row."""
    parts = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select(
        "_key", "_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    urls = parts.select(F.coalesce("_url", F.lit("")).alias("u"), said.alias("said")).groupBy("u").agg(
        F.count(F.when(F.col("said") == "allow", 1)).alias("n_good"), F.count(F.when(F.col("said") == "block", 1)).alias("n_bad")
    )
    # distinct URLs take few bytes but many grams: dealt out by number, not by size
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = cut(urls.withColumn("held", F.substr(F.md5("u"), F.lit(1), F.lit(1)) < HELD_BELOW).repartition(spread, "u"))
    flat = url_grams(urls, F.col("u"), order)
    learnt = lambda n: F.sum(F.when(F.col("held"), 0).otherwise(F.col(n))).alias(n)
    grams = cut(flat.groupBy("g").agg(learnt("n_good"), learnt("n_bad")))
    scores = cut(gram_scores(grams, mass, order=order))
    few = scores.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    each = flat.groupBy("u", "n_good", "n_bad", "held", "g").agg(F.count(F.lit(1)).alias("n"))
    scored = cut(
        each.join(F.broadcast(scores) if few else scores, "g")
        .groupBy("u", "n_good", "n_bad", "held")
        .agg(F.round(F.sum(F.col("n") * F.col("score")) / F.sum("n"), 6).alias("score"))
    )
    limit = calibrated(scored)
    by_method = F.lit("allow") if limit is None else F.when(F.coalesce(F.col("score"), F.lit(0.0)) < limit, F.lit("block")).otherwise(F.lit("allow"))
    return (
        parts.withColumn("said", said)
        .withColumn("u", F.coalesce("_url", F.lit("")))
        .join(scored.select("u", "score"), "u", "left")
        .select(
            F.col("_key").alias(key),
            F.col("_url").alias(url),
            "host",
            "path",
            "rule",
            F.coalesce("score", F.lit(0.0)).alias("score"),
            F.coalesce("said", by_method).alias("verdict"),
        )
    )
