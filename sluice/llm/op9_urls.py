"""URL filter: rules first, then a ratio of two character Markov models.  DataFrame functions only.

Two variable-order Markov models over characters, one of accepted and one of rejected
URLs, are smoothed by recursive interpolation with the next shorter context (a context
never seen passes its shorter context on unchanged, so the order adapts to the data).
The verdict compares the mean difference of log-likelihoods a character with a threshold
calibrated on URLs that were held out of the counts.

Counts are exact: a table with a row for each distinct gram of all URLs, written once to the
shared folder.  It grows with the distinct grams; shorter grams and contexts are summed from
longer ones and joined to them by equality, level by level, so no key has more rows than the
alphabet.  The characters of the URLs are joined to it by gram.  Scores are summed in steps of
2**-40, so that they do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAD = "\x02"
HOT = 512  # of the most frequent grams are also sent to the tasks, so that no join key holds more than one in HOT characters
UNIT = float(1 << 40)  # steps of a score


def parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and the text after ``://``; all empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as one string) and its verdict, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _padded(rest: Column, order: int) -> Column:
    return F.concat(F.lit(PAD * order), F.lower(rest))


def _spots(order: int) -> Column:
    """Each character with the ``order`` before it; of a text without any, one shorter gram."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - order)), lambda i: F.substring("text", i, F.lit(order + 1)))


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """g, n, a, r: how often each gram of (text, accepted) stands anywhere, in accepted and in rejected URLs; ``accepted`` is null in URLs that do not count."""
    spots = urls.select("accepted", F.explode(_spots(order)).alias("g")).where(F.length("g") > order)
    times = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return spots.groupBy("g").agg(F.count(F.lit(1)).alias("n"), times(F.col("accepted")).alias("a"), times(~F.col("accepted")).alias("r"))


def _model(grams: DataFrame, order: int, weight: float) -> DataFrame:
    """g, n and one: log p(accepted) - log p(rejected) of the last character of each gram, in steps of 1 / UNIT."""
    levels = [grams]
    for j in range(order, 0, -1):
        levels.append(levels[-1].groupBy(F.substring("g", 2, j).alias("g")).agg(*(F.sum(c).alias(c) for c in "nar")))
    shorter = None
    for j, level in enumerate(reversed(levels)):
        context = Window.partitionBy(F.substring("g", 1, j))
        level = level.withColumns({"ca": F.sum("a").over(context), "cr": F.sum("r").over(context)})
        if shorter is None:
            level = level.withColumns({"pa": F.lit(1.0 / 256), "pr": F.lit(1.0 / 256)})
        else:
            level = level.withColumn("end", F.substring("g", 2, j)).join(shorter, "end")
        p = lambda x: (F.col(x) + weight * F.col("p" + x)) / (F.col("c" + x) + weight)
        last = level.select("g", "n", p("a").alias("pa"), p("r").alias("pr"))
        shorter = last.select(F.col("g").alias("end"), "pa", "pr")
    return last.select("g", "n", F.round(F.log(F.col("pa") / F.col("pr")) * UNIT).cast("long").alias("one"))


def _scored(rows: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """``rows`` (with ``text``) plus score: the mean over characters of log p(accepted) - log p(rejected), 0 if empty.

    The first character of a row carries its columns.  Frequent grams are looked up in each
    task and dealt by row, the others are joined by gram.
    """
    keep = [c for c in rows.columns if c != "text"]
    hot = F.broadcast(model.orderBy(F.desc("n"), "g").limit(HOT).select("g", F.col("one").alias("hot")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    spots = rows.select("row", F.struct(*keep).alias("kept"), F.posexplode(_spots(order)).alias("i", "g"))
    spots = spots.select("row", F.when(F.col("i") == 0, F.col("kept")).alias("kept"), "g").join(hot, "g", "left")
    by = F.when(F.col("hot").isNull(), F.col("g")).otherwise(F.concat(F.lit(PAD * (order + 2)), (F.col("row") % 8191).cast("string")))
    spots = spots.withColumn("g", by).join(model.select("g", "one"), "g", "left")
    score = F.sum(F.coalesce("hot", "one", F.lit(0))) / F.count(F.lit(1)) / UNIT
    return spots.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), score.alias("score")).select("kept.*", "score")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",), order: int = 3, weight: float = 2.0, holdout: int = 8) -> DataFrame:
    """One row for each row of ``pages``: the ``keep`` columns, host, path, rule, verdict (allow or block), score.

    ``rules`` are (verdict, "host/path prefix").  URLs that a rule decides are also the
    labelled URLs: one in ``holdout`` (by hash) sets the threshold, the others are counted.
    Null, empty and malformed URLs have host and path '' and score 0.  Without labelled
    URLs of both kinds the threshold is 0.  Repeated rows and equal ids stay separate rows.
    The grams of all URLs are counted when this is called.
    Columns that are not in ``keep`` are not read; those in ``keep`` must not have the new names.
    """
    host, path, rest = parts(F.col(url))
    base = pages.select(*keep, host.alias("host"), path.alias("path"), _padded(rest, order).alias("text"))
    name, verdict = by_rules(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "verdict": verdict})
    labelled = base.where(F.col("verdict").isNotNull() & (F.length("text") > order)).select((F.col("verdict") == "allow").alias("accepted"), "text")
    out = F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(holdout)) == 0
    scratch = Scratch(pages.sparkSession, "urls")
    counted = base.select(F.when(~out, F.col("verdict") == "allow").alias("accepted"), "text")
    model = scratch.keep(_model(scratch.keep(_grams(counted, order), "grams"), order, weight), "model")
    # The threshold: of all steps of 0.02 in the range of the scores, that with the best balanced accuracy on held-out URLs, nearest to 0.
    steps = _scored(labelled.where(out), model, order)
    steps = steps.select("accepted", F.floor(F.col("score") * 50).alias("step"))
    steps = steps.groupBy("step").agg(F.sum(F.col("accepted").cast("int")).alias("a"), F.sum((~F.col("accepted")).cast("int")).alias("r"))
    bins = steps.agg(F.array_sort(F.collect_list(F.struct("step", "a", "r"))).alias("x"), F.sum("a").alias("na"), F.sum("r").alias("nr"))
    gain = lambda b: F.aggregate("x", F.lit(0.0), lambda s, y: s + F.when(y["step"] >= b, y["a"] / F.col("na")).otherwise(y["r"] / F.col("nr")))
    every = F.sequence(F.least(F.lit(0), F.array_min("x")["step"]), F.greatest(F.lit(0), F.array_max("x")["step"]))
    best = F.array_max(F.transform(every, lambda b: F.struct(gain(b).alias("gain"), (-F.abs(b)).alias("near"), b.alias("step"))))
    limit = bins.select(F.when((F.col("na") > 0) & (F.col("nr") > 0), best["step"] / 50.0).otherwise(F.lit(0.0)).alias("limit"))
    scored = _scored(base, model, order)
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= limit.scalar(), "allow").otherwise("block")))
