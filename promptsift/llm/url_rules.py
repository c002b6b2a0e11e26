"""URL filters: a rule list, and association rules mined from labelled pages.

A URL's tokens are the labels of its host, the segments of its path and the parts of its
query, without bare numbers. A labelled page (one that ``labels`` has under its id) is a
transaction. Tokens that the same pages have are one item, as no rule tells them apart: a URL
has the item if it has one of them. Items that are confident enough by themselves are rules:
whatever else a URL has, they match it, so they go from the pages' baskets. FP-growth over
what is left of the bad pages' finds the combinations, of any length, that occur often enough;
they are counted among the good pages, and those that are confident enough are rules. A rule
with more items than another that it can't beat is dropped. A URL is matched by an inverted index: every rule stands under its rarest item, a URL
looks up its own items, and the rules it finds there are tested against all of them. Matching
is done once for each distinct URL.

FP-growth lists every frequent subset of a basket before any is counted among good pages.
Where distinct baskets have over ``SUBSETS`` subsets, combinations are therefore made level by
level instead, by joining those that are frequent and no rules yet: what contains a rule is
matched by it and isn't listed. Both ways give verdicts by the rules of all lengths. The work of the
second grows with the number of combinations that are frequent and no rules.

Everything runs on DataFrame expressions and the JVM's FP-growth. What FP-growth brings to
the driver are the frequent items: at most a URL's tokens over the support.

Results for edge cases: a null URL, or one without ``://``, has an empty host and path, no
rule and the verdict allow. Repeated pages are judged each. Without enough labelled pages
there are no mined rules. Null labels count as good; a page with several labels is bad if one
of them is.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsift.llm.common import looked_up, saved

#: Host, path and verdict of the rule list.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Share of the labelled pages that hold a combination, and their least number.
SUPPORT, LEAST = 0.002, 25
CONFIDENCE = 0.6
#: Subsets of all distinct baskets that FP-growth may have to list.
SUBSETS = 1 << 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """After the first ://, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL, each with its part of the URL."""
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    parts = {"h:": F.split(host(url), r"\."), "p:": F.split(F.lower(path(url)), r"[/.]"), "q:": F.split(F.lower(query), "&")}

    def marked(mark: str, found: Column) -> Column:
        return F.transform(F.filter(found, lambda x: ~x.rlike("^[0-9]*$")), lambda x: F.concat(F.lit(mark), x))

    found = [marked(mark, p) for mark, p in parts.items()]
    return F.array_distinct(F.concat(*found))


def listed(pages: DataFrame) -> DataFrame:
    """Adds host, path, rule and its verdict, null where no rule fits."""
    ranked = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    h, p = F.col("host"), F.col("path")
    rule = verdict = F.lit(None).cast("string")
    for name, start, says in reversed(ranked):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    url = F.col("url")
    parsed = pages.withColumns({"host": F.coalesce(host(url), F.lit("")), "path": F.coalesce(path(url), F.lit(""))})
    return parsed.withColumns({"rule": rule, "listed": verdict})


def _keyed(sets: DataFrame, single: DataFrame) -> DataFrame:
    """sets (items and more) with key, their rarest item."""
    rarest = F.min_by("key", F.struct("n", "key")).alias("key")
    keys = sets.select("items", F.explode("items").alias("key")).join(single, "key").groupBy("items").agg(rarest)
    return sets.join(keys, "items")


def _counts(sets: DataFrame, held: DataFrame) -> DataFrame:
    """items, n: how many of held (own, an array of items) have each of sets (items, key)."""
    own = held.select("own", F.explode("own").alias("key"))
    having = own.join(sets.select("items", "key"), "key").filter(F.size(F.array_except("items", "own")) == 0)
    return having.groupBy("items").agg(F.count(F.lit(1)).alias("n"))


def _with_good(sets: DataFrame, good: DataFrame, single: DataFrame) -> DataFrame:
    """sets (items, n_bad) with key and n, the number of all pages that have them."""
    keyed = saved(_keyed(sets, single))
    found = _counts(keyed, good).withColumnRenamed("n", "n_good")
    return keyed.join(found, "items", "left").withColumn("n", F.col("n_bad") + F.coalesce("n_good", F.lit(0))).drop("n_good")


def _by_levels(bad: DataFrame, good: DataFrame, single: DataFrame, least: int) -> DataFrame:
    """Frequent combinations that contain no confident one: items, n_bad, key, n."""
    level = single.select(F.array("key").alias("items"))
    out = None
    while True:
        a, b = level.alias("a"), level.alias("b")
        fits = (F.slice(F.col("a.items"), 1, F.size("a.items") - 1) == F.slice(F.col("b.items"), 1, F.size("b.items") - 1)) & (F.element_at("a.items", -1) < F.element_at("b.items", -1))
        longer = _keyed(a.join(b, fits).select(F.concat("a.items", F.slice("b.items", -1, 1)).alias("items")), single)
        frequent = _counts(longer, bad).filter(F.col("n") >= least).withColumnRenamed("n", "n_bad")
        found = saved(_with_good(frequent, good, single))
        if found.isEmpty():
            return found if out is None else out
        out = found if out is None else out.unionByName(found)
        level = saved(found.filter(F.col("n_bad") < CONFIDENCE * F.col("n")).select("items"))


def combinations(held: DataFrame, single: DataFrame, least: int) -> DataFrame:
    """Of pages' baskets held (bad, own): frequent combinations of two items or more, as items, n_bad, key (their rarest item) and n."""
    bad, good = held.filter("bad"), held.filter("NOT bad")
    subsets = bad.select("own").distinct().agg(F.sum(F.pow(F.lit(2.0), F.size("own")))).first()[0] or 0
    if subsets > SUBSETS:
        return _by_levels(bad, good, single, least)
    n_bad = bad.count()
    model = FPGrowth(itemsCol="own", minSupport=min(1.0, (least - 0.5) / max(1, n_bad))).fit(bad.select("own"))
    several = saved(model.freqItemsets.filter((F.size("items") > 1) & (F.col("freq") >= least)).select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad")))
    return _with_good(several, good, single)


def mined_rules(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules to the bad label (items, key: the rarest of them, confidence, support), and the tokens' items (token, item)."""
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    by_page = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.bool_or(bad).alias("bad"))
    known = pages.select("page_id", tokens(F.coalesce("url", F.lit(""))).alias("tokens")).join(by_page, "page_id")
    baskets = saved(known.select(F.monotonically_increasing_id().alias("page"), "tokens", "bad"))
    n = baskets.count()
    least = max(LEAST, math.ceil(SUPPORT * n - 1e-9))
    flat = baskets.select("page", "bad", F.explode("tokens").alias("token"))
    # of the pages that have a token: their number and two sums that tell sets of pages apart
    same = {"x": F.bit_xor(F.xxhash64("page")), "y": F.bit_xor(F.xxhash64(F.lit(1), "page"))}
    found = flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *(c.alias(k) for k, c in same.items()))
    one = Window.partitionBy("n", "x", "y")
    items = saved(found.filter(F.col("n_bad") >= least).select("token", F.min("token").over(one).alias("item"), "n", "n_bad"))
    confident = F.col("n_bad") >= CONFIDENCE * F.col("n")
    measures = [(F.col("n_bad") / F.col("n")).alias("confidence"), (F.col("n_bad") / n).alias("support")]
    every = items.groupBy(F.col("item").alias("key")).agg(F.max("n").alias("n"), F.max("n_bad").alias("n_bad"))
    alone = every.filter(confident).select(F.array("key").alias("items"), "key", *measures)
    single = saved(every.filter(~confident).select("key", "n"))
    if single.isEmpty():
        return saved(alone), items.select("token", "item")
    open_ = items.join(single.select(F.col("key").alias("item")), "item", "left_semi").select("token", "item")
    held = saved(flat.join(open_, "token").groupBy("page", "bad").agg(F.array_sort(F.collect_set("item")).alias("own")).select("bad", "own"))
    rules = saved(combinations(held, single, least).filter(confident).select("items", "key", *measures))
    # each rule against those on its sub-combinations: rows for every item left out, not all pairs
    less = rules.select("items", "confidence", F.explode("items").alias("out")).select("items", "confidence", F.array_remove("items", F.col("out")).alias("fewer"))
    beaten = less.join(rules.select(F.col("items").alias("fewer"), F.col("confidence").alias("was")), "fewer").filter("was >= confidence").select("items").distinct()
    return rules.join(beaten, "items", "left_anti").unionByName(alone), items.select("token", "item")


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    rules, items = mined_rules(pages, labels)
    seen = listed(pages.select("page_id", "url"))
    urls = seen.filter("rule is null and url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    looked = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(items, "token")
    own = looked.groupBy("url").agg(F.collect_set("item").alias("own"))
    index = rules.select("key", F.col("items").alias("needed"))
    hit = own.select("url", "own", F.explode("own").alias("key")).join(index, "key").filter(F.size(F.array_except("needed", "own")) == 0).select("url").distinct()
    known = hit.withColumn("mined", F.lit("block")).join(urls, "url")
    verdict = F.coalesce("listed", "mined", F.lit("allow")).alias("verdict")
    return looked_up(seen, saved(known), "url", "mined").select("page_id", "host", "path", "rule", verdict)
