"""URL filter: rules first, then the ratio of two character language models.

Both models are smoothed Markov chains of variable order over host and path: every order is mixed
with the next lower one by the share of characters that are new after its context (Witten-Bell).
They learn from the URLs that rules accept and reject; every other URL is judged by its
length-normalised log-likelihood ratio against a threshold calibrated on labelled URLs that the
models have not seen. Everything is DataFrame operations.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barrelbook.session import checkpointed

#: Characters of a gram: the last one and its longest context.
ORDER = 5
#: Probability of a character that no context knows.
FLOOR = 1 / 1024
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Number of the longest rule that fits (of equally long ones the first), or NULL."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    fits = [
        F.when(
            ((host == rules[i].host) | F.endswith(host, F.lit("." + rules[i].host)))
            & F.startswith(path, F.lit(rules[i].path)),
            F.lit(i),
        )
        for i in order
    ]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """A row per character of ``text`` and its end: the character after its context."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("text"), F.lit(END))
    rows = texts.withColumn("__padded", padded)
    places = F.sequence(F.lit(1), F.length("__padded") - (order - 1))
    return rows.withColumn("at", F.explode(places)).withColumn("gram", F.substr("__padded", "at", F.lit(order))).drop(
        "__padded", "at", "text"
    )


def gram_ratios(counts: DataFrame, order: int) -> DataFrame:
    """``(gram, good, bad)`` counts to ``(gram, ratio)``: log of the two smoothed probabilities.

    The counts of shorter grams are sums over the longest ones. ``counts`` has every gram that is
    to be scored, with zeros where a class has not seen it.
    """
    lower = None
    for size in range(1, order + 1):
        own = counts.groupBy(F.right("gram", F.lit(size)).alias("gram")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")
        )
        after = W.partitionBy(F.left("gram", F.lit(size - 1)))
        own = own.select(
            "gram",
            F.right("gram", F.lit(size - 1)).alias("tail"),
            *[
                column
                for name in ("good", "bad")
                for column in (
                    F.col(name),
                    F.sum(name).over(after).alias(f"{name}_sum"),
                    F.sum((F.col(name) > 0).cast("long")).over(after).alias(f"{name}_kinds"),
                )
            ],
        )
        if lower is None:
            own = own.withColumns({"low_good": F.lit(FLOOR), "low_bad": F.lit(FLOOR)})
        else:
            own = own.join(lower, "tail")
        lower = own.select("gram", *[_mixed(name).alias(f"low_{name}") for name in ("good", "bad")])
        if size < order:
            lower = lower.withColumnRenamed("gram", "tail")
    return lower.select("gram", F.log(F.col("low_good") / F.col("low_bad")).alias("ratio"))


def _mixed(name: str) -> Column:
    total, kinds = F.col(f"{name}_sum"), F.col(f"{name}_kinds")
    return F.when(total == 0, F.col(f"low_{name}")).otherwise(
        (F.col(name) + kinds * F.col(f"low_{name}")) / (total + kinds)
    )


def _calibrated(scores: DataFrame) -> float:
    """The point as many deviations below the accepted mean as above the rejected one."""
    seen = {
        r.label: (r.mean, r.spread or 0.0)
        for r in scores.groupBy("label").agg(F.avg("score").alias("mean"), F.stddev("score").alias("spread")).collect()
    }
    if "allow" not in seen or "block" not in seen:
        return 0.0
    (good, good_spread), (bad, bad_spread) = seen["allow"], seen["block"]
    if good_spread + bad_spread == 0:
        return (good + bad) / 2
    return (good * bad_spread + bad * good_spread) / (good_spread + bad_spread)


def judge(pages: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url", order: int = ORDER) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    ``rule`` is the rule that decides, or NULL; then ``score``, the mean log ratio of the accepted
    and the rejected model per character, decides: at least the threshold means allow. A NULL URL
    or one without ``://`` has empty host and path and is judged like any text. Equal URLs are
    scored once and get equal verdicts; repeated rows and NULL ids stay. Labelled URLs with
    ``crc32 % 5 = 0`` calibrate, the others train. Without URLs of both classes the ratio is what
    the one model and the floor give, and the threshold 0. An empty table gives no rows.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    number = rule_for(F.col("host"), F.col("path"), rules)
    named = {i: rule for i, rule in enumerate(rules)}
    own = own.withColumn("number", number)
    own = own.withColumn("rule", _choose(named, lambda r: r.name)).withColumn("label", _choose(named, lambda r: r.verdict))
    text = F.concat("host", "path")
    texts = own.withColumn("text", text).groupBy("text").agg(F.min("label").alias("label"), F.count("*").alias("times"))
    texts = texts.withColumn("unseen", F.crc32(F.col("text").cast("binary")) % 5 == 0)
    learns = ~F.col("unseen")
    counts = (
        _grams(texts, order)
        .groupBy("gram")
        .agg(
            F.sum(F.when(learns & (F.col("label") == "allow"), F.col("times")).otherwise(0)).alias("good"),
            F.sum(F.when(learns & (F.col("label") == "block"), F.col("times")).otherwise(0)).alias("bad"),
        )
    )
    ratios = gram_ratios(checkpointed(counts), order)
    asked = texts.filter(F.col("label").isNull() | F.col("unseen"))
    asked = asked.select(
        F.xxhash64("text").alias("one"), F.xxhash64(F.reverse("text")).alias("two"), "text", "label"
    )
    scored = (
        _grams(asked, order)
        .join(ratios, "gram")
        .groupBy("one", "two", "label")
        .agg(F.avg("ratio").alias("score"))
    )
    scored = checkpointed(scored)
    limit = _calibrated(scored.filter("label IS NOT NULL"))
    judged = scored.filter("label IS NULL").select("one", "two", "score")
    met = own.withColumns({"one": F.xxhash64(text), "two": F.xxhash64(F.reverse(text))}).join(
        judged, ["one", "two"], "left"
    )
    by_model = F.when(F.col("score") >= limit, "allow").otherwise("block")
    return met.select("page_id", "host", "path", "rule", F.coalesce("label", by_model).alias("verdict"), "score")


def _choose(named: dict[int, Rule], pick) -> Column:
    chosen = F.lit(None).cast("string")
    for number, rule in named.items():
        chosen = F.when(F.col("number") == number, F.lit(pick(rule))).otherwise(chosen)
    return chosen
