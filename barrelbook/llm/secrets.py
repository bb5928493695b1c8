"""Secret scan: fixed rules, and a character language model that tells random strings from names.

Two Markov chains over characters are trained on labelled strings: random ones (what the rules find in
the corpus, and generated strings over the usual alphabets) and ordinary ones (other strings of the
corpus that are put together like names and numbers); each different string counts once. The weight of a character after
another is the logarithm of the ratio of its two smoothed probabilities, in thousandths; a string whose
weights reach ``MARGIN`` is taken for a secret. Everything is DataFrame functions.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, pattern, group of which the characters count, least number of them, and words of which every
#: match holds one in lower case. Where the group is all of the match and runs to the end of its
#: characters, the pattern itself asks for the least number.
RULES = (
    (
        "assign",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
        ("passw", "secret", "token", "api_key", "apikey"),
    ),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16, ("akia",)),
    ("hex", r"[0-9a-f]{32,}", 0, 32, ()),
)
#: Kind of the spans that the model adds.
MODEL_KIND = "random"
#: Strings that the model judges, and those that it learns to be ordinary.
JUDGED, LEARNED = "[A-Za-z0-9+/_-]{16,}={0,2}", "[A-Za-z0-9+/_-]{8,}={0,2}"
#: What makes a string ordinary: names with short numbers, and numbers, put together by signs.
ORDINARY = "^([A-Za-z]+[0-9]{0,4}|[0-9]+)([+/_=-]+([A-Za-z]+[0-9]{0,4}|[0-9]+))*[+/_=-]*$"
#: Characters of the alphabet of strings: letters, digits, ``+/_-=``.
SYMBOLS = 67
#: Sum of weights from which a string is taken for a secret, in thousandths of a nat.
MARGIN = 12_000
#: Generated random strings of each alphabet.
GENERATED = 4096
#: Matches whose positions are added up at a time.
RUN = 512
START = "\x02"
_CODES = 128
_KEPT = "array<struct<start:bigint,end:bigint,value:string>>"
_TEXT, _LOWER, _REST, _FOUND, _BETWEEN, _KINDS = (f"__secrets_{x}" for x in ("text", "lower", "rest", "found", "between", "spans"))


def _with_pieces(rows: DataFrame, text: str, pattern: str, may: Column | None = None) -> DataFrame:
    """The matches of a pattern, and what stands before, between and after them; NULL without a match.

    ``may`` is false where there is none for certain.
    """
    has = F.rlike(text, F.lit(pattern))
    has = has if may is None else may & has
    return rows.withColumns(
        {
            _FOUND: F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            _BETWEEN: F.when(has, F.split(text, pattern, -1)),
        }
    )


def _spans(keep, value) -> Column:
    """``start, end, value`` of the kept matches, in code points, end exclusive.

    Positions are running sums over runs of matches, then over the runs, so that a text with very
    many matches takes time in proportion to them.
    """
    met = F.zip_with(
        F.slice(_BETWEEN, F.lit(1), F.size(_FOUND)),
        _FOUND,
        lambda gap, match: F.struct(
            F.length(gap).cast("bigint").alias("gap"), F.length(match).cast("bigint").alias("size"), match.alias("match")
        ),
    )

    def add(acc, x):
        start = acc.at + x.gap
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"), value(x.match).alias("value"))
        kept = F.when(keep(x.match), F.concat(acc.kept, F.array(span))).otherwise(acc.kept)
        return F.struct(end.alias("at"), kept.alias("kept"))

    def within(run):
        return F.aggregate(run, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_KEPT).alias("kept")), add)

    numbers = F.sequence(F.lit(0), F.floor((F.size(_FOUND) - 1) / RUN).cast("int"))
    runs = F.transform(numbers, lambda i: within(F.slice(met, i * RUN + 1, F.lit(RUN))))

    def follow(acc, run):
        moved = F.transform(
            run.kept,
            lambda s: F.struct((s.start + acc.at).alias("start"), (s.end + acc.at).alias("end"), s.value.alias("value")),
        )
        return F.struct((acc.at + run.at).alias("at"), F.concat(acc.kept, F.array(moved)).alias("kept"))

    nothing = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_KEPT}>").alias("kept"))
    return F.coalesce(F.flatten(F.aggregate(runs, nothing, follow, lambda acc: acc.kept)), F.array().cast(_KEPT))


def _value(rule):
    _, pattern, group, _, _ = rule
    return (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)


def _blanked(rule) -> Column:
    """The pieces put together again, every kept match as blanks, so that all positions stay."""
    value, least = _value(rule), rule[3]
    blank = F.transform(_FOUND, lambda m: F.when(F.length(value(m)) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    parts = F.zip_with(_BETWEEN, F.concat(blank, F.array(F.lit(""))), lambda gap, m: F.concat(gap, m))
    return F.coalesce(F.array_join(parts, ""), F.col(_REST))


def _with_rules(rows: DataFrame, text: str) -> DataFrame:
    """The kept spans of every rule, leftmost and without overlap, and the text with all of them as blanks.

    Each step is a projection of its own, as its columns are used more than once by the next.
    """
    own = rows.withColumn(_TEXT, F.coalesce(F.col(text), F.lit("")))
    own = own.withColumns({_REST: F.col(_TEXT), _LOWER: F.lower(_TEXT)})
    for number, rule in enumerate(RULES):
        value, least, words = _value(rule), rule[3], rule[4]
        may = functools.reduce(lambda a, b: a | b, [F.contains(_LOWER, F.lit(w)) for w in words]) if words else None
        own = _with_pieces(own, _TEXT, rule[1], may)
        own = own.withColumn(f"{_KINDS}{number}", _spans(lambda m: F.length(value(m)) >= least, value))  # noqa: B023
        if number:  # a match in what is left lies within one in the text
            own = _with_pieces(own, _REST, rule[1], F.col(_FOUND).isNotNull())
        own = own.withColumn(_REST, _blanked(rule))
    return own.drop(_FOUND, _BETWEEN, _LOWER)


def generated(spark: SparkSession, count: int = GENERATED) -> DataFrame:
    """``string, label``: random strings of 40 characters, in hexadecimal, capitals and letters with digits."""

    def hashed(suffix: str) -> Column:
        return F.sha2(F.concat(F.col("id").cast("string"), F.lit(suffix)), 256)

    digest = hashed("")
    more = F.base64(F.unhex(F.concat(hashed(":a"), hashed(":b"))))
    mixed = F.translate(more, "+/=", "")
    forms = F.array(F.left(digest, F.lit(40)), F.left(F.upper(mixed), F.lit(40)), F.left(mixed, F.lit(40)), F.left(more, F.lit(40)))
    return spark.range(count).select(F.explode(forms).alias("string"), F.lit("random").alias("label"))


def pairs(string: Column) -> Column:
    """Every character with the one before it; ``START`` stands before the first."""
    return F.regexp_extract_all(F.concat(F.lit(START), string), F.lit("(?s)(?=(..))"), F.lit(1))


def _step(pair: Column) -> Column:
    return F.ascii(pair) * _CODES + F.ascii(F.right(pair, F.lit(1)))


def train(samples: DataFrame) -> list[int]:
    """Weights by step, from ``string, label`` with the labels ``random`` and ``ordinary``.

    Each different string of a label counts once. A chain's probability of a character after another
    leans on that of the character anywhere, as if it had been seen ``SYMBOLS`` times more in that
    share. The counts of steps are summed in the tasks; at most one row per step of two characters
    reaches the driver. Without samples all weights are 0.
    """
    counted = samples.distinct().select("label", F.explode(pairs(F.col("string"))).alias("pair"))
    rows = counted.groupBy("pair").agg(
        *[F.count(F.when(F.col("label") == label, 1)).alias(label) for label in ("random", "ordinary")]
    )
    rows = rows.select(F.ascii("pair").alias("before"), F.ascii(F.right("pair", F.lit(1))).alias("after"), "random", "ordinary")
    found = rows.collect()
    chains = [_chain([(r.before, r.after, r[label]) for r in found]) for label in ("random", "ordinary")]
    steps = ((before, after) for before in range(_CODES) for after in range(_CODES))
    return [math.floor(1000 * math.log(chains[0](*step) / chains[1](*step))) for step in steps]


def _chain(counts: list[tuple[int, int, int]]):
    """The smoothed probability of a character after another."""
    step, after_any, total = Counter(), Counter(), Counter()
    for before, after, n in counts:
        step[before, after] += n
        total[before] += n
        after_any[after] += n
    every = total.total()
    return lambda before, after: (
        step[before, after] + SYMBOLS * ((after_any[after] + 1) / (every + SYMBOLS))
    ) / (total[before] + SYMBOLS)


def randomness(string: Column, weights: list[int]) -> Column:
    """Sum of the weights of a string's steps."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    return F.aggregate(pairs(string), F.lit(0).cast("bigint"), lambda acc, pair: acc + F.get(table, _step(pair)))


def samples(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Labelled strings of the corpus: what the rules find is random, and ordinary what else is put together like names.

    Other strings have no label, so that a secret that no rule finds doesn't teach the model that it is ordinary.
    """
    ruled = _with_rules(docs.select(text), text)
    ordinary = F.filter(F.regexp_extract_all(_REST, F.lit(LEARNED), F.lit(0)), lambda s: F.rlike(s, F.lit(ORDINARY)))

    def labelled(strings: Column, label: str) -> Column:
        return F.transform(strings, lambda s: F.struct(s.alias("string"), F.lit(label).alias("label")))

    found = [F.transform(f"{_KINDS}{number}", lambda s: s.value) for number in range(len(RULES))]
    both = F.concat(labelled(F.flatten(F.array(*found)), "random"), labelled(ordinary, "ordinary"))
    return ruled.select(F.explode(both).alias("sample")).select("sample.string", "sample.label")


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, text: str = "text", margin: int = MARGIN) -> DataFrame:
    """The rows with ``secrets``: ``start, number, end, kind, value`` of every span, in order.

    Spans go by start, then in the order of the rules, the model's last; positions are code points,
    the end is exclusive. ``labelled`` (``string, label``) trains the model; by default the samples of
    the corpus and the generated strings. The model judges strings outside the spans of the rules.
    A NULL text counts as empty and has no span; rows that repeat stay; the model learns each string
    once, however often it stands in the corpus. Other columns stay; one named ``secrets`` is replaced,
    as are names that begin with ``__secrets_``. An empty table gives no rows.
    """
    if labelled is None:
        labelled = samples(docs, text=text).unionByName(generated(docs.sparkSession))
    weights = train(labelled)
    ruled = _with_pieces(_with_rules(docs, text), _REST, JUDGED)
    ruled = ruled.withColumn(f"{_KINDS}{len(RULES)}", _spans(lambda m: randomness(m, weights) >= margin, lambda m: m))

    def tagged(number: int, kind: str) -> Column:
        return F.transform(
            f"{_KINDS}{number}",
            lambda s: F.struct(
                s.start.alias("start"), F.lit(number).alias("number"), s.end.alias("end"), F.lit(kind).alias("kind"), s.value.alias("value")
            ),
        )

    kinds = [*[rule[0] for rule in RULES], MODEL_KIND]
    all_spans = F.concat(*[tagged(number, kind) for number, kind in enumerate(kinds)])
    kept = [c for c in docs.columns if c != "secrets" and not c.startswith("__secrets_")]
    return ruled.select(*kept, F.array_sort(all_spans).alias("secrets"))


def names(secrets: Column, *, rules_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    if rules_only:
        secrets = F.filter(secrets, lambda s: s.number < len(RULES))
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, spans by rule, a hash of the rules' spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(rule[0]) for rule in RULES]
    return found.select(
        "doc_id", *counts, F.sha2(names(F.col("secrets"), rules_only=True), 256).alias("base_sha256"), names(F.col("secrets")).alias("spans")
    )
