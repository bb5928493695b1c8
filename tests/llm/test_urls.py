from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from barrelbook.llm import urls
from barrelbook.llm.urls import Rule

RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


class Model:
    """Witten-Bell over all orders, one character at a time."""

    def __init__(self, texts, order=5):
        self.order, self.after = order, defaultdict(Counter)
        for text in texts:
            for at in self.places(text):
                for size in range(order):
                    self.after[at[order - 1 - size : order - 1]][at[-1]] += 1

    def places(self, text):
        padded = urls.START * (self.order - 1) + text + urls.END
        return [padded[i : i + self.order] for i in range(len(padded) - self.order + 1)]

    def chance(self, context, char):
        low = urls.FLOOR if not context else self.chance(context[1:], char)
        if context == "":
            low = urls.FLOOR
        seen = self.after.get(context)
        if not seen:
            return low
        return (seen[char] + len(seen) * low) / (sum(seen.values()) + len(seen))

    def mean(self, text):
        found = [math.log(self.chance(g[:-1], g[-1])) for g in self.places(text)]
        return sum(found) / len(found)


def brute(rows):
    joined = [(i, *parts(u)) for i, u in rows]
    labels = {h + p: rule_of(h, p) for _, h, p in joined}
    unseen = lambda t: zlib.crc32(t.encode()) % 5 == 0
    learn = lambda v: Model([h + p for _, h, p in joined if (r := rule_of(h, p)) and r.verdict == v and not unseen(h + p)])
    good, bad = learn("allow"), learn("block")
    score = lambda t: good.mean(t) - bad.mean(t)
    seen = {v: [score(t) for t, r in labels.items() if r and r.verdict == v and unseen(t)] for v in ("allow", "block")}
    limit = 0.0
    if all(seen.values()):
        mean = {v: sum(x) / len(x) for v, x in seen.items()}
        spread = {v: math.sqrt(sum((s - mean[v]) ** 2 for s in x) / (len(x) - 1)) if len(x) > 1 else 0.0 for v, x in seen.items()}
        limit = (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
    out = []
    for i, h, p in joined:
        rule = rule_of(h, p)
        if rule:
            out.append((i, h, p, rule.name, rule.verdict, None))
        else:
            s = score(h + p)
            out.append((i, h, p, None, "allow" if s >= limit else "block", s))
    return out


def check(spark, rows, **extra):
    frame = spark.createDataFrame([(i, u) for i, u in rows], "page_id long, url string").repartition(3)
    frame = frame.withColumns({n: F.lit(v) for n, v in extra.items()})
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(map(tuple, urls.judge(frame, RULES).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert (g[5] is None) == (w[5] is None) and (g[5] is None or abs(g[5] - w[5]) < 1e-9)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "m.other.net", "other.org", "EXAMPLE.com", "notexample.com", "com", "xcom"]
    rows = [
        (i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['/en/', '/es/', '/fr/', '/', ''])}{rng.randrange(40)}{rng.choice(['', '?q=/en/', '#x', '/ü'])}")
        for i in range(150)
    ]
    rows += [(300, None), (301, ""), (302, "no scheme"), (303, "://"), (304, "a://b://c"), (305, "x://h\n/p\nq"), (306, "s://İ.com/")]
    rows += [(5, rows[5][1]), (None, "http://z.org/x"), (307, "http://long.org/" + "ab" * 3_000)]
    check(spark, rows, host="x", path="y", rule=1, score="z", gram="g", text="t")


def test_one_class_and_empty_table(spark):
    check(spark, [(1, "http://a.com/x"), (2, "http://a.org/x")])
    check(spark, [(1, None)])
    check(spark, [])


def test_no_python_in_the_plan(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = urls.judge(frame, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
