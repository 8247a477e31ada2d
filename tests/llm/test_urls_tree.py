"""The template tree against a recursive version over plain dictionaries, and its verdicts."""

import random
from collections import Counter, defaultdict

import pytest

from lodestone.llm import urls


def apart(g, m, og, om, prior):
    pooled = (og + urls.WEIGHT * prior) / (om + urls.WEIGHT)
    return m > 0 and 0 < pooled < 1 and abs(g / m - pooled) / (pooled * (1 - pooled) / m) ** 0.5 > urls.SIMILAR


def judged(pages):
    """Verdict of (host, segments, good or None) pages, by walking each host's tree down and up."""
    marks = [g for _, _, g in pages if g is not None]
    prior = sum(marks) / len(marks) if marks else 1.0
    down = {(h, s): list(s) for h, s, _ in pages}
    sums = defaultdict(lambda: [0, 0])
    for h, s, g in pages:
        sums[h, s][0] += g or 0
        sums[h, s][1] += g is not None

    def children(names, level):
        out = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for (h, s), t in names.items():
            if len(t) >= level:
                c = out[h, "/".join(t[: level - 1])][t[level - 1]]
                c[0] += sums[h, s][0]
                c[1] += sums[h, s][1]
        return out

    depth = max((len(s) for _, s, _ in pages), default=0)
    for level in range(1, depth + 1):
        for (h, head), own in children(down, level).items():
            pg, pm = sum(c[0] for c in own.values()), sum(c[1] for c in own.values())
            rare = {n for n, (g, m) in own.items() if m < urls.WEIGHT and not apart(g, m, pg - g, pm - m, prior)}
            if len(rare) > urls.FANOUT:
                for (k, _), t in down.items():
                    if k == h and len(t) >= level and "/".join(t[: level - 1]) == head and t[level - 1] in rare:
                        t[level - 1] = "*"
    up = {k: list(t) for k, t in down.items()}
    for level in range(depth, 0, -1):
        for (h, head), own in children(up, level).items():
            pg, pm = sum(c[0] for c in own.values()), sum(c[1] for c in own.values())
            like = {n for n, (g, m) in own.items() if not apart(g, m, pg - g, pm - m, prior)}
            if len(like) > 1:
                for (k, _), t in up.items():
                    if k == h and len(t) >= level and "/".join(t[: level - 1]) == head and t[level - 1] in like:
                        t[level - 1] = "~"
    branch, host = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, s), t in up.items():
        for to in (branch[h, tuple(t)], host[h]):
            to[0] += sums[h, s][0]
            to[1] += sums[h, s][1]
    out = {}
    for (h, s), t in up.items():
        of_host = (host[h][0] + urls.WEIGHT * prior) / (host[h][1] + urls.WEIGHT)
        g, m = branch[h, tuple(t)]
        out[h, s] = ("/" + "/".join(t), (g + urls.WEIGHT * of_host) / (m + urls.WEIGHT), prior)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    pages = []
    for i in range(1500):
        host = f"h{rng.choice((0, 0, 0, 1, 2))}.org"
        segments = [f"a{rng.randrange(3)}"] + [rng.choice("bcdef") + rng.choice("xyz" * 9 + "klmnopqrstuv") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 5))]
        chance = 0.9 if "by" not in segments and segments[0] != "a2" else 0.2
        good = None if rng.random() < 0.3 else int(rng.random() < chance)
        pages.append((host, tuple(segments) if rng.random() < 0.98 else (), good))
    rows = [(i, f"http://{h}/{'/'.join(s)}", g) for i, (h, s, g) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, good int")
    out = urls.judge_urls(df, df.select("page_id", F_bool("good").alias("good")))
    want, seen = judged(pages), Counter()
    for r in out.collect():
        h, s, _ = pages[r.page_id]
        branch, purity, prior = want[h, s]
        assert r.branch == branch and abs(r.purity - purity) < 1e-9
        assert r.verdict == ("block" if purity < urls.BELOW * prior else "allow")
        seen[r.verdict] += 1
    assert min(seen["block"], seen["allow"]) > 50


def F_bool(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("boolean")


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "http://a.org/x", "c"), (1, "http://a.org/x", "c"), (None, "http://a.org/x", None), (2, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, HOST string")
    marks = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None)], "page_id long, good boolean")
    assert sorted((r.page_id or 0, r.host, r.path) for r in urls.judge_urls(df, marks).collect()) == [(0, "a.org", "/x"), (1, "a.org", "/x"), (1, "a.org", "/x"), (2, "", "")]
