"""URL filter by host rules and, beyond these, by a path-template tree; DataFrame functions only.

Paths become templates: a segment that varies (numbers, hexadecimal names, or in a node with very many children those
without enough labels that do not differ from the others) turns into a wildcard, from the top and host by host. Branches
whose labelled purity does not differ significantly from their siblings' are merged, at all levels. A branch is rejected when
its purity, smoothed towards its host's and all hosts', falls below a part of that of all labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

#: (host, path, verdict): the rule holds for the host and its subdomains where the path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rare children of a node that stay apart, weight of the smoothing in labels, deviations that count as significant,
#: and the part of the share of all good labels below which a branch is rejected.
FANOUT, WEIGHT, SIMILAR, BELOW = 32, 10.0, 1.96, 0.85
#: Rounds that wildcards may take; each needs another node with more than FANOUT children on one path.
ROUNDS = 10_000
#: Rows of the verdict table that are broadcast at most (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    raw = F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def shape_of(path: Column) -> Column:
    """Segments of the path, those that vary by their look replaced by wildcards."""
    def general(s: Column) -> Column:
        ext = F.regexp_extract(s, r"(\.[a-z]{1,5})$", 1)
        return F.when(s.rlike(r"^[0-9]+(\.[a-z]{1,5})?$"), F.concat(F.lit("{n}"), ext)).when(s.rlike(r"^(?=.*[0-9])[0-9a-f-]{8,}(\.[a-z]{1,5})?$"), F.concat(F.lit("{x}"), ext)).otherwise(s)

    return F.transform(F.array_remove(F.split(path, "/"), ""), general)


def _apart(g: Column, m: Column, og: Column, om: Column, prior: float) -> Column:
    """Whether the purity of g good of m labels differs significantly from that of the siblings, og of om, without it."""
    pooled = (og + WEIGHT * prior) / (om + WEIGHT)
    z = F.abs(g / m - pooled) / F.sqrt(pooled * (1 - pooled) / m)
    return F.coalesce((m > 0) & (pooled > 0) & (pooled < 1) & (z > SIMILAR), F.lit(False))


def _places(tree: DataFrame) -> DataFrame:
    """(id, host, level, head, child, good, labelled): every shape at each of its levels; head is a digest of the template above.

    A row a segment, with digests in place of paths, so that a path of very many segments costs its length, and no level a pass of its own.
    """
    digests = F.aggregate("template", F.array(F.md5("host")), lambda d, s: F.concat(d, F.array(F.md5(F.concat(F.element_at(d, -1), F.lit("/"), s)))))
    each = tree.select("id", "host", "good", "labelled", digests.alias("heads"), "template").select("id", "host", "good", "labelled", F.posexplode(F.arrays_zip("heads", "template")).alias("at", "x"))
    return each.where(F.col("x.template").isNotNull()).select("id", "host", (F.col("at") + 1).alias("level"), F.col("x.heads").alias("head"), F.col("x.template").alias("child"), "good", "labelled")


def _children(places: DataFrame, prior: float) -> DataFrame:
    """(level, head, child, labels, apart): the children of all nodes, with sums over their subtrees.

    Sums are combined before each shuffle; no node's children are gathered into a window.
    """
    child = places.groupBy("level", "head", "child").agg(F.sum("good").alias("g"), F.sum("labelled").alias("m"))
    node = child.groupBy("level", "head").agg(F.sum("g").alias("pg"), F.sum("m").alias("pm"))
    apart = _apart(F.col("g"), F.col("m"), F.col("pg") - F.col("g"), F.col("pm") - F.col("m"), prior)
    return child.join(node, ["level", "head"]).select("level", "head", "child", F.col("m").alias("labels"), apart.alias("apart"))


def _renamed(tree: DataFrame, levels: DataFrame, name: str) -> DataFrame:
    """``tree`` with ``name`` as the segments of ``levels`` (id, levels)."""
    new = F.transform("template", lambda s, i: F.when(F.array_contains(F.coalesce("levels", F.array().cast("array<int>")), i + 1), F.lit(name)).otherwise(s))
    return tree.join(levels, "id", "left").withColumn("template", new).select(*tree.columns)


def _tree(pages: DataFrame, prior: float, scratch: Scratch) -> DataFrame:
    """(host, shape, template, branch, good, labelled): shapes with their place in the tree, before and after merging.

    Downwards, the rare children of a node that has more than FANOUT of them become one wildcard ``*``; a child with
    WEIGHT labels, or one whose purity differs significantly from its siblings', keeps its name at any number of
    children. A node can only be judged when those above it are: each round takes, in all paths at once, the first
    node with too many, so there are as many rounds as a path has such nodes, however deep it is. Upwards, children whose purity
    does not differ significantly from that of their siblings together, without themselves, become one branch ``~``, with
    sums over all that lies below them; what is merged below a node does not change its sums, so all levels are compared in one pass.
    """
    sums = pages.groupBy("host", "shape").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    tree = scratch.keep(sums.withColumns({"template": F.col("shape"), "id": F.monotonically_increasing_id()}), "shapes")
    for k in range(ROUNDS):
        places = scratch.keep(_places(tree), f"places{k}")
        rare = scratch.keep(_children(places, prior).where((F.col("labels") < WEIGHT) & ~F.col("apart")).select("level", "head", "child"), f"rare{k}")
        wide = scratch.keep(rare.groupBy("level", "head").agg(F.count("*").alias("n")).where(F.col("n") > FANOUT).select("level", "head"), f"wide{k}")
        if wide.isEmpty():
            break
        first = places.join(wide, ["level", "head"]).groupBy("id").agg(F.min("level").alias("level"))
        levels = places.join(first, ["id", "level"]).join(rare, ["level", "head", "child"], "left_semi").select("id", F.array("level").alias("levels"))
        tree = scratch.keep(_renamed(tree, levels, "*"), f"tree{k}")
    else:
        raise RuntimeError(f"nodes with too many children are left after {ROUNDS} rounds")
    like = scratch.keep(_children(places, prior).where(~F.col("apart")).select("level", "head", "child"), "like")
    several = like.groupBy("level", "head").agg(F.count("*").alias("n")).where("n > 1").select("level", "head")
    alike = like.join(several, ["level", "head"], "left_semi")
    levels = places.join(alike, ["level", "head", "child"], "left_semi").groupBy("id").agg(F.collect_set("level").alias("levels"))
    own = tree.select("id", F.col("template").alias("own"))
    return _renamed(tree, levels, "~").join(own, "id").select("host", "shape", F.col("own").alias("template"), F.col("template").alias("branch"), "good", "labelled")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, branch, purity`` for every row of ``pages`` (page_id, url).

    labels: page_id, good (boolean); a page may have several, of which all must be good. A branch's purity is its share
    of good labels, smoothed towards its host's, and that towards the share of all labels; a branch below BELOW of that
    share is rejected. A url that is null or has no ``://`` has an empty host and path, fits no rule, and is judged with the others of that kind.
    Without any label the purity is 1 and nothing but the rules rejects. Repeated rows are judged alike; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    labels = labels.where("page_id is not null and good is not null").groupBy(F.col("page_id").cast("long").alias("label_id")).agg(F.min(F.col("good").cast("long")).alias("good"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = scratch.keep(rows.withColumn("shape", shape_of(F.col("path"))), "pages")
    marked = rows.join(labels, F.col("page_id") == F.col("label_id"), "left").select("host", "shape", F.coalesce("good", F.lit(0)).alias("good"), F.col("good").isNotNull().cast("long").alias("labelled"))
    good, marks = marked.agg(F.sum("good"), F.sum("labelled")).first()
    prior = good / marks if marks else 1.0
    tree = scratch.keep(_tree(marked, prior, scratch), "tree")
    own = tree.groupBy("host", "branch").agg(F.sum("good").alias("bg"), F.sum("labelled").alias("bm"))
    host = tree.groupBy("host").agg(((F.sum("good") + WEIGHT * prior) / (F.sum("labelled") + WEIGHT)).alias("of_host"))
    own = own.join(host, "host").select("host", "branch", ((F.col("bg") + WEIGHT * F.col("of_host")) / (F.col("bm") + WEIGHT)).alias("purity"))
    shown = lambda c: F.concat(F.lit("/"), F.array_join(c, "/"))
    verdicts = tree.select("host", "shape", "template", "branch").join(own, ["host", "branch"])
    verdicts = scratch.keep(verdicts.select("host", "shape", shown("template").alias("template"), shown("branch").alias("branch"), "purity"), "verdicts")
    verdicts = F.broadcast(verdicts) if verdicts.count() <= BROADCAST_ROWS else verdicts.hint("merge")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(verdicts, ["host", "shape"], "left")
    method = F.when(F.col("purity") < BELOW * prior, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "template", "branch", "purity")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls. A page's label is that of the document whose id its path ends in: good quality and not toxic."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    ids = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null")
    marks = ids.join(labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")), "doc_id").select("page_id", "good")
    return judge_urls(pages, marks)
