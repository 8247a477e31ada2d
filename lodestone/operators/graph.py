"""Clusters of records that share evidence, and the components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import scratch

#: Two rounds halve the nodes, and one doubling halves the longest way: no table of 64-bit ids gets there.
ROUNDS, DOUBLINGS = 130, 65


def _ends(up: DataFrame, keep, drop) -> DataFrame:
    """(node, up) with each pointer followed to its end, a node that points to itself."""
    for j in range(DOUBLINGS):
        to = up.select(F.col("node").alias("up"), F.col("up").alias("next")).where("up <> next")
        if up.join(to, "up", "left_semi").isEmpty():
            return up
        further = keep(up.join(to, "up", "left").select("node", F.coalesce("next", "up").alias("up")), f"ends{j}")
        drop(up)
        up = further
    raise RuntimeError(f"pointers are left after {DOUBLINGS} doublings")


def components(edges: DataFrame, keep=scratch.keep, drop=lambda *_: None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is its smallest reachable node.

    Every round points each node to the smallest of itself and its neighbours, follows the pointers to their ends
    by doubling, replaces the nodes of all edges by these ends, and drops loops and repeats. A node that is an end
    in two rounds running is the end of all its neighbours of the first, and each of those has one end only; so
    two rounds at least halve the nodes with an edge, whatever the order of ids, and a round has a logarithm of
    doublings. The loop runs until no edge is left. The minimum is combined before the shuffle, so a node
    with very many links costs one row a task. All edges and maps stay in tables: keep(df, label) writes one, drop
    gives up what later steps do not read.
    """
    e = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    for k in range(ROUNDS + 1):
        if e.isEmpty():
            break
        if k == ROUNDS:
            raise RuntimeError(f"edges are left after {ROUNDS} rounds of contraction")
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(e.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = _ends(keep(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("up")), f"up{k}"), keep, drop)
        maps.append(up)
        moved = e.join(up.toDF("a", "ua"), "a").join(up.toDF("b", "ub"), "b").where("ua <> ub")
        nxt = keep(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), f"edges{k}")
        drop(e)
        e = nxt
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1].toDF("node", "component")
    for up in reversed(maps[:-1]):
        out = up.join(out.toDF("up", "top"), "up", "left").select("node", F.coalesce("top", "up").alias("component"))
    out = keep(out, "components")
    drop(*maps)
    return out


def clusters(links: DataFrame) -> DataFrame:
    """(member, cluster) of links (member, evidence): cluster is the smallest member that shared evidence reaches.

    Members of one evidence become edges to its smallest member, so an evidence that very many share costs a row each.
    """
    links = scratch.keep(links.select("member", "evidence").where("member is not null").distinct(), "links")
    least = links.groupBy("evidence").agg(F.min("member").alias("b"))
    found = components(links.join(least, "evidence").select(F.col("member").alias("a"), "b"))
    members = links.select("member").distinct()
    return members.join(found.toDF("member", "cluster"), "member", "left").select("member", F.coalesce("cluster", "member").alias("cluster"))
