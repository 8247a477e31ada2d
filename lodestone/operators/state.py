"""Append-only records: current state, history, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import Ranges, ordinary

# Evidence that lets a memory count as verified, and evidence that a task is told to repeat.
QUALIFYING = ("test_result", "command_output", "tool_output", "user_confirmation")
VALIDATION = ("test_result", "command_output")


def current(memories: DataFrame) -> DataFrame:
    """Memories that no other supersedes."""
    gone = memories.where("supersedes is not null").select(F.col("supersedes").alias("__gone"))
    return memories.join(gone, F.col("memory_id") == F.col("__gone"), "left_anti")


def with_status(memories: DataFrame) -> DataFrame:
    """All memories and whether each is current."""
    gone = memories.where("supersedes is not null").select(F.col("supersedes").alias("__gone")).distinct()
    return memories.join(gone, F.col("memory_id") == F.col("__gone"), "left").withColumn("is_current", F.col("__gone").isNull()).drop("__gone")


def of_kind(memories: DataFrame, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    if kind not in kinds:
        raise ValueError(f"unknown kind: {kind}")
    return memories.where(F.col("kind") == kind)


def open_conflicts(conflicts: DataFrame, memories: DataFrame) -> DataFrame:
    """Conflicts of which both memories are current; one whose memory is missing stops the read."""
    known, out = with_status(memories).select("memory_id", "is_current"), conflicts
    for side in ("a", "b"):
        missing = F.raise_error(F.concat(F.lit("missing memory "), F.col(side))).cast("boolean")
        out = out.join(known.toDF(side, "__current"), side, "left").where(F.coalesce("__current", missing)).select(*conflicts.columns)
    return out


def upsert_conflicts(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """New conflicts (a, b, recorded_at) of a batch: pairs in either order are one, the earliest wins, stored ones stay."""
    new = declared.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("recorded_at").alias("recorded_at")).where("a <> b")
    return new.join(stored.select("a", "b"), ["a", "b"], "left_anti")


def supersession_violations(memories: DataFrame) -> DataFrame:
    """(memory_id, reason): self, missing target, or one of several superseders of a target."""
    claims = memories.where("supersedes is not null").select("memory_id", "supersedes")
    several = claims.groupBy("supersedes").agg(F.count("*").alias("n")).where("n > 1").select("supersedes")
    out = claims.where("memory_id = supersedes").select("memory_id", F.lit("self").alias("reason"))
    known = memories.select(F.col("memory_id").alias("supersedes"))
    out = out.unionByName(claims.join(known, "supersedes", "left_anti").select("memory_id", F.lit("missing").alias("reason")))
    return out.unionByName(claims.join(several, "supersedes", "left_semi").select("memory_id", F.lit("taken").alias("reason")))


def first_equivalents(memories: DataFrame, links: DataFrame) -> DataFrame:
    """(memory_id, canonical_id): of current equal records the oldest stands for all. Combined before the shuffle.

    Equal are content, kind, state, what they supersede, and both lists of evidence, related and supporting, in order.
    links: (memory_id, evidence_id, position, role).
    """
    key = ["content", "kind", "epistemic_state", "supersedes", "cited"]
    ordered = F.array_sort(F.collect_list(F.struct("position", "evidence_id", "role")))
    cited = links.groupBy("memory_id").agg(F.transform(ordered, lambda x: F.struct(x.evidence_id, x.role)).alias("cited"))
    live = current(memories).join(cited, "memory_id", "left").select("memory_id", "seq", F.sha2(F.to_json(F.struct(*key)), 256).alias("key"))
    first = live.groupBy("key").agg(F.min(F.struct("seq", "memory_id")).memory_id.alias("canonical_id"))
    return live.select("memory_id", "key").join(first, "key").select("memory_id", "canonical_id")


def verified_gate(links: DataFrame) -> DataFrame:
    """(memory_id, n_supporting, qualifies): verified needs a supporting evidence of a qualifying kind."""
    good = (F.col("role") == "supporting") & F.col("kind").isin(*QUALIFYING)
    return links.groupBy("memory_id").agg(F.count_if(F.col("role") == "supporting").alias("n_supporting"), F.coalesce(F.bool_or(good), F.lit(False)).alias("qualifies"))


def child_arrays(links: DataFrame, owner: str, child: str, position: str) -> DataFrame:
    """Children of each owner in the order of their positions."""
    parts = F.array_sort(F.collect_list(F.struct(position, child)))
    return links.groupBy(owner).agg(F.transform(parts, lambda x: x[child]).alias("children"))


def latest(observations: DataFrame) -> DataFrame:
    """The last observation of every path, without a sort: the largest sequence, combined before the shuffle."""
    last = F.max(F.struct("seq", "digest", "size_bytes"))
    return observations.groupBy("path").agg(last.alias("o")).select("path", "o.seq", "o.digest", "o.size_bytes")


def changes(observations: DataFrame) -> DataFrame:
    """Observations with status: added for the first of a path, else changed or unchanged against the one before; a null digest is a value.

    A path with very many observations spreads over ranges of seq.
    """
    if ordinary(observations, "path"):
        before = F.lag(F.struct("path", "digest")).over(Window.partitionBy("path").orderBy("seq"))
        return _changed(observations.withColumn("__before_it", before))
    return _changed(Ranges(observations, ["path", "seq"]).previous(["path", "digest"], "__before_it").table())


def _changed(out: DataFrame) -> DataFrame:
    first = F.col("__before_it").isNull() | ~F.col("__before_it.path").eqNullSafe(F.col("path"))
    status = F.when(first, "added").when(~F.col("__before_it.digest").eqNullSafe(F.col("digest")), "changed").otherwise("unchanged")
    return out.withColumn("status", status).drop("__before_it")


def partners(open_: DataFrame) -> DataFrame:
    """(memory_id, partners) of open conflicts (a, b): the other end, seen from both."""
    both = open_.select(F.col("a").alias("memory_id"), F.col("b").alias("other")).unionByName(open_.select(F.col("b").alias("memory_id"), F.col("a").alias("other")))
    return both.groupBy("memory_id").agg(F.array_sort(F.collect_set("other")).alias("partners"))


def seed_report(candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """(path, status) of candidates (path, digest) against the latest stored digest."""
    stored = latest(observations).select("path", F.col("digest").alias("__stored"))
    status = F.when(F.col("__stored").isNull(), "new").when(F.col("__stored") == F.col("digest"), "unchanged").otherwise("changed")
    return candidates.join(stored, "path", "left").select("path", status.alias("status"))


def missing(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return children.join(parents.select(key), key, "left_anti")


def timeline(events: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories in event order; an event whose memory is missing stops the read."""
    out = events.where("kind = 'memory_recorded'").join(memories.withColumnRenamed("kind", "memory_kind"), F.col("subject_id") == F.col("memory_id"), "left")
    return out.withColumn("memory_id", F.coalesce("memory_id", F.raise_error(F.concat(F.lit("missing memory "), F.col("subject_id")))))


def backfill_events(memories: DataFrame) -> DataFrame:
    """(subject_id, kind, recorded_at): the events that an old store never wrote, by record and by supersession.

    The order of recorded_at and subject_id is their order; numbering is left to the reader's sort.
    """
    kinds = F.array(F.lit("memory_recorded"), F.when(F.col("supersedes").isNotNull(), F.lit("memory_superseded")))
    return memories.select("memory_id", "supersedes", "seq", F.explode(F.array_compact(kinds)).alias("kind")).select(F.when(F.col("kind") == "memory_recorded", F.col("memory_id")).otherwise(F.col("supersedes")).alias("subject_id"), "kind", F.col("seq").alias("recorded_at"))
