"""Admission that follows shared evidence: clusters of records, corroboration, promotion, and the validation pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import semantic
from lodestone.operators.compile import cost
from lodestone.sources import scratch

#: How far below the floor of memories a corroborated one may score.
BAND = 0.20


def cluster_admitted(scored: DataFrame, members: DataFrame) -> DataFrame:
    """(q, id) of the winning cluster of every query, all its members, whatever their own scores.

    scored: (q, id, score) of root causes and verified lessons, at least those no more than the margin below a query's
    best. members: (id, cluster, is_lesson), the clusters that shared evidence makes of them. The best record speaks for
    its cluster: it reaches the floor of memories, that of lessons too where it is one, and leads the best record of
    another cluster by the margin. A cluster of lessons only is left to their own channel. Ties go to the smaller id.
    Rows are combined by cluster before queries compare.
    """
    floor, margin = semantic.WINNER["memory"]
    lesson_floor = semantic.SETS["lesson"][0]
    best = F.min(F.struct((-F.col("score")).alias("s"), "id", "is_lesson")).alias("best")
    sums = scored.select("q", "id", "score").join(members, "id").groupBy("q", "cluster").agg(best)
    w = Window.partitionBy("q").orderBy("best")
    first = sums.withColumns({"r": F.row_number().over(w), "other": -F.lead("best.s").over(w)}).where("r = 1").withColumn("top", -F.col("best.s"))
    needed = F.when(F.col("best.is_lesson"), F.lit(max(floor, lesson_floor))).otherwise(F.lit(floor))
    won = first.where((F.col("top") >= needed) & (F.col("other").isNull() | (F.round(F.col("top") - F.col("other"), 9) >= margin)))
    mixed = members.where("not is_lesson").select("cluster")
    return members.select("id", "cluster").join(won.select("q", "cluster").join(mixed, "cluster", "left_semi"), "cluster").select("q", "id")


def corroborated(scored: DataFrame, evidence: DataFrame, attempt_evidence: DataFrame, lexical: DataFrame | Callable[[DataFrame], DataFrame], attempt_vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(q, id): the best record of a query where an attempt that shares its evidence is relevant by itself.

    scored: (q, id, score); evidence: (id, evidence); attempt_evidence: (attempt_id, evidence); lexical: (q, attempt_id)
    of the attempts that a query's words admit, or a function that finds these among such pairs; attempt_vectors: (attempt_id, v); query_vectors: (q, qv). An attempt
    counts when the words admit it or when it wins among the attempts that share the record's evidence; only those are
    compared. Meant for the queries for which ``cluster_admitted`` gives nothing.
    """
    top = semantic.top(scored, 1).where(F.col("score") >= semantic.WINNER["memory"][0] - BAND).select("q", "id")
    related = scratch.keep(top.join(evidence, "id").join(attempt_evidence, "evidence").select("q", "id", "attempt_id").distinct(), "related")
    if callable(lexical):
        lexical = lexical(related.select("q", "attempt_id").distinct())
    by_words = related.join(lexical.select("q", "attempt_id"), ["q", "attempt_id"], "left_semi").select("q", "id")
    pool = related.join(attempt_vectors.join(related.select("attempt_id"), "attempt_id", "left_semi"), "attempt_id").join(query_vectors, "q").select("q", F.col("attempt_id").alias("id"), semantic.cosine(F.col("v"), F.col("qv")).alias("score"))
    won = semantic.winner(pool, *semantic.WINNER["attempt"]).select("q")
    return by_words.unionByName(top.join(won, "q", "left_semi")).distinct()


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows (q, id) of the first, and of the second for queries without a row in the first."""
    return first.select("q", "id").unionByName(second.select("q", "id").join(first.select("q").distinct(), "q", "left_anti"))


def channels(**found: DataFrame) -> DataFrame:
    """(q, id, <one flag a channel>) of everything that a channel (q, id) admits."""
    rows = [df.select("q", "id", *[F.lit(n == name).alias(n) for n in found]) for name, df in found.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("q", "id").agg(*[F.bool_or(n).alias(n) for n in found])


def promoted(drafts: DataFrame, memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Skills of drafts (skill_id, name, purpose, steps, conditions, lesson_id), with verification_state, evidence_ids and reason.

    State and evidence come from the stored lesson, never from the draft. reason says why a draft is refused: blank
    name or purpose, no steps, a blank step or condition, or no such lesson; it is null where the skill stands.
    evidence: (memory_id, evidence_id, position).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    lessons = memories.where("kind = 'lesson'").select(F.col("memory_id").alias("lesson_id"), F.col("epistemic_state").alias("__state"))
    cited = evidence.groupBy(F.col("memory_id").alias("lesson_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "evidence_id"))), lambda x: x.evidence_id).alias("evidence_ids"))
    out = drafts.join(lessons, "lesson_id", "left").join(cited, "lesson_id", "left")
    reason = F.coalesce(
        F.when(blank(F.col("name")), F.lit("blank name")), F.when(blank(F.col("purpose")), F.lit("blank purpose")),
        F.when(F.coalesce(F.size("steps"), F.lit(0)) < 1, F.lit("no steps")), F.when(F.exists("steps", blank), F.lit("blank step")),
        F.when(F.coalesce(F.exists("conditions", blank), F.lit(False)), F.lit("blank condition")), F.when(F.col("__state").isNull(), F.lit("unknown lesson")),
    )
    state = F.when(F.col("__state") == "verified", "verified").otherwise("candidate")
    return out.select("skill_id", "name", "purpose", "steps", "conditions", "lesson_id", state.alias("verification_state"), "evidence_ids", reason.alias("reason"))


def chosen_chunks(scored: DataFrame) -> DataFrame:
    """Of chunks (q, d, i, score, ...), those of score above 0; of a document without any, its first chunk."""
    best = F.max("score").over(Window.partitionBy("q", "d"))
    least = F.min("i").over(Window.partitionBy("q", "d"))
    return scored.withColumns({"__best": best, "__least": least}).where((F.col("score") > 0) | ((F.col("__best") <= 0) & (F.col("i") == F.col("__least")))).drop("__best", "__least")


def with_validation(items: DataFrame, validation: DataFrame, cited: DataFrame, budget: int) -> DataFrame:
    """A budget scan (q, pos, section, size, cost, used, selected) and its validation pass, with evidence_id for the latter.

    validation: (q, p, evidence_id, size), all that a query recommends, in the order of p. cited: (q, pos,
    evidence_id) of the items. Where the scan took every item, what the selected ones cite follows under its own
    header while it fits; where it stopped, the whole pool counts as omitted, with null cost and used.
    """
    state = items.groupBy("q").agg(F.bool_and("selected").alias("__all"), F.max("used").alias("__used"), F.max("pos").alias("__pos"))
    wanted = items.where("selected").select("q", "pos").join(cited, ["q", "pos"]).select("q", "evidence_id").distinct().withColumn("__cited", F.lit(True))
    pool = validation.join(state, "q", "left").join(wanted, ["q", "evidence_id"], "left")
    pool = pool.withColumn("__all", F.coalesce("__all", F.lit(True))).where(~F.col("__all") | F.col("__cited"))
    w = Window.partitionBy("q").orderBy("p", "evidence_id")
    head = F.lit("VALIDATION")
    pool = pool.withColumn("__n", F.row_number().over(w)).withColumn("cost", F.when(F.col("__all"), cost(F.col("size"), head, F.col("__n") == 1).cast("long")))
    used = F.when(F.col("__all"), F.coalesce("__used", F.lit(0)) + F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pool = pool.withColumn("used", used.cast("long")).withColumn("selected", F.coalesce(F.col("used") <= budget, F.lit(False)))
    own = pool.select("q", (F.coalesce("__pos", F.lit(0)) + F.col("__n")).alias("pos"), head.alias("section"), "size", "cost", "used", "selected", "evidence_id")
    return items.withColumn("evidence_id", F.lit(None).cast(dict(validation.dtypes)["evidence_id"])).select(*own.columns).unionByName(own)


def upserted(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Stored rows with the new ones in their place; of several new rows of one key the largest ``order`` wins."""
    names = [c for c in new.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("r")).select(*key, "r.*")
    return stored.join(last.select(*key), key, "left_anti").unionByName(last.select(*stored.columns))


# What a status and a result say of an index, by its state; and what helps.
INDEX_LINES = {
    "ready": ("ready ({indexed} indexed)", "semantic + lexical{fresh}"),
    "stale": ("stale ({missing} of {total} not indexed; refreshed automatically on next preflight)", "semantic + lexical -- DEGRADED: {missing} record(s) not indexed ({detail}; {remedy})"),
    "disabled": ("disabled ({detail}; {remedy})", "lexical only -- semantic retrieval is {detail} ({remedy})"),
    "unavailable": ("unavailable ({detail}; {remedy})", "lexical only -- semantic retrieval is unavailable: {detail} ({remedy})"),
}
REMEDY, REMEDIES = "run: lodestone semantic-setup", {"the index is unreadable": "delete the index, then run: lodestone semantic-setup"}
FRESH = " (refreshed {refreshed})"


def index_lines(states: DataFrame) -> DataFrame:
    """``states`` (status, detail, missing, indexed, refreshed) with described and retrieval, their lines for a status and a result."""
    pick = lambda table, key, default=None: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), *([F.lit(default)] if default else []))
    values = {
        "fresh": F.when(F.col("refreshed") > 0, F.lit(FRESH)).otherwise(F.lit("")), "detail": F.coalesce("detail", F.lit("")), "remedy": pick(REMEDIES, F.coalesce("detail", F.lit("")), REMEDY),
        "total": (F.col("indexed") + F.col("missing")).cast("string"), **{c: F.col(c).cast("string") for c in ("missing", "indexed", "refreshed")},
    }

    def filled(template: Column) -> Column:
        for name, value in values.items():
            template = F.replace(template, F.lit(f"{{{name}}}"), value)
        return template

    return states.withColumns({name: filled(pick({k: v[i] for k, v in INDEX_LINES.items()}, F.col("status"))) for i, name in enumerate(("described", "retrieval"))})


def index_state(pool: DataFrame, vectors: DataFrame, enabled: bool, model: str, built_with: str | None, complete: bool) -> DataFrame:
    """One row (state, detail, missing): disabled, unavailable, stale or ready, and how many records have no vector yet."""
    missing = pool.join(vectors.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti").agg(F.count("*").alias("missing"))
    broken = "not set up" if not enabled else "the last index build did not finish" if not complete else "the index was built with a different model" if built_with != model else None
    state = F.lit("disabled" if not enabled else "unavailable") if broken else F.when(F.col("missing") > 0, "stale").otherwise("ready")
    return missing.select(state.alias("state"), F.lit(broken).cast("string").alias("detail"), "missing")
