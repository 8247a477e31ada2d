"""Which records are relevant to each task, over all channels, and what a preflight and a guard report of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import experience, index, semantic
from lodestone.operators.index import Index
from lodestone.operators.ordered import Ranges, ordinary
from lodestone.operators.state import VALIDATION
from lodestone.sources import scratch


def admitted(tokens: DataFrame, records: Index, by_vector: DataFrame) -> DataFrame:
    """(q, id, words, full_text, semantic): records that a channel admits; by_vector has (q, id)."""
    words, full_text = index.words_and_full_text(tokens, records)
    return experience.channels(words=words, full_text=full_text, semantic=by_vector)


def attempts(found: DataFrame, table: DataFrame) -> DataFrame:
    """(q, attempt_id, seq, outcome, evidence_id) of admitted attempts, a row for each evidence of one, or one with null."""
    return found.select("q", F.col("id").alias("attempt_id")).join(table.select("attempt_id", "seq", "outcome", "evidence_id"), "attempt_id").select("q", "attempt_id", "seq", "outcome", "evidence_id")


def memories(found: DataFrame, relevant_attempts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q, memory_id): memories that a channel admits, or that share evidence with a relevant attempt that succeeded or failed."""
    seen = relevant_attempts.where("outcome <> 'partial'").select("q", "evidence_id").distinct()
    rescued = seen.join(evidence, "evidence_id").select("q", "memory_id")
    return found.select("q", F.col("id").alias("memory_id")).unionByName(rescued).distinct()


def memory_vectors(near, live: DataFrame, evidence: DataFrame, clusters: DataFrame, attempt_evidence: DataFrame, words, attempt_vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(q, id): memories that vectors admit for a preflight: pools of their own, which never compete with each other.

    Root causes and verified lessons by cluster or else by corroboration, the verified lessons as a set besides, and
    invalidations and pending ones by a single winner each. near(eligible, **limits) gives (q, id, score) of the
    memories (id) that are eligible; evidence: (id, evidence); words: (q, attempt_id), or a function as ``corroborated`` has it.
    """
    floor, margin = semantic.WINNER["memory"]
    of = lambda cond: live.where(cond).select(F.col("memory_id").alias("id"))
    lessons = of("kind = 'lesson' and epistemic_state = 'verified'")
    causes = of("kind = 'root_cause' or (kind = 'lesson' and epistemic_state = 'verified')")
    scored = scratch.keep(near(causes, within=margin), "causes")
    first = experience.cluster_admitted(scored, clusters)
    second = experience.corroborated(scored, evidence.join(causes, "id", "left_semi"), attempt_evidence, words, attempt_vectors, query_vectors)
    out = experience.with_fallback(first, second).unionByName(lesson_set(near, lessons))
    for kind in ("invalidation", "pending"):
        out = out.unionByName(winner(near, of(f"kind = '{kind}'")))
    return out.distinct()


def winner(near, eligible: DataFrame, kind: str = "memory") -> DataFrame:
    """(q, id): the single winner among eligible records."""
    return semantic.winner(near(eligible, k=2), *semantic.WINNER[kind]).select("q", "id")


def lesson_set(near, eligible: DataFrame, kind: str = "lesson") -> DataFrame:
    """(q, id): the few best eligible records above the floor of their kind."""
    floor, cap = semantic.SETS[kind]
    return semantic.admitted_set(near(eligible, floor=floor, k=cap), floor, cap).select("q", "id")


def document_set(scored: DataFrame) -> DataFrame:
    """(q, id, score) of the few documents whose best chunk is above the floor; scored: (q, group, score) by chunk."""
    return semantic.admitted_set(semantic.group_max(scored), *semantic.SETS["document"]).select("q", "id", "score")


def first_seen(*sources: DataFrame) -> DataFrame:
    """(q, evidence_id, p): the distinct evidence of sources (q, place, position, evidence_id) in the order of first sight."""
    rows = sources[0].withColumn("__s", F.lit(0))
    for n, df in enumerate(sources[1:], 1):
        rows = rows.unionByName(df.withColumn("__s", F.lit(n)))
    first = rows.groupBy("q", "evidence_id").agg(F.min(F.struct("__s", "place", "position")).alias("first"))
    return first.withColumn("p", F.row_number().over(Window.partitionBy("q").orderBy("first", "evidence_id"))).drop("first")


def validation(verified_lessons: DataFrame, successes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q, evidence_id, p): evidence that validates, of verified lessons and then of successes, each (q, place, position, evidence_id)."""
    return validating(first_seen(verified_lessons, successes), evidence)


def validating(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of ``cited`` (q, evidence_id, p) whose evidence validates; one whose evidence is missing stops the read."""
    kinds = cited.join(evidence.select("evidence_id", F.col("kind").alias("__kind")), "evidence_id", "left")
    missing = F.raise_error(F.concat(F.lit("missing evidence "), F.col("evidence_id").cast("string"))).cast("string")
    return kinds.where(F.coalesce("__kind", missing).isin(*VALIDATION)).select("q", "evidence_id", "p")


def conflicts(open_: DataFrame, relevant: DataFrame) -> DataFrame:
    """(q, a, b) of open conflicts (a, b) of which either memory is relevant."""
    either = lambda side: open_.select("a", "b").join(relevant.select("q", F.col("memory_id").alias(side)), side).select("q", "a", "b")
    return either("a").unionByName(either("b")).distinct()


def guard(skills: DataFrame, relevant_attempts: DataFrame) -> DataFrame:
    """(q, attempt_id, seq) of relevant failed attempts that share evidence with an applicable skill (q, evidence_id)."""
    return relevant_attempts.where("outcome = 'failed'").join(skills.select("q", "evidence_id"), ["q", "evidence_id"], "left_semi").select("q", "attempt_id", "seq").distinct()


def chunk_hits(admitted_: DataFrame, chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """(q, d, i, source, c, n, shared, intent, hits): chunks of admitted documents (q, d) that share a token with the task.

    A document whose chunks share none gives its first chunk with nothing shared. chunks: (d, source, i, n, c, tokens).
    A row a chunk and task, whose token sets are intersected where they meet; no token is a row of its own.
    """
    asked = tokens.groupBy("q").agg(F.collect_set("token").alias("asked"))
    rows = admitted_.select("q", "d").join(chunks.select("d", "i", "source", "c", "n", "tokens"), "d").join(asked, "q", "left")
    rows = rows.withColumn("hits", F.coalesce(F.array_intersect("tokens", "asked"), F.array().cast("array<string>"))).drop("tokens", "asked")
    intent = F.size(F.array_intersect("hits", F.array(*map(F.lit, T.INTENT_TERMS))))
    rows = rows.withColumns({"shared": F.size("hits").cast("long"), "intent": intent.cast("long")})
    most = F.max("shared").over(Window.partitionBy("q", "d"))
    return rows.withColumn("most", most).where((F.col("shared") > 0) | ((F.col("most") == 0) & (F.col("i") == 0))).select("q", "d", "i", "source", "c", "n", "shared", "intent", "hits")


def ordered_evidence(hits: DataFrame, by_vector: DataFrame) -> DataFrame:
    """``hits`` with score, similarity and pos, their order for each task; by_vector: (q, id, score) of admitted documents."""
    scored = hits.withColumn("score", T.weighted_overlap(F.col("shared"), F.col("intent"))).join(by_vector.select("q", F.col("id").alias("d"), F.col("score").alias("similarity")), ["q", "d"], "left")
    scored = scored.withColumn("semantic", F.col("similarity").isNotNull()).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    return placed(scratch.keep(scored, "scored"))


def placed(scored: DataFrame) -> DataFrame:
    """``scored`` (q, score, similarity, source, d, i) with pos, the place among a query's rows.

    A query with very many rows spreads over ranges of the order, so no task ranks all chunks of one.
    """
    if ordinary(scored, "q"):
        return scored.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("similarity"), "source", "d", "i")))
    rows = scored.withColumns({"__score": -F.col("score"), "__similarity": -F.col("similarity")})
    ranges = Ranges(rows, ["q", "__score", "__similarity", "source", "d", "i"]).previous(["q"], "__prior").running(F.lit(1), "sum", "__row")
    first = F.col("__prior").isNull() | (F.col("__prior.q") != F.col("q"))
    out = ranges.running(F.when(first, F.col("__row")), "max", "__start").table()
    return out.withColumn("pos", (F.col("__row") - F.col("__start") + 1).cast("int")).select(*scored.columns, "pos")
