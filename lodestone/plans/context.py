"""Preflights, guards and contexts for many tasks at once, over any source of records.

A source of records has the methods of ``views.Views``: tasks, memories, memory_evidence, evidence, attempts, skills,
conflicts, chunks and chunk_texts, attempt_sizes, evidence_sizes, pool (vectors), search (an index, or what stands for one) and
task_tokens; ``sources.records`` reads them from a store. Names of attempts and evidence in texts are their ids behind ``v.prefix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import compile as C
from lodestone.operators import cover, experience, graph, index, relevance, semantic, state
from lodestone.sources import scratch

BUDGET = 4000


def near(v, kind: str):
    """A function of eligible records and limits: cosines of tasks and eligible records of a kind."""
    if getattr(v, "asked", None) is None:  # the tasks' vectors are read once
        v.asked = semantic.Queries(v.pool("task").select(F.col("id").alias("q"), F.lit("x").alias("query_pool"), F.col("v").alias("qv")))
    asked = v.asked
    pool = v.pool(kind).withColumn("pool", F.lit("x"))
    pool = pool if "group" in pool.columns else pool.withColumn("group", F.col("id"))

    def found(eligible=None, **limits):
        return semantic.near(asked, pool if eligible is None else pool.join(eligible, "id", "left_semi"), **limits)

    return found


def attempt_words(v):
    """A function of pairs (q, attempt_id): those that words admit, by the texts of these attempts alone and without an index."""

    def among(pairs: DataFrame) -> DataFrame:
        asked = v.task_tokens().groupBy("q", "qn").agg(F.collect_set("token").alias("asked"))
        texts = v.attempts().select("attempt_id", F.concat_ws(" ", "task", "approach").alias("text")).join(pairs.select("attempt_id"), "attempt_id", "left_semi").dropDuplicates(["attempt_id"])
        both = pairs.join(texts.select("attempt_id", T.tokens(F.col("text")).alias("tokens")), "attempt_id").join(asked, "q")
        return both.where(F.size(F.array_intersect("tokens", "asked")) >= T.majority(F.col("qn"))).select("q", "attempt_id")

    return among


def relevant_attempts(v) -> DataFrame:
    """(q, attempt_id, outcome, evidence_id) of attempts that words, full text or vectors admit."""
    found = relevance.admitted(v.task_tokens(), v.search("attempt"), relevance.winner(near(v, "attempt"), None, "attempt"))
    return scratch.keep(relevance.attempts(found, v.attempts()), "attempts")


def relevant_memories(v, attempts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(q, memory_id) of current memories that any channel admits; own: what vectors admit, by default a preflight's pools."""
    live = state.current(v.memories())
    found = relevance.admitted(v.task_tokens(), v.search("memory"), memory_vectors(v) if own is None else own)
    out = relevance.memories(found, attempts, v.memory_evidence().select("memory_id", "evidence_id"))
    return scratch.keep(out.join(live.select("memory_id"), "memory_id", "left_semi").select("q", "memory_id"), "memories")


def pool_clusters(v) -> tuple[DataFrame, DataFrame]:
    """Evidence links (id, evidence) of current root causes and verified lessons, and their clusters (id, cluster, is_lesson)."""
    live = state.current(v.memories()).where("kind = 'root_cause' or (kind = 'lesson' and epistemic_state = 'verified')")
    links = live.select("memory_id", (F.col("kind") == "lesson").alias("is_lesson")).join(v.memory_evidence().select("memory_id", "evidence_id"), "memory_id", "left")
    links = scratch.keep(links.select(F.col("memory_id").alias("id"), F.col("evidence_id").alias("evidence"), "is_lesson"), "links")
    found = graph.clusters(links.select(F.col("id").alias("member"), "evidence"))
    return links.select("id", "evidence"), found.withColumnRenamed("member", "id").join(links.select("id", "is_lesson").distinct(), "id")


def corroborated(v, links: DataFrame, members: DataFrame, scored: DataFrame) -> DataFrame:
    own = v.attempts().select("attempt_id", F.col("evidence_id").alias("evidence"))
    vectors = v.pool("attempt").select(F.col("id").alias("attempt_id"), "v")
    asked = v.pool("task").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    second = experience.corroborated(scored, links, own, attempt_words(v), vectors, asked)
    return experience.with_fallback(experience.cluster_admitted(scored, members), second)


def memory_vectors(v) -> DataFrame:
    links, members = pool_clusters(v)
    own = v.attempts().select("attempt_id", F.col("evidence_id").alias("evidence"))
    asked = v.pool("task").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return scratch.keep(
        relevance.memory_vectors(near(v, "memory"), state.current(v.memories()), links, members, own, attempt_words(v), v.pool("attempt").select(F.col("id").alias("attempt_id"), "v"), asked), "memory-vectors",
    )


def document_set(v) -> DataFrame:
    return relevance.document_set(near(v, "chunk")(floor=semantic.SETS["document"][0]))


def admitted_documents(v) -> tuple[DataFrame, DataFrame]:
    """(q, id, words, full_text, semantic) of documents, and (q, id, score) of those that vectors admit; found once for a source."""
    if getattr(v, "documents_admitted", None) is None:
        by_vector = scratch.keep(document_set(v), "document-set")
        current = v.chunks().where("i = 0").select(F.col("d").alias("id"))  # the index also knows observations that are no longer current
        found = relevance.admitted(v.task_tokens(), v.search("document"), by_vector.select("q", "id"))
        v.documents_admitted = scratch.keep(found.join(current, "id", "left_semi").select("q", "id", "words", "full_text", "semantic"), "admitted"), by_vector
    return v.documents_admitted


def ordered_evidence(v) -> DataFrame:
    """Chunks of the documents that a task admits, scored and in order; narrow rows, without the chunks' texts."""
    documents, by_vector = admitted_documents(v)
    hits = relevance.chunk_hits(documents.select("q", F.col("id").alias("d")), v.chunks(), v.task_tokens())
    return relevance.ordered_evidence(hits, by_vector)


def sufficient(v, placed: bool = True) -> DataFrame:
    """(q, pos, evidence_id, i, source, c, n) of the ordered chunks that add something; pos counts all of them only where ``placed``.

    Where the tasks' tokens are a block, no more than the first chunks of each are put in order.
    """
    documents, by_vector = admitted_documents(v)
    found = cover.sufficient(documents.select("q", F.col("id").alias("d")), by_vector, v.chunks(), v.task_tokens(), placed)
    if found is not None:
        return found
    ranked = scratch.keep(ordered_evidence(v), "ordered").withColumnRenamed("d", "evidence_id")
    return C.sufficient(ranked, ranked.select("q", "pos", F.explode("hits").alias("token")))


def validation(v, attempts: DataFrame, memories: DataFrame) -> DataFrame:
    """(q, evidence_id, p): what a preflight recommends to check again."""
    lessons = state.current(v.memories()).where("kind = 'lesson' and epistemic_state = 'verified'").select("memory_id", F.col("seq").alias("place"))
    own = memories.join(lessons, "memory_id").join(v.memory_evidence().select("memory_id", "evidence_id", "position"), "memory_id").select("q", "place", "position", "evidence_id")
    successes = attempts.where("outcome = 'succeeded' and evidence_id is not null").select("q", F.col("seq").alias("place"), F.lit(0).alias("position"), "evidence_id")
    return scratch.keep(relevance.validation(own, successes, v.evidence()), "validation")


class Context:
    """What a context is made of: narrow items in order with their sizes, what they cite, and their texts on demand."""

    def __init__(self, v, budget: int = BUDGET):
        self.v, self.budget = v, budget
        live = state.current(v.memories())
        attempts = relevant_attempts(v)
        memories = relevant_memories(v, attempts)
        own = {"invariant": relevance.lesson_set, "decision": relevance.winner}
        found = {}
        for kind, choose in own.items():  # kinds that a preflight does not admit by vectors have pools of their own
            ids = live.where(F.col("kind") == kind).select(F.col("memory_id").alias("id"))
            by_vector = choose(near(v, "memory"), ids, "invariant") if kind == "invariant" else choose(near(v, "memory"), ids)
            found[kind] = by_vector.select("q", F.col("id").alias("memory_id"))
        every = memories
        for by_vector in found.values():
            every = every.unionByName(by_vector)
        place = {"invariant": 0, "pending": 1, "decision": 3, "root_cause": 5}
        section = F.when((F.col("kind") == "lesson") & (F.col("epistemic_state") == "verified"), 2)
        for kind, at in place.items():
            section = section.when(F.col("kind") == kind, at)
        self.memories = every.distinct().join(live.select("memory_id", "kind", "epistemic_state", "seq"), "memory_id").withColumn("s", section).where("s is not null")
        self.memories = scratch.keep(self.memories, "context-memories")
        self.excluded = v.tasks().select("q").join(self.memories.where("s = 0").groupBy("q").agg(F.count("*").alias("n")), "q", "left")
        invariants = live.where("kind = 'invariant'").agg(F.count("*").alias("n")).scalar()
        self.excluded = self.excluded.select("q", (invariants - F.coalesce("n", F.lit(0))).alias("n_excluded"))
        self.partners = state.partners(state.open_conflicts(v.conflicts(), v.memories()))
        self.evidence = v.memory_evidence().select("memory_id", "evidence_id")
        failed = attempts.where("outcome = 'failed'")
        causes = self.memories.where("s = 5").select("q", "memory_id", F.col("seq").alias("pos")).join(self.evidence, "memory_id")
        absorbed = causes.join(failed.select("q", "attempt_id", "seq", "evidence_id"), ["q", "evidence_id"]).groupBy("q", "attempt_id", "seq").agg(F.min(F.struct("pos", "memory_id")).memory_id.alias("memory_id"))
        self.absorbed = scratch.keep(absorbed, "absorbed")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "attempt_id"))), lambda x: self.name("attempt", x.attempt_id))
        self.cited = self.absorbed.groupBy("q", "memory_id").agg(listed.alias("cited"))
        self.alone = failed.join(self.absorbed.select("q", "attempt_id"), ["q", "attempt_id"], "left_anti").select("q", "attempt_id", "seq", "evidence_id")
        self.chunks = scratch.keep(sufficient(v, placed=False).select("q", F.col("evidence_id").alias("d"), "c", "i", "n", "source", F.col("pos").cast("long").alias("p")), "sufficient")
        self.validation = validation(v, attempts, memories)

    def name(self, kind: str, value):
        """How texts name an attempt or evidence."""
        return F.concat(F.lit(self.v.prefix.get(kind, "")), value.cast("string"))

    def parts(self) -> DataFrame:
        """(q, s, p, key, entity, authority, path, i, n, cited, partners) of all items, without their contents."""
        none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
        zero = F.lit(0)
        memories = self.memories.join(self.cited, ["q", "memory_id"], "left").join(self.partners, "memory_id", "left").select(
            "q", "s", F.col("seq").alias("p"), F.concat(F.lit("m"), F.col("memory_id")).alias("key"), F.col("memory_id").alias("entity"), F.col("epistemic_state").alias("authority"), null.alias("path"), zero.alias("i"), F.lit(1).alias("n"),
            F.when(F.col("s") == 5, F.coalesce("cited", none)).otherwise(none).alias("cited"), F.coalesce("partners", none).alias("partners"),
        )
        chunks = self.chunks.select("q", F.lit(4).alias("s"), "p", F.concat(F.lit("c"), F.col("c")).alias("key"), self.name("evidence", F.col("d")).alias("entity"), F.lit("document_observation").alias("authority"), F.col("source").alias("path"), "i", "n", none.alias("cited"), none.alias("partners"))
        alone = self.alone.select("q", "attempt_id", "seq").distinct().select("q", F.lit(6).alias("s"), F.col("seq").alias("p"), F.concat(F.lit("a"), F.col("attempt_id").cast("string")).alias("key"), self.name("attempt", F.col("attempt_id")).alias("entity"), null.alias("authority"), null.alias("path"), zero.alias("i"), F.lit(1).alias("n"), none.alias("cited"), none.alias("partners"))
        return memories.unionByName(chunks).unionByName(alone)

    def contents(self, wanted: DataFrame) -> DataFrame:
        """(key, content) of the items of ``wanted`` (key)."""
        keys = wanted.select("key").distinct()
        attempts = self.v.attempts().select(F.concat(F.lit("a"), F.col("attempt_id").cast("string")).alias("key"), F.concat_ws(" -- ", "task", "approach").alias("content")).dropDuplicates(["key"])
        memories = self.v.memories().select(F.concat(F.lit("m"), F.col("memory_id")).alias("key"), "content")
        chunks = self.v.chunk_texts(keys.where("key like 'c%'").select(F.substring("key", 2, 1 << 30).alias("c"))).select(F.concat(F.lit("c"), F.col("c")).alias("key"), F.col("chunk").alias("content"))
        evidence = self.v.evidence().select(F.concat(F.lit("e"), F.col("evidence_id").cast("string")).alias("key"), "content")
        return attempts.unionByName(memories).unionByName(chunks).unionByName(evidence).join(keys, "key", "left_semi")

    def sizes(self) -> DataFrame:
        """(key, content_size): lengths of the safe contents; those of chunks are stored."""
        memories = self.v.memories().join(self.memories.select("memory_id"), "memory_id", "left_semi").select(F.concat(F.lit("m"), F.col("memory_id")).alias("key"), T.safe_size(F.col("content")).alias("content_size"))
        attempts = self.v.attempt_sizes().join(self.alone.select("attempt_id"), "attempt_id", "left_semi").select(F.concat(F.lit("a"), F.col("attempt_id").cast("string")).alias("key"), "content_size")
        chunks = self.v.chunks().join(self.chunks.select("c"), "c", "left_semi").select(F.concat(F.lit("c"), F.col("c")).alias("key"), F.col("size").alias("content_size"))
        return memories.unionByName(attempts.dropDuplicates(["key"])).unionByName(chunks)

    def scan(self) -> DataFrame:
        """The budget scan over all items and its validation pass, with evidence_id for the latter and key and parts for the others."""
        size = C.item_size(F.col("entity"), F.col("content_size"), F.col("authority"), F.col("path"), F.col("i"), F.col("n"), F.col("cited"), F.col("partners"))
        pos = F.row_number().over(Window.partitionBy("q").orderBy("s", "p", "entity"))
        items = self.parts().join(self.sizes(), "key").withColumn("size", size).withColumn("pos", pos)
        items = items.withColumn("section", F.element_at(F.array(*map(F.lit, C.SECTIONS)), F.least(F.col("s"), F.lit(5)) + 1))
        self.items = scratch.keep(C.within_budget(items, self.budget), "items")
        memory = F.when(F.col("key").startswith("m"), F.col("entity"))
        cited = self.items.where("selected").select("q", "pos", memory.alias("memory_id")).join(self.evidence, "memory_id").select("q", "pos", "evidence_id")
        alone = self.alone.where("evidence_id is not null").select("q", F.concat(F.lit("a"), F.col("attempt_id").cast("string")).alias("key"), "evidence_id")
        of_attempt = self.items.where("selected and key like 'a%'").select("q", "pos", "key").join(alone, ["q", "key"]).select("q", "pos", "evidence_id")
        evidence = self.v.evidence_sizes().join(self.validation.select("evidence_id").distinct(), "evidence_id", "left_semi")
        none = F.array().cast("array<string>")
        size = C.item_size(self.name("evidence", F.col("evidence_id")), F.col("content_size"), F.col("kind"), F.lit(None).cast("string"), F.lit(0), F.lit(1), none, none)
        pool = self.validation.join(evidence, "evidence_id").select("q", "p", "evidence_id", size.alias("size"))
        return scratch.keep(experience.with_validation(self.items.select("q", "pos", "section", "size", "cost", "used", "selected"), pool, cited.unionByName(of_attempt), self.budget), "scan")

    def rendered(self, scan: DataFrame) -> DataFrame:
        """(q, pos, section, rendered) of the selected items."""
        chosen = self.items.where("selected").select("q", "pos", "section", "key", "entity", "authority", "path", "i", "n", "cited", "partners")
        evidence = scan.where("selected and evidence_id is not null").join(self.v.evidence().select("evidence_id", "kind"), "evidence_id")
        none = F.array().cast("array<string>")
        more = evidence.select("q", "pos", "section", F.concat(F.lit("e"), F.col("evidence_id").cast("string")).alias("key"), self.name("evidence", F.col("evidence_id")).alias("entity"), F.col("kind").alias("authority"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("n"), none.alias("cited"), none.alias("partners"))
        chosen = scratch.keep(chosen.unionByName(more), "chosen")
        text = T.render_item(F.col("entity"), F.col("content"), F.col("authority"), F.col("path"), F.col("i"), F.col("n"), F.col("cited"), F.col("partners"))
        return chosen.join(self.contents(chosen), "key").select("q", "pos", "section", text.alias("rendered"))


def compiled(v, budget: int = BUDGET) -> DataFrame:
    """(q, text): the portable text of every task's context under the budget."""
    c = Context(v, budget)
    scan = c.scan()
    return C.render(c.rendered(scan), C.totals(scan, v.tasks(), c.excluded), v.tasks())


def preflight(v) -> DataFrame:
    """Categories of every task, each in its order; constraints hold for all tasks and stand once, under task -1."""
    live = state.current(v.memories())
    attempts = relevant_attempts(v)
    memories = relevant_memories(v, attempts)
    related = memories.join(live.select("memory_id", "kind", "epistemic_state", "seq"), "memory_id")
    category = F.when(F.col("kind") == "root_cause", "root_cause").when((F.col("kind") == "lesson") & (F.col("epistemic_state") == "verified"), "lesson").when(F.col("kind") == "pending", "pending").when(F.col("kind") == "invalidation", "invalidation")
    pair = relevance.conflicts(state.open_conflicts(v.conflicts(), v.memories()), memories)
    zero = F.lit(0).cast("long")
    parts = [
        live.where("kind = 'invariant'").select(F.lit(-1).cast("long").alias("q"), F.lit("constraint").alias("category"), F.col("memory_id").alias("entity"), F.col("seq").alias("place")),
        related.select("q", category.alias("category"), F.col("memory_id").alias("entity"), F.col("seq").alias("place")).where("category is not null"),
        attempts.where("outcome <> 'partial'").select("q", F.when(F.col("outcome") == "failed", "known_failure").otherwise("known_success").alias("category"), F.col("attempt_id").cast("string").alias("entity"), F.col("seq").alias("place")).distinct(),
        validation(v, attempts, memories).select("q", F.lit("validation").alias("category"), F.col("evidence_id").cast("string").alias("entity"), F.col("p").cast("long").alias("place")),
        pair.select("q", F.lit("conflict").alias("category"), F.concat_ws(" ", "a", "b").alias("entity"), zero.alias("place")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pos = F.row_number().over(Window.partitionBy("q", "category").orderBy("place", "entity"))
    return out.select("q", "category", "entity", pos.alias("pos"))


def guard(v) -> DataFrame:
    """Skills that apply to a task, failed attempts on their evidence that the task admits, and the evidence to check again."""
    found = relevance.admitted(v.task_tokens(), v.search("skill"), relevance.winner(near(v, "skill"), None, "skill"))
    skills = v.skills().select(F.col("skill_id").alias("id"), "seq", "evidence_id")
    skills = scratch.keep(found.select("q", "id").join(skills, "id"), "skills")
    applied = skills.select("q", "id", "seq").distinct()
    failed = relevance.guard(skills, relevant_attempts(v))
    checks = relevance.first_seen(skills.where("evidence_id is not null").select("q", F.col("seq").alias("place"), F.lit(0).alias("position"), "evidence_id"))
    checks = relevance.validating(checks, v.evidence())
    rows = [("skill", applied, "id", "seq"), ("known_failure", failed, "attempt_id", "seq"), ("validation", checks, "evidence_id", "p")]
    out = None
    for name, df, entity, place in rows:
        part = df.select("q", F.lit(name).alias("category"), F.col(entity).cast("string").alias("entity"), F.col(place).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    pos = F.row_number().over(Window.partitionBy("q", "category").orderBy("place", "entity"))
    return out.select("q", "category", "entity", pos.alias("pos"))
