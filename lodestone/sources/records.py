"""The records of a store as the source of preflights, guards and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import index
from lodestone.operators.encoder import VectorIndex
from lodestone.operators.index import Index, query_tokens
from lodestone.sources import scratch
from lodestone.sources.store import Store


def pool(store: Store) -> DataFrame:
    """(entity_type, entity_id, text) of all that has a vector: attempts, all memories, skills, chunks of current documents."""
    one = lambda df, kind, key, text: df.select(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), text.alias("text"))
    chunks = store.sources().select("evidence_id", F.posexplode(T.chunks(F.col("content"))).alias("i", "chunk")).select(T.chunk_id(F.col("evidence_id"), F.col("i")).alias("c"), "chunk")
    out = one(store.table("attempts"), "attempt", "attempt_id", F.concat_ws(" ", "task", "approach"))
    out = out.unionByName(one(store.table("memories"), "memory", "memory_id", F.col("content")))
    out = out.unionByName(one(store.table("skills"), "skill", "skill_id", F.concat_ws(" ", "name", "purpose", F.concat_ws(" ", "conditions"))))
    return out.unionByName(one(chunks, "chunk", "c", F.col("chunk")))


class Records:
    """A store and some tasks (q, task), read as ``plans.context`` wants them."""

    prefix: dict = {}

    def __init__(self, store: Store, tasks: DataFrame, vectors: VectorIndex | None = None):
        self.spark, self.store, self._tasks, self.vectors = store.spark, store, tasks, vectors
        self._chunks = None

    def tasks(self) -> DataFrame:
        return self._tasks

    def task_tokens(self) -> DataFrame:
        return query_tokens(self._tasks, "q", F.col("task"))

    def memories(self) -> DataFrame:
        return self.store.ordered("memory")

    def memory_evidence(self) -> DataFrame:
        return self.store.table("memory_evidence")

    def evidence(self) -> DataFrame:
        return self.store.table("evidence").select("evidence_id", "content", "kind")

    def attempts(self) -> DataFrame:
        """A row for each evidence of an attempt, or one with null."""
        return self.store.ordered("attempt").join(self.store.table("attempt_evidence").select("attempt_id", "evidence_id"), "attempt_id", "left")

    def skills(self) -> DataFrame:
        """A row for each evidence of a skill, or one with null."""
        return self.store.ordered("skill").withColumn("evidence_id", F.explode_outer("evidence_ids"))

    def conflicts(self) -> DataFrame:
        return self.store.table("conflicts")

    def chunks(self) -> DataFrame:
        """(d, source, i, n, c, size, tokens, chunk) of the current observation of every path."""
        if self._chunks is None:
            cut = self.store.sources().select(F.col("evidence_id").alias("d"), F.col("path").alias("source"), T.chunks(F.col("content")).alias("chunks"))
            rows = cut.select("d", "source", F.size("chunks").alias("n"), F.posexplode("chunks").alias("i", "chunk"))
            rows = rows.select("d", "source", "i", "n", T.chunk_id(F.col("d"), F.col("i")).alias("c"), "chunk")
            self._chunks = scratch.keep(index.measured(rows), "chunks")
        return self._chunks

    def index(self, kind: str) -> Index:
        return self.store.index(kind)

    search = index

    def chunk_texts(self, wanted: DataFrame) -> DataFrame:
        """(c, chunk) of the chunks ``wanted`` (c), or more."""
        return self.chunks().select("c", "chunk")

    def attempt_sizes(self) -> DataFrame:
        """(attempt_id, content_size): lengths of the safe contents of attempts, a row for each of theirs."""
        return self.attempts().select("attempt_id", T.safe_size(F.concat_ws(" -- ", "task", "approach")).alias("content_size"))

    def evidence_sizes(self) -> DataFrame:
        """(evidence_id, kind, content_size): lengths of the safe contents of evidence."""
        return self.evidence().select("evidence_id", "kind", T.safe_size(F.col("content")).alias("content_size"))

    def pool(self, kind: str) -> DataFrame:
        if kind == "task":
            if self.vectors is None or self.vectors.stored().isEmpty():
                return self._tasks.select(F.col("q").alias("id")).where("false").withColumn("v", F.lit(None).cast("array<float>"))
            asked = self._tasks.select(F.lit("task").alias("entity_type"), F.col("q").cast("string").alias("entity_id"), F.col("task").alias("text"))
            got = self.vectors.encoder.vectors(asked)
            return self._tasks.select(F.col("q").alias("id"), F.col("q").cast("string").alias("entity_id")).join(got, "entity_id").select("id", "v")
        if self.vectors is None:
            out = self.spark.createDataFrame([], "id string, v array<float>")
        else:
            out = self.vectors.stored().where(F.col("entity_type") == kind).select(F.col("entity_id").alias("id"), "v")
        if kind == "chunk":  # of current observations alone
            out = out.join(self.chunks().select(F.col("c").alias("id"), F.col("d").alias("group")), "id")
        return out
