"""Vector ranking and the admission rules on ranked scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import scratch

#: Queries that are multiplied with the pool at once: some 4 MB of 512 numbers.
QUERY_BLOCK = 1024
# Fixed values: (floor, margin) of single winners and (floor, cap) of sets.
WINNER = {"attempt": (0.50, 0.08), "memory": (0.20, 0.08), "skill": (0.55, 0.10)}
SETS = {"lesson": (0.30, 2), "invariant": (0.35, 2), "document": (0.30, 2)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors to nine places; 0 where one is zero, an error where their lengths differ."""
    norm = lambda v: F.sqrt(dot(v, v))
    same = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(same, F.round(F.try_divide(dot(a, b), norm(a) * norm(b)), 9), F.lit(0.0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    by_norm = lambda x: _let(F.sqrt(dot(x, x)), lambda n: F.transform(x, lambda y: y / F.when(n == 0, F.lit(1.0)).otherwise(n)))
    return _let(v, by_norm)


def _unit(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows in double precision; a zero vector stays as it is, one of another length raises."""
    lengths = set(column.value_lengths().to_pylist())
    if lengths - {size}:
        raise ValueError(f"vectors have {size} numbers, found {sorted(lengths, key=str)}")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1.0, norm)


class Queries:
    """A stated query set (q, query_pool, qv), counted once. Up to QUERY_BLOCK rows go to all tasks as one matrix; more stay a
    table, with the number of their block in ``i``, and meet the pool on a grid of blocks."""

    def __init__(self, queries: DataFrame):
        spark = queries.sparkSession
        self.type, self.block = dict(queries.dtypes)["q"], None
        ids = queries.where("qv is not null").select("q", F.col("query_pool").cast("string").alias("query_pool"), F.col("qv").cast("array<double>").alias("qv"))
        first = ids.limit(QUERY_BLOCK + 1).toArrow()
        self.empty = not first.num_rows
        if first.num_rows <= QUERY_BLOCK:
            self.block = spark.sparkContext.broadcast(first.sort_by("q"))
            return
        stored = scratch.keep(ids, "queries")
        self.n = -(-stored.count() // QUERY_BLOCK)
        self.table = stored.withColumn("i", F.pmod(F.xxhash64("q"), F.lit(self.n)).cast("int"))


def near(queries: DataFrame | Queries, pool: DataFrame, floor: float | None = None, k: int | None = None, within: float | None = None, itself: bool = True) -> DataFrame:
    """(q, id, group, score): the cosines, to nine places, of a stated query set against all rows of its pool.

    pool: (id, pool, group, v), of which eligible rows are filtered before; null vectors match nothing, nor does a
    vector itself (q = id) without ``itself``. Every batch of the pool is one product with a block of queries. Only rows
    come out that reach ``floor``, are among the first ``k`` of a query in a batch or cell and no more than ``within`` below its
    best there; ``top``, ``winner`` or ``cluster_admitted`` pick among these. The pool is read once, whatever the number of queries.
    """
    asked = queries if isinstance(queries, Queries) else Queries(queries)
    key = dict(pool.dtypes)
    rows = pool.where("v is not null").select("id", F.col("pool").cast("string").alias("pool"), "group", F.col("v").cast("array<double>").alias("v"))
    schema = f"q {asked.type}, id {key['id']}, group {key['group']}, score double"
    limits = (floor, k, within, itself)
    if asked.empty:
        return pool.sparkSession.createDataFrame([], schema)
    if asked.block is not None:
        block = asked.block
        return rows.mapInArrow(lambda batches: _batches(block.value, batches, *limits), schema)
    # A cell is a block of queries and a part of the pool; a task has the queries of a cell first and then streams the pool's rows.
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    pool_side = rows.select(F.explode(F.sequence(F.lit(0), F.lit(asked.n - 1))).alias("i"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("j"), F.lit(1).alias("side"), none("q", asked.type), "id", "group", F.col("pool").alias("name"), "v")
    query_side = asked.table.select("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), F.lit(0).alias("side"), "q", none("id", key["id"]), none("group", key["group"]), F.col("query_pool").alias("name"), F.col("qv").alias("v"))
    cells = query_side.unionAll(pool_side).repartition(asked.n * parts, "i", "j").sortWithinPartitions("i", "j", "side")
    return cells.mapInArrow(lambda batches: _cells(batches, *limits), schema)


def _batches(block: pa.Table, batches, *limits):
    """Scores of pool rows (id, pool, group, v) with one block of queries."""
    asked = _Asked(block["q"].combine_chunks(), block["query_pool"].to_pylist(), block["qv"].combine_chunks(), *limits)
    for batch in batches:
        yield from asked.scores(batch.column(0), batch.column(1), batch.column(2), batch.column(3))
        asked.forget()


def _cells(batches, *limits):
    """Scores of the cells (i, j, side, q, id, group, name, v) of a grid, each with its queries before the pool's rows."""
    cell, waiting, asked = None, [], None
    for batch in batches:
        at = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cut = np.concatenate([[0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1, [batch.num_rows]])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e <= s:
                continue
            part, now = batch.slice(s, e - s), tuple(at[:2, s].tolist())
            if now != cell:
                cell, waiting, asked = now, [], None
            if at[2, s] == 0:
                waiting.append(part)
            elif waiting:
                if asked is None:
                    block = pa.Table.from_batches(waiting)
                    asked = _Asked(block["q"].combine_chunks(), block["name"].to_pylist(), block["v"].combine_chunks(), *limits)
                yield from asked.scores(part.column(4), part.column(6), part.column(5), part.column(7))


class _Asked:
    """A block of queries and, over the rows that it has met, the scores that a further row must reach."""

    def __init__(self, q: pa.Array, names: list, vectors: pa.Array, floor: float | None, k: int | None, within: float | None, itself: bool):
        self.q, self.names, self.size = q, np.array(names, dtype=object), len(vectors[0])
        self.v = _unit(vectors, self.size)
        self.floor, self.k, self.within, self.itself = floor, k, within, itself
        self.forget()

    def forget(self) -> None:
        self.best = np.full(len(self.q), -np.inf)
        self.top = np.full((len(self.q), self.k or 0), -np.inf)  # the k best so far, ascending

    def scores(self, ids: pa.Array, pools: pa.Array, groups: pa.Array, vectors: pa.Array):
        if not len(ids):
            return
        own, v = np.array(pools.to_pylist(), dtype=object), _unit(vectors, self.size)
        found = []
        for name in dict.fromkeys(own.tolist()):
            qi, vi = np.flatnonzero(self.names == name) if name is not None else np.zeros(0, int), np.flatnonzero(own == name)
            if not len(qi) or not len(vi):
                continue
            score = np.round(self.v[qi] @ v[vi].T, 9)
            if not self.itself:
                same = np.asarray(ids.take(pa.array(vi)).to_pylist(), dtype=object)
                score[np.asarray(self.q.take(pa.array(qi)).to_pylist(), dtype=object)[:, None] == same[None, :]] = -np.inf
            keep = score > -np.inf if self.floor is None else score >= self.floor
            if self.k is not None:
                both = np.concatenate([self.top[qi], score], axis=1)
                self.top[qi] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :], axis=1)
                keep &= score >= self.top[qi][:, :1]  # ties stay
            if self.within is not None:
                self.best[qi] = np.maximum(self.best[qi], score.max(axis=1))
                keep &= score >= self.best[qi][:, None] - self.within - 2e-9
            x, y = np.nonzero(keep)
            found.append((qi[x], vi[y], score[x, y]))
        if found:
            a, c, s = (np.concatenate(z) for z in zip(*found, strict=True))
            yield pa.record_batch({"q": self.q.take(pa.array(a)), "id": ids.take(pa.array(c)), "group": groups.take(pa.array(c)), "score": pa.array(s)})


def top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def winner(scored: DataFrame, floor: float, margin: float) -> DataFrame:
    """The first of each query where it reaches the floor and leads by the margin; one alone needs no margin."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    out = scored.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)}).where("rank = 1")
    return out.where((F.col("score") >= floor) & (F.col("next").isNull() | (F.round(F.col("score") - F.col("next"), 9) >= margin)))


def admitted_set(scored: DataFrame, floor: float, cap: int) -> DataFrame:
    """At most cap candidates of each query, all above the floor."""
    return top(scored.where(F.col("score") >= floor), cap)


def group_max(scored: DataFrame) -> DataFrame:
    """A document's score is that of its best chunk."""
    return scored.groupBy("q", F.col("group").alias("id")).agg(F.max("score").alias("score"))


def encode_concepts(text: Column, concepts: tuple[str, ...]) -> Column:
    """A deterministic encoder for tests and cold starts: counts of concept words, normalised; a last axis for none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array(*[((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / len(c)).cast("double") for c in concepts])
    none = lambda h: F.concat(h, F.array(F.when(F.forall(h, lambda x: x == 0), F.lit(1.0)).otherwise(F.lit(0.0))))
    return normalise(_let(hits, none))
