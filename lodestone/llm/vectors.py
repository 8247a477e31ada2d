"""Near-duplicate vectors by p-stable Euclidean hashing, verified by exact cosine.

A table hashes a normalised vector to the tuple ``floor((a_j . v + b_j) / width)`` of Gaussian projections; vectors of
one tuple and one label share a bucket. Tables are added until a pair at the threshold is missed less often than
MISSED. Equal vectors go on as one. Buckets of one vector are dropped before any vector moves. Large
buckets are cut into blocks, and tasks compare pairs of blocks as matrix products in double precision. A pair that
several tables bring together counts in the first of them alone, as each vector carries its cells in all tables; so no
list of pairs is built or deduplicated.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.scratch import Scratch

WIDTH, MISSED, BLOCK, SEED = 2.0, 0.0001, 1024, 20240229
#: Projections of a table at TEN_THOUSAND vectors; more for more of them, so that chance meetings stay linear.
PROJECTIONS = 16


def _same_cell(distance: float, width: float) -> float:
    """Chance that one projection puts two vectors of this distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections a table and tables, for n vectors."""
    apart = _same_cell(math.sqrt(2.0), WIDTH)  # of vectors at right angles
    k = PROJECTIONS + max(0, math.ceil(math.log(max(1.0, n / 10_000)) / -math.log(apart)))
    near = _same_cell(math.sqrt(max(1e-12, 2 - 2 * threshold)), WIDTH) ** k
    return k, max(1, math.ceil(math.log(MISSED) / math.log(1 - near)))


@lru_cache(maxsize=4)
def _projections(size: int, k: int, tables: int) -> list[tuple]:
    """Directions, offsets and salts of every table, made once a worker."""
    rng = np.random.default_rng((SEED, size))
    salt = np.random.default_rng(SEED).integers(1, 1 << 63, (tables, k), dtype=np.uint64) | np.uint64(1)
    return [(rng.standard_normal((size, k)), rng.random(k) * WIDTH, salt[t]) for t in range(tables)]


def _signatures(v: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 64-bit bucket for each vector (row) and table (column)."""
    out = np.empty((len(v), tables), dtype=np.uint64)
    for t, (a, b, salt) in enumerate(_projections(v.shape[1], k, tables)):
        cell = np.floor((v @ a + b) / WIDTH).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            h = (cell * salt).sum(axis=1, dtype=np.uint64) + np.uint64(t)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out[:, t] = h ^ (h >> np.uint64(29))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1)
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, weight): for each vector a of a block pair the links that it has there, and a vector b that ties it to
    its linked ones. rows: (key, table, left, right, rep, copies, embedding, cells), where a row of both sides has both
    flags, and cells holds a vector's cells in all tables.
    """

    def flush(parts, out):
        ids = np.concatenate([p[0] for p in parts])
        if len(ids) < 2:
            return
        copies, left, right, v, cells = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4, 5))
        table = parts[0][6]
        li, ri = np.flatnonzero(left), np.flatnonzero(right)
        link = v[li] @ v[ri].T >= threshold
        link[ids[li][:, None] == ids[ri][None, :]] = False
        x, y = np.nonzero(link)
        if not len(x):
            return
        for t in range(table):  # a pair counts in the first table that brings it together
            fresh = cells[li[x], t] != cells[ri[y], t]
            x, y = x[fresh], y[fresh]
            if not len(x):
                return
        a, b = li[x], ri[y]
        weight = np.zeros(len(ids), dtype=np.int64)
        np.add.at(weight, a, copies[b])
        if not np.array_equal(li, ri):
            np.add.at(weight, b, copies[a])
        label = ids.copy()
        while True:  # smallest id within the block pair
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            if np.array_equal(new, label):
                break
            label = new
        hit = np.unique(np.concatenate([a, b]))
        out.append((ids[hit], label[hit], weight[hit]))

    def run(batches):
        key, parts = None, []
        for batch in batches:
            out = []
            keys = batch.column(0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            v = _matrix(batch.column(6)) if len(keys) and len(set(batch.column(6).value_lengths().to_pylist())) == 1 else None
            cells = np.frombuffer(b"".join(batch.column(7).to_pylist()), "<i8").reshape(len(keys), -1)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e <= s:
                    continue
                if keys[s] != key:
                    if parts:
                        flush(parts, out)
                    key, parts = keys[s], []
                some = batch.slice(s, e - s)
                parts.append((some.column(4).to_numpy(), some.column(5).to_numpy(), some.column(2).to_numpy(zero_copy_only=False), some.column(3).to_numpy(zero_copy_only=False), v[s:e] if v is not None else _matrix(some.column(6)), cells[s:e], some.column(1)[0].as_py()))
            yield _links(out)
        out = []
        if parts:
            flush(parts, out)
        yield _links(out)

    def _links(out):
        a, b, w = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "weight": pa.array(w, pa.int64())})

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, weight long")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and one length link when their cosine is at least the threshold. A vector that is null, empty
    or zero or holds a null or non-finite component, and one without a label or id, links with nothing and is its own
    component. n_links counts other rows linked directly, component_id is the smallest vec_id that links reach,
    kept says that it is the row's own. Rows that repeat a vec_id with an equal vector count as copies of each other.
    An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    e = F.col("embedding")
    fine = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0)
    real = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"), F.col("label"))
    good = base.where(fine).where(real).withColumn("digest", F.sha2(F.array_join(F.transform("embedding", lambda x: F.hex(F.xxhash64(x + F.lit(0.0)))), ","), 256))
    classes = good.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = scratch.keep(classes.select(F.col("label").cast("string").alias("label"), "digest", "rep", "copies", "embedding"), "classes")
    n = classes.count()
    k, tables = plan(n, threshold)

    def sign(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths().to_pylist())
            for size in np.unique(sizes) if len(sizes) else ():
                some = batch.filter(pa.array(sizes == size))
                for at in range(0, some.num_rows, 2048):
                    part = some.slice(at, 2048)
                    sig = _signatures(_matrix(part.column(2)), k, tables).view(np.int64)
                    yield pa.record_batch({"rep": part.column(0), "label": part.column(1), "embedding": part.column(2), "copies": part.column(3), "size": pa.array([int(size)] * len(sig), pa.int32()), "signature": pa.array(list(sig), pa.list_(pa.int64())), "cells": pa.array([x.tobytes() for x in sig], pa.binary())})

    schema = "rep long, label string, embedding array<double>, copies long, size int, signature array<long>, cells binary"
    signed = scratch.keep(classes.select("rep", "label", "embedding", "copies").mapInArrow(sign, schema), "signed")
    cells = signed.select("rep", F.posexplode("signature").alias("table", "cell"), "label", "size")
    cells = scratch.keep(cells.select("rep", "table", F.xxhash64("table", "cell", "label", "size").alias("bucket")), "cells")
    full = cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = cells.join(full, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("rep", "table", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"))
    rows = members.join(signed.select("rep", "copies", "embedding", "cells"), "rep").select("key", "table", "left", "right", "rep", "copies", "embedding", "cells")
    links = scratch.keep(_compare(rows, threshold), "links")
    label = components(links.select("a", "b"), scratch).toDF("rep", "component")
    weight = links.groupBy(F.col("a").alias("rep")).agg(F.sum("weight").alias("weight"))
    classes = classes.join(label, "rep", "left").join(weight, "rep", "left")
    classes = classes.select(F.col("label").alias("label_text"), "digest", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    usable = fine & real
    marked = base.withColumn("label_text", F.when(usable, F.col("label").cast("string"))).withColumn("digest", F.when(usable, F.sha2(F.array_join(F.transform("embedding", lambda x: F.hex(F.xxhash64(x + F.lit(0.0)))), ","), 256)))
    out = marked.select("vec_id", "label_text", "digest").join(classes, ["label_text", "digest"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors, within their labels, at a cosine of 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
