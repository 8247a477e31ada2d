"""The boundary to text encoders, and the stored vector index with its states."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.experience import index_lines, upserted
from lodestone.sources import log

BATCH = 32
# What keeps an index from being used, or from being whole.
NOT_SET_UP, INCOMPLETE, OTHER_MODEL = "not set up", "the last index build did not finish", "the index was built with a different model"
UNREADABLE, NOT_REFRESHED = "the index is unreadable", "the automatic refresh could not run"


class Encoder:
    """An encoder by name: ``load()`` is called once in a worker and gives a function from texts to a matrix of rows.

    The name identifies the model with its revision and file; an index is only asked with the model that built it.
    """

    def __init__(self, name: str, size: int, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.name, self.size, self.load = name, size, load

    def vectors(self, records: DataFrame) -> DataFrame:
        """(entity_type, entity_id, v) of records (entity_type, entity_id, text), BATCH texts at a time; unit rows."""
        load, size = self.load, self.size

        def run(batches):
            encode = load()
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    some = batch.slice(at, BATCH)
                    v = np.asarray(encode([t or "" for t in some.column(2).to_pylist()]), dtype=np.float64)
                    if v.shape != (some.num_rows, size):
                        raise ValueError(f"the encoder gave {v.shape} for {some.num_rows} texts of {size} numbers")
                    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                    v = (v / np.where(norm == 0, 1.0, norm)).astype(np.float32)
                    yield pa.record_batch({"entity_type": some.column(0), "entity_id": some.column(1), "v": pa.array(list(v), pa.list_(pa.float32()))})

        return records.select("entity_type", "entity_id", "text").mapInArrow(run, "entity_type string, entity_id string, v array<float>")


def concepts(words: tuple[str, ...]) -> Encoder:
    """A deterministic encoder for tests and for use without a model: an axis a concept word, and one for none."""

    def load():
        def encode(texts):
            hits = np.array([[float(t.lower().count(w)) for w in words] for t in texts]).reshape(len(texts), len(words))
            return np.hstack([hits, (hits.sum(axis=1, keepdims=True) == 0).astype(float)])

        return encode

    return Encoder("concepts:" + ",".join(words), len(words) + 1, load)


class VectorIndex:
    """Vectors (entity_type, entity_id, v) below a folder, in generations.

    ``generations/<n>`` says of which model and folders generation n is, and whether its build has ended; it appears whole, and
    one of several writers makes it. Readers have the last one, whatever is written meanwhile. A fault in reading or refreshing
    never ends a search: the index is then empty or as it was, and its state says why.
    """

    def __init__(self, spark: SparkSession, root: str, encoder: Encoder):
        self.spark, self.root, self.encoder = spark, root.rstrip("/"), encoder
        self.fault: str | None = None  # what an attempt to refresh or read met

    def _last(self) -> int:
        return max((int(n) for n in log.names(self.spark, f"{self.root}/generations") if n.isdigit()), default=-1)

    def meta(self) -> dict | None:
        n = self._last()
        return None if n < 0 else json.loads(log.text_of(self.spark, f"{self.root}/generations/{n}"))

    def _publish(self, after: int, **data) -> bool:
        return log.publish(self.spark, f"{self.root}/generations/{after + 1}", json.dumps(data))

    def setup(self, pool: DataFrame) -> VectorIndex:
        """Build the index of all records of the pool anew; a build that breaks off leaves it unavailable, never half read."""
        own = {"model": self.encoder.name, "size": self.encoder.size}
        self._publish(self._last(), **own, ready=False, parts=[])
        part = f"part={uuid.uuid4().hex}"
        self.encoder.vectors(pool).write.parquet(f"{self.root}/{part}")
        while not self._publish(self._last(), **own, ready=True, parts=[part]):
            pass  # a refresh or another build came first; this one is whole and later
        self.fault = None
        return self

    def _broken(self, meta: dict | None) -> str | None:
        if meta is None:
            return NOT_SET_UP
        if not meta.get("ready"):
            return INCOMPLETE
        return OTHER_MODEL if meta["model"] != self.encoder.name or meta["size"] != self.encoder.size else None

    def _read(self, meta: dict) -> DataFrame:
        return self.spark.read.schema("entity_type string, entity_id string, v array<float>").parquet(*[f"{self.root}/{p}" for p in meta["parts"]])

    def stored(self) -> DataFrame:
        """The vectors of a whole build by the present model; empty where there is none or it can't be read."""
        meta = self.meta()
        if self._broken(meta) or self.fault == UNREADABLE:
            return self.spark.createDataFrame([], "entity_type string, entity_id string, v array<float>")
        try:
            return self._read(meta)
        except Exception:  # a folder that is gone
            self.fault = UNREADABLE
            return self.stored()

    def refresh(self, pool: DataFrame) -> int:
        """Encode the records that have no vector yet; returns how many. A fault leaves the index as it was."""
        n, meta = self._last(), self.meta()
        if self._broken(meta):
            return 0
        part = f"part={uuid.uuid4().hex}"
        try:
            self._read(meta).agg(F.sum(F.size("v"))).first()
        except Exception:
            self.fault = UNREADABLE
            return 0
        try:
            missing = pool.join(self._read(meta).select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti")
            self.encoder.vectors(missing).write.parquet(f"{self.root}/{part}")
            added = self.spark.read.parquet(f"{self.root}/{part}").count()
        except Exception:
            self.fault = NOT_REFRESHED
            log.delete(self.spark, f"{self.root}/{part}")
            return 0
        if added and self._publish(n, **{**meta, "parts": [*meta["parts"], part]}):
            return added
        log.delete(self.spark, f"{self.root}/{part}")  # nothing is missing, or another refresh came first
        return 0

    def upsert(self, vectors: DataFrame, order: str) -> DataFrame:
        """Stored vectors with new ones (entity_type, entity_id, v, order) in their place."""
        return upserted(self.stored().withColumn(order, F.lit(None).cast(dict(vectors.dtypes)[order])), vectors, ["entity_type", "entity_id"], order).drop(order)

    def state(self, pool: DataFrame, refreshed: int = 0) -> Row:
        """The row (status, detail, missing, indexed, refreshed, described, retrieval): what the index can do now, with a line for a
        status and one for a result."""
        meta = self.meta()
        broken = self._broken(meta) or (UNREADABLE if self.fault == UNREADABLE else None)
        have = self.stored().select("entity_type", "entity_id").distinct()
        missing = pool.join(have, ["entity_type", "entity_id"], "left_anti")
        rows = missing.agg(F.count("*").alias("missing")).withColumn("indexed", have.agg(F.count("*").alias("n")).scalar())
        if broken:
            rows = rows.select(F.lit("disabled" if meta is None else "unavailable").alias("status"), F.lit(broken).alias("detail"), F.lit(0).cast("long").alias("missing"), F.lit(0).cast("long").alias("indexed"))
        else:
            short = F.col("missing") > 0
            rows = rows.select(F.when(short, "stale").otherwise("ready").alias("status"), F.when(short, NOT_REFRESHED).alias("detail"), "missing", "indexed")
        return index_lines(rows.withColumn("refreshed", F.lit(refreshed).cast("long"))).first()
