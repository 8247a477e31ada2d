"""Product codes of vectors: integer Lloyd rounds for every part's codebook, with the group bounds of Yinyang k-means.

Components become integers, so means, distances and ties are exact. The codebooks are small and of fixed size: the driver
holds them and gets, each round, one sum a part, entry and component. A vector's assignments and bounds stay beside it in a
table that each round reads and writes once:

- the entries of a codebook are clustered into a few groups, once;
- of each vector part, an upper bound of the distance to its entry is kept, and for each group a lower bound of the
  distances to all its other entries; when entries move, the bounds widen by how far;
- a group is scanned only where its lower bound does not lie above the upper bound, which is made exact before. Scans
  compare integer distances, the lower index first. Bounds are rounded outwards, so no group with an equally near entry is passed over.

Sums of a round are those of the last one and what vectors that changed their entry take away and add.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch
from lodestone.llm.skew import lookup

#: Units of a component, and the components that count: the squares of their distances fit a long.
SCALE, MOST = 4096, 1 << 27
PARTS, ENTRIES, ROUNDS, GROUPS = 8, 16, 6, 4


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries themselves, started from entries far apart."""
    centres = entries[:1].astype(np.float64)
    while len(centres) < min(groups, len(entries)):
        far = ((entries[:, None, :] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, entries[int(far.argmax())]])
    for _ in range(rounds):
        of = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(len(centres)):
            if (of == g).any():
                centres[g] = entries[of == g].mean(0)
    return of


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of all rows of ``x`` to all entries."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for d in range(x.shape[1]):  # one component at a time: memory stays at rows times entries
        gap = x[:, d, None] - entries[None, :, d]
        out += gap * gap
    return out


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(x).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(x).astype(np.float32), np.float32(-np.inf))


class Part:
    """Assignments of one part of many vectors: ``entry``, the bound ``upper`` and the group bounds ``lower``."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower, self.scanned = entry, upper, lower, 0

    @classmethod
    def first(cls, x: np.ndarray, entries: np.ndarray, group: np.ndarray, groups: int) -> Part:
        """All distances, as nothing is known."""
        out = cls(np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), np.full((len(x), groups), -np.inf, np.float32))
        out._scan(x, entries, group, np.arange(len(x)), None)
        return out

    def move(self, x: np.ndarray, before: np.ndarray, entries: np.ndarray, group: np.ndarray) -> None:
        """Assignments to ``entries`` after those to the entries ``before``."""
        drift = _above(((entries - before) ** 2).sum(1))
        drift[(entries == before).all(1)] = 0
        self.upper = np.nextafter(self.upper + drift[self.entry], np.float32(np.inf))
        for g in range(self.lower.shape[1]):
            if (group == g).any() and (most := drift[group == g].max()) > 0:
                self.lower[:, g] = np.nextafter(self.lower[:, g] - most, np.float32(-np.inf))
        near = np.flatnonzero(self.lower.min(1) <= self.upper)
        own = ((x[near] - entries[self.entry[near]]) ** 2).sum(1)
        self.upper[near] = _above(own)
        still = self.lower[near].min(1) <= self.upper[near]
        self._scan(x, entries, group, near[still], own[still])

    def _scan(self, x: np.ndarray, entries: np.ndarray, group: np.ndarray, rows: np.ndarray, own: np.ndarray | None) -> None:
        """Exact distances to the groups that may hold an entry at least as near; own: those to the rows' entries, None at first."""
        never = np.iinfo(np.int64).max
        best, entry = (np.full(len(rows), never), np.full(len(rows), len(entries))) if own is None else (own.copy(), self.entry[rows].copy())
        seen = []
        for g in range(self.lower.shape[1]):
            of = np.flatnonzero(group == g)
            at = np.flatnonzero(self.lower[rows, g] <= self.upper[rows])
            if not len(of) or not len(at):
                continue
            d = _squares(x[rows[at]], entries[of])
            self.scanned += d.size
            seen.append((g, of, at, d))
            low = d.argmin(1)  # the first of equals; ``of`` ascends
            near, name = d[np.arange(len(at)), low], of[low]
            better = (near < best[at]) | ((near == best[at]) & (name < entry[at]))
            best[at[better]], entry[at[better]] = near[better], name[better]
        old = self.entry[rows]
        if own is not None:  # the entry that a row leaves is one of the others of its group now
            left = np.flatnonzero(entry != old)
            where = rows[left], group[old[left]]
            self.lower[where] = np.minimum(self.lower[where], _below(own[left]))
        for g, of, at, d in seen:
            d = np.where(of[None, :] == entry[at][:, None], never, d)
            rest = d.min(1)
            self.lower[rows[at], g] = np.where(rest == never, np.float32(np.inf), _below(rest))
        self.entry[rows], self.upper[rows] = entry, _above(best)

    def pack(self) -> list[np.ndarray]:
        return [self.entry.astype(np.uint8)[:, None].view(np.uint8), np.ascontiguousarray(self.upper[:, None]).view(np.uint8), np.ascontiguousarray(self.lower).view(np.uint8)]

    @classmethod
    def unpack(cls, raw: np.ndarray, groups: int) -> Part:
        upper = np.ascontiguousarray(raw[:, 1:5]).view(np.float32)[:, 0].copy()
        return cls(raw[:, 0].astype(np.int64), upper, np.ascontiguousarray(raw[:, 5 : 5 + 4 * groups]).view(np.float32).copy())


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a byte matrix."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Codebooks:
    """Result of ``compress``: ``rows`` and the final ``entries`` (part, entry, component), empty where no vector counts."""

    def __init__(self, rows: DataFrame, entries: np.ndarray):
        self.rows, self.entries = rows, entries

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> Codebooks:
    """Codes of ``vectors`` (vec_id, embedding, label): rows (vec_id, label, code array<int>, error) and the codebooks.

    Rows whose embedding is null or holds a null or non-finite component are dropped. Components become floor(4096 x); a
    codebook starts from the parts of the rows with the smallest ids, null ids last and equal ids by their vectors, or of all rows
    where they are fewer than ``entries``. Each round assigns every part to its nearest entry, the lower one of equals, and
    moves entries to the componentwise floor of the means; the parts are assigned once more at the end, and error is the sum of those squared
    distances. Repeated rows count each. The length of the vectors is that of the first row that has a positive one which ``parts``
    divides, in that order; rows of another length, or with a component of 2**15 or more, take no part and get null for code and error.
    An empty table gives no rows; other columns are not read.
    """
    if entries > 256:
        raise ValueError("entries are bytes: 256 at most")
    scratch = Scratch(vectors.sparkSession, "codebooks")
    e = F.col("embedding").cast("array<double>")
    real = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = vectors.where(real).select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("v"))
    counts = (F.size("v") > 0) & (F.size("v") % parts == 0) & F.forall("v", lambda x: F.abs(x) < F.lit(MOST / SCALE))
    base = scratch.keep(base.withColumn("counts", counts), "base")
    first = base.where("counts").orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("size")).take(1)
    odd = base.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        return Codebooks(odd, np.zeros((parts, 0, 0), np.int64))
    size, width = first[0].size, first[0].size // parts
    some = F.col("counts") & (F.size("v") == size)
    starts = base.where(some).orderBy(F.asc_nulls_last("vec_id"), "v").select("v").take(entries)
    book = np.floor(np.array([r.v for r in starts]) * SCALE).astype(np.int64).reshape(len(starts), parts, width).transpose(1, 0, 2).copy()
    count = len(starts)
    groups = min(groups, count)
    of = [grouped(b, groups) for b in book]
    state = parts * (5 + 4 * groups)
    label = base.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, x binary, state binary, slot int, value long"

    def assign(x: np.ndarray, raw: np.ndarray | None, before: np.ndarray | None, now: np.ndarray) -> list[Part]:
        out = []
        for p in range(parts):
            own = x[:, p * width : (p + 1) * width]
            if raw is None:
                out.append(Part.first(own, now[p], of[p], groups))
            else:
                part = Part.unpack(raw[:, p * (5 + 4 * groups) : (p + 1) * (5 + 4 * groups)], groups)
                part.move(own, before[p], now[p], of[p])
                out.append(part)
        return out

    def step(before: np.ndarray | None, now: np.ndarray):
        """A round's assignments: the rows with their new state, and at a task's end what it changes in the sums."""

        def run(batches):
            change = np.zeros((parts, count, width + 1), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                if before is None:
                    x = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE).astype(np.int64)
                    kept, old, raw = _bytes_of(x.astype("<i4").view(np.uint8)), None, None
                else:
                    kept = batch.column(2)
                    x, raw = _matrix(kept, "<i4", size).astype(np.int64), _matrix(batch.column(3), np.uint8, state)
                    old = raw.reshape(len(x), parts, -1)[:, :, 0]
                new = assign(x, raw, before, now)
                for p, part in enumerate(new):
                    own = np.concatenate([x[:, p * width : (p + 1) * width], np.ones((len(x), 1), np.int64)], 1)
                    moved = np.arange(len(x)) if old is None else np.flatnonzero(old[:, p] != part.entry)
                    np.add.at(change[p], part.entry[moved], own[moved])
                    if old is not None:
                        np.subtract.at(change[p], old[moved, p].astype(np.int64), own[moved])
                packed = np.concatenate([b for part in new for b in part.pack()], 1)
                yield pa.record_batch([batch.column(0), batch.column(1), kept, _bytes_of(packed), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64())], ["vec_id", "label", "x", "state", "slot", "value"])
            slots = np.flatnonzero(change)
            none = [pa.nulls(len(slots), t) for t in (pa.int64(), kind, pa.binary(), pa.binary())]
            yield pa.record_batch([*none, pa.array(slots, pa.int32()), pa.array(change.ravel()[slots], pa.int64())], ["vec_id", "label", "x", "state", "slot", "value"])

        return run

    kind = _arrow_type(base, "label")
    table, before = base.where(some).select("vec_id", "label", "v"), None
    sums = np.zeros(parts * count * (width + 1), np.int64)
    for k in range(rounds):
        found = scratch.keep(table.mapInArrow(step(before, book), schema), f"round{k}")
        for r in found.where("slot is not null").groupBy("slot").agg(F.sum("value").alias("value")).collect():  # parts * entries * (width + 1) rows
            sums[r.slot] += r.value
        by = sums.reshape(parts, count, width + 1)
        before, used = book, by[:, :, -1:] > 0
        book = np.where(used, by[:, :, :-1] // np.maximum(by[:, :, -1:], 1), book)
        if k:
            scratch.drop(last)
        last, table = found, found.where("slot is null").select("vec_id", "label", "x", "state")

    def finish(batches):
        for batch in batches:
            n = batch.num_rows
            if before is None:
                x, raw = np.floor(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE).astype(np.int64), None
            else:
                x, raw = _matrix(batch.column(2), "<i4", size).astype(np.int64), _matrix(batch.column(3), np.uint8, state)
            code, error = np.zeros((n, parts), np.int32), np.zeros(n, np.int64)
            for p, part in enumerate(assign(x, raw, before, book) if n else ()):
                code[:, p] = part.entry
                error += ((x[:, p * width : (p + 1) * width] - book[p][part.entry]) ** 2).sum(1)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(code.ravel(), pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1), codes, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    out = scratch.keep(table.mapInArrow(finish, f"vec_id long, label {label}, code array<int>, error long"), "codes")
    return Codebooks(out.unionByName(odd.where(~some)), book)


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings in 8 parts of 16 entries after 6 rounds, with the errors of vectors and labels."""
    scratch = Scratch(spark, "codes")
    done = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = done.rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    labels = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    total = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return lookup(rows, labels, ["key"], total).select("vec_id", F.when(F.col("code").isNotNull(), code).alias("code"), "error", "label_error", F.lit(done.sha256()).alias("codebooks_sha256"))
