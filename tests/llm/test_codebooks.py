"""Vector codes against plain integer Lloyd rounds: ties, repeats, nulls, odd lengths and large components; what the bounds skip."""

import hashlib
import math

import numpy as np
import pytest

from lodestone.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(rows, parts=8, entries=16, rounds=6):
    kept = [(v, label, [math.floor(4096 * float(np.float32(x))) for x in e]) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    x = np.array([k[2] for k in kept], dtype=np.int64).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][2]))[:entries]
    book = x[first].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(book.shape[1]):
                if (own := at[:, p] == e).any():
                    book[p, e] = x[own, p].sum(0) // own.sum()
    at, d = assign()
    error, by_label = d.sum(1).tolist(), {}
    for k, e in zip(kept, error, strict=True):
        by_label[k[1]] = by_label.get(k[1], 0) + e
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(((k[0] if k[0] is not None else -1, "".join(f"{c:02x}" for c in a), e, by_label[k[1]], sha) for k, a, e in zip(kept, at, error, strict=True)))


def query(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(4).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    out = codebooks.op13_vector_codes(spark, str(path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) if r[0] is not None else (-1, *r[1:]) for r in out.collect()))


def test_ties_repeats_and_nulls(spark, tmp_path):
    rng = np.random.default_rng(3)
    grid = (rng.integers(-3, 4, (300, 16)) / 4096).tolist()  # few values: many ties
    rows = [(i, v, None if i % 11 == 0 else i % 3) for i, v in enumerate(grid)]
    rows += [(5, grid[5], 1), (5, grid[6], 1), (None, grid[7], 0), (None, grid[7], None)]
    rows += [(-1000, None, 1), (-999, [float("nan")] * 16, 1), (-998, [None] * 16, 1), (-997, [float("inf")] * 16, 1)]
    assert query(spark, rows, tmp_path) == lloyd(rows)


def test_negative_means_are_floors_and_hot_labels(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, v, 0) for i, v in enumerate((rng.standard_normal((500, 64)) * 0.2 - 0.1).astype(np.float32).tolist())]
    assert query(spark, [(*r, "x") for r in rows], tmp_path, SCHEMA + ", CODE string") == lloyd(rows)


@pytest.mark.parametrize("n", [0, 1, 5, 17])
def test_fewer_rows_than_entries(spark, tmp_path, n):
    rows = [(i, [float(i % 4)] * 8, None) for i in range(n)]
    assert query(spark, rows, tmp_path) == (lloyd(rows) if n else [])


def test_rows_of_other_lengths_and_large_components_get_no_code(spark, tmp_path):
    fine = [(i, [float(i)] * 8, 1) for i in range(10, 30)]
    odd = [(1, [1.0] * 7, 1), (2, [], 1), (40, [1.0] * 16, 1), (3, [1e30] * 8, 1)]
    out = query(spark, fine + odd, tmp_path)
    assert [r for r in out if r[1] is not None] == lloyd(fine)
    assert {r[0]: r[1:3] for r in out if r[1] is None} == {i: (None, None) for i in (1, 2, 3, 40)}
    assert all(r[1] is None for r in query(spark, odd[:2], tmp_path))


def test_bounds_skip_scans_and_never_a_nearest_entry():
    rng = np.random.default_rng(11)
    centres = rng.integers(-3000, 3000, (16, 8))
    x = (centres[rng.integers(0, 16, 4000)] + rng.integers(-200, 200, (4000, 8))).astype(np.int64)
    book = x[:16].copy()
    of = codebooks.grouped(book, 4)
    part, scanned = codebooks.Part.first(x, book, of, 4), []
    for _ in range(8):
        d = codebooks._squares(x, book)
        assert np.array_equal(part.entry, d.argmin(1))
        for g in range(4):  # every bound holds
            others = np.where((of[None, :] == g) & (np.arange(16)[None, :] != part.entry[:, None]), d, np.iinfo(np.int64).max).min(1)
            assert (part.lower[:, g].astype(float) <= np.sqrt(others.astype(float))).all()
        assert (part.upper >= np.sqrt(d.min(1))).all()
        moved = book.copy()
        for e in range(16):
            if (part.entry == e).any():
                moved[e] = x[part.entry == e].sum(0) // (part.entry == e).sum()
        part = codebooks.Part.unpack(np.concatenate(part.pack(), 1), 4)
        part.move(x, book, moved, of)
        scanned.append(part.scanned)
        book = moved
    assert min(scanned) < 0.5 * x.shape[0] * 16
