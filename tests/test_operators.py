"""Small scenarios, sequential restatements of the closed forms, and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import compile as C
from lodestone.operators import retrieval, semantic, state
from lodestone.sources import files, ignore, store
from lodestone.sources.store import KINDS
from lodestone.streaming import watch


def test_budget_stops_at_the_first_item_that_does_not_fit(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(40):
        used, stop, seen, out = 0, False, set(), []
        for pos in range(1, rng.randint(2, 12)):
            section, body = C.SECTIONS[pos // 3], rng.randint(1, 40)
            rows.append((q, pos, section, body))
            price = body + 1 + (len(section) + 1 if section not in seen else 0)
            seen.add(section)
            stop = stop or used + price > 100
            used += 0 if stop else price
            out.append(not stop)
        want[q] = out
    df = C.within_budget(spark.createDataFrame(rows, "q int, pos int, section string, size int"), 100)
    got = {}
    for r in df.orderBy("q", "pos").collect():
        got.setdefault(r.q, []).append(r.selected)
    assert got == want


def test_sufficient_set_equals_a_sequential_walk(spark):
    rng = random.Random(2)
    ranked, tokens, want = [], [], set()
    for q in range(60):
        covered, docs = set(), set()
        for pos in range(1, rng.randint(2, 9)):
            doc, sem, ts = rng.randint(0, 3), rng.random() < 0.4, {rng.randint(0, 5) for _ in range(rng.randint(0, 3))}
            ranked.append((q, pos, doc, sem))
            tokens += [(q, pos, str(t)) for t in ts]
            if pos == 1 or ts - covered or (sem and doc not in docs):
                want.add((q, pos))
                covered |= ts
            docs.add(doc)
    got = C.sufficient(spark.createDataFrame(ranked, "q int, pos int, evidence_id int, semantic boolean"), spark.createDataFrame(tokens, "q int, pos int, token string"))
    assert {(r.q, r.pos) for r in got.collect()} == want


def test_chunks_of_paragraphs_and_hard_cuts(spark):
    long = "word " * 400
    df = spark.createDataFrame([("short\n\ntext",), (f"one\n \ntwo\n\n{long}",), ("",)], "t string").select(T.chunks(F.col("t")).alias("c"))
    a, b, c = (r.c for r in df.collect())
    assert a == ["short\n\ntext"] and b[:2] == ["one", "two"] and all(len(x) <= 1200 for x in b) and "".join(b[2:]).replace(" ", "") == "word" * 400
    assert c == [""]


def test_safe_text_shows_controls(spark):
    df = spark.createDataFrame([("a\tb\\\x1b[0m‮",), ("plain",)], "t string").select(T.terminal_safe(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["a\\tb\\\\\\x1b[0m\\u202e", "plain"]


def test_chunk_ids_round_trip(spark):
    a, b = T.parse_chunk_id(T.chunk_id(F.lit("x#1"), F.lit(7)))
    assert spark.range(1).select(a.alias("a"), b.alias("b")).first() == ("x#1", 7)


def test_winner_needs_margin_unless_alone(spark):
    rows = [(1, 1, 0.5), (1, 2, 0.45), (2, 1, 0.5), (3, 1, 0.5), (3, 2, 0.3)]
    df = spark.createDataFrame(rows, "q int, id int, score double")
    assert sorted(r.q for r in semantic.winner(df, 0.2, 0.08).collect()) == [2, 3]


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        ("*.log", "a/b.log", True), ("/build", "build/x.txt", True), ("/build", "a/build/x", False), ("doc/", "doc/a", True), ("doc/", "doc", False), ("*.md\n!keep.md", "keep.md", False),
        ("tmp/\n!tmp/a", "tmp/a", True), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("[ab].txt", "b.txt", True), ("[!ab].txt", "b.txt", False), ("x?", "xy", True), ("# c\n\n", "c", False),
    ],
)
def test_ignore_patterns(spark, rules, path, want):
    assert spark.range(1).select(ignore.ignored(F.lit(path), ignore.parse(rules)).alias("x")).first().x is want


def test_names(spark):
    df = spark.createDataFrame([("a/.env",), ("README.md",), ("x/README",), ("n/node_modules/a.md",), ("docs/a.txt",), ("my-secret.md",), ("z.egg-info/a.txt",)], "path string")
    assert sorted(r.path for r in files.proposed(df).collect()) == ["README.md", "docs/a.txt"]


def test_unfit_content_is_refused(spark):
    rows = [("a", bytearray(b"ok")), ("b", bytearray(b"\x00x")), ("c", bytearray(b"\xff\xfe")), ("d", bytearray(b" \n")), ("e", bytearray(b"x" * (files.MAX_FILE_BYTES + 1))), ("f", bytearray(b"\x10\x0f"))]
    assert sorted(r.path for r in files.fit_content(spark.createDataFrame(rows, "path string, content binary")).collect()) == ["a", "f"]


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("hi")
    assert [r.path for r in files.read_files(spark, str(tmp_path)).collect()] == ["sub/a.md"]


def test_store_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "c", "file_reference", None)], store.SCHEMAS["evidence"])
    assert store.read(spark, str(tmp_path), "evidence").count() == 0
    for _ in range(2):
        store.append(rows, str(tmp_path), "evidence", ["evidence_id"])
    assert store.read(spark, str(tmp_path), "evidence").count() == 1


def test_old_version_gets_defaults(spark, tmp_path):
    spark.createDataFrame([("m", "e", 0)], "memory_id string, evidence_id string, position int").write.parquet(str(tmp_path / "memory_evidence"))
    assert store.read(spark, str(tmp_path), "memory_evidence").first().role == "related"


def test_rejects_and_bad_arguments(spark):
    rows = [("0" * 32, " ", "note", "inferred"), ("0" * 32, "x", "other", "inferred"), ("z", "x", "note", "inferred"), ("0" * 32, "x", "note", "verified")]
    df = spark.createDataFrame(rows, "memory_id string, content string, kind string, epistemic_state string")
    assert [r.reason for r in store.rejects(df).collect()] == ["blank content", "unknown kind", "malformed id", None]
    with pytest.raises(ValueError):
        state.of_kind(df, "other", KINDS)
    with pytest.raises(ValueError):
        retrieval.recall(df, "", 3)


def test_missing_timeline_target_raises(spark):
    events = spark.createDataFrame([(1, "memory_recorded", "gone")], "sequence long, kind string, subject_id string")
    with pytest.raises(Exception, match="missing memory"):
        state.timeline(events, spark.createDataFrame([], "memory_id string, kind string")).collect()


def test_poll_interval():
    assert [watch.poll_interval(0.01, s) for s in (0, 119, 120, 1799, 1800)] == [2, 2, 10, 10, 60] and watch.poll_interval(0.5, 0) == 25 and watch.poll_interval(9, 200) == 60


def test_capture_goes_on_from_its_checkpoint(spark, tmp_path):
    schema, where = "path string, seq long, digest string", [str(tmp_path / x) for x in ("in", "out", "ck")]
    for batch in ([("p", 1, "A"), ("p", 2, "B")], [("p", 3, "B"), ("p", 4, "A"), ("q", 5, "A")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where[0])
        out = watch.capture_all(spark, where[0], schema, *where[1:])
    assert [r.status for r in out.orderBy("seq").collect()] == ["added", "changed", "unchanged", "changed", "added"]


def test_package_stands_alone(spark):
    import subprocess
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    found = subprocess.run(["grep", "-rlE", "lodestone.llm|corpus_pipeline", "--include=*.py", str(root / "lodestone")], capture_output=True, text=True).stdout.split()
    assert all("/llm/" in f for f in found)
