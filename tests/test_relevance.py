"""The stored index, vectors in blocks, components and the parts of preflights and contexts on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import compile as C
from lodestone.operators import graph, index, ordered, relevance, semantic, state
from lodestone.streaming import watch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the", "result"]
    return [(i, " ".join(rng.choice(words[: rng.choice((5, 42))]) for _ in range(rng.randrange(0, 30)))) for i in range(80)]


def test_index_equals_counts_and_survives_batches(spark, tmp_path, corpus):
    df = spark.createDataFrame(corpus, "id long, text string")
    whole = index.Index(spark, str(tmp_path / "a")).append(df)
    parts = index.Index(spark, str(tmp_path / "b"))
    assert parts.batches() == [] and parts.terms().count() == 0
    for cond in ("id < 30", "id < 55", "true", "true"):
        parts.append(df.where(cond))
    assert parts.batches() == [0, 1, 2, 3]
    for table in ("postings", "forward"):
        assert rows(whole.table(table)) == rows(parts.table(table))
    assert rows(whole.terms()) == rows(parts.terms())
    assert rows(parts.rebuild(df.where("id < 5")).table("forward").select("id")) == [(i,) for i in range(5)]
    tokens = {i: [t for t in text.split() if t != "the"] for i, text in corpus}
    df_ = Counter(t for ts in tokens.values() for t in set(ts))
    assert {r.token: (r.df, r.cf) for r in whole.terms().collect()} == {t: (n, sum(ts.count(t) for ts in tokens.values())) for t, n in df_.items()}


def test_words_and_full_text_equal_loops(spark, tmp_path, corpus):
    idx = index.Index(spark, str(tmp_path / "a")).append(spark.createDataFrame(corpus, "id long, text string"))
    tasks = [(0, "w1 w2 w3"), (1, "w30 w31 w32 w33 w1"), (2, "the"), (3, "absent words only"), (4, "w4"), (5, "w0 w1 absent result")]
    q = index.query_tokens(spark.createDataFrame(tasks, "q int, t string"), "q", F.col("t"))
    tokens = {i: [t for t in text.split() if t != "the"] for i, text in corpus}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    lexical, fts = set(), set()
    for k, task in tasks:
        asked = set(task.split()) - {"the", "a"}
        scored = []
        for i, ts in tokens.items():
            both = asked & set(ts)
            if len(both) >= len(asked) // 2 + 1:
                lexical.add((k, i, len(both)))
            if both:
                s = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for t in both)
                scored.append((-round(s, 6), i, len(both), len(set(ts))))
        for _, i, c, size in sorted(scored)[:200]:
            if c >= max(min(len(asked), size) // 2 + 1, (len(asked) // 2 + 1) // 2):
                fts.add((k, i, c))
    assert set(rows(index.lexical(q, idx).select("q", "id", "shared"))) == lexical
    assert set(rows(index.full_text(q, idx))) == fts
    words, full = index.words_and_full_text(q, idx)
    assert set(rows(words)) == {x[:2] for x in lexical} and set(rows(full)) == {x[:2] for x in fts}


def test_bounds_give_the_same_best_records(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join([*(rng.choice(common) for _ in range(rng.randrange(5, 120))), *(rng.choice(rare) for _ in range(rng.randrange(4)))])) for i in range(1500)]
    docs += [(2000 + i, "c0 c1 r5 r6") for i in range(8)] + [(3000, ""), (3001, "nothing of this")]  # ties, and records without a token asked for
    idx = index.Index(spark, str(tmp_path / "i")).append(spark.createDataFrame(docs[:700], "id long, text string")).append(spark.createDataFrame(docs[700:], "id long, text string"))
    tasks = [(0, "c0 c1 r5 r6 r7"), (1, "r1 c2 c3 c4 c5"), (2, "c0"), (3, "absent"), (4, "r10 r11 r12 r13"), (5, " ".join(common))]
    q = index.query_tokens(spark.createDataFrame(tasks, "q int, t string"), "q", F.col("t"))
    every = {}
    for r in index.scored(q, idx).collect():
        every.setdefault(r.q, []).append((-r.score, r.id, r.shared))
    monkeypatch.setattr(index, "DIRECT_PAIRS", 0)
    weights = index._weights(q, idx)
    for cap in (1, 5, 20, 2000):
        want = {(k, i, -s, n, at + 1) for k, rows_ in every.items() for at, (s, i, n) in enumerate(sorted(rows_)[:cap])}
        assert {(r.q, r.id, r.score, r.shared, r["rank"]) for r in index.ranked(q, idx, cap).collect()} == want
        opened = idx.table("postings").join(index._open(weights, idx, index._threshold(weights, idx, cap)), ["token", "band"]).where("q in (0, 1)").count()
        assert opened < (0.2 if cap <= 5 else 1.01) * sum(r.df for r in weights.where("q in (0, 1)").collect())


@pytest.mark.parametrize("block", [1024, 2])
def test_vectors_in_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(semantic, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    v = [(i, str(i % 3), i % 5, [float(x) for x in rng.standard_normal(6) * (i % 4 + 1)]) for i in range(60)] + [(60, "0", 0, None), (61, None, 0, [1.0] * 6), (62, "0", 0, [0.0] * 6)]
    pool = spark.createDataFrame(v, "id long, pool string, group int, v array<double>").repartition(3)
    queries = spark.createDataFrame([r[:2] + r[3:] for r in v if r[0] % 7 == 0], "q long, query_pool string, qv array<double>")
    unit = {r[0]: np.array(r[3]) / (np.linalg.norm(r[3]) or 1) for r in v if r[3]}
    want = {(a, b): round(float(unit[a] @ unit[b]), 9) for a in unit if a % 7 == 0 for b in unit if a != b and v[a][1] == v[b][1] is not None}
    got = {(r.q, r.id): r.score for r in semantic.near(queries, pool, itself=False).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 2e-9
    top = rows(semantic.top(semantic.near(queries, pool, k=2, itself=False), 2).select("q", "id"))
    assert top == sorted((a, b) for a in {a for a, _ in want} for _, b in sorted((-s, b) for (x, b), s in want.items() if x == a)[:2])
    assert {(r.q, r.id) for r in semantic.near(queries, pool, floor=0.3, itself=False).collect()} == {k for k, s in want.items() if s >= 0.3}
    best = {a: max(s for (x, _), s in want.items() if x == a) for a, _ in want}
    close = {(r.q, r.id) for r in semantic.near(queries, pool, within=0.1, itself=False).collect()}
    assert {k for k, s in want.items() if s > best[k[0]] - 0.1} <= close
    with pytest.raises(Exception, match="numbers"):
        semantic.near(queries, pool.unionByName(spark.createDataFrame([(99, "0", 0, [1.0])], pool.schema))).collect()
    assert semantic.near(queries.where("false"), pool).count() == 0


def test_many_queries_meet_the_pool_once_and_never_the_driver(spark, monkeypatch):
    monkeypatch.setattr(semantic, "QUERY_BLOCK", 64)
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.sin(F.col("id") * 7 + k * F.col("id") % 13 + k))
    pool = spark.range(400).select("id", F.lit("p").alias("pool"), F.lit(0).alias("group"), vector.alias("v"))
    asked = semantic.Queries(spark.range(300).select(F.col("id").alias("q"), F.lit("p").alias("query_pool"), vector.alias("qv")))
    assert asked.block is None and asked.n == 5
    out = semantic.top(semantic.near(asked, pool, k=3), 3)
    v = np.array([r.v for r in pool.orderBy("id").collect()])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(v[:300] @ v.T, 9)
    want = {(a, b) for a in range(300) for b in sorted(range(400), key=lambda b: (-score[a, b], b))[:3]}
    got = {(r.q, r.id) for r in out.collect()}
    assert len(got) == 900 and all(score[a, b] >= min(score[a, c] for x, c in want if x == a) for a, b in got)
    plan = semantic.near(asked, pool, k=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 400") == 1 and "Broadcast" not in plan


def test_clusters_of_a_long_chain(spark):
    n = 10_000
    links = [(i, e) for i in range(n) for e in (i, i + 1)] + [(20_000 + i, 50_000) for i in range(300)] + [(30_000, None)]
    got = {r.member: r.cluster for r in graph.clusters(spark.createDataFrame(links, "member long, evidence long")).collect()}
    assert got == {i: 0 for i in range(n)} | {20_000 + i: 20_000 for i in range(300)} | {30_000: 30_000}


def test_places_over_ranges_equal_windows(spark, monkeypatch):
    rng = random.Random(4)
    rows_ = [(rng.choice((0, 0, 0, 1)), rng.randrange(4), rng.random() if rng.random() < 0.3 else 0.0, rng.choice("ab"), rng.randrange(9), i) for i in range(500)]
    df = spark.createDataFrame(rows_, "q int, score long, similarity double, source string, d long, i int").repartition(4)
    want = rows(relevance.placed(df))
    monkeypatch.setattr(ordered, "ORDINARY", 0)
    assert rows(relevance.placed(df)) == want and len(want) == 500


def test_missing_records_stop_a_read(spark):
    links = spark.createDataFrame([(0, 1, 0, "e1"), (0, 2, 0, "gone")], "q int, place int, position int, evidence_id string")
    known = spark.createDataFrame([("e1", "test_result"), ("e2", "tool_output")], "evidence_id string, kind string")
    none = links.where("false")
    assert [r.evidence_id for r in relevance.validation(links.where("place = 1"), none, known).collect()] == ["e1"]
    with pytest.raises(Exception, match="missing evidence gone"):
        relevance.validation(links, none, known).collect()
    memories = spark.createDataFrame([("a", None), ("b", None), ("c", "b")], "memory_id string, supersedes string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "b")], "a string, b string")
    assert [tuple(r) for r in state.open_conflicts(pairs, memories).collect()] == [("a", "c")]
    with pytest.raises(Exception, match="missing memory z"):
        state.open_conflicts(pairs.unionByName(spark.createDataFrame([("a", "z")], "a string, b string")), memories).collect()


def test_null_digests_are_values(spark):
    df = spark.createDataFrame([("p", 1, "A"), ("p", 2, None), ("p", 3, None), ("p", 4, "B"), ("q", 5, None)], "path string, seq int, digest string")
    assert [r.status for r in state.changes(df).orderBy("seq").collect()] == ["added", "changed", "unchanged", "changed", "added"]


def test_capture_of_null_digests_over_triggers(spark, tmp_path):
    schema, where = "path string, seq long, digest string", [str(tmp_path / x) for x in ("in", "out", "ck")]
    for batch in ([("p", 1, "A"), ("p", 2, None)], [("p", 3, None), ("p", 4, "A")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(where[0])
        out = watch.capture_all(spark, where[0], schema, *where[1:])
    assert [r.status for r in out.orderBy("seq").collect()] == ["added", "changed", "unchanged", "changed"]


def test_duplicates_need_equal_evidence(spark):
    m = spark.createDataFrame([(x, "c", "note", "inferred", None, i) for i, x in enumerate("abcde")], "memory_id string, content string, kind string, epistemic_state string, supersedes string, seq int")
    ev = spark.createDataFrame([("a", "x", 0, "related"), ("a", "y", 1, "related"), ("b", "x", 5, "related"), ("b", "y", 7, "related"), ("c", "y", 0, "related"), ("c", "x", 1, "related"), ("d", "x", 0, "related"), ("d", "y", 1, "supporting")], "memory_id string, evidence_id string, position int, role string")
    assert rows(state.first_equivalents(m, ev)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e")]


def test_partners_from_both_ends(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert rows(state.partners(df)) == [("a", ["b", "c"]), ("b", ["a"]), ("c", ["a"])]


def test_first_seen_keeps_the_order_of_sources(spark):
    lessons = spark.createDataFrame([(1, 9, 0, "x"), (1, 9, 1, "y"), (1, 3, 0, "z")], "q int, place int, position int, evidence_id string")
    successes = spark.createDataFrame([(1, 1, 0, "w"), (1, 2, 0, "z")], "q int, place int, position int, evidence_id string")
    got = relevance.first_seen(lessons, successes).orderBy("p").collect()
    assert [r.evidence_id for r in got] == ["z", "x", "y", "w"]


def test_a_document_without_a_hit_gives_its_first_chunk(spark):
    chunks = spark.createDataFrame([(1, "s", i, 2, f"1#{i}", t) for i, t in enumerate((["x"], ["y"]))] + [(2, "s", i, 2, f"2#{i}", ["z"]) for i in range(2)], "d int, source string, i int, n int, c string, tokens array<string>")
    tokens = spark.createDataFrame([(7, 1, "y")], "q int, qn int, token string")
    admitted = spark.createDataFrame([(7, 1), (7, 2)], "q int, d int")
    hits = relevance.chunk_hits(admitted, chunks, tokens)
    assert rows(hits.select("c", "shared")) == [("1#1", 1), ("2#0", 0)]
    vectors = spark.createDataFrame([(7, 2, 0.5)], "q int, id int, score double")
    assert [(r.c, r.similarity, r.semantic) for r in relevance.ordered_evidence(hits, vectors).orderBy("pos").collect()] == [("1#1", 0.0, False), ("2#0", 0.5, True)]


def test_size_equals_the_rendered_text(spark):
    ids = "array<string>"
    cases = [("e1", "a\tb\\", None, None, 0, 1, [], []), ("e2", "x", "verified", "p\n/q", 1, 3, ["a1"], ["m1", "m2"]), ("e3", "", "inferred", "p", 0, 1, ["a1", "a22"], [])]
    df = spark.createDataFrame(cases, f"e string, c string, a string, p string, i int, n int, x {ids}, y {ids}")
    text = T.render_item(*map(F.col, "ecapinxy"))
    size = C.item_size(F.col("e"), F.length(T.terminal_safe(F.col("c"))), *map(F.col, "apinxy"))
    assert all(a == b for a, b in df.select(F.length(text), size).collect())


def test_texts_of_tasks_without_items(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "q int, task string")
    items = C.within_budget(spark.createDataFrame([(1, 1, "HISTORY", 3), (2, 1, "HISTORY", 900)], "q int, pos int, section string, size int"), 40)
    sums = C.totals(items, tasks, spark.createDataFrame([(1, 2)], "q int, n_excluded long"))
    shown = spark.createDataFrame([(1, 1, "HISTORY", "abc")], "q int, pos int, section string, rendered string")
    got = {r.q: r.text for r in C.render(shown, sums, tasks).collect()}
    assert got[1] == "Task: a\n\nHISTORY\nabc\n\n-- 1 of 1 selected; 0 omitted for budget; 2 project invariant(s) not relevant to this task (see: preflight)"
    assert got[2].splitlines()[2:] == ["No compiled items fit within the budget.", "", "-- 0 of 1 selected; 1 omitted for budget"]
    assert got[3].splitlines()[2] == "No compiled context for this task."


@pytest.mark.parametrize("parts, ordinary", [("1", 0), ("7", 0), ("7", 1 << 20)])
def test_ranges_and_windows_equal_loops(spark, monkeypatch, parts, ordinary):
    monkeypatch.setattr(ordered, "ORDINARY", ordinary)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = random.Random(1)
        rows = [(rng.choice("aaaaaaaab"), i, rng.choice("xy")) for i in range(400)] + [(None, 1000, "x"), (None, 1001, None)]
        df = spark.createDataFrame(rows, "path string, seq int, digest string").repartition(3)
        want, last = {}, {}
        for p, i, d in sorted(rows, key=lambda r: r[1]):
            want[i] = "added" if p not in last else "unchanged" if last[p] == d else "changed"
            last[p] = d
        assert {r.seq: r.status for r in state.changes(df).collect()} == want
        slots, seen = {}, Counter()
        for p, i, _ in sorted(rows, key=lambda r: r[1]):
            slots[i] = seen[p] // 5
            seen[p] += 1
        assert {r.seq: r.delay_s for r in watch.write_slots(df.select(F.col("path").alias("bucket"), "seq")).collect()} == slots
        times = spark.createDataFrame([(p, i * 7 % 61, i) for p, i, _ in rows], "path string, s int, seq int").select("path", F.timestamp_seconds("s").alias("ts"), "seq")
        got = Counter((r.path, r.ts.timestamp(), r.n) for r in watch.settled(times, 3.0).collect())
        runs = Counter()
        for p in {p for p, *_ in rows}:
            t = sorted(i * 7 % 61 for q, i, _ in rows if q == p)
            n = 0
            for k, x in enumerate(t):
                n += 1
                if k + 1 == len(t) or t[k + 1] - x >= 3:
                    runs[p, float(x), n] += 1
                    n = 0
        assert got == runs
        assert watch.settled(times.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
