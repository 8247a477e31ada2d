"""Corpus operators against simulations and loops, their SQL, hot groups, and odd tables through all stages."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestone.llm import hashing, jaccard, lines, mixing, packing, quality, registry, substring, vectors
from tests.llm.test_llm import SF, WORD, base_features, classes_by_force, removed_by_walk

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    _equal(spark, c, name, SF)


def test_vector_sql_on_a_table_with_links(spark, tmp_path):
    """The driver's small tables have no links; here copies, chains and stars do, within labels and across them."""
    rng, rows = np.random.default_rng(12), []
    for base in rng.standard_normal((25, 64)):
        for k in range(6):
            v = base + rng.standard_normal(64) * (0, 0, 0.05, 0.05, 0.08, 0.4)[k]
            rows.append((len(rows), v.astype(np.float32).tolist(), int(len(rows) % 7 > 0)))
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 64, 0), (1003, rows[3][1], None), (1004, [float("nan")] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert _equal(spark, c, "op6_embedding_near_dedup", str(tmp_path)) > 100


def _equal(spark, c, name, sf):
    r = c.execute(registry.oracle_sql()[name])
    names = sorted(d[0] for d in r.description)
    want = r.fetchall()
    df = registry.queries()[name](spark, sf)
    assert sorted(df.columns) == names
    order = [[d[0] for d in r.description].index(n) for n in names]
    got = sorted(tuple(x[n] for n in names) for x in df.collect())
    assert got == sorted(tuple(x[i] for i in order) for x in want)
    return sum(r[names.index("n_links")] for r in got) if "n_links" in names else len(got)


def served_by_rounds(totals, credits, quantum):
    """(queue, quantum) in the order of a round-robin in which deficits carry over."""
    out, deficit, at, r = [], [Fraction(0)] * len(totals), [0] * len(totals), 0
    while any(a * quantum < t for a, t in zip(at, totals, strict=True)):
        r += 1
        for q, t in enumerate(totals):
            deficit[q] += Fraction(credits[q])
            while at[q] * quantum < t:
                size = min(quantum, t - at[q] * quantum)
                if size > deficit[q]:
                    break
                deficit[q] -= size
                out.append((q, at[q], size))
                at[q] += 1
    return out


@pytest.mark.parametrize(("totals", "weights"), [([9000, 5000, 700], [0.171, 0.607, 0.222]), ([5000, 300, 40, 8000], [0.1, 0.3, 0.55, 0.05]), ([1000], [1.0]), ([300, 300, 1], [0.33, 0.34, 0.33])])
def test_schedule_equals_a_simulated_round_robin(totals, weights):
    s = packing.Schedule(totals, weights, 512, 64)
    at = 0
    for q, k, size in served_by_rounds(totals, s.credit.tolist(), 64):
        assert s.place(np.array([q]), np.array([k]))[0] == at
        at += size
    assert at == sum(totals)


def test_early_windows_hold_the_target_shares_for_any_number_of_sources(spark):
    for others in (0, 1200):
        rows = [(i, f"word{i} " * 900, "en", "big") for i in range(40)] + [(100 + i, f"w{i} " * 900, "en", "small") for i in range(10)] + [(1000 + i, "x", "en", f"o{i}") for i in range(others)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        out = packing.pack(df, weights={"big": 0.5, "small": 0.4}).where("sequence_id < 8").groupBy("source_queue").agg(F.sum("length").alias("n")).collect()
        got = {r.source_queue: r.n / (8 * 2048) for r in out}
        assert abs(got["s:big"] / got["s:small"] - 0.5 / 0.4) < 0.12


def xx(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64(data, seed=seed).intdigest()
    return h - (1 << 64) if h >> 63 else h


def pair(a: int, b: int) -> int:
    return xx(b.to_bytes(8, "little", signed=True), xx(a.to_bytes(8, "little", signed=True)) % (1 << 64))


def number(a: int, n: int) -> int:
    return xx(n.to_bytes(4, "little"), xx(a.to_bytes(8, "little", signed=True)) % (1 << 64))


def ratios_by_hand(rows, labels):
    """Ratio and verdict of (doc_id, text) rows by dictionaries."""
    good = {r.doc_id for r in labels if r.quality == 1} - {r.doc_id for r in labels if r.quality != 1}
    fits = {d for d in good if number(d, 11) % 2 == 0}
    grams, raw, target = {}, Counter(), Counter()
    for d, text in rows.items():
        h = [xx(w.encode()) for w in WORD.findall(text or "")]
        grams[d] = [x % quality.BUCKETS for x in h] + [pair(a, b) % quality.BUCKETS for a, b in zip(h, h[1:], strict=False)]
        raw.update(grams[d])
        target.update(grams[d] if d in fits else [])
    t, r = target.total(), raw.total()
    ratio = lambda b: np.float32(math.log((target[b] + 1) / (t + quality.BUCKETS)) - math.log((raw[b] + 1) / (r + quality.BUCKETS)))
    llr = {d: sum(float(ratio(b)) for b in g) / max(1, len(g)) for d, g in grams.items()}
    failed = {d: base_features(text)[-1] for d, text in rows.items()}
    floor = np.percentile([llr[d] for d in good - fits if d in rows and not failed[d]], 100 * quality.MISSED) - quality.MARGIN
    return llr, {d: not failed[d] and llr[d] >= floor for d in rows}


def test_ratio_and_verdict_equal_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    llr, kept = ratios_by_hand({r.doc_id: r.text for r in docs.collect()}, labels.collect())
    seen = Counter()
    for x in quality.score_quality(docs, labels).collect():
        assert abs(x.llr - llr[x.doc_id]) < 1e-5
        assert x.kept == kept[x.doc_id]
        seen[x.kept, x.base_failed] += 1
    assert seen[True, False] and seen[False, True]


def test_filtering_stages_equal_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    _, kept = ratios_by_hand({r.doc_id: r.text for r in rows}, spark.read.parquet(f"{SF}/labels.parquet").collect())
    assert {r.doc_id for r in cp.quality_rules(spark, docs, SF).collect()} == {d for d, k in kept.items() if k}
    p, _ = mixed_by_hand([(r.doc_id, r.text, r.lang, r.source) for r in rows])
    uniform = lambda d: int(hashlib.md5(f"{d}-20240229".encode()).hexdigest()[:13], 16) / 2**52
    close = {r.doc_id for r, x in zip(rows, p, strict=True) if abs(uniform(r.doc_id) - x) < 1e-4}
    got = {r.doc_id for r in cp.mix(spark, docs, SF).collect()}
    assert got - close == {r.doc_id for r, x in zip(rows, p, strict=True) if uniform(r.doc_id) < x} - close and len(close) < 3


def mixed_by_hand(rows, share=0.8, power=0.7, topics=mixing.TOPICS):
    """Probabilities of (doc_id, text, lang, source) rows: topics, raking and inclusion in loops over dictionaries."""
    buckets = {}
    for i, (_, text, *_) in enumerate(rows):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        buckets[i] = [int(hashing.words(pa.array([w]), hashing.LOWER)[0][0] % np.uint64(mixing.BUCKETS)) for w in words]
    together, n = np.zeros((mixing.BUCKETS, mixing.BUCKETS), np.int64), np.zeros(mixing.BUCKETS, np.int64)
    for b in buckets.values():
        for x in b:
            n[x] += 1
        for at in range(0, len(b), mixing.CONTEXT):
            own = sorted(set(b[at : at + mixing.CONTEXT]))
            together[np.ix_(own, own)] += 1
    label, part = mixing.topic_model(together, n, topics)
    cells, of = defaultdict(float), {}
    for i, (_, text, lang, source) in enumerate(rows):
        lift = [((sum(label[x] == t for x in buckets[i]) + mixing.PRIOR_WORDS * part[t]) / part[t]) if part[t] else -1 for t in range(topics)]
        of[i] = (source, lang, max(range(topics), key=lambda t: (lift[t], -t)) if buckets[i] else -1)
        cells[of[i]] += -(-len((text or "").encode()) // 4) + 1
    x, total = {k: v / sum(cells.values()) for k, v in cells.items()}, sum(cells.values())
    wants = []
    for d in range(3):
        own = defaultdict(float)
        for k, v in x.items():
            own[k[d]] += v
        raised = {k: v**power for k, v in own.items()}
        wants.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(400):
        for d, want in enumerate(wants):
            own = defaultdict(float)
            for k, v in x.items():
                own[k[d]] += v
            x = {k: v * want[k[d]] / own[k[d]] for k, v in x.items()}
    low, high = 0.0, 1e6  # the scale at which the expected sample has its size
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cells[k], mid * total * x[k]) for k in cells) < share * total else (low, mid)
    return [min(1.0, low * total * x[of[i]] / cells[of[i]]) for i in range(len(rows))], [of[i][2] for i in range(len(rows))]


def test_mixing_equals_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    p, topic = mixed_by_hand(rows)
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    for (d, *_), want, t in zip(rows, p, topic, strict=True):
        assert got[d].topic == str(t) and abs(got[d].probability - want) < 1e-5
    assert len(set(topic)) > 4


def test_given_shares_are_met(spark):
    rng = random.Random(2)
    rows = [(i, f"{rng.choice('abcdef') * 3} " * rng.randrange(5, 60), rng.choice(["en", "fr"]), rng.choice(["rare"] + ["s0", "s1"] * 5 + [f"o{j}" for j in range(10)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"rare": 0.3, "s0": 0.35, "s1": 0.35}}
    out = mixing.mix_sources(df, targets, strict=True)
    assert [r.met for r in mixing.margins(out, targets).collect()] == [True] * 3
    assert out.where("source like 'o%' and probability > 0").count() == 0
    loose = mixing.mix_sources(df, targets)
    assert mixing.margins(loose, targets).where("not met").count() > 0 and loose.where("source = 'rare' and probability < 1").count() == 0
    assert loose.where("source like 'o%' and probability > 0").count() == 0
    own = mixing.mix_sources(df.withColumn("kind", F.col("doc_id") % 3), {"topic": {"0": 0.5}}, share=0.3, topics="kind", strict=True)
    assert [r.met for r in mixing.margins(own, {"topic": {"0": 0.5}}).collect()] == [True]


def test_topics_stay_when_a_word_is_added(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 600")
    model = spark.sparkContext.broadcast(mixing.topic_model(*mixing.cooccurrences(docs), mixing.TOPICS))
    both = docs.select(mixing.topic_of(F.col("text"), model).alias("a"), mixing.topic_of(F.concat("text", F.lit(" extra")), model).alias("b")).collect()
    assert np.mean([r.a == r.b for r in both]) > 0.95


def test_a_bucket_of_many_blocks_and_recall_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    rows = [centre + 0.1 * (lambda x: x / np.linalg.norm(x))(rng.standard_normal(64)) for _ in range(1500)]  # one dense cluster
    for _ in range(400):  # pairs whose cosine lies just above the threshold
        a, b = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 64)))
        b -= (a @ b) * a
        c = rng.uniform(0.98, 0.985)
        rows += [a, c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)]
    v = np.array(rows)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    found, want = sum(got[i].n_links for i in range(len(v))), int(near.sum())
    assert vectors.BLOCK < 1500 and found <= want and found >= 0.999 * want
    pairs = sum(got[i].n_links for i in range(1500, len(v)))
    assert pairs >= 0.99 * near[1500:].sum() > 700
    assert len({got[i].component_id for i in range(1500)}) == 1


def test_large_groups_of_near_copies(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 6))):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    assert len({t for _, t in rows}) > max(jaccard.PART, jaccard.SLICE)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, 3, 9, 10).collect()}
    assert got == classes_by_force(rows, 3, 9, 10)


def test_rows_of_one_doc_id_are_classed_by_their_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (5, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.group) for r in jaccard.near_duplicates(df).collect())
    assert sorted((d, c) for d, c, _ in got.elements()) == [(1, 1), (5, 1), (5, 1), (5, 5), (7, 5)]
    assert len({g for _, _, g in got}) == 2


def test_near_duplicate_stage_drops_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (None, a), (8, ""), (9, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], COLUMNS)
    got = sorted((r.doc_id or 0, r.text or "") for r in cp.near_duplicates(spark, df, SF).collect())
    assert got == sorted([(1, a), (5, b), (6, c), (0, a), (8, ""), (9, "")])


def test_windows_of_hot_passages_over_ranges(spark):
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(70)]
    rows = []
    for d in range(120):
        w = [f"u{rng.randrange(10**6)}" for _ in range(30)]
        at = rng.randrange(30)
        rows.append((d, " ".join(w[:at] + (hot if d % 3 else hot[: rng.randrange(10, 40)]) + w[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed_by_walk(rows)
    for more in ({}, {"block_bytes": 2000, "fan": 2, "span": 3}):
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, **more).collect()} == want


def test_hot_chunks_are_salted(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 5)
    rows = [(i, f"same one\nsame two\nsame three\nsame four\nown {i}\nown {i + 1000}\nown {i + 2000}") for i in range(60)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_lines_removed == 0 and all(out[i].n_lines_removed >= 2 for i in range(1, 60))
    assert all("own" in out[i].text for i in out)


def test_lines_of_one_doc_id_with_two_texts(spark):
    a, b = "p q\nr s\nt u\nv w", "other\nlines\nhere\nonly"
    out = lines.dedup_lines(spark.createDataFrame([(1, a), (1, b), (1, a), (2, a)], "doc_id long, text string")).collect()
    assert sorted(r.text for r in out if r.doc_id == 1) == sorted([a, b, a]) and [r.text for r in out if r.doc_id == 2] == [""]


CLASHES = ("row", "id", "key", "t", "deal", "spans", "hash", "salt", "start", "c", "s", "l", "n", "probability2", "KEPT", "N_Words", "TOKENS", "n_lines", "ratios", "f", "label_id", "bucket", "group", "doc", "text_hash", "queue", "part")


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    for out in (lines.dedup_lines(wide), mixing.mix_sources(wide), quality.score_quality(wide, labels)):
        names = [c.lower() for c in out.columns]
        assert len(set(names)) == len(names) and out.count() == 30
        kept = next(c for c in CLASHES if c in out.columns and c != "n_lines")
        assert {r[0] for r in out.select(kept).collect()} == {CLASHES.index(kept)}
    assert jaccard.near_duplicates(wide).count() == substring.remove_repeats(wide).count() == 30
    assert packing.pack(wide).select("doc_id").distinct().count() == 30


def test_stages_take_odd_and_empty_tables(spark):
    text = "\n".join(f"line {i} of a text with some words in it" for i in range(40))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, None, "s", None), (3, text, None, "s", None), (None, text, "en", None, 5), (4, "x" * 30_000, "en", "s", 1), (5, text.upper(), "en", "s", 1)]
    for df in (spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], COLUMNS)):
        wide = df.withColumn("deal", F.lit(1)).withColumn("group", F.lit("x"))
        for name, stage in cp.STAGES:
            out = stage(spark, wide, SF)
            assert out.count() <= 1000 and (name == "packing" or out.columns == list(cp.COLUMNS))
            if not df.take(1):
                assert out.count() == 0


def test_scratch_needs_a_shared_folder_off_local_mode():
    from lodestone.llm import scratch

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="share"):
        scratch.shared_dir(Session())

