"""Operators of the training-corpus subpackage against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, jaccard, language, lines, mixing, packing, quality, registry, sharding, substring, urls, vectors
from lodestone.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, __text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = " ".join(rng.choice(words) for _ in range(120))
    long = "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(900))
    edited = base.split()
    edited[60] = "other"
    texts = [None, "", " \n\t ", "one", "one two", base, base, base.upper(), " ".join(edited), long, long + "\nlast line here", "x" * 50_000, "é ß 漢字 " * 30, "1234 !!"]
    rows = [(i + 1, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, "a", "b") for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", "s1", 1, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_places_every_id_once(spark, docs, odd):
    encoder = packing.byte_bpe()
    for df, weights in ((docs, None), (odd, {"s1": 0.5, "s2": 0.1})):
        rows = packing.pack(df, weights=weights).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        assert sorted(by) == list(range(len(by)))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at == 2048 or at & (at - 1) == 0
        texts = [r.text for r in df.collect()]
        assert sum(r.length for r in rows) == sum(len(encoder.ids(t or "")) + 1 for t in texts)
    ids = {r.doc_id: encoder.ids(r.text or "").tolist() + [1] for r in docs.collect()}
    for r in packing.pack(docs).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
    assert packing.pack(none(spark)).count() == 0


def test_packing_of_many_queues_is_the_same(spark, docs, odd, monkeypatch):
    some = docs.withColumn("source", F.concat("source", F.lit("-"), F.col("doc_id") % 9)).union(docs)
    weights = {some.first().source: 0.3, "web-3": 0.2, "absent": 0.1}
    for df, w in ((some, None), (some, weights), (odd, {"s1": 0.5, "s2": 0.1})):
        want = sorted(packing.pack(df, weights=w).collect(), key=str)
        assert len({r.source_queue for r in want}) > 2
        with monkeypatch.context() as m:
            m.setattr(packing, "QUEUES", 2)
            m.setattr(packing, "SPREAD", 3, raising=False)
            assert sorted(packing.pack(df, weights=w).collect(), key=str) == want


def test_packing_keeps_proportions():
    s = packing.Schedule([100_000, 50_000, 7_000], [100 / 157, 50 / 157, 7 / 157], 2048, 256)
    owner = np.full(157_000, -1)
    for q, total in enumerate(s.total):
        k = np.arange(s.quanta[q])
        for a, pos in zip(k, s.place(np.full(len(k), q), k), strict=True):
            n = min(256, total - a * 256)
            assert (owner[pos : pos + n] == -1).all()
            owner[pos : pos + n] = q
    assert (owner >= 0).all()
    for w in range(157_000 // 2048):
        part = np.bincount(owner[: (w + 1) * 2048], minlength=3) / ((w + 1) * 2048)
        assert np.abs(part - s.total / 157_000).max() * (w + 1) * 2048 <= 3 * 256


def test_tokens_of_special_strings():
    from tokenizers import Tokenizer

    e = packing.byte_bpe()
    t = Tokenizer.from_file(e.path)
    for text in ("a <|endoftext|> b", "  tabs\t\n", "naïve 漢字"):
        assert e.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_sharding_is_minimax(spark, docs, odd):
    for df, shards in ((docs, 40), (docs, 3), (odd, 5)):
        rows = sharding.shard(df, shards).collect()
        sizes, order = Counter(), {}
        for r in rows:
            sizes[r.group_key] += r.size
            order.setdefault(r.group_key, set()).add(r.shard)
        assert all(len(s) == 1 for s in order.values())
        seq = [sizes[k] for k in sorted(sizes)]
        assert [next(iter(order[k])) for k in sorted(sizes)] == sorted(next(iter(order[k])) for k in sizes)

        def fits(c, seq=seq, shards=shards):
            n, used = 1, 0
            for x in seq:
                if x > c:
                    return False
                n, used = (n + 1, x) if used + x > c else (n, used + x)
            return n <= shards

        best = next(c for c in sorted({sum(seq[i:j]) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)}) if fits(c))
        assert max(Counter({s: sum(r.size for r in rows if r.shard == s) for s in range(shards)}).values()) == best
        for s in range(shards):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(none(spark)).count() == 0


def base_features(text):
    w = WORD.findall(text or "")
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice, covered, seen, dup = Counter(runs), set(), set(), 0
    for i, x in enumerate(runs):
        covered |= set(range(i, i + 8)) if twice[x] > 1 else set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_quality_features_and_verdicts(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (docs, odd):
        out = quality.score_quality(df, labels)
        assert set(df.columns) <= set(out.columns) and out.count() == df.count()
        for r in out.collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_features(r.text)
            assert not (r.kept and r.base_failed)
    assert quality.score_quality(none(spark), labels).count() == 0
    assert quality.score_quality(docs, labels.where("false")).where("kept <> (not base_failed)").count() == 0


def bayes_by_hand(train, texts):
    """Languages and probabilities from dictionaries of n-gram buckets, one text at a time."""
    def grams(t):
        t, out = t.lower(), Counter()
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                h = 0
                for j, c in enumerate(t[i : i + n]):
                    h = (h * 0x01000193 + ord(c) * 0x9E3779B1 + j + 1) & 0xFFFFFFFF
                h = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
                out[h >> (32 - language.BITS)] += 1
        return out

    total, rows = defaultdict(Counter), Counter()
    for t, lang in train:
        if t is not None and lang is not None:
            total[lang] += grams(t)
            rows[lang] += 1
    out = []
    for t in texts:
        if not rows or t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        s = {x: np.log(rows[x] / sum(rows.values())) + sum(n * np.log((total[x][g] + language.SMOOTH) / (total[x].total() + language.SMOOTH * language.COLUMNS)) for g, n in grams(t).items()) for x in sorted(rows)}
        best = max(s, key=s.get)
        out.append((best, 1 / sum(np.exp(v - s[best]) for v in s.values())))
    return out


def test_language_accuracy_and_edges(spark, docs, odd):
    model = language.fit(docs.where(~language.held_out()))
    known = {r.doc_id: r.lang for r in docs.collect()}
    out = language.predict(docs.where(language.held_out()), model).collect()
    assert np.mean([r.lang_pred == known[r.doc_id] for r in out]) > 0.95
    found = {r.doc_id: r.lang_pred for r in language.predict(odd, model).collect()}
    assert found[1] == found[2] == found[14] == "und" and found[6] != "und"
    assert language.predict(docs, language.fit(none(spark))).where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language.predict(none(spark), model).count() == 0
    row, _, n = language.counts(["abc def " * 40_000, "", "hi"])
    assert n[row == 0].sum() == 3 * 8 * 40_000 - 3 and n[row == 2].sum() == 3
    assert not language.has_letter("\u00bd \u00b2 \u2163 12") and language.has_letter("1\u00e9")


@pytest.mark.parametrize("at_once", [64, 3])
def test_language_equals_a_model_by_hand_for_any_number_of_languages(spark, docs, monkeypatch, at_once):
    monkeypatch.setattr(language, "AT_ONCE", at_once)
    monkeypatch.setattr(language, "ENTRIES", 500)
    rng = random.Random(11)
    some = [r.text[:300] for r in docs.limit(60).collect()]
    for names, rows in (("ab", 20), ([f"l{i:03}" for i in range(300)] if at_once == 64 else "abcdefgh", 320 if at_once == 64 else 40)):
        train = [(rng.choice(some)[: rng.randrange(20, 90)], names[i % len(names)]) for i in range(rows)] + [(None, names[0]), ("text", None), ("", names[1])]
        texts = [t[:50] for t in some[:12]] + [None, "", "12 \u00bd", "a"]
        model = language.fit(spark.createDataFrame(train, "text string, lang string"))
        got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
        for r, (lang, p) in zip(got, bayes_by_hand(train, texts), strict=True):
            assert abs(r.score - p) < 1e-6 and (r.lang_pred == lang or p < 0.5)


def removed_by_walk(rows, window=20):
    seen, out = set(), {}
    for d, text in sorted(rows):
        w, keep = (text or "").encode().split(), None
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                keep[i : i + window] = [False] * window
            seen.add(x)
        joined = b" ".join(a for a, k in zip(w, keep, strict=True) if k)
        out[d] = (len(w), len(w) - sum(keep), hashlib.sha256(joined).hexdigest())
    return out


def test_substring_equals_a_walk(spark, docs, odd):
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    for df in (docs, some):
        want = removed_by_walk([(r.doc_id, r.text) for r in df.collect()])
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df).collect()}
        assert got == want
        for more in ({"block_bytes": 20_000, "fan": 3, "span": 2}, {"block_bytes": 20_000, "fan": 1, "span": 100}):
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(df, **more).collect()}
            assert got == want
    assert substring.remove_repeats(odd).count() == odd.count()
    assert substring.remove_repeats(none(spark)).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(16)
        for _ in range(c % 7 + 1):
            rows.append(([float(x) for x in centre + 0.02 * rng.standard_normal(16)], c % 3))
    rows += [rows[0], rows[0], (None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), ([], 1), (rows[0][0], None), ([1e300] * 16, 1), (rows[0][0][:8], 0)]
    table = [(i, e, l) for i, (e, l) in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()}
    good = {i: np.array(e) / np.linalg.norm(np.array(e) / 1e10) / 1e10 for i, e, l in table if l is not None and e and None not in e and np.isfinite(e).all() and np.abs(e).max() > 0}
    near = defaultdict(set)
    for i in good:
        for j in good:
            if i != j and table[i][2] == table[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.98:
                near[i].add(j)
    for i, *_ in table:
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert got[i] == (len(near[i]), min(reach))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_raking_meets_margins(spark, docs, odd):
    cells = {(a, b, c): v for (a, b, c), v in zip([(a, b, c) for a in "xy" for b in "pq" for c in "01"], range(1, 9), strict=True)}
    targets = [{"x": 0.5, "y": 0.5}, {"p": 0.2, "q": 0.8}, {"0": 0.6, "1": 0.4}]
    out = mixing.rake(cells, targets)
    for d, t in enumerate(targets):
        for k, v in t.items():
            assert abs(sum(w for key, w in out.items() if key[d] == k) - v) < 1e-6
    p = mixing.inclusion(cells, out, 20)
    assert max(p.values()) <= 1 and abs(sum(p[k] * cells[k] for k in cells) - 20) < 1e-6
    for df in (docs, odd):
        got = mixing.mix_sources(df, share=0.7)
        assert got.count() == df.count() and got.where("probability is null or probability < 0 or probability > 1").count() == 0
    assert mixing.mix_sources(docs).select("doc_id", "sampled").exceptAll(mixing.mix_sources(docs.repartition(7)).select("doc_id", "sampled")).count() == 0
    assert mixing.mix_sources(none(spark)).count() == 0


def test_mixing_of_many_sources_is_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(1, 900), rng.choice("pq"), f"s{min(i, rng.randrange(300))}" if i >= 300 else f"s{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for targets in (None, {"source": {"s299": 0.01, "s7": 0.002, "absent": 0.1}, "lang": {"p": 0.4, "q": 0.6}}):
        got = {r.doc_id: r.probability for r in mixing.mix_sources(df, targets).collect()}
        with monkeypatch.context() as m:
            m.setattr(mixing, "VALUES", 400)
            want = {r.doc_id: r.probability for r in mixing.mix_sources(df, targets).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-6


def test_url_rules_and_templates(spark):
    rows = [("http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/2#t", "a.example.com", "/en/2", "example.com/en/", "block"), ("http://x.com/de/", "x.com", "/de/", "com/", "allow"), ("http://q.net/es/9", "q.net", "/es/9", "net/es/", "block"), ("http://notexample.com/en/3", "notexample.com", "/en/3", "com/", "allow"), ("http://x.com", "x.com", "", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a?b://h.org/p", "h.org", "/p", None, "allow")]
    pages = spark.createDataFrame([(i, r[0], "c") for i, r in enumerate(rows)], "page_id long, url string, host string")
    empty = spark.createDataFrame([], "page_id long, good boolean")
    got = {r.page_id: tuple(r)[1:5] for r in urls.judge_urls(pages, empty).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1:] for r in rows]
    bad = [(i, f"http://h.org/bad/{i}") for i in range(100, 140)] + [(i, f"http://h.org/good/{i}.html") for i in range(200, 240)] + [(i, f"http://h.org/wide/name{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300, 340)]
    marks = spark.createDataFrame([(i, u.split("/")[3] != "bad") for i, u in bad if i % 2], "page_id long, good boolean")
    out = urls.judge_urls(spark.createDataFrame(bad, "page_id long, url string"), marks).collect()
    assert all((r.verdict == "block") == r.path.startswith("/bad/") for r in out)
    assert {r.template for r in out} == {"/bad/{n}", "/good/{n}.html", "/wide/*"}
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), empty).count() == 0


@pytest.mark.parametrize("order", ["ascending", "mixed", "stars"])
def test_components_of_long_chains(spark, order):
    ids = list(range(400))
    if order == "mixed":
        random.Random(7).shuffle(ids)
    edges = list(zip(ids, ids[1:], strict=False)) + [(1000 + i, 1001 + i) for i in range(0, 50, 2)]
    if order == "stars":  # hubs of the largest ids, tied to each other by their smallest leaves
        edges = [(900 - h, h * 20 + i) for h in range(20) for i in range(21)]
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(table, Scratch(spark, "test")).collect()}
    want = {n: 0 for e in edges for n in e if n < 1000} | {1000 + i: 1000 + i - i % 2 for i in range(50) if order != "stars"}
    assert got == want


@pytest.mark.parametrize("children", [20, 80])
def test_a_bad_section_is_judged_apart_at_any_fanout(spark, children):
    names = [f"sec{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(children)]
    rows = [(100 * i + j, f"http://h.org/{n}/{j}", i != 5) for i, n in enumerate(names) for j in range(40 if i == 5 else 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    out = urls.judge_urls(pages, pages.select("page_id", "good")).collect()
    assert all((r.verdict == "block") == r.path.startswith(f"/{names[5]}/") for r in out)
    assert children == 20 or {r.template for r in out} == {f"/{names[5]}/{{n}}", "/*/{n}"}


def test_deep_sections_are_judged_apart(spark):
    rows = [(1000 * d + 100 * g + j, f"http://h.org/{'/'.join('abcdefghi'[:d])}/{'good' if g else 'bad'}/x/{j}", bool(g)) for d in (2, 4, 9) for g in (0, 1) for j in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    out = urls.judge_urls(pages, pages.select("page_id", "good")).collect()
    assert all((r.verdict == "block") == ("/bad/" in r.path) for r in out) and len({r.template for r in out}) == 6


def classes_by_force(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    out = {}
    for d in sorted(sets):
        if d in out:
            continue
        todo, out[d] = [d], d
        while todo:
            a = sets[todo.pop()]
            for e, b in sets.items():
                if e not in out and a and b and den * len(a & b) >= num * len(a | b):
                    out[e] = d
                    todo.append(e)
    return {d: (len(sets[d]), out[d]) for d in sets}


def test_jaccard_against_brute_force(spark, docs, odd):
    rng = random.Random(4)
    words, near = [f"v{i}" for i in range(400)], []
    for c in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(8, 90))]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            near.append((c * 100 + len(near), " ".join(w)))
    made = spark.createDataFrame(near, "doc_id long, text string")
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    for df, k, num, den in ((made, 3, 9, 10), (made, 2, 3, 4), (docs, 5, 4, 5), (some, 3, 9, 10)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, k, num, den).collect()}
        assert got == classes_by_force([(r.doc_id, r.text) for r in df.collect()], k, num, den)
    assert jaccard.near_duplicates(odd).count() == odd.count()
    assert jaccard.near_duplicates(none(spark)).count() == 0


def test_lines_are_whole_and_repeats_go(spark, docs, odd):
    chunked = docs.select("doc_id", "text", lines.let(F.split("text", "\n"), lambda a: lines.chunk_bounds(a)).alias("c")).collect()
    first, spots = {}, []
    for r in sorted(chunked):
        all_lines = r.text.split("\n")
        assert [x for c in r.c for x in range(c.start, c.start + c.length)] == list(range(len(all_lines)))
        for c in r.c:
            t = "\n".join(all_lines[c.start : c.start + c.length])
            if c.length > 1 and t.strip():
                first.setdefault(t, (r.doc_id, c.start))
                spots.append((t, r.doc_id, c))
    gone = defaultdict(set)
    for t, d, c in spots:
        if first[t] != (d, c.start):
            gone[d] |= set(range(c.start, c.start + c.length))
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    for r in chunked:
        assert got[r.doc_id].text == "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id])
        assert got[r.doc_id].n_lines_removed == len(gone[r.doc_id])
    assert sum(map(len, gone.values())) > 0
    out = lines.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[1] is None and kept[2] == "" and len(kept[11]) < 2000 < len(kept[10])
    assert lines.dedup_lines(none(spark)).count() == 0


def test_chunks_survive_an_insertion(spark):
    rng = random.Random(6)
    body = [f"line {rng.random()}" for _ in range(400)]
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new"] + body))], "doc_id long, text string")
    got = {r.doc_id: r.n_lines_removed for r in lines.dedup_lines(df).collect()}
    assert got[1] == 0 and got[2] > 300


def test_copies_of_lines_leave_nothing(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice("abcdefgh") + str(rng.randrange(k)) for _ in range(n)) for n in (*range(2, 60), 65, 66, 129, 130) for k in (1, 10**9)]
    texts += ["\n".join(["same"] * n) for n in (64, 65, 66, 129)]
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(texts))]
    df = spark.createDataFrame(rows + [(i + 1000, t) for i, t in rows], "doc_id long, text string")
    chunks = df.select(F.explode(lines.chunk_bounds(F.split("text", "\n"))).alias("c")).select("c.*")
    assert chunks.where("length < 2").count() == 0
    out = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert [i for i, _ in rows if out[i + 1000].text != "" or out[i + 1000].n_lines_removed != out[i + 1000].n_lines] == []


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        assert out.count() == out.select("doc_id").distinct().count() <= docs.count()
        if name == "ngram_jaccard_join":
            want = classes_by_force([(r.doc_id, r.text) for r in docs.collect()], 5, 4, 5)
            assert {r.doc_id for r in out.collect()} == {d for d, (_, c) in want.items() if d == c}
        docs = out
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    ids = {r.doc_id: packing.byte_bpe().ids(r.text).tolist() + [1] for r in docs.collect()}
    for r in packed.collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_registered_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 14))
