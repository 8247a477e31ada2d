"""The prefix trie against brute force: nulls, ties, repeats, borrowed heads, hot first turns, long conversations, odd tables."""

import hashlib
import zlib

import pytest

from lodestone.llm import conversations, skew

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = (t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest())
            by.setdefault(c, []).append((key, (r, x)))
    own = {c: [turn for _, turn in sorted(v, key=lambda z: z[0])] for c, v in by.items()}
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(rows):
    convs = rebuild(rows)
    members, kids = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[q] for q in below) if below else 1
        saved[p] = sum(saved[q] for q in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted((tuple(r) for r in conversations.rebuilt_trie(df).collect()), key=lambda r: r[:2])


def many():
    rows = []
    for c in range(-12, 90):
        n = (c * 7) % 6 + (17 if c % 31 == 0 else 0)
        for t in range(n):
            text = "hello" if t == 0 and c % 3 else f"turn {t} of {c % 4}" if t < 3 else f"only {c} {t}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return rows


def test_hot_turns_long_conversations_and_borrowed_heads(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SPAN", 4)
    monkeypatch.setattr(conversations, "SPREAD", 3)
    monkeypatch.setattr(skew, "HOT", 8)
    rows = many()
    assert any(not turns for turns in rebuild(rows).values()) and max(map(len, rebuild(rows).values())) > 16
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_one_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(conversations, "SPAN", 16)
    rows = [(5, t, "user", f"t{t % 3}") for t in range(300)] + [(6, t, "user", f"t{t % 3}") for t in range(290)] + [(c, 0, "user", "t0") for c in range(20, 30)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_nulls_ties_repeats_clashes_and_long_texts(spark):
    rows = [
        (0, None, "user", "first"), (0, 0, None, "x"), (0, 0, "user", None), (0, 0, "user", None), (0, 1, "", ""),
        (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "user", "a"), (2, 0, "us", "era"), (2, 0, "user", "a"), (None, 0, "user", "nobody"),
        (7, 0, "user", "ü" * 300_000), (8, 0, "user", "ü" * 300_000), (10, -3, "user", "-"), (2**62, 5, "user", "a"), (-(2**62), 5, "user", "a"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA + ", digest int, BYTES int, name int, n int, Depth int")
    assert found(df) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(3, 0, "user", "a")]])
def test_empty_and_single(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_streamed_digests_of_one_node(spark):
    ends = spark.range(30_000).selectExpr("7L as conv_id", "2L as depth", "id * 3 as member").unionByName(spark.range(50).selectExpr("id as conv_id", "1L as depth", "id as member"))
    out = {(r.conv_id, r.depth): r.ends_sha256 for r in conversations.digest_lists(ends).collect()}
    assert out[7, 2] == hashlib.sha256(",".join(str(i * 3) for i in range(30_000)).encode()).hexdigest()
    assert out[9, 1] == hashlib.sha256(b"9").hexdigest() and len(out) == 51
