"""Clusters, corroboration, promotion, chunk choice, the validation pass, upserts and index states on small tables."""

import pytest

from lodestone.operators import compile as C
from lodestone.operators import experience as X


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("scores", "lessons", "want"),
    [
        ([("a", 0.5), ("b", 0.1), ("c", 0.3)], "b", ["a", "b"]),  # a sibling comes along at any score
        ([("a", 0.5), ("b", 0.49), ("c", 0.3)], "b", ["a", "b"]),  # a sibling is no rival
        ([("a", 0.5), ("b", 0.1), ("c", 0.45)], "b", []),  # another cluster is
        ([("a", 0.25), ("b", 0.1)], "a", []),  # a lesson that speaks reaches the lessons' floor
        ([("a", 0.25), ("b", 0.1)], "b", ["a", "b"]),
        ([("a", 0.5), ("b", 0.4)], "ab", []),  # lessons only
        ([("a", 0.19)], "", []),
        ([], "", []),
    ],
)
def test_cluster_admission(spark, scores, lessons, want):
    scored = spark.createDataFrame([(1, i, s) for i, s in scores], "q int, id string, score double")
    members = spark.createDataFrame([(i, "a" if i in "ab" else i, i in lessons) for i in "abc"], "id string, cluster string, is_lesson boolean")
    assert rows(X.cluster_admitted(scored, members)) == [(1, i) for i in want]


@pytest.mark.parametrize(("score", "words", "attempt", "want"), [(0.1, True, 0.0, 1), (0.1, False, 0.6, 1), (0.1, False, 0.4, 0), (-0.1, True, 0.9, 0)])
def test_corroboration(spark, score, words, attempt, want):
    scored = spark.createDataFrame([(1, "m", score)], "q int, id string, score double")
    ev = spark.createDataFrame([("m", 7)], "id string, evidence int")
    att = spark.createDataFrame([("t", 7), ("u", 8)], "attempt_id string, evidence int")
    lexical = spark.createDataFrame([(1, "t" if words else "u")], "q int, attempt_id string")
    vectors = spark.createDataFrame([("t", [attempt, (1 - attempt**2) ** 0.5]), ("u", [1.0, 0.0])], "attempt_id string, v array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "q int, qv array<double>")
    assert len(rows(X.corroborated(scored, ev, att, lexical, vectors, asked))) == want


def test_promotion_takes_state_and_evidence_from_the_stored_lesson(spark):
    drafts = spark.createDataFrame([("1", "n", "p", ["s"], [], "v"), ("2", "n", "p", ["s"], None, "i"), ("3", "n", "p", [], [], "v"), ("4", "n", "p", ["s", " "], [], "v"), ("5", None, "p", ["s"], [], "v"), ("6", "n", "p", ["s"], [], "x"), ("7", "n", "p", ["s"], [""], "v")], "skill_id string, name string, purpose string, steps array<string>, conditions array<string>, lesson_id string")
    memories = spark.createDataFrame([("v", "lesson", "verified"), ("i", "lesson", "inferred"), ("x", "note", "verified")], "memory_id string, kind string, epistemic_state string")
    cites = spark.createDataFrame([("v", "e2", 1), ("v", "e1", 0)], "memory_id string, evidence_id string, position int")
    got = {r.skill_id: (r.verification_state, r.evidence_ids, r.reason) for r in X.promoted(drafts, memories, cites).collect()}
    assert got["1"] == ("verified", ["e1", "e2"], None) and got["2"] == ("candidate", None, None)
    assert [got[k][2] for k in "34567"] == ["no steps", "blank step", "blank name", "unknown lesson", "blank condition"]


def test_chunk_choice(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 2, 1, 0), (1, 3, 0, 0), (1, 3, 1, 2)], "q int, d int, i int, score int")
    assert rows(X.chosen_chunks(df)) == [(1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 1, 2)]


def test_validation_pass(spark):
    items = C.within_budget(spark.createDataFrame([(1, 1, "HISTORY", 3), (2, 1, "HISTORY", 3), (2, 2, "HISTORY", 99)], "q int, pos int, section string, size int"), 40)
    pool = spark.createDataFrame([(q, p, e, 4) for q in (1, 2) for p, e in enumerate("efg")], "q int, p int, evidence_id string, size int")
    cited = spark.createDataFrame([(1, 1, "e"), (1, 1, "g"), (2, 1, "e")], "q int, pos int, evidence_id string")
    got = X.with_validation(items, pool, cited, 40).where("section = 'VALIDATION'").orderBy("q", "pos").collect()
    # used before: 3 + 1 + 8; the first validation item costs 4 + 1 + 11, the next 4 + 1
    assert [(r.q, r.evidence_id, r.used, r.selected) for r in got if r.q == 1] == [(1, "e", 28, True), (1, "g", 33, True)]
    assert [(r.used, r.selected) for r in got if r.q == 2] == [(None, False)] * 3


def test_upsert_and_index_state(spark):
    stored = spark.createDataFrame([("m", 1, 0), ("m", 2, 0)], "entity_type string, entity_id int, version int")
    new = spark.createDataFrame([("m", 2, 5), ("m", 2, 4), ("m", 3, 1)], "entity_type string, entity_id int, version int")
    assert rows(X.upserted(stored, new, ["entity_type", "entity_id"], "version")) == [("m", 1, 0), ("m", 2, 5), ("m", 3, 1)]
    state = lambda pool, *a: rows(X.index_state(pool, stored, *a))[0][:2]
    assert state(stored, True, "a", "a", True) == ("ready", None) and state(new, True, "a", "a", True) == ("stale", None)
    assert state(stored, False, "a", None, False)[0] == "disabled" and state(stored, True, "a", "b", True)[0] == state(stored, True, "a", "a", False)[0] == "unavailable"
