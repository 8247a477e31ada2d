"""Workspaces, the store's batches, discovery, the watcher, the vector index and the command line, end to end."""

import json
import os
import subprocess
import sys
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import encoder
from lodestone.plans import context
from lodestone.sources import files, ignore, records
from lodestone.sources.store import VERSION, Store, checked, numbered
from lodestone.sources.workspace import Workspace, WorkspaceError
from lodestone.streaming import watch, watcher

MEMORY = "draft_id string, content string, kind string, epistemic_state string, supersedes string, evidence_ids array<string>, supporting_evidence_ids array<string>, recorded_at timestamp"


def at(n):
    return datetime(2024, 1, 1, 0, 0, n)


def memories(spark, *rows):
    full = [(d, c, k, s, sup, ev, su, at(n)) for n, (d, c, k, s, sup, ev, su) in enumerate(rows)]
    return spark.createDataFrame(full, MEMORY)


def evidence(spark, store, *kinds):
    df = spark.createDataFrame([(f"e{i}", f"proof {i}", k, at(i)) for i, k in enumerate(kinds)], "draft_id string, content string, kind string, recorded_at timestamp")
    return [r.id for r in store.add_evidence(df).orderBy("draft_id").collect()]


def test_remember_in_one_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    test, doc = evidence(spark, store, "test_result", "error_observation")
    rows = [
        ("a", "one", "note", "inferred", None, [doc], None), ("b", "one", "note", "inferred", None, [doc], []), ("c", " ", "note", "inferred", None, None, None), ("d", "x", "wish", "inferred", None, None, None),
        ("e", "x", "lesson", "verified", None, [doc], [doc]), ("f", "x", "lesson", "verified", None, [test], None), ("g", "x", "lesson", "verified", None, [doc], [test]), ("h", "x", "lesson", "verified", None, [doc, test], [test]),
        ("i", "x", "note", "inferred", None, ["0" * 32], None), ("j", "x", "note", "inferred", "0" * 32, None, None),
    ]
    got = {r.draft_id: (r.status, r.reason, r.id) for r in store.remember(memories(spark, *rows)).collect()}
    assert {d: g[1] for d, g in got.items() if g[0] == "refused"} == {
        "c": "blank content", "d": "unknown kind", "e": "no supporting evidence of a qualifying kind", "f": "verified without supporting evidence", "g": "supporting evidence outside the evidence", "i": "unknown evidence", "j": "unknown superseded memory",
    }
    assert got["a"][0] == "added" and got["b"] == ("existing", None, got["a"][2]) and got["h"][0] == "added"
    assert [r.role for r in store.table("memory_evidence").where(F.col("memory_id") == got["h"][2]).orderBy("position").collect()] == ["related", "supporting"]
    again = {r.draft_id: (r.status, r.id) for r in store.remember(memories(spark, *rows)).collect()}
    assert again["a"] == ("existing", got["a"][2]) and store.table("memories").count() == 2 and store.table("events").count() == 2
    one = got["a"][2]
    two = {r.draft_id: (r.status, r.reason) for r in store.remember(memories(spark, ("k", "new", "note", "inferred", one, None, None), ("l", "newer", "note", "inferred", one, None, None), ("m", "one", "note", "inferred", None, ["y"], None))).collect()}
    assert two == {"k": ("added", None), "l": ("refused", "already superseded"), "m": ("refused", "unknown evidence")}
    assert {r.draft_id: r.status for r in store.remember(memories(spark, ("n", "one", "note", "inferred", None, [doc], None))).collect()} == {"n": "added"}  # the old one is no longer current
    assert [r.kind for r in store.table("events").orderBy("sequence").collect()] == ["memory_recorded"] * 3 + ["memory_superseded", "memory_recorded"]
    assert [r.sequence for r in store.table("events").orderBy("sequence").collect()] == list(range(5))
    assert store.index("memory").table("forward").count() == 4
    assert [r.content for r in store.ordered("memory").collect()] == ["one", "x", "new", "one"]
    assert store.get("memories", "memory_id", one).content == "one" and store.get("memories", "memory_id", "no") is None


def test_a_broken_batch_is_never_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    evidence(spark, store, "file_reference")
    n = store.batches()[-1]
    os.remove(tmp_path / "s" / "commits" / str(n))
    assert store.table("evidence").count() == 0
    ids = evidence(spark, store, "file_reference", "user_statement")
    assert store.batches() == [n] and {r.evidence_id for r in store.table("evidence").collect()} == set(ids)


def test_malformed_rows_stop_a_read(spark, tmp_path):
    df = spark.createDataFrame([("0" * 32, "c", "wish", "inferred", at(0), None)], "memory_id string, content string, kind string, epistemic_state string, recorded_at timestamp, supersedes string")
    with pytest.raises(Exception, match="malformed row of memories: kind"):
        checked(df, "memories").collect()


def test_old_stores_are_brought_up_to_date(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("a" * 32, "x", "note", "inferred", at(2), None), ("b" * 32, "y", "note", "inferred", at(1), None), ("c" * 32, "z", "note", "inferred", at(3), "b" * 32)]
    old = tmp_path / "s"
    spark.createDataFrame(rows, "memory_id string, content string, kind string, epistemic_state string, recorded_at timestamp, supersedes string").write.parquet(f"{old}/memories/batch=0")
    spark.createDataFrame([("e" * 32, "proof", "document", at(0))], "evidence_id string, content string, kind string, recorded_at timestamp").write.parquet(f"{old}/evidence/batch=0")
    spark.createDataFrame([("a" * 32, "e" * 32, 0)], "memory_id string, evidence_id string, position int").write.parquet(f"{old}/memory_evidence/batch=0")
    (old / "commits").mkdir()
    (old / "commits" / "0").touch()
    assert store.version() == 1 and store.migrate() == VERSION == store.migrate()
    assert [(r.kind, r.subject_id[0]) for r in store.table("events").orderBy("sequence").collect()] == [("memory_recorded", "b"), ("memory_recorded", "a"), ("memory_superseded", "b"), ("memory_recorded", "c")]
    assert [r.content for r in store.ordered("memory").collect()] == ["y", "x", "z"]
    assert [r.kind for r in store.table("evidence").collect()] == ["document_observation"] and [r.role for r in store.table("memory_evidence").collect()] == ["related"]
    assert {r.draft_id: (r.status, r.id) for r in store.remember(memories(spark, ("d", "x", "note", "inferred", None, ["e" * 32], None))).collect()} == {"d": ("existing", "a" * 32)}
    (tmp_path / "s" / "versions" / "9").touch()
    with pytest.raises(ValueError, match="version 9"):
        store.migrate()


def test_numbers_without_gaps(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k").repartition(5)
    assert [r.n for r in numbered(df, ["k"], 10, "n").orderBy("k").collect()] == list(range(10, 1010))


def test_attempts_skills_conflicts_and_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    test, doc = evidence(spark, store, "test_result", "file_reference")
    lesson, other = (r.id for r in store.learn(spark.createDataFrame([("a", "retry fixes the pool", True, None, [test], [test], at(0)), ("b", "pools are slow", False, None, [], [], at(1))], "draft_id string, content string, verified boolean, supersedes string, evidence_ids array<string>, supporting_evidence_ids array<string>, recorded_at timestamp")).orderBy("draft_id").collect())
    assert [(r.kind, r.epistemic_state) for r in store.ordered("memory").collect()] == [("lesson", "verified"), ("lesson", "user_asserted")]
    attempt = "draft_id string, task string, approach string, outcome string, evidence_ids array<string>, recorded_at timestamp"
    out = store.record_attempts(spark.createDataFrame([("a", "t", "p", "failed", [test], at(0)), ("b", "t", "", "failed", [], at(0)), ("c", "t", "p", "won", [], at(0)), ("d", "t", "p", "failed", ["no"], at(0)), ("e", "t", "q", "succeeded", None, at(1))], attempt))
    assert {r.draft_id: r.reason for r in out.collect()} == {"a": None, "b": "blank approach", "c": "unknown outcome", "d": "unknown evidence", "e": None}
    assert [r.approach for r in store.ordered("attempt").collect()] == ["p", "q"]
    skill = "draft_id string, name string, purpose string, steps array<string>, conditions array<string>, lesson_id string, recorded_at timestamp"
    out = store.promote(spark.createDataFrame([("a", "retry", "pool", ["do"], [], lesson, at(0)), ("b", "no", "x", ["do"], [], "missing", at(0))], skill))
    assert {r.draft_id: r.reason for r in out.collect()} == {"a": None, "b": "unknown lesson"}
    kept = store.ordered("skill").first()
    assert kept.verification_state == "verified" and kept.evidence_ids == [test]
    pairs = spark.createDataFrame([(other, lesson, at(1)), (lesson, other, at(0))], "x string, y string, recorded_at timestamp")
    assert store.record_conflicts(pairs).count() == 1 and store.record_conflicts(pairs).count() == 0
    with pytest.raises(ValueError, match="unknown memory"):
        store.record_conflicts(spark.createDataFrame([("x", lesson, at(0))], pairs.schema))
    docs = lambda text, n: spark.createDataFrame([("p.md", text, at(n))], "path string, text string, observed_at timestamp").select("path", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("size_bytes"), "text", "observed_at")
    assert [store.observe(docs(t, n)).first().status for n, t in enumerate("AABA")] == ["added", "unchanged", "changed", "changed"]
    assert store.table("observations").count() == 3 and store.sources().first().content == "A"
    store.rebuild_indexes()
    assert store.index("document").table("forward").count() == 3


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    root = tmp_path / "w"
    (root / "docs" / "deep").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / ".git" / "info").mkdir(parents=True)
    (tmp_path / "config" / "git").mkdir(parents=True)
    (tmp_path / "config" / "git" / "ignore").write_text("global.md\nback.md\n")
    (root / ".git" / "info" / "exclude").write_text("own.md\n")
    (root / ".gitignore").write_text("*.tmp.md\n!back.md\ndocs/hidden/\n")
    (root / "docs" / "hidden").mkdir()
    for name in ("README.md", "global.md", "own.md", "back.md", "a.tmp.md", "docs/a.md", "docs/deep/b.txt", "docs/hidden/c.md", "node_modules/d.md", "my-token.txt", ".env", "main.py"):
        (root / name).write_text(f"text of {name}")
    (tmp_path / "outside.md").write_text("secret")
    os.symlink(tmp_path / "outside.md", root / "link.md")
    os.symlink(root, root / "docs" / "loop")
    return root


def test_discovery(spark, tree):
    assert [r.path for r in files.discovered(spark, tree).collect()] == ["README.md", "back.md", "docs/a.md", "docs/deep/b.txt"]
    assert len(files.listing(tree, 3)) <= 3
    for raw, why in (("link.md", "outside"), (".", "itself"), ("docs", "regular"), (".env", "credential"), ("../outside.md", "outside"), ("none.md", "No such"), (".lodestone/x", "No such")):
        with pytest.raises(files.Refused, match=why):
            files.resolved(tree, raw)
    assert files.resolved(tree, "docs/../README.md") == "README.md"
    rules = ignore.load(tree)
    assert ignore.matches("docs/hidden/x/y.md", rules) and not ignore.matches("back.md", rules)
    both = files.scope(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("b",), ("c",)], "path string"))
    assert sorted(r.path for r in both.collect()) == ["a", "b", "c"]


def test_workspaces(tmp_path):
    w = Workspace.init(tmp_path, "dev")
    assert Workspace.init(tmp_path, "dev").store_id == w.store_id
    assert (tmp_path / ".gitignore").read_text().splitlines().count(".lodestone/") == 1
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert Workspace.discover(tmp_path / "a" / "b").root == w.root
    with pytest.raises(WorkspaceError, match="profile"):
        Workspace.init(tmp_path, "lab")
    for text in ("{", "[]", '{"schema_version": 2}', json.dumps({"schema_version": 1, "profile": "x"}), json.dumps({"schema_version": 1, "profile": "dev", "store_id": "z"})):
        (w.folder / "manifest.json").write_text(text)
        with pytest.raises(WorkspaceError):
            Workspace.open(tmp_path)
    (w.folder / "manifest.json").unlink()
    with pytest.raises(WorkspaceError, match="no manifest"):
        Workspace.open(tmp_path)
    with pytest.raises(WorkspaceError, match="no workspace"):
        Workspace.open(tmp_path / "a")


def test_watching(spark, tree):
    now = [100.0]
    w = Workspace.init(tree, "dev")
    store = w.store(spark)
    eye = watcher.Watcher(spark, w, store, clock=lambda: now[0])
    eye.baseline(retro=False)
    assert eye.tick() == [] and store.table("observations").count() == 0  # what was there before is not observed
    (tree / "README.md").write_text("changed")
    assert eye.tick() == []
    now[0] += 0.5
    (tree / "README.md").write_text("changed again")
    assert eye.tick() == []
    now[0] += 0.9
    assert eye.tick() == []  # a new change waits anew
    now[0] += 0.2
    assert eye.tick() == ["README.md"] and store.sources().first().content == "changed again"
    (tree / "new.md").write_text("new")
    now[0] += 1
    assert eye.tick() == [] and "new.md" not in eye.pending  # discovery runs every ten seconds
    now[0] += 10
    eye.tick()
    now[0] += 1
    assert eye.tick() == ["new.md"]
    (tree / "README.md").write_bytes(b"\x00\x01")
    now[0] += 1
    eye.tick()
    now[0] += 2
    assert eye.tick() == [] and eye.last_error and "README.md" not in eye.pending  # refused for good
    (tree / "new.md").unlink()
    now[0] += 1
    eye.tick()
    assert "new.md" not in eye.known
    for i in range(12):
        (tree / f"many{i:02}.md").write_text(str(i))
    now[0] += 11
    eye.tick()
    now[0] += 1
    assert len(eye.tick()) == 5
    now[0] += 1
    assert len(eye.tick()) == 5  # five a second, none dropped
    (tree / "docs" / "a.md").write_text("while no one watched")
    (tree / "many00.md").write_text("drifted")
    second = watcher.Watcher(spark, w, store, clock=lambda: now[0])
    second.baseline(retro=True)
    assert store.sources().where("path = 'many00.md'").first().content == "drifted" and store.sources().where("path = 'docs/a.md'").count() == 0
    (w.folder / "manifest.json").write_text(json.dumps({"schema_version": 1, "profile": "dev", "store_id": "f" * 32}))
    assert second.tick() == [] and second.stopped


HOLD = "import sys, time; from lodestone.sources.workspace import Workspace; from lodestone.streaming import watcher; print(watcher.acquire(Workspace.open(sys.argv[1])), flush=True); time.sleep(60)"


def test_one_watcher_at_a_time(tmp_path, monkeypatch):
    w = Workspace.init(tmp_path, "dev")
    monkeypatch.setenv("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert watcher.holder(w) is None and watcher.acquire(w) and watcher.acquire(w) and watcher.holder(w) == os.getpid()
    watcher.release(w)
    other = subprocess.Popen([sys.executable, "-c", HOLD, str(tmp_path)], stdout=subprocess.PIPE)
    stranger = subprocess.Popen(["sleep", "60"])
    try:
        assert other.stdout.readline() == b"True\n" and watcher.holder(w) == other.pid
        assert not watcher.acquire(w) and "running" in watcher.status(w)[0]
        started = []
        monkeypatch.setattr(watcher, "spawn", lambda w, fresh: started.append(fresh) or 1)
        assert "already" in watcher.start(w) and watcher.supervise(w) is None
        record = (w.folder / "watch.lock").read_text()
        (w.folder / "watch.lock").write_text(json.dumps({"pid": stranger.pid, "started": 1}))  # a number that went to another process
        assert "has not ended" in watcher.stop(w, 0.3) and stranger.poll() is None
        (w.folder / "watch.lock").write_text(record)
        assert watcher.stop(w) == "stopped" and other.wait(10) != 0
    finally:
        other.kill()
        stranger.kill()
        other.wait()
        stranger.wait()
    watcher.set_enabled(w, True)
    assert watcher.holder(w) is None and "again" in watcher.supervise(w) and started == [False]
    assert watcher.stop(w) == "not watching" and not watcher.enabled(w) and watcher.supervise(w) is None
    assert "process" in watcher.start(w) and started == [False, True]
    with pytest.raises(WorkspaceError):
        watcher.start(Workspace.init(tmp_path / "x", "lab")) if (tmp_path / "x").mkdir() is None else None


def test_aliases_and_temporary_names(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "a.md").write_text("a")
    (tmp_path / "alias").symlink_to(tmp_path / "real")
    (tmp_path / "real" / "loop").symlink_to(tmp_path)
    assert [p for p, _, _ in files.listing(tmp_path)] == ["alias/a.md", "real/a.md"]
    assert [n for n in ("README.md~", ".#x.md", "a.txt.swp", "#b.md#", "notes.tmp", "4913", "README.md", "part.md") if files.is_temporary(n)] == ["README.md~", ".#x.md", "a.txt.swp", "#b.md#", "notes.tmp", "4913"]


def test_settling_as_a_stream(spark, tmp_path):
    rows = [("p", 0), ("p", 400), ("p", 5000), ("q", 100), ("p", 5200), ("q", 9000)]
    for n, batch in enumerate((rows[:3], rows[3:5], rows[5:], [("z", 60_000)])):
        df = spark.createDataFrame([(p, datetime.fromtimestamp(1_700_000_000 + ms / 1000)) for p, ms in batch], "path string, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = watch.settle_stream(stream, 1.0, "10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.path, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("p", 2), ("p", 2), ("q", 1), ("q", 1)]


def test_vector_index_states(spark, tmp_path):
    enc = encoder.concepts(("pool", "auth"))
    pool = spark.createDataFrame([("memory", "a", "pool pool"), ("memory", "b", "auth"), ("skill", "c", None)], "entity_type string, entity_id string, text string")
    v = encoder.VectorIndex(spark, str(tmp_path / "v"), enc)
    assert v.state(pool).status == "disabled" and v.stored().count() == 0 and v.refresh(pool) == 0
    v.setup(pool.where("entity_id <> 'c'"))
    said = v.state(pool)
    assert (said.status, said.missing, said.described) == ("stale", 1, "stale (1 of 3 not indexed; refreshed automatically on next preflight)") and "DEGRADED: 1" in said.retrieval
    assert v.refresh(pool) == 1 and v.refresh(pool) == 0 and v.state(pool, 1).retrieval == "semantic + lexical (refreshed 1)"
    assert {r.entity_id: list(np.round(r.v, 3)) for r in v.stored().collect()} == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1]}
    other = encoder.VectorIndex(spark, str(tmp_path / "v"), encoder.concepts(("x",)))
    assert other.state(pool).retrieval.startswith("lexical only -- semantic retrieval is unavailable: the index was built with a different model")
    assert v._publish(v._last(), **{**v.meta(), "ready": False})
    assert v.state(pool).detail == encoder.INCOMPLETE and v.stored().count() == 0
    bad = encoder.Encoder("bad", 2, lambda: lambda texts: np.zeros((len(texts), 3)))
    with pytest.raises(Exception, match="of 2 numbers"):
        bad.vectors(pool).collect()


def test_vector_index_faults_never_end_a_search(spark, tmp_path):
    pool = spark.createDataFrame([("memory", "a", "pool"), ("memory", "b", "auth")], "entity_type string, entity_id string, text string")

    def failing():
        raise OSError("no model")

    v = encoder.VectorIndex(spark, str(tmp_path / "v"), encoder.concepts(("pool", "auth"))).setup(pool.where("entity_id = 'a'"))
    offline = encoder.VectorIndex(spark, str(tmp_path / "v"), encoder.Encoder(v.encoder.name, v.encoder.size, failing))
    assert offline.refresh(pool) == 0 and offline.stored().count() == 1
    assert offline.state(pool).retrieval == "semantic + lexical -- DEGRADED: 1 record(s) not indexed (the automatic refresh could not run; run: lodestone semantic-setup)"
    late = encoder.VectorIndex(spark, str(tmp_path / "v"), v.encoder)
    meta = late.meta()
    assert v.refresh(pool) == 1 and not late._publish(late._last() - 1, **meta)  # of two that refresh one generation, one is published
    [part] = meta["parts"]
    for f in (tmp_path / "v" / part).glob("part-*"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "v" / part).glob(".*.crc"):
        f.unlink()
    broken = encoder.VectorIndex(spark, str(tmp_path / "v"), v.encoder)
    assert broken.refresh(pool) == 0 and broken.stored().count() == 0
    assert broken.state(pool).retrieval == "lexical only -- semantic retrieval is unavailable: the index is unreadable (delete the index, then run: lodestone semantic-setup)"
    assert broken.setup(pool).state(pool).described == "ready (2 indexed)"


@pytest.fixture
def told(tmp_path, spark):
    def tell(*argv):
        return cli.run(["--root", str(tmp_path / "w"), *argv])

    (tmp_path / "w").mkdir()
    tell("init", "dev")
    return tell


def ids(lines):
    return [x.split("[")[1].split("]")[0] for x in lines if "[" in x]


def test_commands_tell_an_auth_refresh_story(told, tmp_path):
    assert told("recall", "x") == ["No memories found."] and told("skills") == ["No skills are recorded."]
    [error] = ids(told("evidence-add", "401 after the token refresh", "--kind", "command_output"))
    [passed] = ids(told("evidence-add", "auth tests pass", "--kind", "test_result"))
    [failed] = ids(told("attempt", "--task", "fix auth token refresh", "--approach", "retry the request", "--outcome", "failed", "--evidence", error))
    [cause] = ids(told("remember", "the clock of the client drifts", "--kind", "root_cause", "--evidence", error))
    [won] = ids(told("attempt", "--task", "fix auth token refresh", "--approach", "renew before expiry", "--outcome", "succeeded", "--evidence", passed))
    [lesson] = ids(told("learn", "renew the auth token before it expires", "--verified", "--supporting", passed))
    assert ids(told("learn", "renew the auth token before it expires", "--verified", "--supporting", passed)) == [lesson]
    [rule] = ids(told("remember", "never log an auth token", "--kind", "invariant"))
    [far] = ids(told("remember", "releases go out on mondays", "--kind", "invariant"))
    told("remember", "decided to renew auth token refresh early", "--kind", "decision")
    (tmp_path / "w" / "auth.md").write_text("How auth token refresh works.\n\nThe token lives for an hour.")
    assert told("seed") == ["new: auth.md"] and told("seed", "auth.md", "none.md")[0] == "added: auth.md"
    assert told("seed") == ["unchanged: auth.md"] and told("sources")[0].startswith("auth.md ")
    out = told("preflight", "auth token refresh")
    assert out[0].startswith("Retrieval: lexical only") and {failed, cause, won, lesson, rule, far, passed} <= set(ids(out))
    text = "\n".join(told("context", "auth token refresh"))
    assert rule in text and far not in text and "1 project invariant(s)" in text and "PROJECT EVIDENCE" in text and f"from attempt [{failed}]" in text
    assert text.index("CONSTRAINTS") < text.index("LESSONS") < text.index("DECISIONS") < text.index("PROJECT EVIDENCE") < text.index("HISTORY") < text.index("VALIDATION")
    assert told("export", "auth token refresh")[0].startswith("Task: auth token refresh\n\nCONSTRAINTS")
    assert "No compiled items fit" in "\n".join(told("context", "auth token refresh", "--budget", "5"))
    assert "ready" in told("semantic-setup")[0] and told("preflight", "auth token refresh")[0] == "Retrieval: semantic + lexical"
    told("remember", "one more", "--supersedes", rule)
    assert any("(superseded)" in x for x in told("timeline")) and told("preflight", "auth")[0] == "Retrieval: semantic + lexical (refreshed 1)"
    said = told("status")
    assert "Memories: 6" in said and "Invariants: 1" in said
    assert told("watch", "status") == ["Watcher: off"] and told("watch", "stop") == ["not watching"]
    with pytest.raises(ValueError, match="qualifying"):
        told("learn", "x", "--verified", "--supporting", ids(told("evidence-add", "doc", "--kind", "document_observation"))[0])


def test_guard_needs_skill_evidence_and_words(spark, tmp_path, told):
    w = Workspace.open(tmp_path / "w")
    store = w.store(spark)
    e1, e2 = evidence(spark, store, "test_result", "command_output")
    [lesson] = ids(told("learn", "connection pool retries", "--verified", "--supporting", e1))
    store.promote(spark.createDataFrame([("a", "retry connection pool", "pool timeouts", ["do"], ["db"], lesson, at(0))], "draft_id string, name string, purpose string, steps array<string>, conditions array<string>, lesson_id string, recorded_at timestamp"))
    [a] = ids(told("attempt", "--task", "retry connection pool", "--approach", "sleep", "--outcome", "failed", "--evidence", e1))
    told("attempt", "--task", "retry connection pool", "--approach", "other", "--outcome", "failed", "--evidence", e2)
    told("attempt", "--task", "paint the shed", "--approach", "green", "--outcome", "failed", "--evidence", e1)
    out = context.guard(records.Records(store, spark.createDataFrame([(0, "retry connection pool")], "q long, task string"))).collect()
    assert [r.entity for r in out if r.category == "known_failure"] == [a] and [r.entity for r in out if r.category == "validation"] == [e1]
    assert sum(r.category == "skill" for r in out) == 1
    assert told("guard", "unrelated words")[1:] == ["No relevant experience found."]


def test_errors_go_to_the_other_stream(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(cli.__file__)))
    r = subprocess.run(["python", "-m", "lodestone.cli", "--root", str(tmp_path), "status"], capture_output=True, text=True, cwd=root, timeout=120)
    assert r.returncode == 1 and r.stdout == "" and "no workspace" in r.stderr
