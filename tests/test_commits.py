"""Commits, lookups and following indexes: breaks at each step, writers at the same time, and what a write reads."""

import json
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators.index import Index
from lodestone.sources import log
from lodestone.sources.store import Store

MEMORY = "draft_id string, content string, kind string, epistemic_state string, supersedes string, evidence_ids array<string>, supporting_evidence_ids array<string>, recorded_at timestamp"


def drafts(spark, *rows):
    return spark.createDataFrame([(d, c, "note", "inferred", sup, [], [], datetime(2024, 1, 1, 0, 0, n)) for n, (d, c, sup) in enumerate(rows)], MEMORY)


def state_of(store):
    found = {c: sorted(map(tuple, store.table(c).drop("event_id").collect())) for c in ("memories", "events")}
    return found, sorted(r.id for r in store.index("memory").table("forward").collect())


def test_one_file_one_writer(spark, tmp_path):
    assert log.publish(spark, f"{tmp_path}/c/0", "one") and not log.publish(spark, f"{tmp_path}/c/0", "two")
    assert log.text_of(spark, f"{tmp_path}/c/0") == "one" and log.names(spark, f"{tmp_path}/c") == ["0"]


@pytest.mark.parametrize("step", ["rows", "publish", "index rows", "index publish"])
def test_a_break_and_a_rerun_give_equal_store_and_index(spark, tmp_path, monkeypatch, step):
    good, broken = Store(spark, f"{tmp_path}/good"), Store(spark, f"{tmp_path}/broken")
    batch = drafts(spark, ("a", "one two", None), ("b", "three", None))
    for store in (good, broken):
        store.remember(drafts(spark, ("z", "zero", None)))
        store.index("memory")
    good.remember(batch)

    def stop(*_, **__):
        raise RuntimeError("broken off")

    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="broken off"):
        m.setattr(*{"rows": (Store, "_write", stop), "publish": (log, "publish", stop), "index rows": (Index, "apply", stop), "index publish": (log, "publish", _fails_on("applied", stop))}[step])
        broken.remember(batch)
        broken.index("memory")
    again = {r.status for r in broken.remember(batch).collect()}
    assert again == ({"added"} if step in ("rows", "publish") else {"existing"})
    assert state_of(broken) == state_of(good)


def _fails_on(part, stop):
    real = log.publish
    return lambda spark, path, text: stop() if f"/{part}/" in path else real(spark, path, text)


def test_a_write_that_comes_second_is_checked_again(spark, tmp_path, monkeypatch):
    one, two = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/s")
    target = one.remember(drafts(spark, ("t", "target", None))).first().id
    real, calls = log.publish, []

    def between(spark_, path, text):
        if "/commits/" in path and not calls:
            calls.append(path)
            two.remember(drafts(spark, ("b", "same text", None), ("c", "new target", target)))
        return real(spark_, path, text)

    monkeypatch.setattr(log, "publish", between)
    got = {r.draft_id: (r.status, r.reason) for r in one.remember(drafts(spark, ("x", "same text", None), ("y", "newer target", target), ("w", "own", None))).collect()}
    assert got == {"x": ("existing", None), "y": ("refused", "already superseded"), "w": ("added", None)}
    assert sorted(r.sequence for r in one.table("events").collect()) == list(range(5)) and one.table("memories").count() == 4
    assert one.batches() == [0, 1, 2] and sorted(r.content for r in one.table("memories").collect()) == ["new target", "own", "same text", "target"]


WRITER = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.driver.memory", "700m").getOrCreate()
sys.path.insert(0, sys.argv[2])
from tests.test_commits import drafts
from lodestone.sources.store import Store
n = sys.argv[3]
store = Store(spark, sys.argv[1])
print([r.status for r in store.remember(drafts(spark, ("same" + n, "the same", None), ("own" + n, "own " + n, None))).orderBy("draft_id").collect()])
store.index("memory")
"""


def test_six_processes(spark, tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "w.py").write_text(WRITER)
    run = [subprocess.Popen([sys.executable, str(tmp_path / "w.py"), f"{tmp_path}/s", str(root), str(n)], stdout=subprocess.PIPE, stderr=subprocess.PIPE, cwd=root) for n in range(6)]
    said = [p.communicate(timeout=600) for p in run]
    assert all(p.returncode == 0 for p in run), said[0][1][-2000:]
    told = [out.decode().strip().splitlines()[-1] for out, _ in said]
    assert sorted(told) == ["['added', 'added']"] + ["['added', 'existing']"] * 5
    store = Store(spark, f"{tmp_path}/s")
    assert store.batches() == list(range(6)) and store.table("memories").where("content = 'the same'").count() == 1
    assert sorted(r.sequence for r in store.table("events").collect()) == list(range(7))
    assert sorted(r.id for r in store.index("memory").table("forward").collect()) == sorted(r.memory_id for r in store.table("memories").collect())


def test_a_write_reads_no_text_and_few_buckets(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.remember(spark.range(2000).select(F.concat(F.lit("d"), "id").alias("draft_id"), F.concat(F.lit("content "), "id").alias("content"), F.lit("note").alias("kind"), F.lit("inferred").alias("epistemic_state"), F.lit(None).cast("string").alias("supersedes"), F.array().cast("array<string>").alias("evidence_ids"), F.array().cast("array<string>").alias("supporting_evidence_ids"), F.lit(datetime(2024, 1, 1)).alias("recorded_at")))
    read, real = [], Store.rows

    def rows(self, name, batches):
        read.append(name)
        return real(self, name, batches)

    Store.rows = rows
    try:
        got = {r.draft_id: r.status for r in store.remember(drafts(spark, ("x", "content 5", None), ("y", "fresh", None))).collect()}
    finally:
        Store.rows = real
    assert got == {"x": "added", "y": "added"} or got == {"x": "existing", "y": "added"}
    assert set(read) == {"lookup"}
    keys = spark.createDataFrame([("meaning", "ab" * 32), ("meaning", "a0" * 32)], "what string, key string")
    plan = store.found(keys)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan and "(prefix" in plan and "IN" in plan.upper() and "content" not in plan


def test_old_commits_keep_their_folders(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.remember(drafts(spark, ("a", "one", None)))
    entry = json.loads(log.text_of(spark, f"{store.root}/commits/0"))
    assert set(entry["folders"]) == {"memories", "memory_evidence", "events", "lookup"} and entry["next"] == {"events": 1}
