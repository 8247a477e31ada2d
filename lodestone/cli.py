"""The command line: one workspace, one command, plain text on the output, errors on the other stream with status 1."""

from __future__ import annotations

import argparse
import signal
import sys
import uuid
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators import encoder, retrieval, state
from lodestone.plans import context
from lodestone.sources import files, records
from lodestone.sources.store import EVIDENCE_KINDS, KINDS, OUTCOMES, STATES
from lodestone.sources.workspace import PROFILES, Workspace
from lodestone.streaming import watcher

CONCEPTS = ("test", "fail", "error", "deploy", "cache", "auth", "token", "pool", "build", "schema", "index", "user")


def session(workspace: Workspace) -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": str(workspace.folder / "scratch"), "spark.sql.warehouse.dir": str(workspace.folder / "warehouse")}
    found = SparkSession.getActiveSession()
    if found is not None:
        return found
    out = SparkSession.builder.master("local[*]").config(map=conf).getOrCreate()
    out.sparkContext.setLogLevel("ERROR")
    return out


def safe(text: str) -> str:
    """A line that shows controls and directions as escapes, as ``functions.text.terminal_safe`` does."""
    named = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
    odd = {0x2028, 0x2029, 0x200E, 0x200F, 0x061C, *range(0x202A, 0x202F), *range(0x2066, 0x206A)}
    shown = lambda c: named.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or 127 <= ord(c) < 160 else f"\\u{ord(c):04x}" if ord(c) in odd else c)
    return "".join(map(shown, text))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    top.add_argument("--root", help="the workspace; else the nearest one upwards")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name, help, *args, **named):
        p = sub.add_parser(name, help=help)
        for a in args:
            p.add_argument(a)
        for flag, options in named.items():
            p.add_argument(f"--{flag.replace('_', '-')}", **options)
        return p

    many, evidence = {"action": "append", "default": []}, {"evidence": {"action": "append", "default": []}}
    add("init", "make a workspace").add_argument("profile", nargs="?", default="general", choices=PROFILES)
    add("status", "show the workspace")
    add("remember", "record a memory", "text", kind={"choices": KINDS, "default": "note"}, state={"choices": STATES, "default": "user_asserted"}, supersedes={}, supporting=many, **evidence)
    add("evidence-add", "record evidence", "text", kind={"choices": EVIDENCE_KINDS, "required": True})
    add("learn", "record a lesson", "text", verified={"action": "store_true"}, supersedes={}, supporting=many, **evidence)
    add("recall", "search memories", "query", limit={"type": int, "default": 20}, all={"action": "store_true"})
    add("timeline", "show the history", kind={"choices": KINDS})
    add("attempt", "record an attempt", task={"required": True}, approach={"required": True}, outcome={"required": True, "choices": OUTCOMES}, **evidence)
    add("preflight", "experience before a task", "task")
    add("context", "a budgeted context for a task", "task", budget={"type": int, "default": context.BUDGET})
    add("export", "a context to hand on", "task", budget={"type": int, "default": context.BUDGET}, **{"for": {"choices": ["generic"], "default": "generic"}})
    add("skills", "list skills")
    add("guard", "check an action", "action")
    add("seed", "observe documents by name, or list candidates").add_argument("paths", nargs="*")
    add("sources", "list observed documents", history={"action": "store_true"})
    add("semantic-setup", "build the vector index")
    w = add("watch", "control the watcher").add_subparsers(dest="action", required=True)
    for name in ("status", "start", "stop"):
        w.add_parser(name)
    w.add_parser("run").add_argument("--fresh", action="store_true")
    return top


def _draft(spark: SparkSession, **values):
    """One draft; its name is new, so that each call of a command is an act of its own."""
    kinds = {"evidence_ids": "array<string>", "supporting_evidence_ids": "array<string>", "verified": "boolean"}
    row = {"draft_id": uuid.uuid4().hex, **values}
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).withColumn("recorded_at", F.current_timestamp())


def _records(spark, workspace, store, task: str, refresh: bool = True):
    vectors = encoder.VectorIndex(spark, str(workspace.folder / "vectors"), encoder.concepts(CONCEPTS))
    pool = records.pool(store)
    added = vectors.refresh(pool) if refresh else 0
    tasks = spark.createDataFrame([(0, task)], "q long, task string")
    return records.Records(store, tasks, vectors), vectors.state(pool, added)


def run(argv: list[str]) -> list[str]:
    """The lines that a command prints."""
    args = parser().parse_args(argv)
    if args.command == "init":
        made = Workspace.init(args.root or ".", args.profile)
        return [f"Workspace at {made.root} ({made.profile})"]
    workspace = Workspace.open(args.root) if args.root else Workspace.discover()
    if args.command == "watch" and args.action != "run":
        return watcher.status(workspace) if args.action == "status" else [{"start": watcher.start, "stop": watcher.stop}[args.action](workspace)]
    spark = session(workspace)
    store = workspace.store(spark)
    if args.command == "watch":
        return _watch(spark, workspace, store, args.fresh)
    supervised = watcher.supervise(workspace)
    return [supervised] * bool(supervised) + COMMANDS[args.command](spark, workspace, store, args)


def _result(df, done: str) -> list[str]:
    r = df.first()
    if r.reason:
        raise ValueError(r.reason)
    return [f"{done} [{r.id}]" if getattr(r, "status", "added") == "added" else f"Known already [{r.id}]"]


def _status(spark, workspace, store, args) -> list[str]:
    live = state.current(store.table("memories"))
    n = {r.kind: r["count"] for r in live.groupBy("kind").count().collect()}
    _, said = _records(spark, workspace, store, "", refresh=False)
    rows = [f"Workspace: {workspace.root}", f"Profile: {workspace.profile}", f"Memories: {store.table('memories').count()}"]
    return rows + [f"{label}: {n.get(kind, 0)}" for label, kind in (("Invariants", "invariant"), ("Pending", "pending"), ("Open questions", "question"), ("Environment facts", "environment"))] + [f"Semantic: {said.described}", *watcher.status(workspace)]


def _remember(spark, workspace, store, args) -> list[str]:
    return _result(store.remember(_draft(spark, content=args.text, kind=args.kind, epistemic_state=args.state, supersedes=args.supersedes, evidence_ids=args.evidence + args.supporting, supporting_evidence_ids=args.supporting)), "Remembered")


def _learn(spark, workspace, store, args) -> list[str]:
    return _result(store.learn(_draft(spark, content=args.text, verified=args.verified, supersedes=args.supersedes, evidence_ids=args.evidence + args.supporting, supporting_evidence_ids=args.supporting)), "Learned")


def _recall(spark, workspace, store, args) -> list[str]:
    m = store.ordered("memory")
    found = retrieval.recall(m if args.all else state.current(m), args.query, args.limit).collect()
    return [f"[{r.memory_id}] {safe(r.content)}" for r in found] or ["No memories found."]


def _timeline(spark, workspace, store, args) -> list[str]:
    m = state.with_status(store.ordered("memory"))
    m = state.of_kind(m, args.kind, KINDS) if args.kind else m
    return [f"{r.recorded_at:%Y-%m-%d %H:%M:%S} [{r.memory_id}] ({r.kind}) {safe(r.content)}" + ("" if r.is_current else " (superseded)") for r in m.orderBy("seq").collect()] or ["Nothing is recorded."]


def _preflight(spark, workspace, store, args) -> list[str]:
    source, said = _records(spark, workspace, store, args.task)
    return [f"Retrieval: {said.retrieval}", *_listed(context.preflight(source), store)]


def _guard(spark, workspace, store, args) -> list[str]:
    source, said = _records(spark, workspace, store, args.action)
    return [f"Retrieval: {said.retrieval}", *_listed(context.guard(source), store)]


def _listed(rows, store) -> list[str]:
    texts = {}
    for table, key, text in (("memories", "memory_id", "content"), ("attempts", "attempt_id", "approach"), ("skills", "skill_id", "name"), ("evidence", "evidence_id", "content")):
        wanted = rows.select(F.col("entity").alias(key)).distinct()
        texts |= {r[0]: r[1] for r in store.table(table).join(wanted, key, "left_semi").select(key, text).collect()}  # what one task admits
    out, last = [], None
    for r in rows.orderBy("category", "pos").collect():
        if r.category != last:
            last = r.category
            out.append(last.upper().replace("_", " "))
        out.append(f"- [{r.entity}] {safe(texts.get(r.entity, ''))}".rstrip())
    return out or ["No relevant experience found."]


def _context(spark, workspace, store, args) -> list[str]:
    source, said = _records(spark, workspace, store, args.task)
    text = context.compiled(source, args.budget).first().text
    if args.command == "export":
        return [text]
    return [f"Retrieval: {said.retrieval}", *text.split("\n")[1:]]


def _seed(spark, workspace, store, args) -> list[str]:
    if not args.paths:
        return [f"{r.status}: {safe(r.path)}" for r in workspace.candidates(spark, store).collect()] or ["No documents found."]
    out, refused = workspace.seed(spark, store, args.paths)
    return [f"{r.status}: {safe(r.path)}" for r in out.orderBy("path").collect()] + [f"refused: {safe(why)}" for why in refused.values()]


def _sources(spark, workspace, store, args) -> list[str]:
    rows = store.table("observations").orderBy("path", "seq") if args.history else store.sources()
    return [f"{safe(r.path)} {r.digest[:12]} {r.size_bytes} bytes" for r in rows.collect()] or ["No documents are tracked."]


def _semantic(spark, workspace, store, args) -> list[str]:
    pool = records.pool(store)
    vectors = encoder.VectorIndex(spark, str(workspace.folder / "vectors"), encoder.concepts(CONCEPTS)).setup(pool)
    return [f"Semantic: {vectors.state(pool).described}"]


COMMANDS = {
    "status": _status, "remember": _remember, "learn": _learn, "recall": _recall, "timeline": _timeline, "preflight": _preflight, "guard": _guard, "context": _context, "export": _context, "seed": _seed, "sources": _sources, "semantic-setup": _semantic,
    "evidence-add": lambda spark, workspace, store, args: _result(store.add_evidence(_draft(spark, content=args.text, kind=args.kind)), "Evidence"),
    "attempt": lambda spark, workspace, store, args: _result(store.record_attempts(_draft(spark, task=args.task, approach=args.approach, outcome=args.outcome, evidence_ids=args.evidence)), "Attempt"),
    "skills": lambda spark, workspace, store, args: [f"[{r.skill_id}] ({r.verification_state}) {safe(r.name)}: {safe(r.purpose)}" for r in store.ordered("skill").collect()] or ["No skills are recorded."],
}


def _watch(spark, workspace, store, fresh: bool) -> list[str]:
    if not watcher.acquire(workspace):
        raise ValueError("another process watches this workspace")
    ended = []
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, lambda *_: ended.append(True))
    try:
        w = watcher.Watcher(spark, workspace, store)
        w.baseline(retro=not fresh)
        w.run(lambda: watcher.enabled(workspace) and not ended)
    finally:
        watcher.release(workspace)
    return ["Watcher ended."]


def main() -> int:
    try:
        print("\n".join(run(sys.argv[1:])))
    except (ValueError, files.Refused, OSError) as e:
        print(f"error: {safe(str(e))}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    sys.exit(main())
