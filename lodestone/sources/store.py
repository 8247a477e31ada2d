"""The record store: append-only tables of committed batches, writes of whole batches, reads that fail on malformed rows.

Commit n is the file ``commits/<n>``: it names the folders in which the batch's rows lie, and the next free numbers. A writer
reads the store as of the last commit, checks its drafts, writes rows to new folders, and then makes the next commit's file,
which only one of several writers can. Who comes second finds the file there, and checks and writes again against the
store as it is now; so batches stand in one order, each was checked against all before it, and what a broken writer left is never read.

``lookup`` is what checks read: keys of memories, of what is superseded, of meanings and of evidence, in buckets by their first
digits and with Bloom filters. A write opens the buckets of its drafts and no text of the store.
Search indexes follow the commits: an index knows how far it has read, and a read of it first takes in what is newer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import experience, state
from lodestone.operators.index import Index
from lodestone.sources import log, scratch

# The kinds and states of memories, the kinds of evidence, outcomes, and the kinds of events.
KINDS = ("note", "decision", "lesson", "root_cause", "pending", "question", "invariant", "environment", "invalidation")
STATES = ("user_asserted", "inferred", "verified")
EVIDENCE_KINDS = ("user_statement", "user_confirmation", "command_output", "test_result", "file_reference", "document_observation", "tool_output", "error_observation")
OUTCOMES = ("succeeded", "failed", "partial")
EVENT_KINDS = ("memory_recorded", "memory_superseded", "attempt_recorded", "skill_promoted")
VERSION = 4
#: Keys of a write that are looked up by name; more are joined with the buckets that hold them.
NAMED_KEYS = 1000
#: Times that a write is checked again after others came first.
ATTEMPTS = 1000
SCHEMAS = {
    "memories": "memory_id string, content string, kind string, epistemic_state string, recorded_at timestamp, supersedes string",
    "evidence": "evidence_id string, content string, kind string, recorded_at timestamp",
    "memory_evidence": "memory_id string, evidence_id string, position int, role string",
    "attempts": "attempt_id string, task string, approach string, outcome string, recorded_at timestamp",
    "attempt_evidence": "attempt_id string, evidence_id string, position int",
    "skills": "skill_id string, name string, purpose string, steps array<string>, conditions array<string>, lesson_id string, verification_state string, evidence_ids array<string>, recorded_at timestamp",
    "events": "sequence long, event_id string, kind string, subject_id string, occurred_at timestamp",
    "conflicts": "a string, b string, recorded_at timestamp",
    "lookup": "what string, key string, id string, at timestamp, prefix string",
    "observations": "seq long, path string, evidence_id string, digest string, size_bytes long, observed_at timestamp",
}
#: What ``lookup`` has: memories by id, superseded memories by id, memories by the digest of their meaning, kinds of evidence by id.
LOOKUPS = ("memory", "superseded", "meaning", "evidence")
#: Values of columns that older versions did not have.
DEFAULTS = {"memory_evidence": {"role": "related"}}
#: Kinds that versions up to 3 wrote under other names.
RENAMED = {"evidence": {"file": "file_reference", "document": "document_observation", "url": "user_statement", "observation": "document_observation"}, "events": {"skill_recorded": "skill_promoted"}}
_ID = "^[0-9a-f]{32}$"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of a plain folder; one that is not there yet is empty. Columns that an old version lacks get their defaults."""
    want = spark.createDataFrame([], SCHEMAS[table])
    path = f"{root.rstrip('/')}/{table}"
    if not _exists(spark, path):
        return want
    out = want.unionByName(spark.read.option("mergeSchema", "true").parquet(path), allowMissingColumns=True).select(want.columns)
    return out.fillna(DEFAULTS.get(table, {}))


def append(rows: DataFrame, root: str, table: str, key: list[str]) -> DataFrame:
    """Append rows whose key the table does not hold yet, so that a repeated batch adds nothing; returns what was added."""
    stored = read(rows.sparkSession, root, table).select(*key)
    new = rows.dropDuplicates(key).join(stored, key, "left_anti")
    new.write.mode("append").parquet(f"{root.rstrip('/')}/{table}")
    return new


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = log.path_of(spark, path)
    return fs.exists(p)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _outside(c: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def rejects(memories: DataFrame) -> DataFrame:
    """Rows with the first reason that refuses them, null where none does."""
    reason = F.coalesce(
        F.when(_blank("content"), F.lit("blank content")), F.when(_outside("kind", KINDS), F.lit("unknown kind")), F.when(_outside("epistemic_state", STATES), F.lit("unknown state")),
        F.when(~F.coalesce(F.col("memory_id").rlike(_ID), F.lit(False)), F.lit("malformed id")),
    )
    return memories.withColumn("reason", reason)


def _malformed(table: str) -> list[tuple[str, Column]]:
    """What makes a stored row malformed: columns and conditions."""
    bad_id = lambda c: ~F.coalesce(F.col(c).rlike(_ID), F.lit(False))
    none = lambda c: F.col(c).isNull()
    return {
        "memories": [("memory_id", bad_id("memory_id")), ("content", _blank("content")), ("kind", _outside("kind", KINDS)), ("epistemic_state", _outside("epistemic_state", STATES)), ("recorded_at", none("recorded_at")), ("supersedes", F.col("supersedes").isNotNull() & bad_id("supersedes"))],
        "evidence": [("evidence_id", bad_id("evidence_id")), ("kind", _outside("kind", EVIDENCE_KINDS)), ("content", none("content"))],
        "memory_evidence": [("memory_id", bad_id("memory_id")), ("evidence_id", bad_id("evidence_id")), ("position", F.coalesce(F.col("position") < 0, F.lit(True))), ("role", _outside("role", ("related", "supporting")))],
        "attempts": [("attempt_id", bad_id("attempt_id")), ("outcome", _outside("outcome", OUTCOMES)), ("recorded_at", none("recorded_at"))],
        "attempt_evidence": [("attempt_id", bad_id("attempt_id")), ("evidence_id", bad_id("evidence_id"))],
        "skills": [("skill_id", bad_id("skill_id")), ("steps", F.coalesce(F.size("steps") < 1, F.lit(True))), ("verification_state", _outside("verification_state", ("candidate", "verified")))],
        "events": [("sequence", none("sequence")), ("kind", _outside("kind", EVENT_KINDS)), ("subject_id", none("subject_id"))],
        "lookup": [("key", none("key")), ("what", _outside("what", LOOKUPS))],
        "conflicts": [("a", bad_id("a")), ("b", bad_id("b")), ("order", ~F.coalesce(F.col("a") < F.col("b"), F.lit(False)))],
        "observations": [("evidence_id", bad_id("evidence_id")), ("digest", ~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False))), ("size_bytes", F.coalesce(F.col("size_bytes") < 0, F.lit(True))), ("path", _blank("path"))],
    }[table]


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df``, whose read fails at the first malformed row and names the column at fault; no row is skipped."""
    first = df.columns[0]
    fault = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in _malformed(table)])
    error = F.raise_error(F.concat(F.lit(f"malformed row of {table}: "), fault)).cast(dict(df.dtypes)[first])
    return df.withColumn(first, F.when(fault.isNotNull(), error).otherwise(F.col(first)))


#: The table that each search index follows.
INDEXED = {"memory": "memories", "attempt": "attempts", "skill": "skills", "document": "evidence"}
#: Tables whose rows are numbered.
COUNTED = {"events": "sequence", "observations": "seq"}


def _meaning() -> Column:
    """The digest of what a memory says; equal ones stand for each other while they are current."""
    return F.sha2(F.to_json(F.struct("content", "kind", "epistemic_state", "supersedes", "evidence_ids", "supporting_evidence_ids")), 256)


def numbered(rows: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """``rows`` with numbers from ``start`` without gaps in an order, without a sort in one task: ranges count their rows first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    ranged = scratch.keep(ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(*order))), "numbered")
    at, ahead = start, []
    for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # at most a row a shuffle partition
        ahead.append((r["__range"], at))
        at += r.n
    base = rows.sparkSession.createDataFrame(ahead, "__range int, __base long")
    return ranged.join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__n") - 1).drop("__range", "__base", "__n")


class Store:
    """The tables of a workspace. All writes take a batch of drafts, each with a ``draft_id`` that names it for good."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.seen: int | None = None  # the commit that a write is checked against, none while reading

    def batches(self) -> list[int]:
        found = sorted(int(x) for x in log.names(self.spark, f"{self.root}/commits") if x.isdigit())
        return found if self.seen is None else [n for n in found if n <= self.seen]

    def entry(self, n: int) -> dict:
        """What commit n says: ``folders`` by table and the ``next`` numbers; one of an older version says nothing."""
        text = log.text_of(self.spark, f"{self.root}/commits/{n}")
        return json.loads(text) if text.strip() else {"folders": None, "next": {}}

    def rows(self, name: str, batches: list[int]) -> DataFrame:
        """The rows of a table that some commits wrote, with the defaults of columns that an old version lacks."""
        want = self.spark.createDataFrame([], SCHEMAS[name])
        paths = []
        for n in batches:
            folders = self.entry(n)["folders"]
            if folders is None:  # version 3 and before
                paths += [f"{self.root}/{name}/batch={n}"] if _exists(self.spark, f"{self.root}/{name}/batch={n}") else []
            elif name in folders:
                paths.append(f"{self.root}/{name}/{folders[name]}")
        if not paths:
            return want
        if name == "lookup":
            return checked(self.spark.read.schema(want.schema).option("basePath", f"{self.root}/lookup").parquet(*paths).select(want.columns), name)
        out = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        out = want.unionByName(out, allowMissingColumns=True).select(want.columns)
        if name in RENAMED:
            out = out.replace(RENAMED[name], subset=["kind"])
        return checked(out.fillna(DEFAULTS.get(name, {})), name)

    def table(self, name: str) -> DataFrame:
        """All committed rows of a table."""
        return self.rows(name, self.batches())

    def commit(self, **tables: DataFrame) -> int:
        """Write rows that need no check as one batch, and return its number."""
        return self._written(lambda: (tables, None))[0]

    def _written(self, build: Callable[[], tuple[dict[str, DataFrame], object]]) -> tuple[int, object]:
        """The number and result of a write. ``build`` gives rows by table and a result, from the store as of ``seen``; it is called
        again where another commit came first."""
        for _ in range(ATTEMPTS):
            last = max(self.batches(), default=-1)
            self.seen = last
            try:
                tables, result = build()
                folders, numbers = {}, dict(self.entry(last)["next"]) if last >= 0 else {}
                for name, df in tables.items():
                    folders[name] = f"part={uuid.uuid4().hex}"
                    self._write(df, name, f"{self.root}/{name}/{folders[name]}")
                for name, column in COUNTED.items():
                    if name in folders:
                        top = self.spark.read.parquet(f"{self.root}/{name}/{folders[name]}").agg(F.max(column)).first()[0]
                        numbers[name] = self._next(name, column) if top is None else top + 1
            finally:
                self.seen = None
            if log.publish(self.spark, f"{self.root}/commits/{last + 1}", json.dumps({"folders": folders, "next": numbers, "version": VERSION})):
                return last + 1, result
            for name, folder in folders.items():
                log.delete(self.spark, f"{self.root}/{name}/{folder}")
        raise RuntimeError(f"other writers came first {ATTEMPTS} times")

    def _write(self, df: DataFrame, name: str, path: str) -> None:
        writer = lambda d: d.write.mode("overwrite").option("compression", "zstd")
        df = df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns)
        if name == "lookup":
            df = df.repartition("prefix").sortWithinPartitions("prefix", "key")
            writer(df).option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("prefix").parquet(path)
        else:
            writer(df).parquet(path)

    def found(self, keys: DataFrame) -> DataFrame:
        """(what, key, id, at) of what is known of ``keys`` (what, key): the buckets of these keys are opened, by name where they are few."""
        known = self.table("lookup")
        keys = keys.where("key is not null").distinct()
        some = keys.take(NAMED_KEYS + 1)
        if len(some) <= NAMED_KEYS:
            known = known.where(F.col("prefix").isin(sorted({k.key[:1] for k in some})) & F.col("key").isin(sorted({k.key for k in some})))
        return known.join(keys, ["what", "key"], "left_semi").select("what", "key", "id", "at")

    def follow(self, kind: str) -> Index:
        """The search index of a kind of record, after it has taken in all commits."""
        out = Index(self.spark, f"{self.root}/index/{kind}", "string")
        batches = self.batches()
        while batches and (at := out.watermark()) < batches[-1]:
            new = [n for n in batches if n > at]
            folders = [self.entry(n)["folders"] for n in new]
            if all(f is not None and INDEXED[kind] not in f for f in folders):
                out.skip(at + 1, new[-1])
                continue
            out.apply(self._indexed(kind, new), at + 1, new[-1])  # where another reader was faster, its batch is there now
        return out

    def index(self, kind: str) -> Index:
        return self.follow(kind)

    def _indexed(self, kind: str, batches: list[int]) -> DataFrame:
        """(id, text) of the records of a kind that some commits wrote."""
        rows = lambda table: self.rows(table, batches)
        return {
            "memory": lambda: rows("memories").select(F.col("memory_id").alias("id"), F.col("content").alias("text")),
            "attempt": lambda: rows("attempts").select(F.col("attempt_id").alias("id"), F.concat_ws(" ", "task", "approach").alias("text")),
            "skill": lambda: rows("skills").select(F.col("skill_id").alias("id"), F.concat_ws(" ", "name", "purpose", F.concat_ws(" ", "conditions")).alias("text")),
            "document": lambda: rows("evidence").where("kind = 'document_observation'").select(F.col("evidence_id").alias("id"), F.col("content").alias("text")),
        }[kind]().dropDuplicates(["id"])

    def version(self) -> int:
        names = [int(x) for x in log.names(self.spark, f"{self.root}/versions")]
        if names:
            return max(names)
        batches = self.batches()
        return self.entry(batches[-1]).get("version", 1) if batches else VERSION

    def migrate(self) -> int:
        """Bring an older store to VERSION, a step a version, each as a commit of its own that is marked once it is there; a newer one is refused.

        2: events of memories that never had one, in the order of their times and ids. 3: the role of evidence links, as
        a default on reading. 4: the lookup table. A step that broke before its mark finds nothing left to add when it runs again.
        """
        at = self.version()
        if at > VERSION:
            raise ValueError(f"the store has version {at}, this engine knows {VERSION}")
        if at < 2:
            self._written(lambda: ({"events": self._missing_events()}, None))
        if at < 4:
            self._written(lambda: ({"lookup": self._missing_lookup()}, None))
        if at < VERSION:
            log.publish(self.spark, f"{self.root}/versions/{VERSION}", "")
        return self.version()

    def _missing_events(self) -> DataFrame:
        known = self.table("events").where("kind in ('memory_recorded', 'memory_superseded')").select("subject_id", "kind")
        missing = state.backfill_events(self.table("memories").withColumn("seq", F.col("recorded_at"))).join(known, ["subject_id", "kind"], "left_anti")
        return self._events(missing, ["recorded_at", "subject_id", "kind"])

    def _missing_lookup(self) -> DataFrame:
        every = self._keys(self._cited(self.table("memories"))).unionByName(self._evidence_keys(self.table("evidence")))
        return every.join(self.table("lookup").select("what", "key", "id"), ["what", "key", "id"], "left_anti")

    def _cited(self, memories: DataFrame) -> DataFrame:
        """Memories with the two lists of their evidence."""
        parts = F.array_sort(F.collect_list(F.struct("position", "evidence_id", "role")))
        links = self.table("memory_evidence").groupBy("memory_id").agg(parts.alias("p"))
        links = links.select("memory_id", F.transform("p", lambda x: x.evidence_id).alias("evidence_ids"), F.transform(F.filter("p", lambda x: x.role == "supporting"), lambda x: x.evidence_id).alias("supporting_evidence_ids"))
        return memories.join(links, "memory_id", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("evidence_ids", "supporting_evidence_ids")})

    def _keys(self, memories: DataFrame) -> DataFrame:
        """Rows of ``lookup`` for memories with their evidence."""
        row = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"), F.col("memory_id").alias("id"), F.col("recorded_at").alias("at"))
        rows = memories.select(F.explode(F.array(row("memory", F.col("memory_id")), row("superseded", F.col("supersedes")), row("meaning", _meaning()))).alias("x")).select("x.*")
        return rows.where("key is not null").withColumn("prefix", F.substring("key", 1, 1))

    def _evidence_keys(self, evidence: DataFrame) -> DataFrame:
        return evidence.select(F.lit("evidence").alias("what"), F.col("evidence_id").alias("key"), F.col("kind").alias("id"), F.col("recorded_at").alias("at"), F.substring("evidence_id", 1, 1).alias("prefix"))

    def _next(self, table: str, column: str) -> int:
        batches = self.batches()
        if batches and (known := self.entry(batches[-1])["next"].get(table)) is not None:
            return known
        last = self.table(table).agg(F.max(column)).first()[0]
        return 0 if last is None else last + 1

    def _events(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """Events of (subject_id, kind, recorded_at) in an order, behind all others."""
        out = numbered(rows, order, self._next("events", "sequence"), "sequence")
        return out.select("sequence", F.md5(F.concat_ws("|", F.col("sequence").cast("string"), "kind", "subject_id")).alias("event_id"), "kind", "subject_id", F.col("recorded_at").alias("occurred_at"))

    def _identified(self, drafts: DataFrame, kind: str) -> DataFrame:
        return drafts.withColumn("id", F.md5(F.concat_ws("|", F.lit(kind), F.col("draft_id").cast("string"))))

    def add_evidence(self, drafts: DataFrame) -> DataFrame:
        """(draft_id, id, reason) of drafts (draft_id, content, kind, recorded_at)."""
        reason = F.coalesce(F.when(_blank("content"), F.lit("blank content")), F.when(_outside("kind", EVIDENCE_KINDS), F.lit("unknown kind")))
        rows = scratch.keep(self._identified(drafts, "evidence").withColumn("reason", reason), "drafts")

        def build():
            known = self.found(rows.select(F.lit("evidence").alias("what"), F.col("id").alias("key"))).select(F.col("key").alias("evidence_id"))
            new = rows.where("reason is null").dropDuplicates(["id"]).withColumnRenamed("id", "evidence_id").join(known, "evidence_id", "left_anti")
            return {"evidence": new, "lookup": self._evidence_keys(new)}, None

        self._written(build)
        return rows.select("draft_id", "id", "reason")

    def remember(self, drafts: DataFrame) -> DataFrame:
        """(draft_id, id, status, reason): added, existing (an equal current memory stands for it) or refused.

        drafts: draft_id, content, kind, epistemic_state, supersedes, evidence_ids, supporting_evidence_ids, recorded_at.
        All checks come before the search for an equal memory, but that for a second superseder; drafts count in the
        order of recorded_at and draft_id. Memories, links, events and keys are one batch.
        """
        lists = {c: F.coalesce(F.array_distinct(c), F.array().cast("array<string>")) for c in ("evidence_ids", "supporting_evidence_ids")}
        own = scratch.keep(self._identified(drafts, "memory").withColumns(lists).withColumn("meaning", _meaning()), "own")
        return self._written(lambda: self._remembered(own))[1]

    def _remembered(self, d: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        """What a batch of drafts adds to the store as of ``seen``, and what becomes of each draft."""
        named = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"))
        every = F.concat(F.transform("evidence_ids", lambda e: named("evidence", e)), F.array(named("memory", F.col("id")), named("memory", F.col("supersedes")), named("superseded", F.col("supersedes")), named("meaning", F.col("meaning"))))
        met = scratch.keep(self.found(d.select(F.explode(every).alias("x")).select("x.*")), "met")
        of = lambda what: met.where(F.col("what") == what)
        cited = d.select("draft_id", F.explode("evidence_ids").alias("key"), "supporting_evidence_ids").join(of("evidence").select("key", F.col("id").alias("e_kind")), "key", "left")
        supports = F.array_contains("supporting_evidence_ids", F.col("key"))
        sums = cited.groupBy("draft_id").agg(F.bool_or(F.col("e_kind").isNull()).alias("unknown"), F.bool_or(supports & F.col("e_kind").isin(*state.QUALIFYING)).alias("good"))
        known = of("memory").select(F.col("key").alias("supersedes"), F.lit(True).alias("target"))
        d = d.join(sums, "draft_id", "left").join(known, "supersedes", "left")
        verified = F.col("epistemic_state") == "verified"
        reason = F.coalesce(
            F.when(_blank("content"), F.lit("blank content")), F.when(_outside("kind", KINDS), F.lit("unknown kind")), F.when(_outside("epistemic_state", STATES), F.lit("unknown state")),
            F.when(F.coalesce("unknown", F.lit(False)), F.lit("unknown evidence")), F.when(F.size(F.array_except("supporting_evidence_ids", "evidence_ids")) > 0, F.lit("supporting evidence outside the evidence")),
            F.when(verified & (F.size("supporting_evidence_ids") == 0), F.lit("verified without supporting evidence")), F.when(verified & ~F.coalesce("good", F.lit(False)), F.lit("no supporting evidence of a qualifying kind")),
            F.when(F.col("supersedes").isNotNull() & F.col("target").isNull(), F.lit("unknown superseded memory")),
        )
        gone = self.found(of("meaning").select(F.lit("superseded").alias("what"), F.col("id").alias("key"))).select(F.col("key").alias("id"))
        stored = of("meaning").join(gone, "id", "left_anti").groupBy(F.col("key").alias("meaning")).agg(F.min(F.struct("at", "id")).id.alias("stored"))
        order = ["recorded_at", "draft_id"]
        fine = F.col("reason").isNull()
        same = F.first("id").over(Window.partitionBy("meaning", fine).orderBy(*order))
        d = scratch.keep(d.withColumn("reason", reason).join(stored, "meaning", "left").withColumn("same", F.coalesce("stored", F.when(fine, same))), "drafts")
        taken = of("superseded").select(F.col("key").alias("supersedes"), F.lit(True).alias("taken")).distinct()
        new = d.where(fine & (F.col("same") == F.col("id")) & F.col("stored").isNull()).dropDuplicates(["id"])
        new = new.join(of("memory").select(F.col("key").alias("id")), "id", "left_anti").join(taken, "supersedes", "left")  # a draft that was run before adds nothing
        second = F.col("supersedes").isNotNull() & (F.coalesce("taken", F.lit(False)) | (F.row_number().over(Window.partitionBy("supersedes").orderBy(*order)) > 1))
        new = scratch.keep(new.withColumn("late", F.when(second, F.lit("already superseded"))), "new")
        rows = new.where("late is null").withColumnRenamed("id", "memory_id")
        spread = rows.select("memory_id", "supporting_evidence_ids", F.posexplode("evidence_ids").alias("position", "evidence_id"))
        role = F.when(F.array_contains("supporting_evidence_ids", F.col("evidence_id")), "supporting").otherwise("related")
        events = state.backfill_events(rows.withColumn("seq", F.col("recorded_at")))
        out = d.join(new.select(F.col("id").alias("same"), "late"), "same", "left").withColumn("reason", F.coalesce("reason", "late"))
        status = F.when(F.col("reason").isNotNull(), "refused").when(F.col("same") == F.col("id"), F.when(F.col("stored").isNull(), "added").otherwise("existing")).otherwise("existing")
        told = out.select(F.col("draft_id").cast("string").alias("draft_id"), F.when(F.col("reason").isNull(), F.col("same")).alias("id"), status.alias("status"), "reason")
        tables = {"memories": rows, "memory_evidence": spread.withColumn("role", role), "events": self._events(events, ["recorded_at", "subject_id", "kind"]), "lookup": self._keys(rows)}
        return tables, scratch.keep(told, "told")

    def learn(self, drafts: DataFrame) -> DataFrame:
        """``remember`` of lessons: verified ones are so, others asserted. drafts have ``verified`` in place of kind and state."""
        said = F.when(F.coalesce("verified", F.lit(False)), "verified").otherwise("user_asserted")
        return self.remember(drafts.withColumns({"kind": F.lit("lesson"), "epistemic_state": said}))

    def record_attempts(self, drafts: DataFrame) -> DataFrame:
        """(draft_id, id, reason) of drafts (draft_id, task, approach, outcome, evidence_ids, recorded_at)."""
        own = scratch.keep(self._identified(drafts, "attempt").withColumn("evidence_ids", F.coalesce(F.array_distinct("evidence_ids"), F.array().cast("array<string>"))), "own")

        def build():
            cited = own.select("draft_id", F.lit("evidence").alias("what"), F.explode("evidence_ids").alias("key"))
            unknown = cited.join(self.found(cited.select("what", "key")).select("key"), "key", "left_anti").select("draft_id", F.lit(True).alias("unknown")).distinct()
            reason = F.coalesce(F.when(_blank("task"), F.lit("blank task")), F.when(_blank("approach"), F.lit("blank approach")), F.when(_outside("outcome", OUTCOMES), F.lit("unknown outcome")), F.when(F.coalesce("unknown", F.lit(False)), F.lit("unknown evidence")))
            d = scratch.keep(own.join(unknown, "draft_id", "left").withColumn("reason", reason), "drafts")
            new = d.where("reason is null").dropDuplicates(["id"]).withColumnRenamed("id", "attempt_id").join(self.table("attempts").select("attempt_id"), "attempt_id", "left_anti")
            new = scratch.keep(new, "new")
            events = new.select(F.col("attempt_id").alias("subject_id"), F.lit("attempt_recorded").alias("kind"), "recorded_at")
            links = new.select("attempt_id", F.posexplode("evidence_ids").alias("position", "evidence_id"))
            return {"attempts": new, "attempt_evidence": links, "events": self._events(events, ["recorded_at", "subject_id"])}, d.select("draft_id", "id", "reason")

        return self._written(build)[1]

    def promote(self, drafts: DataFrame) -> DataFrame:
        """(draft_id, id, reason) of skills drafted from lessons (draft_id, name, purpose, steps, conditions, lesson_id, recorded_at)."""
        named = self._identified(drafts, "skill").withColumnRenamed("id", "skill_id")

        def build():
            made = experience.promoted(named, self.table("memories"), self.table("memory_evidence"))
            d = scratch.keep(made.join(named.select("draft_id", "skill_id", "recorded_at"), "skill_id"), "drafts")
            new = scratch.keep(d.where("reason is null").dropDuplicates(["skill_id"]).join(self.table("skills").select("skill_id"), "skill_id", "left_anti"), "new")
            events = new.select(F.col("skill_id").alias("subject_id"), F.lit("skill_promoted").alias("kind"), "recorded_at")
            return {"skills": new, "events": self._events(events, ["recorded_at", "subject_id"])}, d.select("draft_id", F.col("skill_id").alias("id"), "reason")

        return self._written(build)[1]

    def record_conflicts(self, pairs: DataFrame) -> DataFrame:
        """New conflicts of (x, y, recorded_at) between known memories; unknown ones raise. Returns (a, b, recorded_at)."""

        def build():
            ends = pairs.select(F.lit("memory").alias("what"), F.explode(F.array("x", "y")).alias("key")).distinct()
            if found := ends.join(self.found(ends).select("key"), "key", "left_anti").take(1):
                raise ValueError(f"unknown memory: {found[0].key}")
            new = scratch.keep(state.upsert_conflicts(pairs, self.table("conflicts")), "conflicts")
            return {"conflicts": new}, new

        return self._written(build)[1]

    def observe(self, files: DataFrame) -> DataFrame:
        """(path, status, evidence_id): added, changed or unchanged files (path, digest, size_bytes, text, observed_at), one a path.

        What is unchanged against the last observation of its path writes nothing.
        """
        own = scratch.keep(files.dropDuplicates(["path"]), "files")

        def build():
            last = state.latest(self.table("observations")).select("path", F.col("digest").alias("stored"))
            status = F.when(F.col("stored").isNull(), "added").when(F.col("stored") == F.col("digest"), "unchanged").otherwise("changed")
            evidence = F.md5(F.concat_ws("|", F.lit("observation"), "path", "digest", F.col("observed_at").cast("string")))
            rows = scratch.keep(own.join(last, "path", "left").withColumns({"status": status, "evidence_id": evidence}), "observed")
            new = rows.where("status <> 'unchanged'")
            seen = numbered(new, ["observed_at", "path"], self._next("observations", "seq"), "seq")
            proof = new.select("evidence_id", F.col("text").alias("content"), F.lit("document_observation").alias("kind"), F.col("observed_at").alias("recorded_at"))
            return {"evidence": proof, "observations": seen, "lookup": self._evidence_keys(proof)}, rows.select("path", "status", F.when(F.col("status") != "unchanged", F.col("evidence_id")).alias("evidence_id"))

        return self._written(build)[1]

    def rebuild_indexes(self) -> None:
        """All search indexes anew from the tables."""
        batches = self.batches()
        for kind in ("memory", "attempt", "skill", "document") if batches else ():
            Index(self.spark, f"{self.root}/index/{kind}", "string").rebuild(self._indexed(kind, batches), batches[-1])

    def ordered(self, kind: str) -> DataFrame:
        """Memories, attempts or skills in the order of their events, with ``seq``; an event whose record is missing stops the read."""
        table, key = {"memory": ("memories", "memory_id"), "attempt": ("attempts", "attempt_id"), "skill": ("skills", "skill_id")}[kind]
        made = "skill_promoted" if kind == "skill" else f"{kind}_recorded"
        events = self.table("events").where(F.col("kind") == made).select(F.col("sequence").alias("seq"), "subject_id")
        out = events.join(self.table(table), F.col("subject_id") == F.col(key), "left")
        missing = F.raise_error(F.concat(F.lit(f"missing {kind} "), F.col("subject_id"))).cast("string")
        return out.withColumn(key, F.coalesce(F.col(key), missing)).drop("subject_id").orderBy("seq")

    def get(self, table: str, key: str, value: str):
        """The row of an id, or None."""
        found = self.table(table).where(F.col(key) == value).take(1)
        return found[0] if found else None

    def sources(self) -> DataFrame:
        """(path, seq, digest, size_bytes, observed_at, evidence_id, content): the last observation of every path and its evidence, by path."""
        o = self.table("observations")
        last = state.latest(o).select("path", "seq")
        out = o.join(last, ["path", "seq"]).join(self.table("evidence").select("evidence_id", "content"), "evidence_id", "left")
        gone = F.raise_error(F.concat(F.lit("missing evidence "), F.col("evidence_id"))).cast("string")
        return out.withColumn("content", F.coalesce("content", gone)).select("path", "seq", "digest", "size_bytes", "observed_at", "evidence_id", "content").orderBy("path")

