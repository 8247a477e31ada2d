"""Workspaces: a project folder with the engine's own folder in it, its manifest, and what is recorded there."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import files
from lodestone.sources.store import VERSION, Store

PROFILES = ("general", "dev", "lab")
SCHEMA_VERSION = 1


class WorkspaceError(ValueError):
    """A workspace that is not there, or whose manifest is unfit."""


def write_manifest(folder: Path, data: dict) -> None:
    """Replace the manifest as a whole, so that no reader sees a part of it."""
    part = folder / ".manifest.part"
    part.write_text(json.dumps(data, indent=2) + "\n", encoding="utf-8")
    os.replace(part, folder / "manifest.json")


def read_manifest(folder: Path) -> dict:
    try:
        data = json.loads((folder / "manifest.json").read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise WorkspaceError(f"{folder} has no manifest") from e
    except ValueError as e:
        raise WorkspaceError(f"the manifest in {folder} is not JSON: {e}") from e
    if not isinstance(data, dict) or data.get("schema_version") != SCHEMA_VERSION:
        raise WorkspaceError(f"the manifest in {folder} has another schema version than {SCHEMA_VERSION}")
    if data.get("profile") not in PROFILES:
        raise WorkspaceError(f"the manifest in {folder} has no known profile")
    if not re.fullmatch("[0-9a-f]{32}", str(data.get("store_id"))):
        raise WorkspaceError(f"the manifest in {folder} has no identity")
    return data


class Workspace:
    """One project folder. Its store is below its own folder, or at ``store_root`` where executors can reach that alone."""

    def __init__(self, root: Path, profile: str, store_id: str):
        self.root, self.profile, self.store_id = root, profile, store_id
        self.folder = root / files.OWN

    @classmethod
    def init(cls, path: str | Path, profile: str = "general") -> Workspace:
        """Make a workspace, or open the one that is there; another profile than its own is refused."""
        if profile not in PROFILES:
            raise WorkspaceError(f"unknown profile: {profile}")
        root = Path(path).resolve()
        folder = root / files.OWN
        if folder.exists() and not folder.is_dir():
            raise WorkspaceError(f"{folder} is no directory")
        if not folder.is_dir():
            folder.mkdir(parents=True)
            write_manifest(folder, {"schema_version": SCHEMA_VERSION, "store_id": uuid.uuid4().hex, "profile": profile})
        out = cls.open(root)
        if out.profile != profile:
            raise WorkspaceError(f"the workspace at {root} has the profile {out.profile}, not {profile}")
        listed = root / ".gitignore"
        text = listed.read_text(encoding="utf-8") if listed.exists() else ""
        if f"{files.OWN}/" not in text.splitlines():
            listed.write_text(text + ("" if not text or text.endswith("\n") else "\n") + f"{files.OWN}/\n", encoding="utf-8")
        return out

    @classmethod
    def open(cls, path: str | Path) -> Workspace:
        root = Path(path).resolve()
        if not (root / files.OWN).is_dir():
            raise WorkspaceError(f"no workspace at {root}")
        data = read_manifest(root / files.OWN)
        return cls(root, data["profile"], data["store_id"])

    @classmethod
    def discover(cls, start: str | Path = ".") -> Workspace:
        """The nearest workspace from here upwards."""
        here = Path(start).resolve()
        for folder in (here, *here.parents):
            if (folder / files.OWN).is_dir():
                return cls.open(folder)
        raise WorkspaceError(f"no workspace in {here} or above")

    def store(self, spark: SparkSession, store_root: str | None = None) -> Store:
        """The store, brought to the present version."""
        out = Store(spark, store_root or str(self.folder / "store"))
        if out.version() != VERSION:
            out.migrate()
        return out

    def read_documents(self, spark: SparkSession, paths: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """(path, digest, size_bytes, text, observed_at) of the paths that are fit, and why others are refused."""
        fine, refused = [], {}
        for p in paths:
            try:
                fine.append(files.resolved(self.root, p))
            except files.Refused as e:
                refused[str(p)] = str(e)
        rows = spark.read.format("binaryFile").load([str(self.root / p) for p in fine]) if fine else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
        rel = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(str(self.root)) + 2})")
        out = files.fit_content(rows.select(rel.alias("path"), "content")).withColumn("observed_at", F.current_timestamp())
        return out, refused

    def seed(self, spark: SparkSession, store: Store, paths: list[str]) -> tuple[DataFrame, dict[str, str]]:
        """Observe documents by name; what their contents or paths refuse is told apart from what was observed."""
        docs, refused = self.read_documents(spark, paths)
        out = store.observe(docs)
        seen = {r.path for r in out.select("path").collect()}  # one row a path asked for
        for p in paths:
            try:
                rel = files.resolved(self.root, p)
            except files.Refused:
                continue
            if rel not in seen:
                refused[str(p)] = f"{p}: not text, blank or not UTF-8"
        return out, refused

    def candidates(self, spark: SparkSession, store: Store) -> DataFrame:
        """(path, status) of discovered documents: new, changed or unchanged against the store."""
        found = [r.path for r in files.discovered(spark, self.root).collect()]  # at most MOST_VISITS paths
        docs, _ = self.read_documents(spark, found)
        last = store.sources().select("path", F.col("digest").alias("stored"))
        status = F.when(F.col("stored").isNull(), "new").when(F.col("stored") == F.col("digest"), "unchanged").otherwise("changed")
        return docs.join(last, "path", "left").select("path", status.alias("status")).orderBy("path")
