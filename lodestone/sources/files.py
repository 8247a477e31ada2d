"""Project files as a source: discovery, refusal of unfit content, and name policies."""

from __future__ import annotations

import fnmatch
import os
import stat
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import ignore

MAX_FILE_BYTES = 1 << 20
# Credential names that are never read, and names that discovery does not propose.
SECRET_NAMES = (".env*", "*.pem", "*.key", "id_rsa*")
SENSITIVE_NAMES = ("*secret*", "*password*", "*passwd*", "*credential*", "*token*")
# Names that discovery proposes at the root, and suffixes at any depth.
ROOT_NAMES = ("README*", "LICENSE*", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "requirements*.txt", "AGENTS.md", "CLAUDE.md")
SUFFIXES = (".md", ".txt")
#: Entries that discovery looks at before it stops, and the engine's own folder.
MOST_VISITS, OWN = 50_000, ".lodestone"
# Directories that are never entered.
EXCLUDED_DIRS = (".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs")


def glob_regex(pattern: str) -> str:
    """A file-name glob (``*`` and ``?``) as an anchored regular expression."""
    special = {"*": ".*", "?": "."}
    return "^(?s)" + "".join(special.get(c) or ("\\" + c if not c.isalnum() and c != "_" else c) for c in pattern) + "$"


def matches(name: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_regex(p))
    return out


# Names of files that editors and downloads leave for a while.
TEMPORARY = ("*.swp", "*.swo", "*.swx", "*~", ".#*", "#*#", "*.tmp", ".*.tmp", "*.orig", "*.rej", "4913", "*.part", "*.crdownload")


def is_temporary(path: str) -> bool:
    """Whether a file's name is one of TEMPORARY."""
    return any(fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], pattern) for pattern in TEMPORARY)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_secret(path: Column) -> Column:
    return matches(base_name(path), SECRET_NAMES)


def is_sensitive(path: Column) -> Column:
    return matches(F.lower(base_name(path)), SENSITIVE_NAMES)


def in_excluded_dir(path: Column, own: str = OWN) -> Column:
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*map(F.lit, (*EXCLUDED_DIRS, own)))) | F.exists(dirs, lambda d: d.endswith(".egg-info"))


def proposed(paths: DataFrame) -> DataFrame:
    """Of relative paths (path), those that discovery proposes, before ignore rules and content checks."""
    p = F.col("path")
    wanted = (~p.contains("/") & matches(p, ROOT_NAMES)) | p.endswith(SUFFIXES[0]) | p.endswith(SUFFIXES[1])
    return paths.where(wanted & ~in_excluded_dir(p) & ~is_secret(p) & ~is_sensitive(p))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below root, as Spark's file source lists them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + glob_regex(root.rstrip("/") + "/").removeprefix("^(?s)").removesuffix("$"), "")
    return raw.where(F.col("length") <= MAX_FILE_BYTES).select(rel.alias("path"), "content")


def fit_content(files: DataFrame) -> DataFrame:
    """(path, digest, size_bytes, text) of files that are text: no NUL, valid UTF-8, not blank, not over the limit."""
    text = F.decode("content", "UTF-8")
    sized = files.where((F.octet_length("content") <= MAX_FILE_BYTES) & ~F.hex("content").rlike("^(..)*00"))
    valid = sized.where(F.is_valid_utf8(F.col("content").cast("string")))
    return valid.where(text.rlike("(?U)\\S")).select("path", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("size_bytes"), F.col("content").cast("string").alias("text"))


class Refused(ValueError):
    """A path that is not read, and why."""


def resolved(root: str | Path, raw: str | Path) -> str:
    """A path asked for by name, relative to the workspace; refused outside it, at its root, in the engine's own folder,
    with a credential's name, where it is no regular file, and above MAX_FILE_BYTES. Links are followed first."""
    base = Path(root).resolve()
    target = Path(raw) if Path(raw).is_absolute() else base / raw
    try:
        target = target.resolve()
        inside = target.is_relative_to(base)
        parts = target.relative_to(base).parts if inside else ()
        info = target.stat() if parts else None
    except (OSError, RuntimeError) as e:
        raise Refused(f"{raw}: {e}") from e
    if not inside:
        raise Refused(f"{raw}: outside the workspace")
    if not parts:
        raise Refused(f"{raw}: the workspace itself")
    if parts[0] == OWN:
        raise Refused(f"{raw}: in the engine's own folder")
    if any(Path(target.name).match(p) for p in SECRET_NAMES):
        raise Refused(f"{raw}: the name of a credential")
    if not stat.S_ISREG(info.st_mode):
        raise Refused(f"{raw}: no regular file")
    if info.st_size > MAX_FILE_BYTES:
        raise Refused(f"{raw}: {info.st_size} bytes, above {MAX_FILE_BYTES}")
    return "/".join(parts)


def listing(root: str | Path, most: int = MOST_VISITS) -> list[tuple[str, int, int]]:
    """(path, mtime in ns, size) of regular files below the root, by path, without excluded and ignored directories.

    Links to directories are entered only inside the root and never within themselves, so a directory with several
    names is listed under each; after ``most`` entries the walk stops. An entry that can't be read is passed over.
    """
    base = Path(root).resolve()
    rules = ignore.load(base)
    out, visits, todo = [], 0, [(base, frozenset())]
    while todo:
        folder, above = todo.pop()
        try:
            info = folder.stat()
            if (own := (info.st_dev, info.st_ino)) in above:
                continue
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            visits += 1
            if visits > most:
                return sorted(out)
            rel = str(Path(e.path).relative_to(base))
            try:
                if e.is_dir():
                    inside = not e.is_symlink() or Path(e.path).resolve().is_relative_to(base)
                    if inside and e.name not in EXCLUDED_DIRS and e.name != OWN and not e.name.endswith(".egg-info") and not ignore.matches(rel, rules, True):
                        todo.append((Path(e.path), above | {own}))
                elif e.is_file() and not ignore.matches(rel, rules) and Path(e.path).resolve().is_relative_to(base):
                    info = e.stat()
                    out.append((rel, info.st_mtime_ns, info.st_size))
            except OSError:
                continue
    return sorted(out)


def discovered(spark: SparkSession, root: str | Path) -> DataFrame:
    """(path, mtime, size) of the files that discovery proposes, by path; those of unfit size are left out."""
    found = spark.createDataFrame(listing(root), "path string, mtime long, size long")
    return proposed(found).where(F.col("size") <= MAX_FILE_BYTES).orderBy("path")


def scope(tracked: DataFrame, discovered_: DataFrame) -> DataFrame:
    """(path): what is tracked or discovered, once each."""
    return tracked.select("path").union(discovered_.select("path")).distinct()
