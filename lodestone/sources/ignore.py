"""Ignore rules in the usual pattern language: ``* ** ? [..]``, negation, anchors, directories; the last match wins."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dir_only: bool


def _regex(pattern: str) -> str:
    """The part of a regular expression for one pattern without its anchors."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i) and i + 2 == len(pattern) and (i == 0 or pattern[i - 1] == "/"):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            if pattern[i] == "\\" and i + 1 < len(pattern):
                i += 1
            out.append(pattern[i] if pattern[i].isalnum() or pattern[i] in "_/-" else "\\" + pattern[i])
            i += 1
    return "".join(out)


def parse(text: str) -> list[Rule]:
    """Rules of an ignore file; blank lines and comments give none."""
    rules = []
    for line in text.splitlines():
        bare = line.rstrip(" ") if not line.endswith("\\ ") else line
        if not bare or bare.startswith("#"):
            continue
        negated = bare.startswith("!")
        bare = bare[1:] if negated else bare
        dir_only = bare.endswith("/")
        bare = bare.rstrip("/")
        if not bare:
            continue
        anchored = "/" in bare
        rules.append(Rule(("^" if anchored else "^(?:.*/)?") + _regex(bare.lstrip("/")) + "$", negated, dir_only))
    return rules


def ignored(path: Column, rules: list[Rule], is_dir: bool = False) -> Column:
    """Whether a file's path is ignored: itself, or any directory above it, by the last rule that matches."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("p"), (F.lit(is_dir) | (n < F.size(parts))).alias("d")))

    def verdict(x: Column) -> Column:
        out = None
        for r in reversed(rules):
            hit = x.p.rlike(r.regex) & (x.d if r.dir_only else F.lit(True))
            out = F.when(hit, F.lit(not r.negated)) if out is None else out.when(hit, F.lit(not r.negated))
        return out.otherwise(F.lit(False))

    return F.exists(prefixes, verdict)


def matches(path: str, rules: list[Rule], is_dir: bool = False) -> bool:
    """``ignored`` for one path on the driver, where a walk decides whether to enter a directory."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        prefix, folder = "/".join(parts[:n]), is_dir or n < len(parts)
        hit = next((r for r in reversed(rules) if (folder or not r.dir_only) and re.search(r.regex, prefix)), None)
        if hit is not None and not hit.negated:
            return True
    return False


def load(root: str | Path) -> list[Rule]:
    """Rules of the user's global ignore file, of the repository's own exclude file and of the root's ignore file, in
    this order, so that later ones win. What can't be read gives none."""
    base = Path(root)
    home = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config")
    found = []
    for file, wanted in ((home / "git" / "ignore", True), (base / ".git" / "info" / "exclude", (base / ".git").is_dir()), (base / ".gitignore", True)):
        try:
            found += parse(file.read_text(encoding="utf-8", errors="replace")) if wanted else []
        except OSError:
            continue
    return found
