"""Secret scan: an Aho-Corasick prefilter, regular expressions anchored at its hits, and checksums inside of tokens.

Texts are scanned as bytes that are folded first: A-Z count as a-z, and then 0-9 and a-f as one class. So one automaton
finds the keywords in either case and, as a word of that class, all places where a run of hexadecimal digits is long
enough. Only at a hit is a kind's expression tried, anchored there, on the bytes as they are; a kind with a checksum
keeps a match only if it holds. All expressions are ASCII, so bytes and code points give the same matches; spans are counted in code points.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

HEX_LEAST, VALUE_LEAST, ACCESS_LEAST = 24, 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(ord("0") if chr(b).lower() in "0123456789abcdef" else ord(chr(b).lower()) if b < 128 else b for b in range(256))
_LATER_BYTES = bytes(range(0x80, 0xC0))


def checksum_holds(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the thirty before them, in base 62."""
    value, digits = zlib.crc32(token[-36:-6]), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.encode() == token[-6:]


class Kind(NamedTuple):
    """What a secret looks like: each starts with a keyword; ``kept`` judges a match, which hides what it covers even if it fails."""

    name: str
    keywords: tuple[str, ...]
    pattern: bytes
    kept: Callable[[re.Match], bool]
    base: bool = True


KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= VALUE_LEAST),
    Kind("access", ("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= ACCESS_LEAST),
    Kind("hex", ("0" * HEX_LEAST,), rb"[0-9a-f]{%d,}" % HEX_LEAST, lambda m: True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"\bgh[pousr]_[0-9A-Za-z]{36}\b", lambda m: checksum_holds(m[0]), False),
    Kind("npm", ("npm_",), rb"\bnpm_[0-9A-Za-z]{36}\b", lambda m: checksum_holds(m[0]), False),
)


@lru_cache(maxsize=1)
def _automaton() -> tuple[ahocorasick.Automaton, list]:
    """Folded keywords with their length and kind, and the kinds' expressions; made once a worker."""
    found = ahocorasick.Automaton()
    for i, kind in enumerate(KINDS):
        for word in kind.keywords:
            found.add_word(word.encode().translate(_FOLD).decode(), (len(word), i))
    found.make_automaton()
    return found, [re.compile(k.pattern) for k in KINDS]


def spans_of(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of a UTF-8 text, in code points, by start and then kind."""
    automaton, patterns = _automaton()
    ends, found = [0] * len(KINDS), []
    # No keyword lies inside another of its kind, so hits of a kind come in the order of their starts.
    for last, (length, i) in automaton.iter(raw.translate(_FOLD).decode("latin-1")):
        start = last - length + 1
        if start >= ends[i] and (m := patterns[i].match(raw, start)):
            ends[i] = m.end()
            if KINDS[i].kept(m):
                found.append((start, i, m.end()))
    found.sort()
    at = {}
    done = points = 0
    for place in sorted({p for s, _, e in found for p in (s, e)}):
        points += len(raw[done:place].translate(None, _LATER_BYTES))
        at[place], done = points, place
    return [(at[s], i, at[e]) for s, i, e in found]


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text): spans of kind, start, end and base, by start, then kind as in KINDS.

    Matches of a kind are leftmost and do not overlap, and hide what they cover even where they fail; kinds do not hide each
    other. Whole texts of any length are scanned, in time that grows with the length; a null text counts as empty, and a row
    without secrets has an empty list. Rows are judged alone, so repeated rows and ids are kept as they are, a null doc_id
    too; an empty table gives no rows, and other columns are not read. Nothing is shuffled.
    """
    Scratch(docs.sparkSession, "secrets")

    def run(batches):
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            spans = []
            for text in batch.column(1).cast(pa.binary()):
                got = spans_of(text.as_py() or b"")
                spans.append([{"kind": KINDS[i].name, "start": s, "end": e, "base": KINDS[i].base} for s, i, e in got])
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(spans, pa.list_(kind))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of all documents; n_github and n_npm count what the method adds to the base."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("github"), count("npm")
    )
