"""Removal of repeated word passages, found by difference-cover anchors.

The word positions 0, 1, 3 and 9 modulo 13 are a difference cover: for any two positions i and j there is a
shift below 13 that brings both onto the cover. So two equal windows of 20 words, wherever they start, share an
8-word run that starts on the cover in both. Only those runs (4 of 13 positions) are hashed and exchanged.

1. Documents are dealt into blocks by id and written once in that order; all passes read them from there.
2. A block sends each of its distinct anchor hashes once. Those that two blocks hold go back to these blocks.
3. A block extends: every window of 20 words around a repeated anchor is hashed to 128 bits, half of them over each of
   the two independent hashes of its words, and each distinct one is sent once, with the smallest document that holds it in the block.
4. Of each window, all blocks but the one with the smallest document get it back as taken.
5. A block drops the words under a window that is taken or that starts earlier in the block itself.

Repeats are merged inside a block before anything is exchanged, so a passage that a third of all documents share
costs an entry a block, not a row a document, and no pairs are made. Exchanges have two levels: FAN parts of a block
meet those of RANGE blocks, which settle what they can, and send one entry of each hash on to all ranges. So rows
grow in proportion to the input, and of the most frequent hash one task sees RANGE entries or one a range.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.hashing import two_words, windows, windows_at
from lodestone.llm.scratch import Scratch

#: A perfect difference set: fixed values.
PERIOD, COVER = 13, (0, 1, 3, 9)
_ON = np.isin(np.arange(PERIOD), COVER)
BLOCK_BYTES = 6_000_000
#: Parts of a block, blocks that meet on the first level, and bytes of text for each bucket of the second.
FAN, RANGE, BUCKET_BYTES = 64, 256, 1 << 23
U, I = np.uint64, np.int64
#: Blocks of a part of the written documents, and such parts at most; each is a file.
PART_BLOCKS, MOST_PARTS = 4, 50_000


class _Block:
    """Word hashes of the documents of a block, ordered by id, and what follows from them."""

    def __init__(self, table: pa.Table, window: int, second: bool = True):
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else pa.array([], pa.uint64())
        self.table = table.take(order)
        self.window, self.span = window, window - PERIOD + 1
        hashes, first, at = [], [np.zeros(1, np.int64)], 0
        for i in range(0, self.table.num_rows, 256):
            h, f = two_words(self.table["text"].slice(i, 256).combine_chunks(), second=second)
            hashes.append(h)
            first.append(f[1:] + at)
            at += h.shape[1]
        self.first = np.concatenate(first)
        both = np.concatenate(hashes, axis=1) if hashes else np.zeros((1 + second, 0), U)
        self.h, self.g = both[0], both[-1]
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.left = self.first[1:][self.doc] - np.arange(len(self.h))  # words from here to the end of the document
        self.long = (self.n >= window)[self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of anchors and their hashes."""
        at = np.arange(len(self.h)) - self.first[self.doc]
        w = windows(self.h, self.span)
        pos = np.flatnonzero((self.left >= self.span) & _ON[at % PERIOD] & self.long)
        return pos, w[pos]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows that hold an anchor which repeats, in this block or in another."""
        pos, a = self.anchors()
        order = np.argsort(a, kind="stable")
        s = a[order]
        same = np.zeros(len(s), bool)
        if len(s) > 1:
            eq = s[1:] == s[:-1]
            same[1:] |= eq
            same[:-1] |= eq
        hit = np.zeros(len(self.h) + PERIOD + 1, np.int32)
        hit[pos[order[same]]] = 1
        if len(repeated):
            hit[pos[_member(a, repeated)]] = 1
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(hit, dtype=np.int32)])
        n = len(self.h)
        return np.flatnonzero((total[PERIOD : n + PERIOD] - total[:n] > 0) & (self.left >= self.window))


def _member(a: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(a), bool)
    at = np.searchsorted(sorted_, a)
    at[at == len(sorted_)] = 0
    return sorted_[at] == a


def _gathered(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What a block got back: hashes and second hashes, by hash."""
    h, g = (np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in right[c]]) if right.num_rows else np.zeros(0, U) for c in ("h", "g"))
    order = np.argsort(h, kind="stable")
    return h[order], g[order]


def _new(*sorted_: np.ndarray) -> np.ndarray:
    """Where a run of equal entries of sorted arrays begins."""
    out = np.ones(len(sorted_[0]), bool)
    if len(out):
        out[1:] = False
        for x in sorted_:
            out[1:] |= x[1:] != x[:-1]
    return out


EXCHANGE = "bucket long, range long, block long, h binary, g binary, id binary, owner binary"


def _rows(keys: dict[str, np.ndarray], cut: np.ndarray, end: int, **columns: np.ndarray) -> pa.Table:
    """One row of the exchange for each stretch of entries that begins at ``cut``."""
    stop = np.append(cut, end)[1:]
    out = {c: pa.array(keys[c], pa.int64()) if c in keys else pa.nulls(len(cut), pa.int64()) for c in ("bucket", "range", "block")}
    return pa.table(out | {c: pa.array([columns[c][s:e].tobytes() if c in columns else b"" for s, e in zip(cut.tolist(), stop.tolist(), strict=True)], pa.binary()) for c in ("h", "g", "id", "owner")})


def _dealt(block: int, fan: int, span: int, h: np.ndarray, **more: np.ndarray) -> pa.Table:
    """The parts of a block by the leading bits of its hashes; h is sorted."""
    bucket = ((h >> U(32)) * U(fan)) >> U(32)
    cut = np.flatnonzero(_new(bucket))
    n = len(cut)
    return _rows({"bucket": bucket[cut].astype(I), "range": np.full(n, block // span), "block": np.full(n, block)}, cut, len(h), h=h, **more)


def _settled(table: pa.Table, buckets: int, first_stays: bool) -> pa.Table:
    """Entries that go back to their blocks, and, where there are buckets of a second level, one entry of each hash for it.

    A hash that occurs once goes nowhere on this level. Of one that occurs more often all entries go back or, with
    ``first_stays``, all but that of the smallest id. An entry without a block (owner -1) is known to repeat.
    """
    h, g, ids, owner = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in (("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("owner", "<i8")))
    if not len(owner):
        owner = np.repeat(table["block"].to_numpy(), [len(x.as_buffer()) // 8 for x in table["h"]])
    if not len(g):
        g, ids = np.zeros(len(h), U), np.zeros(len(h), I)
    order = np.lexsort((owner, ids, g, h))
    h, g, ids, owner = h[order], g[order], ids[order], owner[order]
    new = _new(h, g)
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(h) else new
    back = ~new if first_stays else many & (owner >= 0)
    by = np.argsort(owner[back], kind="stable")
    o, bh, bg = owner[back][by], h[back][by], g[back][by]
    cut = np.flatnonzero(_new(o))
    out = [_rows({"block": o[cut]}, cut, len(o), h=bh, g=bg)]
    if buckets:
        uh, ug, uid = h[new], g[new], ids[new]
        uo = owner[new] if first_stays else np.where(many[new], -1, owner[new])
        bucket = ((uh >> U(32)) * U(buckets)) >> U(32)
        cut = np.flatnonzero(_new(bucket))
        out.append(_rows({"bucket": bucket[cut].astype(I)}, cut, len(uh), h=uh, g=ug, id=uid, owner=uo))
    return pa.concat_tables(out)


def _exchange(sent: DataFrame, buckets: int, first_stays: bool, scratch: Scratch, label: str) -> DataFrame:
    """What goes back to the blocks (block, h, g) of what they have sent; buckets of the second level, 0 where there is one range."""
    near = scratch.keep(sent.groupBy("bucket", "range").applyInArrow(lambda table: _settled(table, buckets, first_stays), EXCHANGE), f"{label}-near")
    back = near.where("block is not null").select("block", "h", "g")
    if buckets:
        far = near.where("block is null").groupBy("bucket").applyInArrow(lambda table: _settled(table, 0, first_stays), EXCHANGE)
        back = back.unionByName(scratch.keep(far.select("block", "h", "g"), f"{label}-far"))
    return back


def remove_repeats(docs: DataFrame, window: int = 20, block_bytes: int = BLOCK_BYTES, fan: int = FAN, span: int = RANGE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for every row of ``docs`` (doc_id, text).

    A word goes when a window of ``window`` words covers it whose words also start earlier: in a document of a
    smaller doc_id, or earlier in the same one. Windows are judged on the input. kept_text holds the
    words that stay, joined by one space, and kept_sha256 its digest. Null and empty texts have no words.
    Rows that repeat a doc_id count as parts of one document in the order of their texts; rows without a doc_id come
    before all others, those of one text together, in a fixed order. An empty table gives no rows; other columns are not read.
    """
    if window < PERIOD + 2:
        raise ValueError(f"window must be {PERIOD + 2} or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("doc_id").isNull().alias("no_id"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(fan, -(-size // BUCKET_BYTES)) if blocks > span else 0
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.when(F.col("no_id"), F.col("text"))), F.lit(blocks)))
    dealt = scratch.keep_by(dealt, "block", min(-(-blocks // PART_BLOCKS), MOST_PARTS), "dealt")

    def first_pass(key, table):
        return _dealt(key[0].as_py(), fan, span, np.unique(_Block(table, window, second=False).anchors()[1]))

    sent = dealt.select("block", "doc_id", "text").groupBy("block").applyInArrow(first_pass, EXCHANGE)
    back = _exchange(sent, buckets, False, scratch, "anchors")

    def second_pass(key, left, right):
        b = _Block(left, window)
        at = b.candidates(_gathered(right)[0])
        h, g = windows(b.h, window)[at], windows_at(b.g, window, at)
        order = np.lexsort((g, h))  # stable: documents stand in the order of their ids
        order = order[_new(h[order], g[order])]
        ids = b.table["doc_id"].to_numpy()[b.doc[at[order]]] if len(order) else np.zeros(0, I)
        return _dealt(key[0].as_py(), fan, span, h[order], g=g[order], id=ids)

    sent = dealt.select("block", "doc_id", "text").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(second_pass, EXCHANGE)
    taken = _exchange(sent, buckets, True, scratch, "windows")

    def last_pass(key, left, right):
        b = _Block(left, window)
        w = windows(b.h, window)
        at = np.flatnonzero(b.left >= window)
        w = w[at]
        order = np.argsort(w, kind="stable")
        some = np.zeros(len(w), bool)
        same = ~_new(w[order])
        some[order[same]] = True
        if len(w) > 1:
            some[order[:-1][same[1:]]] = True
        th, tg = _gathered(right)
        some |= _member(w, th)
        # Of windows that may repeat: those of the block and, before them, those that are taken, by both hashes.
        i = np.flatnonzero(some)
        h, g = np.concatenate([th, w[i]]), np.concatenate([tg, windows_at(b.g, window, at[i])])
        order = np.lexsort((g, h))
        again = order[~_new(h[order], g[order])]
        later = np.zeros(len(w), bool)
        later[i[again[again >= len(th)] - len(th)]] = True
        edge = np.zeros(len(b.h) + window + 1, np.int32)
        np.add.at(edge, at[later], 1)
        np.add.at(edge, at[later] + window, -1)
        keep = np.cumsum(edge, dtype=np.int32)[: len(b.h)] == 0
        kept, sha = [], []
        for i, text in enumerate(b.table["text"]):
            got = (text.as_py() or "").encode().split()
            mask = keep[b.first[i] : b.first[i + 1]]
            if not mask.all():
                got = list(compress(got, mask))
            joined = b" ".join(got)
            kept.append(joined)
            sha.append(hashlib.sha256(joined).hexdigest())
        removed = np.add.reduceat(np.concatenate([~keep, [False]]), b.first[:-1]) if len(b.n) else np.zeros(0)
        removed = np.where(b.n > 0, removed, 0)
        return pa.table({"doc_id": b.table["doc_id"], "no_id": b.table["no_id"], "n_words": pa.array(b.n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(sha, pa.string())})

    out = dealt.groupBy("block").cogroup(taken.groupBy("block")).applyInArrow(last_pass, "doc_id long, no_id boolean, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_text", "kept_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words and more that stand earlier."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
