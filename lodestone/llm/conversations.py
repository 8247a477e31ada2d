"""Prefix trie of conversations by prefix doubling.

1. Turns are numbered within their conversations over ranges of (conversation, turn), so that a conversation of any
   length spreads over tasks.
2. Every distinct turn gets a dense number, its name. In each of a logarithm of rounds, two neighbouring blocks of
   names make one of twice the length at a place divisible by it, and each distinct pair gets a dense number.
3. The first d turns are the blocks of the binary decomposition of d, in order; their names are the prefix's name. Equal
   prefixes, and no others, have equal names, so nodes are groups of (d, names).
4. A node is known by its smallest member and its depth. A conversation is the smallest member of nodes on one stretch
   of depths down to its end. What lies below a node is so a sum over its members of what each has on its own
   stretch, from that depth on: no walk over the levels of the tree is needed.
5. Members that end at a node are sorted over ranges and joined to pieces, and the pieces are digested as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch
from lodestone.llm.skew import dense, lookup

#: Depths of a conversation that one window takes, and depths that one row is spread over at a time.
SPAN, SPREAD = 1 << 12, 1 << 12
#: Conversations a group, and the borrowed turns' divisor, of the rebuilt conversations.
GROUP, BORROWED = 5, 9
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, digest, bytes) of ``conversations`` (conv_id, turn, role, text): turns in order from 0.

    digest is that of role and text, bytes the UTF-8 length of the text. Turns are ordered with null first, and turns of one
    number by their digests; null role and text count as empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    by = ["conv_id", "turn", "digest"]

    def count(batches):
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            at = np.arange(len(conv))
            new = np.concatenate([[True], conv[1:] != conv[:-1]])
            local = at - np.maximum.accumulate(np.where(new, at, 0))
            if conv[0] == last:
                head = len(conv) if not new[1:].any() else int(np.flatnonzero(new[1:])[0]) + 1
                local[:head] += n
            last, n = conv[-1], int(local[-1]) + 1
            yield pa.record_batch([batch.column(0), pa.array(local, pa.int64()), batch.column(2), batch.column(3)], ["conv_id", "local", "digest", "bytes"])

    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(count, "conv_id long, local long, digest binary, bytes long")
    kept = scratch.keep(dealt.withColumn("part", F.spark_partition_id()), "dealt")
    ends = kept.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last")).collect()  # a row a range
    before, conv, n = [], None, 0
    for r in sorted(ends):
        before.append((r.part, r.first, n if r.first == conv else 0))
        n = r.last.local + 1 + (n if r.last.conv_id == conv else 0)
        conv = r.last.conv_id
    before = F.broadcast(kept.sparkSession.createDataFrame(before, "part int, conv_id long, before long"))
    return kept.join(before, ["part", "conv_id"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, bytes) and conversations (conv_id, size), every one with the head of its group's first.

    Conversation c takes the first h turns of c - c % 5 in place of its own first h, with h = crc32(c) % 9; c may be left
    without turns.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": F.crc32(F.col("conv_id").cast("string")) % BORROWED})
    convs = scratch.keep(convs, "own")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(sizes, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = scratch.keep(convs.select("conv_id", "n", "base", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("size")), "convs")
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tail = lookup(turns, convs, ["conv_id"], total).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "bytes")
    first = turns.where(F.col("pos") < BORROWED).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    head = first.join(convs.select("conv_id", "base", "head"), "base").where("pos < head").select("conv_id", "pos", "digest", "bytes")
    return tail.unionByName(head), convs.select("conv_id", "size")


def _blocks(turns: DataFrame, convs: DataFrame, longest: int, scratch: Scratch) -> list[DataFrame]:
    """By level k, (conv_id, size, j, name): the name of the turns from j * 2**k up to the next such place; level 0 has bytes too."""
    sized = scratch.keep(turns.join(convs, "conv_id"), "turns")
    names, _, total = dense(sized, ["digest"], scratch, "names")
    out = [scratch.keep(lookup(sized, names, ["digest"], total).select("conv_id", "size", F.col("pos").alias("j"), "name", "bytes"), "blocks")]
    for k in range(1, max(1, longest.bit_length())):
        even = F.col("j") % 2 == 0
        pairs = out[-1].groupBy("conv_id", "size", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right"))
        pairs = scratch.keep(pairs.where("left is not null and right is not null"), f"pairs{k}")
        names, _, total = dense(pairs, ["left", "right"], scratch, f"names{k}")
        out.append(scratch.keep(lookup(pairs, names, ["left", "right"], total).select("conv_id", "size", "j", "name"), f"blocks{k}"))
    return out


def _prefixes(blocks: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, size, key, bytes): the names of every conversation's first turns, largest block last."""
    base = blocks[0].select("conv_id", "size", (F.col("j") + 1).alias("depth"), "bytes", F.when(F.col("j") % 2 == 0, F.struct(F.lit(0).alias("k"), "name")).alias("part"))
    every = base
    for k, level in enumerate(blocks[1:], 1):
        # Block j of level k, j even, is a part of each prefix whose decomposition has it: those that end within its sibling.
        low, high = (F.col("j") + 1) * (1 << k), F.least(F.col("size"), (F.col("j") + 2) * (1 << k) - 1)
        some = level.where("j % 2 = 0").select("conv_id", "size", "name", low.alias("low"), high.alias("high"))
        some = some.withColumn("step", F.explode(F.sequence(F.floor(F.col("low") / SPREAD), F.floor(F.col("high") / SPREAD))))
        depth = F.explode(F.sequence(F.greatest("low", F.col("step") * SPREAD), F.least("high", F.col("step") * SPREAD + SPREAD - 1)))
        some = some.withColumn("depth", depth).select("conv_id", "size", "depth", F.lit(None).cast("long").alias("bytes"), F.struct(F.lit(k).alias("k"), "name").alias("part"))
        every = every.unionByName(some)
    key = F.transform(F.sort_array(F.collect_list("part")), lambda p: p["name"])
    return every.groupBy("conv_id", "depth").agg(F.first("size").alias("size"), key.alias("key"), F.max("bytes").alias("bytes"))


def _sums(rows: DataFrame, root: int, longest: int) -> DataFrame:
    """Per node (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens); rows: (conv_id, depth, size, rep, n, deepest, bytes)."""
    own = F.col("rep") == F.col("conv_id")
    leaf = own & (F.col("depth") == F.col("size")) & (F.col("deepest") == F.col("depth"))
    rows = rows.withColumns({"weight": F.when(own, (F.col("n") - 1) * F.col("bytes")).otherwise(F.lit(0)), "leaf": leaf.cast("long")})
    span, ghost = F.floor(F.col("depth") / SPAN), F.lit(True)
    # A window takes SPAN depths of a conversation, and the row before and the one behind them as ghosts.
    places = [F.when(F.lit(True), F.struct(span.alias("span"), F.lit(False).alias("ghost"))), F.when(F.col("depth") % SPAN == SPAN - 1, F.struct((span + 1).alias("span"), ghost.alias("ghost"))), F.when(F.col("depth") % SPAN == 0, F.struct((span - 1).alias("span"), ghost.alias("ghost")))]
    rows = rows.withColumn("place", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull()))).select("*", "place.span", "place.ghost").drop("place")
    along = Window.partitionBy("conv_id", "span").orderBy("depth")
    down = Window.partitionBy("conv_id", "span").orderBy(F.desc("depth"))
    rows = rows.withColumns(
        {
            "above": F.lag("rep").over(along),
            "child": F.coalesce(F.lead("rep").over(along) == F.col("conv_id"), F.lit(False)).cast("long"),
        }
        | {c: F.sum(F.when(~F.col("ghost"), F.col(of)).otherwise(F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, 0)) for c, of in (("below", "weight"), ("leaves", "leaf"))}
    ).where("not ghost")
    if longest >= SPAN:  # what later spans hold
        behind = Window.partitionBy("conv_id").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
        later = rows.groupBy("conv_id", "span").agg(F.sum("weight").alias("w"), F.sum("leaf").alias("l"))
        later = later.select("conv_id", "span", F.coalesce(F.sum("w").over(behind), F.lit(0)).alias("later_w"), F.coalesce(F.sum("l").over(behind), F.lit(0)).alias("later_l"))
        rows = rows.join(later, ["conv_id", "span"]).withColumns({"below": F.col("below") + F.col("later_w"), "leaves": F.col("leaves") + F.col("later_l")})
    parent = F.when(own, F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("above")))
    return rows.groupBy(F.col("rep").alias("conv_id"), "depth").agg(
        F.max(parent).alias("parent_conv_id"), F.max("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("below").alias("saved_tokens")
    )


def digest_lists(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ends (conv_id, depth, member): the digest of each node's members, ascending, joined by commas.

    Members are sorted over ranges and joined to pieces of a batch at most; the pieces of a node pass its digest one by one.
    """

    def join(batches):
        for batch in batches:
            conv, depth, member = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])])) if len(conv) else np.zeros(0, np.int64)
            stop = np.append(cut, len(conv))[1:]
            pieces = [",".join(map(str, member[s:e].tolist())) for s, e in zip(cut.tolist(), stop.tolist(), strict=True)]
            yield pa.record_batch({"conv_id": pa.array(conv[cut], pa.int64()), "depth": pa.array(depth[cut], pa.int64()), "first": pa.array(member[cut], pa.int64()), "piece": pa.array(pieces, pa.string())})

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            done = []
            for conv, depth, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (conv, depth) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (conv, depth), hashlib.sha256()
                sha.update(piece.encode())
            yield _digests(done)
        yield _digests([(*key, sha.hexdigest())] if key is not None else [])

    def _digests(rows):
        return pa.record_batch({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "depth": pa.array([r[1] for r in rows], pa.int64()), "ends_sha256": pa.array([r[2] for r in rows], pa.string())})

    by = ["conv_id", "depth", "member"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, "conv_id long, depth long, first long, piece string")
    pieces = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return pieces.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row for each distinct sequence of first turns of ``convs`` (conv_id, size), with ``turns`` (conv_id, pos, digest, bytes).

    conv_id is the smallest conversation that starts so, depth its turns, parent_conv_id that of the sequence without the last
    turn (the root's is null); n_convs counts the conversations, n_children the sequences of one more turn, n_leaves those
    that go no further below it or at it; saved_tokens adds, over it and all below, (n_convs - 1) times the bytes of the
    last text; ends_sha256 is the digest of the conversations that end there. conv_id and depth give the texts of a row: it
    has the first turns of that conversation. Conversations without turns belong to the root, and none at all give no rows.
    """
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    root, longest, n_all = convs.agg(F.min("conv_id"), F.max("size"), F.count("*")).first()
    longest = longest or 0
    blocks = _blocks(turns, convs, longest, scratch)
    keyed = scratch.keep(_prefixes(blocks), "prefixes")
    nodes = keyed.groupBy("depth", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.max("size").alias("deepest"), F.first("bytes").alias("bytes"))
    nodes = scratch.keep(nodes, "nodes")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = scratch.keep(lookup(keyed.drop("bytes"), nodes, ["depth", "key"], total).drop("key"), "rows")
    sums = scratch.keep(_sums(rows, root, longest), "sums")
    top = sums.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = top.where(F.lit(n_all > 0)).select(
        F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_all).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    ends = rows.where("depth = size").select(F.col("rep").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    ends = ends.unionByName(convs.where("size = 0").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member")))
    out = sums.select(*top.columns).unionByName(top).join(digest_lists(ends), ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).select(*top.columns, "ends_sha256")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text); other columns are not read.

    Nulls, ties and rows without a conv_id as in ``numbered``, repeated rows are turns of their own; texts of any length move
    as digests; an empty table gives no rows.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = rebuilt(numbered(conversations, scratch), scratch)
    return prefix_trie(turns, convs, scratch)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of all rebuilt conversations."""
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
