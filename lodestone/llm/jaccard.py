"""Exact near-duplicate classes by Jaccard similarity of word shingles, with a token-group matrix.

1. Every text becomes a set of 64-bit shingle hashes. Equal sets are one class and go on as one row.
2. All tokens get one global order: by a frequency sketch of fixed size over the whole corpus, rare ones first.
   Two sets that are similar enough share a token of their *prefixes* (the first ``n - ceil(t n) + 1`` tokens).
3. Documents are tied to a few centres that share a prefix token; verified ties make groups of similar documents.
4. A group stores the union of its members' tokens. A document of another group that shares a prefix token
   with a group is a query. Two bounds keep groups shut: how many tokens
   stand behind the shared one in the query and in the members, before any text moves; then the query's overlap with
   the union of whole sets. Groups whose bounds reach the threshold are opened, and members are compared one by one
   until one matches. Pairs inside a group need no look: they are connected already.
No step makes all pairs of a group, and none drops a candidate. A token that many small groups hold in their prefixes does
meet as many queries as groups. Keys of two tokens for such tokens made more rows, as documents that share many tokens
then meet under all pairs of them; bands of set sizes in the key cost more than they saved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.hashing import LOWER, mix, windows, words
from lodestone.llm.scratch import Scratch

#: Counters of the frequency sketch, a fixed size: its broadcast has four bytes for each.
SKETCH = 1 << 21
CHUNK = 1 << 16
#: Members of one part of a group.
PART = 128
SLICE = 256
#: Shingles for each file of a table, and files that a table may have at least.
PART_SHINGLES, LEAST_PARTS = 1 << 20, 48


def shingle_sets(column: pa.Array, k: int):
    """The sorted set of shingle hashes of every row; fewer than k words make one shingle, none make none."""
    for at in range(0, len(column), SLICE):
        part = column.slice(at, SLICE)
        h, first = words(part, LOWER)
        w = windows(h, k)
        for i in range(len(part)):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(w[a : b - k + 1])
            elif b > a:
                yield windows(h[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _text(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sketch(spark: SparkSession, docs: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """Occurrences in sets by counter, over all documents."""

    def count(batches):
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [s & np.uint64(SKETCH - 1) for s in shingle_sets(_text(part), k)]
                total += np.bincount(np.concatenate(sets).astype(np.int64), minlength=SKETCH)
        if total.any():
            salt = int(np.random.default_rng(int(total.sum())).integers(64))
            yield pa.record_batch({"chunk": pa.array(range(SKETCH // CHUNK), pa.int32()), "salt": pa.array([salt] * (SKETCH // CHUNK), pa.int32()), "counts": pa.array([total[c : c + CHUNK].astype("<i8").tobytes() for c in range(0, SKETCH, CHUNK)], pa.binary())})

    def add(key, table):
        total = np.zeros(CHUNK, dtype=np.int64)
        for x in table["counts"]:
            total += np.frombuffer(x.as_buffer(), dtype="<i8")
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    schema = "chunk int, salt int, counts binary"
    some = docs.select("text").mapInArrow(count, schema).groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary")
    rows = some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()  # SKETCH / CHUNK rows
    total = np.zeros(SKETCH, dtype=np.int64)
    for r in rows:
        total[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, dtype="<i8")
    return np.minimum(total, 0xFFFFFFFF).astype(np.uint32)


def _sets(docs: DataFrame, k: int, num: int, den: int, sketch) -> DataFrame:
    """(doc_id, text_hash, n, high, low, prefix): size and 128-bit digest of the set, and its prefix tokens in the global order."""

    def run(batches):
        order = sketch.value
        for batch in batches:
            ids = _text(batch, "doc_id")
            n, high, low, prefix = [], [], [], []
            for s in shingle_sets(_text(batch), k):
                size = len(s)
                n.append(size)
                with np.errstate(over="ignore"):
                    high.append(int(s.sum(dtype=np.uint64).view(np.int64)) if size else 0)
                    low.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if size else 0)
                if size and den * size >= num * (size + 1):
                    length = size - (num * size + den - 1) // den + 1
                    rank = order[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                    prefix.append(s[np.lexsort((s, rank))[:length]].view(np.int64))
                else:
                    prefix.append(np.zeros(0, np.int64))
            sizes = np.cumsum([0, *map(len, prefix)])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.record_batch({"doc_id": ids.cast(pa.int64()), "text_hash": _text(batch, "text_hash"), "n": pa.array(n, pa.int64()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64()), "prefix": pa.LargeListArray.from_arrays(pa.array(sizes, pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, high long, low long, prefix array<long>")


def _open(rows: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b). rows: (key, doc, query); each query is held against the group of its key.

    The rows of a key come together, members first. The union of the members' tokens bounds a query's
    overlap with any of them; a group that can't reach the threshold stays shut.
    """

    def run(batches):
        key, ids, sets, union = None, [], [], None
        for batch in batches:
            keys, doc, query = (_text(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "query"))
            a, b = [], []
            for i, s in enumerate(shingle_sets(_text(batch), k)):
                if keys[i] != key:
                    key, ids, sets, union = keys[i], [], [], None
                if not query[i]:
                    ids.append(int(doc[i]))
                    sets.append(s)
                    continue
                if not ids:
                    continue
                if union is None:
                    union = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
                n = len(s)
                hit = s[_within(s, union)]
                if den * len(hit) < num * n:  # the overlap with a member is at most this, and no less than t n is needed
                    continue
                for d, m in zip(ids, sets, strict=True):
                    if den * min(n, len(m)) < num * max(n, len(m)):
                        continue
                    both = int(_within(hit, m).sum())
                    if den * both >= num * (n + len(m) - both):
                        a.append(int(doc[i]))
                        b.append(d)
                        break
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = rows.hint("merge").join(texts, "doc").select("key", "query", "doc", "text")
    return full.repartition("key").sortWithinPartitions("key", "query").mapInArrow(run, "a long, b long")


def _within(s: np.ndarray, other: np.ndarray) -> np.ndarray:
    at = np.searchsorted(other, s)
    at[at == len(other)] = 0
    return other[at] == s if len(other) else np.zeros(len(s), bool)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, group) for every row of ``docs`` (doc_id, text; other columns are not read).

    Two documents link when ``den * |A and B| >= num * |A or B|`` over their sets of k-word shingles, lower-cased
    in A-Z; component_id is the smallest doc_id that links reach, and group a number of the class in this result. A
    null or empty text, or one without words, has no shingles and links with nothing: its own id is its component and
    its group is null, as is that of a row without a doc_id, whose component is null. Rows that repeat a doc_id are
    classed each by its own text, which text_hash tells apart. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    counts = _sketch(spark, docs, k, scratch)
    sketch, files = spark.sparkContext.broadcast(counts), max(LEAST_PARTS, int(counts.sum(dtype=np.int64)) // PART_SHINGLES)
    keep = lambda df, label: scratch.keep(df, label, files)
    sets = scratch.keep(_sets(docs, k, num, den, sketch), "sets")
    known = sets.where("doc_id is not null and n > 0")
    whole = known.groupBy("high", "low", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("prefix").alias("prefix"))
    whole = keep(whole.select(F.monotonically_increasing_id().alias("doc"), "high", "low", "n", "rep.*", "prefix"), "whole")
    every = keep(sets.select("doc_id", "text_hash", "n", "high", "low"), "every")
    scratch.drop(sets)  # tables go as soon as a narrower one has what later steps read
    length = F.col("n") - F.floor((num * F.col("n") + den - 1) / den) + 1
    tokens = whole.select("doc", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("doc").alias("centre")).where("df > 1")
    tokens = keep(tokens.join(shared, "token"), "tokens")  # of tokens in two prefixes or more
    classes = keep(whole.drop("prefix"), "classes")
    scratch.drop(whole)
    # The texts of classes that share a token, once each; rows that repeat one are combined where the join leaves them.
    wanted = classes.join(tokens.select("doc"), "doc", "left_semi").select("doc", "doc_id", "text_hash")
    texts = docs.join(wanted, ["doc_id", "text_hash"]).groupBy("doc_id", "text_hash", "doc").agg(F.first("text").alias("text"))
    texts = keep(texts.select("doc", "text"), "texts")

    # A document whose prefix is shared in good part is held against the centres of its two rarest and its two
    # commonest shared tokens. This only finds groups early; step 4 sees to all the rest.
    picks = tokens.groupBy("doc", "n").agg(
        F.count("*").alias("in_common"),
        F.array(F.min(F.struct("pos", "centre")).centre, F.max(F.struct("df", "pos", "centre")).centre, F.min(F.struct("df", "pos", "centre")).centre, F.max(F.struct("pos", "centre")).centre).alias("centres"),
    ).where(10 * F.col("in_common") >= 3 * length)
    ties = picks.select("doc", F.explode(F.array_distinct("centres")).alias("centre")).where("doc <> centre")
    ties = keep(ties.select(F.col("doc"), "centre", F.pmod(F.xxhash64("doc"), F.lit(1 << 30)).alias("u")), "ties")
    spread = ties.groupBy("centre").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("salts"))
    salts = ties.join(spread, "centre").select("doc", F.xxhash64("centre", F.pmod("u", "salts")).alias("key"), F.lit(True).alias("query"))
    centres = spread.select(F.col("centre").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    centres = centres.select("doc", F.xxhash64("doc", F.col("salt").cast("long")).alias("key"), F.lit(False).alias("query"))
    links = keep(_open(salts.unionByName(centres), texts, k, num, den), "ties-verified")
    first = components(links, scratch, files).withColumnRenamed("node", "doc")

    # Groups of similar documents: what is tied so far. Their parts are of near sizes, by bands and a hash.
    sized = classes.select("doc", "n").join(first, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sized = keep(sized.join(tokens.select("doc"), "doc", "left_semi"), "sized")
    grouped = keep(tokens.select("doc", "pos", F.col("token").alias("meet")).join(sized, "doc"), "grouped")
    scratch.drop(tokens, ties)
    fine = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num) / 5)))
    members = sized.withColumn("band", fine)
    parts_of = members.groupBy("component", "band").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    members = members.join(parts_of, ["component", "band"]).select("doc", "n", "component", F.xxhash64("component", "band", F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("key"))
    members = keep(members, "members")
    parts = members.groupBy("component", "key").agg(F.min("n").alias("part_least"), F.max("n").alias("part_most"))
    heads = members.groupBy("component").agg(F.count("*").alias("heads"))
    # Two sets need num (n + m) / (num + den) common tokens. Of a pair that is similar enough take the first common
    # token in the global order: all common tokens stand there or behind it, in both sets. So n - pos reaches that
    # number in either set, and the pair meets at this token; a row that falls short on a side is no such meeting.
    slack = (num + den) * (F.col("n") - F.col("pos")) - num * F.col("n")
    unions = grouped.groupBy("meet", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(slack).alias("most_slack")).join(heads, "component")
    multi = unions.groupBy("meet").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("meet")
    asks = grouped.join(multi, "meet").join(heads, "component").select("meet", "doc", "n", slack.alias("slack"), F.col("component").alias("own"), F.col("heads").alias("own_heads"))
    smaller = (F.col("own_heads") < F.col("heads")) | ((F.col("own_heads") == F.col("heads")) & (F.col("own") > F.col("component")))
    near = (den * F.col("n") >= num * F.col("least")) & (den * F.col("most") >= num * F.col("n"))
    first_common = (F.col("most_slack") >= num * F.col("n")) & (F.col("slack") >= num * F.col("least")) & (den * F.col("slack") >= num * num * F.col("n"))
    asks = asks.join(unions, "meet").where((F.col("own") != F.col("component")) & smaller & near & first_common)
    asks = asks.select("doc", "n", "component").distinct()
    fits = (den * F.col("n") >= num * F.col("part_least")) & (den * F.col("part_most") >= num * F.col("n"))
    asks = asks.join(parts, "component").where(fits).select("doc", "key")
    asks = keep(asks.withColumn("u", F.pmod(F.xxhash64("doc"), F.lit(1 << 30))), "asks")
    scratch.drop(grouped)
    opened = asks.groupBy("key").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("salts"))
    queries = asks.join(opened, "key").select("doc", F.xxhash64("key", F.pmod("u", "salts")).alias("key"), F.lit(True).alias("query"))
    inside = members.join(opened, "key").select("doc", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key")
    inside = inside.select("doc", F.xxhash64("key", F.col("salt").cast("long")).alias("key"), F.lit(False).alias("query"))
    more = keep(_open(queries.unionByName(inside), texts, k, num, den), "opened")
    scratch.drop(texts, asks, members, sized)
    label = components(links.unionByName(more), scratch, files).toDF("doc", "group")
    of_class = keep(classes.select("doc", "high", "low", "n", "doc_id").join(label, "doc", "left").withColumn("group", F.coalesce("group", "doc")), "of-class")
    least = of_class.groupBy("group").agg(F.min("doc_id").alias("component"))
    of_class = of_class.join(least, "group").select("high", "low", "n", "group", "component")
    out = every.join(of_class, ["high", "low", "n"], "left")
    has = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(has, F.coalesce("component", "doc_id")).alias("component_id"), F.when(has & (F.col("n") > 0), F.col("group")).alias("group"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")
