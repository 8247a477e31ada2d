"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A chunk ends after a line where the rolling hash of the last lines' hashes falls on a fixed residue, so a boundary
depends on the lines near it and not on their place: an insertion shifts text but not the chunks behind it.
A chunk has two lines at least: no boundary falls on its first line, and a lone last line joins the chunk before. It
has no largest size: only a run of like lines goes on without a boundary, and no cut inside it would follow its content.
Chunks of two lines and more that occur before in the corpus (in a smaller doc_id, or earlier in the same document)
are removed after their bytes are compared with the first occurrence of the same hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

#: A boundary hash looks at the last ROLL lines; one line in DIVISOR may end a chunk.
ROLL, DIVISOR = 2, 2
#: Occurrences are dealt by hash; those of a hash with more than HOT of them, or one in HOT_SHARE of all, by hash and SALTS.
HOT, HOT_SHARE, SALTS = 1000, 10_000, 64
#: Bytes of text of a part of the dealt documents, and parts at most.
PART_BYTES, MOST_PARTS = 1 << 25, 50_000


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def chunk_bounds(lines: Column, roll: int = ROLL, divisor: int = DIVISOR) -> Column:
    """array<struct<start, length>> of the chunks of an array of lines; of two lines and more, but for an array of one."""

    def bounds(h: Column) -> Column:
        def ends(i: Column) -> Column:
            mixed = F.xxhash64(*[F.when(i >= k, F.get(h, i - k)) for k in range(roll)])
            return F.pmod(mixed, F.lit(divisor)) == 0

        every, last = F.sequence(F.lit(0), F.size(h) - 1), F.size(h) - 1
        marks = F.array_join(F.transform(every, lambda i: F.when((i > 0) & ends(i), F.lit("1")).otherwise(F.lit("0"))), "")
        # Of marks in a row every second one counts, from the left.
        cut = let(F.split(F.regexp_replace(marks, "11", "10"), ""), lambda m: F.filter(every, lambda i: ((F.get(m, i) == "1") & (i < last - 1)) | (i == last)))

        def spans(c: Column) -> Column:
            start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(c, k - 1) + 1)
            return F.transform(c, lambda e, k: F.struct(start(k).alias("start"), (e - start(k) + 1).alias("length")))

        return let(cut, spans)

    return let(F.transform(lines, lambda x: F.xxhash64(x)), bounds)


def text_of(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span.start + 1, span.length), "\n")


def dedup_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut from text, and (n_lines, n_lines_removed, row columns as before).

    Reads doc_id and text and keeps all other columns (those of the two names, in any case, are replaced). A null text
    stays null and an empty one empty; both have no chunk of two lines. Rows of one doc_id with different texts are
    documents of their own, in the order of a hash of their texts; rows equal in both are one document, and each of
    them keeps what it keeps. Rows without a doc_id are kept as they are and are first occurrences for no one.
    Two-line chunks of blank lines only are left alone. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    names = ("n_lines", "n_lines_removed")
    others = [c for c in docs.columns if c.lower() not in names and c.lower() != "text"]
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])  # so that no column of docs clashes with those here
    text = F.col("text").cast("string")
    each = docs.select(own.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), text.alias("t"))
    # Dealt once by a hash of (id, key): the joins below move spans to the texts, never texts to spans.
    size = each.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    each = scratch.keep_by(each.withColumn("deal", F.xxhash64("id", "key")), "deal", min(-(-size // PART_BYTES), MOST_PARTS), "dealt")
    lines = F.split("t", "\n")
    base = each.select("deal", "id", "key", "t").where("id is not null and t is not null and position('\n' in t) > 0")

    def mine(spans: Column) -> Column:
        """Of spans dealt to a row, those of its own id and key: two rows may share a hash."""
        return F.filter(spans, lambda c: (c.id == F.col("id")) & (c.key == F.col("key")))

    def listed(a: Column) -> Column:
        spans = F.filter(chunk_bounds(a), lambda c: c.length >= least)
        return F.filter(F.transform(spans, lambda c: let(text_of(a, c), lambda t: F.when(t.rlike(r"[^\s]"), F.struct(c.start.alias("start"), c.length.alias("length"), F.xxhash64(t).alias("hash"))))), lambda c: c.isNotNull())

    narrow = scratch.keep(base.select("deal", "id", "key", F.explode(let(lines, listed)).alias("c")).select("deal", "id", "key", "c.*"), "chunks")
    repeated = scratch.keep(narrow.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    # At most HOT_SHARE hashes, so their broadcast has a fixed bound.
    hot = F.broadcast(scratch.keep(repeated.where(F.col("n") > max(HOT, total // HOT_SHARE)).select("hash", F.lit(True).alias("hot")), "hot"))

    def salted(df: DataFrame) -> DataFrame:
        """Occurrences (id, key, start, hash, ...) with the salt under which they are dealt."""
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", "key", "start"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
        return df.join(hot, "hash", "left").withColumn("salt", salt).drop("hot")

    def spread(df: DataFrame) -> DataFrame:
        """Rows (hash, ...) once for every salt that their hash is dealt under."""
        salts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        return df.join(hot, "hash", "left").withColumn("salt", F.explode(salts)).drop("hot")

    wanted = salted(narrow).join(spread(repeated.select("hash")), ["hash", "salt"], "left_semi")
    spans = wanted.groupBy("deal").agg(F.collect_set(F.struct("id", "key", "start", "length", "hash")).alias("spans"))
    # Texts move only of documents that hold a repeated hash, and of these only the chunks in question.
    held = base.join(spans, "deal").select("deal", "id", "key", F.struct(lines.alias("lines"), mine(F.col("spans")).alias("spans")).alias("s"))
    texts = let(F.col("s"), lambda s: F.transform(s.spans, lambda c: F.struct(c.start.alias("start"), c.length.alias("length"), c.hash.alias("hash"), text_of(s.lines, c).alias("chunk"))))
    some = scratch.keep(held.select("deal", "id", "key", F.explode(texts).alias("c")).select("deal", "id", "key", "c.*"), "texts")
    first = some.groupBy("hash", "chunk").agg(F.min(F.struct("id", "key", "start")).alias("first"))  # equal bytes, not only equal hashes
    drop = salted(some).join(spread(first), ["hash", "salt", "chunk"]).where(F.struct("id", "key", "start") != F.col("first"))
    drop = scratch.keep(drop.groupBy("deal").agg(F.collect_set(F.struct("id", "key", "start", "length")).alias("all")), "drop")
    scratch.drop(narrow, some)
    own_spans = F.transform(mine(F.col("all")), lambda c: F.struct(c.start.alias("start"), c.length.alias("length")))
    out = each.join(drop, "deal", "left").withColumn("spans", own_spans).drop("all")

    def gaps(s: Column) -> Column:
        """The lines between the spans."""
        k = F.size(s.spans)
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(s.spans, i - 1).start + F.get(s.spans, i - 1).length)
        end = lambda i: F.when(i == k, F.size(s.lines)).otherwise(F.get(s.spans, i).start)
        return F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.slice(s.lines, begin(i) + 1, end(i) - begin(i))))

    rest = F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.array_join(let(F.struct(lines.alias("lines"), F.sort_array("spans").alias("spans")), gaps), "\n"))
    removed = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")), F.lit(0), lambda n, c: n + c.length).cast("long")
    place = {c: f"c{i}" for i, c in enumerate(others)}
    shown = [F.col("row")[place[c]].alias(c) if c in place else rest.alias(c) for c in docs.columns if c.lower() not in names]
    return out.select(*shown, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), removed.alias("n_lines_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated chunks of lines."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text", "n_lines", "n_lines_removed")
