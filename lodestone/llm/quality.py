"""Quality rules by hashed n-gram log-likelihood ratios, with DataFrame functions only.

Word unigrams and bigrams are hashed to a fixed number of buckets. Two smoothed multinomials over the buckets, of the
trusted target (labelled good) and of the raw corpus (all documents), give each bucket a log-likelihood ratio. A
document's score is the mean ratio of its n-grams, so length does not count. The threshold follows from trusted
documents that were kept out of the target, and every document is held against it. All labelled rows count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

BUCKETS, SMOOTH = 1 << 18, 1.0
#: Bitmaps of 32,768 ids each that go to all tasks, some 64 MB; more, as of ids far apart, are joined.
BITMAPS = 1 << 14
#: Share of the held-back trusted documents that may fall under the threshold, and a margin below it.
MISSED, MARGIN = 0.001, 0.25
RUN = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def grams(h: Column) -> Column:
    """Buckets of all unigrams and bigrams of an array of word hashes."""
    pairs = F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), F.lit(BUCKETS)))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS))), F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))


def repeat_words(h: Column) -> Column:
    """Words under windows of RUN words that occur twice or more in the document, the first time included."""

    def covered(w: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(s, j + 1).h == x.h, F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x.i))

        order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(let(order, starts), zero, lambda acc, a: F.struct((acc.n + a + RUN - F.greatest(a, acc.end)).alias("n"), (a + RUN).alias("end")), lambda acc: acc.n)
        return F.when(F.size(F.array_distinct(w)) < F.size(w), total).otherwise(F.lit(0))

    last = F.size(h) - RUN
    w = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)]))
    return F.when(last >= 1, let(w, covered)).otherwise(F.lit(0))


def _trusted(labels: DataFrame) -> DataFrame:
    """(label_id, fits): all labelled good rows, half to fit the target, half to set the threshold."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality")).where("quality = 1 and label_id is not null")
    return good.select("label_id", (F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(2)) == 0).alias("fits"))


def _flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (id, ...) with fits, whether the id is among ``ids`` (id); these go to the tasks as bitmaps, so that no text is shuffled."""
    bits = ids.groupBy(F.bitmap_bucket_number("id").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    if bits.limit(BITMAPS + 1).count() <= BITMAPS:
        bits = F.broadcast(bits)
    at = F.bitmap_bit_position("id")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0, F.lit(False))
    return docs.withColumn("bucket_", F.bitmap_bucket_number("id")).join(bits, "bucket_", "left").withColumn("fits", found).drop("bucket_", "bits")


def _least(scores: DataFrame) -> float | None:
    """The MISSED percentile of ``scores`` (llr), None where there are none: only the lowest come together, not all in one task."""
    n = scores.count()
    if not n:
        return None
    at = (n - 1) * MISSED
    lower, upper = math.floor(at), math.ceil(at)
    top = [r.llr for r in scores.orderBy("llr").limit(upper + 1).orderBy(F.desc("llr")).limit(2).collect()]
    return top[0] if lower == upper else (upper - at) * top[1] + (at - lower) * top[0]


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    docs: doc_id, text and any other columns, which stay (those of these names, in any case, are replaced). labels: doc_id, quality.
    Null and empty texts have no words and fail the base rules. Without labels that say good, or where no labelled
    document is among docs, the ratio is 0 everywhere and only the base rules decide. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    trusted = scratch.keep(_trusted(labels), "trusted")
    key = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    flagged = _flagged(docs.select(key.alias("id"), text.alias("text")), trusted.where("fits").select(F.col("label_id").alias("id")))
    each = flagged.select(F.col("fits").cast("long").alias("fits"), F.explode(let(hashes, grams)).alias("bucket"))
    counts = scratch.keep(each.groupBy("bucket").agg(F.sum("fits").alias("target"), F.count("*").alias("raw")), "counts")
    t, r = counts.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("raw"), F.lit(0))).first()
    ratio = F.log((F.coalesce("target", F.lit(0)) + SMOOTH) / (t + SMOOTH * BUCKETS)) - F.log((F.coalesce("raw", F.lit(0)) + SMOOTH) / (r + SMOOTH * BUCKETS))
    table = spark.range(BUCKETS).toDF("bucket").join(counts, "bucket", "left").select("bucket", (ratio if t else F.lit(0.0)).cast("float").alias("ratio"))
    # A row of a fixed size, whatever the input: BUCKETS ratios in the order of the buckets.
    table = scratch.keep(table.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x.ratio).alias("ratios")), "ratios")

    def features(v: Column, ratios: Column) -> Column:
        def of(x: Column) -> Column:
            sums = let(grams(x.h), lambda g: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(ratios, b.cast("int"))) / F.greatest(F.size(g), F.lit(1)))
            return F.struct(
                F.size(x.w).cast("long").alias("n_words"), F.length(F.array_join(x.w, "")).cast("long").alias("word_chars"),
                repeat_words(x.h).cast("long").alias("n_repeat_words"), sums.alias("llr"),
            )

        return let(F.struct(v.alias("w"), F.transform(v, lambda w: F.xxhash64(w)).alias("h")), of)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])  # so that no column of docs clashes with those here
    some = docs.select(own.alias("row"), text.alias("t"), table.scalar().alias("ratios"), key.alias("id"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    some = some.select(
        "row", "id", let(F.struct(words(F.col("t")).alias("w"), F.col("ratios").alias("r")), lambda x: features(x.w, x.r)).alias("f"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
    )
    some = some.select("row", "id", "f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words", "f.llr")
    some = some.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    scored = scratch.keep(some, "scored")
    held_back = scored.select("id", "llr", "base_failed").join(trusted.where("not fits"), F.col("id") == F.col("label_id"), "left_semi").where("not base_failed")
    least = _least(held_back.select("llr"))
    floor = least - MARGIN if least is not None else float("-inf")
    return scored.select("row.*", *names[:5], "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= F.lit(floor))).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the ratio's verdict for all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs.select("doc_id", "text"), labels)
    return out.drop("text")
