"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking multiplies the cells by factors, one margin after
the other, until the margins have their target shares; margins that the caller gives are raked last, so that they hold
where they contradict the others. A document's inclusion probability is its cell's fitted tokens over its actual ones,
scaled so that the expected sample has the wanted size and no probability exceeds 1. A document stays when a uniform
number made from its id falls below that probability, so the sample is the same on every run.

Topics are groups of words that occur together: words are hashed to BUCKETS, the buckets' co-occurrences in runs of
CONTEXT words are counted over the whole corpus (a table of fixed size, in exact integers), and the buckets are
clustered by the leading eigenvectors of their positive pointwise mutual information. A text's topic is the one whose
words it holds most often for their share of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.hashing import LOWER, words
from lodestone.llm.scratch import Scratch

TOPICS, BUCKETS, CONTEXT = 8, 512, 64
#: Words of an average text that are mixed into a text before its topics are compared, so that a few words don't decide.
PRIOR_WORDS = 20
#: Margins of up to this many values are raked on the driver; larger ones in tables, to the same shares.
VALUES = 64
#: Rows of the probability table that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
ROUNDS, CLOSE = 200, 1e-9
#: What targets leave to other values counts as nothing below this.
NOTHING = 1e-9
SLICE = 256


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words of all texts, in order, and each text's first word (one more than texts)."""
    h, first = words(column, LOWER)
    return (h % np.uint64(BUCKETS)).astype(np.int64), first


def cooccurrences(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many runs of CONTEXT words hold a word of both buckets, for all pairs, and all words by bucket; exact over all rows."""

    def run(batches):
        total, n = np.zeros((BUCKETS, BUCKETS), dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b, first = _buckets(batch.column(0).slice(at, SLICE))
                size = np.diff(first)
                runs = -(-size // CONTEXT)
                doc = np.repeat(np.arange(len(size)), size)
                own = (np.cumsum(runs) - runs)[doc] + (np.arange(len(b)) - first[:-1][doc]) // CONTEXT
                n += np.bincount(b, minlength=BUCKETS)
                for low in range(0, int(runs.sum()), 2048):
                    i, j = np.searchsorted(own, [low, low + 2048])
                    x = np.zeros((2048, BUCKETS), dtype=np.float32)
                    x[own[i:j] - low, b[i:j]] = 1
                    total += (x.T @ x).astype(np.int64)  # below 2 ** 24, so exact
        if n.any():
            salt = TaskContext.get().partitionId() % 16
            rows = [r.tobytes() for r in (*total, n)]
            yield pa.record_batch({"row": pa.array(range(BUCKETS + 1), pa.int32()), "salt": pa.array([salt] * (BUCKETS + 1), pa.int32()), "counts": pa.array(rows, pa.binary())})

    def add(key, table):
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in table["counts"])
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "row int, salt int, counts binary"
    some = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema).groupBy("row", "salt").applyInArrow(add, "row int, counts binary")
    rows = some.groupBy("row").applyInArrow(add, "row int, counts binary").collect()  # BUCKETS + 1 rows
    total = np.zeros((BUCKETS + 1, BUCKETS), dtype=np.int64)
    for r in rows:
        total[r.row] = np.frombuffer(r.counts, "<i8")
    return total[:-1], total[-1]


def topic_model(together: np.ndarray, n: np.ndarray, topics: int) -> tuple[np.ndarray, np.ndarray]:
    """The topic of every bucket, and every topic's share of all words."""
    own = np.diag(together).astype(np.float64)
    used = np.flatnonzero(own)
    label = np.zeros(BUCKETS, dtype=np.int64)
    if len(used):
        pair = together[np.ix_(used, used)].astype(np.float64)
        side = pair.sum(axis=1)
        mutual = np.maximum(np.log(np.maximum(pair, 1e-300) * pair.sum() / np.outer(side, side)), 0.0)
        label[used] = _clusters(mutual, own[used], topics)
    share = np.bincount(label, weights=n, minlength=topics).astype(np.float64)
    return label, share / max(1.0, share.sum())


def _clusters(mutual: np.ndarray, own: np.ndarray, topics: int) -> np.ndarray:
    """Groups of buckets whose rows of ``mutual`` point the same way."""
    np.fill_diagonal(mutual, 0.0)
    value, vector = np.linalg.eigh(mutual)
    at = vector[:, -topics:] * np.sqrt(np.maximum(value[-topics:], 0.0))
    length = np.sqrt((at * at).sum(axis=1, keepdims=True))
    at = np.round(at / np.where(length > 0, length, 1.0), 9)
    centre = at[[int(np.argmax(own))]]
    for _ in range(1, min(topics, len(at))):  # the farthest from all centres so far is the next
        centre = np.vstack([centre, at[int(np.argmin((at @ centre.T).max(axis=1)))]])
    label = (at @ centre.T).argmax(axis=1)
    for _ in range(50):
        moved = np.array([at[label == k].sum(axis=0) if (label == k).any() else centre[k] for k in range(len(centre))])
        centre = moved / np.maximum(np.sqrt((moved * moved).sum(axis=1, keepdims=True)), 1e-12)
        new = (at @ centre.T).argmax(axis=1)
        if np.array_equal(new, label):
            break
        label = new
    return label


def topic_of(text: Column, model) -> Column:
    """The topic of every text by a broadcast ``topic_model``; -1 without a word. Ties go to the smaller topic."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        (label, share), out = model.value, []
        topics = len(share)
        for at in range(0, len(column), SLICE):
            b, first = _buckets(column.slice(at, SLICE))
            size = np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)
            held = np.bincount(doc * topics + label[b], minlength=len(size) * topics).reshape(-1, topics)
            lift = np.where(share > 0, (held + PRIOR_WORDS * share) / np.where(share > 0, share, 1.0), -1.0)
            out += [str(t) if n else "-1" for t, n in zip(lift.argmax(axis=1), size, strict=True)]
        return pa.array(out, pa.string())

    return run(text)


def rake(cells: dict[tuple, float], targets: list[dict], given: tuple[int, ...] = (), rounds: int = ROUNDS, close: float = CLOSE) -> dict[tuple, float]:
    """Shares of the cells whose margins are the targets, as near to the cells' own proportions as raking brings them.

    Target values without a cell are left out and the others scaled up; values without a target keep what is left
    in their own proportions. Where targets contradict each other, those of the margins in ``given`` hold, the last one first.
    """
    keys = sorted(cells)
    x = np.array([max(0.0, cells[k]) for k in keys])
    if not keys or x.sum() <= 0:
        return dict.fromkeys(keys, 0.0)
    x = x / x.sum()
    margins = []
    for d in sorted(range(len(targets)), key=lambda d: (d in given, d)):
        target = targets[d]
        names = sorted({k[d] for k in keys})
        index = {n: i for i, n in enumerate(names)}
        at = np.array([index[k[d]] for k in keys])
        own = np.bincount(at, weights=x, minlength=len(names))
        want = np.array([max(0.0, target[n]) if n in target else np.nan for n in names], dtype=float)
        want[own <= 0] = 0.0
        free = np.isnan(want)
        if free.any():
            left = max(0.0, 1 - np.nansum(want))
            left = left if left > NOTHING else 0.0
            want[free] = own[free] / own[free].sum() * left if own[free].sum() else 0.0
        if want.sum() > 0:
            margins.append((at, want / want.sum()))
    for _ in range(rounds):
        worst = 0.0
        for at, want in margins:
            own = np.bincount(at, weights=x, minlength=len(want))
            factor = np.divide(want, own, out=np.zeros_like(want), where=own > 0)
            worst = max(worst, float(np.abs(own - want).max()))
            x = x * factor[at]
        if worst < close:
            break
    return dict(zip(keys, x.tolist(), strict=True))


def inclusion(cells: dict[tuple, float], shares: dict[tuple, float], budget: float, strict: bool = False) -> dict[tuple, float]:
    """Probability of each cell's documents, for an expected sample of ``budget`` tokens.

    What a full cell can't give, others give; with ``strict`` the sample becomes smaller instead, so that shares hold.
    """
    keys = sorted(cells)
    have, want = np.array([cells[k] for k in keys], dtype=float), np.array([shares[k] for k in keys], dtype=float)
    p = np.zeros(len(keys))
    some = (want > 0) & (have > 0)
    budget = min(budget, float(have[some].sum()))
    if strict and some.any():
        budget = min(budget, float((have[some] / want[some]).min() * want[some].sum()))
    full = np.zeros(len(keys), bool)
    for _ in range(len(keys) + 1):
        open_ = ~full & some
        if not open_.any():
            break
        scale = max(0.0, budget - have[full].sum()) / want[open_].sum()
        p[open_] = scale * want[open_] / have[open_]
        over = open_ & (p > 1 + 1e-12)
        if not over.any():
            break
        full |= over
        p[full] = 1.0
    return dict(zip(keys, np.clip(p, 0, 1).tolist(), strict=True))


def smoothed(cells: dict[tuple, float], d: int, power: float) -> dict:
    """Target shares of a margin: its own shares to a power below 1, which lifts small values."""
    own: dict = {}
    for k in sorted(cells):
        own[k[d]] = own.get(k[d], 0.0) + cells[k]
    raised = {k: v**power for k, v in own.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def _value(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("v:"), F.col(name).cast("string")), F.lit("none"))


def _raked_in_tables(cells: DataFrame, targets: list[dict], share: float, power: float, strict: bool, scratch: Scratch, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """(s, l, t, probability) of cells (s, l, t, n): ``rake`` and ``inclusion`` over tables, each margin's step written."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("n")).first()[0])
    x = scratch.keep(cells.select("s", "l", "t", "n", (F.col("n") / F.lit(total)).alias("x")), "x")
    wants = []
    for d, given in sorted(zip("slt", targets, strict=True), key=lambda x: bool(x[1])):  # given margins last
        own = scratch.keep(x.groupBy(d).agg(F.sum("x").alias("own")), f"own-{d}")
        if given:
            table = spark.createDataFrame([(k, float(max(0.0, v))) for k, v in given.items()], f"{d} string, given double")
            own = scratch.keep(own.join(table, d, "left"), f"given-{d}")
            sums = own.agg(F.sum("given").alias("given"), F.sum(F.when(F.col("given").isNull(), F.col("own"))).alias("free")).first()
            left = max(0.0, 1 - (sums.given or 0.0))
            left = left if left > NOTHING else 0.0
            want = F.coalesce("given", F.col("own") / F.lit(sums.free or 1.0) * F.lit(left))
        else:
            want = F.pow("own", F.lit(power))
        every = own.agg(F.sum(want)).first()[0]
        if every > 0:
            wants.append((d, scratch.keep(own.select(d, (want / F.lit(every)).alias("want")), f"want-{d}")))
    for _ in range(rounds):
        worst = 0.0
        for d, want in wants:
            now = scratch.keep(x.groupBy(d).agg(F.sum("x").alias("own")).join(want, d), f"now-{d}")
            worst = max(worst, now.agg(F.max(F.abs(F.col("own") - F.col("want")))).first()[0])
            factor = F.when(F.col("own") > 0, F.col("want") / F.col("own")).otherwise(F.lit(0.0))
            moved = scratch.keep(x.join(now.select(d, factor.alias("factor")), d).select("s", "l", "t", "n", (F.col("x") * F.col("factor")).alias("x")), f"x-{d}")
            scratch.drop(x, now)
            x = moved
        if worst < close:
            break
    some = x.where("x > 0")
    ends = some.agg(F.sum("n").alias("n"), F.min(F.col("n") / F.col("x")).alias("least"), F.sum("x").alias("x")).first()
    budget = min(share * total, float(ends.n or 0))
    if strict and ends.n:
        budget = min(budget, ends.least * ends.x)
    ratio, scale = F.col("x") / F.col("n"), 0.0
    while True:  # a cell is full, with probability 1, from some scale on; each step fills at least one more
        full = ratio * F.lit(scale) > 1
        sums = some.agg(F.sum(F.when(full, F.col("n"))).alias("have"), F.sum(F.when(~full, F.col("x"))).alias("want")).first()
        further = max(0.0, budget - (sums.have or 0)) / sums.want if sums.want else 0.0
        if further <= scale * (1 + 1e-12):
            break
        scale = further
    return scratch.keep(x.select("s", "l", "t", F.least(F.lit(1.0), ratio * F.lit(scale)).alias("probability")), "probabilities")


def mix_sources(docs: DataFrame, targets: dict[str, dict] | None = None, share: float = 0.8, power: float = 0.7, seed: int = 20240229, topics: int | str = TOPICS, strict: bool = False) -> DataFrame:
    """``docs`` with tokens, topic, probability and sampled.

    docs: doc_id, text, lang, source and any other columns, which stay (those of these names, in any case, are replaced).
    Tokens are a quarter of the text's UTF-8 bytes, rounded up, and one more. targets: shares by value of ``source``,
    ``lang`` and ``topic``; a margin without them gets its own shares to ``power``, and gives way to those with. ``share``
    of all tokens is the expected size of the sample; ``strict`` makes it smaller where shares would not hold otherwise
    (``margins`` reports them). topics: how many to find, or the name of a column that has them. Null source and
    language are values of their own, as is the topic -1 of texts without a word. Rows of one doc_id are sampled
    together; rows without a doc_id share one number. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    names = ["tokens", "topic", "probability", "sampled"]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])  # so that no column of docs clashes with those here
    tokens = (F.ceil(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) / 4) + 1).cast("long")
    if isinstance(topics, str):
        topic = F.coalesce(F.col(topics).cast("string"), F.lit("-1"))
    else:
        model = spark.sparkContext.broadcast(topic_model(*cooccurrences(docs), topics))
        topic = topic_of(F.col("text").cast("string"), model)
    each = docs.select(own.alias("row"), F.col("doc_id").cast("string").alias("id"), _value("source").alias("s"), _value("lang").alias("l"), topic.alias("t"), tokens.alias("n"))
    cells = scratch.keep(each.groupBy("s", "l", "t").agg(F.sum("n").alias("n")), "cells")
    given = targets or {}
    wanted = [{(k if name == "topic" else f"v:{k}"): v for k, v in given.get(name, {}).items()} for name in ("source", "lang", "topic")]
    if any(cells.select(d).distinct().limit(VALUES + 1).count() > VALUES for d in "slt"):
        table = _raked_in_tables(cells, wanted, share, power, strict, scratch)
    else:
        held = {(r.s, r.l, r.t): float(r.n) for r in cells.collect()}  # at most VALUES ** 3 rows
        shares = rake(held, [own or smoothed(held, d, power) for d, own in enumerate(wanted)], tuple(d for d, own in enumerate(wanted) if own))
        p = inclusion(held, shares, share * sum(held.values()), strict)
        table = spark.createDataFrame([(*k, v) for k, v in p.items()], "s string, l string, t string, probability double")
    table = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")
    uniform = F.conv(F.substring(F.md5(F.concat(F.coalesce("id", F.lit("")), F.lit(f"-{seed}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    out = each.join(table, ["s", "l", "t"], "left")
    return out.select("row.*", F.col("n").alias("tokens"), F.col("t").alias("topic"), "probability", (uniform < F.col("probability")).alias("sampled"))


def margins(mixed: DataFrame, targets: dict[str, dict]) -> DataFrame:
    """(margin, value, target, expected, met): the expected shares of a result of ``mix_sources`` beside the given targets."""
    rows = [(m, str(v), float(t)) for m, own in targets.items() for v, t in own.items()]
    spark = mixed.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("value")) for m in ("source", "lang", "topic")])).alias("m")
    expected = F.sum(F.col("tokens") * F.col("probability"))
    sums = mixed.select(each, "tokens", "probability").groupBy("m.margin", "m.value").agg(expected.alias("expected"))
    total = sums.where("margin = 'source'").agg(F.sum("expected")).first()[0] or 1.0
    out = spark.createDataFrame(rows, "margin string, value string, target double").join(sums, ["margin", "value"], "left")
    share = F.coalesce(F.col("expected") / F.lit(total), F.lit(0.0))
    return out.select("margin", "value", "target", share.alias("expected"), (F.abs(share - F.col("target")) < 1e-6).alias("met"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion probability of all documents and whether the sample takes them."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", "probability", "sampled")
