"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens. In each round a queue earns credit in proportion to its target weight and
serves as many whole quanta as its deficit (earned less served) allows; what is left carries over to the next
round. The served quanta, back to back, are the training stream, and windows are cut from it without gaps.

Quantum k of a queue with T tokens and credit c a round is served in round ``ceil(min((k + 1) q, T) / c)``. So the
deficit after any round, and with it the place of any token in the stream, follows from the queues' totals: each
partition places its own documents, and deficits carry over windows and partitions without a sequential pass.
Queues that run dry drop out; the others keep their proportions. Queues without a target weight share what the others
leave, by their shares of all tokens to a power: 1 lets all of them run dry together, less lifts small queues, so that
the early windows hold more of them than the corpus does.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

WINDOW, QUANTUM, END_ID = 2048, 256, 1
#: Of the registered query: target shares are the sources' sizes to this power, which lifts small sources.
POWER = 0.7
#: Share of a queue for which nothing is left: such queues follow when the others run dry.
LEAST = 1e-7
#: Up to this many queues the schedule is broadcast; for more, quanta are sorted in a table. Both give the same places.
QUEUES = 1024
#: Quanta of a queue that one row is spread to at once.
SPREAD = 1 << 16
#: Rows of queue offsets (some 40 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


class Encoder:
    """Token ids as the tokenizer file gives them, without added special tokens.

    The ranks of the same vocabulary serve ordinary texts much faster; a text with the string of a special token,
    or one that the fast path refuses, goes to the tokenizer itself.
    """

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        self.path, self.ranks_path, self.pattern = path, ranks_path, pattern
        self.slow = self.fast = None
        self.special: list[str] = []

    def _load(self) -> None:
        import json

        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.slow = Tokenizer.from_file(self.path)
        if self.ranks_path:
            import tiktoken

            with open(self.ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.slow is None:
            self._load()
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except Exception:  # noqa: BLE001  its regular expressions give up on some very long runs
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def byte_bpe() -> Encoder:
    """The public byte-level BPE of 50,257 ids."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


class Schedule:
    """Where in the stream any token of any queue stands."""

    def __init__(self, totals: list[int], weights: list[float], window: int, quantum: int):
        self.total = np.array(totals, dtype=np.int64)
        self.credit = np.maximum(np.array(weights, dtype=np.float64), LEAST) * window
        self.quantum, self.window = quantum, window
        self.quanta = -(-self.total // quantum)
        n = int(self.total.sum())
        rest, sizes = n % window, []
        for bit in range(rest.bit_length() - 1, -1, -1):  # a rest goes to sequences of powers of two, which need no padding
            if rest >> bit & 1:
                sizes.append(1 << bit)
        self.full = n // window
        self.tail = n - rest + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

    def round_of(self, s, k):
        return np.ceil(np.minimum((k + 1) * self.quantum, self.total[s]) / self.credit[s]).astype(np.int64)

    def served(self, s, r):
        """Tokens of queue s that are served by the end of round r (broadcast against each other)."""
        c = np.clip(np.floor(r * self.credit[s] / self.quantum).astype(np.int64), 0, self.quanta[s])
        for _ in range(2):  # the division may be off by one; round_of decides
            c = c + ((c < self.quanta[s]) & (self.round_of(s, c) <= r))
            c = c - ((c > 0) & (self.round_of(s, c - 1) > r))
        return np.minimum(c * self.quantum, self.total[s])

    def place(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Stream position of the first token of quantum k of queue s."""
        out = np.empty(len(s), dtype=np.int64)
        every = np.arange(len(self.total))[:, None]
        step = max(1, (1 << 18) // len(self.total))
        for at in range(0, len(s), step):
            ss, kk = s[at : at + step], k[at : at + step]
            r = self.round_of(ss, kk)
            before, after = self.served(every, (r - 1)[None, :]), self.served(every, r[None, :])
            ahead = np.where(every < ss[None, :], after, before).sum(axis=0)
            out[at : at + step] = ahead + kk * self.quantum - before[ss, np.arange(len(ss))]
        return np.maximum(out, 0)

    def sequence(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset and first position behind the sequence."""
        q, o = pos // self.window, pos % self.window
        end = (q + 1) * self.window
        if (late := q >= self.full).any() and len(self.tail) > 1:
            t = np.searchsorted(self.tail, pos[late], "right") - 1
            q[late], o[late], end[late] = self.full + t, pos[late] - self.tail[t], self.tail[t + 1]
        return q, o, end


def _tokenise(docs: DataFrame, encoder: Encoder, end_id: int) -> DataFrame:
    def run(batches):
        part, queued = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                queue, start, n, ids = some.column(2).to_pylist(), [], [], []
                for q, text in zip(queue, some.column(1).to_pylist(), strict=True):
                    got = np.append(encoder.ids(text or "").astype("<u4"), np.uint32(end_id))
                    start.append(queued.get(q, 0))
                    n.append(len(got))
                    queued[q] = start[-1] + len(got)
                    ids.append((got.astype("<u2") if got.max() < 1 << 16 else got).tobytes())
                yield pa.record_batch({"doc_id": some.column(0), "queue": pa.array(queue, pa.string()), "part": pa.array([part] * len(n), pa.int32()), "at": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, queue string, part int, at long, n long, ids binary")


def shares_of(totals: dict[str, int], weights: dict[str, float] | None, power: float) -> dict[str, float]:
    """Target shares of queues: those named as given, the others by their totals to ``power`` in what is left."""
    every = max(1, sum(totals.values()))
    named = {q: weights[q[2:]] for q in totals if weights and q[2:] in weights}
    own = {q: (totals[q] / every) ** power for q in sorted(totals) if q not in named}
    left, free = (max(0.0, 1 - sum(named.values())) if named else 1.0), sum(own.values())
    return {q: named[q] if q in named else own[q] / free * left for q in totals}


def _sorted_places(placed: DataFrame, held: DataFrame, weights: dict[str, float] | None, power: float, window: int, quantum: int, scratch: Scratch) -> DataFrame:
    """``placed`` with places, the stream positions of a document's quanta: running sums over all quanta by round, queue and number."""
    spark = held.sparkSession
    named = spark.createDataFrame([(f"s:{q}", float(w)) for q, w in (weights or {}).items()], "queue string, named double")
    totals = scratch.keep(held.groupBy("queue").agg(F.sum("held").alias("total")).join(named, "queue", "left"), "totals")
    every = totals.agg(F.sum("total")).first()[0]
    own = F.pow(F.col("total") / F.lit(every), F.lit(float(power)))
    sums = totals.agg(F.sum("named").alias("named"), F.sum(F.when(F.col("named").isNull(), own)).alias("free")).first()
    left, free = (max(0.0, 1 - sums.named) if sums.named is not None else 1.0), sums.free or 0.0
    share = F.coalesce("named", own / F.lit(free or 1.0) * F.lit(left))
    blocks = totals.select("queue", "total", (F.greatest(share, F.lit(LEAST)) * window).alias("credit"), F.ceil(F.col("total") / quantum).alias("quanta"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(quanta - 1) div {SPREAD}"))).alias("block")).repartition("queue", "block")
    quanta = blocks.select("queue", "total", "credit", F.explode(F.sequence(F.col("block") * SPREAD, F.least(F.col("block") * SPREAD + SPREAD, F.col("quanta")) - 1)).alias("k"))
    end = F.least((F.col("k") + 1) * quantum, F.col("total"))
    quanta = quanta.select("queue", "k", F.ceil(end / F.col("credit")).alias("round"), (end - F.col("k") * quantum).alias("size"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quanta = scratch.keep(quanta.repartitionByRange(parts, "round", "queue", "k").withColumn("range", F.spark_partition_id()), "quanta")
    at, ahead = 0, []
    for r in quanta.groupBy("range").agg(F.sum("size").alias("n")).orderBy("range").collect():  # at most one row a shuffle partition
        ahead.append((r.range, at))
        at += r.n
    within = Window.partitionBy("range").orderBy("round", "queue", "k").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0))
    quanta = quanta.join(F.broadcast(spark.createDataFrame(ahead, "range int, ahead long")), "range").select("queue", "k", pos.alias("pos"))
    key = ["queue", "part", "at"]  # names a row: every row has a token
    spread = placed.select(*key, F.explode(F.sequence(F.expr(f"begin div {quantum}"), F.expr(f"(begin + n - 1) div {quantum}"))).alias("k"))
    places = spread.join(quanta.hint("merge"), ["queue", "k"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "pos"))).alias("places"))
    return placed.join(places.hint("merge"), key).select("doc_id", "queue", "begin", "n", "ids", F.col("places.pos").alias("places"))


def _pieces(rows: DataFrame, plan, number: dict[str, int] | None) -> DataFrame:
    def run(batches):
        s = plan.value
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                yield _placed(batch.slice(row, 256), s, number)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source_queue string")


def _placed(batch: pa.RecordBatch, s: Schedule, number: dict[str, int] | None) -> pa.RecordBatch:
    begin, n = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
    ids = [x.as_buffer() for x in batch.column(4)]
    first, last = begin // s.quantum, (begin + n - 1) // s.quantum
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    lo, hi = np.maximum(k * s.quantum, begin[doc]), np.minimum((k + 1) * s.quantum, (begin + n)[doc])
    if number is None:
        pos = batch.column(5).flatten().to_numpy(zero_copy_only=False)
    else:
        pos = s.place(np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)[doc], k)
    pos = pos + lo - k * s.quantum
    out = []
    while len(doc):  # a piece that crosses a sequence's end is cut there
        seq, off, end = s.sequence(pos)
        size = np.minimum(hi - lo, end - pos)
        out.append((doc, lo - begin[doc], size, seq, off))
        more = size < hi - lo
        doc, lo, hi, pos = doc[more], (lo + size)[more], hi[more], end[more]
    doc, start, size, seq, off = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((start, doc))
    doc, start, size, seq, off = doc[order], start[order], size[order], seq[order], off[order]
    tokens = [np.frombuffer(b, "<u2" if b.size == 2 * m else "<u4").astype("<u4") for b, m in zip(ids, n, strict=True)]
    cut = [tokens[d][a : a + m].tobytes() for d, a, m in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
    return pa.record_batch({"doc_id": batch.column(0).take(pa.array(doc)), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids": pa.array(cut, pa.binary()), "doc_tokens": pa.array(n[doc], pa.int64()), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(off, pa.int64()), "source_queue": batch.column(1).take(pa.array(doc))})


def pack(docs: DataFrame, encoder: Encoder | None = None, weights: dict[str, float] | None = None, power: float = 1.0, window: int = WINDOW, quantum: int = QUANTUM, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents, each with its place in a sequence of ``window`` tokens.

    One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset,
    source_queue. ``docs`` has doc_id, text and source; other columns are not read. A document's tokens are its ids
    and ``end_id``; a null or empty text is that one token. ``weights`` are target shares by source; sources not
    named share what is left by their sizes to ``power``. A null source is a queue of its own. Repeated rows are packed as
    often as they occur. Sequences are filled without gaps; the rest of the stream, under one window, goes to
    sequences of falling powers of two. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    encoder = encoder or byte_bpe()
    queue = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("none"))
    rows = scratch.keep(_tokenise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), queue.alias("queue")), encoder, end_id), "tokens")
    held = scratch.keep(rows.groupBy("queue", "part").agg(F.sum("n").alias("held")), "held")
    ahead = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("queue", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    base = F.broadcast(base) if held.count() <= BROADCAST_ROWS else base.hint("merge")
    placed = rows.join(base, ["queue", "part"]).select("doc_id", "queue", "part", "at", (F.col("base") + F.col("at")).alias("begin"), "n", "ids")
    if held.select("queue").distinct().limit(QUEUES + 1).count() > QUEUES:
        total = held.agg(F.sum("held")).first()[0]
        plan = spark.sparkContext.broadcast(Schedule([total], [1.0], window, quantum))
        return _pieces(_sorted_places(placed, held, weights, power, window, quantum, scratch), plan, None)
    totals = {r.queue: r.total for r in held.groupBy("queue").agg(F.sum("held").alias("total")).collect()}  # at most QUEUES rows
    names, share = sorted(totals), shares_of(totals, weights, power)
    plan = spark.sparkContext.broadcast(Schedule([totals[q] for q in names] or [0], [share[q] for q in names] or [1.0], window, quantum))
    return _pieces(placed.select("doc_id", "queue", "begin", "n", "ids"), plan, {q: i for i, q in enumerate(names)})


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the pieces of each sequence put together; at most one window of ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x.ids))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens; target shares of sources are their sizes to the power POWER."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), power=POWER)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
