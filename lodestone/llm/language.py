"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams of one to three characters of the lower-cased text, hashed to a fixed number of columns, are
gathered for each language over all training rows. The matrix of log probabilities is broadcast by blocks of AT_ONCE
languages, each of a fixed size; more languages take more blocks, and a text keeps its best of all. A batch of texts
is one sparse matrix of counts: its entries times their rows of the matrix, summed by text, and the log shares of
the languages among the training rows give the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch

BITS = 14
COLUMNS, SMOOTH = 1 << BITS, 0.1
#: Languages of one block of the model: AT_ONCE x COLUMNS numbers are held on the driver and broadcast at a time.
AT_ONCE = 64
ORDERS = (1, 2, 3)
#: Characters hashed at once, and entries of a sparse matrix that are multiplied at once.
STEP, ENTRIES = 1 << 18, 1 << 16
#: Languages that a training task holds before it sends what it has counted.
HELD = 256


def has_letter(text: str) -> bool:
    """Whether a character is a letter: number forms and superscripts are none."""
    return any(map(str.isalpha, text))


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse matrix (row, column, count) of hashed n-grams of whole texts, ordered by row and column.

    Texts are hashed back to back, in steps that overlap by the longest n-gram; n-grams over two texts don't count.
    """
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) for t in lowered], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = []
    for at in range(0, len(codes), STEP):
        c, r = codes[at : at + STEP + max(ORDERS) - 1], row[at : at + STEP + max(ORDERS) - 1]
        own = min(STEP, len(codes) - at)
        h = np.zeros(len(c), dtype=np.uint32)
        keys = []
        for n in range(1, max(ORDERS) + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in ORDERS:
                k = min(m, own)
                x = (h[:k] ^ (h[:k] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                inside = r[:k] == r[n - 1 : n - 1 + k]
                keys.append((r[:k] * COLUMNS + (x >> np.uint32(32 - BITS)))[inside])
        found.append(np.unique(np.concatenate(keys), return_counts=True))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    key, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True) if len(found) > 1 else (found[0][0], None)
    n = found[0][1] if which is None else np.bincount(which, weights=np.concatenate([n for _, n in found])).astype(np.int64)
    return key >> BITS, key & (COLUMNS - 1), n


def batches_of(texts: list[str]):
    """Runs (first, last + 1) of texts of some STEP characters together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > STEP:
            yield first, i
            first, size = i, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text and so is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5 == 0


class Model:
    """Names of the learned languages in order, and their counts as a table (lang, column, n), column -1 for texts."""

    def __init__(self, names: list[str], table: DataFrame | None, texts: int):
        self.names, self.table, self.texts = names, table, texts

    def block(self, at: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names, log priors and log probabilities (COLUMNS x languages) of AT_ONCE languages."""
        names = self.names[at : at + AT_ONCE]
        got = self.table.where(F.col("lang").isin(names)).toArrow()  # at most AT_ONCE * (COLUMNS + 1) rows
        column = {x: i for i, x in enumerate(names)}
        where, at_, n = np.array([column[x] for x in got["lang"].to_pylist()], dtype=np.int64), got["at"].to_numpy(), got["n"].to_numpy()
        matrix, prior = np.full((COLUMNS, len(names)), SMOOTH), np.zeros(len(names))
        grams = at_ >= 0
        np.add.at(matrix, (at_[grams], where[grams]), n[grams])
        np.add.at(prior, where[~grams], n[~grams])
        return names, np.log(prior / self.texts), np.log(matrix / matrix.sum(axis=0))


def fit(docs: DataFrame) -> Model:
    """The counts of every language of ``docs`` (text, lang), from all rows with both; other columns are not read.

    Rows with a null text or language teach nothing; empty texts count for the prior alone. Repeated rows count as
    often as they occur. An empty table gives a model without languages. The driver holds the languages' names.
    """
    scratch = Scratch(docs.sparkSession, "language")

    def run(batches):
        total: dict[str, np.ndarray] = {}

        def send():
            for lang, x in total.items():
                at = np.flatnonzero(x)
                yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at - 1, pa.int32()), "n": pa.array(x[at], pa.int64())})
            total.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                row, col, n = counts(texts[a:b])
                edge = np.searchsorted(row, np.arange(b - a + 1))
                for i, lang in enumerate(langs[a:b]):
                    if lang not in total:
                        if len(total) >= HELD:
                            yield from send()
                        total[lang] = np.zeros(COLUMNS + 1, dtype=np.int64)
                    total[lang][0] += 1
                    total[lang][col[edge[i] : edge[i + 1]] + 1] += n[edge[i] : edge[i + 1]]
        yield from send()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    table = scratch.keep(rows.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")), "counts")
    texts = {r.lang: r.n for r in table.where("at = -1").select("lang", "n").collect()}  # a row a language
    return Model(sorted(texts), table, sum(texts.values()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of every whole text and its probability among all learned.

    Only the text is an input. A text that is null, empty or without a letter is ``und`` with score 0, as is every
    text when no language was learned. Rows come out as often as they go in; ties go to the first language by name.
    Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "language")
    context = docs.sparkSession.sparkContext
    schema = "doc_id long, text string, pred string, top double, total double"
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("pred"), F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("total"))

    def scored(df: DataFrame, block) -> DataFrame:
        """``df`` with pred and top, the best language so far, and total, the sum of all likelihoods over that of the best."""

        def run(batches):
            names, prior, logp = block.value
            for batch in batches:
                texts = [t if t is not None and has_letter(t) else "" for t in batch.column(1).to_pylist()]
                pred, top, total = (batch.column(i).to_pylist() for i in (2, 3, 4))
                for a, b in batches_of(texts):
                    row, col, n = counts(texts[a:b])
                    score = np.tile(prior, (b - a, 1))
                    for at in range(0, len(row), ENTRIES):  # sums go on where a step cuts a text's entries
                        r, part = row[at : at + ENTRIES], n[at : at + ENTRIES, None] * logp[col[at : at + ENTRIES]]
                        first = np.flatnonzero(np.diff(r, prepend=-1))
                        score[r[first]] += np.add.reduceat(part, first, axis=0)
                    best = score.argmax(axis=1)
                    high = score[np.arange(b - a), best]
                    rest = np.exp(score - high[:, None]).sum(axis=1)
                    for i in range(a, b):
                        if not texts[i]:
                            continue
                        j = i - a
                        if high[j] > top[i]:
                            pred[i], top[i], total[i] = names[best[j]], float(high[j]), float(rest[j] + total[i] * np.exp(top[i] - high[j]))
                        else:
                            total[i] += float(rest[j] * np.exp(high[j] - top[i]))
                yield pa.record_batch({"doc_id": batch.column(0), "text": batch.column(1), "pred": pa.array(pred, pa.string()), "top": pa.array(top, pa.float64()), "total": pa.array(total, pa.float64())})

        return df.mapInArrow(run, schema)

    for at in range(0, len(model.names), AT_ONCE):
        if at:
            state = scratch.keep(state, f"block{at}")
        state = scored(state, context.broadcast(model.block(at)))
    return state.select("doc_id", F.coalesce("pred", F.lit("und")).alias("lang_pred"), F.when(F.col("pred").isNull(), F.lit(0.0)).otherwise(1 / F.col("total")).alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the four fifths that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
