"""Sufficient evidence, budgets, and assembled results for many tasks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

# The order in which sections are filled and shown.
SECTIONS = ("CONSTRAINTS", "OPEN RISKS", "LESSONS", "DECISIONS", "PROJECT EVIDENCE", "HISTORY", "VALIDATION")


def sufficient(ranked: DataFrame, tokens: DataFrame) -> DataFrame:
    """Of candidates (q, pos, evidence_id, semantic), those that add something to what stands before them.

    tokens: (q, pos, token), the query tokens that a candidate covers. Kept are the first one, each that covers a
    token for the first time, and the first of each document that vectors admitted.
    """
    first = tokens.groupBy("q", "token").agg(F.min("pos").alias("pos")).select("q", "pos").distinct().withColumn("adds", F.lit(True))
    seen = F.row_number().over(Window.partitionBy("q", "evidence_id").orderBy("pos"))
    out = ranked.join(first, ["q", "pos"], "left").withColumn("seen", seen)
    return out.where((F.col("pos") == 1) | F.col("adds") | (F.col("semantic") & (F.col("seen") == 1))).drop("adds", "seen")


def cost(size: Column, section: Column, first: Column) -> Column:
    """Code points of a text of this size and its newline, and of the section's header for its first item."""
    return size + 1 + F.when(first, F.length(section) + 1).otherwise(F.lit(0))


def item_size(entity: Column, content_size: Column, authority: Column, path: Column, index: Column, count: Column, cited: Column, partners: Column) -> Column:
    """The length of ``render_item`` without the text: content_size is the length of the safe content."""
    listed = lambda ids: F.aggregate(ids, F.lit(-2), lambda n, x: n + F.length(x) + 4)
    part = F.when(count > 1, F.length(F.concat(F.lit(" (chunk "), (index + 1).cast("string"), F.lit(" of "), count.cast("string"), F.lit(")")))).otherwise(F.lit(0))
    head = F.length(entity) + 5 + F.coalesce(F.length(authority) + 3, F.lit(0)) + content_size
    where = F.coalesce(F.length(T.terminal_safe(path)) + 11 + part, F.lit(0))
    more = lambda ids, words: F.when(F.size(ids) > 0, listed(ids) + len(words) + 1).otherwise(F.lit(0))
    return head + where + more(cited, "  from attempt ") + more(partners, "  CONFLICTS WITH ")


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """Items (q, pos, section, size) with cost, used and selected: everything before the first that does not fit.

    size is the length of the rendered item, so nothing is rendered that the budget then leaves out.
    """
    if budget < 1:
        raise ValueError("the budget must be positive")
    head = F.row_number().over(Window.partitionBy("q", "section").orderBy("pos")) == 1
    run = Window.partitionBy("q").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = items.withColumn("cost", cost(F.col("size"), F.col("section"), head).cast("long"))
    return out.withColumn("used", F.sum("cost").over(run)).withColumn("selected", F.col("used") <= budget)


def totals(items: DataFrame, tasks: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(q, n_selected, n_omitted, used, footer) of a budget scan, for all tasks (q).

    excluded: (q, n_excluded), the current invariants that are not relevant to a task; the footer names them.
    """
    out = items.groupBy("q").agg(F.count_if("selected").alias("n_selected"), F.count_if(~F.col("selected")).alias("n_omitted"), F.max(F.when(F.col("selected"), F.col("used"))).alias("used"))
    out = tasks.select("q").join(out, "q", "left").select("q", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_selected", "n_omitted", "used")])
    text = F.format_string("-- %d of %d selected; %d omitted for budget", "n_selected", F.col("n_selected") + F.col("n_omitted"), "n_omitted")
    if excluded is not None:
        out = out.join(excluded, "q", "left").withColumn("n_excluded", F.coalesce("n_excluded", F.lit(0)))
        text = F.concat(text, F.when(F.col("n_excluded") > 0, F.format_string("; %d project invariant(s) not relevant to this task (see: preflight)", "n_excluded")).otherwise(F.lit("")))
    return out.withColumn("footer", text)


def render(items: DataFrame, sums: DataFrame, tasks: DataFrame) -> DataFrame:
    """(q, text): a portable text of every task (q, task): its selected items (q, pos, section, rendered) under their headers, and the footer of ``totals``."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "section", "rendered")))
    lines = lambda a: F.transform(a, lambda x, i: F.concat(F.when((i == 0) | (F.get(a, i - 1).section != x.section), F.concat(x.section, F.lit("\n"))).otherwise(F.lit("")), x.rendered))
    body = items.groupBy("q").agg(rows.alias("rows")).select("q", F.array_join(lines(F.col("rows")), "\n").alias("body"))
    out = tasks.join(sums, "q").join(body, "q", "left")
    empty = F.when(F.col("n_omitted") > 0, "No compiled items fit within the budget.").otherwise("No compiled context for this task.")
    return out.select("q", F.concat_ws("\n", F.concat(F.lit("Task: "), T.terminal_safe(F.col("task"))), F.lit(""), F.coalesce("body", empty), F.lit(""), "footer").alias("text"))
