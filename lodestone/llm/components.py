"""Connected components of an edge table by repeated contraction, over the scratch tables of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.llm.scratch import Scratch
from lodestone.operators import graph


def components(edges: DataFrame, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), as ``operators.graph`` finds them; tables of at most ``parts`` files."""
    return graph.components(edges, lambda df, label: scratch.keep(df, label, parts), scratch.drop)
