"""Evaluate expensive expressions once.

The optimiser merges neighbouring projections, which repeats an expression wherever a later
one uses its column. For parsing that multiplies the work at every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are computed once per row and kept.

    The columns go through a one-element explode: still one stage and no shuffle, but later
    expressions refer to its output instead of a copy of the expression.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*df.columns, packed.alias("_staged")).select(
        *kept, *[F.col("_staged")[n].alias(n) for n in columns]
    )
