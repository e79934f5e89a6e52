"""Skew-safe ordered operators within groups (previous/next row).

A plain ``lag``/``lead`` window sends a whole group to one task.  Here the
group is cut into chunks of the integral order key; the window runs per
(group, chunk) and only the chunk boundaries - one row per chunk - are fixed
up through a small table of chunk ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.identity import DEFAULT_CHUNK


def neighbour(df: DataFrame, group_by, order_col: str, value_cols: list[str], direction: str,
              prefix: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    # ``order_col`` is integral and unique within a group (e.g. a turn number or
    # a dense position from ``identity.dense_id``).
    """Add ``<prefix><col>`` holding the value of the previous (``direction='prev'``)
    or next (``'next'``) row of the same group in ``order_col`` order."""
    groups = [group_by] if isinstance(group_by, str) else list(group_by)
    keyed = df.withColumn("__chunk", F.floor(F.col(order_col) / F.lit(chunk)).cast("bigint"))
    w = Window.partitionBy(*groups, "__chunk").orderBy(order_col)
    fn = F.lag if direction == "prev" else F.lead
    local = keyed
    for c in value_cols:
        local = local.withColumn(f"__n_{c}", fn(F.col(c)).over(w))
    local = local.withColumn("__nb_order", fn(F.col(order_col)).over(w))
    # Edge rows of each chunk: the last one (its values feed the next chunk's
    # first row) for 'prev', the first one for 'next'.  Read from the window
    # output, so this branch shares the window's exchange.
    other = F.lead if direction == "prev" else F.lag
    local = local.withColumn("__edge", other(F.col(order_col)).over(w).isNull())
    ends = local.where("__edge").select(*groups, "__chunk", *[F.col(c).alias(f"__e_{c}") for c in value_cols],
                                        F.col(order_col).alias("__e_order"))
    wc = Window.partitionBy(*groups).orderBy("__chunk")
    adj = ends
    for c in value_cols:
        adj = adj.withColumn(f"__a_{c}", fn(F.col(f"__e_{c}")).over(wc))
    adj = adj.withColumn("__a_order", fn(F.col("__e_order")).over(wc))
    adj = adj.select(*groups, "__chunk", *[f"__a_{c}" for c in value_cols], "__a_order")
    joined = local.join(adj, [*groups, "__chunk"], "left")
    at_edge = F.col("__nb_order").isNull()
    for c in value_cols:
        joined = joined.withColumn(f"{prefix}{c}", F.when(at_edge, F.col(f"__a_{c}")).otherwise(F.col(f"__n_{c}")))
    drop = ["__chunk", "__nb_order", "__a_order", "__edge"] + [f"__n_{c}" for c in value_cols] + [f"__a_{c}" for c in value_cols]
    return joined.drop(*drop)
