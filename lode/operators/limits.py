"""Order-dependent controls: change detection and the limiter of accepted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_SECONDS = 10, 3600


def changed(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Adds changed: the content differs from the one before it (not: was never seen)."""
    return rows.withColumn("_h", F.md5(F.col(content).cast("binary"))).withColumn("changed", F.expr(f"coalesce(_h <> lag(_h) over (partition by {key} order by {order}), true)")).drop("_h")


def accepted(times: Column, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> Column:
    """struct(n, last, live) of sorted times: how many are accepted, the last of them, and those within the window.

    A time is accepted if fewer than ``limit`` accepted ones lie in the window before. A fold whose
    state holds ``limit`` times at most.
    """
    none = F.lit(None).cast("bigint")
    start = F.struct(F.lit(0).cast("bigint").alias("n"), none.alias("last"), F.array().cast("array<bigint>").alias("live"))

    def step(state: Column, t: Column) -> Column:
        live = F.filter(state["live"], lambda x: t - x < seconds)
        open_ = F.size(live) < limit
        return F.struct(
            (state["n"] + open_.cast("bigint")).alias("n"), F.when(open_, t).otherwise(state["last"]).alias("last"), F.when(open_, F.concat(live, F.array(t))).otherwise(live).alias("live")
        )

    return F.aggregate(times, start, step)


def rate_limit(events: DataFrame, key: str, ts: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """key, n_events, n_accepted, last_accepted per key.

    A pause of a window's length or more empties the state, so a key's history is cut there and its
    pieces are folded apart: a busy key is not one row.
    """
    order = f"partition by {key} order by _t"
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    rows = rows.withColumn("_new", F.expr(f"case when _t - lag(_t) over ({order}) < {seconds * 1_000_000} then 0 else 1 end"))
    rows = rows.withColumn("_piece", F.expr(f"sum(_new) over ({order} rows between unbounded preceding and current row)"))
    pieces = rows.groupBy(key, "_piece").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    pieces = pieces.select(key, F.size("_t").cast("long").alias("_n"), accepted(F.col("_t"), limit, seconds * 1_000_000).alias("_a"))
    by = pieces.groupBy(key).agg(F.sum("_n").alias("n_events"), F.sum("_a.n").alias("n_accepted"), F.max("_a.last").alias("_last"))
    return by.select(key, "n_events", "n_accepted", F.timestamp_micros("_last").cast(events.schema[ts].dataType).alias("last_accepted"))
