"""Recent form of the agents (riders, trainers): rates over their last 100 rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.skew import OrderedRows

# Fixed values.
ROWS, MINIMUM = 100, 10
FLAGS = {"win": 1, "place": 2, "show": 3}
AGENTS = {"jockey": "jockey_id", "trainer": "trainer_id"}


def with_agent_rates(df: DataFrame, agent: str, prefix: str, *, position: str = "rank",
                     order: Sequence[str] = ("date_dt", "race_id", "horse_num"),
                     rows: int = ROWS, minimum: int = MINIMUM, total: int | None = None,
                     **skew) -> DataFrame:
    """``{prefix}_{win,place,show}_rate_{rows}`` over the agent's last ``rows`` rows.

    NULL below ``minimum`` known outcomes; unknown outcomes are left out.  Outcomes are counted
    from the first row on; counts are whole numbers, so those of the last rows are the exact
    difference of two.  ``total``: the number of rows, where ``hot`` is given.
    """
    o = OrderedRows(df, [agent], order, halo=rows, rows=total, **skew)
    counts = {"_known": F.count(F.col(position))} | {
        f"_{name}": F.sum(S.within(position, limit)) for name, limit in FLAGS.items()}
    counted = o.rows.select("*", *[
        F.coalesce(c.over(o.before), F.lit(0)).alias(n) for n, c in counts.items()])
    recent = {n: F.col(n) - o.over(F.lag(n, rows, 0), o.spec) for n in counts}
    return o.finish(counted.select(*o.rows.columns, *[
        F.when(recent["_known"] >= minimum, F.try_divide(recent[f"_{name}"], recent["_known"]))
        .alias(f"{prefix}_{name}_rate_{rows}") for name in FLAGS]))


def with_all_agent_rates(df: DataFrame, agents: dict[str, str] | None = None,
                         hot: dict[str, DataFrame | None] | None = None, **options) -> DataFrame:
    """Rates of every agent the table has; ``hot`` holds each agent column's hot keys, if known."""
    for prefix, column in (agents or AGENTS).items():
        if column in df.columns:
            df = with_agent_rates(df, column, prefix,
                                  hot="check" if hot is None else hot[column], **options)
    return df
