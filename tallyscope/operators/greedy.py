"""Order-dependent choices (first come, first kept) as Spark jobs.

Only conflicts travel: one row per pair that excludes each other. A group with few conflicts is settled in one pass by
an ordered ``aggregate``; a group with many is settled by rounds of joins that give the same answer, because a node
without an undecided predecessor is exactly one the sequential rule would keep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.session import cut

GROUP_LIMIT = 2000


def _split(edges: DataFrame, group: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges of small groups, edges of large groups or None)."""
    hot = edges.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*group)
    if hot.isEmpty():
        return edges, None
    return edges.join(hot, group, "left_anti"), edges.join(hot, group, "left_semi")


def dropped_by_earlier(edges: DataFrame, group: list[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """Nodes dropped when each node is kept unless an earlier kept node excludes it.

    ``edges``: group columns, ``winner`` (the earlier node), ``loser``, ``loser_rank`` (ascending order of processing).
    Returns the group columns and ``node``.
    """
    edges = cut(edges.select(*group, "winner", "loser", "loser_rank"))
    small, large = _split(edges, group, limit)
    losers = small.groupBy(*group, "loser").agg(
        F.min("loser_rank").alias("rank"), F.collect_set("winner").alias("before")
    )
    walked = losers.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("rank", "loser", "before"))).alias("steps")
    )
    gone = F.aggregate(
        "steps",
        F.slice(F.transform("steps", lambda s: s["loser"]), 1, 0),
        lambda out, s: F.when(F.size(F.array_except(s["before"], out)) > 0, F.array_append(out, s["loser"])).otherwise(
            out
        ),
    )
    done = walked.select(*group, F.explode(gone).alias("node"))
    return done if large is None else done.unionByName(_drop_rounds(large, group))


def _drop_rounds(edges: DataFrame, group: list[str]) -> DataFrame:
    parts = []
    left = cut(edges.select(*group, "winner", "loser"))
    while not left.isEmpty():
        losers = left.select(*group, F.col("loser").alias("winner")).distinct()
        free = left.join(losers, [*group, "winner"], "left_anti")
        gone = cut(free.select(*group, F.col("loser").alias("node")).distinct())
        parts.append(gone)
        left = cut(
            left.join(gone.withColumnRenamed("node", "loser"), [*group, "loser"], "left_anti").join(
                gone.withColumnRenamed("node", "winner"), [*group, "winner"], "left_anti"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def greedy_matching(
    edges: DataFrame, group: list[str], left: str, right: str, order: list[str], limit: int = GROUP_LIMIT
) -> DataFrame:
    """One-to-one matching that walks the edges in ascending ``order`` and takes one when both ends are free.

    ``order`` plus the two ends must be a total order. Returns the taken edges.
    """
    cols = [*order, left, right]
    edges = cut(edges.select(*group, *cols))
    small, large = _split(edges, group, limit)
    walked = small.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("steps"))
    none = F.slice("steps", 1, 0)
    taken = F.aggregate(
        "steps",
        none,
        lambda out, s: F.when(
            F.exists(out, lambda t: (t[left] == s[left]) | (t[right] == s[right])), out
        ).otherwise(F.array_append(out, s)),
    )
    done = walked.select(*group, F.explode(taken).alias("_e")).select(*group, *[F.col(f"_e.{c}").alias(c) for c in cols])
    return done if large is None else done.unionByName(_match_rounds(large, group, left, right, cols))


def _match_rounds(edges: DataFrame, group: list[str], left: str, right: str, cols: list[str]) -> DataFrame:
    parts = []
    rest = cut(edges)
    while not rest.isEmpty():
        best = F.min(F.struct(*cols)).alias("_e")
        by_left = rest.groupBy(*group, left).agg(best).select(*group, "_e")
        by_right = rest.groupBy(*group, right).agg(best).select(*group, "_e")
        taken = cut(
            by_left.join(by_right, [*group, "_e"]).select(*group, *[F.col(f"_e.{c}").alias(c) for c in cols])
        )
        parts.append(taken)
        rest = cut(
            rest.join(taken.select(*group, left), [*group, left], "left_anti").join(
                taken.select(*group, right), [*group, right], "left_anti"
            )
        )
    return reduce(DataFrame.unionByName, parts)
