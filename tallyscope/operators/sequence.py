"""Ordered operators (previous row, running sum, rank, carry-down) that hold when one key owns much of the data.

A plain window puts a whole key into one task. Here each key is cut into *blocks*: columns that never decrease along
the order (a range of sequence numbers, a day, an exact leading sort value). Windows run inside (key, block); one summary
row per block is aggregated map-side, and only those summaries meet in a window over the key.

Every method reads its input twice (once for the summaries), so a chain of them should be cut with a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(cols: list) -> list[tuple[Column, bool]]:
    return [(F.col(c), True) if isinstance(c, str) else c for c in cols]


def _direct(cols: list) -> list[Column]:
    return [c.asc_nulls_last() if up else c.desc_nulls_last() for c, up in _pairs(cols)]


class Blocks:
    """``keys`` split by ``block`` columns; rows are ordered by ``order``.

    ``block`` and ``order`` are lists of a column name (ascending) or ``(Column, ascending)``.
    """

    def __init__(self, keys: list[str], block: list, order: list):
        self.keys = keys
        self.block = _pairs(block)
        self.names = [f"_blk{i}" for i in range(len(self.block))]
        self.order = order
        self.inside = Window.partitionBy(*keys, *self.names).orderBy(*_direct(order))
        across = [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, (_, up) in zip(self.names, self.block)]
        self.across = Window.partitionBy(*keys).orderBy(*across)

    def tag(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: c for n, (c, _) in zip(self.names, self.block)})

    def _join(self, tagged: DataFrame, summary: DataFrame) -> DataFrame:
        ids = [*self.keys, *self.names]
        renamed = summary.select(*[F.col(c).alias(f"_s{c}") for c in ids], *[c for c in summary.columns if c not in ids])
        cond = [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in ids]
        return tagged.join(renamed, cond, "left").drop(*[f"_s{c}" for c in ids])

    def running_sum(self, df: DataFrame, out: str, value: Column) -> DataFrame:
        """Sum of ``value`` over the rows up to and including this one."""
        tagged = self.tag(df).withColumn("_v", value)
        sums = tagged.groupBy(*self.keys, *self.names).agg(F.sum("_v").alias("_bsum"))
        sums = sums.withColumn(
            "_blk_before", F.sum("_bsum").over(self.across.rowsBetween(Window.unboundedPreceding, -1))
        ).drop("_bsum")
        inside = F.sum("_v").over(self.inside.rowsBetween(Window.unboundedPreceding, 0))
        return (
            self._join(tagged, sums)
            .withColumn(out, F.coalesce(F.col("_blk_before"), F.lit(0)) + F.coalesce(inside, F.lit(0)))
            .drop("_v", "_blk_before", *self.names)
        )

    def row_number(self, df: DataFrame, out: str, total: str | None = None) -> DataFrame:
        """1-based position inside the key, and in ``total`` the rows of the key."""
        tagged = self.tag(df)
        sums = tagged.groupBy(*self.keys, *self.names).agg(F.count("*").alias("_bn"))
        sums = sums.withColumn("_blk_before", F.sum("_bn").over(self.across.rowsBetween(Window.unboundedPreceding, -1)))
        if total:
            sums = sums.withColumn(total, F.sum("_bn").over(Window.partitionBy(*self.keys)))
        sums = sums.drop("_bn")
        return (
            self._join(tagged, sums)
            .withColumn(out, (F.coalesce(F.col("_blk_before"), F.lit(0)) + F.row_number().over(self.inside)).cast("bigint"))
            .drop("_blk_before", *self.names)
        )

    def previous(self, df: DataFrame, cols: dict[str, str]) -> DataFrame:
        """Add for each ``source -> out`` the value of the previous row of the key (null on the first)."""
        return self.neighbours(df, before=cols)

    def following(self, df: DataFrame, cols: dict[str, str]) -> DataFrame:
        """As ``previous``, with the next row."""
        return self.neighbours(df, after=cols)

    def neighbours(self, df: DataFrame, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
        """Values of the previous and of the next row, with one summary of the blocks for both."""
        before, after = before or {}, after or {}
        tagged = self.tag(df)
        rank = F.struct(*[c for c, _ in _pairs(self.order)])
        if not all(up for _, up in _pairs(self.order)):
            raise ValueError("neighbours need an ascending order")
        jobs = [(before, F.lag, F.max_by, "_blk_b"), (after, F.lead, F.min_by, "_blk_a")]
        jobs = [j for j in jobs if j[0]]
        for cols, _, _, name in jobs:
            tagged = tagged.withColumn(name, F.struct(*cols))
        edges = tagged.groupBy(*self.keys, *self.names).agg(*[pick(name, rank).alias(name + "e") for _, _, pick, name in jobs])
        edges = edges.withColumns({name + "n": step(name + "e").over(self.across) for _, step, _, name in jobs})
        got = self._join(tagged, edges.drop(*[name + "e" for *_, name in jobs]))
        for cols, step, _, name in jobs:
            got = got.withColumn(name, F.coalesce(step(name).over(self.inside), F.col(name + "n")))
        for cols, _, _, name in jobs:
            got = got.withColumns({out: F.col(f"{name}.{src}") for src, out in cols.items()}).drop(name, name + "n")
        return got.drop(*self.names)

    def carry(self, df: DataFrame, out: str, value: Column, strict: bool = False) -> DataFrame:
        """The last non-null ``value`` at or before this row, or only before it when ``strict``."""
        return self.carry_all(df, {out: value}, strict)

    def carry_all(self, df: DataFrame, values: dict[str, Column], strict: bool = False) -> DataFrame:
        """``carry`` for several ``out -> value`` with one summary of the blocks for all of them."""
        at = list(enumerate(values))
        tagged = self.tag(df).withColumns({f"_v{i}": values[out] for i, out in at})
        rank = F.struct(*[c for c, _ in _pairs(self.order)])
        blocks = tagged.groupBy(*self.keys, *self.names).agg(*[F.max_by(F.col(f"_v{i}"), F.when(F.col(f"_v{i}").isNotNull(), rank)).alias(f"_edge{i}") for i, _ in at])
        before = self.across.rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumns({f"_blk_near{i}": F.last(f"_edge{i}", ignorenulls=True).over(before) for i, _ in at}).drop(*[f"_edge{i}" for i, _ in at])
        frame = self.inside.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        met = self._join(tagged, blocks).withColumns({out: F.coalesce(F.last(f"_v{i}", ignorenulls=True).over(frame), F.col(f"_blk_near{i}")) for i, out in at})
        return met.drop(*[f"{n}{i}" for i, _ in at for n in ("_v", "_blk_near")], *self.names)


def ranges(col: str, width: int = 65536) -> tuple[Column, bool]:
    """Block column: consecutive ranges of an integer column."""
    return F.floor(F.col(col) / F.lit(float(width))), True
