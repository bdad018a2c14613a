"""Two copies of a table compared: sums that no order can change per bucket of keys, rows only where the sums differ.

Where the copies agree, which is nearly everywhere, a bucket costs one row; only the rows of differing buckets are
shuffled and joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def marks(columns: list[str]) -> list[Column]:
    """Values and whether they are null, so that a null never hashes like an absent column."""
    return [x for c in columns for x in (F.col(c), F.col(c).isNull())]


def with_bucket(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*marks(keys)), F.lit(buckets)))


def checksums(df: DataFrame, keys: list[str], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, n, and two independent sums over its rows, the same in any order. Repeated rows count."""
    seeded = [F.xxhash64(*marks(keys + columns)), F.xxhash64(F.lit(1), *marks(keys + columns))]
    return with_bucket(df, keys, buckets).groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(seeded[0]).alias("x"), F.sum(seeded[1].cast("decimal(20,0)")).alias("s"))


def differing_buckets(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    left, right = (checksums(df, keys, columns, buckets).select("bucket", F.struct("n", "x", "s").alias(name)) for df, name in ((a, "_a"), (b, "_b")))
    return left.join(right, "bucket", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("bucket")


def differing_rows(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], buckets: int = BUCKETS, once: bool = False) -> DataFrame:
    """The keys on which two copies differ: keys, status (only_a, only_b, changed, repeated) and the names of the columns
    that changed. A null key equals a null key; a key that stands a different number of times is ``repeated``. With
    ``once`` a key counts once in each copy, by its least row.

    The rows of both copies are shuffled together, once."""
    wanted = F.broadcast(differing_buckets(a, b, keys, columns, buckets))  # a number each, and no more than ``buckets``

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = with_bucket(df, keys, buckets).join(wanted, "bucket", "left_semi")
        return rows.select(*keys, F.lit(name).alias("_copy"), F.struct(*columns).alias("_row"))

    def of(name: str) -> list[Column]:
        own = F.when(F.col("_copy") == name, F.col("_row"))
        if once:
            return [F.min(own).alias(f"_lo{name}")]
        mark = F.when(F.col("_copy") == name, F.xxhash64(*marks([f"_row.{c}" for c in columns])))
        return [F.count(own).alias(f"_n{name}"), F.min(own).alias(f"_lo{name}"), F.max(own).alias(f"_hi{name}"), F.bit_xor(mark).alias(f"_x{name}")]

    met = side(a, "a").unionByName(side(b, "b")).groupBy(*keys).agg(*of("a"), *of("b"))
    differs = lambda p, c: ~F.col(f"_{p}a.{c}").eqNullSafe(F.col(f"_{p}b.{c}"))
    changed = F.concat_ws(",", *(F.when(differs("lo", c) if once else differs("lo", c) | differs("hi", c), F.lit(c)) for c in columns))
    status = F.when(F.col("_lob").isNull(), "only_a").when(F.col("_loa").isNull(), "only_b")
    status = status.when(changed != "", "changed") if once else status.when(F.col("_na") != F.col("_nb"), "repeated").when((changed != "") | (F.col("_xa") != F.col("_xb")), "changed")
    both = F.col("_loa").isNotNull() & F.col("_lob").isNotNull()
    return met.select(*keys, status.alias("status"), F.when(both, changed).otherwise("").alias("columns")).filter("status is not null")


def review_metrics(corrections: DataFrame, overlay: DataFrame) -> DataFrame:
    """(metric, value) of a set of reviews: rows, keys, flags, labels, notes, bindings, rows without an outline, and the
    states that the overlay makes of them. ``corrections`` carries label and note of the object, bind and outline."""
    said = corrections.select("image_id", "mask_key", "removed", "accepted", "label", "note", "bind", "outline")
    wide = said.agg(
        F.count("*").alias("rows"), F.count_if("removed").alias("removed"), F.count_if("accepted").alias("accepted"), F.count_if(F.coalesce("note", F.lit("")) != "").alias("notes"),
        F.count_if(F.coalesce("outline", F.lit("")) == "").alias("no_outline"))
    long = wide.selectExpr("stack(5, 'rows', rows, 'removed', removed, 'accepted', accepted, 'notes', notes, 'no_outline', no_outline) as (metric, value)")
    keys = said.select("image_id", "mask_key").distinct().agg(F.count("*").alias("value")).select(F.lit("keys").alias("metric"), "value")

    def per(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.filter(F.coalesce(column, F.lit("")) != "").groupBy(F.concat(F.lit(name + ":"), F.col(column)).alias("metric")).agg(F.count("*").alias("value"))

    return reduce(DataFrame.unionByName, [long, keys, per(said, "label", "label"), per(said, "bind", "bind"), per(overlay, "state", "state")])
