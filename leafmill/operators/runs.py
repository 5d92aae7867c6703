"""Running values over the rows of a key in order, for keys of any number of rows.

The order, a whole number, is cut into stretches of `size`. A window runs over each stretch by itself; what the stretches
before hold comes from one row for each of them. So a key that holds a tenth of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SIZE = 65_536


def join_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys are equal; `right` is unique by the keys and loses them."""
    named = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(named, on, "left").drop(*(f"__r_{k}" for k in keys))


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], ties: tuple[str, ...] = (), size: int = SIZE, before: bool = False) -> DataFrame:
    """df with a column for each of `values`, {name: (kind, value)}: the sum, greatest or last non-null value of the rows up to
    this one, or with `before` of those before it. Rows of one order go by `ties`."""
    b = df.withColumn("__b", F.floor(F.col(order) / size)).withColumns({f"__v_{n}": v for n, (_, v) in values.items()})
    w = Window.partitionBy(*keys, "__b").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    of = {"sum": F.sum, "max": F.max}
    pick = lambda kind, c: of[kind](c) if kind in of else F.last(c, ignorenulls=True)
    by = F.struct(order, *ties)
    whole = {n: F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), by)) if kind == "last" else of[kind](f"__v_{n}") for n, (kind, _) in values.items()}
    blocks = b.groupBy(*keys, "__b").agg(*(v.alias(f"__s_{n}") for n, v in whole.items()))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__b", *(pick(kind, f"__s_{n}").over(earlier).alias(f"__c_{n}") for n, (kind, _) in values.items()))
    inside = b.withColumns({n: pick(kind, f"__v_{n}").over(w) for n, (kind, _) in values.items()})
    out = join_safe(inside, blocks, [*keys, "__b"])
    both = {"sum": lambda n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0)), "max": lambda n: F.greatest(n, f"__c_{n}"), "last": lambda n: F.coalesce(n, f"__c_{n}")}
    out = out.withColumns({n: both[kind](n) for n, (kind, _) in values.items()})
    return out.drop("__b", *(f"__{x}_{n}" for x in "vc" for n in values))


def neighbours(df: DataFrame, keys: list[str], order: str, value: str, names: tuple[str, str], ties: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """df with the value of the row before and of the row behind."""
    b = df.withColumn("__b", F.floor(F.col(order) / size))
    w = Window.partitionBy(*keys, "__b").orderBy(order, *ties)
    by = F.struct(order, *ties)
    ends = b.groupBy(*keys, "__b").agg(F.min_by(value, by).alias("__first"), F.max_by(value, by).alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.select(*keys, "__b", F.lag("__last").over(over).alias("__before"), F.lead("__first").over(over).alias("__behind"))
    b = b.withColumns({"__n": F.row_number().over(w), names[0]: F.lag(value).over(w), names[1]: F.lead(value).over(w), "__m": F.lead(F.lit(1)).over(w)})
    out = join_safe(b, ends, [*keys, "__b"])
    out = out.withColumns({names[0]: F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col(names[0])), names[1]: F.when(F.col("__m").isNull(), F.col("__behind")).otherwise(F.col(names[1]))})
    return out.drop("__b", "__n", "__m", "__before", "__behind")
