"""Quantities recorded in different units, converted to common ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions.pay_text import ALIASES, Pay, read_pay
from sievemill.session import ship

_TYPES = [T.BooleanType(), T.DoubleType(), T.DoubleType(), *[T.StringType()] * 4, T.IntegerType()]
_PAY = T.StructType([T.StructField("blank", T.BooleanType()), *[T.StructField(n, t) for n, t in zip(Pay._fields, _TYPES, strict=True)]])
#: Units a table may name beside the listed ones; they are patterns of the automaton in every task.
MOST_UNITS = 10_000


def _more_units(units: DataFrame) -> tuple[tuple[str, str], ...]:
    """The units of the table that the list of aliases lacks, which are looked for by their own names."""
    rows = units.where("kind in ('currency', 'period', 'scale') and trim(unit) <> ''").select("kind", "unit").distinct().limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError(f"a table of units names at most {MOST_UNITS}")
    return tuple(sorted((r["kind"], r["unit"]) for r in rows if (r["kind"], r["unit"]) not in ALIASES))


def _read(text: str, more: tuple[tuple[str, str], ...]) -> Column:
    """What a pay text states, by a Pandas UDF that reads equal texts of a batch once."""

    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            codes, values = pd.factorize(batch, use_na_sentinel=True)
            told = [read_pay(v, more) for v in values]
            rows = [(p is None, *(p or Pay(False))) for p in told] + [(True, *Pay(False))]
            yield pd.DataFrame([rows[c] for c in codes], columns=["blank", *Pay._fields])

    read.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(read, _PAY)(text)


def further_amounts(rows: DataFrame, units: DataFrame, *, key: str = "id", text: str = "salary") -> DataFrame:
    """(id, text, further): texts that state more amounts than the one or the range that was taken, and how many."""
    ship(rows.sparkSession)
    told = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).distinct()
    return told.withColumn("further", _read("text", _more_units(units))["further"]).where("further > 0")


def pay_per_year(rows: DataFrame, units: DataFrame, *, key: str = "id", text: str = "salary", low: str = "salarymin", high: str = "salarymax") -> DataFrame:
    """(id, usd_year_min, usd_year_max): every id that states pay, in whole US dollars a year.

    An automaton finds the unit aliases in the text, the longest match counts; amounts stand near them.
    Amounts in the text win over the two columns; a text of units alone applies to the columns; blank text
    leaves the columns as dollars a year; text that states no pay is no case. Of one filled column both
    ends are made, the smaller end comes first. A unit without a factor in ``units`` states nothing.
    ``units`` is joined by key, so Spark broadcasts it while it is small and shuffles otherwise; a unit that the
    fixed aliases lack is found by its own name. Of several amounts the first with a unit beside it counts,
    see ``further_amounts`` for the rest. Dollars beyond 64 bits are no case. Repeated rows give one row; a null key is no record.
    """
    read = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(low).cast("double").alias("a"), F.col(high).cast("double").alias("b"), _read(text, _more_units(units)).alias("p"))
    ship(rows.sparkSession)
    own = F.col("p.low").isNotNull()
    a = F.coalesce("a", "b")
    b = F.coalesce("b", "a")
    told = read.where("(p.blank or p.stated)").select(
        "id",
        F.when(own, F.col("p.low")).otherwise(a).alias("low"),
        F.when(own, F.col("p.high")).otherwise(b).alias("high"),
        F.coalesce("p.low_scale", F.lit("")).alias("low_scale"),
        F.coalesce("p.high_scale", F.lit("")).alias("high_scale"),
        F.when(F.col("p.blank"), "USD").otherwise(F.col("p.currency")).alias("currency"),
        F.when(F.col("p.blank"), "year").otherwise(F.col("p.period")).alias("period"),
    )
    told = told.where("low is not null").distinct()
    factor = units.select("kind", "unit", F.col("factor").cast("double").alias("factor"))

    def of(kind: str, name: str) -> DataFrame:
        return factor.where(F.col("kind") == kind).groupBy(F.col("unit").alias(name)).agg(F.max("factor").alias(f"{name}_x"))

    # A scale is named for few texts; both ends mostly share it.
    scaled = told.join(of("scale", "low_scale"), "low_scale", "left").join(of("scale", "high_scale"), "high_scale", "left")
    priced = scaled.join(of("currency", "currency"), "currency").join(of("period", "period"), "period")
    usd = lambda v, scale: F.col(v) * F.when(F.col(scale) == "", F.lit(1.0)).otherwise(F.col(f"{scale}_x")) * F.col("currency_x") * F.col("period_x")
    whole = lambda c: F.round(F.round(c, 6), 0).try_cast("bigint")
    x, y = whole(usd("low", "low_scale")), whole(usd("high", "high_scale"))
    return priced.select("id", F.least(x, y).alias("usd_year_min"), F.greatest(x, y).alias("usd_year_max")).where("usd_year_min is not null and usd_year_max is not null").distinct()
