"""Runs of dates that a fill handle left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.functions import scalars as S
from gridmend.operators.store import small
from gridmend.operators.cells import COLUMN
from gridmend.operators.rules import _finish, flag

MIN_RUN = 3


def step_band(days: Column) -> Column:
    """The band of a step between two dates, null if it's in none."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(X.AUTOFILL_BANDS):
        out = F.when(days.between(lo, hi), i).otherwise(out)
    return out


def dated_cells(prepared: DataFrame, profile: DataFrame) -> DataFrame:
    """(COLUMN, row_id, d): cells of symbol columns that stand for one date with symbols behind it."""
    ids = profile.where("is_id").select(*COLUMN)
    c = prepared.join(small(ids), COLUMN)
    serial = F.when(F.col("integral").between(1, 1000000000), S.serial_to_date(F.col("integral")))
    d = F.when(F.col("vtype") == "date", F.col("v_date")).when(F.col("is_num"), serial).when((F.col("vtype") == "str") & (F.size("dates") == 1), F.get("dates", F.lit(0)))
    c = c.select(*COLUMN, "row_id", d.alias("d")).where("d is not null")
    return c.where(F.size(S.reverse_date(F.col("d"), F.lit(None).cast("string"))) > 0)


def runs(dated: DataFrame, keys: list[str] = COLUMN) -> DataFrame:
    """(keys, first_row, length) of runs of MIN_RUN cells or more: rows 1 or 2 apart and steps of one band.

    The pair that breaks a run is used up: the next run starts at its second cell without a band. That makes it a fold over
    dated cells in order. Where two neighbours can't be in one run whatever came before, the fold starts anew, so what is gathered for a fold
    is a stretch without such a gap, not a column."""
    order = Window.partitionBy(*keys).orderBy("row_id")
    gap, days = F.col("row_id") - F.lag("row_id").over(order), F.datediff(F.col("d"), F.lag("d").over(order))
    cut = F.when(F.coalesce(gap.between(1, 2) & step_band(days).isNotNull(), F.lit(False)), 0).otherwise(1)
    dated = dated.withColumn("cut", cut).withColumn("stretch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cell = F.struct(F.col("row_id").alias("r"), F.col("d"))
    start = "named_struct('first', cast(null as bigint), 'n', 0, 'band', cast(null as int), 'r', cast(null as bigint), 'd', cast(null as date), 'out', cast(array() as array<struct<first:bigint,n:int>>))"

    def step(a: Column, x: Column) -> Column:
        gap, days = x["r"] - a["r"], F.datediff(x["d"], a["d"])
        band = step_band(days)
        go = F.coalesce(gap.between(1, 2) & band.isNotNull() & (a["band"].isNull() | (a["band"] == band)), F.lit(False))
        closed = F.when(a["n"] >= MIN_RUN, F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("n"))))).otherwise(a["out"])
        return F.struct(
            F.when(go, a["first"]).otherwise(x["r"]).alias("first"), F.when(go, a["n"] + 1).otherwise(F.lit(1)).alias("n"), F.when(go, band).alias("band"),
            x["r"].alias("r"), x["d"].alias("d"), F.when(go, a["out"]).otherwise(closed).alias("out"),
        )

    def finish(a: Column) -> Column:
        return F.when(a["n"] >= MIN_RUN, F.concat(a["out"], F.array(F.struct(a["first"].alias("first"), a["n"].alias("n"))))).otherwise(a["out"])

    folded = dated.groupBy(*keys, "stretch").agg(F.aggregate(F.array_sort(F.collect_list(cell)), F.expr(start), step, finish).alias("runs"))
    return folded.select(*keys, F.explode("runs").alias("x")).select(*keys, F.col("x.first").alias("first_row"), F.col("x.n").cast("long").alias("length"))


def autofill_flags(prepared: DataFrame, profile: DataFrame) -> DataFrame:
    """One flag at the first row of each run."""
    found = runs(dated_cells(prepared, profile))
    text = F.concat(F.col("length").cast("string"), F.lit(" dates in a row"))
    args = F.create_map(F.lit("length"), F.col("length").cast("string"))
    return found.select(*COLUMN, F.col("first_row").alias("row_id"), text.alias("value_repr"), args.alias("reason_args"), flag("R-AUTO", "autofill-sequence", None, 0.90).alias("f")).transform(_finish)
