"""Adjudication of suspicions by the external identifiers of their row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.functions.scalars import strip
from gridmend.operators.cells import SHEET
from gridmend.operators.registry import Registry, lookup_ids
from gridmend.operators.store import stash


def resolved_ids(cells: DataFrame, registry: Registry) -> DataFrame:
    """(SHEET, row_id, col_ord, s, gene) of text cells that hold a known external identifier. The shape test comes before the
    join, so most cells never reach it."""
    text = cells.where("vtype = 'str'").select(*SHEET, "row_id", "col_ord", strip(F.col("v_str")).alias("s"))
    shaped = text.where(" or ".join(f"s rlike r'{shape}'" for _, shape in X.ID_SHAPES))
    return lookup_ids(shaped, "s", registry).where("gene is not null")


def adjudicate(suspicions: DataFrame, cells: DataFrame, registry: Registry) -> DataFrame:
    """suspicions with xref_status and the confidence that follows: corroborated if an identifier elsewhere in the row resolves to
    a symbol that equals a candidate or a name of it, contradicted if some resolve and none does, absent if none resolves."""
    keyed = suspicions.withColumn("sid", F.xxhash64(*SHEET, "col_ord", "row_id", "rule_id"))
    asked = keyed.where("suggestion is not null").select("sid", *SHEET, "col_ord", "row_id", "candidates")
    ids = resolved_ids(cells, registry).withColumnRenamed("col_ord", "at")
    near = stash(asked.join(ids, [*SHEET, "row_id"]).where("at <> col_ord"))
    wanted = near.select("sid", "candidates", "at", "s", "gene")
    names = near.select(F.explode("candidates").alias("symbol")).distinct()
    equal = registry.equivalents(names).withColumnRenamed("symbol", "candidate")
    hits = wanted.select("sid", "gene", F.explode("candidates").alias("candidate")).join(equal, "candidate").where("equivalent = gene").select("sid", "gene").distinct().withColumn("hit", F.lit(True))
    seen = wanted.join(hits, ["sid", "gene"], "left").groupBy("sid").agg(
        F.max(F.coalesce("hit", F.lit(False))).alias("agrees"),
        F.slice(F.array_sort(F.collect_set(F.struct("at", "s", "gene"))), 1, 3).alias("ids"),
    )
    out = keyed.join(seen, "sid", "left")
    asked_ = F.col("suggestion").isNotNull()
    status = F.when(asked_ & F.col("agrees").isNull(), "absent").when(asked_ & F.col("agrees"), "corroborated").when(asked_, "contradicted")
    conf = F.when(status == "corroborated", F.least(F.lit(0.99), F.col("confidence") + 0.4)).when(status == "contradicted", F.least(F.col("confidence"), F.lit(0.20))).otherwise(F.col("confidence"))
    said = F.array_join(F.transform("ids", lambda i: F.concat_ws("->", i["s"], i["gene"])), ", ")
    args = F.when(F.col("ids").isNotNull(), F.map_concat("reason_args", F.create_map(F.lit("row_ids"), said))).otherwise(F.col("reason_args"))
    return out.withColumns({"xref_status": status, "confidence": conf, "reason_args": args}).select(*suspicions.columns)
