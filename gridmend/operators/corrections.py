"""Proposed and applied corrections, with an audit log and analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.functions.scalars import band, bucket, family, strip
from gridmend.operators.cells import SHEET
from gridmend.operators.rules import ADVISORY

KEY = [*SHEET, "col", "row_id"]


def split_candidates(suggestion):
    """The candidates of a rendered suggestion."""
    return F.filter(F.transform(F.split(suggestion, r"\|"), strip), lambda x: x != "")


def propose(suspicions: DataFrame) -> DataFrame:
    """One correction for each suspicion: its first candidate is proposed. Advice is marked and never applied."""
    return suspicions.select(
        F.xxhash64(*SHEET, "col", "row_id", "rule_id").alias("correction_id"), *SHEET, "col", "row_id", F.col("value_repr").alias("original_value"),
        F.coalesce(F.get("candidates", F.lit(0)), F.lit("")).alias("proposed_value"), F.coalesce("candidates", F.array().cast("array<string>")).alias("all_candidates"),
        "confidence", "kind", F.col("reason_code").alias("reason"), F.col("kind").isin(ADVISORY).alias("advisory"),
    )


def render(corrections: DataFrame) -> DataFrame:
    """The table that a reviewer sees; accept is preset from the confidence."""
    return corrections.select(
        "correction_id", (F.col("confidence") >= 0.85).alias("accept"), F.when(F.col("sheet") == "", "_").otherwise(F.col("sheet")).alias("sheet"), F.col("col").alias("column"),
        F.col("row_id").alias("row"), F.substring("original_value", 1, 50).alias("original"), F.col("proposed_value").alias("proposed"),
        F.array_join(F.slice("all_candidates", 2, 1000), " | ").alias("alt_candidates"), "confidence", "kind", F.substring("reason", 1, 120).alias("reason"),
    )


def decide(corrections: DataFrame, edited: DataFrame) -> DataFrame:
    """Corrections that a reviewer accepted, with the edited values. edited: (correction_id, accept, proposed)."""
    got = edited.where("accept").select("correction_id", F.col("proposed").alias("edited"))
    return corrections.join(got, "correction_id").withColumn("proposed_value", F.coalesce("edited", "proposed_value")).drop("edited")


def audit_log(decisions: DataFrame, cells: DataFrame) -> DataFrame:
    """decisions with applied and skip_reason. A header that several columns share stands for the first of them."""
    sheets = cells.select(*SHEET).distinct().withColumn("has_sheet", F.lit(True))
    places = cells.groupBy(*KEY).agg(F.min("col_ord").alias("col_ord"))
    d = decisions.join(sheets, SHEET, "left").join(places, KEY, "left")
    why = (
        F.when(F.coalesce("proposed_value", F.lit("")) == "", "empty proposed_value")
        .when(F.col("has_sheet").isNull(), "sheet not in workbook")
        .when(F.col("col_ord").isNull(), "could not resolve cell")
        .when(F.col("advisory"), "advisory only")
    )
    return d.withColumns({"applied": why.isNull(), "skip_reason": why}).drop("has_sheet")


def apply(cells: DataFrame, log: DataFrame) -> DataFrame:
    """New cells with the applied decisions; the source is untouched. A corrected cell is text, and a date format is cleared."""
    best = log.where("applied").groupBy(*SHEET, "col_ord", "row_id").agg(F.max_by("proposed_value", F.struct("confidence", "correction_id")).alias("new"))
    c = cells.join(best, [*SHEET, "col_ord", "row_id"], "left")
    hit = F.col("new").isNotNull()
    put = {"vtype": F.when(hit, "str").otherwise(F.col("vtype")), "v_str": F.coalesce("new", "v_str")}
    put |= {k: F.when(~hit, F.col(k)) for k in ("v_int", "v_num", "v_date", "v_time_h", "v_time_m", "v_bool")}
    put["number_format"] = F.when(~(hit & F.lower("number_format").rlike("[ymd]")), F.col("number_format"))
    return c.withColumns(put).drop("new").select(*cells.columns)


def analytics(corrections: DataFrame, top: int = 15) -> DataFrame:
    """(facet, item, n) by kind, family, confidence bucket (zero-filled), the ``top`` sheet::column pairs, and totals."""
    c = corrections.withColumns({"family": family(F.col("proposed_value")), "bucket": bucket(F.col("confidence")), "place": F.concat_ws("::", "sheet", "col")})
    by = lambda facet, col: c.groupBy(F.col(col).alias("item")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "item", "n")
    zero = c.sparkSession.createDataFrame([("bucket", b, 0) for b in ("high (>=0.85)", "medium (0.5-0.85)", "low (<0.5)")], "facet string, item string, n long")
    buckets = by("bucket", "bucket").unionByName(zero).groupBy("facet", "item").agg(F.sum("n").alias("n"))
    places = by("place", "place").orderBy(F.desc("n"), "item").limit(top)
    totals = c.agg(F.count("*").alias("n"), F.count_distinct("sheet").alias("sheets"), F.count_distinct("place").alias("columns"))
    totals = totals.select(F.explode(F.create_map(F.lit("n"), "n", F.lit("sheets"), "sheets", F.lit("columns"), "columns")).alias("item", "n")).select(F.lit("total").alias("facet"), "item", "n")
    return by("kind", "kind").unionByName(by("family", "family")).unionByName(buckets).unionByName(places).unionByName(totals)


def capped_report(suspicions: DataFrame, per_band: int = 20) -> DataFrame:
    """The text report's rows: at most ``per_band`` a band, the most confident first. The limit is pushed below the shuffle."""
    from pyspark.sql import Window

    b = suspicions.withColumn("band", band(F.col("confidence")))
    w = Window.partitionBy("file_id", "band").orderBy(F.desc("confidence"), *SHEET, "col_ord", "row_id", "rule_id")
    return b.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_band)


def json_report(suspicions: DataFrame) -> DataFrame:
    """(file_id, json) one line for each suspicion, in the command line's shape."""
    shape = F.struct(
        "sheet", F.col("col").alias("column"), F.col("row_id").alias("row"), F.col("value_repr").alias("value"), "kind", "suggestion", "confidence",
        F.concat_ws(" ", "reason_code", F.to_json("reason_args")).alias("reason"), "xref_status",
    )
    return suspicions.select("file_id", F.to_json(shape).alias("json"))


__all__ = ["X", "analytics", "apply", "audit_log", "capped_report", "decide", "json_report", "propose", "render", "split_candidates"]
