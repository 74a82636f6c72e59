"""Plans that put the operators together: detection over cells, reports, audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmend.functions.scalars import band
from gridmend.operators import profile as P
from gridmend.operators import rules as R
from gridmend.operators.cells import COLUMN, SHEET
from gridmend.operators.registry import Registry, drift_note, seed, snapshot_age
from gridmend.operators.sequence import autofill_flags
from gridmend.operators.store import stash
from gridmend.operators.xref import adjudicate


@dataclass
class Detection:
    """suspicions, profile (one row a column) and enriched cells of one run."""

    suspicions: DataFrame
    profile: DataFrame
    enriched: DataFrame

    def report(self, snapshot: str | None = None, today: str | None = None) -> DataFrame:
        """One row for each file: rows and columns scanned, identifier columns as sheet!column, suspicions, and a note if the registry's
        snapshot, a path with its date, is old at today's date."""
        rows = self.enriched.groupBy(*SHEET).agg((F.max("row_id") + 1).alias("rows")).groupBy("file_id").agg(F.sum("rows").alias("rows_scanned"))
        cols = self.profile.groupBy("file_id").agg(
            F.count("*").alias("columns_scanned"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("promoted") | F.col("is_id"), F.struct("sheet_ord", "col_ord", F.concat_ws("!", "sheet", "col").alias("c"))))), lambda x: x["c"]).alias("identifier_columns"),
        )
        found = self.suspicions.groupBy("file_id").agg(F.count("*").alias("n_suspicions"))
        note = drift_note(snapshot_age(F.lit(snapshot), F.lit(today).cast("date"))) if snapshot and today else F.lit(None).cast("string")
        return cols.join(rows, "file_id", "left").join(found, "file_id", "left").fillna(0).withColumn("note", note)


def detect(cells: DataFrame, registry: Registry | None = None, columns: DataFrame | None = None, row_context_boost: bool = False, reference_year: int = 2026) -> Detection:
    """Every damaged cell of any number of files. The enriched cells and the profile, which has one row a column, are stored once and
    read by all rules; these join them without a shuffle as long as the profile is small, and the optional adjudication takes one
    shuffle by row of the cells that hold identifiers."""
    registry = registry or seed(cells.sparkSession)
    enriched = stash(P.enrich(cells, registry.lookup(), reference_year))
    profile = stash(P.profile_columns(enriched, columns))
    found = R.cell_flags(enriched, profile, P.foreign_sheets(profile))
    found = found.unionByName(R.column_flags(profile)).unionByName(autofill_flags(R.prepared(enriched), profile))
    if row_context_boost:
        found = adjudicate(found, cells, registry)
    return Detection(found, profile, enriched)


def too_large(files: DataFrame, limit: int) -> DataFrame:
    """A suspicion for each of files (path, length) above a size limit, from file metadata alone, in the form of detect's."""
    none = F.lit(None).cast("string")
    put = {
        "file_id": F.col("path"), "sheet_ord": F.lit(0), "sheet": F.lit(""), "col_ord": F.lit(0), "col": F.lit(""), "row_id": F.lit(0).cast("long"), "rule_id": F.lit("R-BIG"),
        "kind": F.lit("file-too-large"), "value_repr": F.concat(F.format_number("length", 0), F.lit(" bytes")), "suggestion": none, "candidates": F.lit(None).cast("array<string>"),
        "confidence": F.lit(0.0), "reason_code": F.lit("R-BIG"), "reason_args": F.create_map(F.lit("limit"), F.lit(str(limit))), "xref_status": none,
    }
    return files.where(F.col("length") > limit).select(*[put[c].alias(c) for c in R.OUT])


def exit_code(suspicions: DataFrame, medium: float = 0.30) -> DataFrame:
    """(file_id, code): 1 with a high-confidence suspicion, 2 with one of at least ``medium``, else 0."""
    top = F.max("confidence")
    return suspicions.groupBy("file_id").agg(F.when(top >= 0.85, 1).when(top >= medium, 2).otherwise(0).alias("code"))


def audit_summary(suspicions: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, high, medium, low, info, kinds) of every file, clean ones included."""
    b = band(F.col("confidence"))
    counts = suspicions.groupBy("file_id").agg(
        *[F.count_if(b == name).alias(name.lower()) for name in ("High", "Medium", "Low", "Info")],
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    return files.select("file_id").distinct().join(counts, "file_id", "left").fillna(0, ["high", "medium", "low", "info"]).withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


__all__ = ["COLUMN", "Detection", "audit_summary", "detect", "exit_code", "too_large"]
