"""Packaged outputs: the JSON payload of a batch and the bundle of one file's corrected table, audit, report and schema."""

from __future__ import annotations

import csv
import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmend.functions.scalars import band
from gridmend.operators.cells import SHEET, value_text

VERSION = "0.1"
#: Rows of a sheet that a bundle may hold: it is put together on the driver.
MAX_COLUMNS = 16_384
BUNDLE_ROWS = 1_000_000


def payload(suspicions: DataFrame, errors: DataFrame) -> DataFrame:
    """One JSON row for each file: {version, tool, file, suspicions by band} or {version, tool, file, error}."""
    b = band(F.col("confidence"))
    counts = suspicions.groupBy("file_id").agg(*[F.count_if(b == n).alias(n.lower()) for n in ("High", "Medium", "Low", "Info")])
    head = [F.lit(VERSION).alias("version"), F.lit("gridmend").alias("tool"), F.col("file_id").alias("file")]
    ok = counts.select("file_id", F.to_json(F.struct(*head, F.struct("high", "medium", "low", "info").alias("suspicions"))).alias("json"))
    return ok.unionByName(errors.select("file_id", F.to_json(F.struct(*head, "error")).alias("json")))


def batch_summary(suspicions: DataFrame, files: DataFrame) -> DataFrame:
    """(item, n) of a batch: files, files with suspicions, and suspicions by band."""
    n = files.select("file_id").distinct().agg(F.count("*").alias("n")).select(F.lit("files").alias("item"), "n")
    hit = suspicions.agg(F.count_distinct("file_id").alias("n")).select(F.lit("files with suspicions").alias("item"), "n")
    by = suspicions.groupBy(band(F.col("confidence")).alias("item")).agg(F.count("*").alias("n"))
    return n.unionByName(hit).unionByName(by)


def wide_csv(cells: DataFrame, file_id: str, sheet: str) -> str:
    """One sheet as CSV text; a sheet beyond BUNDLE_ROWS is an error, and is written by Spark instead."""
    part = cells.where((F.col("file_id") == file_id) & (F.col("sheet") == sheet))
    names = [r.col for r in part.select("col_ord", "col").distinct().orderBy("col_ord").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError("the sheet is too wide for a bundle")
    if part.agg(F.max("row_id")).first()[0] >= BUNDLE_ROWS:
        raise ValueError("the sheet is too large for a bundle")
    rows = part.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("col", value_text()))).alias("m")).orderBy("row_id")
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(names)
    for r in rows.toLocalIterator():
        w.writerow([r.m.get(c, "") for c in names])
    return out.getvalue()


def bundle(fixed_cells: DataFrame, log: DataFrame, schemas: DataFrame, file_id: str) -> bytes:
    """A ZIP of one file: each sheet's corrected CSV and schema, the audit log as JSON and the report as CSV."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for s in schemas.where(F.col("file_id") == file_id).orderBy("sheet_ord").toLocalIterator():
            z.writestr(f"{s.sheet}.cleaned.csv", wide_csv(fixed_cells, file_id, s.sheet))
            z.writestr(f"{s.sheet}.schema.json", s.schema)
        cols = ["sheet", "col", "row_id", "original_value", "proposed_value", "kind", "confidence", "applied", "skip_reason"]
        rows = [r.asDict() for r in log.where(F.col("file_id") == file_id).select(*SHEET[2:], *cols[1:]).limit(BUNDLE_ROWS + 1).toLocalIterator()]
        if len(rows) > BUNDLE_ROWS:
            raise ValueError("the audit log is too long for a bundle")
        z.writestr("audit.json", json.dumps({"version": VERSION, "changes": rows}, default=str))
        out = io.StringIO()
        w = csv.DictWriter(out, cols)
        w.writeheader()
        w.writerows(rows)
        z.writestr("report.csv", out.getvalue())
    return data.getvalue()


def schema_bundle(schemas: DataFrame) -> bytes | None:
    """A ZIP of the schemas of a batch of files, one entry for each file (its first sheet's); None if there are none."""
    first = schemas.groupBy("file_id").agg(F.min_by("schema", "sheet_ord").alias("schema")).orderBy("file_id")
    data, n = io.BytesIO(), 0
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for r in first.toLocalIterator():
            z.writestr(f"{r.file_id.rsplit('/', 1)[-1]}.schema.json", r.schema)
            n += 1
    return data.getvalue() if n else None
