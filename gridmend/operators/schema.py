"""Table schemas that keep the damage from happening again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.operators.cells import COLUMN, SHEET

PATTERNS = {"HGNC": "^[A-Z][A-Z0-9-]{1,14}$", "RIKEN": r"^\d{7}[A-Z]\d{2}$"}
SAID = {
    "HGNC": "gene symbol: kept as text so that it is not read as a date or a number",
    "RIKEN": "clone identifier: kept as text so that it is not read in scientific notation",
    "generic": "identifier: kept as text so that it is not converted on import",
}


def fields(enriched: DataFrame, profile: DataFrame) -> DataFrame:
    """(COLUMN, registry, type, pattern): identifier columns are strings with the pattern that their first 200 cells show, other columns
    get a coarse type from their first 50."""
    rank = F.row_number().over(Window.partitionBy(*COLUMN).orderBy("row_id"))
    first = enriched.withColumn("rn", rank).where("rn <= 200")
    text, early = F.col("vtype") == "str", F.col("rn") <= 50
    seen = first.groupBy(*COLUMN).agg(
        F.count_if(text & F.col("is_known")).alias("known"), F.count_if(text & F.col("v_str").rlike(X.GENE_LIKE)).alias("like"), F.count_if(text & F.col("v_str").rlike(X.RIKEN)).alias("riken"),
        *[F.count_if(early & (F.col("vtype") == t)).alias(f"t_{t}") for t in ("int", "float", "bool", "date")], F.count_if(early).alias("t_all"),
    )
    j = profile.select(*COLUMN, (F.col("promoted") | F.col("is_id")).alias("id")).join(seen, COLUMN, "left").fillna(0)
    registry = F.when((F.col("known") >= 1) | ((F.col("like") > 0) & (F.col("like") >= F.col("riken"))), "HGNC").when(F.col("riken") >= 1, "RIKEN").otherwise("generic")
    coarse = (
        F.when(F.col("t_all") == 0, "string")
        .when(F.col("t_int") == F.col("t_all"), "integer")
        .when(F.col("t_int") + F.col("t_float") == F.col("t_all"), "number")
        .when(F.col("t_bool") == F.col("t_all"), "boolean")
        .when(F.col("t_date") > 0, "date")
        .otherwise("string")
    )
    pattern = F.when(registry == "HGNC", PATTERNS["HGNC"]).when(registry == "RIKEN", PATTERNS["RIKEN"])
    return j.select(*COLUMN, F.when(F.col("id"), registry).alias("registry"), F.when(F.col("id"), "string").otherwise(coarse).alias("type"), F.when(F.col("id"), pattern).alias("pattern"))


def table_schemas(field_rows: DataFrame) -> DataFrame:
    """(SHEET, schema): one JSON table schema for each sheet, its fields in column order."""
    said = F.when(F.col("registry") == "HGNC", SAID["HGNC"]).when(F.col("registry") == "RIKEN", SAID["RIKEN"]).when(F.col("registry") == "generic", SAID["generic"])
    field = F.struct(
        F.col("col").alias("name"), "type", F.when(F.col("pattern").isNotNull(), F.struct("pattern")).alias("constraints"), said.alias("description")
    )
    rows = field_rows.groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", field.alias("f")))), lambda x: x["f"]).alias("fields"))
    body = F.struct(
        F.lit("https://specs.frictionlessdata.io/schemas/table-schema.json").alias("$schema"), F.col("sheet").alias("name"), "fields",
        F.array(*[F.lit(x) for x in X.SCHEMA_MISSING]).alias("missingValues"),
    )
    return rows.select(*SHEET, F.to_json(body).alias("schema"))


def violations(cells: DataFrame, field_rows: DataFrame) -> DataFrame:
    """Cells that don't satisfy their column's schema."""
    j = cells.join(field_rows.where("registry is not null"), COLUMN)
    bad = (F.col("vtype") != "str") | (F.col("pattern").isNotNull() & ~F.col("v_str").rlike(PATTERNS["HGNC"]) & (F.col("registry") == "HGNC")) | ((F.col("registry") == "RIKEN") & ~F.col("v_str").rlike(PATTERNS["RIKEN"]))
    return j.where(bad).select(*COLUMN, "row_id", "vtype", "registry")


def bare_column(name: Column) -> Column:
    """A column's name without the sheet in front of it."""
    return F.substring_index(name, "!", -1)
