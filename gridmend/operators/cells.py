"""The cells model: any table or workbook as one long DataFrame of typed cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = (
    "file_id string, sheet_ord int, sheet string, col_ord int, col string, row_id long, vtype string, v_str string, "
    "v_int decimal(38,0), v_num double, v_date date, v_time_h int, v_time_m int, v_bool boolean, number_format string"
)
#: What names a column, and a sheet.
COLUMN = ["file_id", "sheet_ord", "sheet", "col_ord", "col"]
SHEET = ["file_id", "sheet_ord", "sheet"]


def _cell(c: Column, kind: T.DataType) -> dict[str, Column]:
    if isinstance(kind, T.BooleanType):
        return {"vtype": F.lit("bool"), "v_bool": c}
    if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return {"vtype": F.lit("int"), "v_int": c.cast("decimal(38,0)"), "v_num": c.cast("double")}
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        x = c.cast("double")
        return {"vtype": F.lit("float"), "v_num": F.when(~F.isnan(x), x)}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"vtype": F.lit("date"), "v_date": c.cast("date")}
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return {"vtype": F.lit("str"), "v_str": c.cast("string")}
    return {"vtype": F.lit("other"), "v_str": c.cast("string")}


def from_table(df: DataFrame, row_id: str | Column, file_id: str = "table", sheet: str = "_sheet0", skip: tuple[str, ...] = ()) -> DataFrame:
    """The cells of a typed table: one pass, no shuffle. Null and NaN cells are left out; row_id orders the rows."""
    wanted = T._parse_datatype_string("vtype string, v_str string, v_int decimal(38,0), v_num double, v_date date, v_bool boolean")
    structs = []
    for i, f in enumerate(x for x in df.schema.fields if x.name not in skip):
        got = _cell(F.col(f"`{f.name}`"), f.dataType)
        parts = [got.get(w.name, F.lit(None)).cast(w.dataType).alias(w.name) for w in wanted.fields]
        structs.append(F.struct(F.lit(i).alias("col_ord"), F.lit(f.name).alias("col"), *parts))
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    long = df.select(rid.cast("long").alias("row_id"), F.explode(F.array(*structs)).alias("c"))
    null = lambda kind: F.lit(None).cast(kind)
    out = long.select(
        F.lit(file_id).alias("file_id"), F.lit(0).alias("sheet_ord"), F.lit(sheet).alias("sheet"), "c.col_ord", "c.col", "row_id", "c.vtype", "c.v_str", "c.v_int",
        "c.v_num", "c.v_date", null("int").alias("v_time_h"), null("int").alias("v_time_m"), "c.v_bool", null("string").alias("number_format"),
    )
    return out.where(F.coalesce(F.col("v_str"), F.col("v_num").cast("string"), F.col("v_date").cast("string"), F.col("v_bool").cast("string")).isNotNull())


def columns_of(df: DataFrame, file_id: str = "table", sheet: str = "_sheet0", skip: tuple[str, ...] = ()) -> DataFrame:
    """(COLUMN) rows of a table, so that empty columns survive."""
    names = [c for c in df.columns if c not in skip]
    return df.sparkSession.createDataFrame([(file_id, 0, sheet, i, c) for i, c in enumerate(names)], "file_id string, sheet_ord int, sheet string, col_ord int, col string")


def value_text() -> Column:
    """A cell's value as text."""
    return F.coalesce(
        F.when(F.col("vtype") == "str", F.col("v_str")),
        F.when(F.col("vtype") == "int", F.col("v_int").cast("string")),
        F.when(F.col("vtype") == "date", F.col("v_date").cast("string")),
        F.when(F.col("vtype") == "time", F.format_string("%02d:%02d", "v_time_h", "v_time_m")),
        F.when(F.col("vtype") == "bool", F.col("v_bool").cast("string")),
        F.col("v_num").cast("string"),
        F.col("v_str"),
    )


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Fill the empty cells of merged ranges with their top left value. ranges: SHEET, r0, c0, r1, c1 (rows without the
    header, columns from 0, inclusive). Ranges don't overlap, so each place has one anchor."""
    places = ranges.where("r0 >= 0").select(
        *SHEET, "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("row_id"), F.col("c1")
    ).select(*SHEET, "r0", "c0", F.col("row_id").cast("long").alias("row_id"), F.explode(F.sequence("c0", "c1")).alias("col_ord"))
    anchor = cells.withColumnsRenamed({"row_id": "r0", "col_ord": "c0"}).drop("col")
    names = cells.select(*COLUMN).distinct()
    filled = places.join(anchor, [*SHEET, "r0", "c0"]).join(names, [*SHEET, "col_ord"])
    missing = filled.join(cells.select(*SHEET, "row_id", "col_ord"), [*SHEET, "row_id", "col_ord"], "left_anti")
    return cells.unionByName(missing.select(*cells.columns))


def sample_rows(cells: DataFrame, n_rows: int, head: int = 5000, share: int = 10, seed: int = 20260518, above: int = 100_000) -> DataFrame:
    """The opt-in stratified sample of a sheet of n_rows rows: its first and last ``head`` rows and one in ``share`` of the others, by
    a hash of the row. Sheets of ``above`` rows or fewer are whole; all other operators scan every row by default."""
    if n_rows <= above:
        return cells
    inner = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(share)) == 0
    return cells.where((F.col("row_id") < head) | (F.col("row_id") >= n_rows - head) | inner)
