"""Small sheets on which every emission rule fires, as queries run them once for each nation."""

from __future__ import annotations

from datetime import date as d
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.operators.cells import SCHEMA

SYMBOLS = ["BRCA1", "TP53", "EGFR", "MYC", "ATM", "PTEN", "KRAS", "NRAS", "ALK", "APC"]
SHEETS = {
    "times": {"gene": [*SYMBOLS[:3], "01:03", "11:30", (1, 3)]},
    "alike": {"gene": [*SYMBOLS[:4], "ТP53", "АTM"]},
    "dates": {"symbol": ["BRCA1", "TP53", d(2024, 9, 2), d(2024, 3, 1), "MARCHF1"]},
    "lone": {"symbol": [*SYMBOLS[:3], d(2024, 9, 2), *SYMBOLS[3:6]]},
    "serial": {"symbol": ["BRCA1", "TP53", 41334, "EGFR", "41519", d(2024, 9, 2), 41153]},
    "serial_alone": {"symbol": [*SYMBOLS[:4], 41334, "41519"]},
    "id_float": {"symbol": [*SYMBOLS[:4], 2.31e13]},
    "zeros": {"acc": ["00012345", "00012346", "00012347", 12345, "23456"]},
    "zeros_two": {"acc": ["00012345", "00012346", "0012347", 12345]},
    "long": {"accession": ["NM_000546", "NM_000547", "NM_000548", "NM_000549", 12345678901234567890]},
    "floats": {"gene_id": [1.5e8, 9.876543e11, 1e8, 2.310009e13, 1.23456789123e10]},
    "riken": {"RIKEN_cdna_id": [2.310009e7, 1.234567e8, 9.876543e9, 100506334.0]},
    "blind": {"misc_col": ["x", "y", "41519", "z", "w"], "Unnamed_1": [39880, "x", "y", "z", "w"], "col_a": ["foo", "2-Oct", "bar", "baz", "qux"], "misc_b": ["foo", d(2024, 9, 2), *["a note of words"] * 10]},
    "texts": {"marker": ["Oct-3/4", "stem", "note"], "remark": ["foo", "50-78-2", "bar"], "cas_number": ["foo", "50-78-2", "bar"]},
    "auto": {"symbol": [*SYMBOLS[:5], *[d(2024, 9, i) for i in range(2, 7)], *SYMBOLS[5:]]},
    "commas": {"value": ["1,5", "2,7", "0,8", "3,14", "1,2", "4,0"]},
    "comma_cell": {"value": ["1.5"] * 9 + ["3,14"] + ["2.5"]},
    "unknown": {"symbol": [*SYMBOLS, "XYZZY9"]},
}


def _cell(v: object) -> dict[str, object]:
    if isinstance(v, tuple):
        return {"vtype": "time", "v_time_h": v[0], "v_time_m": v[1]}
    if isinstance(v, d):
        return {"vtype": "date", "v_date": v}
    if isinstance(v, int):
        return {"vtype": "int", "v_int": Decimal(v), "v_num": float(v)}
    if isinstance(v, float):
        return {"vtype": "float", "v_num": v}
    return {"vtype": "str", "v_str": v}


def cells(spark: SparkSession, nation: DataFrame) -> DataFrame:
    """The cells of all sheets, in a file of its own for each row of nation; sheet names the sheet."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = []
    for at, (sheet, columns) in enumerate(SHEETS.items()):
        for j, (col, values) in enumerate(columns.items()):
            for i, v in enumerate(values):
                cell = {"file_id": None, "sheet_ord": at, "sheet": sheet, "col_ord": j, "col": col, "row_id": i, **_cell(v)}
                rows.append(tuple(cell.get(n) for n in names))
    one = spark.createDataFrame(rows, SCHEMA)
    files = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24)))).join(nation.select(F.col("n_nationkey").cast("int").alias("k"), "n_name"), "k")
    return files.withColumn("file_id", F.col("n_name")).select(*names)
