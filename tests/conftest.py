import os
import sys
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def cells(spark):
    """cells({file: {column: values}}, formats): a cells DataFrame of small tables, each a file of one sheet."""
    from gridmend.operators.cells import SCHEMA

    def make(files, formats=None):
        rows = []
        for name, cols in files.items():
            for j, (col, values) in enumerate(cols.items()):
                for i, v in enumerate(values):
                    if v is None:
                        continue
                    kind = {bool: "bool", int: "int", float: "float", date: "date", str: "str", tuple: "time"}[type(v)]
                    num = kind in ("int", "float")
                    rows.append((
                        name, 0, "S", j, col, i, kind, v if kind == "str" else None, Decimal(v) if kind == "int" else None, float(v) if num else None, v if kind == "date" else None,
                        v[0] if kind == "time" else None, v[1] if kind == "time" else None, v if kind == "bool" else None, (formats or {}).get((name, col, i)),
                    ))
        return spark.createDataFrame(rows, SCHEMA)

    return make
