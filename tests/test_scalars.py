from datetime import date

import pytest
from pyspark.sql import functions as F

from gridmend.functions import scalars as S


def one(spark, schema, rows, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_serials(spark):
    rows = [(39880,), (41334,), (41519,), (19999,), (20000,), (60000,), (60001,)]
    got = one(spark, "n int", rows, S.serial_to_date(F.col("n")))
    assert got[:3] == [(date(2009, 3, 8),), (date(2013, 3, 1),), (date(2013, 9, 2),)]
    assert [g[0] is None for g in got[3:]] == [True, False, False, True]


def test_dates_to_symbols(spark):
    cases = [
        (date(2024, 9, 2), None, ["SEPT2", "SEP2"]),
        (date(2024, 3, 1), None, ["MARCH1", "MARC1"]),
        (date(2007, 9, 1), "mmm-yy", ["SEPT7", "SEP7"]),
        (date(2007, 9, 1), None, ["SEPT1", "SEP1", "SEPT7", "SEP7"]),
        (date(2024, 5, 31), None, ["MEI31", "JUN1"]),
        (date(2024, 11, 2), None, []),
        (date(2024, 6, 3), None, []),
        (date(2035, 1, 1), "mmm-yy", ["TAMM35"]),
        (date(3715, 9, 2), None, []),
    ]
    got = one(spark, "d date, f string", [(d, f) for d, f, _ in cases], S.reverse_date(F.col("d"), F.col("f")))
    assert [g[0] for g in got] == [w for *_, w in cases]


def test_canonical(spark):
    got = one(spark, "c array<string>", [(["SEPT2", "SEP2"],), (["MARCH1", "MARC1"],), (["DEC1"],), (["OCT4"],)], S.canonical(F.col("c")), S.has_one_modern(F.col("c")))
    assert got == [(["SEPTIN2", "SEPT2", "SEP2"], True), (["MARCHF1", "MTARC1", "MARCH1", "MARC1"], False), (["DELEC1", "DEC1"], True), (["OCT4"], False)]


@pytest.mark.parametrize("whole", [True])
def test_parse(spark, whole):
    d = date
    cases = {
        "2-Oct": [d(2026, 10, 2)], "Mar-06-14": [d(2014, 3, 6)], "06/03/14": [d(2014, 3, 6), d(2014, 6, 3)], "2012-03-03 00:00": [d(2012, 3, 3)], "07.Mär": [d(2026, 3, 7)], "September 2, 2024": [d(2024, 9, 2)],
        "2 March 2014": [d(2014, 3, 2)], "30-Feb": [], "BRCA1": [], "March 2014": [], "1/13/2014": [d(2014, 1, 13)], "": [],
    }
    got = one(spark, "t string", [(t,) for t in cases], S.parse_dates(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_cell_tokens(spark):
    got = one(spark, "t string", [("2-Oct,ATOCT2,OCT2",), ("x|2-Oct|y",), ("x\t2-Oct",), ("a,b;2-Oct",), ("a,b",)], F.size(S.parse_cell_dates(F.col("t"))))
    assert [g[0] for g in got] == [1, 1, 1, 1, 0]


def test_riken(spark):
    yes, no = [2.310009e19, 2.310009e13, 9.876543e11], [1.5e8, 2e10, 1e15, 1e7, 5e8, 100506334.0, 1.111111e10, -2.310009e19, 0.0]
    got = one(spark, "x double", [(x,) for x in yes + no], S.riken_signature(F.col("x")))
    assert [g[0] for g in got] == [True] * 3 + [False] * len(no)


def test_kinds(spark):
    cases = {
        "HGNC:11998": "hgnc_id", "ENSG00000012048": "ensembl", "NM_007294.3": "refseq", "P00533": "uniprot", "1956": "entrez", "672": "numeric", "BRCA1": "gene_like", "2310009E13": "riken_pattern",
        "n.d.": "placeholder", "0.0": "placeholder", " ": "empty", "1e12": "string-other", "-1.5e3": "numeric", "some words": "string-other",
    }
    got = one(spark, "t string", [(t,) for t in cases], S.text_kind(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_headers(spark):
    from gridmend.functions.fixed import IDENTIFIER_HINTS

    cases = {"ENTREZID": True, "genesymbol": True, "sampleid": True, "kid": False, "value": False, "x" * 81 + " gene": False, "Gene Name": True}
    got = one(spark, "t string", [(t,) for t in cases], S.has_hint(S.header_tokens(F.col("t")), IDENTIFIER_HINTS))
    assert [g[0] for g in got] == list(cases.values())


def test_homoglyphs_and_times(spark):
    got = one(spark, "t string", [("ΣEPT2",), ("АTM",), ("BRCA１",), ("BRCA1",), ("été",)], S.gene_after_repair(F.col("t")))
    assert [g[0] for g in got] == ["SEPT2", "ATM", "BRCA1", None, None]
    got = one(spark, "t string", [("01:03",), ("11:30:00",), ("24:10",), ("25:10",), ("1:3",)], S.time_text(F.col("t")))
    assert [g[0] for g in got] == ["1:03", "11:30", "24:10", None, None]


def test_simulator_round_trip(spark):
    symbols = [f"SEPT{i}" for i in range(1, 16)] + [f"MARCH{i}" for i in range(1, 13)] + ["DEC1", "OCT4", "MEI31", "JUN2", "TAMM41"]
    back = S.reverse_date(F.col("m.d"), F.when(F.year("m.d") == 2024, "d-mmm"))
    df = spark.createDataFrame([(s,) for s in symbols], "s string").select("s", S.simulate(F.col("s")).alias("m"))
    assert df.where(F.array_contains(back, F.col("s"))).count() == len(symbols)
    got = one(spark, "s string", [("BRCA1",), ("2310009E13",), ("SEPT16",)], S.simulate(F.col("s"))["x"], S.simulate(F.col("s"))["d"])
    assert got == [(None, None), (2.310009e19, None), (None, None)]


def test_families_and_bands(spark):
    got = one(spark, "s string", [("SEPTIN2",), ("SEPT2",), ("SEP15",), ("MARCHF1",), ("MARC2",), ("DECOR",), ("POU2F1",)], S.family(F.col("s")))
    assert [g[0] for g in got] == ["SEPTIN", "SEPT", "SEP", "MARCHF", "MARC", "OTHER", "POU2F"]
    got = one(spark, "x double", [(0.85,), (0.5,), (0.3,), (0.1,)], S.band(F.col("x")))
    assert [g[0] for g in got] == ["High", "Medium", "Low", "Info"]
