from datetime import date as d

import pytest

from gridmend.operators import corrections as K
from gridmend.operators import schema as H
from gridmend.operators.registry import Registry, seed
from gridmend.operators.xref import adjudicate
from gridmend.plans.detect import detect

#: One file for each golden table; all are scanned by one plan.
FILES = {
    "named": {"symbol": ["BRCA1", "TP53", d(2024, 9, 2), d(2024, 3, 1), "MARCHF1"]},
    "other": {"patient_age": [31, 42, 53, 64, 75], "diagnosis_date": [d(2024, 9, i) for i in range(1, 6)]},
    "header_only": {"gene": [d(2024, 9, 2)]},
    "lone": {"symbol": ["BRCA1", "TP53", "EGFR", d(2024, 9, 2), "MYC", "ATM", "PTEN"]},
    "format": {"symbol": ["BRCA1", "TP53", d(2007, 9, 1), "EGFR", "MYC"]},
    "serial": {"symbol": ["BRCA1", "TP53", 41334, "EGFR", "MYC", d(2024, 9, 2)]},
    "blind": {"Unnamed_1": [39880, "x", "y", "z", "w"], "misc_col": ["x", "y", "41519", "z", "w"], "col_a": ["foo", "2-Oct", "bar", None, None]},
    "quiet": {"some_col": [8615, 9000, 10000, 11000, 12000]},
    "auto": {"symbol": ["BRCA1", "TP53", "EGFR", "MYC", "ATM", *[d(2024, 9, i) for i in range(2, 7)], "PTEN", "KRAS", "NRAS", "ALK", "APC"]},
    "auto2": {"symbol": ["BRCA1", "TP53", "EGFR", "MYC", "ATM", d(2024, 9, 1), d(2024, 9, 3), d(2024, 9, 5)]},
    "times": {"gene": ["BRCA1", "TP53", "EGFR", "01:03", "11:30", (1, 3)]},
    "cas": {"CAS_Number": ["foo", "50-78-2", "bar"], "remark": ["foo", "50-78-2", "bar"]},
    "commas": {"value": ["1,5", "2,7", "0,8", "3,14", "1,2", "4,0"], "mixed": ["1,5", "2.7", "0.8", "3,14", "1.2", None]},
    "comma_cell": {"value": ["1.5"] * 9 + ["3,14"]},
    "zeros": {"acc": ["00012345", "00012346", "00012347", 12345, 23456]},
    "few_zeros": {"acc": ["00012345", "00012346", "x", 12345, 23456]},
    "riken": {"gene_id": [1.5e8, 9.876543e11, 1e8, 1.234567e10, 2.310009e13]},
    "hinted": {"RIKEN_cdna_id": [2.310009e7, 1.234567e8, 9.876543e9, 100506334.0]},
    "entrez": {"geneId": [100506334.0, 100506335.0, 100506336.0, 100506337.0]},
    "long": {"accession": ["NM_000546", "NM_000547", "NM_000548", "NM_000549", 12345678901234567890, 98765432109876543210]},
    "clean": {"symbol": ["SEPTIN1", "MARCHF1", "DELEC1", "BRCA1", "TP53"]},
    "unrec": {"symbol": ["BRCA1", "TP53", "EGFR", "MYC", "ATM", "PTEN", "KRAS", "NRAS", "ALK", "APC", "XYZZY9"]},
    "oct34": {"marker": ["Oct-3/4", "stem", "note"]},
}


@pytest.fixture(scope="module")
def found(cells, spark):
    got = detect(cells(FILES, {("format", "symbol", 2): "mmm-yy"})).suspicions.collect()
    out = {}
    for r in got:
        out.setdefault(r.file_id, []).append((r.col, r.row_id, r.rule_id, r.suggestion, r.confidence))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_dates(found):
    assert [x[1:] for x in found["named"]] == [(2, "R-DATE", "SEPTIN2 | SEPT2 | SEP2", 0.60), (3, "R-DATE", "MARCHF1 | MTARC1 | MARCH1 | MARC1", 0.50)]
    assert len(found["header_only"]) == 1
    assert found["lone"][0][4] == 0.30
    assert found["format"][0][3] == "SEPTIN7 | SEPT7 | SEP7"


def test_clean_tables(found):
    for name in ("other", "quiet", "clean", "entrez"):
        assert name not in found


def test_serials(found):
    assert [(x[1], x[2], x[4]) for x in found["serial"] if x[1] == 2] == [(2, "R-SER-NUM", 0.85)]
    rules = {(c, r): (rule, conf) for c, r, rule, _, conf in found["blind"]}
    assert rules == {("Unnamed_1", 0): ("R-SNUM", 0.30), ("misc_col", 2): ("R-SSTR", 0.30), ("col_a", 1): ("R-DSTR", 0.55)}


def test_autofill(found):
    runs = [x for x in found["auto"] if x[2] == "R-AUTO"]
    assert runs == [("symbol", 5, "R-AUTO", None, 0.90)]
    assert not [x for x in found["auto2"] if x[2] == "R-AUTO"]


def test_times_cas_commas(found):
    assert [(x[1], x[2], x[3]) for x in found["times"]] == [(3, "R-TIME-STR", "1:03"), (4, "R-TIME-STR", "11:30"), (5, "R-TIME-OBJ", "1:3")]
    assert {x[0]: x[4] for x in found["cas"]} == {"CAS_Number": 0.20, "remark": 0.70}
    assert [(x[0], x[2], x[4]) for x in found["commas"]] == [("value", "R-DC-COL", 0.55)]
    assert [(x[1], x[2]) for x in found["comma_cell"]] == [(9, "R-DC-CELL")]


def test_identifiers(found):
    assert [(x[1], x[3], x[4]) for x in found["zeros"]] == [(3, "00012345", 0.85), (4, "00023456", 0.85)]
    assert not [x for x in found.get("few_zeros", []) if x[2] == "R-LZ"]
    assert [(x[1], x[4]) for x in found["riken"]] == [(1, 0.95), (3, 0.95), (4, 0.95)]
    assert [x[4] for x in found["hinted"]] == [0.85, 0.85, 0.85, 0.55]
    assert [x[2] for x in found["long"]] == ["R-LONG", "R-LONG"]
    assert [(x[1], x[2], x[4]) for x in found["unrec"]] == [(10, "R-UNREC", 0.20)]
    assert found["oct34"][0][3] == "POU5F1 | OCT4 | OCT3"


def test_xref_corrections_and_schema(spark, cells):
    t = cells({"x": {"symbol": ["BRCA1", "TP53", d(2024, 9, 2), "EGFR", d(2024, 9, 3)], "refseq": ["NM_007294", "NM_000546", "NM_001008491", "NM_005228", "NM_005228"]}})
    s = seed(spark)
    ids = spark.createDataFrame([("refseq", "NM_001008491", "SEPTIN2"), ("refseq", "NM_005228", "EGFR")], "space string, id string, symbol string")
    reg = Registry(s.current, s.prev, s.alias, s.xspecies, ids)
    got = detect(t, reg)
    flags = got.suspicions.persist()
    judged = {r.row_id: (r.xref_status, round(r.confidence, 2)) for r in adjudicate(flags, t, reg).collect()}
    assert judged == {2: ("corroborated", 0.99), 4: ("contradicted", 0.20)}
    log = K.audit_log(K.propose(flags), t)
    fixed = {(r.col, r.row_id): (r.vtype, r.v_str) for r in K.apply(t, log).collect()}
    assert fixed["symbol", 2] == ("str", "SEPTIN2") and fixed["symbol", 0] == ("str", "BRCA1")
    rows = H.fields(got.enriched, got.profile)
    assert {r.col: (r.registry, r.type) for r in rows.collect()}["symbol"] == ("HGNC", "string")
    assert {(r.col, r.row_id) for r in H.violations(t, rows.where("col = 'symbol'")).collect()} == {("symbol", 2), ("symbol", 4)}
    assert '"name":"symbol"' in H.table_schemas(rows).first().schema
