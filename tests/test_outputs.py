import io
import json
import zipfile

from gridmend import cli
from gridmend.operators import corrections as K
from gridmend.operators import outputs as U
from gridmend.operators import schema as H
from gridmend.plans.detect import detect
from gridmend.streaming.inbox import watch_cells


def test_bundle(spark, cells):
    t = cells({"f": {"gene": ["BRCA1", "TP53", "01:03", "EGFR", "MYC"], "n": [1, 2, 3, 4, 5]}})
    got = detect(t)
    log = K.audit_log(K.propose(got.suspicions), t)
    data = U.bundle(K.apply(t, log), log, H.table_schemas(H.fields(got.enriched, got.profile)), "f")
    z = zipfile.ZipFile(io.BytesIO(data))
    assert set(z.namelist()) == {"S.cleaned.csv", "S.schema.json", "audit.json", "report.csv"}
    assert "1:03,3" in z.read("S.cleaned.csv").decode()
    assert [x["kind"] for x in json.loads(z.read("audit.json"))["changes"]] == ["time-coercion"]


def test_stream(spark, cells, tmp_path):
    cells({"f": {"gene": ["BRCA1", "TP53", "01:03"]}}).write.parquet(str(tmp_path / "in" / "a"))
    q = watch_cells(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["R-TIME-STR"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("gene,n\nBRCA1,1\nTP53,2\n01:03,3\n")
    assert cli.main(["detect", str(tmp_path), "--json"]) == 2
    assert json.loads(capsys.readouterr().out)["suggestion"] == "1:03"
    assert cli.main(["schema", str(tmp_path)]) == 0
    assert '"name":"gene"' in capsys.readouterr().out
    assert cli.main(["audit", str(tmp_path)]) == 2
    assert json.loads(capsys.readouterr().out)["files"][0]["medium"] == 1
