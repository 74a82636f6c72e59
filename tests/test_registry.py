from gridmend.operators import registry as G


def test_date_prone_names_have_no_snapshot_row(spark):
    schema = "symbol string, status string, prev_symbol string, alias_symbol string, row long"
    rows = [("SEPTIN2", "Approved", "SEPT2|NEDD5", None, 7), ("MARCHF1", "Approved", "MARCH1", None, 8), ("TP53", "Approved", "P53", None, 9)]
    got = G.date_prone(G.build(spark.createDataFrame(rows, schema)))
    assert got.columns == ["old", "symbol"]
    assert sorted(map(tuple, got.collect())) == [("MARCH1", "MARCHF1"), ("SEPT2", "SEPTIN2")]
