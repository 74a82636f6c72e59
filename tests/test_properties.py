"""Properties of scalar expressions, each over one batch of generated values."""

from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmend.functions import scalars as S
from gridmend.functions.fixed import AUTOFILL_BANDS
from gridmend.operators.sequence import runs

FEW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(st.lists(st.dates(date(1900, 1, 1), date(2100, 12, 31)), min_size=50, max_size=80))
def test_symbols_of_dates(spark, days):
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    for d, found, canon, again in rows.select("d", S.reverse_date(F.col("d"), F.lit("d-mmm")).alias("f")).select("d", "f", S.canonical(F.col("f")), S.canonical(S.canonical(F.col("f")))).collect():
        assert len(set(found)) == len(found) and set(found) <= set(canon) and again == canon
        for s in found:
            number = int("".join(c for c in s if c.isdigit()))
            assert number == (32 - d.day if s.startswith("JUN") else d.day)


@FEW
@given(st.lists(st.integers(20000, 60000), min_size=50, max_size=80))
def test_serials_round_trip(spark, serials):
    for n, d in spark.createDataFrame([(n,) for n in serials], "n int").select("n", S.serial_to_date(F.col("n"))).collect():
        assert d - date(1899, 12, 30) == timedelta(days=n)


@FEW
@given(st.lists(st.dates(date(2000, 1, 1), date(2059, 12, 31)), min_size=40, max_size=60))
def test_rendered_dates_parse(spark, days):
    rows = spark.createDataFrame([(d, form) for d in days for form in (d.isoformat(), f"{d:%d-%b-%Y}", f"{d:%b.%d.%y}", f"{d:%d/%m/%Y}", f"{d:%B} {d.day}, {d.year}")], "d date, t string")
    assert rows.where(~F.array_contains(S.parse_dates(F.col("t")), F.col("d"))).count() == 0


def fold(cells):
    """Runs by a plain loop."""
    out, run, band = [], [], None
    for r, d in cells:
        if run:
            gap, days = r - run[-1][0], (d - run[-1][1]).days
            k = next((i for i, (lo, hi) in enumerate(AUTOFILL_BANDS) if lo <= days <= hi), None)
            if 1 <= gap <= 2 and k is not None and band in (None, k):
                run.append((r, d))
                band = k
                continue
            if len(run) >= 3:
                out.append((run[0][0], len(run)))
        run, band = [(r, d)], None
    return out + ([(run[0][0], len(run))] if len(run) >= 3 else [])


@FEW
@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.sampled_from([1, 1, 1, 7, 7, 30, 366, 2])), max_size=12), min_size=20, max_size=30))
def test_runs_against_a_loop(spark, tables):
    rows, want = [], set()
    for g, steps in enumerate(tables):
        r, d, cells = 0, date(2020, 1, 1), [(0, date(2020, 1, 1))]
        for gap, days in steps:
            r, d = r + gap, d + timedelta(days=days)
            cells.append((r, d))
        rows += [(g, r, d) for r, d in cells]
        want |= {(g, *x) for x in fold(cells)}
    got = {tuple(x) for x in runs(spark.createDataFrame(rows, "g int, row_id long, d date"), ["g"]).collect()}
    assert got == want
