"""Queries over the driver's tables, one for each operator or family of operators, on values derived from keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.functions import scalars as S
from gridmend.operators import cells as C
from gridmend.operators import corrections as K
from gridmend.operators import outputs as U
from gridmend.operators import profile as P
from gridmend.operators import registry as G
from gridmend.operators import rules as R
from gridmend.operators import schema as H
from gridmend.operators import sequence as Q
from gridmend.operators import walk as W
from gridmend.operators import xref as V
from gridmend.plans import golden
from gridmend.plans.detect import audit_summary, detect, exit_code, too_large
from gridmend.sources.readers import sniff_column

TABLES = {"customer": "c_custkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))


def text(c: Column) -> Column:
    return F.array_join(c, "|")


def formats() -> Column:
    return F.when(F.col("o_orderkey") % 3 == 1, "mmm-yy").when(F.col("o_orderkey") % 3 == 2, "d-mmm")


def serial_to_date(spark, d):
    n = F.lit(19990) + F.col("o_orderkey") % 40020
    return orders(spark, d).select("o_orderkey", n.cast("long").alias("n"), S.serial_to_date(n).cast("string").alias("decoded"))


def reverse_date(spark, d):
    return orders(spark, d).select("o_orderkey", text(S.reverse_date(F.col("d"), formats())).alias("symbols"))


def canonicalize(spark, d):
    found = orders(spark, d).withColumn("found", S.reverse_date(F.col("d"), formats()))
    return found.select("o_orderkey", text(S.canonical(F.col("found"))).alias("symbols"), S.has_one_modern(F.col("found")).alias("one_modern"))


def gene_date_by_family(spark, d):
    found = orders(spark, d).withColumn("s", S.canonical(S.reverse_date(F.col("d"), formats()))).where("size(s) > 0")
    return found.select(S.family(F.col("s")[0]).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


def date_text() -> Column:
    d, k = F.col("d"), F.col("o_orderkey") % 8
    f = lambda p: F.date_format(d, p)
    return (
        F.when(k == 0, f("yyyy-MM-dd"))
        .when(k == 1, f("d-MMM"))
        .when(k == 2, f("MMM-dd-yy"))
        .when(k == 3, f("dd/MM/yy"))
        .when(k == 4, f("MMMM d, yyyy"))
        .when(k == 5, f("d.MMM.yyyy"))
        .when(k == 6, F.concat(F.lit("OCT4,"), f("d-MMM")))
        .otherwise(f("d MMMM yyyy"))
    )


def parse_date_text(spark, d):
    rows = orders(spark, d).withColumn("t", date_text())
    dates = F.transform(S.parse_dates(F.col("t")), lambda x: x.cast("string"))
    return rows.select("o_orderkey", "t", text(dates).alias("dates"))


def parse_cell_dates(spark, d):
    rows = orders(spark, d).withColumn("t", date_text())
    return rows.select("o_orderkey", text(F.transform(S.parse_cell_dates(F.col("t")), lambda x: x.cast("string"))).alias("dates"))


def simulate_roundtrip(spark, d):
    k = F.col("c_custkey")
    prefixes = F.array(*[F.lit(p) for p in ("SEPT", "MARCH", "DEC", "OCT", "JUN", "TAMM", "BRCA")])
    symbol = F.concat(F.get(prefixes, (k % 7).cast("int")), (k % 53).cast("string"))
    rows = table(spark, d, "customer").select("c_custkey", symbol.alias("symbol")).withColumn("made", S.simulate(F.col("symbol")))
    back = S.reverse_date(F.col("made.d"), F.when(F.year("made.d") == 2024, "d-mmm"))
    return rows.select("c_custkey", "symbol", F.col("made.d").cast("string").alias("made"), F.coalesce(F.array_contains(back, F.col("symbol")), F.lit(False)).alias("round_trip"))


def riken_signature(spark, d):
    k = F.col("l_orderkey")
    powers = F.array(*[F.lit(float(f"1e{i}")) for i in (0, 1, 6, 13, 20, 25)])
    x = (F.lit(1000000) + k * 7919 % 9000000).cast("double") * F.get(powers, (k % 6).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", x.alias("x")).distinct()
    return rows.select("l_orderkey", S.riken_signature(F.col("x")).alias("signature"), (F.abs("x") >= 2.0**53).alias("beyond_exact"))


def leading_zeros(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.right("c_name", F.lit(9)).alias("s"))
    cut = F.when(F.col("row_id") % 7 == 0, F.col("s").cast("bigint").cast("string")).otherwise(F.col("s"))
    sheet = C.from_table(rows.select("row_id", cut.alias("account_id")), "row_id", skip=("row_id",))
    found = detect(sheet).suspicions.where("rule_id = 'R-LZ'")
    return found.select("row_id", "value_repr", "suggestion", "confidence")


def time_texts(spark, d):
    t = F.date_format("ts", "HH:mm")
    odd = F.when(F.col("event_id") % 5 == 0, F.concat(t, F.lit(":71"))).otherwise(t)
    rows = table(spark, d, "events").select("event_id", odd.alias("t"))
    return rows.select("event_id", "t", S.time_text(F.col("t")).alias("h_mm"))


def cas_and_aliases(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 3 == 0, F.concat_ws("-", k + 10, k % 100, k % 10)).when(k % 3 == 1, F.get(F.array(*[F.lit(x) for x in ("Oct-3/4", "3/4-Oct", "OCT34", "oct3/4", "Oct-4")]), (k % 5).cast("int"))).otherwise(F.concat_ws("-", k, k))
    rows = orders(spark, d).select("o_orderkey", t.alias("t"))
    return rows.select("o_orderkey", F.col("t").rlike(X.CAS).alias("cas"), F.col("t").rlike(f"(?i){X.OCT34}").alias("oct34"))


def decimal_commas(spark, d):
    k = F.col("c_custkey")
    one = F.format_string("%.2f", "c_acctbal")
    all_ = F.translate(one, ".", ",")
    few = F.when(k % 50 == 0, all_).otherwise(one)
    rows = table(spark, d, "customer").select(k.alias("row_id"), few.alias("sparse"), all_.alias("throughout"))
    found = detect(C.from_table(rows, "row_id", skip=("row_id",))).suspicions.where("kind = 'decimal-comma'")
    return found.select("col", "row_id", "rule_id", "value_repr", "confidence")


def homoglyphs(spark, d):
    t = F.when(F.col("p_partkey") % 5 == 0, F.translate(F.upper("p_brand"), "ABR", "АΒꓣ")).otherwise(F.upper("p_brand"))
    clean = F.regexp_replace(t, "#", "")
    rows = table(spark, d, "part").select("p_partkey", clean.alias("t"))
    return rows.select("p_partkey", S.repair_homoglyphs(F.col("t")).alias("repaired"), S.gene_after_repair(F.col("t")).alias("symbol"), F.size(S.homoglyph_list(F.col("t"))).cast("long").alias("n"))


def id_text() -> Column:
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    pad = F.lpad(s, 11, "0")
    return F.get(
        F.array(
            F.concat(F.lit("ENSG"), pad), F.concat(F.lit("NM_"), s, F.lit(".2")), F.concat(F.lit("P"), F.lpad((k % 100000).cast("string"), 5, "0")), F.concat(F.lit("HGNC:"), s),
            F.concat(F.lit("MGI:"), s), F.concat(F.lit("FBgn"), pad), s, F.concat(F.lit("GENE"), (k % 100).cast("string")), F.lit(" N/A "), F.concat((k % 1000).cast("string"), F.lit(".5e3")),
            F.concat(F.lpad((k % 10000000).cast("string"), 7, "0"), F.lit("E13")), F.concat(F.lit("free text "), s), F.lit("0.0"), F.lit("  "),
        ), (k % 14).cast("int")
    )


def value_kinds(spark, d):
    rows = orders(spark, d).withColumn("t", id_text())
    return rows.select("o_orderkey", S.text_kind(F.col("t")).alias("kind"), S.external_id_kind(F.col("t")).alias("external"))


HEADERS = [
    "l_discount", "o_orderdate", "l_shipdate", "p_name", "c_name", "c_mktsegment", "ENTREZID", "genesymbol", "sampleid", "kid", "Gene Name", "fold_change", "gene_id", "timestamp",
    "A caption that goes on for more than eighty characters about a protein list, Supplemental Table S2", "lipid", "age", "n_value",
]


def header_hints(spark, d):
    rows = spark.createDataFrame([(h,) for h in HEADERS], "header string")
    tokens = S.header_tokens(F.col("header"))
    return rows.select("header", text(tokens).alias("tokens"), S.has_hint(tokens, X.IDENTIFIER_HINTS).alias("identifier"), S.has_hint(tokens, X.NON_IDENTIFIER_HINTS).alias("other"))


def base_cells(spark, d) -> tuple[DataFrame, DataFrame]:
    """The cells and columns of six tables, each one sheet of one file."""
    cells, cols = None, None
    for name, key in TABLES.items():
        df = table(spark, d, name)
        a, b = C.from_table(df, key, "tables", name), C.columns_of(df, "tables", name)
        cells, cols = (a, b) if cells is None else (cells.unionByName(a), cols.unionByName(b))
    return cells, cols


def classify_columns(spark, d):
    cells, cols = base_cells(spark, d)
    got = P.classify(P.enrich(cells, G.seed(spark).lookup()), cols)
    return got.select("sheet", "col", "column_type", F.round("type_confidence", 6).alias("confidence"), "n_samples")


def column_verdicts(spark, d):
    cells, cols = base_cells(spark, d)
    got = P.profile_columns(P.enrich(cells, G.seed(spark).lookup()), cols)
    return got.select("sheet", "col", "is_id", "promoted", "measured", "legit_dates", "blind")


def column_counts(spark, d):
    cells, _ = base_cells(spark, d)
    got = P.evidence(P.enrich(cells, G.seed(spark).lookup()))
    return got.select("sheet", "col", "n", "n_text", "n_num", "n_gene_like", "n_period", "n_comma", "n_lz", "first_row")


def gene_sheet(spark, d) -> DataFrame:
    """Cells of a synthetic sheet by order: symbols with dates among them, accessions, a measurement, a note."""
    k = F.col("o_orderkey")
    o = orders(spark, d)
    row = o.select(
        k.alias("row_id"), F.concat(F.lit("SEPTIN"), (k % 15 + 1).cast("string")).alias("sym"), F.col("d"), (k % 11 == 0).alias("is_date"), F.concat(F.lit("ENSG"), F.lpad((k % 40).cast("string"), 11, "0")).alias("acc"),
        (k * 3 % 1000).cast("double").alias("reads"), F.when(k % 97 == 0, "2-Oct").otherwise(F.lit("note")).alias("note"),
    )
    symbols = C.from_table(row.where("not is_date").select("row_id", F.col("sym").alias("symbol")), "row_id", skip=("row_id",))
    dates = C.from_table(row.where("is_date").select("row_id", F.col("d").alias("symbol")), "row_id", skip=("row_id",))
    rest = C.from_table(row.select("row_id", F.lit(None).cast("string").alias("symbol"), "acc", "reads", "note"), "row_id", skip=("row_id",))
    return symbols.unionByName(dates).unionByName(rest)


def detect_sheet(spark, d):
    found = detect(gene_sheet(spark, d)).suspicions
    return found.select("col", "row_id", "rule_id", "kind", "suggestion", "confidence")


def detect_tables(spark, d):
    cells, cols = base_cells(spark, d)
    found = detect(cells, columns=cols).suspicions
    return found.groupBy("sheet", "col", "rule_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def autofill_runs(spark, d):
    k = F.col("o_orderkey")
    step = F.get(F.array(*[F.lit(x) for x in (1, 7, 7, 30, 365, 1, 1, 12)]), (F.floor(k / 13) % 8).cast("int"))
    rows = orders(spark, d).select(F.floor(k / 13).alias("grp"), (k % 13).alias("row_id"), F.date_add(F.lit("2010-01-01").cast("date"), ((k % 13) * step + F.when(k % 13 > 6, k % 3).otherwise(0)).cast("int")).alias("d"))
    return Q.runs(rows, ["grp"])


def part_registry(spark, d) -> G.Registry:
    k = F.col("p_partkey")
    s = lambda p, e: F.concat(F.lit(p), e.cast("string"))
    rows = table(spark, d, "part").select(
        k.alias("row"), s("GEN", k).alias("symbol"), F.when(k % 17 == 0, "Withdrawn").otherwise("Approved").alias("status"), F.concat_ws("|", s("OLD", k % 300), s("GEN", k + 1)).alias("prev_symbol"),
        F.concat_ws("| ", s("ALI", k % 200), s("OLD", k % 400), s("ali", k % 150)).alias("alias_symbol"), s("HGNC:", k).alias("hgnc_id"), s("", k + 1000).alias("entrez_id"),
        F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0"), F.lit(".3")).alias("ensembl_gene_id"), s("NM_", k % 900).alias("refseq_accession"),
    )
    return G.build(rows)


def registry_build(spark, d):
    r = part_registry(spark, d)
    prev = r.prev.select(F.lit("prev").alias("part"), "old", "symbol")
    return prev.unionByName(r.alias.select(F.lit("alias").alias("part"), "old", "symbol"))


def registry_resolve(spark, d):
    k = F.col("o_orderkey")
    ask = F.concat(F.get(F.array(*[F.lit(x) for x in ("GEN", "gen", "OLD", "Ali", "ALI", "none")]), (k % 6).cast("int")), (k % 350).cast("string"))
    rows = orders(spark, d).select(ask.alias("ask")).distinct()
    return part_registry(spark, d).resolve(rows, "ask").select("ask", "resolved")


def registry_equivalents(spark, d):
    r = part_registry(spark, d)
    asked = r.current.unionByName(r.prev.select(F.col("old").alias("symbol")))
    return r.equivalents(asked)


def xref_lookup(spark, d):
    k = F.col("l_partkey")
    ids = F.get(F.array(F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0"), F.lit(".7")), F.concat(F.lit("HGNC:"), k.cast("string")), (k + 1000).cast("string"), F.concat(F.lit("NM_"), (k % 900).cast("string"), F.lit(".1"))), (F.col("l_suppkey") % 4).cast("int"))
    rows = table(spark, d, "lineitem").select(ids.alias("id")).distinct()
    return G.lookup_ids(rows, "id", part_registry(spark, d)).select("id", "gene")


def xref_adjudicate(spark, d):
    k = F.col("o_orderkey")
    base = orders(spark, d).select(k.alias("row_id"), F.concat(F.lit("GEN"), (k % 60 + 1).cast("string")).alias("cand"), F.when(k % 4 != 3, F.concat(F.lit("HGNC:"), F.when(k % 4 == 0, k % 60 + 1).otherwise(k % 50 + 1).cast("string"))).alias("hgnc"))
    cells = C.from_table(base.select("row_id", "cand", "hgnc"), "row_id", skip=("row_id",))
    null, k_ = F.lit(None).cast("string"), F.col("row_id")
    susp = base.select(
        F.lit("table").alias("file_id"), F.lit(0).alias("sheet_ord"), F.lit("_sheet0").alias("sheet"), F.lit(0).alias("col_ord"), F.lit("cand").alias("col"), "row_id", F.lit("R-DATE").alias("rule_id"), F.lit("gene-date").alias("kind"),
        F.col("cand").alias("value_repr"), F.when(k_ % 10 != 9, F.col("cand")).alias("suggestion"), F.array("cand").alias("candidates"), (F.lit(0.15) + (k_ % 5) * 0.2).alias("confidence"), F.lit("R-DATE").alias("reason_code"),
        F.create_map(F.lit("a"), F.lit("b")).alias("reason_args"), null.alias("xref_status"),
    )
    got = V.adjudicate(susp, cells, part_registry(spark, d))
    return got.select("row_id", "xref_status", F.round("confidence", 6).alias("confidence"))



def suspicions(spark, d) -> DataFrame:
    """Suspicions made from orders by arithmetic, for the operators on reports."""
    k = F.col("o_orderkey")
    n = F.size(S.canonical(S.reverse_date(F.col("d"), F.lit("d-mmm"))))
    found = orders(spark, d).withColumn("candidates", S.canonical(S.reverse_date(F.col("d"), F.lit("d-mmm"))))
    kinds = F.array(*[F.lit(x) for x in X.KINDS[:12]])
    return found.where(n > 0).select(
        F.concat(F.lit("file"), (k % 23).cast("string"), F.lit("_x.csv")).alias("file_id"), F.lit(0).alias("sheet_ord"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("sheet"), (k % 7).cast("int").alias("col_ord"),
        F.concat(F.lit("c"), (k % 7).cast("string")).alias("col"), k.alias("row_id"), F.concat(F.lit("R"), (k % 4).cast("string")).alias("rule_id"), F.get(kinds, (k % 12).cast("int")).alias("kind"), F.col("d").cast("string").alias("value_repr"),
        text(F.col("candidates")).alias("suggestion"), "candidates", (F.col("o_orderkey") % 20 / 20).alias("confidence"), F.lit("R").alias("reason_code"), F.create_map(F.lit("a"), F.lit("b")).alias("reason_args"), F.lit(None).cast("string").alias("xref_status"),
    )


def bands(spark, d):
    b = suspicions(spark, d).withColumns({"band": S.band(F.col("confidence")), "bucket": S.bucket(F.col("confidence"))})
    return b.groupBy("band", "bucket").agg(F.count("*").alias("n"))


def exit_codes(spark, d):
    return exit_code(suspicions(spark, d))


def audit(spark, d):
    files = spark.createDataFrame([(f"file{i}_x.csv",) for i in range(25)], "file_id string")
    got = audit_summary(suspicions(spark, d), files)
    return got.withColumn("kinds", text(F.col("kinds")))


def analytics(spark, d):
    return K.analytics(K.propose(suspicions(spark, d)))


def capped(spark, d):
    got = K.capped_report(suspicions(spark, d), 3)
    return got.select("file_id", "band", "n", "row_id")


def proposals(spark, d):
    got = K.render(K.propose(suspicions(spark, d)))
    return got.select("sheet", "column", "row", "accept", "original", "proposed", "alt_candidates", "kind")


def audit_log(spark, d):
    s = suspicions(spark, d).where("file_id = 'file3_x.csv'")
    cells = C.from_table(orders(spark, d).select(F.col("o_orderkey").alias("row_id"), F.col("d").alias("c0"), F.col("o_custkey").alias("c1")), "row_id", "file3_x.csv", "S0", skip=("row_id",))
    log = K.audit_log(K.propose(s), cells)
    return log.select("sheet", "col", "row_id", "applied", "skip_reason", "proposed_value")


def apply_corrections(spark, d):
    s = suspicions(spark, d).where("file_id = 'file3_x.csv'")
    cells = C.from_table(orders(spark, d).select(F.col("o_orderkey").alias("row_id"), F.col("d").alias("c0"), F.col("o_custkey").alias("c1")), "row_id", "file3_x.csv", "S0", skip=("row_id",))
    done = K.apply(cells, K.audit_log(K.propose(s), cells))
    return done.withColumn("value", C.value_text()).select("col", "row_id", "vtype", "value")


def schema_fields(spark, d):
    cells, cols = base_cells(spark, d)
    rich = P.enrich(cells, G.seed(spark).lookup())
    got = H.fields(rich, P.profile_columns(rich, cols))
    return got.select("sheet", "col", "registry", "type", "pattern")


def prefilter(spark, d):
    docs = table(spark, d, "documents")
    word = F.element_at(F.split("text", r"\s+"), 1)
    seeded = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("SEPT"), (F.floor(F.col("doc_id") / 4) % 20).cast("string"))).otherwise(word)
    files = docs.select((F.col("doc_id") % 100).alias("row_id"), seeded.alias("v_str"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 100).cast("string")).alias("file_id"))
    cells = files.select("file_id", F.lit(0).alias("sheet_ord"), F.lit("s").alias("sheet"), F.lit(0).alias("col_ord"), F.lit("w").alias("col"), "row_id", F.lit("str").alias("vtype"), "v_str")
    known = G.seed(spark).lookup()
    low = cells.withColumn("low", F.lower("v_str")).join(known, "low", "left")
    rich = low.withColumns({"s": F.col("v_str"), "is_known": F.coalesce(F.array_contains("known", F.col("v_str")), F.lit(False))})
    return P.has_gene_symbols(rich)


def recall(spark, d):
    k = F.col("o_orderkey")
    s = suspicions(spark, d)
    note = F.when(k % 5 == 0, F.lit("nothing")).when(k % 5 == 1, F.lit("SEPT2, 1-Mar")).when(k % 5 == 2, F.lit("DEC1")).otherwise(F.lit("MARCH9;OCT4"))
    expected = orders(spark, d).select(F.concat(F.lit("file"), (k % 29).cast("string"), F.lit("_x.csv")).alias("file_id"), k.alias("note_id"), W.note_symbols(note).alias("symbols"))
    got = W.score_recall(expected, s)
    return got.select("note_id", text(F.col("symbols")).alias("symbols"), "outcome")


def precision_intervals(spark, d):
    s = table(spark, d, "labels").select((F.col("quality") == 1).alias("correct"), F.col("toxic").cast("string").alias("kind"))
    got = W.precision_by(s, ["kind"])
    return got.select("kind", "n", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "lo", "hi")])


def corpus_summary(spark, d):
    files = spark.createDataFrame([(f"file{i}_x.csv",) for i in range(40)], "file_id string")
    return W.corpus_summary(files, files.where("length(file_id) = 11"), suspicions(spark, d))


def html_sniff(spark, d):
    p = table(spark, d, "pages")
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<table><tr><td>"), "url", F.lit("</td></tr></table>"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("\t1"))).otherwise(F.col("html"))
    return p.select("page_id", sniff_column(content).alias("format"))


def merged_fill(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("row_id"), F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).alias("a"), F.when(F.col("n_nationkey") % 5 == 0, F.col("n_regionkey").cast("string")).alias("b"))
    cells = C.from_table(n, "row_id", skip=("row_id",))
    starts = table(spark, d, "nation").where("n_nationkey % 5 = 0")
    ranges = starts.select(F.lit("table").alias("file_id"), F.lit(0).alias("sheet_ord"), F.lit("_sheet0").alias("sheet"), F.col("n_nationkey").alias("r0"), F.lit(0).alias("c0"), (F.col("n_nationkey") + 3).alias("r1"), F.lit(1).alias("c1"))
    got = C.fill_merged(cells, ranges)
    return got.select("row_id", "col", "v_str")


def stratified_sample(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice"))
    # one sheet of as many rows as the highest order; head and tail are taken whole, so both show in the counts
    last = o.agg(F.max("row_id")).first()[0] + 1
    got = C.sample_rows(C.from_table(o, "row_id", skip=("row_id",)), last, head=100, above=1000)
    return got.where((F.col("row_id") < 100) | (F.col("row_id") >= last - 100)).select("row_id", "v_num")


def rule_sheets(spark, d):
    found = detect(golden.cells(spark, table(spark, d, "nation"))).suspicions
    return found.groupBy("sheet", "col", "row_id", "rule_id", "kind", "suggestion", "confidence").agg(F.count("*").alias("n"))


def walk_files(spark, d):
    k = F.col("o_orderkey")
    acc = F.concat(F.lit("PMC"), (k % 50).cast("string"))
    notes = orders(spark, d).select(k.alias("note_id"), acc.alias("accession"), F.when(k % 4 > 0, F.concat(F.lit("http://x/y/t"), (k % 30).cast("string"), F.lit(".xlsx"))).alias("url"))
    files = orders(spark, d).select((k % 50).alias("a"), (k % 7).alias("b")).distinct()
    ends = F.when(F.col("b") == 3, ".csv").otherwise(".xlsx")
    files = files.select(F.concat(F.lit("cache/PMC"), F.col("a").cast("string"), F.lit("_t"), F.col("b").cast("string"), ends).alias("file_id"))
    got = W.annotated_files(notes, files)
    return got.select("note_id", "file_id")


def large_files(spark, d):
    files = orders(spark, d).select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") * 10_007).alias("length"))
    return too_large(files, 100_000_000).select("file_id", "rule_id", "kind", "value_repr", "confidence")


def column_names(spark, d):
    name = F.concat(F.when(F.col("p_partkey") % 3 > 0, "Sheet1!").otherwise(""), F.when(F.col("p_partkey") % 3 > 1, "x!").otherwise(""), "p_name")
    return table(spark, d, "part").select("p_partkey", H.bare_column(name).alias("name"))


def snapshot_ages(spark, d):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("data/set_"), F.col("d").cast("string"), F.when(k % 9 == 0, F.lit("")).otherwise(F.lit(".tsv")))
    rows = orders(spark, d).select("o_orderkey", F.when(k % 10 == 0, F.lit("data/set.tsv")).otherwise(path).alias("p"))
    age = G.snapshot_age(F.col("p"), F.lit("2001-09-01").cast("date"))
    return rows.select("o_orderkey", age.alias("age"), G.drift_note(age).alias("note"))


def date_prone(spark, d):
    return G.date_prone(G.seed(spark))


def cells_of_tables(spark, d):
    cells, _ = base_cells(spark, d)
    return cells.groupBy("sheet", "col_ord", "col", "vtype").agg(F.count("*").alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))


def reports(spark, d):
    cells, cols = base_cells(spark, d)
    got = detect(cells, columns=cols).report()
    return got.withColumn("identifier_columns", text(F.col("identifier_columns")))


def json_reports(spark, d):
    return K.json_report(suspicions(spark, d))


def table_schemas(spark, d):
    cells, cols = base_cells(spark, d)
    rich = P.enrich(cells, G.seed(spark).lookup())
    return H.table_schemas(H.fields(rich, P.profile_columns(rich, cols))).select("sheet", "schema")


def batch_summary(spark, d):
    return U.batch_summary(suspicions(spark, d), spark.createDataFrame([(f"file{i}_x.csv",) for i in range(40)], "file_id string"))


def payloads(spark, d):
    errors = spark.createDataFrame([("bad.xlsx", "Unreadable: no table")], "file_id string, error string")
    return U.payload(suspicions(spark, d), errors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        gene_date_by_family, serial_to_date, reverse_date, canonicalize, parse_date_text, parse_cell_dates, simulate_roundtrip, riken_signature, leading_zeros, time_texts,
        cas_and_aliases, decimal_commas, homoglyphs, value_kinds, header_hints, cells_of_tables, classify_columns, column_verdicts, column_counts, detect_sheet, detect_tables, autofill_runs,
        registry_build, registry_resolve, registry_equivalents, xref_lookup, xref_adjudicate, bands, exit_codes, audit, analytics, capped, proposals, audit_log, apply_corrections, schema_fields, table_schemas,
        prefilter, recall, precision_intervals, corpus_summary, html_sniff, merged_fill, stratified_sample, rule_sheets, large_files, walk_files, column_names, snapshot_ages, date_prone, reports, json_reports, batch_summary, payloads,
    )
}
__all__ = ["QUERIES", "R"]
