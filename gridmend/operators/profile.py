"""Column profiles: what each column holds, in two aggregations over the cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.functions import scalars as S
from gridmend.operators.cells import COLUMN, SHEET
from gridmend.operators.store import small

SAMPLE = 200
MIN_SAMPLES = 5
THRESHOLD = 0.30


def enrich(cells: DataFrame, lookup: DataFrame, reference_year: int = 2026) -> DataFrame:
    """cells with s (stripped text), is_known, is_known_upper, is_resolvable and is_xspecies, by one join with the registry's lookup
    table, and the dates and symbols of texts that parse, computed once."""
    c = cells.withColumn("s", S.strip(F.col("v_str"))).withColumn("low", F.lower("s"))
    j = c.join(small(lookup), "low", "left")
    text = F.col("vtype") == "str"
    no = F.lit(False)
    j = j.withColumns(
        {
            "is_known": text & F.coalesce(F.array_contains("known", F.col("s")), no),
            "is_known_upper": text & F.coalesce(F.array_contains("known", F.upper("s")), no),
            "is_resolvable": text & F.coalesce("resolvable", no),
            "is_xspecies": text & F.coalesce("xspecies", no) & F.length("s").between(2, 20),
            "in_xspecies": text & F.coalesce("xspecies", no),
        }
    )
    # a date needs a digit; most texts end here
    maybe = text & ~F.col("is_xspecies") & F.col("s").rlike("[0-9]") & (F.length("s") >= 4)
    none = F.array().cast("array<array<date>>")
    parsed = F.when(maybe, S.token_dates(F.col("v_str"), reference_year)).otherwise(none)
    j = j.drop("known", "resolvable", "xspecies").withColumn("parsed", parsed)
    whole = F.coalesce(F.get("parsed", F.lit(0)), F.array().cast("array<date>"))
    return j.withColumns({"dates": whole, "cell_dates": S.first_parsed(F.col("parsed"))}).drop("parsed")


def classify(enriched: DataFrame, columns: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(COLUMN, column_type, type_confidence, n_samples) of each column, from its first ``sample`` cells by row. The row limit is applied before
    the shuffle, so a long column sends a few rows."""
    rank = F.row_number().over(Window.partitionBy(*COLUMN).orderBy("row_id"))
    first = enriched.withColumn("rn", rank).where(F.col("rn") <= sample).withColumn("kind", S.value_kind())
    text = F.col("vtype") == "str"
    hgnc = text & (F.col("is_known") | F.col("is_known_upper"))
    count = lambda c: F.count_if(c)
    kinds = ["hgnc_id", "ensembl", "refseq", "uniprot", "entrez", "riken_pattern", "gene_like", "date", "numeric", "string-other"]
    agg = first.groupBy(*COLUMN).agg(
        F.count("*").alias("seen"),
        count(F.col("kind").isin("placeholder", "empty")).alias("dropped"),
        count(hgnc).alias("n_hgnc"),
        count(text & ~hgnc & F.col("in_xspecies")).alias("n_multi"),
        *[count(F.col("kind") == k).alias(f"k_{k.replace('-', '_')}") for k in kinds],
    )
    if columns is not None:
        agg = columns.join(agg, COLUMN, "left").fillna(0)
    total = F.col("seen") - F.col("dropped")
    share = lambda k: F.col(k) / F.when(total > 0, total)
    both = (F.col("n_hgnc") + F.col("n_multi")) / F.when(total > 0, total)
    rules: list[tuple[Column, str, Column]] = [
        (F.col("seen") == 0, "empty", F.lit(0.0)),
        (F.col("seen") < min_samples, "free_text", F.lit(0.0)),
        (total == 0, "empty", F.lit(0.0)),
        (share("n_hgnc") >= threshold, "gene_symbol", share("n_hgnc")),
        (both >= threshold, "gene_symbol", both),
        *[(share(f"k_{db}") >= threshold, db, share(f"k_{db}")) for db in ("hgnc_id", "ensembl", "refseq", "uniprot", "entrez")],
        (share("k_riken_pattern") >= threshold, "riken", share("k_riken_pattern")),
        (share("k_gene_like") >= threshold, "gene_symbol", share("k_gene_like")),
        ((share("k_date") >= 0.20) & (F.col("k_gene_like") == 0) & (F.col("k_riken_pattern") == 0), "date", share("k_date")),
        (share("k_numeric") >= 0.5, "measurement", share("k_numeric")),
        (share("k_date") >= 0.5, "date", share("k_date")),
    ]
    kind = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise("free_text")
    conf = reduce(lambda acc, r: acc.when(r[0], r[2]), rules[1:], F.when(rules[0][0], rules[0][2])).otherwise(share("k_string_other"))
    return agg.select(*COLUMN, kind.alias("column_type"), conf.alias("type_confidence"), F.when(F.col("seen") < min_samples, F.col("seen")).otherwise(total).cast("long").alias("n_samples"))


def evidence(enriched: DataFrame) -> DataFrame:
    """Counts over all cells of each column, partially aggregated before the shuffle."""
    text, num = F.col("vtype") == "str", F.col("vtype").isin("int", "float")
    s = F.col("s")
    lz = text & s.rlike(r"^0[0-9]+\z")
    gene_like = text & s.rlike(X.GENE_LIKE)
    symbols = F.size(S.reverse_date(F.col("v_date"), F.lit(None).cast("string")))
    months = F.transform("dates", lambda d: F.call_function("shiftleft", F.lit(1), F.month(d)))
    month_bits = F.aggregate(months, F.lit(0), lambda a, b: a.bitwiseOR(b))
    base = enriched.groupBy(*COLUMN).agg(
        F.count("*").alias("n"),
        F.count_if(text).alias("n_text"),
        F.count_if(num).alias("n_num"),
        F.count_if(F.col("is_known")).alias("n_known"),
        F.count_if(gene_like).alias("n_gene_like"),
        F.count_if(text & s.rlike(X.RIKEN)).alias("n_riken"),
        F.count_if(gene_like & (F.col("is_known") | F.col("is_resolvable"))).alias("n_recognised"),
        F.count_if((F.col("vtype") == "date") & (symbols > 0)).alias("n_date_corrupt"),
        F.count_if(text & (F.size("dates") > 0)).alias("n_date_text"),
        F.bit_count(F.bit_or(F.when(text, month_bits).otherwise(0))).alias("n_months"),
        F.count_if(text & (s != "")).alias("n_filled"),
        F.count_if(text & s.rlike(X.DECIMAL_COMMA)).alias("n_comma"),
        F.count_if(text & s.rlike(X.DECIMAL_PERIOD)).alias("n_period"),
        F.min("row_id").alias("first_row"),
    )
    widths = enriched.where(lz).groupBy(*COLUMN, F.length("s").alias("width")).agg(F.count("*").alias("cnt"), F.min("row_id").alias("at"))
    widths = widths.groupBy(*COLUMN).agg(
        F.sum("cnt").alias("n_lz"), F.count("*").alias("n_widths"), F.max_by("width", F.struct("cnt", -F.col("at"))).alias("lz_width")
    )
    return base.join(widths, COLUMN, "left").fillna(0, ["n_lz", "n_widths"])


def verdicts(profile: DataFrame) -> DataFrame:
    """profile (classify joined with evidence) with what the rules ask of a column."""
    name = F.lower("col")
    tokens = S.header_tokens(F.col("col"))
    profile = profile.withColumns({"hint": S.has_hint(tokens, X.IDENTIFIER_HINTS), "non_hint": S.has_hint(tokens, X.NON_IDENTIFIER_HINTS), "riken_hint": F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in X.RIKEN_HEADERS]))})
    kind, n = F.col("column_type"), F.greatest(F.col("n"), F.lit(1))
    other = F.col("n") - F.col("n_text")
    seen = (F.col("n_known") > 0) | (F.col("n_gene_like") > 0) | (F.col("n_riken") > 0)
    free = (
        F.when(F.col("non_hint"), False)
        .when(F.col("n") == 0, F.col("hint"))
        .when(~seen & ~F.col("hint"), False)
        .when((F.col("n_known") >= 1) & ((F.col("n_known") + other) / n >= 0.3), True)
        .when((F.col("n_gene_like") > 0) & ((F.col("n_gene_like") + other) / n >= 0.5), True)
        .when((F.col("n_riken") > 0) & ((F.col("n_riken") + other) / n >= 0.3), True)
        .otherwise(F.col("hint"))
    )
    is_id = F.when(kind.isin("gene_symbol", "riken"), True).when(kind == "free_text", free).otherwise(False)
    any_id = kind.isin("gene_symbol", "entrez", "uniprot", "refseq", "ensembl", "hgnc_id", "riken") | F.col("hint")
    share = F.col("n_date_text") / F.greatest(F.col("n_text"), F.lit(1))
    legit = (F.col("n_text") >= 5) & ((S.any_like(name, X.DATE_HEADERS) & (share >= 0.5)) | ((F.col("n_months") >= 5) & (share >= 0.8)))
    exempt = S.any_like(name, X.MEASUREMENT_EXEMPT)
    measured = ~exempt & (S.any_like(name, X.MEASUREMENT_HEADERS) | ((F.col("n") >= 10) & (F.col("n_num") / n >= 0.95)))
    skipped = kind.isin("entrez", "uniprot", "refseq", "ensembl", "hgnc_id", "measurement", "date", "empty")
    return profile.withColumns({"is_id": is_id, "legit_dates": legit, "measured": measured}).withColumns(
        {"promoted": (F.col("n_lz") >= 3) | F.col("is_id") | any_id, "blind": ~F.col("non_hint") & ~skipped, "chemical": S.any_like(name, X.CHEMISTRY_HEADERS)}
    )


def profile_columns(enriched: DataFrame, columns: DataFrame | None = None, **options) -> DataFrame:
    """One row for each column: its type, evidence and verdicts."""
    both = classify(enriched, columns, **options).join(evidence(enriched), COLUMN, "left")
    counts = [c for c in both.columns if c.startswith("n_") or c == "n"]
    return verdicts(both.fillna(0, counts))


def foreign_sheets(profile: DataFrame) -> DataFrame:
    """SHEETs of 20 symbol-like cells or more in identifier columns of which fewer than half are recognised."""
    ids = profile.where("promoted or is_id").groupBy(*SHEET).agg(F.sum("n_gene_like").alias("g"), F.sum("n_recognised").alias("r"))
    return ids.where("g >= 20 and r / g < 0.5").select(*SHEET)


def has_gene_symbols(enriched: DataFrame, rows: int = 5000, least: int = 5) -> DataFrame:
    """Files with a column of ``least`` distinct known symbols or more in its first ``rows`` rows."""
    known = enriched.where(F.col("is_known") & (F.col("row_id") < rows))
    return known.groupBy(*COLUMN).agg(F.count_distinct("s").alias("k")).where(F.col("k") >= least).select("file_id").distinct()
