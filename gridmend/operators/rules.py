"""Emission rules: which cells are damaged, how, and what they were.

Rules of the first pass (symbol columns) take precedence over those of the numeric pass (identifier columns), and both over
the context-free pass; that is a ``coalesce`` of three structs in each row, so there is no state and no order of
evaluation. Column-level rules come from the profile alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.functions import scalars as S
from gridmend.operators.cells import COLUMN, SHEET, value_text
from gridmend.operators.store import small

FLAG = "struct<rule_id:string,kind:string,candidates:array<string>,confidence:double>"
#: Kinds whose suggestion is advice, not a value to write into the cell.
ADVISORY = ["decimal-comma", "cas-registry"]
OUT = [*COLUMN, "row_id", "rule_id", "kind", "value_repr", "suggestion", "candidates", "confidence", "reason_code", "reason_args", "xref_status"]


def flag(rule: str, kind: str, candidates: Column | None, confidence: Column | float) -> Column:
    c = candidates if candidates is not None else F.lit(None)
    conf = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("kind"), c.cast("array<string>").alias("candidates"), conf.cast("double").alias("confidence")).cast(FLAG)


def first_of(rules: list[tuple[Column, Column]]) -> Column:
    """The flag of the first rule whose condition holds, else null."""
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(F.lit(None).cast(FLAG))


def prepared(cells: DataFrame) -> DataFrame:
    """Per-cell values that several rules use, each computed once: text and number readings and their symbols."""
    text, num = F.col("vtype") == "str", F.col("vtype").isin("int", "float")
    integral = F.when(F.col("vtype") == "int", F.col("v_int")).when((F.col("vtype") == "float") & (F.col("v_num") == F.floor("v_num")) & (F.abs("v_num") < 1e18), F.col("v_num").cast("decimal(38,0)"))
    digits = F.when(text & F.col("s").rlike(X.DIGITS), F.col("s").try_cast("decimal(38,0)"))
    null = F.lit(None).cast("string")
    out = cells.withColumns({"is_text": text, "is_num": num, "integral": integral, "digits": digits})
    small = lambda c: F.when(c.between(1, 1000000000), c)
    return out.withColumns(
        {
            "num_symbols": F.when(F.col("integral").isNotNull(), S.reverse_date(S.serial_to_date(small(F.col("integral"))), null)),
            "digit_symbols": F.when(F.col("digits").isNotNull(), S.reverse_date(S.serial_to_date(F.col("digits")), null)),
            "raw_symbols": F.when(F.col("vtype") == "date", S.reverse_date(F.col("v_date"), F.col("number_format"))),
            "text_symbols": F.when(F.size("cell_dates") > 0, S.symbols_of_dates(F.col("cell_dates"))),
            "repaired": F.when(text & (F.octet_length("v_str") != F.char_length("v_str")), S.gene_after_repair(F.col("s"))),
            "time_text": F.when(text & F.contains("s", F.lit(":")), S.time_text(F.col("v_str"))),
        }
    ).withColumns({"date_symbols": S.canonical(F.col("raw_symbols")), "date_modern": S.has_one_modern(F.col("raw_symbols"))})


def some(c: str) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def symbol_column_rules() -> Column:
    """The first pass: cells of columns of symbols."""
    few = F.col("n_date_corrupt") < 2
    one = F.size("date_symbols") == 1
    conf = (
        F.when(one, 0.95)
        .when(some("date_symbols") & few, F.when(F.col("date_modern"), 0.30).otherwise(0.20))
        .when(some("date_symbols"), F.when(F.col("date_modern"), 0.60).otherwise(0.50))
        .otherwise(0.0)
    )
    serial = F.when(F.col("n_date_corrupt") >= 1, 0.85).otherwise(0.15)
    serial_text = F.when(F.col("n_date_corrupt") >= 1, 0.75).otherwise(0.15)
    plain = F.col("is_text") & ~F.col("is_xspecies")
    listed = F.when(some("date_symbols"), F.col("date_symbols"))
    return first_of(
        [
            (F.col("vtype") == "time", flag("R-TIME-OBJ", "time-coercion", F.array(F.concat_ws(":", "v_time_h", "v_time_m")), 0.80)),
            (plain & F.col("time_text").isNotNull(), flag("R-TIME-STR", "time-coercion", F.array("time_text"), 0.75)),
            (plain & F.col("repaired").isNotNull(), flag("R-HOMO", "homoglyph", F.array("repaired"), 0.85)),
            (F.col("vtype") == "date", flag("R-DATE", "gene-date", listed, conf)),
            (F.col("is_num") & some("num_symbols"), flag("R-SER-NUM", "gene-date-serial", F.col("num_symbols"), serial)),
            (F.col("is_num") & (F.abs("v_num") >= 1e10), flag("R-IDFLOAT-P1", "id-float", None, 0.85)),
            (plain & some("digit_symbols"), flag("R-SER-STR", "gene-date-serial", F.col("digit_symbols"), serial_text)),
        ]
    )


def identifier_column_rules() -> Column:
    """The numeric pass: cells of identifier columns of any kind."""
    form = F.when(F.col("is_num") & (F.col("integral") >= 0), F.col("integral").cast("string")).when(
        F.col("digits").isNotNull() & ~F.col("s").startswith("0"), F.col("s")
    )
    stripped = (F.col("n_lz") >= 3) & (F.length(form) < F.col("lz_width"))
    padded = F.array(F.lpad(form, F.greatest(F.col("lz_width"), F.lit(1)), "0"))
    size = F.abs("v_num")
    long_int = F.when(F.col("vtype") == "int", F.abs("v_int") >= X.EXACT_INT).otherwise(size >= float(X.EXACT_INT))
    is_float = F.col("hint") & (F.col("vtype") == "float")
    sig = S.riken_signature(F.col("v_num"))
    return first_of(
        [
            (F.coalesce(stripped, F.lit(False)), flag("R-LZ", "leading-zero-stripped", padded, F.when(F.col("n_widths") == 1, 0.85).otherwise(0.65))),
            (F.col("is_num") & long_int, flag("R-LONG", "long-int-precision-loss", None, 0.85)),
            (is_float & (size >= 1e10), flag("R-IDF-A", "id-float", None, F.when(sig, 0.95).otherwise(0.80))),
            (is_float & sig & (size >= 1e7), flag("R-IDF-B", "id-float", None, F.when(F.col("riken_hint"), 0.85).otherwise(0.65))),
            (is_float & F.col("riken_hint") & (size >= 1e7), flag("R-IDF-C", "id-float", None, 0.55)),
        ]
    )


def context_free_rules() -> Column:
    """The pass over cells of any column that isn't known to hold something else."""
    text = F.col("is_text") & ~F.col("is_xspecies")
    dates = F.when(F.size("date_symbols") == 1, 0.45).when(F.col("date_modern"), 0.30).otherwise(0.25)
    parsed = F.when((F.size("cell_dates") == 1) & (F.size("text_symbols") == 1), 0.55).when(F.size("text_symbols") == 1, 0.40).otherwise(0.25)
    cas = F.when(F.col("chemical"), 0.20).otherwise(0.70)
    return first_of(
        [
            (some("date_symbols"), flag("R-DATE-P2", "gene-date", F.col("date_symbols"), dates)),
            (text & F.col("s").rlike(f"(?i){X.OCT34}"), flag("R-OCT34", "gene-date-string", F.array(F.lit("POU5F1"), F.lit("OCT4"), F.lit("OCT3")), 0.80)),
            (text & F.col("s").rlike(X.CAS), flag("R-CAS", "cas-registry", F.array("v_str"), cas)),
            (text & some("text_symbols") & ~F.col("legit_dates"), flag("R-DSTR", "gene-date-string", F.col("text_symbols"), parsed)),
            (text & some("digit_symbols") & ~F.col("measured"), flag("R-SSTR", "gene-date-serial", F.col("digit_symbols"), 0.30)),
            (F.col("is_num") & some("num_symbols") & ~F.col("measured"), flag("R-SNUM", "gene-date-serial", F.col("num_symbols"), F.when(F.size("num_symbols") == 1, 0.30).otherwise(0.20))),
        ]
    )


def commas_sparse() -> Column:
    return (F.col("n_filled") >= 5) & (F.col("n_comma") > 0) & (F.col("n_period") > 0) & (F.col("n_comma") / F.col("n_filled") <= 0.10) & (F.col("n_period") >= 4 * F.col("n_comma"))


def commas_throughout() -> Column:
    return (F.col("n_filled") >= 5) & (F.col("n_period") == 0) & (F.col("n_comma") / F.greatest(F.col("n_filled"), F.lit(1)) >= 0.80)


def cell_flags(enriched: DataFrame, profile: DataFrame, foreign: DataFrame) -> DataFrame:
    """Flags of single cells: one join of the cells with their columns' profile, then expressions only."""
    marks = profile.join(foreign.withColumn("is_foreign", F.lit(True)), SHEET, "left")
    c = prepared(enriched).join(small(marks), COLUMN)
    c = c.withColumns({"p1": F.when(F.col("is_id"), symbol_column_rules()), "p15": F.when(F.col("promoted"), identifier_column_rules()), "p2": F.when(F.col("blind"), context_free_rules())})
    outlier = F.col("promoted") & (F.col("n_gene_like") >= 10) & (F.col("n_recognised") / F.greatest(F.col("n_gene_like"), F.lit(1)) >= 0.80)
    unknown = F.col("is_text") & F.col("s").rlike(X.GENE_LIKE) & ~(F.col("is_known") | F.col("is_resolvable")) & F.col("is_foreign").isNull()
    main = F.coalesce("p1", "p15", "p2")
    unrec = F.when(outlier & unknown & F.col("p1").isNull() & F.col("p15").isNull(), flag("R-UNREC", "unrecognized-symbol", None, 0.20))
    comma = F.when(commas_sparse() & F.col("is_text") & F.col("s").rlike(X.DECIMAL_COMMA), flag("R-DC-CELL", "decimal-comma", F.array(F.lit("period-decimal (replace `,` with `.`)")), 0.40))
    flags = F.array_compact(F.array(main, unrec, comma))
    args = F.create_map(
        F.lit("type"), F.col("column_type"), F.lit("format"), F.coalesce("number_format", F.lit("")), F.lit("corrupted_dates"), F.col("n_date_corrupt").cast("string"),
        F.lit("known"), F.concat_ws("/", "n_recognised", "n_gene_like"),
    )
    return c.select(*COLUMN, "row_id", value_text().alias("value_repr"), args.alias("reason_args"), F.explode(flags).alias("f")).transform(_finish)


def column_flags(profile: DataFrame) -> DataFrame:
    """Flags of whole columns, reported at their first row."""
    advice = F.array(F.lit("set decimalChar to `,` in the table schema, or convert numbers to period-decimal"))
    hit = profile.where(commas_throughout())
    share = F.format_string("%d/%d cells use comma-decimal", "n_comma", "n_filled")
    args = F.create_map(F.lit("cells"), F.concat_ws("/", "n_comma", "n_filled"))
    return hit.select(*COLUMN, F.col("first_row").alias("row_id"), share.alias("value_repr"), args.alias("reason_args"), flag("R-DC-COL", "decimal-comma", advice, 0.55).alias("f")).transform(_finish)


def _finish(df: DataFrame) -> DataFrame:
    joined = F.when(F.size("f.candidates") > 0, F.array_join("f.candidates", " | "))
    return df.select(
        *COLUMN, "row_id", "f.rule_id", "f.kind", "value_repr", joined.alias("suggestion"), "f.candidates", "f.confidence",
        F.col("f.rule_id").alias("reason_code"), "reason_args", F.lit(None).cast("string").alias("xref_status"),
    )
