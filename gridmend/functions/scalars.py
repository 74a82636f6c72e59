"""Scalar expressions: text, dates, identifiers. All are built-in Spark expressions, evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmend.functions import fixed as X

NO_TEXTS = "array<string>"


def empty() -> Column:
    return F.array().cast(NO_TEXTS)


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends, where trim removes spaces only."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+\z", "")


def any_like(c: Column, parts: list[str]) -> Column:
    """Whether c contains any of the parts."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


# --- dates ---------------------------------------------------------------------------------------------------


def serial_to_date(n: Column) -> Column:
    """The date of a spreadsheet serial, null outside the plausible range."""
    lo, hi = X.SERIAL_RANGE
    return F.when(n.between(lo, hi), F.date_add(F.lit("1899-12-30").cast("date"), n.cast("int")))


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body reads it."""
    return F.transform(F.array(value), body)[0]


def table(pairs: dict[str, str]) -> Column:
    """A constant map<string, string>: one text that folds into one literal, where a map of literals would be a
    node of the plan for each entry."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in pairs.items())), F.lit("\n"), F.lit("\t"))


def family_table() -> dict[str, str]:
    """100 * month + n -> symbols, from the families' rules."""
    out: dict[str, list[str]] = {}
    for m, lo, hi, p in X.FAMILIES:
        for n in range(lo, hi + 1):
            out.setdefault(str(100 * m + n), []).append(f"{p}{n}")
    for m, lo, hi, p in X.FAMILIES_BACKWARD:
        for n in range(lo, hi + 1):
            out.setdefault(str(100 * m + n), []).append(f"{p}{32 - n}")
    return {k: ",".join(v) for k, v in out.items()}


def rename_table() -> dict[str, str]:
    """Old symbol -> present symbol of the renamed families."""
    return {f"{old}{n}": f"{new}{n}" for old, (new, last) in X.RENAMED.items() for n in range(1, last + 1)} | X.RENAMED_ONE


def candidates(month: Column, n: Column) -> Column:
    """Symbols that a date of this month and number may have been."""
    found = F.try_element_at(table(family_table()), (100 * month + n).cast("string"))
    return F.coalesce(F.split(found, ","), empty())


def reverse_date(d: Column, number_format: Column) -> Column:
    """Symbols behind a date: by its day, by its two-digit year if the format shows a year and no day, and by both
    if the format is unknown, the day is 1 and the year is 2000 to 2059."""
    fmt = F.lower(number_format)
    # an empty format says nothing, as no format does, but it isn't unknown
    by_year = F.coalesce(F.contains(fmt, F.lit("y")) & ~F.contains(fmt, F.lit("d")), F.lit(False))
    both = number_format.isNull() & (F.dayofmonth(d) == 1) & F.year(d).between(2000, 2059)
    day = F.when(by_year, empty()).otherwise(candidates(F.month(d), F.dayofmonth(d)))
    year = F.when(by_year | both, candidates(F.month(d), F.year(d) % 100)).otherwise(empty())
    found = F.array_distinct(F.concat(day, year))
    return F.when(F.year(d).between(*X.YEAR_RANGE), found).otherwise(empty())


def modern(symbol: Column) -> Column:
    """The present name of a symbol of a renamed family, else null."""
    return F.try_element_at(table(rename_table()), symbol)


def canonical(found: Column) -> Column:
    """Candidates with present names first."""
    return F.array_distinct(F.concat(F.array_compact(F.transform(found, modern)), found))


def has_one_modern(found: Column) -> Column:
    """Whether exactly one present name is among them."""
    return F.size(F.array_distinct(F.array_compact(F.transform(found, modern)))) == 1


def month_number(token: Column) -> Column:
    """The month of an abbreviation in one of twelve languages, else null."""
    return F.try_element_at(table({n: str(m) for m, names in X.MONTHS.items() for n in names}), F.lower(token)).cast("int")


def make_date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is none."""
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def _full_year(text: Column, reference_year: int) -> Column:
    n = F.when(text != "", text).cast("int")
    return F.when(text == "", F.lit(reference_year)).when(n < 100, n + 2000).otherwise(n)


_SEP = "[-/.]"
_TOKEN = "|".join(sorted({n for names in X.MONTHS.values() for n in names}))
ISO = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?)?\z"
DAY_MONTH = rf"(?iu)^([0-9]{{1,2}}){_SEP}({_TOKEN})({_SEP}([0-9]{{2,4}}))?\z"
MONTH_DAY = rf"(?iu)^({_TOKEN}){_SEP}([0-9]{{1,2}})({_SEP}([0-9]{{2,4}}))?\z"
NUMBERS = rf"^([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{2,4}})\z"
_LONG = "|".join([*X.LONG_MONTHS, *(m[:3] for m in X.LONG_MONTHS), "sept"])
#: Written-out dates; parts of a date are never filled from today's.
LONG_MDY = rf"(?i)^({_LONG})\.? ([0-9]{{1,2}})(st|nd|rd|th)?,? ([0-9]{{4}})\z"
LONG_DMY = rf"(?i)^([0-9]{{1,2}})(st|nd|rd|th)? ({_LONG})\.?,? ([0-9]{{4}})\z"


def parse_dates(text: Column, reference_year: int = 2026) -> Column:
    """Dates that a text may mean, in order; both readings of an all-numeric one. A year that isn't given is
    reference_year, so that results don't depend on the day of the run."""

    def read(s: Column) -> Column:
        part = lambda p, i: F.regexp_extract(s, p, i)
        num = lambda p, i: part(p, i).try_cast("int")
        year = lambda p, i: let(part(p, i), lambda y: _full_year(y, reference_year))
        both = let(year(NUMBERS, 3), lambda y: compact(make_date(y, num(NUMBERS, 2), num(NUMBERS, 1)), make_date(y, num(NUMBERS, 1), num(NUMBERS, 2))))
        return (
            F.when(s.rlike(ISO), compact(make_date(num(ISO, 1), num(ISO, 2), num(ISO, 3))))
            .when(s.rlike(DAY_MONTH), compact(make_date(year(DAY_MONTH, 4), month_number(part(DAY_MONTH, 2)), num(DAY_MONTH, 1))))
            .when(s.rlike(MONTH_DAY), compact(make_date(year(MONTH_DAY, 4), month_number(part(MONTH_DAY, 1)), num(MONTH_DAY, 2))))
            .when(s.rlike(NUMBERS), F.array_distinct(both))
            .when(s.rlike(LONG_MDY), compact(make_date(num(LONG_MDY, 4), month_number(F.left(part(LONG_MDY, 1), F.lit(3))), num(LONG_MDY, 2))))
            .when(s.rlike(LONG_DMY), compact(make_date(num(LONG_DMY, 4), month_number(F.left(part(LONG_DMY, 3), F.lit(3))), num(LONG_DMY, 1))))
            .otherwise(F.array().cast("array<date>"))
        )

    return let(strip(text), read)


def token_dates(text: Column, reference_year: int = 2026) -> Column:
    """parse_dates of the whole text, and then of its tokens by each delimiter in turn."""
    tokens = F.concat(F.array(text), *[F.split(text, d, -1) for d in (",", ";", "\t", "\n", r"\|")])
    return F.transform(tokens, lambda t: parse_dates(t, reference_year))


def first_parsed(dates: Column) -> Column:
    """Of token_dates, those of the whole text or else of the first token that parses."""
    return F.coalesce(F.get(F.filter(dates, lambda x: F.size(x) > 0), F.lit(0)), F.array().cast("array<date>"))


def parse_cell_dates(text: Column, reference_year: int = 2026) -> Column:
    """parse_dates of the whole cell, else of its first token that parses, by the first delimiter that yields one."""
    return first_parsed(token_dates(text, reference_year))


def symbols_of_dates(dates: Column) -> Column:
    """Symbols behind any of the dates, in order, without repeats."""
    return F.array_distinct(F.flatten(F.transform(dates, lambda d: reverse_date(d, F.lit(None).cast("string")))))


# --- identifiers -----------------------------------------------------------------------------------------------


def external_id_kind(text: Column) -> Column:
    """The first shape of external identifier that text has, else null."""
    s = strip(text)
    return _id_kind(s)


def _id_kind(s: Column) -> Column:
    return F.coalesce(*[F.when(s.rlike(shape), kind) for kind, shape in X.ID_SHAPES])


def text_kind(text: Column) -> Column:
    """The kind of a text value."""
    big = r"^[+-]?[0-9]*\.?[0-9]+[eE][+-]?0*[1-9][0-9]+\z"  # an exponent of two digits or more
    return let(strip(text), lambda s: F.when(s == "", "empty").otherwise(F.coalesce(
        F.when(F.lower(s).isin(X.MISSING) | s.isin(X.ZEROS), "placeholder"),
        _id_kind(s),
        F.when(s.rlike(X.GENE_LIKE), "gene_like"),
        F.when(s.rlike(X.RIKEN), "riken_pattern"),
        F.when(s.rlike(X.NUMERIC_TEXT) & ~s.rlike(big), "numeric"),
        F.lit("string-other"),
    )))


def value_kind() -> Column:
    """The kind of a cell, from the columns of the cells model."""
    vtype = F.col("vtype")
    zero = F.coalesce(F.col("v_num") == 0, F.lit(False))
    return (
        F.when(vtype == "str", text_kind(F.col("v_str")))
        .when(vtype == "date", "date")
        .when(vtype == "bool", "bool")
        .when(vtype.isin("int", "float"), F.when(zero, "placeholder").otherwise("numeric"))
        .otherwise("other")
    )


#: Powers of ten as literals: computed powers are not rounded alike everywhere.
_POWERS = [float(f"1e{k}") for k in range(0, 27)]


def riken_signature(x: Column) -> Column:
    """Whether a float looks like a clone identifier read as a number: a mantissa of 7 digits, an exponent of 7 to 31, one trailing
    zero at most, three distinct digits beside zero at least."""
    exp = F.floor(F.log10(F.when(x > 0, x))).cast("int")
    power = F.get(F.array(*[F.lit(p) for p in _POWERS]), exp - 6)
    mantissa = x / power
    digits = F.when((mantissa == F.floor(mantissa)) & mantissa.between(1000000, 9999999), mantissa.cast("bigint").cast("string"))
    distinct = F.size(F.array_remove(F.array_distinct(F.split(digits, "")), "0"))
    return F.coalesce(exp.between(7, 31) & digits.isNotNull() & ~digits.endswith("00") & (distinct >= 3), F.lit(False))


def header_tokens(name: Column) -> Column:
    """Words of a header; none for a caption."""
    s = strip(name)
    return F.when(F.length(s) > 80, empty()).otherwise(F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1))


def has_hint(tokens: Column, hints: list[str]) -> Column:
    """Whether a token is a hint or, of 4 characters or more, ends with one that is shorter by 2."""
    ends = lambda t: reduce(lambda a, b: a | b, [(F.length(t) >= len(h) + 2) & F.endswith(t, F.lit(h)) for h in hints])
    return F.arrays_overlap(tokens, F.array(*[F.lit(h) for h in hints])) | F.exists(tokens, lambda t: (F.length(t) >= 4) & ends(t))


_FROM = "".join(X.HOMOGLYPHS) + "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF21 + i) for i in range(26))
_TO = "".join(t * len(f) for f, t in X.HOMOGLYPHS.items()) + "0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repair_homoglyphs(text: Column) -> Column:
    """Look-alikes replaced by the ASCII characters they look like."""
    return F.translate(text, _FROM, _TO)


def homoglyph_list(text: Column) -> Column:
    """array<struct<original, codepoint, replacement>> of the replaced characters."""
    chars = F.filter(F.split(text, ""), lambda c: repair_homoglyphs(c) != c)
    return F.transform(chars, lambda c: F.struct(c.alias("original"), F.concat(F.lit("U+"), F.lpad(F.hex(F.encode(c, "UTF-16BE")), 4, "0")).alias("codepoint"), repair_homoglyphs(c).alias("replacement")))


def gene_after_repair(text: Column) -> Column:
    """The repaired text if it was changed and then has the shape of a symbol, else null."""
    fixed = repair_homoglyphs(text)
    return F.when((fixed != text) & (fixed.rlike(X.GENE_LIKE) | fixed.rlike(X.GENE_LIKE_LOOSE)), fixed)


def time_text(text: Column) -> Column:
    """h:mm of a text that is a time of day, else null."""
    s = strip(text)
    hour, minute = F.regexp_extract(s, X.TIME_TEXT, 1), F.regexp_extract(s, X.TIME_TEXT, 2)
    return F.when(s.rlike(X.TIME_TEXT), F.concat(hour.try_cast("int").cast("string"), F.lit(":"), minute))


def family(symbol: Column) -> Column:
    """The family of a proposed symbol."""
    s = F.upper(strip(symbol))
    out = F.lit("OTHER")
    for p in reversed(X.FAMILY_PREFIXES):
        out = F.when(s.rlike(rf"^{p}-*[0-9]+\z"), p).otherwise(out)
    for p in reversed(X.MODERN_PREFIXES):
        out = F.when(s.startswith(p), p).otherwise(out)
    return out


def band(confidence: Column) -> Column:
    """High, Medium, Low or Info."""
    out = F.lit("Info")
    for name, least in reversed(X.BANDS):
        out = F.when(confidence >= least, name).otherwise(out)
    return out


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high (>=0.85)").when(confidence >= 0.5, "medium (0.5-0.85)").otherwise("low (<0.5)")


def simulate(text: Column) -> Column:
    """struct<d date, x double>: what a spreadsheet makes of a text on import; both null if it stays as it is."""
    day = F.lit(None).cast("date")
    number = lambda p: F.regexp_extract(text, rf"^{p}([1-9][0-9]?)\z", 1)
    for m, lo, hi, p in X.FAMILIES:
        n = F.when(number(p) != "", number(p)).cast("int")
        hi = 3 if p == "APR" else 1 if p == "DEC" and hi == 1 else hi
        made = make_date(2000 + n, F.lit(1), F.lit(1)) if p == "TAMM" else make_date(F.lit(2024), F.lit(m), n)
        day = F.when(n.between(lo, hi), made).otherwise(day)
    n = F.when(number("JUN") != "", number("JUN")).cast("int")
    day = F.when(n.between(1, 3), make_date(F.lit(2024), F.lit(5), 32 - n)).otherwise(day)
    return F.struct(day.alias("d"), F.when(text.rlike(X.EXPONENT), text.try_cast("double")).alias("x"))
