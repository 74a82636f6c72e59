"""Quality rules by line-first cleaning, with DataFrame operations only.

Every line of a document is judged by itself: it fails if it has no end punctuation (and is long enough for a
sentence), if it looks like navigation (separators between entries, or a list of menu words), if it
shouts, if it is strewn with symbols, or if it holds a boilerplate phrase. Failing lines are removed; a
document that loses too much of its text, or of whose text too little is left, is rejected.

Beside the verdict the document's own counts are given: words, code points in words, symbols, lines equal to an
earlier line, words in repeated 3-word windows. A document is in one row and all of this is computed
in it, so there is no shuffle.

Cases: null text has no words, no lines and is rejected; empty text too; very long texts are read whole;
repeated rows give repeated results; other columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import any_of

#: Fixed by the contract: what parts words, and what counts as a symbol.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "enable javascript", "lorem ipsum", "click here", "sign up for", "subscribe to our", "share this", "skip to content",
    "powered by", "licensed under the", "copyright ©", "copyright (c)",
)
#: Words of menus.
MENU = ("home", "about", "contact", "login", "log in", "sign in", "register", "menu", "search", "next", "previous", "back to top", "sitemap", "faq")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), 1), F.array().cast("array<string>"))


def line_fails(line: Column, min_sentence_words: int = 4, max_separators: int = 2, max_symbol_share: float = 0.05, max_shouts: int = 2) -> Column:
    """Whether a line that isn't blank fails a rule."""
    bare = F.rtrim(line)
    low = F.lower(bare)
    count = lambda what: (F.length(bare) - F.length(F.replace(bare, F.lit(what), F.lit("")))) / len(what)
    long_enough = F.regexp_count(bare, F.lit(f"[^{SPACE}]+")) >= min_sentence_words
    punctuation = long_enough & ~any_of([F.endswith(bare, F.lit(x)) for x in (".", "!", "?", "…", '"', "”", "»", ":", ";", ")", "'", "。", "！", "？")])
    navigation = (count(" | ") > max_separators) | (count(" » ") > max_separators) | (count(" > ") > max_separators)
    menu = F.trim(F.regexp_replace(low, r"[|>»·/,.-]+", " ")).rlike(rf"^\s*(?:(?:{'|'.join(MENU)})(?:\s+|$))+$")
    symbols = F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))
    strewn = symbols > max_symbol_share * F.length(bare)
    shouts = (count("!!") > max_shouts) & (F.upper(bare) == bare)
    boilerplate = any_of([F.contains(low, F.lit(x)) for x in BOILERPLATE])
    return punctuation | navigation | strewn | shouts | (~long_enough & menu) | boilerplate


def clean_lines(text: Column) -> Column:
    """The text without its failing lines; blank lines stay."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(f"[^{SPACE}]") & line_fails(x)))
    return F.array_join(kept, "\n")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first occurrence included.

    words must be a column, not an expression: it is read many times."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )
    return F.when(n < 4, F.lit(0)).otherwise(_covered(windows))


def _covered(windows: Column) -> Column:
    """Words covered by windows whose value occurs more than once."""
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is computed once

    def places(order: Column) -> Column:
        # neighbours in the order by value and place that have equal values
        same = lambda i, j: F.coalesce(F.get(order, i)["h"] == F.get(order, j)["h"], F.lit(False))
        held = F.filter(order, lambda x, i: same(i, i - 1) | same(i, i + 1))
        at = F.sort_array(F.transform(held, lambda x: x["i"]))
        # a window adds up to 3 words, fewer if the next one begins inside it
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    pairs = lambda w: F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs(w), places)))


def judge_documents(docs: DataFrame, max_lost: float = 0.5, min_words_left: int = 20) -> DataFrame:
    """docs' doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost (share
    of code points in removed lines) and kept."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        clean_lines(F.col("text")).alias("clean_text"),
    )
    rows = rows.select(
        "doc_id",
        F.length("text").alias("chars"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        "clean_text",
        F.size(words_of(F.col("clean_text"))).alias("left"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("lost", 1 - F.length("clean_text") / F.greatest(F.col("chars"), F.lit(1)))
    kept = ~F.col("base_failed") & (F.col("lost") <= max_lost) & (F.col("left") >= min_words_left)
    return rows.withColumn("kept", kept).drop("chars", "left")
