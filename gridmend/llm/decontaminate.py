"""Benchmark decontamination by a distributed positional inverted index, with DataFrame operations only.

Test windows are runs of SIZE consecutive words of a benchmark item (an item of fewer words is one window).
  1. The index: every document is parted into words once, and its words are stored by position in the shared folder,
     partitioned by document. A term's postings (document, position) are read from it; nothing reads the texts again.
  2. The lengths of the test terms' posting lists, over all documents, rank the terms of each window.
  3. Each window is searched from its rarest terms, the anchors. Postings of an anchor meet its windows, and the
     lists of the window's other terms are intersected where the posting lies, at their offsets from it: first those of the
     next rarest terms, then, for the few that are left, all others. All terms present is an exact phrase match; for a
     proximity match, ``near_terms`` of them within ``slop`` words of their place suffice, wherever the passage is laid.
     Of n terms then the n - near_terms + 1 rarest are anchors, one of which must be present, and one more of the next rarest as well, so that no
     match is lost.

No posting list is shuffled, so a frequent term is never one task's: the windows, in blocks of TESTS_BLOCK rows (a
bound in bytes, since a row holds some SIZE words), are broadcast to the index, with a pass over it for each block. What meets by document is
only matches. Nothing reaches the driver but counts.

Cases: null and empty texts have no words and no hits; items without words are never found; repeated items
count by item_id; rows that repeat doc_id and text are one document; very long texts are indexed whole; clean_documents passes
other columns, whatever their names, unchanged, and mark_documents leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import ascii_lower, drop_stash, id_key, named, stash, text_hash, unnamed

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
#: Terms of a window that op7's proximity matches hold.
NEAR_TERMS = 8
#: Rows of windows that are broadcast at once; a row is a window and one of its anchors, of some hundred bytes.
TESTS_BLOCK = 200_000
#: Test terms that may be broadcast, of some 50 bytes each.
TERMS_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    # what stands between words, each run once: only the first and the last part can be empty
    parts = F.split(ascii_lower(text.cast("string")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, words) windows of the items."""
    items = items.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    last = F.greatest(F.lit(0), F.size("w") - size)
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("words")).distinct()


def index_of(docs: DataFrame) -> DataFrame:
    """(doc_id, id0, hash, n_words, w): the words of every row of docs by position, stored."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("id0"), text_hash().alias("hash"), words_of(F.col("text")).alias("w"))
    # explode keeps the words from being made anew for each use
    words = words.select("doc_id", "id0", "hash", F.explode(F.array("w")).alias("w"))
    return stash(words.select("doc_id", "id0", "hash", F.size("w").alias("n_words"), "w"))


def term_frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): the length of the posting list of each of terms (term), which has no repeats. Terms up to TERMS_BROADCAST are
    sought where the words lie, so that only counts are shuffled; more are joined by a shuffle."""
    few = terms.count() <= TERMS_BROADCAST
    return index.select(F.explode("w").alias("term")).join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def anchored(windows: DataFrame, index: DataFrame, near_terms: int | None = None) -> DataFrame:
    """Windows with their terms from the rarest on: (anchor, at, first, window, terms array<struct<off, term>>, others, n,
    item_ids), a row for each anchor, of which the rarest is ``first``. One of others, the next rarest terms, must be near too.

    Equal windows of several items are one; offsets are relative to the anchor's place ``at``."""
    windows = windows.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    terms = windows.select("words", F.posexplode("words").alias("pos", "term"))
    used = stash(term_frequencies(index, stash(terms.select("term").distinct())))
    ranked = (
        terms.join(used, "term", "left")
        .groupBy("words")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("term"), F.col("pos")))).alias("r"))
    )
    n = F.size("words")
    missing = F.lit(0) if near_terms is None else n - F.least(F.lit(near_terms), n)
    each = windows.join(ranked, "words").select("*", F.posexplode(F.slice("r", F.lit(1), missing + 1)).alias("rank", "a"))
    return each.select(
        F.col("a")["term"].alias("anchor"),
        F.col("a")["pos"].alias("at"),
        (F.col("rank") == 0).alias("first"),
        F.xxhash64("words").alias("window"),
        F.transform("r", lambda t: F.struct((t["pos"] - F.col("a")["pos"]).alias("off"), t["term"].alias("term"))).alias("terms"),
        F.transform(F.filter(F.slice("r", F.lit(1), missing + 2), lambda t: t["pos"] != F.col("a")["pos"]), lambda t: t["term"]).alias("others"),
        n.alias("n"),
        "item_ids",
    )


def find_matches(docs: DataFrame, items: DataFrame, size: int = SIZE, near_terms: int | None = None, slop: int = 2) -> DataFrame:
    """(id0, hash, start, n, exact, item_ids) of every match: id0 and hash name the document (common.id_key and
    text_hash), start and n are its place in words. Without near_terms only exact phrases are returned."""
    return distinct_matches(matches_by_posting(index_of(docs), items, size, near_terms, slop))


def distinct_matches(found: DataFrame) -> DataFrame:
    """The matches of postings, one row each. A passage that satisfies proximity at several neighbouring places, or where its
    exact phrase stands, is one match."""
    rows = found.select("id0", "hash", F.explode("found").alias("m")).select("id0", "hash", "m.*")
    starts = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("start"))))
    grouped = rows.groupBy("id0", "hash", "window").agg(starts(F.col("exact")).alias("e"), starts(~F.col("exact")).alias("p"), F.first("n").alias("n"), F.first("item_ids").alias("item_ids"))
    clear = lambda a, x: ~F.exists("e", lambda y: F.abs(y - x) < F.col("n")) & F.coalesce(x - F.get(a, F.size(a) - 1) >= F.col("n"), F.lit(True))
    near = F.aggregate("p", F.array().cast("array<int>"), lambda a, x: F.when(clear(a, x), F.concat(a, F.array(x))).otherwise(a))
    places = F.concat(*[F.transform(c, lambda x: F.struct(x.alias("start"), F.lit(k).alias("exact"))) for c, k in ((F.col("e"), True), (near, False))])  # noqa: B023
    return grouped.select("id0", "hash", "n", "item_ids", F.explode(places).alias("m")).select("id0", "hash", "m.start", "n", "m.exact", "item_ids")


def matches_by_posting(index: DataFrame, items: DataFrame, size: int = SIZE, near_terms: int | None = None, slop: int = 2) -> DataFrame:
    """(id0, hash, found): the matches, as in find_matches, of each posting of the index that has any."""
    windows = stash(windows_of(items, size))
    tests = stash(anchored(windows, index, near_terms).withColumn("part", F.xxhash64("anchor", "window", "at")))
    blocks = -(-tests.count() // TESTS_BLOCK)
    out = None
    for k in range(max(1, blocks)):
        block = tests.where(F.pmod("part", F.lit(max(1, blocks))) == k)
        found = _met(index, F.broadcast(block), size - 1 + (2 * slop if near_terms else 0), near_terms, slop)
        out = found if out is None else out.unionByName(found)
    return out


def _met(index: DataFrame, tests: DataFrame, reach: int, near_terms: int | None, slop: int) -> DataFrame:
    postings = index.select("id0", "hash", "w", F.posexplode("w").alias("pos", "term"))
    met = postings.join(tests, postings.term == tests.anchor)
    lead = F.least("pos", F.lit(reach))
    around = F.slice("w", F.col("pos") - lead + 1, lead + (reach + 1))
    met = met.where((F.size("others") == 0) | F.arrays_overlap(around, "others"))
    # explode keeps the surroundings from being made anew for each use
    met = met.select("id0", "hash", "pos", "at", "first", "window", "terms", "n", "item_ids", lead.alias("lead"), F.explode(F.array(around)).alias("around"))
    match = lambda start, exact: F.struct(
        start.alias("start"), F.col("n").alias("n"), F.lit(exact).alias("exact"), F.col("window").alias("window"), F.col("item_ids").alias("item_ids"))
    start = F.col("pos") - F.col("at")
    either = lambda cond, rows, like: F.when(cond, rows).otherwise(F.slice(F.array(like), 1, 0))
    found = either(F.col("first") & _exact(), F.array(match(start, True)), match(start, True))
    if near_terms is not None:
        moved = F.transform(_near(near_terms, slop), lambda d: match(start + d, False))
        found = F.concat(found, either(_may_be_near(near_terms), moved, match(start, False)))
    return met.select("id0", "hash", F.explode(F.array(found)).alias("found")).where("size(found) > 0")


def _exact() -> Column:
    """Whether every term, from the rarest on, stands at its offset from the posting's place."""
    return F.forall("terms", lambda t: F.coalesce(F.get("around", F.col("lead") + t["off"]) == t["term"], F.lit(False)))


def _may_be_near(near_terms: int) -> Column:
    """Whether near_terms of the terms stand around the posting at all."""
    return F.size(F.filter("terms", lambda t: F.array_contains("around", t["term"]))) >= F.least(F.lit(near_terms), F.col("n"))


def _near(near_terms: int, slop: int) -> Column:
    """By how many words, slop at most, the passage may be moved so that near_terms of the terms stand within slop words of
    their place."""

    def stands(t: Column, d: Column) -> Column:
        at = F.col("lead") + t["off"] + d
        first = F.greatest(at - slop, F.lit(0))
        return F.array_contains(F.slice("around", first + 1, F.greatest(at + slop + 1 - first, F.lit(0))), t["term"])

    moves = F.array(*[F.lit(d) for d in range(-slop, slop + 1)])
    return F.filter(moves, lambda d: F.size(F.filter("terms", lambda t: stands(t, d))) >= F.least(F.lit(near_terms), F.col("n")))


def mark_documents(docs: DataFrame, items: DataFrame, size: int = SIZE, near_terms: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) of every row of docs: words inside exact matches, and the sorted
    ids, as strings, of the items found. With near_terms also n_near, the number of proximity matches that aren't exact."""
    index = index_of(docs)
    found = stash(matches_by_posting(index, items, size, near_terms))
    if near_terms is not None:
        near = distinct_matches(found).where(~F.col("exact")).groupBy("id0", "hash").agg(F.count("*").alias("n_near"))
        found = found.select("id0", "hash", F.filter("found", lambda m: m["exact"]).alias("found")).where("size(found) > 0")
    # a document's matches come together as they would in one row: there are no more than it has words and windows
    per_doc = found.groupBy("id0", "hash").agg(F.flatten(F.collect_set("found")).alias("found"))
    per_doc = per_doc.select(
        "id0",
        "hash",
        F.sort_array(F.array_distinct(F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["n"].alias("n"))))).alias("spans"),
        F.array_distinct(F.flatten(F.transform("found", lambda m: m["item_ids"]))).alias("ids"),
    )
    # words covered by spans in order of their starts
    fold = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["covered"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("covered"),
            F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
        ),
    )["covered"]
    per_doc = per_doc.select("id0", "hash", fold.alias("hit"), F.array_sort(F.transform("ids", lambda i: i.cast("string"))).alias("ids"))
    rows = index.select("doc_id", "id0", "hash", F.col("n_words").cast("long").alias("n_words"))
    extra = []
    if near_terms is not None:
        rows = rows.join(near, ["id0", "hash"], "left")
        extra = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    return rows.join(per_doc, ["id0", "hash"], "left").select(
        "doc_id", "id0", "hash", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids"), *extra
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs in which no window occurs."""
    index = index_of(docs)
    hit = stash(matches_by_posting(index, items, size).select("id0", "hash").distinct())
    drop_stash(index)
    return unnamed(named(docs)[0].join(hit, ["id0", "hash"], "left_anti"), docs)
