"""Corpus-scale walks: which files are damaged, recall against ground truth, intervals of precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.functions.scalars import band, parse_cell_dates, strip, symbols_of_dates


def corpus_summary(files: DataFrame, gene_files: DataFrame, suspicions: DataFrame) -> DataFrame:
    """(files, gene_files, corrupted_files, papers, papers_corrupted, high, medium, low, info); a file's paper is its name up to the first
    underscore."""
    b = band(F.col("confidence"))
    per = suspicions.groupBy("file_id").agg(*[F.count_if(b == n).alias(n.lower()) for n in ("High", "Medium", "Low", "Info")])
    j = files.select("file_id").distinct().join(gene_files.withColumn("gene", F.lit(True)), "file_id", "left").join(per, "file_id", "left")
    paper = F.substring_index(F.substring_index("file_id", "/", -1), "_", 1)
    hit = F.col("gene").isNotNull() & F.col("high").isNotNull()
    return j.withColumns({"paper": paper, "hit": hit}).agg(
        F.count("*").alias("files"), F.count("gene").alias("gene_files"), F.count_if(F.col("hit")).alias("corrupted_files"), F.count_distinct("paper").alias("papers"),
        F.count_distinct(F.when(F.col("hit"), F.col("paper"))).alias("papers_corrupted"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("high", "medium", "low", "info")],
    )


def note_symbols(note: Column, reference_year: int = 2026) -> Column:
    """Symbols that a free-text note on a damaged cell names: itself a list of symbols or of dates."""
    tokens = F.filter(F.transform(F.split(note, r"[,;|/\s]+"), strip), lambda t: t != "")
    named = F.filter(F.transform(tokens, F.upper), lambda t: t.rlike(r"^[A-Z]{3,6}[0-9]{1,2}\z"))
    dated = F.flatten(F.transform(tokens, lambda t: symbols_of_dates(parse_cell_dates(t, reference_year))))
    return F.array_sort(F.array_distinct(F.concat(named, dated)))


def score_recall(expected: DataFrame, suspicions: DataFrame) -> DataFrame:
    """expected (file_id, note_id, symbols array) with outcome: TP, FN-missed, FN-suggestion-mismatch, ambiguous-note or file-missing.
    suspicions (file_id, candidates)."""
    found = suspicions.where("size(candidates) > 0").groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_set("candidates"))).alias("offered"))
    seen = suspicions.select("file_id").distinct().withColumn("any", F.lit(True))
    j = expected.join(found, "file_id", "left").join(seen, "file_id", "left")
    hit = F.coalesce(F.arrays_overlap("symbols", "offered"), F.lit(False))
    out = F.when(F.size("symbols") == 0, "ambiguous-note").when(F.col("any").isNull(), "FN-missed").when(hit, "TP").otherwise("FN-suggestion-mismatch")
    if "present" in expected.columns:
        out = F.when(~F.col("present"), "file-missing").otherwise(out)
    return j.withColumn("outcome", out).drop("offered", "any")


def wilson(hits: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The Wilson interval of a proportion."""
    p, zz = hits / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return mid - half, mid + half


def precision_by(scored: DataFrame, by: list[str]) -> DataFrame:
    """scored (by..., correct boolean): n, hits, precision and its Wilson interval."""
    g = scored.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("correct")).alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return g.select(*by, "n", "hits", (F.col("hits") / F.col("n")).alias("precision"), lo.alias("lo"), hi.alias("hi"))


def todo(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that a walk's ledger doesn't hold yet: a stopped walk goes on from there."""
    return files.join(ledger.select("file_id").distinct(), "file_id", "left_anti")


def orphans(names: DataFrame, listed: DataFrame) -> DataFrame:
    """Names in one list and not in the other, with the side."""
    a = names.join(listed, "name", "left_anti").withColumn("side", F.lit("unlisted"))
    return a.unionByName(listed.join(names, "name", "left_anti").withColumn("side", F.lit("absent")))


def record(done: DataFrame, path: str) -> None:
    """Append finished files (file_id, ...) to the ledger at path, a folder of Parquet. An append is one job, so a walk that is stopped
    in the middle of it leaves either all of its rows or none."""
    done.write.mode("append").parquet(path)


def annotated_files(notes: DataFrame, files: DataFrame) -> DataFrame:
    """notes (accession, url, ...) with file_id of the cached file that each is about: the one named by accession and the last part of
    the url, or, without a url, every spreadsheet of the accession. Notes without such a file have a null file_id."""
    named = files.select("file_id", F.substring_index("file_id", "/", -1).alias("name"))
    sheets = named.where(F.lower("name").rlike(r"[.]xlsx?$")).select("file_id", F.substring_index("name", "_", 1).alias("accession"))
    has_url = F.coalesce(F.length("url") > 0, F.lit(False))
    pinned = notes.where(has_url).withColumn("name", F.concat_ws("_", "accession", F.substring_index("url", "/", -1))).join(named, "name", "left").drop("name")
    return pinned.unionByName(notes.where(~has_url).join(sheets, "accession", "left"))
