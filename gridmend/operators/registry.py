"""Symbol registries and external identifiers, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.functions import fixed as X
from gridmend.functions.scalars import external_id_kind, strip

EN_DATE_SHAPE = r"(?i)^([0-9]{1,2}[-/.](jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[-/.][0-9]{1,2})([-/.][0-9]{2,4})?\z"


def pipe_list(c):
    """The parts of a pipe-separated list, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda x: x != "")


@dataclass
class Registry:
    """current (symbol), prev and alias (old, symbol), xspecies (low), xref (space, id, symbol)."""

    current: DataFrame
    prev: DataFrame
    alias: DataFrame
    xspecies: DataFrame
    xref: DataFrame

    def lookup(self) -> DataFrame:
        """One row for each case-folded symbol: (low, known array, resolvable, xspecies). known are the exact current and previous
        spellings."""
        known = self.current.select("symbol").unionByName(self.prev.select(F.col("old").alias("symbol"))).select(
            F.lower("symbol").alias("low"), F.col("symbol").alias("known"), F.lit(True).alias("resolvable"), F.lit(False).alias("xspecies")
        )
        none = F.lit(None).cast("string")
        alias = self.alias.select(F.lower("old").alias("low"), none.alias("known"), F.lit(True).alias("resolvable"), F.lit(False).alias("xspecies"))
        other = self.xspecies.select("low", none.alias("known"), F.lit(False).alias("resolvable"), F.lit(True).alias("xspecies"))
        return known.unionByName(alias).unionByName(other).groupBy("low").agg(F.collect_set("known").alias("known"), F.max("resolvable").alias("resolvable"), F.max("xspecies").alias("xspecies"))

    def resolutions(self) -> DataFrame:
        """(key, folded, symbol): current, then previous, then alias; exact keys before case-folded ones. Of old names that differ in
        case alone the one that was claimed last counts."""
        levels = self.current.select(F.col("symbol").alias("key"), "symbol", F.lit(0).alias("level"), F.lit(0).cast("long").alias("late"))
        for level, old in ((1, self.prev), (2, self.alias)):
            levels = levels.unionByName(old.select(F.col("old").alias("key"), "symbol", F.lit(level).alias("level"), (-F.col("row")).cast("long").alias("late")))
        exact = levels.select("key", F.lit(False).alias("folded"), "symbol", "level", "late")
        folded = levels.select(F.lower("key").alias("key"), F.lit(True).alias("folded"), "symbol", "level", "late")
        return exact.unionByName(folded).groupBy("key", "folded").agg(F.min_by("symbol", F.struct("level", "late", "symbol")).alias("symbol"))

    def resolve(self, df: DataFrame, column: str, out: str = "resolved") -> DataFrame:
        """df with the present symbol of a column's symbols, or null."""
        r = self.resolutions()
        exact = r.where("not folded").select(F.col("key").alias(column), F.col("symbol").alias("__exact"))
        folded = r.where("folded").select(F.col("key").alias("__low"), F.col("symbol").alias("__folded"))
        got = df.join(exact, column, "left").withColumn("__low", F.lower(column)).join(folded, "__low", "left")
        return got.withColumn(out, F.coalesce("__exact", "__folded")).drop("__exact", "__folded", "__low")

    def equivalents(self, symbols: DataFrame) -> DataFrame:
        """(symbol, equivalent) for each of symbols(symbol): itself, what it resolves to, and all old names of either."""
        base = self.resolve(symbols.select("symbol").distinct(), "symbol")
        own = base.select("symbol", F.explode(F.array_compact(F.array_distinct(F.array("symbol", "resolved")))).alias("name"))
        old = self.prev.unionByName(self.alias).select("old", F.col("symbol").alias("name"))
        return own.select("symbol", F.col("name").alias("equivalent")).unionByName(
            own.join(old, "name").select("symbol", F.col("old").alias("equivalent"))
        ).distinct()


def build(hgnc: DataFrame, multispecies: DataFrame | None = None) -> Registry:
    """Build from tables: hgnc(symbol, status, prev_symbol, alias_symbol, hgnc_id, entrez_id, ensembl_gene_id,
    refseq_accession, uniprot_ids[, row]), multispecies(species, external_id, current_symbol, prev_or_alias).

    Only approved symbols count; of several rows that claim a name the first wins (by row, else by symbol); a previous name
    that is current is dropped, an alias that is current or previous is dropped."""
    spark = hgnc.sparkSession
    if "row" not in hgnc.columns:
        hgnc = hgnc.withColumn("row", F.lit(0))
    ok = hgnc.where((F.col("status") == "Approved") & (F.coalesce("symbol", F.lit("")) != ""))
    current = ok.select("symbol").distinct()
    order = F.struct("row", "symbol")

    def names(column: str) -> DataFrame:
        rows = ok.select("symbol", "row", F.explode(pipe_list(F.col(column))).alias("old"))
        rows = rows.groupBy("old").agg(F.min_by("symbol", order).alias("symbol"), F.min("row").alias("row"))
        return rows.join(current.select(F.col("symbol").alias("old")), "old", "left_anti")

    prev = names("prev_symbol")
    alias = names("alias_symbol").join(prev.select("old"), "old", "left_anti")
    spaces = {"hgnc_id": "hgnc_id", "entrez_id": "entrez", "ensembl_gene_id": "ensembl", "refseq_accession": "refseq", "uniprot_ids": "uniprot"}
    keys = F.array(*[F.struct(F.lit(s).alias("space"), F.col(c).cast("string").alias("ids")) for c, s in spaces.items() if c in ok.columns]).cast("array<struct<space:string,ids:string>>")
    ids = ok.select("symbol", "row", F.explode(keys).alias("k")).select("symbol", "row", "k.space", F.explode(pipe_list(F.col("k.ids"))).alias("id"))
    ids = ids.withColumn("id", F.when(F.col("space").isin("ensembl", "refseq"), F.substring_index("id", ".", 1)).otherwise(F.col("id")))
    ids = ids.select("space", "id", "symbol", F.lit(0).alias("priority"), "row")
    if multispecies is None:
        xspecies = spark.createDataFrame([], "low string")
    else:
        both = multispecies.select(F.explode(F.array("current_symbol", "prev_or_alias")).alias("s")).select(strip(F.col("s")).alias("s"))
        xspecies = both.where((F.col("s") != "") & ~F.col("s").rlike(EN_DATE_SHAPE)).select(F.lower("s").alias("low")).distinct()
        more = multispecies.select(
            F.coalesce(external_id_kind(F.col("external_id")), F.lit("ensembl")).alias("space"), F.col("external_id").alias("id"),
            F.col("current_symbol").alias("symbol"), F.lit(1).alias("priority"), F.lit(0).alias("row"),
        )
        ids = ids.unionByName(more.where(F.coalesce("id", F.lit("")) != ""))
    xref = ids.groupBy("space", "id").agg(F.min_by("symbol", F.struct("priority", "row", "symbol")).alias("symbol"))
    return Registry(current, prev, alias, xspecies, xref)


def seed(spark: SparkSession) -> Registry:
    """A registry of the renamed families and a few common symbols. Results that depend on membership are relative to
    it; the full registry is the user's, by load()."""
    rows = [(f"{new}{i}", f"{old}{i}", f"SEP{i}" if old == "SEPT" else "") for old, (new, last) in X.RENAMED.items() for i in range(1, last + 1)]
    rows += [(new, old, "") for old, new in X.RENAMED_ONE.items()]
    rows += [("POU5F1", "", "OCT3|OCT4"), *((f"POU2F{i}", "", f"OCT{i}") for i in (1, 2))]
    common = "ACTB AKT1 ALK APC ATM BRCA1 BRCA2 CDK4 CDKN2A EGFR ERBB2 ESR1 GAPDH JAK2 KRAS MDM2 MYC NRAS PIK3CA PTEN RB1 STAT3 TNF TP53 VEGFA"
    rows += [(s, "", "") for s in common.split()]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "symbol string, prev_symbol string, alias_symbol string, row int")
    return build(table.withColumn("status", F.lit("Approved")))


def load(spark: SparkSession, hgnc_glob: str | None = None, xref_glob: str | None = None) -> Registry:
    """The registry of the latest file, by name, of a glob of tab-separated tables; the seed without one."""
    if hgnc_glob is None:
        return seed(spark)
    # names alone are listed; no snapshot but the last is read
    last = spark.read.format("binaryFile").load(hgnc_glob).select(F.max("path")).first()[0]
    multi = spark.read.csv(xref_glob, sep="\t", header=True).toDF("species", "external_id", "current_symbol", "prev_or_alias") if xref_glob else None
    return build(spark.read.csv(last, sep="\t", header=True).withColumn("row", F.monotonically_increasing_id()), multi)


def snapshot_age(path, today):
    """Days from the date in a snapshot's file name to today; null without one."""
    return F.datediff(today, F.regexp_extract(path, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date"))


def drift_note(age, limit: int = 30):
    """A warning if the snapshot is older than limit days."""
    return F.when(age > limit, F.concat(F.lit("registry snapshot is "), age.cast("string"), F.lit(" days old")))


def date_prone(registry: Registry) -> DataFrame:
    """(old, symbol) of previous names that a spreadsheet reads as dates."""
    return registry.prev.where(F.col("old").rlike(X.DATE_PRONE)).select("old", "symbol")


def xref_key(text):
    """struct(space, id) of a text that has the shape of an external identifier; versions are cut off."""
    s, kind = strip(text), external_id_kind(text)
    base = F.when(kind.isin("ensembl", "refseq"), F.substring_index(s, ".", 1)).otherwise(s)
    return F.when(kind.isNotNull(), F.struct(kind.alias("space"), base.alias("id")))


def lookup_ids(df: DataFrame, column: str, registry: Registry, out: str = "gene") -> DataFrame:
    """df with the symbol that a column's external identifier stands for, or null."""
    keyed = df.withColumn("__k", xref_key(F.col(column))).withColumns({"__space": F.col("__k.space"), "__id": F.col("__k.id")})
    names = registry.xref.select(F.col("space").alias("__space"), F.col("id").alias("__id"), F.col("symbol").alias(out))
    return keyed.join(names, ["__space", "__id"], "left").drop("__k", "__space", "__id")
