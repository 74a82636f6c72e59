"""What several operators share: materialised tables, document keys, connected components.

Documents are named by ``doc_key``: rows that repeat both doc_id and text are one document
and get the same result, whatever the operator.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmend.operators import store
from gridmend.operators.store import drop_stash

__all__ = ["all_of", "any_of", "ascii_lower", "components", "crc_mod", "drop_stash", "id_key", "lookup", "named", "quoted", "stash", "table", "text_hash", "unnamed", "worker_keeps"]


#: In a Python worker, by operator: what empties the tables that it keeps from task to task.
_kept: dict[str, Callable[[], None]] = {}


def worker_keeps(operator: str, empty: Callable[[], None]) -> None:
    """Say, as a task begins, that its operator keeps tables in the worker, and empty those of other operators: Spark uses a
    worker again for the next stage, and the tables of all stages of a pipeline would add up in its memory."""
    for other in [o for o in _kept if o != operator]:
        _kept.pop(other)()
    _kept[operator] = empty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stash(df: DataFrame) -> DataFrame:
    """Store df in the shared folder and read it back, see store.stash."""
    out = store.stash(df)
    # the shuffles behind df have no reader any more; Spark's cleaner removes their files once the driver has seen that
    df.sparkSession._jvm.System.gc()
    return out


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with table, which has one row a key and in ``count`` the number of rows that have the key.

    Keys that hold more than a thousandth of all rows, of which there are fewer than a thousand, are broadcast, so that none of
    them lands in one task; the others are shuffled. rows and table are read twice and should be cheap to read."""
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    limit = F.lit(total // 1000 + 1)
    hot, cold = table.where(F.col(count) > limit), table.where(F.col(count) <= limit)
    often = rows.join(F.broadcast(hot), key)
    return often.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under made-up column names with the document key id0, hash, and the made-up name of each column: columns of any
    name stay apart from those that an operator makes. unnamed() takes it back."""
    names = {c: f"column {i}" for i, c in enumerate(docs.columns)}
    keys = [id_key().alias("id0"), text_hash().alias("hash")]
    return docs.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()], *keys), names


def unnamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their own names, of rows made from named(docs)."""
    return rows.select(*[F.col(f"`column {i}`").alias(c) for i, c in enumerate(docs.columns)])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def id_key() -> Column:
    """With text_hash, the document key: doc_id without nulls."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0))


def text_hash() -> Column:
    """Tells apart rows that share a doc_id, and null doc_ids from zero. Never null."""
    return F.xxhash64(F.col("text").cast("string"), F.col("doc_id").isNull())


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a long, b long), undirected, in any order. Returns (node, comp): comp is the smallest
    node of the component; nodes without an edge don't occur. Each round is a partial aggregation
    and one join on the node, so a star of any degree is pre-aggregated before the shuffle; the
    rounds' tables lie in the shared folder. The number of rounds grows with the logarithm of the
    longest path.
    """
    cur = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large-star: every neighbour above u points to the least of u's neighbourhood
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small-star: u and its smaller neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(new)
        drop_stash(cur)
        cur = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h % 1000003), F.bit_xor(h)).first())
