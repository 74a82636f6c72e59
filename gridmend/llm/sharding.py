"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by a key: the CRC-32 of the text and then of the doc_id, so equal texts lie together.
  1. A size-weighted sample of keys is drawn: a record is drawn with a probability proportional to its
     bytes, by a hash. The quantiles of the sample are the splitters.
  2. Records are range-partitioned by binary search in the splitters. Ranges that turn out overfull in bytes
     are subdivided, all in one pass, by a second sample drawn from them alone; what then is overfull holds one key, a third
     of all rows at worst, and is dealt into parts by a hash of its rows.
  3. The splitters at which the shards part are the quantiles of the whole: those nearest to its equal parts in bytes. So a shard
     is a run of ranges, contiguous in the key, and shards differ by about one range, a part in RANGES of a shard.
  4. A row's slot is its number in its range, counted range by range, after the rows of the shard's ranges before it.

What reaches the driver are sampled keys and the ranges' totals: their number is set by RANGES and OVERSAMPLE and does not grow
with the documents.

Cases: null texts count 1 byte; null doc_ids are keys like others; repeated rows are told apart by slot; equal texts lie in one
shard or in neighbouring ones, where a bound between shards falls among them; a record larger than a shard is a shard's most of
it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmend.llm.common import stash

#: Ranges for each shard.
RANGES = 128
#: Sampled keys for each range.
OVERSAMPLE = 24
#: Times the mean from which a range is overfull.
OVERFULL = 2.0


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, row) of every row; row tells repeated rows apart."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    low = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return rows.withColumn("key", (F.col("text_crc32") - F.lit(1 << 31)) * F.lit(1 << 32) + low)


def sample(rows: DataFrame, share: Column, seed: int) -> list[tuple[int, int]]:
    """Sorted (range, key) of rows (range, key, size, ...), drawn with the probability size * share."""
    u = F.pmod(F.xxhash64("key", "doc_id", "row", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted(tuple(r) for r in rows.where(u < F.col("size") * share).select("range", "key").toLocalIterator())


def quantiles(keys: list[int], parts: int) -> list[int]:
    """Distinct splitters at the quantiles of sorted keys."""
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _array(numbers: list, kind: str) -> Column:
    # one text that folds into one array constant, where a list would be a node of the plan for each number
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters at or below key, by binary search in one constant array."""
    if not splitters:
        return F.lit(0)
    array = _array(splitters, "bigint")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.get(array, mid) <= key)
        return F.struct(
            F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length() + 1))
    return F.aggregate(steps, start, halve)["lo"]


def totals_of(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(range, part, bytes, rows) of each part of a range, in order."""
    return sorted(tuple(r) for r in rows.groupBy("range", "part").agg(F.sum("size"), F.count("*")).toLocalIterator())


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Where to cut a sequence of sizes into shards: the edges nearest to the equal parts of their sum."""
    edges = [0, *accumulate(sizes)]
    out = []
    for s in range(1, shards):
        want = edges[-1] * s / shards
        i = bisect_left(edges, want)
        out.append(i - 1 if i and want - edges[i - 1] <= edges[min(i, len(sizes))] - want else min(i, len(sizes)))
    return out


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of docs, near-equal in bytes."""
    spark = docs.sparkSession
    rows = stash(records(docs))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * RANGES
    limit = OVERFULL * total / ranges
    drawn = sample(rows.withColumn("range", F.lit(0)), F.lit(ranges * OVERSAMPLE / max(1, total)), 1)
    splitters = quantiles([k for _, k in drawn], ranges)
    out = stash(rows.withColumns({"range": range_of(F.col("key"), splitters), "part": F.lit(0)}))
    totals = totals_of(out)
    parts = [1] * (len(splitters) + 1)
    if any(size > limit for _, _, size, _ in totals):
        wanted = {r: 2 * int(size / limit) + 2 for r, _, size, _ in totals if size > limit}
        share = {r: wanted[r] * OVERSAMPLE / size for r, _, size, _ in totals if r in wanted}
        shares = F.get(_array([share.get(r, 0.0) for r in range(len(splitters) + 1)], "double"), F.col("range"))
        inside: dict[int, list[int]] = {}
        for r, key in sample(out, shares, 2):
            inside.setdefault(r, []).append(key)
        splitters = sorted({*splitters, *(k for r, keys in inside.items() for k in quantiles(keys, wanted[r]))})
        # a key that fills a range has splitters on both sides, so that what is left of it is that key alone
        heavy = [k for r, keys in inside.items() for k in {x for x in keys if keys.count(x) > OVERSAMPLE}]
        splitters = sorted({*splitters, *heavy, *(k + 1 for k in heavy)})
        out = stash(out.withColumn("range", range_of(F.col("key"), splitters)))
        parts = [1] * (len(splitters) + 1)
        for r, _, size, _ in totals_of(out):
            if size > limit:
                parts[r] = int(size / limit) + 1
        part = F.pmod(F.xxhash64("key", "doc_id", "row"), F.get(_array(parts, "int"), F.col("range"))).cast("int")
        out = out.withColumn("part", part)
        totals = totals_of(out)
    bounds = cuts([size for _, _, size, _ in totals], shards)
    places, shard, before = [], 0, 0
    for i, (r, p, _, n) in enumerate(totals):
        while shard < len(bounds) and i >= bounds[shard]:
            shard, before = shard + 1, 0
        places.append((r, p, shard, before))
        before += n
    starts = spark.createDataFrame(places, "range int, part int, shard int, before long")
    number = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "row")).cast("long")
    placed = out.withColumn("number", number).join(F.broadcast(starts), ["range", "part"])  # starts has a row for each range
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).alias("slot"))
