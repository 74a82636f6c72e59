"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints within 3 differing bits disagree in at most 3 of their 8 bytes, so they share at
least 5 positional bytes. The index lists fingerprints by positional bytes; a list holds the
fingerprints that agree at four positions. Fourteen sets of four positions suffice to have one inside any five: each
half of the fingerprint, and two positions of each half whose pairs belong to the same way to pair a half off.
In a list the shared positional bytes of a pair are tallied, pairs that reach the guaranteed 5 are
kept, and those are verified by their Hamming distance.

Scale: equal fingerprints are one entry (copies never form pairs) and find their component by a lookup that broadcasts the few
most frequent; a list is kept only if it has two entries; a list of any length is dealt as pairs of blocks of BLOCK entries, each pair a task of
bounded size, and a block emits the links of a spanning forest instead of all pairs, which keeps
every component whole. Components are found by the distributed union-find in common.py.

Cases: no words gives fingerprint zero, linked like any other; null text counts as no words; null
doc_ids group with equal nulls and never are the smallest unless all are null; repeated rows give
repeated results; very long texts are hashed whole; one_per_group passes other columns, whatever their names, unchanged, and
group_documents leaves them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import components, lookup, named, stash, text_hash, unnamed

#: Fixed by the fingerprints: bits that may differ, and the shared positional bytes that this guarantees.
MAX_BITS, MIN_SHARED = 3, 5
#: The three ways to pair off the positions of a half, and the sets of positions whose bytes name a list.
PAIRINGS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
QUADS = [(0, 1, 2, 3), (4, 5, 6, 7), *((*a, b[0] + 4, b[1] + 4) for way in PAIRINGS for a in way for b in way)]
#: Entries of a list that one side of a task holds.
BLOCK = 4096
#: Lists up to this length are compared many lists at once.
SMALL = 48


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text in UTF-8."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # bytes: only A-Z change, only ASCII blanks part
    if not words:
        return 0
    if len(words) < 3:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxh64_intdigest(b" ".join(w), 42) for w in zip(words, words[1:], words[2:], strict=False)]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' doc_id with fp, the fingerprint as a signed long, and text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    cols = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").cast("binary").alias("text")
    )
    return cols.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs share MIN_SHARED positional bytes and then differ in MAX_BITS bits at most."""
    diff = x ^ y
    shared = np.zeros(diff.shape, np.int8)
    for k in range(8):
        shared += (diff >> np.uint64(8 * k)) & np.uint64(255) == 0
    return (shared >= MIN_SHARED) & (np.bitwise_count(diff) <= MAX_BITS)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, member) of the components among fps, by growing each from its first entry."""
    left, out = np.unique(fps), []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for x in front:
                rest = np.flatnonzero(~hit)
                hit[rest[_similar(left[rest], x)]] = True
            front, left = left[hit], left[~hit]
            out += [(root, m) for m in front]
    return out


def list_links(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Links among entries with equal key; keys are sorted. Returns an array of pairs."""
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[new, len(keys)])
    size = np.repeat(sizes, sizes)
    out = []
    small = size <= SMALL
    k, f = keys[small], fps[small]
    for d in range(1, SMALL):
        same = k[d:] == k[:-d] if d < len(k) else np.zeros(0, bool)
        if not same.any():
            break
        a, b = f[:-d][same], f[d:][same]
        ok = _similar(a, b)
        out.append(np.stack([a[ok], b[ok]], axis=1))
    for at, n in zip(new[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        if links := _forest(fps[at : at + n]):
            out.append(np.array(links, np.uint64))
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of a set of links whose components are those of all pairs within MAX_BITS.

    fps: distinct fingerprints in column fp."""
    byte = [F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255) for k in range(8)]
    keys = [F.lit(i << 32) + sum((byte[k] * F.lit(1 << 8 * at) for at, k in enumerate(quad)), F.lit(0)) for i, quad in enumerate(QUADS)]
    entries = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = stash(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    entries = lookup(entries, lists, "key", "n").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
            lambda j: F.least(j, block) * F.col("blocks") + F.greatest(j, block),
        )
    )
    entries = entries.select("key", F.explode(pairs).alias("pair"), "fp")
    dealt = entries.repartition("key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(part: np.ndarray) -> pa.RecordBatch:
            tag = np.cumsum(np.r_[0, (part[1:, :2] != part[:-1, :2]).any(axis=1)])
            found = list_links(tag, part[:, 2].view(np.uint64)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(3)], axis=1)
            part = np.ascontiguousarray(np.concatenate([*held, part]))
            last = np.flatnonzero((part[:, :2] != part[-1, :2]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield done(np.ascontiguousarray(part[:cut]))
            held = [part[cut:]]  # the last list may go on in the next batch; it is bounded by its two blocks
        if held:
            yield done(np.ascontiguousarray(held[0]))

    return dealt.mapInArrow(run, "a long, b long")


def group_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row of docs; root is a fingerprint that names the
    component, component_id the smallest doc_id reachable over links, null if the component has none."""
    prints = stash(fingerprints(docs))
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    comps = components(links(distinct.select("fp")))
    roots = comps.join(distinct, comps.node == distinct.fp).groupBy("comp").agg(F.min("first_id").alias("component_id"))
    member = comps.join(roots, "comp").select(F.col("node").alias("fp"), "comp", "component_id")
    whole = distinct.join(member, "fp", "left").select(
        "fp", "n", F.coalesce("comp", "fp").alias("root"), F.when(F.col("comp").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return lookup(prints, stash(whole), "fp", "n").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of docs with one document of each group: the one of the smallest doc_id, and of rows
    that share that doc_id the one of the smallest text hash; of repeated rows one."""
    groups = group_documents(docs)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("text_hash").alias("hash"))
    best = stash(groups.groupBy("root").agg(F.min(rank).alias("best")).select("best.id0", "best.hash"))
    kept = named(docs)[0].join(best, ["id0", "hash"], "left_semi")
    return unnamed(kept.dropDuplicates(["id0", "hash"]), docs)
