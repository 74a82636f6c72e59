"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings is trained in numpy from confirmed toxic examples and unlabelled text. With
class prior p and logistic loss l, the risk estimator is
    p * mean_P l(+) + max(0, mean_U l(-) - p * mean_P l(-)),
the class-prior-corrected risk whose negative part is kept from falling below zero; when a batch
drives it below zero, the step goes up that part's gradient instead.

The training sample is bounded (``max_positive``, ``max_unlabelled`` rows, those of the least hashes in the whole table). Its
hashed features are made, and the ``max_features`` that set toxic rows apart most are chosen, on the executors; the
driver gets these alone. Scoring reads whole texts in Arrow batches.

Cases: null and empty texts have no words and get the model's bias as score; doc_ids with several
labels are toxic if any label is; without a positive example every score is 0; repeated rows give repeated
results; the columns labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import drop_stash, named, quoted, stash, text_hash, unnamed, worker_keeps

DIMS = 1 << 18
#: Characters of a word's beginning that make a feature of its own: inflected words share it.
PREFIX = 5
#: Times its mean over unlabelled rows that a feature's mean over toxic rows must reach to be used.
LIFT = 2
_WORD = re.compile(r"[^\W\d_]+")
_slots: dict[str, int] = {}
SLOTS_KEPT = 500_000


def forget() -> None:
    """Empty the kept slots. As a function of the module it does so in the worker, whose copy a task's closure hasn't."""
    _slots.clear()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): the slots of each distinct word and of each distinct beginning of a word, with
    log(1 + 100 * share of the words), a density that long and short texts share."""
    counts = Counter(_WORD.findall(text.lower())) if text else {}
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    if len(_slots) > SLOTS_KEPT:
        _slots.clear()
    total, sums, get = sum(counts.values()), {}, _slots.get
    for w, n in counts.items():
        pair = get(w)
        if pair is None:
            crc = lambda mark, x: zlib.crc32((mark + x).encode("utf-8", "surrogatepass")) % DIMS
            pair = _slots[w] = crc("w", w), crc("p", w[:PREFIX])
        for slot in pair:
            sums[slot] = sums.get(slot, 0) + n
    shares = np.fromiter(sums.values(), np.float32, len(sums)) / total
    return np.fromiter(sums, np.int32, len(sums)), np.log1p(100 * shares)


@dataclass
class Model:
    """score = logistic(bias + weights . features)."""

    weights: np.ndarray
    bias: float
    prior: float

    def score(self, text: str | None) -> float:
        if not self.prior:
            return 0.0
        slots, values = features(text)
        z = self.bias + float(self.weights[slots] @ values)
        return float(1 / (1 + np.exp(-z))) if z > -500 else 0.0


class _Rows:
    """Sparse rows in numpy."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n = len(rows)
        sizes = np.array([len(s) for s, _ in rows], np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.slot = np.concatenate([s for s, _ in rows]) if rows else np.zeros(0, np.int32)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)

    def keep(self, column_of: np.ndarray) -> None:
        """Drop the features without a column and renumber the rest."""
        ok = column_of[self.slot] >= 0
        self.row, self.slot, self.value = self.row[ok], column_of[self.slot[ok]], self.value[ok]

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of each feature."""
        one = np.bincount(self.slot, self.value, DIMS) / self.n
        return one, np.bincount(self.slot, self.value**2, DIMS) / self.n - one**2

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.slot] * self.value, self.n)

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.slot, g[self.row] * self.value, dims)


def fit(
    positive: list[tuple[np.ndarray, np.ndarray]],
    unlabelled: list[tuple[np.ndarray, np.ndarray]],
    prior: float,
    steps: int = 200,
    rate: float = 0.08,
    decay: float = 2e-3,
    min_rows: int = 5,
    max_features: int = 300,
) -> Model:
    """Minimise the non-negative risk with Adam over full batches, on the ``max_features`` features, each of at
    least ``min_rows`` sampled rows and denser in toxic rows, whose means differ most in standard errors."""
    weights = np.zeros(DIMS, np.float32)
    if not positive or not 0 < prior < 1:
        return Model(weights, 0.0, 0.0)
    p, u = _Rows(positive), _Rows(unlabelled or positive)
    seen = np.bincount(p.slot, minlength=DIMS) + np.bincount(u.slot, minlength=DIMS)
    means, spreads = zip(*(x.moments() for x in (p, u)), strict=True)
    contrast = (means[0] - means[1]) / np.sqrt(spreads[0] / p.n + spreads[1] / u.n + 1e-12)
    contrast[(seen < min(min_rows, p.n)) | (means[0] < LIFT * means[1])] = 0
    used = np.sort(np.argsort(-contrast, kind="stable")[: min(max_features, np.count_nonzero(contrast))])
    column_of = np.full(DIMS, -1, np.int32)
    column_of[used] = np.arange(len(used))
    p.keep(column_of)
    u.keep(column_of)
    d = len(used)
    w, b = np.zeros(d), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        zp, zu = p.dot(w) + b, u.dot(w) + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, uu = sigmoid(zp) / p.n, sigmoid(zu) / u.n  # gradients of l(-)
        if negative >= 0:
            gp, gu = prior * (-(1 - sigmoid(zp)) / p.n) - prior * up, uu
        else:
            gp, gu = prior * up, -uu
        g = p.back(gp, d) + u.back(gu, d) + decay * prior * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    weights[used] = w
    return Model(weights, float(b), float(prior))


def sample_of(docs: DataFrame, labels: DataFrame, usable: Column, max_positive: int, max_unlabelled: int) -> DataFrame:
    """(doc_id, hash, part): the rows of docs to train on, those of the least hashes of their doc_id: part 1 of toxic rows,
    part 0 of all usable rows. It has max_positive + max_unlabelled rows at most, whatever the number of documents."""
    rows = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id", text_hash().alias("hash"), F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)).alias("draw"))
    toxic = rows.join(labels.where(usable & (F.col("toxic") == 1)).select("doc_id").distinct(), "doc_id")

    def least(rows: DataFrame, n: int) -> DataFrame:
        # four times as many as needed, so that repeated rows are told apart among a few
        share = min(1.0, 4 * n / max(1, rows.count()))
        return rows.where(F.col("draw") < int(share * (1 << 40))).distinct().orderBy("draw", "doc_id", "hash").limit(n).select("doc_id", "hash")

    positive, plain = least(toxic, max_positive), least(rows, max_unlabelled)
    return positive.withColumn("part", F.lit(1)).unionByName(plain.withColumn("part", F.lit(0)))


def contrasting(made: DataFrame, min_rows: int, max_features: int) -> list[int]:
    """The slots that fit would use, found on the executors. made: (part, slots, values)."""
    sizes = {r["part"]: r["count"] for r in made.groupBy("part").count().collect()}  # two rows
    p, u = (F.lit(float(max(1, sizes.get(k, 0)))) for k in (1, 0))
    each = made.select("part", F.explode(F.arrays_zip("slots", "values")).alias("z")).select("part", "z.slots", F.col("z.values").cast("double").alias("v"))
    of = lambda part, x: F.sum(F.when(F.col("part") == part, x).otherwise(0.0))
    v = F.col("v")
    sums = each.groupBy("slots").agg(F.count("*").alias("seen"), of(1, v).alias("p1"), of(1, v * v).alias("p2"), of(0, v).alias("u1"), of(0, v * v).alias("u2"))
    mp, mu = F.col("p1") / p, F.col("u1") / u
    spread = F.sqrt((F.col("p2") / p - mp * mp) / p + (F.col("u2") / u - mu * mu) / u + 1e-12)
    used = sums.where((F.col("seen") >= min(min_rows, sizes.get(1, 0))) & (mp >= LIFT * mu) & (mp > mu)).select("slots", ((mp - mu) / spread).alias("contrast"))
    return [r[0] for r in used.orderBy(F.desc("contrast"), "slots").limit(max_features).collect()]


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, max_positive: int = 3000, max_unlabelled: int = 9000, min_rows: int = 5, max_features: int = 300
) -> Model:
    """Fit on rows of docs where ``usable`` (a condition on doc_id) holds; labels have doc_id and toxic. The
    class prior is the toxic share of the usable labelled rows. At most ``max_positive`` toxic and ``max_unlabelled`` other rows are
    drawn, by least hash, so that a rerun draws the same; of their features ``max_features`` are used. Only these reach the driver."""
    marks = labels.where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, marked = marks.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not toxic or not marked:
        return fit([], [], 0.0)
    chosen = stash(sample_of(docs, labels, usable, max_positive, max_unlabelled))
    rows = docs.select("doc_id", text_hash().alias("hash"), F.col("text").cast("string").alias("text"))
    texts = rows.join(F.broadcast(chosen), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash", "part"]).select("part", "text")  # chosen is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("toxicity", forget)
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
                ["part", "slots", "values"],
            )

    made = stash(texts.mapInArrow(run, "part int, slots array<int>, values array<float>"))
    used = np.array(sorted(contrasting(made, min_rows, max_features)), np.int32)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.asarray(s.values), np.asarray(v.values)) for s, v in zip(batch.column(1), batch.column(2), strict=True)]
            kept = [(s[k], v[k]) for s, v in pairs for k in [np.isin(s, used)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in kept], pa.list_(pa.int32())), pa.array([v for _, v in kept], pa.list_(pa.float32()))],
                ["part", "slots", "values"],
            )

    sets: tuple[list, list] = ([], [])
    for r in made.mapInArrow(reduce, made.schema).toLocalIterator():
        sets[r[0]].append((np.array(r[1], np.int32), np.array(r[2], np.float32)))
    drop_stash(chosen)
    drop_stash(made)
    return fit(sets[1], sets[0], min(0.95, toxic / marked), min_rows=min_rows, max_features=max_features)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a column toxicity (0 to 1) of the column ``text``, last; a column of that name is replaced."""
    fields = [f for f in docs.schema.fields if f.name != "toxicity"]
    names = [f.name for f in fields]
    cols = docs.select(*[F.col(quoted(n)) for n in names])
    schema = cols.withColumn("toxicity", F.lit(0.0)).schema
    used = np.flatnonzero(model.weights)
    weights, bias, prior = model.weights[used], model.bias, model.prior
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("toxicity", forget)
        m = Model(np.zeros(DIMS, np.float32), bias, prior)
        m.weights[used] = weights
        for batch in batches:
            scores = pa.array([m.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*names, "toxicity"])

    return cols.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below ``limit``, with all of their columns, whatever their names."""
    rows, names = named(docs)
    rows = rows.withColumn(names["text"], F.col(f"`{names['text']}`").cast(docs.schema["text"].dataType))
    return unnamed(score_documents(rows, model, names["text"]).where(F.col("toxicity") < limit), docs)
