"""Language identification of code-switched text by a linear-chain conditional random field.

A sequence is a line's words; a word's state is its language. Emissions sum learned weights of the word's
features: beginnings and endings of 1 to 3 characters, character 2- and 3-grams, the word itself if
the lexicon has it, and the set of languages in whose training text the lexicon has seen it.
Transitions are learned with them, by gradient ascent on the conditional likelihood in numpy. Training lines carry
the language of their document; since those hold one language each, a share of the training sequences
is spliced from two lines, so that the transitions learn what a switch costs.

Inference is forward-backward over whole lines, all lines of a batch at once. A document's language
is the one with the most expected letters, its score the share of them.

Cases: null texts and texts without a letter are ``und`` with score 0; without a training row every text is ``und``;
repeated rows give repeated results; no column but text is an input of a prediction.
"""

from __future__ import annotations

import random
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMS = 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 400_000
#: Cells (words and padding) that a forward-backward pass holds.
CELLS = 1_000_000


def words_of(line: str) -> list[str]:
    """The words of a line, in lower case: runs of letters. Runs of other numerals are no words."""
    words = _WORD.findall(line.lower())
    return words if "".join(words).isalpha() else [w for w in words if any(map(str.isalpha, w))]


_slot: dict[str, dict[str, int]] = {"<": {}, ">": {}, "g": {}}


def _slots(mark: str, parts: list[str]) -> list[int]:
    """Slots of substrings of one kind, each hashed once; there are few distinct ones."""
    known = _slot[mark]
    if len(known) > 200_000:
        known.clear()
    out = list(map(known.get, parts))
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                out[i] = known[parts[i]] = zlib.crc32((mark + parts[i]).encode("utf-8", "surrogatepass")) % DIMS
    return out


def word_features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Slots of a word's features."""
    n = len(word)
    grams = {word[i : i + 2] for i in range(n - 1)} | {word[i : i + 3] for i in range(n - 2)}
    out = _slots("<", [word[:1], word[:2], word[:3]]) + _slots(">", [word[-1:], word[-2:], word[-3:]]) + _slots("g", list(grams))
    if seen := lexicon.get(word):
        out += [zlib.crc32(x.encode()) % DIMS for x in (f"w{word}", f"l{seen}")]
    return out


def forward_backward(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [N, T, L], expected transitions [L, L] and log-likelihood normalisers [N].

    emit: [N, T, L] scores, rows sorted by falling length; trans: [L, L] scores. Products are scaled at each
    step, so that sequences of any length neither overflow nor vanish."""
    n, steps, labels = emit.shape
    top = emit.max(axis=2, keepdims=True)
    pot = np.exp(emit - top)
    move = np.exp(trans)
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # rows that reach step t
    alpha = np.zeros_like(pot)
    scale = np.ones((n, steps))
    a = pot[:, 0]
    for t in range(steps):
        k = active[t]
        if t:
            a = (alpha[:k, t - 1] @ move) * pot[:k, t]
        else:
            a = a[:k]
        s = a.sum(axis=1)
        alpha[:k, t] = a / s[:, None]
        scale[:k, t] = s
    beta = np.ones_like(pot)
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        beta[:k, t] = ((pot[:k, t + 1] * beta[:k, t + 1]) @ move.T) / scale[:k, t + 1, None]
    inside = np.arange(steps) < lengths[:, None]
    gamma = alpha * beta * inside[:, :, None]
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
    both = inside[:, 1:]
    right = np.where(both[:, :, None], pot[:, 1:] * beta[:, 1:] / scale[:, 1:, None], 0)
    pairs = move * np.einsum("nti,ntj->ij", alpha[:, :-1], right)
    z = (np.log(scale) + top[:, :, 0]) * inside
    return gamma, pairs, z.sum(axis=1)


class LanguageCRF:
    """Weights [DIMS, L], transitions [L, L], the languages and the lexicon."""

    def __init__(self, languages: list[str], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, str]) -> None:
        self.languages, self.weights, self.trans, self.lexicon = languages, weights, trans, lexicon
        self.rows: dict[str, int] = {}
        self.emissions = np.zeros((1024, len(languages)))

    def learn(self, words: set[str]) -> None:
        """Fill emission rows for words that have none yet."""
        new = sorted(words.difference(self.rows))
        if not new:
            return
        at = len(self.rows)
        while at + len(new) > len(self.emissions):
            self.emissions = np.concatenate([self.emissions, np.zeros_like(self.emissions)])
        slots = [word_features(w, self.lexicon) for w in new]
        starts = np.cumsum([0, *map(len, slots)])[:-1]
        self.emissions[at : at + len(new)] = np.add.reduceat(self.weights[np.concatenate(slots)], starts)
        self.rows.update(zip(new, range(at, at + len(new)), strict=True))

    def row_ids(self, words: list[str]) -> list[int]:
        """Rows of self.emissions for words, computed once for each distinct word."""
        self.learn(set(words))
        return [self.rows[w] for w in words]

    def marginals(self, lines: list[list[int]]) -> list[np.ndarray]:
        """[words, L] of each line of emission rows."""
        out: list[np.ndarray] = [np.zeros((0, len(self.languages)))] * len(lines)
        order = sorted((i for i, x in enumerate(lines) if x), key=lambda i: -len(lines[i]))
        at = 0
        while at < len(order):
            longest = len(lines[order[at]])
            part = order[at : at + max(1, CELLS // longest)]
            # rows much shorter than the longest wait for the next pass
            part = [i for i in part if 2 * len(lines[i]) >= longest] or part[:1]
            at += len(part)
            lengths = np.array([len(lines[i]) for i in part])
            ids = np.zeros((len(part), longest), np.int64)
            ids[np.arange(longest) < lengths[:, None]] = np.concatenate([lines[i] for i in part])
            gamma, _, _ = forward_backward(self.emissions[ids], self.trans, lengths)
            for i, g, n in zip(part, gamma, lengths.tolist(), strict=True):
                out[i] = g[:n]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if len(self.rows) > WORDS_KEPT:
            self.rows.clear()
        found = [(i, w) for i, text in enumerate(texts) for line in (text or "").split("\n") if (w := words_of(line))]
        self.learn(set().union(*(w for _, w in found)))
        row = self.rows.__getitem__
        owner = [i for i, _ in found]
        lines = [list(map(row, w)) for _, w in found]
        sizes = [np.fromiter(map(len, w), np.float64, len(w)) for _, w in found]
        totals = np.zeros((len(texts), max(1, len(self.languages))))
        if self.languages:
            for i, g, n in zip(owner, self.marginals(lines), sizes, strict=True):
                totals[i] += n @ g
        weight = totals.sum(axis=1)
        best = totals.argmax(axis=1)
        return [
            (self.languages[b], min(1.0, float(totals[i, b] / w))) if w > 0 else ("und", 0.0)
            for i, (b, w) in enumerate(zip(best.tolist(), weight.tolist(), strict=True))
        ]


def fit(rows: list[tuple[str, str]], max_words: int = 150_000, steps: int = 60, rate: float = 0.3, decay: float = 1e-5, spliced: float = 0.5) -> LanguageCRF:
    """Train on (text, language) rows. Lines are drawn evenly over languages up to ``max_words`` words in
    all; ``spliced`` is the share of sequences made of two lines of different languages."""
    rng = random.Random(7)
    languages = sorted({y for _, y in rows})
    index = {y: k for k, y in enumerate(languages)}
    by: dict[str, list[list[str]]] = {y: [] for y in languages}
    seen: dict[str, Counter] = {y: Counter() for y in languages}
    for text, y in rows:
        for line in (text or "").split("\n"):
            if w := words_of(line):
                by[y].append(w)
                seen[y].update(w)
    lexicon: dict[str, list[str]] = {}
    for y in languages:
        for w, n in seen[y].items():
            if n >= 3:
                lexicon.setdefault(w, []).append(y)
    sets = {w: ",".join(ys) for w, ys in lexicon.items()}
    sequences: list[tuple[list[str], list[int]]] = []
    for y in languages:
        rng.shuffle(by[y])
        left = max_words // max(1, len(languages))
        for line in by[y]:
            if left <= 0:
                break
            # a very long line is cut into sequences, whole
            for lo in range(0, len(line), 60):
                part = line[lo : lo + 60]
                sequences.append((part, [index[y]] * len(part)))
            left -= len(line)
    rng.shuffle(sequences)
    half = int(len(sequences) * spliced) // 2
    joined = [(a + c, b + d) for (a, b), (c, d) in zip(sequences[:half], sequences[half : 2 * half], strict=True)]
    sequences = sorted(joined + sequences[2 * half :], key=lambda s: -len(s[0]))
    model = LanguageCRF(languages, np.zeros((DIMS, len(languages))), np.zeros((len(languages),) * 2), sets)
    if not sequences or len(languages) < 2:
        return model
    vocabulary = sorted({w for s, _ in sequences for w in s})
    number = {w: i for i, w in enumerate(vocabulary)}
    slots = [word_features(w, sets) for w in vocabulary]
    word = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slot = np.concatenate([np.array(s) for s in slots])
    used, slot = np.unique(slot, return_inverse=True)
    k = len(languages)
    w, trans = np.zeros((len(used), k)), np.zeros((k, k))
    lengths = np.array([len(s) for s, _ in sequences])
    ids = np.zeros((len(sequences), lengths[0]), np.int64)
    gold = np.zeros((len(sequences), lengths[0]), np.int64)
    inside = np.arange(lengths[0]) < lengths[:, None]
    ids[inside] = [number[x] for s, _ in sequences for x in s]
    gold[inside] = [x for _, s in sequences for x in s]
    total = lengths.sum()
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
    flat_ids, flat_gold = ids[inside], gold[inside]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    for t in range(1, steps + 1):
        emissions = np.stack([np.bincount(word, w[slot, j], len(vocabulary)) for j in range(k)], axis=1)
        gamma, pairs, _ = forward_backward(emissions[ids], trans, lengths)
        off = -gamma[inside]
        off[np.arange(len(off)), flat_gold] += 1
        per_word = np.stack([np.bincount(flat_ids, off[:, j], len(vocabulary)) for j in range(k)], axis=1)
        gw = np.stack([np.bincount(slot, per_word[word, j], len(used)) for j in range(k)], axis=1) / total - decay * w
        gt = (true_pairs - pairs) / total - decay * trans
        for x, g, a, b in ((w, gw, 0, 1), (trans, gt, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            x += rate * (1 - t / (steps + 1)) * (moments[a] / (1 - 0.9**t)) / (np.sqrt(moments[b] / (1 - 0.99**t)) + 1e-8)
    model.weights[used] = w
    model.trans = trans
    return model


def train(docs: DataFrame, usable: Column, max_rows: int = 400, max_chars: int = 20_000) -> LanguageCRF:
    """Fit on a sample of at most ``max_rows`` rows of each language, those of the least hashes of their doc_id among all rows of
    docs where ``usable`` (a condition on doc_id) holds and lang is not null, so that a rerun draws the same; every language takes
    part. Texts of more than ``max_chars`` characters would crowd out the rest of the sample and are left out of it; scoring reads them whole."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000_007)) / 1_000_000_007
    shares = [F.lit(x) for y, n in sorted(counts.items()) for x in (y, 2.0 * max_rows / n)]
    share = F.try_element_at(F.create_map(*shares), F.col("lang")) if shares else F.lit(0.0)
    # about twice as many as wanted, of which the least stay
    drawn = rows.select("text", "lang", draw.alias("draw")).where(F.col("draw") < share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= max_rows).select("text", "lang")
    return fit(sorted((r["text"], r["lang"]) for r in drawn.toLocalIterator()))


_models: dict[str, LanguageCRF] = {}


def _shared(docs: DataFrame, model: LanguageCRF):
    """A function that gives the model on an executor; reused workers keep the rows of words they know."""
    used = np.flatnonzero(model.weights.any(axis=1))
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, used, model.weights[used], model.trans, model.lexicon))

    def get() -> LanguageCRF:
        if name not in _models:
            languages, at, rows, trans, lexicon = shared.value
            weights = np.zeros((DIMS, len(languages)))
            weights[at] = rows
            _models.clear()
            _models[name] = LanguageCRF(languages, weights, trans, lexicon)
        return _models[name]

    return get


def label_documents(docs: DataFrame, model: LanguageCRF) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs."""
    get = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = get()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = crf.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def label_document_words(docs: DataFrame, model: LanguageCRF) -> DataFrame:
    """(doc_id, words array<struct<word, lang, score>>) of every row of docs: the language of each word of its text, with
    its marginal probability; no words for null texts."""
    get = _shared(docs, model)
    word = pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = get()
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                found = [[dict(zip(("word", "lang", "score"), w, strict=True)) for w in label_words(t or "", crf)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(word))], ["doc_id", "words"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, words array<struct<word:string,lang:string,score:double>>")


def label_words(text: str, model: LanguageCRF) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of every word of a text."""
    out = []
    for line in text.split("\n"):
        if words := words_of(line):
            (g,) = model.marginals([model.row_ids(words)])
            out += [(w, model.languages[k], float(p[k])) for w, p, k in zip(words, g, g.argmax(axis=1), strict=True)]
    return out
