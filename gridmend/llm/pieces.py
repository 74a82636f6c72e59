"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: a score-ordered agenda of adjacent symbol pairs. The text is normalised as the model asks
(identity here: a dummy prefix, blanks written as U+2581), cut into units, and each unit starts as
its characters; an agenda holds every adjacent pair that is a piece, best score first, leftmost on
ties; merging a pair adds its two new neighbours. What is no piece in the end is spelled in bytes.

No piece holds U+2581 behind another character, so no merge crosses the start of a run of blanks:
units are ``blanks + word``, and encoding unit by unit equals encoding the whole. Results per
unit are kept in a bounded table, since words repeat; the agendas of all new short units of a batch
advance together in numpy, one pop a round, and longer units use a heap each.

Cases: null and empty texts give no ids and an empty decoding; very long texts are encoded whole;
repeated rows give repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridmend.llm.common import worker_keeps

BLANK = "▁"
_UNIT = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
#: Units kept per worker process (some 250 MB); the table starts anew when full.
UNITS_KEPT = 700_000
#: Units of more characters are encoded one by one.
UNIT_CHARS_KEPT = 48
NO_PAIR = np.iinfo(np.int32).max


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if wire == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, wire, value


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str) -> None:
        import struct

        with open(model_file, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        self.prefix, self.squeeze, self.rules = True, True, ""
        for field, _, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, 1
                for f, _, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif field == 3:
                for f, _, v in _fields(value):
                    if f == 1:
                        self.rules = v.decode()
                    elif f == 3:
                        self.prefix = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
        if self.rules != "identity" or self.squeeze:
            raise ValueError("only identity normalisation that keeps blanks is supported")
        if any(k in (4, 5) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece crosses the start of a run of blanks")
        normal = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1]
        self.ids = dict(normal)
        self.rank = {p: (-self.scores[i]) for p, i in normal}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        if len(self.bytes) != 256:
            raise ValueError("byte fallback needs 256 byte pieces")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if not self.prefix:
            raise ValueError("a model without a dummy prefix is not supported")
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self._tabulate()

    def encode_unit(self, unit: str) -> list[int]:
        """Merge from the agenda until it is empty."""
        rank, ids = self.rank, self.ids
        if unit in ids and len(unit) == 1:
            return [ids[unit]]
        sym: list[str | None] = list(unit)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            pair = unit[i : i + 2]
            if (r := rank.get(pair)) is not None:
                agenda.append((r, i, i + 1, pair))
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, j, pair = pop(agenda)
            if sym[i] is None or right[i] != j or sym[i] + sym[j] != pair:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j] = pair, None
            k = right[j]
            right[i] = k
            if k >= 0:
                left[k] = i
                if (r := rank.get(p := pair + sym[k])) is not None:
                    push(agenda, (r, i, k, p))
            if (h := left[i]) >= 0 and (r := rank.get(p := sym[h] + pair)) is not None:
                push(agenda, (r, h, i, p))
        out: list[int] = []
        for s in sym:
            if s is not None:
                if (x := ids.get(s)) is not None:
                    out.append(x)
                else:
                    out.extend(self.bytes[b] for b in s.encode("utf-8", "surrogatepass"))
        return out

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return _UNIT.findall((BLANK if self.prefix else "") + text.replace(" ", BLANK))

    def encode(self, text: str | None) -> list[int]:
        return [x for u in self.units(text or "") for x in self.encode_unit(u)]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8, blanks restored, the dummy prefix off."""
        raw = b"".join(
            bytes([self.byte_of[i]]) if i in self.byte_of else b"" if self.kinds[i] == 3 else self.pieces[i].encode()
            for i in ids
        )
        text = raw.decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def learn(self, keys: set[str]) -> None:
        """Encode the units of these keys (units without their first blank) into the kept tables."""
        short: dict[int, list[str]] = {}
        for key in keys:
            if len(key) < UNIT_CHARS_KEPT:
                short.setdefault(len(key) + 1, []).append(key)
            else:
                self._keep(key, self.encode_unit(BLANK + key))
        for n, group in short.items():
            for lo in range(0, len(group), 50_000):
                self._learn_equal(n, group[lo : lo + 50_000])

    def _keep(self, key: str, ids: list[int]) -> None:
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids)
        self.ids_of[key] = ",".join(map(str, ids))
        self.text_of[key] = raw.decode("utf-8", "replace").replace(BLANK, " ")

    def _learn_equal(self, n: int, keys: list[str]) -> None:
        """The agendas of many units of n characters at once: each row pops its best pair, leftmost on
        ties, until none is left."""
        points = np.frombuffer("".join(BLANK + k for k in keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym = self.char_id[np.minimum(points, len(self.char_id) - 1)].reshape(len(keys), n)
        odd = (sym < 0).any(axis=1)
        for i in np.flatnonzero(odd):
            self._keep(keys[i], self.encode_unit(BLANK + keys[i]))
        rows = np.flatnonzero(~odd)
        sym = sym[rows]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks, merged = self._pairs(sym[:, :-1], sym[:, 1:])
        while len(rows) and sym.shape[1] > 1:
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            live = ranks[each, at] < NO_PAIR
            if not live.all():
                done.append((rows[~live], sym[~live]))
                rows, sym, ranks, merged, at = rows[live], sym[live], ranks[live], merged[live], at[live]
                each = each[: len(rows)]
            if not len(rows):
                break
            new = merged[each, at]
            gone = np.arange(sym.shape[1]) != (at + 1)[:, None]
            sym[each, at] = new
            sym = sym[gone].reshape(len(rows), -1)
            ranks = ranks[gone[:, 1:]].reshape(len(rows), -1)
            merged = merged[gone[:, 1:]].reshape(len(rows), -1)
            for shift in (-1, 0):  # the pairs that the new symbol ends and begins
                i = at + shift
                ok = np.flatnonzero((i >= 0) & (i < sym.shape[1] - 1))
                r, m = self._pairs(sym[ok, i[ok]], sym[ok, i[ok] + 1])
                ranks[ok, i[ok]], merged[ok, i[ok]] = r, m
        done.append((rows, sym))
        names, pieces = self.names, self.shown
        for rows, sym in done:
            for i, ids in zip(rows.tolist(), sym.tolist(), strict=True):
                key = keys[i]
                self.ids_of[key] = ",".join([names[x] for x in ids])
                self.text_of[key] = "".join([pieces[x] for x in ids])

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of adjacent symbols; NO_PAIR where they don't merge."""
        code = a.astype(np.int64) * len(self.pieces) + b
        slot = _slot(code, self.bits)
        found = np.full(code.shape, -1, np.int32)
        for _ in range(self.probes):
            found = np.where(self.codes[slot] == code, self.targets[slot], found)
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return np.where(found >= 0, self.order[found], NO_PAIR), found

    def _tabulate(self) -> None:
        """Lookup tables of the many-units agenda."""
        chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        if any(c not in chars for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")
        self.char_id = np.full(max(map(ord, chars)) + 2, -1, np.int32)
        for c, i in chars.items():
            self.char_id[ord(c)] = i
        for b in range(128):  # an ASCII character that is no piece is one byte piece, which never merges
            if self.char_id[b] < 0:
                self.char_id[b] = self.bytes[b]
        scores = np.array(self.scores)
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        codes, targets, ids = [], [], self.ids
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                x, y = ids.get(piece[:k]), ids.get(piece[k:])
                if x is not None and y is not None:
                    codes.append(x * len(self.pieces) + y)
                    targets.append(i)
        self.bits = 21
        size = 1 << self.bits
        self.codes, self.targets, self.probes = np.full(size, -1, np.int64), np.full(size, -1, np.int32), 1
        slots = _slot(np.array(codes, np.int64), self.bits).tolist()
        taken: dict[int, int] = {}
        for code, target, slot in zip(codes, targets, slots, strict=True):
            tries = 1
            while slot in taken:
                slot, tries = (slot + 1) & (size - 1), tries + 1
            taken[slot] = code
            self.codes[slot], self.targets[slot] = code, target
            self.probes = max(self.probes, tries)
        self.names = [str(i) for i in range(len(self.pieces))]
        self.shown = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p.replace(BLANK, " ") for i, p in enumerate(self.pieces)]

    def keys(self, text: str) -> list[str]:
        """The units of a text, each without its first blank."""
        if not text:
            return []
        if BLANK not in text and "" not in (words := text.split(" ")):
            return words
        return [u[1:] for u in self.units(text)]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each text. The decoding joins that of each
        unit's ids: a unit spells whole characters, so byte runs never cross units."""
        keys = [self.keys(t or "") for t in texts]
        if len(self.ids_of) > UNITS_KEPT:
            self.ids_of.clear()
            self.text_of.clear()
        self.learn(set().union(*keys).difference(self.ids_of))
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        out = []
        for ks in keys:
            ids = ",".join(map(ids_of, ks))
            out.append((ids.count(",") + 1 if ks else 0, ids, "".join(map(text_of, ks))[1:]))
        return out


def _slot(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(maxsize=2)
def codec_of(model_file: str) -> PieceCodec:
    """One codec per worker process, so that reused workers keep its tables."""
    return PieceCodec(model_file)


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False, checks_per_batch: int = 2) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row of docs.

    In each Arrow batch the results of ``checks_per_batch`` texts are held against the sentencepiece
    library, ids and decoding, and a difference is an error; the tests hold all texts against it.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        worker_keeps("pieces", codec_of.cache_clear)
        codec = codec_of(model_file)
        library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sha = hashlib.sha256
        for batch in batches:
            texts = batch.column(1)
            # the batch goes out in slices, so that ids of few texts are held at once
            for lo in range(0, len(texts), 1000):
                n_tokens, a, b, lists = [], [], [], []
                part = texts.slice(lo, 1000).to_pylist()
                for k, (text, (n, ids, back)) in enumerate(zip(part, codec.digests(part), strict=True)):
                    if lo == 0 and k < checks_per_batch:
                        want = library.encode(text or "")
                        if ids != ",".join(map(str, want)) or back != library.decode(want):
                            raise ValueError("the agenda and the sentencepiece library disagree")
                    n_tokens.append(n)
                    a.append(sha(ids.encode()).hexdigest())
                    b.append(sha(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        lists.append([int(x) for x in ids.split(",")] if ids else [])
                cols = [batch.column(0).slice(lo, 1000), pa.array(n_tokens, pa.int64()), pa.array(a), pa.array(b)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)
