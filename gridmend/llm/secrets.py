"""Secret scans.

Method: an Aho-Corasick automaton over all keywords runs once over the lower-cased text; only where it
hits is an anchored regular expression tried, and kinds with an embedded checksum are then
validated. Matches of a kind are leftmost and don't overlap, as an unanchored search would find
them, because each such match begins with a keyword.

Kinds: ``assign`` (keyword, separator, value of 6 or more characters), ``access`` (AKIA..., 20 or more), ``hex``
(runs of 24 or more of [0-9a-f]; a run has no keyword, so one linear scan finds it), and the added
kinds ``github`` and ``npm`` (tokens of 30 characters and a base-62 CRC-32 of them) and ``xprv`` (base58
with four bytes of double SHA-256).

Cases: null and empty texts have no spans; texts are scanned whole; offsets count code points, end
exclusive; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
#: Keyword -> kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "xprv": "xprv",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32 of body."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def base58_ok(text: str) -> bool:
    """Whether text is base58 of a payload and the first four bytes of its double SHA-256."""
    n = 0
    for c in text:
        n = n * 58 + _BASE58.index(c)
    data = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(data) and hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def find_spans(text: str | None, words=None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start and then kind as listed."""
    if not text:
        return []
    words = words or automaton()
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is two characters would shift offsets
        low = text.translate(_LOWER)
    spans: list[tuple[str, int, int]] = []
    ends = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in words.iter(low))
    for start, kind in hits:
        if start < ends[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, start):
                ends[kind] = m.end()
                if len(m[2]) >= 6:
                    spans.append((kind, start, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                ends[kind] = m.end()
                if m.end() - start >= 20:
                    spans.append((kind, start, m.end()))
        elif kind == "xprv":
            if (m := _XPRV.match(text, start)) and base58_ok(m[0]):
                ends[kind] = m.end()
                spans.append((kind, start, m.end()))
        elif (m := (_GITHUB if kind == "github" else _NPM).match(text, start)) and base62_crc(m[1]) == m[2]:
            ends[kind] = m.end()
            spans.append((kind, start, m.end()))
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends) of every row of docs: three arrays of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            found = [find_spans(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[s[0] for s in f] for f in found], pa.list_(pa.string())),
                    pa.array([[s[1] for s in f] for f in found], pa.list_(pa.int64())),
                    pa.array([[s[2] for s in f] for f in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "kinds", "starts", "ends"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>"
    )
