"""Byte-level BPE encoding and decoding.

Method: inside each pre-token a priority queue of merge ranks runs over a doubly linked list of symbols. A popped
entry whose symbols have changed since it was pushed is stale and is skipped. Decoding concatenates the byte strings
of the vocabulary.

Defined cases: a null text encodes as the empty text; an empty text gives no ids; strings of added tokens in a text
become their ids; texts of any length are encoded whole (no chunk borders, hence no border effects); ids that are not
in the vocabulary raise ``KeyError``; decoded bytes that are not UTF-8 become U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from array import array

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# The pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Below this code point the pattern is compiled for the plain ``re`` engine, with its classes spelled out.
LATIN_END = 0x250
_beyond_latin = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search


def _latin_pattern() -> re.Pattern:
    """:data:`PATTERN` for texts without code points from ``LATIN_END`` on; letters, the most usual case, come first."""
    of = lambda major: "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == major)
    letters, numbers, space = of("L"), of("N"), r"\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(
        f" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letters}{numbers}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable stand-in: Latin-1 letters stand for themselves, the rest go to U+0100 and up, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class BpeTokenizer:
    """A byte-level BPE vocabulary file (``tokenizers`` JSON) with an encoder and a decoder of its own."""

    def __init__(self, path: str, cache_size: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        vocab = spec["model"]["vocab"]
        raw = lambda token: bytes(back[c] for c in token)
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.byte_ids = [vocab[c] for _, c in sorted(byte_alphabet().items())]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
            if self.added
            else None
        )
        self.pieces = regex.compile(PATTERN).findall
        self.latin_pieces = _latin_pattern().findall
        #: Ids of words seen lately: two generations of at most ``cache_size`` words, the older one is dropped whole.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_size = cache_size

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token: lowest merge rank first, leftmost first among equals."""
        sym = [self.byte_ids[b] for b in data]
        n, merges = len(sym), self.merges
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = merges.get((sym[i], sym[i + 1]))
            if m:
                heap.append((m[0], i, sym[i], sym[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # stale: a neighbour was merged since this entry was pushed
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                m = merges.get((new, sym[k]))
                if m:
                    heapq.heappush(heap, (m[0], i, new, sym[k], m[1]))
            h = left[i]
            if h >= 0:
                m = merges.get((sym[h], new))
                if m:
                    heapq.heappush(heap, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0]

    def _word(self, w: str) -> bytes:
        got = self.older.get(w)
        if got is None:
            ids = self.merge(w.encode())
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(w) <= 64:
            if len(self.cache) >= self.cache_size:
                self.older, self.cache = self.cache, {}
            self.cache[w] = got
        return got

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens, packed little-endian."""
        words = self.pieces(text) if _beyond_latin(text) else self.latin_pieces(text)
        known, word = self.cache.get, self._word
        return b"".join([known(w) or word(w) for w in words])

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_added is None or not self.split_added.search(text):
            return self._plain(text)
        parts = self.split_added.split(text)
        return b"".join(struct.pack("<I", self.added[p]) if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def encode(self, text: str | None) -> list[int]:
        return list(struct.unpack(f"<{len(p := self.encode_packed(text)) // 4}I", p))

    def decode_packed(self, packed: bytes) -> str:
        ids = array("I", packed)
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, BpeTokenizer] = {}


def load(path: str) -> BpeTokenizer:
    """One tokenizer per path and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = BpeTokenizer(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``id_col``, ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (string), a row per input row,
    repeats and null ids included; other input columns are ignored. One narrow stage, no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def fn(ids, texts, tok):
        packed = [tok.encode_packed(t) for t in texts]
        return {"_id": ids, "ids": packed, "decoded": [tok.decode_packed(p) for p in packed]}

    out = map_rows(df, id_col, text_col, fn, f"_id {kind}, ids binary, decoded string", lambda: load(tokenizer), 256)
    return out.withColumnRenamed("_id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of what :func:`encode_decode` returns."""
    return encoded.select(
        id_col,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
