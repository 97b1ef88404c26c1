"""Byte-level BPE, encoded and decoded by the files of a public tokenizer.

Each piece of a text is a row of parts held as two arrays: the parts' tokens and the merge rank of every neighbouring
pair. The smallest rank is searched by a scan, its boundary deleted and the two neighbouring ranks refreshed. Scans cost
the square of the length, so pieces over LONG_PIECE bytes hold the same ranks in a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orthobox.llm._rows import map_texts

LONG_PIECE = 256
#: Pieces remembered by a worker; when full, the memory starts afresh.
REMEMBERED = 250_000
REMEMBERED_BYTES = 48

# The pattern of byte-level BPE's pieces, and the same for texts whose characters all stand below U+0250
# with only ASCII digits and ASCII white space.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
LATIN_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LATIN_SPACE = "\t\n\x0b\x0c\r "
LATIN_PIECES = f"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN_LETTERS}]+| ?[0-9]+| ?[^{LATIN_SPACE}{LATIN_LETTERS}0-9]+|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+"
NOT_LATIN = "[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]"
NONE = 1 << 60


def byte_characters() -> dict[str, int]:
    """Which byte each character of the vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoding and decoding by one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not byte-level BPE without normaliser and prefix space")
        vocab, chars = model["vocab"], byte_characters()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: (bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()) for t, i in {**vocab, **added}.items()}
        self.byte_ids = [0] * 256
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        self.shift = max(vocab.values()).bit_length()
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << self.shift | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.not_latin, self.latin, self.other = re.compile(NOT_LATIN).search, re.compile(LATIN_PIECES).findall, regex.compile(PIECES).findall
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        if len(piece) > LONG_PIECE:
            return self.merge_long(piece)
        parts = [self.byte_ids[b] for b in piece]
        shift, get, merged = self.shift, self.ranks.get, self.merged
        ranks = [get(a << shift | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << shift | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << shift | parts[i + 1], NONE)
        return parts

    def merge_long(self, piece: bytes) -> list[int]:
        """The same tokens, with ranks in a heap and parts in a linked list: for pieces without a length limit."""
        parts = [self.byte_ids[b] for b in piece]
        n, shift, get = len(parts), self.shift, self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << shift | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] << shift | parts[k], NONE)) != NONE:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := get(parts[h] << shift | parts[i], NONE)) != NONE:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def _learn(self, piece: str) -> bytes:
        encoded = piece.encode()
        ids = np.array(self.merge(encoded), dtype="<u4").tobytes()
        if len(encoded) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.split_added(text) if self.split_added else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            known, learn = self.known.get, self._learn
            out += [known(p) or learn(p) for p in (self.other if self.not_latin(part) else self.latin)(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of such ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join([self.bytes_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per file and worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_texts(df: DataFrame, keep: Sequence[str], text: str, tokenizer: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """The kept columns, n_tokens and, as asked, ids (array of int), decoded (string); always their SHA-256.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded text in UTF-8. Null
    texts count as empty: no ids. Special tokens' strings in a text are encoded as those tokens. tokenizer is a file that
    executors can open. Of adjacent pairs with equal ranks the leftmost merges first. Repeated rows get the same result each, an
    empty table gives no rows. Where a kept column has one of the names, that of the result gets underscores.

    A long text is encoded whole, by a task that handles it alone.
    """
    outputs = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    outputs += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded

    def make():
        coder = codec(tokenizer)

        def work(texts: pa.Array):
            encoded = [coder.encode(t) for t in texts.cast(pa.string()).to_pylist()]
            back = [coder.decode(x) for x in encoded]
            sha = [[hashlib.sha256(x).hexdigest() for x in encoded], [hashlib.sha256(x.encode()).hexdigest() for x in back]]
            return [[len(x) // 4 for x in encoded], *sha, *([[np.frombuffer(x, "<i4") for x in encoded]] if ids else []), *([back] if decoded else [])]

        return work

    return map_texts(df, keep, text, outputs, make)
