"""Secret scanning: three fixed patterns, and strings whose sliding-window entropy is too high for words.

An entropy candidate is a run of 20 or more characters of [A-Za-z0-9+/_=-]. Its character class is the narrowest of hex,
alnum and base64 that holds all of it. A window of WINDOW characters moves over it, its Shannon entropy kept by the counts
that change at its two ends; windows at or over their class's threshold join into spans. Candidates that the allow-list
matches in full give none, and neither do spans that hold a placeholder, or lie inside one of a fixed pattern.

All patterns take time in proportion to the text. Spans that start at one place are listed in the order of their kinds.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthobox.llm._rows import map_texts, raw

WINDOW = 20
# Entropy, in bits, from which a window of each class counts.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.8}
# Candidates that are no secrets: words of up to 19 letters and slugs of such words, numbers and dates, UUIDs.
ALLOWED = (
    r"[+/_=-]*+(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19})(?:[+/_=-]++(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19}|[0-9]{1,4}))*[+/_=-]*+",
    r"[A-Z]?[a-z]{1,18}(?:[A-Z][a-z]{1,18}){0,3}",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
)
# What the placeholders of documentation hold.
PLACEHOLDERS = r"EXAMPLE|example|xxxx|XXXX|0123456789|abcdefgh|ABCDEFGH|placeholder|changeme"
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")

_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_CANDIDATE = np.zeros(256, dtype=bool)
_CANDIDATE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+").fullmatch), ("alnum", re.compile(r"[A-Za-z0-9]+").fullmatch), ("base64", re.compile(r".+", re.S).fullmatch))


def entropy_windows(text: str, window: int = WINDOW) -> Iterator[float]:
    """The entropy in bits of each window of the text, from the counts that change between neighbours."""
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(text):
        if i >= window:  # the old one goes first, so no count passes the window's size
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += cost[n - 1] - cost[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        if i >= window - 1:
            yield math.log2(window) - total / window


def entropy_spans(candidate: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """The spans of one candidate whose windows reach its class's threshold."""
    least = next(THRESHOLDS[name] for name, whole in _CLASSES if whole(candidate))
    spans: list[tuple[int, int]] = []
    for i, h in enumerate(entropy_windows(candidate, window)):
        if h >= least - 1e-9:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + window)
            else:
                spans.append((i, i + window))
    return spans


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the mask's runs of at least so many bytes, none of which crosses texts."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    held = (ends - starts >= least) & mask[np.minimum(starts, len(mask) - 1)] if len(mask) else np.zeros(0, dtype=bool)
    starts, ends = starts[held], ends[held]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _inside(base: list[tuple[int, int, int]]):
    """Whether a span lies in one of the base spans (start, kind, end)."""
    order = sorted((s, e) for s, _, e in base)
    starts, upto = [s for s, _ in order], list(itertools.accumulate((e for _, e in order), max))
    return lambda s, e: (i := bisect.bisect_right(starts, s)) > 0 and e <= upto[i - 1]


def scan(texts: pa.Array, allowed: Sequence[str] = ALLOWED, placeholders: str = PLACEHOLDERS) -> list[list[tuple[int, int, str]]]:
    """For each text (UTF-8 bytes) its spans (start, position of the kind in KINDS, end), in code points and sorted."""
    data, offsets = raw(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    starts, ends, rows = _runs(_CANDIDATE[data], offsets, WINDOW)
    hexes = _runs(_HEX[data], offsets, LEAST["hex"])
    marks = (data == 0x3A) | (data == 0x3D)
    marked = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets]))
    loud = {*rows.tolist(), *hexes[2].tolist()}
    keyed = [i for i in loud if b"AKIA" in texts[i].as_py()]  # a run of 20 such characters is a candidate too
    open_ = {i: texts[i].as_py().decode() for i in {*loud, *marked.tolist()}}
    points: dict[int, np.ndarray | None] = {}

    def point(i: int, at: int) -> int:
        """The code points before a byte offset of text i."""
        if i not in points:
            own = data[offsets[i] : offsets[i + 1]]
            points[i] = None if len(open_[i]) == len(own) else np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        return int(at - offsets[i]) if points[i] is None else int(points[i][at - offsets[i]])

    for i in marked.tolist():
        found[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(open_[i]) if len(m[2]) >= LEAST["assign"]]
    for i in keyed:
        found[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(open_[i]) if len(m[0]) >= LEAST["access"]]
    for s, e, i in zip(*(x.tolist() for x in hexes)):
        found[i].append((point(i, s), 2, point(i, e)))
    inside: dict[int, Callable[[int, int], bool]] = {}
    dummy = re.compile(placeholders).search if placeholders else lambda _: None
    allow = re.compile("|".join(f"(?:{a})" for a in allowed)).fullmatch if allowed else lambda _: None
    for s, e, i in zip(starts.tolist(), ends.tolist(), rows.tolist()):
        candidate = data[s:e].tobytes().decode()
        if not allow(candidate):
            at = point(i, s)
            if i not in inside:
                inside[i] = _inside(found[i])
            found[i] += [(at + a, 3, at + b) for a, b in entropy_spans(candidate) if not dummy(candidate[a:b]) and not inside[i](at + a, at + b)]
    return [sorted(x) for x in found]


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of each span, by start and then kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each maximal run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_rows(df: DataFrame, text: str, length: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The input's rows and columns, the text's spans replaced by the mark and the length column, if any, by the new text's
    code points where there were spans. Null texts stay null, texts without spans stay as they are, columns may have any names."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    scanned = scan_texts(df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), list(names.values()), names[text], mark=mark)
    clean = F.when(F.col("spans") == "", F.col(names[text])).otherwise(F.col("clean_text"))
    out = {c: F.col(n) for c, n in names.items()} | {text: clean}
    if length in names:
        out[length] = F.when(F.col("spans") == "", F.col(names[length])).otherwise(F.length("clean_text").cast(df.schema[length].dataType))
    return scanned.select(*[v.alias(c) for c, v in out.items()])


def scan_texts(df: DataFrame, keep: Sequence[str], text: str, allowed: Sequence[str] = ALLOWED, mark: str | None = None) -> DataFrame:
    """The kept columns with n_assign, n_access, n_hex, n_entropy, base_sha256, spans and, given a mark, clean_text.

    spans lists every span as kind:start:end, base_sha256 digests those of the three base kinds; offsets are code points,
    ends exclusive. clean_text has the spans replaced by the mark. Null texts count as empty; empty texts have no spans, an
    empty table gives no rows, and repeated rows get the same result each. Where a kept column has one of the names above,
    that of the result gets underscores at its end.

    A long text is scanned whole, in time that grows with its length; ties (spans of one start) go by kind.
    """
    outputs = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_entropy")] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    outputs += [T.StructField("clean_text", T.StringType())] * (mark is not None)

    def make():
        def work(texts: pa.Array):
            found = scan(texts, allowed)
            out = [[sum(k == kind for _, k, _ in x) for x in found] for kind in range(4)]
            out += [[hashlib.sha256(joined([y for y in x if y[1] < 3]).encode()).hexdigest() for x in found], [joined(x) for x in found]]
            if mark is not None:
                out.append([redacted(t, x, mark) if x else t for t, x in zip(texts.cast(pa.string()).to_pylist(), found)])
            return out

        return work

    return map_texts(df, keep, text, outputs, make)
