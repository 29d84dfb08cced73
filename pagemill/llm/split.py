"""Problem 9: cut texts above a token limit into balanced, overlapping pieces at natural boundaries.

The fewest pieces that can hold the text are computed, equal-length targets placed, each target snapped to the strongest
boundary near it (blank line, line break, sentence end, white space, else a character), every piece is encoded again on
its own, and one more piece is tried whenever any piece is above the limit.

Defined results: null, empty and fitting texts give no piece; a text without any boundary is cut between characters; repeated
rows are cut each for itself, alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .tokens import Encoder, encoder

LIMIT, OVERLAP, SLACK = 4096, 256, 64
#: Natural boundaries from strong to weak, as patterns over the UTF-8 bytes of a text; a cut is at the end of a match.
_STRENGTHS = [re.compile(p) for p in (rb"\n[ \t]*\n\s*", rb"\n", rb"(?:[.!?]|\xe2\x80\xa6)(?:[\"')\]]|\xe2\x80[\x99\x9d]|\xc2\xbb)*\s+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)(?:\xe3\x80[\x8d\x8f]|\xe2\x80\x9d)*|\xe0\xa5[\xa4\xa5]\s*", rb"[ \t]+")]


def _cut_points(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which ``raw`` may be cut, ascending, and the strength (4 to 0) of each."""
    strength = np.zeros(len(raw) + 1, np.int8)
    data = np.frombuffer(raw, np.uint8)
    for power, pattern in zip((1, 2, 3, 4), reversed(_STRENGTHS)):
        ends = [m.end() for m in pattern.finditer(raw)]
        strength[ends] = power
    ok = np.ones(len(raw) + 1, bool)
    ok[:-1] = (data & 0xC0) != 0x80
    ok[0] = False
    at = np.flatnonzero(ok)
    return at, strength[at]


def _best(at, strength, token_at, low: int, high: int, target: int) -> int | None:
    """The strongest cut whose token position is in [low, high], nearest to ``target`` among equals; its index in ``at``."""
    a, b = np.searchsorted(token_at, [low, high + 1])
    if a >= b:
        return None
    s = strength[a:b]
    among = np.flatnonzero(s == s.max())
    return int(a + among[np.argmin(np.abs(token_at[a:b][among] - target))])


def pieces_of(e: Encoder, text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of ``text`` in code points; one piece if it fits the limit."""
    ids = e.ids(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids))]
    raw = text.encode()
    ends = np.cumsum(e.lengths[ids])
    at, strength = _cut_points(raw)
    token_at = np.searchsorted(ends, at, "left") + 1  # tokens that cover the text up to the cut
    total, count = len(ids), -(-(len(ids) - overlap) // (limit - overlap))
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    while True:
        share = total / count
        room = max(0, int(limit - overlap - share) - 8)
        reach = max(1, min(int(share // 3), room if room > 16 else 16))
        cuts, out, start, ok = [], [], 0, True
        for k in range(1, count):
            target = round(k * share)
            i = _best(at, strength, token_at, target - reach, target + reach, target)
            if i is None or (cuts and at[i] <= at[cuts[-1]]):
                ok = False
                break
            cuts.append(i)
        if ok:
            bounds = [*(int(at[i]) for i in cuts), len(raw)]
            for k, end in enumerate(bounds):
                piece = raw[start:end].decode()
                n = len(e.ids(piece))
                if n > limit:
                    ok = False
                    break
                out.append((int(chars[start - 1]) if start else 0, int(chars[end - 1]), n))
                if k < len(cuts):
                    here = int(token_at[cuts[k]])
                    j = _best(at, strength, token_at, here - overlap + 1, here - overlap + slack, here - overlap + 1)
                    start = int(at[j]) if j is not None and at[j] < end else end
        if ok:
            return out
        count += 1


def split(df: DataFrame, path: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``df(doc_id, text)`` to the pieces of every text above ``limit`` tokens.

    Columns: doc_id, piece_no (from 0), start_at, end_at (code points), n_tokens, text. Null, empty and fitting texts
    give no rows. A text of at most ``limit`` UTF-8 bytes cannot exceed the limit and is never sent to Python.
    """
    source = df.select(F.col("doc_id").cast("bigint"), "text").where(F.octet_length("text") > limit)

    def run(b: pa.RecordBatch):
        e, rows = encoder(path), []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            pieces = pieces_of(e, text, limit, overlap)
            if len(pieces) > 1:
                rows += [(doc, k, s, t, n, text[s:t]) for k, (s, t, n) in enumerate(pieces)]
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece_no", "start_at", "end_at", "n_tokens", "text"])

    return map_batches(source, run, "doc_id bigint, piece_no int, start_at int, end_at int, n_tokens int, text string", rows=200)
