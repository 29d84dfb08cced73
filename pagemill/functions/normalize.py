"""Unicode normalisation, canonical text, and repair of visually ordered vowel signs.

Spark has no NFC built in, so these are Arrow functions; text that is already normal is passed through after one quick look.
Null gives null.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import chars

# Characters that are always dropped, and ligatures.
DROPPED = "﻿​­⁠᠎"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

_I = "඀-෿஀-௿"
_JOINER = re.compile(f"(?<![{_I}])‍|‍(?![{_I}])|(?<![{_I}])‌|‌(?![{_I}])|(?<=[්்])‌")
_REST = re.compile(f"\r\n?|[{DROPPED}]|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|[ﬀ-ﬆ]")
_TOUCHED = re.compile(f"[\r{DROPPED}‌‍\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9fﬀ-ﬆ]")
_CLUSTER = f"[ක-ෆ](?:්‍[ක-ෆ])*"
_MISPLACED = re.compile(f"[ෙෛெ-ை](?:{_CLUSTER}|[க-ஹ])")


def normalize_text(text: str) -> str:
    """NFC, without invisible and control characters; joiners stay only inside Sinhala and Tamil words."""
    text = unicodedata.normalize("NFC", text)
    if not _TOUCHED.search(text):
        return text
    # Joiners look at their neighbours in the composed text, so they are judged before anything else goes.
    return _REST.sub(lambda m: "\n" if m[0][0] == "\r" else LIGATURES.get(m[0], ""), _JOINER.sub("", text))


def canonical_text(text: str) -> str:
    return " ".join(x for x in re.split(f"[{re.escape(chars.WHITE)}]+", normalize_text(text)) if x)


def repair_text(text: str) -> tuple[str, int]:
    """Move pre-base vowel signs that no consonant precedes behind the consonant cluster that follows; NFC; number moved."""
    moved, parts, at = 0, [], 0
    while m := _MISPLACED.search(text, at if not parts else at):
        before = text[m.start() - 1 : m.start()] if m.start() > at else (parts[-1][-1:] if parts else "")
        if before and chars.is_consonant(before):
            parts.append(text[at : m.start() + 1])
            at = m.start() + 1
            continue
        parts += [text[at : m.start()], m[0][1:], m[0][0]]
        at = m.end()
        moved += 1
    return unicodedata.normalize("NFC", "".join([*parts, text[at:]])), moved


@F.arrow_udf(T.StringType())
def _normalize(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else normalize_text(x) for x in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else canonical_text(x) for x in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("moved", T.IntegerType())]))
def _repair(texts: pa.Array) -> pa.Array:
    rows = [(None, None) if x is None else repair_text(x) for x in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["text", "moved"])


def normalize(text: Column) -> Column:
    return _normalize(text)


def canonical(text: Column) -> Column:
    return _canonical(text)


def repair_visual_order(text: Column) -> Column:
    """Struct ``text, moved``."""
    return _repair(text)
