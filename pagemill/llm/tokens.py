"""Problem 7: encode every text with a public byte-level BPE tokenizer.

Short texts are encoded where they are read. A long text is cut into overlapping chunks that are pre-tokenised in
parallel; neighbouring chunks are stitched at a pre-token boundary that both found inside their overlap (the pattern has
no look-behind, so from a common boundary on both see the same pre-tokens); the pieces between stitches are encoded in
parallel and their ids concatenated. Seams without a common boundary (one pre-token longer than the overlap) are closed
by joining the two chunks into one piece, so the result equals encoding the whole text at once.

Defined results: a null text and an empty text give an empty list; special-token strings are ordinary text. Every row of the
input gives one row, whatever its length, its ``doc_id`` null or repeated: long texts are told apart by a hash of the text
beside their id, and equal rows are encoded once and given back as often as they came.
"""

from __future__ import annotations

import base64
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, map_batches

# The public pre-token pattern of the vocabulary, and Unicode White_Space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Code points of a chunk, of its overlap with the next one, and of the end of a chunk whose boundaries aren't trusted.
CHUNK, OVERLAP, MARGIN = 32768, 1024, 16
_CACHED_WORDS, _CACHED_CHARS = 400_000, 48


class Encoder(dict):
    """Ids of a vocabulary file, as int32 bytes by space-delimited word; words repeat, so most are a dictionary look-up.

    The pattern never matches across a change from non-space to space, hence the ids of a text are those of its words
    (each with the one space before it) and of the white space between them.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self.lengths[rank] = len(word)
        self.words = re.compile(rf"[{WHITE}]+(?![^{WHITE}])| ?[^{WHITE}]+|[{WHITE}]").findall

    def __missing__(self, word: str) -> bytes:
        ids = np.asarray(self.bpe.encode_ordinary(word), np.int32).tobytes()
        if len(word) <= _CACHED_CHARS:
            if len(self) > _CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.words(text))) if text else b""

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), np.int32)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; loaded once a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or TOKENIZER_DIR}/{name}.tiktoken"


def id_lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.fromiter(accumulate((len(x) // 4 for x in encoded), initial=0), np.int32, len(encoded) + 1)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def _boundaries(pattern, chunk: str, low: int, high: int) -> list[int]:
    """Ends of the pre-tokens of ``chunk`` that lie in [low, high]."""
    return [m.end() for m in pattern.finditer(chunk) if low <= m.end() <= high]


def encode(df: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``df(doc_id, text)`` to ``(doc_id, ids)``, one row for each row of ``df``.

    Other columns are ignored.
    """
    source = df.select(F.col("doc_id").cast("bigint"), F.col("text"))
    is_long = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        return pa.RecordBatch.from_arrays([b.column(0), id_lists([e.encode(x) for x in b.column(1).to_pylist()])], names=["doc_id", "ids"])

    short = map_batches(source.where(~is_long), whole, "doc_id bigint, ids array<int>")

    def cut(b: pa.RecordBatch):
        from xxhash import xxh3_128_digest as digest

        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            starts = range(0, len(text), chunk)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * len(starts), pa.int64()), pa.array([digest(text.encode())] * len(starts), pa.binary()), pa.array(range(len(starts)), pa.int32()), pa.array([text[s : s + chunk + overlap] for s in starts])],
                names=["doc_id", "own", "k", "part"],
            )

    def pretokenise(b: pa.RecordBatch) -> pa.RecordBatch:
        import regex

        pattern = regex.compile(PATTERN)
        head, tail = [], []
        for part in b.column(4).to_pylist():
            ends = [0, *(m.end() for m in pattern.finditer(part))]
            # The chunk may start inside a pre-token: its own first boundaries count only where the chunk before agrees.
            # No cut after white space: at the end of a piece, white space would match as one run.
            head.append([x for x in ends if x < overlap])
            tail.append([x - chunk for x in ends if chunk <= x < len(part) - MARGIN and not part[x - 1].isspace()])
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["doc_id", "own", "k", "copies", "part", "head", "tail"])

    # A doc_id may be null: groupBy and windows treat null as one value. Chunks of equal rows meet here and are one from here on.
    key = ["doc_id", "own"]
    chunks = map_batches(source.where(is_long), cut, "doc_id bigint, own binary, k int, part string", rows=50)
    once = chunks.groupBy(*key, "k").agg(F.count("*").alias("copies"), F.first("part").alias("part"))
    parts = map_batches(once, pretokenise, "doc_id bigint, own binary, k int, copies bigint, part string, head array<int>, tail array<int>", rows=50)
    by_doc = Window.partitionBy(*key).orderBy("k")
    seams = parts.withColumn("next", F.array_min(F.array_intersect("tail", F.lead("head").over(by_doc)))).withColumn("from", F.lag("next").over(by_doc))
    # A piece starts at each chunk whose seam with the chunk before is resolved; other chunks continue the piece.
    starts = (F.col("k") == 0) | F.col("from").isNotNull()
    body = F.expr(f"substring(part, coalesce(from, 0) + 1, {chunk} + coalesce(next, 0) - coalesce(from, 0))")
    pieces = (
        seams.select(*key, "k", "copies", F.sum(starts.cast("int")).over(by_doc).alias("piece"), body.alias("body"))
        .groupBy(*key, "piece")
        .agg(F.max("copies").alias("copies"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x.body), "").alias("text"))
    )

    def piece_ids(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        return pa.RecordBatch.from_arrays([*b.columns[:4], id_lists([e.encode(x) for x in b.column(4).to_pylist()])], names=["doc_id", "own", "piece", "copies", "ids"])

    encoded = map_batches(pieces.select(*key, "piece", "copies", "text").repartition(*key, "piece"), piece_ids, "doc_id bigint, own binary, piece bigint, copies bigint, ids array<int>", rows=50)
    joined = encoded.groupBy(*key).agg(F.max("copies").alias("copies"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x.ids)).alias("ids"))
    long = joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("doc_id", "ids")
    return short.unionByName(long)


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df(doc_id, ids)`` to ``(doc_id, text)``: raw bytes of the ids, concatenated; a null list gives null."""

    def texts(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path).bpe
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else bpe.decode_bytes(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(df.select(F.col("doc_id").cast("bigint"), "ids"), texts, "doc_id bigint, text string", rows=500)
