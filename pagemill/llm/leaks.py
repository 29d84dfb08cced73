"""Problem 8: documents that contain passages of held-out test items, exact, disguised or edited.

Rare character n-grams of the items' squashed text (letters and digits only) are the seeds. Documents and items meet in a
shuffled join on the seeds' hashes; a document sends only the hashes that pass a Bloom filter of all seeds, whose size is
fixed. Each joined pair is scored by a Smith-Waterman alignment of words around its seeds: a leak is an unbroken run of
``RUN`` words, or an alignment that holds most words of the whole item.

Neither items nor documents are collected: the corpus is read once, whatever the number of items. Seeds and items are
repeated under ``SALTS`` salts, so that an item that a third of all documents leak is spread over as many tasks, and the
items of one document are aligned ``GROUP`` at a time.

Defined results: null and empty texts and items leak nothing; an item shorter than ``RUN`` words must be there as a whole;
an item of fewer than ``SHORT_SEED`` letters is no evidence and is never found. A repeated document counts once; of several
texts under one item_id the smallest counts.
"""

from __future__ import annotations

import re
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoding
from .common import batch, map_batches
from .lookalike import folder

#: Characters of a seed, and of those of items whose runs are too short for it (Chinese and Japanese words are one character);
#: items that may share a rare one, seeds wanted in every run of ``RUN`` words.
SEED, SHORT_SEED, SHARED, SEEDS_PER_RUN = 12, 6, 3, 2
#: Words of an unbroken run that is a leak; share of an item's words that an edited copy must keep.
RUN, KEPT = 10, 0.7
#: Copies of seeds and items in the joins; items of a document that are aligned at once.
SALTS, GROUP = 16, 64
#: Size of the Bloom filter, 4 MiB whatever the number of items, its probes, and bits of the parts in which it is put together.
FILTER_BITS, PROBES, PART_BITS = 25, 3, 16
_MARKS = "̀-ͯऀ-෿฀-๿"
_SQUASH = re.compile(rf"[^\w{_MARKS}]+|_+")
_WORD = re.compile(rf"[぀-ヿ一-鿿]|[\w{_MARKS}]+?(?=[぀-ヿ一-鿿])|[\w{_MARKS}]+")
_BREAK = re.compile(r"\s*[-‐­¬]?\s*\n[\s>|*]*$")
_MULTIPLIER = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def plain(text: str) -> str:
    """Restored, with look-alikes folded, in lower case."""
    if encoding.suspect(text):
        text = encoding.restore(text)[0]
    return folder()(text).lower()


def hashes(text: str, short: bool = False) -> np.ndarray:
    """Hash of every run of ``SEED`` characters, or of ``SHORT_SEED``."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < (SHORT_SEED if short else SEED):
        return np.zeros(0, np.uint64)
    two = c[:-1] * _MULTIPLIER[0] + c[1:]
    four = two[:-2] * _MULTIPLIER[1] + two[2:]
    if short:
        return (four[:-2] * _MULTIPLIER[3]) ^ (two[4:] * _MULTIPLIER[2])
    eight = four[:-4] * _MULTIPLIER[2] + four[4:]
    return (eight[:-4] * _MULTIPLIER[3]) ^ (four[8:] * _MULTIPLIER[0] >> np.uint64(7)) ^ four[8:]


class Item:
    """Words of an item and the hashes of its squashed text."""

    def __init__(self, text: str):
        self.words = _WORD.findall(plain(text))
        self.starts = np.cumsum([0, *map(len, self.words)])
        runs = range(max(1, len(self.words) - RUN + 1))
        self.short = min(int(self.starts[min(a + RUN, len(self.words))] - self.starts[a]) for a in runs) < SEED + 2
        self.grams = hashes("".join(self.words), self.short)

    def runs(self):
        """Places of the hashes that lie within each run of words."""
        seed = SHORT_SEED if self.short else SEED
        for a in range(max(1, len(self.words) - RUN + 1)):
            low, high = int(self.starts[a]), int(self.starts[min(a + RUN, len(self.words))]) - seed + 1
            yield low, max(low, min(high, len(self.grams)))

    def seeds(self, shared: dict[int, int]) -> tuple[list[int], int]:
        """Hashes that few items have, and of each run without enough of these its rarest; and how many of them a leak must hold."""
        values = self.grams.view(np.int64).tolist()
        chosen = {h for h in values if shared[h] <= SHARED}
        for low, high in self.runs():
            inside = values[low:high]
            if sum(h in chosen and shared[h] <= SHARED for h in inside) < SEEDS_PER_RUN:
                chosen.update(sorted(inside, key=lambda h: (shared[h], h))[:SEEDS_PER_RUN])
        own = np.array([h in chosen for h in values], np.int64)
        total = np.concatenate([[0], own.cumsum()])
        poorest = [int(total[high] - total[low]) for low, high in self.runs()]
        return sorted(chosen), max(1, min([*poorest, int(own.sum()) // 10]))


def probes(h: np.ndarray, k: int) -> np.ndarray:
    """Places of the hashes in the Bloom filter, for probe ``k``."""
    return ((h * _MULTIPLIER[k] if k else h) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Filter:
    """The Bloom filter of all seeds."""

    def __init__(self, parts: dict[int, bytes]):
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        for k, raw in parts.items():
            self.bits[k << PART_BITS : (k + 1) << PART_BITS] = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)

    def passed(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` that may be seeds."""
        at = np.flatnonzero(self.bits[probes(h, 0)])
        for k in range(1, PROBES):
            at = at[self.bits[probes(h[at], k)]]
        return at


def align(item: list[int], doc: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman over word numbers (-1 in ``doc``: not a word of the item): (identical words on the best path, longest unbroken run).

    Match 2, mismatch and gap -1. Beside the score, identical words of the path are carried along.
    """
    n = len(doc)
    score, run = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    best = longest = 0
    steps = np.arange(n + 1, dtype=np.int64)
    tie = np.int64(1 << 20)  # scores are ordered by score, then by identical words, in one number
    for w in item:
        equal = doc == w
        step = np.where(equal, 2 * tie + 1, -tie).astype(np.int64)
        s = np.maximum(score[:-1] + step, score[1:] - tie)
        s[s < tie] = 0
        raised = steps * tie
        raised[1:] += s
        score = np.maximum.accumulate(raised) - steps * tie  # gaps along the document
        score[score < tie] = 0
        run[1:] = (run[:-1] + 1) * equal
        best = max(best, int(score.max()))
        longest = max(longest, int(run.max()))
    return best % int(tie), longest


def _tokens(text: str) -> tuple[list[str], list[bool], np.ndarray]:
    """Words of a text, whether a line break joins each to the one before, and the squashed position of each."""
    words, joins, last = [], [], 0
    for m in _WORD.finditer(text):
        a, z = m.span()
        words.append(text[a:z])
        joins.append(a - last > 1 - (text[last:a] == "\n") and last > 0 and "\n" in text[last:a] and bool(_BREAK.search(text[last:a])))
        last = z
    return words, joins, np.cumsum([0, *map(len, words)])


def _numbered(words: list[str], joins: list[bool], numbers: dict[str, int]) -> np.ndarray:
    """Numbers of the words; pieces of a word broken over lines count as that word."""
    out, k = [], 0
    while k < len(words):
        n = numbers.get(words[k], -1)
        if k + 1 < len(words) and joins[k + 1] and (whole := numbers.get(words[k] + words[k + 1])) is not None:
            n, k = whole, k + 1
        out.append(n)
        k += 1
    return np.array(out, np.int32)


def leaked(text: str, found: list[tuple[int, list[str], list[int]]]) -> list[tuple[int, int, int]]:
    """(item, identical words, longest run) of the items that ``text`` leaks; ``found``: item, its words, places of its seeds."""
    words, joins, starts = _tokens(text)
    out = []
    for item, own, hits in found:
        numbers = {w: n for n, w in enumerate(dict.fromkeys(own))}
        line = [numbers[w] for w in own]
        reach = int(1.4 * sum(map(len, own))) + 40
        hits = sorted(set(hits))
        kept = longest = 0
        at = 0
        while at < len(hits):  # one alignment for each group of near seeds
            last = at
            while last + 1 < len(hits) and hits[last + 1] - hits[last] <= reach:
                last += 1
            a = int(np.searchsorted(starts, hits[at] - reach, "right")) - 1
            z = int(np.searchsorted(starts, hits[last] + reach, "left"))
            a = max(a, 0)
            got = align(line, _numbered(words[a:z], joins[a:z], numbers))
            kept, longest = max(kept, got[0]), max(longest, got[1])
            at = last + 1
        if longest >= min(RUN, len(own)) or kept >= max(KEPT * len(own), min(RUN - 2, len(own))):
            out.append((item, kept, longest))
    return out


def _seeds(items: DataFrame) -> DataFrame:
    """``items(item_id, text)`` to ``(item_id, words, short, least, seeds)``; how many items share a hash is counted in Spark."""

    def grams(b: pa.RecordBatch) -> pa.RecordBatch:
        own = [Item(t) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.unique(x.grams.view(np.int64)) for x in own], pa.list_(pa.int64()))], names=["item_id", "text", "grams"])

    one = items.where("length(text) > 0").groupBy(F.col("item_id").cast("bigint").alias("item_id")).agg(F.min("text").alias("text"))
    hashed = map_batches(one, grams, "item_id bigint, text string, grams array<bigint>", rows=500).checkpoint()
    each = hashed.select("item_id", F.explode("grams").alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("shared"))
    counted = each.join(shared.hint("merge"), "gram").groupBy("item_id").agg(F.collect_list(F.struct("gram", "shared")).alias("shared"))  # as many as the item has letters

    def choose(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = b.column(0).to_pylist(), []
        for i, text, shared in zip(ids, b.column(1).to_pylist(), b.column(2).to_pylist()):
            item = Item(text)
            chosen, least = item.seeds({x["gram"]: x["shared"] for x in shared})
            rows.append((i, item.words, item.short, least, chosen))
        return batch(list(zip(("item_id", "words", "short", "least", "seeds"), (pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int32(), pa.list_(pa.int64())))), rows)

    return map_batches(hashed.select("item_id", "text").join(counted, "item_id"), choose, "item_id bigint, words array<string>, short boolean, least int, seeds array<bigint>", rows=500).checkpoint()


def _filter_parts(seeds: DataFrame) -> dict[int, bytes]:
    """The Bloom filter of ``seeds(gram)`` in parts: each task fills its own, equal parts are united in Spark, and at most
    2 ** (FILTER_BITS - PART_BITS) of them come to the driver."""

    def fill(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            h = np.asarray(b.column(0)).view(np.uint64)
            for k in range(PROBES):
                bits[probes(h, k)] = True
        parts = np.packbits(bits).reshape(-1, 1 << (PART_BITS - 3))
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["part", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    rows = seeds.mapInArrow(fill, "part int, bits binary").groupBy("part").applyInArrow(unite, "part int, bits binary")
    return {r.part: bytes(r.bits) for r in rows.collect()}


def find(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``documents(doc_id, text)`` and ``items(item_id, text)`` to ``(doc_id, item_id, words, run)``."""
    chosen = _seeds(items)
    seeds = chosen.select("item_id", F.explode("seeds").alias("gram"))
    parts = documents.sparkSession.sparkContext.broadcast(_filter_parts(seeds.select("gram")))  # 4 MiB at most
    mark = uuid4().hex
    any_short = not chosen.where("short").isEmpty()
    any_long = not chosen.where("not short").isEmpty()

    def hits(b: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest as digest

        known = _loaded(mark, parts)
        ids, texts = b.column(0).to_pylist(), [plain(t) for t in b.column(1).to_pylist()]
        squashed = [_SQUASH.sub("", t) for t in texts]
        joined, offsets = "\x00".join(squashed), np.cumsum([0, *(len(s) + 1 for s in squashed)])
        grams, places, owners = [], [], []
        for short in (False,) * any_long + (True,) * any_short:
            h = hashes(joined, short)
            at = known.passed(h)
            own = np.searchsorted(offsets, at, "right") - 1
            grams, places, owners = [*grams, h[at].view(np.int64)], [*places, at - offsets[own]], [*owners, own]
        rows = []
        if owners and len(own := np.concatenate(owners)):
            order = np.argsort(own, kind="stable")
            own, gram, place = own[order], np.concatenate(grams)[order], np.concatenate(places)[order]
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            rows = [(ids[own[x]], digest(texts[own[x]].encode()), texts[own[x]], gram[x:y], place[x:y].astype(np.int32)) for x, y in zip(edges, edges[1:])]
        return batch(list(zip(("doc_id", "own", "text", "grams", "places"), (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())))), rows)

    source = documents.select(F.col("doc_id").cast("bigint"), "text").where("length(text) > 0")
    key = ["doc_id", "own"]
    found = map_batches(source, hits, "doc_id bigint, own binary, text string, grams array<bigint>, places array<int>", rows=500).checkpoint()  # read twice
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.hash("own"), F.lit(SALTS)).alias("salt")
    spots = found.select(*key, salt, F.inline(F.arrays_zip("grams", "places"))).withColumnsRenamed({"grams": "gram", "places": "place"})
    # Seeds and items are never broadcast: their number has no bound.
    met = spots.join(seeds.select("gram", "item_id", salts).hint("merge"), ["gram", "salt"]).groupBy(*key, "item_id").agg(F.array_sort(F.collect_set("place")).alias("hits"))
    wanted = chosen.select("item_id", "words", "least", salts)
    pairs = met.withColumn("salt", F.pmod(F.hash("own"), F.lit(SALTS))).join(wanted.hint("merge"), ["item_id", "salt"]).where(F.size("hits") >= F.col("least")).drop("salt", "least").withColumnRenamed("words", "item_words")
    # The items of a document in groups of bounded size, so that no row grows with what a document leaks.
    groups = F.ceil(F.count("*").over(Window.partitionBy(*key)) / GROUP).cast("int")
    grouped = pairs.select(*key, "item_id", "item_words", "hits", F.pmod(F.hash("item_id"), groups).alias("part"))
    bundles = grouped.groupBy(*key, "part").agg(F.collect_list(F.struct("item_id", "item_words", "hits")).alias("found"))
    texts = found.select(*key, "text").dropDuplicates(key)
    work = bundles.alias("l").join(texts.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.own") == F.col("r.own"))).select("l.doc_id", "r.text", "l.found")

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, text, own in zip(*(c.to_pylist() for c in b.columns)):
            rows += [(i, *x) for x in leaked(text, [(x["item_id"], x["item_words"], x["hits"]) for x in own])]
        return batch(list(zip(("doc_id", "item_id", "words", "run"), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))), rows)

    return map_batches(work, score, "doc_id bigint, item_id bigint, words int, run int", rows=100)


_filters: dict[str, Filter] = {}


def _loaded(mark: str, parts) -> Filter:
    """The worker's filter, put together once a Python worker."""
    if mark not in _filters:
        _filters.clear()
        _filters[mark] = Filter(parts.value)
    return _filters[mark]
