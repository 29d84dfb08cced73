"""Problem 2: language of every page and of every stretch of another language in it, with a confidence.

Nearest-centroid classification of sentence units: normalised TF-IDF vectors of hashed character n-grams are compared by
cosine with several centroids per language. Centroids come from k-means within each label of a bounded sample of labelled
rows; since labels are partly wrong, every centroid then takes the language for which most of its nearest sample units
vote. A unit further from its centroid than nearly all units of the sample are is rejected. The languages are the labels that
the collection has.

Defined results: pages without text, headings, tables, running heads and rejected units carry no language; an absent label
counts as no language. Garbled text is classified as its restored form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches
from .lookalike import folder
from .scans import furniture
from .sentences import units

BITS = 14
#: Bounds of the training sample: labelled pages per label, and labels, more of which are an error; centroids per label.
SAMPLE_PER_LABEL, MOST_LABELS, CENTROIDS = 400, 256, 3
_HASHES = 1 << 63
REJECT_QUANTILE, REJECT_SLACK = 0.002, 0.75
_ENDED = re.compile(r"[.!?।。！？…][”\"»’'）\)\]“」』�]*$|[฀-๿]$")
_STRIP = re.compile(r"[\d\W_]+")


def _ngrams(codes: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Keys unit << BITS | hash of the 2- and 3-grams that don't cross a unit's end; each unit starts and ends with a space."""
    keys = []
    c = codes.astype(np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in (1, 2, 3):
        size = len(c) - n + 1
        if size <= 0:
            break
        if n == 1:
            h = c * np.uint32(0x9E3779B1)
            continue
        h = (h[:size] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        ok = unit[:size] == unit[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
        keys.append((unit[:size].astype(np.uint32) << np.uint32(BITS) | (mixed >> np.uint32(32 - BITS)))[ok])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint32)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse term counts: (unit, bucket, count), sorted by unit; at most 2**18 texts a call."""
    prepared = [f" {_STRIP.sub(' ', x).strip().lower()} " for x in texts]
    sizes = np.fromiter(map(len, prepared), np.int64, len(prepared))
    codes = np.frombuffer("".join(prepared).encode("utf-32-le"), np.uint32)
    unit = np.repeat(np.arange(len(prepared)), sizes)
    keys = np.sort(_ngrams(codes, unit))
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    found = keys[starts]
    return (found >> np.uint32(BITS)).astype(np.int64), (found & np.uint32((1 << BITS) - 1)).astype(np.int64), counts


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # bucket by centroid, columns of length 1
    langs: list[str]  # language of each centroid
    least: np.ndarray  # least cosine accepted by each centroid

    def cosines(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.centroids.shape[1]), np.float32)
        unit, bucket, count = vectors(texts)
        if not len(unit):
            return out
        weight = (np.log1p(count) * self.idf[bucket]).astype(np.float32)
        edges = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        norm = np.sqrt(np.add.reduceat(weight * weight, edges))
        norm, rows = np.maximum(norm, 1e-9), unit[edges]
        for k, centroid in enumerate(self.centroids.T):  # one narrow table at a time stays in the processor's cache
            out[rows, k] = np.add.reduceat(centroid[bucket] * weight, edges) / norm
        return out

    def classify(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language or None if rejected, confidence) of each text; confidence is the winner's share of the two best cosines."""
        if not texts:
            return []
        cos = self.cosines(texts)
        best = cos.argmax(1)
        top = cos[np.arange(len(texts)), best]
        code = np.unique(self.langs, return_inverse=True)[1]
        rival = np.where(code[None, :] != code[best][:, None], cos, 0).max(1)
        accepted = (top > 0) & (top >= self.least[best])
        share = top / np.maximum(top + rival, 1e-9)
        return [(self.langs[k] if ok else None, c) for k, ok, c in zip(best.tolist(), accepted.tolist(), share.tolist())]


def fit(rows: list[tuple[str, str]], centroids: int = CENTROIDS, seed: int = 7) -> Model:
    """A model from ``(label, text)`` of single units; labels may be partly wrong."""
    rng = np.random.default_rng(seed)
    labels = np.array([r[0] for r in rows])
    unit, bucket, count = vectors([r[1] for r in rows])
    size = len(rows)
    seen = np.bincount(bucket, minlength=1 << BITS)
    idf = np.log((1 + size) / (1 + seen)).astype(np.float32) + 1
    weight = (np.log1p(count) * idf[bucket]).astype(np.float32)
    norm = np.sqrt(np.bincount(unit, weight * weight, size))
    weight /= np.maximum(norm[unit], 1e-9)
    bounds = np.searchsorted(unit, np.arange(size + 1))
    filled = np.flatnonzero(np.diff(bounds))

    def mean(members: np.ndarray) -> np.ndarray:
        pick = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in members])
        v = np.bincount(bucket[pick], weight[pick], 1 << BITS).astype(np.float32)
        return v / max(np.linalg.norm(v), 1e-9)

    def cosines(matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((size, matrix.shape[1]), np.float32)
        for k in range(matrix.shape[1]):  # one narrow table at a time stays in the processor's cache
            out[filled, k] = np.add.reduceat(np.ascontiguousarray(matrix[:, k])[bucket] * weight, bounds[:-1][filled])
        return out

    found: list[np.ndarray] = []
    for label in sorted(set(labels)):
        own = np.flatnonzero(labels == label)
        start = rng.choice(own, min(centroids, len(own)), replace=False)
        current = np.stack([mean(np.array([i])) for i in start], axis=1)
        for _ in range(6):
            near = cosines(current)[own].argmax(1)
            groups = [own[near == k] for k in range(current.shape[1])]
            current = np.stack([mean(g) for g in groups if len(g) > 1] or [mean(own)], axis=1)
        found += list(current.T)
    matrix = np.stack(found, axis=1)
    cos = cosines(matrix)
    near, top = cos.argmax(1), cos.max(1)
    totals = {x: (labels == x).sum() for x in set(labels)}
    names, keep, least = [], [], []
    for k in range(matrix.shape[1]):
        own = near == k
        if own.sum() < 5:
            continue
        votes = {x: (labels[own] == x).sum() / totals[x] for x in totals}
        names.append(str(max(sorted(votes), key=votes.get)))
        keep.append(k)
        least.append(REJECT_SLACK * float(np.quantile(top[own], REJECT_QUANTILE)))
    return Model(idf, np.asfortranarray(matrix[:, keep]), names, np.array(least, np.float32))


#: Letters by script, for units in which a lost end mark joined sentences of two scripts.
_RUNS = re.compile("|".join(f"[{x}][^\\W{''.join(y for y in ('A-Za-zÀ-ɏ', '඀-෿', '஀-௿', 'ऀ-ॿ', '฀-๿', '぀-ヿ一-鿿') if y != x)}]*(?:[\\W\\d]+[{x}]+)*" for x in ("A-Za-zÀ-ɏ", "඀-෿", "஀-௿", "ऀ-ॿ", "฀-๿", "぀-ヿ一-鿿")))
_FOUR_LETTERS = re.compile(r"[^\W\d_](?:[\W\d_]*[^\W\d_]){3}")
_SCRIPTS = [re.compile(f"[{x}]") for x in ("A-Za-zÀ-ɏ", "඀-෿", "஀-௿", "ऀ-ॿ", "฀-๿", "぀-ヿ一-鿿")]
_OTHERS = [re.compile("[" + "".join(s.pattern[1:-1] for s in _SCRIPTS if s is not own) + "]") for own in _SCRIPTS]
_DISGUISED = re.compile("[Ͱ-ӿ！-～]")
MIXED_LETTERS, MIXED_WORDS = 20, 3


def _by_script(start: int, end: int, text: str):
    """The unit, or its long one-script runs if it has at least two of them; a single foreign name isn't one."""
    if _DISGUISED.search(text):
        text = folder()(text)
    own = next((k for k, s in enumerate(_SCRIPTS) if s.search(text)), None)
    if own is not None and _OTHERS[own].search(text):
        long = [r for r in _RUNS.findall(text) if sum(map(str.isalpha, r)) >= MIXED_LETTERS and (len(r.split()) >= MIXED_WORDS or r[0] >= "ก")]
        if len(long) > 1:
            yield from ((start, end, r) for r in long)
            return
    yield start, end, text


def readable_units(text: str | None, scanned: bool) -> list[tuple[int, int, str]]:
    """(start, end, text) of the sentences and list items of a page; sentences need an end mark."""
    if not text:
        return []
    if scanned:  # blank out edge lines, keeping offsets
        lines = text.split("\n")
        gone, _ = furniture(lines)
        text = "\n".join(" " * len(x) if k in gone else x for k, x in enumerate(lines))
    return [x for s, e, k, t in units(text) for x in _by_script(s, e, t) if (k == "item" or (k == "sentence" and _ENDED.search(t))) and _FOUR_LETTERS.search(t)]


def hash_limit(rows: int, wanted: int) -> int:
    """Of hashes below 2**63, the limit under which some twice ``wanted`` of ``rows`` rows fall; never 0."""
    return _HASHES - 1 if rows <= 2 * wanted else max(1, _HASHES * 2 * wanted // rows)


def learn(pages: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model from ``pages(page_id, langs, scanned, text)``: of the pages with one label, the ``per_label`` of least hash of each label.

    Without a labelled page the model rejects every unit.
    """
    labelled = pages.where("size(langs) = 1 and length(text) > 0").select("page_id", F.element_at("langs", 1).alias("label"), "scanned", "text").where("label is not null")
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: the column doesn't hold languages")
    rows: list[tuple[str, str]] = []
    if sizes:
        limits = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(hash_limit(n, per_label)))])
        hashed = labelled.withColumn("hash", F.xxhash64("page_id").bitwiseAND(F.lit(_HASHES - 1))).where(F.col("hash") < limits[F.col("label")]).dropDuplicates(["page_id"])
        least = Window.partitionBy("label").orderBy("hash", "page_id")  # over some twice ``per_label`` rows
        sample = hashed.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= per_label).collect()
        if not sample:
            raise ValueError("no page of the sample is left")
        for r in sorted(sample, key=lambda r: (r.label, r.rank)):
            rows += [(r.label, t) for _, _, t in readable_units(r.text, r.scanned)]
    return fit(rows) if rows else Model(np.ones(1 << BITS, np.float32), np.zeros((1 << BITS, 1), np.float32), ["und"], np.ones(1, np.float32))


def segments(pages: DataFrame, model: Model) -> DataFrame:
    """``pages(page_id, langs, scanned, text)`` to its stretches: ``(page_id, langs, start_at, end_at, lang, confidence)``.

    A stretch joins neighbouring units of one language; its confidence is their mean, weighted by length.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, langs, scanned, texts = (c.to_pylist() for c in b.columns)
        owner, spans, words = [], [], []
        for i, (s, t) in enumerate(zip(scanned, texts)):
            for start, end, text in readable_units(t, s):
                owner.append(i)
                spans.append((start, end))
                words.append(text)
        found = []
        for a in range(0, len(words), 4000):
            found += model.classify(words[a : a + 4000])
        rows: list[list] = []
        for i, (start, end), (lang, conf) in zip(owner, spans, found):
            if lang is None:
                continue
            if rows and rows[-1][0] == i and rows[-1][3] == lang:
                rows[-1][2] = end
            else:
                rows.append([i, start, end, lang, 0.0, 0])
            rows[-1][4] += conf * (end - start)
            rows[-1][5] += end - start
        columns = (
            pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([langs[r[0]] for r in rows], pa.list_(pa.string())),
            pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
            pa.array([r[3] for r in rows], pa.string()), pa.array([round(r[4] / max(r[5], 1), 4) for r in rows], pa.float64()),
        )
        return pa.RecordBatch.from_arrays(list(columns), names=["page_id", "langs", "start_at", "end_at", "lang", "confidence"])

    source = pages.select(F.col("page_id").cast("bigint"), "langs", F.coalesce("scanned", F.lit(False)).alias("scanned"), "text").where("length(text) > 0")
    return map_batches(source, run, "page_id bigint, langs array<string>, start_at int, end_at int, lang string, confidence double", rows=1000)


def relabelled(found: DataFrame) -> DataFrame:
    """``segments`` to the languages of pages whose labels are wrong or incomplete: ``(page_id, lang)``."""
    per_page = found.groupBy("page_id").agg(F.array_sort(F.collect_set("lang")).alias("written"), F.first("langs").alias("langs"))
    labels = F.array_sort(F.array_distinct(F.coalesce("langs", F.expr("cast(array() as array<string>)"))))
    return per_page.where(F.col("written") != labels).select("page_id", F.explode("written").alias("lang"))
