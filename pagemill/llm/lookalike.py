"""Problem 1: one consistent form for text that looks the same but is stored with different characters.

Look-alike strings and code points are joined into transitive classes by union-find; the representative of a class is its
most frequent member in the collection; text is rewritten greedily (leftmost, longest) by an Aho-Corasick automaton until
nothing changes. Invisible characters are dropped before, but for joiners that change the written conjunct.

Defined results: null stays null; case, accents, punctuation, line breaks and double spaces stay visible differences, and so
do circled, raised and lowered characters. A record delivered again counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Letters of other alphabets that look like a Latin letter, each string beside the one it resembles.
CYRILLIC, CYRILLIC_AS = "асеһіјорѕухԁԛԝАВЕЅІЈКМНОРСТУХ", "acehijopsyxdqwABESIJKMHOPCTYX"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"
#: Letters of further alphabets with the shape of a Latin letter: Coptic, Cherokee, and rarer Cyrillic ones.
COPTIC, COPTIC_AS = "ⲞⲟⲤⲥⲎⲔⲘⲚⲢⲣⲦⲬⲭ", "OoCcHKMNPpTXx"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPSTVWZ"
CYRILLIC_MORE, CYRILLIC_MORE_AS = "ѵӏ", "vl"
#: Tags of the character database for forms and widths of the same character; circles, raised and lowered ones are visible.
FORMS = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")
#: Kana that look like Han characters or like each other.
KANA, KANA_AS = "ニロカトエタハヘー", "二口力卜工夕八へ一"
#: Letter sequences that are drawn as one letter: Sinhala, Tamil, Devanagari, Thai.
SEQUENCES = {
    "අා": "ආ", "අැ": "ඇ", "අෑ": "ඈ", "එ්": "ඒ", "ඔ්": "ඕ", "උෟ": "ඌ", "ඔෟ": "ඖ", "ෙෙ": "ෛ", "ැැ": "ෑ", "ෘෘ": "ෲ",
    "அா": "ஆ", "ஒள": "ஔ", "ெள": "ௌ", "எா": "ஏ",
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाे": "ो", "ाै": "ौ",
    "ํา": "ำ", "เเ": "แ",
}
SPACES = "              　"
HYPHENS = "‐‑‒⁃﹣"
VIRAMAS = "්्্੍્୍్್്"
#: Invisible format characters; a joiner stays between a virama and a letter where the script writes the pair otherwise.
_INVISIBLE = "­͏؜᠎​‎‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
_DROP = re.compile(f"[{_INVISIBLE}]|(?<![{VIRAMAS}])‍|‍(?![ऀ-෿])|(?<!्)(?<!க்)‌|‌(?![क-हஷ])")
#: Presentation forms and letters beyond the first plane: many members, none part of a longer one.
_BEYOND = re.compile("[\ufb1d-\ufdff\ufe70-\ufefc\U00010000-\U0010ffff]")
_MAYBE_DROP = re.compile(f"[{_INVISIBLE}‌‍]")


class UnionFind:
    """Transitive classes of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        path = []
        while (p := self.parent.setdefault(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            self.parent[y] = x
        return x

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values() if len(c) > 1]


def _same_forms():
    """Code points that are a form or width of other characters, from the character database."""
    for code in range(0x80, 0x20000):
        tag, _, _ = unicodedata.decomposition(chr(code)).partition(" ")
        if tag not in FORMS:
            continue
        plain = unicodedata.normalize("NFKC", chr(code))
        if plain != chr(code) and tag != "<compat>" or unicodedata.category(chr(code))[0] == "L" or 0x2E80 <= code < 0x2FE0:
            yield chr(code), plain


@lru_cache(None)
def classes() -> tuple[tuple[str, ...], ...]:
    """Transitive look-alike classes; a property of characters alone, the same for every input."""
    u = UnionFind()
    for a, b in [*zip(CYRILLIC, CYRILLIC_AS), *zip(GREEK, GREEK_AS), *zip(COPTIC, COPTIC_AS), *zip(CHEROKEE, CHEROKEE_AS), *zip(CYRILLIC_MORE, CYRILLIC_MORE_AS), *zip(KANA, KANA_AS), *SEQUENCES.items(), *((x, " ") for x in SPACES), *((x, "-") for x in HYPHENS), *_same_forms()]:
        u.join(unicodedata.normalize("NFC", a), unicodedata.normalize("NFC", b))
    return tuple(tuple(c) for c in u.classes())


def count_members(batch_text: str) -> Counter:
    """Occurrences of class members in ``batch_text``."""
    chars = Counter(batch_text)
    out = Counter({m: n for c in classes() for m in c if len(m) == 1 and (n := chars.get(m))})
    for c in classes():
        for m in c:
            if len(m) > 1 and all(x in chars for x in m) and (n := batch_text.count(m)):
                out[m] = n
    return out


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Each other member of a class to its most frequent one; ties go to the NFKC-stable, shorter, smaller one."""
    out = {}
    for c in classes():
        best = min(c, key=lambda m: (-counts.get(m, 0), unicodedata.normalize("NFKC", m) != m, len(m), m))
        out |= {m: best for m in c if m != best}
    return out


class Rewriter:
    """Canonical form of a text under a table of replacements."""

    def __init__(self, table: dict[str, str]):
        import ahocorasick

        # The automaton looks through a node's branches one by one: the many members of _BEYOND are mapped before it.
        self.beyond = {ord(old): new for old, new in table.items() if len(old) == 1 and _BEYOND.match(old)}
        self.automaton = ahocorasick.Automaton()
        for old, new in table.items():
            if len(old) > 1 or ord(old) not in self.beyond:
                self.automaton.add_word(old, (len(old), new))
        self.automaton.make_automaton()
        longer = [old for old in table if len(old) > 1]
        # Quick looks that clean text passes without a walk through the automaton.
        self.single = re.compile("[" + re.escape("".join(old for old in table if len(old) == 1 and ord(old) not in self.beyond)) + "]")
        self.start = re.compile("[" + re.escape("".join({x[0] for x in longer})) + "][" + re.escape("".join({x[1] for x in longer})) + "]") if longer else None

    def __call__(self, text: str) -> str:
        if _MAYBE_DROP.search(text):
            text = _DROP.sub("", text)
        text = unicodedata.normalize("NFC", text)
        if _BEYOND.search(text):
            text = unicodedata.normalize("NFC", text.translate(self.beyond))
        if not (self.single.search(text) or (self.start and self.start.search(text))):
            return text
        seen: list[str] = []
        while text not in seen:  # a replacement may complete another member
            seen.append(text)
            at, parts = 0, []
            for last, (size, new) in self.automaton.iter_long(text):
                parts += [text[at : last + 1 - size], new]
                at = last + 1
            if not parts:
                return text
            text = unicodedata.normalize("NFC", "".join([*parts, text[at:]]))
        # The fixed point; of forms that turn into each other the smallest.
        return min(seen[seen.index(text) :])


_rewriters: dict[int, Rewriter] = {}


def rewriter(table: dict[str, str]) -> Rewriter:
    key = hash(frozenset(table.items()))
    if key not in _rewriters:
        _rewriters[key] = Rewriter(table)
    return _rewriters[key]


@lru_cache(1)
def folder() -> Rewriter:
    """The rewriter without any counts: a fixed form for comparisons inside one operator."""
    return Rewriter(representatives({}))


def _member_counts(texts: DataFrame, weight: str | None = None) -> DataFrame:
    """``(member, n)`` of each batch of ``texts``; with ``weight``, each text counts that often."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter = Counter()
        texts = b.column(0).to_pylist()
        if weight is None:
            counts = count_members("\n".join(x for x in texts if x))
        else:
            for x, times in zip(texts, b.column(1).to_pylist()):
                for member, n in count_members(x or "").items():
                    counts[member] += n * times
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["member", "n"])

    return map_batches(texts.select("text", *([weight] if weight else [])), run, "member string, n bigint", rows=4000)


def learn(texts: DataFrame) -> dict[str, str]:
    """The replacement table for ``texts(record_kind, id, text)``: counts over all records, added up in Spark; one row a class member returns.

    Texts aren't shuffled to count a record once: all deliveries are counted, and what the repeated ones hold is taken off
    again. Which records are repeated is found from their ids alone.
    """
    key = ["record_kind", "id"]
    again = texts.where("text is not null").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("more", 1 - F.col("n"))
    repeated = texts.where("text is not null").join(again, key).dropDuplicates(key)
    counts = _member_counts(texts).unionByName(_member_counts(repeated, "more"))
    rows = counts.groupBy("member").agg(F.sum("n").alias("n")).collect()  # one row a member of the fixed classes
    return representatives({r.member: r.n for r in rows})


def canonical(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """``df(..., text)`` with ``text`` in its consistent form; other columns as they are."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rewrite, i = rewriter(table), b.schema.get_field_index("text")
        new = pa.array([None if x is None else rewrite(x) for x in b.column(i).to_pylist()], pa.string())
        return b.set_column(i, pa.field("text", pa.string()), new)

    return map_batches(df, run, df.schema)


def keyed(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """``df(record_kind, scope, id, text)`` to ``(record_kind, scope, id, look, own)``: 128-bit hashes of the consistent and the stored text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest as digest

        rewrite = rewriter(table)
        texts = b.column(3).to_pylist()
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([digest(rewrite(x).encode()) for x in texts], pa.binary()), pa.array([digest(x.encode()) for x in texts], pa.binary())], names=["record_kind", "scope", "id", "look", "own"])

    source = df.select("record_kind", F.col("scope").cast("bigint"), F.col("id").cast("bigint"), "text").where("text is not null")
    return map_batches(source, run, "record_kind string, scope bigint, id bigint, look binary, own binary")


GROUP = ["record_kind", "scope", "look"]
#: Rows of one stored form that one task joins; a form with more is spread over as many salts as that takes.
SALTED_ROWS = 20_000


def mixed_forms(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of the groups that look the same but are stored in more than one form, and those forms with their counts:
    ``(..., id, own)`` and ``(..., own, n, salts)``. Groups of exact copies only cost nothing but their hashes."""
    rows = keys.dropDuplicates().checkpoint()  # read several times below instead of rewriting every text again
    forms = rows.groupBy(*GROUP, "own").agg(F.count("*").alias("n"))
    mixed = forms.groupBy(*GROUP).agg(F.count("*").alias("forms"), F.sum("n").alias("whole")).where("forms > 1")
    kept = forms.join(mixed, GROUP).withColumn("salts", F.ceil(F.col("n") / SALTED_ROWS).cast("int"))
    return rows.join(mixed.select(*GROUP), GROUP, "left_semi"), kept


def lookalike_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of records within a scope that look the same but are stored differently: ``(record_kind, id_a, id_b)``.

    Distinct forms are paired first, and records are joined to these pairs of forms side by side, spread by salts, so that
    exact copies of one form never meet each other: the work follows the pairs that come out.
    """
    members, forms = mixed_forms(keys)
    salted = members.join(forms.select(*GROUP, "own", "salts"), [*GROUP, "own"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts").cast("bigint")).cast("int"))
    side = lambda x: [F.col("own").alias(f"own_{x}"), F.col("salts").alias(f"salts_{x}")]
    pairs = forms.select(*GROUP, *side("a")).join(forms.select(*GROUP, *side("b")), GROUP).where("own_a < own_b")
    of = lambda x: salted.select(*GROUP, F.col("own").alias(f"own_{x}"), "salt", F.col("id").alias(f"id_{x}"))
    spread = lambda df, x: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(f"salts_{x}") - 1)))
    first = spread(pairs, "a").join(of("a"), [*GROUP, "own_a", "salt"]).drop("salt")
    both = spread(first, "b").join(of("b"), [*GROUP, "own_b", "salt"])
    return both.where("id_a != id_b").select("record_kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def lookalike_classes(keys: DataFrame) -> DataFrame:
    """The same without pairs: ``(record_kind, id, class_id, links)`` of each record that has a differing look-alike; the class
    is named by its smallest id, ``links`` are the records of the class that are stored differently."""
    members, forms = mixed_forms(keys)
    named = members.groupBy(*GROUP).agg(F.min("id").alias("class_id"))
    counted = forms.select(*GROUP, "own", (F.col("whole") - F.col("n")).alias("links")).join(named, GROUP)
    return members.join(counted, [*GROUP, "own"]).select("record_kind", "id", "class_id", "links")
