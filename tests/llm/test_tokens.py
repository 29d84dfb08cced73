"""Encoding, splitting and term counts against plain references, with odd inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import split, terms, tokens

PATH = tokens.vocabulary()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="needs the vocabulary files")
ODD = [None, "", " ", "  \x85", "\x1c\x1d", "a" * 3000, "<|endoftext|> it's\n\n\n  x  ", "ශ්‍රී ලංකාව 12.5% — “x”", "𝒜𝒷 𐎠 𠮷", "\n\n" * 40 + "end", "don't 're  we'll", " ".join(["word"] * 300)]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 1024), (100, 40), (37, 20)])
def test_encode_equals_library(spark, chunk, overlap):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab c\n'sක්‍ 1.\t") for _ in range(rng.randint(1, 600))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, PATH, chunk, overlap).collect()}
    want = reference(texts)
    assert [got[i] for i in range(len(texts))] == want
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df, PATH), PATH).collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]
    assert tokens.encode(df.limit(0), PATH).count() == 0


def test_split(spark):
    long = "\n\n".join(f"Sentence {i} is here. It has a second part, which is longer." for i in range(900))
    texts = [None, "", "short", long, "x" * 70_000, "කම " * 9000, "\n" * 20_000 + "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = split.split(df, PATH).orderBy("doc_id", "piece_no").collect()
    sizes = [len(x) for x in reference(texts)]
    assert {r.doc_id for r in rows} == {i for i, n in enumerate(sizes) if n > split.LIMIT}
    e = tokens.encoder(PATH)
    for i in {r.doc_id for r in rows}:
        own = [r for r in rows if r.doc_id == i]
        assert own[0].start_at == 0 and own[-1].end_at == len(texts[i])
        for r in own:
            assert r.text == texts[i][r.start_at : r.end_at] and r.n_tokens == len(e.ids(r.text)) <= split.LIMIT
        for a, b in zip(own, own[1:]):
            assert a.start_at < b.start_at <= a.end_at < b.end_at
            assert len(e.ids(texts[i][b.start_at : a.end_at])) <= split.OVERLAP + 2
    assert all(r.text.rstrip().endswith(".") for r in rows if r.doc_id == 3)


def test_terms(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "si", None]), rng.choice(["a", "a", "a", "b", "c", None, "d" * 3000]), rng.randint(1, 30), i // 2, rng.choice([None, 1, 5])) for i in range(1500)]
    rows = [rows[i - i % 2] for i in range(len(rows))]  # every entry is delivered twice
    df = spark.createDataFrame(rows, "lang string, word string, record_id bigint, entry_id bigint, freq int")
    want: dict = {}
    for lang, word, record, _, freq in {(a, b, c, d, e) for a, b, c, d, e in rows}:
        if word is not None:
            total, lists = want.setdefault((lang, word), [0, set()])
            want[lang, word] = [total + (freq or 0), lists | {record}]
    got = {(r.lang, r.word): (r.total, r.lists) for r in terms.term_counts(df).collect()}
    assert got == {k: (t, len(s)) for k, (t, s) in want.items()}
    assert terms.term_counts(df.limit(0)).count() == 0
    sizes = spark.createDataFrame([("en", 30, 1), (None, 30, None)], "lang string, n_lists bigint, n_tokens bigint")
    marked = {(r.lang, r.word): r.marks for r in terms.marked(terms.term_counts(df), sizes).collect()}
    assert marked[None, "a"] == ["common"] and marked["si", "a"] == []


def test_hot_term_spreads(spark):
    df = spark.range(20_000).select(F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("word"), F.col("id").alias("record_id"), F.col("id").alias("entry_id"), F.lit(1).alias("freq"))
    assert terms.term_counts(df).where("word = 'hot'").first().lists == 13_333
