"""Scripts, sizes and repetitions beyond the usual: encodings, look-alikes, labels, pieces."""

import random

import pytest

from pagemill.llm import encoding, languages, leaks, lookalike, scans, sentences, split

TEXTS = {
    "ru": "Вчера комитет рассмотрел отчёт и отложил решение. Он ушёл в 8 часов.",
    "uk": "Гірський комітет розглянув звіт і її дії. Рішення відклали, Гість пішов. Рёбра",
    "el": "Η επιτροπή εξέτασε την έκθεση και ανέβαλε την απόφαση.",
    "pl": "Wczoraj zażółć gęślą jaźń, a komitet odłożył decyzję.",
    "cs": "Výbor včera projednal zprávu, měšťan odešel.",
    "ko": "위원회는 어제 보고서를 검토하고 결정을 미루었다. 그 날",
    "ar": "راجعت اللجنة التقرير أمس وأجلت القرار.",
    "he": "הוועדה בחנה את הדו״ח אתמול",
    "hi": "अधिकारी ने पुल के लिए",
    "si": "ලිපිකරු ප්‍රදේශයේ වාර්තාව",
    "ta": "கொமுநி ஆட்சிமன்றம்",
    "ja": "委員会は昨日報告書を検討した。",
    "fr": "Un été près de l’état où C’est noté à Noël",
    "emoji": "Well done 😀👍 all!",
}


def garble(text, page):
    return "".join(encoding._chars(page).get(b, chr(b)) for b in text.encode())


@pytest.mark.parametrize("page", encoding.CODE_PAGES)
def test_every_script_comes_back(page):
    for text in TEXTS.values():
        assert encoding.restore(text) == (text, [])
        for stored in (garble(text, page), "Clean words. " + garble(text, page) + " More."):
            new, first, last = encoding.restore_aligned(stored)
            assert new == encoding.restore(stored)[0] == stored.replace(garble(text, page), text)
            assert len(first) == len(last) == len(new) and first[0] == 0 and last[-1] == len(stored)


def test_garbled_many_times():
    for text in TEXTS.values():
        stored = text
        for _ in range(6):
            stored = garble(stored, "cp1252")
        assert encoding.restore(stored)[0] == text


def test_genuine_text_with_odd_pairs():
    for text in ["« Été » l’été d’état voilà»” C’est «État» qu’à Noël", "„Die Ä“ und „Straße“ für Übung", "ÑÑBw ÿXk Ñ¾TB gñ´* œ´X", "olá» GÄ” x", "Гість, Рёбра, №5 «В»"]:
        assert encoding.restore(text) == (text, [])


def test_forms_and_shapes_are_one():
    fold = lookalike.folder()
    assert [fold(x) for x in ("𝐇𝐞𝐥𝐥𝐨", "ѵӏ", "Ꭺ", "ⲟ", "ﻩ")] == ["Hello", "vl", "A", "o", "ه"]
    assert [fold(x) for x in ("①", "x²", "½")] == ["①", "x²", "½"]


def test_rewriting_ends_at_a_fixed_point():
    rng = random.Random(5)
    members = [m for c in lookalike.classes() for m in c]
    for counts in ({}, {m: rng.randint(0, 9) for m in members}):
        r = lookalike.rewriter(lookalike.representatives(counts))
        for _ in range(300):
            text = "".join(rng.choice(members) for _ in range(rng.randint(1, 8)))
            assert r(r(text)) == r(text)


def test_representatives_count_records_once(spark):
    rows = [("page", 1, "ｗ")] * 5 + [("page", 2, "w"), ("page", 3, "w"), ("page", 4, None), ("page", 4, None)]
    df = spark.createDataFrame(rows, "record_kind string, id bigint, text string")
    assert lookalike.learn(df)["ｗ"] == "w"


def test_pairs_and_classes_against_brute_force(spark, monkeypatch):
    """Salted joins give every pair once, and classes the same links."""
    monkeypatch.setattr(lookalike, "SALTED_ROWS", 7)
    rng = random.Random(8)
    rows = [("page", 0, i, rng.choice(["the", "thе", "ｔhe", "than"])) for i in range(90)] + [("lexicon", i % 3, i, rng.choice(["a", "а"])) for i in range(30)]
    df = spark.createDataFrame(rows + rows[:20], "record_kind string, scope bigint, id bigint, text string")
    keys = lookalike.keyed(df, lookalike.representatives({}))
    fold = lookalike.folder()
    want = {(k, i, j) for k, s, i, x in rows for k2, s2, j, y in rows if k == k2 and s == s2 and i < j and x != y and fold(x) == fold(y)}
    assert [tuple(r) for r in lookalike.lookalike_pairs(keys).orderBy("record_kind", "id_a", "id_b").collect()] == sorted(want)
    links = {}
    for k, i, j in want:
        links[k, i], links[k, j] = links.get((k, i), 0) + 1, links.get((k, j), 0) + 1
    assert {(r.record_kind, r.id): r.links for r in lookalike.lookalike_classes(keys).collect()} == links


def test_many_copies_and_one_variant(spark):
    """A hundred thousand copies of one text and a single variant: as many pairs as copies, and no work beyond them."""
    from pyspark.sql import functions as F

    rows = spark.range(100_001).select(F.lit("page").alias("record_kind"), F.lit(0).cast("bigint").alias("scope"), F.col("id"), F.when(F.col("id") == 50_000, "thе").otherwise("the").alias("text"))
    pairs = lookalike.lookalike_pairs(lookalike.keyed(rows, lookalike.representatives({})))
    assert pairs.count() == 100_000 and pairs.where("id_a != 50000 and id_b != 50000").isEmpty()


def test_sample_limit_of_any_size():
    for n in (1, 799, 801, 10**6, 10**10, 10**15):
        share = languages.hash_limit(n, 400) / 2**63
        assert 0 < share <= 1 and min(n, 400) <= n * share * 1.01 + 1e-6 and n * share < 801


def test_labels_of_the_collection(spark):
    """A language that nobody named beforehand is found."""
    rng = random.Random(3)
    words = {"xx": "komitea eilen raportti päätös siirtää kokous silta joki".split(), "yy": "comitetul ieri raportul decizia amânat ședința podul râul".split()}
    rows = [(i, [lang], False, " ".join(rng.choice(words[lang]) for _ in range(12)).capitalize() + ".") for i, lang in enumerate(["xx", "yy"] * 60)]
    df = spark.createDataFrame(rows, "page_id bigint, langs array<string>, scanned boolean, text string")
    found = languages.segments(df, languages.learn(df)).collect()
    assert len(found) >= 118 and all([r.lang] == r.langs for r in found)


@pytest.mark.parametrize(("text", "strong"), [("නව ගම", False), ("बाद में", False), ("தம் இந்", False), ("එක. දෙක", True), ("एक। दो", True), ("one… two", True), ("“Go.” He", True), ("。次", True)])
def test_sentence_ends_among_cut_points(text, strong):
    assert (2 in split._cut_points(text.encode())[1].tolist()) is strong


def test_leaks_of_short_words_and_hot_items(spark):
    """Ten characters of Chinese, an item of few letters, one item in most documents, repeated rows, texts of many items."""
    zh = "应村民要求屿澜登记处公布了公开计划书记员说桥梁工程还没有完成我们必须等待"
    tiny = "an ox or a hen is up to me"
    hot = "the curved glacier of the north lifts a sextant near the harbour and seven walnuts"
    many = [f"item {k} holds quiet marble bridges beside lantern {k} under willow number {k * 7} today" for k in range(150)]
    items = spark.createDataFrame([(1, zh), (2, tiny), (3, hot), (4, "cat"), (5, "ab")] + [(100 + k, t) for k, t in enumerate(many)], "item_id bigint, text string")
    docs = [(1, "前言。" + zh[4:15] + "。"), (2, "前言。" + zh[4:12] + "。"), (3, "He said: " + tiny.upper() + "!"), (4, "\n".join(many)), (None, hot), (5, hot + "."), (5, hot + ".")] + [(k, f"{k} x {hot} y") for k in range(10, 60)]
    found = leaks.find(spark.createDataFrame(docs, "doc_id bigint, text string"), items)
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert len(got) == len(set(got))
    assert {x for x in got if x[1] < 100} == {(1, 1), (3, 2), (None, 3), (5, 3)} | {(k, 3) for k in range(10, 60)}
    assert {x for x in got if x[1] >= 100} == {(4, 100 + k) for k in range(150)}


def test_filter_passes_every_seed():
    import numpy as np

    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 5000, np.int64).view(np.uint64)
    bits = np.zeros(1 << leaks.FILTER_BITS, bool)
    for k in range(leaks.PROBES):
        bits[leaks.probes(seeds, k)] = True
    packed = np.packbits(bits).reshape(-1, 1 << (leaks.PART_BITS - 3))
    known = leaks.Filter({k: packed[k].tobytes() for k in np.flatnonzero(packed.any(1))})
    assert len(known.passed(seeds)) == len(seeds) and len(known.passed(rng.integers(0, 2**63, 100_000, np.int64).view(np.uint64))) < 20


def cut(text, *know):
    return [text[a:b] for a, b, _, _ in sentences.units(text, *know)]


def test_gaps_of_chinese_and_japanese():
    assert cut("今日は晴れです 明日は雨です") == ["今日は晴れです", "明日は雨です"] and cut("我来了 他走了") == ["我来了", "他走了"]
    assert cut("東京 大阪") == ["東京 大阪"] and cut("彼は 来た。次。") == ["彼は 来た。", "次。"] and cut("行\n数です。") == ["行\n数です。"]


def test_abbreviations():
    for text in ("Gov. Brown spoke.", "Univ. of Oxford.", "Jan. 5 was cold.", "The U.S. Senate met."):
        assert cut(text) == [text]


def test_words_of_the_collection(spark):
    """Words that nobody listed: what stands only before numbers holds a gap open, what ends paragraphs closes it, abbreviations are learned."""
    rng = random.Random(6)
    names = ["ตาก", "เลย", "น่าน", "ระนอง", "สตูล", "ลำปาง", "พังงา", "กระบี่"]
    thai = [f"{rng.choice(names)}อยู่ทางเหนือ ราคา {rng.randint(10, 99)} หน่วยตลอดมา{rng.choice(names)}\n\n" for _ in range(400)]
    chinese = [f"{rng.choice('甲乙丙丁戊己')}到学校上课{rng.choice('天地人山水火')}说完毕。" for _ in range(400)]
    english = [f"Plot xq. {rng.randint(1, 9)} of the xq. {rng.randint(1, 9)} land was let. The rest was sold.\n\n" for _ in range(60)]
    df = spark.createDataFrame([("".join(thai[k : k + 20]),) for k in range(0, 400, 20)] + [("".join(chinese[k : k + 20]),) for k in range(0, 400, 20)] + [(x,) for x in english] + [(None,), ("",)], "text string")
    know = sentences.learn(df)
    assert "xq" in know.abbreviations and "sold" not in know.abbreviations
    assert cut("The xq. 5 was let. It was sold.", know) == ["The xq. 5 was let.", "It was sold."] and len(cut("The xq. 5 was let. It was sold.")) == 3
    assert "说完毕" in know.closing and cut("甲到学校上课山说完毕 乙到学校上课人说完毕", know) == ["甲到学校上课山说完毕", "乙到学校上课人说完毕"]
    assert know.closing["ราคา"][1] >= 300 and cut("ตากราคา ระนอง", know) == ["ตากราคา ระนอง"] and cut("ตากราคา ระนอง") == ["ตากราคา", "ระนอง"]
    assert sentences.learn(df.limit(0)).opening == {}
    rows = sentences.sentences(spark.createDataFrame([(1, "甲到学校上课山说完毕 乙到学校上课人说完毕")], "record_id bigint, text string"), know)
    assert rows.count() == 2


def test_long_runs_without_spaces():
    assert len(cut("ก" * 100_000)) == 1 and len(cut("天" * 100_000 + " " + "地" * 100_000)) == 1
    assert len(cut("ตาก " * 3000)) == 3000


def test_misreadings_in_a_large_vocabulary(spark):
    """Of 100,000 words by Zipf's law, misreadings of rare ones are found as well as those of common ones."""
    rng = random.Random(12)
    vocabulary = sorted({"".join(rng.choice("abdeghiklmnoprstuvwyz") for _ in range(rng.randint(6, 11))) for _ in range(101_000)})[:100_000]
    rng.shuffle(vocabulary)
    counted = {w: 3_000_000 // (k + 20) for k, w in enumerate(vocabulary)}
    misread = {}
    for k in range(0, 100_000, 40):
        w = vocabulary[k]
        options = [(r, p) for r, p in scans.MISREADINGS["latin"] if p in w and r.islower() and r.isascii()]
        if options and counted[w] >= 2 * scans.RATIO:
            read, printed = rng.choice(options)
            at = rng.choice([i for i in range(len(w)) if w.startswith(printed, i)])
            misread[w[:at] + read + w[at + len(printed) :]] = w
    rows = [("en", w, n, n, 0) for w, n in counted.items()] + [("en", w, 1, 1, 0) for w in misread if w not in counted]
    df = spark.createDataFrame(rows, "lang string, word string, n bigint, lower bigint, proper bigint")
    got = {r.word: r.fixed for r in scans.corrections(spark, df, scans.dictionary(df)).collect()}
    assert len(misread) > 2000 and sum(got.get(w) == fixed for w, fixed in misread.items()) >= 0.9 * len(misread)


def test_confidences_are_evidence(spark):
    """A suspect reading needs a less common word, a sure one a commoner; no confidence changes nothing."""
    rows = [("en", "granary", 20, 20, 0, None), ("en", "grauary", 2, 2, 0, None), ("en", "harbour", 20, 20, 0, 90.0), ("en", "harbonr", 2, 2, 0, 40.0), ("en", "library", 40, 40, 0, None), ("en", "llbrary", 2, 2, 0, 99.0), ("en", "journey", 40, 40, 0, None), ("en", "jouruey", 2, 2, 0, 80.0)]
    df = spark.createDataFrame(rows, "lang string, word string, n bigint, lower bigint, proper bigint, conf double")
    assert {r.word for r in scans.corrections(spark, df, scans.dictionary(df)).collect()} == {"harbonr", "jouruey"}
    page = scans._PageWords("the bro-\nken one", confs=[90.0, 30.0, 50.0, None])
    assert [(w[1], w[6]) for w in page.words] == [("the", 90.0), ("broken", 30.0), ("one", None)]
    assert {w[6] for w in scans._PageWords("the bro-\nken one", confs=[1.0]).words} == {None}


def test_confusions_of_a_script_without_a_table(spark):
    """Devanagari: words broken over lines are joined, and an exchange of letters that many pairs show is undone."""
    rng = random.Random(9)
    words = ["".join(rng.choice("कगचजटडतदपबमयरलसह") + rng.choice(["", "ा", "ि", "ु"]) for _ in range(4)) + "घन" for _ in range(12)]
    pages = [(k, "d", "\n".join(" ".join(rng.sample(words, 8)) for _ in range(12))) for k in range(30)]
    wrong = [w.replace("घ", "ध") for w in words]
    pages += [(100 + k, f"d{k}", "यह पृष्ठ है\n" + w + " यहाँ है\nऔर " + words[0][:3] + "-\n" + words[0][3:] + " फिर\nअंत में है") for k, w in enumerate(wrong)]
    found = scans.Findings(spark, spark.createDataFrame(pages, "ocr_id bigint, doc string, text string"))
    assert {(r.word, r.fixed) for r in found.fixes.collect()} == set(zip(wrong, words))
    assert {(r.line_no, r.kind) for r in found.found().where("ocr_id = 103").collect()} == {(1, "misread"), (2, "hyphen")}
    assert "और " + words[0] + " फिर" in scans.paragraphs(found).where("ocr_id = 103").first().text


def test_telling_words_of_labelled_pages(spark):
    """A language that no list names is told by the words of its pages."""
    rows = [(["es"], "el informe de la junta se aplazó y el acuerdo no fue firmado por la ciudad")] * 6 + [(["en"], "the report of the board was read by the clerk and it was not signed")] * 6 + [(None, "x y")]
    words = scans.telling_words(spark.createDataFrame(rows, "langs array<string>, text string"))
    assert {"el", "la", "informe"} <= words["es"] and words["en"] >= scans.STOP_WORDS["en"] and words["de"] == scans.STOP_WORDS["de"]
    page = scans._PageWords("el acuerdo\nde la junta", scans._telling(words))
    assert {w[0] for w in page.words} == {"es"}
    assert scans.telling_words(spark.createDataFrame([], "langs array<string>, text string")) == scans.STOP_WORDS
