"""Look-alikes, encodings, sentences, languages, scans and leaks on small fixtures."""

import random

import pytest

from pagemill.llm import encoding, languages, leaks, lookalike, scans, sentences

TEXTS = {
    "en": ["The board met at 8 p.m. on Monday to hear Mr. Fox.", "A sum of Rs. 500 was paid for the survey of the northern canal.", "Was the report of the committee really approved at the request of the villagers?"],
    "fr": ["Le conseil a examiné le dossier écrit après un long débat.", "M. Martin a payé 12,5 € au greffier pour le relevé de la région.", "Pourquoi le ministère a-t-il rejeté le règlement de la ville ?"],
    "de": ["Der Schreiber hat über den Vertrag mit dem Bauern gesprochen und ging.", "Nach Nr. 8 Abs. 3 sind z. B. 23 Meter zulässig, ca. 9 weniger als früher.", "Wurde der Bericht in der Stadt wirklich abgelehnt und verschoben?"],
    "si": ["ගොවියා ඊළඟ වාරය සඳහා පාලම අනුමත කළේය.", "නිලධාරියා පසුගිය සතියේ තීරණය ප්‍රකාශයට පත් කළේය.", "කමිටුව නැවතත් ඉල්ලීම සම්පූර්ණ කළේය ද?"],
    "ja": ["書記は計画書を受け取った。", "委員会は本当に新しい通知を公表したのか？", "明日まで待ちます。"],
}


# --- look-alikes


def test_classes_are_transitive_and_disjoint():
    seen = [m for c in lookalike.classes() for m in c]
    assert len(seen) == len(set(seen))
    u = lookalike.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        u.join(a, b)
    assert sorted(map(tuple, u.classes())) == [("a", "b", "c", "d"), ("x", "y")]


@pytest.mark.parametrize(("a", "b", "same"), [("fine", "ﬁne", True), ("Mr. а", "Mr. a", True), ("ｔｈｅ", "the", True), ("අා", "ආ", True), ("ඔ්", "ඕ", True), ("கெள", "கௌ", True), ("é", "é", True), ("a​b", "ab", True), ("a b", "a b", True), ("a‐b", "a-b", True), ("日", "⽇", True), ("Than", "than", False), ("pres", "près", False), ("a  b", "a b", False), ("පත්රය", "පත්‍රය", False), ("a\nb", "a b", False), ("x.", "x", False), ("වර්", "වර්‍", True)])
def test_equal_looking(a, b, same):
    for counts in ({}, {"а": 99, "අා": 99}):
        r = lookalike.rewriter(lookalike.representatives(counts))
        assert (r(a) == r(b)) is same and r(r(a)) == r(a)


def test_pairs(spark):
    rows = [("page", 0, 1, "the"), ("page", 0, 2, "thе"), ("page", 0, 3, "the"), ("page", 0, 2, "thе"), ("lexicon", 1, 1, "the"), ("lexicon", 2, 2, "thе"), ("lexicon", 1, 3, "ｔhe"), ("page", 0, 4, None), ("page", 0, 5, "")]
    df = spark.createDataFrame(rows, "record_kind string, scope bigint, id bigint, text string")
    table = lookalike.learn(df)
    got = {tuple(r) for r in lookalike.lookalike_pairs(lookalike.keyed(df, table)).collect()}
    assert got == {("page", 1, 2), ("page", 2, 3), ("lexicon", 1, 3)}
    assert lookalike.lookalike_pairs(lookalike.keyed(df.limit(0), lookalike.learn(df.limit(0)))).count() == 0
    assert [r.text for r in lookalike.canonical(df.where("id = 4 or id = 5"), table).orderBy("id").collect()] == [None, ""]


# --- encodings

CLEAN = [*sum(TEXTS.values(), []), "CHÂTEAU ÂGE © 2019 No. 83", "&[ñ´ xv´ ur]> &R`u ÿp œa ¾¾", "« Il sera signé. »", "n’était rien où", "வணிகர் “x” …", "नई पुल के लिए", "", "é" * 2000]


@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_garbled_is_restored(page):
    for text in ["ලිපිකරු ප්‍රදේශයේ වාර්තාව", "கொமுநி ஆட்சிமன்றம்", "अधिकारी ने पुल के लिए", "ชาวนาจากลา", "dépassé 7,98 mètres près de", "für Bögen zulässig", "协议还没有完成。我们必须等待。"]:
        garbled = "".join(encoding._chars(page).get(b, chr(b)) for b in text.encode())
        assert encoding.restore(garbled)[0] == text
        mixed = "Clean words. " + garbled + " More."
        new, first, last = encoding.restore_aligned(mixed)
        assert new == "Clean words. " + text + " More." and len(first) == len(last) == len(new)
        assert first[0] == 0 and last[-1] == len(mixed) and all(a < b for a, b in zip(first, last))


def test_twice_and_other_encodings():
    twice = "dépassé où rien"
    for _ in range(2):
        twice = "".join(encoding._chars("cp1252").get(b, chr(b)) for b in twice.encode())
    assert encoding.restore(twice)[0] == "dépassé où rien"
    assert encoding.restore("The ledger of the board and the farmer".encode().decode("utf-16-le"))[0] == "The ledger of the board and the farmer"
    assert encoding.restore("年度计划由理事会保存".encode("gb2312").decode("latin-1"))[0] == "年度计划由理事会保存"
    assert encoding.restore("Pr�fer")[1] == ["lost"] and encoding.restore(None) == (None, [])


def test_clean_text_stays():
    for text in CLEAN:
        assert encoding.restore(text) == (text, [])


# --- sentences


def cut(text):
    return [text[a:b] for a, b, _, _ in sentences.units(text)]


def test_sentences():
    for own in TEXTS.values():
        text = ("" if own is TEXTS["ja"] else " ").join(own)
        assert cut(text) == own
    assert cut("# Title 3\n\nMr. A. B. Fox met Dr. Who\nat 8 a.m. today. “We go. It is late.” he said. Copies went to X ... and Y.") == ["Title 3", "Mr. A. B. Fox met Dr. Who\nat 8 a.m. today.", "“We go. It is late.” he said.", "Copies went to X ... and Y."]
    assert cut("- one two\n- three. four\n\n1. five\n(a) six\n\n| a | b |\n|---|---|\n\nEnd.") == ["one two", "three. four", "five", "six", "End."]
    assert cut("ในปี 1968 กรมแกแก้ไขประกาศจำนวน 1129 ฉบับ เสมียนจากลายื่นสะพานต่อสภา") == ["ในปี 1968 กรมแกแก้ไขประกาศจำนวน 1129 ฉบับ", "เสมียนจากลายื่นสะพานต่อสภา"]
    assert cut("රු. 5 ක්. ඒ. ජේ. සිල්වා මහතා ගියේය. පෙ.ව. 8 ට.") == ["රු. 5 ක්.", "ඒ. ජේ. සිල්වා මහතා ගියේය.", "පෙ.ව. 8 ට."]
    assert cut("Er kam am 17. März an. Sie ging.") == ["Er kam am 17. März an.", "Sie ging."]
    assert cut("") == cut("\n \n") == cut("​") == []
    assert len(cut("x" * 200_000)) == 1


def test_sentence_offsets_of_stored_text(spark):
    stored = "​One­ two.‍ Three four.​"
    spans = [(a, b) for a, b, _, _ in sentences.units(stored)]
    assert [stored[a:b] for a, b in spans] == ["One­ two.", "Three four."]
    df = spark.createDataFrame([(1, stored, "x"), (2, None, "x"), (3, "", "x")], "record_id bigint, text string, kind string")
    assert [(r.record_id, r.start_at, r.end_at) for r in sentences.sentences(df).collect()] == [(1, *s) for s in spans]


# --- languages


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    rows = [(lang, t) for lang, own in TEXTS.items() for t in own for _ in range(20)]
    wrong = [(rng.choice(list(TEXTS)), t) for _, t in rng.sample(rows, 30)]
    return languages.fit(rows + wrong)


def test_languages_learn_from_noisy_labels(model):
    for lang, own in TEXTS.items():
        assert [x for x, _ in model.classify(own)] == [lang] * len(own)
    assert model.classify(["ገበሬው ወደ ገበያ ሄደ"])[0][0] is None and model.classify([]) == []


def test_segments(spark, model):
    text = TEXTS["si"][0] + " " + TEXTS["en"][1] + "\n\n" + TEXTS["en"][2]
    rows = [(1, ["si"], False, text), (2, None, False, TEXTS["fr"][0]), (3, ["en"], False, TEXTS["en"][0]), (4, None, False, ""), (5, ["si"], None, None), (6, [], True, "Amtsblatt für Tiefbau Mars — 15.02.2002\n\n" + TEXTS["en"][0] + "\n- 4 -")]
    df = spark.createDataFrame(rows, "page_id bigint, langs array<string>, scanned boolean, text string")
    found = languages.segments(df, model)
    one = found.where("page_id = 1").orderBy("start_at").collect()
    assert [r.lang for r in one] == ["si", "en"] and text[one[1].start_at : one[1].end_at] == text[text.index("A sum") :] and all(0.5 < r.confidence <= 1 for r in one)
    assert {tuple(r) for r in languages.relabelled(found).collect()} == {(1, "si"), (1, "en"), (2, "fr"), (6, "en")}
    assert languages.segments(df, languages.learn(df.limit(0))).count() == 0


# --- scans

PAGE = "Weekly Notice — 4.03.2021\n\nThe committee approved the re-\nport of the two-\nthirds majority. The cornmittee\nmet on Monday.\n45,997.78\n\nCivil office 41/761\n- 3 -"


def test_scans(spark):
    clean = "The committee approved the report of the two-thirds majority of the committee.\n"
    rows = [(k, "d", clean * 6, None) for k in range(12)] + [(20, "d", PAGE, "x"), (20, "d", PAGE, "x"), (21, "d", None, None), (22, "d", " \n", None)]
    found = scans.Findings(spark, spark.createDataFrame(rows, "ocr_id bigint, doc string, text string, word string"))
    got = {(r.line_no, r.kind) for r in found.found().where("ocr_id = 20").collect()}
    assert got == {(0, "furniture"), (2, "hyphen"), (4, "misread"), (8, "furniture"), (9, "furniture")}
    text = scans.paragraphs(found).where("ocr_id = 20").first().text
    assert text == "The committee approved the report of the two-thirds majority. The committee met on Monday. 45,997.78"
    none = scans.Findings(spark, spark.createDataFrame([], "ocr_id bigint, doc string, text string"))
    assert none.found().count() == 0


def test_scans_of_rare_words(spark):
    """A word of the dictionary has its misreadings found, however small its share; a name does not, nor does an opener of sentences count as one."""
    often = "the board met at noon and the report was read to the council by the clerk of the town.\n" * 1500
    rare = "the granary of the town was by the quay of Kelzer. After the board met the one-eyed clerk came.\n" * 20
    rows = [(k, "d", often) for k in range(8)] + [(8, "d", rare)]
    rows += [(20, "d", "the board met.\nthe grauary was read\nby the clerk. Aftcr the board\nmet in Kelzcr the clerk was one-\neyed and the\nco-\nuncil met at noon and the\nboard met.")]
    found = scans.Findings(spark, spark.createDataFrame(rows, "ocr_id bigint, doc string, text string"))
    got = {(r.line_no, r.kind, r.word, r.fixed) for r in found.found().where("ocr_id = 20").collect()}
    assert got == {(1, "misread", "grauary", "granary"), (2, "misread", "aftcr", "after"), (5, "hyphen", "council", None)}


def test_links_of_corrections(spark):
    """What a misreading is corrected to is no misreading itself."""
    rows = [("en", "committee", 5000, 5000, 0), ("en", "cornmittee", 100, 100, 0), ("en", "cornmitfee", 1, 1, 0), ("en", "board", 5, 5, 0)]
    counted = spark.createDataFrame(rows, "lang string, word string, n bigint, lower bigint, proper bigint")
    got = {(r.word, r.fixed) for r in scans.corrections(spark, counted, scans.dictionary(counted)).collect()}
    assert got == {("cornmittee", "committee"), ("cornmitfee", "committee")}


# --- leaks

ITEM = "The curved glacier of Rindulnavdultas lifts a sextant near Quenpelmar and 749 walnuts from Brelannavfal stand beside the painted sextant before the narrow kettle of Tasketmardul turns another silver lantern for the heavier umbrella"
OTHER = "Each orchard that Osttunvelost weighs costs Kelnavzer 549 lattices so Lanketborost heats another narrow lantern beside the colder violin of Marholthotho"


def test_leaks(spark):
    words = ITEM.split()
    edited = [w if i % 5 else "other" for i, w in enumerate(words)]
    docs = {
        1: "Intro. " + ITEM + ". End.", 2: ITEM.upper().replace(" ", "  "), 3: "x " + " ".join(words[5:15]) + " y", 4: "x " + " ".join(words[5:12]) + " y", 5: " ".join(edited), 6: ITEM.replace("glacier", "gla-\ncier").replace("walnuts", "wal\nnuts"),
        7: ITEM.replace("a", "а"), 8: "\n".join("> " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6)), 9: "nothing at all", 10: None, 11: "", 12: "z " * 20_000 + ITEM, 13: " ".join(OTHER.split()[:20]) + " and " + ITEM,
    }
    d = spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (1, ITEM)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find(d, items).collect()}
    assert got == {(k, 1) for k in (1, 2, 3, 5, 6, 7, 8, 12, 13)} | {(13, 2)}
    assert leaks.find(d, items.limit(0)).count() == 0 and leaks.find(d.limit(0), items).count() == 0


def brute_align(item, doc):
    best, longest = (0, 0), 0
    table = [[(0, 0)] * (len(doc) + 1) for _ in range(len(item) + 1)]
    run = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item):
        for j, y in enumerate(doc):
            same = x == y
            s, k = table[i][j]
            options = [(0, 0), (s + (2 if same else -1), k + same), (table[i][j + 1][0] - 1, table[i][j + 1][1]), (table[i + 1][j][0] - 1, table[i + 1][j][1])]
            table[i + 1][j + 1] = max(o if o[0] > 0 else (0, 0) for o in options)
            run[i + 1][j + 1] = run[i][j] + 1 if same else 0
            best, longest = max(best, table[i + 1][j + 1]), max(longest, run[i + 1][j + 1])
    return best[1], longest


def test_alignment_against_brute_force():
    import numpy as np

    rng = random.Random(9)
    for _ in range(150):
        item, doc = [rng.randint(0, 5) for _ in range(rng.randint(1, 12))], [rng.randint(-1, 5) for _ in range(rng.randint(1, 20))]
        assert leaks.align(item, np.array(doc, np.int32)) == brute_align(item, doc)
