"""Relational operators against small references written another way."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill.functions import sequences
from pagemill.operators import correct, documents, evaluate, learn, lexicon, ocr, router
from pagemill.plans import catalogue
from pagemill.sources import files


def test_lexicon_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("තීරණය තීරණය, අමාත්‍ය‍ abc",), (None,), ("තීරණය අමාත්‍ය",)], "text string")
    lex = lexicon.build(texts, "si")
    assert {r.word: r.freq for r in lex.counts.collect()} == {"තීරණය": 3, "අමාත්‍ය": 2}
    lex.prune(3).save(str(tmp_path / "lex"))
    back = lexicon.read(spark, str(tmp_path / "lex"))
    assert back.lang == "si" and back.tokens.first()[0] == 5 and [tuple(r) for r in back.counts.collect()] == [("තීරණය", 3)]
    bad = tmp_path / "bad"
    bad.write_text("nothing\n")
    with pytest.raises(ValueError):
        lexicon.read(spark, str(bad))
    bad.write_text(f"{lexicon.MAGIC} lang=si types=1 tokens=1\nword\n")
    with pytest.raises(Exception, match="bad line"):
        lexicon.read(spark, str(bad)).counts.collect()


def brute_variants(word, rules, edits):
    best, frontier = {}, {word: 1.0}
    for depth in range(1, edits + 1):
        step = {}
        for form, score in frontier.items():
            for src, dst, weight in rules:
                for i in range(len(form) - len(src) + 1):
                    if form[i : i + len(src)] == src:
                        new = form[:i] + dst + form[i + len(src) :]
                        if new != word:
                            step[new] = max(step.get(new, 0.0), score * weight)
        for f, s in step.items():
            if s > best.get(f, (0.0, 0))[0]:
                best[f] = (s, depth)
        frontier = step
    return {(f, d, round(s, 9)) for f, (s, d) in best.items()}


def test_variants_against_brute_force(spark):
    rng = random.Random(3)
    rules = [("a", "b", 0.5), ("b", "cc", 0.25), ("cc", "a", 0.125), ("ab", "d", 0.75)]
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    got = correct.variants(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(rules, correct.RULES_SCHEMA))
    by = {w: set() for w in words}
    for r in got.collect():
        by[r.word].add((r.form, r.edits, round(r.weight, 9)))
    assert by == {w: brute_variants(w, rules, 2) for w in words}


LEXICON = [("ගම්මාන", 6), ("වැව", 40), ("සාගරය", 12), ("මාර්ගය", 30), ("බර", 25), ("මර", 2)]
RULES = [("ශ", "ග", 0.4), ("ස", "ප", 0.2), ("ච", "ව", 0.5), ("ට", "බ", 0.2), ("ට", "ම", 0.2)]


def test_corrections(spark):
    lex, rules = spark.createDataFrame(LEXICON, "word string, freq bigint"), spark.createDataFrame(RULES, correct.RULES_SCHEMA)
    words = spark.createDataFrame([("මාර්ශය",), ("චැච",), ("ටර",), ("සාශරය",), ("වැව",), ("කඳුකරය",), (None,)], "word string")
    fixed = lambda o=correct.Options(): {r.word: r.fixed for r in correct.corrections(words, lex, rules, o).collect()}
    assert fixed() == {"මාර්ශය": "මාර්ගය", "චැච": "වැව", "සාශරය": "සාගරය"}
    # Two letters are too short by default; 25 against 2 is clear with the usual margin, not with one of 20.
    assert fixed(correct.Options(min_len=2))["ටර"] == "බර" and "ටර" not in fixed(correct.Options(min_len=2, margin=20.0))
    assert "සාශරය" not in fixed(correct.Options(min_freq=13)) and fixed(correct.Options(min_score=5.0)) == {"මාර්ශය": "මාර්ගය", "චැච": "වැව"}
    assert fixed(correct.Options(max_edits=1)) == {"මාර්ශය": "මාර්ගය", "සාශරය": "සාගරය"}
    texts = spark.createDataFrame([(1, "(මාර්ශය) 17\tචැච;\n\nවැව සාශරය"), (2, None), (3, "")], "id int, text string")
    conf = spark.createDataFrame([(1, "චැච;", 99.0)], "id int, token string, conf double")
    got = {r.id: (r.text, r.changed) for r in correct.correct_texts(texts, None, lex, rules, "si").collect()}
    assert got == {1: ("(මාර්ගය) 17\tවැව;\n\nවැව සාගරය", 3), 2: (None, 0), 3: ("", 0)}
    gated = {r.id: r.text for r in correct.correct_texts(texts, conf, lex, rules, "si").collect()}
    assert gated[1] == "(මාර්ගය) 17\tචැච;\n\nවැව සාගරය"


def test_large_rule_tables_are_joined_by_key(spark):
    """No plan compares every word with every rule, whatever the number of rules; several tables are applied for themselves."""
    words = spark.createDataFrame([("abc",), ("bca",)], "word string")
    many = spark.range(20_001).select(F.concat(F.lit("z"), F.col("id").cast("string")).alias("src"), F.lit("a").alias("dst"), F.lit(0.5).cast("float").alias("weight")).unionByName(spark.createDataFrame([("bc", "x", 0.5)], correct.RULES_SCHEMA))
    out = correct.variants(words, many)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {(r.word, r.form) for r in out.collect()} == {("abc", "ax"), ("bca", "xa")}
    sets = spark.createDataFrame([("one", "a", "b", 0.5), ("two", "a", "c", 0.25)], "rule_set string, src string, dst string, weight float")
    got = {(r.rule_set, r.word, r.form) for r in correct.variants(words, sets, sets=["rule_set"]).collect()}
    assert got == {("one", "abc", "bbc"), ("two", "abc", "cbc"), ("one", "bca", "bcb"), ("two", "bca", "bcc")}


def test_rule_parser(spark):
    lines = spark.createDataFrame([("# c",), ("a\tb\t0.5",), ("a\ta\t0.5",), ("x",), ("c\td\t7",)], "value string")
    assert sorted((r.src, r.dst, r.weight) for r in correct.parse_rules(lines).collect()) == [("a", "b", 0.5), ("c", "d", 1.0)]


TSV = ["level\tpage_num", "5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t70.5\tOld", "5\t1\t1\t1\t1\t2\t0\t0\t9\t9\t88\thar-", "5\t1\t1\t1\t2\t1\t0\t0\t9\t9\t80\tbour", "5\t0\t2\t1\t1\t1\t0\t0\t9\t9\t-1\tමාර්ගය", "4\t1\t1\t1\t1\t1\t0\t0\t9\t9\t90\tno", "5\t1\t1\t1\t1\t3\t0\t0\t9\t9\t90\t "]


def test_tsv_pages(spark):
    words = ocr.parse_tsv(spark.createDataFrame([("d", x) for x in TSV], "doc string, value string"))
    got = ocr.paragraphs(words).collect()
    assert len(got) == 1 and got[0].text == "Old harbour\n\nමාර්ගය" and got[0].words == 3 and abs(got[0].confidence - 79.5) < 1e-3
    assert ocr.paragraphs(words.limit(0)).count() == 0


def test_router(spark):
    from tests.test_functions import ENGLISH, GOOD, LEGACY

    words = "struct<legacy:array<string>,other:array<string>,mixed:map<string,array<boolean>>,text:string,legacy_chars:bigint,other_chars:bigint>"
    schema = f"doc string, page int, raw_md string, needs_ocr boolean, reason string, fonts array<string>, legacy_words {words}"
    data = [
        ("d", 1, ENGLISH * 3, False, None, ["Times"], None), ("d", 2, "පළාෙත් " * 40, False, None, [], None), ("d", 3, " \n", False, None, None, None), ("d", 4, GOOD * 6, True, "scan", [], None),
        ("d", 5, LEGACY * 6, False, None, ["ABCDEF+FMAbhaya", "Times"], None), ("d", 6, LEGACY * 6, False, None, ["Bamini", "Arial"], None), ("d", 7, GOOD * 6, False, None, [], None), ("e", 1, None, False, None, [], None),
    ]
    plan = router.plan(spark.createDataFrame(data, schema))
    got = {(r.doc, r.page): r for r in plan.collect()}
    assert [got["d", k].method for k in range(1, 8)] == ["text_layer", "text_layer_repaired", "empty", None, "legacy_converted", None, "text_layer"]
    assert got["d", 2].moved == 40 and got["d", 4].flags == ["inspector:scan"] and got["d", 6].flags == ["legacy_font:bamini"] and got["d", 6].ocr_langs == ["ta", "en"] and got["e", 1].plan == "empty"
    assert "legacy_convert:no_font_info" in got["d", 5].flags
    read = spark.createDataFrame([("d", 7, "something else " * 30, 60.0), ("d", 4, GOOD, 95.0)], "doc string, page int, text string, confidence double")
    after = {(r.doc, r.page): r for r in router.verify(plan, read).collect()}
    assert after["d", 7].plan == "ocr" and after["d", 7].flags[0].startswith("verify_failed:") and after["d", 1].plan == "text"
    pages = {(r.doc, r.page): r for r in router.assemble(router.verify(plan, read), read).collect()}
    assert pages["d", 7].method == "ocr" and "low_ocr_confidence" in pages["d", 7].flags and pages["d", 4].langs == ["si"] and pages["d", 6].flags[-1] == "unreliable_text_layer:ocr_unavailable"
    assert {r.plan for r in router.plan(spark.createDataFrame(data, schema), router.config(ocr="force")).collect()} == {"ocr"}
    with pytest.raises(ValueError):
        router.config(ocr="sometimes")


def test_documents(spark):
    pages = spark.createDataFrame([("a", 2, "ocr", "two ", 90.0, 1.0), ("a", 1, "text_layer", " one", None, 0.5), ("b", 1, "failed", None, None, None)], "doc string, page int, kind string, markdown string, confidence double, seconds double")
    assert {r.doc: r.text for r in documents.markdown(pages).collect()} == {"a": "one\n\ntwo\n", "b": ""}
    assert documents.markdown(pages, markers=True).where("doc = 'a'").first().text == "<!-- page 1 -->\n\none\n\n<!-- page 2 -->\n\ntwo\n"
    s = {r.doc: r for r in documents.summary(pages).collect()}
    assert s["a"].methods == {"ocr": 1, "text-layer": 1} and s["a"].confidence == 90.0 and s["b"].failed == 1


def test_evaluation(spark):
    import statistics

    xs = [float(x) for x in (1, 5, 2, 8, 9, 4, 4, 7, 3)]
    got = evaluate.quantiles_exclusive(spark.createDataFrame([("k", x) for x in xs] + [("one", 1.0)], "k string, v double"), ["k"], "v").collect()
    q = statistics.quantiles(xs, n=20)
    assert len(got) == 1 and [round(got[0][f"p{p}"], 9) for p in (10, 25, 50, 75, 90)] == [round(q[k], 9) for k in (1, 4, 9, 14, 17)]
    before = spark.createDataFrame([("si_mn_1_clean.png", 0.2, 0.4), ("plain.png", 0.1, 0.1), ("gone.png", 0.1, 0.1)], "file string, cer double, wer double")
    rows = evaluate.compare(before, before.where("file != 'gone.png'")).collect()
    assert [(r.font, r.variant, r.pages) for r in rows] == [("mn", "clean", 1), ("all", "all", 2), ("all", "clean", 1), ("all", "plain", 2)]
    assert tuple(evaluate.unmatched(before, before.where("file != 'gone.png'")).first()) == (3, 2, 2)
    assert spark.range(1).select(evaluate.bucket(F.lit("a"))).first()[0] == 59
    truth = spark.createDataFrame([("x/a.gt.txt", "one"), ("x/a.gt.md", "two"), ("x/b.gt.txt", "three")], "file string, text string")
    hits = {r.file: r.reference for r in evaluate.with_truth(spark.createDataFrame([("x/a.png", "t"), ("x/b_scan.png", "t"), ("x/c.png", "t")], "file string, text string"), truth).collect()}
    assert hits == {"x/a.png": "one", "x/b_scan.png": "three"}


def test_alignment_and_rules(spark):
    assert learn.char_rules("harhour", "harbour") == [("h", "b")] and learn.char_rules("roof", "rooof") == [("r", "ro")] and learn.char_rules("modern", "modem") == [("rn", "m")]
    assert learn.char_rules("a", "a") == learn.char_rules("", "") == learn.char_rules("abcdef", "uvwxyz") == []
    pairs = spark.createDataFrame([("xa", "ya")] * 3 + [("xx", "xx"), ("b", "c")], "word string, truth string")
    got = {(r.src, r.dst): (r.n, r.occurrences) for r in learn.learn_rules(pairs).collect()}
    assert got == {("x", "y"): (3, 5)}
    words = learn.word_pairs(spark.createDataFrame([(1, ["the", "bat", "x"], [90.0, 50.0, 10.0], ["the", "cat", "x"]), (2, None, None, ["a"])], "id int, read array<string>, confs array<float>, truth array<string>"))
    assert sorted((r.word, r.truth) for r in words.collect()) == [("bat", "cat"), ("the", "the"), ("x", "x")]


def whole_table(a, b):
    """Edit distances of all beginnings, and the places that a walk back over them sets against each other."""
    d = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                d[i, j] = min(d.get((i - 1, j), 999) + 1, d.get((i, j - 1), 999) + 1, d.get((i - 1, j - 1), 999) + (i > 0 and j > 0 and a[i - 1] != b[j - 1]))
    i, j, out = len(a), len(b), []
    while i and j:
        if d[i, j] == d[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return d[len(a), len(b)], out[::-1]


def cost(a, b, found):
    return len(a) + len(b) - 2 * len(found) + sum(a[i] != b[j] for i, j in found)


def test_links_against_the_whole_table(monkeypatch):
    rng = random.Random(7)
    cases = [([rng.randint(0, 3) for _ in range(rng.randint(0, 25))], [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]) for _ in range(300)]
    for a, b in cases:
        assert learn.links(a, b) == whole_table(a, b)[1] and sequences.distance(a, b) == whole_table(a, b)[0]
    monkeypatch.setattr(sequences, "TABLE_CELLS", 40)  # halved again and again, still as near
    for a, b in cases:
        found = learn.links(a, b)
        assert found == sorted(set(found)) and cost(a, b, found) <= whole_table(a, b)[0] + 0


def test_accuracy_and_core(spark):
    df = spark.createDataFrame([("g", "a", "a"), ("g", "b", "c"), ("h", "x", "x")], "grp string, word string, truth string")
    assert {r.grp: (r.words, r.wrong) for r in learn.accuracy(df, ["grp"]).collect()} == {"g": (2, 1), "h": (1, 0)}
    cores = spark.createDataFrame([("«(වැව)».",), ("12",), ("a වැ-ව b",), (None,)], "t string").select(learn.core(F.col("t"))).collect()
    assert [r[0] for r in cores] == ["වැව", "", "වැ-ව", None]


def test_mutual_best_against_brute_force(spark):
    rng = random.Random(5)
    boxes = []
    for page in (1, 2):
        for side in "ab":
            for k in range(25):
                x, y = rng.uniform(0, 300), rng.uniform(0, 300)
                boxes.append((page, side, k, x, y, x + rng.uniform(5, 80), y + rng.uniform(5, 80)))

    def iou(p, q):
        w, h = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
        if w <= 0 or h <= 0:
            return 0.0
        area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
        return w * h / (area(p) + area(q) - w * h)

    want = set()
    for page in (1, 2):
        a, b = [x for x in boxes if x[0] == page and x[1] == "a"], [x for x in boxes if x[0] == page and x[1] == "b"]
        best_a = {p[2]: max(b, key=lambda q: (iou(p, q), -q[2])) for p in a}
        best_b = {q[2]: max(a, key=lambda p: (iou(p, q), -p[2])) for q in b}
        want |= {(page, p[2], best_a[p[2]][2]) for p in a if iou(p, best_a[p[2]]) >= 0.1 and best_b[best_a[p[2]][2]][2] == p[2]}
    got = learn.mutual_best(spark.createDataFrame(boxes, "page int, side string, idx int, x0 double, y0 double, x1 double, y1 double"), least=0.1)
    assert {(r.page, r.a_idx, r.b_idx) for r in got.collect()} == want


def test_code_alignment(spark):
    rng = random.Random(2)
    table = {"a": "ක", "b": "ග", "c": "ත", "d": "ද"}
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(200)]
    pairs = spark.createDataFrame([(w, [table[c] for c in w]) for w in words], "codes string, units array<string>")
    got = {r.code: r.unit for r in learn.align_codes(pairs, iterations=3, least=1000).where("rank = 1").collect()}
    assert got == table


def test_paths_against_every_path():
    """The table filled for all words at once finds what trying every path finds."""
    rng, decay = random.Random(4), 0.25
    table = {c: {u: math.log(rng.random()) for u in rng.sample(["", "x", "y", "xy", "yx", "xxy"], 4)} for c in ("a", "b", "ab", "bab")}
    unseen = {c: math.log(rng.random() / 50) for c in table}
    model = learn.CodeModel(table, unseen, 3, decay)

    def tries(codes, units):
        if not codes:
            return [] if units else [(0.0, [])]
        out = []
        for size in range(1, min(3, len(codes)) + 1):
            code = codes[:size]
            if code in table:
                for k in range(min(3, len(units)) + 1):
                    unit = "".join(units[:k])
                    step = table[code].get(unit, unseen[code]) + (size - 1) * math.log(decay)
                    out += [(step + s, [(code, unit), *rest]) for s, rest in tries(codes[size:], units[k:])]
        return out

    words = [("".join(rng.choice("ab") for _ in range(4)), [rng.choice("xy") for _ in range(5)]) for _ in range(30)] + [("abcb", list("xyxyx"))]
    for (codes, units), path in zip(words, model.paths([w[0] for w in words], [w[1] for w in words])):
        every = tries(codes, units)
        if not every:
            assert path is None
            continue
        own = sum(table[c].get(u, unseen[c]) + (len(c) - 1) * math.log(decay) for c, u in path)
        assert abs(own - max(s for s, _ in every)) < 1e-9 and "".join(c for c, _ in path) == codes and "".join(u for _, u in path) == "".join(units)


def test_code_table(spark):
    rows = [("a", "x", 9, 0.9, 1), ("a", "y", 1, 0.1, 2), ("b", "z", 5, 1.0, 1), ("ab", "xz", 8, 1.0, 1), ("ba", "w", 6, 0.75, 1), ("ba", "zx", 2, 0.25, 2), ("c", "q", 1, 1.0, 1)]
    got = {r.code: (r.to, [(x.unit, x.n) for x in r.alternatives]) for r in learn.code_table(spark.createDataFrame(rows, "code string, unit string, n bigint, share double, rank int")).collect()}
    assert got == {"a": ("x", [("y", 1)]), "b": ("z", []), "ba": ("w", [("zx", 2)])}
    pairs = spark.createDataFrame([("ab", "xz", 80.0), ("ab", "xz", 90.0), ("cab", "q", 20.0), ("c", "q", 99.0)], "legacy string, read string, conf double")
    assert [(r.legacy, r.n) for r in learn.pairs_with(pairs, "ab", 5, 50.0).collect()] == [("ab", 2)]


def test_html_markdown_of_every_document(spark, tmp_path):
    rows = [(k, f"Title {k}", None if k == 3 else f"First of {k}.\n\nSecond.") for k in range(7)]
    spark.createDataFrame(rows, "doc_id bigint, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: r.title for r in catalogue.queries()["html_markdown"](spark, str(tmp_path)).collect()}
    assert got == {f"in/{k}.htm": f"Title {k}" for k in range(7)}


def test_code_alignment_of_every_letter(spark, tmp_path):
    rng = random.Random(5)
    letters = "කගතදනඅආඛඝ්ී"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3, 4, 5)))) for _ in range(300)] + ["ක" * 6 + "ඛ" * 8]
    spark.createDataFrame([(1, " ".join(words))], "ocr_id bigint, text string").write.parquet(f"{tmp_path}/ocr_pages.parquet")
    got = catalogue.queries()["code_alignment"](spark, str(tmp_path)).collect()
    assert {r.unit for r in got if len(r.code) == 1} == set(letters)


def test_grid_search(spark):
    lex, rules = spark.createDataFrame(LEXICON, "word string, freq bigint"), spark.createDataFrame(RULES, correct.RULES_SCHEMA)
    pairs = spark.createDataFrame([("මාර්ශය", "මාර්ගය", 50.0), ("මාර්ශය", "මාර්ගය", 96.0), ("කඳුකරය", "කඳුකරය", None)], "word string, truth string, conf double")
    got = learn.simulate(pairs, lex, rules, learn.grid(spark))
    assert got.count() == 144
    r = {x.gate: x for x in learn.best_by_gate(got).collect()}
    assert r[None].fixed == 2 and r[93.0].fixed == 1
    learned = spark.createDataFrame([("ශ", "ග", 12, 0.5), ("ච", "ව", 5, 0.02), ("q", "r", 3, 0.9)], "src string, dst string, n bigint, probability double")
    sets = learn.rule_sets(learned)
    assert {r.rule_set: r.n for r in sets.groupBy("rule_set").agg(F.count("*").alias("n")).collect()} == {"4,0": 2, "4,0.01": 2, "4,0.05": 1, "10,0": 1, "10,0.01": 1, "10,0.05": 1}
    grouped = learn.simulate(pairs.withColumn("grp", F.lit("scan")), lex, sets, learn.grid(spark), by=["grp"])
    assert grouped.count() == 6 * 144 and {x.fixed for x in grouped.where("gate is null and min_score = 0 and margin = 2 and min_freq = 1").collect()} == {2}


def test_files(spark, tmp_path):
    named = {"a.htm": b"<!DOCTYPE html><html><head><title>T</title></head><body><p>caf\xc3\xa9</body></html>", "b.txt": b"caf\xe9 \x93quoted\x94", "c.md": b"# x", "d.bin": bytes(range(8)), "e.docx": b"PK\x03\x04", "f": b"%PDF-1.7\n", "g.txt": b"\xff\xfea\x00b\x00", ".h.txt": b"x", "i.gt.txt": b"x", "j.txt": b""}
    for name, raw in named.items():
        (tmp_path / name).write_bytes(raw)
    d = files.scan(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[-1]: r.f for r in d.select("path", files.sniff(F.col("path"), F.col("content")).alias("f")).collect()}
    assert {k: kinds[k] for k in kinds if k != "g.txt"} == {"a.htm": "html", "b.txt": "text", "c.md": "markdown", "d.bin": None, "e.docx": "office", "f": "pdf"}
    empty = spark.createDataFrame([("x.txt", bytearray())], "path string, content binary")
    assert [r.markdown for r in files.extract(empty).collect()] == [""]
    got = {r.doc.rsplit("/", 1)[-1]: r for r in files.extract(d).collect()}
    assert got["a.htm"].markdown == "café" and got["a.htm"].title == "T" and got["b.txt"].markdown == "café “quoted”" and got["f"].markdown is None


def test_stream(spark, tmp_path):
    from pagemill.streaming import pages as stream

    rows = spark.sql("select 1L as page_id, timestamp'2024-01-01 00:00:00' as ingested_at, 'The text of the page is here' as markdown union all select 1L, timestamp'2024-01-01 01:00:00', 'The text of the page is here' union all select 2L, timestamp'2024-01-02 00:00:00', null")
    rows.write.parquet(str(tmp_path / "in"))
    source = stream.once(stream.read(spark, str(tmp_path / "in"), rows.schema), "page_id", "ingested_at")
    q = stream.judged(source).writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert Counter(r.verdict for r in spark.table("judged").collect()) == {"healthy": 1, "empty": 1}
