"""Readers, finishing, sets, reports and plans: own fixtures, brute force, and plans that must hold at scale."""

import io
import math
import random
import re
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from pagemill import session
from pagemill.functions import health, html, metrics, render, script
from pagemill.operators import correct, documents, evaluate, lexicon, ocr, router
from pagemill.sources import deliveries, files, office


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
WORD = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Water</w:t></w:r></w:p><w:p><w:r><w:t>The level</w:t></w:r><w:r><w:tab/><w:t>rose.</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
CORE = '<p:core xmlns:p="urn:p" xmlns:dc="urn:dc"><dc:title> Report </dc:title></p:core>'
ODT = '<o:doc xmlns:o="urn:o" xmlns:t="urn:t" xmlns:b="urn:b"><o:body><o:text><t:h t:outline-level="3">Head</t:h><t:p>One<t:s t:c="2"/>two</t:p><t:list><t:list-item><t:p>a</t:p><t:list><t:list-item><t:p>b</t:p></t:list-item></t:list></t:list-item></t:list><b:table><b:table-row><b:table-cell><t:p>x</t:p></b:table-cell></b:table-row></b:table></o:text></o:body></o:doc>'
SLIDE = '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Plan {0}</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>point</a:t></a:r></a:p></p:sp></p:sld>'
BOOK = '<package xmlns="urn:x" xmlns:dc="urn:d"><metadata><dc:title>Tale</dc:title></metadata><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
SHEET = '<worksheet xmlns="urn:s"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="2"><c r="B2" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>'
OFFICE = {
    "a.docx": (archive(word__document_DOT_xml=WORD, docProps__core_DOT_xml=CORE), "## Water\n\nThe level\trose.\n\n- one\n  - two\n\n| a\\|b |  |\n|---|---|\n| 1 |  |", "Report"),
    "b.odt": (archive(content_DOT_xml=ODT), "### Head\n\nOne  two\n\n- a\n  - b\n\n| x |\n|---|", None),
    "c.pptx": (archive(ppt__presentation_DOT_xml="<p/>", ppt__slides__slide10_DOT_xml=SLIDE.format(10), ppt__slides__slide2_DOT_xml=SLIDE.format(2)), "## Plan 2\n\n- point\n\n## Plan 10\n\n- point", None),
    "d.xlsx": (archive(xl__workbook_DOT_xml='<w xmlns="urn:s"><sheet name="Sums"/></w>', xl__sharedStrings_DOT_xml="<s><si><t>k</t></si></s>", xl__worksheets__sheet1_DOT_xml=SHEET), "## Sums\n\n| k |  | 7 |\n|---|---|---|\n|  | z |  |", None),
    "e.epub": (archive(**{"META-INF__container_DOT_xml": '<c><rootfile full-path="OPS/p.opf"/></c>', "OPS__p_DOT_opf": BOOK, "OPS__a_DOT_xhtml": "<p>last</p>", "OPS__b_DOT_xhtml": "<h1>first</h1>"}), "# first\n\nlast", "Tale"),
    "f.csv": ("k;v\n1;\"a;b\"\n".encode(), "| k | v |\n|---|---|\n| 1 | a;b |", None),
    "g.docx": (b"PK\x03\x04broken", None, None), "h.doc": (b"\xd0\xcf\x11\xe0", None, None), "i.docx": (archive(word__document_DOT_xml="<w><unclosed>"), None, None), "j.docx": (archive(other_DOT_txt="x"), None, None),
}


def test_office_files(spark):
    for name, (raw, markdown, title) in OFFICE.items():
        assert office.office_to_markdown(name, raw) == (markdown, title), name
    df = spark.createDataFrame([(n, bytearray(raw)) for n, (raw, _, _) in OFFICE.items()] + [("k.docx", None)], "path string, content binary")
    got = {r.doc: r for r in files.extract(df).collect()}
    assert got["a.docx"].markdown == OFFICE["a.docx"][1] and got["a.docx"].title == "Report" and got["g.docx"].markdown is None


ENCODED = {
    "cp1252": "Le café était fermé à Noël, dit-il. “Oui” — c’est l’été.", "cp1251": "Вчера комитет рассмотрел отчёт и отложил решение.", "cp1253": "Η επιτροπή εξέτασε την έκθεση και ανέβαλε την απόφαση.", "cp1250": "Wczoraj zażółć gęślą jaźń, a komitet odłożył decyzję.", "koi8_r": "Комитет рассмотрел отчёт.",
    "cp1256": "راجعت اللجنة التقرير أمس وأجلت القرار", "shift_jis": "委員会は昨日報告書を検討した。", "euc_jp": "委員会は昨日報告書を検討した。", "euc_kr": "위원회는 어제 보고서를 검토하고 결정을 미루었다.", "gb18030": "委员会昨天审议了报告，推迟了决定。", "big5": "委員會昨天審議了報告，推遲了決定。", "utf-16-le": "The board met.", "utf-16-be": "The board met.",
}


def test_encodings_are_guessed(spark):
    rows = [(name, bytearray(text.encode(name))) for name, text in ENCODED.items()] + [("utf-8", bytearray("ශ්‍රී é".encode())), ("none", None), ("empty", bytearray())]
    got = {r.name: r.t for r in spark.createDataFrame(rows, "name string, raw binary").select("name", files.decode(F.col("raw")).alias("t")).collect()}
    assert got == ENCODED | {"utf-8": "ශ්‍රී é", "none": None, "empty": ""}


def test_text_files_and_selections(spark, tmp_path):
    for name, raw in {"a.txt": b"one", "sub/b.md": b"tw\xff", ".c.txt": b"x", "d.html": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    assert sorted(r.text for r in files.text_files(spark, str(tmp_path)).collect()) == ["one", "tw�"]
    (tmp_path / "sel.jsonl").write_text('{"doc": "a", "page": 1}\n\n{"doc": "b", "page": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "sel.jsonl"), "doc string, page int").count() == 2
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n')
    assert files.csv_tables(spark, str(tmp_path / "t.csv")).first().b == "x\ny"


def test_finish_and_assemble(spark):
    lex, rules = spark.createDataFrame([("මාර්ගය", 30)], "word string, freq bigint"), spark.createDataFrame([("ශ", "ග", 0.4)], correct.RULES_SCHEMA)
    pages = spark.createDataFrame([("d", 1, "මාර්ශය\r\nමාර්ශය", 40.0), ("d", 2, "plain ﬁne", 90.0), ("d", 3, None, None)], "doc string, page int, text string, confidence double")
    conf = spark.createDataFrame([("d", 1, "x", 10.0)], "doc string, page int, token string, conf double")
    done = correct.finish(pages, conf, lex, rules)
    assert {r.page: (r.text, r.flags) for r in done.collect()} == {1: ("මාර්ගය\nමාර්ගය", ["corrected:2"]), 2: ("plain fine", []), 3: (None, [])}
    assert {r.page: r.flags for r in correct.finish(pages, None, None, None).collect()} == {1: [], 2: [], 3: []}
    plans = spark.createDataFrame([("d", k, "ocr", None, None, None, ["inspector:scan"], None, "") for k in (1, 2, 4)], "doc string, page int, plan string, method string, markdown string, moved int, flags array<string>, ocr_langs array<string>, md string")
    got = {r.page: r.flags for r in router.assemble(plans, done.join(pages.select("doc", "page", "confidence"), ["doc", "page"])).collect()}
    assert got[1] == ["inspector:scan", "corrected:2", "low_ocr_confidence"] and got[2] == ["inspector:scan"] and got[4] == ["inspector:scan", "unreliable_text_layer:ocr_unavailable"]
    probes = spark.createDataFrame([("d", 1, "ගම්මානය මාර්ගය වැව ළඟ ය"), ("d", 1, "one two"), ("d", 2, "short")], "doc string, page int, text string")
    langs = {r.page: (r.ocr_langs, r.flags[-1]) for r in router.resolve_langs(plans, probes).collect()}
    assert langs == {1: (["si"], "probed_langs:sin"), 2: (["en"], "inspector:scan"), 4: (["en"], "inspector:scan")}


def test_loading_word_lists(spark, tmp_path):
    lexicon.build(spark.createDataFrame([("වැව වැව",)], "text string"), "si").save(str(tmp_path / "si"))
    lexicon.build(spark.createDataFrame([("word",)], "text string"), "en").save(str(tmp_path / "en"))
    (tmp_path / "bad").write_text("nothing\n")
    (tmp_path / "other").write_text("#another-list 2 lang=si types=1 tokens=3\nවැව\t3\n")
    found, note = correct.load(spark, "si", str(tmp_path / "si"))
    assert note is None and found.counts.first().freq == 2 and correct.load(spark, "ta", "nowhere") == (None, None)
    for name in ("en", "bad", "gone"):
        found, note = correct.load(spark, "si", str(tmp_path / name))
        assert found is None and "not corrected" in note
    assert lexicon.read(spark, str(tmp_path / "other"), "#another-list 2").counts.first().freq == 3


def test_ranked_values_against_statistics(spark):
    """Quantiles and medians of a key that holds nearly all rows, of small keys and of a null key, over several ranges."""
    rng = random.Random(11)
    groups = {"hot": [rng.choice([1.0, 2.5, rng.uniform(0, 9)]) for _ in range(3000)], "two": [5.0, 1.0], "one": [4.0], None: [3.0, 3.0, 8.0], "void": []}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("void", None), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in evaluate.quantiles_exclusive(df, ["k"], "v").collect()}
    assert set(got) == {"hot", "two", None}
    for k in got:
        q = statistics.quantiles(groups[k], n=20)
        assert all(math.isclose(got[k][f"p{p}"], q[i]) for p, i in ((10, 1), (25, 4), (50, 9), (75, 14), (90, 17)))
    s = {r.k: r for r in evaluate.stats(df, ["k"], "v").collect()}
    assert {k: s[k].median for k in s} == {k: statistics.median(v) if v else None for k, v in groups.items()} and s["void"].n == 0
    whole = evaluate.quantiles_exclusive(df, [], "v").first()
    assert math.isclose(whole.p50, statistics.quantiles([v for _, v in rows if v is not None], n=20)[9])
    plan = evaluate.ranked(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def brute_fill(pages, paths, train, hold, least, per_doc, most):
    import hashlib

    sets = {"train": [], "holdout": []}
    for k, doc in enumerate(sorted(paths, key=lambda p: (hashlib.sha1(p.encode()).hexdigest(), p))):
        if len(sets["train"]) >= train and len(sets["holdout"]) >= hold:
            break
        own = [(doc, page) for page, fm in sorted(pages.get(doc, [])) if fm >= least and page < most][:per_doc]
        if own:
            to_train = (k % 3 or len(sets["holdout"]) >= hold) and len(sets["train"]) < train
            sets["train" if to_train else "holdout"].extend(own)
    return {(name, *x) for name, rows in sets.items() for x in rows}


def test_sets_are_filled_in_turn(spark):
    for seed, (train, hold) in enumerate([(6, 3), (2, 9), (50, 4), (1, 1), (9, 0)]):
        rng = random.Random(seed)
        paths = [f"doc{k}" for k in range(30)]
        pages = {p: [(n, rng.choice([10, 900])) for n in range(rng.randint(0, 4))] for p in paths if rng.random() < 0.7}
        rows = [(p, n, fm, 1) for p, own in pages.items() for n, fm in own]
        got = evaluate.fill_sets(spark.createDataFrame(rows, "doc string, page int, fm bigint, other bigint"), spark.createDataFrame([(p,) for p in paths], "doc string"), train, hold)
        assert {(r.part, r.doc, r.page) for r in got.collect()} == brute_fill(pages, paths, train, hold, 600, 2, 50)


def test_reports(spark):
    files_ = spark.createDataFrame([("x/a.png", "# One two", "ocr", 1.5), ("x/b_scan.png", "three", "text-layer", 0.5), ("x/c.png", "lost", "ocr", 1.0)], "file string, markdown string, methods string, seconds double")
    truths = spark.createDataFrame([("x/a.gt.md", "One  too"), ("x/b.gt.txt", "three")], "file string, text string")
    rows = evaluate.bench_run(files_, truths)
    assert {r.file: (round(r.cer, 4), r.wer, r.methods, r.lang) for r in rows.collect()} == {"x/a.png": (round(1 / 7, 4), 0.5, "ocr", "en"), "x/b_scan.png": (0.0, 0.0, "text-layer", "en")}
    lines = [r.line for r in evaluate.results_table(rows).collect()]
    assert lines[0].split() == ["file", "lang", "CER", "%", "WER", "%", "sec", "method"] and lines[1].split() == ["x/a.png", "en", "14.29", "50.00", "1.5", "ocr"] and lines[3] == "" and "n=2" in lines[4] and len(lines) == 5
    import json

    found = json.loads(evaluate.results_json(rows).first().json)
    assert [x["file"] for x in found] == ["x/a.png", "x/b_scan.png"] and found[0]["wer"] == 0.5
    pages = spark.createDataFrame([("d", 1, "legacy_converted", "මාර්ගය වැව", ["legacy_unmatched_tokens:3"], 0.2), ("d", 2, "ocr", "x", [], 1.0), ("d", 3, "legacy_converted", "", [], 0.4)], "doc string, page int, kind string, markdown string, flags array<string>, seconds double")
    read = spark.createDataFrame([("d", 1, "මාර්ගය වැව", 3.0), ("d", 2, "x", 2.0), ("d", 3, "abc", 1.0)], "doc string, page int, text string, seconds double")
    results = evaluate.conversion(pages, read)
    assert {r.page: (r.cer, r.word_f1) for r in results.collect()} == {1: (0.0, 1.0), 2: (0.0, 1.0), 3: (1.0, 0.0)}
    report = {r.measure: (r.n, r.median, r.most) for r in evaluate.conversion_report(results).collect()}
    assert report["cer"] == (2, 0.5, 1.0) and report["ocr_seconds"] == (2, 2.0, 3.0) and [tuple(r) for r in evaluate.other_methods(results).collect()] == [("ocr", 1)]


def test_small_things(spark):
    one = spark.range(1)
    holds = one.select(*[render.hold_note(F.lit(k), F.lit(3 * 1024**3), F.lit(512), F.lit(7.25)) for k in ("low_memory", "critical", "load")]).first()
    assert holds[0].startswith("low memory (3.0 GiB available, 512 B reserved") and holds[1].startswith("Critical memory pressure") and holds[2].startswith("system load 7.3 is high")
    targets = one.select(documents.target_path("out", F.lit("in/a.b/c.pdf"), "json"), documents.target_path("out/x.md", F.lit("c.pdf"), "markdown", single=True), documents.target_path("out", F.lit("in/.hid"), "text")).first()
    assert tuple(targets) == ("out/in/a.b/c.json", "out/x.md", "out/in/.hid.txt")
    c = one.select(script.probed(script.script_counts(F.lit("abcdefghijklmnop ගම්මානය"))), script.probed(script.script_counts(F.lit("abc")))).first()
    assert tuple(c) == (["en"], [])
    glyphs = spark.createDataFrame([("d", 1, "ABCDEF+FMAbhaya", "k"), ("d", 1, "Times", "x"), ("d", 1, "Times", " "), ("d", 1, None, "y")], "doc string, page int, font string, ch string")
    assert tuple(ocr.glyph_counts(glyphs).first()) == ("d", 1, 1, 2)
    order = [r.doc for r in evaluate.shuffled(spark.createDataFrame([(x,) for x in "abcdef"], "doc string"), "doc", 3).orderBy("place").collect()]
    assert sorted(order) == list("abcdef") and order != list("abcdef")


def test_error_rates_of_long_texts(spark):
    rng = random.Random(2)
    words = [rng.choice("ab ba cc dd ee".split()) for _ in range(3000)]
    other = [w for w in words if rng.random() > 0.01]
    df = spark.createDataFrame([(" ".join(words), " ".join(other)), ("", "x"), ("x", ""), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(metrics.wer(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - (len(words) - len(other)) / len(words)) < 1e-9 and got[1:] == [1.0, 1.0, None]
    near = spark.createDataFrame([("x" * 50 + "y" * n, "x" * 50) for n in (0, 5, 40, 400)], "a string, b string")
    assert [r[0] for r in near.select(metrics.edits(F.col("a"), F.col("b"))).collect()] == [0, 5, 40, 400]


def test_health_of_words_against_expressions():
    """Sums over looked-up words equal counting the whole text at once, for tags, marks, odd spaces and long words."""
    rng = random.Random(3)
    parts = ["the", "Of", "*a*nd", "x%y", "ñandu", "ගම්ම", "ෙක", "க்", "ගaé", "<b class='x y'>", "</b>", "#", "12", " ", " ", "\x1cz", "a" * 90, "‍", "<unclosed of the"]
    table = health._Table()
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        words = [w for w in re.split("[\t-\r \x85\xa0  -     　]+", text) if w]
        bare = re.sub("<[^>]*(?:>|$)", "", text).translate(str.maketrans("*_#", "   "))
        tokens = [re.sub("[^A-Za-z]", "", w) for w in re.split("[\t-\r \x85\xa0  -     　]+", bare)]
        got = dict(zip(health.COUNTS, health.count_words([text])[0].tolist()))
        assert got["words"] == sum(bool(re.search("[඀-෿஀-௿]", w)) for w in words) and got["latin"] == len(re.findall("[A-Za-z]", text))
        assert got["tokens"] == sum(len(t) > 1 for t in tokens) and got["function"] == sum(len(t) > 1 and t.lower() in health._FUNCTION for t in tokens)
    assert len(table) == 0


def test_checkpoint_folder_of_a_cluster(spark, monkeypatch):
    """Outside of one process no folder of a machine is ever set."""

    class Context:
        applicationId, master, folder = "a1", "local-cluster[3,2,1024]", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Conf(dict):
        def get(self, key, otherwise=None):
            return dict.get(self, key, otherwise)

    class Session:
        sparkContext, conf = Context(), Conf()

    s = Session()
    assert session.checkpoint_dir(s, "/tmp/x") is None and s.sparkContext.folder is None
    s.sparkContext = Context()
    s.sparkContext.applicationId, s.conf["spark.checkpoint.dir"] = "a2", "hdfs://shared"
    assert session.checkpoint_dir(s, "/tmp/x") == "hdfs://shared" == s.sparkContext.folder
    s.sparkContext, s.conf = Context(), Conf()
    s.sparkContext.applicationId, s.sparkContext.master = "a3", "local[4]"
    assert session.checkpoint_dir(s, "/tmp/x") == "/tmp/x"


def test_router_converts_once(spark):
    """Verification reads the written plan: the conversions don't run again for each use."""
    words = "struct<legacy:array<string>,other:array<string>,mixed:map<string,array<boolean>>,text:string,legacy_chars:bigint,other_chars:bigint>"
    pages = spark.createDataFrame([("d", 1, "text", False, None, [], None)], f"doc string, page int, raw_md string, needs_ocr boolean, reason string, fonts array<string>, legacy_words {words}")
    read = spark.createDataFrame([], "doc string, page int, text string, confidence double")
    plan = router.verify(router.plan(pages), read)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2


def drawn(page):
    """The tree of a page, written out again."""
    tree = html.Tree()
    tree.feed(page)
    tree.close()
    write = lambda n: n if isinstance(n, str) else f"<{n.name}>" + "".join(map(write, n.children)) + f"</{n.name}>"
    return "".join(map(write, tree.root.children))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<b>c<i>d</b>e</i>f</p>", "<p>a<b>c<i>d</i></b><i>e</i>f</p>"), ("<b>a<p>c</b>d</p>", "<b>a</b><p><b>c</b>d</p>"), ("<a>x<div>y<div>z</a>u</div>v</div>", "<a>x</a><div><a>y</a><div><a>z</a>u</div>v</div>"),
        ("<table><b><tr><td>x</td></tr>y</table>z", "<b></b><b>y</b><table><tr><td>x</td></tr></table><b>z</b>"), ("<table>x<td>y</td>z</table>", "xz<table><td>y</td></table>"), ("<div><b>x</div>y", "<div><b>x</b></div><b>y</b>"),
        ("<b><em><u1><u2><u3><aside></b></em>", "<b><em><u1><u2><u3></u3></u2></u1></em></b><aside><b></b></aside>"), ("<b>x<table><tr><td>y</table>z", "<b>x<table><tr><td>y</td></tr></table>z</b>"), ("</p>x</b>", "<p></p>x"), ("<a href=1>x<a href=2>y", "<a>x</a><a>y</a>"),
    ],
)
def test_misnested_pages(page, want):
    assert drawn(page) == want


def test_pages_of_random_tags():
    """No order of tags loses a word or fails."""
    rng = random.Random(21)
    names = "p b i a div table tr td th li ul h2 span blockquote br font em tbody caption button".split()
    for _ in range(400):
        words = [f"w{k}" for k in range(rng.randint(1, 12))]
        page = "".join(w + " " + "".join(rng.choice(["<%s>", "</%s>", "<%s>"]) % rng.choice(names) for _ in range(rng.randint(0, 4))) for w in words)
        assert sorted(re.findall(r"w\d+", drawn(page))) == sorted(words)
        html.html_to_markdown(page)


def test_repeated_deliveries_count_once(spark):
    rng = random.Random(14)
    rows = [(rng.choice([None, *range(4000)]), "t") for _ in range(3000)]
    df = spark.createDataFrame([(k, f"text of {k}") for k, _ in rows], "id bigint, text string").repartition(4)
    got = deliveries.once(df, "id")
    assert sorted((r.id is not None, r.id or 0, r.text) for r in got.collect()) == sorted((k is not None, k or 0, f"text of {k}") for k in {k for k, _ in rows})
    assert deliveries.once(df.limit(0), "id").count() == 0 and deliveries.once(df.where("id = 7").limit(1), "id").count() <= 1
    two = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), (None, 1, "x"), (None, 1, "x")], "k string, i int, text string")
    assert deliveries.once(two, "k", "i").count() == 3
