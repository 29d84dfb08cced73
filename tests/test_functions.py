"""Text functions on literal fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import fonts, health, html, legacy, metrics, normalize, render, script

GOOD = "බස්නාහිර පළාතේ ගම්පහ දිස්ත්‍රික්කයේ ඉඩම් හිමිකම් නිරවුල් කිරීම සම්බන්ධයෙනි "
LEGACY = "Y%S ,xld m%cd;dka;%sl iudcjd§ ckrcfha w;s úfYI .eiÜ m;%h "
ENGLISH = "The members of the board shall be appointed by the minister and shall not hold any other office under this act "
NAMES = "Colombo Kandy Galle Matara Jaffna Negombo Kurunegala Ratnapura Badulla Trincomalee "


def rows(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(*columns).collect()]


def test_scripts(spark):
    c = script.script_counts(F.col("t"))
    got = rows(spark, ["ශ්‍රී ලංකා Sri Lanka இலங்கை", None, "", "abc"], c["si"], c["ta"], c["latin"], script.languages(c, 0.05, 20), script.dominant(c))
    assert got[0][2] == 8 and len(got[0][3]) == 3
    assert got[1][:3] == got[2][:3] == (0, 0, 0) and got[1][3] == [] and got[1][4] is None
    assert got[3][3:] == ([], "en")


def test_language_arguments(spark):
    got = spark.range(1).select(script.lang_arg(F.array(F.lit("en"), F.lit("si"), F.lit("si"))), script.lang_arg(F.expr("cast(array() as array<string>)")), script.parse_lang(F.lit("Sinhala"))).first()
    assert tuple(got) == ("sin+eng", "eng", "si")


def test_health(spark):
    df = spark.createDataFrame([(GOOD * 4,), ("පළාෙත් " * 40,), ("abc",), (LEGACY * 6,), (ENGLISH * 4,), (NAMES * 4,), (None,), ("a" * 300_000,)], "t string")
    got = [r.h for r in health.assessed(df, "t").collect()]
    assert [h.verdict for h in got] == ["healthy", "broken", "empty", "broken", "healthy", "healthy", "empty", "healthy"]
    assert got[1].reasons == ["visual_order"] and got[3].latin_gibberish > 0.7 and got[4].latin_gibberish < 0.2 and got[5].latin_gibberish < 0.2


GA, MA, VIRAMA, E_SIGN, A_SIGN, ZWJ, ZWNJ = "ග", "ම", "\u0dca", "\u0dd9", "\u0dcf", "\u200d", "\u200c"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GA + VIRAMA + ZWJ + MA, GA + VIRAMA + ZWJ + MA), (ZWJ + GA + MA + ZWJ, GA + MA), (GA + VIRAMA + ZWNJ + MA, GA + VIRAMA + MA), (GA + ZWNJ + MA, GA + ZWNJ + MA), ("x" + ZWNJ + "y", "xy"),
        ("o\ufb03ce\rnext\r\nline", "office\nnext\nline"), ("\ufeffso\u00adft\u2060", "soft"), ("tab\there\x07", "tab\there"), (GA + E_SIGN + A_SIGN, GA + "\u0ddc"), ("e\u0301", "é"), ("", ""),
    ],
)
def test_normalize(text, want):
    assert normalize.normalize_text(text) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="කපළාේේ‍‌ \r\nabﬁ​தகைெ"))
def test_canonical_text_is_clean(text):
    got = normalize.canonical_text(text)
    assert got == " ".join(got.split()) and not set(got) & set(normalize.DROPPED + "\r\n") and not set(got) & set(normalize.LIGATURES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("කගජටතනපබමයරලවසහ"), st.sampled_from(["", E_SIGN, "\u0ddb", "\u0dd2", "\u0dcf"]), st.booleans()), max_size=12))
def test_repair(syllables):
    """A sign typed before its consonant, as it is drawn, comes back behind it, and only then."""
    logical = drawn = ""
    moved = 0
    for k, (consonant, sign, wrong) in enumerate(syllables):
        # Behind a bare consonant a sign reads as that one's own: only after another sign or at the start it is out of place.
        early = wrong and sign in (E_SIGN, "\u0ddb") and (not drawn or not "ක" <= drawn[-1] <= "ෆ")
        logical, drawn, moved = logical + consonant + sign, drawn + (sign + consonant if early else consonant + sign), moved + early
        if k % 3 == 2:
            logical, drawn = logical + " ", drawn + " "
    import unicodedata

    assert normalize.repair_text(drawn) == (unicodedata.normalize("NFC", logical), moved)


@pytest.mark.parametrize(("text", "want", "moved"), [("\u0bc7" + "மற்கு", "மேற்கு", 1), (E_SIGN + MA + VIRAMA + ZWJ + "ර", MA + VIRAMA + ZWJ + "ර" + E_SIGN, 1), (GOOD, GOOD, 0), ("Galle road", "Galle road", 0), ("", "", 0)])
def test_repair_of_clusters_and_clean_text(text, want, moved):
    assert normalize.repair_text(text) == (want, moved)


def test_fonts(spark):
    names = ["DAPBCE+FMAbhayax", "DL-Manel-bold", "ABCDEF+TAM-Kavi", "PMGAGJ+IskoolaPota", "BBPNOK+MSTT31c4e8", None]
    got = rows(spark, names, fonts.legacy_font(F.col("t"))["family"], fonts.is_unnamed_truetype(F.col("t")))
    assert [g[0] for g in got] == ["fm-abhaya", "dl-manel", "tam-tab", None, None, None] and got[4][1]


TOY = {"q": "\u0dd9", "qq": "\u0ddb", "m": "ම", "n": "න", "v": "වි", "vv": "වී", "W": "\u0dca\u200dය", "u": "\u0dcf", ";": ":"}


def test_converter():
    c = legacy.Converter("toy", "si", TOY)
    # Longest codes first; a sign in front goes behind its consonant, with all that hangs on it; what no code draws stays.
    assert [c.convert(x) for x in ("vvvn", "qmu", "qqnWu", "7;x")] == ["වීවින", "මො", "න්‍යෛා", "7:x"]
    assert c.maps("q") and not c.maps("7") and len(c) == len(TOY)


def test_legacy_markdown():
    c = legacy.Converter("toy", "si", TOY)
    words = legacy.FontWords(frozenset({"qmu", "vn"}), frozenset({"nm"}), {"mAm": [True, False, False]}, 8, 3)
    got = legacy.convert_markdown("## **qmu**, nm\n| vn | mAm |\n|---|---|\n", words, c)
    assert got == ("## **මො**, nm\n| වින | මAm |\n|---|---|\n", 3, 1, 0)
    assert legacy.convert_markdown("unknown `vv`", words, c)[3] == 2
    assert legacy.convert_markdown("<u>vv</u>", None, c)[0] == "<u>වී</u>"
    assert legacy.convert_markdown("", words, c) == ("", 0, 0, 0)


def test_drawn_order():
    """Words in the order in which a legacy font draws them, and back by conversion."""
    assert legacy.visual_units("කොළ") == [E_SIGN, "ක", A_SIGN, "ළ"]
    assert legacy.visual_units("ප්‍රේම") == [E_SIGN, "ප", "්‍", "ර", "්", "ම"]
    assert legacy.visual_units("") == [] and legacy.clean_recognised("‍ක්‌ක‌‍") == "ක්ක"
    codes = {u: chr(0x4E00 + k) for k, u in enumerate(sorted({"ක", "ළ", "ම", "ප", "ර", "්", "්‍", E_SIGN, "\u0ddb", A_SIGN}))}
    c = legacy.Converter("made up", "si", {v: k for k, v in codes.items()})
    for word in ("කොළ", "ප්‍රේම", "මෛර", "කළ"):
        assert c.convert("".join(codes[u] for u in legacy.visual_units(word))) == word


def test_rendering(spark):
    got = rows(spark, ["a\n\n\n\nb\n# not a heading", "# Title\n\n| a | b |\n|---|---|\n| 1 | 2 |", "", None], render.text_to_markdown(F.col("t")), render.plain_text(F.col("t")))
    assert got[0][0] == "a\n\nb\n\\# not a heading" and got[1][1] == "Title\n\na\tb\n1\t2\n" and got[2] == ("", "") and got[3][0] is None
    lines = F.array(F.lit("a har-"), F.lit(" bour wall, the Well-"), F.lit(""), F.lit("Known"), F.lit("මාර්-"), F.lit("ගය"))
    assert spark.range(1).select(render.join_lines(lines)).first()[0] == "a harbour wall, the Well- Known මාර්- ගය"


def test_metrics(spark):
    df = spark.createDataFrame([("abcd", "abxd", "the cat sat", "the bat sat"), ("", "", "", "")], "a string, b string, c string, d string")
    got = df.select(metrics.cer(F.col("a"), F.col("b")), metrics.wer(F.col("c"), F.col("d")), metrics.agreement(F.col("a"), F.col("a")), metrics.word_f1(F.col("c"), F.col("d"))).collect()
    assert got[0][0] == 0.25 and abs(got[0][1] - 1 / 3) < 1e-12 and got[0][2] == 1.0 and abs(got[0][3] - 2 / 3) < 1e-12
    assert tuple(got[1]) == (0.0, 0.0, 1.0, 1.0)
    rel = metrics.agreement_of(spark.createDataFrame([(1, "abcabc", "abxabc"), (2, "", ""), (3, None, "ab")], "k int, a string, b string"), ["k"])
    col = spark.createDataFrame([("abcabc", "abxabc")], "a string, b string").select(metrics.agreement(F.col("a"), F.col("b"))).first()[0]
    assert {r.k: round(r.score, 9) for r in rel.collect()} == {1: round(col, 9), 2: 1.0, 3: 0.0}


def test_html():
    page = "<html><head><title> Act  1</title></head><body><nav>n</nav><h1>Act No. 40</h1><p>One <b> bold</b> x<p>two<ul><li>a<ol><li>b<li>c</ol><li>d</ul><table><tr><th>h<th>i<tr><td colspan=2>x|y</table><pre>a\n b </pre><blockquote><p>q</blockquote><p><b>open<p>next</body>"
    md, title = html.html_to_markdown(page)
    assert title == "Act 1"
    assert md == "# Act No. 40\n\nOne **bold** x\n\ntwo\n\n- a\n  1. b\n  2. c\n- d\n\n| h | i |\n|---|---|\n| x\\|y |  |\n\n```\na\n b\n```\n\n> q\n\n**open**\n\n**next**"
    assert html.html_to_markdown("") == ("", None)
