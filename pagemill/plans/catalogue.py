"""Queries of the engine's operators over the test tables, and their SQL where SQL can express them.

Every query reads whole tables. Repeated deliveries count once: what is computed row by row is told apart by its id
afterwards, so that results are shuffled and texts are not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fonts, health, html, legacy, metrics, normalize, render, script
from ..functions.tables import FONT_FAMILIES, LATIN_FONTS, SINHALA_CONFUSIONS
from ..operators import correct, documents, evaluate, learn, lexicon, ocr, router
from ..session import checkpoint_dir, ship
from ..sources import deliveries, files

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    ship(spark)
    checkpoint_dir(spark, fallback="/tmp/pagemill-checkpoints")  # used only where Spark is this one process
    return spark.read.parquet(f"{d}/{table}.parquet")


def _pages(spark: SparkSession, d: str, *columns) -> DataFrame:
    return _once(spark, d, "pages", "page_id", *columns)


def _once(spark: SparkSession, d: str, table: str, key: str, *columns) -> DataFrame:
    """Each record once; only those that may be repeated are shuffled if they carry texts."""
    rows = _read(spark, d, table).select(key, *columns)
    return deliveries.once(rows, key) if {"text", "markdown"} & set(rows.columns) else rows.dropDuplicates([key])


# --- SQL fragments ------------------------------------------------------------------------------------------------

# Fixed values, stated again for the SQL and not taken from the engine, so that a slip in the engine's own shows: white space,
# scripts, signs and consonants, what a Sinhala or Tamil word may hold, words and symbols of the gibberish score.
_W = "\\x{9}-\\x{d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_H = "\\x{9}\\x{b}-\\x{d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_S, _T, _L, _J = "\\x{d80}-\\x{dff}", "\\x{b80}-\\x{bff}", "A-Za-z", "\\x{200c}\\x{200d}"
_S_SIGN, _S_CONSONANT, _T_SIGN, _T_CONSONANT = "\\x{dca}-\\x{ddf}\\x{df2}\\x{df3}", "\\x{d9a}-\\x{dc6}", "\\x{bbe}-\\x{bcd}\\x{bd7}", "\\x{b95}-\\x{bb9}"
_IN_WORD = f"{_S}{_T}{_J}0-9!-/:-@\\[-`{{-~\\x{{2018}}-\\x{{201f}}\\x{{2013}}\\x{{2014}}\\x{{2026}}\\x{{a0}}"
_COMMON = "['the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'by', 'be', 'or', 'as', 'on', 'with', 'any', 'shall', 'this', 'which', 'under', 'such', 'are', 'it', 'from', 'at', 'an', 'not', 'was', 'has', 'have', 'been', 'other', 'may', 'no', 'all', 'his', 'her', 'its', 'their']"
_ODD = "[A-Za-z][%;,''\\[\\]^$|`~@&*=+\\\\{}#][A-Za-z]|[\\x{a1}-\\x{ff}]"
_INDIC_WORD = f"[^{_W}{_S}{_T}]*[{_S}{_T}][^{_W}]*"
_N = lambda text, members: f"len(regexp_extract_all({text}, '[{members}]'))"
_COUNTS = f"coalesce({_N('text', _S)}, 0) AS si, coalesce({_N('text', _T)}, 0) AS ta, coalesce({_N('text', _L)}, 0) AS latin"
_SHARE = lambda f: f"CAST({f} / CAST(greatest(si + ta + latin, 1) AS DOUBLE) AS FLOAT)"
_DOMINANT = "CASE WHEN greatest(si, ta, latin) = 0 THEN NULL WHEN latin >= greatest(si, ta) THEN 'en' WHEN ta >= si THEN 'ta' ELSE 'si' END"
_LANG_LIST = lambda share, least, own=1: (
    f"CASE WHEN si + ta + latin < {least} THEN CAST([] AS VARCHAR[]) ELSE list_transform(list_sort(list_filter([{{'n': -si, 'p': 0, 'l': 'si', 's': {_SHARE('si')}}}, {{'n': -ta, 'p': 1, 'l': 'ta', 's': {_SHARE('ta')}}}, "
    f"{{'n': -latin, 'p': 2, 'l': 'en', 's': {_SHARE('latin')}}}], lambda r: r.s >= CAST({share} AS FLOAT) AND r.n <= -{own})), lambda r: r.l) END"
)
_LANGS = lambda share, least: f"array_to_string({_LANG_LIST(share, least)}, ',')"
_STRIPPED = "translate(regexp_replace(text, '<[^>]*(?:>|$)', '', 'g'), '*_#', '   ')"
_TOKENS = f"list_filter(regexp_extract_all({_STRIPPED}, '[^{_W}]+'), lambda w: regexp_matches(w, '[A-Za-z][^A-Za-z]*[A-Za-z]'))"
_GIBBERISH = f"""
CASE WHEN len(tk) < 30 THEN CAST(0 AS FLOAT) ELSE CAST(
 greatest(least(CAST(CAST(1 AS FLOAT) - CAST(CAST(len(list_filter(tk, lambda w: list_contains({_COMMON}, lower(regexp_replace(w, '[^A-Za-z]', '', 'g'))))) / CAST(len(tk) AS DOUBLE) AS FLOAT) / CAST(CAST(0.15 AS FLOAT) AS DOUBLE) AS FLOAT) AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT))
 * greatest(least(CAST(CAST(len(list_filter(tk, lambda w: regexp_matches(w, '{_ODD}'))) / CAST(len(tk) AS DOUBLE) AS FLOAT) / CAST(CAST(0.15 AS FLOAT) AS DOUBLE) AS FLOAT), CAST(1 AS FLOAT)), CAST(0 AS FLOAT)) AS FLOAT) END"""
_PLAIN = f"regexp_replace(text, '[{_J}]', '', 'g')"
_MEASURES = f"""
m AS (SELECT *, len(regexp_extract_all(text, '{_INDIC_WORD}')) AS words,
 len(regexp_extract_all({_PLAIN}, '[{_S_SIGN}]')) - len(regexp_extract_all({_PLAIN}, '[{_S_CONSONANT}][{_S_SIGN}]')) + len(regexp_extract_all({_PLAIN}, '[{_T_SIGN}]')) - len(regexp_extract_all({_PLAIN}, '[{_T_CONSONANT}][{_T_SIGN}]')) AS errors,
 len(list_filter(regexp_extract_all(text, '{_INDIC_WORD}'), lambda w: regexp_matches(w, '[^{_IN_WORD}A-Za-z]'))) AS bad,
 {_TOKENS} AS tk FROM c),
h AS (SELECT *, CASE WHEN si + ta >= 50 AND words > 0 THEN CAST(errors / CAST(words AS DOUBLE) AS FLOAT) ELSE CAST(0 AS FLOAT) END AS visual_order,
 CASE WHEN si + ta >= 50 AND words > 0 THEN CAST(bad / CAST(words AS DOUBLE) AS FLOAT) ELSE CAST(0 AS FLOAT) END AS foreign_share,
 CASE WHEN latin >= 100 THEN {_GIBBERISH} ELSE CAST(0 AS FLOAT) END AS gibberish,
 CAST(len(regexp_extract_all(text, '\\x{{fffd}}')) / CAST(greatest(length(text), 1) AS DOUBLE) AS FLOAT) AS lost FROM m),
v AS (SELECT *, concat_ws('+', CASE WHEN lost > CAST(0.01 AS FLOAT) THEN 'replacement_chars' END, CASE WHEN visual_order > CAST(0.03 AS FLOAT) THEN 'visual_order' END,
 CASE WHEN foreign_share > CAST(0.02 AS FLOAT) THEN 'foreign_code_points' END, CASE WHEN gibberish >= CAST(0.5 AS FLOAT) THEN 'latin_gibberish' END) AS reasons FROM h),
w AS (SELECT *, CASE WHEN reasons <> '' THEN 'broken' WHEN si + ta + latin < 20 THEN 'empty' ELSE 'healthy' END AS verdict FROM v)"""
_DOCS = f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT *, {_COUNTS} FROM d)"
_PAGES = f"WITH d AS (SELECT DISTINCT page_id, coalesce(markdown, '') AS text FROM pages), c AS (SELECT *, {_COUNTS} FROM d)"


# Text in normal form: composed, joiners only inside Sinhala and Tamil words (kept ones are marked, neighbours may overlap), no
# invisible or control characters, one kind of line break, ligatures spelled out. Canonical text has single spaces as well.
_MARKED = lambda t, before, joiner, mark: f"regexp_replace(regexp_replace({t}, '([{before}]){joiner}([{_S}{_T}])', '\\1{mark}\\2', 'g'), '([{before}]){joiner}([{_S}{_T}])', '\\1{mark}\\2', 'g')"
_NO_VIRAMA = "\\x{d80}-\\x{dc9}\\x{dcb}-\\x{dff}\\x{b80}-\\x{bcc}\\x{bce}-\\x{bff}"


def _normal_sql(text: str) -> str:
    t = _MARKED(f"nfc_normalize({text})", _S + _T, "\\x{200d}", "\ue000")
    t = _MARKED(t, _NO_VIRAMA, "\\x{200c}", "\ue001")
    t = f"translate(regexp_replace({t}, '[\\x{{200c}}\\x{{200d}}]', '', 'g'), '\ue000\ue001', '\u200d\u200c')"
    t = f"regexp_replace(replace({t}, chr(13) || chr(10), chr(10)), '\\r', chr(10), 'g')"
    t = f"regexp_replace({t}, '[\\x{{feff}}\\x{{200b}}\\x{{ad}}\\x{{2060}}\\x{{180e}}\\x{{0}}-\\x{{8}}\\x{{b}}\\x{{c}}\\x{{e}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g')"
    for one, many in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st")):
        t = f"replace({t}, '{one}', '{many}')"
    return t


def _canonical_sql(text: str) -> str:
    return f"trim(regexp_replace({_normal_sql(text)}, '[{_W}]+', ' ', 'g'), ' ')"


# --- scripts, languages, health -------------------------------------------------------------------------------------


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("c", script.script_counts(F.col("text")))


@_query(_DOCS + f" SELECT doc_id, si, ta, latin, round({_SHARE('si')}, 4) AS share_si, round({_SHARE('ta')}, 4) AS share_ta, round({_SHARE('latin')}, 4) AS share_latin FROM c")
def script_shares(spark, d):
    return _counted(spark, d).select("doc_id", "c.si", "c.ta", "c.latin", *[F.round(script.share(F.col("c"), x), 4).alias(f"share_{x}") for x in ("si", "ta", "latin")])


@_query(_DOCS + f" SELECT doc_id, {_LANGS(0.05, 20)} AS langs FROM c")
def languages_detected(spark, d):
    return _counted(spark, d).select("doc_id", F.array_join(script.languages(F.col("c"), 0.05, 20), ",").alias("langs"))


@_query(_DOCS + f" SELECT {_DOMINANT} AS lang, count(*) AS docs FROM c GROUP BY 1")
def dominant_language(spark, d):
    return _counted(spark, d).groupBy(script.dominant(F.col("c")).alias("lang")).agg(F.count("*").alias("docs"))


@_query(_DOCS + f", m AS (SELECT *, {_TOKENS} AS tk FROM c) SELECT doc_id, round({_GIBBERISH}, 4) AS score FROM m")
def latin_gibberish(spark, d):
    return _counted(spark, d).select("doc_id", F.round(health.latin_gibberish_score(health.counts(F.col("text"))), 4).alias("score"))


@_query(_DOCS + "," + _MEASURES + f" SELECT verdict, {_DOMINANT} AS lang, count(*) AS docs FROM w GROUP BY 1, 2")
def health_verdicts(spark, d):
    """Documents by verdict and dominant language: one scan, one small shuffle, no Python."""
    h = health.assessed(_read(spark, d, "documents").select("text"), "text")
    return h.groupBy("h.verdict", script.dominant(F.col("h.letters")).alias("lang")).agg(F.count("*").alias("docs"))


@_query(_PAGES + "," + _MEASURES + " SELECT page_id, round(visual_order, 4) AS visual_order, round(foreign_share, 4) AS foreign_share, round(gibberish, 4) AS gibberish, round(lost, 4) AS lost, verdict, reasons FROM w")
def health_measures(spark, d):
    h = health.assessed(_read(spark, d, "pages").select("page_id", "markdown"), "markdown")
    r = lambda c, n: F.round(f"h.{c}", 4).alias(n)
    return h.select("page_id", r("visual_order", "visual_order"), r("foreign", "foreign_share"), r("latin_gibberish", "gibberish"), r("replacement", "lost"), "h.verdict", F.array_join("h.reasons", "+").alias("reasons")).dropDuplicates(["page_id"])


@_query("WITH d AS (SELECT DISTINCT page_id, coalesce(markdown, '') AS text, langs[1] AS expected FROM pages), c AS (SELECT *, " + _COUNTS + " FROM d)," + _MEASURES + f" SELECT page_id, coalesce(expected IN ('si', 'ta') AND si + ta + latin >= 100 AND CASE expected WHEN 'si' THEN {_SHARE('si')} ELSE {_SHARE('ta')} END < CAST(0.2 AS FLOAT) AND {_SHARE('latin')} > CAST(0.6 AS FLOAT), false) AS wrong FROM w")
def wrong_scripts(spark, d):
    """Pages labelled Sinhala or Tamil that are written in Latin letters."""
    pages = _read(spark, d, "pages").select("page_id", "markdown", F.get("langs", 0).alias("expected"))
    h = health.assessed(pages, "markdown", expected=F.col("expected"))
    return h.select("page_id", F.array_contains("h.reasons", "wrong_script").alias("wrong")).dropDuplicates(["page_id"])


@_query(_DOCS + f" SELECT doc_id, md5({_STRIPPED}) AS digest FROM c")
def markup_stripped(spark, d):
    return _counted(spark, d).select("doc_id", F.md5(health.strip_markup(F.col("text"))).alias("digest"))


@_query(_PAGES + "," + _MEASURES + f", l AS (SELECT page_id, gibberish, {_LANG_LIST(0.03, 50, 30)} AS langs FROM w) SELECT page_id, CASE WHEN gibberish >= CAST(0.5 AS FLOAT) OR len(list_filter(langs, lambda x: x <> 'en')) = 0 THEN '' ELSE array_to_string(langs, '+') END AS hint FROM l")
def script_hints(spark, d):
    h = health.assessed(_read(spark, d, "pages").select("page_id", "markdown"), "markdown")
    return h.select("page_id", F.array_join(health.script_hint(F.col("h")), "+").alias("hint")).dropDuplicates(["page_id"])


@_query(_PAGES + f" SELECT page_id, array_to_string({_LANG_LIST(0.08, 20, 15)}, '+') AS langs FROM c")
def probed_languages(spark, d):
    """Languages that a trial recognition of each page would choose."""
    c = _read(spark, d, "pages").select("page_id", script.script_counts(F.coalesce("markdown", F.lit(""))).alias("c"))
    return c.select("page_id", F.array_join(script.probed(F.col("c")), "+").alias("langs")).dropDuplicates(["page_id"])


@_query("SELECT DISTINCT source, CASE WHEN lower(trim(main_lang)) IN ('si', 'sin', 'sinhala') THEN 'si' WHEN lower(trim(main_lang)) IN ('ta', 'tam', 'tamil') THEN 'ta' WHEN lower(trim(main_lang)) IN ('en', 'eng', 'english') THEN 'en' END AS lang, CASE lower(trim(main_lang)) WHEN 'si' THEN 'sin' WHEN 'ta' THEN 'tam' ELSE 'eng' END AS arg FROM collections")
def language_names(spark, d):
    t = _read(spark, d, "collections").select("source", script.parse_lang(F.col("main_lang")).alias("lang"))
    return t.select("source", "lang", script.lang_arg(F.array("lang")).alias("arg")).distinct()


# --- normal forms and metrics ------------------------------------------------------------------------------------------


@_query(f"SELECT doc_id, md5({_canonical_sql('text')}) AS digest FROM documents")
def canonical_text(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(normalize.canonical(F.col("text"))).alias("digest"))


_PRE, _CLUSTER = "\\x{dd9}\\x{ddb}\\x{bc6}-\\x{bc8}", f"(?:[{_S_CONSONANT}](?:\\x{{dca}}\\x{{200d}}[{_S_CONSONANT}])*|[{_T_CONSONANT}])"
_EARLY = f"(^|[^{_S_CONSONANT}{_T_CONSONANT}])((?:[{_PRE}]{_CLUSTER})+)"


def _repaired_sql(text: str, longest: int = 12) -> str:
    """Runs of signs in front of their consonants, marked, then mended one after the other; no run is as long as ``longest``."""
    t = f"regexp_replace({text}, '{_EARLY}', '\\1\ue000\\2', 'g')"
    for _ in range(longest):
        t = f"regexp_replace({t}, '\ue000([{_PRE}])({_CLUSTER})', '\\2\\1\ue000', 'g')"
    return f"nfc_normalize(replace({t}, '\ue000', ''))"


@_query(f"SELECT DISTINCT page_id, CAST(list_sum(list_transform(regexp_extract_all(markdown, '{_EARLY}', 2), lambda r: len(regexp_extract_all(r, '[{_PRE}]')))) AS INT) AS found, md5({_repaired_sql('markdown')}) AS digest FROM pages")
def visual_order_repair(spark, d):
    r = _read(spark, d, "pages").select("page_id", normalize.repair_visual_order(F.col("markdown")).alias("r"))
    return r.select("page_id", F.when(F.col("r.moved") > 0, F.col("r.moved")).alias("found"), F.md5("r.text").alias("digest")).dropDuplicates(["page_id"])


def _titles(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "title", "source").where("title is not null")
    own = _read(spark, d, "collections").select("source", F.col("title").alias("other")).where("other is not null").distinct()
    return docs.join(own, "source")


_TITLES = "WITH p AS (SELECT d.doc_id, d.title, c.title AS other FROM documents d JOIN (SELECT DISTINCT source, title FROM collections WHERE title IS NOT NULL) c USING (source) WHERE d.title IS NOT NULL)"


def _edits_sql(name: str, members: str, a: str = "title", b: str = "other") -> str:
    """Edit distances ``name(doc_id, n, edits)`` of sequences of characters or words: each distinct member of a pair becomes one
    ASCII character, as the SQL function compares bytes."""
    each = lambda side, c: f"SELECT doc_id, {side} AS side, unnest({members.replace('@', c)}) AS m, unnest(range(1, len({members.replace('@', c)}) + 1)) AS pos FROM p"
    return f""", {name}_m AS ({each(0, a)} UNION ALL {each(1, b)}), {name}_k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY m) AS k FROM {name}_m),
{name}_s AS (SELECT doc_id, coalesce(string_agg(chr(CAST(32 + k AS INT)), '' ORDER BY pos) FILTER (WHERE side = 0), '') AS a, coalesce(string_agg(chr(CAST(32 + k AS INT)), '' ORDER BY pos) FILTER (WHERE side = 1), '') AS b FROM {name}_k GROUP BY doc_id),
{name} AS (SELECT p.doc_id, greatest(coalesce(length(s.a), 0), 1) AS n, coalesce(levenshtein(s.a, s.b), 0) AS edits FROM p LEFT JOIN {name}_s s USING (doc_id))"""


_CHARS, _WORDS = "regexp_extract_all(@, '(?s).')", f"regexp_extract_all(@, '[^{_W}]+')"


@_query(_TITLES + _edits_sql("e", _CHARS) + " SELECT doc_id, round(edits / CAST(n AS DOUBLE), 6) AS cer FROM e")
def cer_pairs(spark, d):
    return _titles(spark, d).select("doc_id", F.round(metrics.cer(F.col("title"), F.col("other")), 6).alias("cer"))


@_query(_TITLES + _edits_sql("e", _WORDS) + " SELECT doc_id, round(edits / CAST(n AS DOUBLE), 6) AS wer FROM e")
def wer_pairs(spark, d):
    return _titles(spark, d).select("doc_id", F.round(metrics.wer(F.col("title"), F.col("other")), 6).alias("wer"))


_GRAMS = """
, s AS (SELECT doc_id, 0 AS side, regexp_replace(title, '[{w}]', '', 'g') AS t FROM p UNION ALL SELECT doc_id, 1, regexp_replace(other, '[{w}]', '', 'g') FROM p),
g AS (SELECT doc_id, side, unnest({grams}) AS g FROM s),
n AS (SELECT doc_id, g, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM g GROUP BY 1, 2)
SELECT doc_id, round(2.0 * sum(least(a, b)) / sum(a + b), 6) AS score FROM n GROUP BY doc_id
"""


@_query(_TITLES + _GRAMS.format(w=_W, grams="list_transform(range(1, length(t)), lambda i: substr(t, i, 2))"))
def bigram_agreement(spark, d):
    t = _titles(spark, d).select("doc_id", F.col("title").alias("a"), F.col("other").alias("b"))
    return metrics.agreement_of(t, ["doc_id"]).select("doc_id", F.round("score", 6).alias("score"))


@_query(_TITLES + _GRAMS.replace("'[{w}]', '', 'g'", "'^$', '', 'g'").format(w=_W, grams=f"regexp_extract_all(t, '[^{_W}]+')"))
def word_f1(spark, d):
    return _titles(spark, d).select("doc_id", F.round(metrics.word_f1(F.col("title"), F.col("other")), 6).alias("score"))


# --- rendering -----------------------------------------------------------------------------------------------------------

_TRIM = lambda c: f"regexp_replace({c}, '^[{_W}]+|[{_W}]+\\z', '', 'g')"


@_query(f"SELECT doc_id, md5({_TRIM(f'''regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)[{_H}]+$', '', 'g'), '(?m)^([{_H}]*[#>|])', '{chr(92) * 2}{chr(92)}1', 'g'), '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g')''')}) AS digest FROM documents")
def text_as_markdown(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(render.text_to_markdown(F.col("text"))).alias("digest"))


_LINE = f"regexp_replace(regexp_replace(x, '^[{_W}]+', ''), '^#+[{_W}]*', '')"
_BARE = f"regexp_replace({_LINE}, '\\*\\*|__|</?u>', '', 'g')"
_ROW = f"array_to_string(list_transform(string_split(regexp_replace({_BARE}, '^\\|+|\\|+$', '', 'g'), '|'), lambda y: {_TRIM('y')}), chr(9))"


@_query(f"""WITH q AS (SELECT DISTINCT page_id, coalesce(markdown, '') AS t FROM pages), l AS (SELECT page_id, t, list_filter(list_transform(string_split(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)), lambda x: CASE WHEN regexp_matches({_LINE}, '^\\|[|: -]*$') THEN NULL WHEN starts_with({_BARE}, '|') THEN {_ROW} ELSE {_BARE} END), lambda x: x IS NOT NULL) AS kept FROM q)
SELECT page_id, md5(CASE WHEN t = '' THEN '' ELSE array_to_string(kept, chr(10)) || CASE WHEN len(kept) > 0 THEN chr(10) ELSE '' END END) AS digest FROM l""")
def plain_text(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(render.plain_text(F.col("markdown"))).alias("digest")).dropDuplicates(["page_id"])


@_query(f"WITH q AS (SELECT DISTINCT page_id, doc, page_number, {_TRIM('coalesce(markdown, chr(32))')} AS body FROM pages), r AS (SELECT doc, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY page_number, page_id) FILTER (WHERE body <> ''), '') AS t FROM q GROUP BY doc) SELECT doc, md5(CASE WHEN t = '' THEN '' ELSE t || chr(10) END) AS digest FROM r")
def document_markdown(spark, d):
    p = _read(spark, d, "pages").select("doc", F.struct("page_number", "page_id").alias("page"), "markdown")
    return documents.markdown(p).select("doc", F.md5("text").alias("digest"))


@_query("""WITH q AS (SELECT DISTINCT page_id, doc, coalesce(length(markdown), 0) AS size, len(flags) AS flags FROM pages), p AS (SELECT doc, count(*) AS pages, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (WHERE flags > 0) AS flagged FROM q GROUP BY doc), e AS (SELECT DISTINCT ON (doc) doc, doc_format AS format, nullif(len(warnings), 0) AS warnings, lipi_version AS version, metadata['title'] AS title FROM extractions)
SELECT doc, format, coalesce(pages, 0) AS pages, CAST(coalesce(size, 0) AS BIGINT) AS size, coalesce(flagged, 0) AS flagged, CAST(warnings AS INT) AS warnings, version, title FROM e LEFT JOIN p USING (doc)""")
def document_json(spark, d):
    """Every document as JSON, read again: format, pages, characters of their markdown, flagged pages, warnings, version, title."""
    kind = F.col("method.kind")
    p = _pages(spark, d, "doc", "page_number", "method", "markdown", "langs", "confidence", "flags").select("doc", F.col("page_number").alias("page"), kind.alias("method"), "markdown", "langs", "confidence", F.when(F.size("flags") > 0, F.col("flags")).alias("flags"))
    e = _once(spark, d, "extractions", "doc", "doc_format", "metadata", "warnings", F.col("seconds_spent").alias("seconds"), F.col("lipi_version").alias("version"))
    schema = "struct<source: string, format: string, pages: array<struct<page: int, markdown: string, flags: array<string>>>, metadata: map<string, string>, warnings: array<string>, version: string>"
    r = documents.to_json(p, e).select("doc", F.from_json("json", schema).alias("r"))
    pages = F.col("r.pages")
    size = F.aggregate(pages, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.length(x["markdown"]), F.lit(0)))
    flagged = F.size(F.filter(pages, lambda x: x["flags"].isNotNull())).cast("bigint")
    return r.select("doc", "r.format", F.size(pages).cast("bigint").alias("pages"), size.alias("size"), flagged.alias("flagged"), F.when(F.col("r.warnings").isNotNull(), F.size("r.warnings")).alias("warnings"), "r.version", F.col("r.metadata")["title"].alias("title"))


@_query("WITH q AS (SELECT DISTINCT page_id, doc, replace(method.kind, '_', '-') AS label FROM pages) SELECT doc, label, count(*) AS pages FROM q GROUP BY doc, label")
def method_counts(spark, d):
    return documents.method_counts(_pages(spark, d, "doc", F.col("method.kind").alias("kind")))


@_query(f"WITH q AS (SELECT DISTINCT page_id, doc, coalesce(markdown, '') AS text, confidence, method.kind AS kind FROM pages), n AS (SELECT *, {_COUNTS} FROM q), a AS (SELECT doc, count(*) AS pages, CAST(sum(si) AS BIGINT) AS si, CAST(sum(ta) AS BIGINT) AS ta, CAST(sum(latin) AS BIGINT) AS latin, round(avg(CAST(confidence AS DOUBLE)), 3) AS confidence, count(*) FILTER (WHERE kind = 'failed') AS failed FROM n GROUP BY doc) SELECT doc, pages, {_LANGS(0.05, 20)} AS langs, confidence, failed FROM a")
def document_summary(spark, d):
    p = _read(spark, d, "pages").select("page_id", "doc", F.col("method.kind").alias("kind"), "markdown", F.col("confidence").cast("double").alias("confidence"), F.col("seconds_spent").alias("seconds"))
    return documents.summary(p, "page_id").select("doc", "pages", F.array_join("langs", ",").alias("langs"), F.round("confidence", 3).alias("confidence"), F.col("failed").cast("bigint").alias("failed"))


@_query(f"""WITH q AS (SELECT DISTINCT page_id, doc, coalesce(markdown, '') AS text, confidence, seconds_spent, replace(method.kind, '_', '-') AS label FROM pages), n AS (SELECT *, {_COUNTS} FROM q),
m AS (SELECT doc, string_agg(k || ' ' || label, ', ' ORDER BY label) AS methods FROM (SELECT doc, label, count(*) AS k FROM q GROUP BY doc, label) GROUP BY doc),
a AS (SELECT doc, CAST(sum(si) AS BIGINT) AS si, CAST(sum(ta) AS BIGINT) AS ta, CAST(sum(latin) AS BIGINT) AS latin, avg(CAST(confidence AS DOUBLE)) AS conf, sum(CAST(seconds_spent AS DOUBLE)) AS seconds FROM n GROUP BY doc),
l AS (SELECT *, {_LANG_LIST(0.05, 20)} AS langs FROM a)
SELECT concat_ws(' · ', doc, methods, CASE WHEN len(langs) > 0 THEN array_to_string(langs, '+') END, CASE WHEN conf IS NOT NULL THEN printf('conf %.0f', conf) END, CASE WHEN seconds IS NOT NULL THEN printf('%.1f s', seconds) END) AS line FROM l JOIN m USING (doc)""")
def summary_lines(spark, d):
    p = _read(spark, d, "pages").select("page_id", "doc", F.col("method.kind").alias("kind"), "markdown", F.col("confidence").cast("double").alias("confidence"), F.col("seconds_spent").cast("double").alias("seconds"))
    s = documents.summary(p, "page_id")
    return s.select(documents.summary_line(*[F.col(c) for c in ("doc", "methods", "langs", "confidence", "seconds")]).alias("line"))


@_query("SELECT DISTINCT doc, 'out/' || regexp_replace(doc, '([^/])\\.[^./]*$', '\\1') || '.md' AS target FROM extractions")
def target_paths(spark, d):
    """Where each rendered document goes."""
    return _read(spark, d, "extractions").select("doc", documents.target_path("out/", F.col("doc"), "markdown").alias("target")).distinct()


@_query("WITH q AS (SELECT DISTINCT page_id, doc, page_number, flags FROM pages WHERE len(flags) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_number, flags, page_id) AS k FROM q) SELECT doc, page_number AS page, array_to_string(flags, ',') AS flags FROM r WHERE k <= 6")
def flagged_pages(spark, d):
    p = _pages(spark, d, "doc", F.col("page_number").alias("page"), "flags")
    return documents.flagged(p).select("doc", "page", F.array_join("flags", ",").alias("flags"))


@_query("WITH q AS (SELECT DISTINCT page_id, flags FROM pages), f AS (SELECT unnest(flags) AS flag FROM q) SELECT flag, count(*) AS n FROM f GROUP BY flag ORDER BY n DESC, flag LIMIT 10")
def flags_most_common(spark, d):
    return evaluate.most_common(_pages(spark, d, "flags").select(F.explode("flags").alias("flag")), "flag", 10)


@_query("WITH q AS (SELECT DISTINCT page_id, doc, flags FROM pages), f AS (SELECT doc, unnest(flags) AS flag FROM q) SELECT doc, CAST(sum(CAST(regexp_extract(flag, ':(\\d+)$', 1) AS BIGINT)) AS BIGINT) AS tokens FROM f WHERE starts_with(flag, 'legacy_unmatched_tokens:') GROUP BY doc")
def unmatched_tokens(spark, d):
    return evaluate.unmatched_tokens(_pages(spark, d, "doc", "flags"))


# --- recognition output ------------------------------------------------------------------------------------------------------


def _ocr_words(spark, d):
    t = _once(spark, d, "ocr_pages", "ocr_id", "text").where("text is not null")
    lines = t.select("ocr_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    words = lines.select("ocr_id", "line", F.posexplode(F.regexp_extract_all("value", F.lit(f"[^{_W}]+"), F.lit(0))).alias("word_no", "text"))
    fixed = lambda n: F.lit(n).alias
    return words.select(F.col("ocr_id").alias("doc"), fixed(1)("page"), (F.col("line") / 20).cast("int").alias("block"), (F.col("line") / 5).cast("int").alias("par"), "line", "word_no", (F.abs(F.length("text") * 7 + F.col("word_no")) % 101).cast("float").alias("conf"), "text")


_OCR_WORDS = f"""WITH t AS (SELECT DISTINCT ocr_id, text FROM ocr_pages WHERE text IS NOT NULL),
l AS (SELECT ocr_id, unnest(string_split(text, chr(10))) AS value, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM t),
x AS (SELECT ocr_id AS doc, CAST(line AS INT) AS line, regexp_extract_all(value, '[^{_W}]+') AS ws FROM l),
w AS (SELECT doc, 1 AS page, line // 20 AS block, line // 5 AS par, line, unnest(range(0, len(ws))) AS word_no, unnest(ws) AS text FROM x)"""


@_query(_OCR_WORDS + """, a AS (SELECT doc, page, block, par, line, string_agg(text, ' ' ORDER BY word_no) AS t FROM w GROUP BY ALL),
p AS (SELECT doc, page, block, par, replace(regexp_replace(string_agg(t, chr(10) ORDER BY line), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), chr(10), ' ') AS t FROM a GROUP BY ALL),
q AS (SELECT doc, string_agg(t, chr(10) || chr(10) ORDER BY block, par) AS t FROM p GROUP BY doc),
m AS (SELECT doc, count(*) AS words, round(CAST(CAST(avg(CAST((length(text) * 7 + word_no) % 101 AS DOUBLE)) AS FLOAT) AS DOUBLE), 3) AS confidence FROM w GROUP BY doc)
SELECT q.doc AS ocr_id, md5(t) AS digest, words, confidence FROM q JOIN m USING (doc)""")
def ocr_paragraphs(spark, d):
    p = ocr.paragraphs(_ocr_words(spark, d))
    return p.select(F.col("doc").alias("ocr_id"), F.md5("text").alias("digest"), "words", F.round(F.col("confidence").cast("double"), 3).alias("confidence"))


@_query(_OCR_WORDS + " SELECT doc, count(*) AS words, round(sum(CAST((length(text) * 7 + word_no) % 101 AS DOUBLE)), 3) AS conf FROM w GROUP BY doc")
def ocr_tsv(spark, d):
    """The words written as TSV lines and parsed again."""
    w = _ocr_words(spark, d)
    line = F.concat_ws("\t", F.lit("5"), "page", "block", "par", "line", "word_no", F.lit("0"), F.lit("0"), F.lit("9"), F.lit("9"), "conf", "text")
    return ocr.parse_tsv(w.select("doc", line.alias("value"))).groupBy("doc").agg(F.count("*").alias("words"), F.round(F.sum("conf"), 3).alias("conf"))


@_query(f"WITH t AS (SELECT DISTINCT ocr_id, word_confidences FROM ocr_pages), w AS (SELECT ocr_id, unnest(word_confidences) AS w FROM t) SELECT ocr_id, {_normal_sql('w.word')} AS token, min(w.conf) AS conf FROM w WHERE w.conf IS NOT NULL GROUP BY 1, 2")
def confidence_map(spark, d):
    w = _once(spark, d, "ocr_pages", "ocr_id", "word_confidences").select("ocr_id", F.inline("word_confidences"))
    return ocr.confidence_map(w.select(F.col("ocr_id").alias("id"), F.col("word").alias("token"), "conf")).withColumnRenamed("id", "ocr_id")


@_query(f"""WITH t AS (SELECT DISTINCT fw_id, doc, page, legacy, other FROM font_words), w AS (SELECT doc, page, true AS fm, unnest(legacy) AS w FROM t UNION ALL SELECT doc, page, false, unnest(other) FROM t), g AS (SELECT doc, page, fm, length(regexp_replace(w, '[{_W}]', '', 'g')) AS n FROM w)
SELECT doc, page, CAST(coalesce(sum(n) FILTER (WHERE fm), 0) AS BIGINT) AS fm, CAST(coalesce(sum(n) FILTER (WHERE NOT fm), 0) AS BIGINT) AS other FROM g GROUP BY doc, page HAVING sum(n) > 0""")
def glyph_counts(spark, d):
    """Glyphs of the words whose fonts were read: those drawn by the convertible legacy font and all others."""
    t = _once(spark, d, "font_words", "fw_id", "doc", "page", "legacy", "other")
    words = t.select("doc", "page", F.lit("ABCDEF+FMAbhaya").alias("font"), F.explode("legacy").alias("w")).unionByName(t.select("doc", "page", F.lit("Times").alias("font"), F.explode("other").alias("w")))
    return ocr.glyph_counts(words.select("doc", "page", "font", F.explode(F.regexp_extract_all("w", F.lit("(?s)."), F.lit(0))).alias("ch")))


@_query("""WITH t AS (SELECT doc_id, title FROM documents WHERE title IS NOT NULL), g AS (SELECT doc_id, unnest(range(1, length(title) + 1)) AS seq, title FROM t),
c AS (SELECT doc_id, seq, substr(title, seq, 1) AS ch, seq * 6.0 + (CASE WHEN seq % 9 = 0 THEN 3.0 ELSE 0.0 END) AS l, seq * 6.0 + 6.0 AS r, CASE WHEN seq % 31 >= 20 THEN 20.0 ELSE 0.0 END AS b FROM g),
x AS (SELECT *, regexp_matches(ch, '^[""" + _W + """]*$') AS blank, coalesce(lag(regexp_matches(ch, '^[""" + _W + """]*$')) OVER o OR abs(b - lag(b) OVER o) > 5 OR l - lag(r) OVER o > 2, true) AS starts FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
n AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT doc_id, CAST(k AS BIGINT) AS word_no, string_agg(ch, '' ORDER BY seq) AS word FROM n WHERE NOT blank GROUP BY doc_id, k""")
def glyph_words(spark, d):
    t = _read(spark, d, "documents").select("doc_id", "title").where("title is not null")
    g = t.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("title")), lambda i: F.col("title").substr(i, F.lit(1)))).alias("p", "ch")).where("ch != ''").withColumn("seq", F.col("p") + 1)
    left = F.col("seq") * 6.0 + F.when(F.col("seq") % 9 == 0, 3.0).otherwise(0.0)
    glyphs = g.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "seq", "ch", F.lit(True).alias("legacy"), left.alias("left"), (F.col("seq") * 6.0 + 6.0).alias("right"), F.when(F.col("seq") % 31 >= 20, 20.0).otherwise(0.0).alias("bottom"), F.lit(10.0).alias("size"))
    return ocr.word_breaks(glyphs).select(F.col("doc").alias("doc_id"), "word_no", "word")


# --- word lists and correction ---------------------------------------------------------------------------------------------------


def _word_sql(lang: str) -> str:
    run = {"si": f"[{_S}{_J}]+", "ta": f"[{_T}{_J}]+", "en": f"[{_L}]+"}[lang]
    return f"WITH r AS (SELECT unnest(regexp_extract_all(text, '{run}')) AS w FROM documents), t AS (SELECT regexp_replace(w, '^[{_J}]+|[{_J}]+$', '', 'g') AS word FROM r), f AS (SELECT word, count(*) AS freq FROM t WHERE word <> '' GROUP BY word)"


def _lexicon(spark, d, lang):
    return lexicon.build(_read(spark, d, "documents").select("text"), lang)


@_query(_word_sql("en") + " SELECT word, freq FROM f")
def lexicon_en(spark, d):
    return _lexicon(spark, d, "en").counts


@_query(_word_sql("si") + " SELECT word, freq FROM f WHERE freq >= 3")
def lexicon_si_pruned(spark, d):
    return _lexicon(spark, d, "si").prune(3).counts


@_query(_word_sql("ta") + f" SELECT word || chr(9) || freq AS value FROM f WHERE freq >= 2 UNION ALL SELECT '#pagemill-lexicon 1 lang=ta types=' || count(*) FILTER (WHERE freq >= 2) || ' tokens=' || CAST(coalesce(sum(freq), 0) AS BIGINT) FROM f")
def lexicon_file(spark, d):
    return _lexicon(spark, d, "ta").prune(2).lines()


_RULES = ", rules(src, dst, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', CAST(CAST({w} AS FLOAT) AS DOUBLE))" for a, b, w in SINHALA_CONFUSIONS) + ")"
_STEP = "SELECT {a}.word, left({a}.form, i - 1) || dst || substr({a}.form, i + length(src)) AS form, {a}.score * weight AS score FROM {a} JOIN rules ON contains({a}.form, src) CROSS JOIN LATERAL unnest(range(1, length({a}.form) - length(src) + 2)) AS t(i) WHERE substr({a}.form, i, length(src)) = src"
_VARIANTS = f"""
WITH e AS (SELECT DISTINCT ocr_id, text FROM ocr_pages), x AS (SELECT unnest(regexp_extract_all(text, '[{_S}{_J}]+')) AS w FROM e), y AS (SELECT regexp_replace(w, '^[{_J}]+|[{_J}]+$', '', 'g') AS word FROM x), l AS (SELECT word, count(*) AS freq FROM y WHERE word <> '' GROUP BY word){_RULES},
lex AS (SELECT word, freq FROM l WHERE freq >= 40), u AS (SELECT word FROM l WHERE freq < 40 AND length(word) >= 3),
s0 AS (SELECT word, word AS form, CAST(1.0 AS DOUBLE) AS score FROM u),
r1 AS ({_STEP.format(a="s0")}), s1 AS (SELECT word, form, max(score) AS score FROM r1 WHERE form <> word GROUP BY word, form),
r2 AS ({_STEP.format(a="s1")}), s2 AS (SELECT word, form, max(score) AS score FROM r2 WHERE form <> word GROUP BY word, form),
v AS (SELECT word, form, max(score) AS weight FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY word, form)"""


def _si_words(spark, d):
    return lexicon.build(_once(spark, d, "ocr_pages", "ocr_id", "text").select("text"), "si").counts


@_query(_VARIANTS + " SELECT word, form, round(weight, 9) AS weight FROM v")
def word_variants(spark, d):
    words = _si_words(spark, d).where("freq < 40 and length(word) >= 3").select("word")
    return correct.variants(words, correct.sinhala_rules(spark)).select("word", "form", F.round("weight", 9).alias("weight"))


@_query(_VARIANTS + """, k AS (SELECT v.word, v.form, lex.freq * v.weight AS score, row_number() OVER (PARTITION BY v.word ORDER BY lex.freq * v.weight DESC, v.form) AS rank,
lead(lex.freq * v.weight) OVER (PARTITION BY v.word ORDER BY lex.freq * v.weight DESC, v.form) AS second FROM v JOIN lex ON lex.word = v.form)
SELECT word, form AS fixed, round(score, 6) AS score FROM k WHERE rank = 1 AND score >= 0.05 AND (second IS NULL OR score >= 3.0 * second)""")
def word_corrections(spark, d):
    words = _si_words(spark, d)
    return correct.corrections(words.where("freq < 40").select("word"), words.where("freq >= 40"), correct.sinhala_rules(spark)).select("word", "fixed", F.round("score", 6).alias("score"))


_FIXES = """, k AS (SELECT v.word, v.form, lex.freq * v.weight AS score, row_number() OVER (PARTITION BY v.word ORDER BY lex.freq * v.weight DESC, v.form) AS rank,
lead(lex.freq * v.weight) OVER (PARTITION BY v.word ORDER BY lex.freq * v.weight DESC, v.form) AS second FROM v JOIN lex ON lex.word = v.form),
fixes AS (SELECT word, form AS fixed FROM k WHERE rank = 1 AND score >= 0.05 AND (second IS NULL OR score >= 3.0 * second))"""


@_query(_VARIANTS.replace("u AS (SELECT word FROM l WHERE freq < 40 AND length(word) >= 3)", f"""nt AS (SELECT ocr_id, {_normal_sql('text')} AS text FROM e), tk AS (SELECT ocr_id, unnest(regexp_extract_all(text, '[{_W}]+|[^{_W}]+')) AS token, unnest(range(1, len(regexp_extract_all(text, '[{_W}]+|[^{_W}]+')) + 1)) AS pos FROM nt),
cf AS (SELECT ocr_id, {_normal_sql('w.word')} AS token, min(w.conf) AS conf FROM (SELECT ocr_id, unnest(word_confidences) AS w FROM (SELECT DISTINCT ocr_id, word_confidences FROM ocr_pages)) WHERE w.conf IS NOT NULL GROUP BY 1, 2),
pt AS (SELECT ocr_id, pos, unnest(regexp_extract_all(token, '[{_S}{_J}]+|[^{_S}{_J}]+')) AS part, unnest(range(1, len(regexp_extract_all(token, '[{_S}{_J}]+|[^{_S}{_J}]+')) + 1)) AS sub, conf FROM tk LEFT JOIN cf USING (ocr_id, token)),
cw AS (SELECT *, regexp_extract(part, '^[{_J}]*') AS lead, CASE WHEN regexp_matches(part, '[^{_J}]') THEN regexp_extract(part, '[{_J}]*$') ELSE '' END AS trail, CASE WHEN regexp_matches(part, '[{_S}{_J}]') AND coalesce(conf < 97.0, true) THEN regexp_replace(part, '^[{_J}]+|[{_J}]+$', '', 'g') END AS word FROM pt),
u AS (SELECT DISTINCT word FROM cw WHERE word <> '' AND length(word) >= 3 AND word NOT IN (SELECT word FROM lex))""") + _FIXES + """,
ch AS (SELECT cw.*, fixed, CASE WHEN fixed IS NOT NULL THEN lead || fixed || trail ELSE part END AS new FROM cw LEFT JOIN fixes USING (word)),
r AS (SELECT ocr_id, string_agg(new, '' ORDER BY pos, sub) AS text, count(fixed) AS n FROM ch GROUP BY ocr_id)
SELECT nt.ocr_id, CASE WHEN n > 0 THEN 'corrected:' || n ELSE '' END AS flags, md5(coalesce(r.text, nt.text)) AS digest FROM nt LEFT JOIN r USING (ocr_id)""")
def text_corrections(spark, d):
    """Every recognised page finished: normalised, corrected where a word is not sure, with a flag that counts the changes."""
    words = _si_words(spark, d).where("freq >= 40")
    t = _once(spark, d, "ocr_pages", "ocr_id", "text", "word_confidences").withColumn("doc", F.lit("d"))
    conf = t.select("doc", F.col("ocr_id").alias("page"), F.inline("word_confidences")).withColumnRenamed("word", "token")
    done = correct.finish(t.select("doc", F.col("ocr_id").alias("page"), "text"), conf, words, correct.sinhala_rules(spark))
    return done.select(F.col("page").alias("ocr_id"), F.array_join("flags", ",").alias("flags"), F.md5("text").alias("digest"))


# --- fonts and conversion ------------------------------------------------------------------------------------------------------------

_FAMILY = "CASE " + " ".join(f"WHEN starts_with(n, '{p}') THEN '{f}'" for p, f, _ in FONT_FAMILIES) + " WHEN regexp_matches(upper(regexp_replace(font, '^[^+]*\\+', '')), '^TA[MB]-') THEN 'tam-tab' END"
_FONTS = f"WITH t AS (SELECT DISTINCT fw_id, doc, page, fonts, legacy_chars, other_chars FROM font_words), u AS (SELECT fw_id, doc, page, unnest(fonts) AS font FROM t), x AS (SELECT *, lower(regexp_replace(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), '[^A-Za-z0-9]', '', 'g')) AS n FROM u), y AS (SELECT *, {_FAMILY} AS family FROM x)"


def _font_pages(spark, d):
    t = _once(spark, d, "font_words", "fw_id", "doc", "page", "fonts")
    return t.select("fw_id", "doc", "page", F.explode("fonts").alias("font")).withColumn("family", fonts.legacy_font(F.col("font"))["family"])


@_query(_FONTS + " SELECT font, family, count(*) AS pages FROM y GROUP BY font, family")
def font_families(spark, d):
    return _font_pages(spark, d).groupBy("font", "family").agg(F.count("*").alias("pages"))


@_query(_FONTS + " SELECT family, count(DISTINCT doc) AS docs, count(DISTINCT (doc, page)) AS pages FROM y WHERE family IS NOT NULL GROUP BY family")
def font_survey(spark, d):
    return evaluate.font_survey(_font_pages(spark, d))


@_query(_FONTS + ", z AS (SELECT doc, coalesce(array_to_string(list_sort(list_distinct(list(family) FILTER (WHERE family IS NOT NULL))), '+'), '') AS combo FROM y GROUP BY doc) SELECT CASE WHEN combo = '' THEN '(none)' ELSE combo END AS combo, count(*) AS docs FROM z GROUP BY 1")
def font_combinations(spark, d):
    return evaluate.font_combinations(_font_pages(spark, d))


_LATIN = "|".join(LATIN_FONTS)


@_query(f"SELECT DISTINCT fw_id, round(CASE WHEN coalesce(legacy_chars, 0) + coalesce(other_chars, 0) = 0 THEN 0 ELSE coalesce(legacy_chars, 0) / CAST(coalesce(legacy_chars, 0) + coalesce(other_chars, 0) AS DOUBLE) END, 6) AS share, coalesce(len(list_filter(fonts, lambda f: regexp_matches(lower(f), '{_LATIN}'))) > 0, false) AS has_latin, coalesce(len(list_filter(fonts, lambda f: regexp_matches(lower(f), 'glyphlessfont|hiddenhorzocr'))) > 0, false) AS prior FROM font_words")
def font_shares(spark, d):
    t = _once(spark, d, "font_words", "fw_id", "fonts", "legacy_chars", "other_chars")
    return t.select("fw_id", F.round(legacy.legacy_share(F.col("legacy_chars"), F.col("other_chars")), 6).alias("share"), fonts.has_latin(F.col("fonts")).alias("has_latin"), F.coalesce(F.exists("fonts", fonts.is_prior_ocr), F.lit(False)).alias("prior"))


@_query("WITH t AS (SELECT DISTINCT fw_id, doc, page, legacy_chars AS fm, coalesce(other_chars, 0) AS other FROM font_words WHERE legacy_chars >= 100 AND page < 50), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, fw_id) AS k FROM t) SELECT doc, CAST(page AS INT) AS page, fm, other, CASE WHEN CAST(('0x' || left(sha1(doc), 8)) AS BIGINT) % 100 % 3 = 0 THEN 'holdout' ELSE 'train' END AS part FROM k WHERE k <= 2")
def selected_pages(spark, d):
    t = _once(spark, d, "font_words", "fw_id", "doc", F.col("page").cast("int").alias("page"), F.col("legacy_chars").alias("fm"), F.coalesce("other_chars", F.lit(0)).alias("other"))
    return evaluate.select_pages(t.select("doc", "page", "fm", "other"), least=100)


@_query()
def legacy_conversion(spark, d):
    """Every page whose fonts were read, its legacy words converted."""
    t = _once(spark, d, "font_words", "fw_id", "legacy", "other", "mixed", "text", "legacy_chars", "other_chars")
    page = legacy.convert_page(*[F.col(c) for c in ("text", "legacy", "other", "mixed", "legacy_chars", "other_chars")])
    return t.select("fw_id", page.alias("p")).select("fw_id", "p.converted", "p.kept", "p.unmatched", F.md5("p.text").alias("digest"))


# --- routing --------------------------------------------------------------------------------------------------------------------------


def _pdf_pages(spark, d):
    """Pages with a text layer and what is known of their fonts, as the router's input relation."""
    p = _pages(spark, d, "doc", "page_number", "markdown", F.col("method.kind").alias("kind")).where("kind in ('text_layer', 'text_layer_repaired', 'legacy_converted', 'ocr', 'empty')")
    w = _once(spark, d, "font_words", "page_id", "fonts", F.struct("legacy", "other", "mixed", "text", "legacy_chars", "other_chars").alias("legacy_words"))
    return p.join(w, "page_id", "left").select("doc", F.col("page_id").alias("page"), F.col("markdown").alias("raw_md"), (F.col("kind") == "ocr").alias("needs_ocr"), F.when(F.col("kind") == "ocr", "scanned").alias("reason"), "fonts", "legacy_words")


def _recognised(spark, d):
    o = _once(spark, d, "ocr_pages", "page_id", "text", "confidence")
    return _pages(spark, d, "doc", "page_number").join(o, "page_id").select("doc", F.col("page_id").alias("page"), "text", "confidence")


@_query()
def router_plan(spark, d):
    p = router.resolve_langs(router.plan(_pdf_pages(spark, d)))
    return p.select(F.col("page").alias("page_id"), "plan", "method", F.array_join("flags", ",").alias("flags"), F.array_join("ocr_langs", "+").alias("ocr_langs"))


@_query()
def router_pages(spark, d):
    """Planned, verified against recognition, and assembled pages; recognised text is normalised and corrected."""
    read = _recognised(spark, d)
    done = correct.finish(read, None, _si_words(spark, d).where("freq >= 40"), correct.sinhala_rules(spark))
    p = router.assemble(router.verify(router.plan(_pdf_pages(spark, d)), read), done.join(read.select("doc", "page", "confidence"), ["doc", "page"]))
    return p.select(F.col("page").alias("page_id"), "label", F.array_join("flags", ",").alias("flags"), F.array_join("langs", ",").alias("langs"), F.length("markdown").alias("chars"))


# --- evaluation and learning -----------------------------------------------------------------------------------------------------------


_BENCH = _TITLES.replace("SELECT d.doc_id, d.title, c.title AS other", f"SELECT d.doc_id, {_canonical_sql('c.title')} AS title, {_canonical_sql('d.title')} AS other") + _edits_sql("e", _CHARS) + _edits_sql("f", _WORDS) + f", c AS (SELECT doc_id, {_COUNTS.replace('text', 'title')} FROM p), b AS (SELECT c.doc_id, {_DOMINANT} AS lang, e.edits / CAST(e.n AS DOUBLE) AS cer, f.edits / CAST(f.n AS DOUBLE) AS wer FROM c JOIN e USING (doc_id) JOIN f USING (doc_id))"


def _bench(spark, d):
    """Titles of documents as files, the title of their collection as the ground truth that belongs to each."""
    t = _titles(spark, d)
    name = lambda end: F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(end))
    files_ = t.select(name("_scan.png").alias("file"), F.col("title").alias("markdown"), F.lit("ocr").alias("methods"), F.length("title").cast("double").alias("seconds"))
    return evaluate.bench_run(files_, t.select(name(".gt.txt").alias("file"), F.col("other").alias("text")))


@_query(_BENCH + " SELECT 'in/' || doc_id || '_scan.png' AS file, lang, round(cer, 6) AS cer, round(wer, 6) AS wer FROM b")
def bench_files(spark, d):
    return _bench(spark, d).select("file", "lang", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"))


@_query(_BENCH + " SELECT b.lang, count(*) AS pages, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer, round(avg(CAST(length(t.title) AS DOUBLE)), 6) AS seconds FROM b JOIN documents t USING (doc_id) GROUP BY b.lang")
def bench_by_language(spark, d):
    return evaluate.by_language(_bench(spark, d)).select("lang", "pages", *[F.round(c, 6).alias(c) for c in ("cer", "wer", "seconds")])


@_query()
def bench_table(spark, d):
    """The results as lines of a fixed-width table."""
    return evaluate.results_table(_bench(spark, d))


def _runs(spark, d, value):
    p = _pages(spark, d, F.coalesce(F.get("langs", 0), F.lit("xx")).alias("lang"), F.col("method.kind").alias("kind"), "confidence", "seconds_spent").where("confidence is not null and seconds_spent is not null")
    name = F.concat_ws("_", "lang", F.when(F.length("lang") == 2, F.translate("kind", "_", "-")), F.col("page_id").cast("string"), F.when(F.col("confidence") >= 85, "clean").otherwise("scan"))
    return p.select("kind", F.concat(name, F.lit(".png")).alias("file"), value.cast("double").alias("cer"), (value.cast("double") * 3).alias("wer"))


_BEFORE, _AFTER = "100 - CAST(confidence AS DOUBLE)", "CAST(seconds_spent AS DOUBLE)"
_RUN = lambda v: f"SELECT kind, coalesce(langs[1], 'xx') || '_' || replace(kind, '_', '-') || '_' || page_id || CASE WHEN confidence >= 85 THEN '_clean' ELSE '_scan' END AS stem, {v} AS cer FROM (SELECT DISTINCT page_id, langs, method.kind AS kind, confidence, seconds_spent FROM pages) WHERE confidence IS NOT NULL AND seconds_spent IS NOT NULL"


@_query(f"""WITH b AS ({_RUN(_BEFORE)}), a AS ({_RUN(_AFTER)}), j AS (SELECT stem, b.cer AS c0, a.cer AS c1, string_split(stem, '_') AS p FROM b JOIN a USING (stem)),
k AS (SELECT *, CASE WHEN len(p) >= 4 THEN array_to_string(p[2:len(p) - 2], '_') ELSE 'all' END AS font, p[len(p)] AS variant FROM j),
g AS (SELECT font, variant, c0, c1 FROM k UNION ALL SELECT 'all', variant, c0, c1 FROM k UNION ALL SELECT 'all', 'all', c0, c1 FROM k)
SELECT font, variant, count(*) AS pages, round(100 * avg(c0), 3) AS cer0, round(100 * avg(c1), 3) AS cer1, round(300 * avg(c0), 3) AS wer0, round(300 * avg(c1), 3) AS wer1 FROM g GROUP BY font, variant""")
def compare_runs(spark, d):
    """Two measures of all pages that have both, as two runs: what confidence lacks, and the time a page took."""
    r = evaluate.compare(*[_runs(spark, d, v).drop("kind") for v in (100 - F.col("confidence").cast("double"), F.col("seconds_spent"))])
    return r.select("font", "variant", "pages", *[F.round(c, 3).alias(c) for c in ("cer0", "cer1", "wer0", "wer1")])


@_query(f"WITH b AS (SELECT * FROM ({_RUN(_BEFORE)}) WHERE kind <> 'ocr'), a AS (SELECT * FROM ({_RUN(_AFTER)}) WHERE kind <> 'office') SELECT count(b.stem) AS before, count(a.stem) AS after, count(*) FILTER (WHERE a.stem IS NOT NULL AND b.stem IS NOT NULL) AS common FROM b FULL JOIN a ON a.stem = b.stem")
def compare_unmatched(spark, d):
    """Files of two runs of which each lacks the pages of one method."""
    run = lambda v, lacks: _runs(spark, d, v).where(F.col("kind") != lacks)
    return evaluate.unmatched(run(100 - F.col("confidence"), "ocr"), run(F.col("seconds_spent"), "office"))


_BUCKET = "CAST(('0x' || left(sha1(doc), 8)) AS BIGINT) % 100"


@_query(f"WITH e AS (SELECT DISTINCT doc FROM extractions) SELECT doc, {_BUCKET} AS bucket, CASE WHEN {_BUCKET} < 80 THEN 'train' WHEN {_BUCKET} < 90 THEN 'learn' ELSE 'heldout' END AS part, row_number() OVER (PARTITION BY CASE WHEN {_BUCKET} < 80 THEN 0 WHEN {_BUCKET} < 90 THEN 1 ELSE 2 END ORDER BY sha1('7:' || doc)) AS place FROM e")
def split_parts(spark, d):
    """Documents by set, shuffled within each."""
    docs = _read(spark, d, "extractions").select("doc").distinct().select("doc", evaluate.bucket(F.col("doc")).alias("bucket"), evaluate.split_of(F.col("doc")).alias("part"))
    return evaluate.shuffled(docs, "doc").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("place")).cast("bigint"))


@_query("WITH e AS (SELECT DISTINCT doc FROM extractions) SELECT doc FROM e ORDER BY sha1(doc), doc LIMIT 200")
def sample_by_hash(spark, d):
    return evaluate.hash_sample(_read(spark, d, "extractions").select("doc").distinct(), "doc", 200)


@_query("""WITH t AS (SELECT DISTINCT ocr_id, doc, CAST(confidence AS DOUBLE) AS v FROM ocr_pages WHERE confidence IS NOT NULL), s AS (SELECT split_part(doc, '/', 1) AS source, list_sort(list(v)) AS a, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1),
q AS (SELECT *, unnest([10, 25, 50, 75, 90]) AS p FROM s), j AS (SELECT *, p // 5 AS k, greatest(1, least(n - 1, (n + 1) * (p // 5) // 20)) AS j FROM q),
r AS (SELECT source, p, (a[j] * (20 - ((n + 1) * k - j * 20)) + a[j + 1] * ((n + 1) * k - j * 20)) / 20.0 AS v FROM j)
SELECT source, round(max(v) FILTER (WHERE p = 10), 3) AS p10, round(max(v) FILTER (WHERE p = 25), 3) AS p25, round(max(v) FILTER (WHERE p = 50), 3) AS p50, round(max(v) FILTER (WHERE p = 75), 3) AS p75, round(max(v) FILTER (WHERE p = 90), 3) AS p90 FROM r GROUP BY source""")
def confidence_quantiles(spark, d):
    t = _once(spark, d, "ocr_pages", "ocr_id", F.split_part("doc", F.lit("/"), F.lit(1)).alias("source"), F.col("confidence").cast("double").alias("v"))
    q = evaluate.quantiles_exclusive(t, ["source"], "v")
    return q.select("source", *[F.round(c, 3).alias(c) for c in q.columns if c != "source"])


@_query("WITH t AS (SELECT DISTINCT ocr_id, word_confidences FROM ocr_pages), w AS (SELECT length(w.word) AS size, w.conf AS conf FROM (SELECT unnest(word_confidences) AS w FROM t)) SELECT size, round(count(*) FILTER (WHERE conf < 70) / CAST(greatest(count(conf), 1) AS DOUBLE), 6) AS below_70, round(count(*) FILTER (WHERE conf < 90) / CAST(greatest(count(conf), 1) AS DOUBLE), 6) AS below_90 FROM w GROUP BY size")
def confidence_below(spark, d):
    w = _once(spark, d, "ocr_pages", "ocr_id", "word_confidences").select(F.inline("word_confidences")).select(F.length("word").alias("size"), "conf")
    return evaluate.below(w, ["size"], "conf", (70, 90)).select("size", F.round("below_70", 6).alias("below_70"), F.round("below_90", 6).alias("below_90"))


@_query("WITH t AS (SELECT DISTINCT page_id, method.kind AS kind, CAST(seconds_spent AS DOUBLE) AS v FROM pages) SELECT kind, count(v) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(min(v), 4) AS least, round(max(v), 4) AS most FROM t GROUP BY kind")
def seconds_stats(spark, d):
    t = _pages(spark, d, F.col("method.kind").alias("kind"), F.col("seconds_spent").cast("double").alias("v"))
    s = evaluate.stats(t, ["kind"], "v")
    return s.select("kind", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "least", "most")])


@_query("""WITH e AS (SELECT DISTINCT entry_id, lang, word FROM lexicon_counts WHERE word IS NOT NULL AND lang IS NOT NULL), s AS (SELECT list_distinct(regexp_extract_all(word, '(?s).')) AS codes, [lang] AS units FROM e),
c AS (SELECT unnest(codes) AS code, units[1] AS unit FROM s), b AS (SELECT code, unit, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT code, count(*) AS nc FROM c GROUP BY 1), u AS (SELECT units[1] AS unit, count(*) AS nu FROM s GROUP BY 1)
SELECT code, unit, n, round(2 * n / CAST(nc + nu AS DOUBLE), 6) AS dice FROM b JOIN k USING (code) JOIN u USING (unit)""")
def cooccurrence(spark, d):
    e = _once(spark, d, "lexicon_counts", "entry_id", "lang", "word").where("word is not null and lang is not null")
    c = learn.cooccurrence(e.select(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)).alias("codes"), F.array("lang").alias("units")))
    return c.select("code", "unit", "n", F.round("dice", 6).alias("dice"))


@_query("""WITH t AS (SELECT DISTINCT ocr_id AS page, word_confidences AS w FROM ocr_pages WHERE word_confidences IS NOT NULL), x AS (SELECT page, unnest(range(0, len(w))) AS i FROM t),
a AS (SELECT page, i, (i % 12) * 60.0 AS x0, (i // 12) * 30.0 AS y0 FROM x), b AS (SELECT page, i, (i % 12) * 60.0 + (i % 5) * 9.0 AS x0, (i // 12) * 30.0 + (i % 3) * 4.0 AS y0 FROM x),
j AS (SELECT a.page, a.i AS a_idx, b.i AS b_idx, least(a.x0, b.x0) + 50 - greatest(a.x0, b.x0) AS w, least(a.y0, b.y0) + 20 - greatest(a.y0, b.y0) AS h FROM a JOIN b ON a.page = b.page AND abs(a.x0 - b.x0) < 50 AND abs(a.y0 - b.y0) < 20),
s AS (SELECT page, a_idx, b_idx, w * h / (2000 - w * h) AS iou FROM j), f AS (SELECT * FROM s WHERE iou >= 0.2),
r AS (SELECT *, row_number() OVER (PARTITION BY page, a_idx ORDER BY iou DESC, b_idx) AS ra, row_number() OVER (PARTITION BY page, b_idx ORDER BY iou DESC, a_idx) AS rb FROM f)
SELECT page, CAST(a_idx AS INT) AS a_idx, CAST(b_idx AS INT) AS b_idx, round(iou, 6) AS iou FROM r WHERE ra = 1 AND rb = 1""")
def boxes_mutual_best(spark, d):
    t = _once(spark, d, "ocr_pages", "ocr_id", "word_confidences").where("word_confidences is not null")
    i = t.select(F.col("ocr_id").alias("page"), F.posexplode("word_confidences").alias("idx", "w"))
    x, y = (F.col("idx") % 12) * 60.0, F.floor(F.col("idx") / 12) * 30.0
    a = i.select("page", F.lit("a").alias("side"), "idx", x.alias("x0"), y.alias("y0"))
    b = i.select("page", F.lit("b").alias("side"), "idx", (x + (F.col("idx") % 5) * 9.0).alias("x0"), (y + (F.col("idx") % 3) * 4.0).alias("y0"))
    boxes = a.unionByName(b).select("*", (F.col("x0") + 50).alias("x1"), (F.col("y0") + 20).alias("y1"))
    return learn.mutual_best(boxes, least=0.2).select("page", "a_idx", "b_idx", F.round("iou", 6).alias("iou"))


def _noisy(spark, d):
    """Word pairs with a known truth: words of recognised pages, two letters of some of them read as others."""
    w = _si_words(spark, d).where("length(word) >= 3").select("word", "freq")
    noisy = F.when(F.length("word") % 3 == 0, F.translate("word", "වත", "චන")).otherwise(F.col("word"))
    return w.select(noisy.alias("word"), F.col("word").alias("truth"), (F.length("word") * 17 % 100).cast("double").alias("conf"), F.when(F.length("word") > 6, "long").otherwise("short").alias("grp"), "freq")


_NOISY = f"""WITH e AS (SELECT DISTINCT ocr_id, text FROM ocr_pages), x AS (SELECT unnest(regexp_extract_all(text, '[{_S}{_J}]+')) AS w FROM e), y AS (SELECT regexp_replace(w, '^[{_J}]+|[{_J}]+$', '', 'g') AS word FROM x), l AS (SELECT word, count(*) AS freq FROM y WHERE word <> '' GROUP BY word),
pr AS (SELECT CASE WHEN length(word) % 3 = 0 THEN translate(word, 'වත', 'චන') ELSE word END AS word, word AS truth, CAST(length(word) * 17 % 100 AS DOUBLE) AS conf, CASE WHEN length(word) > 6 THEN 'long' ELSE 'short' END AS grp, freq FROM l WHERE length(word) >= 3)"""
# Runs of unequal characters in the same places; no other alignment is nearer, as letters are only ever exchanged one way.
_LEARNED = """, dp AS (SELECT word, truth, i, substr(word, i, 1) AS a, substr(truth, i, 1) AS b FROM (SELECT word, truth, unnest(range(1, length(word) + 1)) AS i FROM pr WHERE word <> truth)), dd AS (SELECT *, i - row_number() OVER (PARTITION BY word, truth ORDER BY i) AS run FROM dp WHERE a <> b),
rr AS (SELECT string_agg(a, '' ORDER BY i) AS src, string_agg(b, '' ORDER BY i) AS dst FROM dd GROUP BY word, truth, run), rn AS (SELECT src, dst, count(*) AS n FROM rr WHERE length(src) <= 2 GROUP BY src, dst),
ro AS (SELECT src, CAST(sum((length(word) - length(replace(word, src, ''))) // length(src)) AS BIGINT) AS occurrences FROM pr JOIN (SELECT DISTINCT src FROM rn) ON contains(word, src) GROUP BY src),
lr AS (SELECT src, dst, n, occurrences, n / CAST(greatest(occurrences, 1) AS DOUBLE) AS probability FROM rn JOIN ro USING (src) WHERE n >= 2)"""


@_query(_NOISY + _LEARNED + " SELECT src, dst, n, occurrences, round(probability, 9) AS probability FROM lr")
def learned_rules(spark, d):
    return learn.learn_rules(_noisy(spark, d)).select("src", "dst", "n", "occurrences", F.round("probability", 9).alias("probability"))


@_query(_NOISY + " SELECT grp, count(*) AS words, count(*) FILTER (WHERE word <> truth) AS wrong FROM pr GROUP BY grp")
def word_accuracy(spark, d):
    return learn.accuracy(_noisy(spark, d), ["grp"])


@_query(_NOISY + " SELECT word AS legacy, truth AS read, count(*) AS n FROM pr WHERE contains(word, 'ච') AND conf >= 50 GROUP BY 1, 2 ORDER BY n DESC, legacy, read LIMIT 40")
def pairs_with_code(spark, d):
    return learn.pairs_with(_noisy(spark, d).select(F.col("word").alias("legacy"), F.col("truth").alias("read"), "conf"), "ච", 40, 50.0)


# One ASCII character for each Sinhala letter, as the SQL function compares bytes.
_LETTERS = "".join(chr(c) for a, z in ((0xD81, 0xD83), (0xD85, 0xD96), (0xD9A, 0xDB1), (0xDB3, 0xDBB), (0xDBD, 0xDBD), (0xDC0, 0xDC6), (0xDCA, 0xDCA), (0xDCF, 0xDD4), (0xDD6, 0xDD6), (0xDD8, 0xDDF), (0xDE6, 0xDEF), (0xDF2, 0xDF4), (0x200C, 0x200D)) for c in range(a, z + 1))
_ASCII = "".join(chr(33 + k) for k in range(len(_LETTERS))).replace("'", "''")
_DISTANCE = lambda a, b: f"levenshtein(translate({a}, '{_LETTERS}', '{_ASCII}'), translate({b}, '{_LETTERS}', '{_ASCII}'))"
_SET_STEP = "SELECT {a}.rule_set, {a}.word, left({a}.form, i - 1) || dst || substr({a}.form, i + length(src)) AS form, {a}.score * weight AS score FROM {a} JOIN rules ON rules.rule_set = {a}.rule_set AND contains({a}.form, src) CROSS JOIN LATERAL unnest(range(1, length({a}.form) - length(src) + 2)) AS t(i) WHERE substr({a}.form, i, length(src)) = src"
_GRID = f"""{_NOISY}{_LEARNED}, st AS (SELECT * FROM (VALUES ('4,0', 4, 0.0), ('4,0.01', 4, 0.01), ('4,0.05', 4, 0.05), ('10,0', 10, 0.0), ('10,0.01', 10, 0.01), ('10,0.05', 10, 0.05)) AS t(rule_set, least, share)),
rules AS (SELECT rule_set, src, dst, CAST(CAST(greatest(probability, 0.001) AS FLOAT) AS DOUBLE) AS weight FROM lr JOIN st ON n >= least AND probability >= share WHERE length(src) <= 2 AND length(dst) <= 3),
lex AS (SELECT truth AS word, freq FROM pr WHERE freq >= 10), u AS (SELECT DISTINCT rule_set, word FROM pr CROSS JOIN (SELECT DISTINCT rule_set FROM rules) WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM lex)),
s0 AS (SELECT rule_set, word, word AS form, CAST(1.0 AS DOUBLE) AS score FROM u),
r1 AS ({_SET_STEP.format(a="s0")}), s1 AS (SELECT rule_set, word, form, max(score) AS score FROM r1 WHERE form <> word GROUP BY ALL),
r2 AS ({_SET_STEP.format(a="s1")}), s2 AS (SELECT rule_set, word, form, max(score) AS score FROM r2 WHERE form <> word GROUP BY ALL),
v AS (SELECT rule_set, word, form, max(score) AS weight FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY ALL),
k AS (SELECT v.rule_set, v.word, v.form AS fixed, lex.freq, lex.freq * v.weight AS score, row_number() OVER w AS rank, lead(lex.freq * v.weight) OVER w AS second FROM v JOIN lex ON lex.word = v.form WINDOW w AS (PARTITION BY v.rule_set, v.word ORDER BY lex.freq * v.weight DESC, v.form)),
cg AS (SELECT gate, min_score, margin, min_freq FROM (SELECT unnest([NULL, 93.0, 95.0, 97.0]) AS gate), (SELECT unnest([0.0, 0.02, 0.05, 0.1, 0.2, 1.0]) AS min_score), (SELECT unnest([2.0, 3.0, 5.0]) AS margin), (SELECT unnest([1, 2]) AS min_freq)),
tr AS (SELECT k.rule_set, CAST(cg.gate AS DOUBLE) AS gate, CAST(cg.min_score AS DOUBLE) AS min_score, CAST(cg.margin AS DOUBLE) AS margin, cg.min_freq, pr.grp, pr.word, pr.truth, k.fixed, {_DISTANCE("k.fixed", "pr.truth")} - {_DISTANCE("pr.word", "pr.truth")} AS change,
 (cg.gate IS NULL OR pr.conf IS NULL OR pr.conf < cg.gate) AND k.freq >= cg.min_freq AND k.score >= cg.min_score AND (k.second IS NULL OR k.score >= cg.margin * k.second) AS ok FROM pr JOIN k ON k.word = pr.word AND k.rank = 1 CROSS JOIN cg),
gs AS (SELECT rule_set, gate, min_score, margin, min_freq, grp, count(*) FILTER (WHERE ok AND fixed = truth) AS fixed, count(*) FILTER (WHERE ok AND fixed <> truth AND word = truth) AS harmed, count(*) FILTER (WHERE ok AND fixed <> truth AND word <> truth) AS still, CAST(coalesce(sum(change) FILTER (WHERE ok), 0) AS BIGINT) AS edits FROM tr GROUP BY ALL)"""


@_query(_GRID + " SELECT rule_set, gate, min_score, margin, min_freq, grp, fixed, harmed, still, edits FROM gs")
def grid_search(spark, d):
    """Every configuration with every set of learned rules, by group of words."""
    p = _noisy(spark, d)
    lex = p.where("freq >= 10").select(F.col("truth").alias("word"), "freq")
    rules = learn.rule_sets(learn.learn_rules(p)).checkpoint()  # a table of a few rows, read in every round of the expansion
    return learn.simulate(p, lex, rules, learn.grid(spark), by=["grp"])


@_query(_GRID + """, gt AS (SELECT rule_set, gate, min_score, margin, min_freq, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(harmed) AS BIGINT) AS harmed, CAST(sum(still) AS BIGINT) AS still, CAST(sum(edits) AS BIGINT) AS edits FROM gs GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY edits, harmed, rule_set, min_score, margin, min_freq) AS r FROM gt) SELECT rule_set, gate, min_score, margin, min_freq, fixed, harmed, still, edits FROM gr WHERE r = 1""")
def grid_best(spark, d):
    sums = [F.sum(c).alias(c) for c in ("fixed", "harmed", "still", "edits")]
    return learn.best_by_gate(grid_search(spark, d).groupBy("rule_set", "gate", "min_score", "margin", "min_freq").agg(*sums))


@_query()
def code_alignment(spark, d):
    """Codes learned back from all words, typed with a known table of single codes."""
    letters = "කගතදනපබමයරලවසහිුාෙ"
    others = "".join(c for c in [*map(chr, range(0xD80, 0xE00)), "\u200c", "\u200d"] if c not in letters)
    codes = "kgtdnpbmyrlvshiuae" + "".join(chr(0x100 + i) for i in range(len(others)))
    words = _si_words(spark, d).select(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)).alias("units"), F.translate("word", letters + others, codes).alias("codes"))
    return learn.align_codes(words).where("rank = 1").select("code", "unit", "n", F.round("share", 4).alias("share"))


# --- files ------------------------------------------------------------------------------------------------------------------------------


def _as_html(text):
    """A document as an HTML file."""
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><p>"), F.regexp_replace(text, "\n\n", "<p>"), F.lit("</body></html>"))


def _files(spark, d):
    """Documents as files of five kinds."""
    kind = F.col("doc_id") % 5
    text = F.coalesce("text", F.lit(""))
    content = F.when(kind == 0, _as_html(text)).when(kind == 1, F.concat(F.lit("%PDF-1.7\n"), text)).otherwise(text)
    ext = F.element_at(F.array(F.lit(".htm"), F.lit(".bin"), F.lit(".md"), F.lit(".txt"), F.lit(".docx")), (kind + 1).cast("int"))
    return _read(spark, d, "documents").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), ext).alias("path"), content.cast("binary").alias("content"))


@_query("""WITH f AS (SELECT doc_id, doc_id % 5 AS k, coalesce(text, '') AS text FROM documents) SELECT 'in/' || doc_id || CASE k WHEN 0 THEN '.htm' WHEN 1 THEN '.bin' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' ELSE '.docx' END AS path,
CASE k WHEN 1 THEN 'pdf' WHEN 4 THEN 'office' WHEN 0 THEN 'html' WHEN 2 THEN 'markdown' ELSE CASE WHEN text = '' OR floor((least(octet_length(encode(text)), 4096) - len(regexp_extract_all(text, '[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}]'))) * 100 / least(octet_length(encode(text)), 4096)) >= 95 THEN 'text' END END AS format FROM f""")
def formats_sniffed(spark, d):
    return _files(spark, d).select("path", files.sniff(F.col("path"), F.col("content")).alias("format"))


@_query()
def files_extracted(spark, d):
    e = files.extract(_files(spark, d))
    return e.select("doc", "format", "title", F.array_join("langs", ",").alias("langs"), F.array_join("flags", ",").alias("flags"), F.md5("markdown").alias("digest"))


@_query()
def html_markdown(spark, d):
    """Every document, as HTML, to Markdown."""
    path, content = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".htm")), _as_html(F.coalesce("text", F.lit(""))).cast("binary")
    h = _read(spark, d, "documents").select(path.alias("path"), html.to_markdown(files.decode(content)).alias("h"))
    return h.select("path", "h.title", F.md5("h.markdown").alias("digest"))


@_query("SELECT doc_id, sha256(coalesce(text, '')) AS checksum FROM documents")
def checksums(spark, d):
    return _read(spark, d, "documents").select("doc_id", files.checksum(F.coalesce("text", F.lit("")).cast("binary")).alias("checksum"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
