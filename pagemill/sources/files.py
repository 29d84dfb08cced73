"""Files as rows: scanning folders, telling formats apart, decoding, and reading into pages.

Empty content is text (Spark's file sources skip files of no bytes); unreadable bytes are decoded leniently; files of no known format keep a null format.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import chars
from ..functions import health, html, normalize, render, script
from ..functions.tables import IMAGE_EXTENSIONS, OFFICE_EXTENSIONS
from . import office


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of all files below ``path``, without dot-files and ground truths, in splits of Spark's making."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~name.startswith(".") & ~name.contains(".gt.")).select("path", "content")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of the .txt and .md files below ``path``, without dot-files, for word lists; invalid bytes are replaced."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(~F.col("path").contains("/.") & ~name.startswith(".") & extension(F.col("path")).isin("txt", "md"))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, as selections of pages are kept; blank lines are skipped, broken ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_tables(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """CSV files as rows; the first line names the columns."""
    return spark.read.option("header", "true").option("sep", separator).option("multiLine", "true").csv(path)


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, "[^.]\\.([^.]+)$", 1))


def sniff(path: Column, content: Column) -> Column:
    """Format by signature, extension and look of the first 4 KiB: pdf, image, office, html, markdown, text or null."""
    head = F.substring(F.coalesce(content, F.lit(b"")), 1, 4096)
    hexed = F.hex(head)
    ext = extension(path)
    starts = lambda *signs: F.greatest(*[hexed.startswith(s).cast("int") for s in signs], F.lit(0)) > 0
    text = F.decode(head, "ISO-8859-1")
    low = F.lower(F.regexp_replace(text, "^(?:\\xEF\\xBB\\xBF)?[\\x09-\\x0d\\x20\\x85\\xa0]+|^\\xEF\\xBB\\xBF", ""))
    image = starts("89504E47", "FFD8FF", "49492A00", "4D4D002A", "47494638", "0000000C6A502020") | (starts("424D") & ext.isin(*IMAGE_EXTENSIONS)) | (starts("52494646") & (F.substring(hexed, 17, 8) == "57454250"))
    web = low.startswith("<!doctype html") | low.startswith("<html") | (low.startswith("<?xml") & low.contains("<html")) | ext.isin("html", "htm", "xhtml") | (low.contains("<body") & low.contains("</"))
    control = F.regexp_count(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"))
    size = F.length(head)
    printable = (size == 0) | (F.floor((size - control) * 100 / F.greatest(size, F.lit(1))) >= 95)
    return (
        F.when(F.instr(F.substring(text, 1, 1028), "%PDF-").cast("boolean") | text.startswith("%PDF"), "pdf")
        .when(image, "image")
        .when(starts("504B0304", "D0CF11E0", "7B5C727466") | ext.isin(*OFFICE_EXTENSIONS), "office")
        .when(web, "html")
        .when(ext.isin("md", "markdown", "mdx"), "markdown")
        .when(ext.isin(*IMAGE_EXTENSIONS), "image")
        .when(ext == "pdf", "pdf")
        .when(printable, "text")
    )


# Encodings that are tried on bytes without a mark that aren't UTF-8, in order of precedence.
SINGLE_BYTE = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1256", "koi8_r")
MULTI_BYTE = ("shift_jis", "euc_jp", "euc_kr", "gb18030", "big5")


def _by_script(text: str) -> dict[str, int]:
    """Characters of a text by a coarse kind: letters by alphabet and case, kana, Hangul, common and rare Han, the rest."""
    found: dict[str, int] = defaultdict(int)
    for c in text:
        if c.isascii():
            found["ascii"] += 1
        elif "\u3040" <= c <= "\u30ff":
            found["kana"] += 1
        elif "\uac00" <= c <= "\ud7a3":
            found["hangul"] += 1
        elif "\u4e00" <= c <= "\u9fff":
            found["han"] += 1
        elif c in "\u3000\u3001\u3002\uff0c\uff01\uff1f\u300c\u300d":
            found["wide"] += 1
        else:
            found["lower" if c.islower() else "upper" if c.isupper() else "letter" if c.isalpha() else "quote" if c in "“”‘’„«»–—…°§€ \xa0" else "odd"] += 1
    return found


def _single_score(text: str) -> float:
    """How well the characters beyond ASCII go together: letters of one alphabet within words, small ones after small ones."""
    score = 0.0
    for m in re.finditer(r"[^\x00-\x7f]", text):
        c, before, after = m[0], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if c.isalpha():
            beside = [x for x in (before, after) if x.isalpha()]
            alike = sum(x.isascii() == ("\xc0" > x or c < "\u0250") and (not (c.isupper() and before.islower())) for x in beside)
            foreign = sum(x.isascii() and c >= "\u0370" for x in beside)
            score += 0.4 + 0.3 * alike - 1.5 * foreign - 1.0 * (c.isupper() and before.islower())
        elif c in "“”‘’„«»–—…°§€\xa0":
            score += 0.3
        else:
            score -= 0.8 if before.isalpha() and after.isalpha() or c < "\xa0" else 0.3
    return score


#: East Asian characters right beside Latin letters; pairs of high bytes, and the leads of the punctuation and common characters.
_MINGLED = re.compile(r"[A-Za-z][\u4e00-\u9fff\uac00-\ud7a3]|[\u4e00-\u9fff\uac00-\ud7a3][A-Za-z]")
_PAIR, _COMMON_LEADS = re.compile(rb"[\x80-\xff][\x40-\xff]"), {"gb18030": ((0xA1, 0xA3), (0xB0, 0xD7)), "big5": ((0xA1, 0xA3), (0xA4, 0xC6))}


def guess_encoding(raw: bytes) -> str:
    """The encoding under which bytes that aren't UTF-8 read most like text: zero bytes tell UTF-16, whole characters of few
    kinds the East Asian ones, and how letters go together the single-byte ones; ties go to the first named."""
    sample = raw[: 1 << 16]
    if len(sample) > 3:
        even, odd = sample[::2].count(0), sample[1::2].count(0)
        if max(even, odd) > len(sample) // 8 and min(even, odd) * 4 < max(even, odd):
            return "utf-16-le" if odd > even else "utf-16-be"
    high = sum(x >= 0x80 for x in sample)
    best, most = "cp1252", float("-inf")
    for name in MULTI_BYTE:
        text = sample.decode(name, "ignore")
        kinds = _by_script(text)
        whole = kinds["kana"] + kinds["hangul"] + kinds["han"] + kinds["wide"]
        lost = high - len(text.encode(name, "ignore")) + sum(x < 0x80 for x in sample)
        own = {"shift_jis": kinds["kana"], "euc_jp": kinds["kana"], "euc_kr": kinds["hangul"], "gb18030": kinds["han"] + kinds["wide"] - 2 * (kinds["kana"] + kinds["hangul"]), "big5": 0.9 * kinds["han"] + kinds["wide"]}[name]
        mingled = len(_MINGLED.findall(text))
        leads = [pair[0] for pair in _PAIR.findall(sample)] if name in _COMMON_LEADS else []
        rare = sum(not any(low <= x <= upto for low, upto in _COMMON_LEADS[name]) for x in leads) / max(len(leads), 1)
        if whole >= 2 and own >= (0.9 if name == "euc_kr" else 0.15) * whole and lost <= 2 and whole * 2 >= 0.8 * high and mingled * 5 <= whole and rare < 0.1:
            score = own / whole + (name in ("shift_jis", "euc_jp", "euc_kr"))
            if score > most:
                best, most = name, score
    if most > float("-inf"):
        return best
    for name in SINGLE_BYTE:
        text = sample.decode(name, "replace")
        score = _single_score(text) - 2.0 * text.count("\ufffd")
        if score > most + 1e-9:
            best, most = name, score
    return best


def decode_bytes(raw: bytes) -> str:
    """By byte order mark, as strict UTF-8, else by ``guess_encoding`` (unused bytes of code page 1252 as their numbers)."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    name = guess_encoding(raw) if b"\0" in raw else ""
    try:
        return raw.decode(name if name.startswith("utf-16") else "utf-8")
    except UnicodeDecodeError:
        name = guess_encoding(raw)
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw) if name == "cp1252" else raw.decode(name, "replace")


@F.arrow_udf(T.StringType())
def _decode(contents: pa.Array) -> pa.Array:
    return pa.array([None if x is None else decode_bytes(x) for x in contents.to_pylist()], pa.string())


def decode(content: Column) -> Column:
    """Valid UTF-8 without a mark stays in the JVM; only other content goes to Python."""
    plain = F.is_valid_utf8(content.cast("string"))
    marked = F.hex(F.substring(content, 1, 3)).rlike("^(?:EFBBBF|FFFE|FEFF)")
    easy = plain & ~marked & ~F.contains(F.hex(F.substring(content, 1, 64)), F.lit("00"))  # zero bytes may mean UTF-16
    return F.coalesce(F.when(easy, content.cast("string")), _decode(F.when(~easy, content)))


def extract(files: DataFrame) -> DataFrame:
    """Files ``(path, content)`` that hold markup, text or office documents to one page each:
    ``(doc, format, markdown, title, langs, flags)``.

    PDF and image files need external readers; they, and office files that cannot be read, come out with a null text. Each
    branch calls Python for its own rows only.
    """
    kind = lambda *names: F.col("format").isin(*names)
    d = files.select(F.col("path").alias("doc"), "content", sniff(F.col("path"), F.col("content")).alias("format")).where("format is not null")
    d = d.withColumn("text", F.when(kind("html", "markdown", "text"), decode(F.when(kind("html", "markdown", "text"), F.col("content")))))
    d = d.withColumn("page", html.to_markdown(F.when(kind("html"), F.col("text")))).withColumn("office", office.to_markdown(F.col("doc"), F.when(kind("office"), F.col("content"))))
    raw = F.when(kind("html"), F.col("page.markdown")).when(kind("office"), F.col("office.markdown")).when(kind("text"), render.text_to_markdown(F.col("text"))).otherwise(F.col("text"))
    d = health.assessed(d.withColumn("markdown", normalize.normalize(raw)), "markdown")
    flag = F.when(F.col("h.latin_gibberish") >= F.lit(0.5).cast("float"), "legacy_font_text").when(F.array_contains("h.reasons", "visual_order"), "visual_order")
    return d.select("doc", "format", "markdown", F.coalesce("page.title", "office.title").alias("title"), script.languages(F.col("h.letters"), 0.05, 20).alias("langs"), F.array_compact(F.array(flag)).alias("flags"))


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{chars.WS}]")
