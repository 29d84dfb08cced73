"""Per-page routing: which text of a page can be trusted, which page needs recognition, and the final assembly.

``pdf_pages(doc, page, raw_md, needs_ocr, reason, fonts, legacy_words)`` and ``ocr(doc, page, text, confidence)`` are
relations that external readers fill. The cascade is one CASE over computed columns; the costly conversion and repair see
null for the rows that don't need them, so that they cost nothing there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import chars
from ..functions import fonts, health, legacy, metrics, normalize, render, script

# Least agreement of a text layer, and of converted text, with recognition; letters of the page that is compared and of pages that follow its verdict.
LAYER_AGREEMENT, CONVERTED_AGREEMENT, SAMPLE_LETTERS, FOLLOW_LETTERS = 0.90, 0.80, 200, 50


@dataclass(frozen=True)
class Config:
    langs: tuple[str, ...] = ()
    ocr: str = "auto"  # auto, always, never
    verify: bool = True
    repair: bool = True
    legacy_convert: bool = True
    dpi: int = 300


# Accepted spellings of the mode.
MODES = {"auto": "auto", "always": "always", "force": "always", "never": "never", "off": "never"}


def config(langs: str = "", ocr: str = "auto", dpi: int = 300, **flags: bool) -> Config:
    """A configuration from user input: unknown modes and languages are errors, dpi is kept within 72 to 600."""
    names = {x: code for code, spellings in script.SPELLINGS.items() for x in spellings.split()}
    wanted = [x.strip().lower() for x in langs.replace("+", ",").split(",") if x.strip()]
    if unknown := [x for x in wanted if x not in names]:
        raise ValueError(f"unknown languages {unknown}")
    if ocr.lower() not in MODES:
        raise ValueError(f"unknown mode {ocr!r}")
    return Config(tuple(dict.fromkeys(names[x] for x in wanted)), MODES[ocr.lower()], dpi=min(max(dpi, 72), 600), **flags)


def _blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{chars.WS}]")


def plan(pages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds ``plan`` (text, ocr, empty), ``method``, ``markdown``, ``moved``, ``flags`` and ``ocr_langs``."""
    first_font = F.get(F.filter(F.transform(F.coalesce("fonts", F.expr("cast(array() as array<string>)")), fonts.legacy_font), lambda x: x.isNotNull()), 0)
    expected = F.lit(cfg.langs[0]) if cfg.langs else F.col("font_lang")
    w = F.col("legacy_words")
    parts = [w[x].alias(f"w_{x}") for x in ("legacy", "other", "mixed", "text", "legacy_chars", "other_chars")]
    d = pages.select("doc", "page", "raw_md", "needs_ocr", "reason", "fonts", w.isNotNull().alias("has_words"), *parts, normalize.normalize(F.coalesce("raw_md", F.lit(""))).alias("md"))
    d = health.once(d, font_family=first_font["family"], font_lang=first_font["lang"])
    d = health.assessed(d, "md", "h", expected, flat_columns=True)
    letters = F.struct(F.col("h_si").alias("si"), F.col("h_ta").alias("ta"), F.col("h_latin").alias("latin"))
    latin = script.share(letters, "latin") > F.lit(0.5).cast("float")
    if cfg.legacy_convert and cfg.ocr != "always":
        convertible = F.coalesce((F.col("font_family") == "fm-abhaya") & (latin | _blank(F.col("md"))), F.lit(False))
        stand_in = convertible & _blank(F.col("raw_md")) & ~_blank(F.col("w_text"))
        source = F.when(convertible, F.when(stand_in, F.col("w_text")).otherwise(F.col("raw_md")))
        d = d.withColumn("tried", convertible).withColumn("stand_in", stand_in).withColumn("conv", legacy.convert_page(source, *[F.col(f"w_{x}") for x in ("legacy", "other", "mixed", "legacy_chars", "other_chars")]))
        d = d.withColumn("conv_text", F.col("conv.text")).withColumn("unmatched", F.coalesce("conv.unmatched", F.lit(0))).drop("conv", *[f"w_{x}" for x in ("legacy", "other", "mixed", "text", "legacy_chars", "other_chars")])
        d = health.assessed(d, "conv_text", "c", F.lit("si"), flat_columns=True)
    else:
        none = F.expr("cast(array() as array<string>)")
        d = d.withColumns({"tried": F.lit(False), "stand_in": F.lit(False), "conv_text": F.lit(None).cast("string"), "unmatched": F.lit(0), "c_verdict": F.lit("broken"), "c_reasons": none})
    only_visual = F.coalesce((F.col("h_verdict") == "broken") & (F.array_join("h_reasons", "+") == "visual_order"), F.lit(False)) & F.lit(cfg.repair)
    d = d.withColumn("only_visual", only_visual).withColumn("fix", normalize.repair_visual_order(F.when(only_visual, F.col("md"))))
    d = d.withColumn("fix_text", F.col("fix.text")).withColumn("moved", F.col("fix.moved")).drop("fix")
    d = health.assessed(d, "fix_text", "f", expected, flat_columns=True).withColumn("fixed", F.col("only_visual") & (F.col("f_verdict") == "healthy"))

    needs = F.coalesce("needs_ocr", F.lit(False))
    converted = F.col("tried") & (F.col("c_verdict") == "healthy")
    is_legacy = F.coalesce(F.col("font_family").isNotNull() & latin, F.lit(False))
    broken = F.col("h_verdict") == "broken"
    step = (
        F.when(F.lit(cfg.ocr == "always"), "forced").when(converted, "converted").when(needs, "inspector").when(is_legacy, "legacy").when(broken & F.col("fixed"), "repaired").when(broken, "broken")
        .when((F.col("h_verdict") == "empty") & _blank(F.col("md")), "empty").otherwise("layer")
    )
    d = health.once(d, step=step)
    some = lambda test: F.coalesce(F.exists("fonts", test), F.lit(False))
    on = lambda *names: F.col("step").isin(*names)
    unmatched = F.col("unmatched")
    flags = F.array_compact(
        F.array(
            F.when(some(fonts.is_prior_ocr), "prior_ocr_layer"),
            F.when(some(fonts.is_unnamed_truetype), "type3_truetype_fonts"),
            F.when(on("forced"), "ocr_forced"),
            F.when(F.col("stand_in"), "legacy_text_source:pdfium"),
            F.when(on("converted"), F.concat(F.lit("legacy_converted:"), "font_family")),
            F.when(on("converted") & ~F.col("has_words"), "legacy_convert:no_font_info"),
            F.when(on("converted") & (unmatched > 0), F.concat(F.lit("legacy_unmatched_tokens:"), unmatched.cast("string"))),
            F.when(F.col("tried") & ~on("converted", "forced"), F.concat(F.lit("legacy_convert_failed:"), F.array_join("c_reasons", "+"))),
            F.when(on("inspector"), F.concat(F.lit("inspector:"), F.coalesce("reason", F.lit("unreliable_text")))),
            F.when(on("legacy"), F.concat(F.lit("legacy_font:"), "font_family")),
            F.when(on("repaired"), "visual_order_repaired"),
            F.when(on("broken"), F.concat(F.lit("text_layer:"), F.array_join("h_reasons", "+"))),
        )
    )
    return d.select(
        "doc", "page", "raw_md", "md",
        F.when(on("empty"), "empty").when(on("converted", "repaired", "layer"), "text").otherwise("ocr").alias("plan"),
        F.when(on("converted"), "legacy_converted").when(on("repaired"), "text_layer_repaired").when(on("layer"), "text_layer").when(on("empty"), "empty").alias("method"),
        F.when(on("converted"), F.col("conv_text")).when(on("repaired"), F.col("fix_text")).when(on("layer"), F.col("md")).alias("markdown"),
        F.when(on("repaired"), F.col("moved")).alias("moved"),
        flags.alias("flags"),
        F.when(on("forced", "inspector", "legacy", "broken"), _ocr_langs(cfg)).alias("ocr_langs"),
    )


def _ocr_langs(cfg: Config) -> Column:
    """Configured, else the legacy font's (and English beside a Latin font), else the scripts seen, else none: to be probed."""
    if cfg.langs:
        return F.array(*map(F.lit, cfg.langs))
    none = F.expr("cast(array() as array<string>)")
    of_font = F.array_compact(F.array(F.col("font_lang"), F.when(fonts.has_latin(F.col("fonts")), "en")))
    n = F.struct(F.col("h_si").alias("si"), F.col("h_ta").alias("ta"), F.col("h_latin").alias("latin"))
    seen = F.filter(script.languages(n, 0.03, 50), lambda x: F.when(x == "si", n["si"]).when(x == "ta", n["ta"]).otherwise(n["latin"]) >= 30)
    return F.when(F.col("font_family").isNotNull(), of_font).when(F.col("h_latin_gibberish") < F.lit(0.5).cast("float"), seen).otherwise(none)


def verify(plans: DataFrame, ocr: DataFrame) -> DataFrame:
    """Compare the page of each document and kind that has most Sinhala and Tamil letters with its recognised text; where
    they disagree, the kind's pages go to recognition, else they are marked as verified. ``ocr(doc, page, text)``."""
    c = script.script_counts(F.coalesce("markdown", F.lit("")))
    kind = F.when(F.col("plan") == "text", F.when(F.col("method") == "text_layer", "layer").when(F.col("method") == "legacy_converted", "converted"))
    # The cascade with its conversions runs once: its result is written to the shared folder and read three times below.
    d = plans.withColumn("counts", c).withColumn("kind", kind).withColumn("indic", F.col("counts.si") + F.col("counts.ta")).checkpoint()
    rich = d.where(F.col("kind").isNotNull() & (F.col("indic") >= SAMPLE_LETTERS)).groupBy("doc", "kind").agg(F.max(F.struct("indic", "page")).alias("top"))
    chosen = rich.select("doc", "kind", F.col("top.page").alias("page"))
    read = d.select("doc", "page", "kind", "markdown").join(chosen, ["doc", "kind", "page"]).join(ocr.select("doc", "page", F.col("text").alias("read")), ["doc", "page"])
    least = F.when(F.col("kind") == "layer", LAYER_AGREEMENT).otherwise(CONVERTED_AGREEMENT)
    scored = metrics.agreement_of(read.select("doc", "kind", normalize.canonical(F.col("markdown")).alias("a"), normalize.canonical(F.col("read")).alias("b")), ["doc", "kind"])
    verdicts = scored.select("doc", "kind", F.round("score", 2).alias("score"), (F.col("score") >= least).alias("ok"))
    joined = d.join(verdicts, ["doc", "kind"], "left").withColumn("follows", F.col("ok").isNotNull() & (F.col("indic") >= FOLLOW_LETTERS))
    failed = F.coalesce(F.col("follows") & ~F.col("ok"), F.lit(False))
    note = F.format_string("%.2f", "score")
    return joined.select(
        "doc", "page", "raw_md", "md",
        F.when(failed, "ocr").otherwise(F.col("plan")).alias("plan"),
        F.when(failed, F.lit(None)).otherwise(F.col("method")).alias("method"),
        F.when(failed, F.lit(None)).otherwise(F.col("markdown")).alias("markdown"),
        "moved",
        F.when(failed, F.array(F.concat(F.lit("verify_failed:"), note))).when(F.col("follows"), F.array_append("flags", F.concat(F.lit("verified:"), note))).otherwise(F.col("flags")).alias("flags"),
        F.when(failed, script.languages(F.col("counts"), 0.15, 20)).otherwise(F.col("ocr_langs")).alias("ocr_langs"),
    )


def resolve_langs(plans: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Languages for pages that are to be recognised and have none: those of a trial recognition ``probes(doc, page, text)``, else English."""
    none = F.expr("cast(array() as array<string>)")
    if probes is None:
        joined = plans.withColumn("found", none)
    else:
        texts = probes.groupBy("doc", "page").agg(script.sum_counts(script.script_counts(F.col("text"))).alias("c"))
        joined = plans.join(texts.select("doc", "page", script.probed(F.col("c")).alias("found")), ["doc", "page"], "left")
    open_ = (F.col("plan") == "ocr") & (F.size(F.coalesce("ocr_langs", none)) <= 0)
    hit = open_ & (F.size("found") > 0)
    flags = F.when(hit, F.array_append(F.coalesce("flags", none), F.concat(F.lit("probed_langs:"), script.lang_arg(F.col("found"))))).otherwise(F.col("flags"))
    langs = F.when(hit, F.col("found")).when(open_, F.array(F.lit("en"))).otherwise(F.col("ocr_langs"))
    return joined.withColumns({"flags": flags, "ocr_langs": langs}).drop("found")


def assemble(plans: DataFrame, ocr: DataFrame | None = None, disabled: bool = False) -> DataFrame:
    """Pages of the documents: a recognised text wins, else the plan's text, else the unreliable layer, marked as such.

    ``ocr(doc, page, text, confidence)`` may have ``flags`` of its own, as ``correct.finish`` gives them.
    """
    if ocr is None:
        joined = plans.withColumn("read", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("float")).withColumn("read_flags", F.lit(None).cast("array<string>"))
    else:
        own = F.col("flags") if "flags" in ocr.columns else F.lit(None).cast("array<string>")
        joined = plans.join(ocr.select("doc", "page", F.col("text").alias("read"), "confidence", own.alias("read_flags")), ["doc", "page"], "left")
    why = "ocr_disabled" if disabled else "ocr_unavailable"
    use = F.col("read").isNotNull() & (F.col("plan") == "ocr")
    lost = (F.col("plan") == "ocr") & ~use
    kind = F.when(use, "ocr").when(lost & _blank(F.col("md")), "failed").when(lost, "text_layer").otherwise(F.col("method"))
    text = F.when(use, F.col("read")).when(lost, F.col("md")).otherwise(F.coalesce("markdown", F.lit("")))
    low = F.when(use & (F.col("confidence") < 70), F.array(F.lit("low_ocr_confidence")))
    none = F.expr("cast(array() as array<string>)")
    flags = F.concat(F.coalesce("flags", none), F.coalesce(F.when(use, F.col("read_flags")), none), F.coalesce(low, none), F.coalesce(F.when(lost, F.array(F.lit(f"unreliable_text_layer:{why}"))), none))
    reason = F.when(lost & _blank(F.col("md")), F.concat(F.lit(f"{why}: "), F.array_join("flags", ",")))
    out = joined.select("doc", "page", kind.alias("method"), text.alias("markdown"), flags.alias("flags"), F.when(use, F.col("confidence")).alias("confidence"), "moved", reason.alias("reason"))
    return out.withColumn("langs", script.languages(script.script_counts(F.col("markdown")), 0.05, 20)).withColumn("label", render.method_label(F.col("method")))
