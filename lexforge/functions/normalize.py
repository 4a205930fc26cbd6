"""Text normalisation as Column -> Column functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks and letter forms of Arabic script.
DIACRITICS = "[ً-ٰٟ]"
TATWEEL = "ـ"
ALEF_HAMZA = "إأٱ"
ALEF_MADDA = "آ"
ALEF = "ا"
YEH_DOTLESS, YEH = "ى", "ي"
TEH_MARBUTA, HEH = "ة", "ه"
ZERO_WIDTH = "[​-‏‪-‮⁠﻿]"
ARABIC = "[؀-ۿ]"


def replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def collapse(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Non-empty white-space separated tokens."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use's lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def evaluation(c: Column) -> Column:
    """For error rates: no diacritics, hamza forms to alef (madda stays), dotless yeh to yeh, collapsed."""
    c = F.translate(F.regexp_replace(c, DIACRITICS, ""), ALEF_HAMZA + YEH_DOTLESS, ALEF * len(ALEF_HAMZA) + YEH)
    return collapse(c)


def comparison(c: Column) -> Column:
    """For look-ups: also no tatweel, madda to alef, teh marbuta to heh, no punctuation, lower case."""
    c = F.regexp_replace(c, f"{DIACRITICS}|{TATWEEL}", "")
    c = F.translate(c, ALEF_HAMZA + ALEF_MADDA + YEH_DOTLESS + TEH_MARBUTA, ALEF * 4 + YEH + HEH)
    return collapse(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")))


def sanitised_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, DIACRITICS, ""))


def has_diacritics(c: Column) -> Column:
    return c.rlike(DIACRITICS)


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; there is no built-in for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which maps presentation forms to letters."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def pipeline(c: Column) -> Column:
    """Composed, blanks but newlines to a space, no zero-width marks, every line trimmed."""
    c = replaced(nfc(c), [(r"[^\S\n]+", " "), (ZERO_WIDTH, ""), (r"(?m)^ +| +$", "")])
    return F.trim(c)


def html_text(c: Column) -> Column:
    """Tags out in a fixed order: breaks and paragraphs to newlines, items to dashes, then entities."""
    tags = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</?p>", "\n"), (r"(?i)<li>", "\n- "), (r"(?i)</li>", ""), (r"<[^>]+>", "")]
    entities = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
    return F.trim(F.regexp_replace(replaced(c, tags + entities), r"\n{3,}", "\n\n"))


def mixed_spacing(c: Column) -> Column:
    """A space between Arabic and Latin letters or digits; single spaces."""
    return F.trim(replaced(c, [(f"({ARABIC})([A-Za-z0-9])", "$1 $2"), (f"([A-Za-z0-9])({ARABIC})", "$1 $2"), (r" {2,}", " ")]))


def repaired_units(c: Column) -> Column:
    """Unit letters that a scan drew apart."""
    units = ["mmHg", "kPa", "mg", "kg", "ml", "mm", "cm"]
    return replaced(c, [(rf"(?<![A-Za-z])({r'\s+'.join(u)})(?![A-Za-z])", u) for u in units])


def components(c: Column) -> Column:
    """struct<arabic,latin,numbers> of the runs of each kind, joined by spaces."""
    runs = lambda p: F.array_join(F.regexp_extract_all(c, F.lit(p), F.lit(0)), " ")
    return F.struct(runs("[؀-ۿ]+").alias("arabic"), runs("[A-Za-z]+").alias("latin"), runs("[0-9]+").alias("numbers"))


def language_runs(c: Column) -> Column:
    """array<struct<lang,text>> of neighbouring tokens of one script."""
    script = lambda w: F.when(w.rlike(ARABIC), "ar").when(w.rlike("[A-Za-z]"), "en").otherwise("other")
    start = F.array().cast("array<struct<lang:string,text:string>>")

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.lang.alias("lang"), F.concat_ws(" ", last.text, w).alias("text"))))
        fresh = F.concat(acc, F.array(F.struct(script(w).alias("lang"), w.alias("text"))))
        return F.when(F.size(acc) == 0, fresh).when(last.lang == script(w), grown).otherwise(fresh)

    return F.aggregate(words(c), start, step)


def rtl_display(c: Column) -> Column:
    """Mixed text for display: in right-to-left text, runs of Latin letters and digits stand between
    left-to-right marks; other text is as it was."""
    ar, en = F.regexp_count(c, F.lit(ARABIC)), F.regexp_count(c, F.lit("[A-Za-z]"))
    marked = F.regexp_replace(c, r"[A-Za-z0-9][A-Za-z0-9 .,:/_-]*[A-Za-z0-9]", "\u200e$0\u200e")
    return F.when((ar + en > 0) & (ar / (ar + en) > 0.7), marked).otherwise(c)


#: Corrections of machine-translated text, in order.
TRANSLATION_STEPS = [
    (r"\s+،", "،"), (r"(?<=[0-9]) (?=[0-9])", ""), ("رغم وأن", "رغم أن"), (r"(?U)\b(\w+)( \1\b)+", "$1"),
    (f"(?<={ARABIC}),", "،"), (rf"(?<={ARABIC})\?", "؟"), (r" {2,}", " "), (r"\s+([.,;:!])", "$1"),
]


def translation_corrected(c: Column) -> Column:
    """struct<text,changes> after the ordered corrections; changes numbers those that took effect."""
    flags, text = [], c
    for i, (pattern, to) in enumerate(TRANSLATION_STEPS):
        after = F.regexp_replace(text, pattern, to)
        flags.append(F.when(after != text, F.lit(i)))
        text = after
    return F.struct(text.alias("text"), F.filter(F.array(*flags), lambda x: x.isNotNull()).alias("changes"))


def rule_corrected(source: Column, target: Column, rules: list[tuple[str, str, str]]) -> Column:
    """target with each rule's wrong words replaced where its source pattern occurs, in order."""
    return reduce(lambda t, r: F.when(F.lower(source).contains(r[0].lower()) & t.contains(r[1]), F.replace(t, F.lit(r[1]), F.lit(r[2]))).otherwise(t), rules, target)


def mapped_words(c: Column, mapping: Column) -> Column:
    """Words with their replacement in a map column, joined by spaces."""
    return F.array_join(F.transform(words(c), lambda w: F.coalesce(mapping[w], w)), " ")


def repaired_digits(c: Column) -> Column:
    """Letters a scan took for digits, only in tokens that hold a digit and become digits alone."""
    fixed = lambda w: F.translate(w, "OoIl|ZSGTB", "0011125678")
    return F.array_join(F.transform(words(c), lambda w: F.when(w.rlike("[0-9]") & fixed(w).rlike("^[0-9]+$"), fixed(w)).otherwise(w)), " ")


def protected(c: Column, terms: list[str]) -> Column:
    """struct<text,found>: terms, longest first, replaced by numbered placeholders."""
    import re

    pattern = "(?i)" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.split(c, pattern)
    marked = F.zip_with(parts, F.transform(found, lambda x, i: F.concat(F.lit("__MED_"), i.cast("string"), F.lit("__"))), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.struct(F.array_join(marked, "").alias("text"), found.alias("found"))


def restored(c: Column, found: Column) -> Column:
    """The inverse of protected()."""
    return F.aggregate(F.transform(found, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), c, lambda t, x: F.replace(t, F.concat(F.lit("__MED_"), x.i.cast("string"), F.lit("__")), x.t))


def chunks(c: Column, size: int = 512, overlap: int = 128) -> Column:
    """Fixed-stride windows of a text, the last one as it falls; empty text has none."""
    stride = size - overlap
    n = F.char_length(c)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(stride))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(c, s + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, cut).otherwise(F.slice(cut, 1, 0))


def sections(c: Column, least: int = 20) -> Column:
    """Blank-line separated parts longer than least characters."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), F.trim), lambda s: F.char_length(s) > least)


def list_items(c: Column) -> Column:
    """array<struct<kind,text,prefix>> of the non-blank lines."""
    bullet, number, letter = r"^[•\-*○▪▸►]\s+(.+)", r"^(\d+)[.)]\s+(.+)", "^([A-Za-zء-ي])[.)]\\s+(.+)"
    lines = F.filter(F.transform(F.split(c, "\n"), F.trim), lambda x: x != "")

    def kind(x: Column) -> Column:
        item = lambda text, prefix: F.struct(F.lit("list_item").alias("kind"), text.alias("text"), prefix.alias("prefix"))
        return (
            F.when(x.rlike(bullet), item(F.regexp_extract(x, bullet, 1), F.substring(x, 1, 1)))
            .when(x.rlike(number), item(F.regexp_extract(x, number, 2), F.regexp_extract(x, number, 1)))
            .when(x.rlike(letter), item(F.regexp_extract(x, letter, 2), F.regexp_extract(x, letter, 1)))
            .otherwise(F.struct(F.lit("paragraph").alias("kind"), x.alias("text"), F.lit("").alias("prefix")))
        )

    return F.transform(lines, kind)


#: Variable parts of conversation texts and what stands for them, in order.
FINGERPRINT_STEPS = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<ts>"), (r"\d{4}-\d{2}-\d{2}", "<date>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"), (r"(/[A-Za-z0-9_.-]+){2,}", "<cwd>"), (r"\b[0-9a-f]{7,40}\b", "<gitsha>"),
]


def fingerprint_text(c: Column) -> Column:
    return collapse(replaced(c, FINGERPRINT_STEPS))


def snippet(c: Column, term: str, around: int = 100, fallback: int = 200) -> Column:
    """The surroundings of the first case-insensitive hit with ellipses, else the text's beginning."""
    at = F.instr(F.lower(c), term.lower())
    start = F.greatest(at - around, F.lit(1))
    end = at + len(term) + around
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(c, start, end - start), F.when(end <= F.char_length(c), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(c, F.lit(1), F.lit(fallback)))


def without_references(c: Column) -> Column:
    """struct<text,refs>: bracketed or hashed reference numbers taken out."""
    p = r"\[\d+\]|#\d+|\(\d{1,3}\)"
    return F.struct(collapse(F.regexp_replace(c, p, " ")).alias("text"), F.regexp_extract_all(c, F.lit(p), F.lit(0)).alias("refs"))


def grammar(c: Column) -> Column:
    """struct<missing_space,repeated,space_before,corrected> of basic punctuation checks."""
    fixed = replaced(c, [(r"(.)\1{2,}", "$1$1"), (r"\s+([.,;:!?])", "$1"), (r"\(\s+", "("), (r"\s+\)", ")"), (r"([,;:!?])([A-Za-z])", "$1 $2")])
    return F.struct(
        F.regexp_count(c, F.lit(r"[,;:!?][A-Za-z]")).alias("missing_space"), F.regexp_count(c, F.lit(r"(.)\1{2,}")).alias("repeated"),
        F.regexp_count(c, F.lit(r"\s[.,;:!?]")).alias("space_before"), fixed.alias("corrected"),
    )


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral, null if it is none."""
    values = F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv])
    digits = F.transform(F.split(F.upper(c), ""), lambda ch: values[ch])
    sum_ = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("s"), F.lit(0).alias("top")), lambda a, v: F.struct(F.when(v < a.top, a.s - v).otherwise(a.s + v).alias("s"), F.greatest(a.top, v).alias("top")), lambda a: a.s)
    return F.when(F.upper(c).rlike("^(?=.)M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), sum_)


def safe_filename(c: Column) -> Column:
    """Last path part, reserved characters to underscores, no leading dots, 255 characters at most."""
    name = F.regexp_replace(F.element_at(F.split(c, r"[/\\]"), -1), r'[<>:"|?*\x00-\x1f]', "_")
    return F.substring(F.regexp_replace(name, r"^\.+", ""), 1, 255)
