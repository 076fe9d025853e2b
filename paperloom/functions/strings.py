"""String functions of the document model as column expressions.

Defined results: null in, null out, unless the docstring says otherwise. Unicode normal forms and case folding have no
built-in expression and run as Arrow batches; everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# What must equal the document model's own tables for right results.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "Ĳ": "IJ"}
PUNCTUATION = {"，": ",", "．": ".", "。": ".", "：": ":", "；": ";", "（": "(", "）": ")", "－": "-", "／": "/", "％": "%"}
QUOTES_AND_DASHES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", "­": ""}
HEDGES = ["may", "might", "could", "possibly", "suggests", "suggested", "suggesting", "indicates", "indicated", "appears", "seem", "seems", "likely", "unclear"]
VARIANTS = ["V0", "V1", "V2", "V3", "V4", "V5", "V6"]
PII_SHAPES = [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{2}-\d{7}\b", r"\b\d{9}\b"]
PII_MASK = "[TAX-ID-MASKED]"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc_in_place(c: Column) -> Column:
    """Compatibility composition by the ICU library that Spark brings along. A Python function would end the partitioning of its rows, so that all later joins move them again."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full case folding (ß and ss fall together)."""
    return s.map(lambda x: None if x is None else x.casefold())


def _replaced(c: Column, values: dict[str, str]) -> Column:
    for a, b in values.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def collapsed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def comparable(c: Column, fold: Callable[[Column], Column] = nfkc) -> Column:
    """Form for character-level comparison: compatibility forms and full-width punctuation folded, no white space; '' for null."""
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), _replaced(fold(c), PUNCTUATION)).otherwise(c)
    return F.coalesce(F.regexp_replace(folded, r"(?U)\s", ""), F.lit(""))


def grounding_form(c: Column) -> Column:
    """Form for quote matching: composed, ligatures apart, plain quotes and dashes, broken words joined, white space collapsed."""
    composed = F.when(c.rlike(r"[^\x00-\x7F]"), nfc(c)).otherwise(c)
    return collapsed(F.replace(_replaced(_replaced(composed, LIGATURES), QUOTES_AND_DASHES), F.lit("-\n"), F.lit("")))


def ladder(c: Column) -> Column:
    """Array of the seven ever looser variants of a text, V0 to V6."""
    v1 = F.when(c.rlike(r"[^\x00-\x7F]"), nfc(c)).otherwise(c)
    v2 = _replaced(v1, LIGATURES)
    v3 = collapsed(v2)
    v4 = _replaced(v3, QUOTES_AND_DASHES)
    v5 = F.regexp_replace(v4, r"(?<=[a-z])- (?=[a-z])", "")
    return F.array(c, v1, v2, v3, v4, v5, F.replace(v5, F.lit("-"), F.lit("")))


def hedges(c: Column, words: list[str] | None = None) -> Column:
    """Sorted array of the hedge words of the closed list that stand in a text as whole words, whatever their case."""
    return F.array_compact(F.array(*[F.when(c.rlike(rf"(?i)\b{h}\b"), F.lit(h)) for h in sorted(words or HEDGES)]))


def respaced(c: Column) -> Column:
    """Recognised text with blanks put back between words and between letters and digits, lines folded."""
    out = F.regexp_replace(c, r"\s*\n\s*", " ")
    out = F.regexp_replace(out, r"([a-z])([A-Z])", "$1 $2")
    out = F.regexp_replace(F.regexp_replace(out, r"([A-Za-z])(\d)", "$1 $2"), r"(\d)([A-Za-z])", "$1 $2")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def table_summary(html: Column, n: int = 220) -> Column:
    """The first characters of a table's text without its tags."""
    return F.left(collapsed(F.regexp_replace(html, r"<[^>]+>", " ")), F.lit(n))


@F.pandas_udf(StringType())
def cid_decoded(s: pd.Series) -> pd.Series:
    """Runs of ``(cid:N)`` as the text their bytes spell; what spells nothing is left out."""
    import re

    run, token = re.compile(r"(?:\(cid:\d+\))+"), re.compile(r"\(cid:(\d+)\)")

    def spelled(m: re.Match) -> str:
        codes = [int(x) for x in token.findall(m[0])]
        if max(codes) <= 255:
            try:
                return bytes(codes).decode("utf-8")
            except UnicodeDecodeError:
                pass
        return chr(codes[0]) if len(codes) == 1 and codes[0] < 0x110000 else ""

    return s.map(lambda x: x if x is None or "(cid:" not in x else run.sub(spelled, x))


def paragraph_form(c: Column) -> Column:
    """Lines collapsed one by one, paragraphs kept apart by one empty line; '' for null."""
    plain = F.regexp_replace(F.coalesce(cid_decoded(c), F.lit("")), r"\r\n?", "\n")
    lines = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), collapsed), lambda x: x != ""), "\n")
    return F.array_join(F.filter(F.transform(F.split(plain, r"\n\s*\n"), lines), lambda x: x != ""), "\n\n")


def ground_truth_form(c: Column) -> Column:
    """Form for comparison with ground truth: no currency signs, blanks collapsed, case folded; '' for null."""
    plain = collapsed(F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "[$€£¥₹]", ""))
    return F.coalesce(F.when(plain.rlike(r"[^\x00-\x7F]"), casefold(plain)).otherwise(F.lower(plain)), F.lit(""))


def harness_tokens(c: Column) -> Column:
    """Distinct-able tokens of a text: lower case, split where no letter, digit or underscore stands."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+"), lambda x: x != "")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters of two texts, 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b)])


def pii_count(c: Column) -> Column:
    """How many tax and identity numbers of the three shapes a text holds; each shape is counted in what the ones before leave."""
    total, left = F.lit(0), F.coalesce(c, F.lit(""))
    for shape in PII_SHAPES:
        total = total + F.regexp_count(left, F.lit(shape))
        left = F.regexp_replace(left, shape, PII_MASK.replace("$", r"\$"))
    return total


def pii_masked(c: Column) -> Column:
    """A text with those numbers masked, shape after shape."""
    for shape in PII_SHAPES:
        c = F.regexp_replace(c, shape, PII_MASK)
    return c


def spreadsheet_safe(c: Column) -> Column:
    """A cell value a spreadsheet does not take for a formula: a quote before =, +, @, tab, return, and before - unless it is a number; '' for null."""
    first = F.left(c, F.lit(1))
    number = F.replace(F.trim(c), F.lit(","), F.lit("")).rlike(r"(?i)^-(\d[\d_]*\.?[\d_]*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$")
    return F.coalesce(F.when(first.isin("=", "+", "@", "\t", "\r") | ((first == "-") & ~number), F.concat(F.lit("'"), c)).otherwise(c), F.lit(""))


def csv_quoted(c: Column) -> Column:
    """A field as CSV writes it: quoted where it holds a comma, quote or line break; '' for null."""
    return F.coalesce(F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))


def percent(confidence: Column, score: Column | None = None) -> Column:
    """Confidence as a whole percentage: ratios up to 1 times 100, larger ones as they are; ``score`` where it is missing; 0 for neither."""
    raw = F.coalesce(confidence, score) if score is not None else confidence
    return F.coalesce(F.when((raw >= 0) & (raw <= 1), F.bround(raw * 100)).otherwise(F.bround(raw)).cast("int"), F.lit(0))


def table_title(index: Column, page: Column, pct: Column, caption: Column) -> Column:
    """Title of an exported table with its caption, cut to 160 characters."""
    base = F.format_string("Table %d (Page %s) confidence=%d%%", index, F.coalesce(page.cast("string"), F.lit("?")), pct)
    text = F.trim(F.coalesce(caption, F.lit("")))
    return F.when(text == "", base).otherwise(F.concat(base, F.lit(" — "), F.when(F.length(text) > 160, F.concat(F.left(text, F.lit(157)), F.lit("..."))).otherwise(text)))


def table_banner(index: Column, page: Column, pct: Column) -> Column:
    """Line above an exported table."""
    return F.format_string("=== Table %d (Page %s) confidence=%d%% ===", index, F.coalesce(page.cast("string"), F.lit("?")), pct)


def html_escaped(c: Column) -> Column:
    """A text safe inside HTML; '' for null."""
    return F.coalesce(_replaced(c, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}), F.lit(""))


def cell_cut(c: Column, most: int = 500, least: int = 400) -> Column:
    """A cell text of at most ``most`` characters, cut behind the last sentence or before the last blank after ``least``."""
    head = F.left(c, F.lit(most))
    back = F.reverse(head)
    dot, blank = F.lit(most) - F.instr(back, ".") + 1, F.lit(most) - F.instr(back, " ") + 1
    at = F.when((F.instr(back, ".") > 0) & (dot > least), dot).when((F.instr(back, " ") > 0) & (blank > least), blank - 1)
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.substring(head, F.lit(1), at), head))


def sheet_name(c: Column) -> Column:
    """A worksheet name: no characters sheets refuse, at most 31, never empty."""
    out = F.left(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\]:*?/\\]", "_")), F.lit(31))
    return F.when(out == "", "Sheet").otherwise(out)


def file_stem(c: Column, empty: str = "file") -> Column:
    """A name safe as a file name: letters, digits, dot, dash and underscore, no leading dots."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(out == "", empty).otherwise(out)


def label_shown(c: Column, names: dict[str, str] | None = None) -> Column:
    """A layout label as people read it: from ``names``, else its words with capitals."""
    table = F.create_map(*[F.lit(x) for pair in (names or {"doc_title": "Title"}).items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" "))))


def error_cut(c: Column, n: int = 400) -> Column:
    """An error message of at most ``n`` characters."""
    return F.left(c, F.lit(n))


def sha12(c: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256 of a text."""
    return F.left(F.sha2(c, 256), F.lit(12))


def hmac_sha256(key: str, c: Column) -> Column:
    """HMAC-SHA256 of a text under a key, in hexadecimal digits."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in raw), bytes(x ^ 0x5C for x in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def doi(c: Column) -> Column:
    """The first digital object identifier in a text, without punctuation behind it; '' if there is none."""
    return F.regexp_replace(F.regexp_extract(c, r"10\.\d{4,9}/[^\s\"'<>]+", 0), r"[.,;:)\]]+$", "")


def is_collapsed(c: Column) -> Column:
    """Whether a text lost its blanks: 40 characters or more with at most one blank, or 25 letters or more in a row."""
    return ((F.length(c) >= 40) & (F.regexp_count(c, F.lit(r"\s")) <= 1)) | c.rlike("[A-Za-z]{25,}")
