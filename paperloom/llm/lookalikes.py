"""One consistent form for text that looks the same.

Only texts that hold a character which may have to change are taken apart, into words and then into the distinct words
with their setting (script of the text, company of other words of their script). The distinct words alone are exploded
into positioned code points, which a broadcast join sends through the decomposition table (its size is bounded by the
Unicode blocks it is built from). Combining marks are ordered by class behind their base, letters of a foreign script
are drawn to the script of their word or, for a whole word, of its text, the rest is recomposed and the words are
rebuilt and put back.

Rules: full-width forms become plain (punctuation stays full-width in Han text), separate combining accents are
composed, invisible characters go, every other space becomes a plain one; a word of two scripts takes the one all
of its letters can be drawn to (of the text if both, else of most letters); a whole word of look-alikes takes the script of its text unless a word
beside it is certainly of its own script; letters in codes (capitals next to digits) are Latin.

Defined results: null text stays null and empty text empty; repeated rows give repeated rows; columns other than those
named are kept as they are by ``normalized`` and ignored by ``changed_rows``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: Characters that may have to change.
SUSPECT = r"[\u00A0\u00AD\u0300-\u036F\u0370-\u052F\u061C\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u206F\u3000\uFE00-\uFE0F\uFEFF\uFF01-\uFFEE]"
#: Characters without a glyph.
INVISIBLE = r"[\u00AD\u061C\u180E\u200B-\u200F\u202A-\u202E\u2060-\u206F\uFE00-\uFE0F\uFEFF]"
#: Look-alike letters, from the public Unicode confusables (fixed values): Cyrillic to Latin and Greek to Latin.
CYRILLIC = dict(zip("АВЕКМНОРСТХУЅІЈаеорсухѕіјһԁԛԝ", "ABEKMHOPCTXYSIJaeopcyxsijhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"))
#: Letters that pass as Latin only inside a word of other Latin letters (fixed values).
INSIDE = dict(zip("кαινρυ", "kaivpu"))
_LETTERS = {"L": r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u1E00-\u1EFF\uFF21-\uFF3A\uFF41-\uFF5A", "C": r"\u0400-\u052F", "G": r"\u0370-\u03FF\u1F00-\u1FFF", "H": r"\u3400-\u4DBF\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF"}
#: Cyrillic letters no Latin letter looks like.
_SURELY_CYRILLIC = r"[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийлмнптфцчшщъыьэюя]"
_SPLIT = r"(?<=[ \n\t\f\r])|(?=[ \n\t\f\r])"


def _script(ch: str) -> str:
    o = ord(ch)
    if ch.isascii():
        return "L" if ch.isalpha() else ""
    if 0x400 <= o <= 0x52F:
        return "C"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "G" if unicodedata.category(ch)[0] == "L" else ""
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        return "L" if unicodedata.category(ch)[0] == "L" else ""
    return ""


def code_point_table(spark: SparkSession) -> DataFrame:
    """(ch, i, out, ccc, script): what each code point of the covered blocks decomposes into, built from the Unicode database."""
    rows = []
    blocks = [(0x20, 0x530), (0x600, 0x620), (0x1680, 0x1681), (0x180E, 0x180F), (0x1E00, 0x2070), (0x3000, 0x3001), (0xFE00, 0xFE10), (0xFEFF, 0xFF00), (0xFF01, 0xFFEF)]
    for lo, hi in blocks:
        for o in range(lo, hi):
            ch = chr(o)
            cat = unicodedata.category(ch)
            if cat == "Cn":
                continue
            if cat == "Cf" or 0xFE00 <= o < 0xFE10:
                rows.append((ch, 0, "", 0, ""))
            elif cat == "Zs":
                rows.append((ch, 0, " ", 0, ""))
            else:
                text = unicodedata.normalize("NFKC", ch) if o >= 0xFF01 else ch
                for i, x in enumerate(unicodedata.normalize("NFD", text)):
                    rows.append((ch, i, x, unicodedata.combining(x), _script(x)))
    return spark.createDataFrame(rows, "ch string, i int, out string, ccc int, s string")


def composition_map() -> Column:
    """base and mark → composed letter, for the covered blocks, as one constant map."""
    pairs = {}
    for lo, hi in ((0xC0, 0x530), (0x1E00, 0x2000)):
        for o in range(lo, hi):
            d = unicodedata.normalize("NFD", chr(o))
            if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(o):
                pairs[unicodedata.normalize("NFC", d[:-1]) + d[-1]] = chr(o)
    keys = sorted(pairs)
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.lit(pairs[k]) for k in keys]))


def _map(values: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def text_script(text: Column) -> Column:
    """The script of most letters of a text: L, C, G or H."""
    n = {k: F.length(F.regexp_replace(text, f"[^{v}]", "")) for k, v in _LETTERS.items()}
    most = F.greatest(*n.values())
    return F.when(n["L"] == most, "L").when(n["H"] * 2 >= most, "H").when(n["C"] == most, "C").otherwise("G")


def exploded_words(df: DataFrame, keys: list[str], text: str, script: Column | None = None) -> DataFrame:
    """Words of the texts that may have to change: keys, pos, word, script, company. Narrow.

    These are words with a suspect character, and in Cyrillic text words of Latin letters that all look Cyrillic.
    """
    own = df.filter(F.col(text).rlike(SUSPECT)).select(*keys, F.col(text).alias("_t"))
    own = own.select(*keys, F.split("_t", _SPLIT).alias("_w"), (script if script is not None else text_script(F.col("_t"))).alias("script"))
    alike = rf"^\P{{L}}*[{''.join(sorted(set(CYRILLIC.values())))}]+\P{{L}}*$"
    suspect = lambda w: w.rlike(SUSPECT) | ((F.col("script") == "C") & w.rlike(alike))
    words = F.transform(
        "_w",
        lambda w, i: F.struct(
            i.alias("pos"),
            w.alias("word"),
            (suspect(w) & (F.coalesce(F.try_element_at("_w", i - 1 + F.when(i > 1, 0)), F.lit("")).rlike(_SURELY_CYRILLIC) | F.coalesce(F.try_element_at("_w", i + 3), F.lit("")).rlike(_SURELY_CYRILLIC))).alias("company"),
        ),
    )
    words = F.filter(words, lambda x: suspect(x["word"]))
    return own.select(*keys, "script", F.explode(words).alias("x")).select(*keys, "script", "x.pos", "x.word", "x.company")


def rebuilt(df: DataFrame, keys: list[str], text: str, words: DataFrame, canon: DataFrame) -> DataFrame:
    """``df`` with the canonical words at their places; only changed words are shuffled beside the texts they go back into."""
    new = canon.filter("canon <> word").select("word", "script", "company", "canon")
    own = words.join(new, ["word", "script", "company"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "canon"))).alias("_m"))
    parts = F.transform(F.split(text, _SPLIT), lambda w, i: F.coalesce(F.try_element_at("_m", i), w))
    return df.join(own, keys, "left").withColumn(text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(F.array_join(parts, ""))).drop("_m")


def canonical_words(words: DataFrame) -> DataFrame:
    """(word, script, company, canon) of the distinct words; only they are exploded into code points."""
    key = ["word", "script", "company"]
    points = words.select(*key).distinct().select(*key, F.posexplode(F.split("word", "")).alias("pos", "ch"))
    table = F.broadcast(code_point_table(words.sparkSession))
    rows = points.join(table, "ch", "left").select(
        *key, F.struct("pos", F.coalesce("i", F.lit(0)).alias("i")).alias("at"),
        F.when((F.col("script") == "H") & F.col("ch").rlike(r"[\uFF01-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65]"), F.col("ch")).otherwise(F.coalesce("out", "ch")).alias("out"),
        F.coalesce("ccc", F.lit(0)).alias("ccc"),
        F.coalesce("s", F.lit("")).alias("s"),
    ).filter("out <> ''")
    order = Window.partitionBy(*key).orderBy("at")
    whole = Window.partitionBy(*key)
    rows = rows.select(
        *key, "at", "out", "ccc", "s",
        F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(order).alias("starter"),
        F.sum(F.when((F.col("s") == "") & (F.col("ccc") == 0), 1).otherwise(0)).over(order).alias("run"),
        F.max(F.col("out").rlike(r"\d")).over(whole).alias("digits"),
    )
    one = Window.partitionBy(*key, "run")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(one)
    base = F.col("ccc") == 0
    to_latin = {**CYRILLIC, **GREEK}
    to_cyrillic = {v: k for k, v in CYRILLIC.items()}
    out = F.col("out")
    rows = rows.select(
        *key, "at", "out", "ccc", "s", "starter",
        *[count(F.col("s") == x).alias(f"n{x}") for x in "LCG"],
        count(out.isin(list(to_latin))).alias("like_l"),
        count(out.isin(list(to_cyrillic))).alias("like_c"),
        (F.col("digits") & (count((F.col("s") != "") & ~out.rlike(r"\p{Lu}")) == 0)).alias("code"),
        count(base & (F.col("s") != "")).alias("n"),
        count(F.lit(True) & (F.col("s") != "") & out.rlike(r"\p{Lu}")).alias("upper"),
    )
    most = F.greatest("nL", "nC", "nG")
    lead = F.when((F.col("nL") == most) & (F.col("script") != "C"), "L").when((F.col("nC") == most) & (F.col("script") != "G"), "C").when(F.col("nL") == most, "L").when(F.col("nC") == most, "C").otherwise("G")
    single = most == F.col("n")
    can_l = (F.col("nL") > 0) & (F.col("nL") + F.col("like_l") == F.col("n"))
    can_c = (F.col("nC") > 0) & (F.col("nG") == 0) & (F.col("like_c") == F.col("nL"))
    target = (
        F.when(F.col("code") & (F.col("like_l") + F.col("nL") == F.col("n")), "L")
        .when(~single & can_l & ~can_c, "L").when(~single & can_c & ~can_l, "C")
        .when(~single & can_l & can_c & F.col("script").isin("L", "C"), F.col("script"))
        .when(~single, lead)
        .when((F.col("script") == "L") & (F.col("like_l") == F.col("n")) & ~F.col("company"), "L")
        .when((F.col("script") == "C") & (F.col("nL") == F.col("n")) & (F.col("like_c") == F.col("n")) & ((F.col("upper") == 0) | (F.col("n") == 1)) & ~F.col("word").rlike(r"[.]") & F.col("company"), "C")
    )
    rows = rows.withColumn("target", target)
    drawn = (
        F.when((F.col("target") == "L") & F.col("s").isin("C", "G"), F.coalesce(F.try_element_at(_map(to_latin), out), F.when(~single, F.try_element_at(_map(INSIDE), out)), out))
        .when((F.col("target") == "C") & (F.col("s") == "L"), F.coalesce(F.try_element_at(_map(to_cyrillic), out), out))
        .otherwise(out)
    )
    chars = F.array_sort(F.collect_list(F.struct("starter", F.col("ccc").alias("ccc"), F.col("at"), drawn.alias("ch"))))
    compose = composition_map()
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))

    def step(acc, x):
        joined = F.when(x["ccc"] > 0, F.try_element_at(compose, F.concat(acc["last"], x["ch"])))
        return F.struct(F.when(joined.isNull(), F.concat(acc["done"], acc["last"])).otherwise(acc["done"]).alias("done"), F.coalesce(joined, x["ch"]).alias("last"))

    return (
        rows.groupBy(*key).agg(chars.alias("chars"))
        .select(*key, F.aggregate("chars", start, step, lambda a: F.concat(a["done"], a["last"])).alias("canon"))
        .unionByName(
            words.filter(F.col("word").rlike(SUSPECT) & (F.length(F.regexp_replace("word", INVISIBLE, "")) == 0)).select(*key).distinct().withColumn("canon", F.lit(""))
        )
    )


def normalized(df: DataFrame, key: str, text: str, script: Column | None = None) -> DataFrame:
    """``df`` with its text in the one form. ``key`` is unique. Texts without suspect characters are passed through untouched."""
    words = cut(exploded_words(df, [key], text, script))
    return rebuilt(df, [key], text, words, canonical_words(words))


def changed_rows(df: DataFrame, keys: list[str], text: str, script: Column | None = None) -> DataFrame:
    """Distinct keys of the rows whose text has a character that must change."""
    words = cut(exploded_words(df, keys, text, script))  # few beside the text, and read three times
    canon = canonical_words(words).filter("canon <> word").select("word", "script", "company")
    return words.join(canon, ["word", "script", "company"], "left_semi").select(*keys).distinct()
