"""Address records of one location: parse, expand, canonicalise, join on hierarchical keys.

Each record's joined text is parsed into house number, unit, street words, street type, city and postal code, whatever
the order and separators. Abbreviations are expanded by locale dictionaries. Misspelt street and city words are drawn
to the corpus word they come from: symmetric deletes generate the candidates in one join, and a word counts as a
misspelling only of a word one edit away that is far more frequent among distinct written forms, or whose forms agree
with its own in all other components. Records with equal canonical components are one class;
classes are joined on (house, unit, type, street) and then decided by explicit rules for missing components:

- both cities known: they must be equal, or the postal codes must be equal where one city is a misspelling of the other;
- one city missing: the postal codes must be equal, or its postal code is one whose records nearly all name the other's city;
- the place (city and postal code) missing on one side: they are one location only if all classes with the same house,
  unit, type and street that do name a place name the same one.

Defined results: records without any text are in no pair; records without a house number or street pair only with
records equal in every component; repeated rows pair like others; empty tables give no pairs; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Street types and their abbreviations (fixed values of the locale dictionary).
STREET_TYPES = {
    "street": "street", "str": "street", "st": "street", "avenue": "avenue", "ave": "avenue", "av": "avenue",
    "road": "road", "rd": "road", "boulevard": "boulevard", "blvd": "boulevard", "lane": "lane", "ln": "lane",
    "court": "court", "ct": "court", "drive": "drive", "dr": "drive", "square": "square", "sq": "square",
    "place": "place", "pl": "place", "terrace": "terrace", "ter": "terrace", "way": "way", "crescent": "crescent",
    "cres": "crescent", "parkway": "parkway", "pkwy": "parkway", "highway": "highway", "hwy": "highway",
    "close": "close", "cl": "close", "weg": "weg", "strasse": "strasse", "straße": "strasse", "allee": "allee",
}
#: Abbreviated words inside street names (fixed values of the locale dictionary).
STREET_WORDS = {"grn": "green", "hl": "hill", "pk": "park", "grv": "grove", "gdn": "garden", "gdns": "gardens", "mt": "mount", "ft": "fort", "n": "north", "s": "south", "e": "east", "w": "west"}
#: Street types that stand before the name, by language (fixed values of the locale dictionary): French, Spanish, Italian, Portuguese.
LEADING_TYPES = {"rue": "rue", "chemin": "chemin", "impasse": "impasse", "quai": "quai", "allée": "allee", "calle": "calle", "paseo": "paseo", "avenida": "avenida", "via": "via", "viale": "viale", "piazza": "piazza", "rua": "rua", "travessa": "travessa"}
#: Street types that end a name written as one word (fixed values of the locale dictionary): German, Dutch, Scandinavian.
ENDING_TYPES = {"strasse": "strasse", "straße": "strasse", "str": "strasse", "weg": "weg", "allee": "allee", "platz": "platz", "gasse": "gasse", "straat": "straat", "laan": "laan", "gatan": "gatan", "vägen": "vaegen"}
#: A value of the state column is the name of a state if it is at most so often a city, as a share.
STATE_SHARE = 0.1

_POSTAL = re.compile(r"(?<![\w-])(?:[A-Za-z]-)?(\d{5})(?:-\d{4})?(?![\w-])|(?<!\w)([A-Za-z]{1,2}\d{1,2})\s?(\d[A-Za-z]{2})(?!\w)")
_CARE = re.compile(r"(?:c/o|care of|attn\.?:?|z\.?\s?hd\.?)\s+[^,\n]*[,\n]", re.I)
_UNIT = re.compile(r"(?:(?<!\w)(?:flat|unit|apartment|apt|suite|ste|room|rm|floor|fl)\.?\s*(?:no\.?\s*)?#?\s*|#\s*)(\d+[a-z]?|[a-z])(?!\w)", re.I)
_NUMBER_MARK = re.compile(r"(?<!\w)(?:no|nr|num)\.?\s*(?=\d)", re.I)
_BOX = re.compile(r"(?:p\.?\s?o\.?\s*box|postfach|box)\s*#?\s*(\d+)", re.I)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[,\n;]")
_HOUSE = re.compile(r"\d{1,4}[a-z]?$")
COMPONENTS = "house string, unit string, kind string, street array<string>, city array<string>, postal string"


def _near_type(word: str) -> str | None:
    """The street type a longer word is one edit from."""
    if len(word) < 4:
        return None
    for full in set(STREET_TYPES.values()):
        if len(full) >= 4 and abs(len(full) - len(word)) <= 1 and word != full and _one_edit(word, full):
            return full
    return None


def _one_edit(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) == len(b):
        diff = [i for i in range(len(a)) if a[i] != b[i]]
        return len(diff) == 1 or len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _ending(word: str) -> str | None:
    """The type that ends a street name written as one word."""
    return next((e for e in sorted(ENDING_TYPES, key=len, reverse=True) if word.endswith(e) and len(word) >= len(e) + (3 if len(e) > 3 else 4)), None)


def parse_address(text: str | None, states: frozenset[str] = frozenset()) -> dict | None:
    """Components of one written address; None where there is no text. ``states`` are names of states among its words and parts."""
    if text is None or not text.strip():
        return None
    out = {"house": None, "unit": None, "kind": None, "street": [], "city": [], "postal": None}
    s = _CARE.sub(" ", text)
    box = _BOX.search(s)
    if box:
        out["house"], out["kind"] = f"box{box[1]}", "box"
        s = s[: box.start()] + "," + s[box.end() :]
    unit = _UNIT.search(s)
    if unit:
        out["unit"] = unit[1].lower()
        s = s[: unit.start()] + "," + s[unit.end() :]
    postal = None
    for postal in _POSTAL.finditer(s):
        pass
    if postal:
        out["postal"] = (postal[1] or postal[2] + postal[3]).lower()
        s = s[: postal.start()] + "," + s[postal.end() :]
    s = _NUMBER_MARK.sub("", s)
    tokens = [t.lower() for t in _TOKEN.findall(s)]
    segments: list[list[str]] = [[]]
    for t in tokens:
        if t in ",\n;":
            segments.append([])
        else:
            segments[-1].append(t)
    segments = [x for x in segments if x]
    at = next((i for i, x in enumerate(segments) if any(map(_HOUSE.match, x))), None)
    rest: list[list[str]] = []
    if at is not None and out["kind"] is None:
        seg = segments[at]
        if len(seg) == 1 and at + 1 < len(segments):  # the number stands alone before or after its street
            seg = seg + segments.pop(at + 1)
        n = next(i for i, t in enumerate(seg) if _HOUSE.match(t))
        out["house"] = seg[n]
        typed = [i for i, t in enumerate(seg) if t in STREET_TYPES and i != n]
        if not typed and n == len(seg) - 1 and at + 1 < len(segments) and any(t in STREET_TYPES or _near_type(t) for t in segments[at + 1]):
            rest.append(seg[:n])  # a place before the number, the street behind the next separator
            seg, n = [seg[n], *segments.pop(at + 1)], 0
            typed = [i for i, t in enumerate(seg) if t in STREET_TYPES]
        if not typed:
            typed = [i for i, t in enumerate(seg) if _near_type(t)]
        leading = next((i for i, t in enumerate(seg) if t in LEADING_TYPES and i != n and i + 1 < len(seg)), None)
        ending = None if typed or leading is not None else next((i for i, t in enumerate(seg) if i != n and _ending(t)), None)
        after = [i for i in typed if i > n + 1]
        before = [i for i in typed if 0 < i < n]
        if leading is not None and not typed:
            k = None
            own = seg[leading + 1 :] if n < leading else seg[leading + 1 : n]
            out["street"], left = own, [] if n < leading else seg[:leading] + seg[n + 1 :]
            out["kind"] = LEADING_TYPES[seg[leading]]
        elif ending is not None and abs(ending - n) == 1:
            k = None
            tail = _ending(seg[ending])
            out["street"], left = [seg[ending][: -len(tail)]], [t for x, t in enumerate(seg) if x not in (n, ending)]
            out["kind"] = ENDING_TYPES[tail]
        elif before and before[-1] == n - 1:
            k = before[-1]
            start = 0
            if at == 0 and len(segments) == 1 and k > 2:
                start = k - 2 if seg[k - 1] in ("green", "grove", "hill", "park", "grv", "hl", "pk") else k - 1
            out["street"], left = seg[start:k], seg[:start] + seg[n + 1 :]
        elif after:
            k = after[0]
            out["street"], left = seg[n + 1 : k], seg[:n] + seg[k + 1 :]
        elif n == 0:
            k = None
            out["street"], left = seg[1:], []
        else:
            k = None
            out["street"], left = seg[:n], seg[n + 1 :]
        if k is not None:
            out["kind"] = STREET_TYPES.get(seg[k]) or _near_type(seg[k])
        rest += segments[:at] + [left] + segments[at + 1 :]
    else:
        rest = segments
    parts = [x for x in rest if x]
    named = [x for x in parts if " ".join(x) not in states]
    words = [t for x in named or parts for t in x if not t.isdigit() and len(t) > 2 and t not in states]
    out["city"] = words
    out["street"] = [STREET_WORDS.get(t, t) for t in out["street"]]
    return out


def parsed_addresses(df: DataFrame, key: str = "address_id", parts: tuple[str, ...] = ("content", "street_address", "city", "state", "postal_code")) -> DataFrame:
    """Records with their components. The first part is the joined form; the others stand in where it is missing."""
    joined = F.coalesce(*[F.when(F.trim(F.col(parts[0])) != "", F.col(parts[0]))], F.concat_ws(", ", *[F.col(p) for p in parts[1:]]))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["house", "unit", "kind", "street", "city", "postal"]
        for pdf in batches:
            found = [(k, p) for k, t, s in zip(pdf["k"], pdf["t"], pdf["s"]) if (p := parse_address(t, frozenset(() if s is None else s))) is not None]
            yield pd.DataFrame([(k, *(p[n] for n in names)) for k, p in found], columns=["k", *names])

    kind = df.schema[key].dataType.simpleString()
    own = df.select(F.col(key).alias("k"), joined.alias("t")).filter(F.trim("t") != "")
    # names of states among the words and parts of each record, by a join with the values of the state column
    pieces = F.array_distinct(F.concat(F.split(F.lower("t"), r"[^\p{L}'’]+"), F.transform(F.split(F.lower("t"), "[,\n;]"), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}'’]+", " ")))))
    held = own.select("k", F.explode(pieces).alias("w")).filter("w <> ''").join(state_names(df), "w").groupBy("k").agg(F.collect_set("w").alias("s"))
    return own.join(held, "k", "left").mapInPandas(rows, f"k {kind}, {COMPONENTS}").withColumnRenamed("k", key)


def state_names(df: DataFrame, state: str = "state", city: str = "city") -> DataFrame:
    """(w): values of the state column that are seldom values of the city column; none where there are no such columns."""
    if not {state, city} <= set(df.columns):
        return df.sparkSession.createDataFrame([], "w string")
    form = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}'’]+", " "))
    n = df.select(F.explode(F.array(F.struct(form(state).alias("w"), F.lit(1).alias("s"), F.lit(0).alias("c")), F.struct(form(city).alias("w"), F.lit(0).alias("s"), F.lit(1).alias("c")))).alias("x")).select("x.*")
    return n.filter("w <> ''").groupBy("w").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).filter((F.col("s") > 0) & (F.col("c") <= STATE_SHARE * F.col("s"))).select("w")


#: A word is a misspelling of one at least so many times as frequent among the distinct written forms of addresses, or
#: of one near to it where this share of its own forms stands beside another form that is equal in all else.
RATIO, SUPPORT = 20, 0.25
#: Tails of compounds stand behind this share of the heads the most common one stands behind.
TAIL_SHARE = 0.3


def _deletes(word):
    """The word and all strings with one character left out."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), cut))


def _damerau_one(a, b):
    """Whether two different words are one insertion, deletion, replacement or swap of neighbours apart."""
    n = F.length(a)
    at = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: F.when((acc == 0) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), i).otherwise(acc))
    swapped = F.concat(F.substr(a, F.lit(1), at - 1), F.substr(a, at + 1, F.lit(1)), F.substr(a, at, F.lit(1)), F.substr(a, at + 2, n))
    return (F.levenshtein(a, b) == 1) | ((n == F.length(b)) & (at > 0) & (swapped == b))


def _near_words(words: DataFrame) -> DataFrame:
    """(field, word, right, n, sure): pairs of words one edit apart, the rarer one first, n the count of the other one."""
    variants = words.filter(F.length("word") >= 3).select("field", "word", "n", F.explode(_deletes(F.col("word"))).alias("v"))
    rarer = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.word") > F.col("b.word")))
    return (
        variants.alias("a")
        .join(variants.alias("b"), (F.col("a.field") == F.col("b.field")) & (F.col("a.v") == F.col("b.v")) & rarer)
        .select("a.field", "a.word", F.col("b.word").alias("right"), F.col("b.n").alias("n"), (F.col("b.n") >= RATIO * F.col("a.n")).alias("sure"))
        .distinct()
        .filter(_damerau_one(F.col("word"), F.col("right")))
    )


def _compounds(words: DataFrame, wrong: DataFrame) -> DataFrame:
    """(field, word) of compounds of a frequent word and a tail that many words share: words of their own, however rare."""
    splits = words.filter((F.length("word") >= 7) & (F.col("field") == "street")).select(
        "field", "word", F.explode(F.sequence(F.lit(3), F.length("word") - 4)).alias("i")
    )
    splits = splits.select("field", "word", F.expr("substr(word, 1, i)").alias("head"), F.expr("substr(word, i + 1)").alias("tail"))
    heads = words.filter("n > 1").join(wrong, ["field", "word"], "left_anti").select("field", F.col("word").alias("head"))
    known = splits.join(heads, ["field", "head"])
    tails = cut(known.groupBy("field", "tail").agg(F.countDistinct("head").alias("k")))
    least = TAIL_SHARE * (tails.agg(F.max("k")).first()[0] or 0)
    tails = tails.filter((F.col("k") >= least) & (F.col("k") > 1)).select("field", "tail")
    return known.join(tails, ["field", "tail"]).select("field", "word").distinct()


def _words_of(forms: DataFrame) -> DataFrame:
    """(form, field, pos, word) of the street and city words of forms."""
    return forms.select("form", F.explode(F.array(
        F.struct(F.lit("street").alias("field"), F.col("street").alias("words")), F.struct(F.lit("city").alias("field"), F.col("city").alias("words")),
    )).alias("p")).select("form", "p.field", F.posexplode("p.words").alias("pos", "word"))


def _corrected(forms: DataFrame, fixes: DataFrame) -> DataFrame:
    """Forms with their street and city words put right."""
    right = _words_of(forms).join(fixes, ["field", "word"], "left").select("form", "field", "pos", F.coalesce("right", "word").alias("w"))
    lines = right.groupBy("form").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "w")))), lambda x: x["w"]).alias(f) for f in ("street", "city")]
    )
    none = F.array().cast("array<string>")
    return forms.drop("street", "city").join(lines, "form", "left").withColumns({f: F.coalesce(f, none) for f in ("street", "city")})


def _supported(forms: DataFrame, near: DataFrame) -> DataFrame:
    """(field, word, right, k): forms that hold ``word`` and are equal in all else to a form with ``right`` or another word near it.

    All else is house, unit, type, the other words, and place or postal code as far as both are given.
    """
    targets = near.select("field", "word", "right").union(near.select("field", F.col("right").alias("word"), "right")).distinct()
    text = lambda f: F.array_join(f, " ")
    whole = forms.select(
        "form", F.col("street").alias("s"), F.col("city").alias("c"), text("city").alias("place"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("house", "unit", "kind", "postal")],
    ).filter("size(s) > 0 and (house <> '' or postal <> '')")
    each = _words_of(forms).join(whole, "form").join(targets, ["field", "word"])
    own = F.when(F.col("field") == "street", F.col("s")).otherwise(F.col("c"))
    rest = F.transform(own, lambda w, i: F.when(i == F.col("pos"), F.lit("*")).otherwise(w))
    each = cut(each.select(
        "form", "field", "word", "right", "house", "unit", "kind", "postal", "place", text(rest).alias("rest"),
        F.when(F.col("field") == "city", text("s")).otherwise("").alias("street"), F.when(F.col("house") == "", F.col("postal")).otherwise("").alias("code"),
    ))
    a, b = each.filter("word <> right").alias("a"), each.alias("b")
    equal = F.lit(True)
    for c in ("field", "right", "house", "unit", "kind", "rest", "street", "code"):
        equal = equal & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    place = F.expr(
        "(a.place <> '' and a.place = b.place)"
        " or (a.place <> '' and b.place <> '' and levenshtein(a.place, b.place) <= 2 and (a.postal = b.postal or a.postal = '' or b.postal = ''))"
        " or (a.postal <> '' and a.postal = b.postal and (a.place = '' or b.place = ''))"
        " or (a.place = '' and a.postal = '') or (b.place = '' and b.postal = '')"
    )
    met = a.join(b, equal & (F.col("a.word") != F.col("b.word")) & place)
    return met.groupBy("a.field", "a.word", "a.right").agg(F.countDistinct("a.form").alias("k"))


def spelling_corrections(forms: DataFrame) -> DataFrame:
    """(field, word, right) for words of distinct forms (form, house, unit, kind, street, city, postal) that are misspellings.

    Symmetric deletes turn the search for near words into one equi-join. A far more frequent near word is the right one;
    else it is where the forms of the rarer word stand beside equal ones of the other. Copies of a record and the size
    of the corpus change neither test.
    """
    words = cut(_words_of(forms).select("form", "field", "word").distinct().groupBy("field", "word").agg(F.count("*").alias("n")))
    near = cut(_near_words(words))
    wrong = near.filter("sure").select("field", "word").distinct()
    near = cut(near.join(_compounds(words, wrong), ["field", "word"], "left_anti"))
    best = F.max_by("right", F.struct("n", "right")).alias("right")
    sure = cut(near.filter("sure").groupBy("field", "word").agg(best))
    doubtful = near.join(sure.select("field", "word"), ["field", "word"], "left_anti").join(sure.select("field", F.col("word").alias("right")), ["field", "right"], "left_anti")
    doubtful = cut(doubtful.select("field", "word", "right", "n"))
    k = _supported(_corrected(forms, sure), doubtful)
    shown = doubtful.join(k, ["field", "word", "right"]).join(words.select("field", "word", F.col("n").alias("own")), ["field", "word"])
    fixes = cut(sure.unionByName(shown.filter(F.col("k") >= SUPPORT * F.col("own")).groupBy("field", "word").agg(best)))
    while True:  # the right word may be a misspelling itself; it is more frequent at each step, so this ends
        onward = fixes.select("field", F.col("word").alias("right"), F.col("right").alias("next"))
        if fixes.join(onward, ["field", "right"], "left_semi").isEmpty():
            return fixes
        fixes = cut(fixes.join(onward, ["field", "right"], "left").select("field", "word", F.coalesce("next", "right").alias("right")))


PARTS = ["house", "unit", "kind", "street", "city", "postal"]


def canonical_addresses(df: DataFrame, key: str = "address_id") -> DataFrame:
    """Records with canonical components: house, unit, kind, street, city, postal ('' where missing)."""
    parsed = cut(parsed_addresses(df, key).withColumn("form", F.sha2(F.to_json(F.struct(*PARTS)), 256)))
    forms = cut(parsed.select("form", *PARTS).dropDuplicates(["form"]))
    right = _corrected(forms, spelling_corrections(forms))
    blank = lambda c: F.coalesce(c, F.lit(""))
    right = right.select("form", *[blank(F.col(c)).alias(c) for c in ("house", "unit", "kind", "postal")], *[F.array_join(f, " ").alias(f) for f in ("street", "city")])
    return parsed.select(key, "form").join(right, "form").select(key, *PARTS)


#: Share of the records of a postal code that have to name one city for it to stand for that city.
CODE_SHARE = 0.8
STREET_KEY = ["house", "unit", "kind", "street"]


def address_classes(df: DataFrame, key: str = "address_id") -> DataFrame:
    """Every record with the class of its location: (key, location). Records without text are left out.

    Distinct component combinations are resolved once, however many records share them.
    """
    canon = cut(canonical_addresses(df, key))
    combos = canon.groupBy(*STREET_KEY, "city", "postal").agg(F.count("*").alias("n"))
    by_postal = (
        combos.filter("city <> '' and postal <> ''").groupBy(*STREET_KEY, "postal").agg(F.max_by("city", F.struct("n", "city")).alias("postal_city"))
    )
    # a postal code whose records nearly all name one city stands for that city where none is written
    codes = combos.filter("city <> '' and postal <> ''").groupBy("postal", "city").agg(F.sum("n").alias("n")).groupBy("postal").agg(F.sum("n").alias("all"), F.max_by("city", F.struct("n", "city")).alias("code_city"), F.max("n").alias("n"))
    codes = codes.filter(F.col("n") >= CODE_SHARE * F.col("all")).select("postal", "code_city")
    named = combos.join(by_postal, [*STREET_KEY, "postal"], "left").join(codes, "postal", "left")
    place = (
        F.when((F.col("city") == "") & F.coalesce("postal_city", "code_city").isNotNull(), F.coalesce("postal_city", "code_city"))
        .when((F.col("city") != "") & (F.levenshtein("city", "postal_city") <= 2), F.col("postal_city"))
        .when(F.col("city") != "", F.col("city"))
        .when(F.col("postal") != "", F.concat(F.lit("#"), F.col("postal")))
    )
    named = named.withColumn("place", place)
    lone = (
        named.filter("place is not null").groupBy(*STREET_KEY).agg(F.min("place").alias("lo"), F.max("place").alias("hi")).filter("lo = hi").select(*STREET_KEY, F.col("lo").alias("only"))
    )
    classed = named.join(lone, STREET_KEY, "left").select(
        *STREET_KEY, "city", "postal",
        F.sha2(F.to_json(F.struct(*STREET_KEY, F.coalesce("place", "only", F.lit("")).alias("place"))), 256).alias("location"),
    )
    return canon.join(classed, [*STREET_KEY, "city", "postal"]).select(key, "location")


def class_sizes(classes: DataFrame) -> DataFrame:
    """(location, n_records): counted in the tasks before the shuffle."""
    return classes.groupBy("location").agg(F.count("*").alias("n_records"))


#: Records of a location that meet in one task, at most about.
BLOCK = 2_000


def same_location_pairs(df: DataFrame, key: str = "address_id") -> DataFrame:
    """(a, b) with a < b for every pair of records of one location.

    A location of many records is cut into blocks; its blocks meet two by two, each two in a task of their own.
    """
    classes = cut(address_classes(df, key))
    blocks = class_sizes(classes).filter("n_records > 1").select("location", F.ceil(F.col("n_records") / BLOCK).cast("int").alias("blocks"))
    own = classes.join(blocks, "location").select(F.col(key).alias("k"), "location", "blocks", F.pmod(F.xxhash64(F.col(key)), F.col("blocks")).cast("int").alias("b"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a record stands in the pairs of blocks (b, x) for x >= b on the left and (x, b) for x <= b on the right
    left = own.select(F.col("k").alias("k1"), "location", F.col("b").alias("i"), F.explode(F.filter(every, lambda x: x >= F.col("b"))).alias("j"))
    right = own.select(F.col("k").alias("k2"), "location", F.explode(F.filter(every, lambda x: x <= F.col("b"))).alias("i"), F.col("b").alias("j"))
    met = left.join(right, ["location", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("k1") < F.col("k2")))
    return met.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"))
