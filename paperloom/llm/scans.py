"""Repair of text from scanned pages.

Words are counted over the different texts of the whole corpus. A symmetric-delete index over that frequency lexicon (on words folded by the
usual recognition confusions, so that several confusions in a word still meet) generates correction candidates in one
join; a weighted edit distance, cheap for confusion pairs, and the bigram with the word before pick the repair. A word is
misread only against a far more frequent word, so the test reads alike at every corpus size; a word that stands often
enough to have a context of its own is kept where that context is not the one of its candidate (``fax`` beside ``tax``).
For numbers every string of digits is in the lexicon: the candidate is the one the same distance reaches by confusion
pairs alone. Page furniture (page numbers, running headers) is found per record, words broken at line ends are joined
across it unless the hyphen is their own, and the rest is set as continuous paragraphs.

Tasks hold only the most frequent words, a filter that never decides on absence: what it cannot settle is written as an
open finding and settled by a join with the full counts, so the result is the same whatever its bound.

Defined results: null and empty texts give no lines; tables keep their lines; a repeated record is judged like the first;
an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .leakage import _BEYOND, _plain
from .lookalikes import CYRILLIC, GREEK

#: Confusion pairs of recognition, right to read (fixed values), all at the cost of CONFUSED.
CONFUSIONS = {("e", "c"), ("t", "f"), ("i", "l"), ("s", "5"), ("n", "ri"), ("o", "0"), ("d", "cl"), ("l", "1"), ("i", "1"), ("u", "ii"), ("m", "rn"), ("g", "q"), ("h", "b"), ("w", "vv"), ("h", "li"), ("b", "8"), ("z", "2"), ("g", "9"), ("c", "e"), ("f", "t"), ("l", "i"), ("rn", "m"), ("cl", "d"), ("q", "g"), ("b", "h"), ("li", "h"), ("vv", "w"), ("ri", "n")}
CONFUSED, OTHER, LIMIT = 0.3, 1.0, 0.95
#: A misread word is at least so many times rarer than the word it stands for.
RATIO = 12
#: Words of the frequent lexicon that every task gets, at most; rarer words are looked up by a join.
COMMON_WORDS = 60_000
#: Different texts in which a word has to follow another one for it to count as its context.
REPEATED = 3
#: Bigrams in question that are picked out in the tasks, at most; beyond it all bigrams go to the join.
CONTEXT_PAIRS = 200_000
#: Words that no word without digits is read as within LIMIT: every digit of theirs would have to be a confusion.
_NEVER_MISREAD = r"[3467]|[0-9].*[0-9].*[0-9].*[0-9]"

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_ALIKE = {ord(k): v for k, v in {**CYRILLIC, **GREEK}.items()}
_HYPHENS = "-¬‐­‑"
_HYPHEN_SET = set(_HYPHENS)
_BREAK = re.compile(rf"([^\W_]+(?:[-'’][^\W_]+)*)[{_HYPHENS}][ \t ]*$")
_START = re.compile(r"[ \t]*([^\W_]+(?:[-'’][^\W_]+)*)")
_NUM = r"[\dlIO|ZSB]{1,4}"
_PAGE = re.compile(rf"(?:(?:page|seite|p\.|s\.|pag\.|стр\.|blatt)\s*{_NUM}(?:\s*(?:of|von|/|de|из|sur)\s*{_NUM})?|[-—–]\s*{_NUM}\s*[-—–]|[\[(]\s*{_NUM}\s*[\])]|{_NUM}\s*/\s*{_NUM}|第\s*{_NUM}\s*页)", re.I)
_TAIL_NUMBER = re.compile(rf"\s*(?:[|/·—–-]\s*)?(?:{_PAGE.pattern}|{_NUM})$", re.I)
_MAYBE_NUMBER = re.compile(r"[\dlIO|ZSB]\W*$|[\dlIO|ZSB]\s*页", re.I)
_ROMAN = re.compile(r"[ivxl1]{1,6}", re.I)
_BARE = re.compile(rf"{_NUM}")
_AMOUNT = re.compile(r"(?:^|\s)[$€£¥]?[\d,OlISZB]*\d[\d,OlISZB]*\.[\dOlISZB]{2}\s*$")
_TABLE = re.compile(r"\S {2,}\S.*\d|^\s*[\d.,%]+\s*$")
#: Lines that carry a sum over to the next page belong to the table (fixed values).
_CARRY = re.compile(r"carr[il1]ed f[o0]rward|brought f[o0]rward|subt[o0]tal|übertrag|zwischensumme|sous-total|à reporter", re.I)
_DIGIT = re.compile(r"\d")


def _carried(t: str) -> bool:
    low = t.lower()
    return any(x in low for x in ("rward", "t0tal", "total", "übertrag", "summe", "reporter")) and bool(_CARRY.search(low))


_MIXED = re.compile(r"\d[OolISZBb]|[OolISZBb]\d|(?<![^\W_])[OlISZB][.,]\d")
_BADNUM = re.compile(r"(?<![^\W_])([A-Z]{0,4})((?=[\dOolISZBbi]*\d)(?=[\dOolISZBbi]*[OolISZBb])[\dOolISZBb]+)(?![^\W_])|(?<![^\W_])(?<![.,])()([OlISZB])(?=,\d{3}(?!\d))")
_NEVER = re.compile(_NEVER_MISREAD)
_HOUSE_LETTER = re.compile(r"\d+b|b\d{1,2}")
_NUMERALS = str.maketrans("OolIiSZBb", "001115286")

# Comparable forms: single characters first, so that sequences meet whatever stands for their parts.
_SINGLES = bytes.maketrans(b"015i8etqh926", b"olslbcfgbgzb")
_PAIRS = ((b"cl", b"d"), (b"rn", b"m"), (b"rl", b"n"), (b"vv", b"w"), (b"ll", b"u"))
_NO_LETTER = bytes(b for b in range(256) if b > 127 or not chr(b).isalnum())
_NO_LETTER_NOR_DIGIT = _NO_LETTER + b"0123456789"


def folded(text: str, digits: bool = True) -> bytes:
    """Letters (and digits) of a word or line with the usual recognition confusions falling together."""
    if not text.isascii():
        text = _BEYOND.sub(_plain, text)
    s = text.lower().encode("ascii", "ignore").translate(_SINGLES, _NO_LETTER) if digits else text.lower().encode("ascii", "ignore").translate(None, _NO_LETTER_NOR_DIGIT).translate(_SINGLES)
    for a, b in _PAIRS:
        s = s.replace(a, b)
    return s


def folded_forms(word: str) -> set[bytes]:
    """``folded`` with its sequences taken in both orders, as they may overlap (``occiirred``, ``clisputed``)."""
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word.translate(_ALIKE))
    one = other = word.lower().encode("ascii", "ignore").translate(_SINGLES, _NO_LETTER)
    for a, b in _PAIRS:
        one = one.replace(a, b)
    for a, b in reversed(_PAIRS):
        other = other.replace(a, b)
    return {one, other}


def cleaned(text: str) -> str:
    """Invisible characters gone, full-width forms plain, words of look-alikes Latin. Line breaks stay."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text).replace("‑", "-").replace("‐", "-"))
    return _ALIKE_WORD.sub(_latin, text) if _ALIKE_LETTER.search(text) else text


_UNSEEN = re.compile("[" + "".join(map(chr, _INVISIBLE)) + "]")
_ALIKE_LETTER = re.compile("[Ͱ-ԯ]")
_ALIKE_WORD = re.compile(r"[^\W\d_]*[Ͱ-ԯ][^\W\d_]*")


def _latin(m: re.Match) -> str:
    return _latin_word(m[0])


@functools.lru_cache(1 << 16)
def _latin_word(word: str) -> str:
    """A word with letters from elsewhere in Latin ones, where some are Latin already or all can be."""
    out = word.translate(_ALIKE)
    return out if out.isascii() or min(word) < "ɐ" else word


def _prepare(text: str) -> list[str]:
    if "\xad" in text:  # soft hyphens at line ends are breaks, elsewhere invisible
        text = _SOFT.sub("-", text)
    return [x if x.isascii() else cleaned(x) for x in text.split("\n")]


_SOFT = re.compile("\xad(?=[ \t]*(?:\n|$))")
_EDGE = re.compile(rf"[{_HYPHENS}][ \t]*\n\s*")
_LAST = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*$")


def token_words(token: str) -> list[str]:
    """Words of a piece of text without white space, in lower case."""
    return _WORD.findall(cleaned(token).lower())


def halves(text: str) -> list[str]:
    """The halves on both sides of hyphened line ends; as words they would be noise in the lexicon."""
    out = []
    for m in _EDGE.finditer(text):
        a = _LAST.search(text, max(0, m.start() - 40), m.start())
        b = _WORD.match(text, m.end())
        out += [w for x in (a, b) if x for w in token_words(x[0])]
    return out


def weighted_distance(right: str, read: str) -> float:
    """Edit distance from ``right`` to ``read``: CONFUSED for a confusion pair, OTHER for any other edit."""
    n, m = len(right), len(read)
    best = [[9.0] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            v = best[i][j]
            if v > LIMIT + OTHER:
                continue
            if i < n and j < m:
                c = 0.0 if right[i] == read[j] else OTHER
                best[i + 1][j + 1] = min(best[i + 1][j + 1], v + c)
            if i < n:
                best[i + 1][j] = min(best[i + 1][j], v + OTHER)
            if j < m:
                best[i][j + 1] = min(best[i][j + 1], v + OTHER)
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m and (right[i : i + a], read[j : j + b]) in CONFUSIONS:
                        best[i + a][j + b] = min(best[i + a][j + b], v + CONFUSED)
    return best[n][m]


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, copied) in lower case, words broken at line ends left out: n over the different texts, copied over all rows.

    Counted in the tasks before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens: Counter = Counter()
        cut_off: Counter = Counter()
        again: Counter = Counter()  # what copies add
        cut_again: Counter = Counter()

        def words_of(tokens, cut_off):
            # each different token is taken apart once, however often it stands in the texts
            words: Counter = Counter()
            for token, n in tokens.items():
                for w in token_words(token):
                    words[w] += n
            words.subtract(cut_off)
            return words

        def out():
            words, more = words_of(tokens, cut_off), words_of(again, cut_again)
            own = [(w, words[w], words[w] + more[w]) for w in {**words, **more} if words[w] or more[w]]
            return pd.DataFrame(own, columns=["word", "n", "copied"])

        for pdf in batches:
            for t, copies in zip(pdf["t"], pdf["copies"]):
                tokens.update(t.split())
                broken = halves(t) if "\n" in t else ()
                cut_off.update(broken)
                if copies > 1:
                    for own, all_of in ((t.split(), again), (broken, cut_again)):
                        for w, n in Counter(own).items():
                            all_of[w] += n * (copies - 1)
            if len(tokens) > 300_000:
                yield out()
                tokens, cut_off, again, cut_again = Counter(), Counter(), Counter(), Counter()
        yield out()

    own = texts.filter(F.length(text) > 0).groupBy(F.col(text).alias("t")).agg(F.count("*").alias("copies"))
    return own.mapInPandas(count, "word string, n long, copied long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("copied").alias("copied")).filter("n > 0")


def delete_keys(word: str) -> list[str]:
    """Keys of the symmetric-delete index: the folded word and all its forms with one character left out; the halves of a very
    long one, of which a form one edit away keeps at least one."""
    keys: set[str] = set()
    for form in folded_forms(word):
        f = form.decode() or word
        keys.add(f)
        if len(f) > 40:
            h = len(f) // 2
            keys |= {x for n in (h - 1, h, h + 1) for x in (f"<{f[:n]}", f">{f[-n:]}")}
        elif len(f) >= 4:
            keys |= {f[:i] + f[i + 1 :] for i in range(len(f))}
    return sorted(keys)


def corrections(counts: DataFrame) -> DataFrame:
    """(word, right, cost, n, own): candidates for every word that reads as a misrecognised far more frequent one.

    The lexicon and the queries meet on symmetric deletes of their folded forms. Frequency is that over different texts,
    so copies of a scan neither hide its misread words nor make them right. Only a word too rare there to be right for
    any other (below RATIO) is judged by its rows, and not against a word in more texts.
    """

    @F.pandas_udf("array<string>")
    def keys(words: pd.Series) -> pd.Series:
        return pd.Series([delete_keys(w) for w in words])

    @F.pandas_udf("double")
    def cost(right: pd.Series, read: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(a, b) for a, b in zip(right, read)])

    long = F.length("word") >= F.when(F.col("word").rlike(r"\d"), 2).otherwise(3)
    short_right = (F.length("word") == 2) & (F.col("copied") >= RATIO)
    pure = counts.filter((long | short_right) & ~F.col("word").rlike(r"^[\d-]+$") & ~F.col("word").rlike(_NEVER_MISREAD))
    index = cut(pure.withColumn("k", F.explode(keys("word"))))
    lexicon = index.filter((F.col("copied") >= RATIO) & ~F.col("word").rlike(r"\d")).select("k", F.col("word").alias("right"), F.col("n").alias("right_n"), F.col("copied").alias("right_copied"))
    more = F.when(F.col("right_n") >= RATIO, F.col("right_n") >= RATIO * F.col("n")).otherwise((F.col("right_n") >= F.col("n")) & (F.col("right_copied") >= RATIO * F.col("copied")))
    pairs = index.join(lexicon, "k").filter(more & (F.abs(F.length("word") - F.length("right")) <= 3)).select("word", "n", "right", "right_n").distinct()
    pairs = pairs.filter((F.length("word") > 2) | F.col("word").rlike(r"\d")).filter(F.levenshtein("word", "right") <= 6)
    return pairs.withColumn("cost", cost("right", "word")).filter((F.col("cost") > 0) & (F.col("cost") <= LIMIT)).select("word", "right", "cost", F.col("right_n").alias("n"), F.col("n").alias("own"))


class Lexicon(NamedTuple):
    """The frequent words with their counts: every word at least ``floor`` times there is among them."""

    known: dict[str, int]
    floor: int

    def sure(self, word: str) -> bool:
        """Whether the count of a word is settled here; a word not among the known is rarer than the floor."""
        return self.floor <= 1 or word in self.known


def common_words(right: DataFrame) -> Lexicon:
    """The frequent words of ``right`` (word, n): by a threshold out of a histogram of the counts, so a bounded part of the lexicon."""
    step = F.floor(8 * F.log2("n")).cast("int")
    hist = sorted(((r["s"], r["k"]) for r in right.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in hist:
        if total + k > COMMON_WORDS:
            break
        total, least = total + k, s
    if least is None:
        return Lexicon({}, 1 if not hist else 1 << 62)
    rows = right.filter(step >= least).collect()
    known = {r["word"]: r["n"] for r in rows}
    return Lexicon(known, 1 if len(hist) and least == hist[-1][0] else min(known.values()))


def _number(s: str) -> int | None:
    d = re.search(_NUM, s)
    if not d:
        return None
    v = d[0].translate(str.maketrans("lIO|ZSB", "1101258"))
    return int(v) if v.isdigit() else None


_ROMANS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}


def furniture(lines: list[tuple[str, int, int | None, str]]) -> dict[int, str]:
    """Index of a line → page_number or running_header. Lines are (node, number, page or None, text) in record order."""
    found: dict[int, str] = {}
    text = [(x[3].replace("\f", " ") if "\f" in x[3] else x[3]).strip() for x in lines]
    page = [x[2] for x in lines]
    bare: list[tuple[int, int, str]] = []
    for i in [i for i, t in enumerate(text) if 0 < len(t) <= 24]:
        t = text[i]
        if len(t) > 5 and not _MAYBE_NUMBER.search(t):
            continue
        if _PAGE.fullmatch(t) and re.search(r"[\dlIO]", t):
            found[i] = "page_number"
        elif _BARE.fullmatch(t) and re.search(r"\d", t) or t in ("l", "I") or _ROMAN.fullmatch(t) and t.lower() in _ROMANS:
            after = next((x for x in text[i + 1 : i + 3] if x), "")
            before = next((x for x in reversed(text[max(0, i - 2) : i]) if x), "")
            if _AMOUNT.search(after) or _AMOUNT.search(before) and page[i] is None and len(text) > i + 1 and _TABLE.search(after):
                continue
            v = _ROMANS.get(t.lower()) if not re.search(r"\d", t) and t.lower() in _ROMANS else _number(t)
            if v is not None:
                bare.append((i, v, "r" if not re.search(r"\d", t) and t not in ("l", "I") else "n"))
    # bare numbers are page numbers where they count on, page by page
    for kind in "nr":
        own = [(i, v) for i, v, k in bare if k == kind]
        for x, (i, v) in enumerate(own):
            if page[i] is not None:
                last = i + 1 == len(lines) or page[i + 1] != page[i]
                ok = last and v == page[i] + 1 or any(page[j] != page[i] and page[j] - page[i] == w - v for j, w in own)
            else:
                near = [own[x - 1]] if x else []
                near += [own[x + 1]] if x + 1 < len(own) else []
                ok = any((w - v) * (j - i) > 0 and abs(w - v) == 1 for j, w in near) or kind == "r"
            if ok:
                found[i] = "page_number"
    groups: dict[bytes, list[int]] = {}
    for i in [i for i, t in enumerate(text) if 6 <= len(t) <= 100 and (page[i] is not None or not t[0].islower()) and i not in found]:
        t = text[i]
        if page[i] is None:
            first = t[:1] if t[:1].isalnum() else t.lstrip("«“\"'([")[:1]
            if not first or first.islower():
                continue
        tail = _TAIL_NUMBER.sub("", t) if len(t) > 16 and (t[-1].isdigit() or t[-1] in "lIO|ZSB])-—–页") else t
        key = folded(tail, False) or re.sub(r"[\W\d]", "", tail.lower()).encode()
        if len(key) >= 5:
            groups.setdefault(key, []).append(i)
    keys = sorted(groups, key=lambda k: -len(groups[k]))
    merged: dict[bytes, list[int]] = {}
    starts: dict[bytes, list[bytes]] = {}
    ends: dict[bytes, list[bytes]] = {}
    middles: dict[bytes, list[bytes]] = {}
    order: dict[bytes, int] = {}
    for k in keys:
        to = k
        n = len(k)
        if n >= 8:
            # keys that can be close share three characters at an end or all between; the first of them in order is taken
            a, b, c = k[:3], k[-3:], k[3:-3]
            x, y, z = starts.get(a), ends.get(b), middles.get(c)
            close = None
            if x or y or z:
                close = [o for o in {*(x or ()), *(y or ()), *(z or ())} if -3 < len(o) - n < 3 and _close(o, k)]
            if close:
                to = min(close, key=order.__getitem__)
            else:
                order[k] = len(order)
                starts.setdefault(a, []).append(k)
                ends.setdefault(b, []).append(k)
                middles.setdefault(c, []).append(k)
        merged.setdefault(to, []).extend(groups[k])
    for own in merged.values():
        if len(own) < 2:
            continue
        own = [i for i in own if not (_carried(text[i]) or _DIGIT.search(text[i]) and (_AMOUNT.search(text[i]) or _TABLE.search(text[i])))]
        if len(own) < 2:
            continue
        if page[own[0]] is not None:
            if len({page[i] for i in own}) < 2 or any(len(x) > 100 for x in (text[i] for i in own)):
                continue
            found.update((i, "running_header") for i in own if i not in found and _lone(lines, i))
            continue
        edge = [i for i in own if _at_edge(text, found, i)]
        if len(edge) >= 2 or edge and len(own) == 2:
            sentence = [i for i in own if re.search(r"[a-zà-ÿ]{3}[.,;:]$", text[i]) and i not in edge]
            found.update((i, "running_header") for i in own if i not in sentence)
    return found


def _close(a: bytes, b: bytes) -> bool:
    """Whether two keys are at most two edits apart."""
    if len(set(a) ^ set(b)) > 4:
        return False
    return _within(a, b, 2)


def _within(a: bytes, b: bytes, k: int) -> bool:
    """Whether ``a`` and ``b`` are at most ``k`` edits apart: common ends are passed over, each difference branches."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if i:
        a, b = a[i:], b[i:]
        n -= i
    i = 0
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    if i:
        a, b = a[:-i], b[:-i]
    if not a or not b or k == 0:
        return len(a) + len(b) <= k
    if abs(len(a) - len(b)) > k:
        return False
    return _within(a[1:], b[1:], k - 1) or _within(a[1:], b, k - 1) or _within(a, b[1:], k - 1)


def _lone(lines, i: int) -> bool:
    """Whether a line is the only one of its block."""
    node = lines[i][0]
    return not (i and lines[i - 1][0] == node or i + 1 < len(lines) and lines[i + 1][0] == node)


def _at_edge(text: list[str], found: dict[int, str], i: int) -> bool:
    """Whether a line stands at a page edge: beside a page number, at the record's end, or inside a sentence it does not belong to."""
    if i == 0 or i == len(text) - 1:
        return True
    a, b = text[i - 1], text[i + 1]
    if found.get(i - 1) == "page_number" or found.get(i + 1) == "page_number":
        return True
    following = next((x for x in text[i + 1 : i + 4] if x), "")
    leading = next((x for x in reversed(text[max(0, i - 3) : i]) if x), "")
    if not a or not b:
        return not re.search(r"[.,;:]$", text[i]) or bool(re.search(r"\b(?:S\.A|B\.V|Co|Inc|Ltd|LLC)\.$", text[i]))
    return bool(following[:1].islower() and leading and not re.search(r"[.:;!?]$", leading) and not re.search(r"[,;:]$", text[i]))


def line_breaks(lines, found: dict[int, str]) -> Iterator[tuple[int, int, str, str]]:
    """(line, next line of running text, left, right) at hyphened line ends."""
    for i, (_, _, _, t) in enumerate(lines):
        t = t.rstrip()
        if t[-1:] not in _HYPHEN_SET or not t or i in found:
            continue
        m = _BREAK.search(t)
        if not m or not m[1][-1].isalpha():
            continue
        j = next((k for k in range(i + 1, len(lines)) if k not in found and lines[k][3].strip()), None)
        s = j is not None and _START.match(lines[j][3])
        if s and s[1][0].isalpha():
            yield i, j, m[1], s[1]


def break_words(left: str, right: str) -> list[str]:
    """The words whose counts decide a line break: whole, with hyphen, and their innermost parts alone, joined and with hyphen."""
    la, rb = left.lower().rsplit("-", 1)[-1], right.lower().split("-", 1)[0]
    return [(left + right).lower(), f"{left}-{right}".lower(), la, rb, la + rb, f"{la}-{rb}"]


def is_broken(left: str, right: str, count: Callable[[str], int]) -> bool:
    """Whether a line end breaks a word; False for compounds at their own hyphen."""
    whole, hyphened, la, rb, joined, with_hyphen = break_words(left, right)
    a, b = count(whole), count(hyphened)
    if a or b:
        return a >= b
    if right[:1].isupper() and not left.isupper():
        return False
    if count(la) >= RATIO and count(rb) >= RATIO and len(la) > 2 and len(rb) > 2 and not count(joined):
        return False
    return count(joined) >= count(with_hyphen)


def _settled(left: str, right: str, lex: Lexicon) -> bool | None:
    """``is_broken`` as far as the frequent words settle it."""
    if lex.floor <= 1:
        return is_broken(left, right, lambda w: lex.known.get(w, 0))
    a, b = lex.known.get((left + right).lower()), lex.known.get(f"{left}-{right}".lower())
    if a is None and b is None:
        return None
    return (a or 0) >= (b or 0)  # one that is not known is rarer than one that is


class Finding(NamedTuple):
    """A defect, or a word still to be looked up: kind ``break`` (word and prev are the halves), ``number`` or ``word``.

    ``given`` names the open break a word depends on, ``broken`` how it has to come out.
    """

    line: int
    kind: str
    word: str | None = None
    prev: str | None = None
    given: str | None = None
    broken: bool | None = None


def record_findings(lines, lex: Lexicon, usual: set[str] | None = None) -> list[Finding]:
    """Defects and open findings of one record. Words among the frequent ones are not listed.

    ``usual`` keeps tokens that hold nothing but such words from record to record.
    """
    known = lex.known
    usual = set() if usual is None else usual
    if len(usual) > 300_000:
        usual.clear()
    found = furniture(lines)
    out = [Finding(i, kind) for i, kind in found.items()]
    tail: dict[int, tuple[str, str, bool | None]] = {}
    head: dict[int, tuple[str, str, bool | None]] = {}
    for i, j, left, right in line_breaks(lines, found):
        broken = _settled(left, right, lex)
        if broken is not False:
            tail[i] = head[j] = (left, right, broken)
            out.append(Finding(i, "broken_word" if broken else "break", left, right))
    last = ""
    for i, (_, _, _, t) in enumerate(lines):
        if i in found:
            continue
        tokens = t.split()
        special = i in head or i in tail
        if not special:
            if usual.issuperset(tokens):
                last = t
                continue
            new = False
            for x in tokens:
                if x not in usual:
                    if x.isalpha() and x.lower() in known or not (_MIXED.search(x) or [w for w in _WORD.findall(x.lower()) if w not in known and len(w) > 1 and not w.isdigit() and not _NEVER.search(w)]):
                        usual.add(x)
                    else:
                        new = True
            if not new:
                last = t
                continue
        for m in _BADNUM.finditer(t) if _MIXED.search(t) else ():
            code = re.fullmatch(r"[A-Z]{1,4}\d+", m[0]) and not re.match(r"[./-]\d", t[m.end() :]) or re.fullmatch(r"[A-Z]\d{5}", m[0])
            if m[2] and _HOUSE_LETTER.fullmatch(m[0]) and not re.search(r"[.,]$", t[: m.start()]) and not re.match(r"[.,]\d", t[m.end() :]):
                continue
            if not code and not (m[1] and m[2][0].isalpha()) and not re.search(r"[A-Z]{1,2}\d{1,2} $", t[: m.start()]):
                if m[2] is None or lex.sure(m[0].lower()) or lex.floor <= RATIO:
                    if m[2] is None or known.get(m[0].lower(), 0) < RATIO:
                        out.append(Finding(i, "misread", m[0]))
                else:
                    out.append(Finding(i, "number", m[0].lower(), m[0]))
        before = next(iter(_WORD.findall(last.lower())[-1:]), None)
        last = t
        opened: tuple[str, str] | None = None  # the open break at the head of the line, for the word behind it
        for x, m in enumerate(_WORD.finditer(t)):
            w = m[0].lower()
            if not special:
                if w not in known and len(w) > 1 and (w.isalpha() or not w.isdigit() and not _NEVER.search(w)):
                    out.append(Finding(i, "word", w, before))
                before = w
                continue
            readings: list[tuple[str, str | None, str | None, bool | None]] = [(w, before, None, None)]
            after = w
            if x == 0 and i in head:
                left, right, broken = head[i]
                pair = f"{left}\n{right}"
                after = (left + right).lower()
                readings = [] if broken else [(w, before, pair, False)]
                opened = (w, pair) if broken is None else None
            elif i in tail and m.end() >= len(t.rstrip()) - 1 and m[0] == tail[i][0]:
                left, right, broken = tail[i]
                after = (left + right).lower()
                pair = f"{left}\n{right}"
                readings = [(after, before, None, None)] if broken else [(after, before, pair, True), (w, before, pair, False)]
            elif opened:
                readings = [(w, before, opened[1], True), (w, opened[0], opened[1], False)]
            if not (x == 0 and i in head):
                opened = None
            for word, prev, pair, broken in readings:
                if word not in known and len(word) >= 2 and (word.isalpha() or not word.isdigit() and not _NEVER.search(word)):
                    out.append(Finding(i, "word", word, prev, pair, broken))
            before = after
    return out


def record_lines(texts: list[tuple[str, int | None, str]]) -> list[tuple[str, int, int | None, str]]:
    """Lines of a record out of its (node, page or None, text) parts."""
    return [(node, no, page, line) for node, page, text in texts for no, line in enumerate(_prepare(text))]


FOUND = "tbl string, rec_id string, node string, line_no int, kind string, word string, prev string, given string, broken boolean, same_text long"


def _lines_of(parts):
    return record_lines([(p["node"], None if p["page"] is None or p["page"] != p["page"] else int(p["page"]), p["text"]) for p in parts if p["text"]])


def _mark(parts) -> int:
    """A number that copies of a record share."""
    crc = size = 0
    for p in parts:
        text = (p["text"] or "").encode("utf-8", "surrogatepass")
        crc, size = zlib.crc32(text, crc), size + len(text)
    return crc | (size & 0x7FFFFFFF) << 32


def _plainly(records: DataFrame) -> DataFrame:
    """Records with one plain text as that text, the others as their parts."""
    first = F.get("parts", F.lit(0))
    lone = F.coalesce((F.size("parts") == 1) & (first["node"] == "") & first["page"].isNull() & first["text"].isNotNull(), F.lit(False))
    return records.select("tbl", "rec_id", F.when(lone, first["text"]).alias("text"), F.when(~lone, F.col("parts")).alias("parts"))


def raw_findings(records: DataFrame, lex: Lexicon) -> DataFrame:
    """Findings of records (tbl, rec_id, parts array<struct<node,page,text>>); open ones are still to be looked up."""
    sent = records.sparkSession.sparkContext.broadcast(tuple(lex))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual: set[str] = set()
        own = Lexicon(*sent.value)
        for pdf in batches:
            out = []
            for tbl, rec, text, parts in zip(pdf["tbl"], pdf["rec_id"], pdf["text"], pdf["parts"]):
                if text is not None:
                    parts = [{"node": "", "page": None, "text": text}]
                lines = _lines_of(parts)
                found = record_findings(lines, own, usual)
                mark = _mark(parts) if found else 0
                out += [(tbl, rec, lines[f.line][0], lines[f.line][1], *f[1:], mark) for f in found]
            yield pd.DataFrame(out, columns=["tbl", "rec_id", "node", "line_no", "kind", "word", "prev", "given", "broken", "same_text"])

    return _plainly(records).filter("text is not null or parts is not null").mapInPandas(rows, FOUND)


def settled_findings(found: DataFrame, right: DataFrame, lex: Lexicon) -> DataFrame:
    """Findings with every open break and number decided by the full counts ``right`` (word, n)."""
    if lex.floor <= 1:
        return found
    words = F.pandas_udf(lambda a, b: pd.Series([break_words(x, y) for x, y in zip(a, b)]), "array<string>")

    @F.pandas_udf("boolean")
    def broken(a: pd.Series, b: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([is_broken(x, y, lambda w, c=dict((k, n) for k, n in (c.items() if isinstance(c, dict) else c)): c.get(w, 0)) for x, y, c in zip(a, b, counts)], dtype=bool)

    breaks = found.filter("kind = 'break'").select("word", "prev").distinct().withColumnRenamed("word", "left").withColumnRenamed("prev", "right")
    each = breaks.select("left", "right", F.explode(F.array_distinct(words("left", "right"))).alias("word")).join(right.select("word", "n"), "word", "left")
    counted = each.groupBy("left", "right").agg(F.map_from_entries(F.collect_list(F.struct("word", F.coalesce("n", F.lit(0)).alias("n")))).alias("counts"))
    decided = cut(counted.select(F.concat_ws("\n", "left", "right").alias("given"), broken("left", "right", "counts").alias("came_out")))
    out = found.filter("kind not in ('break', 'number')").join(decided, "given", "left").filter("given is null or broken = came_out").select(found.columns)
    ends = found.filter("kind = 'break'").withColumn("given", F.concat_ws("\n", "word", "prev")).join(decided.filter("came_out"), "given", "left_semi").withColumn("kind", F.lit("broken_word"))
    often = right.filter(F.col("n") >= RATIO).select("word")
    numbers = found.filter("kind = 'number'").join(often, "word", "left_anti").withColumns({"word": F.col("prev"), "kind": F.lit("misread"), "prev": F.lit(None).cast("string")})
    return out.select(found.columns).unionByName(ends.select(found.columns)).unionByName(numbers.select(found.columns))


class Judgement(NamedTuple):
    """What is found in records: settled defects and (tbl, rec_id, node, line_no, word, right) of misread words."""

    sure: DataFrame
    repairs: DataFrame


def judged(records: DataFrame) -> Judgement:
    """The lexicon, the findings and the choice among the candidates of all records."""
    counts = cut(word_counts(records.select(F.explode("parts.text").alias("text"))))
    wrong = cut(corrections(counts))
    right = cut(counts.filter(~F.col("word").rlike(r"^\d+$")).join(wrong.select("word").distinct(), "word", "left_anti").select("word", "n"))
    lex = common_words(right)
    found = cut(settled_findings(raw_findings(records, lex), right, lex)) if lex.floor <= 1 else cut(settled_findings(cut(raw_findings(records, lex)), right, lex))
    sure = found.filter("kind <> 'word'").select("tbl", "rec_id", "node", "line_no", "kind", "word", "prev")
    words = found.filter("kind = 'word'").select("tbl", "rec_id", "node", "line_no", "word", "prev", "same_text")
    return Judgement(sure, chosen_repairs(records, words, wrong))


def defects(records: DataFrame) -> DataFrame:
    """Distinct (tbl, rec_id, node, line_no, defect)."""
    sure, repairs = judged(records)
    at = ["tbl", "rec_id", "node", "line_no"]
    return sure.select(*at, F.col("kind").alias("defect")).unionByName(repairs.select(*at, F.lit("misread").alias("defect"))).distinct()


_SPACED = bytes(o if o > 127 or chr(o).isalnum() or chr(o) in "'-_" else 32 for o in range(256))


def bigrams(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``wanted`` (prev, right) that stand side by side in some text."""
    few = wanted.limit(CONTEXT_PAIRS + 1).collect()
    sent = records.sparkSession.sparkContext.broadcast({(r["prev"], r["right"]) for r in few} if len(few) <= CONTEXT_PAIRS else None)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = sent.value
        for pdf in batches:
            seen: set[tuple[str, str]] = set()
            for t in pdf["t"]:
                w = cleaned(t).lower().encode("utf-8", "surrogatepass").translate(_SPACED).decode("utf-8", "surrogatepass").split()
                seen.update(zip(w, w[1:]) if some is None else some.intersection(zip(w, w[1:])))
            yield pd.DataFrame(list(seen), columns=["prev", "right"])

    texts = records.select(F.explode("parts.text").alias("t")).filter("length(t) > 0")
    return texts.mapInPandas(rows, "prev string, right string").distinct().join(wanted, ["prev", "right"], "left_semi")


def chosen_repairs(records: DataFrame, words: DataFrame, wrong: DataFrame) -> DataFrame:
    """(tbl, rec_id, node, line_no, word, right) of misread words out of ``words`` (.., word, prev, same_text) and ``wrong`` (word, right, cost, n, own).

    Among several candidates the one that stands behind the same word elsewhere is taken, then the nearest, then the most
    frequent. A word that stands RATIO times or more in different texts can have a context of its own: it is no misread one
    where, of the words it follows in REPEATED different texts, its candidates follow fewer than half elsewhere.
    """
    at = ["tbl", "rec_id", "node", "line_no", "word"]
    options = wrong.groupBy("word").agg(F.max("own").alias("own"), F.collect_list(F.struct("right", "cost", "n")).alias("o"))
    each = cut(words.join(options, "word"))
    several = F.size("o") > 1
    kept = each.filter((F.col("own") >= RATIO) & F.col("prev").isNotNull()).groupBy("word", "prev").agg(F.countDistinct("same_text").alias("k"), F.first("o").alias("o")).filter(F.col("k") >= REPEATED)
    kept = cut(kept.select("word", "prev", "k", F.explode("o.right").alias("right")))
    open_ = each.filter(several & F.col("prev").isNotNull()).select("prev", F.explode("o.right").alias("right"))
    there = cut(bigrams(records, cut(open_.unionByName(kept.select("prev", "right")).distinct())).withColumn("there", F.lit(1)))
    context = kept.join(there, ["prev", "right"], "left").groupBy("word", "prev", "k").agg(F.coalesce(F.max("there"), F.lit(0)).alias("there"))
    genuine = context.groupBy("word").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("there")).alias("seen")).filter("2 * seen < k").select("word")
    misread = each.join(genuine, "word", "left_anti")
    choice = misread.filter(several).select(*at, "prev", F.explode("o").alias("c")).select(*at, "prev", "c.*").join(there, ["prev", "right"], "left")
    rank = F.struct(F.coalesce("there", F.lit(0)).alias("b"), (-F.col("cost")).alias("c"), "n", "right")
    return misread.filter(~several).select(*at, F.col("o")[0]["right"].alias("right")).unionByName(choice.groupBy(*at).agg(F.max_by("right", rank).alias("right")))


def set_text(lines, found: dict[int, str], broken: set[int], repairs: dict[str, str], numbers: set[str] = frozenset()) -> str:
    """Continuous paragraphs of one record: furniture ``found`` gone, words ``broken`` at line ends joined, misread words and numbers
    repaired, tables left in lines."""
    breaks = {i: (j, a, b) for i, j, a, b in line_breaks(lines, found) if i in broken}
    drop_head = {j: b for j, _, b in breaks.values()}

    def mend(t: str) -> str:
        def one(m):
            right = repairs.get(m[0].lower())
            if not right:
                return m[0]
            return right.upper() if m[0].isupper() and len(m[0]) > 2 else right.capitalize() if m[0][:1].isupper() else right

        if repairs:
            low = t.lower()
            if any(w in low for w in repairs):
                t = _WORD.sub(one, t)
        if not any(x in t for x in numbers):
            return t
        return _BADNUM.sub(lambda m: m[0] if m[0] not in numbers else (m[1] or "") + (m[2] or m[0]).translate(_NUMERALS), t)

    out: list[list[str]] = []
    open_line = False
    at_edge = False  # a page edge inside a paragraph keeps it open
    for i, (node, _, _, t) in enumerate(lines):
        if i in found:
            at_edge = True
            continue
        t = t.replace("\f", " ").strip()
        if not t:
            if not at_edge or out and out[-1][-1][-1:] in ".!?:»”\"":
                open_line = False
            continue
        if i in drop_head and t.startswith(drop_head[i]):
            t = t[len(drop_head[i]) :].lstrip()
        if i in breaks:
            _, a, b = breaks[i]
            t = _BREAK.sub("", t) + a + b
        row = bool(_DIGIT.search(t)) and bool(_TABLE.search(t) or _AMOUNT.search(t))
        if row or i and lines[i - 1][0] != node and not at_edge:
            open_line = False
        if t:
            if open_line:
                own = out[-1]
                own.append(t if t[:1] in ".,;:!?)" or own[-1].endswith("-") and t[:1].isalnum() else " " + t)
            else:
                out.append([t])
            open_line = not row
        at_edge = False
    return "\n\n".join(mend(" ".join("".join(p).split())) for p in out)


def repaired(records: DataFrame) -> DataFrame:
    """(tbl, rec_id, text) of all records in continuous readable paragraphs."""
    sure, repairs = judged(records)
    every = sure.unionByName(repairs.select("tbl", "rec_id", "node", "line_no", F.lit("repair").alias("kind"), "word", F.col("right").alias("prev")))
    fixes = every.groupBy("tbl", "rec_id").agg(F.collect_list(F.struct("node", "line_no", "kind", "word", "prev")).alias("fixes"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tbl, rec, text, parts, fixes in zip(pdf["tbl"], pdf["rec_id"], pdf["text"], pdf["parts"], pdf["fixes"]):
                if text is None and parts is None:
                    out.append((tbl, rec, ""))
                    continue
                lines = _lines_of(parts if text is None else [{"node": "", "page": None, "text": text}])
                fixes = [] if fixes is None else list(fixes)
                place = {(x[0], x[1]): i for i, x in enumerate(lines)} if fixes else {}
                found, broken, words, numbers = {}, set(), {}, set()
                for f in fixes:
                    kind = f["kind"]
                    if kind == "repair":
                        words[f["word"]] = f["prev"]
                    elif kind == "misread":
                        numbers.add(f["word"])
                    elif kind == "broken_word":
                        broken.add(place[f["node"], f["line_no"]])
                    else:
                        found[place[f["node"], f["line_no"]]] = kind
                out.append((tbl, rec, set_text(lines, found, broken, words, numbers)))
            yield pd.DataFrame(out, columns=["tbl", "rec_id", "text"])

    return _plainly(records).join(fixes, ["tbl", "rec_id"], "left").mapInPandas(rows, "tbl string, rec_id string, text string")
