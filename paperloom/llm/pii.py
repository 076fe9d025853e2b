"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions, in numpy.

The text is folded position by position (look-alikes, full-width forms and invisible characters do not matter) and read
whole, in overlapping windows. What is found, and from where to where, is the network's: its emissions in overlapping
windows are weighed by how far inside a window a character stands and added, and the best tag sequence of each whole text
decides them together (``decode``). A span is widened to whole tokens and freed of punctuation around it; an exact check that follows may
only reject it (``plausible``). The weights are trained by ``pii_train`` from labelled spans, in windows over whole texts,
and kept beside this module.

Defined results: null and empty texts have no spans; overlapping spans are resolved to the earlier and longer; repeated
rows give repeated spans (the query keeps distinct ones); columns other than those named are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import CYRILLIC, GREEK

KINDS = ("name", "email", "phone", "id_number", "address")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
WINDOW, STRIDE, CONTEXT, BATCH = 128, 96, 28, 768
#: Characters whose scores are held at once; a longer text is a part of its own.
CHARS = 500_000
#: Characters by which the bounds on other tags look to each side; more of them leave less to Viterbi, with the same tags.
ROUNDS = 4
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
#: Characters the model knows; others fall into classes.
_ALPHABET = "".join(map(chr, range(32, 127))) + "\n"
_INDEX = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_UPPER, _LOWER, _OTHER = len(_ALPHABET) + 1, len(_ALPHABET) + 2, len(_ALPHABET) + 3
VOCAB = len(_ALPHABET) + 4
_ALIKE = {**CYRILLIC, **GREEK}
_GONE = set("­​‌‍⁠﻿")

#: Capitalised words that are no part of a name (fixed values): titles, cues and company forms.
_NOT_NAME = set(
    "Mr Mrs Ms Miss Dr Prof Herr Frau Attn Signed Cardholder Contact Person Prepared As We The In On At To By For Of And Neither Both Dear Sincerely From Date Page Seite Flat Apt Unit Box PO Invoice Receipt Bank Statement Annex File Notes Review Summary Annual Under Whoever Out Per Tel Phone Call E-mail Email SSN Tax National Residence Home Deliver Please Holder Section Reference Confidential Dossier Sachbearbeitung "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split()
)
#: Legal forms of companies (fixed values): no person's name ends before one.
_FORMS = set("Ltd Llc Inc Gmbh Co Oy Ag Corp Limited Company Plc Llp Sa Sarl Bv Nv Spa Srl Kg Ohg Ab As Ooo".split())
#: Words that begin a sentence or heading before a capital (fixed values).
_NOT_FIRST = set("Im Die Der Das Für Nach Von Neither Both In At On To By La Le Les Selon Après File Notes Annex Annual Summary Review FILE NOTES ANNEX ANNUAL SUMMARY REVIEW Seite Page Date Invoice Receipt The".split())
#: Places that could hold personal data; each pattern begins with few characters, so a text is passed over quickly.
_SIGNS = [re.compile(r"@"), re.compile(r"[\[(]\s?at\s?[\])]")]
_DIGITS = re.compile(r"\d(?:[ ./()\n-]{0,3}\d){6}")
_POSTAL = re.compile(r"\d{5}(?!\d)")
_BOXES = re.compile(r"[Bb][Oo][Xx]\s\d|Postfach\s\d")
_CODES = re.compile(r"[A-Z]{1,2}(?: ?\n?\d{2}(?:[ \n]?\d){4}|\d{1,2}[A-Z]?\s\d[A-Z]{2}(?!\w)|-\d{5}(?!\d))")
_PAIR = re.compile(r"([A-ZÀ-Þ][A-Za-zÀ-ÿ015]*\.?),?\s{1,3}(?=(?:[A-Z]\.\s?){0,2}[A-ZÀ-Þ][A-Za-zß-ÿ015]{2})")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?!\d)|\d\d?[./]\d\d?[./]\d{4}(?!\d)")


class _Fold(dict):
    """Code point → plain character, filled as characters are met."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if o > 127:
            if c in _ALIKE:
                c = _ALIKE[c]
            else:
                n = unicodedata.normalize("NFKC", c)
                c = n if len(n) == 1 else c
                if c.isspace():
                    c = " "
        self[o] = c
        return c


_FOLD = _Fold()
_GONE_POINTS = np.array(sorted(map(ord, _GONE)), np.uint32)


def folded(text: str) -> tuple[str, np.ndarray | None]:
    """The text in plain characters, and for each the place it stands at (None where nothing was left out)."""
    if text.isascii():
        return text, None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gone = np.isin(points, _GONE_POINTS) | (points >= 0x300) & (points <= 0x36F)
    if not gone.any():
        return text.translate(_FOLD), None
    at = np.flatnonzero(~gone)
    return points[at].tobytes().decode("utf-32-le", "surrogatepass").translate(_FOLD), at


_ASCII = np.array([_INDEX.get(chr(i), _OTHER) for i in range(128)], np.int16)


def encoded(text: str) -> np.ndarray:
    """Character numbers of a folded text."""
    if text.isascii():
        return _ASCII[np.frombuffer(text.encode("ascii"), np.uint8)]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = _ASCII[np.minimum(points, 127)]
    for at in np.flatnonzero(points > 127):
        c = text[at]
        out[at] = _UPPER if c.isupper() else _LOWER if c.islower() else _OTHER
    return out


class Tagger:
    """The trained network: embedding, two LSTM directions, emission layer and CRF transitions.

    The cell takes as much in as it forgets, c = u + f (c - u) and h = o c, with f, o = clip(x / 4 + 1/2, 0, 1) and
    u = clip(x, -1, 1): no exponentials, three gates. Gates stand as forget, output, candidate.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        n, embed = self.w["whf"].shape[0], self.w["emb"].shape[1]
        scale = np.repeat(np.float32([0.25, 0.25, 1]), n)[:, None]
        shift = np.repeat(np.float32([0.5, 0.5, 0]), n)
        # rows: hidden units, embedding, one for the bias
        self.gates = {d: np.concatenate([self.w[f"wh{d}"].T * scale, self.w[f"wx{d}"].T * scale, (self.w[f"b{d}"] * scale[:, 0] + shift)[:, None]], axis=1) for d in "fb"}
        # below the gates, the scores of the hidden units: one product a step gives both
        for d, at in (("f", 0), ("b", n)):
            own = np.zeros((self.w["wo"].shape[1], self.gates[d].shape[1]), np.float32)
            own[:, :n] = self.w["wo"][at : at + n].T
            self.gates[d] = np.concatenate([self.gates[d], own])
        self.letters = np.ascontiguousarray(self.w["emb"].T)
        self.n, self.embed = n, embed

    @classmethod
    def load(cls, path: str = MODEL) -> Tagger:
        with np.load(path) as f:
            return cls({k: f[k] for k in f.files})

    def _run(self, x: np.ndarray, d: str) -> np.ndarray:
        """(t, tags, b): the share of one direction in the scores, for characters in the order they are read."""
        t, b = x.shape
        n, w = self.n, self.gates[d]
        z = np.zeros((w.shape[1], b), np.float32)
        h, letters = z[:n], z[n:-1]
        z[-1] = 1
        g, c = np.empty((len(w), b), np.float32), np.zeros((n, b), np.float32)
        both, f, o, u, e = g[: 2 * n], g[:n], g[n : 2 * n], g[2 * n : 3 * n], g[3 * n :]
        out = np.empty((t, *e.shape), np.float32)
        zero, one = np.float32(0), np.float32(1)
        for i, codes in enumerate(x.astype(np.intp)):
            np.take(self.letters, codes, axis=1, out=letters, mode="clip")
            np.matmul(w, z, out=g)
            if i:
                out[i - 1] = e
            both.clip(zero, one, out=both)
            u.clip(-one, one, out=u)
            c -= u
            c *= f
            c += u
            np.multiply(o, c, out=h)
        out[-1] = np.matmul(w[3 * n :, :n], h)
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(t, b) character numbers → (t, b, tags) scores; columns end in zeros, whose scores mean nothing."""
        t = len(x)
        size = (x > 0).sum(0)
        e = self._run(x, "f")
        e += self.w["bo"][:, None]
        if (size == t).all():
            e += self._run(x[::-1], "b")[::-1]
        else:  # backwards from each column's own end
            turned = (size - 1 - np.arange(t)[:, None]) % t
            e += np.take_along_axis(self._run(np.take_along_axis(x, turned, 0), "b"), turned[:, None], 0)
        return e.transpose(0, 2, 1)

    def _open(self, e: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether another tag than the first could stand in a best sequence, for each row of the scores of several texts.

        Bounds from above, for beginning and inner tags, on how far the best sequence up to here (``up``) and from here on
        (``on``) leads the best one with the first tag here; each round brings in the characters one further away.
        """
        trans, start = self.w["trans"], self.w["start"]
        kinds = slice(1, None, 2), slice(2, None, 2)
        lead = []
        for k in kinds:
            columns = e[:, k].T
            top = columns[0]
            for c in columns[1:]:
                top = np.maximum(top, c)
            lead.append(top - e[:, 0])
        cap_up = [float((trans[:, k] - trans[:, :1]).max()) for k in kinds]
        cap_on = [float((trans[k] - trans[0]).max()) for k in kinds]
        begin = [float((start[k] - start[0]).max()) for k in kinds]
        step = [[float(trans[p, k].max() - trans[0, 0]) for k in kinds] for p in kinds]
        enter = [float(trans[0, k].max() - trans[0, 0]) for k in kinds]
        leave = [float(trans[k, 0].max() - trans[0, 0]) for k in kinds]
        up = [x + c for x, c in zip(lead, cap_up)]
        on = [np.full(len(e), c, np.float32) for c in cap_on]
        for _ in range(ROUNDS):
            far = [x + y for x, y in zip(lead, on)]
            before, behind = [x[:-1] for x in up], [x[1:] for x in far]
            new_up, new_on = [], []
            for k in (0, 1):
                x = np.maximum(before[0] + step[0][k], before[1] + step[1][k])
                new_up.append(lead[k] + cap_up[k])
                new_up[k][1:] = lead[k][1:] + np.clip(x, enter[k], max(cap_up[k], enter[k]))
                new_up[k][first] = lead[k][first] + begin[k]
                y = np.maximum(behind[0] + step[k][0], behind[1] + step[k][1])
                new_on.append(np.full(len(e), cap_on[k], np.float32))
                new_on[k][:-1] = np.clip(y, leave[k], max(cap_on[k], leave[k]))
                new_on[k][last] = 0
            up, on = new_up, new_on
        return (up[0] + on[0] > -1e-3) | (up[1] + on[1] > -1e-3)

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each (length, tags) array of emission scores.

        Where no other tag can stand in a best sequence it is the first one; the stretches between such places are decoded
        by Viterbi, each between its neighbours.
        """
        trans, start = self.w["trans"], self.w["start"]
        size = np.array([len(e) for e in emissions])
        ends = size.cumsum()
        e = np.concatenate(emissions)
        tags = np.zeros(len(e), np.int8)
        open_ = np.zeros(len(e) + 1, bool)
        open_[:-1] = self._open(e, ends - size, ends - 1)
        cut = open_.copy()  # where a stretch begins: an open place behind a closed one or at the start of a text
        cut[1:] &= ~open_[:-1]
        cut[ends - size] = open_[ends - size]
        begin = np.flatnonzero(cut)
        over = ~open_
        over[ends] = True
        stop = np.flatnonzero(over)
        end = stop[np.searchsorted(stop, begin, side="right")]
        head, tail = np.isin(begin, ends - size), np.isin(end, ends)
        e[begin[~head]] += trans[0] - start
        e[end[~tail] - 1] += trans[:, 0]
        order = np.argsort(end - begin, kind="stable")
        while len(order):
            longest = int(end[order[-1]] - begin[order[-1]])
            most = max(1, min(8 * BATCH, CHARS // longest))
            some, order = order[-most:].tolist(), order[:-most]
            for i, y in zip(some, self._viterbi([e[begin[i] : end[i]] for i in some])):
                tags[begin[i] : end[i]] = y
        return np.split(tags, ends[:-1])

    def _viterbi(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each array, all in one pass, aligned at their ends."""
        order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
        t = len(emissions[order[0]])
        k = emissions[0].shape[1]
        first = np.array([t - len(emissions[i]) for i in order])
        e = np.zeros((t, len(order), k), np.float32)
        for col, i in enumerate(order):
            e[first[col] :, col] = emissions[i]
        turned = np.ascontiguousarray(self.w["trans"].T)
        score = np.zeros((len(order), k), np.float32)
        back = np.zeros((t, len(order), k), np.int8)
        live = 0
        for i in range(t):
            if live:
                step = score[:live, None, :] + turned[None]  # the previous tag runs along the last axis
                back[i, :live] = step.argmax(2)
                score[:live] = step.max(2) + e[i, :live]
            now = int(np.searchsorted(first, i, side="right"))
            score[live:now] = e[i, live:now] + self.w["start"]
            live = now
        tags = np.zeros((t, len(order)), np.int8)
        tags[-1] = score.argmax(1)
        rows = np.arange(len(order))
        for i in range(t - 1, 0, -1):
            tags[i - 1] = back[i][rows, tags[i]]
        out: list[np.ndarray] = [np.empty(0, np.int8)] * len(order)
        for col, i in enumerate(order):
            out[i] = tags[first[col] :, col]
        return out


def postal_places(text: str) -> list[tuple[int, int]]:
    """Postal codes and boxes."""
    at = []
    for m in _POSTAL.finditer(text):
        a, b = m.span()
        if a > 1 and text[a - 1].isspace() and (text[a - 2].isalpha() or text[a - 2] == ",") or text[b : b + 1].isspace() and text[b : b + 3].strip()[:1].isupper():
            at.append((a, b))
    at += [m.span() for m in _BOXES.finditer(text)]
    return at + [m.span() for m in _CODES.finditer(text) if not m.start() or not text[m.start() - 1].isalnum()]


def regions(text: str) -> list[tuple[int, int]]:
    """Merged stretches around all places that could hold personal data. The query and the training read whole texts."""
    at = []
    for m in _DIGITS.finditer(text):
        a = m.start()
        before = text[a - 1] if a else " "
        if not (before.isalnum() or before in "_,-" or before == "." and text[a - 2 : a - 1].isdigit()) and not _DATE.match(text, a):
            at.append(m.span())
    at += postal_places(text)
    at += [(m.start() - CONTEXT, m.end() + CONTEXT) for p in _SIGNS for m in p.finditer(text)]
    at += [m.span() for m in _PAIR.finditer(text) if m[1] not in _NOT_FIRST]
    out: list[list[int]] = []
    for a, b in sorted(at):
        a, b = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(regions_of: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """(region, text, from, to) of overlapping windows over the regions, which are numbered through."""
    out = []
    number = 0
    for no, rs in enumerate(regions_of):
        for a, b in rs:
            at = a
            while True:
                out.append((number, no, at, min(at + WINDOW, b)))
                if at + WINDOW >= b:
                    break
                at += STRIDE
            number += 1
    return out


def shares(part: list[tuple[int, int, int, int]], of: list[tuple[int, int, int]], t: int) -> np.ndarray:
    """(t, windows, 1): the share of a window's scores at each place among those of all windows over it, by how far inside it stands.

    A place is in one window or in two that follow one another.
    """
    a, b = np.array([w[2:] for w in part]).T
    first, last = np.array([s[1:] for s in of]).T
    # alike for most windows: length, whether one goes before, and how far the next one reaches
    alike, which = np.unique(np.stack([b - a, a > first, np.minimum(STRIDE + WINDOW, last - a)]), axis=1, return_inverse=True)
    size, follows, reach = alike.astype(np.float32)
    at = np.arange(t, dtype=np.float32)[:, None]
    inside = lambda x, y: np.maximum(np.minimum(at - x + 1, y - at), 0)
    own = np.maximum(inside(0, size), 1)
    before = np.where(follows > 0, inside(-STRIDE, WINDOW - STRIDE), 0)
    behind = np.where(reach > size, inside(STRIDE, reach), 0)
    return (own / (own + before + behind)).astype(np.float32)[:, which.reshape(-1), None]


def widened(text: str, a: int, b: int) -> tuple[int, int]:
    """A span with the tokens it touches whole and without the punctuation around it."""
    while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    while a < b and not text[a].isalnum() and text[a] not in "+(#":
        a += 1
    while b > a and not text[b - 1].isalnum() and not (text[b - 1] == "." and re.search(r"(?:^|[^\w])[A-Z]\.$", text[a:b])):
        b -= 1
    return a, b


def plausible(kind: str, value: str, behind: str = "") -> bool:
    """An exact check of a decoded span: it can only be turned down."""
    digits = sum(c.isdigit() for c in value)
    if kind == "name":
        words = re.findall(r"[^\W\d_]{2,}", value)
        company = re.match(r"[ \n]+([A-ZÀ-Þ][\w]*)", behind)
        return 1 <= len(words) <= 5 and bool(re.search(r"[ \n,.]", value)) and not any(w.capitalize() in _NOT_NAME for w in words) and not (company and company[1].capitalize() in _FORMS)
    if kind == "email":
        return bool(re.search(r"@|[\[(]\s?at\s?[\])]", value)) and bool(re.search(r"[.]|dot", value))
    if kind == "phone":
        return 7 <= digits <= 15 and (value[0] in "+(0" or bool(re.match(r"\d{3}([-. \n])\n?\d{3}\1", value)))
    if kind == "id_number":
        return 6 <= digits <= 20 and sum(c.isalpha() for c in value) <= 4 and not _DATE.fullmatch(value)
    return digits > 0 and sum(c.isalpha() for c in value) >= 4 and bool(postal_places(value + behind[:3]))


def spans_of(texts: list[str], tagger: Tagger, check: bool = True) -> list[list[tuple[str, int, int]]]:
    """(kind, from, to) of each text, in places of the folded text."""
    if len(texts) > 1 and sum(map(len, texts)) > CHARS:
        half = len(texts) // 2
        return spans_of(texts[:half], tagger, check) + spans_of(texts[half:], tagger, check)
    rs = [[(0, len(t))] if t else [] for t in texts]
    ws = windows(rs)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not ws:
        return out
    codes = {no: encoded(texts[no]) for no in {w[1] for w in ws}}
    stretches = [(no, a, b) for no, own in enumerate(rs) for a, b in own]
    sums = [np.zeros((b - a, len(TAGS)), np.float32) for _, a, b in stretches]
    order = sorted(range(len(ws)), key=lambda i: ws[i][3] - ws[i][2])
    for at in range(0, len(order), BATCH):
        part = [ws[i] for i in order[at : at + BATCH]]
        t = max(b - a for _, _, a, b in part)
        x = np.zeros((t, len(part)), np.int16)
        for col, (_, no, a, b) in enumerate(part):
            x[: b - a, col] = codes[no][a:b]
        scores = tagger.emissions(x) * shares(part, [stretches[w[0]] for w in part], t)
        turned = scores.transpose(0, 2, 1).reshape(-1, len(part))
        e = np.empty((len(part), *scores.shape[::2]), np.float32)
        for col in range(0, len(part), 16):  # a few columns at a time, or each number would be fetched from memory alone
            e[col : col + 16].reshape(-1, len(turned))[:] = turned[:, col : col + 16].T
        for col, (number, _, a, b) in enumerate(part):
            start = stretches[number][1]
            sums[number][a - start : b - start] += e[col, : b - a]
    by_length = sorted(range(len(stretches)), key=lambda i: len(sums[i]))
    while by_length:
        most = max(1, min(BATCH, CHARS // len(sums[by_length[-1]])))
        part, by_length = by_length[-most:], by_length[:-most]
        for i, y in zip(part, tagger.decode([sums[i] for i in part])):
            no, start, _ = stretches[i]
            text, n = texts[no], len(y)
            live = np.flatnonzero(y)
            while len(live):
                a = int(live[0])
                kind = (int(y[a]) - 1) // 2
                b = a + 1
                while b < n and y[b] and (int(y[b]) - 1) // 2 == kind and y[b] % 2 == 0:
                    b += 1
                x, z = widened(text, start + a, start + b)
                if x < z and (not check or plausible(KINDS[kind], text[x:z], text[z : z + 40])):
                    out[no].append((KINDS[kind], x, z))
                live = live[live >= b]
    for no, found in enumerate(out):
        last = 0
        kept = []
        for kind, a, b in sorted(set(found), key=lambda x: (x[1], -x[2])):
            if a >= last:
                kept.append((kind, a, b))
                last = b
        out[no] = kept
    return out


PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]"}


def _spans_in_text(texts: list[str | None], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """(kind, from, to) in places of the texts as written."""
    plain = [folded(t or "") for t in texts]
    out = []
    for (s, at), found in zip(plain, spans_of([p[0] for p in plain], tagger)):
        out.append(found if at is None else [(k, int(at[a]), int(at[b - 1]) + 1) for k, a, b in found])
    return out


def personal_spans(df: DataFrame, keys: list[str], text: str, label: str | None = None, model: str = MODEL) -> DataFrame:
    """keys, kind, start, pii_value for every span. ``label`` names a column with what the text is called (a field name);
    it is read by the network before the text. Narrow: one pass, the model is loaded once per task."""
    lead = F.concat(F.col(label), F.lit(": ")) if label else F.lit("")
    own = df.filter(F.length(text) > 0).select(*[F.col(k).cast("string").alias(k) for k in keys], lead.alias("_l"), F.col(text).alias("_t"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load(model)
        for pdf in batches:
            leads = pdf["_l"].to_list()
            found = _spans_in_text([a + b for a, b in zip(leads, pdf["_t"])], tagger)
            out = []
            for key, l, t, spans in zip(pdf[keys].itertuples(index=False, name=None), leads, pdf["_t"], found):
                out += [(*key, k, a - len(l), t[a - len(l) : b - len(l)]) for k, a, b in spans if a >= len(l)]
            yield pd.DataFrame(out, columns=[*keys, "kind", "start", "pii_value"])

    return own.mapInPandas(rows, ", ".join(f"{k} string" for k in keys) + ", kind string, start int, pii_value string")


def masked(df: DataFrame, text: str, model: str = MODEL) -> DataFrame:
    """``df`` with typed placeholders in place of personal information; the rest of the text is unchanged."""
    held: list = []

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not held:
            held.append(Tagger.load(model))
        for s in batches:
            texts = s.to_list()
            out = []
            for at in range(0, len(texts), 1000):
                part = texts[at : at + 1000]
                for t, spans in zip(part, _spans_in_text(part, held[0])):
                    for k, a, b in reversed(spans):
                        t = t[:a] + PLACEHOLDER[k] + t[b:]
                    out.append(t)
            yield pd.Series(out, dtype="object")

    return df.withColumn(text, mask(F.col(text)))


def masked_json(df: DataFrame, column: str, model: str = MODEL) -> DataFrame:
    """``df`` with personal information masked in every string inside a JSON column, keys and everything else unchanged.

    The network reads a string behind the name of its field. Null stays null; a text that is no JSON is masked as one string.
    """
    held: list = []

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        if not held:
            held.append(Tagger.load(model))
        for s in batches:
            values, leads, texts, places = [], [], [], []
            for no, raw in enumerate(s):
                try:
                    value = json.loads(raw) if raw else None
                except (ValueError, RecursionError):
                    value = raw
                values.append([value])
                todo = [(values[-1], 0, "")]
                while todo:
                    inside, at, name = todo.pop()
                    v = inside[at]
                    if isinstance(v, dict):
                        todo += [(v, k, k) for k in v]
                    elif isinstance(v, list):
                        todo += [(v, i, name) for i in range(len(v))]
                    elif isinstance(v, str) and v:
                        leads.append(f"{name}: " if name else "")
                        texts.append(v)
                        places.append((inside, at, no))
            changed = set()
            for a in range(0, len(texts), 1000):
                own = list(zip(leads[a : a + 1000], texts[a : a + 1000], places[a : a + 1000]))
                for (lead, t, (inside, at, no)), spans in zip(own, _spans_in_text([x + y for x, y, _ in own], held[0])):
                    for k, x, y in reversed([z for z in spans if z[1] >= len(lead)]):
                        t = t[: x - len(lead)] + PLACEHOLDER[k] + t[y - len(lead) :]
                        changed.add(no)
                    inside[at] = t
            out = [raw if no not in changed else (v[0] if isinstance(v[0], str) and not raw.lstrip().startswith('"') else json.dumps(v[0], ensure_ascii=False)) for no, (raw, v) in enumerate(zip(s, values))]
            yield pd.Series(out, dtype="object")

    return df.withColumn(column, mask(F.col(column)))
