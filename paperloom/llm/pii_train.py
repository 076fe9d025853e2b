"""Training of the personal information tagger from labelled spans, in numpy.

``python -m paperloom.llm.pii_train FOLDER`` reads at most LABEL_DOCS documents and LABEL_REVIEWS reviews of a data
folder and finds slots of personal data in them by the cues and shapes written below. In COPIES copies of each text every slot is
filled with a value of the generator (``Writer``), which knows nothing of the shapes: other names, hosts, numbering plans,
address orders, line breaks and recognition damage; companies come as counter-examples. The labels of those texts are exact
by construction. Nine tenths of the texts train the network, in windows over all of a text, of which a share BLANK of those
without a span stays; the rest gives precision and recall, also without the exact check. The weights are saved beside this
module. Nothing here runs inside a query.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np

from . import pii
from .pii import _FORMS, _NOT_NAME, KINDS, TAGS, VOCAB, encoded, folded, windows

LABEL_DOCS, LABEL_REVIEWS = 9000, 4000

#: Shapes of slots in the texts the labels come from.
_W = r"(?:[A-ZÀ-Þ][a-zß-ÿ015]+|[A-ZÀ-Þ]{3,})(?:[-¬‐]\s?\n\s?[a-zß-ÿA-Z]+)?"
_GAP = r"(?: {1,3}| ?\n ?)"
_NAME = rf"(?:{_W},{_GAP}{_W}(?:{_GAP}[A-Z]\.)?|(?:{_W}|[A-Z]\.)(?:{_GAP}?[A-Z]\.)?{_GAP}{_W})"
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:[-¬‐]\n[A-Za-z0-9._%+-]+)?"
_AT = r"(?:\s{0,2}@\s{0,2}|\s{0,2}[\[(]\s?at\s?[\])]\s{0,2})"
_DOT = r"(?:\.|\s?[\[(]dot[\])]\s?|\s+dot\s+)"
_HOST = rf"[A-Za-z0-9-]+(?:-?\n[a-z0-9]+)?(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"
_EMAIL = rf"{_LOCAL}{_AT}{_HOST}"
_SEP = r"(?:[ ./-]|-?\n| ?\n)"
_PHONE = rf"(?:(?:\+|00)\d{{1,3}}{_SEP}?)?(?:\(\d{{1,5}}\)[ \n]?)?\d{{2,5}}(?:{_SEP}\d{{2,5}}){{1,4}}|\+\d{{9,14}}|(?:\+|00)\d{{1,3}}{_SEP}\d{{6,12}}|\(\d{{2,5}}\)[ \n]?\d{{3,4}}{_SEP}?\d{{3,5}}|0\d{{8,11}}|\+\d{{1,3}}(?: \(0\))?\d{{1,4}}(?:{_SEP}\d{{2,6}}){{1,3}}"
_ID = r"\d{17}[\dXx]|\d{3}-\n?\d{2}-\n?\d{4}|\d{2}-\n?\d{7}|[A-Z]{2}[ \n]?\d{2}[ \n]\d{2}[ \n]\d{2}[ \n][A-Z]|[A-Z]{2}\d{6}[A-Z]|[A-Z]{1,2}\d{7,8}|\d{9,12}"
#: A number that can be dialled: with its country or area code written as such.
_DIALLED = re.compile(r"[+(0]|\d{3}([-. \n])\d{3}\1\d{4}(?!\d)")
_CITY = rf"{_W}(?:[ \n]{_W})?"
_ZIP = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]?[ \n]?\d[A-Z]{2})"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|FLAT|APT|UNIT|Room)\.?[ \n]#?\d+[A-Za-z]?|#\d+)"
_STREET = rf"(?:No\.?[ \n])?\d{{1,4}}[A-Za-z]?[ \n]{_W}(?:[ \n]{_W}){{0,3}}\.?"
_STREET_LAST = rf"{_W}(?: {_W}){{0,2}}[ \n]\d{{1,4}}[a-z]?"
_TAIL = rf",[ ]?\n?[ ]?{_CITY}(?:,?[ \n](?:[A-Z]{{2}}[ \n])?{_ZIP})|,[ ]?\n?[ ]?(?:[A-Z]-)?{_ZIP}[ \n]{_W}"
_ADDRESS = rf"(?:{_UNIT},[ ]?\n?[ ]?)?(?:P\.?O\.? ?Box[ \n]\d+|Postfach[ \n]\d+|{_STREET}|{_STREET_LAST})(?:,[ ]?\n?[ ]?{_UNIT})?(?:{_TAIL})"
SHAPES = {"name": re.compile(_NAME), "email": re.compile(_EMAIL), "phone": re.compile(_PHONE), "id_number": re.compile(_ID), "address": re.compile(_ADDRESS)}
_COMPANY = _FORMS | set("Foods Optics Dairy Papers Energy Systems Networks Textiles Laboratories Instruments Components Supplies Freight Ceramics Works Print Logistics".split())
EMBED, HIDDEN, EPOCHS, COLUMNS, RATE, COPIES, BLANK = 8, 24, 6, 64, 8e-3, 6, 0.2
#: Share of a gate's slope that counts beyond its straight part, in training only.
LEAK = 0.05

_ID_CUE = re.compile(r"(?:SSN|[Tt]ax id|National no\.|Holder\s+of\s+document|identity\s+number\s+reads|[Rr]egistered\s+under|id_number|passport(?:_no)?|Passport|Steuer-?ID|Steuernummer|Ausweis(?:nummer)?|[Nn]uméro fiscal|ИНН|паспорт|身份证号?|证件号)[ :\n]{0,3}$")
_NAME_CUE = re.compile(
    r"(?:Contact\s+person:|Attn:|Signed,|Prepared\s+by|Mrs?\.?|Ms\.?|Dr\.?|Herr|Frau|Cardholder|(?:^|[.!?\s])As|spoke\s+with|handed\s+to|suivi\s+par|Sachbearbeitung:|Registrar:?|name:|Исполнитель:?|Контакт:?|联系人：?:?|经办人：?:?|Ansprechpartner:?|Responsable\s*:?)[ \n]{0,3}(?:(?:Ms|Mr|Mrs|Dr)\.?[ \n])?$"
)


class Writer:
    """Values of every kind in the ways people write them."""

    HEAD = "bra dor fen gal har jes kil lor mar nor pel quen ros sil tar und ver wil yor zan ach bel cor dun el fro".split()
    MID = "a e i o u an el in or ul".split()
    TAIL = "bury dell ford gate ham hurst ley mere mond ner ness rick sen son stad ton vall wick worth berg".split()
    GIVEN = "Aaron Adele Agnes Albert Alma Amir Anders Anton Astrid Aylin Bela Bianca Boris Carmen Cedric Chiara Colin Dana Darius Delia Dmitri Doris Edgar Elif Emil Enzo Erika Fatima Felix Fiona Frieda Gerda Gianni Greta Hamza Hanna Hector Hilda Ida Igor Ilse Imran Irene Ivan Jamal Jana Jarek Jonas Julia Kai Karim Katja Kurt Lara Leif Lena Leo Lidia Luca Magda Marco Maren Mats Mehmet Mila Nadia Nico Nina Noor Olaf Olga Omar Otto Paula Pavel Petra Rafael Rita Robin Rosa Ruben Samira Sara Sergei Silke Simon Sofia Stefan Tamara Theo Tilda Tobias Ulla Vera Viktor Wanda Xenia Yann Yusuf Zoe".split()
    STREETS = "Street St Str. Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Dr Court Ct Square Sq Way Terrace Place Parkway Hill".split()

    def __init__(self, r):
        self.r = r

    def one(self, x):
        return x[self.r.integers(len(x))]

    def digits(self, n, lead=None):
        return (str(self.one(lead)) if lead else str(self.r.integers(10))) + "".join(str(x) for x in self.r.integers(0, 10, n - 1))

    def surname(self):
        w = self.one(self.HEAD) + (self.one(self.MID) if self.r.random() < 0.5 else "") + self.one(self.TAIL)
        return w.capitalize()

    def gap(self):
        return "\n" if self.r.random() < 0.12 else " "

    def damaged(self, value):
        """Sometimes capitals, a letter read as a digit, or a word broken at a line end."""
        u = self.r.random()
        if u < 0.05:
            return value.upper()
        if u < 0.09:
            k = int(self.r.integers(len(value)))
            return value[:k] + {"o": "0", "l": "1", "i": "1", "s": "5"}.get(value[k], value[k]) + value[k + 1 :]
        if u < 0.12:
            words = [m for m in re.finditer(r"[a-z]{4,}", value)]
            if words:
                m = self.one(words)
                return value[: m.start() + 2] + "-\n" + value[m.start() + 2 :]
        return value

    def name(self):
        g, s, g1, g2 = self.one(self.GIVEN), self.surname(), self.gap(), self.gap()
        i = f"{self.one('ABCDEFGHJKLMNOPRSTVW')}."
        return self.damaged(self.one([f"{g}{g1}{s}", f"{g}{g1}{s}", f"{g}{g1}{s}", f"{g}{g1}{i}{g2}{s}", f"{i}{g1}{s}", f"{s},{g1}{g}", f"{s}, {g} {i}"]))

    def company(self):
        return f"{self.surname()} {self.one('Foods Optics Papers Energy Systems Textiles Laboratories Freight Trading Holding Motors Pharma Steel Media'.split())} {self.one('Ltd LLC Inc GmbH Oy AG plc'.split())}"

    def email(self):
        a, b = self.one(self.GIVEN).lower(), self.surname().lower()
        local = self.one([f"{a}.{b}", f"{a}{self.digits(2)}", f"{a[0]}.{b}", f"{a}_{b}", f"{a}+{self.one(['hr', 'news', 'tax'])}", b, f"{b}.{a[0]}", f"{a}-{b}"])
        host = self.surname().lower() + self.one(["", "", "-mail", "post"]) + self.one([".example", ".test", ".com", ".org", ".net", ".co.uk", ".de", ".invalid"])
        if self.r.random() < 0.15:
            host = self.one(["mail.", "eu."]) + host
        at = self.one(["@"] * 8 + [" @ ", " [at] ", "(at)", "[at]", "\n@"])
        if self.r.random() < 0.06:
            host = host.replace(".", self.one([" dot ", " [dot] ", "[dot]"]))
        return local + at + host

    def phone(self):
        d, s = self.digits, self.one([" ", "-", ".", " "])
        return self.one([
            f"+{self.one([1, 44, 49, 33, 7, 86, 39])}{s}{d(3, '23456789')}{s}{d(3)}{s}{d(4)}", f"+1{d(10, '23456789')}", f"({d(3, '23456789')}) {d(3)}-{d(4)}", f"{d(3, '23456789')}-{d(3)}-{d(4)}", f"{d(3, '23456789')}.{d(3)}.{d(4)}",
            f"+44 20 {d(4)} {d(4)}", f"0044-20-{d(4)}-{d(4)}", f"020 {d(4)} {d(4)}", f"+49 (0){d(2, '3456789')} {d(5)} {d(3)}", f"+49 {d(2, '3456789')} {d(7)}", f"0{d(3, '123')} {d(7)}", f"0{d(2, '23')}/{d(7)}", f"+33 {d(1, '1234')} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"+86 1{d(2)} {d(4)} {d(4)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}", f"{d(3, '23456789')}-{d(3)}-\n{d(4)}", f"+44 20\n{d(4)} {d(4)}",
        ])

    def id_number(self):
        d, a = self.digits, lambda n: "".join(self.one("ABCDEFGHJKLMNPRSTXYZ") for _ in range(n))
        return self.one([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)}-{d(7)}", f"{d(2)}-{d(7)}", d(9), d(10), d(11), d(12), d(17) + self.one(["X", d(1)]), f"{a(1)}{d(8)}", f"{a(2)}{d(7)}", f"{a(2)} {d(2)} {d(2)} {d(2)} {a(1)}", f"{a(2)}{d(6)}{a(1)}", f"{d(3)}-\n{d(2)}-{d(4)}", f"{a(2)}{d(8)}"])

    def address(self):
        d, g = self.digits, self.gap
        town, post = self.surname(), self.one([d(5), d(5), f"{d(5)}-{d(4)}", f"{self.one(['HF', 'WR', 'ZX', 'LM'])}{d(1, '123456789')} {d(1)}{self.one(['QV', 'AB', 'TR'])}", f"{self.one(['HF', 'WR', 'LM', 'NY'])} {d(5)}"])
        street = f"{d(int(self.r.integers(1, 4)), '123456789')}{self.one([''] * 9 + ['a', 'B'])} {self.surname()}{self.one(['', '', ' ' + self.one(['Hill', 'Park', 'Green', 'Grove'])])} {self.one(self.STREETS)}"
        unit = self.one(["Flat", "Apt", "Unit", "Suite", "Apartment"]) + " " + self.one(["", "", "#"]) + d(int(self.r.integers(1, 3)), "123456789")
        u = self.r.random()
        if u < 0.12:
            street = f"{self.one(['P.O. Box', 'PO Box', 'Postfach'])} {d(int(self.r.integers(2, 5)), '123456789')}"
        elif u < 0.24:
            street = f"{self.surname()}{self.one(['weg', 'strasse', 'straße', 'allee', 'platz'])} {d(int(self.r.integers(1, 4)), '123456789')}"
            return f"{street},{g()}{self.one(['', '', 'D-'])}{d(5)} {town}"
        elif u < 0.36:
            street = f"{street}, {unit}"
        elif u < 0.48:
            street = f"{unit},{g()}{street}"
        return self.damaged(f"{street},{g()}{town}{self.one([',', ''])}{g()}{post}")

    def refilled(self, text, spans):
        """The text with other values in its slots, and the spans of those."""
        out, new, last = [], [], 0
        size = 0
        for kind, a, b in spans:
            value = getattr(self, kind)()
            out += [text[last:a], value]
            size += a - last
            new.append((kind, size, size + len(value)))
            size += len(value)
            last = b
        tail = text[last:]
        if self.r.random() < 0.2:
            tail += self.one([" ", "\n", " Payment from ", " The supplier "]) + self.company() + self.one([" confirmed receipt.", ".", " agreed."])
        return "".join(out) + tail, new


def checked(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The exact ends of a decoded span, or None where its text has not the shape of its kind."""
    lo, hi = max(0, a - 48), min(len(text), b + 48)
    best = None
    while lo > 0 and text[lo - 1].isalnum() and a - lo < 64:
        lo -= 1
    for m in SHAPES[kind].finditer(text, lo, hi):
        s, e = m.span()
        if s >= b:
            break
        if e <= a:
            continue
        if kind == "name":
            s, e = _trim_name(text, s, e, a, b)
            if s is None:
                continue
        elif kind in ("phone", "id_number"):
            if s and (text[s - 1].isalnum() or text[s - 1] in "#" or text[s - 1] == "-" and kind == "id_number") or e < len(text) and (text[e].isalnum() or text[e] == "-" and e + 1 < len(text) and text[e + 1].isdigit()):
                continue
            n = sum(c.isdigit() for c in text[s:e])
            if kind == "phone" and (not 9 <= n <= 15 or not _DIALLED.match(text, s, e)):
                continue
        elif kind == "email":
            if text[s : s + 7].lower() == "mailto:":
                s += 7
            while e > s and not text[e - 1].isalnum():
                e -= 1
        overlap = min(e, b) - max(s, a)
        if overlap > 0 and (best is None or overlap > best[0] and not (kind == "name" and 2 * best[0] >= b - a)):
            best = (overlap, s, e)
    return best and best[1:]


_LEAD = re.compile(rf"({_W}|[A-Z]\.)(,?)({_GAP})?")


def _trim_name(text: str, s: int, e: int, a: int, b: int):
    """A matched name without titles and cues at its head, extended to a middle initial or surname it lacks."""
    while True:
        m = _LEAD.match(text, s, e)
        if not m or m[1].rstrip(".").capitalize() not in _NOT_NAME:
            break
        s = m.end()
        again = SHAPES["name"].match(text, s, min(len(text), b + 60))
        if not again:
            return None, None
        e = again.end()
    words = re.findall(_W, text[s:e])
    behind = re.match(rf"[ ]({_W})", text[e : e + 40])
    if any(w.capitalize() in _NOT_NAME for w in words) or behind and behind[1].capitalize() in _COMPANY:
        return None, None
    return s, e


def first_names(texts: list[str]) -> set[str]:
    """Given names seen in both orders behind a cue."""
    seen: dict[str, int] = {}
    for t in texts:
        for m in SHAPES["name"].finditer(t):
            if _NAME_CUE.search(t[max(0, m.start() - 30) : m.start()]):
                w = re.findall(_W, m[0])
                if len(w) == 2:
                    first = w[1] if "," in m[0] else w[0]
                    seen[first.capitalize()] = seen.get(first.capitalize(), 0) + 1
    return {k for k, n in seen.items() if n >= 4}


def labelled(text: str, given: set[str]) -> list[tuple[str, int, int]]:
    """Labelled spans of a folded text."""
    out = []
    for kind in ("email", "address", "id_number", "phone", "name"):
        for m in SHAPES[kind].finditer(text):
            a, b = m.span()
            if any(a < y and x < b for _, x, y in out):
                continue
            before = text[max(0, a - 30) : a]
            if kind == "id_number":
                if not _ID_CUE.search(before):
                    continue
            elif kind == "phone":
                s = m[0]
                if not (s[0] in "+(" or s.startswith("0") or re.fullmatch(r"\d{3}([-. \n])\d{3}\1\d{4}", s)) or not 9 <= sum(c.isdigit() for c in s) <= 15 or re.match(r"\d\d[./-]\d\d[./-]\d{4}", s):
                    continue
                if a and (text[a - 1].isalnum() or text[a - 1] in "-#"):
                    continue
            if kind in ("email", "id_number", "phone", "address"):
                got = checked(kind, text, a, b)
                if not got:
                    continue
                a, b = got
            if kind == "name":
                a, b = _trim_name(text, a, b, a, b)
                if a is None:
                    continue
                words = re.findall(_W, text[a:b])
                cue = _NAME_CUE.search(text[max(0, a - 30) : a])
                known = any(w.capitalize() in given for w in words)
                block = any(k == "address" and 0 < x - b <= 2 for k, x, _ in out)
                if not (known or cue or block):
                    continue
            if not any(a < y and x < b for _, x, y in out):
                out.append((kind, a, b))
    return sorted(out, key=lambda x: x[1])


def tag_array(text: str, spans) -> np.ndarray:
    y = np.zeros(len(text), np.int8)
    for kind, a, b in spans:
        i = KINDS.index(kind)
        y[a:b] = 2 + 2 * i
        y[a] = 1 + 2 * i
    return y


class Net:
    """Forward and backward passes, of the cell of ``pii.Tagger``."""

    def __init__(self, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        k, self.n = len(TAGS), hidden
        self.p = {"emb": g(VOCAB, embed), "wo": g(2 * hidden, k), "bo": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32), "start": np.zeros(k, np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": g(embed, 3 * hidden), f"wh{d}": g(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}
            self.p[f"b{d}"][:hidden] = 1.0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.step = 0

    def lstm(self, x, d):
        t, b = x.shape
        n, wh = self.n, self.p[f"wh{d}"]
        given = (self.p["emb"] @ self.p[f"wx{d}"] + self.p[f"b{d}"])[x]
        on = (x > 0).astype(np.float32)[:, :, None]
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        h0, c0, c1, h1 = (np.empty((t, b, n), np.float32) for _ in range(4))
        gates = np.empty((t, b, 3 * n), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            h0[i], c0[i] = h, c
            g = gates[i]
            np.matmul(h, wh, out=g)
            g += given[i]
            g[:, : 2 * n] *= 0.25
            g[:, : 2 * n] += 0.5
            np.clip(g[:, : 2 * n], 0, 1, out=g[:, : 2 * n])
            u = np.clip(g[:, 2 * n :], -1, 1, out=g[:, 2 * n :])
            c = (u + g[:, :n] * (c - u)) * on[i]
            h = g[:, n : 2 * n] * c
            c1[i], h1[i] = c, h
        return h1, (h0, c0, c1, gates, on)

    def lstm_back(self, x, d, kept, dout, grad):
        t, b = x.shape
        n, wt = self.n, np.ascontiguousarray(self.p[f"wh{d}"].T)
        h0, c0, c1, gates, on = kept
        # beyond the edges a part of the slope is let through, or a unit once there would learn no more
        slope = np.empty_like(gates)
        s, u = gates[:, :, : 2 * n], gates[:, :, 2 * n :]
        slope[:, :, : 2 * n] = np.where((s > 0) & (s < 1), 0.25, 0.25 * LEAK)
        slope[:, :, 2 * n :] = np.where(np.abs(u) < 1, 1.0, LEAK)
        dg = np.empty_like(gates)
        dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        for i in range(t - 1, -1, -1) if d == "f" else range(t):
            g, o = gates[i], dg[i]
            dh = dh + dout[i]
            dc = (dc + dh * g[:, n : 2 * n]) * on[i]
            np.multiply(dc, c0[i] - g[:, 2 * n :], out=o[:, :n])
            np.multiply(dh, c1[i], out=o[:, n : 2 * n])
            np.multiply(dc, 1 - g[:, :n], out=o[:, 2 * n :])
            o *= slope[i]
            dh = o @ wt
            dc = dc * g[:, :n]
        flat = dg.reshape(t * b, 3 * n)
        which = np.zeros((VOCAB, t * b), np.float32)
        which[x.reshape(-1), np.arange(t * b)] = 1
        dtable = which @ flat
        grad[f"wh{d}"] += h0.reshape(t * b, n).T @ flat
        grad[f"b{d}"] += dtable.sum(0)
        grad[f"wx{d}"] += self.p["emb"].T @ dtable
        grad["emb"] += dtable @ self.p[f"wx{d}"].T

    def train(self, x, y, rate):
        p, n = self.p, self.n
        hf, kf = self.lstm(x, "f")
        hb, kb = self.lstm(x, "b")
        h = np.concatenate([hf, hb], 2)
        e = h @ p["wo"] + p["bo"]
        t, b, k = e.shape
        # forward and backward sums of the tag sequences, each step brought to the sum 1
        top = e.max(2, keepdims=True)
        w, a = np.exp(e - top), np.exp(p["trans"])
        alpha, beta, size = np.empty_like(e), np.ones_like(e), np.empty((t, b, 1), np.float32)
        for i in range(t):
            now = w[i] * (alpha[i - 1] @ a if i else np.exp(p["start"]))
            size[i] = now.sum(1, keepdims=True)
            alpha[i] = now / size[i]
        for i in range(t - 2, -1, -1):
            beta[i] = (w[i + 1] * beta[i + 1] / size[i + 1]) @ a.T
        grad = {q: np.zeros_like(v) for q, v in p.items()}
        rows, tt = np.arange(b)[None], np.arange(t)[:, None]
        de = alpha * beta
        grad["start"] += de[0].sum(0) - np.bincount(y[0], minlength=k)
        grad["trans"] += a * np.tensordot(alpha[:-1], w[1:] * beta[1:] / size[1:], ([0, 1], [0, 1]))
        np.subtract.at(grad["trans"], (y[:-1].ravel(), y[1:].ravel()), 1)
        z = (np.log(size) + top).sum((0, 2))
        gold = p["start"][y[0]] + e[tt, rows, y].sum(0) + p["trans"][y[:-1], y[1:]].sum(0)
        de[tt, rows, y] -= 1
        grad["wo"] += np.tensordot(h, de, ([0, 1], [0, 1]))
        grad["bo"] += de.sum((0, 1))
        dh = de @ p["wo"].T
        self.lstm_back(x, "f", kf, dh[:, :, :n], grad)
        self.lstm_back(x, "b", kb, dh[:, :, n:], grad)
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values())) / b
        scale = min(1.0, 5.0 / max(norm, 1e-9)) / b
        for q, g in grad.items():
            g = g * scale
            self.m[q] = 0.9 * self.m[q] + 0.1 * g
            self.v[q] = 0.999 * self.v[q] + 0.001 * g * g
            p[q] -= rate * (self.m[q] / (1 - 0.9**self.step)) / (np.sqrt(self.v[q] / (1 - 0.999**self.step)) + 1e-8)
        return float((z - gold).mean())


def review_strings(payload: str | None) -> list[tuple[str, str]]:
    """(key, string) of every string in a review payload."""
    try:
        value = json.loads(payload) if payload else None
    except ValueError:
        return []
    out, todo = [], [("", value)]
    while todo:
        k, v = todo.pop()
        if isinstance(v, dict):
            todo += list(v.items())
        elif isinstance(v, list):
            todo += [(k, x) for x in v]
        elif isinstance(v, str) and v:
            out.append((k, v))
    return out


def examples(folder: str):
    """Windows (character numbers, tags) to learn from, and the held-out texts with their spans and refilled."""
    import pandas as pd

    docs = pd.read_parquet(f"{folder}/documents.parquet", columns=["text"]).text.drop_duplicates().head(LABEL_DOCS)
    reviews = pd.read_parquet(f"{folder}/hitl_reviews.parquet", columns=["payload"]).payload.dropna().head(LABEL_REVIEWS)
    texts = [folded(t)[0] for t in docs if t] + [folded(f"{k}: {v}")[0] for p in reviews for k, v in review_strings(p)]
    given = first_names(texts)
    print(len(texts), "texts,", sorted(given))
    spans = [labelled(t, given) for t in texts]
    r = np.random.default_rng(3)
    writer = Writer(r)
    test = r.random(len(texts)) < 0.1
    rows = []
    for t, own, held in zip(texts, spans, test):
        if held:
            continue
        for copy in range(1 + COPIES if own else 1):
            text, at = writer.refilled(t, own) if copy else (t, own)
            codes, y = encoded(text), tag_array(text, at)
            for _, _, a, b in windows([[(0, len(text))] if text else []]):
                # a copy differs in the windows of its values only; of the blank ones of a text a part stays
                if y[a:b].any() or not copy and r.random() < BLANK:
                    rows.append((codes[a:b], y[a:b]))
    print(len(rows), "windows", sum(bool(y.any()) for _, y in rows), "with spans", flush=True)
    held = [(texts[i], spans[i]) for i in np.flatnonzero(test)]
    return rows, held, [writer.refilled(*x) for x in held]


def trained(rows, hidden: int = HIDDEN, embed: int = EMBED, epochs: float = EPOCHS, seed: int = 7, path: str = pii.MODEL, rate: float = RATE) -> None:
    """The weights after ``epochs`` passes at a rate that falls to nothing, saved after each."""
    net, r = Net(hidden, embed, seed), np.random.default_rng(seed)
    rows = sorted(rows, key=lambda x: len(x[0]))
    groups = [rows[i : i + COLUMNS] for i in range(0, len(rows), COLUMNS)]
    total = int(epochs * len(groups))
    loss: list[float] = []
    while net.step < total:
        for gi in r.permutation(len(groups))[: total - net.step]:
            g = groups[gi]
            t = max(len(x) for x, _ in g)
            x, y = np.zeros((t, len(g)), np.int16), np.zeros((t, len(g)), np.int64)
            for c, (a, b) in enumerate(g):
                x[: len(a), c], y[: len(b), c] = a, b
            part = net.step / total
            loss.append(net.train(x, y, rate * min(1.0, 1.25 * (1 - part)) + 1e-5))
        print(path, "passes", round(net.step / len(groups), 2), "loss", np.mean(loss[-len(groups) :]), flush=True)
        np.savez_compressed(path, **{k: v.astype(np.float32) for k, v in net.p.items()})


def report(held, refilled, path: str = pii.MODEL, show: bool = True) -> None:
    """Precision and recall on held-out texts, as written and refilled."""
    tagger = pii.Tagger.load(path)
    for title, some in (("as written", held), ("refilled", refilled)):
        for check in (False, True):
            got = pii.spans_of([t for t, _ in some], tagger, check)
            for kind in KINDS:
                a = {(i, x[1], x[2]) for i, s in enumerate(got) for x in s if x[0] == kind}
                b = {(i, x[1], x[2]) for i, (_, s) in enumerate(some) for x in s if x[0] == kind}
                print(title, "with check" if check else "network alone", kind, "precision", round(len(a & b) / max(1, len(a)), 4), "recall", round(len(a & b) / max(1, len(b)), 4), len(b))
                for word, rest in (("   more:", a - b), ("   less:", b - a)) if check and show else ():
                    for i, x, y in list(rest)[:6]:
                        print(word, repr(some[i][0][max(0, x - 25) : x]), repr(some[i][0][x:y]), repr(some[i][0][y : y + 10]))


def main(folder: str) -> None:
    rows, held, refilled = examples(folder)
    trained(rows)
    report(held, refilled)


if __name__ == "__main__":
    main(sys.argv[1])
