"""Held-out passages inside training text, found by the q-gram lemma and verified by banded alignment.

Texts are folded into a stream of letters and digits (case, spacing, punctuation, line breaks, character forms and the
usual recognition confusions fall together). A document carries an item if some ``min_words`` consecutive item words (the
whole item, where it has fewer) stand in it with at most k = budget * m of their m characters edited, wherever the edits lie.

Two forms of the lemma filter before the alignment, both without loss. Of the disjoint q-grams of the item (every q-th
place) an edit destroys one at most, so of the s that lie in the passage s - k are shared; all of them lie within k
neighbouring diagonals, so they are counted in overlapping diagonal bands that are at least twice as wide, and then within
each passage. Of all overlapping q-grams an edit destroys q at most, so a passage also shares m - q + 1 - k * q of them
with the region; with q = REGION_Q = 3 and a budget of 0.08 that is three quarters of them. What meets both bounds is aligned.

The held-out items are the stated side: their index is built once on the driver and sent to the tasks in parts of at most
ITEM_BOUND characters, one pass over the documents for each part. Documents stream through in blocks, with no shuffle
before the result.

Defined results: null, empty and shorter texts carry nothing; items of fewer than ``min_words`` words must be carried
whole, those of fewer than q folded characters without an edit; repeated documents are each reported; an empty table on
either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import CYRILLIC, GREEK

Q, MIN_WORDS, BUDGET = 6, 25, 0.08
#: Characters of the items that are searched for in one pass, at most.
ITEM_BOUND = 64_000_000
#: Cells of bands that are counted in an array; more of them are sorted.
CELLS = 1 << 23
#: q of the overlapping q-grams that a passage has to share with its region.
REGION_Q, CODE_BITS = 3, 12
#: Recognition confusions that fall together (fixed values): sequences first, then single characters.
_SEQUENCES = ((b"rn", b"m"), (b"ri", b"n"), (b"vv", b"w"), (b"ii", b"u"), (b"cl", b"d"))
_SINGLE = dict(zip(b"015i8etqh", b"olslbcfgb"))
_TABLE = bytes(_SINGLE.get(b, b) for b in range(256))
_DROP = bytes(b for b in range(256) if not chr(b).isalnum() or b > 127)
_ALIKE = {ord(k): v for k, v in {**CYRILLIC, **GREEK}.items()}
_BASE = np.uint64(0x9E3779B97F4A7C15)


_BEYOND = re.compile(r"[^\x00-\x7f]+")


def _plain(m: re.Match) -> str:
    return _plain_run(m[0])


@functools.lru_cache(1 << 16)
def _plain_run(run: str) -> str:
    """What characters beyond ASCII stand for, as far as that is ASCII."""
    return unicodedata.normalize("NFKD", run.translate(_ALIKE)).encode("ascii", "ignore").decode()


def _letters(text: str) -> bytes:
    if not text.isascii():
        text = _BEYOND.sub(_plain, text)
    return text.lower().encode("ascii", "ignore").translate(None, _DROP)


def fold(text: str) -> bytes:
    """The comparable stream of a text."""
    s = _letters(text)
    for a, b in _SEQUENCES:
        s = s.replace(a, b)
    return s.translate(_TABLE)


def word_offsets(words: list[str]) -> np.ndarray:
    """Places in the folded text at which its words start, and its end. A sequence folded across two words belongs to the first."""
    s = _letters(" ".join(words))
    off = np.concatenate([[0], np.cumsum([len(_letters(w)) for w in words])])
    for a, b in _SEQUENCES:
        off = off - np.searchsorted([m.start() for m in re.finditer(a, s)], off)
        s = s.replace(a, b)
    return off


def gram_hashes(stream: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of a byte stream."""
    n = len(stream) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    wide = stream.astype(np.uint64)
    for j in range(q):
        h *= _BASE
        h += wide[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def within_edits(a: bytes, b: bytes, budget: int) -> bool:
    """Whether ``a`` is within ``budget`` edits of some part of ``b``: the alignment over the band that ``b`` is, its ends free, a column
    of the table at a time in the bits of one number."""
    rows: dict[int, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << len(a) - 1 if a else 0
    up, down, cost = whole, 0, len(a)
    if cost <= budget:
        return True
    for c in b:
        equal = rows.get(c, 0)
        level = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more = down | ~(across | up) & whole
        less = up & across
        if more & top:
            cost += 1
        elif less & top:
            cost -= 1
            if cost <= budget:
                return True
        more, less = more << 1 & whole, less << 1 & whole
        up = less | ~(level | more) & whole
        down = more & level
    return False


class ItemIndex:
    """The disjoint q-grams of all items by hash, and the passages of each item with the edits they may have."""

    def __init__(self, items: list[tuple[object, str]], q: int = Q, min_words: int = MIN_WORDS, budget: float = BUDGET):
        self.q = q
        self.keys: list = []
        self.streams: list[bytes] = []
        self.passages: list[np.ndarray] = []  # from, to, edits, shared disjoint q-grams at least
        self.short: list[tuple[object, bytes]] = []
        hashes, owner, place = [], [], []
        for key, text in items:
            words = [w for w in (text or "").split() if _letters(w)]
            whole = fold(" ".join(words))
            if not whole:
                continue
            if len(whole) < q:
                self.short.append((key, whole))
                continue
            off = word_offsets(words)
            w = min(min_words, len(off) - 1)
            start, end = off[: len(off) - w], off[w:]
            grams = (end - q) // q - (start + q - 1) // q + 1
            edits = np.minimum((budget * (end - start)).astype(np.int64), np.maximum(grams - 1, 0))
            ok = end - start >= q
            no = len(self.keys)
            self.keys.append(key)
            self.streams.append(whole)
            self.passages.append(np.stack([start, end, edits, np.maximum(grams - edits, 1)])[:, ok])
            places = np.arange(0, len(whole) - q + 1, q, dtype=np.int32)
            hashes.append(gram_hashes(np.frombuffer(whole, np.uint8), q)[places])
            owner.append(np.full(len(places), no, np.int32))
            place.append(places)
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.owner, self.place = cat(owner, np.int32)[order], cat(place, np.int32)[order]
        self.unique, first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.first = first.astype(np.int64)
        self.need = np.array([p[3].min() if p.shape[1] else 1 for p in self.passages], np.int64)
        self.longest = np.array([(p[1] - p[0]).max() if p.shape[1] else 0 for p in self.passages], np.int64)
        self.half = np.array([p[2].max() + 1 if p.shape[1] else 1 for p in self.passages], np.int64)
        # passages and region q-grams of all items behind one another, for the test of many bands at once
        self.at = np.concatenate([[0], np.cumsum([len(x) + q for x in self.streams])]).astype(np.int64)
        self.codes = _region_codes(bytes(q).join(self.streams) + bytes(q))
        self.lengths = np.array([len(x) for x in self.streams], np.int64)
        self.many = np.concatenate([[0], np.cumsum([p.shape[1] for p in self.passages])]).astype(np.int64)
        self.every = np.concatenate(self.passages, axis=1) if self.passages else np.zeros((4, 0), np.int64)
        # slot of a hash by its low bits; -1 none, -2 several
        bits = max(16, min(22, int(np.log2(max(1, len(self.unique)))) + 5))
        self.mask = np.uint64((1 << bits) - 1)
        low = (self.unique & self.mask).astype(np.int64)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.slots[low] = np.arange(len(low), dtype=np.int32)
        self.slots[np.flatnonzero(np.bincount(low, minlength=1 << bits) > 1) if len(low) else low] = -2

    def search(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text number, item number) of the items the texts carry."""
        q = self.q
        if not len(self.unique) or not texts:
            return []
        starts = np.concatenate([[0], np.cumsum([len(t) + q for t in texts])])
        stream = np.frombuffer(bytes(q).join(texts) + bytes(q), np.uint8)
        h = gram_hashes(stream, q)
        slot = self.slots[(h & self.mask).astype(np.int64)]
        several = np.flatnonzero(slot == -2)
        if len(several):
            slot[several] = np.minimum(np.searchsorted(self.unique, h[several]), len(self.unique) - 1)
        at = np.flatnonzero(slot >= 0)
        slot = slot[at]
        hit = self.unique[slot] == h[at]
        at, slot = at[hit], slot[hit]
        if not len(at):
            return []
        n = self.count[slot]
        rep = np.repeat(np.arange(len(at), dtype=np.int32), n)
        entry = np.repeat((self.first[slot] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(len(rep), dtype=np.int32)
        doc = np.searchsorted(starts, at, side="right") - 1
        items = len(self.keys)
        small = np.int32 if len(texts) * items < 1 << 31 else np.int64
        pair = (doc * items).astype(small)[rep] + self.owner[entry]
        # a band holds no more than its document and item share at all
        if len(texts) * items <= CELLS:
            enough = np.bincount(pair, minlength=len(texts) * items) >= np.tile(self.need, len(texts))
            live = np.flatnonzero(enough[pair])
            pair, rep, entry = pair[live], rep[live], entry[live]
            number = np.cumsum(enough, dtype=np.int64)[pair] - 1
            numbers = int(enough.sum())
        else:
            kinds, number = np.unique(pair, return_inverse=True)
            numbers = len(kinds)
        if not len(pair):
            return []
        item, place = self.owner[entry], self.place[entry]
        local = (at - starts[doc])[rep]
        shift = local - place + int(max(map(len, self.streams)))
        width = 2 * self.half[item]
        bands = int(shift.max(initial=0)) // int(2 * self.half.min()) + 2
        codes: np.ndarray | None = None
        found: set[tuple[int, int]] = set()
        failed: set[tuple[int, int, int, int]] = set()
        for step in (0, 1):  # overlapping bands: k neighbouring diagonals lie within one of the two
            cell = number * bands + (shift + step * (width // 2)) // width
            live = np.flatnonzero(_often(cell, numbers * bands) >= self.need[item])
            order = live[np.lexsort((local[live], place[live], cell[live]))]
            if not len(order):
                continue
            # enough of them within the length of the longest passage
            ahead = np.arange(len(order)) + self.need[item[order]] - 1
            inside = np.minimum(ahead, len(order) - 1)
            close = (ahead < len(order)) & (cell[order[inside]] == cell[order]) & (place[order[inside]] - place[order] <= self.longest[item[order]] - q)
            lo = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1])
            hi = np.append(lo[1:], len(order))
            kept = np.flatnonzero(np.maximum.reduceat(close, lo))
            if not len(kept):
                continue
            turn = local[order] - place[order]
            ranges = place[order[lo]], place[order[hi - 1]] + q, np.minimum.reduceat(turn, lo), np.maximum.reduceat(turn, lo)
            codes = _region_codes(stream) if codes is None else codes
            head = pair[order[lo]]
            band, window = self._similar(head[kept] // items, head[kept] % items, *(x[kept] for x in ranges), codes, starts)
            cuts = np.flatnonzero(np.diff(band)) + 1
            for g, windows in zip(band[np.concatenate([[0], cuts])] if len(band) else (), np.split(window, cuts)):
                own = order[lo[kept[g]] : hi[kept[g]]]
                d, i = divmod(int(pair[own[0]]), items)
                same = int(pair[own[0]]), len(own), int(own[0]), int(own[-1])
                if (d, i) in found or same in failed:
                    continue
                if self._carried(i, texts[d], place[own], local[own], windows):
                    found.add((d, i))
                else:
                    failed.add(same)  # the same shared q-grams come in both bands
        return sorted(found)

    def _similar(self, doc, item, first, last, low, high, codes, starts) -> tuple[np.ndarray, np.ndarray]:
        """(band, passage) of the passages of each band that share enough of its overlapping q-grams with the region, counted over all bands at once.

        A band is a document, an item, the item places from ``first`` to ``last`` and the shifts from ``low`` to ``high``. Q-grams are
        compared by CODE_BITS of a hash, so the count is never too small and no band is lost.
        """
        bands, windows = [], []
        for at in range(0, len(doc), 256):
            g = slice(at, at + 256)
            i, n = item[g].astype(np.int64), len(item[g])
            a = np.maximum(0, first[g] - self.longest[i])
            b = np.minimum(self.lengths[i], last[g] + self.longest[i])
            size = starts[doc[g] + 1] - starts[doc[g]] - self.q
            lo, hi = np.maximum(0, a + low[g] - self.half[i]), np.minimum(size, b + high[g] + self.half[i])
            here = np.zeros((n, 1 << CODE_BITS), bool)
            row, within = _ragged(np.maximum(hi - lo - REGION_Q + 1, 0))
            here[row, codes[(starts[doc[g]] + lo)[row] + within]] = True
            wide = np.maximum(b - a - REGION_Q + 1, 0)
            row, within = _ragged(wide)
            sums = np.concatenate([[0], np.cumsum(here[row, self.codes[(self.at[i] + a)[row] + within]])])
            base = np.concatenate([[0], np.cumsum(wide)])[:-1]
            row, within = _ragged(self.many[i + 1] - self.many[i])
            start, end, edits, _ = self.every[:, self.many[i][row] + within]
            ok = np.flatnonzero((start >= a[row]) & (end <= b[row]))
            row, within, start, end, edits = row[ok], within[ok], start[ok], end[ok], edits[ok]
            from_, to = base[row] + start - a[row], base[row] + end - REGION_Q + 1 - a[row]
            ok = sums[to] - sums[from_] >= end - start - REGION_Q + 1 - REGION_Q * edits
            bands.append(at + row[ok])
            windows.append(within[ok])
        return np.concatenate(bands), np.concatenate(windows)

    def _carried(self, i: int, text: bytes, place: np.ndarray, local: np.ndarray, windows: np.ndarray) -> bool:
        """Whether a passage of item ``i`` meets both bounds in a band with the shared q-grams (place, local) and is aligned."""
        q, r, item = self.q, REGION_Q, self.streams[i]
        start, end, edits, need = self.passages[i]
        kinds = np.flatnonzero(np.diff(place, prepend=-1))  # each place counts once
        places = place if len(kinds) == len(place) else place[kinds]
        shared = np.searchsorted(places, end - q, side="right") - np.searchsorted(places, start, side="left")
        over = (shared - need)[windows]
        for w in windows[np.argsort(-over, kind="stable")[: int((over >= 0).sum())]]:
            a, b, k = int(start[w]), int(end[w]), int(edits[w])
            inside = (place >= a) & (place <= b - q)
            shift = local[inside] - place[inside]
            lo, hi = max(0, a + int(shift.min()) - k), min(len(text), b + int(shift.max()) + k)
            region = text[lo:hi]
            here = {region[x : x + r] for x in range(len(region) - r + 1)}
            if sum(item[x : x + r] in here for x in range(a, b - r + 1)) < b - a - r + 1 - k * r:
                continue
            if within_edits(item[a:b], region, k):
                return True
        return False


def _region_codes(stream: bytes | np.ndarray) -> np.ndarray:
    """CODE_BITS of a hash of each overlapping q-gram of a stream."""
    wide = np.frombuffer(stream, np.uint8).astype(np.uint32) if isinstance(stream, bytes) else stream.astype(np.uint32)
    h = np.zeros(max(0, len(wide) - REGION_Q + 1), np.uint32)
    for j in range(REGION_Q):
        h *= np.uint32(2654435761)
        h += wide[j : j + len(h)]
    h *= np.uint32(2246822519)
    return (h >> np.uint32(32 - CODE_BITS)).astype(np.int64)


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of rows of the given sizes."""
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _often(code: np.ndarray, cells: int) -> np.ndarray:
    """For each code, how often it occurs."""
    if cells <= CELLS:
        return np.bincount(code, minlength=1)[code]
    _, back, n = np.unique(code, return_inverse=True, return_counts=True)
    return n[back]


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", q: int = Q, min_words: int = MIN_WORDS, budget: float = BUDGET) -> DataFrame:
    """(key, item) for every document that carries an item or a passage of it. One narrow pass over the documents for each part of the items."""
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    own = docs.filter(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    parts = max(1, -(-2 * size // ITEM_BOUND)) if size > ITEM_BOUND else 1
    out = None
    for part in range(parts):
        some = items.select(item_key, item_text) if parts == 1 else items.select(item_key, item_text).filter(F.pmod(F.xxhash64(item_key), F.lit(parts)) == part)
        sent = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in some.collect()], q, min_words, budget))
        found = own.mapInPandas(_searcher(sent), f"k {kinds[0]}, i {kinds[1]}")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("k").alias(key), F.col("i").alias(item_key))


def _searcher(sent):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for pdf in batches:
            keys, texts = pdf["k"].to_list(), pdf["t"].to_list()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 150_000) and b - a < 500:
                    size += len(texts[b])
                    b += 1
                block = [fold(t) for t in texts[a:b]]
                found = [(keys[a + d], index.keys[i]) for d, i in index.search(block)]
                found += [(keys[a + d], k) for k, s in index.short for d, t in enumerate(block) if s in t]
                yield pd.DataFrame(found, columns=["k", "i"])
                a = b

    return rows
