"""Evaluation passages inside training text: broadcast n-grams of the items, scan of every document, verified alignment.

The n-grams of the normalised items are broadcast, a block of items at a time. Words of a document become numbers of the items' vocabulary; a word that is in none but
one edit from one becomes that one, so misspelt words don't break n-grams. N-grams are five words in a row, in document and item alike, or but for one word: replaced
by any other, put in between, or left out. Where n-grams of an item lie along one diagonal and cover enough of it, the words around them are aligned with the item: first
the length of their longest common subsequence in bit-parallel form, then a local alignment that forgives misspelt words and charges gaps, so that a chain of stock phrases
in other order or with other words between does not pass. N-grams of a whole batch of documents are hashed and looked up as arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.visual import base_form, skeleton
from memspark.operators.work import Work

_word = re.compile("[^\\W_](?:[^\\W_]|[̀-ͯ­͏​-‏⁠﻿])*")
NGRAM = 5
MISSED, INSERTED = 0.7, 0.3
SCORED = 0.2  # of an item's words, least score of the alignment
MATCHED = 0.92  # of the least share of an item's words, those that must be equal or near; the rest may be edited beyond that
COVERED = 0.35  # of an item's words, within n-grams along one diagonal and its neighbours


@lru_cache(1 << 17)
def _plain(token: str) -> str:
    if token.isascii():
        return token.lower()
    d = unicodedata.normalize("NFD", skeleton(base_form(token)).casefold())
    return unicodedata.normalize("NFC", "".join(c for c in d if not "̀" <= c <= "ͯ"))


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The normalised words of a text and where each stands in it."""
    found = [(_plain(m.group()), m.span()) for m in _word.finditer(text)]
    return [w for w, _ in found if w], [s for w, s in found if w]


def _near(a: str, b: str) -> bool:
    """Equal but for one edit (two from nine letters): an inserted, missing, changed or swapped letter each."""
    if a == b:
        return True
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, gap = len(long), len(long) - len(short)
    most = 2 if n > 8 else 1
    if n < 4 or gap > most or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    j = 0
    while j < len(short) - i and short[-1 - j] == long[-1 - j]:
        j += 1
    left, right = long[i : n - j], short[i : len(short) - j]
    if len(left) <= 1 or len(left) == 2 and left == right[::-1]:
        return True
    # two edits leave the middle between the first and the last of them
    return most == 2 and (len(left) <= 2 or left[1:] == right[:-1] or right[1:] == left[:-1] or left[1:-1] == right[1:-1] or gap == 1 and right in (left[1:-1] + left[-1], left[0] + left[1:-1]))


# n-grams as (offsets in the document, offsets in the item), five words each but those in which one word is free
_ROW = (0, 1, 2, 3, 4)
_ONE_MORE = [(0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5)]
_ONE_FREE = [(0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)]
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_BITS = 22


def _hashes(ids: np.ndarray, offsets: tuple[int, ...], tag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of an array of word numbers (negative: none) all of whose words at the offsets are known."""
    n = len(ids) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ok = np.ones(n, bool)
    for o in offsets:
        ok &= ids[o : o + n] >= 0
    at = np.flatnonzero(ok)
    h = np.full(len(at), tag * 0x51ED270B + len(offsets), np.uint64)
    for f, o in zip(_FACTORS, offsets, strict=False):
        h += (ids[at + o].astype(np.uint64) + np.uint64(1)) * f
        h ^= h >> np.uint64(31)
    return at, h * _FACTORS[5] ^ (h >> np.uint64(29))


class _Numbers(dict):
    """Token as written -> number of its word, of the nearest word of the vocabulary, -1 for none and -2 for tokens without a word."""

    def __init__(self, vocabulary: dict[str, int], shorter: dict[str, list[str]]):
        self.vocabulary, self.shorter = vocabulary, shorter

    def __missing__(self, token: str) -> int:
        w = _plain(token)
        n = -2 if not w else self.vocabulary.get(w, -1)
        if n == -1 and len(w) > 3 and not w.isdigit():
            forms = [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]
            like = {v for f in forms for v in self.shorter.get(f, ()) if _near(v, w)}
            like |= {v for f in forms if (v := f) in self.vocabulary and len(v) > 3}
            n = min((self.vocabulary[v] for v in like), default=-1)
        if len(self) > 2_000_000:
            self.clear()
        self[token] = n
        return n


class _Items:
    """Words, vocabulary and n-gram tables of a block of items; picklable, built once on the driver."""

    def __init__(self, rows: list[tuple], ngram: int = NGRAM):
        self.ids, self.words = [], []
        for key, text in rows:
            if w := words(text)[0]:
                self.ids.append(key)
                self.words.append(w)
        self.vocabulary: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        self.numbered = np.full((len(self.words), max([len(w) for w in self.words], default=0)), -9, dtype=np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.short = sorted({len(w) for w in self.words if len(w) < ngram})
        for at, w in enumerate(self.words):
            ids = np.array([self.vocabulary[x] for x in w])
            self.numbered[at, : len(w)] = ids
            ways = [(_ROW, 0), *((o, 1) for o in _ONE_MORE), *((o, 2 + i) for i, o in enumerate(_ONE_FREE))] if len(w) >= ngram else [(tuple(range(len(w))), 9)]
            for offsets, tag in ways:
                p, h = _hashes(ids, offsets, tag)
                found.append((h, np.full(len(p), at), p))
        h, at, p = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.item, self.place = at[order].astype(np.int32), p[order].astype(np.int32)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def numbers(self) -> _Numbers:
        shorter: dict[str, list[str]] = {}
        for v in self.vocabulary:
            if len(v) > 3 and not v.isdigit():
                for i in range(len(v)):
                    shorter.setdefault(v[:i] + v[i + 1 :], []).append(v)
        return _Numbers(self.vocabulary, shorter)

    def hits(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ids, item, place in the item) of every n-gram that a document shares with an item, start by start."""
        ways = [(_ROW, 0), (_ROW, 1), *((o, 0) for o in _ONE_MORE), *((o, 2 + i) for i, o in enumerate(_ONE_FREE)), *((tuple(range(n)), 9) for n in self.short)]
        at, slot = [], []
        for offsets, tag in ways:
            k, h = _hashes(ids, offsets, tag)
            keep = self.bitmap[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            k, h = k[keep], h[keep]
            keep = doc[k] == doc[np.minimum(k + offsets[-1], len(doc) - 1)]
            k, h = k[keep], h[keep]
            s = np.searchsorted(self.hashes, h)
            keep = (s < len(self.hashes)) & (self.hashes[np.minimum(s, len(self.hashes) - 1)] == h) if len(self.hashes) else np.zeros(len(h), bool)
            at.append(k[keep])
            slot.append(s[keep])
        k, s = np.concatenate(at), np.concatenate(slot)
        n = self.first[s + 1] - self.first[s]
        each = np.repeat(self.first[s] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return np.repeat(k, n), self.item[each], self.place[each]


def _spots(item: list[str], window: list[str]) -> list[list[int]]:
    """For each word of the window the places in the item of words that it equals or, if it equals none, is near to."""
    places: dict[str, list[int]] = {}
    ends: dict[str, set[str]] = {}
    for i, x in enumerate(item):
        places.setdefault(x, []).append(i)
        if len(x) > 3:  # a word with one error keeps its first two letters or its last two
            ends.setdefault("<" + x[:2], set()).add(x)
            ends.setdefault(">" + x[-2:], set()).add(x)
    known: dict[str, list[int]] = {}
    for y in set(window):
        if y in places:
            known[y] = places[y]
        else:
            like = ends.get("<" + y[:2], set()) | ends.get(">" + y[-2:], set()) if len(y) > 2 else ()
            known[y] = sorted(i for x in like if abs(len(x) - len(y)) < 3 and _near(x, y) for i in places[x])
    return [known[y] for y in window]


def _common(m: int, spots: list[list[int]]) -> int:
    """Length of the longest common subsequence of an item of m words and a window, bit-parallel."""
    full = v = (1 << m) - 1
    for at in spots:
        u = 0
        for i in at:
            u |= 1 << i
        if u := v & u:
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _best(m: int, spots: list[list[int]]) -> tuple[float, int, int]:
    """(score, item word, window word) where the best local alignment ends."""
    drop = MISSED * np.arange(m + 1)
    prev, best = np.zeros(m + 1), (0.0, -1, -1)
    for j, at in enumerate(spots):
        row = np.maximum(prev - INSERTED, 0.0)
        if at:
            i = np.array(at)
            row[i + 1] = np.maximum(row[i + 1], prev[i] + 1)
            top = int(row[i + 1].argmax())
            if row[i[top] + 1] > best[0]:
                best = (float(row[i[top] + 1]), at[top], j)
            row = np.maximum(np.maximum.accumulate(row + drop) - drop, 0.0)
        prev = row
    return best


def _align(item: list[str], window: list[str], least: float) -> tuple[float, int, int, int, int, int] | None:
    """Best local alignment: score, matched words, first and last item word, first and last window word; null if it scores less than ``least``."""
    spots = _spots(item, window)
    score, i1, j1 = _best(len(item), spots)
    if j1 < 0 or score < least:
        return None
    # the same from its end backwards: what reaches that score first is its start
    back = [[i1 - i for i in at if i <= i1] for at in spots[j1::-1]]
    _, i, j = _best(i1 + 1, back)
    i0, j0 = i1 - i, j1 - j
    matched = _common(i1 - i0 + 1, [[x - i0 for x in at if i0 <= x <= i1] for at in spots[j0 : j1 + 1]])
    return score, matched, i0, i1, j0, j1


def _scores(items: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Scores of the best local alignments of items and windows as rows of word numbers (negative: none), all rows at once."""
    drop = (MISSED * np.arange(items.shape[1] + 1)).astype(np.float32)
    prev = np.zeros((len(items), items.shape[1] + 1), np.float32)
    best = np.zeros(len(items), np.float32)
    for j in range(windows.shape[1]):
        row = np.maximum(prev - np.float32(INSERTED), 0)
        equal = items == windows[:, j : j + 1]
        np.maximum(row[:, 1:], (prev[:, :-1] + 1) * equal, out=row[:, 1:])
        np.maximum(best, row.max(axis=1), out=best)
        prev = np.maximum(np.maximum.accumulate(row + drop, axis=1) - drop, 0)
    return best


def _covered(size: np.ndarray, group: np.ndarray, kept: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], place: np.ndarray, widest: int) -> np.ndarray:
    """How many of an item's words n-grams cover along each kept diagonal and its neighbours."""
    hit = np.zeros((len(kept), widest + NGRAM), bool)
    for rows, other in near:
        n = group[other + 1] - group[other]
        at = np.repeat(group[other] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        hit[np.repeat(rows, n), place[at]] = True
    over = hit[:, :widest].copy()
    for i in range(1, NGRAM):
        over[:, i:] |= hit[:, : widest - i]
    return (over & (np.arange(widest) < size[:, None])).sum(axis=1)


def _distinct(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples in order; in one sort of packed numbers where they fit."""
    low = int(b.min())
    bits = [int(x).bit_length() for x in (a.max(), b.max() - low, c.max())]
    if sum(bits) < 63:
        packed = np.sort((a << (bits[1] + bits[2])) | ((b - low) << bits[2]) | c)
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
        return packed >> (bits[1] + bits[2]), ((packed >> bits[2]) & ((1 << bits[1]) - 1)) + low, packed & ((1 << bits[2]) - 1)
    order = np.lexsort((c, b, a))
    a, b, c = a[order], b[order], c[order]
    fresh = np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0)))
    return a[fresh], b[fresh], c[fresh]


def _scan(texts: list[tuple], items: _Items, numbers: _Numbers, least: float) -> list[tuple]:
    """(key, item, from, to, share) of a batch of (key, text)."""
    texts = [(k, t) for k, t in texts if t]
    rows = [[n for n in map(numbers.__getitem__, _word.findall(t)) if n != -2] for _, t in texts]
    ids = np.array([n for r in rows for n in r], dtype=np.int64)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    doc, first = np.repeat(np.arange(len(rows)), sizes), np.concatenate(([0], np.cumsum(sizes)))
    k, item, place = items.hits(ids, doc)
    if not len(k):
        return []
    # distinct (document, item, diagonal, place), the diagonals of 16 words each
    d, line = doc[k], (k - first[doc[k]] - place) // 16
    pair, line, place = _distinct(d * len(items.ids) + item, line, place.astype(np.int64))
    new_group = np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(line) != 0)))
    group = np.append(np.flatnonzero(new_group), len(pair))
    g_pair, g_line, n = pair[group[:-1]], line[group[:-1]], np.diff(group)
    after = np.concatenate(((np.diff(g_pair) == 0) & (np.diff(g_line) == 1), [False]))  # the next group is the next diagonal
    before = np.concatenate(([False], after[:-1]))
    around = n + np.where(after, np.append(n[1:], 0), 0) + np.where(before, np.append(0, n[:-1]), 0)
    m = items.sizes[g_pair % len(items.ids)]
    need = np.maximum(np.minimum(NGRAM, m), COVERED * m)
    kept = np.flatnonzero(around * NGRAM >= need)
    own = np.arange(len(kept))
    near = [(own, kept), (own[after[kept]], kept[after[kept]] + 1), (own[before[kept]], kept[before[kept]] - 1)]
    kept = kept[_covered(m[kept], group, kept, near, place, items.numbered.shape[1]) >= need[kept]]
    # the window of a diagonal holds the passages of the next one too, so of neighbours every other is enough
    run = np.concatenate(([True], (np.diff(g_pair[kept]) != 0) | (np.diff(g_line[kept]) != 1))) if len(kept) else np.zeros(0, bool)
    kept = kept[(np.arange(len(kept)) - np.maximum.accumulate(np.where(run, np.arange(len(kept)), 0))) % 2 == 0]
    # then those whose words, as numbers, align well enough
    start = np.maximum(0, g_line[kept] * 16 - 24)
    good = np.zeros(len(kept), bool)
    padded = np.concatenate((ids, [-1]))
    for at in range(0, len(kept), 512):
        part = slice(at, at + 512)
        which, size = g_pair[kept[part]] % len(items.ids), m[kept[part]]
        wide = int(size.max())
        where = start[part, None] + np.arange(wide + 64)
        i = g_pair[kept[part]] // len(items.ids)
        inside = (where < sizes[i][:, None]) & (np.arange(wide + 64) < (size + 64)[:, None])
        windows = np.where(inside, padded[np.where(inside, where + first[i][:, None], len(ids))], -1)
        good[part] = _scores(items.numbered[which, :wide], windows) >= SCORED * size
    kept, start = kept[good], start[good]
    out: list[tuple] = []
    read = lru_cache(4)(lambda i: words(texts[i][1]))
    last, end = -1, -1
    for g, s in zip(kept.tolist(), start.tolist(), strict=True):
        if g_pair[g] != last:
            last, end = g_pair[g], -1
        if g_line[g] * 16 + 16 <= end:  # within the place found before
            continue
        i, at = divmod(int(g_pair[g]), len(items.ids))
        w, spans = read(i)
        item_words = items.words[at]
        wide, size = len(item_words) + 64, len(item_words)
        while True:  # the window grows while the alignment reaches its end, so what stands between words does not cut a passage off
            found = _align(item_words, w[s : s + wide], SCORED * size)
            if found is None or found[5] < wide - 8 or s + wide >= len(w):
                break
            wide *= 2
        if found is not None and found[3] - found[2] + 1 >= least * size and found[1] >= MATCHED * least * size:
            _, matched, _, _, j0, j1 = found
            out.append((texts[i][0], items.ids[at], spans[s + j0][0], spans[s + j1][1], matched / size))
            end = s + j1  # another place of the item may follow
    return out


def leaked_passages(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: float = 0.5, block: int = 4_000_000) -> DataFrame:
    """doc, item, from, to (code points of the text as it is), share of the item's words found: one row for each place of a leaked item.

    An item has leaked if at least ``least`` of it, in words, stands in one passage and in order, small edits forgiven. Items are broadcast ``block`` characters at
    a time (their tables take some 40 bytes a character), one block after the other; the documents are read once for each block. Null or empty texts hold nothing; items
    without a word never leak; items of fewer words than an n-gram are searched as a whole. Extra columns are ignored; repeated rows give repeated results.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("text <> ''")
    schema = f"doc {dict(docs.dtypes)[doc_key]}, item {dict(items.dtypes)[item_key]}, `from` int, `to` int, share double"
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    work, names = Work(spark, "leakage"), [f"b{b}" for b in range(n)]
    for b, name in enumerate(names):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        shared = spark.sparkContext.broadcast(_Items([tuple(r) for r in part.collect()]))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            table = shared.value
            numbers = table.numbers()
            for batch in batches:
                yield pd.DataFrame(_scan(list(zip(batch["doc"], batch["text"], strict=True)), table, numbers, least), columns=["doc", "item", "from", "to", "share"])

        found = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).mapInPandas(scan, schema)
        if n == 1:
            return found
        work.cut(found, name)  # a block is done with before the next is made, so driver and workers hold one
        shared.destroy()
    return work.read(found, *names)


def without_passages(docs: DataFrame, doc_key: str, text: str, places: DataFrame) -> DataFrame:
    """doc, text, n_removed for each document with leaked places, the places cut out. Overlapping places are cut once."""
    spans = places.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))
    rows = docs.select(F.col(doc_key).alias("doc"), F.col(text).alias("text")).join(spans, "doc")
    # fold over the places in order: the text kept so far and the end of the last cut
    kept = F.expr(
        "aggregate(spans, named_struct('out', '', 'at', 0), (a, s) -> named_struct('out', if(s.from > a.at, concat(a.out, substring(text, a.at + 1, s.from - a.at)), a.out), 'at', greatest(a.at, s.to)), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return rows.select("doc", kept.alias("text"), F.size("spans").alias("n_removed"))
