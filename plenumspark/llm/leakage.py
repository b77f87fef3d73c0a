"""Evaluation passages leaking into training text: MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumspark.session import checkpointed, spread

#: Item words on end that make a leak, and item words for each one that may be misspelled, left out or put in.
WINDOW, WORDS_AN_ERROR = 10, 8
#: Words of a shingle. TESTDATA fixes ten words with about one error in eight; no five-word shingle need survive an error in their midst.
SHINGLE = 3
#: Shingles of a passage that survive its allowed errors (two in twelve words leave four of ten), how many of them each has in
#: a window with it, itself counted, and the odds of missing such a passage.
INTACT, TOGETHER, MISS = WINDOW + 2 - SHINGLE + 1 - 2 * SHINGLE, 2, 1e-6
#: A document's shingles are cut into chunks of this many; a block is two neighbours, so every window lies in one.
CHUNK = WINDOW
#: Size classes of blocks by the most item shingles in them: small blocks need fewer hash functions for the same recall.
CLASSES = (WINDOW, 2 * CHUNK)
#: Item pieces, and characters of them, searched for at once; more are searched for in several passes.
ITEMS_A_PASS, CHARACTERS_A_PASS = 5000, 2_000_000
#: Words of a piece of a long item, and words that neighbouring pieces share: more than a passage and its errors can span.
PIECE, SHARED = 2000, 4 * WINDOW

_BROKEN = re.compile(r"[-‐‑­¬]\s*")
_WORD = re.compile(r"[^\W_]+")


class _Plain(dict):
    """Characters to their compatibility decomposition without combining marks; filled as they are met."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        self[code] = plain
        return plain


_PLAIN = _Plain()


def words_of(text: str) -> list[str]:
    """The words of a text without case, punctuation, accents and breaks at hyphens."""
    text = _BROKEN.sub("", text)
    if not text.isascii():
        text = text.translate(_PLAIN)
    return _WORD.findall(text.casefold())


def hash_functions(shingles: int) -> int:
    """Hash functions that a block of so many shingles needs to meet a window of an INTACT passage with odds 1 - MISS.

    Each intact shingle may be the least of the block and of the rest of a window with it.
    """
    j = INTACT / (shingles + (WINDOW - SHINGLE + 1) - TOGETHER)
    return math.ceil(math.log(MISS) / math.log(1 - j))


_N = max(hash_functions(c) for c in CLASSES)
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 2**63, _N, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 2**63, _N, dtype=np.uint64)


def _permuted(h: np.ndarray, k: int) -> np.ndarray:
    x = h * _A[k] + _B[k]
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """Words to 64 bits, remembered while the memory for it is small."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(known) < 500_000:
                    known[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the SHINGLE words on end that start at each word."""
    n = len(h) - SHINGLE + 1
    out = h[:n]
    for i in range(1, SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) ^ (out >> np.uint64(31)) ^ h[i : i + n]
    return out


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then those from begin[1] on."""
    total = int(n.sum())
    return np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total) if total else np.zeros(0, dtype=np.int64)


class ItemIndex:
    """MinHash values of every window of every item, by hash function, and the items' words for verification."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hasher = _Hasher()
        self.ids: list[int] = []
        self.words: dict[int, list[str]] = {}
        self.pairs: dict[int, dict[int, list[int]]] = {}
        values: list[list[np.ndarray]] = [[] for _ in range(_N)]
        owners: list[np.ndarray] = []
        known: list[np.ndarray] = []
        for item, text in items:
            w = words_of(text or "")
            if len(w) < WINDOW:
                continue
            s = shingles(hasher(w))
            at: dict[int, list[int]] = defaultdict(list)
            for i, x in enumerate(s.tolist()):
                at[x].append(i)
            view = np.lib.stride_tricks.sliding_window_view(s, WINDOW - SHINGLE + 1)
            owners.append(np.full(len(view), len(self.ids), dtype=np.int64))
            known.append(s)
            self.ids.append(item)
            self.words[item] = w
            self.pairs[item] = dict(at)
            for k in range(_N):
                values[k].append(_permuted(view, k).min(axis=1))
        own = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        self.values, self.owners = [], []
        for k in range(_N):
            v = np.concatenate(values[k]) if owners else np.zeros(0, dtype=np.uint64)
            pairs = np.unique(np.rec.fromarrays([v, own], names="v,o")) if len(v) else None
            self.values.append(pairs["v"].copy() if pairs is not None else v)
            self.owners.append(pairs["o"].copy() if pairs is not None else own)
            values[k] = []
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, dtype=np.uint64)
        # Where each known shingle occurs: (shingle, item) as one number, and the place in the item.
        where = [np.searchsorted(self.known, x) * len(self.ids) + o for o, x in enumerate(known)]
        occurs, places = (np.concatenate(where), np.concatenate([np.arange(len(x)) for x in known])) if known else (np.zeros(0, dtype=np.int64),) * 2
        order = np.argsort(occurs, kind="stable")
        self.occurs, self.places = occurs[order], places[order]
        # At most one in sixteen other shingles passes the sieve; the look-up among the known ones is exact.
        bits = max(18, int(len(self.known) * 16 - 1).bit_length()) if len(self.known) else 18
        self.mask = np.uint64((1 << bits) - 1)
        self.sieve = np.zeros(1 << bits, dtype=bool)
        self.sieve[(self.known & self.mask).astype(np.int64)] = True

    def candidates(self, s: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, chunk, item) of the blocks that share a MinHash value with an item's window.

        `s` are the shingles of many documents on end; document d has those from starts[d] to starts[d + 1].
        Only shingles of items are hashed: no other can be the least of a window, and leaving them out makes a
        block smaller. A block with fewer than INTACT of them can't be verified and is left out before.
        """
        if not len(s) or not len(self.known):
            return []
        at = np.nonzero(self.sieve[(s & self.mask).astype(np.int64)])[0]
        x = s[at]
        place = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        kept = self.known[place] == x
        at, x = at[kept], x[kept]
        if len(at) < INTACT:
            return []
        lengths = np.diff(starts)
        chunks = -(-lengths // CHUNK)
        first = np.concatenate([[0], np.cumsum(chunks)])
        doc = np.searchsorted(starts, at, "right") - 1
        chunk = first[doc] + (at - starts[doc]) // CHUNK
        # The item shingles lie in order of their chunks: chunk c has those from edge[c] to edge[c + 1].
        edge = np.searchsorted(chunk, np.arange(first[-1] + 1))
        owner = np.repeat(np.arange(len(lengths)), chunks)
        follows = np.append(owner[1:] == owner[:-1], False)
        number = np.arange(len(owner)) - first[owner]
        # A block is a chunk with the next one; a last chunk is the second half of the block before.
        lo, hi = edge[:-1], np.where(follows, edge[np.minimum(np.arange(len(owner)) + 2, len(edge) - 1)], edge[1:])
        size = hi - lo
        blocks = np.nonzero((size >= INTACT) & (follows | (number == 0)))[0]
        n_items = len(self.ids)
        found = []
        least = 0
        for most in CLASSES:
            mine = blocks[(size[blocks] > least) & (size[blocks] <= most)]
            least = most
            if not len(mine):
                continue
            n = size[mine]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            flat = x[np.repeat(lo[mine] - begin, n) + np.arange(n.sum())]
            for k in range(hash_functions(most)):
                m = np.minimum.reduceat(_permuted(flat, k), begin)
                left = np.searchsorted(self.values[k], m, "left")
                n_hit = np.searchsorted(self.values[k], m, "right") - left
                found.append(np.repeat(mine, n_hit) * n_items + self.owners[k][_ranges(left, n_hit)])
            if len(found) > 200:
                found = [np.unique(np.concatenate(found))]
        if not found:
            return []
        block, item = np.divmod(np.unique(np.concatenate(found)), n_items)
        held = self._along_diagonals(block, item, lo, size, place[kept], at - starts[doc])
        return list(zip(owner[block[held]].tolist(), number[block[held]].tolist(), [self.ids[o] for o in item[held].tolist()]))

    def _along_diagonals(self, block: np.ndarray, item: np.ndarray, lo: np.ndarray, size: np.ndarray, known: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The candidates with INTACT equal shingles whose places in document and item keep their distance within six.

        The errors of a passage shift it by two at most, so each lies in a stretch of one of two gratings.
        """
        held = []
        # As many candidates at a time as keep the arrays small.
        for a in range(0, len(block), 50_000):
            b, o = block[a : a + 50_000], item[a : a + 50_000]
            n = size[b]
            candidate = np.repeat(np.arange(len(b)), n)
            flat = _ranges(lo[b], n)
            key = known[flat] * len(self.ids) + o[candidate]
            left = np.searchsorted(self.occurs, key, "left")
            n_hit = np.searchsorted(self.occurs, key, "right") - left
            distance = self.places[_ranges(left, n_hit)] - np.repeat(at[flat], n_hit)
            owner = np.repeat(candidate, n_hit).astype(np.int64)
            ok = np.zeros(len(b), dtype=bool)
            for shift in (0, 3):
                cell, times = np.unique(owner * (1 << 40) + (distance + shift + (1 << 38)) // 6, return_counts=True)
                ok[cell[times >= INTACT] >> 40] = True
            held.append(np.nonzero(ok)[0] + a)
        return np.concatenate(held) if held else np.zeros(0, dtype=np.int64)

    def contained(self, item: int, s: list[int]) -> tuple[int, int] | None:
        """Exact shingle containment: the item positions around passages of which at least INTACT shingles are in the block, in step but for two errors; None if there is none."""
        pairs = self.pairs[item]
        matches = [(j - i, j) for i, x in enumerate(s) for j in pairs.get(x, ())]
        spans = []
        for d in {d for d, _ in matches}:
            at = sorted({j for e, j in matches if 0 <= e - d <= 2})
            spans += [(at[k], at[k + INTACT - 1]) for k in range(len(at) - INTACT + 1) if at[k + INTACT - 1] - at[k] <= WINDOW + 3]
        return (min(a for a, _ in spans), max(b for _, b in spans)) if spans else None


@lru_cache(maxsize=1 << 17)
def _close(a: str, b: str) -> bool:
    """Whether one word can be a misspelling of the other: one letter wrong, missing, extra or swapped, two in words of eight letters or more."""
    most = 1 if min(len(a), len(b)) < 8 else 2
    if abs(len(a) - len(b)) > most:
        return False
    # What both begin and end with does not matter.
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    e = 0
    while e < n - k and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if len(a) <= 1 and len(b) <= 1:
        return True
    if most == 1:
        return len(a) == 2 == len(b) and a == b[::-1]
    previous = list(range(len(b) + 1))
    before: list[int] = []
    for i, x in enumerate(a, 1):
        current = [i]
        for j, y in enumerate(b, 1):
            d = min(previous[j] + 1, current[-1] + 1, previous[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            current.append(d)
        before, previous = previous, current
    return previous[-1] <= most


def holds_passage(doc: list[str], item: list[str]) -> bool:
    """Whether `doc` holds WINDOW item words on end in order, with about one error in WORDS_AN_ERROR.

    A local alignment that begins and ends with equal words; a misspelled, missing or extra word is one
    error, another word in its place is two. Missing words are not held. A cell keeps its (worth, words
    held) of which none is beaten in both; worth is words of the item used less WORDS_AN_ERROR an error.
    What is worth less than `floor` is dropped without loss: what would have to follow it is a passage
    by itself.
    """
    places: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(item):
        places[w].append(j)
    m = len(item)
    enough = -(WORDS_AN_ERROR // 2)
    floor = enough - (WINDOW - 1)
    cost = WORDS_AN_ERROR - 1  # of a word of the item that is misspelled or missing

    def put(cells: dict[int, list[tuple[int, int]]], j: int, worth: int, held: int, left: int) -> None:
        """Add a state at item place j, and those in which the next words are missing."""
        if held + left < WINDOW:
            return
        while worth >= floor and held + m - j >= WINDOW:
            states = cells.get(j)
            if states is None:
                cells[j] = [(worth, held)]
            elif any(a >= worth and b >= held for a, b in states):
                return
            else:
                cells[j] = [(a, b) for a, b in states if a > worth or b > held] + [(worth, held)]
            j, worth = j + 1, worth - cost

    previous: dict[int, list[tuple[int, int]]] = {}  # words of the item used -> states
    for i, x in enumerate(doc, 1):
        current: dict[int, list[tuple[int, int]]] = {}
        left = len(doc) - i
        for j, states in previous.items():
            for worth, held in states:
                if j < m:
                    if item[j] == x:
                        if held + 1 >= WINDOW and worth + 1 >= enough:
                            return True
                        put(current, j + 1, worth + 1, min(held + 1, WINDOW), left)
                    elif worth - cost >= floor and _close(x, item[j]):
                        put(current, j + 1, worth - cost, min(held + 1, WINDOW), left)
                if worth - WORDS_AN_ERROR >= floor:
                    put(current, j, worth - WORDS_AN_ERROR, held, left)
        for j in places.get(x, ()):
            put(current, j + 1, 1, 1, left)
        previous = current
    return False


#: The last index built in this Python worker, by the fingerprint of its items: tasks of one pass share it.
_index: dict[str, ItemIndex] = {}


def _index_of(shared) -> ItemIndex:
    mark, pieces = shared.value
    if mark not in _index:
        _index.clear()
        _index[mark] = ItemIndex([(k, text) for k, (_, text) in enumerate(pieces)])
    return _index[mark]


def _search(batches: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    index = _index_of(shared)
    item_of = [item for item, _ in shared.value[1]]
    hasher = _Hasher()
    margin = CHUNK + 4

    def run(ids: list[int], words: list[list[str]], s: list[np.ndarray]) -> list[tuple[int, int]]:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in s])])
        flat = np.concatenate(s)
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, c, o in index.candidates(flat, starts):
            hits[d, o].append(c)
        out = []
        for (d, o), chunks in hits.items():
            item = index.words[o]
            for c in sorted(chunks):
                a = c * CHUNK
                span = index.contained(o, s[d][a : a + 2 * CHUNK].tolist())
                if span is None:
                    continue
                part = index.words[o][max(0, span[0] - margin) : span[1] + SHINGLE + margin]
                here = words[d][max(0, a - margin) : a + 2 * CHUNK + SHINGLE - 1 + margin]
                if holds_passage(here, part):
                    out.append((ids[d], item_of[o]))
                    break
        return out

    for pdf in batches:
        out: list[tuple[int, int]] = []
        ids, words, s, size = [], [], [], 0
        for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"]):
            w = words_of(text)
            if len(w) < WINDOW - 2:
                continue
            ids.append(doc)
            words.append(w)
            s.append(shingles(hasher(w)))
            size += len(w)
            if size > 400_000:
                out += run(ids, words, s)
                ids, words, s, size = [], [], [], 0
        if ids:
            out += run(ids, words, s)
        yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for item, text in zip(pdf["item_id"].tolist(), pdf["text"]):
            w = words_of(text)
            for a in range(0, max(1, len(w) - SHARED), PIECE - SHARED):
                out.append((item, " ".join(w[a : a + PIECE])))
        yield pd.DataFrame(out, columns=["item_id", "text"])


def leaks(documents: DataFrame, items: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id): documents that hold at least ten words of an item on end, in order.

    Items are the short side of the containment search: the MinHash values of their windows are sent to
    every task, about `items_a_pass` pieces of items and CHARACTERS_A_PASS characters at a time; more take more
    passes over the documents, so no item is dropped and the broadcast stays bounded. A long item is searched
    for in overlapping pieces. Blocks of documents are put into size classes by their item shingles, each with as
    many hash functions as its recall needs. What shares a value is verified by exact shingle containment and
    an alignment. No shuffle but the final distinct.

    Items of fewer than ten words and null or blank texts lead to no case. Repeated rows count once.
    """
    spark = documents.sparkSession
    docs = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    rows = checkpointed(rows.mapInPandas(_pieces, "item_id long, text string").distinct())
    n, characters = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, math.ceil(n / items_a_pass), math.ceil(characters / CHARACTERS_A_PASS))
    parts = []
    for k in range(passes):
        block = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        found = sorted((r["item_id"], r["text"]) for r in block.collect())
        shared = spark.sparkContext.broadcast((xxhash.xxh128_hexdigest(repr(found)), found))
        parts.append(docs.mapInPandas(lambda it, shared=shared: _search(it, shared), "doc_id long, item_id long"))
    return reduce(DataFrame.unionByName, parts).distinct()
