"""Filling containers of fixed capacity with documents: best fit, then swap-based local search."""

from __future__ import annotations

import base64
import heapq
import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenumspark.session import checkpointed, spread

#: The vocabulary file (ranks of a byte-level BPE) and, a fixed value, the pattern its texts are cut by.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed together in one task, and such groups whose underfull containers are packed again together.
ITEMS_A_SHARD, SHARDS_A_GROUP = 4096, 64
#: Capacities in one plan.
CAPACITIES_AT_ONCE = 200
#: A container filled less than this is packed again on the second level.
FULL = 0.98
_SHIFT = 24

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The public tokenizer at `path`, loaded once a Python worker."""
    if path not in _tokenizers:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _tokenizers[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tokenizers[path]


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document with an id and a text; whole texts are counted."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array([len(encode(t)) for t in pdf["text"]], dtype=np.int64)})

    return spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")).mapInPandas(count, "doc_id long, n_tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item indices, each item put into the fullest bin it fits; `sizes` must fall."""
    bins: list[list[int]] = []
    slack: list[tuple[int, int]] = []
    for i, w in enumerate(sizes):
        k = bisect_left(slack, (w, -1))
        if k < len(slack):
            room, b = slack.pop(k)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        insort(slack, (room - w, b))
    return bins


class _Open:
    """The bins with room left, by their room: all their items in order of size, so that the best partner of an exchange is one look-up."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.where = {i: k for k, b in enumerate(bins) for i in b}
        self.items: dict[int, list[tuple[int, int]]] = {}
        self.by_room: dict[int, list[int]] = {}
        self._arrays: dict[int, np.ndarray] = {}
        for k, b in enumerate(bins):
            room = capacity - self.fill[k]
            if b and room:
                self.items.setdefault(room, []).extend((sizes[i], i) for i in b)
                self.by_room.setdefault(room, []).append(k)
        for x in self.items.values():
            x.sort()

    def add(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if room and self.bins[k]:
            known = self.items.setdefault(room, [])
            for i in self.bins[k]:
                insort(known, (self.sizes[i], i))
            insort(self.by_room.setdefault(room, []), k)
            self._arrays.pop(room, None)

    def drop(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if room and self.bins[k]:
            known = self.items[room]
            for i in self.bins[k]:
                del known[bisect_left(known, (self.sizes[i], i))]
            at = self.by_room[room]
            del at[bisect_left(at, k)]
            if not at:
                del self.by_room[room], self.items[room]
            self._arrays.pop(room, None)

    def sizes_at(self, room: int) -> np.ndarray:
        x = self._arrays.get(room)
        if x is None:
            x = self._arrays[room] = np.fromiter((a for a, _ in self.items[room]), dtype=np.int64, count=len(self.items[room]))
        return x


def _exchange(state: _Open, room: int, give: list[tuple[int, int]], pairs: tuple[np.ndarray, list[tuple[int, int]]] | None) -> tuple[int, list[tuple[int, int]], int | None]:
    """(gain, (size, item) given, item taken or None) that takes most of `room` in some bin with that room: a move, one for one, or, with `pairs`, two for one."""
    k = bisect_left(give, (room + 1, -1)) - 1
    best, given, taken = (give[k][0], [give[k]], None) if k >= 0 and give[k][0] else (0, [], None)
    if best == room:
        return best, given, taken
    known = state.items[room]
    if pairs is None:
        last = -1
        for w, i in give:
            if w == last:
                continue
            last = w
            j = bisect_left(known, (w - room, -1))
            if j < len(known) and w - known[j][0] > best:
                best, given, taken = w - known[j][0], [(w, i)], known[j][1]
                if best == room:
                    break
        return best, given, taken
    sums, members = pairs
    if not len(sums):
        return best, given, taken
    at = state.sizes_at(room)
    j = np.searchsorted(at, sums - room)
    gains = np.where(j < len(at), sums - at[np.minimum(j, len(at) - 1)], 0)
    k = int(gains.argmax())
    if gains[k] > best:
        a, b = members[k]
        return int(gains[k]), [give[a], give[b]], known[int(j[k])][1]
    return best, given, taken


def _pair_sums(give: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Sums of two of the items and their places, one pair for each two weights. A bin of capacity c has at most sqrt(2 c) different weights, so there are no more than about c pairs, however many items."""
    members = []
    first: list[int] = []
    for k, (w, _) in enumerate(give):
        if not w:
            continue
        if not first or give[first[-1]][0] != w:
            first.append(k)
        elif first[-1] == k - 1:
            members.append((k - 1, k))
    members += [(a, b) for n, a in enumerate(first) for b in first[n + 1 :]]
    return np.array([give[a][0] + give[b][0] for a, b in members], dtype=np.int64), members


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewer, fuller bins by moves and exchanges that raise the sum of squared fills, until no bin can be emptied.

    The emptiest bin gives to fuller ones with room left: an item moves; or one item, or two, of it change
    places with a smaller one, taking as much room as they can. Each step fills a fuller bin at the cost of
    an emptier, so squared fill rises and the search ends. A bin that can give nothing more is left; the next
    emptiest is tried. No step can go below total size over capacity, where it stops. Bins are looked up by
    their room, so a step costs the source's items times the different rooms, not the bins.
    """
    least = math.ceil(sum(sizes) / capacity)
    state = _Open(bins, sizes, capacity)
    fill = state.fill
    alive = {k for k in range(len(bins)) if bins[k]}
    waiting = [(fill[k], k) for k in alive if fill[k] < capacity]
    heapq.heapify(waiting)
    while waiting and len(alive) > least:
        was, source = heapq.heappop(waiting)
        if fill[source] != was:
            if fill[source] < capacity:
                heapq.heappush(waiting, (fill[source], source))
            continue
        state.drop(source)
        give = sorted((sizes[i], i) for i in bins[source])
        bins[source] = []
        improved = True
        while improved and give and give[-1][0]:
            improved = False
            for two in (False, True):
                pairs = _pair_sums(give) if two else None
                for room in sorted(state.items, reverse=True):
                    while room in state.items and room <= capacity - fill[source] and give and give[-1][0]:
                        gain, given, taken = _exchange(state, room, give, pairs)
                        if not gain:
                            break
                        target = state.by_room[room][0] if taken is None else state.where[taken]
                        state.drop(target)
                        for w, i in given:
                            del give[bisect_left(give, (w, i))]
                            bins[target].append(i)
                            state.where[i] = target
                        if taken is not None:
                            bins[target].remove(taken)
                            insort(give, (sizes[taken], taken))
                            state.where[taken] = source
                        fill[target] += gain
                        fill[source] -= gain
                        state.add(target)
                        improved = True
                        if two:
                            pairs = _pair_sums(give)
                if improved:
                    break
        if give and not give[-1][0] and len(alive) > 1:
            # Items without size fit anywhere.
            target = min(alive - {source})
            state.drop(target)
            bins[target] += [i for _, i in give]
            state.where.update((i, target) for _, i in give)
            state.add(target)
            give = []
        bins[source] = [i for _, i in give]
        if give:
            state.add(source)
        else:
            alive.discard(source)
    return [bins[k] for k in sorted(alive)]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each item, from 0; no item may be larger than the capacity."""
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order].tolist()
    bins = local_search(best_fit(ranked, capacity), ranked, capacity)
    out = np.zeros(len(sizes), dtype=np.int64)
    for b, items in enumerate(bins):
        out[order[items]] = b
    return out


_ITEM = "budget_id int, capacity_tokens int, doc_id long, part_no int, token_start long, token_end long"
_PLACED = _ITEM + ", shard long, container_id long"


def _pack_group(pdf: pd.DataFrame, level: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "part_no", "token_start"], kind="stable")
    sizes = (pdf["token_end"] - pdf["token_start"]).to_numpy()
    capacity = int(pdf["capacity_tokens"].iloc[0])
    base = (int(pdf["shard"].iloc[0]) << 2 | level) << _SHIFT
    return pdf.assign(container_id=base + pack(sizes, capacity))


def containers(documents: DataFrame, budgets: DataFrame, path: str = VOCABULARY, items_a_shard: int = ITEMS_A_SHARD) -> DataFrame:
    """(budget_id, doc_id, part_no, token_start, token_end, container_id): every document's place for each capacity.

    A text larger than the capacity, and no other, is cut into full parts, each a container, and a rest
    that is packed like a document. Items are spread over shards of about `items_a_shard` by hash, each
    packed by best fit and local search; the containers left underfull by SHARDS_A_GROUP shards are
    packed again together, so what a shard wastes doesn't add up. No task holds more than such a group.

    An empty text takes no room but has a place; null texts and ids and capacities below 1 are left out.
    A doc_id in several rows is several items. Capacities are put beside each document as an array, not by
    a join; many are taken CAPACITIES_AT_ONCE at a time.
    """
    wanted = [(r["budget_id"], r["capacity_tokens"]) for r in budgets.where("budget_id IS NOT NULL AND capacity_tokens >= 1").select("budget_id", "capacity_tokens").distinct().collect()]
    shards = max(1, math.ceil(documents.count() / items_a_shard))
    counts = token_counts(documents, path)
    counts = counts if len(wanted) <= CAPACITIES_AT_ONCE else checkpointed(counts)
    parts = [_of_capacities(counts, wanted[k : k + CAPACITIES_AT_ONCE], shards) for k in range(0, max(1, len(wanted)), CAPACITIES_AT_ONCE)]
    return reduce(DataFrame.unionByName, parts)


def _of_capacities(counts: DataFrame, wanted: list[tuple[int, int]], shards: int) -> DataFrame:
    """`containers` of some capacities."""
    room = "array<struct<budget_id:int,capacity_tokens:int>>"
    rooms = F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(c).cast("int").alias("capacity_tokens")) for b, c in wanted]) if wanted else F.expr(f"cast(array() as {room})")
    counted = counts.select("doc_id", "n_tokens", F.explode(rooms).alias("r")).select("doc_id", "n_tokens", "r.*")
    start = F.col("part_no").cast("long") * F.col("capacity_tokens")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity_tokens")) - 1, F.lit(0)).cast("int")
    items = (
        counted.withColumn("part_no", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("token_start", start).withColumn("token_end", F.least(F.col("n_tokens"), start + F.col("capacity_tokens")))
        .withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(shards)))
        .select("budget_id", "capacity_tokens", "doc_id", "part_no", "token_start", "token_end", "shard")
    )
    first = items.groupBy("budget_id", "capacity_tokens", "shard").applyInPandas(lambda p: _pack_group(p, 0), _PLACED)
    if shards == 1:
        return first.select("budget_id", "doc_id", "part_no", "token_start", "token_end", "container_id")
    first = checkpointed(first)
    under = first.groupBy("budget_id", "capacity_tokens", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("fill")).where(F.col("fill") < F.col("capacity_tokens") * FULL).select("budget_id", "capacity_tokens", "container_id")
    kept = first.join(under, ["budget_id", "capacity_tokens", "container_id"], "left_anti")
    again = first.join(under, ["budget_id", "capacity_tokens", "container_id"], "left_semi").withColumn("shard", F.floor(F.col("shard") / SHARDS_A_GROUP)).select("budget_id", "capacity_tokens", "doc_id", "part_no", "token_start", "token_end", "shard")
    second = again.groupBy("budget_id", "capacity_tokens", "shard").applyInPandas(lambda p: _pack_group(p, 1), _PLACED)
    columns = ["budget_id", "doc_id", "part_no", "token_start", "token_end", "container_id"]
    return kept.select(*columns).unionByName(second.select(*columns))
