"""Containers: nothing lost, nothing over, near the fewest possible."""

import math
import os
import random
import time

import numpy as np
import pytest

from plenumspark.llm import packing

pytestmark = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no tokenizer")


@pytest.mark.parametrize("capacity", [64, 512, 2048])
def test_pack(capacity):
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.lognormal(4, 1.2, 2000).astype(int), capacity)
    bins = packing.pack(sizes, capacity)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= capacity and len(set(bins)) == bins.max() + 1
    big = int((sizes > capacity / 2).sum())
    assert len(fill) <= max(math.ceil(sizes.sum() / capacity), big) * 1.02 + 1


def test_local_search_empties_bins():
    sizes = [6, 6, 4, 4, 4, 4, 2]
    bins = [[0, 2], [1, 3], [4], [5], [6]]
    out = packing.local_search(bins, sizes, 10)
    assert len(out) == 3 and sorted(i for b in out for i in b) == list(range(7)) and all(sum(sizes[i] for i in b) <= 10 for b in out)


def test_exchanges_raise_squared_fill():
    rng = random.Random(4)
    for _ in range(20):
        sizes = sorted((rng.randrange(1, 60) for _ in range(80)), reverse=True)
        start = [[i] for i in range(80)]
        out = packing.local_search([list(b) for b in start], sizes, 100)
        fill = lambda bins: sum(sum(sizes[i] for i in b) ** 2 for b in bins)
        assert fill(out) >= fill(start) and max(sum(sizes[i] for i in b) for b in out) <= 100 and len(out) < 60


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(5)
    rows = [(i, "ord " * rng.randrange(0, 300), "x") for i in range(400)] + [(1000, "ord " * 5000, "y"), (1001, None, "z"), (None, "a", "z"), (1002, "", "z"), (7, "ord ord", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, budget_id string")


@pytest.fixture(scope="module")
def budgets(spark):
    return spark.createDataFrame([(1, 64), (1, 64), (2, 1000), (3, None), (4, 0), (None, 5)], "budget_id int, capacity_tokens int")


@pytest.mark.parametrize("items_a_shard", [50, 100_000])
def test_containers(documents, budgets, items_a_shard):
    out = packing.containers(documents, budgets, items_a_shard=items_a_shard).toPandas()
    n = {}
    for r in packing.token_counts(documents).collect():
        n.setdefault(r["doc_id"], []).append(r["n_tokens"])
    for budget, capacity in ((1, 64), (2, 1000)):
        b = out[out.budget_id == budget]
        assert set(b.doc_id) == set(n)
        b = b.assign(size=b.token_end - b.token_start)
        assert b.groupby("container_id")["size"].sum().max() <= capacity
        for doc, parts in b.groupby("doc_id"):
            assert parts["size"].sum() == sum(n[doc])
            if len(n[doc]) == 1:
                assert len(parts) == max(1, math.ceil(n[doc][0] / capacity))
        total = b["size"].sum()
        assert b.container_id.nunique() <= math.ceil(total / capacity) * 1.05 + 2
    assert set(out.budget_id) == {1, 2}


def test_empty(documents, budgets):
    assert packing.containers(documents.limit(0), budgets).count() == 0 and packing.containers(documents, budgets.limit(0)).count() == 0


def test_two_for_one_with_many_items():
    """A bin of forty items gives two of them for one; the search once left such bins out."""
    sizes = [90, 10] + [97] + [1] * 40
    bins = packing.local_search([[0], [2], list(range(3, 43)), [1]], sizes, 100)
    fills = sorted(sum(sizes[i] for i in b) for b in bins)
    assert sum(fills) == sum(sizes) and max(fills) <= 100 and len(bins) == math.ceil(sum(sizes) / 100)


def test_search_grows_with_the_items():
    rng = np.random.default_rng(3)
    took = []
    for n in (4000, 16000):
        sizes = rng.integers(60, 201, n)
        start = time.perf_counter()
        bins = packing.pack(sizes, 512).max() + 1
        took.append(time.perf_counter() - start)
        assert bins <= math.ceil(sizes.sum() / 512) * 1.015
    assert took[1] < 12 * took[0] + 1


def test_many_capacities(spark):
    docs = spark.createDataFrame([(i, "ord " * i) for i in range(5)], "doc_id long, text string")
    budgets = spark.createDataFrame([(i, i + 1) for i in range(450)], "budget_id int, capacity_tokens int")
    got = packing.containers(docs, budgets).groupBy("budget_id").agg({"doc_id": "count"}).count()
    assert got == 450
