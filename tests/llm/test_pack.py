import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvellum.llm import pack


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 4))
def test_buckets_have_the_least_padding(histogram, most):
    sizes = np.array(sorted(histogram))
    counts = np.array([histogram[s] for s in sizes])
    cost = lambda ends: int(((np.array(ends)[np.searchsorted(ends, sizes)] - sizes) * counts).sum())
    got = pack.choose_buckets(sizes, counts, most)
    least = min(cost(sorted({*x, sizes[-1]})) for k in range(most) for x in itertools.combinations(sizes[:-1], min(k, len(sizes) - 1)))
    assert len(got) <= most and cost(got) == least


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 100), st.integers(0, 50)), min_size=1, max_size=12, unique_by=lambda x: x[0]))
def test_patterns_hold_every_item_once(histogram):
    bounds, counts = map(np.array, zip(*sorted(histogram)))
    patterns = pack.form_batches(bounds, counts, 100)
    held = np.zeros(len(bounds), int)
    for n, pattern in patterns:
        assert sum(bounds[b] * m for b, m in pattern) <= 100
        for b, m in pattern:
            held[b] += n * m
    assert (held == counts).all()


SCHEMA = "doc_id bigint, n_tokens bigint, bucket string, size string"


def check(spark, sizes, capacity, buckets):
    rows = pack.pack(spark.createDataFrame([(i, n, "clash", "clash") for i, n in sizes], SCHEMA), capacity, buckets).collect()
    want = {}
    for i, n in sizes:
        if n is not None:
            want[i] = max(n, want.get(i, 0))
    assert {r.doc_id for r in rows} == set(want) and len({(r.doc_id, r.piece_no) for r in rows}) == len(rows)
    used = {}
    for r in rows:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.token_end - r.token_start
    for i, n in want.items():
        mine = sorted((r.token_start, r.token_end) for r in rows if r.doc_id == i)
        assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
        assert len(mine) == max(1, -(-n // capacity))
    assert all(0 < u <= capacity for u in used.values())
    return used


def test_defined_results(spark, monkeypatch):
    monkeypatch.setattr(pack, "RANKED", 20)
    rng = np.random.default_rng(2)
    sizes = [(i, int(n)) for i, n in enumerate(rng.lognormal(4, 0.8, 600))] + [(900, 0), (901, None), (902, 512), (903, 2000), (902, 500), (904, 1024)]
    used = check(spark, sizes, 512, 32)
    assert sum(used.values()) / (512 * len(used)) > 0.9


def test_empty_and_single(spark):
    assert check(spark, [], 512, 8) == {}
    assert check(spark, [(1, 7)], 512, 8) == {0: 7}


def test_tokens_of_a_public_vocabulary(spark):
    pytest.importorskip("tiktoken")
    docs = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|> 1,024", "x")], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in pack.token_sizes(docs).collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0 and got[1] >= 2
