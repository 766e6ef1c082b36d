import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import packing as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no tokenizer here")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=80))
def test_no_container_overflows_and_all_items_are_placed(sizes):
    sizes = np.array(sizes, np.int64)
    got = K.pack(sizes, 20)
    fill = np.bincount(got, weights=sizes, minlength=1) if len(sizes) else np.zeros(1)
    assert len(got) == len(sizes) and fill.max() <= 20


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(300, 2300), min_size=6, max_size=59))
def test_packing_again_never_needs_more_containers(sizes):
    sizes = np.array(sizes, np.int64)
    got = K.pack(sizes)
    assert np.bincount(got, weights=sizes).max() <= K.CAPACITY
    full, K.FULL_ENOUGH = K.FULL_ENOUGH, 0.0
    try:
        assert got.max() <= K.pack(sizes).max()
    finally:
        K.FULL_ENOUGH = full


def test_what_is_promised_of_a_packing(spark):
    df = spark.createDataFrame([(k, "word " * (k % 90), "t") for k in range(300)] + [(900, None, "t")], "doc_id long, text string, total string")
    assert {tuple(r)[1:] for r in K.checked(df, capacity=64).collect()} == {(True, True, True)}


def test_little_space_is_left():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(7, 0.7, 20_000), 1, 4096).astype(np.int64)
    got = K.pack(sizes)
    best = -(-sizes.sum() // 4096)
    assert got.max() + 1 <= 1.015 * best


def test_the_first_packing_stays_where_the_second_needs_more():
    sizes = np.array([1700, 1150, 1150, 1350, 1350, 1310], np.int64)
    got = K.pack(sizes)
    assert np.bincount(got, weights=sizes).tolist() == [4000.0, 4010.0]


def packed(spark, rows, **how):
    df = spark.createDataFrame([(d, x, 1, "s") for d, x in rows], "doc_id long, text string, slot int, shard string")
    return K.packed(df, **how)


def test_whole_texts_in_order(spark):
    rows = [(k, "word " * (k % 50)) for k in range(400)] + [(900, None), (901, ""), (902, "long text " * 700), (900, None)]
    got = sorted((tuple(r[c] for c in ("container_id", "slot", "start", "n_tokens", "doc_id", "piece", "from_token")) for r in packed(spark, rows, capacity=256).collect()))
    count = {d: len(K.tokenizer().encode_ordinary(x or "")) for d, x in rows}
    total, place = {}, {}
    for c, slot, start, n, d, piece, begin in got:
        expected = place.get(c, (0, 0))
        assert (slot, start) == expected
        place[c] = (slot + 1, start + n)
        total.setdefault(d, []).append((piece, begin, n))
    assert max(p[1] for p in place.values()) <= 256
    for d, pieces in total.items():
        copies = sum(1 for x, _ in rows if x == d)
        assert sum(n for *_, n in pieces) == copies * count[d]
        if count[d] <= 256:
            assert len(pieces) == copies  # never split
    assert set(total) == {d for d, _ in rows}


def test_several_shards_and_same_result_again(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD_ITEMS", 100)
    rows = [(k, "some words here " * (k % 9 + 1)) for k in range(500)]
    one = sorted(map(tuple, packed(spark, rows, capacity=64).collect()))
    assert one == sorted(map(tuple, packed(spark, rows[::-1], capacity=64).collect()))
    assert len({r[2] >> 32 for r in one}) == 5


def test_long_runs_of_one_character(spark):
    got = packed(spark, [(1, " " * 300_000), (2, "a" * 100_000)]).groupBy("doc_id").sum("n_tokens").collect()
    assert all(r["sum(n_tokens)"] > 0 for r in got) and len(got) == 2


def test_the_other_matcher_counts_like_the_tokenizer():
    import regex

    encoding, pattern = K.tokenizer(), regex.compile(K.PATTERN)
    for x in ("It's  a test,\n\n  of 1234 things!  ", "  \t x", "naïve 日本語 '' 's", "a" * 500 + " " * 500 + "b"):
        assert sum(len(encoding._encode_single_piece(m.group())) for m in pattern.finditer(x)) == len(encoding.encode_ordinary(x))


def test_empty_table(spark):
    assert packed(spark, []).count() == 0
