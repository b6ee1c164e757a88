import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm.packing import TOKENIZER, TokenCounter, best_fit, local_search, pack, token_sizes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60))
def test_search_never_loses_items_nor_worsens(sizes):
    s = np.array(sizes, int)
    first = best_fit(s, 40)
    after = local_search(s, [list(b) for b in first], 40)
    assert sorted(i for b in after for i in b) == list(range(len(s)))
    assert all(s[b].sum() <= 40 for b in after) and len(after) <= len(first)
    square = lambda bins: sum(int(s[b].sum()) ** 2 for b in bins)
    assert square(after) >= square(first)


def test_search_empties_a_bin_that_best_fit_leaves():
    s = np.array([6, 5, 5, 4, 4, 3, 3])  # 30 in three bins of 10
    bins = [[0, 5], [1, 3], [2, 4], [6]]
    assert len(local_search(s, bins, 10)) == 3


@pytest.mark.parametrize("text", ["", "a", "  two  spaces\n\n\n  then  text ", "x = 1\n    if y:\n\n\n        z", "\t \n", "émile’s 東京 ok  \u00a0 end", "it's we'll  I'd", "\U0010fffd odd  char", "A" * 5000])
def test_counts_are_those_of_the_plain_tokenizer(text):
    c = TokenCounter(TOKENIZER)
    assert c(text) == len(c.plain.encode_ordinary(text))


@settings(max_examples=200, deadline=None)
@given(st.text(" \n\tab1.é'", max_size=40))
def test_counts_on_any_text(text):
    c = _COUNTER
    assert c(text) == len(c.plain.encode_ordinary(text))


_COUNTER = TokenCounter(TOKENIZER)


def test_pieces_and_places(spark):
    rng = np.random.default_rng(0)
    n = [int(v) for v in rng.lognormal(3, 1, 400)] + [0, 250, 100, 100, None]
    sizes = spark.createDataFrame([(i if i % 50 else None, v) for i, v in enumerate(n)], "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 64), (3, None)], "capacity_id int, capacity_tokens int")
    got = pack(sizes, caps, block=60, rounds=3).toPandas()
    for c, cap in ((1, 100), (2, 64)):
        g = got[got.capacity_id == c]
        assert g.tokens.sum() == sum(v or 0 for v in n)
        fill = g.groupby("container").tokens.sum()
        assert fill.max() <= cap and not g.duplicated(["container", "place"]).any()
        assert len(fill) <= -(-fill.sum() // cap) + 8
        whole = g.groupby("doc_id").agg(tokens=("tokens", "sum"), pieces=("piece", "size"))
        assert (whole.pieces == np.maximum(1, -(-whole.tokens // cap))).all(), "only what exceeds the capacity is cut"
    assert pack(sizes.limit(0), caps).count() == 0 and pack(sizes, caps.limit(0)).count() == 0


def test_sizes_of_texts(spark):
    d = spark.createDataFrame([(1, "hello world", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, tokens string")
    assert sorted(tuple(r) for r in token_sizes(d).collect()) == [(1, 2), (2, 0), (3, 0)]


def test_too_many_capacities_are_refused_not_dropped(spark):
    sizes = spark.createDataFrame([(1, 5)], "doc_id long, tokens long")
    caps = spark.range(1, 1002).selectExpr("cast(id as int) AS capacity_id", "cast(id as int) AS capacity_tokens")
    with pytest.raises(ValueError, match="1000 capacities"):
        pack(sizes, caps)


def test_search_ends_only_when_no_step_helps():
    """Against brute force: no move, exchange or two for one raises the sum of squared fills of the bins left."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        s = rng.integers(1, 30, 60)
        bins = local_search(s, best_fit(s, 50), 50)
        fill = [int(s[b].sum()) for b in bins]
        for x, a in enumerate(bins):
            for y, b in enumerate(bins):
                if x != y and fill[y] >= fill[x]:
                    for out in [(i,) for i in a] + [(i, j) for i in a for j in a if i < j]:
                        for back in ([()] if len(out) == 1 else []) + [(k,) for k in b]:
                            gain = int(s[list(out)].sum()) - sum(int(s[k]) for k in back)
                            assert gain <= 0 or fill[y] + gain > 50
