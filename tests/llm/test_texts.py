import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm.leakage import WuManber, find_leaks, words
from cohortloom.llm.notebooks import cells
from cohortloom.llm.reading import _pair_sums, fit_reading, isotonic, prose, reading_levels

ITEM = "In Polby, a kite maker ferries 356 velvet hats on alternate Thursdays near Quilfell as the doctor's bylaw demands"
BOOK = {"cells": [{"cell_type": "markdown", "source": ["# Title\n", "Some *text* here."]}, {"cell_type": "code", "source": "x = 1", "outputs": [{"output_type": "stream", "text": ["a\n", "b"]}, {"data": {"text/plain": ["c"]}}, {"traceback": ["t1", "t2"]}]}]}


def test_cells_of_all_forms():
    assert [k for k, _ in cells(json.dumps(BOOK), "ipynb")] == ["text", "code", "output", "output", "output"]
    marked = "=== text ===\nHello.\n\n=== code [3] ===\nx\n\n=== output text ===\ny\n"
    assert [(k, c.strip()) for k, c in cells(marked, "cells")] == [("text", "Hello."), ("code", "x"), ("output", "y")]
    percent = "# %% [markdown]\n# # Head\n# text\n\n# %%\ny = 2  # keep\n\n# Out[1] (text)\n#> 7\n#> 8\n"
    assert [(k, c.strip()) for k, c in cells(percent, "percent")] == [("text", "# Head\ntext"), ("code", "y = 2  # keep"), ("output", "7\n8")]
    assert list(cells(None, "ipynb")) == [] and list(cells("  ", "cells")) == []
    assert list(cells("{broken", "ipynb")) == [("text", "{broken")]
    assert list(cells("plain", None)) == [("text", "plain")]


def brute(items, text, n):
    t = words(text)
    own = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
    return {k for k, v in items for w in [words(v)] if any(tuple(w[i : i + n]) in own for i in range(len(w) - n + 1))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("a b c d e".split()), max_size=40))
def test_search_equals_brute_force(items, text):
    listed = [(i, " ".join(x)) for i, x in enumerate(items)]
    assert WuManber(listed, 4).search(words(" ".join(text))) == brute(listed, " ".join(text), 4)


@pytest.mark.parametrize("shown", ["**{}**", "> {}", "# {}", "<b>{}</b>", "('{}',)", "&quot;{}&quot;", "{}\\n"])
def test_disguises(shown):
    assert WuManber([(7, ITEM)]).search(words(shown.format(ITEM.upper().replace(" ", "\n# ")))) == {7}


def test_found_within_one_cell_only(spark):
    half = ITEM.split()
    split = f"=== text ===\n{' '.join(half[:8])}\n=== code [1] ===\n{' '.join(half[8:17])}\n"
    ten = f"=== output text ===\nxx {' '.join(half[2:12])} yy\n"
    docs = [(1, split, "cells"), (2, ten, "cells"), (2, ten, "cells"), (3, None, "cells"), (4, "", None), (5, "w " * 50_000 + ITEM, "percent")]
    d = spark.createDataFrame(docs, "doc_id long, text string, nb_format string")
    items = spark.createDataFrame([(9, "bench", ITEM), (10, "bench", None), (11, "bench", "too short")], "item_id long, bench string, item_text string")
    assert sorted(tuple(r) for r in find_leaks(d, items).collect()) == [(2, 9), (2, 9), (5, 9)]
    assert find_leaks(d.limit(0), items).count() == 0 and find_leaks(d, items.limit(0)).count() == 0


def test_many_items_are_searched_in_batches(spark):
    rng = np.random.default_rng(3)
    said = [" ".join(f"w{v}" for v in rng.integers(0, 500, 30)) for _ in range(12)]
    d = spark.createDataFrame([(i, f"=== text ===\n{said[i]} and {said[(i + 5) % 12]}\n", "cells") for i in range(9)], "doc_id long, text string, nb_format string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "item_id long, item_text string")
    whole = sorted(tuple(r) for r in find_leaks(d, items).collect())
    assert len(whole) == 18 and sorted(tuple(r) for r in find_leaks(d, items, batch=100).collect()) == whole


def test_long_markup_hides_nothing():
    half = ITEM.split()
    tag = f'<img src="data:{"x" * 5000}">'
    assert WuManber([(7, ITEM)]).search(words(" ".join(half[:6]) + tag + " ".join(half[6:]))) == {7}
    assert "x" * 50 not in " ".join(prose(f"Some words {tag} and more of them."))


EASY = "Look at the cat. The cat is red. We see a dog. It is big. You can run now. I like the hat."
HARD = "Notwithstanding the methodological heterogeneity, the parameterisation presupposes a longitudinal interpretation that is seldom verifiable empirically. Insofar as the susceptibility is disregarded, the covariance would be systematically attenuated, thereby invalidating any inference."
MIDDLE = "The table shows how the average changes when a column is removed. We use the second table because the first one is not complete. After the step, compare the result with the chart above."


def test_isotonic_is_monotone_and_keeps_the_mean():
    y = np.array([1, 3, 2, 2, 5, 4.0])
    f = isotonic(y)
    assert (np.diff(f) >= 0).all() and f.sum() == pytest.approx(y.sum()) and isotonic(np.zeros(0)).size == 0


def test_pair_sums_against_all_pairs():
    rng = np.random.default_rng(1)
    z, y, w = rng.normal(size=(60, 4)), rng.integers(1, 5, 60), rng.normal(size=4)
    lo, hi = np.nonzero(y[:, None] < y[None, :])
    diff = z[hi] - z[lo]
    p = 1 / (1 + np.exp(diff @ w))
    grad, hess, pairs = _pair_sums(z, y, w, block=7)
    assert pairs == len(diff) and np.allclose(grad, diff.T @ p) and np.allclose(hess, (diff * (p * (1 - p))[:, None]).T @ diff)


def test_prose_leaves_out_what_is_none():
    text = "# Head\nOne sentence. Two!\n\n- a bullet here\n```\ncode = 1.\n```\n| a | b |\n|---|---|\n![i](x.png)\nSee [this](http://x.y) now."
    assert prose(text) == ["One sentence.", "Two!", "a bullet here", "See this now."]


def test_levels(spark):
    grades = [(1, EASY), (3, MIDDLE), (5, HARD)]
    graded = [(lv, t + " " + t.split(". ")[k % 2] + ".") for lv, t in grades for k in range(4)]
    m = fit_reading(graded)
    anchors = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(graded)] + [(99, None, "x")], "anchor_id int, reading_level int, passage string")
    # a single hard sentence doesn't raise an easy notebook
    mixed = EASY + " " + HARD.split(". ")[0] + ". " + EASY
    docs = [(1, f"=== text ===\n{EASY}\n", "cells"), (2, f"=== text ===\n{MIDDLE}\n", "cells"), (3, f"=== text ===\n{HARD}\n", "cells"), (4, f"=== text ===\n{mixed}\n", "cells"), (5, "=== code [1] ===\nx = 1\n", "cells"), (6, None, None), (6, "", "ipynb")]
    got = [tuple(r) for r in reading_levels(spark.createDataFrame(docs, "doc_id long, text string, nb_format string"), anchors).select("doc_id", "reading_level").collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 3), (3, 5), (4, 1), (5, None), (6, None), (6, None)], key=str)
    assert m.levels.tolist() == [1, 3, 5]
    with pytest.raises(ValueError):
        fit_reading([(1, EASY)])


def test_levels_and_profile_cover_every_language(spark):
    from cohortloom.llm import queries

    sf = "/root/testdata/sf0.001"
    langs = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = {r.doc_id: r.calibrated for r in queries.p9_levels(spark, sf).collect()}
    assert got == {d: lang == "en" for d, lang in langs.items()} and set(got.values()) == {True, False}
    assert sum(r.n_docs for r in queries.p9_profile(spark, sf).collect()) == len(langs)
    assert all(langs[r.doc_id] == "en" for r in queries.p9_found(spark, sf).collect())
