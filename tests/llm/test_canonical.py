import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.functions.editing import osa
from cohortloom.llm.canonical import DeletionIndex, Ranker, Vocabulary, _limit, _most, map_to_list, own_words, tokens
from cohortloom.functions.measures import CHANGING, HARMLESS
from cohortloom.llm.canonical import ORDER_WORDS

DRUGS = [(1, "furosemide", "frusemide"), (2, "lisinopril", "lisin"), (3, "hydrochlorothiazide", "HCTZ"), (4, "lisinopril-hydrochlorothiazide", "lisinopril/HCTZ"), (5, "isosorbide mononitrate", "ISMN"), (6, "isosorbide dinitrate", "ISDN"), (7, "0.9 % sodium chloride", "normal saline"), (8, "sodium chloride 0.9 % flush", "NS flush"), (9, "pantoprazole sodium", None), (10, "cholecalciferol (vitamin d3)", "vit D3"), (11, "hydralazine", None)]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(DRUGS, "ref_id long, ref_name string, also_known_as string")


def decide(text, own=frozenset()):
    r = Ranker(DRUGS, HARMLESS | ORDER_WORDS, CHANGING, own)
    t = tokens(text)
    return r.decide(text, {p: r.vocabulary.repair(p) for p in {*t, *(a + b for a, b in zip(t, t[1:]))}})[0]


@pytest.mark.parametrize(
    ("text", "ref"),
    [("*LISSINOPRL* 5", 2), ("lisinopril-yhdrochloroyhiazide-10-12.5mg", 4), ("lisinopril and hydrochlorothiazide", 4), ("HCTZ ER 12.5 MG PO TB24", 3), ("inj isosorbide dnitrate 20 mg/mL", 6), ("iaosorbide mononitrate", 5), ("1000 mg 0.9 % sodium  chloride daily", 7), ("NS flush-10mg", 8), ("SODIUM CHLORIDE 0.9 % FLUSH 5 MG PO TABS", 8), ("pantoprazoles doium", 9), ("vit d3", 10), ("saline nasal spray", 0), ("Frusemide 20 mg, take 1 po bid", 1), ("12", 0), ("x" * 3000, 0)],
)
def test_decisions(text, ref):
    assert decide(text) == ref


def test_words_of_the_corpus_are_not_repaired_away():
    listed = Ranker(DRUGS, HARMLESS | ORDER_WORDS, CHANGING, frozenset())
    own = own_words({"hydralazine": 1000, "hydroxyzine": 200, "hydralizine": 40, "furosemide": 900, "prednisone": 100}, listed)
    assert own == {"hydroxyzine", "prednisone"}
    assert decide("hydroxyzine 10 mg", own) == 0 and decide("hydralizine 10 mg", own) == 11


def test_repair_takes_the_nearest():
    v = Vocabulary(["atenolol", "metoprolol", "oral", "rate", "pulse"])
    assert v.repair("atenllol") == [("atenolol", 1)]
    assert [w for w, _ in v.repair("uplseerate")] == ["pulse", "rate"]
    assert v.repair("zzzzzz") == [] and v.repair("") == []


def test_rows(spark, reference):
    values = [("Furosemide ", 1, True), ("furosemide", 1, True), ("furosemdie", 1, False), ("lisin 5", 2, False), (None, None, False), (" n/a", None, False), ("gabapentin", 0, False), ("!!", 0, False)]
    df = spark.createDataFrame([(i, v, -5) for i, (v, _, _) in enumerate(values)] * 2, "id long, value string, ref_id int")
    got = map_to_list(df, reference).collect()
    assert len(got) == 16, "repeated rows stay"
    for r in got:
        assert (r.ref_id, r.exact) == values[r.id][1:], r
    assert map_to_list(df.limit(0), reference).count() == 0
    assert {r.ref_id for r in map_to_list(df, reference.limit(0)).collect()} == {0, None}


word = st.text("abcd", min_size=3, max_size=13)


@settings(max_examples=200, deadline=None)
@given(st.lists(word, min_size=1, max_size=12), word)
def test_join_by_deletions_loses_no_word_within_the_edits(words, token):
    """Against the distance to every word."""
    vocabulary, limit = Vocabulary(words), _limit(token)
    if token not in vocabulary.words:
        near = [(d, -len(w), w) for w in set(words) if (d := osa(token, w, m := min(limit, _most(len(w))))) <= m]
        assert vocabulary.near(token) == ((min(near)[2], min(near)[0]) if near else None)


def test_index_of_no_words():
    assert list(DeletionIndex([]).within("abc", 2)) == [] and Vocabulary([]).near("abcdef") is None


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=14))
def test_whole_names_are_blocked_without_loss(letters):
    names = ["abcabcabc", "cabbacab", "bbbbbbbb", "acacacacacac", "abcabc"]
    r = Ranker([(i, n, None) for i, n in enumerate(names, 1)], frozenset(), frozenset(), frozenset())
    kept = {n for _, n in r._alike(letters)}
    assert {n for n in names if osa(letters, n, len(n) // 4) <= len(n) // 4 and len(letters) > 1} <= kept


def test_long_lists_take_time_by_their_matches():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 11))) for _ in range(20_000)]
    v = Vocabulary(words)
    began = time.perf_counter()
    for w in words[:300]:
        assert v.near(w[:2] + w[3] + w[2] + w[4:])[1] <= 1
    assert time.perf_counter() - began < 3
