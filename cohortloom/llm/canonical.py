"""Freely typed values mapped to the entry of a reference list that they mean, or to none.

Token-level repair: each distinct token of the values (and each pair of neighbours written as one, for blanks typed
wrongly) is joined to the vocabulary by edit distance, through the deletion neighbourhoods of both sides; the corrected tokens of a value are then compared with every name
of every entry by soft TF-IDF, and the best entry is taken if it scores high enough.

The vocabulary has the list's own tokens, fixed lists of words that don't matter (doses, forms, sides, manners) and of
words that make something else of a value (goal, ideal), and the corpus's own frequent words that the list lacks:
without those a drug outside the list would be "repaired" to the most similar one inside it. A word is the corpus's own
if it is too frequent, beside its nearest word of the list, to be a slip of that.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.editing import osa
from ..functions.measures import CHANGING, HARMLESS, MISSING
from ..operators.readings import reference_rows
from ..session import task_slots, written

# Words of orders that don't tell one drug from another.
ORDER_WORDS = frozenset(
    "mg mcg g ml meq unit units iu tab tabs tablet tablets cap caps capsule capsules po iv im sc sq soln solution susp inj injection er xr sr dr "
    "cr la xl ec odt tb24 cp24 cpdr pf home med meds take by mouth daily bid tid qid qhs qam prn oral orally every hours the and plus with of "
    "in hcl hydrochloride maleate mesylate potassium sodium calcium succinate tartrate besylate phosphate bisulfate fumarate citrate acetate "
    "sulfate bromide extended release delayed immediate patch cream ointment spray drops topical".split()
)
THRESHOLD = 0.6
OWN_SHARE = 4e-4  # share of all tokens that a word of the corpus needs: there are 2,500 at most
OWN_RATIO = 0.25  # of the nearest listed word's count, from which a word three edits away isn't its slip
WHOLE = 0.25  # edits for each letter up to which a value as a whole is a name
_TOKEN = re.compile(r"[a-z]+\d*|\d+(?:\.\d+)?|%")


def tokens(text: str) -> list[str]:
    """Words, numbers and percent signs of a value in lower case; numbers and letters apart, but for ``o2``, ``d3``."""
    return _TOKEN.findall(text.lower())


def _limit(word: str) -> int:
    n = len(word)
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3


def _most(length: int) -> int:
    """Edits up to which a word of this length is meant."""
    return min(3, max(1, (length + 1) // 3))


def _deletions(text: str, most: int) -> set[str]:
    """The text, and what is left of it without up to ``most`` letters."""
    out, last = {text}, {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out |= last
    return out


class DeletionIndex:
    """Words by their deletion neighbourhoods: two words within d edits (swaps included) have a string in common after up to d
    deletions in each. The join is by that string's checksum; the distance is verified afterwards."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = sorted(words)
        marks = [(zlib.crc32(t.encode()), n) for n, w in enumerate(self.words) for t in _deletions(w, _most(len(w)))]
        key, of = (np.array([m[i] for m in marks], t) for i, t in enumerate((np.uint32, np.int32)))
        order = np.argsort(key, kind="stable")
        self.key, self.of = key[order], of[order]
        self.longest = max(map(len, self.words), default=0)

    def within(self, token: str, limit: int) -> Iterator[str]:
        """Words that may be within ``limit`` edits of the token; none that is so is left out."""
        if not limit or len(token) > self.longest + limit:
            return
        asked = np.fromiter((zlib.crc32(t.encode()) for t in _deletions(token, limit)), np.uint32)
        low, high = np.searchsorted(self.key, asked), np.searchsorted(self.key, asked, side="right")
        hit = np.flatnonzero(high > low)
        for n in {int(n) for i in hit for n in self.of[low[i] : high[i]]}:
            if abs(len(self.words[n]) - len(token)) <= limit:
                yield self.words[n]


class Vocabulary:
    """Words that tokens are repaired to."""

    def __init__(self, words: Iterable[str], strict: Iterable[str] = ()) -> None:
        """``strict``: words that short tokens must spell right."""
        self.words = frozenset(w for w in words if w)
        strict = frozenset(w for w in strict if len(w) < 6)
        self.index = DeletionIndex(w for w in self.words if len(w) > 2 and w not in strict and not w[0].isdigit())
        self.memo: dict[str, tuple[str, int] | None] = {}

    def near(self, token: str) -> tuple[str, int] | None:
        """The nearest word and its distance, or None. Ties go to the longer, then alphabetically first word."""
        if token not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[token] = self._near(token)
        return self.memo[token]

    def _near(self, token: str) -> tuple[str, int] | None:
        if token in self.words:
            return token, 0
        if token[:1].isdigit() and len(token) != 2:
            return None
        if len(token) == 2:  # only a swap
            return (token[::-1], 1) if token[::-1] in self.words and not token.isdigit() else None
        limit = _limit(token)
        found = [(d, -len(w), w) for w in self.index.within(token, limit) if (d := osa(token, w, m := min(limit, _most(len(w))))) <= m]
        return (min(found)[2], min(found)[0]) if found else None

    def repair(self, token: str) -> list[tuple[str, int]]:
        """One word, two if the token is two words run together, or none."""
        if one := self.near(token):
            return [one]
        best, found = 99, []
        if len(token) > 4 and not token[0].isdigit():
            for k in range(2, len(token) - 1):
                a, b = token[:k], token[k:]
                if len(a) + len(b) > 5 and (x := self.near(a)) and (y := self.near(b)) and max(len(x[0]), len(y[0])) > 3 and x[1] + y[1] < best:
                    best, found = x[1] + y[1], [x, y]
        return found if best <= 2 else []


class Ranker:
    """Soft TF-IDF of repaired tokens against all names of all entries."""

    def __init__(self, entries: list[tuple[int, str, str | None]], noise: frozenset[str], changing: frozenset[str], own: frozenset[str]) -> None:
        self.noise, self.changing, self.own = noise, changing, own
        self.names: list[tuple[int, frozenset[str]]] = []
        self.exact: dict[str, int] = {}
        for ref, name, also in entries:
            for text in [name, *(also or "").split(";")]:
                key = " ".join(text.lower().split())
                if key:
                    self.exact.setdefault(key, ref)
                for form in {text, re.sub(r"\([^()]*\)", " ", text)}:
                    if words := frozenset(tokens(form)):
                        self.names.append((ref, words))
        df = Counter(w for ws in {(r, w) for r, words in self.names for w in words} for w in [ws[1]])
        count = max(len({r for r, _ in self.names}), 1)
        self.idf = {w: math.log(1 + count / n) for w, n in df.items()}
        self.top = math.log(1 + count)
        listed = frozenset(self.idf)
        self.vocabulary = Vocabulary(listed | noise | changing | own, strict=(changing | noise) - listed)
        self.of_word: dict[str, list[int]] = defaultdict(list)
        for i, (_, words) in enumerate(self.names):
            for w in words:
                self.of_word[w].append(i)
        # listed words that begin a word of the vocabulary, which isn't listed itself
        self.short: dict[str, list[str]] = {}
        for b in self.vocabulary.words - listed:
            if found := [b[:n] for n in range(2, len(b) - 2) if b[:n] in listed and not b[:n].isdigit()]:
                self.short[b] = found
        self.whole = sorted({(ref, "".join(tokens(n))) for ref, name, also in entries for n in [name, *(also or "").split(";")] if len(n) > 5})
        self.of_pair: dict[str, list[int]] = defaultdict(list)  # names by each of their pairs of letters
        for n, (_, name) in enumerate(self.whole):
            for pair in set(map("".join, zip(name, name[1:]))):
                self.of_pair[pair].append(n)
        self.by_ends: dict[str, list[str]] = defaultdict(list)  # listed words by first and last letter
        for w in self.idf:
            if len(w) > 5:
                self.by_ends[w[0] + w[-1]].append(w)

    def weight(self, word: str) -> float:
        """Of a listed word within a name: its rarity, less for salts and the like."""
        return self.idf[word] * (0.35 if word in self.noise or word[0].isdigit() or word == "%" else 1.0)

    def rank(self, repaired: list[tuple[str, float]]) -> tuple[int, float]:
        """Best entry and score of a value's (word, similarity to what was typed); entry 0 if nothing matches."""
        have: dict[str, float] = {}
        for w, s in repaired:
            have[w] = max(have.get(w, 0.0), s)
        near: dict[str, tuple[str, float]] = {}  # listed word -> (word of the value, similarity)
        for w, s in have.items():
            if w in self.idf:
                near[w] = (w, s)
        for w, s in have.items():
            for a in self.short.get(w, ()):
                near.setdefault(a, (w, 0.85 * s))
        best = (0.0, 0.0, 0)
        for i in {i for w in near for i in self.of_word[w]}:
            ref, words = self.names[i]
            dot = size = 0.0
            met = set()
            for w in words:
                v = self.weight(w)
                size += v * v
                if w in near:
                    dot += v * v * near[w][1]
                    met.add(near[w][0])
            own = sum(self.weight(w) ** 2 for w in words if w in near) + sum(self._extra(w) ** 2 for w in have if w not in met)
            score = dot / math.sqrt(size * own) if own else 0.0
            # of equal scores the fuller name, then the smaller id
            if (score, size, -ref) > best:
                best = (score, size, -ref)
        return -best[2], best[0]

    def _extra(self, word: str) -> float:
        """Weight of a word of the value that the name lacks."""
        if word in self.changing:
            return 3 * self.top
        if word in self.noise or word[0].isdigit() or word == "%":
            return 0.12 * self.top if word in self.noise else 0.05
        return self.idf.get(word, self.top)

    def decide(self, text: str, repairs: dict[str, list[tuple[str, int]]]) -> tuple[int, float]:
        """Entry and score of a value, given the repairs of its tokens and neighbouring pairs."""
        key = " ".join(text.lower().split())
        if key in self.exact:
            return self.exact[key], 1.0
        own = tokens(text)
        out: list[tuple[str, float]] = []
        i = 0
        while i < len(own):
            t = own[i]
            one = repairs.get(t) or []
            pair = t + own[i + 1] if i + 1 < len(own) else ""
            two = repairs.get(pair) if pair else None
            joined = two and len(two) == 1 and len(two[0][0]) > 3
            if joined and (two[0][1] == 0 or not one or (len(one) == 1 and one[0][1] > two[0][1] and not repairs.get(own[i + 1]))):
                out.append(self._sim(two[0]))
                i += 2
                continue
            if one:
                out.extend(self._sim(r) for r in one)
            elif full := self._written_out(t):
                out.append((full, 0.8))
            elif len(t) > 1 and not t[0].isdigit():
                out.append((t, 1.0))
            elif t[0].isdigit() and t in self.idf:
                out.append((t, 1.0))
            i += 1
        ref, score = self.rank(out)
        if score < THRESHOLD and not any(w in self.own or w in self.changing for w, _ in out):
            # the letters as a whole: blanks and several slips within short words
            letters = "".join(t for t in own if t not in self.noise and not t[0].isdigit())
            for i, name in self._alike(letters):
                most = int(len(name) * WHOLE)
                if most and (d := osa(letters, name, most)) <= most and 1 - d / len(name) > score:
                    ref, score = i, 1 - d / len(name)
        return (ref, score) if score >= THRESHOLD else (0, score)

    def _alike(self, letters: str) -> list[tuple[int, str]]:
        """Names that may be within the edits allowed for their length: an edit takes three pairs of letters at most."""
        shared: Counter[int] = Counter()
        for pair in set(map("".join, zip(letters, letters[1:]))):
            shared.update(self.of_pair.get(pair, ()))
        need = lambda name: max(len(name), len(letters)) - 1 - 3 * int(len(name) * WHOLE)
        # pairs that occur more than once count once here, so as many are forgiven
        again = lambda t: len(t) - 1 - len(set(zip(t, t[1:])))
        return [self.whole[n] for n in sorted(shared) if shared[n] + again(letters) + again(self.whole[n][1]) >= need(self.whole[n][1])]

    def _written_out(self, token: str) -> str | None:
        """The one listed word that two or three letters abbreviate: same first and last letter, the rest in order."""
        if not 2 <= len(token) <= 3 or not token.isalpha():
            return None
        fits = [w for w in self.by_ends.get(token[0] + token[-1], ()) if re.search(".*".join(token), w)]
        return fits[0] if len(fits) == 1 else None

    @staticmethod
    def _sim(repair: tuple[str, int]) -> tuple[str, float]:
        return repair[0], 1 - 0.5 * repair[1] / max(len(repair[0]), 1)


def map_to_list(values: DataFrame, reference: DataFrame, value: str = "value", noise: frozenset[str] = HARMLESS | ORDER_WORDS, changing: frozenset[str] = CHANGING, extra_names: str = "also_known_as") -> DataFrame:
    """``values`` with ``ref_id`` (0: the list has none; null: the value is missing), ``score`` and ``exact``.

    ``exact`` marks values that are, trimmed and in any case, a ``ref_name``. Missing are null, blank and the usual
    tokens. The value may be long or hold anything; what has no letters maps to 0. Columns of ``values`` with the names of
    results are replaced. Work is done once for each distinct value and distinct token; the way back to the rows is a
    join on the value in which values with over 1 % of the rows are salted.
    """
    spark = values.sparkSession
    entries = [(int(r[0]), r[1], r[2]) for r in reference_rows(reference, "ref_id", "ref_name", extra_names) if r[0] is not None and r[1]]
    names = {e[1].strip().lower() for e in entries}
    rows = values.drop("ref_id", "score", "exact").withColumn("_v", F.lower(F.regexp_replace(F.regexp_replace(F.col(value).cast("string"), r"^\s+|\s+$", ""), r"\s+", " ")))
    there = F.col("_v").isNotNull() & ~F.col("_v").isin(*sorted(MISSING))
    distinct = written(rows.filter(there).groupBy("_v").count(), "values")
    empty = frozenset()
    listed = Ranker(entries, noise, changing, empty)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter[str] = Counter()
            for v, n in zip(b["_v"].to_pylist(), b["count"].to_pylist()):
                for t in tokens(v):
                    words[t] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["token", "n"])

    counts = written(distinct.mapInArrow(split, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    # bounded: at most 1 / OWN_SHARE tokens have that share
    frequent = {r[0]: r[1] for r in counts.filter(F.col("n") >= F.lit(OWN_SHARE * total)).collect()}
    own = own_words(frequent, listed)
    ranker = Ranker(entries, noise, changing, own)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs, ts = [], []
            for v in b["_v"].to_pylist():
                t = tokens(v)
                for x in {*t, *(p + q for p, q in zip(t, t[1:]))}:
                    vs.append(v)
                    ts.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.string()), pa.array(ts, pa.string())], ["_v", "token"])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = b["token"].to_pylist()
            kind = pa.list_(pa.struct([("word", pa.string()), ("d", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.string()), pa.array([[{"word": w, "d": d} for w, d in ranker.vocabulary.repair(t)] for t in ts], kind)], ["token", "fix"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for v, fixes in zip(b["_v"].to_pylist(), b["fixes"].to_pylist()):
                got.append(ranker.decide(v, {f["token"]: [(w["word"], w["d"]) for w in f["fix"]] for f in fixes or []}))
            yield pa.RecordBatch.from_arrays([b["_v"], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["_v", "ref_id", "score"])

    parts = written(distinct.select("_v").mapInArrow(pieces, "_v string, token string"), "pieces")
    # few bytes, much work for each: spread by number of tasks, not by size
    slots = task_slots(spark)
    fixes = parts.select("token").distinct().repartition(slots).mapInArrow(repair, "token string, fix array<struct<word: string, d: int>>")
    found = (
        distinct.select("_v")
        .join(parts.join(fixes, "token").groupBy("_v").agg(F.collect_list(F.struct("token", "fix")).alias("fixes")), "_v", "left")
        .repartition(slots)
        .mapInArrow(decide, "_v string, ref_id long, score double")
    )
    n_rows = distinct.agg(F.sum("count")).collect()[0][0] or 0
    hot = [r[0] for r in distinct.filter(F.col("count") > F.lit(0.01 * n_rows)).select("_v").collect()]  # under 100 values
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.col("_v").isin(hot) if hot else F.lit(False)
    found = found.withColumn("_s", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    told = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    # by a hash of the row, which a stage that runs again draws again
    salted = rows.withColumn("_s", F.when(is_hot, F.pmod(F.xxhash64(*told), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    return (
        salted.join(found, ["_v", "_s"], "left")
        .withColumn("exact", F.coalesce(F.lower(F.regexp_replace(F.col(value).cast("string"), r"^\s+|\s+$", "")).isin(sorted(names)), F.lit(False)))
        .drop("_v", "_s")
    )


def own_words(frequent: dict[str, int], listed: Ranker) -> frozenset[str]:
    """Frequent tokens of the corpus that are words of their own, not slips of listed ones or of each other."""
    known = listed.vocabulary
    out: set[str] = set()
    mine: dict[str, set[str]] = defaultdict(set)  # the words found so far by their deletions
    for t, n in sorted(frequent.items(), key=lambda x: (-x[1], x[0])):
        if t in known.words or len(t) < 4 or t[0].isdigit():
            continue
        got = known.near(t)
        if got is None and out:
            alike = {w for x in _deletions(t, _limit(t)) for w in mine.get(x, ())}
            found = [(d, -len(w), w) for w in alike if (d := osa(t, w, m := min(_limit(t), _most(len(w))))) <= m]
            got = (min(found)[2], min(found)[0]) if found else None
        if got is None:
            # two words run together aren't a new one
            cut = known.repair(t)
            if not cut or sum(d for _, d in cut) > (2 if min(len(w) for w, _ in cut) > 3 else 0):
                out.add(t)
        elif got[1] > 2 and n > OWN_RATIO * frequent.get(got[0], 1):
            out.add(t)
        if t in out:
            for x in _deletions(t, _most(len(t))):
                mine[x].add(t)
    return frozenset(out)
