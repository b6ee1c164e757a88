"""Reading level of a document's prose, learnt from graded passages.

A linear ranker over syntax and vocabulary features is fitted to pairs of passages of different level (logistic loss on
the difference of their features); isotonic regression turns its scores into levels. Sentences are described one by
one and a document is the trimmed mean of its sentences, so that single sentences of another level don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .notebooks import cells

LEAST_WORDS = 40
TRIM = 0.34
ANCHOR_LIMIT = 20_000  # graded passages that a ranker is fitted to on the driver

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", re.M | re.S)
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]+\$", re.S)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_SKIP = re.compile(r"^\s*(#{1,6}\s|\||[-=*_]{3,}\s*$|[!<>]|\{|data:)")
_BULLET = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*")
_ANY = re.compile(r"\w+")
_VOWELS = re.compile(r"[aeiouy]+")
# Words that join clauses.
_JOINING = frozenset(
    "although because since if when while whether which that whose whom after before unless until insofar notwithstanding thereby "
    "whereas though so as where than".split()
)
# The commonest function words.
_PLAIN = frozenset(
    "the a an and or but of to in on at for with it is was are be we you i he she they them this that do not now then can see have "
    "has had by from so all one no if up out".split()
)
FEATURES = (
    "words", "letters", "syllables", "long", "very_long", "commas", "joining", "plain", "longest", "log_words", "log_letters",
)


def prose(text: str) -> list[str]:
    """Sentences of a text cell's prose: no headings, tables, fences, formulas, images or tags."""
    text = _FENCE.sub("\n", text)
    if "$" in text:
        text = _MATH.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(r"\1", _IMAGE.sub(" ", text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if block:
            out.extend(s for s in _SENTENCE.split(" ".join(block)) if s)
            block.clear()

    for line in text.split("\n"):
        if not line.strip() or _SKIP.match(line):
            close()
            continue
        if m := _BULLET.match(line):
            close()
            line = line[m.end() :]
        block.append(line.strip())
    close()
    return out


def describe(sentence: str) -> list[float] | None:
    """Features of one sentence, or None if it has fewer than two words."""
    words = _WORD.findall(sentence)
    n = len(words)
    if n < 2:
        return None
    lower = [w.lower() for w in words]
    sizes = [len(w) for w in lower]
    letters = sum(sizes) / n
    syllables = sum(max(1, len(_VOWELS.findall(w))) for w in lower) / n
    return [
        n, letters, syllables, sum(s >= 8 for s in sizes) / n, sum(s >= 12 for s in sizes) / n, sentence.count(","),
        sum(w in _JOINING for w in lower), sum(w in _PLAIN for w in lower) / n, max(sizes), np.log(n), np.log(letters),
    ]


def features(sentences: list[str]) -> np.ndarray | None:
    """Trimmed means of the sentences' features, or None without sentences."""
    rows = [d for s in sentences if (d := describe(s)) is not None]
    if not rows:
        return None
    m = np.sort(np.array(rows), axis=0)
    cut = min(round(len(m) * TRIM), (len(m) - 1) // 2)
    return m[cut : len(m) - cut].mean(axis=0)


@dataclass
class ReadingModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray  # scores at which the calibrated level passes from one to the next
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def level(self, score: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.bounds, score)]


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Non-decreasing least-squares fit (pool adjacent violators)."""
    blocks: list[list[float]] = []  # mean, weight, members
    for v, u in zip(y.astype(float), np.ones(len(y)) if w is None else w):
        blocks.append([v, u, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, u2, k = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[2] = (p[0] * p[1] + m * u2) / (p[1] + u2), p[1] + u2, p[2] + k
    return np.concatenate([np.full(int(k), m) for m, _, k in blocks]) if blocks else np.zeros(0)


def _pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray, block: int = 1000) -> tuple[np.ndarray, np.ndarray, int]:
    """Over all pairs of an easier passage i and a harder one j, with p the chance that i ranks above j: sum of p (z_j - z_i),
    sum of p (1 - p) (z_j - z_i)(z_j - z_i)', and the number of pairs."""
    s = z @ w
    grad, hess, pairs = np.zeros(len(w)), np.zeros((len(w), len(w))), 0
    for level in np.unique(y):
        harder = np.flatnonzero(y > level)
        easier = np.flatnonzero(y == level)
        pairs += len(harder) * len(easier)
        for at in range(0, len(easier), block):
            i = easier[at : at + block]
            p = 1 / (1 + np.exp(np.clip(s[harder][:, None] - s[i][None, :], -30, 30)))
            q = p * (1 - p)
            a, b = z[harder], z[i]
            grad += p.sum(1) @ a - p.sum(0) @ b
            cross = a.T @ q @ b
            hess += (a * q.sum(1)[:, None]).T @ a + (b * q.sum(0)[:, None]).T @ b - cross - cross.T
    return grad, hess, pairs


def fit_reading(passages: list[tuple[int, str]], rounds: int = 400, penalty: float = 1e-2) -> ReadingModel:
    """Ranker and calibration from (level, passage); passages without prose are left out.

    Pairs of the same level say nothing. The loss of all pairs and its derivatives are summed block by block, from the
    scores of two sets of passages, so that no list of pairs is formed. At least two levels are needed.
    """
    kept = [(level, x) for level, text in passages if text and (x := features(prose(text))) is not None]
    y = np.array([level for level, _ in kept])
    if len(np.unique(y)) < 2:
        raise ValueError("passages of at least two levels are needed")
    x = np.array([v for _, v in kept])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    w = np.zeros(x.shape[1])
    step = np.eye(len(w))
    for _ in range(rounds):  # Newton steps of the penalised logistic loss
        grad, hess, pairs = _pair_sums(z, y, w)
        move = np.linalg.solve(hess / pairs + penalty * step, grad / pairs - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    score = z @ w
    order = np.argsort(score, kind="stable")
    fitted = isotonic(y[order].astype(float))
    levels = np.unique(y)
    bounds = []
    for a, b in zip(levels[:-1], levels[1:]):
        # halfway between the last passage calibrated below the middle of two levels and the first one above
        above = int(np.searchsorted(fitted, (a + b) / 2))
        s = score[order]
        bounds.append((s[max(above - 1, 0)] + s[min(above, len(s) - 1)]) / 2)
    return ReadingModel(mean, scale, w, np.array(bounds), levels)


def reading_levels(documents: DataFrame, anchors: DataFrame, key: str = "doc_id", text: str = "text", form: str = "nb_format", level: str = "reading_level", passage: str = "passage", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_words, n_sentences, score, reading_level) of every document, and its columns ``keep``.

    ``n_words`` counts all words of the text cells; score and level are null where there is no prose at all (null or
    empty texts, code only). The passages, checked to be few, train the model on the driver; documents are read once,
    whole, without a shuffle. Repeated documents get a row each.
    """
    graded = anchors.select(level, passage).limit(ANCHOR_LIMIT + 1).collect()
    if len(graded) > ANCHOR_LIMIT:
        raise ValueError(f"at most {ANCHOR_LIMIT} graded passages; sample them first")
    model = fit_reading([(int(r[0]), r[1]) for r in graded if r[0] is not None])
    slim = documents.select(documents[key].alias("doc"), documents[text].alias("text"), documents[form].alias("form"), *[documents[c] for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sentences, rows = [], [], []
            for t, f in zip(b["text"], b["form"].to_pylist()):
                own = [c for kind, c in cells(t.as_py(), f) if kind == "text"]
                said = [s for c in own for s in prose(c)]
                words.append(sum(len(_ANY.findall(c)) for c in own))
                sentences.append(len(said))
                rows.append(features(said))
            known = np.array([r is not None for r in rows], bool)
            score, found = np.full(len(rows), np.nan), np.zeros(len(rows), int)
            if known.any():
                score[known] = model.score(np.array([r for r in rows if r is not None]))
                found[known] = model.level(score[known])
            yield pa.RecordBatch.from_arrays(
                [b["doc"], pa.array(words, pa.int64()), pa.array(sentences, pa.int64()), pa.array(score, pa.float64(), mask=~known), pa.array(found, pa.int32(), mask=~known), *[b[c] for c in keep]],
                ["doc", "n_words", "n_sentences", "score", "reading_level", *keep],
            )

    kind, kept = documents.schema[key].dataType.simpleString(), "".join(f", {c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"doc {kind}, n_words long, n_sentences long, score double, reading_level int{kept}").withColumnRenamed("doc", key)
