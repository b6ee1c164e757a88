"""Evaluation texts in a training corpus: Wu-Manber search for every run of ten words of every item.

The alphabet is words, not characters: a cell becomes a sequence of lower-case words without punctuation, quoting,
comment marks or markup, so that these can't hide a passage. A pattern is each run of ``WORDS`` successive words of an
item; all patterns have the same length, as the algorithm wants it. SHIFT is indexed by a block of two words and says
how far the window may jump; where it is zero, the block's hash bucket lists the patterns that end in it, a prefix hash
thins them out, and the words themselves are compared. Nearly all blocks of a corpus occur in no item, so the window
jumps nine words at a time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .notebooks import cells

WORDS = 10
BLOCK = 2
ITEM_WORDS = 200_000  # words of the items that are searched in one pass, about; more items take more passes

# Everything in ASCII that is no letter or digit separates words; upper case becomes lower case.
_FOLD = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)
_APOSTROPHE = re.compile("(?<=\\w)['\u2019\u02bc](?=\\w)")
_WIDE = re.compile("[\u00a0\u00ab\u00bb\u2000-\u206f\u3000-\u303f]")
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>")
_ESCAPED = re.compile(r"\\[nrt]")
_LINK = re.compile(r"\]\([^()\s]+\)")


def words(text: str) -> list[bytes]:
    """The words of a text as the comparison sees them."""
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "&" in text:
        text = unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if "'" in text or "\u2019" in text or "\u02bc" in text:
        text = _APOSTROPHE.sub("", text)
    if not text.isascii():
        text = _WIDE.sub(" ", text.lower())
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class WuManber:
    """Search tables over all runs of ``length`` words of the given items; shorter items are one pattern of their own length.

    Items shorter than ``length`` words can't hold a run and are never found, nor are null ones.
    """

    def __init__(self, items: list[tuple[int, str | None]], length: int = WORDS) -> None:
        self.length = length
        self.patterns: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for item, text in items:
            own = words(text or "")
            for i in range(len(own) - length + 1):
                at = self.patterns[tuple(own[i : i + length])]
                if item not in at:
                    at.append(item)
        self.shift: dict[tuple[bytes, bytes], int] = {}
        self.bucket: dict[tuple[bytes, bytes], dict[int, list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for p in self.patterns:
            for j in range(BLOCK - 1, length):
                block = (p[j - 1], p[j])
                self.shift[block] = min(self.shift.get(block, length), length - 1 - j)
            self.bucket[p[-2], p[-1]][hash(p[:BLOCK])].append(p)
        self.default = length - BLOCK + 1

    def search(self, text: list[bytes]) -> set[int]:
        """Items of which some run of ``length`` words occurs in the words of one cell."""
        found: set[int] = set()
        end, n, shift, default = self.length - 1, len(text), self.shift, self.default
        while end < n:
            s = shift.get((text[end - 1], text[end]), default)
            if s:
                end += s
                continue
            start = end - self.length + 1
            for p in self.bucket[text[end - 1], text[end]].get(hash((text[start], text[start + 1])), ()):
                if list(p) == text[start : end + 1]:
                    found.update(self.patterns[p])
            end += 1
        return found


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", form: str = "nb_format", item: str = "item_id", passage: str = "item_text", length: int = WORDS, batch: int = ITEM_WORDS) -> DataFrame:
    """(key, item) of every document one cell or output of which holds at least ``length`` successive words of the item.

    One pass over the corpus without any shuffle; the items travel with the tasks. If they have more than ``batch`` words
    together, they are dealt by hash into batches of about as many, each searched in a pass of its own, so neither the
    driver nor a task ever holds more. Whole texts are searched. Null or empty texts hold nothing; repeated documents
    are reported each; the pairs are distinct for each row. An empty item table gives an empty result.
    """
    listed = items.select(F.col(item).cast("long").alias("item"), F.col(passage).alias("passage")).filter(F.col("item").isNotNull() & F.col("passage").isNotNull())
    total = listed.agg(F.sum(F.size(F.split("passage", r"\s+")))).collect()[0][0] or 0
    passes = -(-total // batch)
    if passes < 2:
        return _one_pass(documents, listed, key, text, form, item, length)
    # rows of one item go together, so that the pairs stay distinct
    deal = F.pmod(F.xxhash64("item"), F.lit(passes))
    out = [written(_one_pass(documents, listed.filter(deal == n), key, text, form, item, length), "leaks") for n in range(passes)]
    return reduce(DataFrame.unionByName, out)


def _one_pass(documents: DataFrame, listed: DataFrame, key: str, text: str, form: str, item: str, length: int) -> DataFrame:
    rows = [tuple(r) for r in listed.collect()]
    slim = documents.select(documents[key].cast("long").alias("doc"), documents[text].alias("text"), documents[form].alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = WuManber(rows, length)
        for b in batches:
            docs, found = [], []
            for d, t, f in zip(b["doc"].to_pylist(), b["text"], b["form"].to_pylist()):
                hits: set[int] = set()
                for _, content in cells(t.as_py(), f):
                    own = words(content)
                    if len(own) >= length:
                        hits |= tables.search(own)
                docs += [d] * len(hits)
                found += sorted(hits)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc", "item"])

    return slim.mapInArrow(run, "doc long, item long").toDF(key, item)
