"""Documents packed into containers of fixed capacity, sizes in tokens of a public tokenizer.

An item that alone exceeds the capacity is cut into full pieces and a rest; all other items stay whole. Full pieces are
containers of their own. The rest is packed in blocks of bounded size: best-fit decreasing first, then swap-based local
search, which moves documents and exchanges them one for one or two for one between underfull bins whenever that raises
the sum of squared fills, so that the emptiest bins run empty. Bins that stay underfull are dissolved, their items mixed
across blocks, and packed again.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 15_000  # items that are packed together
ROUNDS = 4
FULL = 0.998  # fill from which a bin isn't dissolved
CAPACITY_LIMIT = 1_000  # capacities, as they travel within the plan

# The public pattern that cuts text into words before byte-pair merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BARRIER = "\U0010fffd"
_BEFORE_LAST_BLANK = re.compile(r"(\s)(?=\s\S)")


class TokenCounter:
    """Number of tokens of a text. The pattern's look-ahead keeps the last blank before a word apart from its run; a
    barrier put there beforehand does the same and lets the matcher run without look-ahead, nearly twice as fast."""

    def __init__(self, path: str = TOKENIZER) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fast = tiktoken.Encoding("fast", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={_BARRIER: max(ranks.values()) + 1})

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if _BARRIER in text:
            return len(self.plain.encode_ordinary(text))
        marked = _BEFORE_LAST_BLANK.sub(rf"\1{_BARRIER}", text)
        return len(self.fast.encode(marked, allowed_special={_BARRIER})) - (len(marked) - len(text))


@lru_cache(2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens) of every document; null and empty texts have 0 tokens."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([count(t.as_py()) for t in b["text"]], pa.int64())], ["key", "tokens"])

    return documents.select(documents[key].alias("key"), documents[text].alias("text")).mapInArrow(run, f"key {kind}, tokens long").withColumnRenamed("key", key)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of places into ``sizes``: largest item first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect.bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([int(i)])
            bisect.insort(room, (capacity - s, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(int(i))
            if free > s:
                bisect.insort(room, (free - s, b))
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Raises the sum of squared fills of the underfull bins until the emptiest run empty and nothing helps any more.

    The bins give in order of fill, the emptiest first: one moves a document to the bin that it fills best, or exchanges one
    for a smaller one of any other bin, or two for one, whatever fills the other bin most. A step is taken only if the
    sum of squared fills rises, so the search ends; it does when a whole round of givers finds no step. Of all its
    documents a giver weighs the different sizes, and all pairs of these. Full bins are left alone.
    """
    fill = np.array([int(sizes[b].sum()) for b in bins])
    open_bins = np.flatnonzero(fill < capacity)
    if len(open_bins) < 2:
        return bins
    members = {int(k): set(bins[k]) for k in open_bins}
    items = np.concatenate([bins[k] for k in open_bins]).astype(int)
    own, place = sizes[items], {int(i): n for n, i in enumerate(items)}
    home = np.repeat(open_bins, [len(bins[k]) for k in open_bins])
    room = sorted((int(capacity - fill[k]), k) for k in members)

    def shift(i: int, a: int, b: int) -> None:
        s = int(sizes[i])
        for k, change in ((a, -s), (b, s)):
            room.pop(bisect.bisect_left(room, (int(capacity - fill[k]), k)))
            fill[k] += change
            bisect.insort(room, (int(capacity - fill[k]), k))
        members[a].discard(i)
        members[b].add(i)
        home[place[i]] = b

    def move(giver: int, mine: list[int]) -> bool:
        for i in mine:
            s = int(sizes[i])
            # the receiver with the least room that takes it
            for free, to in room[bisect.bisect_left(room, (s, -1)) :]:
                if fill[to] + s <= fill[giver]:
                    break  # the rest are emptier still
                if to != giver and members[to]:
                    shift(i, giver, to)
                    return True
        return False

    def exchange(giver: int, mine: list[int]) -> bool:
        of: dict[int, list[int]] = {}
        for i in mine:
            of.setdefault(int(sizes[i]), []).append(i)
        each = sorted(of)
        sets = {s: (of[s][0],) for s in reversed(each)}
        for n, s in enumerate(each):
            for t in each[n:]:
                if t != s or len(of[s]) > 1:
                    sets.setdefault(s + t, (of[s][0], of[t][-1]))
        given = np.array(sorted(sets))
        slack = capacity - fill[home]
        at = np.searchsorted(given, own + slack, side="right") - 1
        gain = np.where((at >= 0) & (home != giver), given[at] - own, 0)
        gain = np.where(fill[home] + gain > fill[giver], gain, 0)
        best = int(np.argmax(gain * np.where(gain == slack, 2, 1)))  # filled to the brim is worth most
        if gain[best] <= 0:
            return False
        back, to = int(items[best]), int(home[best])
        shift(back, to, giver)
        for i in sets[int(given[at[best]])]:
            shift(i, giver, to)
        return True

    changed = True
    while changed:
        changed = False
        for giver in sorted(members, key=lambda k: (fill[k], k)):
            while members[giver] and fill[giver] < capacity:
                mine = sorted(members[giver], key=lambda i: (-sizes[i], i))
                if not (move(giver, mine) or exchange(giver, mine)):
                    break
                changed = True
    out = [b for k, b in enumerate(bins) if k not in members]
    return out + [sorted(m) for k, m in sorted(members.items()) if m]


def _placing(turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        n, limit = pdf["tokens"].to_numpy(), int(pdf["cap"].iloc[0])
        order = np.lexsort((pdf["row"].to_numpy(), -n))
        pdf, n = pdf.iloc[order], n[order]
        bins = local_search(n, best_fit(n, limit), limit)
        at, within, fills = np.zeros(len(n), int), np.zeros(len(n), "int32"), np.zeros(len(n))
        for k, b in enumerate(bins):
            at[b], within[b], fills[b] = k, np.arange(len(b)), n[b].sum() / limit
        return pdf.assign(container=[f"r{turn}.{b}.{k}" for b, k in zip(pdf["block"], at)], place=within, fill=fills).drop(columns="block")

    return place


def pack(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", tokens: str = "tokens", capacity_id: str = "capacity_id", capacity: str = "capacity_tokens", block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(capacity_id, container, place, key, piece, start, tokens): where every document or piece of one goes.

    ``container`` names a container of its capacity, ``place`` counts its items from 0, ``piece`` the pieces of a document
    from 0 and ``start`` the token at which the piece begins. Items of 0 tokens go into some container too; negative or
    null sizes count as 0. Rows with equal or null keys are documents of their own. More than ``CAPACITY_LIMIT`` different
    capacities raise ValueError; null ones and those under 1 have no containers. Each block of items is one task's
    work; a round's shuffle carries the items not yet in a full container, and nothing but counts reaches the driver.
    """
    spark = sizes.sparkSession
    kind = sizes.schema[key].dataType.simpleString()
    caps = [(r[0], int(r[1])) for r in capacities.select(capacity_id, capacity).filter(F.col(capacity) > 0).distinct().limit(CAPACITY_LIMIT + 1).collect()]
    if len(caps) > CAPACITY_LIMIT:
        raise ValueError(f"more than {CAPACITY_LIMIT} capacities must be packed in several runs")
    base = written(sizes.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("row")), "sizes")
    if not caps:
        return spark.createDataFrame([], f"{capacity_id} int, container string, place int, {key} {kind}, piece int, start long, tokens long")
    cap = F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).cast("long").alias("cap")) for i, c in caps]))
    each = base.select("key", "n", "row", cap.alias("c")).select("key", "n", "row", "c.*").withColumn("whole", F.floor(F.col("n") / F.col("cap")))
    full = (
        each.filter((F.col("whole") > 0))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("k"))
        .select("capacity_id", F.concat(F.lit("f"), F.col("row"), F.lit("."), F.col("k")).alias("container"), F.lit(0).alias("place"), "key", F.col("k").cast("int").alias("piece"), (F.col("k") * F.col("cap")).alias("start"), F.col("cap").alias("tokens"))
    )
    rest = each.filter((F.col("n") % F.col("cap") > 0) | (F.col("n") == 0)).select("capacity_id", "cap", "key", "row", F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("cap")).alias("start"), (F.col("n") % F.col("cap")).alias("tokens"))
    schema = f"capacity_id int, cap long, key {kind}, row long, piece int, start long, tokens long, container string, place int, fill double"
    parts = [full]
    counts = {r[0]: r[1] for r in rest.groupBy("capacity_id").count().collect()}
    for turn in range(rounds):
        blocks = {i: max(1, -(-n // block)) for i, n in counts.items()}
        last = turn == rounds - 1 or all(b == 1 for b in blocks.values())
        number = F.create_map(*[x for i, b in ({c: 1 for c, _ in caps} | blocks).items() for x in (F.lit(i), F.lit(b))])

        placed = (
            rest.withColumn("block", F.pmod(F.xxhash64("row", F.lit(turn)), number[F.col("capacity_id")]).cast("int"))
            .groupBy("capacity_id", "block")
            .applyInPandas(_placing(turn), schema)
        )
        placed = written(placed, "packed")
        done = placed if last else placed.filter(F.col("fill") >= FULL)
        parts.append(done.select("capacity_id", "container", "place", "key", "piece", "start", "tokens"))
        if last:
            break
        rest = placed.filter(F.col("fill") < FULL).drop("container", "place", "fill")
        counts = {r[0]: r[1] for r in rest.groupBy("capacity_id").count().collect()}
        if not counts:
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("capacity_id").alias(capacity_id), "container", "place", F.col("key").alias(key), "piece", "start", "tokens")
