"""Packing documents into sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus) comes to the driver. There,
patterns of few documents that fill a sequence exactly are enumerated; how often to repeat each is fitted to the
histogram by non-negative least squares and rounded; what the patterns leave over is packed best fit, largest first,
again by repeated patterns. The plan is a table of length intervals: the pieces number r0 to r0 + times of a length go to
these sequences at this offset. Pieces are numbered within their length by the task that made them plus what earlier
tasks have of it, so no length is gathered anywhere, and each finds its place by a binary search in the plan.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import split_words, vocabulary
from .common import cut, held, ship, slices, table, texts

CAPACITY = 4096
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
END_ID = (1).to_bytes(4, "little")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class Tokens:
    """Token ids of words, as little-endian bytes, by the tokenizers library. White space separates pre-tokens, so a
    text's ids are those of its words one after another; words seen lately aren't encoded again."""

    def __init__(self, path: str, kept: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.split = split_words
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        names = self.library.get_vocab()
        self.final = np.zeros(max(names.values()) + 1, bool)
        self.final[[i for t, i in names.items() if suffix and t.endswith(suffix)]] = True
        self.kept, self.known, self.old = kept, {}, {}

    def _whole(self, word: str) -> bytes:
        ids = self.library.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Pre-tokens go to the library some hundred a text; a token that ends a word shows where one ends."""
        out = []
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            encoded = self.library.encode_batch_fast([" ".join(some[k : k + 200]) for k in range(0, len(some), 200)], add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in encoded])
            ends = np.flatnonzero(self.final[ids]) * 4 + 4
            if len(ends) == len(some):  # else some are more than one pre-token
                raw, ends = ids.astype("<u4").tobytes(), ends.tolist()
                out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                out += map(self._whole, some)
        return out

    def _learn(self, new: list[str]) -> None:
        """Lower-case letters and what marks follow them are pre-tokens of their own; other words go to the library
        whole. The lower case of sigma depends on its place, so the library makes it."""
        plain, words, heads, tails, whole = [], [], [], [], []
        for word in new:
            if word.isalpha() and word.islower():
                plain.append(word)
                continue
            words.append(word)
            low = word if "Σ" in word else word.lower()
            if low.isalpha():
                heads.append(low)
                tails.append("")
                continue
            head = low.rstrip(MARKS)
            if head.isalpha():
                heads.append(head)
                tails.append(low[len(head) :])
            else:
                heads.append(word)
                tails.append("")
                whole.append(word)
        known = self.known
        known.update(zip(whole, map(self._whole, whole), strict=True))
        parts = [*filterfalse(known.__contains__, {*heads, *tails} - {""})]
        again = {part: ids for part in parts if (ids := self.old.get(part))}
        known.update(again)
        parts = [*filterfalse(again.__contains__, parts), *plain]
        known.update(zip(parts, self._encode(parts), strict=True))
        known.update(zip(words, [known[h] + known[t] if t else known[h] for h, t in zip(heads, tails, strict=True)], strict=True))

    def __call__(self, batch: list[str]) -> Iterator[bytes]:
        split = [*map(self.split, batch)]
        flat = [*chain.from_iterable(split)]
        if len(self.known) >= self.kept:  # what is used again comes back from the old table
            self.known, self.old = {}, self.known
        known = self.known
        found = [*map(known.get, flat)]
        gaps = [k for k, ids in enumerate(found) if ids is None]
        if gaps:
            new = {flat[k] for k in gaps}
            again = {word: ids for word in new if (ids := self.old.get(word)) is not None}
            known.update(again)
            new = [*new.difference(again)]
            for at in range(0, len(new), 50_000):
                self._learn(new[at : at + 50_000])
            for k in gaps:
                found[k] = known[flat[k]]
        at = 0
        for words in split:
            yield b"".join(found[at : at + len(words)])
            at += len(words)


def piece_rows(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """Documents to pieces of at most ``capacity`` ids; ``nth`` counts this task's pieces of the same length."""
    tokens = held(("packing", path), lambda: Tokens(path))
    part = TaskContext.get().partitionId()
    counts = np.zeros(capacity + 1, np.int64)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    for batch in batches:
        docs, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(bodies, 1 << 18):
            rows = []
            for doc, raw in zip(docs[a:b], tokens(bodies[a:b]), strict=True):
                raw += END_ID
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut_off = raw[at : at + 4 * capacity]
                    n = len(cut_off) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(cut_off), part, int(counts[n])))
                    counts[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


def patterns_for(counts: np.ndarray, capacity: int, most_docs: int = 5, tries: int = 6) -> np.ndarray:
    """Patterns (rows of lengths, 0: none) of at most ``most_docs`` documents that fill ``capacity`` exactly.

    All pairs, and for each length ``tries`` patterns of every larger size, with members drawn as the histogram has them
    (a fixed seed: the same histogram gives the same patterns) and the last one closing the gap.
    """
    there = np.flatnonzero(counts)
    there = there[there < capacity]
    if not len(there):
        return np.zeros((0, most_docs), np.int64)
    rng = np.random.default_rng(7)
    share = np.cumsum(counts[there] / counts[there].sum())
    found = [np.zeros((0, most_docs), np.int64)]
    for size in range(2, most_docs + 1):
        first = np.repeat(there, tries if size > 2 else 1)
        drawn = there[np.minimum(np.searchsorted(share, rng.random((len(first), size - 2))), len(there) - 1)]
        last = capacity - first - drawn.sum(1)
        ok = last > 0
        ok[ok] = counts[last[ok]] > 0
        full = np.concatenate([first[ok, None], drawn[ok], last[ok, None], np.zeros((ok.sum(), most_docs - size), np.int64)], 1)
        found.append(full)
    return np.unique(-np.sort(-np.concatenate(found), 1), axis=0)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> list[float]:
    """Repeat counts x >= 0 that minimise |A x - counts|, by cyclic coordinate descent (which leaves most at 0) until no
    count moves by a twentieth, or ``rounds`` times."""
    rest = counts.astype(float).tolist()
    rest[0] = 0.0  # what absent members point to
    x = [0.0] * len(patterns)
    rows = patterns.tolist()
    norms = [float(sum(row.count(n) for n in row if n)) for row in rows]
    for _ in range(rounds):
        moved = 0.0
        for k, row in enumerate(rows):
            slope = 0.0
            for n in row:
                slope += rest[n]
            step = slope / norms[k]
            if step < -x[k]:
                step = -x[k]
            if step:
                x[k] += step
                for n in row:
                    if n:
                        rest[n] -= step
                moved = max(moved, abs(step))
        if moved < 0.05:
            break
    return x


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how many)] and how often each repeats, that use up ``counts`` exactly."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[list[tuple[int, int]], int]] = []
    if left[capacity]:
        plan.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    patterns = patterns_for(left, capacity)
    # rounded, most repeated first; what rounding up takes too much of is cut to what is left, and once all counts are
    # used, patterns rounded down to none take what they still find
    x = fit(patterns, left) if len(patterns) else []
    order = sorted(zip(patterns.tolist(), x, strict=True), key=lambda p: (-p[1], p[0]))
    for rounded in (round, math.ceil):
        for row, times in order:
            pattern = [(n, len([*same])) for n, same in groupby(row) if n]
            times = min([rounded(times), *(int(left[n]) // m for n, m in pattern)])
            if times > 0:
                for n, m in pattern:
                    left[n] -= times * m
                plan.append((pattern, times))
    # best fit, largest first: the largest length left, then again and again the largest that still fits
    there = [int(n) for n in np.flatnonzero(left)]
    while there:
        room, pattern, at = capacity, [], len(there)
        while room > 0 and at:
            at = int(np.searchsorted(there[:at], room, "right"))
            if not at:
                break
            at -= 1
            n = there[at]
            m = min(int(left[n]), room // n) if pattern else 1 if 2 * n > capacity else min(int(left[n]), room // n)
            pattern.append((n, m))
            room -= n * m
        times = min(int(left[n]) // m for n, m in pattern)
        for n, m in pattern:
            left[n] -= times * m
        plan.append((pattern, times))
        gone = {n for n, _ in pattern if not left[n]}
        if gone:
            there = [n for n in there if n not in gone]
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as intervals, sorted by length and first rank: length, rank, many, sequence, offset."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for n, m in pattern:
            rows.append((n, int(used[n]), m, sequence, offset))
            used[n] += m * times
            offset += n * m
        sequence += times
    rows.sort()
    columns = np.asarray(rows or np.zeros((0, 5)), np.int64).T
    return dict(zip(("length", "rank", "many", "sequence", "offset"), columns, strict=True))


def placed_rows(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    p = plan.value
    key = (p["length"] << 45) + p["rank"]
    for batch in batches:
        length = batch.column(3).to_numpy(zero_copy_only=False)
        rank = batch.column(5).to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, (length << 45) + rank, "right") - 1
        nth = rank - p["rank"][at]
        many = p["many"][at]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(p["sequence"][at] + nth // many), pa.array(p["offset"][at] + nth % many * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and an end id; null and empty texts are the end id alone. Only documents over
    ``capacity`` ids are cut. Sequences have no gaps and none exceeds ``capacity``. Repeated rows and null ids are
    packed like any other row; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary()
    pieces = cut(texts(docs).mapInArrow(lambda b: piece_rows(b, path, capacity), PIECES), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each task and length: the ranks its pieces of that length begin at
    bases = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row[0]] = row[1]
    plan = spark.sparkContext.broadcast(places(pack_counts(counts, capacity), capacity))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lambda b: placed_rows(b, plan), PACKED)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
