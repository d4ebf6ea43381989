"""Benchmark decontamination by greedy string tiling.

1. Every document's five-word windows are hashed in one vectorised pass; a bitmap of fixed size,
   filled from the benchmark's windows, drops what cannot match. Words under the windows that pass
   are kept, nothing else of the text leaves the task.
2. The windows join the benchmark's windows: (document, item) pairs that share a seed.
3. Each pair is tiled: the longest match of unmarked words is marked again and again, found by
   Karp-Rabin hashes of halving length. The share of an item's words under tiles is its coverage;
   tiles may lie in any order, so reordered passages count.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.llm.text import bytes_of, normalised, slices, windows_of, word_hashes
from moralens.staging import stage

SEED_WORDS = 5
COVERAGE = 0.5
BITMAP_BITS = 1 << 23  # one megabyte with every task, whatever the benchmark's size

SEEDED = "seeds array<bigint>, places array<int>, words array<bigint>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def seeded_words(texts: pa.Array, bitmap: np.ndarray | None) -> pa.StructArray:
    """Per normalised text: distinct window hashes that the bitmap lets pass, and the words below.

    ``bitmap`` None lets all pass.
    """
    flat, offsets = bytes_of(texts)
    seeds: list[np.ndarray] = []
    places: list[np.ndarray] = []
    words: list[np.ndarray] = []
    for start, stop in slices(offsets):
        hashes, rows = word_hashes(flat, offsets[start : stop + 1])
        windows, at = windows_of(hashes, rows, SEED_WORDS)
        if bitmap is not None:
            slot = windows % np.uint64(BITMAP_BITS)
            passed = (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
            windows, at = windows[passed], at[passed]
        bounds = np.searchsorted(at, rows)
        covered = np.zeros(len(hashes) + SEED_WORDS, dtype=bool)
        for i in range(SEED_WORDS):
            covered[at + i] = True
        for row in range(stop - start):
            own = slice(bounds[row], bounds[row + 1])
            seeds.append(np.unique(windows[own]).view(np.int64))
            if bounds[row] < bounds[row + 1]:
                here = np.flatnonzero(covered[rows[row] : rows[row + 1]])
                places.append(here.astype(np.int32))
                words.append(hashes[rows[row] + here].view(np.int64))
            else:
                places.append(np.zeros(0, dtype=np.int32))
                words.append(np.zeros(0, dtype=np.int64))
    return pa.StructArray.from_arrays(
        [_lists(seeds, pa.int64()), _lists(places, pa.int32()), _lists(words, pa.int64())], names=["seeds", "places", "words"]
    )


def seeding(text: Column, bitmap: np.ndarray | None = None) -> Column:
    def seeded(texts: pa.Array) -> pa.Array:
        return seeded_words(texts, bitmap)

    return F.arrow_udf(seeded, SEEDED)(normalised(text))


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of all values of ``seeds.seed``; at most 2^17 rows of eight bytes come to the driver."""
    slot = F.pmod(F.col("seed"), F.lit(BITMAP_BITS))  # a power of two, so signs do not matter
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    filled = seeds.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(BITMAP_BITS >> 6, dtype=np.int64)
    for row in filled.collect():
        bitmap[row["word"]] = row["bits"]
    return bitmap.view(np.uint64)


def tiled_words(words: list[int], places: list[int], item: list[int], least: int = SEED_WORDS) -> int:
    """Words of ``item`` under greedy tiles of at least ``least`` words.

    ``words`` stand at ``places`` of the document; matches do not cross gaps. Of equally long
    matches the first in the document, then in the item, is marked first.
    """
    vocabulary = set(item)
    text: list[int | None] = []
    before = None
    for word, place in zip(words, places, strict=True):
        if before is not None and place != before + 1 and text and text[-1] is not None:
            text.append(None)
        before = place
        if word in vocabulary:
            text.append(word)
        elif text and text[-1] is not None:
            text.append(None)
    used_text, used_item = [False] * len(text), [False] * len(item)
    tiled = 0
    length = max(least, len(item))
    while True:
        matches = _matches(text, item, used_text, used_item, length)
        heap = [(-n, i, j) for n, i, j in matches]
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            parts = _free_parts(used_text, used_item, i, j, -n)
            if parts == [(0, -n)]:
                for k in range(-n):
                    used_text[i + k] = used_item[j + k] = True
                tiled -= n
            else:
                for start, size in parts:
                    if size >= length:
                        heapq.heappush(heap, (-size, i + start, j + start))
        if length <= least:
            return tiled
        length = max(least, length // 2)


def _free_parts(used_text: list[bool], used_item: list[bool], i: int, j: int, n: int) -> list[tuple[int, int]]:
    parts, start = [], None
    for k in range(n + 1):
        free = k < n and not used_text[i + k] and not used_item[j + k]
        if free and start is None:
            start = k
        elif not free and start is not None:
            parts.append((start, k - start))
            start = None
    return parts


def _matches(text, item, used_text, used_item, length):
    """Maximal matches of unmarked words, ``length`` words or longer: (words, in text, in item)."""
    at: dict[int, list[int]] = {}
    for start, code in _rolling(item, used_item, length):
        at.setdefault(code, []).append(start)
    found = []
    for i, code in _rolling(text, used_text, length):
        for j in at.get(code, ()):
            if i and j and _same(text, item, used_text, used_item, i - 1, j - 1):
                continue  # part of a match that begins further left
            n = 0
            while i + n < len(text) and j + n < len(item) and _same(text, item, used_text, used_item, i + n, j + n):
                n += 1
            if n >= length:
                found.append((n, i, j))
    return found


def _same(text, item, used_text, used_item, i, j):
    return text[i] is not None and text[i] == item[j] and not used_text[i] and not used_item[j]


def _rolling(words, used, length):
    """Karp-Rabin codes of the runs of ``length`` unmarked words, with their starts."""
    base, modulus = 1_000_003, (1 << 61) - 1
    lead = pow(base, length - 1, modulus)
    code = run = 0
    for i, word in enumerate(words):
        if word is None or used[i]:
            code = run = 0
            continue
        if run == length:
            code = (code - words[i - length] * lead) % modulus
            run -= 1
        code = (code * base + word) % modulus
        run += 1
        if run == length:
            yield i - length + 1, code


def tiling(words: Column, places: Column, item: Column) -> Column:
    def tiled(batches_words: pa.Array, batches_places: pa.Array, batches_items: pa.Array) -> pa.Array:
        rows = zip(batches_words.to_pylist(), batches_places.to_pylist(), batches_items.to_pylist(), strict=True)
        return pa.array([tiled_words(w, p, i) for w, p, i in rows], type=pa.int64())

    return F.arrow_udf(tiled, "bigint")(words, places, item)


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, tiled_words, coverage) of pairs whose coverage reaches the threshold.

    NULL texts are empty. Items of fewer than five words have no seed and contaminate nothing.
    Repeated documents and repeated items (same id and words) give one row; rows that share an id but
    not the text give the larger coverage. NULL ids are kept as NULL.
    """
    best = F.max(F.struct("coverage", "tiled_words", "item_words")).alias("_best")
    return tilings(documents, benchmark, ["doc_id"], coverage).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "_best.item_words", "_best.tiled_words", "_best.coverage"
    )


def tilings(documents: DataFrame, benchmark: DataFrame, names: list[str], coverage: float) -> DataFrame:
    """One row per document row and item whose coverage reaches the threshold, with the columns ``names`` of the document."""
    items = benchmark.select("item_id", seeding(F.col("text")).alias("_s"))
    items = items.select("item_id", "_s.words", "_s.seeds").where(F.size("seeds") > 0)
    items = stage(items.distinct().withColumn("_item", F.monotonically_increasing_id()), "items")
    seeds = items.select("_item", F.explode("seeds").alias("seed"))
    bitmap = seed_bitmap(seeds)
    hits = documents.select(*names, seeding(F.col("text"), bitmap).alias("_s")).select(*names, "_s.*")
    hits = stage(hits.where(F.size("seeds") > 0).withColumn("_row", F.monotonically_increasing_id()), "seeded")
    pairs = hits.select("_row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("_row", "_item").distinct()
    return (
        pairs.join(hits.select("_row", *names, "words", "places"), "_row")
        .join(items.select("_item", "item_id", F.col("words").alias("item")), "_item")
        .select(
            *names,
            "item_id",
            F.size("item").cast("bigint").alias("item_words"),
            tiling(F.col("words"), F.col("places"), F.col("item")).alias("tiled_words"),
        )
        .withColumn("coverage", F.col("tiled_words") / F.col("item_words"))
        .where(F.col("coverage") >= coverage)
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows, with their own columns, whose text no item contaminates.

    A row is named by its id, NULL or not, and a digest of its text: other texts under the id stay.
    """
    digest = F.md5(F.coalesce("text", F.lit("")))
    named = documents.select(F.col("doc_id").alias("_dirty_id"), digest.alias("_dirty_text"), "text")
    names = ["_dirty_id", "_dirty_text"]
    dirty = tilings(named, benchmark, names, coverage).select(*names).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_dirty_id")) & (digest == F.col("_dirty_text"))
    return documents.join(dirty, same, "left_anti")
