"""Maximal periodic runs of words, by longest common extensions over difference-cover samples.

A run with period p and at least 4 p words has 3 p consecutive words that equal the one p further on,
so one of the grid points 0, 3p, 6p, ... lies among them: grids of all periods have O(n log n) points. From
each point the run extends both ways by a longest common extension (LCE). The LCE of two suffixes
compares fewer than ``V`` words until both stand on positions of a difference cover modulo ``V``; only
the suffixes there are sorted, and a sparse table over their common prefixes answers the rest.

Texts go slice by slice, all texts of a slice at once in numpy; structures are built for those texts of
a slice that need them, and memory follows the longer of a slice and one text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.llm.text import bytes_of, slices

# fixed values: every difference modulo 31 occurs between two of these
V, COVER = 31, (1, 5, 11, 24, 25, 27)
#: SHIFT[d]: least steps that bring positions i and i + d (i = 0 modulo V) to the cover, by i's residue
SHIFT = np.array(
    [[next(s for s in range(V) if (i + s) % V in COVER and (i + d + s) % V in COVER) for d in range(V)] for i in range(V)]
)
MIN_WORDS, MIN_PERIODS = 6, 4
GRID_STEP = MIN_PERIODS - 1
GRID_POINTS = 1 << 21
RUN_FIELDS = "array<struct<start:bigint,length:bigint,period:bigint>>"
WORD = r"[^\x20\x09-\x0D]+"


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows of keys, the first key counting most; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Samples:
    """The sorted suffixes at cover positions of some texts, and range minima over their common prefixes.

    ``words`` are positive numbers; ``ends[i]`` is where the text of position i ends; ``wanted`` says
    which positions belong to texts that are asked about.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, wanted: np.ndarray):
        in_cover = np.isin(np.arange(V), COVER)
        self.words, self.ends = words, ends
        self.at = np.flatnonzero(wanted & in_cover[np.arange(len(words)) % V])
        self.levels = self._ranks()
        self.rank = self.levels[-1]
        self.table = self._minima()

    def _ranks(self) -> list[np.ndarray]:
        """Ranks by the first V, 2 V, 4 V, ... words, until all differ."""
        at, stop = self.at, self.ends[self.at]
        bits = max(int(self.words.max(initial=1)).bit_length(), 1)
        per_key = max(62 // bits, 1)
        rank = _dense(stop)  # texts apart
        for first in range(0, V, per_key):
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(first, min(first + per_key, V)):
                inside = at + k < stop
                key <<= bits
                key[inside] |= self.words[at[inside] + k]
            rank = _dense(rank, key)
        levels, step = [rank], V
        while len(at) and int(rank.max()) < len(at) - 1:
            rank = _dense(rank, self._moved(rank + 1, step))
            levels.append(rank)
            step *= 2
        return levels

    def _moved(self, values: np.ndarray, step: int) -> np.ndarray:
        """The value of the sample ``step`` words on, 0 where the text has ended."""
        goal = self.at + step
        inside = goal < self.ends[self.at]
        out = np.zeros(len(values), dtype=np.int64)
        out[inside] = values[np.searchsorted(self.at, goal[inside])]
        return out

    def _minima(self) -> list[np.ndarray]:
        """Row k: minima of 2^k neighbouring common prefixes, in the order of the suffixes."""
        order = np.argsort(self.rank)
        common = np.zeros(len(order), dtype=np.int64)
        a, b = self.at[order[:-1]], self.at[order[1:]]
        live = np.flatnonzero(self.ends[a] == self.ends[b])
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a[live] + common[live + 1], b[live] + common[live + 1]
            inside = np.maximum(x, y) < self.ends[x - common[live + 1]]
            own, x, y = live[inside], x[inside], y[inside]
            level = self.levels[k]
            same = level[np.searchsorted(self.at, x)] == level[np.searchsorted(self.at, y)]
            common[own[same] + 1] += V << k
        for _ in range(V):
            x, y = a[live] + common[live + 1], b[live] + common[live + 1]
            inside = np.maximum(x, y) < self.ends[a[live]]
            live, x, y = live[inside], x[inside], y[inside]
            same = self.words[x] == self.words[y]
            live = live[same]
            common[live + 1] += 1
        table, width = [common], 1
        while 2 * width <= len(common):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at different cover positions of one text."""
        a, b = self.rank[np.searchsorted(self.at, i)], self.rank[np.searchsorted(self.at, j)]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        row = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(i), dtype=np.int64)
        for k in np.unique(row):
            of = row == k
            out[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k) + 1])
        return out


def extensions(words: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCE of the positions ``i`` < ``j`` of one text each: how many words from there on are the same."""
    shift = SHIFT[i % V, (j - i) % V]
    room = ends[i] - j
    out = np.minimum(shift, room)
    live = np.arange(len(i))
    for k in range(V):
        live = live[k < out[live]]
        if not len(live):
            break
        same = words[i[live] + k] == words[j[live] + k]
        out[live[~same]] = k
        live = live[same]
    # those that matched all the way to the cover go on there
    far = np.flatnonzero((out == shift) & (shift < room))
    if len(far):
        samples = Samples(words, ends, np.isin(ends, ends[i[far]]))
        out[far] += samples.common(i[far] + shift[far], j[far] + shift[far])
    return out


def grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position in it, period) of all grid points, in portions.

    Every period p up to a quarter of a text has the points 0, 3 p, 6 p, ... that have a word p further on.
    """
    periods = np.where(sizes >= MIN_WORDS, sizes // MIN_PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = -(-(sizes[text] - period) // (GRID_STEP * period))
    done = np.cumsum(points)
    start = 0
    while start < len(text):
        stop = max(int(np.searchsorted(done, (done[start - 1] if start else 0) + GRID_POINTS, side="right")), start + 1)
        own = points[start:stop]
        number = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        p = np.repeat(period[start:stop], own)
        yield np.repeat(text[start:stop], own), number * GRID_STEP * p, p
        start = stop


def runs_of(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run, by text, start and period.

    ``words`` are the numbers (from 1) of the words of several texts, ``offsets`` where the texts begin.
    A run is maximal, has at least ``MIN_WORDS`` words and ``MIN_PERIODS`` periods, and its period is its
    smallest.
    """
    sizes = np.diff(offsets)
    n = len(words)
    lefts, rights, periods = [], [], []
    for text, at, p in grid(sizes):
        i = offsets[text] + at
        # a run reaches six words beyond its grid point, so one neighbour matches too
        hit = np.flatnonzero(words[i] == words[i + p])
        i, p = i[hit], p[hit]
        begin, end = offsets[text[hit]], offsets[text[hit] + 1]
        after = (i + p + 1 < end) & (words[np.minimum(i + 1, n - 1)] == words[np.minimum(i + p + 1, n - 1)])
        before = (i > begin) & (words[i - 1] == words[i + p - 1])
        near = after | before
        lefts.append(i[near])
        periods.append(p[near])
    if not lefts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    i, p = np.concatenate(lefts), np.concatenate(periods)
    text = np.searchsorted(offsets, i, side="right") - 1
    begins, ends = np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes)
    forth = extensions(words, ends, i, i + p)
    # the other way on the reversed words: what stands before i is position n - i there
    back = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(i > begins[i])
    if len(inner):
        back[inner] = extensions(words[::-1], (n - begins)[::-1], n - i[inner] - p[inner], n - i[inner])
    start, stop = i - back, i + p + forth
    long = np.flatnonzero(stop - start >= np.maximum(MIN_WORDS, MIN_PERIODS * p))
    text, start, stop, p = text[long], start[long], stop[long], p[long]
    order = np.lexsort((p, stop, start))
    text, start, stop, p = text[order], start[order], stop[order], p[order]
    # found from several grid points, and with multiples of its period
    first = np.ones(len(order), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    text, start, stop, p = text[first], start[first], stop[first], p[first]
    order = np.lexsort((p, start))
    text, start, stop, p = text[order], start[order], stop[order], p[order]
    return text, start - offsets[text], stop - start, p


def kept_words(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words stay if runs keep only their first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change)[:n] == 0


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        flat, offsets = bytes_of(batch)
        parts, collapsed = [], []
        done = 0
        for start, stop in slices(offsets):
            texts = [flat[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(start, stop)]
            number: dict[bytes, int] = defaultdict()
            number.default_factory = lambda number=number: len(number) + 1
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            words = np.fromiter((number[w] for t in texts for w in t), dtype=np.int64, count=int(bounds[-1]))
            text, begin, length, period = runs_of(words, bounds)
            own = np.searchsorted(text, np.arange(len(texts) + 1))
            for k, found in enumerate(texts):
                a, b = own[k], own[k + 1]
                if a < b:
                    keep = kept_words(len(found), begin[a:b], length[a:b], period[a:b])
                    found = [found[w] for w in np.flatnonzero(keep)]
                collapsed.append(b" ".join(found))
            parts.append((text + done, begin, length, period))
            done += len(texts)
        text, begin, length, period = (np.concatenate([np.zeros(0, dtype=np.int64), *p]) for p in zip(*parts, strict=True)) if parts else [np.zeros(0, dtype=np.int64)] * 4
        bounds = np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(begin), pa.array(length), pa.array(period)], names=["start", "length", "period"])
        yield pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(pa.array(bounds), runs), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["runs", "collapsed"]
        )


def periodic_runs(documents: DataFrame, text: Column | None = None) -> DataFrame:
    """The input's columns, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are runs of anything but spaces and control whitespace, numbered from 0. ``collapsed`` has the
    words that stay when every run keeps its first period only, joined by one space. NULL and empty texts
    have no runs and an empty ``collapsed``; repeated rows give a row each. ``text`` is the column to
    search (``text``). An input with columns of the two names raises.
    """
    clash = {c.lower() for c in documents.columns} & {"runs", "collapsed"}
    if clash:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    found = "_found"
    while found in (c.lower() for c in documents.columns):
        found += "_"
    scan = F.arrow_udf(_scan, f"struct<runs:{RUN_FIELDS}, collapsed:string>")
    own = [F.col(f"`{c}`") for c in documents.columns]
    scanned = documents.select(*own, scan(F.coalesce(F.col("text") if text is None else text, F.lit(""))).alias(found))
    return scanned.select(*own, F.col(f"{found}.runs").alias("runs"), F.col(f"{found}.collapsed").alias("collapsed"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text, or for ids whose CRC-32 ends in 0 its words made periodic from word a on.

    With h the CRC-32 and g = floor(h / 10): a = g modulo n, the period 1 + floor((n - a) / (3 + g modulo 8)).
    A NULL id leaves the text as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        g = F.floor(h / 10)
        a = g % n
        p = F.floor((n - a) / (F.lit(3) + g % 8)) + 1
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # the words are an array of one element, so that they are found once
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise("")), 1)
    return F.when(h % 10 == 0, changed).otherwise(text)


def run_digest(documents: DataFrame) -> DataFrame:
    """Per row: counts, the longest run and digests of all runs and of the collapsed text of ``planted`` texts."""
    # a row of its own, so that the planted text is not made part of the Arrow function's input expression
    whole = F.array(planted(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")))
    source = documents.select("doc_id", F.explode(whole).alias("text"))
    found = periodic_runs(source)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("best", F.array_max(ranked))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
