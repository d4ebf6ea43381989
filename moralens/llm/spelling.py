"""Groups of spelling variants: words within one edit of each other, found by pivotal bigrams.

Bigrams are ordered by how many words have them, the rarest first. A word's prefix is its bigrams up to
the third rarest; its pivots are two disjoint bigrams of the prefix, the cheapest pair by dynamic
programming. One edit spoils at most one of two disjoint bigrams, so of two near words the one whose
prefix ends earlier in the order has a pivot that stands in the other's prefix, moved by at most one
position. Pivots are looked up among prefixes by an equi-join, on more than the bigram: where the right
pivot is intact and the edit stands before it, all behind is equal and so is one half of what
precedes; else the left pivot is intact, all up to it is equal and so is one half of what follows.
Every candidate is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.llm.text import bytes_of, slices
from moralens.staging import release, stage

RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIN_LETTERS, MIN_COUNT = 5, 3
#: A form is at least this many times as frequent.
FORM_FACTOR = 2
#: One in so many occurrences loses a letter, to plant variants.
TYPO_RATE = 97
HELD_WORDS = 100_000
INFINITE = 1 << 62


def _counted(rate: int | None):
    """Partial counts of the words of a task's documents; ``rate`` plants one deletion in so many occurrences."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            flat, offsets = bytes_of(batch.column(1))
            for start, stop in slices(offsets):
                for k in range(start, stop):
                    text = flat[offsets[k] : offsets[k + 1]].tobytes().translate(LOWER).decode()
                    seed = zlib.crc32(f"{'' if ids[k] is None else ids[k]}:".encode())
                    for word, n in Counter(RUN.findall(text)).items():
                        if len(word) < MIN_LETTERS:
                            continue
                        if rate:
                            h = zlib.crc32(word.encode(), seed)
                            if not h % rate:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < MIN_LETTERS:
                                    continue
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    return count


def vocabulary(documents: DataFrame, typo_rate: int | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): maximal runs of Latin letters of at least five code points, A-Z lower-cased, that occur ``min_count`` times.

    With ``typo_rate`` an occurrence loses a letter where that number divides the CRC-32 of
    ``doc_id:word``; then doc_id is needed (NULL counts as empty). NULL and empty texts have no words.
    """
    key = F.col("doc_id").cast("string") if typo_rate else F.lit(None).cast("string")
    rows = documents.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.mapInArrow(_counted(typo_rate), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def prefix_and_pivots(word: str, frequency: dict[str, int], rank: dict[str, int]) -> tuple[list[int], int, int, int]:
    """Positions of the prefix's bigrams, those of the left and right pivot, and the rank at which the prefix ends."""
    grams = [word[k : k + 2] for k in range(len(word) - 1)]
    ranks = [rank[g] for g in grams]
    last = sorted(ranks)[2]
    prefix = [k for k, r in enumerate(ranks) if r <= last]
    # cheapest[j]: least cost of j disjoint bigrams that end before the one looked at, and the positions
    single, pair = (INFINITE, -1), (INFINITE, -1, -1)
    ready = 0
    for k in prefix:
        while prefix[ready] <= k - 2:
            single = min(single, (frequency[grams[prefix[ready]]], prefix[ready]))
            ready += 1
        pair = min(pair, (single[0] + frequency[grams[k]], single[1], k))
    return prefix, pair[1], pair[2], last


def _keys(at: str, delta: str, sides: str) -> str:
    """SQL of the join keys of a word's bigram at ``at`` for a partner that is ``delta`` letters shorter.

    ``right``: the edit stands behind the bigram; ``left``: before it. Both sides of the join use the
    partner's length and position, so that they cut the halves at the same letters.
    """
    size = f"(length(word) - {delta})"
    after = f"({size} - {at} - 2)"
    own = f"({at} - {delta})"
    keys = {
        "right": [
            f"xxhash64('a', {size}, {at}, left(word, {at} + 2 + {after} div 2))",
            f"xxhash64('b', {size}, {at}, left(word, {at} + 2), right(word, {after} - {after} div 2))",
        ],
        "left": [
            f"xxhash64('c', {size}, {own}, right(word, {size} - {own} div 2))",
            f"xxhash64('d', {size}, {own}, left(word, {own} div 2), substring(word, {at} + 1))",
        ],
    }
    return ", ".join(k for side in sides.split() for k in keys[side])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs a < b of different rows of ``words`` (word, n) that are one edit apart.

    Words must be distinct, without NULLs, and have at least ``MIN_LETTERS`` code points. No group of words is paired
    with itself by a shared bigram alone; the work for one word grows with its length and the number of
    its rarest bigrams.
    """
    frame = words.select("word", "n")
    grams = frame.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    # bigrams of 26 + 64 letters: at most 8,100 rows
    counts = {r.gram: r["count"] for r in grams.groupBy("gram").count().collect()}
    rank = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}

    def pivotal(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [prefix_and_pivots(w, counts, rank) for w in batch.to_pylist()]
            prefix, left, right, last = zip(*found, strict=True) if found else ([],) * 4
            yield pa.StructArray.from_arrays(
                [pa.array(prefix, pa.list_(pa.int32())), *(pa.array(c, pa.int32()) for c in (left, right, last))],
                names=["prefix", "left", "right", "last"],
            )

    marked = stage(frame.withColumn("p", F.arrow_udf(pivotal, "struct<prefix:array<int>, left:int, right:int, last:int>")("word")).select("word", "n", "p.*"), "pivots")
    probes = marked.select(F.explode(F.expr(f"array({_keys('`left`', '0', 'right')}, {_keys('`right`', '0', 'left')})")).alias("key"), F.struct("word", "n", "last").alias("x"))
    places = marked.select("word", "n", "last", F.explode("prefix").alias("at")).select("*", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("delta"))
    right, left = (f"array({_keys('at', 'delta', side)})" for side in ("right", "left"))
    # a place beside the partner's end, or before its beginning, has keys of one side only
    both = f"concat(if(at + 2 <= length(word) - delta, {right}, array()), if(at >= delta, {left}, array()))"
    index = places.select(F.explode(F.expr(both)).alias("key"), F.struct("word", "n", "last").alias("y"))
    # Spark sizes both sides as the staged table before its rows are exploded, which may seem small enough to broadcast
    found = probes.hint("merge").join(index, "key").where(
        "x.last <= y.last AND x.word != y.word AND abs(length(x.word) - length(y.word)) <= 1 AND levenshtein(x.word, y.word, 1) = 1"
    )
    first = F.col("x.word") < F.col("y.word")
    a, b = F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x"))
    return found.select(a["word"].alias("a"), a["n"].alias("n_a"), b["word"].alias("b"), b["n"].alias("n_b")).distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the last of the chain word, form, its form, ...

    Every round doubles the steps taken. Counts at least double along a chain, so it is short and has no cycle.
    """
    state = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # a staged table of words is several times larger in memory than its files, by which Spark would broadcast it
        moved = stage(state.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(state)
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n), as ``vocabulary`` gives them.

    Near words are one insertion, deletion or replacement apart. ``form`` is the near word of largest n
    (ties: least in code-point order) if that n is at least twice the word's, else NULL; ``root`` the last
    of the chain of forms, the word itself if it has none. An empty table has no rows.
    """
    pairs = near_pairs(words)
    arcs = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("m"), F.col("b").alias("near")),
                                          F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("m"), F.col("a").alias("near")))).alias("arc"))
    best = arcs.groupBy("arc.word").agg(F.count("*").alias("n_near"), F.min(F.struct("arc.m", "arc.near")).alias("best"))
    joined = words.join(best, "word", "left")
    chosen = -F.col("best.m") >= FORM_FACTOR * F.col("n")
    table = stage(
        joined.select(
            "word",
            F.when(chosen, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(chosen, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    roots = _rooted(table.where("form IS NOT NULL"))
    return table.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(documents: DataFrame, typo_rate: int | None = None) -> DataFrame:
    """``variants`` of the whole ``vocabulary`` of documents (doc_id, text); other columns are ignored."""
    return variants(stage(vocabulary(documents, typo_rate), "words"))
