"""Exact top-k BM25 search with block-max pruning, per shard, merged with global statistics.

Shards are runs of the input's rows; each is indexed where it is read: sorted terms, their postings
and their frequencies. Document frequencies, the number of documents and their mean length come from
all shards, so scores of different shards compare.

Lists that hold a sixteenth of a shard's documents or more say little and cost most: they are rows of
a matrix, and one product adds them up for many queries. A shard takes the other terms of a query of
few terms by falling upper bound. After each group of lists, a document's bound is its score so far and,
for the lists still to come, first their maxima and then the maxima of its block. Documents whose bound
does not reach the k-th best score so far are out; once scoring those left from their own terms is
cheaper than the lists to come, these are not read at all.

Bounds of hundreds of terms are far above the scores and let nothing out. The other lists of long queries
are read whole and added up for many queries at once; only documents that reach the query's floor, or the
shard's k-th best where there is none, are scored again from their own terms.

The final scores are summed in term order from all of a document's terms, so neither the shards nor
the order of the lists change them, and ties go to the smaller doc_id. Queries go through the shards in blocks of bounded bytes; a block is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moralens.llm.text import bytes_of, mixed, normalised, slices, word_hashes
from moralens.staging import LARGE_ROWS, stage

K1, B = 1.2, 0.75
TOP = 10
SHARD_BYTES = 1 << 23
FIRST_SHARDS = 4  # that a query goes through in the first round
ROUND_GROWTH = 8  # of the shards behind a floor from round to round
BLOCK_DOCUMENTS = 64
QUERY_BLOCK_BYTES = 1 << 25
DENSE_PART = 16
QUERIES_AT_ONCE = 256
CELLS_AT_ONCE = 1 << 20  # of the matrices of such queries
POSTINGS_AT_ONCE = 1 << 16
SHORT_QUERY = 4  # lists that queries with bounds have at most
LOOKUP_COST = 4  # of a posting read by document, against one read by list
SLACK = 1e-5  # bounds and scores are sums in different orders

FOUND = "query_id bigint, doc_id bigint, score double"
INDEX = "shard binary, n_docs bigint, n_words bigint"


def counted_terms(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, frequency) sorted by term and row, and the words of each row."""
    parts, lengths = [], []
    for start, stop in slices(offsets):
        hashes, bounds = word_hashes(flat, offsets[start : stop + 1])
        lengths.append(np.diff(bounds))
        row = np.repeat(np.arange(start, stop, dtype=np.int32), lengths[-1])
        order = np.argsort(hashes, kind="stable")  # rows stay in order
        hashes, row = hashes[order], row[order]
        fresh = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])[: len(hashes)])
        parts.append((hashes[fresh], row[fresh], np.diff(np.append(fresh, len(hashes))).astype(np.int32)))
    # parts are in row order, and no row is in two
    term = np.concatenate([p[0] for p in parts])
    order = np.argsort(term, kind="stable")
    row, frequency = (np.concatenate([p[k] for p in parts])[order] for k in (1, 2))
    return term[order], row, frequency, np.concatenate(lengths)


def pack_shard(ids: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[bytes, int]:
    term, row, frequency, lengths = counted_terms(flat, offsets)
    terms, sizes = np.unique(term, return_counts=True)
    head = np.array([len(ids), len(terms), len(row)], dtype="<i8")
    parts = (ids.astype("<i8"), lengths.astype("<i4"), terms.astype("<u8"), sizes.astype("<i4"), row.astype("<i4"), frequency.astype("<i4"))
    return head.tobytes() + b"".join(p.tobytes() for p in parts), int(lengths.sum())


def _entries(lists: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of some lists, and the list (by order) of each."""
    sizes = starts[lists + 1] - starts[lists]
    which = np.repeat(np.arange(len(lists)), sizes)
    return np.arange(len(which)) + np.repeat(starts[lists] - np.cumsum(sizes) + sizes, sizes), which


class Shard:
    """An unpacked shard, with impacts once the mean length is known."""

    def __init__(self, blob: bytes) -> None:
        n, v, p = np.frombuffer(blob, "<i8", 3)
        at = 24
        out = []
        for kind, size in (("<i8", n), ("<i4", n), ("<u8", v), ("<i4", v), ("<i4", p), ("<i4", p)):
            out.append(np.frombuffer(blob, kind, size, at))
            at += out[-1].nbytes
        self.ids, self.lengths, self.terms, self.sizes, self.docs, self.frequency = out
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])

    def local_counts(self, terms: np.ndarray) -> np.ndarray:
        """Documents of this shard that have each term."""
        at, there = self.find(terms)
        out = np.zeros(len(terms), dtype=np.int64)
        out[there] = self.sizes[at[there]]
        return out

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.terms):
            return np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=bool)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, self.terms[at] == terms

    def prepare(self, mean_length: float, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Keeps the lists of some sorted terms, with ``weights`` their idf; the number of each one's list, -1 if none."""
        place, there = self.find(terms)
        kept, weights = place[there], weights[there]
        numbers = np.full(len(terms), -1, dtype=np.int64)
        numbers[there] = np.arange(len(kept))
        at, _ = _entries(kept, self.starts)
        self.terms, self.sizes, self.docs, self.frequency = self.terms[kept], self.sizes[kept], self.docs[at], self.frequency[at]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        n, v = len(self.ids), len(self.terms)
        norm = K1 * (1 - B + B * self.lengths / max(mean_length, 1e-9))
        tf = self.frequency.astype(float)
        self.impact = tf * (K1 + 1) / (tf + norm[self.docs]) * np.repeat(weights, self.sizes)
        # the same postings by row, in term order; sorting is in linear time for numbers of 16 bits
        by_row = np.argsort(self.docs.astype(np.uint16) if n <= 1 << 16 else self.docs, kind="stable")
        self.row_terms = np.repeat(np.arange(v, dtype=np.int32), self.sizes)[by_row]
        self.row_impact = self.impact[by_row]
        self.row_starts = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=n))])
        # the terms that some queries have, a row for each query
        self.asked = np.zeros((max(1, min(QUERIES_AT_ONCE, CELLS_AT_ONCE // max(v, 1))), v), dtype=bool)
        common = np.flatnonzero(self.sizes * DENSE_PART >= n)
        self.dense_number = np.full(v, -1, dtype=np.int64)
        self.dense_number[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), dtype=np.float32)
        at, which = _entries(common, self.starts)
        self.dense[which, self.docs[at]] = self.impact[at]
        # a product in single precision is off by a rounding a term at most, and so is what it is compared with
        self.slack = SLACK + 2.0**-23 * len(common)
        self.block_starts = None
        return numbers

    def _find_maxima(self) -> None:
        """The greatest impact of each list, and of each of its blocks: (list, block) runs of the postings."""
        if self.block_starts is not None:
            return
        self.n_blocks = -(-len(self.ids) // BLOCK_DOCUMENTS)
        self.greatest = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.terms) else np.zeros(0)
        block = self.docs // BLOCK_DOCUMENTS
        owner = np.repeat(np.arange(len(self.terms)), self.sizes)
        fresh = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])[: len(block)])
        self.block_of = block[fresh]
        self.block_max = np.maximum.reduceat(self.impact, fresh) if len(fresh) else np.zeros(0)
        self.block_starts = np.searchsorted(fresh, self.starts)

    def queries_at_once(self) -> int:
        """So many that neither their scores nor their dense terms take many cells."""
        return max(1, min(QUERIES_AT_ONCE, CELLS_AT_ONCE // max(len(self.ids), len(self.dense), 1)))

    def search_all(self, query: np.ndarray, lists: np.ndarray, top: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): the ``top`` best documents of each query with a positive score of its floor or more.

        ``lists`` are numbers of terms that the shard has, in term order, query by query; ``query`` numbers
        the query of each, from 0 to the number of ``floors``.
        """
        bounds = np.searchsorted(query, np.arange(len(floors) + 1))
        short = np.diff(bounds) <= SHORT_QUERY
        scores = self._common_scores(query, lists, len(floors))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in np.flatnonzero(short & (np.diff(bounds) > 0)):
            rows, exact = self.search(lists[bounds[i] : bounds[i + 1]], top, scores[i], floors[i])
            found.append((np.full(len(rows), i), rows, exact))
        if not short.all():
            self._add_sparse(scores, query, lists, ~short)
            which, rows = self._reaching(scores, floors, top, ~short)
            exact = self._exact(which, rows, bounds, lists)
            good = np.flatnonzero((exact > 0) & (exact >= floors[which]))
            good = good[np.lexsort((self.ids[rows[good]], -exact[good], which[good]))]
            place = np.arange(len(good)) - np.searchsorted(which[good], which[good])
            good = good[place < top]
            found.append((which[good], rows[good], exact[good]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _common_scores(self, query: np.ndarray, lists: np.ndarray, n_queries: int) -> np.ndarray:
        """What the dense lists add to each document's score, for each query."""
        matrix = np.zeros((n_queries, len(self.dense)), dtype=np.float32)
        number = self.dense_number[lists]
        dense = np.flatnonzero(number >= 0)
        matrix[query[dense], number[dense]] = 1.0
        return matrix @ self.dense

    def _add_sparse(self, scores: np.ndarray, query: np.ndarray, lists: np.ndarray, wanted: np.ndarray) -> None:
        """Adds the lists that are not dense to the scores of the wanted queries."""
        n = len(self.ids)
        use = np.flatnonzero((self.dense_number[lists] < 0) & wanted[query])
        query, lists = query[use], lists[use]
        sizes = self.sizes[lists].astype(np.int64)
        ends = np.cumsum(sizes)
        shift = self.starts[lists] - ends + sizes
        first = 0
        while first < len(lists):
            done = int(ends[first] - sizes[first])
            stop = max(first + 1, int(np.searchsorted(ends, done + POSTINGS_AT_ONCE, side="right")))
            low, high, own = query[first], query[stop - 1] + 1, sizes[first:stop]
            at = np.repeat(shift[first:stop], own)
            at += np.arange(done, ends[stop - 1])
            cell = np.repeat((query[first:stop] - low) * n, own)
            cell += self.docs[at]
            scores[low:high] += np.bincount(cell, weights=self.impact[at], minlength=(high - low) * n).reshape(high - low, n)
            first = stop

    def _reaching(self, scores: np.ndarray, floors: np.ndarray, top: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the scores that may be among the ``top`` best of their query and reach its floor."""
        least = np.where(wanted, np.maximum(floors * (1 - self.slack), np.finfo(np.float32).tiny), np.inf)
        reached = scores >= least[:, None].astype(np.float32)
        for i in np.flatnonzero(np.count_nonzero(reached, axis=1) > top):
            own = scores[i, reached[i]]
            reached[i] &= scores[i] >= np.partition(own, len(own) - top)[len(own) - top] * (1 - self.slack)
        return np.nonzero(reached)

    def search(self, lists: np.ndarray, top: int, common: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``top`` best documents with a positive score of ``floor`` or more, for one query.

        ``lists`` are numbers of terms that the shard has, in term order, ``common`` is what the dense
        ones among them add to each document.
        """
        n = len(self.ids)
        if not len(lists):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        self._find_maxima()
        threshold = least = floor * (1 - self.slack)
        if self.greatest[lists].sum() < least:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        sparse = lists[self.dense_number[lists] < 0]
        bounds = self.greatest[sparse]
        order = sparse[np.argsort(-bounds, kind="stable")]
        work = np.cumsum(self.sizes[order])
        rest = np.append(np.cumsum(np.sort(bounds))[::-1], 0.0)
        score = common.astype(float)
        done, step, alive = 0, max(2 * n, 256), np.arange(n)
        while done < len(order):
            upto = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + step, side="right")))
            at, _ = _entries(order[done:upto], self.starts)
            score += np.bincount(self.docs[at], weights=self.impact[at], minlength=n)
            done = upto
            if done < len(order):
                # scores so far only grow, so the k-th best of them is a lower bound of the final one
                own = np.partition(score, n - top)[n - top] * (1 - self.slack) if n > top else 0.0
                threshold = max(least, own)
                alive = np.flatnonzero(score + rest[done] >= threshold)
                if threshold > 0 and LOOKUP_COST * self.row_starts[-1] / n * len(alive) < work[-1] - work[done - 1]:
                    break
        ends = np.array([0, len(lists)])
        if done < len(order):
            # block maxima of the lists not read bound the rest more closely
            at, _ = _entries(order[done:], self.block_starts)
            ahead = np.bincount(self.block_of[at], weights=self.block_max[at], minlength=self.n_blocks)
            alive = alive[score[alive] + ahead[alive // BLOCK_DOCUMENTS] >= threshold]
            score = np.zeros(n)
            score[alive] = self._exact(np.zeros(len(alive), dtype=np.int64), alive, ends, lists)
        cut = least
        if len(alive) > top:
            cut = max(cut, np.partition(score[alive], len(alive) - top)[len(alive) - top] * (1 - self.slack))
        alive = alive[score[alive] >= cut]
        exact = self._exact(np.zeros(len(alive), dtype=np.int64), alive, ends, lists)
        good = (exact > 0) & (exact >= floor)
        alive, exact = alive[good], exact[good]
        chosen = np.lexsort((self.ids[alive], -exact))[:top]
        return alive[chosen], exact[chosen]

    def _exact(self, query: np.ndarray, rows: np.ndarray, bounds: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Scores of some rows, each for its query, from the rows' own terms, summed in the order of the terms.

        ``query`` is in order; the lists of query q are those from ``bounds[q]`` to ``bounds[q + 1]``.
        """
        n_asked, v = self.asked.shape
        flat = self.asked.reshape(-1)
        out = np.zeros(len(rows))
        cost = np.cumsum(self.row_starts[rows + 1] - self.row_starts[rows])
        start = 0
        while start < len(rows):
            most = (cost[start - 1] if start else 0) + POSTINGS_AT_ONCE
            stop = max(start + 1, min(np.searchsorted(query, query[start] + n_asked), np.searchsorted(cost, most, side="right")))
            low, high = query[start], query[stop - 1] + 1
            own = np.repeat(np.arange(high - low) * v, np.diff(bounds[low : high + 1])) + lists[bounds[low] : bounds[high]]
            flat[own] = True
            at, which = _entries(rows[start:stop], self.row_starts)
            shared = np.flatnonzero(flat[((query[start:stop] - low) * v)[which] + self.row_terms[at]])
            out[start:stop] = np.bincount(which[shared], weights=self.row_impact[at[shared]], minlength=stop - start)
            flat[own] = False
            start = stop
        return out


def inverse_frequency(counts: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p((n_docs - counts + 0.5) / (counts + 0.5))


def index_shards(documents: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, n_docs, n_words): packed indexes of all rows, each of about ``shard_bytes`` of text."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if held and size + batch.nbytes > shard_bytes:
                yield from packed(held)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if held:
            yield from packed(held)

    def packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        if not table.num_rows:
            return
        flat, offsets = bytes_of(table.column("words").chunk(0))
        ids = table.column("doc_id").chunk(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for start, stop in slices(offsets, shard_bytes):
            blob, n_words = pack_shard(ids[start:stop], flat, offsets[start : stop + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([blob], pa.binary()), pa.array([stop - start], pa.int64()), pa.array([n_words], pa.int64())],
                names=["shard", "n_docs", "n_words"],
            )

    named = documents.where(F.col("doc_id").isNotNull()).select("doc_id", normalised(F.col("text")).alias("words"))
    return named.mapInArrow(built, INDEX)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, terms): the sorted distinct terms of each query; queries without words drop out."""

    def cut(texts: pa.Array) -> pa.Array:
        flat, offsets = bytes_of(texts)
        found: list[bytes] = []
        for start, stop in slices(offsets):
            hashes, bounds = word_hashes(flat, offsets[start : stop + 1])
            found += [np.unique(hashes[a:b]).astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.array(found, pa.binary())

    terms = F.arrow_udf(cut, "binary")(normalised(F.col("text")))
    return queries.where(F.col("query_id").isNotNull()).select("query_id", terms.alias("terms")).where(F.length("terms") > 0)


def _term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that have each term, over all shards."""
    chunk = 1 << 14

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for blob in batch.column("shard"):
                total += Shard(blob.as_py()).local_counts(terms)
        numbers = list(range(0, len(terms), chunk))
        blobs = [total[i : i + chunk].tobytes() for i in numbers]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["first", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.int64) for b in table.column("counts"))
        return pa.table({"first": table.column("first")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sums = index.select("shard").mapInArrow(counted, "first bigint, counts binary").groupBy("first").applyInArrow(added, "first bigint, counts binary")
    out = np.zeros(len(terms), dtype=np.int64)
    for row in sums.collect():
        out[row["first"] : row["first"] + chunk] = np.frombuffer(row["counts"], np.int64)
    return out


def top_documents(documents: DataFrame, queries: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``top`` best documents of every query.

    ``queries`` has query_id and text; its distinct words are the query. Only documents that share a
    word are ranked; ties go to the smaller doc_id. NULL texts are empty, rows with a NULL id are
    neither searched nor found, repeated rows of the same id are ranked as rows of their own.
    """
    spark = documents.sparkSession
    index = stage(index_shards(documents, shard_bytes), "index", options=LARGE_ROWS)
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_words")]
    n_docs, n_words, n_shards = index.agg(*sums, F.count("*")).first()
    asked = stage(query_terms(queries), "queries")
    total = asked.agg(F.coalesce(F.sum(F.length("terms")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // QUERY_BLOCK_BYTES))
    found = None
    for number in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == number).collect()
        names = np.array([row["query_id"] for row in block], dtype=np.int64)
        cuts = [np.frombuffer(row["terms"], "<u8") for row in block]
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)
        terms, which = np.unique(np.concatenate(cuts) if cuts else np.zeros(0, "<u8"), return_inverse=True)
        if not len(terms):
            continue
        weights = inverse_frequency(_term_counts(index, terms), n_docs)
        mean = n_words / max(n_docs, 1)
        block = (names, bounds, terms, which.astype(np.int32), weights)
        best = None
        floors = np.zeros(len(names))
        for since, upto in rounds(n_shards):
            shared = spark.sparkContext.broadcast((*block, floors))
            hits = index.select("shard").mapInArrow(_searcher(shared, mean, top, since, upto, n_shards), FOUND)
            best = best_of(hits if best is None else best.unionByName(hits), top)
            if upto < n_shards:
                # the k-th best so far is a floor for the shards to come
                best = stage(best, "best")
                reached = best.where(F.col("rank") == top).select("query_id", "score").collect()
                known = {row["query_id"]: row["score"] for row in reached}
                floors = np.array([known.get(int(name), 0.0) for name in names])
                best = best.drop("rank")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return asked.select("query_id", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return found


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of every query with their rank; ties go to the smaller doc_id."""
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def rounds(n_shards: int) -> list[tuple[int, int]]:
    """The runs of shard numbers that the rounds go through: a few first, then ``ROUND_GROWTH`` times as many.

    A shard sends on what reaches the floor, about ``top`` rows for all shards that the floor comes
    from. So a query sends rows with the logarithm of the number of shards, not one ``top`` from each.
    """
    ends = [FIRST_SHARDS]
    while ends[-1] * 2 < n_shards:
        ends.append(ends[-1] * ROUND_GROWTH)
    ends[-1] = max(n_shards, 1)
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _searcher(shared, mean_length: float, top: int, since: int, upto: int, n_shards: int):
    """Searches the shards for the block's queries.

    Each query numbers the shards in an order of its own, by hash, and goes through those from
    ``since`` to ``upto``; two shards may get the same number, but each has one for every query.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bounds, terms, which, weights, floors = shared.value
        for batch in batches:
            for blob in batch.column("shard"):
                shard = Shard(blob.as_py())
                own_number = mixed(shard.ids[:1].astype(np.uint64) + np.uint64(len(shard.docs)))
                number = mixed(mixed(names.astype(np.uint64)) + own_number) % np.uint64(max(n_shards, 1))
                here = (number >= since) & (number < upto)
                numbers = np.flatnonzero(here)
                used = np.zeros(len(terms), dtype=bool)
                used[which[np.repeat(here, np.diff(bounds))]] = True
                asked = np.flatnonzero(used)
                lists = np.full(len(terms), -1, dtype=np.int64)
                lists[asked] = shard.prepare(mean_length, terms[asked], weights[asked])
                queries, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                step = shard.queries_at_once()
                for first in range(0, len(numbers), step):
                    some = numbers[first : first + step]
                    at, query = _entries(some, bounds)
                    own = lists[which[at]]
                    asker, rows, score = shard.search_all(query[own >= 0], own[own >= 0], top, floors[some])
                    queries.append(names[some[asker]])
                    ids.append(shard.ids[rows])
                    scores.append(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (queries, ids, scores)], names=["query_id", "doc_id", "score"]
                )

    return searched
