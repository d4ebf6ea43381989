"""Removal of repeated substrings: bytes under a long string that a document of smaller id has too.

Every window of ``length`` bytes is named by its anchor, the 24-byte string of least hash inside it:
equal windows have equal anchors at equal offsets. So a few hundredths of the positions stand for all.

1. Slices of documents send the codes of their anchors to buckets; a bucket answers each slice with
   the codes that a second document has.
2. Slices send the surroundings of those anchors, each different one once with its least doc_id. In a
   bucket, the surroundings of an anchor are sorted by what follows it. Prepending the byte before
   (the Burrows-Wheeler column of that order) refines each interval into the intervals of one byte
   more to the left; all intervals advance together, breadth first, and common prefixes follow from
   the interval's. A step's intervals of at least ``length`` common bytes are the classes of equal
   windows; intervals of one member are not extended, and nothing beyond ``length`` is derived.
   An anchor that very many places share (a common phrase with different text beside it) is not
   gathered: each slice sends its different windows over it by their hashes, once with the least
   doc_id, and they spread over all buckets, so no task holds more than one entry per slice of any.
3. Slices get the marks of their surroundings back and cut the bytes.

Rows between the steps are packed arrays, so Spark shuffles few, small rows. No text is sent between
steps but for the surroundings. Slices and buckets grow in number with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moralens.llm.text import BASE, BASE_INVERSE, bytes_of, mixed, powers, slices

ANCHOR = 24
LENGTH = 50
DOCUMENTS_PER_SLICE = 1024
SLICES_PER_BUCKET = 4
PART_BYTES = 1 << 21
LEAST_SLICES = 32
CODE_BITS = 40  # codes only select candidates; bytes decide
HOT_ENTRIES = 1 << 16  # anchors of more entries go by windows
FEW = 8  # occurrences in one part of a slice that count as one entry
LAST = np.iinfo(np.int64).max


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` bytes, by doubling."""
    out, covered = None, 0
    run, size = text.astype(np.uint64) + np.uint64(1), 1
    rest = width
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out = run
                else:
                    n = max(len(text) - covered - size + 1, 0)
                    out = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + run[covered : covered + n]
                covered += size
            rest >>= 1
            if rest:
                n = max(len(run) - size, 0)
                run = run[:n] * np.uint64(pow(BASE, size, 1 << 64)) + run[size : size + n]
                size *= 2
    return mixed(out)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values."""
    pick = np.minimum if least else np.maximum
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = pick(values[: len(values) - (width - size)], values[width - size :])
    return values


class Anchors:
    """Anchors of some documents' bytes: where they are, their hashes, and the windows they name."""

    def __init__(self, text: np.ndarray, rows: np.ndarray, length: int) -> None:
        self.text, self.rows, self.length = text, rows, length
        self.span = length - ANCHOR + 1  # anchors that fit into a window
        if len(text) < length:
            self.at = np.zeros(0, dtype=np.int64)
            self.hashes = np.zeros(0, dtype=np.uint64)
            self.row = np.zeros(0, dtype=np.int64)
            self.windows = np.zeros(0, dtype=np.uint64)
            return
        hashes = np.maximum(rolling(text, ANCHOR), np.uint64(1))
        windows = sliding(hashes, self.span, True)
        end = np.repeat(rows[1:], np.diff(rows))[: len(windows)]
        windows = np.where(np.arange(len(windows)) + length > end, np.uint64(0), windows)
        edge = np.zeros(self.span - 1, dtype=np.uint64)
        self.windows = np.concatenate([edge, windows, edge])
        self.at = np.flatnonzero(sliding(self.windows, self.span, False) == hashes)
        self.hashes = hashes[self.at]
        self.row = np.searchsorted(rows, self.at, side="right") - 1

    def codes(self) -> np.ndarray:
        return self.hashes >> np.uint64(64 - CODE_BITS)

    def offsets(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chosen anchor, how many bytes before it its last and its first window begin."""
        near = np.empty(len(chosen), dtype=np.int64)
        far = np.empty(len(chosen), dtype=np.int64)
        for i in range(0, len(chosen), 1 << 16):
            part = chosen[i : i + (1 << 16)]
            # windows begin from span - 1 bytes before the anchor up to the anchor itself
            own = self.windows[self.at[part][:, None] + np.arange(self.span)] == self.hashes[part][:, None]
            far[i : i + (1 << 16)] = self.span - 1 - own.argmax(axis=1)
            near[i : i + (1 << 16)] = own[:, ::-1].argmax(axis=1)
        return near, far


def surrounding_keys(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray, length: int) -> np.ndarray:
    """64-bit keys of the bytes under an anchor's windows and of their place around it."""
    with np.errstate(over="ignore"):
        begin, end = at - far, at - near + length
        value = (sums[end] - sums[begin]) * inverse[begin]
        return mixed(mixed(value) + far.astype(np.uint64) * np.uint64(64) + near.astype(np.uint64))


def prefix_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(text)), out=sums[1:])
    return sums, powers(BASE_INVERSE, len(text) + 1)


def window_keys(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """64-bit keys of the ``length`` bytes from ``begin`` on."""
    with np.errstate(over="ignore"):
        return mixed((sums[begin + length] - sums[begin]) * inverse[begin])


def equal_windows(group: np.ndarray, near: np.ndarray, far: np.ndarray, owner: np.ndarray, around: np.ndarray, length: int) -> np.ndarray:
    """For each surrounding, a bit for each window offset at which a smaller owner has the same window.

    ``around`` holds span - 1 bytes before the anchor and ``length`` bytes from it on; bytes outside
    the surrounding's own windows do not matter. ``group`` tells the anchors apart.
    """
    n, before = len(group), around.shape[1] - length
    marks = np.zeros(n, dtype=np.uint64)
    if n == 0:
        return marks
    # the suffix order at the anchor: by the bytes that follow, eight at a time
    padded = np.zeros((n, -(-length // 8) * 8), dtype=np.uint8)
    padded[:, :length] = around[:, before:]
    keys = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((*keys.T[::-1], group))
    # common prefix with the one before; below zero where an interval ends
    common = np.full(n + 1, -1, dtype=np.int64)
    differs = around[order[1:], before:] != around[order[:-1], before:]
    common[1:n] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    common[1:n][group[order[1:]] != group[order[:-1]]] = -1
    for offset in range(before + 1):
        # windows that begin ``offset`` bytes before the anchor
        takes = (near[order] <= offset) & (offset <= far[order])
        starts = np.flatnonzero(common[: len(order)] < length - offset)
        least = np.minimum.reduceat(np.where(takes, owner[order], LAST), starts)
        first = np.repeat(least, np.diff(np.append(starts, len(order))))
        marked = takes & (first < owner[order])
        marks[order[marked]] |= np.uint64(1) << np.uint64(offset)
        if offset == before:
            break
        # intervals of one member need no extension
        alone = (common[: len(order)] < 0) & (common[1 : len(order) + 1] < 0)
        if alone.any():
            order, common = order[~alone], np.append(common[: len(order)][~alone], -1)
            if not len(order):
                break
        byte = around[order, before - 1 - offset].astype(np.int64)
        extended = np.cumsum(common[: len(order)] < 0) * 256 + byte
        moved = np.argsort(extended, kind="stable")
        # between neighbours of the new order the prefix is the least of the old order's in between
        pairs = np.empty(2 * len(moved), dtype=np.int64)
        pairs[0::2] = np.concatenate([[0], moved[:-1] + 1])
        pairs[1::2] = moved + 1
        same = np.concatenate([[False], extended[moved[1:]] == extended[moved[:-1]]])
        pairs[0::2][~same] = moved[~same]
        between = np.minimum.reduceat(common, pairs)[0::2]
        common = np.append(np.where(same, between, -1), -1)
        order = order[moved]
    return marks


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _chunk(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _parts(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a table in parts of bounded bytes: first row, last row, bytes, row offsets."""
    flat, offsets = bytes_of(_chunk(table, "text"))
    for start, stop in slices(offsets, PART_BYTES):
        own = offsets[start : stop + 1]
        yield start, stop, flat[own[0] : own[-1]], own - own[0]


def _packed(**arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed, behind their length."""
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _cut(packed: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays (type, values per entry) that ``_packed`` has joined."""
    blob = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    width = sum(np.dtype(kind).itemsize * n for kind, n in kinds)
    entries, at, out = len(blob) // width, 0, []
    for kind, n in kinds:
        values = np.frombuffer(blob, dtype=kind, count=entries * n, offset=at)
        at += values.nbytes
        out.append(values.reshape(entries, n) if n > 1 else values)
    return out


def _occurrences(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte's upper seven bits: zero for less than FEW, else the number of binary digits."""
    return np.where(counts < FEW, 0, np.frexp(counts.astype(float))[1]).astype(np.uint8) << np.uint8(1)


def _entries(seen: np.ndarray) -> np.ndarray:
    """What counts of ``_occurrences`` stand for, at most; fewer than FEW are one."""
    return np.int64(1) << (seen >> np.uint8(1)).astype(np.int64)


def _joined(blobs: list, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of several packed rows, one after the other."""
    cuts = [_cut(b, *kinds) for b in blobs]
    if cuts:
        return [np.concatenate([c[k] for c in cuts]) for k in range(len(kinds))]
    return [np.zeros((0, n) if n > 1 else 0, dtype=kind) for kind, n in kinds]


def _code_bytes(codes: np.ndarray) -> np.ndarray:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CODE_BITS // 8]


def _codes(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, : CODE_BITS // 8] = raw
    return wide.view("<u8").reshape(-1)


def repeated_bytes(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``documents``.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller
    doc_id; overlaps count, and all is judged on the input. Texts are UTF-8 bytes, NULL is empty.
    Rows that share a doc_id do not make each other repeat; rows with a NULL id come after all others.
    """
    if length < ANCHOR + 1 or length - ANCHOR + 1 > 63:
        raise ValueError(f"length must be between {ANCHOR + 1} and {ANCHOR + 62}")
    n_slices = max(LEAST_SLICES, documents.count() // DOCUMENTS_PER_SLICE)
    n_buckets = max(LEAST_SLICES, n_slices // SLICES_PER_BUCKET)
    before = length - ANCHOR

    def bucket_of(codes: np.ndarray) -> np.ndarray:
        return (mixed(codes) % np.uint64(n_buckets)).astype(np.int64)

    def by_bucket(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        buckets = bucket_of(codes)
        order = np.argsort(buckets, kind="stable")
        bounds = np.flatnonzero(np.diff(buckets[order], prepend=-1))
        for start, stop in zip(bounds, np.append(bounds[1:], len(order))[: len(bounds)], strict=True):
            yield int(buckets[order[start]]), order[start:stop]

    def send_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchor codes of each slice, whether two documents of this part share them, and how often they occur."""
        for batch in batches:
            ids, numbers = _ids(batch.column("doc_id")), batch.column("slice").to_numpy()
            buckets, blobs = [], []
            for start, stop, text, rows in _parts(batch):
                anchors = Anchors(text, rows, length)
                codes, own, doc = anchors.codes(), numbers[start:stop][anchors.row], ids[start:stop][anchors.row]
                order = np.lexsort((doc, own, codes))
                codes, own, doc = codes[order], own[order], doc[order]
                fresh = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (own[1:] != own[:-1])]))[: len(codes)]
                if not len(codes):
                    continue
                last = np.append(fresh[1:], len(codes)) - 1
                codes, own, twice = codes[fresh], own[fresh], (doc[fresh] != doc[last]) | _occurrences(last - fresh + 1)
                order = np.argsort(own, kind="stable")
                codes, own, twice = codes[order], own[order], twice[order]
                for bucket, chosen in by_bucket(codes):
                    buckets.append(bucket)
                    blobs.append(
                        _packed(
                            own=own[chosen].astype("<u4"), code=_code_bytes(codes[chosen]), twice=twice[chosen].astype(np.uint8)
                        )
                    )
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def answer_codes(table: pa.Table) -> pa.Table:
        """Per slice, the codes that occur in another part or slice, or twice in one, and whether they are hot."""
        cuts = [_cut(b.as_py(), ("<u4", 1), ("u1", CODE_BITS // 8), ("u1", 1)) for b in _chunk(table, "blob")]
        own, raw, twice = (np.concatenate([c[k] for c in cuts]) for k in range(3))
        codes = _codes(raw)
        order = np.argsort(codes, kind="stable")
        codes, own, twice = codes[order], own[order], twice[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        sizes = np.diff(np.append(starts, len(codes)))
        # entries of one slice from different parts count too: they are different rows
        shared = np.repeat((sizes > 1) | (np.maximum.reduceat(twice & np.uint8(1), starts) > 0), sizes)
        hot = np.repeat(np.add.reduceat(_entries(twice), starts) > HOT_ENTRIES, sizes)
        codes, own, hot = codes[shared], own[shared], hot[shared]
        order = np.lexsort((codes, own))
        codes, own, hot = codes[order], own[order], hot[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))[: len(own)]
        stops = np.append(starts[1:], len(own))[: len(starts)]
        found = []
        for a, b in zip(starts, stops, strict=True):
            once, at = np.unique(codes[a:b], return_index=True)
            found.append(_packed(code=_code_bytes(once), hot=hot[a:b][at].astype(np.uint8)))
        return pa.table({"slice": pa.array(own[starts].astype(np.int64)), "reply": pa.array(found, pa.binary())})

    def chosen_surroundings(anchors: Anchors, wanted: np.ndarray):
        """Anchors with a wanted code, and the keys and offsets of what surrounds them."""
        codes = anchors.codes()
        at = np.searchsorted(wanted, codes)
        chosen = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == codes) if len(wanted) else np.zeros(0, dtype=np.int64)
        near, far = anchors.offsets(chosen)
        sums, inverse = prefix_sums(anchors.text)
        keys = surrounding_keys(sums, inverse, anchors.at[chosen], near, far, length)
        return chosen, codes[chosen], keys, near, far

    def hot_windows(anchors: Anchors, chosen: np.ndarray, codes: np.ndarray, near: np.ndarray, far: np.ndarray):
        """For each window offset, which of the chosen anchors have it, where it begins, and its key."""
        if not len(chosen):
            return
        sums, inverse = prefix_sums(anchors.text)
        for offset in range(before + 1):
            here = np.flatnonzero((near <= offset) & (offset <= far))
            begin = anchors.at[chosen[here]] - offset
            yield here, begin, window_keys(sums, inverse, begin, length)

    def least_of(codes: np.ndarray, keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each different (code, key) once, with its least doc_id."""
        order = np.lexsort((doc, keys, codes))
        codes, keys, doc = codes[order], keys[order], doc[order]
        fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (keys[1:] != keys[:-1])])[: len(codes)]
        return codes[fresh], keys[fresh], doc[fresh]

    def send_surroundings(texts: pa.Table, replies: pa.Table) -> pa.Table:
        raw, hot = _joined(_chunk(replies, "reply").to_pylist(), ("u1", CODE_BITS // 8), ("u1", 1))
        wanted = _codes(raw)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order] != 0
        ids = _ids(_chunk(texts, "doc_id"))
        found: list[tuple[np.ndarray, ...]] = []
        spread: list[tuple[np.ndarray, ...]] = []
        for start, stop, text, rows in _parts(texts):
            anchors = Anchors(text, rows, length)
            chosen, codes, keys, near, far = chosen_surroundings(anchors, wanted)
            doc = ids[start:stop][anchors.row[chosen]]
            if hot.any() and len(chosen):
                often = hot[np.searchsorted(wanted, codes)]
                own = [(codes[often][here], key, doc[often][here]) for here, _, key in hot_windows(anchors, *(a[often] for a in (chosen, codes, near, far)))]
                if own:
                    spread.append(least_of(*(np.concatenate([o[k] for o in own]) for k in range(3))))
                chosen, codes, keys, near, far, doc = (a[~often] for a in (chosen, codes, keys, near, far, doc))
            order = np.lexsort((doc, keys, codes))
            codes, keys, doc, near, far = codes[order], keys[order], doc[order], near[order], far[order]
            at = anchors.at[chosen[order]]
            fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (keys[1:] != keys[:-1])])[: len(codes)]
            codes, keys, doc, near, far, at = (a[fresh] for a in (codes, keys, doc, near, far, at))
            place = np.arange(-before, length)
            inside = (place >= -far[:, None]) & (place < length - near[:, None])
            around = np.where(inside, text[np.where(inside, at[:, None] + place, 0)] if len(at) else 0, 0).astype(np.uint8)
            found.append((codes, keys, doc, near, far, around))
        if not found:
            none = {"bucket": pa.array([], pa.int64()), "slice": pa.array([], pa.int64())}
            return pa.table({**none, "windows": pa.array([], pa.bool_()), "blob": pa.array([], pa.binary())})
        codes, keys, doc, near, far, around = (np.concatenate([f[k] for f in found]) for k in range(6))
        order = np.lexsort((doc, keys, codes))
        fresh = np.concatenate([[True], (codes[order][1:] != codes[order][:-1]) | (keys[order][1:] != keys[order][:-1])])
        order = order[fresh[: len(order)]]
        codes, keys, doc, near, far, around = (a[order] for a in (codes, keys, doc, near, far, around))
        buckets, blobs = [], []
        for bucket, own in by_bucket(codes):
            buckets.append(bucket)
            blobs.append(
                _packed(
                    code=_code_bytes(codes[own]),
                    key=keys[own].astype("<u8"),
                    doc=doc[own].astype("<i8"),
                    near=near[own].astype(np.uint8),
                    far=far[own].astype(np.uint8),
                    around=around[own],
                )
            )
        n_around = len(blobs)
        if spread:
            codes, keys, doc = least_of(*(np.concatenate([f[k] for f in spread]) for k in range(3)))
            for bucket, own in by_bucket(codes ^ keys):
                buckets.append(bucket)
                blobs.append(_packed(code=_code_bytes(codes[own]), key=keys[own].astype("<u8"), doc=doc[own].astype("<i8")))
        number = _chunk(texts, "slice")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(buckets, pa.int64()),
                "slice": pa.array([number] * len(buckets), pa.int64()),
                "windows": pa.array([k >= n_around for k in range(len(blobs))], pa.bool_()),
                "blob": pa.array(blobs, pa.binary()),
            }
        )

    def answer_windows(table: pa.Table) -> tuple[list[int], list[bytes]]:
        """For each slice's windows over hot anchors, the least doc_id that has it."""
        numbers, blobs = _chunk(table, "slice").to_numpy(), _chunk(table, "blob").to_pylist()
        raw, keys, doc = _joined(blobs, ("u1", CODE_BITS // 8), ("<u8", 1), ("<i8", 1))
        width = CODE_BITS // 8 + 16
        own = np.repeat(numbers, [int.from_bytes(b[:8], "little") // width for b in blobs])
        codes = _codes(raw)
        order = np.lexsort((doc, keys, codes))
        codes, keys, doc, own = codes[order], keys[order], doc[order], own[order]
        fresh = np.concatenate([[True], (codes[1:] != codes[:-1]) | (keys[1:] != keys[:-1])])
        least = doc[fresh][np.cumsum(fresh) - 1]
        order = np.argsort(own, kind="stable")
        codes, keys, least, own = codes[order], keys[order], least[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        found = []
        for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
            found.append(_packed(code=_code_bytes(codes[a:b]), key=keys[a:b].astype("<u8"), least=least[a:b].astype("<i8")))
        return own[starts].tolist(), found

    def answer_bucket(table: pa.Table) -> pa.Table:
        by_windows = _chunk(table, "windows")
        around = table.filter(pc.invert(by_windows))
        numbers, found = answer_surroundings(around) if around.num_rows else ([], [])
        n_around = len(found)
        hot = table.filter(by_windows)
        if hot.num_rows:
            more, replies = answer_windows(hot)
            numbers, found = numbers + more, found + replies
        flags = pa.array([k >= n_around for k in range(len(found))], pa.bool_())
        return pa.table({"slice": pa.array(numbers, pa.int64()), "windows": flags, "reply": pa.array(found, pa.binary())})

    def answer_surroundings(table: pa.Table) -> tuple[list[int], list[bytes]]:
        """For each slice's surroundings, the least doc_id that has it and the marks of that document."""
        kinds = (("u1", CODE_BITS // 8), ("<u8", 1), ("<i8", 1), ("u1", 1), ("u1", 1), ("u1", before + length))
        cuts = [_cut(b.as_py(), *kinds) for b in _chunk(table, "blob")]
        numbers = _chunk(table, "slice").to_numpy()
        own = np.repeat(numbers, [len(c[0]) for c in cuts])
        raw, keys, doc, near, far, around = (np.concatenate([c[k] for c in cuts]) for k in range(6))
        codes = _codes(raw)
        order = np.lexsort((doc, keys, codes))
        c, k = codes[order], keys[order]
        fresh = np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
        one = order[fresh]
        several = np.concatenate([[False], codes[one][1:] == codes[one][:-1]])
        several[:-1] |= several[1:]
        marks = np.zeros(len(one), dtype=np.uint64)
        some = one[several]
        marks[several] = equal_windows(codes[some], near[some].astype(np.int64), far[some].astype(np.int64), doc[some], around[some], length)
        which = np.cumsum(fresh) - 1
        least, marked = doc[one][which], marks[which]
        own = own[order]
        order = np.argsort(own, kind="stable")
        c, k, least, marked, own = c[order], k[order], least[order], marked[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        found = []
        for a, b in zip(starts, np.append(starts[1:], len(own)), strict=True):
            found.append(
                _packed(
                    code=_code_bytes(c[a:b]), key=k[a:b].astype("<u8"), least=least[a:b].astype("<i8"), marks=marked[a:b].astype("<u8")
                )
            )
        return own[starts].tolist(), found

    def cut_bytes(texts: pa.Table, replies: pa.Table) -> pa.Table:
        by_windows = _chunk(replies, "windows")
        cool = _chunk(replies.filter(pc.invert(by_windows)), "reply").to_pylist()
        raw, keys, least, marks = _joined(cool, ("u1", CODE_BITS // 8), ("<u8", 1), ("<i8", 1), ("<u8", 1))
        known = mixed(_codes(raw) ^ keys)
        order = np.argsort(known, kind="stable")
        known, least, marks = known[order], least[order], marks[order]
        hot = _chunk(replies.filter(by_windows), "reply").to_pylist()
        hot_raw, hot_keys, hot_least = _joined(hot, ("u1", CODE_BITS // 8), ("<u8", 1), ("<i8", 1))
        hot_codes, hot_names = np.unique(_codes(hot_raw)), mixed(_codes(hot_raw) ^ hot_keys)
        order = np.argsort(hot_names, kind="stable")
        hot_names, hot_least = hot_names[order], hot_least[order]
        wanted = np.unique(np.concatenate([_codes(raw), hot_codes]))
        ids = _ids(_chunk(texts, "doc_id"))
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for start, stop, text, rows in _parts(texts):
            anchors = Anchors(text, rows, length)
            chosen, codes, keys, near, far = chosen_surroundings(anchors, wanted)
            depth = np.zeros(len(text) + 1, dtype=np.int64)
            if len(chosen) and len(known):
                name = mixed(codes ^ keys)
                at = np.minimum(np.searchsorted(known, name), len(known) - 1)
                hit = known[at] == name
                doc = ids[start:stop][anchors.row[chosen]]
                place = anchors.at[chosen]
                for offset in range(before + 1):
                    here = hit & (near <= offset) & (offset <= far)
                    own_mark = (marks[at] >> np.uint64(offset)) & np.uint64(1) != 0
                    begin = place[here & ((doc > least[at]) | ((doc == least[at]) & own_mark))] - offset
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + length, -1)
            often = np.isin(codes, hot_codes)
            doc = ids[start:stop][anchors.row[chosen]][often]
            for here, begin, key in hot_windows(anchors, *(a[often] for a in (chosen, codes, near, far))):
                name = mixed(codes[often][here] ^ key)
                at = np.minimum(np.searchsorted(hot_names, name), len(hot_names) - 1)
                begin = begin[(hot_names[at] == name) & (doc[here] > hot_least[at])]
                np.add.at(depth, begin, 1)
                np.add.at(depth, begin + length, -1)
            gone = np.cumsum(depth[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edge = rows[:-1][rows[:-1] < len(text)]
            first[edge] = gone[edge]
            removed = np.concatenate([[0], np.cumsum(gone)])
            spans = np.concatenate([[0], np.cumsum(first)])
            n_bytes += np.diff(rows).tolist()
            n_removed += (removed[rows[1:]] - removed[rows[:-1]]).tolist()
            n_spans += (spans[rows[1:]] - spans[rows[:-1]]).tolist()
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                part = text[a:b]
                kept = part if removed[a] == removed[b] else part[~gone[a:b]]
                digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
        return pa.table(
            {
                "doc_id": _chunk(texts, "doc_id"),
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(n_spans, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    # ids are compared by value, so rows that share an id, or have none, need not share a slice
    sliced = documents.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slices)).alias("slice"), "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    codes = sliced.mapInArrow(send_codes, "bucket bigint, blob binary")
    shared = codes.groupBy("bucket").applyInArrow(answer_codes, "slice bigint, reply binary")
    around = (
        sliced.groupBy("slice")
        .cogroup(shared.groupBy("slice"))
        .applyInArrow(send_surroundings, "bucket bigint, slice bigint, windows boolean, blob binary")
    )
    marks = around.groupBy("bucket").applyInArrow(answer_bucket, "slice bigint, windows boolean, reply binary")
    return (
        sliced.groupBy("slice")
        .cogroup(marks.groupBy("slice"))
        .applyInArrow(cut_bytes, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    )
