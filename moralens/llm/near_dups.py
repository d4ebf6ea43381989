"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

A shingle weighs as often as it occurs. Its arrivals are a Poisson process of that rate; each arrival
falls on a random register, and a register keeps the shingle that came first. An element stops once
its time passes the latest register, so long texts cost little more than one arrival per shingle.
Two texts agree in a register with the probability of their probability Jaccard similarity.

Registers are banded. The texts of a bucket are not paired with each other: each round compares the
members of a bucket with a few leaders, and only across components found so far, verified on all
shingles. A leader that has met everybody leaves its bucket, and a bucket whose members are all of one
component is done. Large buckets that two rounds leave open hold texts that look alike to the bands but
often are not similar: these are cut into blocks, and every two blocks meet in a task, which counts
common shingles by inverted lists and sends on no more links than join two components. So no pairs are
spelt out, yet every two texts of a bucket are compared or already of one class: no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from moralens.llm.components import components
from moralens.llm.text import bytes_of, free_name, mixed, normalised, slices, windows_of, word_hashes
from moralens.staging import release, row_count, stage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4  # P(a pair of similarity 0.8 shares no band) = (1 - 0.8^4)^24 = 3e-6
REGISTERS = BANDS * ROWS
CODE_BYTES = 5
SIGNED_BYTES = 1 << 20  # signed at once
LARGE_BUCKET = 24
BLOCK_TEXTS = 256
SLACK = 1e-9
BAND_ROUNDS = 2
BITMAP_WORDS = 1 << 17  # 64-bit words: a filter of 2 MB, whatever the data's size

SIGNED = "print binary, bands array<bigint>, shingles binary"


def weighted_shingles(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit shingle codes of all rows, sorted inside each row, repeats kept; and row offsets.

    Rows of one to four words have one shingle, the row; rows without words have one, zero.
    """
    n = len(rows) - 1
    windows, at = windows_of(hashes, rows, SHINGLE_WORDS)
    lengths = np.diff(rows)
    short = np.flatnonzero(lengths < SHINGLE_WORDS)
    extra = np.zeros(len(short), dtype=np.uint64)
    for k, row in enumerate(short):
        code = np.uint64(lengths[row])
        for h in hashes[rows[row] : rows[row + 1]]:
            code = mixed(np.array([code ^ h], dtype=np.uint64))[0]
        extra[k] = code
    row_of = np.concatenate([np.repeat(np.arange(n), lengths)[at], short])
    codes = np.concatenate([windows, extra]) >> np.uint64(64 - 8 * CODE_BYTES)
    order = np.lexsort((codes, row_of))
    return codes[order], np.searchsorted(row_of[order], np.arange(n + 1))


def prob_min_hash(codes: np.ndarray, bounds: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each row, the code that wins each register (n x registers)."""
    n = len(bounds) - 1
    row_all = np.repeat(np.arange(n), np.diff(bounds))
    fresh = np.ones(len(codes), dtype=bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (row_all[1:] != row_all[:-1])
    first = np.flatnonzero(fresh)
    weight = np.diff(np.append(first, len(codes))).astype(float)
    code, row = codes[first], row_all[first]
    best = np.full((n, registers), np.inf)
    winner = np.zeros((n, registers), dtype=np.uint64)
    flat_best, flat_winner = best.reshape(-1), winner.reshape(-1)
    time = np.zeros(len(code))
    state = mixed(code + np.uint64(1))
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(code):
            step += np.uint64(0x9E3779B97F4A7C15)
            draw = mixed(state + step)
            unit = ((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
            time = time - np.log(unit) / weight
            slot = row * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(flat_best, slot, time)
            won = flat_best[slot] == time
            flat_winner[slot[won]] = code[won]
            open_rows = np.unique(row)
            limit = np.zeros(n)
            limit[open_rows] = best[open_rows].max(axis=1)
            going = time < limit[row]
            code, row, weight, time, state = code[going], row[going], weight[going], time[going], state[going]
    return winner


def band_hashes(winner: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash per band (n x bands); equal bands of different numbers differ."""
    n, registers = winner.shape
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    grouped = winner.reshape(n, bands, registers // bands)
    for k in range(registers // bands):
        out = mixed(out ^ grouped[:, :, k])
    return out


def packed(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // CODE_BYTES, 8), dtype=np.uint8)
    wide[:, :CODE_BYTES] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, CODE_BYTES)
    return wide.view("<u8").reshape(-1)


def signed_texts(texts: pa.Array) -> pa.StructArray:
    """Per normalised text: a digest of its words, its band hashes and its packed shingles."""
    flat, offsets = bytes_of(texts)
    prints: list[bytes] = []
    blobs: list[bytes] = []
    bands: list[np.ndarray] = []
    for start, stop in slices(offsets, SIGNED_BYTES):
        hashes, rows = word_hashes(flat, offsets[start : stop + 1])
        codes, bounds = weighted_shingles(hashes, rows)
        bands.append(band_hashes(prob_min_hash(codes, bounds)))
        for row in range(stop - start):
            words = hashes[rows[row] : rows[row + 1]]
            prints.append(hashlib.blake2b(words.astype("<u8").tobytes(), digest_size=16).digest())
            blobs.append(packed(codes[bounds[row] : bounds[row + 1]]))
    values = np.concatenate(bands).reshape(-1) if bands else np.zeros(0, dtype=np.uint64)
    at = pa.array(np.arange(0, len(prints) * BANDS + 1, BANDS, dtype=np.int32))
    lists = pa.ListArray.from_arrays(at, pa.array(values.view(np.int64)))
    return pa.StructArray.from_arrays(
        [pa.array(prints, pa.binary()), lists, pa.array(blobs, pa.binary())], names=["print", "bands", "shingles"]
    )


def signed_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text_digest, print, bands, shingles of every row."""

    def signed(texts: pa.Array) -> pa.Array:
        return signed_texts(texts)

    text = F.coalesce("text", F.lit(""))
    plain = documents.select("doc_id", F.md5(text).alias("text_digest"), normalised(text).alias("_plain"))
    # a text without words is a word of its own, made of its digest
    words = F.when((F.col("_plain") == "") & (F.col("text_digest") != F.md5(F.lit(""))), F.col("text_digest"))
    signs = F.arrow_udf(signed, SIGNED)(F.coalesce(words, F.col("_plain")))
    return plain.select("doc_id", "text_digest", signs.alias("_s")).select("doc_id", "text_digest", "_s.*")


def probability_jaccard(left: bytes, right: bytes) -> float:
    """Exact probability Jaccard similarity of two packed multisets."""
    x, nx = np.unique(unpacked(left), return_counts=True)
    y, ny = np.unique(unpacked(right), return_counts=True)
    both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = nx[ix].astype(float), ny[iy].astype(float)
    only_x, only_y = nx.sum() - a.sum(), ny.sum() - b.sum()
    ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")  # all of the same ratio count as up to it
    sum_a = np.concatenate([[0.0], np.cumsum(a)])
    sum_b = np.concatenate([[0.0], np.cumsum(b)])
    left_part = (only_x + sum_a[upto]) / a
    right_part = (only_y + sum_b[-1] - sum_b[upto]) / b
    return float((1.0 / (left_part + right_part)).sum())


def similarity(left: Column, right: Column) -> Column:
    def similar(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        pairs = zip(lefts.to_pylist(), rights.to_pylist(), strict=True)
        return pa.array([probability_jaccard(a, b) for a, b in pairs], type=pa.float64())

    return F.arrow_udf(similar, "double")(left, right)


def _bitmap_word(key: Column) -> Column:
    return F.shiftright(F.pmod(F.xxhash64(key), F.lit(BITMAP_WORDS * 64)), 6)


def _bitmap_bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(key).bitwiseAND(F.lit(63)).cast("int"))


def _maybe_in(df: DataFrame, key: str, wanted: DataFrame, name: str = "_maybe") -> DataFrame:
    """``df`` with the column ``name``: false only where the key is not in ``wanted`` (one column)."""
    column = F.col(wanted.columns[0])
    word, bits, one = (free_name(f"{name}_{n}", df) for n in ("word", "bits", "bit"))
    marked = wanted.select(_bitmap_word(column).alias(word), _bitmap_bit(column).alias(one))
    bitmap = marked.groupBy(word).agg(F.bit_or(one).alias(bits))
    tested = df.withColumn(word, _bitmap_word(F.col(key))).join(F.broadcast(bitmap), word, "left")
    maybe = F.coalesce(F.col(bits).bitwiseAND(_bitmap_bit(F.col(key))) != 0, F.lit(False))
    return tested.withColumn(name, maybe).drop(word, bits)


def _only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in ``wanted`` (one column, distinct): a bitmap drops most others before the shuffle.

    The last join is an inner one, as the planner would move a semi join ahead of the bitmap.
    """
    name = wanted.columns[0]
    return _maybe_in(df, key, wanted).where("_maybe").drop("_maybe").join(wanted, F.col(key) == F.col(name)).drop(name)


def linking_pairs(table: pa.Table, threshold: float) -> pa.Table:
    """Links (a, b) that join the components of two blocks' texts: a spanning forest of all links."""
    nodes, components_ = table.column("node").to_pylist(), table.column("component").to_pylist()
    blobs = [b.as_py() for b in table.column("shingles")]
    texts = [np.unique(unpacked(b), return_counts=True) for b in blobs]
    total = np.array([f[1].sum() for f in texts], dtype=float)
    of = np.repeat(np.arange(len(texts)), [len(f[0]) for f in texts])
    codes, weights = (np.concatenate([f[k] for f in texts]) for k in range(2))
    order = np.argsort(codes, kind="stable")
    codes, weights, of = codes[order], weights[order].astype(float), of[order]
    parent = {c: c for c in components_}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    # two different blocks: only pairs across; texts of the commonest component meet the others' searches
    block = np.array(table.column("own").to_pylist())
    one_block = bool((block == block[0]).all())
    commonest = max(parent, key=components_.count)
    searching = np.array([c != commonest for c in components_])
    links = []
    for i in np.flatnonzero(searching):
        own, weight = texts[i]
        low, high = np.searchsorted(codes, own, side="left"), np.searchsorted(codes, own, side="right")
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)
        mine = np.bincount(of[at], weights=np.repeat(weight, sizes), minlength=len(texts))
        theirs = np.bincount(of[at], weights=weights[at], minlength=len(texts))
        # the winner of one text must be common: that share bounds the similarity
        near = (mine >= threshold * total[i] - SLACK) & (theirs >= threshold * total - SLACK)
        for j in np.flatnonzero(near & (one_block | (block != block[i]))):
            x, y = root(components_[i]), root(components_[j])
            if x != y and probability_jaccard(blobs[i], blobs[j]) >= threshold:
                parent[x] = y
                links.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    kind = table.column("node").type
    return pa.table({"a": pa.array([x for x, _ in links], kind), "b": pa.array([y for _, y in links], kind)})


def block_links(facing: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Links between components among the texts that share a bucket of ``facing`` (bucket, node, component).

    Texts joined by buckets form a cluster; a cluster of n texts is cut into about n / BLOCK_TEXTS
    blocks by hash, and every two blocks are a group.
    """
    first = facing.groupBy("bucket").agg(F.min("node").alias("b"))
    clusters = components(facing.join(first, "bucket").select(F.col("node").alias("a"), "b"))
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK_TEXTS)).alias("n_blocks"))
    placed = clusters.join(sizes, "component").select("node", F.col("component").alias("cluster"), "n_blocks")
    placed = placed.join(facing.select("node", "component").distinct(), "node")
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    met = placed.select(
        "node", "component", "cluster", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("_other")
    )
    pair = [F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high")]
    met = met.select("node", "component", "cluster", F.col("_own").alias("own"), *pair)
    texts = met.join(known, "node")

    def linked(table: pa.Table) -> pa.Table:
        return linking_pairs(table, threshold)

    kind = known.schema["node"].dataType.simpleString()
    return texts.groupBy("cluster", "low", "high").applyInArrow(linked, f"a {kind}, b {kind}")


def facing_leaders(members: DataFrame, labels: DataFrame | None, leaders: int) -> DataFrame:
    """Members of the buckets that hold several components, each with its component and the leaders."""
    if labels is None:
        placed = members.withColumn("component", F.col("node"))
    else:
        placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    slot = F.pmod(F.xxhash64("component"), F.lit(leaders))
    one = F.struct("node", "component")
    chosen = placed.groupBy("bucket").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.array_compact(F.array(*[F.min(F.when(slot == k, one)) for k in range(leaders)])).alias("leaders"),
    )
    chosen = stage(chosen.where("low < high").select("bucket", "leaders"), "leaders")
    return stage(placed.join(chosen, "bucket"), "facing")


def classes(nodes: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the nodes that are linked to others.

    ``nodes``: (node, bands), one row per different text; ``shingles``: (node, shingles).
    """
    exploded = nodes.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stage(exploded.join(shared, "bucket"), "members")
    known = _only(shingles, "node", members.select(F.col("node").alias("_wanted")).distinct())
    # repeated rows have one name and one text
    known = stage(known.dropDuplicates(["node"]), "shingles")
    labels: DataFrame | None = None
    for number in range(BAND_ROUNDS):
        facing = facing_leaders(members, labels, 2**number)
        if not row_count(facing):
            break
        pairs = facing.select("node", "component", F.explode("leaders").alias("leader")).where(
            F.col("leader.component") != F.col("component")
        )
        links = similar_pairs(pairs.select("node", F.col("leader.node").alias("other")), known, threshold)
        labels = joined_components(labels, links)
        # a leader has met all other classes of its bucket
        members = facing.where(~F.array_contains("leaders.node", F.col("node"))).select("bucket", "node")
    else:
        facing = facing_leaders(members, labels, 1).drop("leaders")
        sizes = facing.groupBy("bucket").agg(F.count("*").alias("n"))
        large = stage(facing.join(sizes.where(F.col("n") > LARGE_BUCKET), "bucket").drop("n"), "large")
        small = facing.join(sizes.where(F.col("n") <= LARGE_BUCKET), "bucket")
        others = small.select("bucket", F.col("node").alias("other"), F.col("component").alias("_component"))
        pairs = small.join(others, "bucket").where((F.col("node") < F.col("other")) & (F.col("component") != F.col("_component")))
        links = similar_pairs(pairs.select("node", "other"), known, threshold)
        labels = joined_components(labels, links.unionByName(block_links(large, known, threshold)))
    if labels is not None:
        release(known)
    return labels if labels is not None else members.select("node", F.col("node").alias("component"))


def similar_pairs(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The links (a, b) among candidate pairs (node, other)."""
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    left = known.select(F.col("node").alias("a"), F.col("shingles").alias("_left"))
    right = known.select(F.col("node").alias("b"), F.col("shingles").alias("_right"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", similarity(F.col("_left"), F.col("_right")).alias("s"))
    return stage(compared.where(F.col("s") >= threshold).select("a", "b"), "links")


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links and of those found so far, which are stars."""
    if labels is not None:
        links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return components(links)


def node_of(documents: DataFrame) -> Column:
    """A name of a row's text that sorts as its doc_id: the id's bytes, then eight of the text's print.

    Different texts have different names, also where they share an id.
    """
    mark = F.substring("print", 1, 8)
    if isinstance(documents.schema["doc_id"].dataType, IntegralType):
        # with the sign bit turned, hex digits sort as the numbers
        turned = F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
        return F.concat(F.unhex(F.lpad(F.hex(turned), 16, "0")), mark)
    return F.concat(F.encode(F.col("doc_id").cast("string"), "utf-8"), F.unhex(F.lit("00")), mark)


def id_of(node: Column, documents: DataFrame) -> Column:
    """The doc_id in a node's name."""
    kind = documents.schema["doc_id"].dataType
    if isinstance(kind, IntegralType):
        number = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
        return number.cast("bigint").cast(kind)
    return F.decode(F.substring(node, F.lit(1), F.octet_length(node) - 9), "utf-8")


def _placed(documents: DataFrame, threshold: float) -> DataFrame:
    """doc_id, text_digest, node (the row's own name), class (the least node of its class), class_id (its id); all NULL without an id."""
    signed = stage(signed_documents(documents.select("doc_id", "text")), "signed")
    # where every id has one text the ids are names enough, and cheaper to compare than bytes
    texts_of_id = signed.where(F.col("doc_id").isNotNull()).select("doc_id", "print").distinct().groupBy("doc_id").count()
    unique = texts_of_id.where("count > 1").isEmpty()
    named = signed.withColumn("row_node", F.col("doc_id") if unique else node_of(documents))
    names = stage(named.select("doc_id", "text_digest", "print", "row_node"), "names")
    named = named.where(F.col("doc_id").isNotNull())
    texts = stage(named.groupBy("print").agg(F.min("row_node").alias("node"), F.first("bands").alias("bands")), "texts")
    linked = classes(texts.select("node", "bands"), named.select(F.col("row_node").alias("node"), "shingles"), threshold)
    # the result needs neither signatures nor shingles, the largest of the tables
    release(signed)
    of_print = texts.join(linked, "node", "left").select("print", F.coalesce("component", "node").alias("class"))
    placed = names.join(of_print, "print", "left")
    known = F.col("doc_id").isNotNull()
    named_class = F.col("class") if unique else id_of(F.col("class"), documents)
    return placed.select(
        "doc_id",
        "text_digest",
        F.when(known, F.col("row_node")).alias("node"),
        F.when(known, F.col("class")).alias("class"),
        F.when(known, named_class).alias("class_id"),
    )


def near_duplicates(documents: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, text_digest: one row per input row; class_id is the least doc_id of the class.

    Texts are compared as lower-cased words. Equal word sequences are one class; texts without words
    are equal when their characters are, and NULL equals ''. Rows that share a doc_id each carry the
    class of their own text. Rows with a NULL doc_id have a NULL class.
    """
    return _placed(documents, threshold).select("doc_id", "class_id", "text_digest")


def row_name(documents: DataFrame) -> Column:
    """The doc_id; where it is NULL, a name made of the text: a number from 2^62 on, or a string behind all others."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    if isinstance(documents.schema["doc_id"].dataType, IntegralType):
        number = F.xxhash64(digest).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        return F.coalesce(F.col("doc_id").cast("bigint"), number)
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\U0010ffff"), digest))


def first_of_each_class(documents: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the least doc_id, with its own columns.

    Of rows that share the least id and the class one stays, by text digest, source and lang. Rows that share an
    id but not the class are judged apart. Rows with a NULL doc_id are named by their text and come after
    all others.
    """
    name = row_name(documents)
    key, digest, maybe, rows = (free_name(f"_dup_{n}", documents) for n in ("key", "text", "maybe", "nth"))
    found = _placed(documents.select(name.alias("doc_id"), "text"), threshold)
    counted = found.groupBy("node", "class", "doc_id", "text_digest").agg(F.count("*").alias("n"))
    all_rows = F.sum("n").over(Window.partitionBy("node"))
    # most documents are alone and never reach the joins below
    special = counted.withColumn("n", all_rows).where((F.col("n") > 1) | (F.col("node") != F.col("class")))
    special = special.select(F.col("doc_id").alias(f"{key}_"), F.col("text_digest").alias(f"{digest}_"), F.col("node").alias(f"{key}_node"), F.col("class").alias(f"{key}_class"))
    special = stage(special, "special")
    own = [F.col(f"`{c}`") for c in documents.columns]
    tested = _maybe_in(documents.withColumn(key, name), key, special.select(f"{key}_"), maybe)
    order = [F.col(f"`{c}`") for c in ("source", "lang") if c in documents.columns]
    nth = Window.partitionBy(f"{key}_class").orderBy(digest, *order, F.lit(0))
    matched = tested.where(maybe).withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    matched = matched.join(special, (F.col(key) == F.col(f"{key}_")) & (F.col(digest) == F.col(f"{digest}_")), "left")
    alone = matched.where(F.col(f"{key}_").isNull()).select(*own)
    several = matched.where(F.col(f"{key}_node") == F.col(f"{key}_class")).withColumn(rows, F.row_number().over(nth))
    kept = several.where(F.col(rows) == 1).select(*own)
    return tested.where(~F.col(maybe)).select(*own).unionByName(alone).unionByName(kept)
