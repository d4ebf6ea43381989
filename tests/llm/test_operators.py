"""The operators on Spark against plain forms, with NULLs, empty tables, repeats and clashing columns."""

import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moralens.llm import components, decontaminate, mixing, near_dups, pii, quality, search, secret_scan
from moralens.llm import substring_dups, token_counts, url_filter
from moralens.llm.registry import QUERIES, read
from moralens.llm.text import bytes_of, word_hashes

from . import reference_forms as plain

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs everywhere, empty and very long texts, repeated rows, and a column that clashes with results."""
    long = "word and more of it " * 20_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "b", 60),
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "b", 60),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, long, "en", "a", len(long)),
        (5, "!!! ???", "en", None, 7),
        (6, "the QUICK brown fox, jumps over the lazy dog again and again today", "en", "a", 62),
        (None, "a text without a name of its own", "en", "a", 10),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("own")).withColumn("position", F.lit(7))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeated_bytes(spark, docs):
    found = QUERIES["op7_repeated_bytes"](spark, SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain.repeated_bytes(docs)


def test_repeated_bytes_of_periodic_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        parts = [rng.choice(["ab" * 40, "a" * 70, "xyz" * 30, "".join(rng.choices("ab", k=60)), "é" * 30]) for _ in range(3)]
        rows.append((rng.randrange(10**6), "".join(parts)))
    found = substring_dups.repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain.repeated_bytes(rows)


@pytest.mark.parametrize("hot", [0, 12])
def test_repeated_bytes_of_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dups, "HOT_ENTRIES", hot)

    def gathered(group, *rest, whole=substring_dups.equal_windows, limit=hot * substring_dups.FEW):
        if len(group):
            assert max((group == g).sum() for g in set(group)) <= limit
        return whole(group, *rest)

    monkeypatch.setattr(substring_dups, "equal_windows", gathered)
    rng = random.Random(8)
    line = "licensed to the holder named here, all rights reserved: "
    rows = []
    for i in range(150):
        name = lambda: "".join(rng.choices("abcd", k=rng.randrange(3, 40)))
        rows.append((i, rng.choice([line, line[:30], line[10:], "ab" * 30]).join(name() for _ in range(rng.randrange(1, 5)))))
    found = substring_dups.repeated_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == plain.repeated_bytes(rows)


def test_repeated_bytes_spreads_rows_without_ids(spark, monkeypatch):
    def parts(table, cut=substring_dups._parts):
        assert table.num_rows < 100
        return cut(table)

    monkeypatch.setattr(substring_dups, "_parts", parts)
    shared = "a passage of more than fifty bytes that every one of the rows has in it"
    rows = [(None, f"{k} {shared}") for k in range(400)] + [(1, f"first {shared}"), (2, shared)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    found = [tuple(r) for r in substring_dups.repeated_bytes(docs).collect()]
    assert len(found) == 402 and {(i, n > 0) for i, _, n, _, _ in found} == {(None, True), (1, False), (2, True)}


def test_near_duplicates(spark, docs):
    found = QUERIES["op5_near_duplicates"](spark, SMALL).collect()
    assert {r.doc_id: r.class_id for r in found} == plain.near_classes(docs)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "LARGE_BUCKET", 6)
    monkeypatch.setattr(near_dups, "BLOCK_TEXTS", 16)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            copy[rng.randrange(120)] = f"v{rng.randrange(8)}"
        rows.append((i, " ".join(copy)))
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == plain.near_classes(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in found} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_decontamination(spark, docs):
    found = QUERIES["op1_decontaminate"](spark, SMALL).collect()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    expected = {}
    for d, text in docs:
        doc = plain.words(text)
        grams = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for i, item in items:
            item = plain.words(item)
            if any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                inside = [w if any(w in g for g in grams) else None for w in doc]
                n = plain.tiled([w if w in item else object() for w in inside], item)
                if len(item) and n / len(item) >= decontaminate.COVERAGE:
                    expected[d, i] = n
    assert {(r.doc_id, r.item_id): r.tiled_words for r in found} == expected and expected


def test_search(spark, docs):
    found = QUERIES["op4_search"](spark, SMALL).collect()
    queries = [(i, t) for i, t in docs if i % 50 == 0]
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found) == sorted(plain.bm25(docs, queries))


def test_search_rounds_cover_every_shard_once():
    for n in (0, 1, 4, 7, 8, 9, 63, 64, 65, 5000):
        runs = search.rounds(n)
        assert runs[0][0] == 0 and runs[-1][1] == max(n, 1)
        assert all(a[1] == b[0] < b[1] for a, b in zip(runs, runs[1:], strict=False))
    assert len(search.rounds(100)) == 3


def test_search_of_short_queries_over_many_shards(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rng = random.Random(2)
    queries = [(k, " ".join(rng.sample(plain.words(rng.choice(docs)[1]) or ["the"], 1))) for k in range(40)] + [(99, ""), (98, None)]
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    found = search.top_documents(frame, asked, top=3, shard_bytes=30_000).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found) == sorted(plain.bm25(docs, queries, 3))
    # a shard for every few documents: several rounds, floors from the ones before
    found = search.top_documents(frame, asked, top=3, shard_bytes=1_000).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in found) == sorted(plain.bm25(docs, queries, 3))


@pytest.mark.parametrize("cells, postings", [(search.CELLS_AT_ONCE, search.POSTINGS_AT_ONCE), (2_000, 50)])
def test_search_adds_long_queries_up_together(docs, monkeypatch, cells, postings):
    monkeypatch.setattr(search, "CELLS_AT_ONCE", cells)
    monkeypatch.setattr(search, "POSTINGS_AT_ONCE", postings)
    alone, one_by_one = [], search.Shard.search
    monkeypatch.setattr(search.Shard, "search", lambda self, lists, *rest: alone.append(len(lists)) or one_by_one(self, lists, *rest))
    texts = [(i, " ".join(plain.words(t))) for i, t in docs]
    flat, offsets = bytes_of(pa.array([t for _, t in texts]))
    ids, half = np.array([i for i, _ in texts]), len(texts) // 2
    blobs = [search.pack_shard(ids[a:b], flat, offsets[a : b + 1])[0] for a, b in ((0, half), (half, len(texts)))]
    asked = [*texts[::7], (-1, "the"), (-2, "the of and")]
    cuts = [np.unique(word_hashes(*bytes_of(pa.array([t])))[0]) for _, t in asked]
    terms, which = np.unique(np.concatenate(cuts), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
    weights = search.inverse_frequency(sum(search.Shard(b).local_counts(terms) for b in blobs), len(docs))
    names, mean = np.array([i for i, _ in asked]), sum(len(t.split()) for _, t in texts) / len(texts)
    floors = np.zeros(len(names))
    for _ in range(2):  # without floors, then with the 10th best score as floor
        alone.clear()
        shared = SimpleNamespace(value=(names, bounds, terms, which, weights, floors))
        shards = pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["shard"])
        hits = pa.Table.from_batches(search._searcher(shared, mean, 10, 0, 2, 2)(iter([shards]))).to_pylist()
        best = {q: sorted((-round(h["score"], 9), h["doc_id"]) for h in hits if h["query_id"] == q)[:10] for q in names.tolist()}
        found = [(q, i, k + 1) for q, own in best.items() for k, (_, i) in enumerate(own)]
        assert sorted(found) == sorted(plain.bm25(docs, asked))
        floors = np.array([-own[9][0] - 1e-8 if len(own) > 9 else 0.0 for own in best.values()])
        assert 0 < len(alone) < len(asked) and max(alone) <= search.SHORT_QUERY


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op10_quality"](spark, sf)
    held = scored.where("held_out").join(read(spark, sf, "labels"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.98
    assert all(0 <= r.score <= 1 for r in held)


def test_quality_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(odd, none).collect()} == {0.5}
    assert quality.quality_scores(empty, none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.good_documents(odd, one).columns == odd.columns


def test_odd_rows(spark, odd):
    n = odd.count()
    assert secret_scan.secret_digest(odd).count() == n and pii.personal_digest(odd).count() == n
    near = near_dups.near_duplicates(odd).collect()
    assert len(near) == n
    classes = {r.doc_id: r.class_id for r in near}
    assert classes[6] == classes[1] == 1 and classes[2] == classes[3] == 2 and classes[5] == 5 and classes[None] is None
    kept = near_dups.first_of_each_class(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5]
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in substring_dups.repeated_bytes(odd).collect()}
    assert removed[(3, 0)] == 0 and removed[(1, 65)] == 0 and removed[(None, 32)] == 0
    bench = spark.createDataFrame([(1, "over the lazy dog again and again today"), (2, None), (3, "a b")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(odd, bench).collect()} == {(1, 1), (6, 1)}
    clean = decontaminate.clean_documents(odd, bench)
    assert clean.columns == odd.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 2, 3, 4, 5]
    masked = secret_scan.masked(odd)
    assert masked.columns == odd.columns and masked.count() == n
    queries = odd.select(F.col("doc_id").alias("query_id"), "text")
    assert {r.query_id for r in search.top_documents(odd, queries).collect()} == {1, 4, 6}


def test_stages_judge_rows_that_share_an_id_by_their_text(spark):
    passage = "over the lazy dog again and again today"
    rows = [
        (None, f"a dirty text {passage}"),
        (None, "a clean text that nothing names at all"),
        (None, None),
        (7, f"another dirty one with {passage}"),
        (7, "a clean text under the same number as the dirty one"),
    ]
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    for kind in ("bigint", "string"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        clean = decontaminate.clean_documents(docs, bench).collect()
        assert sorted(str(r.text) for r in clean) == sorted(str(rows[k][1]) for k in (1, 2, 4))


def test_first_of_each_class_without_ids(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [
        (None, "a text that has no number"), (None, "a text that has no number"), (None, "a text of its own, alone"),
        (None, " ".join(base)), (5, " ".join([*base[:60], "x", *base[60:]])),
        (None, " ".join(f"v{w}" for w in base)), (None, " ".join([*[f"v{w}" for w in base], "y"])),
    ]
    for kind in ("bigint", "string"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        kept = near_dups.first_of_each_class(docs)
        assert kept.dtypes == docs.dtypes
        kept = [(r.doc_id, r.text) for r in kept.collect()]
        assert [i for i, _ in kept if i is not None] == ([5] if kind == "bigint" else ["5"])
        texts = [t for i, t in kept if i is None]
        assert len(texts) == len(set(texts)) == 3 and {rows[0][1], rows[2][1]} < set(texts) and rows[3][1] not in texts


def test_mixture(spark, odd):
    mixed = mixing.mixture(odd).collect()
    assert len(mixed) == odd.count()
    taken = {}
    for r in mixed:
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    order = mixing.training_order(odd)
    assert order.columns == [*odd.columns, "mix_position"]
    rows = order.collect()
    assert [r.mix_position for r in rows] == sorted(r.mix_position for r in rows)
    assert len(rows) == sum(len(r.positions) for r in mixed)


def test_mixture_targets_on_documents(spark):
    rows = QUERIES["op3_mix"](spark, "/root/testdata/sf0.01").collect()
    assert sum({(r.source_size, r.target) for r in rows} and [r.taken for r in rows]) == pytest.approx(1.5 * sum(r.size for r in rows), rel=0.02)


def test_schedule_times(spark):
    schedule = ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0))
    shares = spark.range(0, 101).select((F.col("id") / 100).alias("q"))
    times = [r.t for r in shares.select(mixing.due_time(F.col("q"), schedule).alias("t")).collect()]
    assert times[0] == 0 and times[-1] == pytest.approx(1) and times == sorted(times)
    area = lambda t: 2 * t * t if t <= 0.5 else 0.5 + 2 * (t - 0.5) - (t - 0.5) ** 2
    assert all(area(t) / 1.25 == pytest.approx(k / 100, abs=1e-9) for k, t in enumerate(times))


def test_url_filter(spark):
    urls = ["HTTP://A.COM/x", "http://www.example.com/en/1", "http://EXAMPLE.com/en/", "x.net", None, "http://b.org/p?utm_a=1&q=2#f", "a://c.net/es/", "http://q.org/y"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, "HTTP://A.COM/x")], "page_id bigint, url string")
    listed = spark.createDataFrame([("b.org/p?q=2",), (None,), ("b.org/p?q=2",)], "u string")
    found = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(pages, listed).collect()}
    assert found == {
        (0, "a.com", "/x", "com/", "allow"), (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "example.com", "/en/", "example.com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "b.org", "/p", None, "block"), (6, "c.net", "/es/", "net/es/", "block"), (7, "q.org", "/y", None, "allow"),
    }
    assert url_filter.url_verdicts(pages, listed).count() == 9


def test_url_filter_lets_no_listed_url_pass(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 2)
    pages = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id, '.org/') AS url")
    listed = pages.where("page_id % 3 = 0").select(url_filter.canonical_url(F.col("url")).alias("u"))
    rows = url_filter.url_verdicts(pages, listed).collect()
    assert all((r.verdict == "block") == (r.page_id % 3 == 0) for r in rows)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    import public_tokenizers

    assert secret_scan.secret_digest(empty).count() == pii.personal_digest(empty).count() == 0
    assert near_dups.near_duplicates(empty).count() == near_dups.first_of_each_class(empty).count() == 0
    assert substring_dups.repeated_bytes(empty).count() == 0
    assert decontaminate.contaminated_pairs(empty, bench).count() == decontaminate.clean_documents(empty, bench).count() == 0
    assert mixing.mixture(empty).count() == mixing.training_order(empty).count() == 0
    assert token_counts.token_counts(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert search.top_documents(empty, empty.select(F.col("doc_id").alias("query_id"), "text")).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.url_verdicts(pages, url_filter.crawled_twice(pages)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids), name
        ids, docs = kept, out
    assert not any(secret_scan.spans_of(r.text) for r in docs.collect())
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} <= ids and [r.position for r in rows] == sorted(r.position for r in rows)


def test_texts_that_share_an_id_keep_their_own_class(spark):
    base = [f"w{k}" for k in range(120)]
    near, other = " ".join([*base, "x"]), " ".join(f"v{w}" for w in base)
    rows = [(3, " ".join(base)), (7, near), (7, other), (9, f"{other} y"), (5, "alone here"), (5, "Alone, here"), (5, "quite another text")]
    for kind in ("bigint", "string"):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        found = near_dups.near_duplicates(docs)
        assert dict(found.dtypes)["class_id"] == kind
        classes = sorted((int(r.doc_id), int(r.class_id)) for r in found.collect())
        assert classes == [(3, 3), (5, 5), (5, 5), (5, 5), (7, 3), (7, 7), (9, 7)]
        kept = near_dups.first_of_each_class(docs).collect()
        assert sorted((int(r.doc_id), r.text) for r in kept) == sorted([rows[0], rows[2], rows[6], min(rows[4:6], key=lambda r: plain.md5(r[1]))])
    ids = [(-5, "a b c d e f g"), (5, "A b c d e f g"), (-(1 << 63), "h i"), ((1 << 63) - 1, "H I")]
    found = near_dups.near_duplicates(spark.createDataFrame(ids, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {-5: -5, 5: -5, -(1 << 63): -(1 << 63), (1 << 63) - 1: -(1 << 63)}


def test_helper_columns_take_no_place(spark, odd):
    names = ["_s", "_clean", "_maybe", "_word", "_bits", "_dup_key", "_dup_text", "_dup_nth"]
    marked = odd.select("*", *[F.lit(n).alias(n) for n in names])
    for frame in (secret_scan.secret_spans(marked), pii.personal_spans(marked), secret_scan.masked(marked), near_dups.first_of_each_class(marked)):
        assert frame.select(*names).distinct().collect() == [tuple(names)]


def test_hostile_personal_texts(spark):
    texts = ["0" * 5000 + ".1.2.3", "1." * 50_000, "1 " * 50_000, "9" * 100_000 + "@", "+1" * 50_000, "a@" * 50_000]
    rows = pii.personal_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_ip for r in rows} == {0: 1, 1: 12_500, 2: 0, 3: 0, 4: 0, 5: 0}


def test_digests_equal_the_plain_forms(spark, docs):
    for name, spans in (("op2_secrets", plain.secrets), ("op8_personal_data", plain.personal)):
        for r in QUERIES[name](spark, SMALL).collect():
            base = spans(dict(docs)[r.doc_id] or "")
            assert r.base_sha256 == plain.sha256(base), (name, r.doc_id)
            counts = {k: sum(s.startswith(f"{k}:") for s in base.split(",")) for k in ("assign", "access", "hex", "email", "ip", "card", "phone")}
            assert all(r[f"n_{k}"] == n for k, n in counts.items() if f"n_{k}" in r)
            assert {s for s in base.split(",") if s} <= set(r.spans.split(","))


def test_token_query_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op9_token_counts"](spark, SMALL).collect()}
    for i, text in docs:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert found[i] == (len((text or "").encode()), n, n > 2048)
