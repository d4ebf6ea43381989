"""The stages of the pipeline and the quality classifier against plain forms."""

import collections
import math
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moralens.llm import decontaminate, mixing, quality, secret_scan
from moralens.llm.registry import read

from . import reference_forms as plain

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The documents, with copies, rows of one id, rows without an id, and a dirty one among those."""
    table = read(spark, SMALL, "documents")
    item = read(spark, SMALL, "benchmark").orderBy(F.desc(F.length("text"))).first()["text"]
    rows = [r.asDict() for r in table.orderBy("doc_id").limit(6).collect()]
    more = [rows[0] | {"doc_id": 10_001}, rows[1] | {"doc_id": rows[2]["doc_id"]}, rows[3] | {"doc_id": None}, rows[4] | {"doc_id": None}]
    more.append(rows[2] | {"doc_id": 10_002, "text": "the mail says password: x9Kq2vLm7 and then pwd = 'qzxwvkjhgtrplmnb', nothing more"})
    more += [rows[5] | {"doc_id": None, "text": f"{rows[5]['text']}\n{item}"}, rows[5] | {"doc_id": None, "text": None}]
    return table.unionByName(spark.createDataFrame([tuple(r[c] for c in table.columns) for r in more], table.schema))


def texts_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def plain_statistics(text):
    """The statistics by counting characters and words."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x00-\x20]+", raw)
    n, total = max(len(words), 1), max(len(raw), 1)
    count = lambda characters: sum(raw.count(bytes([c])) for c in characters)
    upper, small = count(range(65, 91)), count(range(97, 123))
    return (
        math.log1p(len(words)), sum(map(len, words)) / n, upper / max(upper + small, 1), count(range(48, 58)) / total,
        count(b"!") / n, count(b"|") / n, count(b"#$%&*@^~<>{}[]=_\\") / n, count(b",;:") / n, count(b".") / n, count(b"\n") / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n, count(range(128, 256)) / total,
    )


def test_statistics_equal_plain_counts():
    rows = duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet'").fetchall()
    texts = [r[0] for r in rows] + [None, "", "   ", "a a a A!", "é\n|é é. #1", "x" * 5000]
    found = quality.statistics_of(pa.array(texts, pa.string())).to_pylist()
    for text, stats in zip(texts, found, strict=True):
        assert list(stats.values()) == pytest.approx(plain_statistics(text)), text


def test_rules_and_expression_equal_their_plain_form(spark):
    documents, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    measured = documents.select("doc_id", quality.text_statistics(F.col("text")).alias("stats"))
    ensemble = quality.fit_rules(measured, labels)
    assert ensemble.rules and all(r.weight for r in ensemble.rules)
    rows = measured.select("stats", ensemble.score(F.col("stats")).alias("score"), quality.rules_held(list(ensemble.rules))(F.col("stats")).alias("held")).collect()
    place = {name: k for k, name in enumerate(quality.STATISTICS)}
    for r in rows:
        holds = [all(low < r.stats[place[name]] <= high for name, low, high in rule.ranges) for rule in ensemble.rules]
        assert [bool(h) for h in r.held] == holds
        margin = ensemble.intercept + sum(rule.weight for rule, h in zip(ensemble.rules, holds, strict=True) if h)
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)))


def test_quality_stage(spark, docs):
    kept = corpus_pipeline.drop_low_quality(spark, docs, SMALL)
    scored = quality.quality_scores(docs, read(spark, SMALL, "labels"))
    # the scores of the same rows in the same order of ids and texts
    expected = collections.Counter(r.doc_id for r in scored.collect() if r.score >= quality.THRESHOLD)
    assert collections.Counter(r.doc_id for r in kept.collect()) == expected
    assert kept.columns == docs.columns and 0 < sum(expected.values()) < docs.count()


def test_near_duplicate_stage(spark, docs):
    rows = docs.collect()
    named = {k: r for k, r in enumerate(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, plain.md5(r.text or ""))))}
    classes = plain.near_classes([(k, r.text) for k, r in named.items()])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    found = texts_of(kept)
    assert sum(found.values()) == len(set(classes.values())) < len(rows)
    by_text = {(r.doc_id, r.text): classes[k] for k, r in named.items()}
    assert len({by_text[key] for key in found}) == len(found)
    # of a class with ids the least one stays
    for key in found:
        ids = [r.doc_id for k, r in named.items() if classes[k] == by_text[key] and r.doc_id is not None]
        assert key[0] == min(ids, default=None)


def test_decontamination_stage(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    rows = docs.collect()
    dirty = set()
    for text in {r.text for r in rows}:
        doc = plain.words(text)
        grams = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for _, item in items:
            item = plain.words(item)
            if any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                inside = [w if any(w in g for g in grams) else None for w in doc]
                if plain.tiled([w if w in item else object() for w in inside], item) / len(item) >= decontaminate.COVERAGE:
                    dirty.add(text)
    expected = collections.Counter((r.doc_id, r.text) for r in rows if r.text not in dirty)
    assert texts_of(corpus_pipeline.drop_contaminated(spark, docs, SMALL)) == expected
    assert sum(expected.values()) < len(rows)


def test_secret_stage(spark, docs):
    def masked(text):
        if not text:
            return text
        gone = set()
        for start, stop, _ in secret_scan.spans_of(text):
            gone |= set(range(start, stop))
        return "".join("" if k in gone and k - 1 in gone else "[SECRET]" if k in gone else c for k, c in enumerate(text))

    expected = collections.Counter((r.doc_id, masked(r.text)) for r in docs.collect())
    found = texts_of(corpus_pipeline.mask_secrets(spark, docs, SMALL))
    assert found == expected and any("[SECRET]" in (t or "") for _, t in found)


def test_mix_stage(spark, docs):
    mixed = mixing.mixture(docs).collect()
    draws = collections.Counter()
    for r in mixed:
        draws[r.doc_id] += len(r.positions)
    rows = corpus_pipeline.mix_sources(spark, docs, SMALL).collect()
    assert collections.Counter(r.doc_id for r in rows) == +draws
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    at = collections.Counter(round(p, 9) for r in mixed for p in r.positions)
    assert collections.Counter(round(r.position, 9) for r in rows) == at
    # words drawn per source come near its target
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += r.taken
    for source, target in {(r.source, r.target) for r in mixed}:
        assert abs(taken[source] - target) <= max(r.size for r in mixed if r.source == source)
    again = corpus_pipeline.mix_sources(spark, docs.repartition(7), SMALL).collect()
    assert [(r.doc_id, r.text, r.position) for r in again] == [(r.doc_id, r.text, r.position) for r in rows]


def test_whole_pipeline_is_its_stages(spark):
    found = corpus_pipeline.run(spark, SMALL)
    docs = read(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert texts_of(found) == texts_of(docs) and found.columns == docs.columns
