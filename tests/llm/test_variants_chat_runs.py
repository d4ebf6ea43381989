"""Spelling variants, chat formatting and periodic runs against plain forms."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moralens.llm import chat_format, periodic_runs, spelling
from moralens.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


# spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    """{word: (form, root, n, n_near, form_n)}"""
    by_size = collections.defaultdict(list)
    for w in counts:
        by_size[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size[len(w) + k] if one_edit(w, v)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def plain_counts(docs):
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def as_rows(found):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


def test_spelling_query_equals_the_plain_form(spark, docs):
    found = QUERIES["op11_spelling_variants"](spark, SMALL)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = as_rows(found)
    assert rows == plain_variants(plain_counts(docs)) and any(r[0] for r in rows.values())


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzàÿ×"])
def test_all_near_words_are_found(spark, letters):
    rng = random.Random(len(letters))
    words = set()
    while len(words) < 300:
        word = "".join(rng.choices(letters, k=rng.randrange(5, 11)))
        words.add(word)
        for _ in range(3):
            k, c = rng.randrange(len(word) + 1), rng.choice(letters)
            words |= {v for v in (word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]) if len(v) >= 5}
    counts = {w: rng.choice([3, 4, 5, 8, 20, 100]) for w in sorted(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_rows(spelling.variants(frame)) == plain_variants(counts)


def test_spelling_broadcasts_no_words(spark):
    counts = {f"{a}{b}word{c}": 3 + k for k, (a, b, c) in enumerate((a, b, c) for a in "abcd" for b in "efgh" for c in "klmn")}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pairs = spelling.near_pairs(frame)
    assert "SortMergeJoin" in plan(pairs) and "Broadcast" not in plan(pairs)
    pairs.collect()
    assert "Broadcast" not in plan(pairs)
    found = spelling.variants(frame)
    assert "Broadcast" not in plan(found)
    assert as_rows(found) == plain_variants(counts)


def test_spelling_of_odd_rows(spark):
    long = "Zebra" * 4000
    rows = [
        (1, "Hello hello HELLO hellò hello", "en", "a", 1), (1, "Hello hello HELLO hellò hello", "en", "a", 1),
        (None, "hellò", None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "1234 !? abcd", "en", None, 3),
        (5, f"{long} {long} {long}", "en", "a", 9),
    ]
    frame = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("own")).withColumn("word", F.lit("own"))
    assert as_rows(spelling.spelling_variants(frame)) == {
        "hello": (None, "hello", 8, 1, None), "hellò": ("hello", "hello", 3, 1, 8), long.lower(): (None, long.lower(), 3, 0, None),
    }
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(empty, spelling.TYPO_RATE).count() == 0


def test_chains_of_forms_are_followed_to_the_end(spark):
    word, counts = "abcdefgh", {}
    for k in range(8):
        counts[word] = 3 * 2**k
        word = word[:k] + "z" + word[k + 1 :]
    rows = as_rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert {r[1] for r in rows.values()} == {max(counts, key=counts.get)}


# chat formatting


def plain_digest(turns):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}"""
    grouped = collections.defaultdict(list)
    for i, turn, role, text in turns:
        grouped[i].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for i, own in grouped.items():
        said = [(t[3], t[5]) for t in sorted(own)]
        replies = "".join(t for r, t in said if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for r, t in said)
        out[i] = (len(said), hashlib.sha256(every.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest())
    return out


CONTROL_BITS = [*chat_format.CONTROL, "\\", "\n", "<", "[", "|", "<\\s>", "é", "a", ">", "s>", "INST]", "<|im_end|>\n"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(CONTROL_BITS), max_size=12), st.lists(st.sampled_from(CONTROL_BITS), max_size=5))
def test_escapes_can_be_undone(text, role):
    text, role = "".join(text), "".join(role)
    safe = chat_format.escaped(text)
    assert chat_format.unescaped(safe) == text and not any(c in safe for c in chat_format.CONTROL)
    formatted = f"{chat_format.START}{chat_format.escaped_role(role)}\n{safe}{chat_format.END}"
    assert list(chat_format.turns_of(formatted * 2)) == [(role, text)] * 2


def test_chat_query_equals_the_plain_form(spark):
    turns = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    turns += [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    found = QUERIES["op12_chat_format"](spark, SMALL).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == plain_digest(turns)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    assert sorted(connection.sql(ORACLES["op12_chat_format"]).fetchall()) == sorted(tuple(r) for r in found)


def test_every_reply_is_an_example_with_all_turns_before_it(spark):
    turns = [(1, k, "system" if k == 0 else ("user", "assistant")[k % 2 == 0], f"t{k} <s>") for k in range(7)] + [(1, 7, "user", "bye")]
    rows = chat_format.chat_examples(spark.createDataFrame(turns, TURNS)).collect()
    whole = [f"<|im_start|>{r}\nt{k} <\\s><|im_end|>\n" for _, k, r, _ in turns[:7]]
    examples = [r for r in rows if r.loss_start is not None]
    assert [r.text for r in examples] == ["".join(whole[:k]) for k in (3, 5, 7)]
    assert [r.text[r.loss_start : r.loss_end] for r in examples] == [f"t{k} <\\s>" for k in (2, 4, 6)]
    assert [r.context_turns for r in examples] == [2, 4, 6]
    assert rows[-1].loss_start is None and rows[-1].text[rows[-1].fresh :] == "<|im_start|>user\nbye<|im_end|>\n"


def test_long_conversations_stay_in_proportion(spark, tmp_path):
    rng = random.Random(4)
    turns = [(7, k, rng.choice(["user", "assistant", "tool"]), f"text {k} " * rng.randrange(20)) for k in range(1500)]
    turns += [(8, 5, "assistant", "x" * 40_000)] * 5 + [(9, 40, "user", "late"), (None, None, None, None), (None, -3, "assistant", "a")]
    frame = spark.createDataFrame(turns, TURNS).repartition(5).withColumn("block", F.lit("own")).withColumn("whole", F.lit(1))
    examples = chat_format.chat_examples(frame)
    found = chat_format.read_back(examples).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == plain_digest(turns)
    size = sum(len(t[3] or "") + 40 for t in turns if t[0] == 7)
    assert next(r.formatted_chars for r in found if r.conv_id == 7) < chat_format.BLOCK_TURNS * size
    # a written table read again, blocks of a long conversation apart
    examples.repartition(3, "text").write.parquet(str(tmp_path / "examples"))
    again = chat_format.read_back(chat_format.arranged(spark.read.parquet(str(tmp_path / "examples")))).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    empty = spark.createDataFrame([], TURNS)
    assert chat_format.chat_examples(empty).count() == chat_format.read_back(chat_format.chat_examples(empty)).count() == 0


def test_examples_of_later_blocks_hold_all_turns_before_them(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k} </s>") for k in range(150)] + [(2, k, "assistant", "y" * 30_000) for k in range(0, 160, 20)]
    turns += [(None, 70, "user", None), (None, 71, "assistant", "a"), (None, None, "user", "first"), (3, 90, "assistant", "alone")]
    rows = chat_format.chat_examples(spark.createDataFrame(turns, TURNS).repartition(4)).where("loss_start IS NOT NULL").collect()
    for conversation in (1, 2, 3, None):
        own = sorted((t for t in turns if t[0] == conversation), key=lambda t: -1 if t[1] is None else t[1])
        said = [f"<|im_start|>{r}\n{(t or '').replace('</s>', chr(60) + chr(92) + '/s>')}<|im_end|>\n" for _, _, r, t in own]
        replies = [k for k, t in enumerate(own) if t[2] == "assistant"]
        found = sorted((r for r in rows if r.conv_id == conversation), key=lambda r: len(r.text))
        assert [r.text for r in found] == ["".join(said[: k + 1]) for k in replies]
        assert [r.context_turns for r in found] == replies
        assert all(r.text[r.loss_start : r.loss_end] + "<|im_end|>\n" == r.text[r.loss_start :] for r in found)
    examples = chat_format.chat_examples(spark.createDataFrame(turns, TURNS))
    assert {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(examples).collect()} == plain_digest(turns)
    broken = examples.withColumn("text", F.when(F.col("block") == 2, F.regexp_replace("text", "t0 ", "T0 ")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="blocks before"):
        chat_format.read_back(broken).collect()


def test_a_changed_context_is_noticed(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(6)]
    examples = chat_format.chat_examples(spark.createDataFrame(turns, TURNS)).withColumn("text", F.regexp_replace("text", "t0", "T0"))
    broken = examples.withColumn("text", F.when(F.col("row") == 1, F.regexp_replace("text", "T0", "t9")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="context of an example"):
        chat_format.read_back(broken).collect()


# periodic runs


def plain_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        at = 0
        while at + p < len(words):
            start = at
            while at + p < len(words) and words[at] == words[at + p]:
                at += 1
            if at + p - start >= max(6, 4 * p) and at > start:
                found.setdefault((start, at + p), p)
            at += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *longest, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(kept))


def test_cover_has_all_differences():
    assert {(a - b) % periodic_runs.V for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.V))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.sampled_from([1, 2, 4, 5, 9, 30])), max_size=5), min_size=1, max_size=4))
def test_runs_equal_the_plain_form(parts):
    texts = [[w for unit, times in text for w in unit * times] for text in parts]
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    text, start, length, period = periodic_runs.runs_of(np.array([w for t in texts for w in t], dtype=np.int64), offsets)
    found = collections.defaultdict(list)
    for k, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        found[k].append(tuple(run))
    assert [found[k] for k in range(len(texts))] == [plain_runs(t) for t in texts]


def test_common_extensions_beyond_the_cover():
    rng = random.Random(6)
    unit = [rng.randrange(1, 4) for _ in range(700)]
    words = np.array(unit + unit[:400] + [9] + unit + [3] * 300, dtype=np.int64)
    ends = np.full(len(words), len(words))
    i = np.array([rng.randrange(len(words) - 1) for _ in range(3000)] + list(range(600)))
    j = np.array([rng.randrange(a + 1, len(words)) for a in i[:3000]] + [a + 700 for a in range(600)])
    expected = []
    for a, b in zip(i, j, strict=True):
        n = 0
        while b + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        expected.append(n)
    assert periodic_runs.extensions(words, ends, i, j).tolist() == expected and max(expected) > 300


def test_run_query_equals_the_plain_form(spark, docs):
    found = QUERIES["op13_periodic_runs"](spark, SMALL).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {i: plain_row(i, t) for i, t in docs}
    assert any(r.n_runs for r in found)


def test_runs_of_odd_rows(spark):
    rows = [
        (10, "a b " * 9000, "en", "a", 1), (10, "a b " * 9000, "en", "a", 1), (11, None, None, None, None), (12, "", "en", "a", 0),
        (13, "x y x y\tx y\nx y\x0bx y\x0cx y", "en", "a", 0), (14, "one", None, None, None), (None, "é " * 6, None, None, None),
    ]
    frame = spark.createDataFrame(rows, DOCS).withColumn("n_runs", F.lit("own")).withColumn("_found", F.lit("own"))
    found = periodic_runs.periodic_runs(frame)
    assert found.columns == [*frame.columns, "runs", "collapsed"]
    got = sorted((str(r.doc_id), r._found, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    run = [(0, 18000, 2)]
    assert got == [
        ("10", "own", run, "a b"), ("10", "own", run, "a b"), ("11", "own", [], ""), ("12", "own", [], ""),
        ("13", "own", [(0, 6, 1)], "x y"), ("14", "own", [], "one"), ("None", "own", [(0, 6, 1)], "é"),
    ]
    digest = periodic_runs.run_digest(frame).collect()
    expected = [(i, *plain_row(i, t)) for i, t, *_ in rows if i is not None]
    assert sorted(tuple(r) for r in digest if r.doc_id is not None) == sorted(expected)
    assert periodic_runs.run_digest(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="already has"):
        periodic_runs.periodic_runs(frame.withColumn("Runs", F.lit(1)))
