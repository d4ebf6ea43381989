"""Secret scans: fixed credential patterns, and guess costs of values in a credential context.

The guess cost of a value is the least sum, over all ways to cut it into segments, of the log10
guesses that each segment needs: listed words, other runs of letters, dates, repeats, keyboard
walks, and single brute-force characters. Dynamic programming over end positions finds it. A value
that stands behind a credential word and costs too many guesses to be prose is a secret.

A filter on the JVM lets only texts with a cue reach Python.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.llm.text import free_name

KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
MIN_VALUE = 6
MIN_ACCESS = 20
MIN_HEX = 24
MIN_GUESS_VALUE = 8
GUESSES = 10.0  # log10 guesses from which a value in context counts as a secret
CAPITAL = 0.9  # a capital at an odd place: the case and the place of one letter
UNLISTED_WORD = 5.0  # a run of letters is taken for a word of a list of 10^5

#: Words that passwords are made of, the commonest first.
WORDS = (
    "password pass admin root user test guest login welcome letmein secret master hello monkey dragon "
    "qwerty abc love sunshine princess football baseball shadow superman batman trustno michael jordan "
    "summer winter spring autumn hunter killer soccer hockey ginger pepper cookie cheese computer internet "
    "server database default changeme temp demo sample example public private token key access account"
).split()
VOWELS = frozenset("aeiouy")
RARE = frozenset("jkqvwxz")
MIN_VOWELS, LONGEST_WORD = 0.2, 24
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")

#: What must occur in a text (on the JVM) for any kind to be found.
CUES = (
    r"(?i:passw|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)"
    r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
)


def word_like(run: str) -> bool:
    """Whether lower-case letters could be a word of some language: not without vowels, nor with pairs no language has.

    Runs that could not are left to the brute-force cost of each letter.
    """
    vowels = [c in VOWELS or c > "\u00bf" for c in run]
    share = sum(vowels) / len(run)
    longest = max(len(list(same)) for _, same in itertools.groupby(vowels))
    odd = any(a in RARE and b in RARE and a + b not in ("zz",) or a == "q" and b not in "u" for a, b in itertools.pairwise(run))
    return len(run) <= LONGEST_WORD and MIN_VOWELS <= share and longest <= 5 and not odd


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; 0 for ''."""
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    words = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
    best = [0.0] + [math.inf] * n
    segments = matched_segments(low, words)
    for end in range(1, n + 1):
        c = value[end - 1]
        card = 10 if c in "0123456789" else 26 if c.isalpha() else 33
        best[end] = best[end - 1] + math.log10(card)
        for start, cost in segments.get(end, ()):
            # a capital first or throughout doubles the guesses, each one elsewhere counts for a place
            own = value[start:end]
            extra = 0.0 if own == low[start:end] else 0.30103 if own[1:].islower() or own.isupper() else CAPITAL * sum(map(str.isupper, own))
            best[end] = min(best[end], best[start] + cost + extra)
    return best[n]


def matched_segments(low: str, words: dict[str, float]) -> dict[int, list[tuple[int, float]]]:
    """Segments other than brute force, by where they end: (start, log10 guesses)."""
    found: dict[int, list[tuple[int, float]]] = {}

    def add(start: int, end: int, cost: float) -> None:
        found.setdefault(end, []).append((start, cost))

    longest = max(map(len, words))
    for start in range(len(low)):
        for end in range(start + 3, min(len(low), start + longest) + 1):
            if low[start:end] in words:
                add(start, end, words[low[start:end]])
    for m in re.finditer(r"[^\W\d_]{3,}", low):
        if word_like(m[0]):
            add(m.start(), m.end(), UNLISTED_WORD)
    date = r"(?=((?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))"
    for m in re.finditer(date, low):
        add(m.start(), m.end(1), math.log10(366 * 200))
    for m in re.finditer(r"(?=((?:19|20)\d\d))", low):
        add(m.start(), m.end(1), math.log10(200))
    for m in re.finditer(r"(.{1,4}?)\1{2,}", low, re.S):
        unit = len(m[1])
        add(m.start(), m.end(), 1.5 * unit + math.log10((m.end() - m.start()) // unit))
    for row in (*ROWS, *(r[::-1] for r in ROWS)):
        after = dict(zip(row, row[1:], strict=False))
        start = 0
        for i in range(1, len(low) + 1):
            if i == len(low) or after.get(low[i - 1]) != low[i]:
                if i - start >= 3:
                    add(start, i, math.log10(47 * 2 * (i - start)))
                start = i
    return found


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in code points, sorted by start, then kind as listed."""
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    context = re.compile(
        r"""(?:(?:passw(?:or)?d|passphrase|passcode|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?)"""
        r"""["']?\x20*(?:=>|[:=])|bearer)\x20*["']?([^\s"'<>,;]+)""",
        re.I | re.A,
    )
    found = [(m.start(), m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= MIN_ACCESS]
    # runs of hex digits are maximal, so the short ones can be left out in the pattern
    found += [(m.start(), m.end(), "hex") for m in re.finditer(rf"[0-9a-f]{{{MIN_HEX},}}", text)]
    for m in context.finditer(text):
        value = m[1].rstrip(".!?)]}")
        if len(value) >= MIN_GUESS_VALUE and guess_cost(value) >= GUESSES:
            found.append((m.start(1), m.start(1) + len(value), "guess"))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[0], rank[s[2]], s[1]))


def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Texts with a cue (None: no cue) to the starts, ends and kinds of their spans."""
    for texts in batches:
        rows = [spans_of(t) if t else [] for t in texts]
        yield pd.DataFrame(
            {
                "starts": [[s[0] for s in r] for r in rows],
                "ends": [[s[1] for s in r] for r in rows],
                "kinds": [[s[2] for s in r] for r in rows],
            }
        )


def secret_spans(documents: DataFrame) -> DataFrame:
    """The input's columns and ``secret_spans``: an array of (start, end, kind), by start and kind.

    Offsets count code points, ends are exclusive. NULL and empty texts have no spans; every input
    row gives one row, repeated rows included; the input may not have a column of that name.
    """
    if "secret_spans" in (c.lower() for c in documents.columns):
        raise ValueError("the input already has a column secret_spans")
    scanner = F.pandas_udf(scan, "starts array<int>, ends array<int>, kinds array<string>")
    found = scanner(F.when(F.col("text").rlike(CUES), F.col("text")))
    name = free_name("_s", documents)
    zipped = F.transform(
        F.arrays_zip(F.col(f"{name}.starts"), F.col(f"{name}.ends"), F.col(f"{name}.kinds")),
        lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"), x["kinds"].alias("kind")),
    )
    own = [F.col(f"`{c}`") for c in documents.columns]
    return documents.select(*own, found.alias(name)).select(*own, zipped.alias("secret_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_digest(documents: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as text, one row per input row."""
    scanned = secret_spans(documents.select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def mask(text: str, spans: list) -> str:
    """``text`` with every maximal run of span characters replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, end in merged((s["start"], s["end"]) for s in spans):
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def masked(documents: DataFrame) -> DataFrame:
    """The documents with secrets in ``text`` masked and ``n_chars``, where given, counted anew.

    NULL texts stay NULL, texts without secrets stay as they are, other columns are not touched.
    """

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask_text(t) if t else None for t in texts], dtype="object")

    masker = F.pandas_udf(apply, "string")
    clean = F.coalesce(masker(F.when(F.col("text").rlike(CUES), F.col("text"))), F.col("text"))
    name = free_name("_clean", documents)
    changed = documents.withColumn(name, clean)
    if "n_chars" in documents.columns:
        kept = F.col(name).eqNullSafe(F.col("text"))
        length = F.length(name).cast(documents.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(kept, F.col("n_chars")).otherwise(length))
    changed = changed.withColumn("text", F.col(name))
    return changed.select(*[F.col(f"`{c}`") for c in documents.columns])


def mask_text(text: str) -> str | None:
    spans = [{"start": s, "end": e} for s, e, _ in spans_of(text)]
    return mask(text, spans) if spans else None
