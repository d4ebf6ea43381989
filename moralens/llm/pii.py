"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs, schemes, identifier cues and
digits. From each anchor a local parser expands to the left and right as far as its grammar allows and
validates the result. Every parser is linear in the text and none starts inside what it has read, so a
text without spaces costs no more than prose.

The base kinds equal the leftmost non-overlapping matches of their published patterns. A filter on
the JVM lets only texts with a cue reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.llm.text import free_name

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("login", "iban", "account")
KINDS = BASE_KINDS + EXTRA_KINDS

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
LOCAL = frozenset(LETTERS + DIGITS + "._%+-")
LABEL = frozenset(LETTERS + DIGITS + "-")
PHONE_TAIL = frozenset(DIGITS + " ().-")

#: Anchors and the parser that each starts.
ANCHORS = {"@": "email", "+": "phone", "://": "login"} | {
    cue: "account" for cue in ("account number", "account no", "acct", "passport", "ssn", "social security")
} | {"iban": "iban"} | {d: "digit" for d in DIGITS}

FOUR_GROUPS = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
GROUP = re.compile(r"[0-9]++")
SPACED_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*+")

#: What must occur in a text (on the JVM) for any kind to be found.
CUES = (
    r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([\x20-]?[0-9]){15}"
    r"|(?i:iban|account n|acct|passport|ssn|social security)"
)


def automaton():
    import ahocorasick

    built = ahocorasick.Automaton()
    for anchor, kind in ANCHORS.items():
        built.add_word(anchor, (kind, len(anchor)))
    built.make_automaton()
    return built


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign ``at`` whose local part begins at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    n = len(text)
    end = at + 1
    while end < n and text[end] in LABEL:
        end += 1
    labels = 0
    if end == at + 1:
        return None
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end += 1
        while end < n and text[end] in LABEL:
            end += 1
        labels += 1
    return (start, end) if start < at and labels else None


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """The run of phone characters from the plus sign ``at`` to its last digit."""
    n = len(text)
    if at + 1 >= n or text[at + 1] not in DIGITS:
        return None
    end = at + 2
    while end < n and text[end] in PHONE_TAIL:
        end += 1
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 else None


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def login_at(text: str, at: int) -> tuple[int, int] | None:
    """user:password between ``://`` (ending at ``at``) and the at-sign of an authority."""
    m = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)").match(text, at)
    return m.span() if m else None


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """An account number behind the cue, with valid check digits."""
    m = re.compile(r"[ :.#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match(text, at)
    if not m:
        return None
    plain = m[1].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
    return m.span(1) if int(number) % 97 == 1 else None


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """An identifier of 6 to 18 letters and digits, digits among them, behind a cue."""
    m = re.compile(r"(?:\.|s|number|no\.?)?[ :#=]{1,3}([A-Z]{0,3}[0-9](?:-?[0-9]){5,17})(?![A-Za-z0-9])").match(text, at)
    return m.span(1) if m else None


def ip_at(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """Four groups of digits from ``at`` on, and where the next search may begin.

    Where they fail they fail from every other digit of the first group.
    """
    m = FOUR_GROUPS.match(text, at)
    if not m:
        return None, GROUP.match(text, at).end()
    # any number of zeros may stand before a part
    fits = all(len(d) <= 3 and int(d or 0) <= 255 for d in (part.lstrip("0") for part in m[0].split(".")))
    return (m.span() if fits else None), m.end()


def card_at(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The run of digits, spaced or not, from ``at`` on if it is a card number, and where the next search may begin."""
    m = SPACED_DIGITS.match(text, at)
    digits = m[0].replace(" ", "").replace("-", "")
    return (m.span() if 16 <= len(digits) <= 19 and passes_luhn(digits) else None), m.end()


def spans_of(text: str, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by kind as listed, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    # one code point stays one, so that offsets hold
    low = text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    # where the next ip and card may begin: matches do not overlap, failed ones are not tried again
    next_ip = next_card = 0
    for last, (kind, width) in anchors.iter(low):
        if kind == "digit":
            if last >= next_ip:
                span, next_ip = ip_at(text, last)
                found["ip"] += [span] if span else []
            if last >= next_card:
                span, next_card = card_at(text, last)
                found["card"] += [span] if span else []
            continue
        own = found[kind]
        floor = own[-1][1] if own else 0
        if kind == "email":
            span = email_at(text, last, floor)
        elif kind == "phone":
            span = phone_at(text, last) if last >= floor else None
        elif kind == "login":
            span = login_at(text, last + 1)
        elif kind == "iban":
            span = iban_at(text, last + 1)
        else:
            span = account_at(text, last + 1) if last + 1 - width >= floor else None
        if span:
            own.append(span)
    found["phone"] = [s for s in found["phone"] if 8 <= sum(c in DIGITS for c in text[s[0] : s[1]]) <= 15]
    return [(s, e, kind) for kind in KINDS for s, e in found[kind]]


def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    anchors = automaton()
    for texts in batches:
        rows = [spans_of(t, anchors) if t else [] for t in texts]
        yield pd.DataFrame(
            {
                "starts": [[s[0] for s in r] for r in rows],
                "ends": [[s[1] for s in r] for r in rows],
                "kinds": [[s[2] for s in r] for r in rows],
            }
        )


def personal_spans(documents: DataFrame) -> DataFrame:
    """The input's columns and ``pii_spans``: an array of (start, end, kind), by kind, then start.

    Offsets count code points, ends are exclusive. NULL and empty texts have no spans; every input
    row gives one row, repeated rows included; the input may not have a column of that name.
    """
    if "pii_spans" in (c.lower() for c in documents.columns):
        raise ValueError("the input already has a column pii_spans")
    scanner = F.pandas_udf(scan, "starts array<int>, ends array<int>, kinds array<string>")
    found = scanner(F.when(F.col("text").rlike(CUES), F.col("text")))
    name = free_name("_s", documents)
    zipped = F.transform(
        F.arrays_zip(F.col(f"{name}.starts"), F.col(f"{name}.ends"), F.col(f"{name}.kinds")),
        lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"), x["kinds"].alias("kind")),
    )
    own = [F.col(f"`{c}`") for c in documents.columns]
    return documents.select(*own, found.alias(name)).select(*own, zipped.alias("pii_spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_digest(documents: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as text, one row per input row."""
    scanned = personal_spans(documents.select("doc_id", "text"))
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii_spans")).alias("spans"),
    )
