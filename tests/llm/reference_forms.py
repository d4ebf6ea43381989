"""Plain Python forms of the corpus operators, for small inputs."""

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\W_]+")


def words(text):
    return WORD.findall((text or "").lower())


def repeated_bytes(docs, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in sorted(docs)]
    for i, b in raw:
        for at in range(len(b) - length + 1):
            first.setdefault(b[at : at + length], i)
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    found = words(text)
    if not found:
        return collections.Counter([("", text or "")])
    if len(found) < 5:
        return collections.Counter([tuple(found)])
    return collections.Counter(tuple(found[k : k + 5]) for k in range(len(found) - 4))


def probability_jaccard(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys())
    return total


def near_classes(docs, threshold=0.8):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a].keys() & sets[b].keys() and probability_jaccard(sets[a], sets[b]) >= threshold:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def tiled(doc, item, least=5):
    """Words of ``item`` under greedy tiles: the longest unmarked match first, then by place."""
    used_doc, used_item, total = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (
                    i + n < len(doc)
                    and j + n < len(item)
                    and doc[i + n] == item[j + n]
                    and not used_doc[i + n]
                    and not used_item[j + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        for k in range(n):
            used_doc[i + k] = used_item[j + k] = True
        total += n


def bm25(docs, queries, top=10):
    tf = {i: collections.Counter(words(t)) for i, t in docs}
    n = len(tf)
    mean = sum(sum(c.values()) for c in tf.values()) / n
    df = collections.Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in tf.items():
            size = sum(c.values())
            score = sum(
                math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
                for w in set(words(text))
                if w in c
            )
            if score > 0:
                scored.append((-round(score, 9), i))
        out += [(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(scored)[:top])]
    return out


def secrets(text):
    assign = re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    )
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found))


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def personal(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
