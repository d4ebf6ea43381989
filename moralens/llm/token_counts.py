"""Token counts with a tokenizers file, from batches balanced by bytes.

Texts are split at ASCII white space, which the tokenizer drops and no token crosses, so the counts
of the pieces add up to the text's; a word counts as its lower-case letters and the marks behind it,
which the tokenizer parts too. Slices of bounded bytes reduce to their different pieces, known ones
come from a memory of bounded size, and new ones are encoded in batches of about equal bytes. Only
lengths leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moralens.llm.text import bytes_of, slices, words_of

BATCH_BYTES = 1 << 10  # of words encoded as one text
MEMORY_PIECES = 1_000_000
LIMIT = 2048
MARKS = ".,;:!?"
SPACES = (9, 10, 13)


class PieceCounter:
    """Tokens of pieces by their 64-bit hash, from a memory that starts anew when it is full."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)

    def count(self, text: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Tokens of each row of a slice."""
        spaced = text.copy()
        spaced[np.isin(text, SPACES)] = 32
        hashes, begins, ends = words_of(spaced, rows)
        names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, names), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == names if len(self.hashes) else np.zeros(len(names), dtype=bool)
        counts = np.zeros(len(names), dtype=np.int64)
        counts[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        raw = text.tobytes()
        pieces = [raw[begins[i] : ends[i]].decode() for i in first[new]]
        counts[new] = self.encode(pieces)
        if len(self.hashes) + len(new) > MEMORY_PIECES:
            self.hashes, self.counts = names[: MEMORY_PIECES // 2], counts[: MEMORY_PIECES // 2]
        elif len(new):
            both = np.concatenate([self.hashes, names[new]])
            order = np.argsort(both, kind="stable")
            self.hashes, self.counts = both[order], np.concatenate([self.counts, counts[new]])[order]
        sums = np.concatenate([[0], np.cumsum(counts[which])])
        return np.diff(sums[np.searchsorted(begins, rows)])

    def encode(self, pieces: list[str]) -> np.ndarray:
        parts = [word_parts(piece) for piece in pieces]
        different = {part for both in parts for part in both}
        found: dict[str, int] = {}
        words = [part for part in different if is_latin(part)]
        # words of letters alone are one pre-token each, so many of them make one text
        texts: list[list[str]] = [[]]
        size = 0
        for word in words:
            texts[-1].append(word)
            size += len(word)
            if size >= BATCH_BYTES:
                texts.append([])
                size = 0
        for own, encoded in zip(texts, self.tokenizer.encode_batch([" ".join(t) for t in texts], add_special_tokens=False), strict=True):
            number = np.array(encoded.word_ids, dtype=np.int64)
            found.update(zip(own, np.bincount(number, minlength=len(own)).tolist(), strict=True))
        others = [part for part in different if part not in found]
        found.update(zip(others, map(len, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)), strict=True))
        return np.array([sum(found[part] for part in both) for both in parts], dtype=np.int64)


def piece_counter(tokenizer_path: str):
    """An Arrow function: texts to token counts."""

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        counter = PieceCounter(tokenizer)
        for batch in batches:
            flat, offsets = bytes_of(batch)
            found = [np.zeros(0, dtype=np.int64)]
            for start, stop in slices(offsets):
                own = offsets[start : stop + 1]
                found.append(counter.count(flat[own[0] : own[-1]], own - own[0]))
            yield pa.array(np.concatenate(found))

    return F.arrow_udf(counted, "bigint")


def is_latin(word: str) -> bool:
    """Letters whose lower case is one letter, whatever stands beside them."""
    return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word


def word_parts(piece: str) -> tuple[str, ...]:
    """A Latin word as its lower-case letters and the marks behind it; anything else as it is."""
    word = piece.rstrip(MARKS)
    if is_latin(word):
        marks = piece[len(word) :]
        return (word.lower(), marks) if marks else (word.lower(),)
    return (piece,)


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row. NULL text counts as empty.

    ``tokenizer_path`` names a tokenizers file that every executor has. Its normaliser and
    pre-tokeniser must drop white space, ignore case and part letters from marks, else pieces would
    not add up: this is checked.
    """
    check_parts(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = documents.select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), piece_counter(tokenizer_path)(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def check_parts(tokenizer_path: str) -> None:
    """Raise unless a sample text gives the same tokens whole and in parts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    sample = "One two\nthree, it's  4\tfive! été ́x \r\n's end."
    whole = [tokenizer.id_to_token(i) for i in tokenizer.encode(sample, add_special_tokens=False).ids]
    parts = [p for w in re.findall(r"[^ \t\r\n]+", sample) for p in word_parts(w)]
    pieces = [tokenizer.id_to_token(i) for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids]
    if whole != pieces:
        raise ValueError("this tokenizer's tokens cross white space or depend on case")
