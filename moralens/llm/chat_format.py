"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example's text is all preceding turns as context and one reply; only the reply's text lies under
the loss mask. The work is dealt by blocks of ``BLOCK_TURNS`` turn numbers: a block of a longer conversation
gets the formatted blocks before it, one row each, so its examples begin at the first turn as all others do,
and the blocks of one conversation are expanded by different tasks. Inside a block, parts (by turn count and
characters) say where an example's own stretch begins; ``(conv_id, block, part, row)`` order the examples.
The examples of a conversation of n turns hold some n^2 / 4 turns: that is the size of the expansion.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts get a backslash
behind their first character; ones that have backslashes there get one more, so it can be undone.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 32
BLOCK_CHARS = 1 << 16
BATCH_CHARS = 1 << 22
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINABLE = "assistant"

# fixed values: control strings of common chat templates
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
PLAIN = re.compile(rf"([<\[])(\\*)({TAILS})")
ESCAPED = re.compile(rf"([<\[])\\(\\*)({TAILS})")

EXAMPLE_FIELDS = "block bigint, part int, row int, context_turns int, text string, begin int, fresh int, loss_start int, loss_end int, whole boolean"
PIECE_FIELDS = "block bigint, part int, last boolean, whole boolean, context_sha256 string, n_turns bigint, turns binary, loss binary, loss_chars bigint, formatted_chars bigint"
DIGEST_FIELDS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escaped(text: str) -> str:
    return PLAIN.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of formatted turns."""
    pieces = formatted.split(END)
    if pieces.pop():
        raise ValueError("a formatted turn has no end")
    for piece in pieces:
        role, line, text = piece.partition("\n")
        if not line or not role.startswith(START):
            raise ValueError("a formatted turn has no beginning")
        yield unescaped_role(role.removeprefix(START)), unescaped(text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _written(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded weight."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weight(row) + 100
        if size >= BATCH_CHARS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _formatted(role: str | None, said: str | None) -> tuple[str, str]:
    """(head, body) of a formatted turn; ``END`` follows."""
    return f"{START}{escaped_role(role or '')}\n", escaped(said or "")


def _blocks_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, block, formatted text) of (conv_id, block, role, text) rows in order."""
    for key, run in itertools.groupby(rows, key=lambda r: r[:2]):
        yield (*key, "".join(f"{head}{body}{END}" for head, body in (_formatted(*r[2:]) for r in run)))


def _examples_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Examples of (conv_id, block, marker, turn, role, text) rows in that order."""
    group, whole, part, number, rank, offset, cut = object(), True, 0, 0, 0, 0, None
    text, begin, fresh, turns = "", 0, 0, 0

    def remainder():
        # turns that no reply of this part follows: context only, nothing to learn
        if fresh < len(text):
            yield (*group, part, number, turns, text, begin, fresh, None, None, whole)

    for conversation, block, marker, _, role, said in rows:
        if group != (conversation, block):
            yield from remainder()
            group, whole, part, number, rank, offset, cut = (conversation, block), block == 0, 0, 0, 0, 0, None
            text, begin, fresh, turns = "", 0, 0, 0
        if marker:
            whole = False
            if said:
                # a formatted block before this one
                text += said
                turns += said.count(END)
                begin = fresh = len(text)
            continue
        own = (rank // BLOCK_TURNS, offset // BLOCK_CHARS)
        if own != cut:
            yield from remainder()
            part += cut is not None
            begin = fresh = len(text)
            cut, number = own, 0
        head, body = _formatted(role, said)
        start = len(text) + len(head)
        text = f"{text}{head}{body}{END}"
        if role == TRAINABLE:
            yield (*group, part, number, turns, text, begin, fresh, start, start + len(body), whole)
            number, fresh = number + 1, len(text)
        turns += 1
        rank += 1
        offset += len(head) + len(body) + len(END)
    yield from remainder()


def _block() -> Column:
    """Rows keep their order over blocks: NULL and negative turn numbers come first."""
    return F.greatest(F.floor(F.coalesce(F.col("turn"), F.lit(0)) / BLOCK_TURNS), F.lit(0)).cast("bigint")


def chat_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn of ``conversations`` (conv_id, turn, role, text; other columns are ignored).

    conv_id; block, part, row: the order; context_turns: turns of ``text`` before its last; text: all turns of
    the conversation up to the reply; begin: where the part's own turns begin in it; fresh: where the part of
    ``text`` begins that no row before holds; loss_start, loss_end: the reply's text (code points, end
    exclusive); whole: no other block belongs to the conversation. A part's turns behind its last reply give
    one more row with a NULL loss span, so every turn is in the output.

    Turns are ordered by turn (NULLs first), role, text; repeated rows are turns of their own. A NULL
    conv_id is one conversation; NULL role and text are empty. An empty table has no rows. Rows with one
    (conv_id, block) come together and in order.
    """
    turns = conversations.select("conv_id", _block().alias("block"), F.lit(0).alias("marker"), "turn", "role", "text")
    # a conversation's first block is told of others by a row, not by looking at the whole conversation
    later = turns.where("block > 0").select("conv_id", "block").distinct()
    longer = later.select("conv_id").distinct()
    kinds = dict(turns.dtypes)
    markers = longer.select(
        "conv_id", F.lit(0).cast("bigint").alias("block"), F.lit(2).alias("marker"), *[F.lit(None).cast(t).alias(c) for c, t in turns.dtypes[3:]]
    )
    # the blocks of longer conversations, formatted once and sent as one row to every block behind them
    theirs = turns.join(longer.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    gathered = theirs.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *order).select("conv_id", "block", "role", "text")
    block_fields = f"_conv {kinds['conv_id']}, _before bigint, _text string"
    block_schema = _arrow_schema(conversations, block_fields)
    blocks = gathered.mapInArrow(lambda batches: _written(_blocks_of(_rows(batches)), block_schema, lambda r: len(r[2])), block_fields)
    ahead = later.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_before") < F.col("block"))).select(
        "conv_id", "block", F.lit(1).alias("marker"), F.col("_before").cast(kinds["turn"]).alias("turn"),
        F.lit(None).cast(kinds["role"]).alias("role"), F.col("_text").alias("text"),
    )
    dealt = turns.unionByName(markers).unionByName(ahead).repartition("conv_id", "block")
    ordered = dealt.sortWithinPartitions("conv_id", "block", F.desc("marker"), *order)
    fields = f"conv_id {kinds['conv_id']}, {EXAMPLE_FIELDS}"
    schema = _arrow_schema(conversations, fields)
    return ordered.mapInArrow(lambda batches: _written(_examples_of(_rows(batches)), schema, lambda r: len(r[5])), fields)


def _arrow_schema(df: DataFrame, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], fields).schema)


def _turn_bytes(formatted: str) -> tuple[int, bytes]:
    """Number of turns, and ``role\\ntext\\n`` of each."""
    said = list(turns_of(formatted))
    return len(said), "".join(f"{role}\n{words}\n" for role, words in said).encode()


def _pieces_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Turns and trainable texts of every part, read from its examples only; a block's first has its context's digest."""
    part, held, before = None, None, ""
    for conversation, block, number, _, _, text, begin, fresh, start, stop, whole in rows:
        own = (conversation, block, number)
        if own != part:
            same = part is not None and part[:2] == own[:2]
            if held:
                yield (*part, not same, *held)
            context = None
            if not same:
                before = text[:begin]
                context = hashlib.sha256(_turn_bytes(before)[1]).hexdigest()
            part, held = own, [whole, context, 0, b"", b"", 0, 0]
        if text[:fresh] != before:
            raise ValueError(f"the context of an example of conversation {conversation} is not what precedes it")
        n, said = _turn_bytes(text[fresh:])
        before = text
        held[2] += n
        held[3] += said
        if start is not None:
            reply = unescaped(text[start:stop])
            held[4] += reply.encode()
            held[5] += len(reply)
        # as the SQL twin counts them: from the beginning of the part on
        held[6] += len(text) - begin
    if held:
        yield (*part, True, *held)


def _digests_of(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of conversations whose pieces come in order; only hash states are kept."""
    conversation, state = object(), None

    def closed():
        n, turns, chars, loss, formatted = state
        return (conversation, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

    for own, _, _, _, _, context, n, turns, loss, chars, formatted in rows:
        if state is None or own != conversation:
            if state:
                yield closed()
            conversation, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        if context is not None and context != state[1].hexdigest():
            raise ValueError(f"the context of an example of conversation {own} is not what its blocks before hold")
        state[0] += n
        state[1].update(turns)
        state[2] += chars
        state[3].update(loss)
        state[4] += formatted
    if state:
        yield closed()


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from ``chat_examples``' rows alone.

    Digests cover ``role\\ntext\\n`` per turn, and the unescaped texts under the loss masks without
    anything between. The rows must come as ``chat_examples`` returns them (``arranged`` puts back a
    table read from files). A row whose context differs from what the rows before hold raises, in other blocks too.
    ``formatted_chars`` counts every example's text from its part's beginning on, as the SQL twin does.

    A conversation of one block is digested where its rows are. The others' pieces meet by conversation
    and are hashed as they stream by: a digest of a sequence has no parallel form, but needs no memory.
    """
    key = examples.schema["conv_id"].dataType.simpleString()
    pieces = f"conv_id {key}, {PIECE_FIELDS}, {DIGEST_FIELDS.replace('n_turns', 'all_turns').replace('_chars', '_total')}"
    digests = f"conv_id {key}, {DIGEST_FIELDS}"
    piece_schema, digest_schema = _arrow_schema(examples, pieces), _arrow_schema(examples, digests)

    def near(batches):
        """Pieces of shared conversations, digests of whole ones."""
        waiting: list[tuple] = []

        def rows():
            for piece in _pieces_of(_rows(batches)):
                if not piece[4]:
                    yield (*piece, *[None] * 5)
                    continue
                waiting.append(piece)
                if piece[3]:
                    for _, *digest in _digests_of(iter(waiting)):
                        yield (*piece[:5], *[None] * 6, *digest)
                    waiting.clear()

        return _written(rows(), piece_schema, lambda r: len(r[7] or b"") + len(r[8] or b""))

    def far(batches):
        def rows():
            for whole, run in itertools.groupby(_rows(batches), key=lambda r: r[4]):
                if whole:
                    yield from ((r[0], *r[11:]) for r in run)
                else:
                    yield from _digests_of(r[:11] for r in run)

        return _written(rows(), digest_schema, lambda r: 300)

    read = examples.mapInArrow(near, pieces)
    return read.repartition("conv_id").sortWithinPartitions("whole", "conv_id", "block", "part").mapInArrow(far, digests)


def arranged(examples: DataFrame) -> DataFrame:
    """Rows of a written table of examples, in the order that ``read_back`` needs."""
    return examples.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part", "row", F.col("loss_start").isNull())
