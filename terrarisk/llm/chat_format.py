"""Chat formatting by token-level assembly.

Every turn is encoded by itself: the role and the text are separate segments, and the reserved ids of the turn marks,
which no text can produce, are spliced between them. The loss mask of a turn is the prefix sum of +1 at the first and
-1 after the last token of an assistant text. Control strings in a text ("<|", also with backslashes between) get one more backslash, which reading removes.

Turns are formatted where they lie. Only the digests of a whole conversation need its turns in order: they pass through
one task as a stream, sorted by Spark, so that memory doesn't follow a conversation's length.

Defined results: null texts and roles are empty; turns with equal numbers are ordered by role and then by text, null
turns, roles and texts come first; a conv_id of any type that is read back from its string will do, and null is a
conversation of its own; other columns are ignored; repeated rows are turns of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import default_path, encoder

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role(role: str) -> str:
    """One line, for the role ends at the first line end."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role_back(line: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; printable bytes stand for themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def format_turns(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text (which orders ties), ids, mask."""
    tokenizer_path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        begin = np.array([encode.tokenizer.get_vocab_size()], "<u4")
        end = begin + np.uint32(1)
        line = np.frombuffer(encode.ids("\n"), "<u4")
        for batch in batches:
            ids, masks = [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                segments = [begin, np.frombuffer(encode.ids(_role(role or "")), "<u4"), line, np.frombuffer(encode.ids(escape(text or "")), "<u4"), end, line]
                places = np.cumsum([0, *map(len, segments)])
                step = np.zeros(places[-1] + 1, np.int8)
                if role == "assistant":
                    step[places[3]] += 1
                    step[places[4]] -= 1
                ids.append(np.concatenate(segments).astype(np.int32))
                masks.append(np.cumsum(step[:-1]).astype(np.int8))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))], names=["conv_id", "turn", "role", "text", "ids", "mask"])

    kinds = {f.name: f.dataType.simpleString() for f in conversations.schema}
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, mask array<tinyint>")


def placed(turns: DataFrame) -> DataFrame:
    """Formatted turns with first, a turn's first token in its conversation: the prefix sum of the turns' lengths."""
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("first", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))


def read_conversations(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """From formatted turns, a row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    tokenizer_path = tokenizer_path or default_path()
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(tokenizer_path).tokenizer
        vocabulary, size = token_bytes(tokenizer), tokenizer.get_vocab_size()
        text_of = lambda ids: b"".join(map(vocabulary.__getitem__, ids.tolist())).decode("utf-8", "replace")
        now, done = None, []

        def row(s: dict) -> dict:
            return {"conv_id": s["id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["all"]}

        for batch in batches:
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask")):
                if now is None or conv != now["id"]:
                    if now is not None:
                        done.append(row(now))
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                marks = np.flatnonzero(ids >= size)  # start and end of the turn
                inner = text_of(ids[marks[0] + 1 : marks[1]])
                role, text = inner.split("\n", 1) if "\n" in inner else (inner, "")
                loss = unescape(text_of(ids[mask > 0]))
                now["n"] += 1
                now["turns"].update(f"{_role_back(role)}\n{unescape(text)}\n".encode())
                now["loss"].update(loss.encode())
                now["chars"] += len(loss)
                now["all"] += len(START) + len(inner) + len(END) + len(text_of(ids[marks[1] + 1 :]))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([row(now)], schema=out)

    out = pa.schema([("conv_id", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    name = F.col("conv_id").cast("string").alias("conv_id")
    ordered = turns.select(name, "turn", "role", "text", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = ordered.select("conv_id", "ids", "mask").mapInArrow(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return rows.withColumn("conv_id", F.col("conv_id").cast(kind))


def chat_format(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Formats the conversations, writes the turns and returns what reading them gives."""
    return read_conversations(written(format_turns(conversations, tokenizer_path), "turns"), tokenizer_path)
