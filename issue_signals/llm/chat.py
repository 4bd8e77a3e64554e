"""Chat formatting at token level, with loss masks and reversible escapes.

A turn becomes  START role "\\n" text END "\\n".  START and END are reserved ids above the vocabulary.
Each segment is encoded by itself and the reserved ids are spliced in between, so no text can produce
one. In texts and roles the written form of a control string is escaped as well (a backslash goes
between "<" and "|"; one more where there are some), so that the decoded conversation is unambiguous
even as plain text. The loss mask is the prefix sums of the segments' lengths: true for the tokens of
assistant texts, not for what surrounds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issue_signals.llm.bpe import GROUP_CHARS, decode_ids, default_pattern, encode_texts, vocabulary_size
from issue_signals.llm.common import small_batches, together

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles are one line: line breaks are escaped too."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turns_ids(roles: list[str | None], texts: list[str | None], path: str, loss_roles: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and loss mask of each turn. The segments of all turns are encoded together, each by itself."""
    start, count = vocabulary_size(path), len(roles)
    segments = [escape_role(r or "") + "\n" for r in roles] + [escape(t or "") for t in texts] + ["\n"]
    encoded = [np.frombuffer(ids, "<i4") for ids in encode_texts(segments, path, default_pattern())]
    begin, end = np.array([start], np.int32), np.array([start + 1], np.int32)
    out = []
    for k, role in enumerate(roles):
        parts = (begin, encoded[k], encoded[count + k], end, encoded[-1])
        ends = np.cumsum([len(p) for p in parts])
        mask = np.zeros(ends[-1], np.int8)
        if (role or "") in loss_roles:
            mask[ends[1] : ends[2]] = 1
        out.append((np.concatenate(parts), mask))
    return out


def formatted(
    conversations: DataFrame,
    path: str,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per row of conversations: conv_id, turn, ids, loss_mask. The tokens of a conversation are
    those of its rows in the order of turn, then ids.

    Turns are formatted where they lie, without a shuffle, so the length of a conversation doesn't
    matter. A null text or role counts as empty; a null turn comes first; rows with a null conversation
    form one conversation without id. An empty table gives no rows."""
    small_batches(conversations.sparkSession)
    columns = [F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn")]
    columns += [F.col(f"`{c}`").cast("string").alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, GROUP_CHARS):
            turns = turns_ids(batch.column("role").to_pylist(), batch.column("text").to_pylist(), path, loss_roles)
            ids = pa.array([t[0] for t in turns], pa.list_(pa.int32()))
            masks = pa.array([t[1] for t in turns], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), ids, masks], names=["conv_id", "turn", "ids", "loss_mask"])

    return conversations.select(*columns).mapInArrow(encode, "conv_id long, turn long, ids array<int>, loss_mask array<tinyint>")


def read_back(ids: np.ndarray, mask: np.ndarray, path: str) -> tuple[str, str, str, str]:
    """Role, text, the text under the mask and the plain text of one formatted turn, from its tokens alone."""
    start = vocabulary_size(path)
    body = decode_ids(ids[ids < start].tolist(), path).decode()
    assert ids[0] == start and np.count_nonzero(ids >= start) == 2
    end = int(np.flatnonzero(ids == start + 1)[0])
    inside = decode_ids(ids[1:end].tolist(), path).decode()
    role, _, text = inside.partition("\n")
    under = decode_ids(ids[mask.astype(bool)].tolist(), path).decode()
    plain = START + inside + END + body[len(inside) :]
    return unescape_role(role), unescape(text), unescape(under), plain


def conversation_digests(turns: DataFrame, path: str) -> DataFrame:
    """What the formatted turns hold, read back from their tokens: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. The turns of a conversation pass by in order, one at a
    time, so that a long conversation needs no more memory than a short one."""
    small_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [part.split()[0] for part in schema.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None

        def closed(state: list) -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]

        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss_mask")):
                if now is None or now[0] != conv:
                    done += [closed(now)] if now else []
                    now = [conv, 0, sha256(), 0, sha256(), 0]
                role, text, under, plain = read_back(ids.values.to_numpy(), mask.values.to_numpy(), path)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(under)
                now[4].update(under.encode())
                now[5] += len(plain)
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in done], schema=_digest_schema())
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, closed(now)))], schema=_digest_schema())

    return rows.mapInArrow(digest, schema)


def _digest_schema() -> pa.Schema:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string()}
    return pa.schema([*kinds.items(), ("formatted_chars", pa.int64())])
