"""Conversations to training text: turns marked by a template, with a mask over what a model is to learn.

Text is put together by columns: the lengths of all segments of a batch (begin of turn, role, text, end) give their offsets by
a running sum; short segments are copied through one array of scatter indices, long ones as slices, into one Arrow buffer
allocated once. Control strings inside texts and roles are escaped with a backslash after their first character, so that
whatever a text says can neither begin nor end a turn, and reading back gives the text as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text put together at once (a longer single text by itself), and of a segment that is copied as a slice.
BATCH_BYTES, SLICE = 1 << 24, 1 << 12


@dataclass(frozen=True)
class Template:
    """Control strings around turns. Those of one begin with the same few characters that occur nowhere else in them."""

    begins: dict[str, str] = field(default_factory=lambda: {"system": "<s>[SYS]", "user": "<s>[INST]", "assistant": "<s>[/INST]"})
    other: tuple[str, str] = ("<s>[ROLE]", "[/ROLE]")
    end: str = "</s>"
    learnt: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

    def __post_init__(self):
        first = {c[0] for c in self.controls}
        if any(first & set(c[1:]) or "\\" in c or len(c) < 2 for c in self.controls) or "\\" in first:
            raise ValueError("a control string's first character may not occur later in one, and none may hold a backslash")
        parts = re.compile("|".join(map(re.escape, self.controls)))
        if any(parts.sub("", s) for s in (*self.begins.values(), *self.other, self.end)):
            raise ValueError("marks of turns are made of control strings only")


def _escaped(texts: pa.Array, template: Template) -> pa.Array:
    """One backslash more after the first character of every control string, with or without some there already."""
    for c in template.controls:
        hit = pc.match_substring_regex(texts, f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}")
        if pc.any(hit).as_py():
            texts = pc.replace_substring_regex(texts, f"({re.escape(c[0])})(\\\\*{re.escape(c[1:])})", r"\1\\\2")
    return texts


def unescaped(text: str, template: Template) -> str:
    for c in template.controls:
        if c[1:] in text:
            text = re.sub(f"{re.escape(c[0])}\\\\(\\\\*{re.escape(c[1:])})", lambda m: m[0][0] + m[1], text)
    return text


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings without nulls, and the offsets of its values."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets.astype(np.int64)


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """All turns as one buffer, with their offsets in it, and offset and length of each turn's text (both in bytes)."""
    names = sorted(template.begins)
    marks = [template.begins[n].encode() for n in names] + [template.other[0].encode(), template.other[1].encode(), template.end.encode(), b""]
    sizes, other = np.array([len(m) for m in marks]), len(names)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    kind = pc.fill_null(pc.index_in(roles, pa.array(names, roles.type)), other).to_numpy(zero_copy_only=False).astype(np.int64)
    strange = kind == other
    shown = _escaped(pc.if_else(pa.array(strange), roles, ""), template)
    (role_bytes, role_at), (text_bytes, text_at) = _bytes_of(shown), _bytes_of(_escaped(texts, template))
    source = np.concatenate([np.frombuffer(b"".join(marks), np.uint8), role_bytes, text_bytes])
    roles_from, texts_from = sum(map(len, marks)), sum(map(len, marks)) + len(role_bytes)
    close = np.where(strange, other + 1, other + 3)
    origin = np.stack([at[kind], roles_from + role_at[:-1], at[close], texts_from + text_at[:-1], np.full(len(kind), at[other + 2])], 1).ravel()
    length = np.stack([sizes[kind], np.diff(role_at), sizes[close], np.diff(text_at), np.full(len(kind), sizes[other + 2])], 1).ravel()
    place = np.concatenate([[0], np.cumsum(length)])
    buffer = pa.allocate_buffer(int(place[-1]))
    out = np.frombuffer(buffer, np.uint8)
    short = np.flatnonzero(length <= SLICE)
    n = length[short]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)  # the byte within its segment
    out[np.repeat(place[short], n) + inside] = source[np.repeat(origin[short], n) + inside]
    for s in np.flatnonzero(length > SLICE):
        out[place[s] : place[s + 1]] = source[origin[s] : origin[s] + length[s]]
    return buffer, place[::5], place[3:-1:5], length[3::5]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about BATCH_BYTES of text."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(size):
        limit = BATCH_BYTES + (size[begin - 1] if begin else 0)
        end = max(begin + 1, int(np.searchsorted(size, limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def format_chat(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:  # noqa: B008
    """conv, piece, formatted, mask of every conversation: its turns in order, and start and length (in bytes of the piece) of each text to learn.

    Conversations stream through their task sorted, so none is held whole: one that goes on in another batch is several
    pieces, which belong together in the order of their numbers; each ends with a turn. Turns are in order of turn (null
    first), then role and text; null roles and texts count as empty, roles without a mark of their own are written out; a
    null conversation is one of its own; repeated rows are turns each; an empty table gives an empty one; other columns are
    left out, whatever their names.
    """
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    told = told.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = object(), 0
        for batch in (part for whole in found for part in _parts(whole)):
            ids = batch.column("conv").to_pylist()
            new = np.array([a != b for a, b in zip(ids, [last, *ids])])
            number = 0 if new[0] else number + 1
            heads = np.flatnonzero(new if new[0] else np.concatenate([[True], new[1:]]))
            buffer, turns, text_at, text_size = assemble(batch.column("role"), batch.column("text"), template)
            learnt = pc.is_in(batch.column("role"), pa.array(template.learnt, batch.column("role").type)).to_numpy(zero_copy_only=False)
            starts = turns[heads]
            within = text_at - np.repeat(starts, np.diff(np.append(heads, len(ids))))
            spans = pa.StructArray.from_arrays([pa.array(within[learnt]), pa.array(text_size[learnt])], ["start", "length"])
            per = np.add.reduceat(learnt.astype(np.int64), heads)
            mask = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), spans)
            offsets = pa.array(np.append(starts, turns[-1]), pa.int64()).buffers()[1]
            formatted = pa.LargeStringArray.from_buffers(len(heads), offsets, buffer)
            numbers = np.zeros(len(heads), np.int64)
            numbers[0], last = number, ids[-1]
            number = int(numbers[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv").take(pa.array(heads)), pa.array(numbers), formatted.cast(pa.string()), mask], ["conv", "piece", "formatted", "mask"])

    kind = rows.schema[conv].dataType.simpleString()
    out = told.mapInArrow(run, f"conv {kind}, piece long, formatted string, mask array<struct<start:long,length:long>>")
    return out.withColumnRenamed("conv", conv)


def read_turns(formatted: str, template: Template) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted piece."""
    role_of = {mark: role for role, mark in template.begins.items()}
    begin = "|".join(map(re.escape, sorted(role_of, key=len, reverse=True)))
    other = f"{re.escape(template.other[0])}(?P<role>.*?){re.escape(template.other[1])}"
    at = 0
    for m in re.finditer(f"(?:(?P<mark>{begin})|{other})(?P<text>.*?){re.escape(template.end)}", formatted, re.S):
        if m.start() != at:
            break
        at = m.end()
        yield role_of[m["mark"]] if m["mark"] else unescaped(m["role"], template), unescaped(m["text"], template)
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")


def chat_digests(pieces: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:  # noqa: B008
    """What the pieces of format_chat(), in its order, hold: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is of role, line end, text, line end of every turn; loss_* of the texts under the mask, unescaped. Pieces are
    read one after the other, with one running digest, so that a conversation of any length takes the memory of a piece.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict | None = None
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def given(found: list[dict]) -> Iterator[pd.DataFrame]:
            if found:
                yield pd.DataFrame([(d["conv"], d["turns"], d["sha"].hexdigest(), d["loss"], d["loss_sha"].hexdigest(), d["chars"]) for d in found], columns=names)

        for frame in frames:
            done = []
            for one, piece, text, mask in zip(frame["conv"], frame["piece"], frame["formatted"], frame["mask"]):
                if piece == 0:
                    done += [now] if now else []
                    now = {"conv": one, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}
                now["chars"] += len(text)
                for role, said in read_turns(text, template):
                    now["turns"] += 1
                    now["sha"].update(f"{role}\n{said}\n".encode())
                raw = text.encode() if len(mask) else b""
                for span in mask:
                    said = unescaped(raw[span["start"] : span["start"] + span["length"]].decode(), template)
                    now["loss"] += len(said)
                    now["loss_sha"].update(said.encode())
            yield from given(done)
        yield from given([now] if now else [])

    kind = pieces.schema[conv].dataType.simpleString()
    rows = pieces.withColumnRenamed(conv, "conv").select("conv", "piece", "formatted", "mask")
    out = rows.mapInPandas(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv)
