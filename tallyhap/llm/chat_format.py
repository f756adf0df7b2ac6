"""Chat formatting: conversations packed as prefix trees.

Conversations stand in order of their turns' chained hashes, so those that
share initial turns are neighbours and a walk down the order is depth-first.
Each task merges its neighbours into trees and emits blocks of about
`block_tokens` tokens: every shared turn's tokens once, each with its position
id in its conversation, and per turn the intervals of the block that it attends
to (its ancestors and itself). Tokens are UTF-8 bytes unless a tokenizer file
is given. A turn shared by more conversations than fit a block, or than one
task has, is emitted once in each such block.

A turn is `<|im_start|>` role newline text `<|im_end|>` newline. Control strings
inside texts and roles are escaped reversibly: every `<` that backslashes and a
bar follow gets one more backslash.

Rows are ranged by (hashes, conversation id), so a third of all conversations
sharing a first turn, or being equal, still spread over all tasks. The turns of
one conversation are gathered into one row. A block also ends after `block_ends`
conversations, so equal ones gather in none without limit.

Nulls: a null text or role is empty; a row of null conv_id is a conversation of
its own, as nothing says which belong together; a null turn comes first. Turns of equal number stand by role, then text;
repeated rows stay, as turns of their own. Texts of any length are kept whole.
The empty table gives no block. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class ChatParams:
    """tokenizer: path of a `tokenizers` file, or None for UTF-8 bytes. learn:
    the role whose texts are under the loss mask."""

    block_tokens: int = 32_768
    block_ends: int = 10_000
    tokenizer: str | None = None
    learn: str = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text stands in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


@dataclass
class Segment:
    """One turn of a tree, emitted once: tokens [start, end) of the block, the
    position id of its first token, its parent in the block (or -1), and which
    of its tokens are under the loss mask."""

    start: int
    end: int
    position: int
    parent: int
    text: str
    loss: tuple[int, int] | None
    attends: list[tuple[int, int]]  # intervals of the block, merged; the last one ends with the token itself (causal)
    ends: list[int | None] = field(default_factory=list)  # conversations whose last turn this is


@dataclass
class Block:
    tokens: list[int] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    ended: int = 0

    def attention(self, up: int, start: int, end: int) -> list[tuple[int, int]]:
        """What a segment [start, end) below segment up attends to: its
        ancestors' intervals, handed down, and itself."""
        above = self.segments[up].attends if up >= 0 else []
        if above and above[-1][1] == start:
            return [*above[:-1], (above[-1][0], end)]
        return [*above, (start, end)]


def byte_tokens(text: str) -> list[int]:
    return list(text.encode("utf-8", "surrogatepass"))


def encoder(params: ChatParams) -> Callable[[str], list[int]]:
    if params.tokenizer is None:
        return byte_tokens
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(params.tokenizer)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def build_blocks(conversations: Iterator[tuple[int | None, list[tuple[str, str]]]], params: ChatParams = ChatParams()) -> Iterator[Block]:
    """conversations: (id, [(role, text), ...]), neighbours sharing turns. The
    header and tail of a turn are tokenized apart from its text, so the loss
    mask falls between tokens."""
    encode, block, open_ = encoder(params), Block(), []
    for conv, turns in conversations:
        shared = 0
        while shared < min(len(turns), len(open_)) and open_[shared][0] == turns[shared]:
            shared += 1
        if len(block.tokens) >= params.block_tokens or block.ended >= params.block_ends:
            yield block
            block, open_, shared = Block(), [], 0
        del open_[shared:]
        for role, text in turns[shared:]:
            whole, a, b = format_turn(role, text)
            parts = [encode(x) for x in (whole[:a], whole[a:b], whole[b:])]
            up = open_[-1][1] if open_ else -1
            position = block.segments[up].position + block.segments[up].end - block.segments[up].start if up >= 0 else 0
            start = len(block.tokens)
            for x in parts:
                block.tokens += x
            loss = (start + len(parts[0]), start + len(parts[0]) + len(parts[1])) if role == params.learn else None
            block.segments.append(Segment(start, len(block.tokens), position, up, whole, loss, block.attention(up, start, len(block.tokens))))
            open_.append(((role, text), len(block.segments) - 1))
        if open_:
            block.segments[open_[-1][1]].ends.append(conv)
            block.ended += 1
    if block.segments:
        yield block


def gathered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and its turns in order, dealt and sorted for depth-first merging."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    few = df.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text")).alias("t"))
    rows = few.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), lambda x, y: _order(x, y)).alias("t"))
    rows = rows.unionByName(few.where("conv_id is null").select("conv_id", F.array("t").alias("t")))
    each = F.transform("t", lambda x: F.substring(F.sha2(F.concat_ws("\n", F.octet_length(x["role"]).cast("string"), x["role"], x["text"]), 256), 1, 16))
    rows = rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), F.concat_ws("", each).alias("path"))
    return rows.repartitionByRange(partitions(df.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id")


def _order(x: F.Column, y: F.Column) -> F.Column:
    """By turn (null first), role, text."""
    same = F.lit(0)
    for name in ("text", "role", "turn"):
        a, b = x[name], y[name]
        less = (a < b) | (a.isNull() & b.isNotNull())
        more = (a > b) | (a.isNotNull() & b.isNull())
        same = F.when(less, -1).when(more, 1).otherwise(same)
    return same


_SEGMENT = "struct<start:long,end:long,position:long,parent:long,text:string,loss_start:long,loss_end:long,attends:array<struct<start:long,end:long>>,ends:array<long>>"


def format_conversations(df: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """Blocks: tokens, position_ids and the tree's segments."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in build_blocks(_conversations(it), params):
            position = np.concatenate([s.position + np.arange(s.end - s.start) for s in block.segments])
            segments = [
                {"start": s.start, "end": s.end, "position": s.position, "parent": s.parent, "text": s.text, "loss_start": s.loss[0] if s.loss else None, "loss_end": s.loss[1] if s.loss else None,
                 "attends": [{"start": a, "end": b} for a, b in s.attends], "ends": s.ends} for s in block.segments
            ]
            yield pd.DataFrame({"tokens": [block.tokens], "position_ids": [position], "segments": [segments]})

    return gathered(df).mapInPandas(run, f"tokens array<int>, position_ids array<long>, segments array<{_SEGMENT}>")


def _conversations(it: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    for f in it:
        for conv, turns in zip(f["conv_id"], f["turns"]):
            yield None if pd.isna(conv) else int(conv), [(t["role"], t["text"]) for t in turns]


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn must start here")
        line, end = text.index("\n", at), text.index(END, at)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


def digests(blocks: DataFrame) -> DataFrame:
    """What the blocks hold of each conversation, read back from tokens (bytes),
    attention intervals and loss masks: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in it:
            out = []
            for tokens, segments in zip(f["tokens"], f["segments"]):
                data = np.asarray(tokens).astype(np.uint8).tobytes()
                for k, s in enumerate(segments):
                    if not len(s["ends"]):
                        continue
                    spans = [(a["start"], a["end"]) for a in s["attends"]]
                    text = b"".join(data[a:b] for a, b in spans).decode("utf-8", "surrogatepass")
                    turns = read_turns(text)
                    loss = []
                    while k >= 0:  # from the last turn up to the first
                        if (at := segments[k]["loss_start"]) is not None and not pd.isna(at):
                            loss.append(data[int(at) : int(segments[k]["loss_end"])])
                        k = segments[k]["parent"]
                    said = "".join(unescape(x.decode("utf-8", "surrogatepass")) for x in reversed(loss))
                    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, said)]
                    out += [(c, len(turns), sha[0], len(said), sha[1], len(text)) for c in s["ends"]]
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return blocks.select("tokens", "segments").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
