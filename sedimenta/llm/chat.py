r"""Chat formatting: conversations that share initial turns are merged into prefix trees.

A pack is one training sequence. It holds conversations that stand together in the order of their
turns, so that all that share their first turns are neighbours; each distinct prefix of turns is one
node, whose tokens are emitted once per pack, depth-first. A node's tokens have the position ids that
they would have in the conversation alone (the ancestors' tokens come before), and may attend to the
ancestors' intervals of the pack and causally to their own. A tree whose tokens exceed the pack's
budget goes on in a further pack that begins with the ancestors again, as attention can't cross
sequences: no group of conversations, however large, has to fit into one row or task.

Every turn is ``<s>[ROLE]role[/ROLE]text</s>``. In roles and texts, whatever looks like one of these
marks or like ``[INST]``, ``[/INST]``, with any number of backslashes behind its first character, gets one
more backslash there, and loses it again on reading back. The marks are tokens of their own, so a
text's tokens never contain one. The loss mask covers exactly the tokens of assistant texts.

Null texts and roles are empty. Rows of a conversation go by turn (null first), then role and text;
repeated rows are turns like others. A null conv_id is a conversation too. An empty table has no packs.
Columns other than conv_id, turn, role and text aren't read. One conversation is one example and fits in memory,
as one document does.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a pack, unless one conversation alone has more; and conversations of a pack.
PACK_TOKENS = 8192
PACK_MEMBERS = 4096

_MARKS = ("<s>", "[ROLE]", "[/ROLE]", "</s>")
_PLAIN = re.compile(r"([<\[])(\\*)(/?(?:s|INST|ROLE)[>\]])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s|INST|ROLE)[>\]])")
#: A tokenizer takes at most this many code points at once; decoding is exact wherever a text is cut.
_STRETCH = 2048


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Tokens:
    """Bytes, or a byte-level vocabulary; marks follow behind its ids."""

    def __init__(self, ranks: bytes | None = None, pattern: str | None = None) -> None:
        self.coder = None
        self.size = 256
        if ranks:
            import tiktoken

            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
            self.size = max(known.values()) + 1
            self.coder = tiktoken.Encoding("given", pat_str=pattern or r"\s+|\S+", mergeable_ranks=known, special_tokens={})

    def mark(self, which: int) -> int:
        return self.size + which

    def encode(self, text: str) -> list[int]:
        if self.coder is None:
            return list(text.encode("utf-8", "surrogatepass"))
        if len(text) <= _STRETCH:
            return self.coder.encode_ordinary(text)
        return [t for at in range(0, len(text), _STRETCH) for t in self.coder.encode_ordinary(text[at : at + _STRETCH])]

    def decode(self, ids: list[int]) -> str:
        """Text without marks."""
        return (bytes(ids) if self.coder is None else self.coder.decode_bytes(ids)).decode("utf-8", "surrogatepass")


@dataclass
class _Node:
    parent: int
    depth: int
    start: int
    position: int
    tokens: np.ndarray
    loss: tuple[int, int] | None
    attends: list[tuple[int, int]]  # the ancestors' intervals, neighbours as one


@dataclass
class _Pack:
    nodes: list[_Node] = field(default_factory=list)
    members: list[tuple[int | None, int]] = field(default_factory=list)
    size: int = 0

    def add(self, parent: int, tokens: np.ndarray, loss: tuple[int, int] | None) -> int:
        above = self.nodes[parent] if parent >= 0 else None
        attends: list[tuple[int, int]] = []
        if above:
            attends = list(above.attends)
            end = above.start + len(above.tokens)
            if attends and attends[-1][1] == above.start:
                attends[-1] = (attends[-1][0], end)
            else:
                attends.append((above.start, end))
        position = above.position + len(above.tokens) if above else 0
        self.nodes.append(_Node(parent, above.depth + 1 if above else 0, self.size, position, tokens, loss, attends))
        self.size += len(tokens)
        return len(self.nodes) - 1


_INTERVAL = pa.struct([("start", pa.int32()), ("end", pa.int32())])
PACK_SCHEMA = pa.schema([
    ("tokens", pa.list_(pa.int32())),
    ("position_ids", pa.list_(pa.int32())),
    ("nodes", pa.list_(pa.struct([
        ("parent", pa.int32()), ("depth", pa.int32()), ("start", pa.int32()), ("n_tokens", pa.int32()), ("first_position", pa.int32()),
        ("attends", pa.list_(_INTERVAL)), ("loss_start", pa.int32()), ("loss_end", pa.int32()),
    ]))),
    ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))),
])
PACK_DDL = (
    "tokens array<int>, position_ids array<int>, nodes array<struct<parent int, depth int, start int, n_tokens int, first_position int, "
    "attends array<struct<start int, end int>>, loss_start int, loss_end int>>, members array<struct<conv_id bigint, leaf int>>"
)


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)), values)


def _rows(packs_: list[_Pack]) -> pa.RecordBatch:
    """A row per pack, see PACK_SCHEMA."""
    nodes = [n for p in packs_ for n in p.nodes]
    number = lambda values: pa.array(values, pa.int32())
    sizes = np.array([len(n.tokens) for n in nodes], dtype=np.int64)
    tokens = np.concatenate([np.empty(0, np.int32), *(n.tokens for n in nodes)])
    first = np.array([n.position for n in nodes], dtype=np.int64)
    positions = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
    spans = [a for n in nodes for a in n.attends]
    intervals = pa.StructArray.from_arrays([number([a for a, _ in spans]), number([b for _, b in spans])], names=["start", "end"])
    of_nodes = pa.StructArray.from_arrays(
        [
            number([n.parent for n in nodes]), number([n.depth for n in nodes]), number([n.start for n in nodes]), number(sizes), number(first),
            _lists([len(n.attends) for n in nodes], intervals),
            number([n.start + n.loss[0] if n.loss else None for n in nodes]), number([n.start + n.loss[1] if n.loss else None for n in nodes]),
        ],
        fields=list(PACK_SCHEMA.field("nodes").type.value_type),
    )
    members = [m for p in packs_ for m in p.members]
    of_members = pa.StructArray.from_arrays([pa.array([c for c, _ in members], pa.int64()), number([leaf for _, leaf in members])], names=["conv_id", "leaf"])
    pack_sizes = [p.size for p in packs_]
    columns = [_lists(pack_sizes, number(tokens)), _lists(pack_sizes, number(positions)), _lists([len(p.nodes) for p in packs_], of_nodes), _lists([len(p.members) for p in packs_], of_members)]
    return pa.RecordBatch.from_arrays(columns, schema=PACK_SCHEMA)


def _segment(tokens: Tokens, role: str, text: str) -> tuple[np.ndarray, tuple[int, int] | None]:
    head = [tokens.mark(0), tokens.mark(1), *tokens.encode(escape(role)), tokens.mark(2)]
    body = tokens.encode(escape(text))
    return np.array([*head, *body, tokens.mark(3)], dtype=np.int32), (len(head), len(head) + len(body)) if role == "assistant" else None


def packs(conversations: DataFrame, ranks: bytes | None = None, pattern: str | None = None, pack_tokens: int = PACK_TOKENS, pack_members: int = PACK_MEMBERS) -> DataFrame:
    """A row per pack, see PACK_SCHEMA: tokens, position ids, nodes depth-first, and each conversation's leaf."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # equal beginnings stand together; conversations that are alike as a whole go by id, so that many of them still divide
    keyed = talks.select("conv_id", "turns", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("path"))
    ordered = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(ranks, pattern)
        pack, path = _Pack(), []  # path: (role, text, node) of the last conversation
        for batch in batches:
            done: list[_Pack] = []
            turns = batch.column("turns")
            bounds, flat = turns.offsets.to_pylist(), turns.values
            every = list(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist(), strict=True))
            for conv, begin, end in zip(batch.column("conv_id").to_pylist(), bounds, bounds[1:], strict=False):
                said = every[begin:end]
                same = 0
                while same < min(len(path), len(said)) and path[same][:2] == said[same]:
                    same += 1
                fresh = [_segment(tokens, *s) for s in said[same:]]
                if pack.members and (pack.size + sum(len(t) for t, _ in fresh) > pack_tokens or len(pack.members) >= pack_members):
                    done.append(pack)
                    pack, path, same = _Pack(), [], 0
                    fresh = [_segment(tokens, *s) for s in said]
                del path[same:]
                for s, (ids, loss) in zip(said[same:], fresh, strict=True):
                    path.append((*s, pack.add(path[-1][2] if path else -1, ids, loss)))
                pack.members.append((conv, path[-1][2] if path else -1))
            if done:
                yield _rows(done)
        if pack.members:
            yield _rows([pack])

    return ordered.mapInArrow(run, PACK_DDL)


READ_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"


class _Reader:
    """One pack, read as a model sees it: a conversation is what its last node may attend to, in the order of position ids."""

    def __init__(self, coder: Tokens, tokens: np.ndarray, positions: np.ndarray, loss: np.ndarray) -> None:
        self.coder, self.tokens, self.positions, self.loss = coder, tokens, positions, loss
        self.marks = np.flatnonzero(tokens >= coder.size)
        self.texts: dict[int, tuple[str, str]] = {}  # by first token: (escaped, unescaped)

    def text(self, begin: int, end: int) -> tuple[str, str]:
        if begin not in self.texts:
            escaped = self.coder.decode(self.tokens[begin:end].tolist())
            self.texts[begin] = escaped, unescape(escaped)
        return self.texts[begin]

    def conversation(self, intervals: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str, int, int]:
        """(role and text of each turn, all text under the loss mask, characters of the formatted text, tokens)."""
        turns, loss, chars, at = [], [], 0, 0
        for begin, end in intervals:
            if not np.array_equal(self.positions[begin:end], np.arange(at, at + end - begin)):
                raise ValueError("position ids don't follow on")
            at += end - begin
            marks = self.marks[np.searchsorted(self.marks, begin) : np.searchsorted(self.marks, end)].tolist()
            kinds = (self.tokens[marks] - self.coder.size).tolist()
            if kinds != [0, 1, 2, 3] * (len(marks) // 4):
                raise ValueError("not a formatted conversation")
            for k in range(0, len(marks), 4):
                (role_, role), (text_, text) = (self.text(marks[k + i] + 1, marks[k + i + 1]) for i in (1, 2))
                turns.append((role, text))
                chars += len(role_) + len(text_) + sum(map(len, _MARKS))
                masked = self.loss[marks[k] : marks[k + 3] + 1]
                inside = self.loss[marks[k + 2] + 1 : marks[k + 3]]
                if masked.any():
                    if not inside.all() or masked.sum() != len(inside):
                        raise ValueError("the loss mask isn't one text")
                    loss.append(text)
        return turns, "".join(loss), chars, at


def read_back(packed: DataFrame, ranks: bytes | None = None, pattern: str | None = None) -> DataFrame:
    """A row per conversation with digests of what its tokens and its loss mask say.

    A conversation is put together from the intervals that its leaf attends to, never from its nodes' parents; position ids that
    don't go on from one to the next are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokens(ranks, pattern)
        names = [x.split()[0] for x in READ_DDL.split(", ")]
        whole = lambda array: array.to_numpy(zero_copy_only=False)
        for batch in batches:
            out = []
            lists = {c: batch.column(c) for c in ("tokens", "position_ids", "nodes", "members")}
            bounds = {c: x.offsets.to_pylist() for c, x in lists.items()}
            tokens, positions = whole(lists["tokens"].values), whole(lists["position_ids"].values)
            nodes, members = lists["nodes"].values, lists["members"].values
            start, size = (nodes.field(c).to_pylist() for c in ("start", "n_tokens"))
            loss_start, loss_end = (nodes.field(c).to_pylist() for c in ("loss_start", "loss_end"))
            attends = nodes.field("attends")
            spans = list(zip(attends.values.field("start").to_pylist(), attends.values.field("end").to_pylist(), strict=True))
            of_node = attends.offsets.to_pylist()
            convs, leaves = (members.field(c).to_pylist() for c in ("conv_id", "leaf"))
            for p in range(batch.num_rows):
                t0, t1 = bounds["tokens"][p : p + 2]
                n0, n1 = bounds["nodes"][p : p + 2]
                mask = np.zeros(t1 - t0, dtype=bool)
                for n in range(n0, n1):
                    if loss_start[n] is not None:
                        mask[loss_start[n] : loss_end[n]] = True
                reader = _Reader(coder, tokens[t0:t1], positions[t0:t1], mask)
                for m in range(*bounds["members"][p : p + 2]):
                    leaf = n0 + leaves[m]
                    seen = [] if leaves[m] < 0 else [*spans[of_node[leaf] : of_node[leaf + 1]], (start[leaf], start[leaf] + size[leaf])]
                    turns, loss, chars, n_tokens = reader.conversation(seen)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((convs[m], len(turns), digest, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), chars, n_tokens))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return packed.mapInArrow(run, READ_DDL)
