"""Chat formatting as prefix trees.

A conversation becomes a sequence of marked turns. Conversations that begin
with the same turns share them: conversations are sorted by the hashes of
their turns, so that a depth-first walk of the prefix tree is the sort order,
and tasks stream it into packs of bounded size. A pack holds every shared turn
once, with position ids that continue along each branch, and each node's
attention intervals: the parts of the pack that its ancestors and itself fill.

The template is ``<turn role=ROLE>\\nTEXT</turn>\\n``. Inside a text, a backslash
is doubled and a backslash is put before ``<turn`` and ``</turn``; inside a role,
before backslash and ``>``. Reading is the exact inverse. Tokens are the UTF-8
bytes of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

# possessive throughout: no two ways to read a text, so none is tried again when a turn is cut off
TURN = re.compile(r"<turn role=((?:\\.|[^\\>])*+)>\n((?:[^\\<]++|\\.|<(?!/?turn))*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, str, str]:
    """A turn as what stands before its text, the escaped text, and what stands after."""
    name = role.replace("\\", "\\\\").replace(">", "\\>")
    return f"<turn role={name}>\n", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; anything but turns raises."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


class Node(NamedTuple):
    start: int
    stop: int
    parent: int
    position: int  # position id of its first token
    intervals: tuple[tuple[int, int], ...]


class Pack:
    """A prefix tree of conversations that arrive in depth-first order."""

    def __init__(self, loss_role: str = "assistant"):
        self.loss_role = loss_role
        self.tokens: list[bytes] = []
        self.mask: list[bytes] = []
        self.size = 0
        self.nodes: list[Node] = []
        self.members: list[tuple[int | None, int]] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # turn and node of the branch that is open

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        depth = 0
        while depth < len(self.path) and depth < len(turns) and self.path[depth][0] == turns[depth]:
            depth += 1
        del self.path[depth:]
        for turn in turns[depth:]:
            parent = self.path[-1][1] if self.path else -1
            before, text, after = (x.encode() for x in render(*turn))
            start, stop = self.size, self.size + len(before) + len(text) + len(after)
            seen = self.nodes[parent].intervals if self.path else ()
            if seen and seen[-1][1] == start:
                seen = (*seen[:-1], (seen[-1][0], stop))
            else:
                seen = (*seen, (start, stop))
            above = self.nodes[parent] if self.path else None
            position = above.position + above.stop - above.start if above else 0
            self.tokens += [before, text, after]
            loss = b"\x01" if turn[0] == self.loss_role else b"\x00"
            self.mask += [bytes(len(before)), loss * len(text), bytes(len(after))]
            self.nodes.append(Node(start, stop, parent, position, seen))
            self.path.append((turn, len(self.nodes) - 1))
            self.size = stop
        self.members.append((conv_id, self.path[-1][1] if self.path else -1))


PACKS = (
    "tokens binary, loss_mask binary, "
    "nodes array<struct<start:int,stop:int,parent:int,position:int,intervals:array<struct<start:int,stop:int>>>>, "
    "members array<struct<conv_id:long,node:int>>"
)
_INTERVAL = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_NODE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("intervals", pa.list_(_INTERVAL))])
_MEMBER = pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])


def _batch(pack: Pack) -> pa.RecordBatch:
    nodes = [
        {"start": n.start, "stop": n.stop, "parent": n.parent, "position": n.position, "intervals": [{"start": a, "stop": b} for a, b in n.intervals]}
        for n in pack.nodes
    ]
    members = [{"conv_id": c, "node": n} for c, n in pack.members]
    bytes_of = lambda parts: pa.array([b"".join(parts)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [bytes_of(pack.tokens), bytes_of(pack.mask), pa.array([nodes], pa.list_(_NODE)), pa.array([members], pa.list_(_MEMBER))],
        ["tokens", "loss_mask", "nodes", "members"],
    )


def with_position_ids(packs: DataFrame) -> DataFrame:
    """``packs`` with position_ids: one id for each token, counting up along every branch from 0."""
    ids = F.transform("nodes", lambda n: F.sequence(n["position"], n["position"] + n["stop"] - n["start"] - 1))
    return packs.withColumn("position_ids", F.flatten(ids))


def format_conversations(conversations: DataFrame, *, limit: int = 1 << 16, loss_role: str = "assistant") -> DataFrame:
    """Packs: tokens, loss_mask, nodes with positions and attention intervals, and members (conv_id, last node).

    A token is a byte of the formatted text. A node holds the position id of
    its first token, and the ids count up inside it; ``with_position_ids``
    writes them out.

    ``conversations`` has conv_id, turn, role and text, one row a turn; other
    columns are ignored. Turns go by turn number, nulls first, ties by role
    and text, so that repeated rows stay and stand together. Null texts and
    roles are empty. Rows without conv_id form one conversation. loss_mask is
    1 on the text of ``loss_role`` turns. A pack closes with the conversation
    that brings it to ``limit`` tokens; a turn shared across packs is in each.
    An empty table gives no packs.

    The sort key is the turns' hashes and then conv_id, so that neither a
    first turn nor a whole conversation that a third of all rows share stays
    in one task. A single conversation is the unit that must fit into memory.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    parts = partitions(conversations.sparkSession)
    dealt = keyed.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack(loss_role)
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            ends, rows = lists.offsets.to_pylist(), lists.values
            roles, texts = rows.field("role"), rows.field("text")
            for i, conv in enumerate(ids):
                lo, n = ends[i], ends[i + 1] - ends[i]
                pack.add(conv, list(zip(roles.slice(lo, n).to_pylist(), texts.slice(lo, n).to_pylist(), strict=True)))
                if pack.size >= limit:
                    yield _batch(pack)
                    pack = Pack(loss_role)
        if pack.members:
            yield _batch(pack)

    return dealt.select("conv_id", "turns").mapInArrow(run, PACKS)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_packs(packs: DataFrame) -> DataFrame:
    """Every member conversation as read back from the packs' tokens, masks, positions and attention intervals.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline for each
    turn), loss_chars and loss_sha256 of the unescaped text under the mask,
    formatted_chars. Position ids that don't count up along a conversation raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data, mask = (np.frombuffer(batch.column(c)[row].as_py(), np.uint8) for c in ("tokens", "loss_mask"))
                nodes, out = batch.column("nodes")[row].as_py(), []
                for member in batch.column("members")[row].as_py():
                    spans = nodes[member["node"]]["intervals"] if member["node"] >= 0 else []
                    cuts = [slice(s["start"], s["stop"]) for s in spans]
                    joined = lambda a: np.concatenate([a[c] for c in cuts]) if cuts else a[:0]  # noqa: B023, E731
                    own, under = joined(data), joined(mask)
                    node, end = member["node"], len(own)
                    while node >= 0:  # from the last node to the root, each begins where the one above ended
                        n = nodes[node]
                        end -= n["stop"] - n["start"]
                        if n["position"] != end:
                            raise ValueError(f"position ids of conversation {member['conv_id']} don't count up")
                        node = n["parent"]
                    formatted = own.tobytes().decode()
                    turns = parse(formatted)
                    loss = unescape(own[under == 1].tobytes().decode())
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((member["conv_id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = [f.split()[0] for f in READ.split(", ")]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return packs.mapInArrow(run, READ)
