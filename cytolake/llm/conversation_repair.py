"""Conversations repaired by the cheapest edits, the ASCII-least among equals.

Rows of a conversation, in order of turn (nulls first; ties by role, then text), are edited until the initials of their
roles read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank rows and for repeats
of an earlier role and text), Insert of an empty turn 3; a truncated row that stays adds 3. An audit is the edits' initials.

The search is over nodes (rows consumed, state), with states start, after s, after u, after a. A cost DP gives every node
its cheapest way to the end; arcs on cheapest ways are optimal. From a node each edit leads to one node, so a node's
least audit begins with its least optimal edit; nodes are ranked by the first 1, 2, 4, ... letters of their audits, each
round from the ranks at both ends of the doubled pointers, and the path is read off the pointers, all places at once.

A conversation may be of any length. Rows are sorted over the whole table by ranges and fall into blocks of ``BLOCK``
rows; a block gives the cheapest cost from each state to each (a piece for each conversation in it). Pieces are scanned
backwards, four numbers at a time, which tells every piece what follows it; blocks then rank their own nodes and give the
audit for each state that they may be entered in. Turns are edited as they stream by in order, so a task holds a block,
or the audit of a conversation, which is part of its row, and never its texts. The digest of a conversation is a stream
over its turns by nature.

Nulls of any column count as one space, in the damage's hash too; a null conv_id is a conversation, a null turn has no
part in gaps. Roles other than by initial s, u or a (in lower case), the empty one too, can't be kept. Rows that repeat
are duplicates of the first. Empty tables give no rows. Columns beyond the four are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spent

#: Rows of a block, as a power of two.
BLOCK_BITS = 12
_SPACES = " \t\n\x0b\x0c\r"
#: Edits in ASCII order, and what they cost.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = (4, 3, 0, 3)
TRUNCATED = 3
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
#: The state after an inserted turn or a changed role, by state; the value of each state when nothing follows.
_FORCED = np.array([USER, USER, ASSISTANT, USER])
_END = np.array([0, 6, 3, 0], np.int64)
#: The state after keeping a role of class none, s, u, a, by state; -1 where that is not allowed.
_KEPT = np.array([[-1] * 4, [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1]])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[SYSTEM, USER] = _LEGAL[USER, ASSISTANT] = _LEGAL[ASSISTANT, USER] = True


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after damage by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 strips ``[.!?]``, 3 repeats, 4 makes a user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn"), space("role").alias("role"), space("text").alias("text"), how.alias("_how")).filter("_how <> 0")
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_how") == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role class, blank, duplicate, truncated) of every row, with its place ``at`` over the whole table, written."""
    body = F.rtrim(F.col("text"), F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256))
    ordered = rows.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    light = cut(ordered.select("conv", "turn", role.alias("role"), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"), digest.alias("digest"), F.monotonically_increasing_id().alias("at")), "turns")
    # the first row of its role and text has its place among the firsts; counted before it is shuffled, however often a text repeats
    firsts = light.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    marked = light.join(firsts, "at", "left").withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull())
    out = cut(marked.select("conv", "at", F.shiftright("at", BLOCK_BITS).alias("block"), "turn", "role", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("open")).alias("truncated")), "turns")
    spent(light)
    return out


class _Block:
    """A block's rows in order: the pieces that they fall into, by conversation, and each row's edits."""

    def __init__(self, table: pa.Table):
        table = table.take(pa.array(np.argsort(table.column("at").to_numpy(), kind="stable")))
        self.table = table
        conv = table.column("conv").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        self.first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        self.size = np.diff(np.append(self.first, len(conv)))
        flag = {c: table.column(c).to_numpy().astype(bool) for c in ("blank", "duplicate", "truncated")}
        self.flag, self.role = flag, table.column("role").to_numpy()
        gone = flag["blank"] | flag["duplicate"]
        # (row, state, edit) -> cost and state, Insert apart
        self.cost = np.full((len(conv), 4, 4), _FAR, np.int64)
        self.next = np.zeros((len(conv), 4, 4), np.int64)
        self.cost[:, :, DELETE], self.next[:, :, DELETE] = COST[DELETE], np.arange(4)
        more = np.where(flag["truncated"], TRUNCATED, 0)[:, None]
        kept = _KEPT[self.role]
        self.cost[:, :, KEEP] = np.where(gone[:, None] | (kept < 0), _FAR, COST[KEEP] + more)
        self.next[:, :, KEEP] = np.maximum(kept, 0)
        self.cost[:, :, REROLE] = np.where(gone[:, None], _FAR, COST[REROLE] + more)
        self.next[:, :, REROLE] = _FORCED

    def values(self, beyond: np.ndarray) -> np.ndarray:
        """The cheapest cost from every node, (row, state, ...), given what lies beyond each piece, (piece, state, ...)."""
        out = np.empty((len(self.role), *beyond.shape[1:]), np.int64)
        after, tail = beyond.copy(), (1,) * (beyond.ndim - 2)
        for back in range(1, int(self.size.max(initial=0)) + 1):
            own = np.flatnonzero(self.size >= back)
            row = self.first[own] + self.size[own] - back
            step = np.full((len(own), *beyond.shape[1:]), _FAR, np.int64)
            for edit in (DELETE, KEEP, REROLE):
                step = np.minimum(step, self.cost[row, :, edit].reshape(len(own), 4, *tail) + after[own[:, None], self.next[row, :, edit]])
            once = COST[INSERT] + step[:, _FORCED]
            after[own] = out[row] = np.minimum(np.minimum(step, once), COST[INSERT] + once[:, _FORCED])
        return out


def _pieces(table: pa.Table) -> pa.Table:
    """For each piece: counts, turns, and the cheapest cost from each state to each."""
    b = _Block(table)
    none = np.where(np.eye(4, dtype=bool), 0, _FAR)
    costs = b.values(np.broadcast_to(none, (len(b.first), 4, 4)))[b.first].reshape(-1, 16)
    legal = np.ones(len(b.role), bool)
    legal[1:] = _LEGAL[b.role[:-1], b.role[1:]]
    legal[b.first] = True
    turn = b.table.column("turn")
    known, value = ~np.asarray(turn.is_null()), turn.fill_null(0).to_numpy()
    fresh = known.copy()
    fresh[1:] &= ~known[:-1] | (value[1:] != value[:-1])
    fresh[b.first] = known[b.first]
    total = lambda x: np.add.reduceat(x.astype(np.int64), b.first)
    last = b.first + b.size - 1
    some = total(known)
    span = lambda at: pa.array(value[np.clip(at, 0, len(value) - 1)], pa.int64(), mask=some == 0)
    return pa.table({
        "conv": b.table.column("conv").take(pa.array(b.first)), "block": b.table.column("block").take(pa.array(b.first)), "n": b.size, "blank": total(b.flag["blank"]), "duplicate": total(b.flag["duplicate"]),
        "truncated": total(b.flag["truncated"]), "illegal": total(~legal), "role_first": b.role[b.first].astype(np.int32), "role_last": b.role[last].astype(np.int32),
        "turn_first": span(last - some + 1), "turn_last": span(last), "turns": total(fresh), "costs": pa.array(list(costs), pa.list_(pa.int64())),
    })


_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
_PIECE = "conv {kind}, block long, n long, blank long, duplicate long, truncated long, illegal long, role_first int, role_last int, turn_first long, turn_last long, turns long, "


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation from its last to its first: what lies beyond each, the cheapest cost to the end from each state."""
    conv, value = object(), _END
    for b in batches:
        beyond, last = [], []
        for c, costs in zip(b.column("conv").to_pylist(), b.column("costs").to_pylist(), strict=True):
            last.append(c != conv)
            if c != conv:
                conv, value = c, _END
            beyond.append(value)
            value = (np.array(costs).reshape(4, 4) + value).min(axis=1)
        rest = [c for c in b.schema.names if c != "costs"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(beyond, pa.list_(pa.int64())), pa.array(last)], names=[*rest, "beyond", "last"])


def ranked_paths(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Ranks of nodes by their least strings, the letter that each begins with, pointers by 1, 2, 4, ... letters, and lengths.

    ``edges`` (node, letter) are the nodes that letters lead to, -1 for none; a node without any ends its strings.
    """
    n = len(edges)
    itself = np.arange(n)

    def least(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = np.where(edges >= 0, np.arange(edges.shape[1]) * n + rank[edges], edges.shape[1] * n)
        letter = weight.argmin(axis=1)
        return letter, np.where(weight[itself, letter] < edges.shape[1] * n, edges[itself, letter], itself)

    letter, to = least(np.zeros(n, np.int64))
    over = to == itself
    rank = np.unique(np.where(over, 0, letter + 1), return_inverse=True)[1]
    length, pointers = np.where(over, 0, 1), [to]
    while not over[pointers[-1]].all():
        p = pointers[-1]
        rank = np.unique(rank * n + rank[p], return_inverse=True)[1]
        length = length + length[p]
        pointers.append(p[p])
    letter, to = least(rank)
    return rank, letter, pointers, length


def _audited(table: pa.Table, pieces: pa.Table) -> pa.Table:
    """For each piece and each state that it may be entered in: the audit of its least path, and the state that it is left in."""
    b = _Block(table)
    pieces = pieces.take(pa.array(np.argsort(pieces.column("conv").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), kind="stable")))
    place = {c: k for k, c in enumerate(pieces.column("conv").to_pylist())}
    pieces = pieces.take(pa.array([place[c] for c in b.table.column("conv").take(pa.array(b.first)).to_pylist()], pa.int64()))
    beyond = np.array(pieces.column("beyond").to_pylist(), np.int64).reshape(-1, 4)
    last = pieces.column("last").to_numpy()
    value = b.values(beyond)
    # nodes: each row's four states, and four beyond each piece
    n_rows, n_pieces = len(b.role), len(b.first)
    of = np.repeat(np.arange(n_pieces), b.size)
    node = (np.arange(n_rows) + of) * 4
    exits = (b.first + b.size + np.arange(n_pieces)) * 4
    edges = np.full((4 * (n_rows + n_pieces), 4), -1, np.int64)
    worth = np.zeros(len(edges), np.int64)
    states = np.arange(4)
    worth[node[:, None] + states] = value
    worth[exits[:, None] + states] = beyond
    for edit in (DELETE, KEEP, REROLE):
        to = node[:, None] + 4 + b.next[:, :, edit]
        edges[node[:, None] + states, edit] = np.where(b.cost[:, :, edit] + worth[to] == value, to, -1)
    inside = np.concatenate([node, exits[last]])[:, None]  # turns are inserted before a row of the piece, or after all
    to = inside + _FORCED
    edges[inside + states, INSERT] = np.where(COST[INSERT] + worth[to] == worth[inside + states], to, -1)
    _, letter, pointers, length = ranked_paths(edges)
    enter = ((b.first + np.arange(n_pieces)) * 4)[:, None] + states
    start = np.repeat(enter.ravel(), length[enter.ravel()])
    step = np.arange(len(start)) - np.repeat(np.cumsum(length[enter.ravel()]) - length[enter.ravel()], length[enter.ravel()])
    at = start
    for k, p in enumerate(pointers):
        at = np.where(step >> k & 1, p[at], at)
    text = np.frombuffer(LETTERS.encode(), np.uint8)[letter[at]].tobytes().decode()
    ends = np.cumsum(length[enter.ravel()])
    audits = [text[e - n : e] for e, n in zip(ends, length[enter.ravel()], strict=True)]
    left = pointers[-1][enter] - exits[:, None]
    out = {c: pieces.column(c) for c in pieces.schema.names if c not in ("beyond", "last")}
    out |= {"cost": value[b.first, START], "audits": pa.array([audits[4 * k : 4 * k + 4] for k in range(n_pieces)], pa.list_(pa.string())), "exits": pa.array(list(left.astype(np.int32)), pa.list_(pa.int32()))}
    return pa.table(out)


def _report(pieces: list[dict]) -> dict:
    """Counts, cost and audit of a conversation from its pieces, in order."""
    out = dict.fromkeys(("gaps", *_COUNTS, "cost"), 0)
    state, audit, turns, low, high, role = START, [], 0, None, None, None
    for k, p in enumerate(pieces):
        for c in _COUNTS:
            out[c] += p[c]
        out["illegal"] += int(k > 0 and not _LEGAL[role, p["role_first"]])
        role = p["role_last"]
        if p["turns"]:
            turns += p["turns"] - (high == p["turn_first"])
            low, high = p["turn_first"] if low is None else low, p["turn_last"]
        out["cost"] = out["cost"] if k else p["cost"]
        audit.append(p["audits"][state])
        state = p["exits"][state]
    return out | {"gaps": 0 if low is None else high - low + 1 - turns, "audit": "".join(audit)}


_NAMES = {USER: "user", ASSISTANT: "assistant"}


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From conversations in order, each its pieces, then its rows: its report, then its repaired turns."""
    schema = None
    conv, pieces, report, place, state, position = object(), [], None, 0, START, 0

    def flushed(out: dict) -> None:
        """Closes the conversation's list of pieces: the report goes first."""
        nonlocal report
        if report is None:
            report = _report(pieces)
            add(out, report=report)

    def add(out: dict, **more) -> None:
        for name in schema.names:
            out[name].append(more.get(name) if name != "conv" else conv)

    def inserted(out: dict) -> None:
        nonlocal place, state, position
        while place < len(report["audit"]) and report["audit"][place] == "I":
            state, place, position = int(_FORCED[state]), place + 1, position + 1
            add(out, position=position, edit="I", role=_NAMES[state], text="")

    def closed(out: dict) -> None:
        if conv is not start:
            flushed(out)
            inserted(out)

    start = conv
    for b in batches:
        if schema is None:
            report_type = pa.struct([*[pa.field(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")], pa.field("audit", pa.string())])
            schema = pa.schema([pa.field("conv", b.schema.field("conv").type), pa.field("report", report_type), pa.field("position", pa.int64()), pa.field("edit", pa.string()), pa.field("role", pa.string()), pa.field("text", pa.string())])
        out: dict = {name: [] for name in schema.names}
        for c, rec, piece, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "rec", "piece", "role", "text")), strict=True):
            if c != conv:
                closed(out)
                conv, pieces, report, place, state, position = c, [], None, 0, START, 0
            if rec == 0:
                continue
            if rec == 1:
                pieces.append(piece)
                continue
            flushed(out)
            inserted(out)
            edit, place = report["audit"][place], place + 1
            if edit == "D":
                continue
            state = int(_FORCED[state]) if edit == "R" or role[:1] != "s" else SYSTEM
            position += 1
            add(out, position=position, edit=edit, role=role if edit == "K" else _NAMES[state], text=text)
        yield pa.RecordBatch.from_pydict(out, schema=schema)
    if schema is not None:
        out = {name: [] for name in schema.names}
        closed(out)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


REPORT = "struct<" + ", ".join(f"{c}: long" for c in ("gaps", *_COUNTS, "cost")) + ", audit: string>"


def edited(rows: DataFrame, names: DataFrame) -> DataFrame:
    """For every conversation of ``names`` (conv) its report, then its repaired turns (position, edit, role, text), in order within a partition.

    ``rows`` are (conv, turn, role, text), without nulls in role and text.
    """
    kind = dict(rows.dtypes)["conv"]
    light = _faults(rows)
    pieces = light.groupBy("block").applyInArrow(_pieces, _PIECE.format(kind=kind) + "costs array<long>")
    ahead = pieces.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), F.col("block").desc())
    known = ahead.mapInArrow(_backwards, _PIECE.format(kind=kind) + "beyond array<long>, last boolean")
    audited = light.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_audited, _PIECE.format(kind=kind) + "cost long, audits array<string>, exits array<int>")
    packed = cut(audited.select("conv", "block", F.struct(*[c for c in audited.columns if c not in ("conv", "block")]).alias("piece")), "pieces")
    spent(light)
    void = lambda kind, name: F.lit(None).cast(kind).alias(name)
    turn, piece = dict(rows.dtypes)["turn"], packed.schema["piece"].dataType
    seen = names.select("conv", F.lit(0).alias("rec"), void("long", "block"), void(piece, "piece"), void(turn, "turn"), void("string", "role"), void("string", "text"))
    parts = packed.select("conv", F.lit(1).alias("rec"), "block", "piece", void(turn, "turn"), void("string", "role"), void("string", "text"))
    turns = rows.select("conv", F.lit(2).alias("rec"), void("long", "block"), void(piece, "piece"), "turn", "role", "text")
    stream = seen.union(parts).union(turns).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "rec", "block", F.col("turn").asc_nulls_first(), "role", "text")
    return stream.mapInArrow(_edited, f"conv {kind}, report {REPORT}, position long, edit string, role string, text string")


def repaired(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The repaired turns: (conv, position from 1, edit, role, text)."""
    return edited(rows, names).filter("report IS NULL").drop("report")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its report and turns, in order: the report and the SHA-256 of its turns."""
    conv, report, digest = None, None, hashlib.sha256()
    kind = None

    def rows(done: list) -> pa.RecordBatch:
        fields = [pa.field("conv", kind), *[pa.field(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")], pa.field("audit", pa.string()), pa.field("sha256", pa.string())]
        return pa.RecordBatch.from_pylist(done, schema=pa.schema(fields))

    for b in batches:
        kind, done = b.schema.field("conv").type, []
        for c, r, position, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "report", "position", "role", "text")), strict=True):
            if r is not None:
                if report is not None:
                    done.append({"conv": conv, **report, "sha256": digest.hexdigest()})
                conv, report, digest = c, r, hashlib.sha256()
                continue
            digest.update(("\n" * (position > 1) + f"{role}:{text}").encode())
        yield rows(done)
    if report is not None:
        yield rows([{"conv": conv, **report, "sha256": digest.hexdigest()}])


def repair_report(conversations: DataFrame) -> DataFrame:
    """Every conv_id: what the damage left wrong, the cost and audit of its repair, and the digest of the repaired turns."""
    kind = dict(conversations.dtypes)["conv_id"]
    names = conversations.select(F.col("conv_id").alias("conv")).distinct()
    counts = ", ".join(f"{c} long" for c in ("gaps", *_COUNTS, "cost"))
    out = edited(damage(conversations), names).mapInArrow(_digested, f"conv {kind}, {counts}, audit string, sha256 string")
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
