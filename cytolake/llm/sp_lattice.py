"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text becomes a lattice: each run of spaces with the word after it is one chunk (no piece crosses such a border), and
each chunk has an arc for every piece of the vocabulary that matches at a place, or its bytes where none does. Arcs are
weighted by piece rank (p proportional to 1 / (rank + 1) to the power ``theta``), and backward sums give every arc its
probability among all ways to finish. The ``k`` segmentations with the largest Gumbel-perturbed log-probability are
found by a best-first (A-star) search whose bound is exact: a prefix's perturbed maximum. Going down one sampled path,
all siblings of a step share one lazily drawn maximum, truncated at the path's own value; the largest of them is
expanded next. The results are distinct, and each has the probability that a top-k sample holds it, given the next
value: 1 - exp(-exp(log p - threshold)), or 1 if there is no further segmentation; its logarithm is given too, as long
texts have one that no double holds.

All random numbers are hashes of (seed, row key, sample, chunk, step), so a row's samples depend on the row alone: not
on batches, partitions or retries; rows that repeat a doc_id and text get the same samples. Null and empty texts have
one segmentation, the empty one. Literal U+2581 is encoded by bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .tokens import mix

MODEL, K, THETA, SEED = "/opt/tokenizers/piece_bpe_32k.model", 2, 1.0, 11
#: Characters of the texts that are worked on at once; a longer text stands alone.
_SLICE_CHARS = 1 << 18
#: Arcs that a worker keeps; beyond, it forgets the rarer chunks (only speed depends on it).
_ARCS = 4_000_000
#: Chunks up to which weights multiply without underflow; longer ones are summed in logarithms.
_SHORT = 60
_MARK = "▁"
_G = 0x9E3779B97F4A7C15
#: The seed's key where there is no doc_id: no doc_id leads to it but by chance.
_NO_ID = 0x5851F42D4C957F2D
_OUT = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, inclusion double, log_inclusion double, round_trip boolean"


def load(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(surface, rank, byte or -1) of every piece of a model file; control pieces have no surface."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    out = []
    for i in range(n):
        if sp.is_byte(i):
            out.append(("", float(n), int(sp.id_to_piece(i)[3:5], 16)))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append(("", float(n), -1))
        else:
            out.append((sp.id_to_piece(i), float(min(n, -sp.get_score(i))), -1))
    return out


def surfaces(pieces: list[tuple[str, float, int]]) -> list[bytes]:
    return [bytes([b]) if b >= 0 else s.replace(_MARK, " ").encode() for s, _, b in pieces]


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class _Prefixes:
    """Of all prefixes of one length that pieces have: sorted hashes, each with its piece, or -1 where it is none."""

    SHIFT = np.uint64(64 - 17)

    def __init__(self, hashes: np.ndarray, pieces: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.pieces = hashes[order], pieces[order]
        self.first = np.searchsorted(self.hashes >> self.SHIFT, np.arange((1 << 17) + 1, dtype=np.uint64)).astype(np.int32)
        self.first = np.minimum(self.first, len(order) - 1)
        self.several = int(np.bincount((self.hashes >> self.SHIFT).astype(np.int64)).max()) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1: from the first with its leading bits onwards."""
        at = self.first[(h >> self.SHIFT).astype(np.int64)]
        out = np.where(self.hashes[at] == h, at, -1)
        todo, last = np.flatnonzero(out < 0), len(self.hashes) - 1
        todo = todo[self.hashes[at[todo]] < h[todo]]
        for k in range(1, self.several + 1):
            here = np.minimum(at[todo] + k, last)
            there = self.hashes[here]
            hit = there == h[todo]
            out[todo[hit]] = here[hit]
            todo = todo[there < h[todo]]
        return out


class Lattices:
    """Lattices of chunks in flat arrays: arcs of a node lie together, ``cum`` is their running probability, 1 at the last."""

    def __init__(self, pieces: list[tuple[str, float, int]], theta: float):
        self.table = {s: (i, -theta * log(rank + 1)) for i, (s, rank, _) in enumerate(pieces) if s}
        self.bytes = {b: i for i, (_, _, b) in enumerate(pieces) if b >= 0}
        self.floor = -theta * log(len(pieces) + 1)
        self.longest = max(map(len, self.table))
        self.surface = surfaces(pieces)
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.width = np.fromiter(map(len, self.surface), np.int64, len(pieces))
        self.start = np.cumsum(self.width) - self.width
        self.single = np.full(0x110000, -1, np.int32)  # pieces of one character; a space stands for its mark, the mark itself for none
        for c, (i, _) in self.table.items():
            if len(c) == 1:
                self.single[ord(c)] = i
        self.single[ord(" ")], self.single[ord(_MARK)] = self.single[ord(_MARK)], -1
        self.weight = np.full(len(pieces), exp(self.floor))
        by_length: dict[int, dict[str, int]] = {}
        for s, (i, logw) in self.table.items():
            self.weight[i] = exp(logw)
            for n in range(2, len(s)):
                by_length.setdefault(n, {}).setdefault(s[:n], -1)
            if len(s) > 1:
                by_length.setdefault(len(s), {})[s] = i
        self.known = {}
        for n, names in sorted(by_length.items()):
            sums, inverse = _hashed(_codes("".join(names)))
            at = np.arange(len(names)) * n
            self.known[n] = _Prefixes((sums[at + n] - sums[at]) * inverse[at], np.array(list(names.values()), np.int32))
        self.n_arcs = self.n_nodes = self.n_chunks = 0
        size = 1 << 16
        self.cum, self.logp = np.zeros(size), np.zeros(size)
        self.piece, self.next = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.low, self.chunk = np.zeros(size, np.int32), np.zeros(size, np.int32)  # of a node: its first arc, its chunk
        self.root, self.uses = np.zeros(size, np.int32), np.zeros(size, np.int64)
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._new()

    def _new(self) -> None:
        self._cum, self._logp, self._piece, self._next, self._low, self._root = ([] for _ in range(6))

    def _append(self, options: list[tuple[int, float, int]]) -> tuple[int, float]:
        """A node with these arcs (piece, log weight, next node); its number and log sum."""
        node = self.n_nodes
        self.n_nodes += 1
        self._low.append(self.n_arcs)
        top = max(o[1] for o in options)
        weights = [exp(o[1] - top) for o in options]
        whole = sum(weights)
        run = 0.0
        for (piece, _, nxt), w in zip(options, weights, strict=True):
            run += w
            self._cum.append(run / whole)
            self._logp.append(log(max(w / whole, 1e-300)))
            self._piece.append(piece)
            self._next.append(nxt)
        self._cum[-1] = 1.0
        self.n_arcs += len(options)
        return node, top + log(whole)

    def _build(self, chunk: str) -> int:
        n = len(chunk)
        literal = {i for i, c in enumerate(chunk) if c == _MARK} if _MARK in chunk else ()
        text = chunk.replace(" ", _MARK)
        nodes, sums = [-1] * (n + 1), [0.0] * (n + 1)
        get, longest = self.table.get, self.longest
        for at in range(n - 1, -1, -1):
            options = []
            for end in range(at + 1, min(n, at + longest) + 1):
                found = get(text[at:end])
                if found is not None and not (literal and any(at <= i < end for i in literal)):
                    options.append((found[0], found[1] + sums[end], nodes[end]))
            if not options or options[0][2] != nodes[at + 1] or get(text[at]) is None or at in literal:
                raw = chunk[at].encode("utf-8", "surrogatepass")
                nxt = nodes[at + 1]
                for b in raw[:0:-1]:
                    nxt, _ = self._append([(self.bytes[b], 0.0, nxt)])
                options.append((self.bytes[raw[0]], self.floor * len(raw) + sums[at + 1], nxt))
            nodes[at], sums[at] = self._append(options)
        return nodes[0]

    def _build_many(self, code: np.ndarray, sizes: np.ndarray) -> None:
        """Lattices of short chunks whose characters are all pieces, in one go; nodes in order of characters left."""
        code = np.where(code == ord(" "), ord(_MARK), code)
        sums, inverse = _hashed(code)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        left = np.repeat(ends, sizes) - np.arange(n)
        order = np.argsort(left.astype(np.int16), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        single = self.single[np.where(code == ord(_MARK), ord(" "), code)]
        where, length, piece = [order], [np.ones(n, np.int64)], [single[order]]
        at = order
        for size, prefixes in self.known.items():
            at = at[np.searchsorted(left[at], size) :]  # those with fewer characters left come first
            k = prefixes.find((sums[at + size] - sums[at]) * inverse[at])
            at, k = at[k >= 0], k[k >= 0]
            if not len(at):
                break
            own = prefixes.pieces[k]
            hit = own >= 0
            where.append(at[hit])
            length.append(np.full(int(hit.sum()), size))
            piece.append(own[hit])
        where, length, piece = map(np.concatenate, (where, length, piece))
        order = np.argsort(rank[where], kind="stable")
        where, length, piece = where[order], length[order], piece[order]
        rest = left[where]
        count = np.bincount(rank[where], minlength=n)
        first = np.cumsum(count) - count
        beta, share = np.zeros(n + 1), np.empty(len(where))
        weight = self.weight[piece]
        levels = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        for a, b in zip(levels, np.append(levels[1:], len(where)), strict=True):
            value = weight[a:b] * np.where(length[a:b] == rest[a], 1.0, beta[np.minimum(where[a:b] + length[a:b], n)])
            lo, hi = np.searchsorted(first, [a, b])
            whole = np.add.reduceat(value, first[lo:hi] - a)
            beta[where[first[lo:hi]]] = whole
            share[a:b] = value / np.repeat(whole, count[lo:hi])
        cum = share.copy()  # added up arc by arc, so that it depends on the chunk alone
        for k in range(1, int(count.max())):
            at = first[count > k] + k
            cum[at] += cum[at - 1]
        cum[first + count - 1] = 1.0
        node_of = self.n_nodes + rank
        nxt = np.where(length == rest, -1, node_of[np.minimum(where + length, n - 1)])
        for name, values in (("cum", cum), ("logp", np.log(np.maximum(share, 1e-300))), ("piece", piece), ("next", nxt)):
            self._store(name, self.n_arcs, values)
        self._store("low", self.n_nodes, self.n_arcs + first)
        chunk = np.empty(n, np.int64)
        chunk[rank] = self.n_chunks + np.repeat(np.arange(len(sizes)), sizes)
        self._store("chunk", self.n_nodes, chunk)
        self._store("root", self.n_chunks, node_of[ends - sizes])
        self.n_arcs += len(where)
        self.n_nodes += n
        self.n_chunks += len(sizes)

    def _store(self, name: str, at: int, new) -> None:
        old = getattr(self, name)
        if at + len(new) + 1 > len(old):
            old = np.concatenate([old, np.zeros(max(len(old) // 4, len(new)) + 1, old.dtype)])
            setattr(self, name, old)
        old[at : at + len(new)] = new

    def _shrink(self) -> None:
        """Forgets chunks that came up least, until half of the nodes at most are left."""
        uses, chunk = self.uses[: self.n_chunks], self.chunk[: self.n_nodes]
        least = 2
        while True:
            kept = uses >= least
            nodes = kept[chunk]
            if 2 * int(nodes.sum()) <= self.n_nodes:
                break
            least *= 2
        arcs = np.repeat(nodes, np.diff(self.low[: self.n_nodes + 1]))
        renamed, numbered = np.cumsum(nodes) - 1, np.cumsum(kept) - 1
        degree = np.diff(self.low[: self.n_nodes + 1])[nodes]
        nxt = self.next[: self.n_arcs][arcs]
        for name, values in (
            ("next", np.where(nxt < 0, -1, renamed[nxt])), ("cum", self.cum[: self.n_arcs][arcs]), ("logp", self.logp[: self.n_arcs][arcs]), ("piece", self.piece[: self.n_arcs][arcs]),
            ("low", np.concatenate([[0], np.cumsum(degree)])), ("chunk", numbered[chunk[nodes]]), ("root", renamed[self.root[: self.n_chunks][kept]]), ("uses", np.zeros(int(kept.sum()), np.int64)),
        ):
            self._store(name, 0, values)
        known = kept[self.numbers]
        self.keys, self.numbers = self.keys[known], numbered[self.numbers[known]]
        self.n_arcs, self.n_nodes, self.n_chunks = int(arcs.sum()), len(degree), int(kept.sum())

    def learn(self, text: str, code: np.ndarray, first: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The number of each chunk, given by place, size and hash; unknown ones get their lattices."""
        if self.n_arcs > _ARCS:
            self._shrink()
        own, index, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, own)
        fresh = np.ones(len(own), bool)
        inside = at < len(self.keys)
        fresh[inside] = self.keys[at[inside]] != own[inside]
        number = np.empty(len(own), np.int64)
        number[~fresh] = self.numbers[at[~fresh]]
        new = index[fresh]
        if len(new):
            places = _runs(first[new], sizes[new])
            plain = np.logical_and.reduceat(self.single[code[places]] >= 0, np.cumsum(sizes[new]) - sizes[new]) & (sizes[new] <= _SHORT)
            before = self.n_chunks
            if plain.any():
                with np.errstate(over="ignore"):
                    self._build_many(code[_runs(first[new[plain]], sizes[new[plain]])], sizes[new[plain]])
            arcs, nodes, chunks = self.n_arcs, self.n_nodes, self.n_chunks
            self._new()
            numbers = []
            for i in new[~plain]:
                was = self.n_nodes
                self._root.append(self._build(text[first[i] : first[i] + sizes[i]]))
                numbers += [self.n_chunks] * (self.n_nodes - was)
                self.n_chunks += 1
            for name, place in (("cum", arcs), ("logp", arcs), ("piece", arcs), ("next", arcs), ("low", nodes), ("root", chunks)):
                self._store(name, place, getattr(self, "_" + name))
            self._store("chunk", nodes, numbers)
            self._store("uses", before, np.zeros(self.n_chunks - before, np.int64))
            self.low[self.n_nodes] = self.n_arcs
            self._new()
            named = np.empty(len(new), np.int64)
            named[plain] = before + np.arange(int(plain.sum()))
            named[~plain] = chunks + np.arange(len(new) - int(plain.sum()))
            number[fresh] = named
            self.keys = np.insert(self.keys, at[fresh], own[fresh])
            self.numbers = np.insert(self.numbers, at[fresh], named)
        self.uses[number] += count
        return number[inverse]

    def roots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Root nodes of the chunks of all texts, one after another, and how many each text has; a space goes in front of a text."""
        joined = "".join([" " + t for t in texts if t])
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        code = _codes(joined)
        space, line = code == 32, code == 10
        starts = space.copy()  # a run of spaces with the word behind it, a word behind lines, or a run of lines
        starts[1:] &= ~space[:-1]
        starts[1:] |= line[:-1] & ~line[1:]
        starts[1:] |= line[1:] & ~line[:-1]
        ends = np.cumsum(size)
        starts[(ends - size)[size > 0]] = True
        first = np.flatnonzero(starts)
        sizes = np.diff(np.append(first, len(code)))
        with np.errstate(over="ignore"):
            sums, inverse = _hashed(code)
            keys = mix((sums[first + sizes] - sums[first]) * inverse[first] + sizes.astype(np.uint64) * np.uint64(_G))
        number = self.learn(joined, code, first, sizes, keys)
        edges = np.searchsorted(first, np.concatenate([[0], ends]))
        return self.root[number].astype(np.int64), np.diff(edges)

    def sample(self, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each start node to the end of its chunk: arcs of every step, starts in order, and the steps of each start."""
        cum = self.cum[: self.n_arcs]
        active = np.flatnonzero(starts >= 0)
        node = starts[active]
        items, arcs, count = [], [], np.zeros(len(starts), np.int64)
        while len(active):
            u = _unit(seeds[active] + np.uint64((len(items) + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
            arc = self.low[node].astype(np.int64)
            behind = np.flatnonzero(cum[arc] <= u)  # the last arc of a node reaches beyond every number
            while len(behind):
                arc[behind] += 1
                behind = behind[cum[arc[behind]] <= u[behind]]
            items.append(active)
            arcs.append(arc)
            count[active] += 1
            node = self.next[arc]
            going = node >= 0
            active, node = active[going], node[going]
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for step, (item, arc) in enumerate(zip(items, arcs, strict=True)):
            out[at[item] + step] = arc
        return out, count


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash of the characters, and the inverse powers that move it to any place."""
    power, inverse = tokens.power_tables(len(code))
    sums = np.zeros(len(code) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], out=sums[1:])
    return sums, inverse


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every run, one run after another."""
    at = np.cumsum(sizes) - sizes
    return np.repeat(first - at, sizes) + np.arange(int(sizes.sum()))


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs, 0 for an empty run."""
    out = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _truncated(phi: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers with locations ``phi``, given that they are below ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - phi)


def _others(p: np.ndarray) -> np.ndarray:
    """log(1 - p): the weight of an arc's siblings; minus infinity where it has none."""
    return np.where(p < 1.0 - 1e-12, np.log1p(-np.minimum(p, 1.0 - 1e-12)), -np.inf)


#: -log(-log u) is below this for every number that ``_unit`` gives.
_TOP = 37.0
#: Steps of a path whose siblings are drawn at first; each time after, twice as many.
_STEPS = 64


class Paths:
    """One sampled path for each of many texts, with the steps whose siblings have the largest perturbed values.

    ``rows`` are the texts' numbers, ``arcs`` and ``items`` (the chunk of each step) lie text after text, ``size`` steps
    each. A step's value is below its prefix's log-probability plus ``_TOP``, and prefixes only lose, so steps past the
    place where that falls below the ``k`` + 1 largest values so far are never drawn: they can neither be chosen nor be
    the threshold. ``values`` and ``steps`` hold those ``k`` + 1, the largest first.
    """

    def __init__(self, lattices: Lattices, rows: np.ndarray, arcs: np.ndarray, items: np.ndarray, size: np.ndarray, top: np.ndarray, after: np.ndarray, lead: np.ndarray, seeds: np.ndarray, k: int):
        self.rows, self.arcs, self.items, self.size, self.top = rows, arcs, items, size, top
        self.first = np.cumsum(size) - size
        self.log_prob = _summed(lattices.logp[arcs], size)
        self.values = np.full((len(rows), k + 1), -np.inf)
        self.steps = np.zeros((len(rows), k + 1), np.int64)
        self.before = np.zeros((len(rows), k + 1))  # log-probability of the prefix of each of these steps
        at, lead = after.copy(), lead.copy()
        todo, more = np.flatnonzero(at < size), _STEPS
        while len(todo):
            step = at[todo, None] + np.arange(more)
            there = step < size[todo, None]
            own = lattices.logp[arcs[np.where(there, self.first[todo, None] + step, 0)]]
            own[~there] = 0.0
            sums = lead[todo, None] + np.cumsum(own, axis=1)
            before = np.concatenate([lead[todo, None], sums[:, :-1]], axis=1)
            u = _unit(seeds[todo, None] + (step.astype(np.uint64) + np.uint64(1)) * np.uint64(_G))
            with np.errstate(divide="ignore"):
                value = np.where(there, _truncated(before + _others(np.exp(own)), top[todo, None], u), -np.inf)
            value, step, before = (np.concatenate(x, axis=1) for x in ((self.values[todo], value), (self.steps[todo], step), (self.before[todo], before)))
            best = np.argpartition(-value, k, axis=1)[:, : k + 1]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(value, best, axis=1), axis=1, kind="stable"), axis=1)
            self.values[todo], self.steps[todo], self.before[todo] = (np.take_along_axis(x, best, axis=1) for x in (value, step, before))
            at[todo] += more
            lead[todo] = sums[:, -1]
            more *= 2
            todo = todo[(at[todo] < size[todo]) & (lead[todo] + _TOP >= self.values[todo, k])]


def _segmentations(lattices: Lattices, texts: list[str], seeds: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
    """The sampled paths of all texts, best first, and the largest value that is left of each text."""
    roots, n_chunks = lattices.roots(texts)
    first_chunk = np.cumsum(n_chunks) - n_chunks
    n = len(texts)
    all_rows = np.arange(n)

    def sampled(rows: np.ndarray, starts: np.ndarray, first: np.ndarray, count: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs and chunks of the steps from ``count`` starts of each row on, the first of them at chunk ``first``; and how many steps."""
        chunk = _runs(first, count)
        key = np.repeat(seeds[rows], count) + (chunk.astype(np.uint64) + np.uint64(7)) * np.uint64(_G)
        arcs, steps = lattices.sample(starts, mix(key + np.uint64(turn)))
        return arcs, np.repeat(chunk, steps), _summed(steps, count).astype(np.int64)

    with np.errstate(over="ignore"):
        top = -np.log(-np.log(_unit(seeds + np.uint64(3))))
        arcs, items, size = sampled(all_rows, roots, np.zeros(n, np.int64), n_chunks, 1)
        zeros = np.zeros(n, np.int64)
        found = [Paths(lattices, all_rows, arcs, items, size, top, zeros, zeros.astype(float), mix(seeds + np.uint64(5)), k)]
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # rows, and the path, step and arc where each left
        for turn in range(2, k + 1):
            value = np.full((n, len(found)), -np.inf)
            for j, p in enumerate(found):
                value[p.rows, j] = p.values[:, 0]
            rows = np.flatnonzero(value.max(axis=1) > -np.inf)
            which, best = value[rows].argmax(axis=1), value[rows].max(axis=1)
            step, lead, own = np.zeros(len(rows), np.int64), np.zeros(len(rows)), np.zeros(len(rows), np.int64)
            place = np.zeros(len(rows), np.int64)  # of the row within its path's arrays
            for j, p in enumerate(found):
                mine = np.flatnonzero(which == j)
                place[mine] = np.searchsorted(p.rows, rows[mine])
                step[mine], lead[mine] = p.steps[place[mine], 0], p.before[place[mine], 0]
                own[mine] = p.arcs[p.first[place[mine]] + step[mine]]
            node = np.searchsorted(lattices.low[: lattices.n_nodes], own, "right") - 1
            degree = lattices.low[node + 1] - lattices.low[node]
            sibling = lattices.low[node, None].astype(np.int64) + np.arange(int(degree.max()) if len(rows) else 0)
            free = (np.arange(sibling.shape[1]) < degree[:, None]) & (sibling != own[:, None])
            for r, w, s, a in taken:
                at = np.minimum(np.searchsorted(r, rows), max(len(r) - 1, 0))
                same = np.flatnonzero((r[at] == rows) & (w[at] == which) & (s[at] == step)) if len(r) else np.zeros(0, np.int64)
                free[same] &= sibling[same] != a[at[same], None]
            chance = np.where(free, np.exp(lattices.logp[np.where(free, sibling, 0)]), 0.0)
            run = np.cumsum(chance, axis=1)
            mark = seeds[rows] + np.uint64(turn) * np.uint64(0xA24BAED4963EE407) + step.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            draw = _unit(mark + np.uint64(31)) * run[:, -1] if len(rows) else np.zeros(0)
            pick = np.minimum((run <= draw[:, None]).sum(axis=1), sibling.shape[1] - 1)
            short = np.flatnonzero(~free[np.arange(len(rows)), pick])  # rounding at the upper end: the last free one
            pick[short] = sibling.shape[1] - 1 - free[short, ::-1].argmax(axis=1)
            arc = sibling[np.arange(len(rows)), pick]
            left = run[:, -1] - chance[np.arange(len(rows)), pick] if len(rows) else np.zeros(0)
            more = (free.sum(axis=1) > 1) & (left > 0)
            with np.errstate(divide="ignore"):
                again = np.where(more, _truncated(lead + np.log(np.where(more, left, 1.0)), best, _unit(mark + np.uint64(37))), -np.inf)
            pieces = []
            for j, p in enumerate(found):
                mine = np.flatnonzero(which == j)
                at = place[mine]
                p.values[at, 0] = again[mine]
                order = np.argsort(-p.values[at], axis=1, kind="stable")
                p.values[at], p.steps[at], p.before[at] = (np.take_along_axis(x[at], order, axis=1) for x in (p.values, p.steps, p.before))
                pieces.append((mine, _runs(p.first[at], step[mine]), p.items[p.first[at] + step[mine]]))
            item = np.zeros(len(rows), np.int64)
            for mine, _, chunk in pieces:
                item[mine] = chunk
            count = n_chunks[rows] - item
            starts = roots[_runs(first_chunk[rows] + item, count)]
            starts[np.cumsum(count) - count] = lattices.next[arc]
            arcs, items, tail = sampled(rows, starts, item, count, turn)
            size = step + 1 + tail
            at = np.cumsum(size) - size
            whole, chunks = np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()), np.int64)
            for j, (mine, source, _) in enumerate(pieces):
                target = _runs(at[mine], step[mine])
                whole[target], chunks[target] = found[j].arcs[source], found[j].items[source]
            whole[at + step], chunks[at + step] = arc, item
            target = _runs(at + step + 1, tail)
            whole[target], chunks[target] = arcs, items
            taken.append((rows, which, step, arc))
            found.append(Paths(lattices, rows, whole, chunks, size, best, step + 1, lead + lattices.logp[arc], mix(seeds[rows] + np.uint64(turn * 13)), k))
    threshold = np.full(n, -np.inf)
    for p in found:
        np.maximum.at(threshold, p.rows, p.values[:, 0])
    return found, threshold


def decode(ids, surface: list[bytes]) -> str:
    """The text that piece ids stand for; the space that encoding puts in front goes."""
    return b"".join(map(surface.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def _same(lattices: Lattices, piece: np.ndarray, size: np.ndarray, rows: np.ndarray, raw: np.ndarray, raw_first: np.ndarray, raw_size: np.ndarray) -> np.ndarray:
    """Whether the pieces of each row give back its bytes."""
    width = lattices.width[piece]
    long = _summed(width, size).astype(np.int64)
    ok = long == raw_size[rows]
    if not ok.all():  # compare what is as long as its text
        kept = np.repeat(ok, size)
        piece, width = piece[kept], width[kept]
    got = lattices.flat[_runs(lattices.start[piece], width)]
    wrong = got != (raw if len(got) == len(raw) else raw[_runs(raw_first[rows[ok]], raw_size[rows[ok]])])
    ok[ok] = _summed(wrong, long[ok]) == 0
    return ok


_state: dict[tuple[str, float], Lattices] = {}


def _encode(vocabulary, name: str, k: int, theta: float, seed: int):
    """``name`` is a digest of the vocabulary: Python workers outlive a job and may meet another model next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (name, theta) not in _state:
            _state.clear()  # one at a time
            _state[name, theta] = Lattices(vocabulary.value, theta)
        lattices = _state[name, theta]
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").fill_null("").to_pylist()
            key = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            copy = b.column("copy").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                all_seeds = mix(mix(key + np.uint64(seed)) ^ np.uint64(_G))
                all_seeds[null] = mix(np.full(int(null.sum()), _NO_ID + seed, np.uint64))
                all_seeds = np.where(copy > 0, mix(all_seeds + copy * np.uint64(0xD6E8FEB86659FD93)), all_seeds)
            ends = np.cumsum([len(t) for t in texts])
            n_bytes = pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE_CHARS, "right")))
                part, own = texts[at:end], ids.slice(at, end - at)
                found, threshold = _segmentations(lattices, part, all_seeds[at:end], k)
                raw = np.frombuffer("".join([" " + t for t in part if t]).encode("utf-8", "surrogatepass"), np.uint8)
                raw_size = n_bytes[at:end] + (n_bytes[at:end] > 0)
                raw_first = np.cumsum(raw_size) - raw_size
                for n, p in enumerate(found):
                    over = p.log_prob - threshold[p.rows]
                    inclusion = np.where(np.isinf(over), 1.0, -np.expm1(-np.exp(np.minimum(over, 700.0))))
                    with np.errstate(divide="ignore"):
                        log_inclusion = np.where(over < -30, over, np.log(inclusion))
                    piece = lattices.piece[p.arcs]
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p.size)]).astype(np.int32)), pa.array(piece))
                    cols = [own.take(pa.array(p.rows)), pa.array(np.full(len(p.rows), n + 1, np.int32)), lists, pa.array(p.size.astype(np.int32)), *(pa.array(x) for x in (p.log_prob, p.top, inclusion, log_inclusion))]
                    cols.append(pa.array(_same(lattices, piece, p.size, p.rows, raw, raw_first, raw_size)))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "inclusion", "log_inclusion", "round_trip"])
                at = end

    return run


def encode(docs: DataFrame, model: str = MODEL, k: int = K, theta: float = THETA, seed: int = SEED, copies: bool = False) -> DataFrame:
    """Up to ``k`` rows per document: piece ids, log-probability, perturbed value, inclusion score, round trip; ``sample`` 1 is the best.

    With ``copies``, rows that repeat a doc_id and text are numbered, and each number has samples of its own; without,
    they get the same samples.
    """
    pieces = load(model)
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)  # as many pieces as the model has
    name = hashlib.sha256(pickle.dumps(pieces)).hexdigest()
    number = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))) - 1 if copies else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", number.cast("long").alias("copy"))
    return rows.mapInArrow(_encode(vocabulary, name, k, theta, seed), _OUT)


def decoded(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with the text that its ids stand for."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(surfaces(load(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(x, vocabulary.value) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return encoded.mapInArrow(run, _OUT + ", text string")
