"""A minimal acyclic transducer over frequent words, kept as one flat byte string.

Words enter in byte order; equal suffixes share states (incremental
minimisation over a register of finished states). Every arc carries the number
of words that leave its source state before it, so the outputs along a word's
path sum to the word's place in byte order, which addresses its ids.

The arcs lie in an open-addressing table keyed by (state, byte), so a batch of
words walks the automaton together, one byte position at a time. The byte
string is memory-mapped by each worker.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa

from .words import raw

_MAGIC = b"MAST0001"
_OPEN: dict[str, "Lexicon"] = {}


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs and finality of the minimal acyclic automaton of sorted distinct words; state 0 is its root."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], *arcs[state].items())
            same = register.setdefault(key, state)
            if same != state:
                arcs[path[-1]][last[len(path) - 1]] = same

    for word in words:
        shared = os.path.commonprefix([word, last])
        settle(len(shared))
        for byte in word[len(shared) :]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    settle(0)
    return arcs, final


def build(entries: dict[bytes, list[int]]) -> bytes:
    """The byte string of a lexicon; ids are below 65,536 and no word is empty."""
    words = sorted(entries)
    arcs, final = _minimal(words)
    order, place = [0], {0: 0}
    for state in order:  # the reachable states, each once
        for to in arcs[state].values():
            if to not in place:
                place[to] = len(order)
                order.append(to)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        stack = [state]
        while stack:
            top = stack[-1]
            todo = [t for t in arcs[top].values() if t not in below]
            if top in below or not todo:
                below[stack.pop()] = final[top] + sum(below[t] for t in arcs[top].values())
            else:
                stack += todo
        return below[state]

    count(0)
    keys, nexts, outs = [], [], []
    for state in order:
        before = int(final[state])
        for byte in sorted(arcs[state]):
            to = arcs[state][byte]
            keys.append(place[state] << 8 | byte)
            nexts.append(place[to])
            outs.append(before)
            before += below[to]
    bits = max(4, (2 * max(1, len(keys)) - 1).bit_length())
    table = np.full((3, 1 << bits), -1, np.int32)
    for key, to, out in zip(keys, nexts, outs):
        slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)
        while table[0, slot] >= 0:
            slot = (slot + 1) & ((1 << bits) - 1)
        table[:, slot] = key, to, out
    ends = np.array([final[s] for s in order], np.uint8)
    at = np.zeros(len(words) + 1, np.int32)
    np.cumsum([len(entries[w]) for w in words], out=at[1:])
    ids = np.array([i for w in words for i in entries[w]], np.uint16)
    head = np.array([bits, len(ends), len(words), len(ids)], np.int64)
    return _MAGIC + head.tobytes() + table.tobytes() + at.tobytes() + ids.tobytes() + ends.tobytes()


class Lexicon:
    """Reads a lexicon from a buffer; ``find`` gives each word's place or -1."""

    def __init__(self, buffer) -> None:
        view = np.frombuffer(buffer, np.uint8)
        if view[:8].tobytes() != _MAGIC:
            raise ValueError("not a lexicon")
        self.bits, states, self.size, n_ids = (int(x) for x in view[8:40].view(np.int64))
        at = 40
        width = 12 << self.bits
        self.table = view[at : at + width].view(np.int32).reshape(3, -1)
        at += width
        self.offsets = view[at : at + 4 * (self.size + 1)].view(np.int32)
        at += 4 * (self.size + 1)
        self.ids = view[at : at + 2 * n_ids].view(np.uint16)
        self.final = view[at + 2 * n_ids : at + 2 * n_ids + states]

    def find(self, words: pa.Array) -> np.ndarray:
        data, at = raw(words)
        lengths = np.diff(at)
        found = np.full(len(lengths), -1, np.int64)
        rows = np.flatnonzero(lengths > 0)
        state, out = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        mask = (1 << self.bits) - 1
        depth = 0
        while len(rows):
            key = state << 8 | data[at[rows] + depth]
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - self.bits)
            seen = self.table[0][slot]
            wrong = np.flatnonzero((seen != key) & (seen >= 0))
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & mask
                seen[wrong] = self.table[0][slot[wrong]]
                wrong = wrong[(seen[wrong] != key[wrong]) & (seen[wrong] >= 0)]
            here = seen >= 0
            rows, slot = rows[here], slot[here]
            state = self.table[1][slot].astype(np.int64)
            out = out[here] + self.table[2][slot]
            depth += 1
            ended = lengths[rows] == depth
            if ended.any():
                ok = ended & (self.final[state] > 0)
                found[rows[ok]] = out[ok]
                rows, state, out = rows[~ended], state[~ended], out[~ended]
        return found


def mapped(content: bytes) -> Lexicon:
    """The lexicon, memory-mapped once a worker; the file has no name any more, so it goes with the worker."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _OPEN:
        handle, path = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(handle, "wb") as out:
            out.write(content)
        _OPEN.clear()
        _OPEN[name] = Lexicon(np.memmap(path, np.uint8, "r"))
        os.unlink(path)
    return _OPEN[name]
