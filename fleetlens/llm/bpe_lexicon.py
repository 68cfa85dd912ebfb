"""Minimal acyclic transducer from frequent words to their token ids.

Words are bytes. The automaton shares prefixes and suffixes: it is built from
the sorted words, and a state whose future equals that of an earlier state is
replaced by it. Each arc carries a number, the count of words accepted before
it from its state; the numbers along a word's path add up to the word's index,
and a table gives the ids at that index.

The compiled form is one flat byte string: arcs sorted by (state, byte), so a
reader maps it from a file and finds the arcs of many words at once by binary
search. Its size is bounded by the number and length of the words.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterable, Sequence

import numpy as np

_MAGIC = 0x4C45584943


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """Automaton and id table of the given (word, ids), as bytes. Repeated words count once."""
    entries = sorted(dict(entries).items())
    # A state is [is final, {byte: state}]; `path` is the unfinished last word.
    register: dict[tuple, list] = {}
    path: list[list] = [[False, {}]]

    def settle(depth: int, word: bytes) -> None:
        """Replace the finished states below `depth` on the last word's path by registered ones."""
        while len(path) > depth + 1:
            state, parent = path.pop(), path[-1]
            key = (state[0], tuple((b, id(s)) for b, s in state[1].items()))
            parent[1][word[len(path) - 1]] = register.setdefault(key, state)

    last = b""
    for word, _ in entries:
        common = len(os.path.commonprefix([last, word]))
        settle(common, last)
        for b in word[common:]:
            path[-1][1][b] = state = [False, {}]
            path.append(state)
        path[-1][0] = True
        last = word
    settle(0, last)

    number: dict[int, int] = {id(path[0]): 0}
    order, at = [path[0]], 0
    while at < len(order):
        for s in order[at][1].values():
            if id(s) not in number:
                number[id(s)] = len(order)
                order.append(s)
        at += 1
    words_from: dict[int, int] = {}

    def count(root: list) -> None:
        stack = [root]
        while stack:
            state = stack[-1]
            todo = [s for s in state[1].values() if id(s) not in words_from]
            if todo:
                stack.extend(todo)
            else:
                words_from[id(state)] = state[0] + sum(words_from[id(s)] for s in state[1].values())
                stack.pop()

    count(path[0])
    keys, targets, outputs = [], [], []
    for n, state in enumerate(order):
        before = int(state[0])
        for b, s in sorted(state[1].items()):
            keys.append(n << 8 | b)
            targets.append(number[id(s)])
            outputs.append(before)
            before += words_from[id(s)]
    ids = [i for _, word_ids in entries for i in word_ids]
    offsets = np.cumsum([0, *(len(word_ids) for _, word_ids in entries)])
    head = np.array([_MAGIC, len(order), len(keys), len(entries), len(ids)], dtype="<i8")
    parts = [
        head,
        np.array(keys, dtype="<i8"),
        np.array(targets, dtype="<i4"),
        np.array(outputs, dtype="<i4"),
        offsets.astype("<i4"),
        np.array(ids, dtype="<u4"),
        np.array([s[0] for s in order], dtype="u1"),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Reader over the compiled bytes (or a memory map of them)."""

    def __init__(self, data):
        magic, self.states, arcs, self.size, n_ids = np.frombuffer(data, "<i8", 5).tolist()
        if magic != _MAGIC:
            raise ValueError("not a compiled lexicon")
        at = 40
        arrays = []
        for kind, n in (("<i8", arcs), ("<i4", arcs), ("<i4", arcs), ("<i4", self.size + 1), ("<u4", n_ids), ("u1", self.states)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        self._keys, self._targets, self._outputs, self._offsets, self._ids, self._final = arrays

    def index(self, words: Sequence[bytes]) -> np.ndarray:
        """Index of each word, -1 for words that are not in the lexicon."""
        n = len(words)
        out = np.zeros(n, dtype=np.int64)
        if not n or not len(self._keys):
            final_root = bool(len(self._final)) and bool(self._final[0])
            return np.array([0 if not w and final_root else -1 for w in words], dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.zeros(n, dtype=np.int64)
        walking = np.flatnonzero(lengths > 0)
        step = 0
        while len(walking):
            key = state[walking] << 8 | flat[starts[walking] + step]
            arc = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            found = self._keys[arc] == key
            out[walking[~found]] = -1
            walking, arc = walking[found], arc[found]
            state[walking] = self._targets[arc]
            out[walking] += self._outputs[arc]
            step += 1
            walking = walking[lengths[walking] > step]
        known = out >= 0
        out[known & (self._final[state] == 0)] = -1
        return out

    def ids_bytes(self, index: int) -> bytes:
        """Ids of the word at `index`, little-endian unsigned 32-bit."""
        return self._ids[self._offsets[index] : self._offsets[index + 1]].tobytes()


def mapped(data: bytes) -> Lexicon:
    """A lexicon over a memory map of `data`.

    The pages are the file's and not the process's. The file is unlinked once
    it is mapped, so nothing stays on the executor's disk.
    """
    with tempfile.TemporaryFile(prefix="lexicon-") as f:
        f.write(data)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
