"""A minimal acyclic transducer from words to token ids, walked for many words at once.

Words are UTF-8 byte strings. The automaton is built from sorted words by merging equal suffix states as they close
(the incremental construction of minimal acyclic automata). Each state knows how many words end at or below it, so the
walk that accepts a word also sums up the word's rank in sorted order; the rank points to the word's ids in one flat
array. All tables are flat arrays that can be memory-mapped and shared by the workers of a machine.
"""

from __future__ import annotations

import json
import os

import numpy as np


class Transducer:
    """``keys``: sorted state*256+byte of every arc; ``to``/``skip``: target and words passed over; ``final`` by state;
    ``offsets``/``ids``: the id outputs by rank of the word."""

    NAMES = ("keys", "to", "skip", "final", "offsets", "ids")

    def __init__(self, **tables: np.ndarray):
        for n in self.NAMES:
            setattr(self, n, tables[n])

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Transducer:
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # open states: [final, arcs]; an arc is (byte, closed state)
        pending: list[int] = []  # bytes that lead from one open state to the next

        def close() -> None:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((pending.pop(), register[key]))

        last = b""
        for w in words:
            common = os.path.commonprefix([last, w])
            while len(pending) > len(common):
                close()
            for byte in w[len(common) :]:
                pending.append(byte)
                path.append([False, []])
            path[-1][0] = True
            last = w
        while pending:
            close()
        states.append((path[0][0], tuple(path[0][1])))  # the root closes last
        root = len(states) - 1
        count = np.zeros(len(states), np.int64)
        keys, to, skip = [], [], []
        for i, (final, arcs) in enumerate(states):  # targets close before their sources
            passed = int(final)
            for byte, t in arcs:
                keys.append((root - i) * 256 + byte)  # numbered so that the root is 0
                to.append(root - t)
                skip.append(passed)
                passed += int(count[t])
            count[i] = passed
        order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        outs = [entries[w] for w in words]
        return cls(
            keys=np.array(keys, np.int64)[order],
            to=np.array(to, np.int64)[order],
            skip=np.array(skip, np.int64)[order],
            final=np.array([f for f, _ in reversed(states)], bool),
            offsets=np.concatenate([[0], np.cumsum([len(o) for o in outs], dtype=np.int64)]).astype(np.int64),
            ids=np.array([x for o in outs for x in o], np.int32),
        )

    def to_bytes(self) -> bytes:
        """All tables as one file, each array at a multiple of 8 bytes, so that it can be memory-mapped."""
        head = {n: (getattr(self, n).dtype.str, len(getattr(self, n))) for n in self.NAMES}
        text = json.dumps(head).encode()
        parts = [len(text).to_bytes(8, "little"), text.ljust(-(-len(text) // 8) * 8)]
        parts.extend(a.tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0") for a in (np.asarray(getattr(self, n)) for n in self.NAMES))
        return b"".join(parts)

    @classmethod
    def map(cls, path: str) -> Transducer:
        """The tables of a file of ``to_bytes``, memory-mapped."""
        raw = np.memmap(path, np.uint8, mode="r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        at = 8 + -(-size // 8) * 8
        tables = {}
        for n, (kind, length) in json.loads(raw[8 : 8 + size].tobytes()).items():
            width = np.dtype(kind).itemsize * length
            tables[n] = raw[at : at + width].view(kind)
            at += -(-width // 8) * 8
        return cls(**tables)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, -1 for words not in the lexicon. One pass a byte position over all words still alive."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, rank = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(lengths > 0)
        at = 0
        while len(alive):
            key = state[alive] * 256 + flat[starts[alive] + at]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[pos] == key
            alive, pos = alive[hit], pos[hit]
            state[alive] = self.to[pos]
            rank[alive] += self.skip[pos]
            at += 1
            over = lengths[alive] == at
            done = alive[over]
            good = done[self.final[state[done]]]
            out[good] = rank[good]
            alive = alive[~over]
        return out
