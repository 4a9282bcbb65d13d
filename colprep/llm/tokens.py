"""Token ids of whole texts by the tokenizers library, with a memory of word units.

The tokenizer cuts texts at white space and between letters and punctuation and encodes every piece alone,
so a unit between two such places always gets the same ids. Units are hashed in bulk; the library encodes
each new one once per worker. Units that hold anything but letters or plain punctuation are encoded as a whole.
"""

from __future__ import annotations

import os

import numpy as np

from colprep.llm.common import LETTER, OTHER, PUNCT, SPACE, classes, lower_bytes, span_hashes

VOCABULARY = "word_bpe_49k.json"
MEMORY = 1_500_000  # units kept per worker; beyond that the memory starts anew


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Encodes texts given as bytes and row offsets."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = memory
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)
        self.slots = np.full(1 << 16, -1, np.int32)
        self.count = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 20, np.uint16)
        self.used = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them)."""
        starts, ends, kinds = self._units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lowered = lower_bytes(data)
        hashes = span_hashes(lowered, starts, ends)
        index = self._find(hashes)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            _, first = np.unique(hashes[missing], return_index=True)
            new = missing[first]
            if self.count + len(new) > self.memory:
                self._reset()
                _, new = np.unique(hashes, return_index=True)
            self._learn(lowered, starts[new], ends[new], kinds[new], hashes[new])
            index = self._find(hashes)
        lengths = self.lengths[index].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        places = np.arange(total[-1]) + np.repeat(self.starts[index] - total[:-1], lengths)
        return self.pool[places].astype(np.uint32), total[np.searchsorted(starts, offsets)]

    def _units(self, data, offsets):
        kind = classes(data)
        edge = np.ones(len(data) + 1, bool)
        if len(data):
            a, b = kind[:-1], kind[1:]
            edge[1:-1] = (a != b) & ((a == SPACE) | (b == SPACE) | ((a == LETTER) & (b == PUNCT)) | ((a == PUNCT) & (b == LETTER)))
        edge[offsets] = True
        for special in self.specials:  # units must not cut through a special token
            text = data.tobytes()
            at = text.find(special)
            while at >= 0:
                low = max((int(x) for x in np.flatnonzero(kind[max(0, at - 256) : at] == SPACE)), default=-1)
                edge[at + 1 : at + len(special)] = False
                kind[at : at + len(special)] = OTHER
                edge[at] = edge[at] or low >= 0 and kind[at - 1] == SPACE
                at = text.find(special, at + 1)
        cuts = np.flatnonzero(edge)
        starts, ends = cuts[:-1], cuts[1:]
        solid = kind[starts] != SPACE
        starts, ends = starts[solid], ends[solid]
        # the kind of a unit: that of all its bytes, or OTHER
        other = np.concatenate([[0], np.cumsum(kind == OTHER)])
        kinds = np.where(other[ends] > other[starts], OTHER, kind[starts])
        return starts, ends, kinds

    def _find(self, hashes):
        mask = np.uint64(len(self.keys) - 1)
        at = (hashes & mask).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        open_ = np.arange(len(hashes))
        while len(open_):
            slot = self.slots[at[open_]]
            same = (self.keys[at[open_]] == hashes[open_]) & (slot >= 0)
            out[open_[same]] = slot[same]
            open_ = open_[~same & (slot >= 0)]
            at[open_] = (at[open_] + 1) & int(mask)
        return out

    def _put(self, hashes, index):
        mask = len(self.keys) - 1
        at = (hashes & np.uint64(mask)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            free = self.slots[at[open_]] < 0
            self.slots[at[open_[free]]] = index[open_[free]]
            placed = self.slots[at[open_]] == index[open_]
            done = open_[placed]
            self.keys[at[done]] = hashes[done]
            open_ = open_[~placed]
            at[open_] = (at[open_] + 1) & mask

    def _learn(self, data, starts, ends, kinds, hashes):
        n = len(starts)
        ids: list[np.ndarray] = [None] * n
        raw = data.tobytes()
        units = [raw[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        plain = np.flatnonzero(kinds != OTHER)
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            got = np.array(self.tokenizer.encode(" ".join([units[i] for i in part]), add_special_tokens=False).ids, np.uint16)
            cut = np.flatnonzero(self.is_end[got]) + 1
            if len(cut) != len(part):
                raise ValueError("the tokenizer does not encode words alone")
            for i, a, b in zip(part.tolist(), [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                ids[i] = got[a:b]
        rest = np.flatnonzero(kinds == OTHER).tolist()
        for k in range(0, len(rest), 2000):
            part = rest[k : k + 2000]
            for i, e in zip(part, self.tokenizer.encode_batch([units[i] for i in part], add_special_tokens=False), strict=True):
                ids[i] = np.array(e.ids, np.uint16)
        lengths = np.array([len(x) for x in ids], np.int32)
        flat = np.concatenate(ids) if n else np.zeros(0, np.uint16)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.count + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.count : self.count + n] = lengths
        if (self.count + n) * 2 > len(self.keys):
            filled = self.slots >= 0
            old_keys, old_slots = self.keys[filled], self.slots[filled]
            size = len(self.keys)
            while (self.count + n) * 2 > size:
                size *= 2
            self.keys, self.slots = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._put(old_keys, old_slots)
        self._put(hashes, np.arange(self.count, self.count + n, dtype=np.int32))
        self.count += n
        self.used += len(flat)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder; workers are reused, so the vocabulary is loaded once in each."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
