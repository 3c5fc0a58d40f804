"""Tokenizing many texts by a public tokenizer whose pre-tokenizer never crosses white space.

Each distinct run of non-space characters is encoded once for a batch (and kept for the next
ones); a text's ids are its runs' ids in order.
"""

from __future__ import annotations

import os

import numpy as np

from .textkernel import Buffer, span_hashes

#: Runs kept between batches, in each Python worker.
KEPT = 1_000_000
#: Set between runs that are encoded together; runs that hold it are encoded alone.
_MARK = 1
_SPACE = np.isin(np.arange(256), [32, 9, 10, 13])
_held: dict[str, "WordTokenizer"] = {}


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` from ``first`` of ``size``, one after the other."""
    return flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        mark = self._plain(chr(_MARK))
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self._forget()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The worker's own copy, loaded once."""
        if path not in _held:
            _held[path] = cls(path)
        return _held[path]

    def _forget(self) -> None:
        self.hashes, self.first, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _together(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids and each run's number of them, if the marks between the runs can be told."""
        if self.mark is None or not runs:
            return None
        ids = self._plain((b" %c " % _MARK).join(runs).decode("utf-8", "replace"))
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(runs) - 1:
            return None
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def _learn(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        if len(self.hashes) + len(hashes) > KEPT:
            self._forget()
        flats, sizes = [self.flat], []
        for a in range(0, len(runs), 20_000):
            some = runs[a : a + 20_000]
            made = self._together(some)
            if made is None:  # a run holds the mark or what becomes its id
                each = [self._plain(w.decode("utf-8", "replace")) for w in some]
                made = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            flats.append(made[0])
            sizes.append(made[1])
        size = np.concatenate(sizes)
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate(flats)
        hashes, first, size = np.concatenate([self.hashes, hashes]), np.concatenate([self.first, first]), np.concatenate([self.size, size])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first, self.size = hashes[order], first[order], size[order]

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes

    def encode(self, buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts as one array, and each text's offsets in it."""
        starts, ends = buffer.runs(~_SPACE[buffer.data])
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(buffer.n + 1, np.int64)
        hashes, at, of = np.unique(span_hashes(buffer.prefix(), starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(hashes))
        if len(new) and len(self.hashes) + len(new) > KEPT:
            self._forget()
            new = np.arange(len(hashes))
        if len(new):
            text = buffer.data.tobytes()
            self._learn(hashes[new], [text[a:b] for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, hashes)[of]
        length = self.size[place]
        total = np.concatenate([[0], np.cumsum(length)])
        return _gather(self.flat, self.first[place], length), total[buffer.split(starts)]
