"""Words of many texts as Arrow arrays, without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Words:
    """The maximal stretches of marked bytes of the texts that ``offsets``
    cut ``data`` into; no word goes from one text into the next."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marked: np.ndarray):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = marked[:-1]
        after = np.zeros(n, bool)
        after[:-1] = marked[1:]
        self.starts = np.flatnonzero(marked & (~before | edge[:n]))
        ends = np.flatnonzero(marked & (~after | edge[1:])) + 1
        self.sizes = ends - self.starts
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the end
        self.bytes = np.ascontiguousarray(data[marked])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])

    def __len__(self) -> int:
        return len(self.sizes)

    def arrow(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.at.astype(np.int64)),
                                                                    pa.py_buffer(self.bytes)])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, equal words alike, and the words by number."""
        if not len(self):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        got = self.arrow().dictionary_encode()
        return np.asarray(got.indices).astype(np.int64), got.dictionary

    def joined(self) -> tuple[bytes, np.ndarray]:
        """Every word with one blank behind it, and where each begins."""
        out = np.full(len(self.bytes) + len(self), 32, np.uint8)
        out[np.arange(len(self.bytes)) + np.repeat(np.arange(len(self)), self.sizes)] = self.bytes
        return out.tobytes(), self.at + np.arange(len(self) + 1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... for sizes[0] numbers, then the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
