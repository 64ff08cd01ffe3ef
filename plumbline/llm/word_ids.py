"""Token ids of texts whose words are encoded one by one, each distinct word once while it is remembered."""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


_caches: weakref.WeakSet[WordCache] = weakref.WeakSet()


class WordCache:
    """Words met last and their ids as little-endian 32-bit bytes.

    `learn` encodes distinct words. A batch looks up its distinct words alone; the
    ids are then gathered by number. Beyond `limit` words the memory starts anew.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int) -> None:
        self.learn, self.limit = learn, limit
        self.words: dict[str, bytes] = {}
        _caches.add(self)

    def ids(self, words: pa.Array, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins and the last ends. words: of all
        texts in a row, `per_text` of them in each.
        """
        coded = words.dictionary_encode()
        # to_pylist makes a scalar of every word first, which took half the time of a batch
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.words) > self.limit:
            self.words.clear()
        raw = list(map(self.words.get, distinct))
        if new := [w for w, ids in zip(distinct, raw, strict=True) if ids is None]:
            self.words.update(zip(new, self.learn(new), strict=True))
            raw = list(map(self.words.get, distinct))
        flat = np.frombuffer(b"".join(raw), np.uint32)
        lens = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        starts = np.cumsum(lens) - lens
        each = lens[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(per_text)])]


def text_slices(texts: pa.StringArray, most: int) -> Iterator[tuple[int, pa.StringArray]]:
    """Slices of about `most` bytes and the number of their first text; a longer text is a slice of its own, whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    since, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield since, texts.slice(since, i - since)
            since, held = i, 0
        held += size
    if len(sizes) > since:
        yield since, texts.slice(since)


def release_memory(keep: WordCache | None = None) -> None:
    """Forget the words of other operators and give back what Arrow and the C heap hold for later: Python workers outlive their tasks."""
    for cache in list(_caches):
        if cache is not keep:
            cache.words.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc alone has it
        trim(0)
