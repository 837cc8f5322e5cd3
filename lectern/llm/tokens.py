"""Token ids of whole texts by the tokenizers library, with each distinct piece of text encoded once per worker.

A piece is a word, or a word with the white space before it, cut only where the tokenizer never
joins the two sides: its ids don't depend on what stands around it, so the ids of a text are those
of its pieces one after another.  A worker keeps the ids of pieces that it has met, up to `most`.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

from .vec import SPACE, U64, prefix, spans, take_ranges, words, BYTE_VALUES

_encoders: dict[tuple, "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, keep_space: bool) -> "PieceEncoder":
    """The worker's encoder of a tokenizer file. keep_space: white space has ids of its own."""
    if (path, keep_space) not in _encoders:
        _encoders[path, keep_space] = PieceEncoder(path, keep_space)
    return _encoders[path, keep_space]


#: Bytes from which a worker's arrays are mapped one by one, and so go back to the system as soon as they are freed.
MAPPED_BYTES = 16 << 20
#: Bytes of a batch that a worker sends back.
MOST_SENT = 4 << 20
_settled = False


def trim() -> None:
    """Gives this worker's free memory back to the system."""
    global _settled
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        libc = ctypes.CDLL(None)
        if not _settled:
            libc.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD; unset, it grows with the largest array that was freed
            pa.set_memory_pool(pa.system_memory_pool())
        _settled = True
        libc.malloc_trim(0)


def forget() -> None:
    """Drops what this worker keeps of tokenizers as well."""
    _encoders.clear()
    trim()


def _until_done(out):
    try:
        yield from out
    finally:
        trim()


def lean(run):
    """A function of Arrow batches, or of one or two tables of a group, whose worker holds nothing that earlier tasks left, and leaves nothing.

    Workers outlive tasks and wait for others, so an executor has more of them than cores.
    """

    def done(out):
        if hasattr(out, "__next__"):
            return _until_done(out)
        if out.nbytes > MOST_SENT:  # as several batches: the JVM reads each into a buffer of its size
            out = pa.Table.from_batches(out.to_batches(max(1, out.num_rows * MOST_SENT // out.nbytes)), out.schema)
        trim()
        return out

    def one(a):
        forget()
        return done(run(a))

    def two(a, b):
        forget()
        return done(run(a, b))

    return two if run.__code__.co_argcount == 2 else one


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts before each run of ASCII white space that follows other text; starts, ends, first piece of each document."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    white = SPACE[data]
    cut = np.zeros(n, bool)
    before = data[:-1]
    plain = before > 0x20
    # the last byte of a white-space character beyond ASCII: no cut within a run of white space
    wide = np.zeros(n - 1, bool)
    if n > 2:
        wide[1:] |= (data[:-2] == 0xC2) & ((before[1:] == 0x85) | (before[1:] == 0xA0))
    if n > 3:
        wide[2:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (data[1:-2] >= 0x80) & (before[2:] >= 0x80)
    cut[1:] = white[1:] & plain & ~wide
    cut[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, off)


class PieceEncoder:
    """Ids of the pieces met so far in an open-addressing table of numpy arrays."""

    def __init__(self, path: str, keep_space: bool, most: int = 1_900_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.most = Tokenizer.from_file(path), pieces if keep_space else words, most
        self.reset()

    def reset(self) -> None:
        self.size = 1 << 16
        self.keys, self.slot = np.zeros(self.size, U64), np.zeros(self.size, np.int32)
        self.known, self.n_ids = 0, 0
        self.at, self.count, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's piece, -1 if it isn't known."""
        out, todo, place = np.full(len(h), -1, np.int32), np.arange(len(h)), (h & U64(self.size - 1)).astype(np.int64)
        while len(todo):
            key = self.keys[place]
            hit = key == h[todo]
            out[todo[hit]] = self.slot[place[hit]]
            on = ~hit & (key != 0)
            todo, place = todo[on], (place[on] + 1) & (self.size - 1)
        return out

    def put(self, h: np.ndarray, number: np.ndarray) -> None:
        place = (h & U64(self.size - 1)).astype(np.int64)
        while len(h):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[free]
            mine = free & (self.keys[place] == h)
            self.slot[place[mine]] = number[mine]
            h, number, place = h[~mine], number[~mine], (place[~mine] + 1) & (self.size - 1)

    def learn(self, h: np.ndarray, texts: list[str]) -> None:
        if self.known + len(h) > self.most and self.known:
            raise MemoryError
        counts, ids = [], []
        for i in range(0, len(texts), 2000):  # the library's own results take some 300 bytes a token: a few at a time
            group = texts[i : i + 2000]
            e = self.tokenizer.encode_batch([group], add_special_tokens=False, is_pretokenized=True)[0]
            ids.append(np.array(e.ids, np.int32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        n, m = self.known + len(h), self.n_ids + len(ids)
        while len(self.at) < n:
            self.at, self.count = np.append(self.at, np.zeros_like(self.at)), np.append(self.count, np.zeros_like(self.count))
        while len(self.ids) < m:
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.at[self.known : n], self.count[self.known : n] = self.n_ids + np.cumsum(counts) - counts, counts
        self.ids[self.n_ids : m] = ids
        if 2 * n > self.size:
            keys, slots = self.keys[self.keys != 0], self.slot[self.keys != 0]
            while 2 * n > self.size:
                self.size *= 2
            self.keys, self.slot = np.zeros(self.size, U64), np.zeros(self.size, np.int32)
            self.put(keys, slots)
        self.put(h, np.arange(self.known, n, dtype=np.int32))
        self.known, self.n_ids = n, m

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and where each document's begin (n + 1 places)."""
        starts, ends, first = self.cut(data, off)
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        h = np.maximum(spans(prefix(BYTE_VALUES[data], "byte"), starts, ends, "byte"), U64(1))
        number = self.find(h)
        if len(miss := np.flatnonzero(number < 0)):
            new, where = np.unique(h[miss], return_index=True)
            raw, at = data.tobytes(), miss[where]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            try:
                self.learn(new, texts)
            except MemoryError:
                self.reset()
                new, where = np.unique(h, return_index=True)
                self.learn(new, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist())])
                miss = np.arange(len(h))
            number[miss] = self.find(h[miss])
        count = self.count[number].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[take_ranges(self.at[number], count)], total[first]
