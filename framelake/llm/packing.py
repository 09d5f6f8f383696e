"""Packed batches: tokens of many documents as number arrays, shuffled as a few large rows instead of one row a token."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

#: Characters and documents of a batch at most (a longer document is a batch of its own).
BATCH_CHARS, BATCH_DOCS = 2_000_000, 60_000


@dataclass
class Batch:
    """Words of the batch's documents in a row: `codes` number them in `words`, document i has codes[starts[i]:starts[i+1]]."""

    number: int
    keys: list
    words: list[bytes]
    codes: np.ndarray
    starts: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), dtype=np.uint64, count=len(self.words))

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.keys)), np.diff(self.starts))


def batches(frames: Iterator[pa.RecordBatch], key: str, text: str, end: bytes | None = None) -> Iterator[Batch]:
    """Documents of one task, which come as Arrow batches, in packed batches; keys stay as they are. Words are runs without ASCII white space, with A-Z lower-cased; a text that is
    null has none. `end` is a word put after each document. Batch numbers hold the partition, so they are unique, and
    the same whenever a task reads the same rows again."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    keys: list = []
    found: list[bytes] = []
    starts, size = [0], 0

    def close() -> Batch:
        words = list(dict.fromkeys(found))
        index = {w: i for i, w in enumerate(words)}
        codes = np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found))
        return Batch(number, keys, words, codes, np.array(starts, dtype=np.int64))

    for frame in frames:
        for k, t in ((k, t) for at in range(0, frame.num_rows, 250) for k, t in zip(
                frame.column(key).slice(at, 250).to_pylist(), frame.column(text).slice(at, 250).to_pylist(), strict=True)):
            if t:
                found += t.encode("utf-8", "surrogatepass").lower().split()
                size += len(t)
            if end is not None:
                found.append(end)
            keys.append(k)
            starts.append(len(found))
            if size >= BATCH_CHARS or len(keys) >= BATCH_DOCS:
                yield close()
                number, keys, found, starts, size = number + 1, [], [], [0], 0
    if keys:
        yield close()


def by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket that occurs; the top `bits` bits of a hash are its bucket. Positions stay in
    order."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(hashes), np.uint16)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            yield int(bucket[part[0]]), part


def steps(docs: np.ndarray) -> bytes:
    """Ascending document numbers of a batch as the steps between them, low bytes before high ones: mostly zeros, which
    the shuffle compresses."""
    return np.diff(docs, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def unroll(packed: bytes) -> np.ndarray:
    """The document numbers that `steps` packed."""
    low, high = np.frombuffer(packed, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(low + (high << 8))
