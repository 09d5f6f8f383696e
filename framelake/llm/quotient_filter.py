"""Counting quotient filters of keys of up to 64 bits: sorted, compact and lossless.

A key of `width` bits is permuted invertibly; its top bits, the quotient, name a slot, and the slot's run holds the rest, the full remainder,
with a counter. As nothing of a key is lost, the filter counts exactly, merges as sorted lists do, and gives its keys back.
"""

from __future__ import annotations

import numpy as np

#: Odd numbers below 2**64 that keys are multiplied by.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Quotient bits at least.
LEAST_BITS = 16


def _mask(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def permute(keys: np.ndarray, width: int = 64) -> np.ndarray:
    """A fixed permutation of the numbers below 2**width that deals similar keys out evenly."""
    half = np.uint64((width + 1) // 2)
    x = keys ^ (keys >> half)
    for factor in FACTORS:
        x = (x * np.uint64(factor)) & _mask(width)
        x ^= x >> half
    return x


def restore(permuted: np.ndarray, width: int = 64) -> np.ndarray:
    """The keys that `permute` made `permuted` of."""
    half = np.uint64((width + 1) // 2)
    x = permuted ^ (permuted >> half)
    for factor in reversed(FACTORS):
        x = (x * np.uint64(pow(factor, -1, 2**64))) & _mask(width)
        x ^= x >> half
    return x


def quotient_bits(ranges: int) -> int:
    """Bits of the quotient where slots are dealt out to `ranges`, a power of two."""
    return max(LEAST_BITS, ranges.bit_length() - 1)


def key_width(bits: int, ranges: int) -> int:
    """The width of keys of `bits` bits: a remainder has one byte at least."""
    return min(64, max(bits, quotient_bits(ranges) + 8))


def split(permuted: np.ndarray, counts: np.ndarray, ranges: int, width: int = 64) -> list[tuple[int, bytes]]:
    """(range, packed filter) of the sorted keys `permuted`, for each range of slots that has some."""
    bits = ranges.bit_length() - 1
    if not len(permuted):
        return []
    which = (permuted >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(permuted), np.int64)
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    ends = np.append(starts[1:], len(permuted))
    return [(int(which[a]), pack(permuted[a:b], counts[a:b], int(which[a]), ranges, width)) for a, b in zip(starts, ends, strict=True)]


def pack(permuted: np.ndarray, counts: np.ndarray, number: int, ranges: int, width: int = 64) -> bytes:
    """The filter of range `number`: the length of each slot's run, the remainders, a one-byte counter each, and the counters that one byte
    can't hold."""
    bits = quotient_bits(ranges)
    slots, size = (1 << bits) // ranges, (width - bits + 7) // 8
    slot = (permuted >> np.uint64(width - bits)).astype(np.int64) - number * slots
    runs = np.bincount(slot, minlength=slots)
    wide = 1 if runs.max(initial=0) < 256 else 4
    remainders = (permuted & _mask(width - bits)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]
    large = counts[counts >= 255].astype("<u8")
    head = np.array([len(permuted), len(large), wide], dtype="<u8")
    return b"".join([head.tobytes(), runs.astype(f"<u{wide}").tobytes(), np.ascontiguousarray(remainders.T).tobytes(),
                     np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes()])


def unpack(packed: bytes, number: int, ranges: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(sorted permuted keys, counts) of a packed filter."""
    bits = quotient_bits(ranges)
    slots, size = (1 << bits) // ranges, (width - bits + 7) // 8
    n, extra, wide = (int(x) for x in np.frombuffer(packed, "<u8", 3))
    runs = np.frombuffer(packed, f"<u{wide}", slots, 24)
    at = 24 + wide * slots
    remainders = np.zeros((n, 8), np.uint8)
    remainders[:, :size] = np.frombuffer(packed, np.uint8, size * n, at).reshape(size, n).T
    slot = np.repeat(np.arange(slots, dtype=np.uint64) + np.uint64(number * slots), runs)
    counts = np.frombuffer(packed, np.uint8, n, at + size * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed, "<u8", extra, at + (size + 1) * n).astype(np.int64)
    return (slot << np.uint64(width - bits)) | remainders.view("<u8").reshape(-1), counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, summed counts, the place among those of every key of `filters` in turn) of several (keys, counts)."""
    keys = np.concatenate([k for k, _ in filters] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([c for _, c in filters] or [np.zeros(0, np.int64)])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts, place
