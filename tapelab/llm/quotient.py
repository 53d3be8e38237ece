"""Counting quotient filters: sorted tables of permuted keys that give keys and counts back without loss.

A key is one or two 64-bit words. An invertible permutation spreads keys evenly; the top bits of the permuted key (its
quotient) are kept as bucket sizes, the others (its full remainder) in as many bytes as they need. A count of one costs one bit.
Filters of the same keys merge like sorted runs.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np

from tapelab.llm.common import GOLD, mix

Keys = tuple[np.ndarray, ...]
_U = np.uint64
_ROUNDS = tuple(_U((i * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & (2**64 - 1)) for i in range(1, 5))


def _odd_inverse(k: int) -> np.uint64:
    return _U(pow(k, -1, 1 << 64))


def _unshift(x: np.ndarray, by: int) -> np.ndarray:
    out = x
    for _ in range(64 // by):
        out = x ^ (out >> _U(by))
    return out


def permute(keys: Keys) -> Keys:
    """Spreads keys evenly; ``restore`` is its inverse."""
    if len(keys) == 1:
        return (mix(keys[0] * GOLD),)
    hi, lo = keys
    for k in _ROUNDS:
        hi, lo = lo, hi ^ mix(lo + k)
    return hi, lo


def restore(keys: Keys) -> Keys:
    if len(keys) == 1:
        x = _unshift(keys[0], 31) * _odd_inverse(0x94D049BB133111EB)
        x = _unshift(x, 27) * _odd_inverse(0xBF58476D1CE4E5B9)
        return (_unshift(x, 30) * _odd_inverse(int(GOLD)),)
    hi, lo = keys
    for k in reversed(_ROUNDS):
        hi, lo = lo ^ mix(hi + k), hi
    return hi, lo


def summed(keys: Keys, counts: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """Distinct keys in order, with the sum of their counts (of ones, if none are given)."""
    if not len(keys[0]):
        return keys, np.zeros(0, _U)
    if counts is None and len(keys) == 1:
        keys = (np.sort(keys[0]),)
    else:
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        keys = tuple(k[order] for k in keys)
        counts = counts[order] if counts is not None else None
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = functools.reduce(np.logical_or, (k[1:] != k[:-1] for k in keys))
    at = np.flatnonzero(fresh)
    total = np.diff(np.append(at, len(fresh))).astype(_U) if counts is None else np.add.reduceat(counts.astype(_U), at)
    return tuple(k[at] for k in keys), total


def top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def runs(keys: Keys, bits: int) -> Iterator[tuple[int, int, int]]:
    """Each shard (top bits) of sorted permuted keys, and where it starts and ends."""
    if len(keys[0]):
        shard = top(keys[0], bits)
        cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(shard[a]), a, b


def pack(keys: Keys, counts: np.ndarray, bits: int) -> bytes:
    """A filter of sorted permuted keys that agree in their top ``bits`` bits."""
    n = len(counts)
    own = max(1, min(24, n.bit_length(), 63 - bits))
    bucket = top(keys[0] << _U(bits), own) if n else np.zeros(0, np.int64)
    size = np.bincount(bucket, minlength=1 << own)
    size = size.astype(np.min_scalar_type(int(size.max())))
    spare = (64 - bits - own + 7) // 8
    several = counts > 1
    more = counts[several]
    more = more.astype(np.min_scalar_type(int(more.max(initial=0))))
    head = np.array([n, bits, own, int(keys[0][0] >> _U(64 - bits)) if n and bits else 0, size.itemsize, more.itemsize, len(keys)], "<i8")
    rest = [np.ascontiguousarray(keys[0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :spare]), *(k.astype("<u8") for k in keys[1:])]
    return b"".join(x.tobytes() for x in (head, size, *rest, np.packbits(several), more))


def unpack(data: bytes) -> tuple[Keys, np.ndarray]:
    n, bits, own, prefix, wide, far, k = np.frombuffer(data, "<i8", 7).tolist()
    at = 56

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    size = take(f"u{wide}", 1 << own)
    spare = (64 - bits - own + 7) // 8
    low = np.zeros((n, 8), np.uint8)
    low[:, :spare] = take("u1", n * spare).reshape(n, spare)
    free = _U(64 - bits - own)
    rest = low.view("<u8").reshape(-1) & ((_U(1) << free) - _U(1))
    quotient = np.repeat(np.arange(1 << own, dtype=_U), size.astype(np.int64))
    first = rest | (quotient << free)
    if bits:
        first |= _U(prefix) << _U(64 - bits)
    others = [take("u8", n) for _ in range(k - 1)]
    several = np.unpackbits(take("u1", (n + 7) // 8), count=n).astype(bool)
    counts = np.ones(n, _U)
    counts[several] = take(f"u{far}", int(several.sum()))
    return (first, *others), counts


def store(folder: str, name: str, values: np.ndarray) -> None:
    """Writes an array under its final name at once, so a task that is run again does no harm."""
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(aside)
    os.replace(aside, f"{folder}/{name}")


def store_filter(folder: str, file: int, keys: Keys, values: dict[str, np.ndarray], bits: int) -> None:
    """Sorted permuted keys of one file (top ``bits`` bits) as arrays to map: bucket borders, remainders, values."""
    own = max(1, min(24, len(keys[0]).bit_length(), 63 - bits))
    size = np.bincount(top(keys[0] << _U(bits), own), minlength=1 << own)
    store(folder, f"{file}-borders", np.concatenate(([0], np.cumsum(size))).astype("<i8"))
    for i, k in enumerate(keys):
        store(folder, f"{file}-key{i}", k.astype("<u8"))
    for name, v in values.items():
        store(folder, f"{file}-{name}", v.astype("<u8"))


@functools.lru_cache(maxsize=4096)
def mapped(path: str, kind: str = "<u8") -> np.ndarray | None:
    """An array of a shared folder, mapped into memory; None where there is none."""
    try:
        return np.memmap(path, np.dtype(kind), "r") if os.path.getsize(path) else None
    except FileNotFoundError:
        return None


def find(folder: str, keys: Keys, names: Sequence[str], bits: int) -> list[np.ndarray]:
    """The values stored under permuted keys, in any order; 0 where a key is missing."""
    out = [np.zeros(len(keys[0]), _U) for _ in names]
    file = top(keys[0], bits)
    for f in np.unique(file).tolist() if bits else [0] * bool(len(file)):
        borders = mapped(f"{folder}/{f}-borders", "<i8")
        have = [mapped(f"{folder}/{f}-key{i}") for i in range(len(keys))]
        if borders is None or have[0] is None:
            continue
        ask = np.flatnonzero(file == f) if bits else np.arange(len(file))
        own = (len(borders) - 1).bit_length() - 1
        bucket = top(keys[0][ask] << _U(bits), own)
        at, end = borders[bucket], borders[bucket + 1]
        while len(ask):
            open_ = at < end
            ask, at, end = ask[open_], at[open_], end[open_]
            hit = functools.reduce(np.logical_and, (h[at] == k[ask] for h, k in zip(have, keys, strict=True)), np.ones(len(ask), bool))
            for o, name in zip(out, names, strict=True):
                o[ask[hit]] = mapped(f"{folder}/{f}-{name}")[at[hit]] if hit.any() else 0
            ask, at, end = ask[~hit], at[~hit] + 1, end[~hit]
    return out
