"""Positions that equal passages share, found in each text by itself."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

GRAM = 32
_BITS = 18
_MASK = np.uint64((1 << _BITS) - 1)
_PART = 1 << _BITS
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A digest of two neighbouring digests: names for strings of twice the length."""
    with np.errstate(over="ignore"):
        out = left * _C1
        out += right
        out ^= out >> _S32
        out *= _C2
        out ^= out >> _S29
    return out


def string_names(data: np.ndarray, length: int) -> np.ndarray:
    """For each position the 64-bit name of the ``length`` bytes from there (at least 8).

    Names double from 8 bytes to the largest power of two in ``length``; two of
    those that overlap name the whole.
    """
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    names = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,)).copy()
    size = 8
    while 2 * size <= length:
        names = _join(names[:-size], names[size:])
        size *= 2
    if size < length:
        step = length - size
        names = _join(names[:-step], names[step:])
    return names


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        step = width - size
        values = np.minimum(values[:-step], values[step:])
    return values


def _parts(texts: Sequence[bytes], window: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Texts side by side, at most 2^18 bytes at once; a longer one in overlapping parts."""
    rows, starts, size, held = [], [], 0, []
    for row, text in enumerate(texts):
        if len(text) < window:
            continue
        step = _PART - window + 1
        for at in range(0, len(text) - window + 1, step) if len(text) > _PART else (0,):
            piece = text[at : at + _PART]
            if size + len(piece) > _PART:
                yield rows, starts, b"".join(held)
                rows, starts, size, held = [], [], 0, []
            rows.append(row)
            starts.append(at)
            held.append(piece)
            size += len(piece)
    if rows:
        yield rows, starts, b"".join(held)


def anchor_runs(texts: Sequence[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For every text the anchors of its windows, as arrays.

    The anchor of a window is the 32-byte string in it with the smallest name,
    the leftmost of equal ones, so equal windows have their anchors at the same
    place. Windows in a row with one anchor are a run: its text's row, first
    and last window start, the anchor's position and name, and a digest of all
    bytes under the run. Every window is in one run.
    """
    for rows, offsets, data in _parts(texts, window):
        lengths = _lengths(rows, offsets, texts)
        at = np.concatenate([[0], np.cumsum(lengths)])
        buffer = np.frombuffer(data, np.uint8)
        names = string_names(buffer, GRAM)
        keyed = (names & ~_MASK) | np.arange(len(names), dtype=np.uint64)
        anchor = (_sliding_min(keyed, window - GRAM + 1) & _MASK).astype(np.int64)
        inside = np.zeros(len(anchor), bool)
        for low, high in zip(at[:-1], at[1:], strict=True):
            inside[low : high - window + 1] = True
        starts = np.flatnonzero(inside)
        found = anchor[starts]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        low, high, where = starts[first], starts[last], found[first]
        hull = np.fromiter(
            (xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(low.tolist(), (high + window).tolist(), strict=True)),
            np.uint64,
            len(low),
        )
        which = np.searchsorted(at, low, side="right") - 1
        base = at[which] - np.asarray(offsets)[which]
        yield (
            np.asarray(rows)[which],
            low - base,
            high - base,
            where - base,
            names[where].view(np.int64),
            hull.view(np.int64),
        )


def _lengths(rows: list[int], offsets: list[int], texts: Sequence[bytes]) -> list[int]:
    return [min(_PART, len(texts[r]) - o) for r, o in zip(rows, offsets, strict=True)]
