"""Patched frame-of-reference blocks of unsigned 32-bit numbers.

A block holds 128 numbers less their minimum, packed at a width that a given share of them needs at most; the low bits
of the others are packed too, and their full differences stand in a list of exceptions.

Layout, little-endian, for n numbers in b blocks:
``PFB1``, n (8 bytes), b (4), exceptions (4); then for all blocks the minima (4 each), widths (1 each), numbers of exceptions
(1 each) and byte starts in the packed area (8 each); the packed area (16 bytes for each bit of width); the
exceptions' places in their blocks (1 each) and differences (4 each). The last block is filled up with its minimum.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFB1"
BLOCK = 128
HEAD = "<4sQII"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """The number of bits each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 numbers below 2**width as rows of ``width`` 64-bit words."""
    out = np.zeros((width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T.astype(np.uint64))
    for k in range(64):
        word, shift = divmod(k * width, 64)
        out[word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_words(words: np.ndarray, width: int) -> np.ndarray:
    """What ``pack_words`` packed."""
    columns = np.ascontiguousarray(words.T)
    out = np.empty((64, len(words)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        value = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= columns[word + 1] << np.uint64(64 - shift)
        out[k] = value & mask
    return out.T


def encode(numbers: np.ndarray, share: float = 0.9) -> bytes:
    """The numbers in blocks; ``share`` of a block's differences fit its width."""
    n = len(numbers)
    n_blocks = -(-n // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, np.uint32)
    grid[:n] = numbers
    if n % BLOCK:
        grid[n:] = grid[n - n % BLOCK : n].min()
    grid = grid.reshape(n_blocks, BLOCK)
    least = grid.min(axis=1, initial=0xFFFFFFFF) if n_blocks else np.zeros(0, np.uint32)
    differ = grid - least[:, None]
    needed = bit_lengths(differ)
    rank = min(BLOCK - 1, max(0, int(np.ceil(share * BLOCK)) - 1))
    widths = np.partition(needed, rank, axis=1)[:, rank] if n_blocks else np.zeros(0, np.uint8)
    beyond = needed > widths[:, None]
    row, place = np.nonzero(beyond)
    sizes = widths.astype(np.uint64) * 16
    starts = np.cumsum(sizes) - sizes
    packed = np.zeros(int(sizes.sum()) // 8, np.uint64)
    for width in np.unique(widths[widths > 0]).tolist():
        blocks = np.flatnonzero(widths == width)
        low = (differ[blocks] & np.uint32((1 << width) - 1)).reshape(-1, 64)
        words = pack_words(low, width).reshape(len(blocks), 2 * width)
        packed[(starts[blocks] // 8).astype(np.int64)[:, None] + np.arange(2 * width)] = words
    return b"".join(
        (
            struct.pack(HEAD, MAGIC, n, n_blocks, len(row)),
            least.astype("<u4").tobytes(),
            widths.tobytes(),
            beyond.sum(axis=1).astype(np.uint8).tobytes(),
            starts.astype("<u8").tobytes(),
            packed.astype("<u8").tobytes(),
            place.astype(np.uint8).tobytes(),
            differ[row, place].astype("<u4").tobytes(),
        )
    )


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The numbers from ``first`` to before ``last``; only the blocks that hold them are unpacked."""
    magic, n, n_blocks, n_beyond = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a block file")
    last = n if last is None else min(last, n)
    at = struct.calcsize(HEAD)

    def column(kind, count):
        nonlocal at
        values = np.frombuffer(data, kind, count, at)
        at += values.nbytes
        return values

    least, widths = column("<u4", n_blocks), column("u1", n_blocks)
    counts, starts = column("u1", n_blocks), column("<u8", n_blocks)
    packed = column("<u8", 2 * int(widths.sum(dtype=np.int64)))
    place, value = column("u1", n_beyond), column("<u4", n_beyond)
    low, high = first // BLOCK, -(-last // BLOCK) if last > first else first // BLOCK
    widths, least = widths[low:high], least[low:high]
    differ = np.zeros((len(widths), BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        blocks = np.flatnonzero(widths == width)
        words = packed[(starts[low + blocks] // 8).astype(np.int64)[:, None] + np.arange(2 * width)]
        differ[blocks] = unpack_words(words.reshape(-1, width), width).reshape(len(blocks), BLOCK)
    before = int(counts[:low].sum(dtype=np.int64))
    here = counts[low:high].astype(np.int64)
    row = np.repeat(np.arange(len(here)), here)
    differ[row, place[before : before + len(row)]] = value[before : before + len(row)]
    return (differ + least[:, None]).reshape(-1)[first - low * BLOCK : max(first, last) - low * BLOCK]
