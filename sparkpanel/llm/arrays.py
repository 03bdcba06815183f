"""Numpy kernels over UTF-8 buffers: words and their codes, rolling hashes, winnowed anchor units, digests.

Rolling hashes are polynomials modulo 2**64 over mixed 64-bit token codes. Prefix sums make the hash of any token
range two look-ups: with S[i] = sum(code[j] * B**j, j < i), hash(i, j) = (S[j] - S[i]) * B**-i. Recursive texts of two
symbols (Thue-Morse) share such hashes whatever the base, so they only choose anchors, where a shared hash costs time
and changes nothing; what is equal is told by content or by a cryptographic digest of it.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 5  # odd, 5 modulo 8, so that powers repeat late


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.r_[U(1), np.full(n - 1, b, dtype=U)]) for b in (self.base, self.inverse))
        return self.up, self.down


_POWERS = Powers(BASE)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A mixed rolling hash of each run of k codes."""
    up, down = _POWERS.upto(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    n = len(sums) - k
    return mix((sums[k:] - sums[:n]) * down[:n]) if n > 0 else np.zeros(0, dtype=U)


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9FB21C651E98DF25))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20):
    """Runs of rows with at most so many bytes together; a longer row is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word [^\\x20\\x09-\\x0D]+ and the offsets of rows in words."""
    n = len(data)
    inside = np.zeros(n + 1, dtype=bool)
    np.logical_not(SPACE[data], out=inside[:n])
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.r_[False, inside[:n]]
    starts = np.flatnonzero(inside & (cut | ~before))
    ends = np.flatnonzero(before & (cut | ~inside))
    return starts, ends, np.searchsorted(starts, offsets)


MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
LONG = 64  # bytes; longer words are digested one by one


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word.

    Eight bytes at a time go through a bijective mix, so words of one length up to eight bytes never share a code. Longer
    ones can be made to, on purpose: codes choose anchors and decide nothing else. Words of more than LONG bytes get a
    digest.
    """
    sizes = ends - starts
    out = mix(sizes.astype(U) * U(0x9FB21C651E98DF25) + U(0x2545F4914F6CDD1D))
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    at = np.flatnonzero(sizes <= LONG)
    for k in range(0, LONG, 8):
        at = at[sizes[at] > k]
        if not len(at):
            break
        piece = eight[starts[at] + k] & MASKS[np.minimum(sizes[at] - k, 8)]
        out[at] = mix((out[at] ^ piece) * U(0xD1342543DE82EF95) + U(k + 1))
    for i in np.flatnonzero(sizes > LONG):
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def digests(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit BLAKE2 digest of each range of bytes, as two 64-bit columns."""
    view = memoryview(np.ascontiguousarray(buffer))
    found = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, dtype="<u8").reshape(-1, 2).astype(U)


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each starts and ends there."""
    to = np.cumsum(ends - starts + 1) - 1
    begin = to - (ends - starts)
    out = np.full(int(to[-1]) + 1 if len(to) else 0, 0x20, dtype=np.uint8)
    from_ = np.repeat(starts - begin, ends - starts)
    places = np.arange(len(out))
    inside = np.ones(len(out), dtype=bool)
    inside[to] = False
    places = places[inside]
    out[places] = data[places + from_]
    return out, begin, to


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def row_of(offsets: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) if n else np.zeros(0, dtype=np.int64)


def _echoes(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Hashes that are the least of some window and stand twice within three widths."""
    if not len(least):
        return least
    reach = np.r_[np.zeros(width - 1, dtype=U), least, np.zeros(width - 1, dtype=U)]
    at = np.flatnonzero(~sliding_min(~reach, width) == grams[: len(least) + width - 1])
    value = grams[at]
    return np.unique(value[1:][(value[1:] == value[:-1]) & (np.diff(at) < 3 * width)])


def units(codes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Winnowing: runs of consecutive windows of one row that select the same anchor.

    A window of so many tokens selects the least hash among its grams. As the choice depends on the window's
    content only, equal windows anywhere have the same anchor. Per unit: row, first and last window (token index
    in the row), anchor, and the tokens of the block from begin to stop, which its windows cover. Runs are cut at
    2 * (window - gram + 1) windows, which only text of a short period reaches. echo: the anchor stands more than
    once near here, so that the unit may repeat within itself.
    """
    width = window - gram + 1
    grams = gram_hashes(codes, gram)
    least = sliding_min(grams, width) if len(codes) >= window else np.zeros(0, dtype=U)
    echoes = _echoes(grams, least, width)
    row = row_of(offsets, len(codes))[: len(least)]
    fits = np.arange(len(least)) + window <= offsets[1:][row]
    at = np.flatnonzero(fits)
    least, row = least[at], row[at]
    new = np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])] if len(at) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(new)
    run = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)])) if len(at) else at
    heads = np.flatnonzero(run % (2 * width) == 0)
    tails = np.r_[heads[1:], len(at)] - 1 if len(heads) else heads
    begin, stop = at[heads], at[tails] + window
    base = offsets[:-1][row[heads]]
    return {"row": row[heads], "first": begin - base, "last": at[tails] - base, "anchor": least[heads], "echo": np.isin(least[heads], echoes), "begin": begin, "stop": stop}


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
