"""Sequence functions: bases, canonical k-mers and their MurmurHash3 values."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
_CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
_LETTER = np.full(256, 255, np.uint8)
for _i in range(26):
    _LETTER[65 + _i] = _LETTER[97 + _i] = _i % 4
_BASE = np.frombuffer(b"ACGT", np.uint8).astype(np.uint64)


def max_hash(scaled: int) -> int:
    """The largest hash that is kept: 2^64 / scaled in floating point; all for scaled <= 1."""
    return MASK64 if scaled <= 1 else int(float(2**64) / scaled)


def squeezed(text: Column) -> Column:
    """Letters of a text as bases: a to z stand for A, C, G, T in turn; anything else goes."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def squeezed_codes(text: np.ndarray) -> np.ndarray:
    """The bytes of texts as base codes: squeezed(), with 255 for the bytes that go."""
    return _LETTER[text]


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def pieces(seq: Column, size: int, overlap: int) -> Column:
    """A sequence as array of pieces of `size` bases, each with the next `overlap` bases; in linear time."""
    own = F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    joined = lambda o: F.transform(o, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(o, i + 1), F.lit("")), 1, overlap)))
    return F.get(F.transform(F.array(own), joined), 0)  # within a lambda, own would be cut anew for each piece


#: Fixed multipliers of the portable hash; its values have PORTABLE_BITS bits.
PORTABLE_BITS, M1, M2, M3 = 60, 134_217_757, 67_108_879, 1_073_741_827
_PRIME = (1 << 31) - 1


def portable_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of k-mers in small whole numbers, which plain SQL engines can state (portable_sql).

    The bases as digits 0 to 3 are read as two decimal numbers, of the first k // 2 digits
    and of the rest, that are mixed by products below 2^63.
    """
    digit = lambda p: ((codes >> np.uint64(2 * (k - 1 - p))) & np.uint64(3)).astype(np.int64)
    halves = []
    for first, last in ((0, k // 2), (k // 2, k)):
        x = np.zeros(len(codes), np.int64)
        for p in range(first, last):
            x = x * 10 + digit(p)
        halves.append(x)
    x = halves[0] % _PRIME * M1 + halves[1] % _PRIME * M2
    for _ in range(2):
        x = x ^ (x >> 29)
        x = (x % _PRIME) * M3 + x // _PRIME
    return (x & ((1 << PORTABLE_BITS) - 1)).astype(np.uint64)


def portable_sql(kmer: str, k: int) -> str:
    """portable_hashes() of a SQL string expression."""
    digits = f"translate({kmer}, 'ACGT', '0123')"
    x = f"(CAST(substr({digits}, 1, {k // 2}) AS BIGINT) % {_PRIME}) * {M1} + (CAST(substr({digits}, {k // 2 + 1}) AS BIGINT) % {_PRIME}) * {M2}"
    x = f"list_reduce([{x}, 1, 2], lambda x, i: (xor(x, x >> 29) % {_PRIME}) * {M3} + xor(x, x >> 29) // {_PRIME})"
    return f"({x} & {(1 << PORTABLE_BITS) - 1})"


def encode(seq: bytes | np.ndarray) -> np.ndarray:
    """A, C, G, T in either case as 0 .. 3, anything else 255."""
    return _CODE[seq if isinstance(seq, np.ndarray) else np.frombuffer(seq, np.uint8)]


def reverse_complement_codes(codes: np.ndarray) -> np.ndarray:
    """Codes of the other strand; invalid ones become 4."""
    flipped = codes[::-1]
    return np.where(flipped < 4, 3 - flipped, 4).astype(np.uint8)


def canonical_codes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 2-bit codes) of all valid canonical k-mers.

    Windows are joined by doubling: a k-mer is put together from pieces whose lengths
    are the powers of two in k.
    """
    if not 4 <= k <= 31:
        raise ValueError("k must lie in 4 .. 31")
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    ok = np.flatnonzero(bad[k:] == bad[:-k])

    def joined(piece: np.ndarray) -> np.ndarray:
        out, done, length = np.zeros(n, np.uint64), 0, 1
        while length <= k:
            if k & length:
                out = (out << np.uint64(2 * length)) | piece[done : done + n]
                done += length
            if 2 * length <= k:
                piece = (piece[: len(piece) - length] << np.uint64(2 * length)) | piece[length:]
            length *= 2
        return out

    base = np.where(codes > 3, 0, codes).astype(np.uint64)
    forward = joined(base)
    backward = joined((np.uint64(3) - base)[::-1])[::-1]  # window i of the strand lies at n - 1 - i of the reversed one
    return ok, np.minimum(forward[ok], backward[ok])


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _table(size: int) -> np.ndarray:
    """The bytes of each run of `size` bases as a little-endian number."""
    table = np.zeros(4**size, np.uint64)
    for j in range(size):
        table |= _BASE[(np.arange(4**size) >> (2 * (size - 1 - j))) & 3] << np.uint64(8 * j)
    return table


def _words(codes: np.ndarray, k: int, at: int, size: int) -> np.ndarray:
    """Bytes at .. at + size of the k-mers as little-endian numbers, 8 bases at most by one table."""
    return _table(size)[((codes >> np.uint64(2 * (k - at - size))) & np.uint64(4**size - 1)).astype(np.int64)]


def hash_codes(codes: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Low 64 bits of MurmurHash3 x64-128 of the k-mers that 2-bit codes stand for."""
    if not len(codes):
        return np.zeros(0, np.uint64)
    return murmur3_low64(lambda at, size: _words(codes, k, at, size), k, len(codes), seed)


def murmur3_low64(word, n: int, many: int, seed: int = 42) -> np.ndarray:
    """Low 64 bits of MurmurHash3 x64-128 of `many` byte strings of n bytes; word(at, size) gives bytes as numbers."""
    c1, c2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
    first = lambda w: _rotated(w * c1, 31) * c2
    second = lambda w: _rotated(w * c2, 33) * c1
    h1 = np.full(many, seed, np.uint64)
    h2 = h1.copy()
    for at in range(0, n - n % 16, 16):
        h1 = (_rotated(h1 ^ first(word(at, 8)), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 = (_rotated(h2 ^ second(word(at + 8, 8)), 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    at, rest = n - n % 16, n % 16
    if rest > 8:
        h2 = h2 ^ second(word(at + 8, rest - 8))
    if rest:
        h1 = h1 ^ first(word(at, min(rest, 8)))
    h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _final(h1), _final(h2)
    return h1 + h2


def sketch_codes(codes: np.ndarray, k: int, keep: int, hashed=hash_codes, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-mers whose hash is `keep` at most; taken in steps of bounded memory."""
    pos, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(1, len(codes) - k + 1), step):  # a k-mer belongs to the step where it starts
        p, c = canonical_codes(codes[at : at + step + k - 1], k)
        h = hashed(c, k)
        on = h <= np.uint64(keep)
        pos.append(p[on] + at)
        hashes.append(h[on])
    return np.concatenate(pos), np.concatenate(hashes)


def sketch(seq: bytes, k: int, scaled: int, seed: int = 42, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept k-mers of a sequence under MurmurHash3."""
    return sketch_codes(encode(seq), k, max_hash(scaled), lambda c, k: hash_codes(c, k, seed), step)
