"""Source tokens of many files at once, on bytes, without a Python loop over tokens.

The token rule is the project's similarity rule: identifiers, runs of ASCII digits, eight
two-character operators and single punctuation characters; all else separates. As every token
is ASCII, working on raw bytes gives the same tokens as decoding first and replacing bad bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
LETTER, DIGIT, PUNCT = 1, 2, 3

# The token alphabet.
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_"
DIGITS = b"0123456789"
SINGLES = b"-+*/%<>&|^~!?=(){}[],.;:"
PAIRS = (b"==", b"!=", b"<=", b">=", b"->", b"::", b"&&", b"||")

_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(LETTERS, np.uint8)] = LETTER
_CLASS[np.frombuffer(DIGITS, np.uint8)] = DIGIT
_CLASS[np.frombuffer(SINGLES, np.uint8)] = PUNCT
_PAIR = np.zeros(65536, bool)
for _p in PAIRS:
    _PAIR[_p[0] * 256 + _p[1]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(n, 1 << 16)
            _powers = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, _BASE, U64)]), dtype=U64)
            _inverses = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, _INVERSE, U64)]), dtype=U64)
    return _powers[:n], _inverses[:n]


@dataclass
class Tokens:
    """Parallel arrays, in reading order. ``file`` is the index of the file in the call."""

    hash: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    length: np.ndarray
    file: np.ndarray
    glued: np.ndarray  # directly behind a digit run, as ``x1f`` in ``0x1f``

    def split(self, files: int) -> np.ndarray:
        """Borders of the files in the arrays; one more than there are files."""
        return np.searchsorted(self.file, np.arange(files + 1))


def tokenize(texts: list[bytes]) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens of all the texts, the joined bytes, and the place of each text in them."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    buf = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n = len(buf)
    cls = _CLASS[buf]
    letter = cls == LETTER
    word = letter | (cls == DIGIT)
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = word[:-1]
    run_start = word & ~before
    run_starts = np.flatnonzero(run_start)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = word[1:]
    run_ends = np.flatnonzero(word & ~after) + 1

    # An identifier begins at the first letter of its run; digits in front are a token of their own.
    seen = np.cumsum(letter, dtype=np.int32)
    run_of = np.cumsum(run_start, dtype=np.int32) - 1
    base = seen[run_starts] - letter[run_starts]
    first_letter = np.flatnonzero(letter)
    first_letter = first_letter[seen[first_letter] - 1 == base[run_of[first_letter]]]

    punct = cls == PUNCT
    pair_at = np.flatnonzero(punct[:-1] & punct[1:])
    pair_at = pair_at[_PAIR[buf[pair_at].astype(np.int32) * 256 + buf[pair_at + 1]]]
    if len(pair_at):
        # Of overlapping pairs the leftmost wins: every second one in an unbroken chain.
        k = np.arange(len(pair_at))
        breaks = np.concatenate([[True], np.diff(pair_at) != 1])
        chain = np.maximum.accumulate(np.where(breaks, k, 0))
        pair_at = pair_at[(k - chain) % 2 == 0]
    begins = punct.copy()
    begins[pair_at + 1] = False
    begins[first_letter] = True
    begins[run_starts] = True
    starts = np.flatnonzero(begins)
    kind = cls[starts]
    length = np.ones(len(starts), np.int64)
    wide = np.zeros(n, bool)
    wide[pair_at] = True
    length[wide[starts]] = 2
    is_word = kind != PUNCT
    ends = run_ends[run_of[starts[is_word]]] if is_word.any() else np.zeros(0, np.int64)
    follower = np.append(starts[1:], n)[is_word]
    length[is_word] = np.minimum(ends, follower) - starts[is_word]
    glued = np.zeros(len(starts), bool)
    glued[1:] = (kind[1:] == LETTER) & (kind[:-1] == DIGIT) & (starts[1:] == starts[:-1] + length[:-1])

    with np.errstate(over="ignore"):
        powers, inverses = _tables(n + 1)
        prefix = np.concatenate([np.zeros(1, U64), np.cumsum((buf.astype(U64) + U64(1)) * powers[:n], dtype=U64)])
        value = (prefix[starts + length] - prefix[starts]) * inverses[starts]
        hashed = mix(value + length.astype(U64) * U64(0xD6E8FEB86659FD93))
    file = (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int32)
    return Tokens(hashed, kind, starts, length, file, glued), buf, offsets


def token_hash(word: bytes) -> int:
    """Hash that ``tokenize`` gives to a word."""
    return int(tokenize([word])[0].hash[0])


_STEPS = mix(np.arange(1, 65, dtype=U64))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` successive values; a shorter list gives one hash of all of it."""
    n = len(values)
    if n == 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        if n < width:
            return mix(np.array([(values * (_STEPS[:n] | U64(1))).sum(dtype=U64) + U64(n)], U64))
        if width > 8:  # a polynomial over the whole list, of which each window is a difference
            powers, inverses = _tables(n + 1)
            prefix = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values) * powers[:n], dtype=U64)])
            return mix((prefix[width:] - prefix[:-width]) * inverses[: n - width + 1])
        out = np.zeros(n - width + 1, U64)
        for j in range(width):
            out += values[j : n - width + 1 + j] * (_STEPS[j] | U64(1))
        return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


def windows_each(values: np.ndarray, borders: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of each of the lists that lie between the borders, one after the other, and their borders."""
    sizes = np.diff(borders)
    counts = np.where(sizes < width, sizes > 0, sizes - width + 1)
    to = np.concatenate([[0], np.cumsum(counts)])
    if len(values) >= width:
        whole = windows(values, width)
        whole = whole[np.arange(width, len(values) + 1) <= np.repeat(borders[1:], sizes)[: len(whole)]]
    else:
        whole = np.zeros(0, U64)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if not len(short):
        return whole, to
    out = np.empty(to[-1], U64)
    lone = np.zeros(to[-1], bool)
    lone[to[short]] = True
    out[~lone] = whole
    for k in short.tolist():
        out[to[k]] = windows(values[borders[k] : borders[k + 1]], width)[0]
    return out, to


def sorted_each(values: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists between the borders, each in order, and which values equal the one before in their list."""
    values = values.copy()
    at = borders.tolist()
    for lo, hi in zip(at[:-1], at[1:]):
        values[lo:hi].sort()
    again = np.zeros(len(values), bool)
    again[1:] = values[1:] == values[:-1]
    again[borders[:-1][np.diff(borders) > 0]] = False
    return values, again


def distinct_each(values: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``distinct`` of each of the lists between the borders, and their borders."""
    values, again = sorted_each(values, borders)
    return values[~again], np.concatenate([[0], np.cumsum(~again)])[borders]


def sums_each(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The sum of each of the lists between the borders."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    with np.errstate(over="ignore"):
        return total[borders[1:]] - total[borders[:-1]]


def minhash_each(values: np.ndarray, borders: np.ndarray, permutations: int) -> np.ndarray:
    """``minhash`` of each of the lists between the borders, one in a row."""
    out = np.full((permutations, len(borders) - 1), np.iinfo(np.uint32).max, np.uint32)
    some = np.flatnonzero(np.diff(borders) > 0)
    if len(some):
        first, product = borders[some], np.empty(len(values), U64)
        with np.errstate(over="ignore"):
            for row, a in zip(out, mix(np.arange(permutations, dtype=U64) + U64(0xA5A5)) | U64(1)):
                np.bitwise_xor(values, a >> U64(7), out=product)
                product *= a
                row[some] = np.minimum.reduceat(product, first) >> U64(32)
    return np.ascontiguousarray(out.T)


def minhash(values: np.ndarray, permutations: int) -> np.ndarray:
    """Smallest value under each of ``permutations`` mixings; all ones for an empty set."""
    if not len(values):
        return np.full(permutations, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        a = mix(np.arange(permutations, dtype=U64) + U64(0xA5A5)) | U64(1)
        product = values[None, :] ^ (a[:, None] >> U64(7))
        product *= a[:, None]
        return (product.min(axis=1) >> U64(32)).astype(np.uint32)


def bands(signature: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` successive values of a signature, or of each row of signatures."""
    count = signature.shape[-1] // rows
    block = signature[..., : count * rows].astype(U64).reshape(*signature.shape[:-1], count, rows)
    with np.errstate(over="ignore"):
        key = np.arange(count, dtype=U64) * U64(0x9E3779B1) + U64(salt)
        for j in range(rows):
            key = mix(key + block[..., j] * (_STEPS[j] | U64(1)))
        return key.view(np.int64)
