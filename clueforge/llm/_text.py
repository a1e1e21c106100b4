"""Byte-level helpers that the operators of this subpackage share.

Everything works on the UTF-8 buffers of Arrow batches with numpy, so a text
costs a few array passes and no Python object per character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The split pattern of the byte-level vocabularies, for texts of any script and for ASCII texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

#: Letters and numbers that the tokenizer libraries' older Unicode tables leave unassigned.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a "
    "11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 "
    "1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_newer = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]")

_split_any = regex.compile(PATTERN).findall
_split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall


def pre_tokens(text: str) -> list[str]:
    """The matches of PATTERN, in order; they cover the text.

    Letters and numbers newer than the tokenizer libraries count as neither, as they do there.
    """
    if text.isascii():
        return _split_ascii(text)
    if not _newer.search(text):
        return _split_any(text)
    at, out = 0, []
    for word in _split_any(_newer.sub("\uffff", text)):
        out.append(text[at : at + len(word)])
        at += len(word)
    return out


_kept: dict[str, object] = {}


def kept(key: str, build: Callable[[], object]) -> object:
    """What a worker keeps between the tasks of one operator (a tokenizer and its caches); the worker holds it until another key or `release`."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Let go of what another operator kept in this worker."""
    _kept.clear()


def training_row(column: str, modulus: int, held_out: int) -> Column:
    """True unless crc32 of the id as text leaves `held_out` modulo `modulus`; so a row without an id is one to learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)) != held_out, F.lit(True))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[marks[0] : marks[-1]], marks - marks[0]


def slices(batch: pa.RecordBatch, column: str | int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `most` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    block = np.cumsum(lengths) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random-looking 64-bit value for each byte; A-Z share those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BYTE[65:91] = _BYTE[97:123]


def _powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    found = cache.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 20), base, np.uint64)
        found[0] = 1
        cache[base] = found = np.multiply.accumulate(found, out=found)
    return found[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words before each row (n + 1), as in `hashed_words`."""
    return hashed_words(data, offsets, is_word, most)[:2]


def hashed_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, the number of words before each row (n + 1), and where each word begins and ends.

    A word is a maximal run of bytes of `is_word` (a table of 256 booleans) in
    one row; A-Z count as a-z. Hashes are polynomial over a random value for
    each byte, so equal words have equal hashes wherever they stand.
    """
    inside = is_word.take(data)
    before = np.empty_like(inside)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        before[firsts] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[firsts[firsts > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.empty(0, np.int64)
    counts = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        if hi - lo > 4 * most:  # one very long word
            value = 0
            for i in range(lo, hi, most):
                part = _BYTE[data[i : min(hi, i + most)]]
                value = value * pow(_BASE, len(part), 1 << 64) + int((part * _powers(_BASE, len(part))[::-1]).sum(dtype=np.uint64))
            hashes[a] = np.uint64(value & (1 << 64) - 1)
        else:
            run = np.zeros(hi - lo + 1, np.uint64)
            values = _BYTE.take(data[lo:hi])
            values *= _powers(_BASE_INVERSE, hi - lo)
            np.cumsum(values, out=run[1:])
            s, e = starts[a:b] - lo, ends[a:b] - lo
            hashes[a:b] = (run[e] - run[s]) * _powers(_BASE, hi - lo + 1)[e - 1]
        a = b
    return mix(hashes + (ends - starts).astype(np.uint64)), counts, starts, ends
