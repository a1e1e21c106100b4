"""Packing of examples into training sequences under several limits (operator 11).

Every example is a vector of demands: tokens, segments (one) and tokens that bear
loss. A sequence is filled by the dot-product heuristic: of the examples that fit,
that one comes next whose demands, weighed by how scarce each kind is, point most
nearly along what the sequence has left. Where examples may be cut, the one that
points best of those that do not fit fills what is left, and its remainder waits
for another sequence; a sequence that another limit closes early gives tokens back
until its length is one that needs no padding.

Packing happens in the task that reads the rows, over a bounded window of open
examples: there is no shuffle, and a lost task makes the same sequences again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.llm._text import slices, utf8, word_hashes
from clueforge.llm.bpe_codec import byte_characters
from clueforge.llm.lm_scoring import IS_WORD, word_spans

#: Limits of a sequence: tokens, segments, tokens that bear loss.
TOKENS, SEGMENTS, LOSS = 4_096, 256, 4_096

#: Open examples among which the heuristic chooses, and when so many wait, how many are left open until more rows come.
WINDOW, LEFT = 1_024, 256

#: Entries of a worker's tables of words, and characters of each; longer words are encoded each time.
CACHE_SIZE, CACHE_LONGEST = 1_000_000, 32

#: The id that ends a document.
END = 2


class Packer:
    """Places demands in sequences; `close` gets the pieces of each: (example, start, length) in order.

    An example has tokens, of which those before `prompt` bear no loss. Its pieces
    are cut from the front. Without `cut`, examples stay whole, and `add` is False
    for one that no sequence could hold.
    """

    def __init__(self, close: Callable[[list[tuple[int, int, int]]], None], tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, cut: bool = True):
        self.close, self.limits, self.cut = close, np.array([tokens, segments, loss], float), cut
        self.names = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)  # tokens that are placed already
        self.sizes = np.empty(0, np.int64)  # tokens that are left
        self.prompts = np.empty(0, np.int64)  # of those left, the first ones without loss
        self.waiting: list[tuple[int, int, int, int]] = []

    def add(self, name: int, tokens: int, prompt: int = 0) -> bool:
        if not self.cut and (tokens > self.limits[0] or max(0, tokens - prompt) > self.limits[2] or self.limits[1] < 1):
            return False
        start, most = 0, int(self.limits[0])
        if self.cut:
            while tokens - start >= most and most - max(0, prompt - start) <= self.limits[2]:  # whole sequences of its own
                self.close([(name, start, most)])
                start += most
        if tokens > start:
            self.waiting.append((name, start, tokens - start, max(0, prompt - start)))
            if len(self.names) + len(self.waiting) >= WINDOW:
                self.pack(LEFT)
        return True

    def pack(self, left: int = 0) -> None:
        """Make sequences until at most `left` examples are open."""
        if self.waiting:
            more = np.array(self.waiting, np.int64).T
            self.names, self.starts, self.sizes, self.prompts = (np.concatenate(x) for x in zip((self.names, self.starts, self.sizes, self.prompts), more, strict=True))
            self.waiting = []
        while len(self.names) > left:
            self._sequence()

    def _sequence(self) -> None:
        """One sequence; its examples leave the window."""
        shares = np.stack([self.sizes, np.ones(len(self.sizes)), np.maximum(0, self.sizes - self.prompts)], axis=1) / self.limits
        weights = shares.mean(axis=0)  # the scarcer a kind, the more it counts
        room = np.ones(3)
        open_ = np.ones(len(self.names), bool)
        pieces: list[tuple[int, int]] = []  # (place in the window, tokens)
        while open_.any():
            value = shares @ (weights * room)
            fits = open_ & (shares <= room + 1e-9).all(axis=1)
            if fits.any():
                at = int(np.argmax(np.where(fits, value, -1.0)))
                taken = int(self.sizes[at])
            elif self.cut:
                free = np.rint(room * self.limits).astype(np.int64)
                at = int(np.argmax(np.where(open_, value, -1.0)))
                taken = int(min(free[0], self.prompts[at] + free[2], self.sizes[at])) if free[1] else 0
            else:
                break
            if not taken:
                break
            open_[at] = False
            pieces.append((at, taken))
            room = np.maximum(0, room - np.array([taken, 1, max(0, taken - self.prompts[at])]) / self.limits)
            if room[0] * self.limits[0] < 0.5:
                break
        total = sum(n for _, n in pieces)
        if self.cut and total < self.limits[0]:
            self._shorten(pieces, total - (1 << total.bit_length() - 1))
        self.close([(int(self.names[at]), int(self.starts[at]), n) for at, n in pieces])
        for at, n in pieces:
            self.starts[at] += n
            self.sizes[at] -= n
            self.prompts[at] = max(0, self.prompts[at] - n)
        rest = self.sizes > 0
        self.names, self.starts, self.sizes, self.prompts = (x[rest] for x in (self.names, self.starts, self.sizes, self.prompts))

    @staticmethod
    def _shorten(pieces: list[tuple[int, int]], back: int) -> None:
        """Give back tokens from the end, until the length is a power of two."""
        while back:
            at, n = pieces.pop()
            if n > back:
                pieces.append((at, n - back))
            back = max(0, back - n)


#: Fixed value: the split pattern in the word vocabulary's file.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters of a plain word: visible ASCII and the letters of Latin-1, which normalisation leaves alone and case folds one to one.
PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch

#: The same for lower-case plain words.
SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+").findall


class _Ids:
    """The library's ids of texts, by a table of the words between white space that a worker has met.

    For files whose pre-tokenizer never joins characters across white space and whose
    normaliser lowers case. Words are looked up by their 64-bit hashes in numpy. Plain
    words are split here and asked of the library's model; the library gets others
    whole, and texts with special strings.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, of = self.tokenizer.model, byte_characters()
        self.letters = {c: "".join(of[b] for b in chr(c).encode()) for c in range(128, 256)}
        spec = json.loads(self.tokenizer.to_str())
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in added) or b"(?!)").search
        #: Normalised character by character, white space dropped by the split, byte-level without a prefix space.
        self.by_words = (
            [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and before[0]["behavior"] == "Removed"
            and before[0]["invert"]
            and before[0]["pattern"].get("Regex") == WORD_SPLIT
            and not before[1]["add_prefix_space"]
            and not any(len(x.split()) != 1 or x.strip() != x for x in added)
        )
        self._clear()

    def _clear(self) -> None:
        self.keys, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.ends, self.flat = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without added tokens; a null is an empty text."""
        if not self.by_words:
            return [np.array(x, np.uint32) for x in self._library([t or "" for t in column.to_pylist()])]
        data, offsets = utf8(column)
        raw, apart = data.tobytes(), {}
        if self.special(raw):
            apart = {i: np.array(self._library([t])[0], np.uint32) for i, t in enumerate(column.to_pylist()) if t and self.special(t.encode())}
            data, offsets = utf8(pa.array([None if i in apart else t for i, t in enumerate(column.to_pylist())], pa.string()))
            raw = data.tobytes()
        hashes, marks = word_hashes(data, offsets, IS_WORD)
        if len(self.keys) + len(self.parts) > CACHE_SIZE:
            self._clear()
        order = np.argsort(hashes)
        ranked = hashes[order]
        head = np.ones(len(ranked), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        keys = ranked[head]
        place = np.empty(len(ranked), np.int64)
        place[order] = np.cumsum(head) - 1
        entry, flat, ends = np.full(len(keys), -1), self.flat, self.ends
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            entry = np.where(self.keys[at] == keys, self.places[at], -1)
        new = np.flatnonzero(entry < 0)
        if len(new):
            starts, stops = (x[order[head][new]] for x in word_spans(data, offsets))
            # Long words come last and leave the table after this batch.
            last = np.argsort(stops - starts > CACHE_LONGEST, kind="stable")
            new, starts, stops = new[last], starts[last], stops[last]
            found = self._words([raw[i:j].decode() for i, j in zip(starts.tolist(), stops.tolist(), strict=True)])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            entry[new] = np.arange(len(ends) - 1, len(ends) - 1 + len(new))
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            ends = np.concatenate([ends, ends[-1] + np.cumsum(sizes)])
            stays = np.sort(new[: int((stops - starts <= CACHE_LONGEST).sum())])
            kept = len(self.ends) - 1 + len(stays)
            self.flat, self.ends = flat[: ends[kept]], ends[: kept + 1]
            at = np.searchsorted(self.keys, keys[stays])
            self.keys, self.places = np.insert(self.keys, at, keys[stays]), np.insert(self.places, at, entry[stays])
        at = entry[place]
        sizes = ends[at + 1] - ends[at]
        before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(sizes, out=before[1:])
        ids = flat[np.arange(before[-1]) + np.repeat(ends[at] - before[:-1], sizes)]
        return [apart[i] if i in apart else ids[a:b] for i, (a, b) in enumerate(pairwise(before[marks].tolist()))]

    def _words(self, words: list[str]) -> list[Sequence[int]]:
        out: list[Sequence[int]] = []
        hard, tokenize, letters, parts = [], self.model.tokenize, self.letters, self.parts
        for k, word in enumerate(words):
            if not PLAIN(word):
                hard.append(k)
                out.append(())
                continue
            ids: tuple[int, ...] = ()
            for part in SPLIT(word.lower()):
                found = parts.get(part)
                if found is None:
                    found = tuple([t.id for t in tokenize(part if part.isascii() else part.translate(letters))])
                    if len(part) <= CACHE_LONGEST:
                        parts[part] = found
                ids = ids + found if ids else found
            out.append(ids)
        for k, ids in zip(hard, self._library([words[k] for k in hard]), strict=True):
            out[k] = ids
        return out

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_workers: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _workers:
        _workers[path] = _Ids(path)
    return _workers[path]


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of whole texts in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for.

    A text's ids are the tokenizer library's for the file at `path`, without added
    tokens, and `end`; all bear loss. Every id lies in one piece. A sequence has at
    most `tokens` ids in at most `segments` pieces; it has `tokens` of them, or a
    power of two. Null and empty texts are `end` alone. Repeated rows and rows
    without an id are packed each. Sequences hold rows of one task only, so a task
    leaves some short ones (powers of two). An empty table has no pieces. Other
    columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        library, sequence = _ids(path), TaskContext.get().partitionId() << 33
        held: dict[int, tuple[pa.Scalar, np.ndarray, list[int]]] = {}  # of open examples: id, ids, tokens not yet placed
        done: list[tuple] = []
        name = 0

        def close(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for example, start, length in pieces:
                key, ids, left = held[example]
                part = ids[start : start + length]
                done.append((key, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset) + ((part.tolist(),) if with_ids else ()))
                offset += length
                left[0] -= length
                if not left[0]:
                    del held[example]
            sequence += 1

        def emitted() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            arrays = [pa.array([k.as_py() for k in columns[0]], key_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[7], pa.list_(pa.int32()))] if with_ids else []), names=names)

        packer, key_type = Packer(close, tokens, segments, loss), None
        for batch in batches:
            key_type = batch.column(0).type
            for part in slices(batch, 1):
                keys = part.column(0)
                for i, ids in enumerate(library.encode(part.column(1))):
                    ids = np.append(ids, np.uint32(end))
                    held[name] = (keys[i], ids, [len(ids)])
                    packer.add(name, len(ids))
                    name += 1
                if len(done) >= 1_000:
                    yield emitted()
        packer.pack()
        if done:
            yield emitted()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(packed, schema)


def pack_examples(examples: DataFrame, key: Column, tokens: Column, bearing: Column, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """key, tokens, bearing, sequence_id, offset: whole examples (instruction data) in sequences under all three limits.

    `bearing` is the number of an example's tokens that bear loss (its last ones).
    An example that is over a limit by itself, or whose numbers are null, gets no
    sequence (nulls). One without tokens takes a segment all the same. Repeated
    examples are packed each; sequences hold rows of one task only.
    """
    rows = examples.select(key.alias("key"), tokens.cast("long").alias("tokens"), bearing.cast("long").alias("bearing"))
    kind = rows.schema["key"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 33
        held: dict[int, tuple[pa.Scalar, int | None, int | None]] = {}
        done: list[tuple] = []

        def close(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for name, _, length in pieces:
                done.append((*held.pop(name), sequence, offset))
                offset += held_tokens.pop(name)
            sequence += 1

        def emitted() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in columns[0]], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["key", "tokens", "bearing", "sequence_id", "offset"])

        held_tokens: dict[int, int] = {}
        packer, key_type, name = Packer(close, *limits, cut=False), None, 0
        for batch in batches:
            key_type = batch.column(0).type
            for k, t, b in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[name], held_tokens[name] = (k, t, b), max(t or 0, 0)
                if t is None or b is None or not packer.add(name, max(t, 1), max(t, 1) - min(max(b, 0), max(t, 0))):
                    done.append((*held.pop(name), None, None))
                name += 1
            if done:
                yield emitted()
        packer.pack()
        if done:
            yield emitted()

    return rows.mapInArrow(packed, f"key {kind}, tokens long, bearing long, sequence_id long, offset long")
