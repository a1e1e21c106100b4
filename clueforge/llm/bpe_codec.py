"""Byte-level BPE encoding and decoding through a generated sentencepiece model (operator 9).

A rank file (one base64 token and its rank a line) becomes a sentencepiece BPE
model without any training: each token's bytes are mapped to printable
characters, its score is the negative rank, and the normaliser is the identity.
sentencepiece then merges the best-scored neighbours first, which is the merge
order of the ranks. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueforge.llm._text import kept as kept_in_worker
from clueforge.llm._text import pre_tokens

#: Entries of a worker's cache of encoded pre-tokens, and characters of each (longer ones are encoded each time); they bound memory and never change an id.
CACHE_SIZE, CACHE_LONGEST = 400_000, 64


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, list[bytes]]:
    """A sentencepiece model as bytes, and the token of each piece id (id 0, the unknown piece, has none)."""
    chars = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    unknown, normal = 2, 1
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token in tokens:
        piece = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-ranks[token])) + _field(3, normal)))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, 0xFFFFFFFFFFFFFFFF) + _field(42, 0xFFFFFFFFFFFFFFFF) + _field(43, 0xFFFFFFFFFFFFFFFF)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer), [b"", *tokens]


class Codec:
    """Encodes texts to ranks, pre-token by pre-token, and decodes ranks to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        model, tokens = serialise(ranks)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ranks = ranks
        self.rank_of = [-1, *(ranks[t] for t in tokens[1:])]
        self.token_of = {rank: token for token, rank in ranks.items()}
        self.table = dict(enumerate(byte_characters()))
        self.cache: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode pre-tokens and decode their ids into the cache; a pre-token that is itself a token is that token."""
        rest, mapped, found = [], [], {}
        for word in words:
            raw = word.encode("utf-8", "replace")
            if (rank := self.ranks.get(raw)) is not None:
                found[word] = [rank]
            else:
                rest.append(word)
                mapped.append(raw.decode("latin-1").translate(self.table))
        rank_of = self.rank_of
        for word, ids in zip(rest, self.processor.encode(mapped, num_threads=1) if mapped else [], strict=True):
            found[word] = [rank_of[i] for i in ids]
        for word, ids in found.items():
            self.cache[word] = ",".join(map(str, ids))
            self.raw[word] = self.decode(ids)

    def encode_batch(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """The ranks of each text as decimals joined by commas, and the bytes they decode to.

        One library call encodes all pre-tokens that the cache lacks.
        """
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
            self.raw.clear()
        split = list(map(pre_tokens, texts))
        if missing := {w for words in split for w in words if w not in self.cache}:
            self.learn(list(missing))
        ids, raw = self.cache.__getitem__, self.raw.__getitem__
        out = [(",".join(map(ids, words)), b"".join(map(raw, words))) for words in split]
        for word in missing:
            if len(word) > CACHE_LONGEST:
                del self.cache[word], self.raw[word]
        return out

    def encode(self, text: str) -> list[int]:
        joined = self.encode_batch([text])[0][0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


def _codec(path: str) -> Codec:
    return kept_in_worker(f"codec {path}", lambda: Codec(read_ranks(path)))


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded text where `with_ids`, of every row.

    `path` names a rank file. ids_sha256 is of the decimal ids joined by commas,
    decoded_sha256 of the bytes that the ids decode to. Null and empty texts have
    no ids; both digests are then of the empty string. Repeated rows are encoded
    each; other columns are not read.
    """
    dtype = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {dtype}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, decoded, kept, texts = [], [], [], [], []
                for joined, raw in codec.encode_batch([x or "" for x in part.column(1).to_pylist()]):
                    counts.append(joined.count(",") + bool(joined))
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
                    if with_ids:
                        kept.append([int(x) for x in joined.split(",")] if joined else [])
                        texts.append(raw.decode("utf-8", "replace"))
                arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)
