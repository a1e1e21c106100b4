"""Token counts by a map-side two-tier lookup (operator 5).

The lengths of frequent pre-tokens are broadcast once as a compact table (their
bytes end to end, and two arrays); a worker hashes it once. A pre-token that is
not in it is encoded by the tokenizer library and kept in a cache of the worker
whose entries and bytes are bounded. No pre-token is ever shuffled: the plan is one scan
and one Arrow map.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clueforge.llm._text import kept, pre_tokens

#: Rows of the sample (by hash, whole texts) that fills the frequent table, entries of that table and characters of each, entries of a worker's cache and characters of each (longer pre-tokens are encoded each time). They bound memory and never change a count.
TABLE_ROWS, TABLE_SIZE, TABLE_LONGEST, CACHE_SIZE, CACHE_LONGEST = 1_000, 65_536, 32, 500_000, 64


class _Lengths:
    """The library's tokenizer, and the numbers of tokens of the pre-tokens met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            added = [x["content"] for x in json.load(file).get("added_tokens", [])]
        self.specials = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.cache: dict[str, int] = {}
        self.table: tuple[object, dict[str, int]] = (None, {})
        # Splitting by PATTERN is right for byte-level files that split so themselves; other files are asked for whole texts.
        split = json.loads(self.tokenizer.to_str())
        before = split.get("pre_tokenizer") or {}
        self.splits = split.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)

    def frequent(self, packed: "Packed") -> dict[str, int]:
        """The broadcast table as a hash table, built once."""
        if self.table[0] is not packed:
            self.table = (packed, packed.unpacked())
        return self.table[1]

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        """The library's number of tokens of each text."""
        if not self.splits:
            return self.encoded(texts)
        if len(self.cache) > CACHE_SIZE:
            self.cache.clear()
        cache, out, open_rows = self.cache, [0] * len(texts), []
        missing: dict[str, None] = {}
        for i, text in enumerate(texts):
            parts = [text]
            if self.specials is not None and (found := len(self.specials.findall(text))):
                parts, out[i] = self.specials.split(text), found
            for part in parts:
                words = pre_tokens(part)
                lengths = list(map(frequent.get, words))
                if None not in lengths:
                    out[i] += sum(lengths)
                    continue
                out[i] += sum(filter(None, lengths))
                rest = [w for w, n in zip(words, lengths, strict=True) if n is None]
                lengths = list(map(cache.get, rest))
                if None in lengths:
                    missing.update((w, None) for w, n in zip(rest, lengths, strict=True) if n is None)
                    open_rows.append((i, rest))
                else:
                    out[i] += sum(lengths)
        if missing:
            words = list(missing)
            found = dict(zip(words, self.encoded(words), strict=True))
            cache.update((w, n) for w, n in found.items() if len(w) <= CACHE_LONGEST)
            for i, rest in open_rows:
                out[i] += sum(found[w] if w in found else cache[w] for w in rest)
        return out


class Packed:
    """Pre-tokens and their numbers of tokens as three buffers: at most TABLE_SIZE * (4 * TABLE_LONGEST + 6) bytes."""

    def __init__(self, lengths: dict[str, int]):
        raw = [w.encode() for w in lengths]
        self.bytes = b"".join(raw)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.uint32)
        self.lengths = np.array(list(lengths.values()), np.uint16)

    def unpacked(self) -> dict[str, int]:
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        return {self.bytes[a:b].decode(): n for a, b, n in zip(starts.tolist(), self.ends.tolist(), self.lengths.tolist(), strict=True)}


def _lengths(path: str) -> _Lengths:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(f"lengths {path}", lambda: _Lengths(path))


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", rows: int = TABLE_ROWS, most: int = TABLE_SIZE) -> dict[str, int]:
    """Numbers of tokens of at most `most` frequent pre-tokens, counted over about `rows` whole texts that a hash of the text takes."""
    rate = min(1.0, rows / max(1, docs.count()))
    longest = TABLE_LONGEST

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(w for w in pre_tokens(value.as_py()) if len(w) <= longest)
        best = counts.most_common(most)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])

    some = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < rate * (1 << 30)))
    found = some.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most).toArrow()
    words = found.column("word").to_pylist()
    return dict(zip(words, _lengths(path).encoded(words), strict=True)) if words else {}


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    Counts are those of the tokenizer file at `path` without added tokens;
    special strings inside a text count as the library counts them. Null and
    empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(Packed(frequent_lengths(docs, path, text)))
    dtype = docs.schema[doc_id].dataType.simpleString()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [x or "" for x in part.column(1).to_pylist()]
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                n = np.array(lengths.count(values, lengths.frequent(table.value)), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counts, f"doc_id {dtype}, n_bytes long, n_tokens long, over_limit boolean")
