"""Benchmark decontamination by a generalised suffix automaton of the test items (operator 6).

The automaton over item words is built on the driver (its size is checked),
packed in sorted arrays and broadcast; a larger benchmark is cut in parts, with
an automaton and a pass over the documents for each. Each document's words stream through it; the longest match that
ends at each word tells which words are inside an occurrence of a window. Spans
of words that cannot reach a window, because too few consecutive word pairs
occur in the items, are skipped with one vectorised test.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from clueforge.llm._text import mix, release, slices, utf8, word_hashes
from clueforge.session import materialise

#: Consecutive words of a window, share of hit words (1 / 20) from which a document is contaminated, and the most item words of one automaton: building takes up to about 700 bytes of the driver for each, the broadcast up to 60.
WINDOW, ONE_IN, MOST_WORDS = 13, 20, 1_000_000

#: Bytes of text that are worked on at once: each takes up to about 50 bytes of a worker's memory.
SLICE = 250_000

#: Words are runs of digits, letters and non-ASCII characters.
IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class SuffixAutomaton:
    """All substrings of several sequences of ints."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new


class Packed:
    """A suffix automaton in arrays: 12 bytes for each edge, 8 for each state."""

    def __init__(self, built: SuffixAutomaton, words: np.ndarray):
        self.words = words
        self.link = np.array(built.link, np.int32)
        self.length = np.array(built.length, np.int32)
        degree = np.array([len(edges) for edges in built.next], np.int64)
        self.first = np.concatenate([[0], np.cumsum(degree)])
        names = np.searchsorted(words, np.fromiter((w for edges in built.next for w in edges), np.uint64, int(self.first[-1]))).astype(np.int32)
        targets = np.fromiter((q for edges in built.next for q in edges.values()), np.int32, int(self.first[-1]))
        order = np.lexsort((names, np.repeat(np.arange(len(degree)), degree)))
        self.names, self.targets = names[order], targets[order]

    def _step(self, state: int, word: int) -> int:
        """The state after a word, or -1."""
        a, b = int(self.first[state]), int(self.first[state + 1])
        at = a + int(np.searchsorted(self.names[a:b], word)) if b - a > 1 else a
        return int(self.targets[at]) if at < b and self.names[at] == word else -1

    def ends(self, hashes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
        """For each word, the state and length of the longest match that ends there, of at most `most` words."""
        state = length = 0
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        for word, there in zip(at.tolist(), known.tolist(), strict=True):
            if not there:
                state = length = 0
            else:
                while (after := self._step(state, word)) < 0 and state:
                    state = int(self.link[state])
                    length = int(self.length[state])
                state, length = (after, length + 1) if after >= 0 else (0, 0)
                if most is not None:
                    while state and self.length[self.link[state]] >= most:
                        state = int(self.link[state])
                    length = min(length, most)
            yield state, length


class Items:
    """The automaton of the items, with the items in which the windows of each state occur.

    Items are told apart by their number; those of one name count once in a document.
    A number as a name is that of an item without a name, of which other parts may hold more.
    """

    def __init__(self, items: list[tuple[str | int | None, list[int]]], window: int = WINDOW):
        self.window = window
        #: Names by number: equal names share one, every item without a name has its own.
        self.names: list[str | int | None] = []
        numbers: list[int] = []
        place: dict[str | int, int] = {}
        built = SuffixAutomaton()
        for name, words in items:
            built.add(words)
            if name is None or name not in place:
                self.names.append(name)
                if name is not None:
                    place[name] = len(self.names) - 1
            numbers.append(len(self.names) - 1 if name is None else place[name])
        self.words = np.array(sorted({w for _, words in items for w in words}), np.uint64)
        self.automaton = Packed(built, self.words)
        del built
        windows: dict[int, dict[int, set[int]]] = {}
        for number, (_, words) in zip(numbers, items, strict=True):
            most = min(window, len(words))
            for i, (state, length) in enumerate(self.automaton.ends(np.array(words, np.uint64), most)):
                if most and i + 1 >= most and length >= most:
                    windows.setdefault(state, {}).setdefault(most, set()).add(number)
        #: Of each state at which a window ends, the (length, items) of these windows.
        self.own = {state: [(k, tuple(sorted(v))) for k, v in found.items()] for state, found in windows.items()}
        #: Of each state, the nearest state on its suffix links (itself included) at which a window ends, or -1.
        self.nearest = np.full(len(self.automaton.link), -1, np.int32)
        for state in np.argsort(self.automaton.length, kind="stable").tolist():
            self.nearest[state] = state if state in self.own else self.nearest[self.automaton.link[state]] if state else -1
        self.least = min((min(window, len(words)) for _, words in items if words), default=0)
        pairs = [np.array(words[:-1], np.uint64) * np.uint64(3) + np.array(words[1:], np.uint64) for _, words in items if len(words) > 1]
        pairs = mix(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)
        self.bits = max(16, min(27, int(np.ceil(np.log2(64 * max(1, len(pairs)))))))
        self.pairs = np.zeros(1 << self.bits, bool)
        self.pairs[pairs >> np.uint64(64 - self.bits)] = True

    def windows_at(self, state: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """The (length, items) of all windows that are suffixes of a state's strings."""
        at = int(self.nearest[state])
        while at >= 0:
            yield from self.own[at]
            at = int(self.nearest[self.automaton.link[at]]) if at else -1

    def keys(self, found: Iterable[int]) -> set[str]:
        """The items by keys that hold in every part: names after an `i`, numbers of items without one after an `n`."""
        return {f"i{name}" if isinstance(name, str) else f"n{i if name is None else name}" for i, name in ((i, self.names[i]) for i in found)}

    def spans(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words, each in one row, that may hold a window."""
        if not self.least or not len(hashes):
            return
        if self.least == 1:
            good = np.isin(hashes, self.words)
            run = 1
        else:
            good = np.zeros(len(hashes), bool)
            good[:-1] = self.pairs[mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> np.uint64(64 - self.bits)]
            last = counts[1:][counts[1:] > counts[:-1]] - 1
            good[last] = False
            run = self.least - 1
        edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(starts[ends - starts >= run].tolist(), ends[ends - starts >= run].tolist(), strict=True):
            if self.least > 1:
                yield a, b + 1
                continue
            for row in range(int(np.searchsorted(counts, a, "right")) - 1, len(counts) - 1):
                if counts[row] >= b:
                    break
                lo, hi = max(a, int(counts[row])), min(b, int(counts[row + 1]))
                if hi > lo:
                    yield lo, hi

    def hits(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are inside a window, and the items that occur in each row."""
        depth = np.zeros(len(hashes) + 1, np.int64)
        found: dict[int, set[int]] = {}
        for a, b in self.spans(hashes, counts):
            row = int(np.searchsorted(counts, a, "right")) - 1
            for i, (state, length) in enumerate(self.automaton.ends(hashes[a:b])):
                for size, items in self.windows_at(state) if length >= self.least else ():
                    if size <= length:
                        depth[a + i + 1 - size] += 1
                        depth[a + i + 1] -= 1
                        found.setdefault(row, set()).update(items)
        return np.cumsum(depth)[:-1] > 0, found


def _item_rows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())


def _hashed(text: str) -> list[int]:
    return word_hashes(*utf8(pa.array([text])), IS_WORD)[0].tolist()


def build_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Items:
    """The automaton of a benchmark table; it raises where the items have over MOST_WORDS words (`item_parts` has no such limit).

    An item without an id counts as an item of its own. Null and empty texts have no
    windows. Items that share an id count as one.
    """
    rows = _item_rows(benchmark, item_id, text)
    size = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).collect()[0][0] or 0
    if size > MOST_WORDS:
        raise ValueError(f"the benchmark has {size} words, over {MOST_WORDS}; use item_parts")
    return Items([(row["id"], _hashed(row["text"])) for row in rows.collect()], window)


def item_parts(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, most: int = MOST_WORDS) -> Iterator[Items]:
    """Automata of at most `most` words each (at least `window`), which together hold all windows of a benchmark of any size.

    Rows come to the driver partition by partition, and one part is built at a
    time. An item that does not fit into a part goes on in the next one, from
    window - 1 words before the cut, so that no window is lost and each piece has
    a whole one. Ids, nulls and empty texts as in `build_items`; the parts know an
    item that is cut, or an id that several items share, as one.
    """
    if most < window:
        raise ValueError(f"a part of {most} words holds no window of {window}")
    held: list[tuple[str | int, list[int]]] = []
    room = most
    for number, row in enumerate(_item_rows(benchmark, item_id, text).toLocalIterator()):
        words, name = _hashed(row["text"]), number if row["id"] is None else row["id"]
        while len(words) > room:
            if room >= window:
                held.append((name, words[:room]))
                words = words[room - window + 1 :]
            yield Items(held, window)
            held, room = [], most
        held.append((name, words))
        room -= len(words)
    yield Items(held, window)


def decontaminate(docs: DataFrame, items: Items | Iterable[Items], doc_id: str = "doc_id", text: str = "text", with_clean: bool = False, keep: tuple[str, ...] | list[str] = (), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row, and clean_text where `with_clean`.

    Columns `keep` and, where `with_text`, the text itself follow unchanged.

    Of several parts (`item_parts`) each but the last is a pass that writes the
    rows to the shared folder with the words that it hits (a bit for each word)
    and the items that it finds; the last adds all of them up. So a word that
    several parts hit, and an item that several find, count once. Columns of
    `keep` must not begin with `_hit`.

    clean_text is the text without its hit words (joined by spaces where any was
    removed). A null or empty text has no words and is not contaminated; with no
    items nothing is hit. An item without an id counts in n_hit and n_items but has
    no place in items_sha256. Repeated rows are judged each; other columns are not read.
    """
    parts = iter([items] if isinstance(items, Items) else items)
    part, after = next(parts, None) or Items([]), next(parts, None)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    while after is not None:
        rows = materialise(_marked(rows, part), "benchmark_hits")
        part, after = after, next(parts, None)
    return _judged(rows, part, with_clean, tuple(keep), with_text)


def _hits(known: Items, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Hit words, words before each row and items of each row of (doc_id, text, ...), with what earlier parts hit."""
    hashes, counts = word_hashes(*utf8(part.column(1)), IS_WORD)
    hit, found = known.hits(hashes, counts)
    keys = [known.keys(found.get(i, ())) for i in range(part.num_rows)]
    if "_hit_words" in part.schema.names:
        for i, (bits, before) in enumerate(zip(part.column("_hit_words").to_pylist(), part.column("_hit_items").to_pylist(), strict=True)):
            if bits is not None:
                hit[counts[i] : counts[i + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=counts[i + 1] - counts[i]).view(bool)
                keys[i].update(before)
    return hit, counts, keys


def _marked(rows: DataFrame, items: Items) -> DataFrame:
    """The rows with _hit_words (a bit for each word, null where none is hit) and _hit_items (keys)."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    plain = [c for c in rows.columns if not c.startswith("_hit")]
    schema = rows.select(plain).schema.add("_hit_words", "binary").add("_hit_items", ArrayType(StringType()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                hit, counts, keys = _hits(shared.value, part)
                bits = [np.packbits(hit[a:b]).tobytes() if k else None for a, b, k in zip(counts, counts[1:], keys, strict=False)]
                arrays = [part.column(c) for c in plain] + [pa.array(bits, pa.binary()), pa.array([sorted(k) for k in keys], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*plain, "_hit_words", "_hit_items"])

    return rows.mapInArrow(marked, schema)


def _judged(rows: DataFrame, items: Items, with_clean: bool, keep: tuple[str, ...], with_text: bool) -> DataFrame:
    """The verdict on each row by the last part and what the earlier ones marked."""
    shared = rows.sparkSession.sparkContext.broadcast(items)
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"doc_id {kind('doc_id')}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if with_clean:
        schema += ", clean_text string"
    if with_text:
        schema += ", text string"
    schema += "".join(f", `{c}` {kind(c)}" for c in keep)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                hit, counts, keys = _hits(shared.value, part)
                run = np.concatenate([[0], np.cumsum(hit)])
                n_words, n_hit = np.diff(counts), run[counts[1:]] - run[counts[:-1]]
                digests = [hashlib.sha256(",".join(sorted(k[1:] for k in found if k[0] == "i")).encode()).hexdigest() if found else empty for found in keys]
                arrays = [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(k) for k in keys], pa.int64()), pa.array(digests), pa.array((n_hit > 0) & (ONE_IN * n_hit >= n_words))]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                if with_clean:
                    texts = part.column(1).to_pylist()
                    for i in np.flatnonzero(n_hit).tolist():
                        texts[i] = _without(texts[i], hit[counts[i] : counts[i + 1]])
                    arrays.append(pa.array(texts, pa.string()))
                    names.append("clean_text")
                if with_text:
                    arrays.append(part.column(1))
                    names.append("text")
                arrays += [part.column(2 + i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *keep])

    return rows.mapInArrow(judged, schema)


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and the separators between them."""
    out, at, previous = [], 0, False
    for word, gone in zip(re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text), hit.tolist(), strict=True):
        if gone:
            if not previous:
                out.append(text[at : word.start()])
            at = word.end()
        previous = gone
    out.append(text[at:])
    return "".join(out)


def oracle_sql(window: int = WINDOW) -> str:
    """The query in DuckDB's SQL: windows as joined words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS iid, CAST(item_id AS VARCHAR) AS id, {words} AS ws FROM benchmark),
k AS (SELECT iid, id, ws, least({window}, len(ws)) AS k FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT iid, id, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM (SELECT iid, id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM k)),
dw AS (SELECT rid, p, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM (SELECT rid, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS p FROM d, (SELECT DISTINCT k FROM w))),
h AS (SELECT rid, p, k, iid, id FROM dw JOIN w USING (k, win)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY 1),
f AS (SELECT rid, count(DISTINCT coalesce(id, 'row ' || iid)) AS n_items, array_to_string(list_sort(list_distinct(list(id) FILTER (id IS NOT NULL))), ',') AS ids FROM h GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN f USING (rid)
"""
