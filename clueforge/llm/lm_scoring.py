"""Language-model scoring with causal self-attention in numpy (operator 8).

Counts of words and of subwords come from all training rows. The units of the
model are the most frequent words, each whole, and subwords of up to five bytes
into which other words fall; a subword outside the vocabulary is spelled by its
bytes. Units are grouped into classes: the commonest are a class each, the others
share classes by what they stand beside. A one-layer causal self-attention model,
trained in numpy on all windows of all training rows, gives the softmax over
the next unit's class, and the corpus counts that over the units of a class; the
product is a distribution over all units. Texts are scored in overlapping windows:
each position is scored once, with masked attention over the window's earlier
positions.

The base score needs the count of every word. Frequent words are broadcast as
two arrays of bounded size; the others are joined by their 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clueforge.llm._text import hashed_words, mix, slices, utf8
from clueforge.session import materialise

#: Bytes of a subword, words and subwords in the vocabulary (the most frequent ones), classes with one unit, shared classes.
PIECE, WORDS, PIECES, SINGLE, SHARED = 5, 49_152, 16_384, 61, 64
#: Positions of a window and those of them that are context only, width of the model, first steps, windows a step.
WINDOW, CONTEXT, WIDTH, STEPS, BATCH = 32, 8, 16, 400, 128
#: Windows of a shard, most shards (a shard grows beyond), rounds over all shards, learning rate of these.
SHARD, MOST_SHARDS, ROUNDS, RATE = 16_384, 256, 2, 0.005
#: Commonest units before and after which a unit is counted to find its class, and rounds of the grouping.
BESIDE, GROUPING = 24, 8
#: Windows whose class probabilities are held at once, in scoring and in training, so that they stay in a core's cache and its arrays in the heap.
AT_ONCE, LEARNT_AT_ONCE = 64, 32
#: Words that are broadcast with their counts, words counted together on the map side, and windows that are worked out together.
FREQUENT, BUFFER, TOGETHER = 500_000, 4_000_000, 1_024

IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bits of a number that hold its first bytes, by their count.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(PIECE + 1)])

#: Unit ids and class ids: 0 before a text, 1 its end, 2 subwords outside the vocabulary; then words and subwords by rank (units), single and shared classes (classes).
BEGIN, END, UNKNOWN, SPECIAL = 0, 1, 2, 3
CLASSES = SPECIAL + SINGLE + SHARED
#: Stands for the end of a text among the word hashes.
END_HASH = np.uint64(0x656E64206F662074)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends, in the order of `word_hashes`."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut | ~np.concatenate([[False], inside[:-1]])))
    breaks = np.flatnonzero(~inside | cut)
    return starts, breaks[np.searchsorted(breaks, starts, "right")] if len(starts) else starts


class Places:
    """Finds 64-bit hashes in a sorted array of them: their first bits lead to a run of few."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there; where it isn't, the place is any."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        run = (hashes >> self.shift).astype(np.int64)
        at, end = self.first.take(run), self.first.take(run + 1)
        at = np.minimum(at, len(self.keys) - 1)
        there = self.keys.take(at) == hashes
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            there[left] = self.keys.take(at[left]) == hashes[left]
            left = left[~there[left] & (at[left] + 1 < end[left])]
        return at, there


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subwords of words as numbers, and how many each word has.

    A number holds the lower-cased bytes, their count, and whether the subword begins a word.
    """
    n = -(-(ends - starts) // PIECE)
    if not len(n):
        return np.empty(0, np.int64), n
    first = np.cumsum(n) - n
    within = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
    size = np.minimum(np.repeat(ends - starts, n) - PIECE * within, PIECE)
    at = np.repeat(starts, n) + PIECE * within
    # The eight bytes from each place on, as one number.
    lower = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=lower[: len(data)])
    eight = np.ndarray(len(data), "<i8", lower, strides=(1,))
    return eight[at] & _KEPT[size] | size << 40 | (within == 0).astype(np.int64) << 44, n


def counted_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): counts of word hashes (kind 0, text ends included) and of subwords (kind 1) over all rows."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        rows = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    keys, n = np.unique(np.concatenate(held[kind]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])
                    held[kind].clear()

        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column(0))
                words, _, starts, ends = hashed_words(data, offsets, IS_WORD)
                held[0].append(words)
                held[1].append(pieces(data, starts, ends)[0])
                rows += part.num_rows
                size += len(words)
                if size > BUFFER:
                    yield from flush()
                    size = 0
        yield from flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array(np.array([END_HASH], np.uint64).view(np.int64)), pa.array([rows], pa.int64())], names=["kind", "key", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(counts, "kind int, key long, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int, exact: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of about `most` rows with the highest counts, in descending order; all rows if there are fewer.

    A histogram of the counts (exact up to `exact`, powers of two beyond) gives the
    least count that fits whole; of the rows of the next lower count, a hash of the
    key takes the share that is still free. So no task sees more than is returned.
    """
    level = F.when(F.col("n") < exact, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    steps = {r["level"]: r["rows"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()}
    total, least, share = 0, 1 << 62, 0.0
    for step in sorted(steps, reverse=True):
        if total + steps[step] > most:
            share = (most - total) / steps[step]
            kept = (level >= least) | ((level == step) & (F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)))
            break
        total, least = total + steps[step], step
    else:
        kept = F.lit(True)
    found = counts.where(kept).toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.lexsort((keys, -n))
    return keys[order], n[order]


class Vocabulary:
    """Units with their log10 probabilities: of words and subwords by rank, and of the bytes of what isn't in it."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], parts: tuple[np.ndarray, np.ndarray], n_words: float, n_texts: float):
        (wk, wn), (pk, pn) = words, parts
        order = np.argsort(wk.view(np.uint64), kind="stable")
        self.words, self.word_unit = wk.view(np.uint64)[order], (SPECIAL + order).astype(np.int32)
        self.places = Places(self.words)
        order = np.argsort(pk, kind="stable")
        self.parts, self.part_unit = pk[order], (SPECIAL + len(wk) + order).astype(np.int32)
        hashes = mix(self.parts.view(np.uint64))
        order = np.argsort(hashes)
        self.part_places, self.placed_unit = Places(hashes[order]), self.part_unit[order]
        # Subwords are counted over all words, but stand only for words outside the vocabulary.
        outside = max(0.0, n_words - float(wn.sum())) / max(1.0, n_words)
        self.counts = np.concatenate([[0.0, n_texts + 1.0, outside * len(pk) + 1.0], wn.astype(float), outside * pn + 1e-9])
        heads = np.zeros(256)
        for k in range(PIECE):
            np.add.at(heads, pk >> (8 * k) & 255, np.where(k < (pk >> 40 & 7), pn, 0))
        self.byte = np.log10((heads + 1) / (heads.sum() + 256))
        self.group(np.where(np.arange(len(self.counts)) < SPECIAL + SINGLE, np.arange(len(self.counts)), SPECIAL + SINGLE))

    def group(self, cls: np.ndarray) -> None:
        """Set the class of each unit, and with it the probabilities inside the classes and the prior of the classes."""
        self.cls = cls.astype(np.int32)
        total = np.bincount(self.cls, self.counts, CLASSES)
        self.inside = np.log10(np.maximum(self.counts, 1e-9) / np.maximum(total, 1e-9)[self.cls])
        self.inside[:SPECIAL] = 0.0
        self.prior = np.maximum(total, 1e-3)

    def spelled(self, value: np.ndarray) -> np.ndarray:
        """log10 probabilities of subwords by their bytes; the count of bytes and whether a word begins are one of 2 * PIECE."""
        out = np.full(len(value), -np.log10(2.0 * PIECE))
        for k in range(PIECE):
            out += np.where(k < (value >> 40 & 7), self.byte[value >> (8 * k) & 255], 0.0)
        return out

    def units(self, data: np.ndarray, hashes: np.ndarray, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as bytes and their `hashed_words`: unit ids of all with an END after each, how many come before each text (n + 1), and the subwords that are UNKNOWN in order."""
        at, whole = self.places.find(hashes)
        own, odd = np.flatnonzero(whole), np.flatnonzero(~whole)
        value, n = pieces(data, starts.take(odd), ends.take(odd))
        there, known = self.part_places.find(mix(value.view(np.uint64)))
        unit = np.full(len(value), UNKNOWN, np.int32)
        unit[known] = self.placed_unit[there[known]]
        before = np.zeros(len(hashes) + 1, np.int64)
        before[1:] = 1
        before[odd + 1] = n
        np.cumsum(before, out=before)
        counts = before.take(marks) + np.arange(len(marks))
        first = before[:-1] + np.repeat(np.arange(len(marks) - 1), np.diff(marks))
        ids = np.full(int(counts[-1]), END, np.int32)
        ids[first.take(own)] = self.word_unit.take(at.take(own))
        ids[np.repeat(first.take(odd) - np.cumsum(n) + n, n) + np.arange(len(unit))] = unit
        return ids, counts, value[~known]

    def inside_classes(self, ids: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """The log10 probability of each unit inside its class; the UNKNOWN ones are spelled."""
        inside = self.inside.take(ids)
        inside[ids == UNKNOWN] = self.spelled(unknown)
        return inside


def windows(ids: np.ndarray, counts: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and rows of the windows from number `low` to `high` of all texts; a target of -1 is none.

    `ids` has the units of all texts, each with its END, and `counts` how
    many come before each text. A window holds CONTEXT positions that an earlier
    window scored, and WINDOW - CONTEXT that it scores itself.
    """
    stride = WINDOW - CONTEXT
    sizes = np.diff(counts)
    before = np.concatenate([[0], np.cumsum(-(-sizes // stride))])
    number = np.arange(low, int(before[-1]) if high is None else min(high, int(before[-1])))
    row = np.searchsorted(before, number, "right") - 1
    place = ((number - before[row]) * stride)[:, None] + np.arange(-CONTEXT, stride)[None, :]
    start, size, last = counts[:-1][row][:, None], sizes[row][:, None], max(0, len(ids) - 1)
    inputs = np.where((place > 0) & (place < size), ids[np.clip(start + place - 1, 0, last)] if len(ids) else 0, BEGIN).astype(np.int32)
    own = place[:, CONTEXT:]
    targets = np.where(own < size, ids[np.clip(start + own, 0, last)] if len(ids) else 0, -1).astype(np.int32)
    return inputs, targets, row


def n_windows(counts: np.ndarray) -> int:
    return int((-(-np.diff(counts) // (WINDOW - CONTEXT))).sum())


_ONES = np.ones(CLASSES, np.float32)


def _held(total: np.ndarray) -> bool:
    """Whether float32 holds these sums of exponents well."""
    return not len(total) or np.minimum.reduce(total) > 1e-12 and np.maximum.reduce(total) < 1e12


class Attention:
    """One causal self-attention layer over class ids, with hand-written gradients.

    Probabilities are held as exponents and their sums. The bias is a factor of
    the columns and the sums of the rows are divided by in the narrow arrays
    that follow, so the widest array is passed over as seldom as can be.
    """

    NAMES = ("embed", "place", "qkv", "out", "head", "bias")

    def __init__(self, prior: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        d = WIDTH
        self.embed, self.place = r.normal(0, 0.3, (CLASSES, d)).astype(np.float32), r.normal(0, 0.1, (WINDOW, d)).astype(np.float32)
        self.qkv, self.out = r.normal(0, d**-0.5, (d, 3 * d)).astype(np.float32), r.normal(0, d**-0.5, (d, d)).astype(np.float32)
        self.head, self.bias = r.normal(0, 0.05, (d, CLASSES)).astype(np.float32), np.log(prior / prior.sum()).astype(np.float32)
        late = np.arange(WINDOW)[None, :] > np.arange(CONTEXT, WINDOW)[:, None]
        self.mask = np.where(late, np.float32(-1e9), np.float32(0))
        self.scales = np.where(np.arange(3 * d) < d, d**-0.5, 1.0).astype(np.float32)
        self.cells = np.arange(CLASSES * d).reshape(CLASSES, d)
        self.room = np.empty((0, CLASSES), np.float32)

    def forward(self, inputs: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the gradients need; last the hidden values and, without the bias, the logits."""
        d = WIDTH
        x = self.embed.take(inputs, 0)
        x += self.place
        own = x[:, CONTEXT:].reshape(-1, d)
        qkv = (x.reshape(-1, d) @ (self.qkv * self.scales)).reshape(len(inputs), WINDOW, 3 * d)
        q, k, v = qkv[:, CONTEXT:, :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
        weight = q @ k.transpose(0, 2, 1)
        weight += self.mask
        with np.errstate(over="ignore"):
            np.exp(weight, out=weight)
            total = weight.reshape(-1, WINDOW) @ _ONES[:WINDOW]
        if not _held(total):
            weight = q @ k.transpose(0, 2, 1) + self.mask
            weight -= weight.max(-1, keepdims=True)
            np.exp(weight, out=weight)
            total = weight.reshape(-1, WINDOW) @ _ONES[:WINDOW]
        share = (1 / total)[:, None]
        mixed = (weight @ v).reshape(-1, d)
        mixed *= share
        h = mixed @ self.out
        h += own
        # The largest array by far: its memory is used again by the next call.
        if len(self.room) < len(h):
            self.room = np.empty((len(h), CLASSES), np.float32)
        logits = np.matmul(h, self.head, out=self.room[: len(h)])
        return x, own, q, k, v, weight, share, mixed, h, logits

    def base(self) -> tuple[np.ndarray, bool]:
        """The bias as a factor of the classes, and whether float32 holds it well."""
        with np.errstate(over="ignore"):
            base = np.exp(self.bias)
        return base, bool(base.min() > 1e-24 and base.max() < 1e12)

    def exponents(self, h: np.ndarray, logits: np.ndarray, base: np.ndarray, held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | float]:
        """exp of the logits in place, the factors of their classes, the sum of each row so weighted, and what was taken off each row first: nothing.

        Where float32 doesn't hold these well, the factors are 1 and the bias is
        added to the logits, less the most of each row.
        """
        if held:
            with np.errstate(over="ignore"):
                np.exp(logits, out=logits)
                total = logits @ base
            if _held(total):
                return logits, base, total, 0.0
        np.matmul(h, self.head, out=logits)
        logits += self.bias
        most = logits.max(-1)
        logits -= most[:, None]
        np.exp(logits, out=logits)
        return logits, _ONES, logits @ _ONES, most

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the targets; 0 where there is none."""
        out = np.zeros(targets.shape)
        base = self.base()
        for low in range(0, len(inputs), AT_ONCE):
            goal = targets[low : low + AT_ONCE].reshape(-1)
            class_of = np.maximum(goal, 0)
            *_, h, logits = self.forward(inputs[low : low + AT_ONCE])
            picked = logits.ravel()[np.arange(len(goal)) * CLASSES + class_of] + self.bias[class_of]
            _, _, total, less = self.exponents(h, logits, *base)
            out[low : low + AT_ONCE] = np.where(goal >= 0, picked - less - np.log(total), 0.0).reshape(-1, targets.shape[1])
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of the targets."""
        each, base = np.float32(1 / max(1, (targets >= 0).sum())), self.base()
        parts = [self._gradients(inputs[low : low + LEARNT_AT_ONCE], targets[low : low + LEARNT_AT_ONCE], each, *base) for low in range(0, len(inputs), LEARNT_AT_ONCE)]
        return {n: sum(p[n] for p in parts) for n in self.NAMES}

    def _gradients(self, inputs: np.ndarray, targets: np.ndarray, each: np.float32, base: np.ndarray, held: bool) -> dict[str, np.ndarray]:
        """Of the summed loss of the targets times `each`."""
        d = WIDTH
        x, own, q, k, v, weight, share, mixed, h, logits = self.forward(inputs)
        goal = targets.reshape(-1)
        there, goal = goal >= 0, np.maximum(goal, 0).astype(np.intp)
        # The gradient by a logit is wide * base * scale, once the target's share is taken off.
        wide, base, total, _ = self.exponents(h, logits, base, held)
        each_goal, flat = np.arange(0, wide.size, CLASSES) + goal, wide.ravel()
        flat[each_goal] = flat.take(each_goal) - total / base.take(goal)
        scale = there * each / total
        gh = wide @ np.ascontiguousarray((self.head * base).T)
        gh *= scale[:, None]
        # In two halves, as BLAS is quicker on small products.
        halves = (h * scale[:, None]).reshape(2, -1, d).transpose(0, 2, 1) @ wide.reshape(2, -1, CLASSES)
        out = {"head": (halves[0] + halves[1]) * base, "bias": scale @ wide * base, "out": mixed.T @ gh}
        gm = gh @ self.out.T
        gm *= share
        less = (gm * mixed) @ _ONES[:d]
        gm = gm.reshape(q.shape)
        gs = gm @ v.transpose(0, 2, 1)
        gs -= less.reshape(len(inputs), -1, 1)
        gs *= weight
        g = np.empty((len(inputs), WINDOW, 3 * d), np.float32)
        g[:, :CONTEXT, :d] = 0
        np.matmul(gs, k, out=g[:, CONTEXT:, :d])
        np.matmul(gs.transpose(0, 2, 1), q, out=g[..., d : 2 * d])
        np.matmul(weight.transpose(0, 2, 1), gm, out=g[..., 2 * d :])
        g = g.reshape(-1, 3 * d)
        out["qkv"] = x.reshape(-1, d).T @ g * self.scales
        gx = (g @ np.ascontiguousarray((self.qkv * self.scales).T)).reshape(x.shape)
        gx[:, CONTEXT:] += gh.reshape(q.shape)
        out["place"] = gx.sum(0)
        out["embed"] = np.zeros_like(self.embed)
        np.add.at(out["embed"].ravel(), self.cells.take(inputs, 0).ravel(), gx.ravel())
        return out

    def packed(self) -> np.ndarray:
        """All weights as one array."""
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def unpacked(self, weights: np.ndarray, copy: bool = True) -> "Attention":
        """This with those weights; without a copy they stay parts of that (float32) array."""
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, weights[at : at + old.size].reshape(old.shape).astype(np.float32, copy=copy))
            at += old.size
        return self

    def fit(self, inputs: np.ndarray, targets: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 11) -> "Attention":
        """Adam over batches of windows in random order."""
        r = np.random.default_rng(seed)
        order = np.empty(0, np.int64)
        weights = self.packed()
        m, s = np.zeros_like(weights), np.zeros_like(weights)
        self.unpacked(weights, copy=False)
        for step in range(1, steps + 1 if len(inputs) else 1):
            # Without replacement, pass by pass, so that every window takes part.
            if len(order) < min(batch, len(inputs)):
                order = np.concatenate([order, r.permutation(len(inputs))])
            some, order = order[:batch], order[batch:]
            found = self.gradients(inputs[some], targets[some])
            g = np.concatenate([found[n].ravel() for n in self.NAMES])
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            weights -= (rate * min(1, 2 - 2 * step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


#: A window as it is stored: its key, and its units from the first input to the last target (17 bits each); BEGIN also where there is none.
_STORED = np.dtype([("key", np.uint64), ("low", np.uint16, WINDOW + 1), ("high", np.uint8, WINDOW // 8 + 1)])


def _unit_windows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, inputs and targets of all windows of rows (key, text); a key depends on the row and the window's place in it."""
    for batch in batches:
        for part in slices(batch, "text", 1_000_000):
            data, offsets = utf8(part.column(1))
            ids, firsts, _ = vocabulary.units(data, *hashed_words(data, offsets, IS_WORD))
            keys = np.asarray(part.column(0)).view(np.uint64)
            first = np.concatenate([[0], np.cumsum(-(-np.diff(firsts) // (WINDOW - CONTEXT)))])
            for low in range(0, n_windows(firsts), 16 * TOGETHER):
                inputs, targets, owner = windows(ids, firsts, low, low + 16 * TOGETHER)
                place = np.arange(low, low + len(owner)) - first[owner]
                yield mix(keys[owner] + mix(place.astype(np.uint64) + np.uint64(1))), inputs, targets


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    key = F.xxhash64(*[F.col(c) for c in ("doc_id", text) if c in docs.columns])
    return docs.select(key.alias("key"), F.col(text).alias("text"))


def _training_windows(docs: DataFrame, text: str, vocabulary: Vocabulary, shards: int) -> DataFrame:
    """(shard, windows): all windows of all rows by unit, dealt into shards by a hash of the row and the window's place; a row holds many."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, inputs, targets in _unit_windows(batches, shared.value):
            stored, units = np.empty(len(key), _STORED), np.empty((len(key), WINDOW + 1), np.int32)
            units[:, : CONTEXT + 1], units[:, CONTEXT + 1 :] = inputs[:, : CONTEXT + 1], np.maximum(targets, BEGIN)
            stored["key"], stored["low"], stored["high"] = mix(key), units & 0xFFFF, np.packbits(units > 0xFFFF, axis=1)
            shard = (stored["key"] % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            used, at = np.unique(shard[order], return_index=True)
            held = [x.tobytes() for x in np.split(stored[order], at[1:])] if len(used) else []
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held, pa.binary())], names=["shard", "windows"])

    return _keyed(docs, text).mapInArrow(dealt, "shard int, windows binary")


def _unpacked_windows(rows: pa.Table | pa.RecordBatch, cls: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets in the order of their keys, by unit or by class; a target of -1 is none."""
    stored = np.frombuffer(b"".join(rows.column("windows").to_pylist()), _STORED)
    stored = stored[np.argsort(stored["key"], kind="stable")]
    units = stored["low"].astype(np.int32)
    units += np.unpackbits(stored["high"], axis=1, count=WINDOW + 1) * np.int32(1 << 16)
    inputs, targets = units[:, :WINDOW], units[:, CONTEXT + 1 :]
    # After an END there is nothing, and before a text only inputs are BEGIN.
    inputs, none = np.where(inputs == END, BEGIN, inputs), targets == BEGIN
    if cls is not None:
        inputs, targets = cls.take(inputs), cls.take(targets)
    return inputs, np.where(none, -1, targets)


def _grouped(stored: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The class of each unit: units that stand beside the same common units share one.

    All stored windows are counted. What is counted has at most 2 * BESIDE rows
    for each unit of the vocabulary.
    """
    places_of = len(vocabulary.counts) * 2 * BESIDE

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(places_of, np.int64)
        for batch in batches:
            for part in slices(batch, "windows"):
                inputs, targets = _unpacked_windows(part)
                last, following = inputs[:, CONTEXT:], np.concatenate([targets[:, 1:], np.full((len(targets), 1), -1)], 1)
                for other, shift in ((last, 0), (following, BESIDE)):
                    hit = (targets >= SPECIAL + SINGLE) & (other >= SPECIAL) & (other < SPECIAL + BESIDE)
                    places, n = np.unique(targets[hit].astype(np.int64) * (2 * BESIDE) + other[hit] - SPECIAL + shift, return_counts=True)
                    counts[places] += n
        places = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts[places])], names=["place", "n"])

    got = stored.select("windows").mapInArrow(beside, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    n_units = len(vocabulary.counts)
    cls = np.where(np.arange(n_units) < SPECIAL + SINGLE, np.arange(n_units), 0)
    x = np.zeros(n_units * 2 * BESIDE, np.float32)
    x[got.column("place").to_numpy()] = got.column("n").to_numpy()
    x = x.reshape(n_units, 2 * BESIDE)[SPECIAL + SINGLE :]
    if not len(x):
        return cls
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    weight = vocabulary.counts[SPECIAL + SINGLE :]
    centres = x[np.linspace(0, min(len(x), 4_096) - 1, SHARED).astype(int)] + 1e-6
    for _ in range(GROUPING):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for k in range(2 * BESIDE):
            centres[:, k] = np.bincount(near, weight * x[:, k], SHARED) / np.maximum(np.bincount(near, weight, SHARED), 1e-9)
    cls[SPECIAL + SINGLE :] = SPECIAL + SINGLE + near
    return cls


def learned(docs: DataFrame, text: str, vocabulary: Vocabulary, about: float) -> Attention:
    """The attention model of all windows of all rows, about so many; it also groups the vocabulary's units.

    The first shard gives the weights to begin with; in each round every shard
    then trains a copy on all of its windows, and the copies are averaged.
    """
    shards = int(min(MOST_SHARDS, max(1, -(-about // SHARD))))
    stored = materialise(_training_windows(docs, text, vocabulary, shards), "windows")
    vocabulary.group(_grouped(stored, vocabulary))
    prior, cls = vocabulary.prior, vocabulary.cls.astype(np.int8)
    attention = Attention(prior)

    def averaged(rows: DataFrame, weights: np.ndarray, steps: int | None, rate: float, seed: int) -> None:
        """The mean of the copies that the shards of some rows train from these weights, by their windows."""

        def trained(one: pa.Table) -> pa.Table:
            inputs, targets = _unpacked_windows(one, cls)
            own = Attention(prior).unpacked(weights).fit(inputs, targets, -(-len(inputs) // BATCH) if steps is None else steps, rate=rate, seed=seed)
            return pa.table({"shard": one.column("shard").slice(0, 1), "n": pa.array([len(inputs)], pa.int64()), "weights": pa.array([own.packed().astype(np.float32).tobytes()], pa.binary())})

        found = sorted(rows.groupBy("shard").applyInArrow(trained, "shard int, n long, weights binary").collect())
        if found:
            total = sum(r["n"] * np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in found)
            attention.unpacked(total / sum(r["n"] for r in found))

    averaged(stored.where("shard = 0"), attention.packed(), STEPS, 0.01, 11)
    for turn in range(ROUNDS):
        averaged(stored, attention.packed(), None, RATE, 100 + turn)
    return attention


def train(docs: DataFrame, text: str = "text") -> dict:
    """The model of a corpus: word counts (a DataFrame and the frequent ones), N, V, vocabulary and attention."""
    counts = materialise(counted_corpus(docs, text), "counts")
    words = counts.where("kind = 0").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    end = int(np.array([END_HASH]).view(np.int64)[0])
    n_texts = words.where(F.col("key") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    keys, n = most_frequent(words, FREQUENT)
    order = np.argsort(keys.view(np.uint64), kind="stable")
    # A word seen once is left to the subwords, so that the model meets words outside the vocabulary as often as it will later.
    own = (keys != end) & (n > 1)
    vocabulary = Vocabulary((keys[own][:WORDS], n[own][:WORDS]), most_frequent(counts.where("kind = 1").select("key", "n"), PIECES), total["n"] - n_texts, n_texts)
    attention = learned(docs, text, vocabulary, total["n"] / (WINDOW - CONTEXT) + n_texts)
    return {"words": words, "N": int(total["n"]), "V": int(total["v"]), "keys": keys.view(np.uint64)[order], "counts": n.astype(np.int64)[order], "vocabulary": vocabulary, "attention": attention}


def text_scores(data: np.ndarray, hashed: tuple[np.ndarray, ...], vocabulary: Vocabulary, attention: Attention) -> np.ndarray:
    """The model's log10 probability of each text, given as bytes and their `hashed_words`; a long one is worked through TOGETHER windows at a time."""
    ids, firsts, unknown = vocabulary.units(data, *hashed)
    n = len(firsts) - 1
    total = np.add.reduceat(vocabulary.inside_classes(ids, unknown), firsts[:-1]) if n else np.zeros(0)
    cls = vocabulary.cls[ids]
    for low in range(0, n_windows(firsts), TOGETHER):
        inputs, targets, owner = windows(cls, firsts, low, low + TOGETHER)
        total += np.bincount(owner, attention.log_probs(inputs, targets).sum(-1, dtype=np.float64), n) / np.log(10.0)
    return total


def score(docs: DataFrame, model: dict, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts count as empty: their one token is the end. Repeated rows are
    scored each. With no training rows every probability is the smoothed or
    spelled one. Other columns are not read.
    """
    spark = docs.sparkSession
    logs_of = np.log10((model["counts"] + 1.0) / (model["N"] + model["V"] + 1.0))
    shared = spark.sparkContext.broadcast((Places(model["keys"]), logs_of, model["vocabulary"], model["attention"]))
    dtype = docs.schema[doc_id].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, logs_of, vocabulary, attention = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                data, offsets = utf8(part.column(2))
                hashed = hashed_words(data, offsets, IS_WORD)
                total = text_scores(data, hashed, vocabulary, attention)
                words, marks = np.insert(hashed[0], hashed[1][1:], END_HASH), hashed[1] + np.arange(len(offsets))
                at, found = places.find(words)
                logs = np.zeros(len(words))
                logs[found] = logs_of[at[found]]
                run, seen = np.concatenate([[0.0], np.cumsum(logs)]), np.concatenate([[0], np.cumsum(found)])
                missing = np.concatenate([[0], np.cumsum(~found)])[marks]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(marks)),
                        pa.array((seen[marks[1:]] - seen[marks[:-1]]).astype(np.int64)),
                        pa.array(run[marks[1:]] - run[marks[:-1]]),
                        pa.array(total),
                        pa.ListArray.from_arrays(pa.array(missing, pa.int32()), pa.array(words[~found].view(np.int64))),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "missing"],
                )
                row += n

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    schema = f"row long, doc_id {dtype}, held_out boolean, n_tokens long, n_known long, base double, score double, missing array<long>"
    first = materialise(rows.mapInArrow(scored, schema), "scores")
    unseen = float(np.log10(1.0 / (model["N"] + model["V"] + 1.0)))
    rare = first.select("row", F.explode("missing").alias("key")).join(model["words"], "key", "left")
    by_row = rare.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.coalesce(F.log10(F.col("n") + 1.0), F.lit(0.0)) + unseen).alias("rest"))
    return first.drop("missing").join(by_row, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model["N"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
