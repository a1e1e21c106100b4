"""Spans of regular expressions as native column expressions.

A text is cut by a pattern; the lengths of the pieces and of the matches give
each match's place. Nothing leaves the JVM, and rows without a match skip the
work. Places count code points; ends are exclusive. Arrays of m spans are worked
through in slices of about the root of m, so that appending never copies the
whole array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,stop:int,kind:string,value:string,part:string>"
EMPTY = f"cast(array() as array<{SPAN}>)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def chunks(items: Column) -> tuple[Column, Column]:
    """The length of slices of about the root of an array's size, and the numbers of its slices from 0."""
    length = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
    return length, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / length).cast("int"))


def scan(items: Column, state: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, item) for each item in order, the state then being advance(state, item); `kind` is the type of what is emitted."""
    none = f"cast(array() as array<{kind}>)"

    def walked(xs: Column) -> Column:
        length, numbers = chunks(xs)

        def one(acc: Column, i: Column) -> Column:
            begin = F.struct(F.element_at(acc, -1)["s"].alias("s"), F.expr(none).alias("o"))
            step = lambda a, x: F.struct(advance(a["s"], x).alias("s"), F.concat(a["o"], F.array(emit(a["s"], x))).alias("o"))
            return F.concat(acc, F.array(F.aggregate(F.slice(xs, i * length + 1, length), begin, step)))

        whole = F.aggregate(numbers, F.array(F.struct(state.alias("s"), F.expr(none).alias("o"))), one, lambda acc: F.flatten(F.transform(acc, lambda a: a["o"])))
        return F.when(F.size(xs) > 0, whole).otherwise(F.expr(none))

    return bound(items, walked)


def spans(text: Column, pattern: str, kind: str, rank: int, group: int = 0, keep: Callable[[Column], Column] | None = None, context: int | None = None) -> Column:
    """All leftmost non-overlapping matches as structs; `part` is the group's text, or the up to `context` characters between the match before and this one.

    `keep` tells from a span whether it stays; a failing match is dropped and
    not tried again from a later place.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.transform(gaps, lambda p: F.right(p, F.lit(context))) if context else F.transform(values, lambda v: F.lit(""))
    step = F.arrays_zip(F.transform(gaps, lambda p: F.length(p)).alias("gap"), values.alias("value"), part.alias("part"))

    def advance(at: Column, x: Column) -> Column:
        return at + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0))

    def emit(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["value"])).alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"), x["part"].alias("part"))

    stays = (lambda s: s["value"].isNotNull() & keep(s)) if keep is not None else (lambda s: s["value"].isNotNull())
    return F.when(text.rlike(pattern), F.filter(scan(step, F.lit(0), advance, emit, SPAN), stays)).otherwise(F.expr(EMPTY))


def apart(found: Column, known: Column) -> Column:
    """The spans of `found` that overlap none of `known`, in order; one pass forward and one backward over both."""

    def tagged(spans: Column, own: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(int(own)).alias("own"), s["stop"].alias("stop"), s.alias("span"), F.lit(True).alias("free")))

    kind = f"struct<start:int,own:int,stop:int,span:{SPAN},free:boolean>"

    def judged(items: Column, edge: int, advance: Callable, free: Callable) -> Column:
        emit = lambda s, x: F.struct(x["start"].alias("start"), x["own"].alias("own"), x["stop"].alias("stop"), x["span"].alias("span"), (x["free"] & free(s, x)).alias("free"))
        return scan(items, F.lit(edge), lambda s, x: F.when(x["own"] == 0, advance(s, x)).otherwise(s), emit, kind)

    both = F.array_sort(F.concat(tagged(known, False), tagged(found, True)))
    forward = judged(both, -1, lambda s, x: F.greatest(s, x["stop"]), lambda s, x: s <= x["start"])
    backward = judged(F.reverse(forward), 2**31 - 1, lambda s, x: F.least(s, x["start"]), lambda s, x: s >= x["stop"])
    left = F.transform(F.reverse(F.filter(backward, lambda x: (x["own"] == 1) & x["free"])), lambda x: x["span"])
    return F.when(F.size(found) == 0, F.expr(EMPTY)).when(F.size(known) == 0, found).otherwise(left)


def joined(found: Column) -> Column:
    """kind:start:end of every span by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    ascii_zero = 48
    total = F.aggregate(
        F.split(F.reverse(number), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda acc, c: F.struct(
            (acc["i"] + F.when(c == "", 0).otherwise(1)).alias("i"),
            (acc["sum"] + F.when(c == "", 0).when(acc["i"] % 2 == 0, F.ascii(c) - ascii_zero).otherwise((F.ascii(c) - ascii_zero) * 2 - F.when(F.ascii(c) > ascii_zero + 4, 9).otherwise(0))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first is named, and all they cover goes."""
    kind = "struct<since:int,start:int,stop:int,kind:string>"
    # What stays before a span begins where the spans before it end; an overlapping span has no name of its own.
    emit = lambda at, s: F.struct(at.alias("since"), F.greatest(at, s["start"]).alias("start"), F.greatest(at, s["stop"]).alias("stop"), F.when(s["start"] >= at, s["kind"]).alias("kind"))
    cuts = scan(F.array_sort(found), F.lit(0), lambda at, s: F.greatest(at, s["stop"]), emit, kind)

    def assembled(xs: Column) -> Column:
        length, numbers = chunks(xs)

        def piece(i: Column) -> Column:
            """The text of a slice of spans, cut from its own part of the text."""
            def cut(own: Column) -> Column:
                first = own[0]["since"]
                part = F.substring(text, first + 1, F.element_at(own, -1)["start"] - first)
                one = lambda body: F.transform(own, lambda s: F.concat(F.substring(body, s["since"] - first + 1, s["start"] - s["since"]), F.coalesce(F.concat(F.lit("["), s["kind"], F.lit("]")), F.lit(""))))
                return bound(part, lambda body: F.array_join(one(body), ""))

            return bound(F.slice(xs, i * length + 1, length), cut)

        return F.concat(F.array_join(F.transform(numbers, piece), ""), F.substring(text, F.element_at(xs, -1)["stop"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, bound(cuts, assembled)).otherwise(text)
