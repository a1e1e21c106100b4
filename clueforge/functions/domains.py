"""Registered domains and denied hosts by a trie of domain suffixes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of the rules that are broadcast at most; their trie is some 50 times larger in each worker.
MOST_BYTES = 8_000_000

#: Bare public suffixes, and the suffixes of public bodies, whose hosts name no one.
PUBLIC = "com cn net org gov edu co io me top xyz info cc biz com.cn net.cn org.cn gov.cn edu.cn co.uk".split()
PUBLIC_BODIES = "gov.cn edu.cn gov edu ac.cn".split()

_SUFFIX, _DENIED = 1, 2


def suffix_trie(public: Iterable[str], denied: Iterable[str]) -> dict:
    """Labels from the right; the key "" holds what a node is."""
    root: dict = {}
    for mark, rules in ((_SUFFIX, public), (_DENIED, denied)):
        for rule in rules:
            node = root
            for label in reversed(rule.strip().lower().strip(".").split(".")):
                node = node.setdefault(label, {})
            node[""] = node.get("", 0) | mark
    return root


def registered(host: str | None, trie: dict) -> str | None:
    """The label before the longest public suffix, with it; none for a denied host, a bare suffix, or a host without a dot."""
    text = (host or "").strip().lower().strip(".").removeprefix("www.")
    labels = text.split(".")
    if len(labels) < 2 or not all(labels):
        return None
    node, suffix = trie, 0
    for depth, label in enumerate(reversed(labels), 1):
        node = node.get(label)
        if node is None:
            break
        mark = node.get("", 0)
        if mark & _DENIED:
            return None
        if mark & _SUFFIX:
            suffix = depth
    # Of a host under no known suffix, the last label is one.
    taken = max(suffix, 1) + 1
    return None if taken > len(labels) else ".".join(labels[-taken:])


_built: list = [None, None]


def domain_matcher(spark: SparkSession, public: Iterable[str] = PUBLIC, denied: Iterable[str] = ()) -> Callable[[Column], Column]:
    """A function of a host column: its registered domain, or null where it has none or is denied.

    A denied domain denies all hosts under it; those of public bodies always are.
    Both lists are broadcast within MOST_BYTES; a host costs a step for each label,
    however many rules there are.
    """
    rules = (tuple(dict.fromkeys(public)), (*dict.fromkeys(denied), *PUBLIC_BODIES))
    size = sum(len(r.encode()) for part in rules for r in part)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of domain rules are more than the {MOST_BYTES} that may be broadcast")
    sent = spark.sparkContext.broadcast(rules)

    @F.pandas_udf("string")
    def found(hosts: pd.Series) -> pd.Series:
        if _built[0] != sent.value:
            _built[:] = sent.value, suffix_trie(*sent.value)
        return pd.Series([registered(h, _built[1]) for h in hosts], dtype=object)

    return found


def host_of(url: Column) -> Column:
    """The host of an address, written with or without its scheme, defanged or not."""
    text = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(text, r"[/?#].*$", ""), r"^[^@]*@|:[0-9]*$", "")


def shared_domains(rows, matcher: Callable[[Column], Column], least: int = 2):  # noqa: ANN001, ANN201
    """domain, n_sources, n_traces, first_trace of registered domains that `least` sources name. rows: host, source, trace_id."""
    named = rows.select(matcher(F.col("host")).alias("domain"), "source", "trace_id").where("domain is not null")
    per = named.groupBy("domain", "source", "trace_id").agg(F.lit(1).alias("one"))
    return per.groupBy("domain").agg(F.countDistinct("source").alias("n_sources"), F.countDistinct("trace_id").alias("n_traces"), F.min("trace_id").alias("first_trace")).where(F.col("n_sources") >= least)
