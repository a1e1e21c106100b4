"""Selections under quotas: source catalogues, balanced corpora, packs of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The most rows of a source catalogue, and of a table of class counts, that one task looks at.
CATALOGUE = 100_000


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def quota_select(sources: DataFrame, limit: int, quotas: dict[str, int], name_cap: int = 0) -> DataFrame:
    """Sources of a catalogue (position, name, url, query, cls, groups) that fill minimum quotas first, then one of each class, then classes and names by turns.

    At most `name_cap` (0: any number) of a name; equal (name, url, query) count
    once. A greedy choice in catalogue order; the catalogue may have CATALOGUE rows.
    Adds `pick`, from 1.
    """
    spark = sources.sparkSession
    rows = sorted((r.asDict() for r in sources.limit(CATALOGUE + 1).collect()), key=lambda r: r["position"])
    if len(rows) > CATALOGUE:
        raise ValueError(f"a catalogue has at most {CATALOGUE} sources")
    limit = limit or len(rows)
    picked: list[dict] = []
    keys: set[tuple] = set()
    names: dict[str, int] = {}

    def take(row: dict) -> bool:
        key = (row["name"] or "", row["url"] or "", row["query"] or "")
        if len(picked) >= limit or key in keys or (name_cap and names.get(key[0], 0) >= name_cap):
            return False
        keys.add(key)
        names[key[0]] = names.get(key[0], 0) + 1
        picked.append(row)
        return True

    for group, least in quotas.items():
        have = sum(group in (r["groups"] or ()) for r in picked)
        for row in rows:
            if have >= least:
                break
            have += group in (row["groups"] or ()) and take(row)
    classes = {r["cls"] for r in picked}
    for row in rows:
        if row["cls"] not in classes and take(row):
            classes.add(row["cls"])
    queues: dict[tuple, list[dict]] = {}
    for row in rows:
        queues.setdefault((row["cls"], row["name"]), []).append(row)
    for turn in range(max(map(len, queues.values()), default=0)):
        for queue in queues.values():
            if turn < len(queue):
                take(queue[turn])
    return spark.createDataFrame([(r["position"], i + 1) for i, r in enumerate(picked)], "position long, pick int")


def balanced_targets(counts: dict[str, int], share: float) -> dict[str, int]:
    """The most rows of each class for the largest total of which no class has more than `share`; ties give to the first by name."""
    def filled(total: int) -> int:
        return sum(min(n, int(share * total + 1e-9)) for n in counts.values())

    # The largest total that its shares fill: what a total fills is a bound for the next, from all rows downward.
    low = sum(counts.values())
    while (bound := filled(low)) < low:
        low = bound
    total, out = low, {}
    for name in sorted(counts):
        out[name] = min(counts[name], int(share * low + 1e-9), total)
        total -= out[name]
    return out


def strict_balance(df: DataFrame, cls: str, order: str, share: float) -> DataFrame:
    """The largest selection of rows of which no class has more than `share`, first rows of each class first."""
    counts = {r[0]: r["count"] for r in df.groupBy(cls).count().limit(CATALOGUE + 1).collect() if r[0] is not None}
    if len(counts) > CATALOGUE:
        raise ValueError(f"at most {CATALOGUE} classes can be balanced")
    targets = df.sparkSession.createDataFrame(sorted(balanced_targets(counts, share).items()), f"{cls} string, _most long")
    return ranked(df.join(F.broadcast(targets), cls), cls, [F.col(order)], "_place").where("_place <= _most").drop("_place", "_most")


def diverse(df: DataFrame, cls: str, score: str, key: str, most: int) -> DataFrame:
    """The best row of each class first, then the best of the rest, `most` in all; adds `pick`."""
    df = ranked(df, cls, [F.desc(score), F.col(key)], "_place")
    top = df.withColumn("_later", F.col("_place") > 1).orderBy("_later", F.desc(score), key).limit(most)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("_later", F.desc(score), key))).drop("_place", "_later")
