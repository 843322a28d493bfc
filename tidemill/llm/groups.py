"""Problem 4: related groups of records, and splits that keep each group together.

Related records are found as connected components of a bipartite graph between documents and what they share (prefixes and
authors). Every round, each document takes the best (by a hash) of all documents that it shares
anything with, and the graph is contracted; a shared thing with one document left has no more to join and is dropped. The
graph shrinks by a constant factor a round, so there are O(log n) rounds; each is written to the checkpoint folder. A
thing that a large part of all rows share is a plain partial aggregation and, on the way back, a broadcast of its one row:
at most rows / HOT things can be that hot, which bounds the broadcast.

Splits are made by grouped iterative stratification. Components are placed whole, by their real label vectors; those with the
same vector are dealt together, by count, as the one-by-one rule would deal them: the rarest outstanding label first, its
largest components first, each to the split that needs that label most. Only distinct vectors reach the task that places them,
never components. Beyond `most_vectors` distinct ones, they are placed in that many independent groups, each in the given
proportions. A label vector must fit in a row. Which components of a vector go to which split is a rank by a hash, counted over
hash ranges so that no vector's components are gathered in one task.

Defined results: null keys relate nothing; a record with a null prefix is a group of its own; a prefix without documents is
one too, with all records of it; repeated rows change nothing; empty tables give empty results; null labels are a label.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut

HOT = 100_000
RANGES = 256


def split_name(c: Column) -> Column:
    """Split names in lower case, without outer blanks, the short form written out."""
    name = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(name.isin("val", "valid", "dev"), "validation").otherwise(name)


def join_unique(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", most: int | None = None, hot: int = HOT) -> DataFrame:
    """rows join one, which has one row per key; keys with over `hot` rows are joined by broadcast, without a shuffle.

    most: the largest number of rows of a key, if it is known; it is counted here if not. Without hot keys, which is the
    usual case, it is a plain join.
    """
    counts = None
    if most is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("_rows")).where((F.col("_rows") > hot) & F.col(key).isNotNull()).select(key)
        keys = counts.limit(1).count()
        most = hot + 1 if keys else 0
    if most <= hot:
        return rows.join(one, key, how).select(*rows.columns, *[c for c in one.columns if c != key])
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot).select(key)
    marked = one.join(F.broadcast(counts), key, "left_semi").withColumn("_hot", F.lit(True))
    new = [c for c in one.columns if c != key]
    first = rows.join(F.broadcast(marked), key, "left")
    hot_rows = first.where("_hot").drop("_hot")
    cold_rows = first.where("_hot is null").drop("_hot", *new).join(one, key, how)
    return hot_rows.select(*rows.columns, *new).unionByName(cold_rows.select(*rows.columns, *new))


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 80) -> DataFrame:
    """(left, component) of a bipartite graph: the component is one of its left nodes. Null ends are left out."""
    edges = cut(edges.select(F.col(left).cast("string").alias("d"), F.col(right).cast("string").alias("x")).where("d is not null and x is not null").distinct())
    nodes, steps = edges.select("d").distinct(), []
    for _ in range(max_rounds):
        # What only one document has joins nothing any more.
        live = cut(edges.groupBy("x").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("d").alias("h"), "d")).alias("best")).where("n > 1"))
        most = live.agg(F.max("n")).collect()[0][0]
        if most is None:
            break
        joined = join_unique(edges, live.select("x", "best"), "x", most=most)
        step = cut(joined.groupBy("d").agg(F.min("best").getField("d").alias("to")))
        steps.append(step)
        rest = join_unique(joined.select("d", "x"), step, "d", most=None)
        edges = cut(rest.select(F.col("to").alias("d"), "x").distinct())
    else:
        raise RuntimeError("components did not converge")
    out = None
    for step in reversed(steps):  # from the last contraction back to the first
        if out is not None:
            further = out.select(F.col("d").alias("to"), F.col("root").alias("further"))
            step = cut(join_unique(step, further, "to", "left").select("d", F.coalesce("further", "to").alias("to")))
        out = step.select("d", F.col("to").alias("root"))
    if out is None:
        return nodes.select(F.col("d").alias(left), F.col("d").alias("component"))
    return nodes.join(out, "d", "left").select(F.col("d").alias(left), F.coalesce("root", "d").alias("component"))


def _key(c: Column) -> Column:
    """Author names without outer blanks and case; blank ones relate nothing."""
    v = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.length(v) > 0, v)


def prefix_groups(prefixes: DataFrame, documents: DataFrame, prefix: str = "prefix_id", document: str = "document_id", authors: tuple[str, ...] = ("author_id", "co_author_id")) -> DataFrame:
    """(prefix_id, component): prefixes related through their documents and the documents' authors."""
    of = prefixes.select(F.col(prefix).cast("string").alias("p"), F.col(document).cast("string").alias("d")).where("p is not null").distinct()
    by = documents.select(F.col(document).cast("string").alias("d"), F.explode(F.array(*[_key(F.col(a)) for a in authors])).alias("a")).where("d is not null and a is not null")
    edges = of.where("d is not null").select("d", F.concat(F.lit("p:"), "p").alias("x")).unionByName(by.select("d", F.concat(F.lit("a:"), "a").alias("x")))
    groups = components(edges, "d", "x").withColumnRenamed("component", "c")
    known = join_unique(of.where("d is not null"), groups, "d")
    # All documents of a prefix are in one component.
    return of.select("p").distinct().join(known.groupBy("p").agg(F.min("c").alias("c")), "p", "left").select(F.col("p").alias(prefix), F.coalesce(F.concat(F.lit("d:"), "c"), F.concat(F.lit("p:"), "p")).alias("component"))


def grouped(records: DataFrame, groups: DataFrame, key: str, prefix: str) -> DataFrame:
    """The records, with the component of their prefix; those without one are components of their own."""
    rows = records.withColumn(prefix, F.col(prefix).cast("string"))
    out = join_unique(rows.where(F.col(prefix).isNotNull()), groups, prefix, "left").unionByName(rows.where(F.col(prefix).isNull()).withColumn("component", F.lit(None).cast("string")))
    alone = F.when(F.col(prefix).isNull(), F.concat(F.lit("r:"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("p:"), F.col(prefix)))
    return out.withColumn("component", F.coalesce("component", alone))


def leaking(records: DataFrame, splits: DataFrame, prefixes: DataFrame, documents: DataFrame, key: str = "record_id", prefix: str = "prefix_id", split: str = "split") -> DataFrame:
    """Records of validation or test whose related group also has a train record, with the group."""
    groups = cut(prefix_groups(prefixes, documents, prefix))
    named = splits.select(key, split_name(F.col(split)).alias("_split")).where(F.col("_split").isin("train", "validation", "test")).distinct()
    rows = cut(grouped(records.select(key, prefix).distinct().join(named, key), groups, key, prefix))
    trained = rows.where("_split = 'train'").select("component").distinct()
    sides = rows.where("_split <> 'train'")
    return join_unique(sides, trained, "component").select(key, F.col("_split").alias(split), "component")


UNIT = 1_000_000  # needs are counted in millionths of a row, so that they are whole numbers and ties are ties


def deal(needs: list[int], rooms: list[int], n: int, size: int, copies: int) -> list[int]:
    """How many of `copies` components with n rows of the label and `size` in all each split gets, if one by one goes where the need is greatest."""
    out, step = [0] * len(needs), n * UNIT
    if copies > 64:  # all values above a threshold are taken before any below it
        low, high = min(needs) - step * (copies + 1), max(needs)
        while high - low > 1:
            middle = (low + high) // 2
            if sum(max(0, -(-(x - middle) // step)) for x in needs) <= copies:
                high = middle
            else:
                low = middle
        out = [max(0, -(-(x - high) // step)) for x in needs]
    for _ in range(copies - sum(out)):
        k = max(range(len(needs)), key=lambda s: (needs[s] - step * out[s], rooms[s] - size * UNIT * out[s], -s))
        out[k] += 1
    return out


def place(units: list[tuple[str, dict, int]], ratios: dict[str, float]) -> dict[str, list[int]]:
    """Iterative stratification of vectors (id, {label: rows}, components with it): of each, how many go to each split; deterministic."""
    left: dict = defaultdict(int)
    for _, labels, copies in units:
        for label, n in labels.items():
            left[label] += n * copies
    share = sum(ratios.values()) or 1.0
    names = list(ratios)
    need = {label: [n * round(ratios[s] / share * UNIT) for s in names] for label, n in left.items()}
    room = [sum(need[label][k] for label in need) for k in range(len(names))]
    by_label = defaultdict(list)
    for i, (_, labels, _) in enumerate(units):
        for label in labels:
            by_label[label].append(i)
    placed: dict[str, list[int]] = {}
    heap = [(n, str(label), label) for label, n in left.items()]
    heapq.heapify(heap)
    while heap:
        n, _, label = heapq.heappop(heap)
        if n != left[label] or not n:  # less is outstanding by now
            continue
        changed = set()
        for i in sorted(by_label[label], key=lambda i: (-units[i][1][label], units[i][0])):
            name, labels, copies = units[i]
            if name in placed:
                continue
            size = sum(labels.values())
            placed[name] = got = deal(need[label], room, labels[label], size, copies)
            for x, m in labels.items():
                left[x] -= m * copies
                changed.add(x)
                for k, c in enumerate(got):
                    need[x][k] -= m * c * UNIT
            for k, c in enumerate(got):
                room[k] -= size * c * UNIT
        for x in changed:
            heapq.heappush(heap, (left[x], str(x), x))
    return placed


def ranked(rows: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """rows with `rank`, their place from 0 among those with the same `by`, in the order of a hash: counted over RANGES ranges."""
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), key)).withColumn("_range", F.pmod(F.shiftrightunsigned("_hash", 40), F.lit(RANGES)))
    sizes = rows.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select(by, "_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_range").orderBy("_hash", key)))
    return inside.join(before, [by, "_range"]).withColumn("rank", F.col("_before") + F.col("_place") - 1).drop("_hash", "_range", "_before", "_place")


def stratified_splits(rows: DataFrame, key: str, label: str, ratios: dict[str, float], seed: int = 42, most_vectors: int = 200_000) -> DataFrame:
    """rows: key, component, label. Each row with its split; the rows of a component share one."""
    rows = rows.select(key, "component", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    counts = rows.groupBy("component", "label").agg(F.count("*").alias("n"))
    vectors = counts.groupBy("component").agg(F.to_json(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("vector"))
    vectors = cut(vectors.withColumn("kind", F.md5("vector")))
    kinds = cut(vectors.groupBy("kind").agg(F.min("vector").alias("vector"), F.count("*").alias("copies")))
    groups = max(1, -(-kinds.count() // most_vectors))
    names = list(ratios)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        units = [(k, {x["label"]: x["n"] for x in json.loads(v)}, int(c)) for k, v, c in sorted(zip(part["kind"], part["vector"], part["copies"]))]
        out: dict[str, list] = {"kind": [], "split": [], "first": [], "last": []}
        for kind, dealt in place(units, ratios).items():
            start = 0
            for s, c in zip(names, dealt):
                if c:
                    for name, v in zip(out, (kind, s, start, start + c - 1)):
                        out[name].append(v)
                    start += c
        return pd.DataFrame(out)

    ranges = cut(kinds.groupBy(F.pmod(F.xxhash64("kind"), F.lit(groups)).alias("part")).applyInPandas(run, "kind string, split string, first bigint, last bigint"))
    several = ranges.groupBy("kind").agg(F.collect_list(F.struct("split", "first", "last")).alias("dealt"))
    chosen = join_unique(ranked(vectors.select("component", "kind"), "kind", "component", seed), several, "kind")
    chosen = cut(chosen.select("component", F.expr("filter(dealt, x -> rank between x.first and x.last)[0].split").alias("split")))
    return join_unique(rows.select(key, "component"), chosen, "component").select(key, "component", "split")
