"""Splits that keep related records together.

Records are linked through shared values of their sources, groups, authors and entities; linked
values are contracted to components by alternating large-star and small-star rounds on a table of
distinct value pairs (grouped, joined and written between rounds: no component is ever one task's
group). Components of equal size and label profile are bundled; a min-cost flow sends the bundles'
records to the splits, where missing or exceeding a quota costs per record; the flow is rounded to
whole components, and a bundle's members are assigned in the order of a hash.

Defined cases: null, blank and stand-in values link nothing; letter case and outer white space do not
matter except in the source; a record delivered again (same table and id) is one record that has the
links of all its rows; a record without any value is a component of its own; empty tables give no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.core.tables import materialise

#: values that say that nothing is known or nobody is named (fixed values)
STAND_INS = ["", "-", "--", "?", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "unk", "undefined", "unnamed", "anonymous", "anon", "nobody", "no one", "not known", "not available", "not applicable", "missing", "tbd", "other", "(none)", "(unknown)", "(anonymous)"]


def _value(c: Column) -> Column:
    """A comparable value: without outer white space, lower case; null where it links nothing."""
    v = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(~v.isin(STAND_INS), v)


def links(examples: DataFrame, name: str) -> DataFrame:
    """(record_table, example_id, kind, value): the linking values of every record."""
    m = F.col("metadata")
    pairs = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")),
        F.struct(F.lit("group").alias("kind"), _value(F.col("split_group_id")).alias("value")),
        F.struct(F.lit("author").alias("kind"), _value(F.try_element_at(m, F.lit("author"))).alias("value")),
        F.struct(F.lit("entity").alias("kind"), _value(F.try_element_at(m, F.lit("entity"))).alias("value")),
    )
    return (
        examples.where(F.col("example_id").isNotNull())
        .select(F.lit(name).alias("record_table"), "example_id", F.filter(pairs, lambda p: p["value"].isNotNull()).alias("values"))
        .select("record_table", "example_id", F.explode_outer("values").alias("v"))
        .select("record_table", "example_id", F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))
        .distinct()
    )


def _node() -> Column:
    """128 bits of a value, its kind included; a record without values is its own node."""
    named = F.concat(F.col("kind"), F.lit("\x00"), F.col("value"))
    alone = F.concat(F.lit("record\x00"), F.col("record_table"), F.lit("\x00"), F.col("example_id"))
    return F.unhex(F.md5(F.coalesce(named, alone)))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component. edges: (a, b), each node in some edge (a = b allowed)."""
    current = materialise(edges.select("a", "b").distinct(), "edges")
    nodes = current.select(F.col("a").alias("node")).union(current.select(F.col("b").alias("node"))).distinct()
    current = current.where("a <> b")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node goes to the smallest of its neighbourhood
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them (edges point from larger to smaller)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = materialise(small, "edges")
        # sums of two hashes: equal sums, equal edges
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return nodes.join(current.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))


def grouped_records(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(record_table, example_id, root) of every record, and the links (with node and root) behind it."""
    found = None
    for name, df in tables.items():
        found = links(df, name) if found is None else found.unionByName(links(df, name))
    linked = materialise(found.withColumn("node", _node()), "links")
    # a star over each record's values: at most four, whatever the record
    first = linked.groupBy("record_table", "example_id").agg(F.array_sort(F.collect_set("node")).alias("n"))
    edges = first.select(F.explode("n").alias("b"), F.col("n")[0].alias("a"))
    roots = components(edges)
    linked = materialise(linked.join(roots, "node"), "roots")
    records = linked.groupBy("record_table", "example_id").agg(F.min("root").alias("root"))
    return records, linked


def mixed_groups(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_table, example_id, group_source): records whose component holds at least two sources."""
    records, linked = grouped_records(tables)
    sources = linked.where("kind = 'source'").groupBy("root").agg(F.min("value").alias("group_source"), F.max("value").alias("_last")).where("group_source <> _last")
    return records.join(sources.drop("_last"), "root").select("record_table", "example_id", "group_source")


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int, amount: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) that sends `amount` at the least cost; successive shortest paths with potentials."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for u, v, c, w in arcs:
        for a, b, room, price in ((u, v, c, w), (v, u, 0, -w)):
            graph[a].append(len(to))
            to.append(b)
            cap.append(room)
            cost.append(price)
    potential = [0.0] * n
    while amount > 0:
        distance, via = [float("inf")] * n, [-1] * n
        distance[source] = 0.0
        queue = [(0.0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            for e in graph[u]:
                nd = d + cost[e] + potential[u] - potential[to[e]]
                if cap[e] > 0 and nd < distance[to[e]] - 1e-12:
                    distance[to[e]], via[to[e]] = nd, e
                    heapq.heappush(queue, (nd, to[e]))
        if distance[sink] == float("inf"):
            raise ValueError("the flow is not feasible")
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance)]
        push, v = amount, sink
        while v != source:
            push, v = min(push, cap[via[v]]), to[via[v] ^ 1]
        v = sink
        while v != source:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
        amount -= push
    return [cap[2 * i + 1] for i in range(len(arcs))]


def allocate(bundles: list[tuple[float, tuple, int]], shares: list[float]) -> list[list[int]]:
    """How many components of each bundle (mean size, label profile, components) go to each split.

    Flow: source -> bundle -> split -> sink in records. A split takes its quota free of charge and more
    at a cost that rises with the excess (twice and further beyond); taking a bundle's label profile
    evenly costs least. The flow is rounded down to whole components; what is left goes, the
    largest components first, where the split lacks most of its quota.
    """
    records = [round(s * n) for s, _, n in bundles]
    total = sum(records)
    quotas = [int(total * x / sum(shares)) for x in shares]
    quotas[quotas.index(max(quotas))] += total - sum(quotas)
    k, b = len(shares), len(bundles)
    even = [[int(n * x / sum(shares)) for x in shares] for _, _, n in bundles]
    source, sink = b + k, b + k + 1
    arcs = []
    for i, (size, _, _) in enumerate(bundles):
        arcs.append((source, i, records[i], 0.0))
        for s in range(k):
            arcs += [(i, b + s, int(even[i][s] * size), 0.0), (i, b + s, records[i], 0.01)]  # off the even share of the profile costs a little
    for s in range(k):
        arcs += [(b + s, sink, quotas[s], 0.0), (b + s, sink, max(1, quotas[s] // 10), 1.0), (b + s, sink, total, 4.0)]
    flow = min_cost_flow(b + k + 2, arcs, source, sink, total) if total else [0] * len(arcs)
    out = []
    for i, (size, _, n) in enumerate(bundles):
        at = i * (1 + 2 * k)
        out.append([min(n, int((flow[at + 1 + 2 * s] + flow[at + 2 + 2 * s]) / size + 1e-9)) for s in range(k)])
    filled = [sum(out[i][s] * bundles[i][0] for i in range(b)) for s in range(k)]
    for i in sorted(range(b), key=lambda i: -bundles[i][0]):
        size, _, n = bundles[i]
        for _ in range(n - sum(out[i])):
            s = max(range(k), key=lambda s: (quotas[s] - filled[s], -s))
            out[i][s] += 1
            filled[s] += size
    # whole components move from a split above its quota to one below while both stay on their side, large ones first
    for i in sorted(range(b), key=lambda i: -bundles[i][0]):
        size = bundles[i][0]
        for x in range(k):
            for y in range(k):
                moved = int(min(out[i][x], max(0, filled[x] - quotas[x]) // size, max(0, quotas[y] - filled[y]) // size))
                out[i][x], out[i][y] = out[i][x] - moved, out[i][y] + moved
                filled[x], filled[y] = filled[x] - moved * size, filled[y] + moved * size
    return out


def assign_splits(tables: dict[str, DataFrame], shares: dict[str, float]) -> DataFrame:
    """(record_table, example_id, group_id, split): every record, whole components to a split.

    Components are bundled by size and label profile: small ones (fewer than 16 records) and giants (at
    least a two-hundredth of all records) by their exact sizes and profiles, those between by size to
    half an octave and profile to an eighth. So at most some hundred bundles, one small row each, go to
    the driver whatever the number of records, and all of them take part in the flow.
    """
    from corpusmill.llm.packing import ranked

    records, _ = grouped_records(tables)
    records = materialise(records, "records")
    names = sorted(tables)
    profile = [f"n{i}" for i in range(len(names))]
    sized = records.groupBy("root").agg(F.count(F.lit(1)).alias("size"), *(F.count_if(F.col("record_table") == n).alias(p) for n, p in zip(names, profile)))
    total = records.count()
    exact = F.concat_ws(":", F.lit("exact"), *profile)
    between = F.concat_ws(":", F.lit("about"), F.floor(2 * F.log2("size")), *(F.floor(8 * F.col(p) / F.col("size")) for p in profile))
    sized = materialise(sized.withColumn("bundle", F.when((F.col("size") < 16) | (F.col("size") * 200 >= F.lit(total)), exact).otherwise(between)), "components")
    rows = sized.groupBy("bundle").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("records")).orderBy("bundle").collect()
    counts = allocate([(r["records"] / r["count"], (r["bundle"],), r["count"]) for r in rows], list(shares.values()))
    bounds = []
    for r, row in zip(rows, counts):
        start = 0
        for split, n in zip(shares, row):
            if n:
                bounds.append((r["bundle"], start, start + n, split))
            start += n
    plan = records.sparkSession.createDataFrame(bounds or [("", 0, 0, "")], "bundle string, lo long, hi long, split string")
    placed = ranked(sized, ["bundle"], ["root"]).join(plan, "bundle").where("rank >= lo and rank < hi")
    return records.join(placed.select("root", "split"), "root").select("record_table", "example_id", F.lower(F.hex("root")).alias("group_id"), "split")
