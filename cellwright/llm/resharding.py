"""Resharding by minimum-cost flow.

Old shards hold known numbers of bytes, new shards get capacities; a transfer costs its bytes unless source and target are
the same shard. The cheapest flow is found by successive shortest paths on the graph of shards (its size is the number of
shards, not of documents) and then carried out: within an old shard documents stand in hash order, and consecutive runs of
bytes go where the flow says, what stays first. Documents aren't cut, so a run ends at the nearest document.

An old shard may be any part of the data: its order is summed by slices of about SLICE documents, and only the
documents of one slice are ever sorted together; slots of new shards are numbered the same way. `rewrite` takes shard and slot to
where a row is read, by its place, and shuffles the texts once, to the shards' files.

Defined cases. Null text: size 8, crc 0. Null old shard: counts as shard 0. Null doc_id and repeated rows: placed like any others, rows in
any order among equals. Empty table: empty result. Other columns are ignored."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, new_folder
from .places import at_rest, place, tagged

SHARDS, OLD, SLICE = 24, 16, 2048


def cheapest_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """(old, new) to bytes, moving all supply into the capacities at the least bytes moved; shard i stays where it is for nothing.

    Successive shortest paths with potentials. Old and new shards are nodes, each old one is joined to each new one."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than the old ones")
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    cost = lambda i, j: int(i != j)
    price = [0] * (n + m)
    while any(left):
        far, back, heap = [float("inf")] * (n + m), [-1] * (n + m), []
        for i in range(n):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            if u < n:
                steps = [(n + j, cost(u, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n))]
            for v, c in steps:
                e = d + c + price[u] - price[v]
                if e < far[v]:
                    far[v], back[v] = e, u
                    heapq.heappush(heap, (e, v))
        ends = [j for j in range(m) if room[j] and far[n + j] < float("inf")]
        j = min(ends, key=lambda j: (far[n + j] + price[n + j], j))
        path, v = [], n + j
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        much = min([left[v], room[j], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + much
            else:
                flow[b, a - n] -= much
        left[v] -= much
        room[j] -= much
        most = max((x for x in far if x < float("inf")), default=0)
        price = [p + min(x, most) for p, x in zip(price, far)]
    return {k: x for k, x in flow.items() if x}


def old_shard(old: int = OLD, id_col: str = "doc_id") -> Column:
    """The layout to start from where none is given: crc32 of the id as text, modulo `old`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % old, F.lit(0)).cast("int")


def reshard(docs: DataFrame, shards: int = SHARDS, old: Column | None = None, capacities: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes plus 8), text_crc32, old_shard, shard, slot (gapless from 0 in its shard).

    capacities: the shares of the new shards, by default all alike."""
    return planned(at_rest(docs), shards, old, capacities, id_col, text_col).drop("file", "row")


def planned(docs: DataFrame, shards: int, old: Column | None, capacities: list[float] | None, id_col: str, text_col: str) -> DataFrame:
    """`reshard` of a table at rest, with the rows' places (file, row)."""
    data = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *place(docs), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.coalesce(old if old is not None else old_shard(id_col=id_col), F.lit(0)).cast("int").alias("old_shard"))
    rows = cut(rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")), "rows")
    sums = {r[0]: (r[1], r[2]) for r in rows.groupBy("old_shard").agg(F.sum("size"), F.count("*")).collect()}  # one row per old shard
    if not sums:
        return rows.select("doc_id", "file", "row", "size", "text_crc32", "old_shard", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    supply = [sums.get(i, (0, 0))[0] for i in range(max(sums) + 1)]
    share = capacities or [1.0] * shards
    total = sum(supply)
    edges = [0, *(round(total * sum(share[: j + 1]) / sum(share)) for j in range(shards))]
    flow = cheapest_flow(supply, [b - a for a, b in zip(edges, edges[1:])])

    # Runs of bytes in each old shard, what stays first.
    runs, spark = [], docs.sparkSession
    for i in range(len(supply)):
        begin = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            runs.append((i, begin, begin + flow[i, j], j))
            begin += flow[i, j]
    ends = F.create_map(*[x for i in range(len(supply)) for x in (F.lit(i), F.array(*[F.struct(F.lit(e).cast("long").alias("e"), F.lit(j).alias("j")) for a, _, e, j in runs if a == i] or [F.struct(F.lit(1).cast("long").alias("e"), F.lit(0).alias("j"))]))])

    rows = _placed(rows, "old_shard", "h", {i: n for i, (_, n) in sums.items()}, F.col("size"), "at")
    middle = F.col("at") + F.col("size") / 2
    # The runs of an old shard are a literal array of at most `shards` ends.
    mine = F.element_at(ends, F.col("old_shard"))
    shard = F.coalesce(F.element_at(F.filter(mine, lambda x: middle < x["e"]), 1)["j"], F.element_at(mine, -1)["j"])
    rows = cut(rows.select("doc_id", "file", "row", "size", "text_crc32", "old_shard", "h", shard.alias("shard")), "assigned")
    counts = {r[0]: r[1] for r in rows.groupBy("shard").count().collect()}  # one row per new shard
    rows = _placed(rows, "shard", "h", counts, F.lit(1), "slot")
    return rows.select("doc_id", "file", "row", "size", "text_crc32", "old_shard", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def _placed(rows: DataFrame, group: str, order: str, counts: dict[int, int], weight: Column, name: str) -> DataFrame:
    """rows with the sum of the weights before each in its group's order. The order is a uniform hash, so slices of equal hash ranges have about SLICE rows."""
    slices = F.create_map(*[x for g, n in counts.items() for x in (F.lit(g), F.lit(max(1, n // SLICE)))])
    rows = rows.withColumn("slice", F.floor((F.col(order) / float(1 << 64) + 0.5) * F.element_at(slices, F.col(group))))
    sums = rows.groupBy(group, "slice").agg(F.sum(weight).alias("w"))
    before = F.sum("w").over(Window.partitionBy(group).orderBy("slice")) - F.col("w")
    sums = sums.select(group, "slice", before.alias("before"))
    inner = F.sum(weight).over(Window.partitionBy(group, "slice").orderBy(order, "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - weight
    return rows.withColumn("inner", inner).join(sums, [group, "slice"]).withColumn(name, F.col("before") + F.col("inner")).drop("slice", "inner", "before")


def rewrite(docs: DataFrame, path: str | None = None, shards: int = SHARDS, old: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[int]]:
    """Write the affected shards, those that lose or gain rows, whole and in the order of their slots; return the folder and their numbers.

    A shard's files are under path/to_shard=N and hold all columns of docs and to_slot (with an underscore more where docs has such a
    column). Shards that keep exactly their old rows are left alone."""
    docs = at_rest(docs)
    path = path or new_folder(docs.sparkSession, "shards")
    plan = cut(planned(docs, shards, old, None, id_col, text_col), "plan")
    return path, carried_out(docs, plan, path)


def free_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns for shard and slot that docs hasn't got."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in ("to_shard", "to_slot"):
        while name in taken:
            name += "_"
        out.append(name)
    return out[0], out[1]


def carried_out(docs: DataFrame, plan: DataFrame, path: str) -> list[int]:
    """Write the affected shards of a plan for docs (at rest); return their numbers."""
    moved = plan.where("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    known = {r[0] for r in plan.select("shard").distinct().collect()}  # one row per shard
    affected = sorted({r[0] for r in moved.collect()} & known)
    if affected:
        shard, slot = free_names(docs)
        places = plan.where(F.col("shard").isin(affected)).select("file", "row", F.col("shard").cast("long").alias(shard), F.col("slot").alias(slot))
        out = tagged(docs, places, (shard, slot))
        # By ranges of shard and slot, so a large shard is written by several tasks.
        out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return affected
