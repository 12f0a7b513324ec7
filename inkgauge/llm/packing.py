"""Filling fixed-capacity containers with items (problem 6).

Linear grouping. Items above capacity * SMALL are sorted by size and cut into
GROUPS groups of equal count; each is rounded up to the largest size of its
group. For those few sizes, configurations (how many of each size fit into one
container) are chosen on the driver, from GROUPS numbers a capacity and never
from items. The i-th item of a group takes the i-th slot of its group. Small
items then go, best fit, into what the real sizes left over.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import positions
from ..session import settle

GROUPS = 32
SMALL = 1 / 8
#: Items and open containers that one best-fit task works on, about.
BIN = 40_000


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {group: slots}) that hold all rounded items.

    Each takes the largest size left and fills the rest as full as the sizes
    left allow (a knapsack over whole tokens; over steps of 1/65536 of a larger
    capacity, sizes rounded up), as often as the counts last.
    """
    step = max(1, -(-capacity // 65536))
    sizes, capacity = [-(-s // step) for s in sizes], capacity // step
    left, out = list(counts), []
    while any(left):
        first = max((g for g in range(len(sizes)) if left[g]), key=lambda g: sizes[g])
        room = max(0, capacity - sizes[first])
        by = np.full(room + 1, -1, dtype=np.int32)  # the group that first reached a sum
        reach = np.zeros(room + 1, dtype=bool)
        reach[0] = True
        takes = []
        for g in sorted((g for g in range(len(sizes)) if left[g] - (g == first) > 0), key=lambda g: -sizes[g]):
            for _ in range(min(left[g] - (g == first), room // max(1, sizes[g]))):
                new = np.zeros_like(reach)
                new[sizes[g] :] = reach[: room + 1 - sizes[g]]
                new &= ~reach
                if not new.any():
                    break
                by[new] = len(takes)
                reach |= new
                takes.append(g)
        used, at = {first: 1}, int(np.flatnonzero(reach)[-1])
        while at:
            g = takes[by[at]]
            used[g] = used.get(g, 0) + 1
            at -= sizes[g]
        times = min(left[g] // a for g, a in used.items())
        for g, a in used.items():
            left[g] -= times * a
        out.append((times, used))
    return out


def _slots(per_limit: dict[int, list], capacities: dict[int, int]) -> list[tuple]:
    """(limit_id, grp, start, stop, a, base): which ranks of a group go to which containers."""
    rows = []
    for limit, stats in per_limit.items():
        taken, base = {g: 0 for g, _, _ in stats}, 0
        names = [g for g, _, _ in stats]
        for times, used in configurations([s for _, s, _ in stats], [n for _, _, n in stats], capacities[limit]):
            for i, a in used.items():
                g = names[i]
                rows.append((limit, g, taken[g], taken[g] + times * a, a, base))
                taken[g] += times * a
            base += times
    return rows


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best fit, largest item first, within one bin of open containers and small items."""
    limit, bin_no, capacity = int(pdf["limit_id"].iloc[0]), int(pdf["bin"].iloc[0]), int(pdf["capacity"].iloc[0])
    opened = pdf[pdf["container"].notna()]
    free = sorted(zip(opened["tokens"].astype(int), opened["container"], strict=True))
    items = pdf[pdf["container"].isna()].sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    took, new = [], 0
    for size in items["tokens"].astype(int):
        i = bisect_left(free, (size, ""))
        if i < len(free):
            room, name = free.pop(i)
        else:
            room, name, new = capacity, f"s{bin_no}-{new}", new + 1
        took.append(name)
        if room > size:
            insort(free, (room - size, name))
        elif size == 0:
            insort(free, (room, name))
    out = {"limit_id": np.full(len(took), limit, dtype=np.int32)}
    out |= {c: items[c].to_numpy(dtype=t) for c, t in (("doc_id", np.int64), ("piece", np.int32), ("pieces", np.int32), ("tokens", np.int64))}
    return pd.DataFrame(out | {"container": np.array(took, dtype=object)})


def pieces(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, capacity, doc_id, piece, pieces, tokens): one row per part of a text.

    A token is a byte of the text in UTF-8. A text of more tokens than the
    capacity is cut into full containers and a rest; any other is one piece.
    Null texts and texts without an id are no items, empty ones are items of no tokens. Limits that are
    null or not positive are left out; the limit table is a small parameter
    table (one row per container size) and is read on the driver.
    """
    sized = settle(documents.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.octet_length("text").cast("long").alias("size")))
    caps = [(r["limit_id"], r["capacity_tokens"]) for r in limits.collect() if r["limit_id"] is not None and (r["capacity_tokens"] or 0) > 0]
    if not caps:
        caps, sized = [(0, 1)], sized.limit(0)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in sorted(caps)]))
    rows = sized.withColumn("l", each).select("l.limit_id", "l.capacity", "doc_id", "size")
    rows = rows.withColumn("pieces", F.expr("cast(greatest(1, (size + capacity - 1) div capacity) as int)")).withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    return rows.withColumn("tokens", F.least("capacity", F.col("size") - F.col("piece") * F.col("capacity"))).select("limit_id", "capacity", "doc_id", "piece", "pieces", "tokens")


def pack(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, doc_id, piece, pieces, tokens, container): every piece in a container.

    What reaches the driver follows GROUPS and the number of limits, never the
    data. Containers are named within a limit: f… full pieces, c… configurations,
    s… opened for small items. Equal sizes and repeated texts are spread by
    document, so no size makes a task large.
    """
    rows = settle(pieces(documents, limits))
    spark = documents.sparkSession
    is_large = f"tokens < capacity and tokens > capacity * {SMALL}D"
    is_small = f"tokens < capacity and tokens <= capacity * {SMALL}D"
    full = rows.filter("tokens = capacity").withColumn("container", F.concat(F.lit("f"), "doc_id", F.lit("-"), "piece"))
    large = positions(rows.filter(is_large), ["limit_id"], [F.col("tokens").desc(), F.col("doc_id").asc(), F.col("piece").asc()])
    counts = rows.groupBy("limit_id", "capacity").agg(F.count_if(F.expr(is_large)).alias("large"), F.count_if(F.expr(is_small)).alias("small")).collect()
    n = {r["limit_id"]: r["large"] for r in counts}
    capacities = {r["limit_id"]: r["capacity"] for r in counts}
    grp = F.lit(None).cast("int")
    for limit, m in n.items():
        grp = F.when(F.col("limit_id") == limit, F.expr(f"cast(position * {GROUPS} div {max(m, 1)} as int)")).otherwise(grp)
    large = settle(large.withColumn("grp", grp))
    stats: dict[int, list] = {}
    for r in large.groupBy("limit_id", "grp").agg(F.max("tokens").alias("size"), F.count(F.lit(1)).alias("n"), F.min("position").alias("first")).orderBy("limit_id", "grp").collect():
        stats.setdefault(r["limit_id"], []).append((r["grp"], r["size"], r["n"], r["first"]))
    slots = _slots({k: [x[:3] for x in v] for k, v in stats.items()}, capacities)
    firsts = [(k, x[0], x[3]) for k, v in stats.items() for x in v]
    slots_df = spark.createDataFrame(slots, "limit_id int, grp int, start long, stop long, a long, base long")
    firsts_df = spark.createDataFrame(firsts, "limit_id int, grp int, first long")
    # Both tables follow GROUPS and the number of limits, never the data.
    ranked = large.join(F.broadcast(firsts_df), ["limit_id", "grp"]).withColumn("rank", F.col("position") - F.col("first"))
    seated = ranked.join(F.broadcast(slots_df), ["limit_id", "grp"]).filter("rank >= start and rank < stop")
    seated = settle(seated.withColumn("container", F.expr("concat('c', base + (rank - start) div a)")).select("limit_id", "capacity", "doc_id", "piece", "pieces", "tokens", "container"))

    bins = F.lit(1)
    for r in counts:
        bins = F.when(F.col("limit_id") == r["limit_id"], F.lit(1 + (r["small"] + r["large"]) // BIN)).otherwise(bins)
    room = seated.groupBy("limit_id", "capacity", "container").agg((F.first("capacity") - F.sum("tokens")).alias("tokens")).filter("tokens > 0")
    room = room.select("limit_id", "capacity", F.pmod(F.xxhash64("container"), bins).alias("bin"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("piece"), F.lit(None).cast("int").alias("pieces"), "tokens", "container")
    small = rows.filter(is_small).select("limit_id", "capacity", F.pmod(F.xxhash64("doc_id", "piece"), bins).alias("bin"), "doc_id", "piece", "pieces", "tokens", F.lit(None).cast("string").alias("container"))
    out = "limit_id int, doc_id long, piece int, pieces int, tokens long, container string"
    filled = room.unionByName(small).groupBy("limit_id", "bin").applyInPandas(_fill, out)
    names = [x.split()[0] for x in out.split(", ")]
    return full.select(*names).unionByName(seated.select(*names)).unionByName(filled.select(*names))


def cut_texts(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, doc_id) of the texts that the packing had to cut."""
    return pack(documents, limits).filter("pieces > 1").select("limit_id", "doc_id").distinct()


def fill(documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, containers, tokens, least, filled): containers used, the fewest
    conceivable (all tokens over the capacity) and the share of space used."""
    caps = limits.groupBy("limit_id").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    by = pack(documents, limits).groupBy("limit_id", "container").agg(F.sum("tokens").alias("t")).groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    by = by.join(caps, "limit_id")
    return by.select("limit_id", "containers", "tokens", F.expr("(tokens + capacity - 1) div capacity").alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4).alias("filled"))
