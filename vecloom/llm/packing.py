"""Problem 7: items into containers of fixed capacity, by exact-complement hashing and best fit.

The items are spread by a hash over packing groups of bounded size; each group is packed by itself, from
the counts of its sizes. Singles are indexed by their size, pairs by their sum, and triples as a single and the index
of pairs at what is left. A container is begun with the largest sizes at hand. As soon as one, two or three
items can close its gap exactly, the index is asked for sizes of that sum under the counts still available, and the
combination is used for as many containers as the counts allow. Gaps without an exact complement take the
largest item that fits, again and again (best fit).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.sources import ensure_checkpoint_dir

#: Rows that one packing group holds on average. It bounds a task's memory; a group wastes at most about one container.
GROUP_ROWS = 40_000
#: Copies of a row that are numbered at a time.
PORTION = 100_000


class Sums:
    """Sizes that are available, and lookups of one, two or three of them by their sum.

    count is addressed by the size itself. summed[g] tells whether two sizes may add up to g; counts only fall, so a sum
    that is found to be used up is struck out once and for all, and nothing else is ever entered.
    """

    def __init__(self, counts: np.ndarray):
        self.count = counts.copy()
        self.count[0] = 0  # size 0 isn't packed
        self.left = int(self.count.sum())
        self.sizes = np.flatnonzero(self.count)  # rising; may hold sizes that have just run out
        self.summed = np.zeros(len(counts), bool)
        for a in self.sizes.tolist():
            fits = self.sizes[: int(np.searchsorted(self.sizes, len(counts) - a))]
            self.summed[a + fits] = True

    def hold(self, s: int, n: int = 1) -> None:
        self.count[s] -= n
        self.left -= n

    def refresh(self) -> None:
        self.sizes = self.sizes[self.count[self.sizes] > 0]

    def best_fit(self, gap: int) -> int:
        """The largest available size up to gap; 0 if there is none."""
        k = int(np.searchsorted(self.sizes, gap, "right"))
        while k and not self.count[self.sizes[k - 1]]:
            k -= 1
        return int(self.sizes[k - 1]) if k else 0

    def single(self, gap: int) -> list[int] | None:
        return [gap] if gap < len(self.count) and self.count[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair of sum gap with the largest member."""
        if gap >= len(self.summed) or not self.summed[gap]:
            return None
        found = self._pair(gap)
        self.summed[gap] = found is not None
        return found

    def _pair(self, gap: int) -> list[int] | None:
        k = int(np.searchsorted(self.sizes, gap))
        a = self.sizes[int(np.searchsorted(self.sizes, -(-gap // 2))) : k]
        hit = a[(self.count[a] > 0) & (self.count[gap - a] > (2 * a == gap))]
        return [int(hit[-1]), int(gap - hit[-1])] if len(hit) else None

    def triple(self, gap: int) -> list[int] | None:
        """The triple of sum gap with the largest member."""
        a = self.sizes[int(np.searchsorted(self.sizes, -(-gap // 3))) : int(np.searchsorted(self.sizes, gap))]
        for s in a[(self.count[a] > 0) & self.summed[gap - a]][::-1].tolist():
            self.count[s] -= 1
            rest = self._pair(gap - s)
            self.count[s] += 1
            if rest:
                return [s, *rest]
            self.pair(gap - s)  # strikes the sum out, unless it only lacked the s that was held
        return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (sizes of a container, number of such containers) that use up the counts by size 1..capacity."""
    s, out = Sums(counts), []
    while s.left:
        items: list[int] = []
        gap = capacity
        while gap and s.left:
            close = None
            if gap <= 3 * int(s.sizes[-1]):
                close = s.single(gap) or s.pair(gap) or s.triple(gap)
            for x in close or [s.best_fit(gap)]:
                if x:
                    s.hold(x)
                    items.append(x)
                gap = gap - x if x else 0
        need = np.bincount(items)
        used = np.flatnonzero(need)
        more = int((s.count[used] // need[used]).min())  # the same pattern again, while the counts allow it
        for x in items:
            s.hold(x, more)
        s.refresh()
        out.append((items, 1 + more))
    return out


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers from 0 for items of sizes 0..capacity. Items of size 0 go round the containers."""
    box = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return box
    order = np.argsort(sizes, kind="stable")
    begin = np.searchsorted(sizes[order], np.arange(capacity + 2))
    used, base = begin[:-1].copy(), 0
    for items, times in plan(np.diff(begin), capacity):
        for x in items:
            box[order[used[x] : used[x] + times]] = base + np.arange(times)
            used[x] += times
        base += times
    zero = order[begin[0] : begin[1]]
    box[zero] = np.arange(len(zero)) % max(1, base)
    return box


def pack(df: DataFrame, ident: str, size: str, tiers: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """tier, container, ident, piece, size: all items of df in containers of each tier's capacity.

    tiers has the columns tier and capacity_tokens. An item is split only if it exceeds the capacity: into
    full pieces of that size, each a container, and a remainder that is packed like an item; pieces count
    from 0. A null or negative size counts as 0; items of size 0 are put where there is a container.
    A tier whose capacity is null or below 1 is left out. Repeated rows are items of their own. Container
    names are unique within a tier, and with the packing they follow from the rows alone, however these are
    partitioned. An empty table gives an empty result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # Equal rows are counted and numbered again, in portions, so that neither a hot identifier nor its number of copies is in one task.
    counted = df.select(F.col(ident).alias("k"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("s")).groupBy("k", "s").agg(F.count("*").alias("n"))
    portion = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {PORTION}")))
    counted = counted.withColumn("portion", portion)
    last = F.least(F.col("n"), (F.col("portion") + 1) * PORTION) - 1
    items = counted.select("k", "s", F.explode(F.sequence(F.col("portion") * PORTION, last)).alias("copy")).checkpoint()
    groups = max(1, -(-items.count() // group_rows))
    items = items.withColumn("g", F.pmod(F.xxhash64("k", "s", "copy"), F.lit(groups)).cast("int"))
    caps = [(r[0], int(r[1])) for r in tiers.where(F.col("capacity_tokens") >= 1).select("tier", "capacity_tokens").distinct().collect()]
    cap = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(c).alias("c")) for t, c in caps]))
    if not caps:
        return df.sparkSession.createDataFrame([], f"tier string, container string, {ident} {df.schema[ident].dataType.simpleString()}, piece int, size int")
    each = items.select("k", "s", "copy", "g", cap.alias("v")).select("k", "s", "copy", "g", "v.tier", "v.c")
    full = F.expr("s div c").cast("int")
    cut = each.withColumn("full", F.when(F.col("s") > F.col("c"), full).otherwise(F.lit(0))).withColumn("rest", (F.col("s") - F.col("full") * F.col("c")).cast("int"))
    # Full pieces are containers already. Their names come from the row, so nothing is shuffled for them.
    name = F.concat_ws("-", F.lit("f"), "copy", "s", "piece", F.coalesce(F.concat(F.lit("="), F.col("k").cast("string")), F.lit("")))
    whole = (
        cut.where("full > 0").select("k", "s", "copy", "tier", "c", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
        .select("tier", name.alias("container"), "k", "piece", F.col("c").cast("int").alias("size"))
    )
    rest = cut.where("full = 0 or rest > 0").select("tier", "c", "g", "k", "copy", F.col("full").alias("piece"), F.col("rest").alias("size"))

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["k", "copy", "piece"], ignore_index=True)
        box = pd.Series(assign(p["size"].to_numpy(), int(key[1])), p.index).astype(str)
        return p.assign(container=f"g{key[2]}-" + box)[["tier", "container", "k", "piece", "size"]]

    kind = items.schema["k"].dataType.simpleString()
    packed = rest.groupBy("tier", "c", "g").applyInPandas(one, f"tier string, container string, k {kind}, piece int, size int")
    return whole.unionByName(packed).withColumnRenamed("k", ident)


def report(packed: DataFrame, tiers: DataFrame) -> DataFrame:
    """tier, capacity_tokens, containers, items, filled, fill: how full the containers of each tier are."""
    boxes = packed.groupBy("tier", "container").agg(F.sum("size").alias("filled"), F.count("*").alias("items"))
    per = boxes.groupBy("tier").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("filled").alias("filled"))
    out = tiers.select("tier", "capacity_tokens").distinct().join(per, "tier")
    return out.withColumn("fill", F.col("filled") / (F.col("containers") * F.col("capacity_tokens")))
