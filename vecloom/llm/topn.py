"""Problem 3: the N best items of every group, by simultaneous per-group bisection.

Score and identifier become one integer that sorts as (score falling, identifier rising). For all groups
of a block at once, a cutoff is bisected: count the codes at or above each group's midpoint, move the
lower or the upper end, and go on until each group holds exactly N codes.

The bisection runs twice. First in each input task, before anything is shuffled: an item among the N best
of a group is among the N best of its task, so only those leave the task. Then once more over what is
left, hash partitioned by group. A hot group of any size sends at most N rows per block of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An identifier has 31 bits in the code, a score the 32 above them.
ID_BITS = 31
ID_MAX = (1 << ID_BITS) - 1
#: Rows that are cut together inside a task.
BLOCK_ROWS = 500_000


def encode(score: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """float32 scores and identifiers in [0, 2^31) to int64 codes; a larger code is a better item."""
    bits = (score.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)  # + 0 makes -0.0 into 0.0
    rank = np.where(bits >= 0, bits + (1 << 31), -1 - (bits + (1 << 31)) + (1 << 31))
    return (rank << ID_BITS) | (ID_MAX - ident.astype(np.int64))


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores and identifiers of codes."""
    rank = code >> ID_BITS
    bits = np.where(rank >= 1 << 31, rank - (1 << 31), -1 - rank)
    return bits.astype(np.int32).view(np.float32), (ID_MAX - (code & ID_MAX)).astype(np.int32)


def bisect_top(group: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n largest codes of each group. Codes are distinct within a group, groups are 0..G-1.

    lo keeps count(code >= lo) >= n, hi keeps count(code >= hi) < n. Rows outside [lo, hi) are settled and
    leave the working set, so a round costs what is still open.
    """
    size = np.bincount(group)
    keep = size[group] <= n
    at = np.flatnonzero(~keep)
    if n <= 0 or not len(at):
        return keep if n > 0 else np.zeros(len(code), bool)
    lo = np.full(len(size), np.iinfo(np.int64).max)
    hi = np.full(len(size), np.iinfo(np.int64).min)
    np.minimum.at(lo, group[at], code[at])
    np.maximum.at(hi, group[at], code[at])
    hi += 1
    above = np.zeros(len(size), np.int64)  # codes at or above hi: in for certain
    while len(at):
        g, c = group[at], code[at]
        mid = lo + (hi - lo) // 2
        upper = c >= mid[g]
        count = above + np.bincount(g[upper], minlength=len(size))
        enough = count >= n
        exact = count == n
        lo = np.where(enough, mid, lo)
        grown = np.where(enough, above, count)
        hi = np.where(enough, hi, mid)
        keep[at[upper & exact[g]]] = True  # the cutoff is found
        keep[at[upper & ~enough[g]]] = True  # above the cutoff, wherever it is
        above = grown
        at = at[~exact[g] & (upper == enough[g])]
    return keep


def _group_ids(t: pa.Table, cols: list[str]) -> np.ndarray:
    """Numbers from 0 for the distinct combinations of cols; nulls are a value like any other."""
    ids = np.zeros(t.num_rows, np.int64)
    for c in cols:
        d = t.column(c).combine_chunks().dictionary_encode("encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        ids = np.unique(ids * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return ids


def _cut(t: pa.Table, cols: list[str], n: int) -> tuple[pa.Table, np.ndarray]:
    """The n best codes of every group and the groups' numbers, in order of (group, code falling)."""
    g, code = _group_ids(t, cols), t.column("code").to_numpy()
    ident = code & ID_MAX
    order = np.lexsort((-code, ident, g))
    first = np.ones(len(order), bool)  # a key counts once, with its best score
    first[1:] = (g[order][1:] != g[order][:-1]) | (ident[order][1:] != ident[order][:-1])
    at = order[first]
    at = at[bisect_top(g[at], code[at], n)]
    at = at[np.lexsort((-code[at], g[at]))]
    return t.take(pa.array(at)), g[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def top_n_per_group(df: DataFrame, groups: list[str], score: str, ident: str, n: int) -> DataFrame:
    """The n best items of each group: the group columns, place (1 is best), ident and score.

    Higher scores come first, equal scores by rising identifier. An identifier counts once in a group,
    with its highest score. Rows whose identifier is null or negative, or whose score is null, NaN or
    infinite, don't count. -0.0 equals 0.0. A null in a group column makes a group of its own. A group
    without a valid row is absent; an empty table gives an empty result. score is a FLOAT, ident an INT
    (or a BIGINT below 2^31). Other columns are dropped, so their names can't clash.
    """
    if n < 1 or not groups:
        raise ValueError("n must be at least 1, and a group column must be named")
    keys = [f"g{k}" for k in range(len(groups))]
    s = F.col(score).cast("float")
    rows = df.where(
        F.col(ident).isNotNull() & (F.col(ident) >= 0) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    ).select(*[F.col(c).alias(k) for c, k in zip(groups, keys)], s.alias("s"), F.col(ident).cast("int").alias("i"))
    types = [rows.schema[k].dataType.simpleString() for k in keys]
    names = ", ".join(f"{k} {t}" for k, t in zip(keys, types))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            code = encode(t.column("s").to_numpy(), t.column("i").to_numpy())
            t = t.select(keys).append_column("code", pa.array(code))
            yield from _cut(t, keys, n)[0].to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows are sorted by group. The last group of a block may go on in the next: its n best wait.
        def placed(t: pa.Table, g: np.ndarray) -> Iterator[pa.RecordBatch]:
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
            place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) + 1
            sc, ix = decode(t.column("code").to_numpy())
            out = t.select(keys).append_column("place", pa.array(place.astype(np.int32)))
            yield from out.append_column("i", pa.array(ix)).append_column("s", pa.array(sc)).to_batches()

        held: pa.Table | None = None
        for t in _blocks(batches):
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            last_row = t.slice(t.num_rows - 1)
            t, g = _cut(t, keys, n)
            same = np.ones(t.num_rows, bool)
            for k in keys:
                v = last_row.column(k)[0]
                if not v.is_valid:
                    eq = pc.is_null(t.column(k))
                elif v.as_py() != v.as_py():
                    eq = pc.is_nan(t.column(k))
                else:
                    eq = pc.equal(t.column(k), v)
                same &= pc.fill_null(eq, False).combine_chunks().to_numpy(zero_copy_only=False)
            held = t.filter(pa.array(same))
            yield from placed(t.filter(pa.array(~same)), g[~same])
        if held is not None:
            yield from placed(held, np.zeros(held.num_rows, np.int64))

    near = rows.mapInArrow(local, f"{names}, code bigint")
    done = near.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(final, f"{names}, place int, i int, s float")
    return done.select(*[F.col(k).alias(c) for c, k in zip(groups, keys)], "place", F.col("i").alias(ident), F.col("s").alias(score))
