"""Names, sizes, cells, cuts and keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: context length from which the rotary scaling factor exceeds 1.
BASE_CONTEXT = 262_144


def size_to_tokens(s: Column) -> Column:
    """'100k' to 100000, '1M' to 1000000, a plain number to itself; anything else is null."""
    t = F.trim(s)
    num = F.regexp_extract(t, r"^(\d+)[kKmM]?$", 1)
    unit = F.when(t.rlike("[kK]$"), 1000).when(t.rlike("[mM]$"), 1_000_000).otherwise(1)
    return F.when(num != "", num.cast("bigint") * unit)


def tokens_to_label(n: Column) -> Column:
    """1000000 to '1M', 100000 to '100k'; numbers that aren't whole thousands as they are."""
    return (
        F.when((n >= 1_000_000) & (n % 1_000_000 == 0), F.concat((n / 1_000_000).cast("bigint").cast("string"), F.lit("M")))
        .when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("bigint").cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def yarn_factor(ctx: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(ctx / F.lit(float(BASE_CONTEXT))).cast("bigint"))


def tier_label(path: Column) -> Column:
    """The last but one part of a path; null if it has fewer than two."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def cell_name(layer: Column, head: Column) -> Column:
    return F.format_string("L%dH%d", layer, head)


def head_file(layer: Column, head: Column) -> Column:
    return F.format_string("layer%02d_head%d", layer, head)


def parse_cell(s: Column) -> Column:
    """'L15H3' in either case to (layer, kv_head); null if it isn't one."""
    # Fixed value: the format of a cell's name.
    pat = r"^[lL](\d+)[hH](\d+)$"
    t = F.trim(s)
    return F.when(t.rlike(pat), F.struct(F.regexp_extract(t, pat, 1).cast("int").alias("layer"), F.regexp_extract(t, pat, 2).cast("int").alias("kv_head")))


def cells(names: list[str]) -> list[tuple[int, int]]:
    """Names such as 'L15H3' to (layer, kv_head); a name that is no cell is an error."""
    out = []
    for name in names:
        m = re.fullmatch(r"[lL](\d+)[hH](\d+)", name.strip())
        if not m:
            raise ValueError(f"{name!r} is no cell: L<layer>H<head>")
        out.append((int(m[1]), int(m[2])))
    return out


def shift_cut(cut: Column, shift: Column, n_keys: Column) -> Column:
    """cut moved by a shift such as '2000', '-16' or '10%', kept within 1 and n_keys - 1.

    The part of a percentage is rounded half away from zero. A shift that is neither, or a fraction without
    the percent sign, gives null.
    """
    # Fixed value: the format of a shift.
    pat = r"^([+-]?\d+(?:\.\d+)?)(%?)$"
    t = F.trim(shift)
    num, pct = F.regexp_extract(t, pat, 1), F.regexp_extract(t, pat, 2) == "%"
    ok = t.rlike(pat) & (pct | ~F.contains(num, F.lit(".")))
    delta = F.round(F.when(pct, cut * num.cast("double") / 100).otherwise(num.cast("double")))
    return F.when(ok, F.least(F.greatest(cut + delta, F.lit(1.0)), (n_keys - 1).cast("double")).cast("bigint"))


def ladder(low: Column, high: Column) -> Column:
    """The powers of two from low to high."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.pow(F.lit(2.0), k).cast("bigint")), lambda x: (x >= low) & (x <= high))


def eval_cuts(cuts: Column, shift: Column, n_keys: Column, kept: Column) -> Column:
    """The cuts to evaluate, rising, each once: the given ones, each of them shifted, and the number of keys kept.

    A shift that can't be read adds none; kept 0 or null adds none.
    """
    moved = F.transform(cuts, lambda c: shift_cut(c, shift, n_keys))
    more = F.when(F.coalesce(kept, F.lit(0)) > 0, F.array(kept.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(cuts.cast("array<bigint>"), moved, more), lambda c: c.isNotNull())))


def cache_key(*parts: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of the parts joined by a bar; null parts are left out."""
    return F.left(F.sha1(F.concat_ws("|", *parts).cast("binary")), F.lit(16))
