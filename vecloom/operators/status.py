"""Checks, states and bookkeeping: sessions, heads, index polls, caches, batches, timers, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: scalings closer than this are the same.
SCALING_TOL = 1e-9


def same_scaling(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= SCALING_TOL, F.lit(False))


def session_problems(sessions: DataFrame, model: str, scaling: float, layers: list[int]) -> DataFrame:
    """session_id, problems: everything that keeps a session from being used; an empty list if nothing does.

    sessions has session_id and meta. Absent or untidy entries are problems, never errors.
    """
    get = lambda k: F.try_element_at("meta", F.lit(k))
    number = lambda k: F.expr(f"try_cast(trim(try_element_at(meta, '{k}')) AS DOUBLE)")
    have = F.filter(F.transform(F.split(F.coalesce(get("layers"), F.lit("")), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    missing = F.array_except(F.array(*[F.lit(x) for x in layers]), have)
    shown = lambda c: F.coalesce(c, F.lit("none"))
    problems = F.array_compact(
        F.array(
            F.when(number("context_len").isNull(), F.concat(F.lit("context_len "), shown(get("context_len")))),
            F.when(F.coalesce(get("model"), F.lit("")) != model, F.concat(F.lit("model "), shown(get("model")))),
            F.when(~same_scaling(number("scaling"), F.lit(scaling)), F.concat(F.lit("scaling "), shown(get("scaling")))),
            F.when(F.size(missing) > 0, F.concat(F.lit("layers "), F.array_join(F.transform(missing, lambda x: x.cast("string")), ","), F.lit(" not recorded"))),
        )
    )
    return sessions.select("session_id", problems.alias("problems"))


def keep_newest(entries: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """entries with evicted: all but the `keep` newest of each group go.

    Only the first keep rows of a group are ranked past a task, however large it is.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    kept = entries.withColumn("rank", rank).where(F.col("rank") <= keep)
    return kept


def stable(polls: DataFrame, by: list[str], order: list[str], ready: Column, n: int) -> DataFrame:
    """polls with ready and stable: the predicate held in this and the n - 1 polls before."""
    win = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return polls.withColumn("ready", ready).withColumn("stable", (F.sum(F.col("ready").cast("int")).over(win) == n))


def plan_batches(cells: DataFrame, size: int) -> DataFrame:
    """layer, kv_head, batch (from 0): layer-major batches of at most `size` heads.

    A layer's heads stay together unless they alone exceed the size; then they are split into batches of
    their own. Cells are heads of a model, some hundreds at most; their layers are packed by a fold over one
    small array.
    """
    if size < 1:
        raise ValueError("a batch holds at least one head")
    each = cells.select("layer", "kv_head").where("layer is not null and kv_head is not null").distinct()
    layers = each.groupBy("layer").agg(F.count("*").cast("int").alias("n"))
    state = "struct<first:int, used:int, out:array<struct<layer:int, first:int>>>"
    begin = F.struct(F.lit(0).alias("first"), F.lit(0).alias("used"), F.array().cast("array<struct<layer:int,first:int>>").alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        big, n = x["n"] > size, x["n"]
        fresh = (big & (acc["used"] > 0)) | (~big & (acc["used"] + n > size))
        first = F.when(fresh, acc["first"] + 1).otherwise(acc["first"])
        batches = F.ceil(n / F.lit(size)).cast("int")
        # a split layer closes its last batch
        nxt = F.when(big, first + batches).otherwise(first)
        used = F.when(big, F.lit(0)).when(fresh, n).otherwise(acc["used"] + n)
        out = F.concat(acc["out"], F.array(F.struct(x["layer"].alias("layer"), first.alias("first"))))
        return F.struct(nxt.alias("first"), used.alias("used"), out.alias("out")).cast(state)

    packed = layers.agg(F.sort_array(F.collect_list(F.struct("layer", "n"))).alias("all")).select(F.explode(F.aggregate("all", begin, step)["out"]).alias("p")).select("p.layer", "p.first")
    place = F.row_number().over(Window.partitionBy("layer").orderBy("kv_head")) - 1
    return each.withColumn("place", place).join(packed, "layer").select("layer", "kv_head", (F.col("first") + F.floor(F.col("place") / size)).cast("int").alias("batch"))


def envelope(results: DataFrame, analysis: str, params: dict[str, str], size: Column) -> DataFrame:
    """One JSON document per size: analysis, params, size, and the size's rows as results, sorted."""
    rows = results.groupBy(size.alias("size")).agg(F.sort_array(F.collect_list(F.struct(*results.columns))).alias("results"))
    head = F.struct(F.lit(analysis).alias("analysis"), F.create_map(*[F.lit(x) for kv in sorted(params.items()) for x in kv]).alias("params"), F.col("size"), F.col("results"))
    return rows.select("size", F.to_json(head).alias("json"))


def read_envelope(docs: DataFrame, result_schema: str) -> DataFrame:
    """The rows of envelopes, with analysis and size; a document of another shape gives none."""
    schema = f"analysis string, params map<string,string>, size string, results array<struct<{result_schema}>>"
    return docs.select(F.from_json("json", schema).alias("e")).select("e.analysis", "e.size", F.explode("e.results").alias("r")).select("analysis", "size", "r.*")


def in_order(rows: DataFrame, size: str, order: list[str]) -> DataFrame:
    """rows whose size is in the order, with place, where it stands there (from 1)."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(size)).cast("int")
    return rows.withColumn("place", at).where("place > 0")


def select_cells(rows: DataFrame, cells: list[tuple[int, int]], strict: bool = True) -> DataFrame:
    """rows (layer, kv_head) of the cells. A cell without a row is an error, unless strict is False; so is an empty choice."""
    if not cells:
        raise ValueError("no cell is chosen")
    wanted = rows.sparkSession.createDataFrame(cells, "layer int, kv_head int")
    if strict:
        absent = [tuple(r) for r in wanted.join(rows.select("layer", "kv_head").distinct(), ["layer", "kv_head"], "left_anti").limit(5).collect()]
        if absent:
            raise ValueError(f"nothing is stored of {absent}")
    return rows.join(wanted, ["layer", "kv_head"], "left_semi")


def recorded_sessions(rows: DataFrame, session: str, wanted: list[str] | None = None) -> DataFrame:
    """The rows of the wanted sessions, of all if none is named. A wanted session without a row is an error."""
    if wanted is None:
        return rows
    if not wanted:
        raise ValueError("no session is chosen")
    some = rows.where(F.col(session).isin(wanted))
    absent = sorted(set(wanted) - {r[0] for r in some.select(session).distinct().collect()})  # at most the wanted ones
    if absent:
        raise ValueError(f"nothing was recorded of {absent}")
    return some
