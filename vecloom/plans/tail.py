"""The tail correction: moments, cuts, fits, gate and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import parse, vec
from vecloom.operators import search, tail
from vecloom.plans.attention import _live_out
from vecloom.plans.registry import KEYS, SCORED, query
from vecloom.sources import ensure_checkpoint_dir, views
from vecloom.sources.views import CELL, KEY_DIM, SCALING, VALUE_DIM

#: The ladder of cuts, and how many keys retrieval keeps.
CUTS, KEEP = [2**i for i in range(13)], 16
#: The shift of a chosen cut, and what is evaluated for it.
SHIFT = "10%"
BUILD_CUTS = sorted({*CUTS, KEEP, *(max(1, int(c * 1.1 + 0.5)) for c in CUTS)})


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def _moments(spark: SparkSession, d: str) -> DataFrame:
    return tail.moments(views.keys(spark, d), CELL, KEY_DIM)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return tail.query_terms(views.queries(spark, d), _moments(spark, d), CELL, SCALING)


def _scan(spark: SparkSession, d: str, cuts: list[int] = CUTS) -> DataFrame:
    return tail.cut_scan(views.queries(spark, d), views.keys(spark, d), CELL, cuts, SCALING, VALUE_DIM, KEEP)


def _cuts(spark: SparkSession, d: str, cuts: list[int] = CUTS) -> DataFrame:
    """Sums at every cut with the exact output, by query; the query's cell, vector and half of the data."""
    train = F.pmod(F.floor(F.col("q_row") / 100), F.lit(2)) == 0
    rows = _scan(spark, d, cuts).withColumn("none_err", tail.kept_error())
    return rows.join(views.queries(spark, d).select("q_row", *CELL, "session_id", "q", train.alias("train")), "q_row")


BASE = f"""{SCORED}, lg AS (SELECT *, score * {SCALING} AS logit, max(score * {SCALING}) OVER (PARTITION BY q_row) AS m, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, pos) AS rank, count(*) OVER (PARTITION BY q_row) AS n FROM scored),
  cuts AS (SELECT unnest({CUTS}) AS cut), i8 AS (SELECT unnest(range({VALUE_DIM})) AS i),
  s AS (SELECT q_row, cache_id, layer, kv_head, cut, i, any_value(m) AS m, sum(CASE WHEN rank <= cut THEN exp(logit - m) ELSE 0 END) AS dt, sum(CASE WHEN rank <= cut THEN exp(logit - m) * value[i + 1] ELSE 0 END) AS nt,
    sum(exp(logit - m)) AS dd, sum(exp(logit - m) * value[i + 1]) AS nn, min(CASE WHEN rank <= cut THEN logit END) AS bnd FROM lg, cuts, i8 WHERE cut <= greatest(n, {KEEP}) GROUP BY q_row, cache_id, layer, kv_head, cut, i),
  e AS (SELECT q_row, cache_id, layer, kv_head, cut, sqrt(sum(pow(nt / dt - nn / dd, 2))) / sqrt(sum(pow(nn / dd, 2))) AS err FROM s GROUP BY ALL)"""


@query(f"""WITH {KEYS}, ij AS (SELECT i, j FROM (SELECT unnest(range({KEY_DIM})) AS i), (SELECT unnest(range({KEY_DIM})) AS j) WHERE i <= j)
  SELECT cache_id, layer, kv_head, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_pop(key[i + 1], key[j + 1]) + 1e-10, 6) + 0.0 AS cov FROM keys, ij GROUP BY cache_id, layer, kv_head, i, j""")
def key_cov(spark: SparkSession, d: str) -> DataFrame:
    """Upper triangle of the covariance of each cell's keys."""
    rows = _moments(spark, d).select(*CELL, F.posexplode("cov").alias("i", "row")).select(*CELL, "i", F.posexplode("row").alias("j", "cov"))
    return rows.where("i <= j").select(*CELL, "i", "j", _r(F.col("cov") + 1e-10).alias("cov"))


@query(f"WITH {BASE} SELECT q_row, cut, CAST(i AS INTEGER) AS i, round(dt, 6) + 0.0 AS dt, round(nt, 6) + 0.0 AS nt, round(bnd, 6) + 0.0 AS bnd FROM s")
def cut_sums(spark: SparkSession, d: str) -> DataFrame:
    s = _scan(spark, d)
    return s.select("q_row", "cut", _r("dt").alias("dt"), _r("bnd").alias("bnd"), F.posexplode("nt").alias("i", "nt")).withColumn("nt", _r("nt"))


@query(f"""WITH {BASE} SELECT layer, kv_head, cut, count(*) AS n, round(avg(err), 6) + 0.0 AS mean, round(quantile_cont(err, 0.5), 6) + 0.0 AS median, round(quantile_cont(err, 0.9), 6) + 0.0 AS p90, round(quantile_cont(err, 0.99), 6) + 0.0 AS p99 FROM e GROUP BY layer, kv_head, cut""")
def rel_err_stats(spark: SparkSession, d: str) -> DataFrame:
    """Relative error of the kept keys alone, by head and cut."""
    e = F.col("none_err")
    return _cuts(spark, d).groupBy("layer", "kv_head", "cut").agg(F.count("*").alias("n"), _r(F.avg(e)).alias("mean"), *[_r(F.percentile(e, p)).alias(n) for p, n in ((0.5, "median"), (0.9, "p90"), (0.99, "p99"))])


@query(f"""WITH {BASE}, w AS (SELECT a.layer, a.kv_head, a.err, b.err AS base FROM e a JOIN e b ON a.q_row = b.q_row AND a.cut = 4 AND b.cut = 2), g AS (SELECT layer, kv_head, avg(CASE WHEN err > base THEN 1.0 ELSE 0.0 END) AS worse,
    quantile_cont(err / base, 0.5) FILTER (WHERE err > base) AS med, quantile_cont(err / base, 0.99) FILTER (WHERE err > base) AS p99, max(err / base) FILTER (WHERE err > base) AS mx FROM w GROUP BY ALL)
  SELECT layer, kv_head, round(worse, 6) + 0.0 AS worse, round(coalesce(med, 1.0), 6) + 0.0 AS ratio_med, round(coalesce(p99, 1.0), 6) + 0.0 AS ratio_p99, round(coalesce(mx, 1.0), 6) + 0.0 AS ratio_max FROM g""")
def ratio_stats(spark: SparkSession, d: str) -> DataFrame:
    """Where keeping 4 keys is worse than keeping 2, and by how much."""
    e = _cuts(spark, d).where(F.col("cut").isin(2, 4)).groupBy("q_row", "layer", "kv_head").pivot("cut", [2, 4]).agg(F.first("none_err"))
    out = e.groupBy("layer", "kv_head").agg(*tail.ratio_stats(F.col("4"), F.col("2")))
    return out.select("layer", "kv_head", *[_r(c).alias(c) for c in ("worse", "ratio_med", "ratio_p99", "ratio_max")])


@query(f"""WITH {BASE}, st AS (SELECT layer, kv_head, cut, avg(err) AS err FROM e GROUP BY ALL)
  SELECT layer, kv_head, CAST(coalesce(min(cut) FILTER (WHERE err <= 0.5), max(cut)) AS INTEGER) AS cut, min(cut) FILTER (WHERE err <= 0.5) IS NOT NULL AS reached FROM st GROUP BY ALL""")
def cut_choice(spark: SparkSession, d: str) -> DataFrame:
    stats = _cuts(spark, d).groupBy("layer", "kv_head", "cut").agg(F.avg("none_err").alias("err"))
    return tail.choose_cut(stats, ["layer", "kv_head"], "err", 0.5)


@query(f"""WITH {BASE}, w AS (SELECT a.layer, a.kv_head, a.err, b.err AS base FROM e a JOIN e b ON a.q_row = b.q_row AND a.cut = 4 AND b.cut = 2),
  g AS (SELECT layer, kv_head, avg(CASE WHEN err > base THEN 1.0 ELSE 0.0 END) AS worse, coalesce(quantile_cont(err / base, 0.99) FILTER (WHERE err > base), 1.0) AS p99, quantile_cont(err, 0.5) <= 5 AS sane FROM w GROUP BY ALL)
  SELECT layer, kv_head, sane AND worse <= 0.1 AND p99 <= 1.5 AS gate_pass, concat_ws('; ', CASE WHEN NOT sane THEN 'sanity failed' END, CASE WHEN worse > 0.1 THEN format('worse {{:.1f}}% > 10%', worse * 100) END, CASE WHEN p99 > 1.5 THEN format('p99 {{:.2f}}x > 1.5x', p99) END) AS reason FROM g""".replace("{{", "{").replace("}}", "}"))
def worse_gate(spark: SparkSession, d: str) -> DataFrame:
    e = _cuts(spark, d).where(F.col("cut").isin(2, 4)).groupBy("q_row", "layer", "kv_head").pivot("cut", [2, 4]).agg(F.first("none_err"))
    stats = e.groupBy("layer", "kv_head").agg(*tail.ratio_stats(F.col("4"), F.col("2")), (F.percentile(F.col("4"), 0.5) <= 5).alias("sanity_pass"))
    return tail.gate(stats, 0.1, 1.5).select("layer", "kv_head", "gate_pass", "reason")


MOM = f"""{SCORED}, mo AS (SELECT q_row, count(*) AS n, avg(score * {SCALING}) AS mu, var_pop(score * {SCALING}) AS var FROM scored GROUP BY q_row)"""


@query(f"WITH {MOM} SELECT q_row, n AS n_keys, round(mu, 6) + 0.0 AS mu, round(var, 6) + 0.0 AS var, round(ln(n) + mu + var / 2, 6) + 0.0 AS ln_mass FROM mo")
def tail_mass_base(spark: SparkSession, d: str) -> DataFrame:
    """Log mass of a cell's keys for each query from their moments; the SQL takes it from the scores themselves."""
    both = views.queries(spark, d).join(_moments(spark, d), CELL)
    mu, var = tail.mass_terms(F.col("q"), F.col("mean"), F.col("cov"), SCALING)
    return both.select("q_row", "n_keys", _r(mu).alias("mu"), _r(var).alias("var"), _r(tail.mass_base(mu, var, F.col("n_keys"))).alias("ln_mass"))


@query(f"""WITH qs AS (SELECT q_row, CAST(q AS DOUBLE[]) AS q FROM decode_rows WHERE q_row % 100 = 0 AND len(q) = 32 AND len(list_filter(q, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(q, lambda x: x <> 0)) > 0),
  p AS (SELECT q_row, i, q[i + 1] / sqrt(list_inner_product(q, q)) + 0.01 * i AS x FROM qs, (SELECT unnest(range(8)) AS i)), l AS (SELECT q_row, sqrt(sum(x * x)) AS n FROM p GROUP BY q_row)
  SELECT q_row, CAST(i AS INTEGER) AS i, round(x / n * 2, 6) + 0.0 AS u FROM p JOIN l USING (q_row)""")
def tail_standin(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in of a map that takes the first eight numbers of the direction and adds a fixed bias."""
    weight = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(KEY_DIM)]) for i in range(VALUE_DIM)])
    bias = F.array(*[F.lit(0.01 * i) for i in range(VALUE_DIM)])
    u = tail.standin(F.col("q"), weight, bias, F.lit(2.0))
    return views.queries(spark, d).select("q_row", F.posexplode(u).alias("i", "u")).withColumn("u", _r("u"))


@query(f"""WITH {BASE}, mo AS (SELECT q_row, count(*) AS n, avg(logit) AS mu, var_pop(logit) AS var FROM lg GROUP BY q_row), av AS (SELECT cache_id, layer, kv_head, i, avg(value[i + 1]) AS u FROM keys, i8 GROUP BY cache_id, layer, kv_head, i),
  z AS (SELECT q_row, exp(ln(n) + mu + var / 2) AS z FROM mo)
  SELECT q_row, CAST(i AS INTEGER) AS i, round((nt + z * exp(-m) * u) / (dt + z * exp(-m)), 6) + 0.0 AS out FROM s JOIN z USING (q_row) JOIN av USING (cache_id, layer, kv_head, i) WHERE cut = 16""")
def tail_merge(spark: SparkSession, d: str) -> DataFrame:
    """The kept keys merged with one pseudo-key: the mean value of the cell with the mass of all its keys."""
    sums = _scan(spark, d, [KEEP]).join(views.queries(spark, d).select("q_row", *CELL, "q"), "q_row")
    av = views.keys(spark, d).groupBy(*CELL).agg(F.array(*[F.avg(F.col("value")[i]) for i in range(VALUE_DIM)]).alias("u"))
    both = sums.join(_moments(spark, d), CELL).join(av, CELL)
    mu, var = tail.mass_terms(F.col("q"), F.col("mean"), F.col("cov"), SCALING)
    z = F.exp(tail.mass_base(mu, var, F.col("n_keys")) - F.col("m"))
    return both.select("q_row", F.posexplode(tail.combine(F.col("nt"), F.col("dt"), F.col("u"), z)).alias("i", "out")).withColumn("out", _r("out"))


def _erfc_sql(y: str) -> str:
    """erfc by its series near zero and by its continued fraction beyond 2.5, on both sides."""
    series = f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(60), lambda n: pow(-1.0, n) * pow({y}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))"
    fraction = lambda a: f"exp(-({a}) * ({a})) / (sqrt(pi()) * list_reduce(list_transform(range(80), lambda k: CAST(80 - k AS DOUBLE)), lambda f, k: {a} + k / 2 / f, CAST({a} AS DOUBLE)))"
    return f"CASE WHEN {y} >= 2.5 THEN {fraction(y)} WHEN {y} <= -2.5 THEN 2 - {fraction(f'(-{y})')} ELSE {series} END"


@query(f"""WITH {BASE}, mo AS (SELECT q_row, count(*) AS n, avg(logit) AS mu, var_pop(logit) AS var FROM lg GROUP BY q_row), b AS (SELECT DISTINCT q_row, cut, bnd FROM s),
  y AS (SELECT q_row, cut, ln(n) + mu + var / 2 AS base, -(bnd - mu - var) / sqrt(var) / sqrt(2.0) AS y FROM b JOIN mo USING (q_row))
  SELECT q_row, cut, round(base + ln(({_erfc_sql('y')}) / 2), 5) + 0.0 AS ln_mass FROM y""")
def tail_mass(spark: SparkSession, d: str) -> DataFrame:
    """Log mass of the keys below the weakest kept one, at every cut."""
    rows = _scan(spark, d).select("q_row", "cut", "bnd").join(_terms(spark, d), "q_row")
    return rows.select("q_row", "cut", _r(tail.tail_mass(F.col("mu"), F.col("var"), F.col("n_keys"), F.col("bnd")), 5).alias("ln_mass"))


@query(f"""WITH {BASE}, mo AS (SELECT q_row, exp(ln(count(*)) + avg(logit) + var_pop(logit) / 2) AS z FROM lg GROUP BY q_row), av AS (SELECT cache_id, layer, kv_head, i, avg(value[i + 1]) AS u FROM keys, i8 GROUP BY cache_id, layer, kv_head, i),
  al AS (SELECT unnest({tail.ALPHAS}) AS alpha), r AS (SELECT layer, kv_head, q_row, alpha, sqrt(sum(pow((nt + alpha * z * exp(-m) * u) / (dt + alpha * z * exp(-m)) - nn / dd, 2))) / sqrt(sum(pow(nn / dd, 2))) AS err
    FROM s JOIN mo USING (q_row) JOIN av USING (cache_id, layer, kv_head, i), al WHERE cut = {KEEP} GROUP BY ALL), g AS (SELECT layer, kv_head, alpha, avg(err) AS err FROM r GROUP BY ALL)
  SELECT layer, kv_head, CAST(arg_min(alpha, err) AS DOUBLE) AS alpha, round(min(err), 6) + 0.0 AS err FROM g GROUP BY layer, kv_head""")
def alpha_grid(spark: SparkSession, d: str) -> DataFrame:
    """The mass factor of least error when the tail's value is the cell's mean and its mass that of all keys."""
    sums = _scan(spark, d, [KEEP]).join(views.queries(spark, d).select("q_row", *CELL, "q"), "q_row")
    av = views.keys(spark, d).groupBy(*CELL).agg(F.array(*[F.avg(F.col("value")[i]) for i in range(VALUE_DIM)]).alias("uh"))
    both = sums.join(_moments(spark, d), CELL).join(av, CELL)
    mu, var = tail.mass_terms(F.col("q"), F.col("mean"), F.col("cov"), SCALING)
    rows = both.withColumn("z", F.exp(tail.mass_base(mu, var, F.col("n_keys")) - F.col("m")))
    return tail.fit_alpha(rows, ["layer", "kv_head"]).withColumn("err", _r("err"))


HEAD = ["layer", "kv_head"]
#: What a chosen cut may err, by mean; what a gate tolerates.
EPS, WORSE_TOL, P99_TOL = 0.5, 0.1, 1.5


def _maps(rows: DataFrame) -> DataFrame:
    return tail.ridge_map(tail.true_tail(rows.where("train")), [*CELL, "cut"], KEY_DIM, VALUE_DIM, 1e-2)


def _scored(spark: SparkSession, d: str, cuts: list[int] = CUTS) -> DataFrame:
    ensure_checkpoint_dir(spark)
    rows = _cuts(spark, d, cuts).checkpoint()  # used to fit and to judge
    return tail.scored_tail(rows, _maps(rows), _terms(spark, d), CELL).checkpoint()


@query()
def ridge_map(spark: SparkSession, d: str) -> DataFrame:
    """Weight, bias and scale of the ridge map of every cell and cut."""
    ensure_checkpoint_dir(spark)
    return _maps(_cuts(spark, d).checkpoint())


def _stats(scored: DataFrame) -> DataFrame:
    rows = tail.true_tail(scored)
    return tail.cut_statistics(rows.withColumn("err", tail.with_alpha(rows, F.lit(1.0))), HEAD)


@query()
def cut_stats(spark: SparkSession, d: str) -> DataFrame:
    """The twelve held-out statistics of every head and cut, with and without the tail."""
    return _stats(_scored(spark, d).where("uh is not null"))


def _built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The record of every head, and its rows at the kept number of keys with the stand-in of its fitted cut.

    The chain: statistics of all cuts, the smallest cut of the ladder within EPS, its shift, the cut of the map (at least the
    kept number of keys), and the mass factor of the training half at what retrieval keeps.
    """
    scored = _scored(spark, d, BUILD_CUTS)
    stats = _stats(scored.where("uh is not null")).checkpoint()
    chosen = tail.choose_cut(stats.where(F.col("cut").isin(CUTS)), HEAD, "err_mean", EPS)
    keys = scored.groupBy(*HEAD).agg(F.min("n_keys").alias("n_keys"))
    final = parse.shift_cut(F.col("cut"), F.lit(SHIFT), F.col("n_keys"))
    heads = chosen.join(keys, HEAD).select(*HEAD, "n_keys", F.col("cut").alias("cut_detected"), F.col("reached").alias("eps_met"), final.alias("cut"), F.greatest(final, F.lit(KEEP)).alias("wanted"))
    # A final cut that was pushed below the number of keys takes the deepest map at or below it.
    there = stats.select(*HEAD, F.col("cut").alias("has"))
    fit = heads.join(there, HEAD).where(F.col("has") <= F.col("wanted")).groupBy(*HEAD).agg(F.max("has").alias("fit_cut"))
    heads = heads.drop("wanted").join(fit, HEAD, "left")
    kept = scored.where(F.col("cut") == KEEP).drop("uh", "pred", "scale")
    maps = scored.join(fit, HEAD).where(F.col("cut") == F.col("fit_cut")).select("q_row", "uh", "pred", "scale")
    rows = kept.join(maps, "q_row", "left")
    alpha = tail.fit_alpha(rows.where("train and uh is not null"), HEAD).select(*HEAD, "alpha")
    return heads.join(alpha, HEAD, "left"), rows.join(alpha, HEAD, "left")


@query()
def alpha_fit(spark: SparkSession, d: str) -> DataFrame:
    """The mass factor of each head at the kept number of keys, fitted on the training half, with its cuts."""
    return _built(spark, d)[0]


@query()
def runtime_stats(spark: SparkSession, d: str) -> DataFrame:
    """Held-out errors of each head at the fitted mass factor and at 1, and against the kept keys alone."""
    rows = _built(spark, d)[1].where("not train and uh is not null")
    rows = rows.withColumn("err", tail.with_alpha(rows, F.col("alpha"))).withColumn("err_one", tail.with_alpha(rows, F.lit(1.0)))
    stats = [F.first("alpha").alias("alpha"), F.count("*").alias("rows_"), F.avg("none_err").alias("none_mean")]
    for e, end in (("err", ""), ("err_one", "_one")):
        stats += [F.avg(e).alias(f"err_mean{end}"), F.percentile(e, 0.9).alias(f"err_p90{end}")]
        stats += [c.alias(f"{n}{end}") for c, n in zip(tail.ratio_stats(F.col(e), F.col("none_err")), ("worse", "ratio_med", "ratio_p99", "ratio_max"))]
    return rows.groupBy(*HEAD).agg(*stats)


def _validated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The gate of every head by its decode errors, the rows at the kept number of keys, and the live part."""
    _, rows = _built(spark, d)
    rows, live = rows.checkpoint(), _live_out(spark, d).checkpoint()
    full = search.merge_partitions(rows.select("q_row", (F.col("m") + F.log("d")).alias("lse"), F.col("exact").alias("out")), live, ["q_row"]).select("q_row", F.col("out").alias("exact"))
    with_tail = tail.apply(rows.withColumn("active", F.lit(True)), live).select("q_row", "out")
    without = tail.apply(rows.withColumn("active", F.lit(False)), live).select("q_row", F.col("out").alias("plain"))
    both = rows.where("uh is not null").select("q_row", *HEAD).join(with_tail, "q_row").join(without, "q_row").join(full, "q_row")
    both = both.select(*HEAD, vec.rel_err(F.col("out"), F.col("exact")).alias("err"), vec.rel_err(F.col("plain"), F.col("exact")).alias("none"))
    stats = both.groupBy(*HEAD).agg(F.count("*").alias("rows_"), F.avg("err").alias("err_mean"), F.avg("none").alias("none_mean"), *tail.ratio_stats(F.col("err"), F.col("none")), F.lit(None).cast("boolean").alias("sanity_pass"))
    return tail.gate(stats, WORSE_TOL, P99_TOL), rows, live


@query()
def decode_validation(spark: SparkSession, d: str) -> DataFrame:
    """Errors of whole outputs (with the live part) against full attention, with the tail and without it, by head.

    sanity_pass is null: the tables hold no recorded output to compare with, so the gate leaves it out.
    """
    return _validated(spark, d)[0]


@query()
def tail_apply(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval merged with the live part: heads whose gate passed with their tail (mass times the fitted factor), others untouched."""
    gates, rows, live = _validated(spark, d)
    active = gates.select(*HEAD, F.col("gate_pass").alias("active"))
    rows = rows.join(active, HEAD, "left").withColumn("active", F.coalesce("active", F.lit(False)))
    flags = rows.select("q_row", "active")
    return tail.apply(rows, live).join(flags, "q_row", "left").select("q_row", "lse", "out", F.coalesce("active", F.lit(False)).alias("active"))


@query(f"""WITH {BASE}, mo AS (SELECT q_row, any_value(layer) AS layer, ln(count(*)) + avg(logit) + var_pop(logit) / 2 AS lnz FROM lg GROUP BY q_row), av AS (SELECT cache_id, layer, kv_head, i, avg(value[i + 1]) AS u FROM keys, i8 GROUP BY cache_id, layer, kv_head, i),
  t AS (SELECT s.q_row, i, m, dt, nt, u, CASE WHEN s.layer % 2 = 0 THEN 0.5 * exp(lnz - m) ELSE 0 END AS z FROM s JOIN mo USING (q_row) JOIN av ON av.cache_id = s.cache_id AND av.layer = s.layer AND av.kv_head = s.kv_head AND av.i = s.i WHERE cut = {KEEP})
  SELECT q_row, CAST(i AS INTEGER) AS i, round(m + ln(dt + z), 6) + 0.0 AS lse, round((nt + z * u) / (dt + z), 6) + 0.0 AS out FROM t""".replace("s.q_row, i, m", "s.q_row, s.i AS i, m"))
def tail_apply_given(spark: SparkSession, d: str) -> DataFrame:
    """Tails of given values (the mean of the cell, half of its mass) on the heads of even layers; the others pass through."""
    sums = _scan(spark, d, [KEEP]).join(views.queries(spark, d).select("q_row", *CELL), "q_row").join(_terms(spark, d), "q_row")
    av = views.keys(spark, d).groupBy(*CELL).agg(F.array(*[F.avg(F.col("value")[i]) for i in range(VALUE_DIM)]).alias("uh"))
    z = F.exp(tail.mass_base(F.col("mu"), F.col("var"), F.col("n_keys")) - F.col("m"))
    rows = sums.join(av, CELL).withColumn("z", z).withColumn("alpha", F.lit(0.5)).withColumn("active", F.col("layer") % 2 == 0)
    none = rows.select("q_row", F.col("m").alias("lse"), F.col("exact").alias("out")).where("false")
    return tail.apply(rows, none).select("q_row", _r("lse").alias("lse"), F.posexplode("out").alias("i", "out")).withColumn("out", _r("out"))


@query(f"""WITH {BASE}, r AS (SELECT layer, kv_head, count(*) AS n, sum(err) AS total, sum(CASE WHEN err > 1 THEN 1 ELSE 0 END) AS worse FROM e WHERE cut = 16 GROUP BY layer, kv_head)
  SELECT layer, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 5) + 0.0 AS total, CAST(sum(worse) AS BIGINT) AS worse, arg_max(kv_head, total / n) AS worst_head FROM r GROUP BY ROLLUP (layer)""")
def check_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Rows, summed error, bad rows and the worst head, by layer and in all."""
    e = F.col("none_err")
    head = _cuts(spark, d).where(F.col("cut") == KEEP).groupBy("layer", "kv_head").agg(F.count("*").alias("n"), F.sum(e).alias("total"), F.sum((e > 1).cast("bigint")).alias("worse"))
    return head.rollup("layer").agg(F.sum("n").alias("n"), _r(F.sum("total"), 5).alias("total"), F.sum("worse").alias("worse"), F.max_by("kv_head", F.col("total") / F.col("n")).alias("worst_head"))


#: Numbers of keys of the error curve, evenly spaced in their logarithm; a cell takes those up to its number of keys.
CURVE_CUTS = vec.log_spaced(4097, 30)


@query(f"""WITH {SCORED}, lg AS (SELECT *, exp(score * {SCALING} - max(score * {SCALING}) OVER (PARTITION BY q_row)) AS e, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, pos) AS top, row_number() OVER (PARTITION BY q_row ORDER BY md5(CAST(pos AS VARCHAR)), pos) AS rnd, count(*) OVER (PARTITION BY q_row) AS n FROM scored),
  ks AS (SELECT unnest({CURVE_CUTS}) AS k), i8 AS (SELECT unnest(range({VALUE_DIM})) AS i),
  s AS (SELECT q_row, layer, k, i, sum(e * value[i + 1]) / sum(e) AS f, sum(CASE WHEN top <= k THEN e * value[i + 1] ELSE 0 END) / sum(CASE WHEN top <= k THEN e ELSE 0 END) AS t, sum(CASE WHEN rnd <= k THEN e * value[i + 1] ELSE 0 END) / sum(CASE WHEN rnd <= k THEN e ELSE 0 END) AS r FROM lg, ks, i8 WHERE k <= n GROUP BY ALL)
  SELECT layer, CAST(k AS INTEGER) AS k, round(avg(pow(f - t, 2)), 6) + 0.0 AS mse, round(avg(pow(f - r, 2)), 6) + 0.0 AS mse_random FROM s GROUP BY layer, k""")
def topk_mse_curve(spark: SparkSession, d: str) -> DataFrame:
    """Error of attention over the k best keys against all keys, and over k keys chosen by a hash, by layer and k."""
    q, kv = views.queries(spark, d), views.keys(spark, d)
    diff = vec.sub(vec.scale(F.col("nt"), 1 / F.col("dt")), F.col("exact"))
    err = None
    for name, by_hash in (("mse", False), ("mse_random", True)):
        s = tail.cut_scan(q, kv, CELL, CURVE_CUTS, SCALING, VALUE_DIM, by_hash=by_hash)
        e = s.select("q_row", F.col("cut").alias("k"), (vec.dot(diff, diff) / VALUE_DIM).alias(name))
        err = e if err is None else err.join(e, ["q_row", "k"])
    both = err.join(q.select("q_row", "layer"), "q_row")
    return both.groupBy("layer", "k").agg(_r(F.avg("mse")).alias("mse"), _r(F.avg("mse_random")).alias("mse_random"))


@query(f"""WITH {KEYS}, n AS (SELECT layer, kv_head, count(*) AS n_keys FROM keys GROUP BY ALL), c AS (SELECT layer, kv_head, n_keys, unnest([8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) AS c FROM n),
  e AS (SELECT layer, kv_head, c FROM c UNION SELECT layer, kv_head, CAST(least(greatest(c + round(c * 0.1), 1), n_keys - 1) AS BIGINT) FROM c UNION SELECT layer, kv_head, {KEEP} FROM n)
  SELECT layer, kv_head, array_to_string(list_sort(list(c)), ',') AS cuts FROM e GROUP BY layer, kv_head""")
def eval_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Every cut that a head's build evaluates: the ladder, its shifted cuts, and what retrieval keeps."""
    n = views.keys(spark, d).groupBy(*HEAD).agg(F.count("*").alias("n_keys"))
    cuts = parse.eval_cuts(parse.ladder(F.lit(8), F.lit(4096)), F.lit(SHIFT), F.col("n_keys"), F.lit(KEEP))
    return n.select(*HEAD, F.array_join(cuts.cast("array<string>"), ",").alias("cuts"))
