"""Every core query against its SQL in DuckDB; queries without SQL must give rows of a stable schema."""

from __future__ import annotations

import pytest

from compare import connect
from vecloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, con, name):
    got = QUERIES[name](spark, data)
    cols = sorted(got.columns)
    a = sorted(tuple(str(r[c]) for c in cols) for r in got.collect())
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    b = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert a == b


#: Queries without SQL: the table with whose rows they must come out, and what must hold of each row.
HOLDS = {
    "ridge_map": lambda r: len(r.weight) == 8 and len(r.weight[0]) == 32 and len(r.bias) == 8 and r.scale > 0 and r.rows > 0,
    "cut_stats": lambda r: r.err_mean >= 0 and r.err_p90 >= 0 and 0 <= r.worse <= 1 and 0 <= r.phi <= 1 and 0 <= r.const <= 1 + 1e-9 and abs(r.ratio - r.err_mean / r.none_mean) < 1e-9 and abs(r.leftover - (1 - r.const) * (1 - r.r2)) < 1e-9 and -1 <= r.cos_median <= 1,
    "alpha_fit": lambda r: 1 <= r.cut_detected and r.fit_cut >= 1 and (r.alpha is None or 0 <= r.alpha <= 1.5),
    "runtime_stats": lambda r: r.err_mean >= 0 and r.none_mean >= 0 and 0 <= r.worse <= 1 and r.ratio_max >= r.ratio_p99,
    "decode_validation": lambda r: r.gate_pass == (r.reason == "") and r.sanity_pass is None and r.rows_ > 0,
    "tail_apply": lambda r: len(r.out) == 8 and r.lse == r.lse and r.active in (True, False),
    "code_signatures": lambda r: r.signatures.endswith("\n") and "\n\n\n" not in r.signatures,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_holds(spark, medium_data, name):
    rows = QUERIES[name](spark, medium_data).collect()
    assert rows and all(HOLDS[name](r) for r in rows)


def test_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() >= 0
