import hashlib

import duckdb
import numpy as np
import pytest

from tessella.plans.inference import REPS
from tessella.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_bootstrap_draws_from_all_events(spark):
    rows = duckdb.sql(f"SELECT event_type, list(value ORDER BY event_id) FROM '{FOLDER}/events.parquet' GROUP BY 1").fetchall()
    assert max(len(v) for _, v in rows) > 200
    got = {r.arm: r for r in QUERIES["RS7"](spark, FOLDER).collect()}
    assert got.keys() == {a for a, _ in rows}
    for arm, v in rows:
        draw = lambda rep, j: int(hashlib.md5(f"42:{arm}:{rep}:{j}".encode()).hexdigest()[:8], 16)  # noqa: E731, B023
        means = [np.mean([v[draw(rep, j) % len(v)] for j in range(len(v))]) for rep in range(REPS)]
        assert (got[arm].ci_low, got[arm].ci_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-7)


def test_families_and_groups_are_whole(spark):
    folder = "/root/testdata/sf0.01"
    customers = duckdb.sql(f"SELECT count(*) FROM '{folder}/customer.parquet'").fetchall()[0][0]
    assert customers > 300 and QUERIES["RS15"](spark, folder).count() == customers
    pairs = duckdb.sql(f"SELECT count(*) FROM (SELECT l_suppkey FROM '{folder}/lineitem.parquet' WHERE l_linestatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2)").fetchall()[0][0]
    assert QUERIES["JN13"](spark, folder).count() == pairs


def test_no_cut_is_in_the_sql():
    names = [f"RS{n}" for n in (*range(7, 16), 17)] + ["JN13"]
    assert not any(c in ORACLES[n] for n in names for c in ("range(200)", "k < ", "<= 300", "l_quantity"))
