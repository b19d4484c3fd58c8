"""Each registered query against its SQL, as the driver does it."""

import duckdb
import pytest

from tidemill.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        same = (got[c] == want[c]) | got[c].isna() & want[c].isna()
        assert same.all(), (c, got[c][~same].iloc[0], want[c][~same].iloc[0])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"fold_scores", "labelled_events"}))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["clean_stage", "join_stage"])
def test_a_bid_of_zero_leaves_the_ask(spark, sf_dir, tmp_path, name):
    """Sides are cleaned each by its own prices: where the bid is zero the ask is the spread, which is sane."""
    events = f"select * replace (case when event_id % 97 = 0 then 0.0 else value end as value) from '{sf_dir}/events.parquet'"
    duckdb.sql(f"copy ({events}) to '{tmp_path}/events.parquet'")
    c = duckdb.connect()
    c.sql(f"create view events as from '{tmp_path}/events.parquet'")
    assert c.sql("select count(*) from events where value = 0").fetchall()[0][0] > 5
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    rows = lambda x: sorted(map(tuple, x[columns].astype(str).values))
    assert rows(got) == rows(want)
