"""Every query of the core with SQL gives the SQL's rows; those without give some."""

import os

import pytest
from compare import FOLDER, duck, same

from weftlake.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    same(QUERIES[name](spark, FOLDER), con, SQL[name])


def test_queries_without_sql(spark, con):
    assert set(QUERIES) - set(SQL) == {"pagerank_hosts", "rdd_sample_bernoulli", "url_resolved"}
    # ends by tolerance: all ranks there are, and a further round changes them little
    ranks = {r.host: r["rank"] for r in QUERIES["pagerank_hosts"](spark, FOLDER).collect()}
    near = {r.host: r["rank"] for r in QUERIES["pagerank_hosts_k3"](spark, FOLDER).collect()}
    assert ranks.keys() == near.keys() and sum(abs(ranks[h] - near[h]) for h in ranks) < 0.2 and all(v > 0 for v in ranks.values())
    # random: a tenth, of what there is
    types = [r.value for r in QUERIES["rdd_sample_bernoulli"](spark, FOLDER).collect()]
    (total,) = con.execute("select count(*) from events").fetchone()
    known = {t for (t,) in con.execute("select distinct event_type from events").fetchall()}
    assert set(types) <= known and abs(len(types) - total / 10) < 5 * (total * 0.09) ** 0.5
    # links from the root of a host lead to that host
    for r in QUERIES["url_resolved"](spark, FOLDER).where("href like '/%' and href not like '//%'").collect():
        assert r.target is None or r.target.split("#")[0].endswith(r.href.split("#")[0])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
