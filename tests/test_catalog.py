"""The registered queries share stored inputs inside one query only."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from dpmine.plans import catalog


def test_stages_belong_to_one_query():
    built = []

    def query(spark, sf):
        for _ in range(2):
            catalog._once("x", lambda: built.append(sf) or sf)
        return catalog._once("x", lambda: None)
    run = catalog._fresh(query)
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda i: run(None, i), range(40))) == list(range(40))
    assert sorted(built) == list(range(40))
    with pytest.raises(LookupError):
        catalog._once("x", lambda: 1)
