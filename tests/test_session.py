import os

from loomfeed.plans import registry
from loomfeed.session import fresh_path, intermediates

D = "/root/testdata/sf0.001"


def test_intermediates_are_gone_after_the_results_are_read(spark):
    names = ["running_totals", "ordered_admission", "overlapping_intervals", "located_changes", "fenced_writers", "recorded_fetches", "stream_leases"]
    for name in names:
        with intermediates(spark) as folder:
            assert registry.queries()[name](spark, D).collect()
            assert os.listdir(folder), name
        assert not os.path.exists(folder), name


def test_scopes_nest(spark):
    with intermediates(spark) as a:
        with intermediates(spark) as b:
            assert b.startswith(a) and fresh_path(spark, "x").startswith(b)
        assert fresh_path(spark, "x").startswith(a + "/x-")
    assert not fresh_path(spark, "x").startswith(a)
