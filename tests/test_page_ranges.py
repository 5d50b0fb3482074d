from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausemill.operators import catalog


def test_pages_equal_plain_pages_and_open_their_ranges_only(spark):
    rows = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(37)).alias("a"), F.when(F.col("id") % 50 != 0, F.col("id")).alias("b"), "id")
    order = ["a", "b", "id"]
    pages = catalog.page_ranges(rows, order, ranges=16)
    assert pages.total == 1000 and sum(n > 0 for n in pages.sizes) > 8
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    for skip in (0, 1, 19, 333, 640, 985, 999, 1000, 5000):
        got = pages.page(skip=skip, limit=30).collect()
        assert [tuple(r)[:3] for r in got] == want[skip : skip + 30]
        assert all(r.total == 1000 for r in got)
    # The scan of a page inside one range is filtered by that range's number.
    number = next(i for i, n in enumerate(pages.sizes) if n > 2 and i > 4)
    inside = pages.page(skip=sum(pages.sizes[:number]) + 1, limit=1)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(_range,{number})" in plan or f"In(_range, [{number}])" in plan


def test_pages_of_nothing_and_out_of_range(spark):
    none = catalog.page_ranges(spark.range(0), ["id"], ranges=4)
    assert none.total == 0 and none.page().collect() == []
    for skip, limit in ((-1, 20), (0, 0), (0, 101)):
        with pytest.raises(catalog.InvalidPage):
            none.page(skip=skip, limit=limit)
