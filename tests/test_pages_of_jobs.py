"""Pages of a job listing behind any offset."""

import random

import pytest

from doctables.operators import jobs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    times = [rng.randrange(10**12) for _ in range(150)] + [5 * 10**11 + rng.randrange(30) for _ in range(100)] + [7] * 40 + [-5, -(10**10)] + [None] * 9
    return [(f"j{i}", t) for i, t in enumerate(times)]


@pytest.mark.parametrize("offset, limit", [(1, 1), (60, 50), (140, 30), (200, 400), (255, 20), (285, 10), (292, 5), (296, 50), (301, 3), (9999, 5)])
def test_pages(spark, rows, offset, limit):
    df = spark.createDataFrame(rows, "id string, created_at long").repartition(4)
    newest = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [tuple(r) for r in jobs.page_jobs(df, limit, offset).collect()] == newest[offset:offset + limit]


def test_an_offset_without_a_limit_does_not_count(spark, rows):
    assert jobs.page_jobs(spark.createDataFrame(rows, "id string, created_at long"), 0, 10).count() == len(rows)
    assert jobs.page_jobs(spark.createDataFrame([], "id string, created_at long"), 5, 10).count() == 0
