"""Access on small fixtures."""

from __future__ import annotations

from lodestar.operators.access import openable_counts


def test_files_are_counted_by_project_before_users_meet_them(spark):
    visible = spark.createDataFrame([(u, p) for u in range(300) for p in (1, 2)] + [(300, 3), (301, None)], "user_id int, project_id int")
    files = spark.createDataFrame([(i, 1) for i in range(400)] + [(400, 2), (401, None)], "id int, project_id int")
    got = openable_counts(visible, files)
    assert {tuple(r) for r in got.collect()} == {(u, 401) for u in range(300)}
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Join") < joined.rindex("Aggregate"), joined  # the files' sums lie below the join
