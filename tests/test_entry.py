import __spark_entry__ as entry


def test_every_sql_has_its_query_and_names_are_unique():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["item", "ref", "A", "B", "C"] and got.count() == 1


def test_wide_pairs_are_dealt_once(spark):
    """Items go to their cell's task, and the metrics need no second exchange."""
    got = entry.queries()["mt_wide_grid"](spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_steps_of_parts_are_made_after_the_shuffle(spark):
    """Parts are dealt to tasks before their steps are made, so no task holds those of a whole file."""
    got = entry.queries()["t11_step_classes"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
