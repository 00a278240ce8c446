from sparktab.operators import runs
from sparktab.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_oldest_first_turns_the_newest_round(spark):
    tables = fx.runs_fixture(spark, SF), fx.run_activations(spark, SF), fx.run_deletes(spark, SF)
    newest = [r.run_id for r in runs.list_runs(*tables, limit=20).collect()]
    assert [r.run_id for r in runs.list_runs(*tables, limit=20, oldest_first=True).collect()] == newest[::-1]
    every = [r.run_id for r in runs.list_runs(*tables).collect()]
    assert every[:20] == newest
    assert [r.run_id for r in runs.list_runs(*tables, oldest_first=True).collect()] == every[::-1]
