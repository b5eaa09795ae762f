"""The Pareto from batches equals the Pareto over all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lotline.operators import pareto, pareto_state
from lotline.plans import ingest
from tests.conftest import rows

SCHEMA = "visual_id string, devrevstep string, process_step string, functional_bin string, interface_bin string, subflow_latest_flag string, substructure_id string"


def unit_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([f"V{rng.randrange(80)}", None]) if rng.random() < 0.95 else "", rng.choice(["A", "B", None]), rng.choice(["HOT", "COLD", None]),
             rng.choice(["100", "200", None]), rng.choice(["1", "2"]), rng.choice(["Y", "N"]), rng.choice(["U1.U2", "U1.U2", "other"])) for _ in range(n)]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_batches_in_any_order_one_repeated(spark, tmp_path, order):
    batches = [unit_rows(120, s) for s in range(3)]
    path = str(tmp_path / "state")
    assert [pareto_state.add_batch(spark.createDataFrame(batches[i], SCHEMA), path, i) for i in (*order, order[1])] == [True, True, True, False]
    whole = pareto.bin_pareto(spark.createDataFrame(sum(batches, []), SCHEMA))
    assert rows(pareto_state.current_pareto(spark, path), *whole.columns) == rows(whole)
    numbers = [r.number for p in pareto_state._parts(spark, path, "units-") for r in p.collect()]
    assert sorted(numbers) == list(range(len(numbers)))
    pareto_state.compact(spark, path)
    assert rows(pareto_state.current_pareto(spark, path), *whole.columns) == rows(whole)
    assert not pareto_state.add_batch(spark.createDataFrame(batches[0], SCHEMA), path, 0)
    assert pareto_state.add_batch(spark.createDataFrame(batches[0], SCHEMA), path, 9)
    assert rows(pareto_state.current_pareto(spark, path), *whole.columns) == rows(whole)


def test_a_batch_that_fails_leaves_the_state(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "state")
    first = spark.createDataFrame(unit_rows(60, 1), SCHEMA)
    pareto_state.add_batch(first, path, 0)
    before = rows(pareto_state.current_pareto(spark, path))
    bad = first.withColumn("functional_bin", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        pareto_state.add_batch(bad, path, 1)
    assert rows(pareto_state.current_pareto(spark, path)) == before


def test_units_land_in_even_files_whose_number_follows_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "FILE_ROWS", 20)
    df = spark.createDataFrame([(None, "A")] * 200, "visual_id string, lot string").coalesce(1)
    assert ingest.land_units(df, str(tmp_path / "many")) == 10
    back = spark.read.option("header", True).csv(str(tmp_path / "many"))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 200 and len(sizes) >= 5 and max(sizes) <= 60
    assert ingest.land_units(df.limit(0), str(tmp_path / "none")) == 3
    assert spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "none")).count() == 0
