"""Cut plans: always written, never planned anew."""

import types

import pytest

from tracewell.functions.lineage import cut, shared_folder, sweep
from tracewell.plans.draws import one_each


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_a_cut_ends_the_plan_and_computes_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    rows = spark.range(100).mapInArrow(count, "id long").join(spark.range(50), "id")
    held = cut(rows)
    assert joins(held) == 0 and counted.value == 100
    assert sorted(r["id"] for r in held.collect()) == list(range(50)) and counted.value == 100
    assert cut(held.where("id < 0")).isEmpty()


def session(master):
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master=master, applicationId="some"))


def test_without_a_shared_folder():
    with pytest.raises(ValueError, match="must name a folder"):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))


def test_rounds_do_not_grow_the_plan_and_choose_as_in_turn(spark):
    n = 6  # every skill wants the same sessions in the same order: as many rounds as skills
    offers = [(f"k{k}", f"s{s}", s + 1) for k in range(n) for s in range(n)] + [("z", "s0", 1)]
    got = one_each(spark.createDataFrame(offers, "skill string, session_id string, rank int"))
    assert {(r["skill"], r["session_id"]) for r in got.collect()} == {(f"k{k}", f"s{k}") for k in range(n)}
    assert joins(got) == 0
    sweep(spark)
