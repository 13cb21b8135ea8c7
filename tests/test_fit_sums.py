"""What a fit sends to the driver: it goes by the models and not by how the rows are stored."""

import gc

import numpy as np

from shelfwise.operators import tree_boosting as boosting

from test_fits import NAMES, blocks_of, data  # noqa: F401

SPECS = [boosting.Spec("y", "train", rounds=3, leaves=8, least_rows=20), boosting.Spec("y", "few", loss="poisson", rounds=3, leaves=8, least_rows=20)]


def sent(spark):
    """Bytes of the results of all tasks so far."""
    jvm, sc = spark._jvm, spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).resultSize() for k in range(stages.size()))


def fitted(spark, data, partitions):  # noqa: F811
    _, edges, blocks, uses = blocks_of(spark, *data, partitions)
    before = sent(spark)
    models = boosting.fit(blocks, NAMES, edges, ["y"], uses, SPECS)
    return models, sent(spark) - before


def test_sums_dont_grow_with_partitions(spark, data, monkeypatch):  # noqa: F811
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    few, few_bytes = fitted(spark, data, 2)
    many, many_bytes = fitted(spark, data, 12)
    assert many_bytes < 1.5 * few_bytes
    # each of 12 tasks has a table, and others add them up
    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    monkeypatch.setattr(boosting, "TREE_FROM", 5)
    added, _ = fitted(spark, data, 12)
    # and without that stage
    monkeypatch.setattr(boosting, "TREE_FROM", 64)
    apart, _ = fitted(spark, data, 12)
    for other in (many, added, apart):
        assert all((np.array(a) == np.array(b)).all() for m, n in zip(few, other) for s, t in zip(m.trees, n.trees) for a, b in zip(s, t))


def test_workers_dont_search_what_they_loaded_for_garbage(spark, data):  # noqa: F811
    fitted(spark, data, 2)
    assert max(spark.sparkContext.parallelize(range(8), 4).map(lambda _: gc.get_freeze_count()).collect()) > 0
