"""Vector links that are rare, and ids that name several vectors."""

import numpy as np

from shelfwise.llm import graph_dedup


def links_of(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = unit @ unit.T >= 0.9
    np.fill_diagonal(found, False)
    return found


def test_rare_pairs_are_found_and_the_audit_tells_the_truth(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(40):
        side = rng.normal(size=32)
        side -= (side @ x[k]) * x[k]
        cosine = rng.uniform(0.905, 0.915)
        x[2000 + k] = cosine * x[k] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    truth = links_of(x).sum(1)
    got = {r.vec_id: r for r in graph_dedup.near_vectors(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    has = np.flatnonzero(truth)
    recall = np.mean([got[i].n_links / truth[i] for i in has])
    print("recall", recall, "audited", got[0].audited_recall, len(has))
    assert len(has) == 80 and recall >= 0.98 and all(got[i].n_links <= truth[i] for i in got)
    assert abs(got[0].audited_recall - recall) <= 0.02


def test_nothing_linked_is_nothing_measured(spark):
    x = np.random.default_rng(3).normal(size=(300, 40))
    rows = graph_dedup.near_vectors(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.audited_recall) for r in rows} == {(0, None)} and all(r.kept for r in rows)


def test_an_id_may_name_several_vectors(spark):
    rng = np.random.default_rng(4)
    a, b, c = (v / np.linalg.norm(v) for v in rng.normal(size=(3, 24)))
    near = lambda v: (v + 0.02 * rng.normal(size=24)).tolist()
    rows = [(7, c.tolist()), (7, near(a)), (7, near(b)), (3, near(a)), (4, near(b)), (9, near(b)), (9, near(b)), (5, None)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in graph_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 1, 3), (4, 3, 4), (5, 0, 5), (7, 0, 7), (7, 1, 3), (7, 3, 4), (9, 3, 4), (9, 3, 4)]
