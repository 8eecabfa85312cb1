"""What must hold for results that no SQL can repeat: clusters, components, approximate search, drawn triples."""

import numpy as np
import pytest

from strandline.operators import sequences, similarity
from strandline.plans import registry
from strandline.sources.tables import behaviours, table


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = table(spark, sf, "embeddings").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def test_lsh_finds_the_nearest(spark, sf, vectors):
    ids, x = vectors
    df = table(spark, sf, "embeddings").cache()
    hits = 0
    for q in (0, 20, 40, 60, 80, 100, 120, 140):
        exact = {r.vec_id for r in similarity.top_k(df, x[q].tolist(), 10).collect()}
        found = similarity.lsh_candidates(df, x[q].tolist(), 10).collect()
        hits += len(exact & {r.vec_id for r in found})
        assert all(r.similarity == pytest.approx(float(x[r.vec_id] @ x[q]), abs=1e-5) for r in found)
    assert hits >= 0.9 * 80
    assert 0 not in {r.vec_id for r in registry.queries()["vs03_lsh_search"](spark, sf).collect()}


def test_clusters_fit_better_than_chance(spark, sf, vectors):
    ids, x = vectors
    found = {r.vec_id: r.cluster for r in registry.queries()["vs11_kmeans"](spark, sf).collect()}
    cluster = np.array([found[i] for i in ids])
    assert set(cluster) == set(range(8))

    def spread(own):
        return sum(((x[own == c] - x[own == c].mean(axis=0)) ** 2).sum() for c in range(8))

    chance = [spread(np.random.default_rng(k).permutation(cluster)) for k in range(20)]
    assert spread(cluster) < min(chance)
    centres = np.stack([x[cluster == c].mean(axis=0) for c in range(8)])
    nearest = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == cluster).mean() > 0.9


def test_components_equal_those_of_the_whole_matrix(spark, sf, vectors):
    ids, x = vectors
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    rows = {r.vec_id: (r.pc1, r.pc2) for r in registry.queries()["vs12_pca"](spark, sf).collect()}
    got = np.array([rows[i] for i in ids])
    for k in range(2):
        own = centred @ axes[k]
        assert np.allclose(got[:, k], own, atol=2e-6) or np.allclose(got[:, k], -own, atol=2e-6)


def test_triples_hold_no_touched_item(spark, sf):
    ev = behaviours(spark, sf).cache()
    pool = ev.select("item_id").distinct().collect()
    touched = {}
    for r in ev.select("user_id", "item_id").distinct().collect():
        touched.setdefault(r.user_id, set()).add(r.item_id)
    rows = sequences.contrastive_triples(ev, ev.select("item_id").distinct(), 100, 4).collect()
    plain = {(r.user_id, r.event_id): (tuple(r.anchor), r.positive) for r in sequences.contrastive(ev, 100).collect()}
    assert {(r.user_id, r.event_id): (tuple(r.anchor), r.positive) for r in rows} == plain and rows
    for r in rows:
        assert not touched[r.user_id] & set(r.negatives)
        assert len(set(r.negatives)) == len(r.negatives) == min(4, len({p.item_id for p in pool} - touched[r.user_id]))
