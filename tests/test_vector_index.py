"""The inverted-file index and fitted codebooks: recall, exactness with all cells, pruning, dead codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import codebooks, similarity, vector_index
from strandline.sources import files
from strandline.sources.tables import table


def found(df):
    return {(r["query"], r.vec_id, r.similarity, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def embeddings(spark, sf):
    return table(spark, sf, "embeddings").cache()


@pytest.fixture(scope="module")
def index(spark, embeddings):
    path = files.scratch(spark)
    vector_index.build(embeddings, path)
    return path


@pytest.fixture(scope="module")
def exact(embeddings):
    return found(similarity.all_pairs_top_k(embeddings.filter("vec_id % 20 = 0"), embeddings, 10))


@pytest.mark.parametrize("refine", [None, 8])
def test_recall(spark, index, embeddings, exact, refine):
    nprobe = vector_index.probes_for(spark, index, embeddings.filter("vec_id % 20 = 7"))
    cells = spark.read.parquet(f"{index}/cells").count()
    assert 1 <= nprobe < cells
    got = found(vector_index.search(spark, index, embeddings.filter("vec_id % 20 = 0"), 10, nprobe, refine))
    assert len({g[:2] for g in got} & {e[:2] for e in exact}) >= 0.9 * len(exact) and len(got) == len(exact)


def test_all_cells_are_exact(spark, index, embeddings, exact, monkeypatch):
    asked = embeddings.filter("vec_id % 20 = 0")
    assert found(vector_index.search(spark, index, asked, 10)) == exact
    monkeypatch.setattr(vector_index, "BLOCK", 7)  # many blocks of rows and of queries
    assert found(vector_index.search(spark, index, asked, 10)) == exact


def test_every_row_is_in_one_list(spark, index, embeddings):
    lists = spark.read.parquet(f"{index}/lists")
    assert lists.count() == embeddings.count() == lists.select("id").distinct().count()
    assert spark.read.parquet(f"{index}/cells").agg(F.sum("n")).first()[0] == embeddings.count()


def test_only_probed_cells_are_read(spark, index, embeddings):
    one = vector_index.search(spark, index, embeddings.filter("vec_id = 20"), 10, 2)
    plan = one._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters: [" in line and "cell" in line.split("PartitionFilters: [")[1].split("]")[0]]
    assert scans and any("IN (" in line.split("PartitionFilters: [")[1] for line in scans)


def test_search_rows_without_vectors_and_copies(spark, monkeypatch):
    """Copies of one vector make a third of the table; zero vectors and nulls are in no list."""
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(40)] + [(200, [0.0] * 8), (201, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = files.scratch(spark)
    vector_index.build(df, path, cells=5)
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    real = df.filter("vec_id < 200")
    assert found(vector_index.search(spark, path, real, 5)) == found(similarity.all_pairs_top_k(real, real, 5))
    with pytest.raises(ValueError):
        vector_index.build(df.limit(0), path)
    with pytest.raises(ValueError):
        vector_index.build(df, path, subspaces=3)


def test_kinds():
    cases = {(99_999,): "FLAT", (100_000,): "IVF_FLAT", (9_999_999, 9.9): "IVF_SQ8", (10_000_000,): "HNSW", (99_999_999, 50, 0.981): "HNSW_HIGH_RECALL", (100_000_000,): "DISKANN"}
    assert {c: vector_index.recommended(*c) for c in cases} == cases


def test_fitted_levels_beat_the_first_vectors(spark, embeddings):
    report = [tuple(r) for r in codebooks.level_report(embeddings, codebooks.fit_levels(embeddings, 8, 3)).orderBy("level").collect()]
    first = np.array([r.embedding for r in embeddings.filter("vec_id < 24").orderBy("vec_id").collect()]).reshape(3, 8, -1)
    plain = [tuple(r) for r in codebooks.level_report(embeddings, list(first)).orderBy("level").collect()]
    assert [r[0] for r in report] == [1, 2, 3] and report[0][1] > report[1][1] > report[2][1]
    assert all(a[1] < b[1] for a, b in zip(report, plain)) and all(r[2] == 1.0 for r in report)


def test_report_against_numpy(spark, embeddings):
    x = np.array([r.embedding for r in embeddings.orderBy("vec_id").collect()], float)
    books = [x[:5], x[5:10]]
    got = {r.level: (r.mse, r.utilisation) for r in codebooks.level_report(embeddings, books).collect()}
    for level, book in enumerate(books, 1):
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        x = x - book[at]
        assert got[level][0] == pytest.approx((x**2).mean()) and got[level][1] == len(set(at)) / 5


def test_dead_codes_come_to_life(spark):
    """Most rows are one vector, so most of the first codes are equal; each of the eight groups gets a code all the same."""
    groups = [(i, [float(10 * (i % 8)), float(i % 8)]) for i in range(64)] + [(100 + i, [0.0, 0.0]) for i in range(500)]
    df = spark.createDataFrame(groups, "vec_id long, embedding array<double>").repartition(3)
    codes = codebooks.fit(df, 8)[0]
    assert sorted(codes.round(9).tolist()) == [[10.0 * k, float(k)] for k in range(8)]
    assert codebooks.fit(df.filter("vec_id = 3"), 4).shape == (1, 4, 2)


@pytest.mark.parametrize("blocks", [1, 3])
def test_blocks_against_brute_force(spark, monkeypatch, blocks):
    """Small tiles, ties of copies, rows to leave out, a least similarity and groups."""
    monkeypatch.setattr(similarity, "TILE", 7)
    monkeypatch.setattr(similarity, "SLICE", 5)
    made = np.random.default_rng(5).normal(size=(20, 3))
    rows = [(i, float(i % 2), [float(x) for x in made[i % 20]], [i // 2, 55, 1000]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, kind double, embedding array<double>, gone array<long>")
    unit = made / np.linalg.norm(made, axis=1)[:, None]

    def brute(a, seen, own):
        scores = sorted((-round(float(unit[a % 20] @ unit[b % 20]), 6), b) for b in range(60) if b % 2 == a % 2 and b not in seen and (own or b != a))
        return [(b, -s) for s, b in scores if -s >= 0.2][:4]

    asked = df.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("name"), "kind", "embedding", "gone")
    kinds = (
        (df, {}, lambda a: brute(a, [], False)),
        (asked, {"query_id": "name", "without": "gone"}, lambda a: brute(a, rows[a][3], True)),
    )
    for queries, more, expected in kinds:
        got = similarity.all_pairs_top_k(queries, df, 4, blocks=blocks, least=0.2, within="kind", **more).orderBy("query", "rank").collect()
        for a in range(60):
            mine = [(r.vec_id, r.similarity) for r in got if str(r.query).lstrip("q") == str(a)]
            assert mine == [(b, pytest.approx(s)) for b, s in expected(a)]


def test_what_is_held_at_once_does_not_grow_with_the_cells(monkeypatch):
    """distances of as many rows are held as fit, however many codes there are, and the nearest are the same."""
    from strandline.operators import codebooks

    draw = np.random.default_rng(5)
    x, codes, held = draw.normal(size=(5000, 4)), draw.normal(size=(700, 4)), []
    real = codebooks.squared_distances

    def distances(a, b):
        held.append(len(a) * len(b))
        return real(a, b)

    monkeypatch.setattr(codebooks, "squared_distances", distances)
    at, far = codebooks.nearest(x, codes)
    assert max(held) <= 1 << 20
    every = real(x, codes)
    assert (at == every.argmin(axis=1)).all() and np.allclose(far, every.min(axis=1))
