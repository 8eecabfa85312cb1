"""Periodic runs, pruned graphs and the filter audit against plain Python, with every awkward kind of row."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from compare import connect, rows_of, rows_of_sql
from pyspark.sql import functions as F
from test_operators import LONG, ROWS

from strandline.llm import audit, graphs, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- 11 runs


def plain_runs(x, least=runs.LEAST):
    """(start, end, period) by trying every period at every place."""
    found = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            if x[i] != x[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p), p)
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    gone = {i for s, e, p in found for i in range(s + p, e)}
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    first = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return (doc_id, len(found), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_of_random_words():
    draw = np.random.default_rng(11)
    for _ in range(600):
        texts = []
        for _ in range(draw.integers(1, 6)):
            n = int(draw.integers(0, 60))
            x = draw.integers(0, draw.integers(1, 4), n).tolist()
            if draw.random() < 0.5 and n > 4:
                p = int(draw.integers(1, n // 2))
                x = [x[i % p] for i in range(n)]
                if draw.random() < 0.5:
                    x[int(draw.integers(0, n))] = 9
            texts.append(x)
        first = np.append(0, np.cumsum([len(x) for x in texts]))
        got = runs.runs(np.array(sum(texts, []), np.int64), first)
        assert list(zip(*(c.tolist() for c in got))) == [(s + f, e + f, p) for x, f in zip(texts, first.tolist()) for s, e, p in plain_runs(x)]


def test_grid_in_small_parts(monkeypatch):
    """Results don't hang on how many points are looked at together."""
    words = np.concatenate([np.tile(np.arange(k), 40) for k in (1, 2, 3, 7, 50)])
    first = np.array([0, 40, 120, 240, 520, len(words)])
    whole = runs.runs(words, first)
    monkeypatch.setattr(runs, "_POINTS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, runs.runs(words, first))) and len(whole[0]) == 5


def test_names_are_equal_for_equal_stretches():
    words = np.array([1, 2, 1, 2, 1, 3, 1, 2, 1, 2])
    levels = runs.names(words, np.array([0, 6, 10]))
    assert len(levels) == 2
    for k, level in enumerate(levels):
        for i, j in itertools.combinations(range(10), 2):
            same = (i < 6) == (j < 6) and words[i : i + 2**k].tolist() == words[j : j + 2**k].tolist() and j + 2**k <= (6 if j < 6 else 10)
            assert (level[i] == level[j] and level[i] >= 0) == same


@pytest.mark.parametrize("plant", [True, False])
def test_runs_of_awkward_rows(spark, plant):
    rows = [
        *ROWS,
        (12, "a b c " * 30 + "x " + "d e " * 20),
        (12, "A a " * 8),
        (13, "é\tß\n" * 9),
        (14, " ".join(["w"] * 11)),
        (15, " ".join(["w"] * 12)),
        *((i, " ".join(f"w{k % 17}" for k in range(i))) for i in range(20, 60)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)
    got = [tuple(r) for r in runs.periodic_runs(docs, plant=plant).collect()]
    short = [r for r in rows if r[1] is not LONG]
    expected = [plain_row(*r, plant) for r in short]
    assert sorted((r for r in got if r[0] != 6), key=str) == sorted(expected, key=str)
    assert sum(r[0] == 6 for r in got) == 1
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_op11_against_plain_python(spark, sf):
    """All periods of all documents; words as numbers so that trying everything ends."""
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [r for r in docs if len(WORD.findall(r.text or "")) < 1500]
    assert len(short) > len(docs) * 0.9 and len(got) == len(docs)
    assert {plain_row(r.doc_id, r.text, True) for r in short} <= got
    assert sum(r[1] > 0 for r in got) > 10


# ---- 12 graphs


def plain_neighbours(rows, k, every):
    """Every pair, in double precision."""
    kept = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for q, v in kept:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in kept if (i, w) != (q, v) and len(w) == len(v))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def close(got, expected):
    return [g[:3] for g in got] == [e[:3] for e in expected] and np.allclose([g[3] for g in got], [e[3] for e in expected], rtol=1e-12, atol=0)


def test_every_vector_of_a_small_table_is_found(spark):
    """Copies, ties, repeated rows, one id with two vectors, vectors that take no part, two lengths, several shards."""
    draw = np.random.default_rng(12)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)]  # copies, two of them queries
    rows += [(7, [0.0, 1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0, 0.0]), (20, [0.0, 0.0, 1.0, 0.0]), (200, [1.0, 0.0]), (201, [0.0, 1.0]), (300, [2.0])]
    rows += [(400, None), (420, []), (440, [0.0] * 4), (460, [1.0, None, 0.0, 0.0]), (480, [float("nan"), 1.0, 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("shard", F.lit(2)).repartition(3)
    for shard in (1000, 16):
        got = found(graphs.neighbours(df, k=10, every=20, shard=shard))
        assert close(got, plain_neighbours(rows, 10, 20))
    assert {q for q, *_ in got} == {0, 20, 40, 100, 120, 200}
    assert found(graphs.neighbours(df.limit(0))) == []
    assert found(graphs.neighbours(df.filter("vec_id = 100"))) == []


def test_very_large_and_very_small_vectors(spark):
    draw = np.random.default_rng(3)
    rows = [(i, (draw.normal(size=3) * 1e200).tolist()) for i in range(50)] + [(100 + i, (draw.normal(size=2) * 1e-180).tolist()) for i in range(50)]
    got = found(graphs.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=10))
    want = sorted(plain_neighbours([(i, (np.array(v) / (1e200 if i < 100 else 1e-180)).tolist()) for i, v in rows], 5, 10))
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_edges_of_a_graph():
    """Few edges, each vector reached, and pruning as by its rule."""
    draw = np.random.default_rng(5)
    for vectors in (draw.normal(size=(700, 8)), np.concatenate([draw.normal(size=(300, 8)) * 1e-6, draw.normal(size=(300, 8)) * 1e-6 + 5, draw.normal(size=(20, 8))])):
        links = graphs.graph(vectors, edges=12)
        assert graphs._reached(links).all() and (links != np.arange(len(links))[:, None]).all()
        assert np.median((links >= 0).sum(axis=1)) <= 12
    near = draw.permutation(700)[None, :80]
    vectors = draw.normal(size=(700, 8))
    expected, left = [], sorted(set(near[0].tolist()) - {3}, key=lambda i: ((vectors[i] - vectors[3]) ** 2).sum())
    while left and len(expected) < 12:
        best = left[0]
        expected.append(best)
        left = [i for i in left if graphs.RELAX * np.linalg.norm(vectors[best] - vectors[i]) > np.linalg.norm(vectors[3] - vectors[i])]
    assert graphs.pruned(vectors, np.array([3]), near, 12)[0, : len(expected)].tolist() == expected


@pytest.mark.parametrize("shard", [graphs.SHARD, 64])
def test_op12_recall(spark, sf, shard):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    expected = plain_neighbours(rows, 10, 20)
    got = found(graphs.neighbours(table, every=20, shard=shard))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert len({(g[0], g[2]) for g in got} & {(e[0], e[2]) for e in expected}) >= 0.97 * len(expected)
    assert close(found(queries.op12_pruned_graph(spark, sf)), plain_neighbours(rows, 10, 100))


def test_recall_among_many_near_copies(spark):
    """A third of the vectors are one vector with little changes, a third are exact copies."""
    draw = np.random.default_rng(8)
    base = draw.normal(size=16)
    near = [base + draw.normal(size=16) * 1e-3 for _ in range(500)]
    rows = [(i, v.tolist()) for i, v in enumerate([*draw.normal(size=(500, 16)), *near, *[base] * 500])]
    expected = plain_neighbours(rows, 10, 20)
    got = found(graphs.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, shard=300))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert len({(g[0], g[2]) for g in got} & {(e[0], e[2]) for e in expected}) >= 0.95 * len(expected)


# ---- 13 audit


def plain_audit(docs, labels):
    good, toxic = ({i for i, *both in labels if i is not None and both[k] == 1} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": any((t or "") == text and j is not None and (i is None or j < i) for j, t, _ in docs),
        }
        rows.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        took, lines = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                took[f] += len(gone)
                fails = sum(f in r[0] for r in own)
                only = sum(r[0] == {f} for r in own)
                lines.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*line, took[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit_of_awkward_rows(spark):
    many = " ".join(f"w{i}" for i in range(200))
    sources = ["s", None, "", "t"]
    docs = [(i, t, sources[k % 4]) for k, (i, t) in enumerate(ROWS)]
    docs += [(30, many, "s"), (31, many, "s"), (31, many, "s"), (32, many, "t"), (None, many, "t"), (33, many + " #", "t"), (34, "w " * 400, "s"), (35, "ÄÖ Ab" * 20, "s"), (36, "x" * 49 + "A", "s"), (37, "x" * 50 + "A", "s"), (38, many[:-1], "u")]
    labels = [(30, 1, 0), (31, 0, 1), (31, 1, 0), (None, 1, 1), (34, None, 1), (35, 1, None), (999, 1, 1), (6, 1, 1), (2, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for name in ("mask", "part", "digest", "n", "quality", "d"):
        df = df.withColumn(name, F.lit(3))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(5)).withColumn("part", F.lit("q"))
    assert audited(audit.filter_audit(df.repartition(3), told)) == plain_audit(docs, labels)
    assert audited(audit.filter_audit(df, told.limit(0))) == plain_audit(docs, [])
    assert audited(audit.filter_audit(df.limit(0), told)) == []


def test_survivors_of_every_subset():
    counts = np.random.default_rng(13).integers(0, 9, (2, 32))
    got = audit.survivors(counts)
    for s in range(32):
        assert got[:, s].tolist() == counts[:, [m for m in range(32) if not m & s]].sum(axis=1).tolist()


def test_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 1, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    assert audited(audit.order_steps(counts, "XY")) == [
        ("p", "XY", 1, 5, 3, 0, 1, 1, 1, 4),
        ("p", "XY", 2, 5, 0, 2, 0, 0, 0, 2),
        ("p", "YX", 1, 6, 2, 0, 0, 1, 1, 2),
        ("p", "YX", 2, 5, 1, 2, 1, 0, 0, 4),
    ]


def test_op13_against_sql_and_plain_python(spark, sf):
    df = queries.op13_filter_audit(spark, sf)
    columns, expected = rows_of_sql(connect(sf), queries.SQL["op13_filter_audit"])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(df) == plain_audit(docs, labels)
