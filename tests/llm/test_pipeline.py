"""Queries of the subpackage over the driver's small tables, and the pipeline stage by stage."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, rows_of, rows_of_sql
from strandline.llm import queries, simhash

COLUMNS = corpus_pipeline.COLUMNS


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_its_rows(spark, sf, name):
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    found = queries.QUERIES[name](spark, sf).count()
    sizes = {"op12_pruned_graph": 10 * spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 100 = 0").count()}
    sizes["op13_filter_audit"] = 600 * spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().count()
    if name.split("_")[0] in ("op2", "op4", "op6"):
        assert found > 0
    elif name in sizes:
        assert found == sizes[name]
    else:
        assert found == documents


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    columns, expected = rows_of_sql(connect(sf), queries.SQL[name])
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == columns and rows_of(df) == expected


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_keeps_the_columns_and_takes_effect(stages):
    for docs in stages[:-1]:
        assert docs.columns == COLUMNS
    assert stages[-1].columns[: len(COLUMNS)] == COLUMNS
    for before, after in zip(stages[:-1], stages[1:]):
        assert ids(after) <= ids(before)
    assert stages[1].count() < stages[0].count() and stages[4].count() <= stages[3].count()


def test_stages_do_what_their_operators_say(spark, sf, stages):
    predicted = queries.op9_quality_ftrl(spark, sf)
    assert ids(stages[1]) == ids(predicted.filter("predicted = 1"))
    left = simhash.near_duplicates(stages[3])
    assert left.groupBy("component_id").count().filter("count > 1").count() == 0
    assert ids(stages[3]) == plain_representatives(stages[2].collect())
    assert stages[-1].filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert stages[-1].count() == stages[4].count()


def plain_representatives(documents):
    """The least doc_id of each group of documents whose fingerprints or five-word shingles are alike, by comparing all pairs."""
    from test_operators import WORD, ascii_lower, plain_fingerprint

    def shingles(text):
        words = WORD.findall(ascii_lower(text))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    found = sorted({(r.doc_id, r.text) for r in documents})
    sets, fps = [shingles(t) for _, t in found], [plain_fingerprint(t) for _, t in found]
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            small, large = sorted((len(sets[a]), len(sets[b])))
            alike = (fps[a] ^ fps[b]).bit_count() <= simhash.DISTANCE
            if not alike and small >= simhash.SIMILAR * large:
                shared = len(sets[a] & sets[b])
                alike = shared >= simhash.SIMILAR * (small + large - shared) > 0
            if alike:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {found[find(a)][0] for a in range(len(found))}


def test_run_gives_the_last_stage(spark, sf, stages):
    assert rows_of(corpus_pipeline.run(spark, sf).select("doc_id", "text", "n_pieces")) == rows_of(stages[-1].select("doc_id", "text", "n_pieces"))


def test_stages_on_awkward_rows(spark, sf):
    rows = [(1, None, None, None, None), (None, "a text", "en", "s", 6), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "x y z w " * 9, None, "s", None)]
    rows += [(4, " ".join(f"long{i % 9973} word{i % 101}" for i in range(60_000)), "en", "s", 1)]
    whole = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    whole = whole.withColumn("score", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("IDS", F.lit(2))  # names that stages use themselves
    for docs in (whole, whole.limit(0)):
        left = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf).cache()
            assert docs.columns[:5] == corpus_pipeline.COLUMNS and (len(docs.columns) == 5) == (k < 4)
            left.append(sorted((tuple(r)[:2] for r in docs.collect()), key=str))
        for before, after in zip(left, left[1:]):
            assert not collections.Counter(after) - collections.Counter(before)
        assert left[1] == left[0] and left[3] == left[2] == left[4]  # nothing to cut, no benchmark item
        if left[0]:
            # null, empty and equal rows are one group; the others differ
            texts = [t for _, t in left[0]]
            blank = [t for t in texts if not t]
            assert len(left[2]) == len({t for t in texts if t}) + bool(blank)
            assert all(r.decoded == r.text for r in docs.collect() if r.text is not None)


def test_decontamination_against_aligning_everything(spark, sf):
    """Every document aligned whole with every item, without seeds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from strandline.llm import decontaminate, textblocks

    items = [decontaminate.item_of(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        block = textblocks.block_of(pc.utf8_lower(pa.array([r.text])), only_words=True)
        words = block.hashed(range_of(block), 1)
        for item in items:
            if decontaminate.align(item.words, words)[0] / (decontaminate.MATCH * len(item.words)) >= decontaminate.THRESHOLD:
                expected.add((r.doc_id, item.number))
    got = {(r.doc_id, r.item_id) for r in queries.op2_benchmark_decontamination(spark, sf).collect()}
    assert got == expected and expected


def range_of(block):
    import numpy as np

    return np.arange(int(block.first[-1]))


def test_repeated_units_against_plain_python(spark, sf):
    from test_operators import plain_repeats

    from strandline.llm import substrings

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("h", F.xxhash64("text")).collect()
    found = queries.op6_substring_dedup(spark, sf).collect()
    got = {(r.doc_id, r.start, r.stop, r.kept_doc_id, r.kept_start, r.kept_stop) for r in found}
    assert got == plain_repeats([(r.doc_id, r.h, r.text) for r in docs], substrings.PASSAGE) and len(found) == len(got)
