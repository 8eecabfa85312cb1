"""The data source of time ranges, and SQL functions that return tables."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.plans import interfaces
from strandline.sources import files, ranges, table_functions
from strandline.sources.tables import behaviours

# ---- data source


@pytest.fixture(scope="module")
def landed(spark, sf):
    path = files.scratch(spark)
    ranges.land(behaviours(spark, sf), path)
    return path


def opened(spark, landed, tmp_path, **options):
    df = ranges.read(spark, landed, trace=str(tmp_path), **options)
    return df, lambda: {os.path.basename(os.path.dirname((tmp_path / f).read_text())) for f in os.listdir(tmp_path)}


START = 1704067200


@pytest.mark.parametrize("how", ["options", "filters", "both"])
def test_only_days_of_the_range_are_opened(spark, sf, landed, tmp_path, how):
    low, high = START + 3 * 86400 + 5, START + 5 * 86400 + 7
    options = {} if how == "filters" else {"start": low, "end": high} if how == "options" else {"start": low}
    df, days = opened(spark, landed, tmp_path, **options)
    if how != "options":
        df = df.filter((F.col("seconds") >= low) & (F.col("seconds") < high))
    expected = behaviours(spark, sf).filter((F.col("seconds") >= low) & (F.col("seconds") < high))
    names = [f.split()[0] for f in ranges.SCHEMA.split(", ")]
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, expected.select(*names).collect()))
    first = START // 86400
    assert days() == {f"day={first + k}" for k in (3, 4, 5)}


def test_edges_of_the_range(spark, sf, landed, tmp_path):
    one = behaviours(spark, sf).orderBy("event_id").first()
    df, days = opened(spark, landed, tmp_path)
    assert one.event_id in {r.event_id for r in df.filter(F.col("seconds") == one.seconds).collect()}
    assert days() == {f"day={one.seconds // 86400}"}
    midnight = START + 86400
    assert df.filter((F.col("seconds") > midnight - 1) & (F.col("seconds") <= midnight - 1)).count() == 0
    none, _ = opened(spark, landed, tmp_path, start=0, end=5)
    assert none.count() == 0 and none.columns == [f.split()[0] for f in ranges.SCHEMA.split(", ")]


def test_remote_folders_are_refused():
    with pytest.raises(ValueError):
        ranges._local("viewfs://store/x")


# ---- table functions


@pytest.fixture(scope="module")
def functions(spark, sf):
    interfaces._functions(spark, sf)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


CALLS = {
    "candidates": ("tf_asked_users", "user_id", "NULL, NULL, 4"),
    "similar_by_behaviour": ("(SELECT DISTINCT item_id FROM tf_weights)", "item_id", "5"),
    "items_for_user": ("tf_asked_users", "user_id", "NULL, 5, 0D"),
    "similar_items": ("tf_items", "item_id", "3, false"),
    "similar_users": ("tf_asked_users", "user_id", "3"),
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_lateral_calls_equal_single_calls(spark, functions, name):
    source, key, more = CALLS[name]
    whole = rows(spark.sql(f"SELECT a.{key}, f.* FROM {source} a, LATERAL {name}(a.{key}, {more}) f"))
    assert whole
    for one in sorted({r[0] for r in whole})[:4]:
        single = rows(spark.sql(f"SELECT * FROM {name}({one}, {more})"))
        assert single == sorted((r[1:] for r in whole if r[0] == one), key=str)


def test_optional_arguments(spark, functions):
    kind, category = spark.sql("SELECT type, category FROM tf_items WHERE active").first()
    found = spark.sql(f"SELECT i.type, i.category FROM candidates(-5, '{kind}', '{category}', 50) c JOIN tf_items i USING (item_id)").distinct().collect()
    assert [tuple(r) for r in found] == [(kind, category)]
    assert spark.sql("SELECT * FROM candidates(-5, NULL, NULL, 7)").count() == 7  # a user who has seen nothing
    assert spark.sql("SELECT * FROM items_for_user(-5, NULL, 7, 0D)").count() == 0  # and has no vector
    assert spark.sql("SELECT * FROM items_by_semantic_id(array(99, 1, 1), 7)").count() == 0


def test_functions_against_dataframes(spark, sf, functions):
    from strandline.operators import recommend, similarity

    items = spark.table("tf_items").filter("active")
    seen = spark.table("tf_seen_month").filter("user_id = 3").select("item_id")
    left = items.join(seen, "item_id", "left_anti").orderBy(F.desc_nulls_last("popularity"), F.desc_nulls_last("rating"), "item_id").limit(9)
    assert [r.item_id for r in left.collect()] == [r.item_id for r in spark.sql("SELECT * FROM candidates(3, NULL, NULL, 9)").orderBy("rank").collect()]
    vector = items.filter("item_id = 12 AND embedding IS NOT NULL").first().embedding
    near = similarity.top_k(items.filter("embedding IS NOT NULL"), vector, 6, id_="item_id", exclude=[12])
    assert rows(near) == rows(spark.sql("SELECT similar_item_id, similarity FROM similar_items(12, 6, false)"))
    ev = behaviours(spark, sf)
    pairs = recommend.cooccurrence(ev.filter(F.col("action").isin("click", "purchase"))).filter("item_a = 8").select("item_b", "users")
    assert rows(pairs) == rows(spark.sql("SELECT similar_item_id, users FROM similar_by_behaviour(8, 1000)"))


def test_registered_again(spark, functions):
    table_functions.register(spark)
    assert spark.sql("SELECT * FROM similar_users(1, 2)").count() <= 2


@pytest.mark.parametrize("name", ["ud06_similar_users", "ud06_items_for_user", "ud06_similar_items"])
def test_all_users_by_blocks(spark, sf, name):
    plan = getattr(interfaces, name)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


@pytest.mark.parametrize("name", ["ud06_candidates", "ud06_items_by_semantic_id"])
def test_first_places_only(spark, sf, name):
    """No user or item meets the whole list."""
    plan = getattr(interfaces, name)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "semantic_id#" not in "".join(x for x in plan.splitlines() if "Join Inner" in x)
