"""Bounds and order of the operators: many spans in one text, one id for many rows, plain updates, rows in another order."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import lines, lm, quality, textblocks


def test_many_spans_in_one_text(spark):
    """Every fifth line begins a window that stands in an earlier document; time grows with lines, not with lines times spans."""
    n = 80_000
    shared = "\n".join(f"a{i}\nb{i}\nc{i}\n-{i}" for i in range(n // 5))
    own = "\n".join(f"a{i}\nb{i}\nc{i}\nown {i}\nmine {i}" for i in range(n // 5))
    docs = spark.createDataFrame([(1, shared), (2, own)], "doc_id long, text string").cache()
    start = time.perf_counter()
    found = {r.doc_id: r for r in lines.line_dedup(docs).collect()}
    assert time.perf_counter() - start < 40
    assert found[1].text == shared and found[1].removed_lines == []
    assert found[2].text == "\n".join(f"own {i}\nmine {i}" for i in range(n // 5))
    assert [tuple(r) for r in found[2].removed_lines] == [(5 * i, 5 * i + 2) for i in range(n // 5)]


def test_training_rows_are_bounded(spark):
    """One id for most rows: no more rows than the bound, and all rows where they fit."""
    docs = spark.createDataFrame([(3, f"text {i}") for i in range(200)] + [(i, "other") for i in range(10, 20)], "doc_id long, text string")
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert quality.sample_labelled(docs, labels, "quality", 25).count() <= 25
    all_rows = quality.sample_labelled(docs, labels, "quality", 10_000)
    assert all_rows.count() == docs.filter(quality.learnable()).count()
    one, two = ({tuple(r) for r in quality.sample_labelled(docs.repartition(k), labels, "quality", 25).collect()} for k in (1, 7))
    assert one == two


def plain_ftrl(examples, p):
    """Updates by the published rule, a number at a time."""
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(z, n):
        return 0.0 if abs(z) <= p.l1 else (math.copysign(p.l1, z) - z) / ((p.beta + math.sqrt(n)) / p.alpha + p.l2)

    for text, y in examples:
        times = {}
        for f in quality.features(text).tolist():
            times[f] = times.get(f, 0) + 1
        scale = math.sqrt(max(1, sum(times.values())))
        w = {f: weight(z.get(f, 0.0), n.get(f, 0.0)) for f in times}
        margin = sum(w[f] * times[f] / scale for f in times) + weight(*bias)
        error = 1 / (1 + math.exp(-max(-30, min(30, margin)))) - y
        for f in times:
            g, before = error * times[f] / scale, n.get(f, 0.0)
            z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / p.alpha * w[f]
            n[f] = before + g * g
        b = weight(*bias)
        bias = [bias[0] + error - (math.sqrt(bias[1] + error**2) - math.sqrt(bias[1])) / p.alpha * b, bias[1] + error**2]
    return {f: weight(z[f], n[f]) for f in z}, weight(*bias)


def test_updates_against_plain_ftrl(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.sample_labelled(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality", 100)
    rows = rows.union(rows.limit(5)).cache()  # repeated rows are learnt as often as they are there
    model = quality.train(rows)
    ordered = rows.orderBy(F.xxhash64(F.lit("ftrl"), "doc_id"), "doc_id", "text", F.col("label").cast("double")).collect()
    weights, bias = plain_ftrl([(r.text, r.label) for r in ordered], quality.Ftrl())
    assert model.bias == pytest.approx(bias, abs=1e-9)
    expected = np.zeros(1 << quality.BITS)
    expected[list(weights)] = list(weights.values())
    assert np.abs(model.weights - expected).max() < 1e-9 and (expected != 0).sum() > 100


def test_another_order_is_told_by_the_keys(spark, monkeypatch):
    """As many different n-grams, but not the same: the second reading of the texts gives other words."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string").coalesce(1)
    assert lm.scores(docs).count() == 2
    changed = lm.packed

    def other(rows, block_bytes):
        return changed(rows.withColumn("text", F.translate("text", "abcdefgh", "stuvwxyz")), block_bytes)

    monkeypatch.setattr(lm, "packed", other)
    with pytest.raises(Exception, match="another order"):
        lm.scores(docs).count()


def test_words_of_a_block_keep_their_case():
    block = textblocks.block_of(pa.array(["A bé\tC", None, "x"]), lower=False)
    assert block.words().to_pylist() == [b"A ", "bé ".encode(), b"C ", b"x "]
    assert textblocks.block_of(pa.array([None, " "])).words().to_pylist() == []


def test_made_up_findings_have_a_small_plan(spark, monkeypatch):
    """The dictionary's words are one literal, not one each in every family that draws a word."""
    from strandline.llm import secrets

    literals = []
    lit = F.lit
    monkeypatch.setattr(F, "lit", lambda value: literals.append(value) or lit(value))
    words = [f"word{i:04d}" for i in range(secrets.SAMPLE_WORDS)]
    secrets.families(secrets.Language(None, [0.0], words), F.col("id"))
    assert not set(words) & {x for x in literals if isinstance(x, str)}


def test_made_up_findings_are_cut_from_what_uses_them(spark):
    """Each use of a finding held the expressions of all families once more; the driver kept those plans."""
    from strandline.llm import secrets

    language = secrets.Language(spark.createDataFrame([("water",)], "word string"), [0.0] * (len(secrets.ALPHABET) + 1) ** 2, ["water", "house", "people"])
    made = secrets.sample_findings(spark, language, 240, first=5)
    for df in (made, secrets.with_features(made.filter("label IS NOT NULL"), language)):
        plan = df._jdf.queryExecution().toString()
        assert "aws_secret_access_key" not in plan and "sha2" not in plan
    # the same ones as written out for each family
    kinds = secrets.families(language, F.col("id"))
    rows = spark.range(5, 245)
    plain = [
        r for k, (name, c, b, a, y) in enumerate(kinds)
        for r in rows.filter(F.pmod("id", F.lit(len(kinds))) == k).select(c.alias("c"), b.alias("b"), a.alias("a"), F.lit(float(y)).alias("y"), F.lit(name).alias("n")).collect()
    ]
    assert len(plain) == 240 and sorted(map(tuple, made.collect())) == sorted(map(tuple, plain))
