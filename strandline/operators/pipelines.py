"""Transformers with fit, transform, save and load, and chains of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Standardiser:
    """c_scaled = (c - mean) / population deviation, by what was fitted; 1 stands in for a deviation of 0, nulls stay."""

    def __init__(self, columns: list[str], stats: dict[str, tuple[float, float]] | None = None):
        self.columns, self.stats = columns, stats

    def fit(self, df: DataFrame) -> Standardiser:
        row = df.agg(*(f for c in self.columns for f in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
        self.stats = {c: (row[f"a_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.stats is None:
            raise ValueError("fit comes first")
        return df.withColumns({f"{c}_scaled": (F.col(c) - mean) / deviation for c, (mean, deviation) in self.stats.items()})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_dict(self) -> dict:
        return {"kind": "standardiser", "columns": self.columns, "stats": self.stats}

    @classmethod
    def from_dict(cls, d: dict) -> Standardiser:
        return cls(d["columns"], {c: tuple(v) for c, v in d["stats"].items()})


class Vocabulary:
    """Adds c_id: a token's place by falling frequency, from `first_id`; unknown tokens get `unknown`."""

    def __init__(self, column: str, most: int = 10_000, first_id: int = 5, unknown: int = 4, ids: dict[str, int] | None = None):
        self.column, self.most, self.first_id, self.unknown, self.ids = column, most, first_id, unknown, ids

    def fit(self, df: DataFrame) -> Vocabulary:
        from strandline.operators.vocabulary import vocabulary

        found = vocabulary(df.select(F.col(self.column).cast("string").alias("token")), 1, self.most, self.first_id)
        self.ids = {r["token"]: r["id"] for r in found.collect()}  # `most` rows at most
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.ids is None:
            raise ValueError("fit comes first")
        table = df.sparkSession.createDataFrame(list(self.ids.items()), f"_t string, `{self.column}_id` long")
        joined = df.join(F.broadcast(table), F.col(self.column).cast("string") == F.col("_t"), "left").drop("_t")
        return joined.fillna(self.unknown, [f"{self.column}_id"])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_dict(self) -> dict:
        return {"kind": "vocabulary", "column": self.column, "most": self.most, "first_id": self.first_id, "unknown": self.unknown, "ids": self.ids}

    @classmethod
    def from_dict(cls, d: dict) -> Vocabulary:
        return cls(**{k: v for k, v in d.items() if k != "kind"})


KINDS = {"standardiser": Standardiser, "vocabulary": Vocabulary}


class Chain:
    """Transformers one after the other; each is fitted on what the ones before it give."""

    def __init__(self, steps: list | None = None):
        self.steps = list(steps or [])

    def add(self, step) -> Chain:
        self.steps.append(step)
        return self

    def fit(self, df: DataFrame) -> Chain:
        for step in self.steps:
            df = step.fit_transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON line, in any folder that Spark can write to."""
        text = json.dumps([s.to_dict() for s in self.steps])
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Chain:
        return cls([KINDS[d["kind"]].from_dict(d) for d in json.loads(spark.read.text(path).first()["value"])])
