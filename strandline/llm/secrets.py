"""Secret scans: candidates are found by patterns, and a random forest removes the false positives.

Everything here is DataFrame expressions and pyspark.ml, so a scan stays in the JVM. The forest
sees a candidate's length, how likely its characters follow one another in the words of the
corpus, how much of it the corpus's dictionary covers, whether it is part of a path, and the
words around it. Dictionary and transitions are counted over all documents (`learn_language`).
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import cut_lineage, own_names

# Words that name a secret, and words that name something public.
SECRET_WORDS = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?|auth(?:orization)?|bearer"
PUBLIC_WORDS = r"commit|revision|sha-?\d*|md5|digest|checksum|etag|uuid|guid|order|card|isbn|version|build|image|example"
_ASSIGNED = rf"(?i:{SECRET_WORDS})[A-Za-z0-9_-]{{0,20}}[\"']?\s{{0,3}}(?:=>|:=|[=:])"
#: What stands before a value: an assignment to a name with a secret word in it, user and colon in a URL, a header's scheme, a key block's first line.
INTRODUCTION = (
    rf"{_ASSIGNED}\s{{0,3}}(?i:bearer |basic )?[\"'`]?"
    r"|://[^\s:/@]{1,64}:(?=[^\s/@]+@)"
    r"|(?i:bearer|basic) (?=[A-Za-z0-9+/_.=-]{8})"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s*"
)
_RUN = "[A-Za-z0-9+/_-]"
#: A value of any length after an introduction, or 16 characters and more in a row wherever they stand, unless they are the name in an assignment.
CANDIDATE = (
    rf"(?:{INTRODUCTION})(?:(?<=KEY-----\s{{0,2}})[A-Za-z0-9+/=\s]+|(?<=://[^\s@]{{1,80}})[^\s/@]+|[^\s\"'`]+)"
    rf"|(?<!{_RUN})(?={_RUN}{{16}})(?!{_RUN}*?{_ASSIGNED}){_RUN}{{16,}}+={{0,2}}"
)
_CLOSING = r"[.,;:)\]}>]+$"
#: Characters before and after a candidate that count as its neighbourhood.
BEFORE, AFTER = 40, 20
FEATURES = (
    "length", "transitions", "changes", "upper", "digits", "other", "hex_only", "distinct", "covered", "in_path", "slashes", "assigned", "quoted", "secret_word", "public_word", "key_prefix",
)
#: Characters with transitions of their own; place 0 is for all others, and a blank stands at both ends of a word.
ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789"
#: A dictionary word occurs so often at least, and has so many letters.
LEAST_COUNT, LEAST_LETTERS = 5, 3
#: Dictionary words, the most frequent, that made-up findings are put together from.
SAMPLE_WORDS = 400
# Words to make findings from where a corpus has no dictionary.
PLAIN_WORDS = (
    "the", "and", "with", "from", "this", "that", "which", "other", "about", "there",
    "their", "first", "house", "water", "people", "under", "world", "after", "where", "thing",
)


@dataclass(frozen=True)
class Language:
    """`dictionary`: words of the corpus, one a row; `transitions`: log probability of a character after another; `common`: the most frequent words."""

    dictionary: DataFrame
    transitions: list[float]
    common: list[str]


def learn_language(df: DataFrame, text: str = "text") -> Language:
    """Counts the words of all texts. Null and empty texts have none; an empty corpus gives an empty dictionary and even transitions."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    counted = cut_lineage(df.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    letters = counted.filter((F.col("n") >= LEAST_COUNT) & F.col("word").rlike(rf"^\p{{L}}{{{LEAST_LETTERS},30}}$"))
    width = len(ALPHABET) + 1
    padded = F.concat(F.lit(" "), F.regexp_replace("word", "[^a-z0-9]", "?"), F.lit(" "))
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(2)))
    found = counted.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    times = [[0] * width for _ in range(width)]
    for r in found.collect():  # one row at most for each two characters of the alphabet and "?"
        times[ALPHABET.find(r["pair"][0]) + 1][ALPHABET.find(r["pair"][1]) + 1] += r["n"]
    logs = [math.log((n + 1) / (sum(row) + width)) for row in times for n in row]
    common = [r["word"] for r in letters.orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS).collect()]
    return Language(letters.select("word"), logs, common or list(PLAIN_WORDS))


def _share(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]", "")) / F.greatest(F.length(text), F.lit(1))


def _transitions(candidate: Column, logs: list[float]) -> Column:
    """Mean log probability of the characters of a candidate, each after the one before it."""
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in logs])), "array<double>")
    padded = F.concat(F.lit(" "), F.lower(candidate), F.lit(" "))
    place = F.transform(F.sequence(F.lit(1), F.length(padded)), lambda i: F.position(F.substring(padded, i, F.lit(1)), F.lit(ALPHABET)))
    steps = F.zip_with(place, F.slice(place, F.lit(2), F.size(place)), lambda a, b: F.get(table, a * (len(ALPHABET) + 1) + b))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0))) / (F.length(padded) - 1)


def covered(candidates_: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(candidate, covered): the share of each different candidate that whole dictionary words cover, parted at marks, digits and capitals."""
    parts = F.regexp_extract_all("candidate", F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})"), F.lit(0))
    each = candidates_.select("candidate").distinct().select("candidate", F.explode_outer(parts).alias("part"))
    each = each.withColumn("word", F.lower("part"))
    known = each.join(dictionary.withColumn("known", F.lit(1)), "word", "left")
    held = F.sum(F.when(F.col("known") == 1, F.length("part")).otherwise(0))
    return known.groupBy("candidate").agg((held / F.greatest(F.length(F.first("candidate")), F.lit(1))).alias("covered"))


def with_features(df: DataFrame, language: Language) -> DataFrame:
    """Adds `f_` columns of FEATURES to rows of (candidate, before, after); nulls count as empty."""
    df = df.withColumn("candidate", F.coalesce("candidate", F.lit("")))
    df = df.join(covered(df, language.dictionary), "candidate", "left")
    c, before, after = F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    classes = c
    for kind, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^a-zA-Z0-9]+", "-")):
        classes = F.regexp_replace(classes, kind, mark)
    number = {
        "length": F.length(c),
        "transitions": _transitions(c, language.transitions),
        # runs of one class each, by length
        "changes": (F.length(classes) - 1) / F.greatest(F.length(c), F.lit(1)),
        "upper": _share(c, "A-Z"),
        "digits": _share(c, "0-9"),
        "other": 1 - _share(c, r"A-Za-z0-9"),
        "hex_only": c.rlike("^[0-9a-f]+$"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1)),
        "covered": F.coalesce("covered", F.lit(0.0)),
        "in_path": before.rlike(r"[/\\.~]$") | after.rlike(r"^[/\\]|^\.\w") | before.rlike(r"(?i)https?:\S*$"),
        "slashes": F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit(""))),
        "assigned": before.rlike(r"[=:>]\s*[\"'`]?$"),
        "quoted": before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"),
        # among the last words before it
        "secret_word": before.rlike(rf"(?i)({SECRET_WORDS})\S*\W*\w*\W*$"),
        "public_word": before.rlike(rf"(?i)\b({PUBLIC_WORDS})\W*\w*\W*$"),
        "key_prefix": c.rlike(r"^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[abp]-|AIza|glpat-|eyJ)"),
    }
    return df.withColumns({f"f_{k}": v.cast("double") for k, v in number.items()}).drop("covered")


#: Matches whose places are added up together.
_TOGETHER = 256


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, candidate, before, after) of every match in the whole text; `start` counts characters from 0.

    A candidate is what follows an introduction, whatever its length, or a run of 16 or more characters; marks that
    close a sentence or bracket aren't part of it. `before` and `after` end at the matches next to it. Null and empty
    texts have none.
    """
    some = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(F.col("text").rlike(CANDIDATE))
    some = some.select(
        "id",
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"),
        # what lies before, between and after the matches
        F.split("text", CANDIDATE, -1).alias("between"),
    )
    sized = some.withColumn("sizes", F.zip_with("found", "between", lambda c, b: F.length(b) + F.length(c)))

    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0), lambda n, s: n + s)

    groups = F.transform(F.sequence(F.lit(1), F.size("sizes"), F.lit(_TOGETHER)), lambda i: total(F.slice("sizes", i, F.lit(_TOGETHER))))
    sized = sized.withColumn("groups", groups)
    sized = sized.withColumn("skipped", F.transform("groups", lambda _, k: total(F.slice("groups", F.lit(1), k))))

    def start(i: Column) -> Column:
        k = F.floor(i / _TOGETHER).cast("int")
        return F.get("skipped", k) + total(F.slice("sizes", k * _TOGETHER + 1, i - k * _TOGETHER)) + F.length(F.get("between", i))

    each = F.transform(
        "found",
        lambda m, i: F.struct(start(i).alias("start"), m.alias("match"), F.right(F.get("between", i), F.lit(BEFORE)).alias("before"), F.left(F.get("between", i + 1), F.lit(AFTER)).alias("after")),
    )
    matches = sized.select(F.col("id").alias(doc_id), F.inline(each))
    # a password in a URL is introduced as such only before an @, which isn't part of the match
    value = F.regexp_replace(F.concat("match", F.lit("@")), f"^(?:{INTRODUCTION})", "")
    value = F.left(value, F.length(value) - 1)
    introduced = F.length("match") - F.length(value)
    bare = F.regexp_replace(value, _CLOSING, "")
    return matches.select(
        doc_id,
        (F.col("start") + introduced).alias("start"),
        bare.alias("candidate"),
        F.right(F.concat("before", F.left("match", introduced)), F.lit(BEFORE)).alias("before"),
        F.left(F.concat(F.substring(value, F.length(bare) + 1, F.length(value)), F.col("after")), F.lit(AFTER)).alias("after"),
    ).filter("candidate != ''")


#: Words drawn for a made-up finding.
_DRAWN = 10


def draws(language: Language, id_: Column) -> dict[str, Column]:
    """What the families put findings together from, in terms of a row number: `digest`, `both` and `words`."""
    digest = F.sha2(F.concat(F.lit("finding "), id_.cast("string")), 256)
    both = F.concat(F.base64(F.unhex(digest)), F.base64(F.unhex(F.sha2(digest, 256))))
    # one literal: as an array of literals it would be copied into each family that draws a word
    words = F.from_json(F.lit(json.dumps(language.common)), "array<string>")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(_DRAWN - 1)), lambda k: F.get(words, F.pmod(F.xxhash64(id_, k), F.size(words)).cast("int")))
    return {"digest": digest, "both": F.regexp_replace(both, "=", ""), "words": drawn}


def families(language: Language, id_: Column, drawn: dict[str, Column] | None = None) -> list[tuple[str, Column, Column, Column, int]]:
    """(name, candidate, before, after, is a secret) of the families of made-up findings, in terms of a row number.

    `drawn`: the row's `draws` where they are columns already, so that they aren't written out again wherever a family uses one.
    """
    drawn = drawn or draws(language, id_)
    digest, both = drawn["digest"], drawn["both"]
    alnum = F.regexp_replace(both, "[^A-Za-z0-9]", "")
    digits = F.translate(digest, "abcdef", "123456")

    def word(k: int) -> Column:
        return F.get(drawn["words"], F.lit(k))

    def text(*parts: Column | str) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def sized(value: Column, least: int, most: int) -> Column:
        return F.left(value, (F.pmod(F.xxhash64(id_, F.lit(99)), F.lit(most - least + 1)) + least).cast("int"))

    prose = F.concat_ws(" ", *(word(k) for k in range(4)))
    mark = F.get(F.array(*(F.lit(c) for c in "!@#$%&*?")), F.pmod(F.xxhash64(id_, F.lit(98)), F.lit(8)).cast("int"))
    number = F.left(digits, F.lit(3))
    password = text(F.initcap(F.left(word(5), F.lit(6))), number, mark)
    mixed = F.concat(sized(alnum, 5, 9), mark, number)
    name = F.concat_ws("_", word(6), word(7))
    path = F.concat_ws("/", F.concat(word(1), word(2)), word(3), F.concat(word(4), word(5)), word(6))
    uuid = F.concat_ws("-", F.left(digest, F.lit(8)), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    return [
        ("hex token", F.left(digest, F.lit(40)), text(prose, ' token = "'), text('" ', prose), 1),
        ("hex bearer", F.left(digest, F.lit(32)), text("Authorization: Bearer "), F.lit("\n"), 1),
        ("cloud key", text("AKIA", F.left(F.upper(alnum), F.lit(16))), text(prose, " "), text(" ", prose), 1),
        ("cloud secret", F.left(both, F.lit(40)), F.lit("aws_secret_access_key="), F.lit("\n"), 1),
        ("prefixed", text("ghp_", F.left(alnum, F.lit(36))), text(prose, " "), F.lit("."), 1),
        ("live key", text("sk_live_", F.left(alnum, F.lit(24))), F.lit("api_key='"), F.lit("'"), 1),
        ("password", password, text(prose, " password="), text(" ", prose), 1),
        ("quoted password", mixed, text('"password": "'), F.lit('",'), 1),
        ("url password", mixed, text("postgres://", word(8), ":"), text("@", word(9), "/"), 1),
        ("secret setting", sized(alnum, 12, 30), text(name, "_secret: "), F.lit("\n"), 1),
        ("pin", sized(digits, 4, 8), text("passcode: "), text(" ", prose), 1),
        ("key block", sized(F.concat(both, both), 60, 80), F.lit("-----BEGIN PRIVATE KEY-----\n"), F.lit("\n-----END"), 1),
        ("long word", F.concat(word(1), word(2), word(3), word(4), word(5), word(6)), text(prose, " "), text(" ", prose), 0),
        ("shouted", F.upper(F.concat(word(1), word(2), word(3), word(4), word(5))), text(prose, " "), F.lit("!! "), 0),
        ("identifier", F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)), F.initcap(word(5))), text(prose, " "), F.lit("("), 0),
        ("number", F.left(digits, F.lit(16)), text(prose, " "), text(" ", prose), 0),
        ("commit", F.left(digest, F.lit(40)), text(prose, " commit "), F.lit("\n"), 0),
        ("checksum", digest, text("sha256: "), F.lit("\n"), 0),
        ("path", path, F.lit("see https://example.org/"), F.lit(".html"), 0),
        ("uuid", uuid, text("uuid "), F.lit(","), 0),
        ("told word", word(1), text(prose, " secret: "), text(" ", prose), 0),
        ("placeholder", F.get(F.array(*(F.lit(p) for p in ("changeme", "your_password", "xxxxxxxx", "None", "<password>", "********", "${PASSWORD}", "os.environ"))), F.pmod(id_, F.lit(8)).cast("int")), text("password="), F.lit("\n"), 0),
        ("name of a setting", name, text("token_", word(9), " = "), text(" ", prose), 0),
        ("underlined", F.concat_ws("_", word(1), word(2), word(3), word(4)), text(prose, " auth: "), text(" ", prose), 0),
    ]


def sample_findings(spark: SparkSession, language: Language, rows: int = 6000, first: int = 0, only: set[str] | None = None) -> DataFrame:
    """Labelled findings (candidate, before, after, label, family) to fit a forest on, made up from families, the same each time.

    `first` is the number of the first row, so that other rows can be drawn; `only` names the families to draw from.
    """
    id_ = F.col("id")
    numbered = spark.range(first, first + rows)
    drawn = draws(language, id_)
    made, kinds = F.lit(None), [f for f in families(language, id_, {k: F.col(k) for k in drawn}) if only is None or f[0] in only]
    for k, (name, c, b, a, y) in enumerate(kinds):
        fields = (c.alias("candidate"), b.alias("before"), a.alias("after"), F.lit(float(y)).alias("label"), F.lit(name).alias("family"))
        made = F.when(F.pmod(id_, F.lit(len(kinds))) == k, F.struct(*fields)).otherwise(made)
    # cut, or each later use of a finding (filters and the join of its features) holds all families once more
    return cut_lineage(numbered.select("id", *(c.alias(k) for k, c in drawn.items())).select(made.alias("m"))).select("m.*")


def train_forest(findings: DataFrame, language: Language, trees: int = 24, depth: int = 8, seed: int = 7) -> PipelineModel:
    """A forest fitted on labelled findings (candidate, before, after, label). Rows with a null label are passed over."""
    rows = cut_lineage(with_features(findings.filter(F.col("label").isNotNull()), language).select("label", *(f"f_{f}" for f in FEATURES)))
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features"),
            RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt"),
        ]
    ).fit(rows)


def scan(df: DataFrame, model: PipelineModel, language: Language, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, candidate, before, after, score, is_secret) for every candidate in every whole text.

    Null and empty texts have no candidates; repeated rows give their findings each time; other columns don't matter.
    """
    # candidates are found once, and join the dictionary's shares of each different one
    found = cut_lineage(candidates(df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id", "text"))
    scored = model.transform(with_features(found, language))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(doc_id), "start", "candidate", "before", "after", score.alias("score"), (score >= threshold).alias("is_secret"))


def redacted(df: DataFrame, model: PipelineModel, language: Language, doc_id: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of `df`, with every secret of `text` replaced by `mask`. Rows are matched by doc_id and text; null texts stay.

    Empty texts stay empty, repeated rows are changed alike and come out as often as they went in. Secrets of one text
    never overlap, being matches of one pattern. A text of any length is changed in one piece.
    """
    key = F.struct(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"))
    found = scan(df.select(key.alias("key"), F.col(text).alias("text")), model, language, "key", "text")
    id_, mark, spans_ = own_names(df, "id", "mark", "spans")
    spans = (
        found.filter("is_secret")
        .select(F.col("key.i").alias(id_), F.col("key.h").alias(mark), "start", F.length("candidate").alias("size"))
        .distinct()
        .groupBy(id_, mark)
        .agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias(spans_))
    )
    own = F.col(f"d.`{text}`")
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col(id_)) & (F.xxhash64(own) == F.col(mark))
    joined = df.alias("d").join(spans, same, "left")
    ends = F.concat(F.array(F.lit(0)), F.transform(spans_, lambda s: s["start"] + s["size"]))
    starts = F.concat(F.transform(spans_, lambda s: s["start"]), F.array(F.length(own)))
    between = F.zip_with(ends, starts, lambda e, s: F.substring(own, e + 1, s - e))
    cleaned = F.when(F.col(spans_).isNull(), own).otherwise(F.array_join(between, mask))
    return joined.select(*(cleaned.alias(c) if c == text else F.col(f"d.`{c}`") for c in df.columns))
