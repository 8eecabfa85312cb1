"""Tokens of behaviour events, items and users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import times

# Ids of the special tokens, kinds of actions and devices, codebook sizes.
SPECIAL = {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[MASK]": 3, "[UNK]": 4}
UNK = 4
ACTIONS = ("view", "click", "like", "dislike", "favorite", "share", "comment", "buy", "rate", "cart")
DEVICES = ("mobile", "desktop", "tablet", "tv", "other")
CODEBOOKS = (1024, 4096, 16384)
TYPE_IDS = {"USER": 0, "ITEM": 1, "ACTION": 2, "CONTEXT": 3}
# Prefixes of catalogue entities, and what counts as no value.
PREFIXES = {
    "movie": "MOV_", "person": "PER_", "actor": "ACT_", "director": "DIR_", "writer": "WRI_", "genre": "GEN_", "region": "REG_",
    "category": "ROL_", "profession": "PRO_", "series": "SER_", "rating": "RAT_", "era": "ERA_", "title_type": "TYP_", "name": "NAM_",
}
NO_VALUE = ("\\N", "", "nan", "None", "UNKNOWN")
# Weights of actions for sequences, for preferences and for co-occurrence.
SEQUENCE_WEIGHTS = {"view": 0.1, "click": 1.0, "like": 1.5, "dislike": -1.0, "favorite": 2.0, "share": 2.0, "comment": 1.5, "buy": 5.0, "rate": 1.0, "cart": 2.0}
PREFERENCE_WEIGHTS = {"view": 1.0, "click": 2.0, "like": 3.0, "favorite": 4.0, "share": 4.0, "comment": 3.5, "buy": 5.0, "purchase": 5.0, "rate": 4.0}
COOCCURRENCE_WEIGHTS = {"buy": 5.0, "purchase": 5.0, "like": 3.0, "click": 1.0}


def weight(action: Column, table: dict[str, float], otherwise: float) -> Column:
    out = F.lit(otherwise)
    for name, value in table.items():
        out = F.when(action == name, F.lit(value)).otherwise(out)
    return out


def action(name: Column) -> Column:
    return F.concat(F.lit("ACTION_"), F.lower(F.trim(F.coalesce(name, F.lit("view")))))


def device(name: Column) -> Column:
    """No token without a device; unknown ones are `other`."""
    clean = F.lower(F.trim(name))
    return F.when(name.isNotNull(), F.concat(F.lit("DEVICE_"), F.when(clean.isin(*DEVICES), clean).otherwise("other")))


def stable_hash(text: Column) -> Column:
    """h = 31 h + code point, in 32 bits; a character outside the basic plane counts as one code point."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))


def semantic_levels(hashed: Column) -> list[Column]:
    a, b, c = CODEBOOKS
    return [hashed % a, F.floor(hashed / a).cast("long") % b, F.floor(hashed / (a * b)).cast("long") % c]


def item(item_id: Column, semantic_id: Column | None = None) -> Column:
    """ITEM_l1_l2_l3 of a semantic id of three levels, else of a hash of the id (`unknown` for none)."""
    levels = semantic_levels(stable_hash(F.coalesce(item_id.cast("string"), F.lit("unknown"))))
    hashed = F.concat_ws("_", F.lit("ITEM"), *(x.cast("string") for x in levels))
    if semantic_id is None:
        return hashed
    given = F.concat_ws("_", F.lit("ITEM"), *(F.get(semantic_id, i).cast("string") for i in range(3)))
    return F.when(F.size(semantic_id) >= 3, given).otherwise(hashed)


def parse_item(token: Column) -> Column:
    """Three levels of an item token as an array; null for anything else."""
    parts = F.transform(F.split(F.substring(token, 6, 1 << 20), "_"), lambda p: p.try_cast("int"))
    good = token.startswith("ITEM_") & (F.size(parts) == 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(good, parts)


def time_tokens(ts: Column | str) -> Column:
    return F.array(F.concat(F.lit("TIME_"), times.bucket(F.hour(ts))), F.concat(F.lit("TIME_"), times.weekday_token(ts)))


def context_tokens(source: Column, position: Column, keyword: Column) -> Column:
    place = position.try_cast("int")
    return F.array_compact(
        F.array(
            F.when(source.isNotNull(), F.concat(F.lit("CONTEXT_"), F.lower(F.trim(source)))),
            F.when(place <= 3, "CONTEXT_top").when(place <= 10, "CONTEXT_mid").when(place > 10, "CONTEXT_bottom"),
            F.when(F.length(keyword) > 0, "CONTEXT_has_keyword"),
        )
    )


def age_bucket(age: Column) -> Column:
    return F.when(age < 18, "teen").when(age < 25, "young").when(age < 35, "adult").when(age < 50, "middle").otherwise("senior")


def user_tokens(age: Column, gender: Column, level: Column) -> Column:
    years, clean, rank = age.try_cast("int"), F.lower(F.trim(gender)), level.try_cast("int")
    sex = F.when(clean.isin("m", "male", "男"), "m").when(clean.isin("f", "female", "女"), "f").otherwise("u")
    return F.array_compact(
        F.array(
            F.when(years.isNotNull(), F.concat(F.lit("USER_age_"), age_bucket(years))),
            F.when(gender.isNotNull(), F.concat(F.lit("USER_gender_"), sex)),
            F.when(rank.isNotNull(), F.concat(F.lit("USER_level_"), rank.cast("string"))),
        )
    )


def kind(token: Column) -> Column:
    found = F.lit("CONTEXT")
    for name in ("USER", "ACTION", "ITEM"):
        found = F.when(token.startswith(f"{name}_"), name).otherwise(found)
    return found


def kind_id(token: Column) -> Column:
    found = F.lit(TYPE_IDS["CONTEXT"])
    for name in ("USER", "ACTION", "ITEM"):
        found = F.when(token.startswith(f"{name}_"), TYPE_IDS[name]).otherwise(found)
    return found


def prefixed(value: Column, prefix: str) -> Column:
    """No token for what counts as no value."""
    return F.when(value.isNotNull() & ~value.isin(*NO_VALUE), F.concat(F.lit(PREFIXES[prefix]), value))


def entity_type(token: Column) -> Column:
    return F.when(token.contains("_"), F.substring_index(token, "_", 1)).otherwise("OTHER")


def rating_bucket(rating: Column) -> Column:
    """Half-point bucket, halves to even; UNKNOWN for what is no number."""
    number = rating.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), "UNKNOWN").otherwise(F.format_string("%.1f", F.rint(number * 2) / 2))


def service_age(age: Column, base: int = 1000) -> Column:
    step = F.lit(5)
    for k, most in reversed(list(enumerate((18, 26, 36, 46, 56)))):
        step = F.when(age < most, k).otherwise(step)
    return (F.lit(base) + step).cast("long")


def service_gender(gender: Column, base: int = 1100) -> Column:
    return (F.lit(base) + F.when(gender.isin("male", "m", "M"), 0).when(gender.isin("female", "f", "F"), 1).otherwise(2)).cast("long")


def service_hour(hour: Column, base: int = 2000) -> Column:
    return (F.lit(base) + F.when(hour < 6, 0).when(hour < 12, 1).when(hour < 18, 2).otherwise(3)).cast("long")


def item_description(kind_: Column, category: Column, subcategory: Column, tags: Column) -> Column:
    """TYPE_, CAT_, SUBCAT_ (if any) and TAG_ tokens."""
    first = F.array(
        F.concat(F.lit("TYPE_"), kind_), F.concat(F.lit("CAT_"), category), F.when(subcategory != "", F.concat(F.lit("SUBCAT_"), subcategory))
    )
    return F.concat(F.array_compact(first), F.transform(tags, lambda t: F.concat(F.lit("TAG_"), t)))


def interleaved(events: Column) -> Column:
    """ACTION_, ITEM_ and TIME_ (by hour, upper case) of each event of an array of (action, item_id, ts)."""
    return F.flatten(
        F.transform(
            events,
            lambda e: F.array(
                F.concat(F.lit("ACTION_"), e["action"]),
                F.concat(F.lit("ITEM_"), e["item_id"].cast("string")),
                F.concat(F.lit("TIME_"), F.upper(times.bucket(F.hour(e["ts"])))),
            ),
        )
    )
