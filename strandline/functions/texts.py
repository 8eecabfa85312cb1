"""Personal data, safety rules, masks and search on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data, in the order in which they are redacted.
PERSONAL = {
    "phone": r"1[3-9]\d{9}",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "id_card": r"\d{17}[\dXx]",
}
# Words and phrases that mark a text, in the order in which they are looked for.
TOXIC = ("hate", "kill", "idiot", "violence")
INJECTION = ("ignore previous instructions", "system prompt", "you are now", "roleplay", "override", "jailbreak")


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def personal_types(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(_may_hold(text, name) & text.rlike(p), F.lit(name)) for name, p in PERSONAL.items())))


def _may_hold(text: Column, name: str) -> Column:
    """A look that costs little before a pattern that begins with a run of any length."""
    return text.contains("@") if name == "email" else F.lit(True)


def redacted(text: Column) -> Column:
    for name, pattern in PERSONAL.items():
        text = F.when(_may_hold(text, name), F.regexp_replace(text, pattern, f"[{name.upper()}_REDACTED]")).otherwise(text)
    return text


def masked_phone(phone: Column) -> Column:
    return F.when(F.length(phone) < 7, phone).otherwise(F.concat(F.left(phone, F.lit(3)), F.lit("****"), F.right(phone, F.lit(4))))


def masked_email(email: Column) -> Column:
    parts = F.split(email, "@")
    masked = F.concat(F.left(F.get(parts, F.lit(0)), F.lit(1)), F.lit("***@"), F.get(parts, F.lit(1)))
    return F.when(F.size(parts) == 2, masked).otherwise(email)


def masked_id_card(number: Column) -> Column:
    return F.when(F.length(number) == 18, F.concat(F.left(number, F.lit(6)), F.lit("********"), F.right(number, F.lit(4)))).otherwise(number)


def masked_name(name: Column) -> Column:
    return F.when(F.length(name) <= 1, name).otherwise(F.concat(F.left(name, F.lit(1)), F.lit("**")))


def toxic_by_words(text: Column) -> Column:
    lower = F.lower(text)
    found = F.lit(False)
    for word in TOXIC:
        found = found | lower.contains(word)
    return found


def injection(text: Column) -> Column:
    """(found, confidence, reason): the first pattern that matches, else a long text with braces."""
    reason = F.when((F.length(text) > 1000) & text.contains("{") & text.contains("}"), "Complex structure suspicious").otherwise("")
    score = F.when(reason != "", 0.6).otherwise(0.0)
    for pattern in reversed(INJECTION):
        hit = text.rlike(f"(?i){pattern}")
        reason = F.when(hit, f"Matched pattern: {pattern}").otherwise(reason)
        score = F.when(hit, 1.0).otherwise(score)
    return F.struct((score > 0).alias("found"), score.alias("confidence"), reason.alias("reason"))


def noise_score(text: Column) -> Column:
    """0.8 where over 0.3 of the characters are neither letters, digits nor white space, 0 for no text, else 0.1."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).when(odd / F.length(text) > 0.3, 0.8).otherwise(0.1)


def json_span(text: Column) -> Column:
    """From the first brace to the last one; empty if there are none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def matches_all(text: Column, query: str) -> Column:
    """Whether a text has every word of a query (no stemming)."""
    words = [w for w in query.lower().split() if w]
    return F.forall(F.array(*(F.lit(w) for w in words)), lambda w: F.array_contains(terms(text), w))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def edit_ratio(a: Column, b: Column) -> Column:
    """100 for equal texts, 0 for texts with nothing in common."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return (1 - F.levenshtein(F.lower(a), F.lower(b)) / longest) * 100


def substring_score(text: Column, query: str) -> Column:
    """Share of the text that the query makes up, in percent; 0 if it isn't in it."""
    return F.when(F.lower(text).contains(query.lower()), F.lit(float(len(query))) / F.length(text) * 100).otherwise(0.0)
