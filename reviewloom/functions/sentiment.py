"""Aspect sentiment as native expressions: no Python in the hot path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import strip_unicode

# Aspects with their aliases, sentiment words, endings, thresholds.
ASPECTS = {
    "battery": ["battery", "charge", "charging"],
    "camera": ["camera", "photo", "picture"],
    "delivery": ["delivery", "courier", "shipping", "arrived"],
    "packaging": ["packaging", "package", "box"],
    "performance": ["performance", "speed", "fast", "slow", "lag"],
    "price": ["price", "cost", "expensive", "cheap", "value"],
    "quality": ["quality", "build", "material", "durable", "broken"],
    "support": ["support", "service", "agent", "refund"],
    "usability": ["easy", "difficult", "interface", "setup", "use"],
}
POSITIVE = "amazing best clear durable easy excellent fast good great helpful love perfect quick reliable smooth".split()
NEGATIVE = "bad broken confusing difficult disappointing drains expensive hate lag late poor slow terrible unhelpful worse".split()
ENDINGS = ["", "s", "es", "d", "ed", "ing", "r", "er", "ers", "ly"]
CUT = r"(?i)[.!?;]|\bbut\b|\bhowever\b"
TOKEN = r"[a-z']+"
LABEL_AT = 0.1


def clauses(text: Column) -> Column:
    """Non-blank clauses with their position: array<struct<pos, clause>>."""
    parts = F.transform(F.split(text, CUT), lambda c, i: F.struct(i.alias("pos"), strip_unicode(c).alias("clause")))
    return F.filter(parts, lambda c: c["clause"] != "")


def tokens_of(clause: Column) -> Column:
    return F.regexp_extract_all(F.lower(clause), F.lit(TOKEN), 0)


def _table(entries: dict[str, str | int]) -> Column:
    """A literal map; looked up once per token."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


#: Polarity of each sentiment word, and the aspects of each form of an alias (several are joined by a comma).
_POLARITY = {w: 1 for w in POSITIVE} | {w: -1 for w in NEGATIVE}
_ASPECT_OF: dict[str, str] = {}
for _name, _aliases in ASPECTS.items():
    for _form in dict.fromkeys(a + e for a in _aliases for e in ENDINGS):
        _ASPECT_OF[_form] = ",".join(filter(None, [_ASPECT_OF.get(_form), _name]))


def score_of(tokens: Column) -> Column:
    """Share of positive minus share of negative words, four digits, half to even; 0 without any."""
    signs = F.transform(F.filter(tokens, lambda t: t.isin(list(_POLARITY))), lambda t: F.try_element_at(_table(_POLARITY), t))  # a set first, as a map is searched from its begin
    total = F.aggregate(signs, F.lit(0), lambda a, s: a + s)
    return F.bround(total.cast("double") / F.greatest(F.size(signs), F.lit(1)), 4)


def aspects_of(tokens: Column) -> Column:
    """Names of the aspects that the tokens mention, each once."""
    hits = F.transform(F.filter(tokens, lambda t: t.isin(list(_ASPECT_OF))), lambda t: F.try_element_at(_table(_ASPECT_OF), t))
    return F.filter(F.array_distinct(F.split(F.array_join(hits, ","), ",")), lambda a: a != "")


def clause_score(clause: Column) -> Column:
    return score_of(tokens_of(clause))


def label(score: Column) -> Column:
    return F.when(score > LABEL_AT, "positive").when(score < -LABEL_AT, "negative").otherwise("neutral")


def mentioned(clause: Column) -> Column:
    """Names of the aspects that a clause mentions by a whole token."""
    return aspects_of(tokens_of(clause))


def mentions(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per clause and mentioned aspect: keys, pos, clause, score, aspect. A null text has none.

    Tokens are taken once per clause, and scored only where an aspect is mentioned.
    """
    per_clause = df.select(*keys, F.explode(clauses(F.coalesce(F.col(text), F.lit("")))).alias("c"))
    tokens = per_clause.select(*keys, "c.pos", "c.clause", F.explode(F.array(tokens_of(F.col("c.clause")))).alias("_t"))  # bound by the generator, so it isn't taken again
    about = tokens.select(*keys, "pos", "clause", "_t", F.explode(F.array(aspects_of(F.col("_t")))).alias("_a")).where(F.size("_a") > 0)
    scored = about.select(*keys, "pos", "clause", "_a", F.explode(F.array(score_of(F.col("_t")))).alias("score"))
    return scored.select(*keys, "pos", "clause", "score", F.explode("_a").alias("aspect"))


def best_per_aspect(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Per key and aspect the clause with the strongest score, the first of equals."""
    strongest = F.max_by(F.struct("score", "clause"), F.struct(F.abs("score"), -F.col("pos"))).alias("b")
    best = mentions(df, text, keys).groupBy(*keys, "aspect").agg(strongest)
    return best.select(*keys, "aspect", F.col("b.score").alias("sentiment_score"), label(F.col("b.score")).alias("sentiment_label"), F.col("b.clause").alias("evidence"))


def aspect_array(text: Column) -> Column:
    """All of it inside one row: sorted array<struct<aspect, sentiment_score, sentiment_label, evidence>>.

    ``transform`` over arrays of one binds the tokens of a clause and the scored
    clauses, so that nothing is computed again for each aspect.
    """

    def scored(c: Column) -> Column:
        bound = F.transform(F.array(tokens_of(c["clause"])), lambda t: F.struct(c["pos"].alias("pos"), c["clause"].alias("clause"), score_of(t).alias("score"), aspects_of(t).alias("aspects")))
        return bound.getItem(0)

    def of(every: Column, name: str) -> Column:
        having = F.filter(every, lambda c: F.array_contains(c["aspects"], name))
        ranked = F.transform(having, lambda c: F.struct(F.abs(c["score"]).alias("a"), (-c["pos"]).alias("p"), c["score"].alias("score"), c["clause"].alias("clause")))
        top = F.transform(F.array(F.array_max(ranked)), lambda t: F.when(t.isNotNull(), F.struct(F.lit(name).alias("aspect"), t["score"].alias("sentiment_score"), label(t["score"]).alias("sentiment_label"), t["clause"].alias("evidence"))))
        return top.getItem(0)

    per_clause = F.filter(F.transform(clauses(F.coalesce(text, F.lit(""))), scored), lambda c: F.size(c["aspects"]) > 0)
    return F.transform(F.array(per_clause), lambda every: F.array_compact(F.array(*[of(every, n) for n in sorted(ASPECTS)]))).getItem(0)


def score_aspects(text: str | None) -> list[dict[str, object]]:
    """The scorer for one text outside Spark, by the same word lists: sorted dicts of aspect, sentiment_score, sentiment_label, evidence."""
    best: dict[str, tuple[float, str]] = {}
    for part in re.split(CUT, text or ""):
        clause = part.strip()
        words = re.findall(TOKEN, clause.lower())
        signs = [_POLARITY[w] for w in words if w in _POLARITY]
        score = round(sum(signs) / max(len(signs), 1), 4)
        for aspect in dict.fromkeys(a for w in words for a in _ASPECT_OF.get(w, "").split(",") if a):
            if aspect not in best or abs(score) > abs(best[aspect][0]):
                best[aspect] = (score, clause)
    named = lambda s: "positive" if s > LABEL_AT else "negative" if s < -LABEL_AT else "neutral"
    return [{"aspect": a, "sentiment_score": s, "sentiment_label": named(s), "evidence": e} for a, (s, e) in sorted(best.items())]
