"""The scalar rules of the memory model as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import norm, strip

# The enumerations and the constants of the model.
TYPES = ("episodic", "working", "semantic", "competence", "plan_graph", "entity")
SENSITIVITIES = ("public", "low", "medium", "high", "hyper")
LAYERS = ("working", "entity", "semantic", "competence", "plan_graph", "episodic")
TASK_STATES = ("planning", "executing", "blocked", "waiting", "done")
OUTCOMES = ("success", "failure", "partial")
SOURCE_TYPES = {"event": "episodic", "tool_output": "episodic", "outcome": "episodic", "observation": "semantic", "working_state": "working"}
SOURCE_CONFIDENCE = {"event": 0.8, "tool_output": 0.9, "observation": 0.7, "outcome": 0.85, "working_state": 1.0}
HALF_LIVES = {"episodic": 3600, "semantic": 2_592_000, "working": 86_400}
KIND_TYPES = {"person": "Person", "tool": "Tool", "project": "Project", "file": "File", "concept": "Concept"}
BOOSTS = {
    "mentions_entity": 20, "mentioned_in": 20, "subject_entity": 25, "fact_subject_of": 25,
    "object_entity": 25, "fact_object_of": 25, "supports": 10, "supported_by": 10, "depends_on": 10, "dependency_of": 10,
}
# Relation predicates and their inverses; both directions hold.
INVERSES = {
    "mentions_entity": "mentioned_in", "references_record": "referenced_by", "derived_semantic": "derived_from", "subject_entity": "fact_subject_of",
    "object_entity": "fact_object_of", "uses": "used_by", "supports": "supported_by", "depends_on": "dependency_of", "causes": "caused_by", "contradicts": "contradicted_by",
}


def pick(c: Column, values: dict, other: Column | None = None) -> Column:
    """The value of a fixed small mapping, as one expression."""
    chain = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(c == next(iter(values)), F.lit(next(iter(values.values())))))
    return chain if other is None else chain.otherwise(other)


def sensitivity_rank(c: Column) -> Column:
    """0..4 in rising order, -1 for unknown and null."""
    return pick(c, {s: i for i, s in enumerate(SENSITIVITIES)}, F.lit(-1))


def sensitivity_label(rank: Column) -> Column:
    """The label of a rank, 'low' if it is none."""
    return pick(rank, dict(enumerate(SENSITIVITIES)), F.lit("low"))


def lexical_match(value: Column, query: Column) -> Column:
    """Normalised values, one inside the other; blank ones match nothing."""
    v, q = norm(value), norm(query)
    return F.coalesce((v != "") & (q != "") & (F.contains(v, q) | F.contains(q, v)), F.lit(False))


def term_match(value: Column, needle: Column) -> Column:
    """The needle inside the value, or the value a whole word of the needle."""
    v, n = norm(value), norm(needle)
    return F.coalesce((v != "") & (n != "") & (F.contains(v, n) | F.array_contains(F.split(n, r"\s+"), v)), F.lit(False))


def first_text(*cols: Column) -> Column:
    """The first value that isn't blank, as it is."""
    return F.coalesce(*[F.when(norm(c) != "", c) for c in cols])


def unique_folded(values: Column) -> Column:
    """Trimmed, without blanks, one for each spelling up to case: the first, in order."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    lower = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def clamp01(x: Column, nan: float | None = None) -> Column:
    """Into [0, 1]; NaN becomes ``nan`` where given."""
    y = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return y if nan is None else F.when(F.isnan(x), F.lit(nan)).otherwise(y)


def seconds_between(early: Column, late: Column) -> Column:
    """Elapsed seconds, not below 0."""
    return F.greatest((F.unix_micros(late) - F.unix_micros(early)) / 1e6, F.lit(0.0))


def decayed(salience: Column, elapsed: Column, half_life: Column, floor: Column) -> Column:
    """Exponential decay with a floor; without a half-life only the floor holds."""
    return F.when(half_life <= 0, F.greatest(salience, floor)).otherwise(F.greatest(salience * F.exp(-elapsed * math.log(2) / half_life), floor))


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 in double precision; 0.5 for a zero vector, null for different lengths."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    same = F.size(a) == F.size(b)
    return F.when(same & (norms == 0), 0.5).when(same, clamp01((total(a, b) / norms + 1) / 2, 0.5))


def recency(last: Column, as_of: Column, half_life_days: int = 30) -> Column:
    """Halves every ``half_life_days``; 0.5 if unset, 1 for the future."""
    days = (F.unix_micros(as_of) - F.unix_micros(last)) / 86_400e6
    return F.when(last.isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.exp(-math.log(2) * days / half_life_days))


def freshness(created: Column, as_of: Column) -> Column:
    """1 / (1 + age in days); 0 if unset."""
    return F.when(created.isNull(), 0.0).otherwise(1 / (1 + seconds_between(created, as_of) / 86_400))


def success_rate(successes: Column, failures: Column, failure_rate: Column) -> Column:
    """From counts, else from a failure rate, else 0.5."""
    return F.when(successes + failures > 0, successes / (successes + failures)).when(failure_rate.isNotNull(), 1 - failure_rate).otherwise(0.5)


def inverse_predicate(p: Column) -> Column:
    """The inverse of a predicate, read without outer blanks and case."""
    p = norm(p)
    return pick(p, INVERSES | {v: k for k, v in INVERSES.items()}, F.concat(F.lit("inverse_of_"), p))


def relation_boost(p: Column) -> Column:
    return pick(norm(p), BOOSTS, F.lit(0))


def record_type(source_kind: Column) -> Column:
    return pick(source_kind, SOURCE_TYPES, F.lit("episodic"))


def source_confidence(source_kind: Column) -> Column:
    return pick(source_kind, SOURCE_CONFIDENCE, F.lit(0.5))


def half_life(type_: Column) -> Column:
    return pick(type_, HALF_LIVES, F.lit(HALF_LIVES["semantic"]))


def entity_type(kind: Column) -> Column:
    return pick(kind, KIND_TYPES, F.lit("Other"))


def without_fences(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))


def first_violation(r: dict[str, Column]) -> Column:
    """The first rule that a record breaks, null for a valid one. ``r``: the envelope's columns by name, with the payload
    as JSON (``payload_json``) or its kind (``payload_kind``, null without a payload)."""
    blank = lambda c: F.coalesce(r[c], F.lit("")) == ""
    kind = r["payload_kind"] if "payload_kind" in r else F.get_json_object(r["payload_json"], "$.kind")
    absent = kind.isNull() if "payload_kind" in r else r["payload_json"].isNull() | (F.trim(r["payload_json"]) == "null")
    rules = [
        ("id is required", blank("id")),
        ("type is required", blank("type")),
        ("type is unknown", ~r["type"].isin(*TYPES)),
        ("sensitivity is required", blank("sensitivity")),
        ("sensitivity is unknown", ~r["sensitivity"].isin(*SENSITIVITIES)),
        ("confidence must be in [0, 1]", F.coalesce((r["confidence"] < 0) | (r["confidence"] > 1), F.lit(False))),
        ("salience must not be negative", F.coalesce(r["salience"] < 0, F.lit(False))),
        ("payload is required", absent),
        ("payload must be of the record's type", ~F.coalesce(kind == r["type"], F.lit(False))),
    ]
    return reduce(lambda acc, x: acc.when(x[1], F.lit(x[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))
