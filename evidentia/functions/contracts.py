"""Strict contracts of requests: a schema is a table of rules, and a request gets all violations at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of JSON values by the types that a variant shows.
KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<", "object": "^OBJECT<"}


@dataclass(frozen=True)
class Rule:
    """What a field of a request has to be. Lengths count characters of trimmed strings and items of arrays; least and most bound numbers."""

    field: str
    kind: str
    required: bool = False
    shortest: int | None = None
    longest: int | None = None
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    values: tuple[str, ...] | None = None


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is made once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _problem(body: Column, parsed: Column, rule: Rule) -> Column:
    """`field: problem` of the first problem of a rule; null without one. What the variant tells is not parsed out of the text again."""
    value = lambda kind: F.try_variant_get(parsed, F.lit(f"$.{rule.field}"), kind)
    text, number = F.trim(value("string") if rule.kind == "string" else F.get_json_object(body, f"$.{rule.field}")), value("double")
    size = F.size(value("array<variant>")) if rule.kind == "array" else F.length(text)

    def first(kind: Column) -> Column:
        problem = F.when(kind == "VOID", F.lit("missing") if rule.required else F.lit(None).cast("string"))
        problem = problem.when(~kind.rlike(KINDS[rule.kind]), "type")
        if rule.shortest is not None or rule.longest is not None:
            least, most = F.lit(rule.shortest or 0), F.lit(2**31 - 1 if rule.longest is None else rule.longest)
            problem = problem.when(_bound(size, lambda n: (n < least) | (n > most)), "length")
        if rule.least is not None or rule.most is not None:
            least, most = F.lit(float("-inf") if rule.least is None else rule.least), F.lit(float("inf") if rule.most is None else rule.most)
            problem = problem.when(_bound(number, lambda n: (n < least) | (n > most)), "range")
        if rule.pattern:
            problem = problem.when(~text.rlike(rule.pattern), "pattern")
        if rule.values:
            problem = problem.when(~text.isin(*rule.values), "value")
        return problem

    kind = F.coalesce(F.schema_of_variant(value("variant")), F.lit("VOID"))
    return F.concat(F.lit(f"{rule.field}: "), _bound(kind, first))


def violations(body: Column, rules: list[Rule]) -> Column:
    """An array of `field: problem` of a JSON text against rules: not_json and not_object alone; else unknown fields, which a strict contract
    does not take, and for each rule the first problem of missing, type, length, range, pattern and value. Empty for a good request.
    A text is made and parsed into a variant once, whatever the number of rules."""

    def of(x: Column) -> Column:
        names = F.map_keys(x["fields"])
        unknown = F.transform(F.array_sort(F.array_except(names, F.array(*[F.lit(r.field) for r in rules]))), lambda n: F.concat(n, F.lit(": unknown")))
        found = F.filter(F.array(*[_problem(x["body"], x["parsed"], r) for r in rules]), lambda y: y.isNotNull())
        wrong = F.when(x["parsed"].isNull(), F.array(F.lit("not_json"))).when(x["fields"].isNull(), F.array(F.lit("not_object")))
        return wrong.otherwise(F.concat(unknown, found))

    parsed = lambda b: _bound(F.try_parse_json(b), lambda p: F.struct(b.alias("body"), p.alias("parsed"), F.try_variant_get(p, F.lit("$"), "map<string,variant>").alias("fields")))
    return _bound(_bound(body, parsed), of)
