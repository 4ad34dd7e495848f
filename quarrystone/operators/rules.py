"""Rule checks of elements: rules that say to which elements they apply and what these must satisfy, both as element filters.

All conditions of all rules are flags of one scan and one grouping of the properties, however many rules there are. A rule is a
dict: name, applies (a filter), requires (a filter), and occurs: ``optional`` (the default: every element that it applies to must
satisfy it), ``required`` (there must be such an element too) or ``prohibited`` (there must be none; requires is left out).

Defined cases: a condition on nothing, or on null, is not satisfied; repeated keys satisfy a condition if one row does; a rule that
applies to no element has passed unless it is required; without elements the report still has a row a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.elements import FilterError, _condition, _Flags, parsed

OCCURS = ("optional", "required", "prohibited")
MAX_RULES = 1000
#: Flags of a number.
WORD = 32


def checked_rules(rules: list[dict]) -> list[dict]:
    """The rules with their filters parsed; unknown parts, repeated names and too many rules raise."""
    if len(rules) > MAX_RULES:
        raise FilterError(f"{MAX_RULES} rules at most")
    out = []
    for rule in rules:
        unknown = set(rule) - {"name", "applies", "requires", "occurs"}
        occurs = rule.get("occurs", "optional")
        if unknown or not isinstance(rule.get("name"), str) or occurs not in OCCURS:
            raise FilterError(f"not a rule: {sorted(unknown) or rule.get('name')!r}, occurs {occurs!r}")
        if occurs == "prohibited" and "requires" in rule:
            raise FilterError(f"rule {rule['name']!r} is prohibited and can't require anything")
        out.append({"name": rule["name"], "occurs": occurs, "applies": parsed(rule.get("applies", {})), "requires": parsed(rule.get("requires", {}))})
    if len({r["name"] for r in out}) < len(out):
        raise FilterError("names of rules must differ")
    return out


def _flagged(elements: DataFrame, properties: DataFrame, rules: list[dict]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Elements with the flags of all rules; per rule whether it applies and whether it is satisfied."""
    flags = _Flags()
    true = lambda c: F.coalesce(c, F.lit(False))
    columns = [(true(_condition(r["applies"], flags)), F.lit(False) if r["occurs"] == "prohibited" else true(_condition(r["requires"], flags))) for r in rules]
    if not flags.conditions:
        return elements, columns
    # the flags of an element are the bits of a few numbers, so that rows stay small however many rules there are
    words = [flags.conditions[k : k + WORD] for k in range(0, len(flags.conditions), WORD)]
    bit = lambda c, i: F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    masks = [F.bit_or(reduce(Column.bitwiseOR, [bit(c, i) for i, (_, c) in enumerate(word)])).alias(f"word{w}_") for w, word in enumerate(words)]
    own = properties.where(F.col("key").isin(sorted(flags.keys))).groupBy("element_row").agg(*masks)
    told = {name: F.col(f"word{w}_").bitwiseAND(F.lit(1 << i).cast("long")) != 0 for w, word in enumerate(words) for i, (name, _) in enumerate(word)}
    return elements.join(own, "element_row", "left").withColumns(told), columns


def verdicts(elements: DataFrame, properties: DataFrame, rules: list[dict]) -> DataFrame:
    """Per element and rule that applies to it: the element's columns, rule, passed."""
    rules = checked_rules(rules)
    rows, columns = _flagged(elements, properties, rules)
    own = [c for c in elements.columns if c not in ("rule", "passed")]
    one = [F.when(a, F.struct(F.lit(r["name"]).alias("rule"), p.alias("passed"))) for r, (a, p) in zip(rules, columns)]
    none = F.array().cast("array<struct<rule:string,passed:boolean>>")
    return rows.select(*own, F.explode(F.array_compact(F.array(*one) if one else none)).alias("r")).select(*own, "r.rule", "r.passed")


def report(elements: DataFrame, properties: DataFrame, rules: list[dict]) -> DataFrame:
    """A row a rule: rule, occurs, applicable, passed, failed (elements) and status (whether the rule as a whole holds)."""
    rules = checked_rules(rules)
    if not rules:
        return elements.sparkSession.createDataFrame([], "rule string, occurs string, applicable long, passed long, failed long, status boolean")
    rows, columns = _flagged(elements, properties, rules)
    counts = [F.struct(F.count_if(a).alias("applicable"), F.count_if(a & p).alias("passed")) for a, p in columns]
    one = rows.agg(*[c.alias(f"r{k}") for k, c in enumerate(counts)])
    named = [F.struct(F.lit(r["name"]).alias("rule"), F.lit(r["occurs"]).alias("occurs"), F.col(f"r{k}.applicable").alias("applicable"), F.col(f"r{k}.passed").alias("passed")) for k, r in enumerate(rules)]
    failed = F.col("applicable") - F.col("passed")
    status = (failed == 0) & ((F.col("occurs") != "required") | (F.col("applicable") > 0))
    return one.select(F.inline(F.array(*named))).withColumns({"failed": failed, "status": status})
