"""Element queries over ``elements`` and their entity-attribute-value ``properties``.

A filter is a JSON object, or a dict: keys are an implicit AND; ``$and`` and ``$or`` take non-empty arrays; keys that start
with ``@`` are columns of the element, all others property keys. A scalar operand means ``$eq``, an object holds operators.
Every property condition is a flag of an element, whether any of its rows satisfies it, so repeated keys may satisfy two bounds
by two rows. All flags come from one scan and one grouping of the properties, whatever the number of conditions. Unknown
operators, and negation, are refused by name.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns that a filter may name.
ROOT = {"@label": "name", "@classFullName": "class", "@id": "global_id", "@storey": "storey"}
#: Limits.
MAX_CHARACTERS, MAX_DEPTH, MAX_CLAUSES, MAX_OBJECTS, MAX_ENTRIES = 65_536, 20, 100, 1000, 100
MAX_KEYS, MAX_KEY_CHARACTERS, MAX_GROUPS, MAX_CHILDREN, MAX_TREE = 100, 256, 1000, 50_000, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COMPARE = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


class FilterError(ValueError):
    """A filter that isn't allowed."""


def like(column: Column, pattern: str) -> Column:
    """LIKE in which only A-Z and a-z are alike and no character escapes."""
    return F.translate(column, _UPPER, _LOWER).like(pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\"))


def typed_equal(value: object) -> Column:
    """A property row that holds this value, in the value's own type."""
    if isinstance(value, bool):
        return F.col("value_boolean") == value
    if isinstance(value, int | float):
        if not math.isfinite(value):
            raise FilterError("numbers that aren't finite can't be compared")
        return F.col("value_number") == float(value)
    if isinstance(value, str):
        return F.col("value_text") == value
    raise FilterError("only texts, numbers and truth values can be compared")


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def root_condition(field: str, op: str, value: object) -> Column:
    if field not in ROOT:
        raise FilterError(f"there is no element field {field!r}")
    column = F.col(ROOT[field])
    if op in _COMPARE:
        raise FilterError(f"{op} can't be asked of {field}")
    if op == "$in":
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value) or len(value) > MAX_ENTRIES:
            raise FilterError(f"$in on {field}: a list of texts, {MAX_ENTRIES} at most")
        return column.isin(value) if value else F.lit(False)
    if op not in ("$eq", "$ne", "$like"):
        raise FilterError(f"no such operation: {op!r}")
    if not isinstance(value, str):
        raise FilterError(f"{op} on {field} compares with a text")
    return {"$eq": lambda: column == value, "$ne": lambda: column != value, "$like": lambda: like(column, value)}[op]()


class _Flags:
    """The conditions on property rows that a filter names; each is a flag column of the elements."""

    def __init__(self):
        self.conditions: list[tuple[str, Column]] = []
        self.keys: set[str] = set()

    def any_row(self, key: str, condition: Column | None = None) -> Column:
        """Whether an element has a row of a key, or one that satisfies a condition too; null stands for false."""
        name = f"flag{len(self.conditions)}_"
        own = F.col("key") == key
        self.keys.add(key)
        self.conditions.append((name, own if condition is None else own & condition))
        return F.col(name)


def _property_condition(flags: _Flags, key: str, op: str, value: object) -> Column:
    no = lambda flag: ~F.coalesce(flag, F.lit(False))
    if op in ("$eq", "$ne") and value is None:
        return no(flags.any_row(key)) if op == "$eq" else flags.any_row(key)
    if op == "$eq":
        return flags.any_row(key, typed_equal(value))
    if op == "$ne":
        return flags.any_row(key) & no(flags.any_row(key, typed_equal(value)))
    if op == "$in":
        if not isinstance(value, list) or len(value) > MAX_ENTRIES:
            raise FilterError(f"$in: a list, {MAX_ENTRIES} entries at most")
        return flags.any_row(key, _any([typed_equal(v) for v in value]))
    if op == "$like":
        if not isinstance(value, str):
            raise FilterError("$like compares with a text")
        return flags.any_row(key, like(F.col("value_text"), value))
    if op in _COMPARE:
        if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
            raise FilterError(f"{op} compares with a finite number")
        return flags.any_row(key, _COMPARE[op](F.col("value_number"), F.lit(float(value))))
    raise FilterError(f"no such operation: {op!r}")


def with_property(elements: DataFrame, properties: DataFrame, key: str, op: str, value: object) -> DataFrame:
    """The elements that satisfy one condition on a property."""
    return filtered(elements, properties, {key: {op: value}})


def parsed(condition: str | dict) -> dict:
    """The filter as a dict, its size, depth and counts checked."""
    text = condition if isinstance(condition, str) else json.dumps(condition)
    if len(text) > MAX_CHARACTERS:
        raise FilterError(f"filter text is limited to {MAX_CHARACTERS} characters")
    try:
        tree = json.loads(text)
    except ValueError as e:
        raise FilterError(f"not readable as JSON: {e}") from e
    counts = {"clauses": 0, "objects": 0}

    def visit(node: object, depth: int) -> None:
        if not isinstance(node, dict):
            raise FilterError("conditions stand in a JSON object")
        if depth > MAX_DEPTH:
            raise FilterError(f"nesting of conditions is limited to {MAX_DEPTH}")
        counts["objects"] += 1
        for key, value in node.items():
            if key in ("$and", "$or"):
                if not isinstance(value, list) or not value or len(value) > MAX_ENTRIES:
                    raise FilterError(f"{key}: a list of 1 to {MAX_ENTRIES} conditions")
                for part in value:
                    visit(part, depth + 1)
            elif key.startswith("$"):
                raise FilterError(f"no such operation: {key!r}")
            else:
                counts["clauses"] += 1
                if isinstance(value, dict) and (not value or not all(k.startswith("$") for k in value)):
                    raise FilterError(f"{key}: expected operations such as $eq")
        if counts["clauses"] > MAX_CLAUSES or counts["objects"] > MAX_OBJECTS:
            raise FilterError(f"limited to {MAX_CLAUSES} clauses in {MAX_OBJECTS} objects")

    visit(tree, 0)
    return tree


def _condition(tree: dict, flags: _Flags) -> Column:
    """A filter as a Boolean column of elements and flags."""
    out = F.lit(True)
    for key, value in tree.items():
        if key == "$and":
            part = reduce(Column.__and__, [_condition(p, flags) for p in value])
        elif key == "$or":
            part = reduce(Column.__or__, [_condition(p, flags) for p in value])
        else:
            one = root_condition if key.startswith("@") else lambda *a: _property_condition(flags, *a)
            part = reduce(Column.__and__, [one(key, op, operand) for op, operand in (value if isinstance(value, dict) else {"$eq": value}).items()])
        out = out & part
    return out


def _selected(elements: DataFrame, properties: DataFrame, condition: str | dict, keys: list[str] = (), by: str | None = None) -> DataFrame:
    """The elements that satisfy a filter, with ``values_`` (key, number and units of the rows of some keys) and ``groups_`` (the
    values of the property ``by``), all from one scan of the properties."""
    flags = _Flags()
    where = _condition(parsed(condition), flags)
    wanted = [F.max(F.when(c, True)).alias(n) for n, c in flags.conditions]
    if keys:
        wanted.append(F.collect_list(F.when(F.col("key").isin(keys), F.struct("key", "value_number", "units"))).alias("values_"))
    if by is not None:
        wanted.append(F.collect_list(F.when(F.col("key") == by, F.struct("value_text", "value_number", "value_boolean"))).alias("groups_"))
    if not wanted:
        return elements.where(where)
    own = properties.where(F.col("key").isin(sorted({*flags.keys, *keys, *([by] if by is not None else [])}))).groupBy("element_row").agg(*wanted)
    return elements.join(own, "element_row", "left").where(where).select(*elements.columns, *[c for c in ("values_", "groups_") if c in own.columns])


def filtered(elements: DataFrame, properties: DataFrame, condition: str | dict) -> DataFrame:
    """The elements that satisfy a filter. An empty object is true of all."""
    return _selected(elements, properties, condition)


def page(elements: DataFrame, after: int | None, top: int) -> DataFrame:
    """A keyset page: up to ``top`` rows after a row, with has_more."""
    rows = elements if after is None else elements.where(F.col("element_row") > after)
    taken = rows.orderBy("element_row").limit(top + 1)
    number = F.row_number().over(Window.orderBy("element_row"))
    return taken.withColumn("n", number).withColumn("has_more", F.max("n").over(Window.partitionBy()) > top).where(F.col("n") <= top).drop("n")


def latest_properties(properties: DataFrame) -> DataFrame:
    """One row per element and key: of repeated keys the last."""
    value = F.struct("value_text", "value_number", "value_boolean", "units")
    return properties.groupBy("element_row", "key").agg(F.max_by(value, "property_row").alias("v")).select("element_row", "key", "v.*")


def element_details(elements: DataFrame, properties: DataFrame) -> DataFrame:
    """Elements with the parent's global_id and their properties as a sorted array of key and value texts."""
    parents = elements.select(F.col("express_id").alias("parent_express_id"), F.col("global_id").alias("parent_global_id"))
    text = F.coalesce("value_text", F.col("value_number").cast("decimal(18,2)").cast("string"), F.col("value_boolean").cast("string"))
    props = latest_properties(properties).groupBy("element_row").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", text))), ";").alias("properties"))
    return elements.join(parents, "parent_express_id", "left").join(props, "element_row", "left")


def keys_of(raw: str | list[str]) -> list[str]:
    """Aggregation keys: a comma list, a JSON array or a list; 1 to 100, not repeated."""
    keys = raw if isinstance(raw, list) else json.loads(raw) if raw.startswith("[") else raw.split(",")
    if not 1 <= len(keys) <= MAX_KEYS or len(set(keys)) < len(keys) or not all(isinstance(k, str) and 1 <= len(k) <= MAX_KEY_CHARACTERS for k in keys):
        raise FilterError(f"aggregations take 1 to {MAX_KEYS} different keys of 1 to {MAX_KEY_CHARACTERS} characters")
    return keys


def _key_statistics(keys: list[str]) -> Column:
    """An array of the statistics of each key over rows of key, value_number and units; zeros and nulls for absent keys."""
    v, units = F.col("value_number"), F.col("units")

    def one(n: int, key: str) -> Column:
        own = F.when(F.col("key") == key, v)
        labels = F.array_sort(F.collect_set(F.when(own.isNotNull(), units)))
        return F.struct(F.lit(n).alias("ordinal"), F.lit(key).alias("key"), F.count(own).alias("count"), F.min(own).alias("min"), F.max(own).alias("max"), F.avg(own).alias("avg"), F.coalesce(F.sum(own), F.lit(0.0)).alias("total"), labels.alias("units"))

    return F.array(*[one(n, k) for n, k in enumerate(keys)])


_FIGURES = ["count", "min", "max", "avg", "total", "units"]


def aggregated(elements: DataFrame, properties: DataFrame, keys: str | list[str], condition: str | dict | None = None) -> DataFrame:
    """Per key: ordinal, count, min, max, avg, total and units of its numbers; zeros and nulls for absent keys. With a
    condition, of the elements that satisfy it; the properties are scanned once then."""
    keys = keys_of(keys)
    if condition is None:
        rows = properties.where(F.col("key").isin(keys)).join(elements.select("element_row"), "element_row", "left_semi")
    else:
        rows = _selected(elements, properties, condition, keys).select(F.explode("values_").alias("v")).select("v.*")
    return rows.agg(_key_statistics(keys).alias("s")).select(F.explode("s").alias("s")).select("s.ordinal", "s.key", *[f"s.{c}" for c in _FIGURES])


_GROUP = ["group_text", "group_number", "group_boolean"]


def _grouped(elements: DataFrame, by: str) -> DataFrame:
    """Elements with their group; elements with ``groups_`` (a property's values) once for each, or once with nulls."""
    if by.startswith("@"):
        if by not in ROOT:
            raise FilterError(f"unknown root field {by!r}")
        return elements.withColumns({"group_text": F.col(ROOT[by]), "group_number": F.lit(None).cast("double"), "group_boolean": F.lit(None).cast("boolean")})
    rows = elements.withColumn("g_", F.explode_outer("groups_"))
    return rows.withColumns(dict(zip(_GROUP, (F.col("g_.value_text"), F.col("g_.value_number"), F.col("g_.value_boolean"))))).drop("g_")


def _by(by: str) -> str | None:
    return None if by.startswith("@") else by


def group_counts(elements: DataFrame, properties: DataFrame, by: str, condition: str | dict | None = None) -> DataFrame:
    """Elements per value of a column or property; those without the property are the null group."""
    return _grouped(_selected(elements, properties, condition or {}, by=_by(by)), by).groupBy(*_GROUP).agg(F.count("*").alias("count"))


def checked_groups(groups: DataFrame) -> DataFrame:
    """Refuses more groups than are allowed; reads one more than that at most."""
    if groups.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise FilterError(f"there are more than {MAX_GROUPS} groups")
    return groups


def group_statistics(elements: DataFrame, properties: DataFrame, by: str, keys: str | list[str], condition: str | dict | None = None) -> DataFrame:
    """The statistics of each key in each group, filled with zeros; with a condition, of the elements that satisfy it. One scan
    of the properties serves the condition, the groups and the numbers."""
    keys = keys_of(keys)
    members = _grouped(_selected(elements, properties, condition or {}, keys, _by(by)), by)
    rows = members.select(*_GROUP, F.explode_outer("values_").alias("v")).select(*_GROUP, "v.*")
    stats = rows.groupBy(*_GROUP).agg(_key_statistics(keys).alias("s")).select(*_GROUP, F.explode("s").alias("s"))
    return stats.select(*_GROUP, "s.key", *[f"s.{c}" for c in _FIGURES])


def property_names(properties: DataFrame) -> DataFrame:
    """Distinct keys with the type of their values."""
    kind = F.when(F.col("value_number").isNotNull(), "number").when(F.col("value_boolean").isNotNull(), "boolean").otherwise("string")
    return properties.select("key", kind.alias("type")).distinct()


def children(elements: DataFrame, parent: int | None) -> DataFrame:
    """An element's children (of None: the roots): label (name, else class) and whether they have children."""
    own = elements.where(F.col("parent_express_id").isNull() if parent is None else F.col("parent_express_id") == parent)
    parents = elements.where("parent_express_id is not null").select(F.col("parent_express_id").alias("express_id")).distinct().withColumn("has", F.lit(True))
    return own.join(parents, "express_id", "left").select("express_id", "global_id", F.coalesce("name", "class").alias("label"), F.coalesce("has", F.lit(False)).alias("has_children"))


def paths(elements: DataFrame, global_ids: DataFrame, depth: int = MAX_TREE) -> DataFrame:
    """From each element (global_ids.global_id) to its root: start, express_id, step (0 = the element). Cycles end.

    One join per level with a column pruned table, until no row is left or the depth is reached.
    """
    up = elements.select("express_id", "parent_express_id")
    at = elements.join(global_ids, "global_id", "left_semi").select(F.col("global_id").alias("start"), "express_id", "parent_express_id", F.array("express_id").alias("seen"))
    out = at.withColumn("step", F.lit(0))
    for step in range(1, depth):
        nxt = at.select("start", F.col("parent_express_id").alias("express_id"), "seen").where("express_id is not null").join(up, "express_id")
        nxt = nxt.where(~F.array_contains("seen", F.col("express_id"))).select("start", "express_id", "parent_express_id", F.concat("seen", F.array("express_id")).alias("seen"))
        if nxt.isEmpty():
            break
        out = out.union(nxt.withColumn("step", F.lit(step)))
        at = nxt
    return out.select("start", "express_id", "step")


def edited(properties: DataFrame, changes: DataFrame) -> DataFrame:
    """A new version of the properties: rows of changed (element_row, key) give way to the changes."""
    return properties.join(changes.select("element_row", "key"), ["element_row", "key"], "left_anti").unionByName(changes.select(*properties.columns))


def without(elements: DataFrame, removed: DataFrame) -> DataFrame:
    return elements.join(removed.select("global_id"), "global_id", "left_anti")


def with_proxy(elements: DataFrame, global_id: str, cls: str, name: str) -> DataFrame:
    """The elements and one more, in the row after the last."""
    proxy = elements.agg((F.max("element_row") + 1).alias("element_row"), (F.max("express_id") + 1).alias("express_id"))
    proxy = proxy.select("express_id", F.lit(global_id).alias("global_id"), F.lit(cls).alias("class"), F.lit(name).alias("name"), F.lit(None).cast("long").alias("parent_express_id"), F.lit(None).cast("string").alias("storey"), "element_row")
    return elements.unionByName(proxy)


def mesh_hashes(triangles: DataFrame) -> DataFrame:
    """Per mesh a hash of its vertices in whole millimetres, of no matter which order of triangles."""
    mm = lambda c: F.round(F.col(c) * 1000).cast("long").cast("string")
    one = F.sha2(F.concat_ws(",", *[mm(v + axis) for v in "uvw" for axis in "xyz"]), 256)
    return triangles.groupBy("mesh_id").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(one))), 256).alias("mesh_hash"))


def word_parts(text: Column) -> Column:
    """A text with its words' parts after it: cut where lower meets upper case and letters meet digits."""
    parts = F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.when(parts == text, text).otherwise(F.concat_ws(" ", text, parts))




def property_statistics(properties: DataFrame) -> DataFrame:
    """One row: elements with properties, property rows, distinct keys."""
    return properties.agg(F.count_distinct("element_row").alias("elements"), F.count("*").alias("property_rows"), F.count_distinct("key").alias("keys"))


def known_ids(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """Those of the asked global_ids that elements have."""
    return asked.select("global_id").distinct().join(elements.select("global_id"), "global_id", "left_semi")


def placed(points: DataFrame, yaw: float, move: tuple[float, float, float]) -> DataFrame:
    """Points turned about the z axis by an angle in radians, then moved."""
    c, s = F.cos(F.lit(yaw)), F.sin(F.lit(yaw))
    x, y = F.col("x"), F.col("y")
    return points.withColumns({"x": x * c - y * s + move[0], "y": x * s + y * c + move[1], "z": F.col("z") + move[2]})


def rewritten(properties: DataFrame, key: str, text: Column | None = None, number: Column | None = None, boolean: Column | None = None) -> DataFrame:
    """Properties in which the values of a key are given anew, from the old ones."""
    new = {"value_text": text, "value_number": number, "value_boolean": boolean}
    return properties.withColumns({c: F.when(F.col("key") == key, v).otherwise(F.col(c)) for c, v in new.items() if v is not None})


#: The kinds of edits.
EDITS = ("set_property", "remove_property", "rename", "delete", "insert_proxy")


def applied_edit(elements: DataFrame, properties: DataFrame, edit: dict) -> tuple[DataFrame, DataFrame]:
    """New versions of elements and properties after one edit; unknown kinds and missing parts are refused.

    set_property (global_id, key, value), remove_property (global_id, key), rename (global_id, name), delete (global_id),
    insert_proxy (global_id, class, name).
    """
    kind = edit.get("kind")
    if kind not in EDITS:
        raise FilterError(f"unknown edit {kind!r}")
    if not isinstance(edit.get("global_id"), str):
        raise FilterError("an edit names a global_id")
    own = elements.where(F.col("global_id") == edit["global_id"]).select("element_row")
    if kind == "insert_proxy":
        if not elements.where(F.col("global_id") == edit["global_id"]).isEmpty():
            raise FilterError("the global_id is taken")
        return with_proxy(elements, edit["global_id"], edit["class"], edit["name"]), properties
    if own.isEmpty():
        raise FilterError(f"no element {edit['global_id']!r}")
    if kind == "delete":
        return elements.where(F.col("global_id") != edit["global_id"]), properties.join(own, "element_row", "left_anti").select(*properties.columns)
    if kind == "rename":
        return elements.withColumn("name", F.when(F.col("global_id") == edit["global_id"], F.lit(edit["name"])).otherwise(F.col("name"))), properties
    gone = own.withColumn("key", F.lit(edit["key"]))
    rest = properties.join(gone, ["element_row", "key"], "left_anti").select(*properties.columns)
    if kind == "remove_property":
        return elements, rest
    value = edit["value"]
    typed_equal(value)
    last = properties.agg(F.coalesce(F.max("property_row"), F.lit(-1)) + 1).first()[0]
    text, number, flag = (value if isinstance(value, str) else None, float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None, value if isinstance(value, bool) else None)
    row = own.select("element_row", F.lit(last).alias("property_row"), F.lit(edit["key"]).alias("key"), F.lit(text).cast("string").alias("value_text"), F.lit(number).cast("double").alias("value_number"), F.lit(flag).cast("boolean").alias("value_boolean"), F.lit(None).cast("string").alias("units"))
    return elements, rest.unionByName(row)
