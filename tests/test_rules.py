import pytest

from quarrystone.operators import rules
from quarrystone.operators.elements import FilterError, filtered

E = "element_row long, express_id long, global_id string, class string, name string, parent_express_id long, storey string"
P = "element_row long, property_row int, key string, value_text string, value_number double, value_boolean boolean, units string"


def tables(spark):
    elements = spark.createDataFrame([(k, k, f"g{k}", "Wall" if k % 2 else "Door", f"n{k}", None, None if k % 5 == 0 else f"s{k % 3}") for k in range(40)], E)
    properties = spark.createDataFrame([(k, j, f"k{j}", None if (k + j) % 4 else f"t{k % 6}", float((k * j) % 11) if (k + j) % 4 else None, None, None) for k in range(40) for j in range(5) if (k + j) % 7], P)
    return elements, properties


def test_each_rule_is_two_filters(spark):
    elements, properties = tables(spark)
    made = [{"name": f"r{k}", "applies": {"@classFullName": "Wall"} if k % 2 else {f"k{k % 5}": {"$ne": None}}, "requires": {f"k{(k + 1) % 5}": {"$lt": k % 11}} if k % 3 else {"@storey": "s1"}} for k in range(100)]
    got = {(r["rule"], r["global_id"]): r["passed"] for r in rules.verdicts(elements, properties, made).collect()}
    for rule in made[:12]:
        applies = {r[0] for r in filtered(elements, properties, rule["applies"]).select("global_id").collect()}
        holds = {r[0] for r in filtered(elements, properties, rule["requires"]).select("global_id").collect()}
        assert {k: v for k, v in got.items() if k[0] == rule["name"]} == {(rule["name"], g): g in holds for g in applies}
    report = {r["rule"]: r for r in rules.report(elements, properties, made).collect()}
    assert len(report) == 100
    for name, r in report.items():
        own = [v for k, v in got.items() if k[0] == name]
        assert (r["applicable"], r["passed"], r["failed"]) == (len(own), sum(own), len(own) - sum(own)) and r["status"] == all(own)


def test_one_scan_of_the_properties(spark, tmp_path):
    elements, properties = tables(spark)
    properties.write.parquet(str(tmp_path / "p"))
    made = [{"name": f"r{k}", "applies": {f"k{k % 5}": {"$gt": k}}, "requires": {f"k{k % 4}": {"$ne": None}}} for k in range(100)]
    plan = rules.verdicts(elements, spark.read.parquet(str(tmp_path / "p")), made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_occurrence_and_empty(spark):
    elements, properties = tables(spark)
    made = [{"name": "a", "applies": {"@classFullName": "Roof"}, "occurs": "required"}, {"name": "b", "applies": {"@classFullName": "Roof"}}, {"name": "c", "applies": {"@classFullName": "Door"}, "occurs": "prohibited"}, {"name": "d", "applies": {"@classFullName": "Roof"}, "occurs": "prohibited"}]
    assert {r["rule"]: r["status"] for r in rules.report(elements, properties, made).collect()} == {"a": False, "b": True, "c": False, "d": True}
    assert {r["rule"]: r["applicable"] for r in rules.report(elements.where("false"), properties, made).collect()} == dict.fromkeys("abcd", 0)
    assert rules.verdicts(elements, properties, []).count() == 0 and rules.report(elements, properties, []).count() == 0


@pytest.mark.parametrize("rule", [{"name": "x", "needs": {}}, {"name": None}, {"name": "x", "occurs": "never"}, {"name": "x", "occurs": "prohibited", "requires": {}}, {"name": "x", "applies": {"@where": "y"}}])
def test_refused(spark, rule):
    with pytest.raises(FilterError):
        rules.verdicts(*tables(spark), [rule])
    with pytest.raises(FilterError):
        rules.verdicts(*tables(spark), [{"name": "x"}, {"name": "x"}])
