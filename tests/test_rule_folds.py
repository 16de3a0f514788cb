"""Rule sets as SQL: the fold equals the machine, and plans grow in proportion to the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fluvia.operators import ruleset

SETS = {
    "general": ruleset.from_document(ruleset.GENERIC),
    "inline": ruleset.inline([{"re": r"k(?<key>\d+)", "dst": "s"}, {"src": "s", "re": "no", "reject": True}, {"src": "s", "re": r"v(?<val>\w+)"}, {"src": "gone", "re": "x"}]),
    "names": ruleset.from_document({"start": [{"regex": r"(\d+)(?:-(\d+))?", "name": ["a", "b", "text"], "next": "t"}], "t": [{"regex": r"^ *(\w)", "name": "c"}, {"regex": "!", "name": "void", "next": "nowhere"}]}),
    "filled": ruleset.from_document([{"regex": r"([a-z])(\d)?", "name": ["x", "y"]}], empty="-", trim=False),
}


def lines():
    rng = random.Random(3)
    made = ["".join(rng.choices(["k1", "k22 ", "v", "no", " ", "7", "7-8", "a", "b5", "!", "x", "\t", "·", "\n", "=", "/p", ":9", "12ms "], k=rng.randint(0, 9))) for _ in range(400)]
    return [*made, None, "", "  ", "2024-01-12 06:30:00 [web] GET /p/1 from 10.0.0.2:80 took 5ms ERROR: kind=view", "Jan 12 06:30:00 app: x"]


@pytest.mark.parametrize("name", sorted(SETS))
def test_fold_equals_machine(spark, name):
    df = spark.createDataFrame(list(enumerate(lines())), "i long, line string")
    plain = lambda d: sorted((r["i"], [(p["name"], p["value"] or "") for p in r["parsed"]]) for r in d.collect())
    want = plain(ruleset.extract(df, "line", SETS[name]))
    assert plain(ruleset.extract_fold(df, "line", SETS[name])) == want and any(p for _, p in want)


def test_templates_need_the_machine(spark):
    rules = ruleset.from_document([{"regex": "a", "set": [{"key": "k", "value": "${x}"}]}])
    with pytest.raises(ValueError):
        ruleset.extract_fold(spark.createDataFrame([("a",)], "line string"), "line", rules)


def test_plans_are_linear(spark):
    df = spark.createDataFrame([("a0 b1",)], "line string")

    def calls(n, form):
        rules = {("start" if not i else f"s{i}"): [{"regex": rf"(\w)({i})", "name": [f"a{i}", f"b{i}"], "next": f"s{i + 1}"}] for i in range(n)}
        made = form(df, rules)
        return len(re.findall(r"RLIKE|regexp_extract", made._jdf.queryExecution().optimizedPlan().toString()))

    chain = lambda d, r: ruleset.extract_native(d, "line", ruleset.from_document(r), "p")
    fold = lambda d, r: ruleset.extract_fold(d, "line", ruleset.from_document(r)).select(F.size("parsed"))
    for form in (chain, fold):
        assert calls(12, form) <= 2.3 * calls(6, form)


def test_long_chain(spark):
    rules = {("start" if not i else f"s{i}"): [{"regex": rf"(\d+){chr(97 + i)}", "name": f"n{i}", "next": f"s{i + 1}"}] for i in range(12)}
    df = spark.createDataFrame([("".join(f"{i}{chr(97 + i)} " for i in range(12)),)], "line string")
    row = ruleset.extract_native(df, "line", ruleset.from_document(rules), "p").first()["p"]
    assert [row[f"n{i}"] for i in range(12)] == [str(i) for i in range(12)]


def test_pairs_as_lists():
    """Rejected lines are null, lines without pairs empty, nulls among values stay."""
    made = ruleset._as_lists([None, [], [("a", "1"), ("b", None)]])
    assert made.to_pylist() == [None, [], [{"name": "a", "value": "1"}, {"name": "b", "value": None}]]
    assert ruleset._as_lists([]).to_pylist() == []
