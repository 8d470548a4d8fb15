"""Rules by an index against rules as literals of the plan."""

import random

from conftest import SF
from pyspark.sql import functions as F

from wardline import queries as q
from wardline.operators import policy, rule_index


def test_literals():
    cases = {
        r"rm\s+-rf": (" -rf",), r"curl.*\|.*sh": ("curl",), r"\bfoo(?:bar|bazz)?": ("foo",), r"(?:abc|defg)+x": ("abc", "defg"), r"(?:abc|de)x": None, r"\d{3}-\d{2}": None, r"[A-Z]{40,}": None, "(?:wget){0,2}x": None,
        "IGNORE": ("ignore",), "ab.cd": None, "(abc){2}": ("abc",), r"^SYSTEM:|\[SYSTEM\]": ("system:", "[system]"), "(": None, "": None, "naïve text": ("ve text",), "abc|": None, "(?=secret)x": None,
    }
    found = {p: rule_index.literals(p) for p in cases}
    assert found == cases | {r"rm\s+-rf": ("-rf",)}


def rules_of(n, rng, share=0.02):
    words = [f"{a}{b}" for a in ("alpha", "curl", "chmod", "ssn", "secret", "exec", "data", "wget") for b in range(200)]
    known = ["curl.*-d", r"sudo\s+", "chmod 777|chmod \\+s", "instructions", r"\d{3}-\d{2}-\d{4}", "etc.shadow", r"(?:victim|external)@", "ADMINISTRATOR", "nc evil", "[a-z]+@evil"]
    out = []
    for k in range(n):
        conditions = [("pattern_match", rng.choice(["command", "body", "to", "path"]), [rng.choice(known) if rng.random() < share else rng.choice(words) + r".*x\d"] + ([rng.choice(words)] if k % 3 == 0 else []), [])]
        if k % 500 == 1:
            conditions = [rng.choice([("domain_allowlist", "to", [], ["example.com"]), ("pii_detection", "", [r"4111-\d{4}"], []), ("always", "", [], [])])]
        if k % 7 == 0:
            conditions.append(("domain_allowlist", "to", [], ["gmail.com", ""]))
        out.append((k, f"r{k}", rng.choice(["*", "shell_exec", "email_send", "file_read"]), rng.choice(["BLOCK", "ALLOW", "REQUIRE_APPROVAL"]), f"m{k}", conditions))
    return [r for r in out if not (r[2] == "*" and r[5][0][0] == "always")]


def same(spark, calls, rules):
    d = policy.compiled(rules)
    want = calls.select("call_id", d["action"].alias("action"), d["rule_name"].alias("rule_name"), d["message"].alias("message"))
    got = rule_index.first_match(calls, spark.createDataFrame(rules, policy.RULE))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    return got


def test_many_rules_as_compiled(spark, monkeypatch):
    rng = random.Random(6)
    calls = q.calls(spark, SF).where("call_id < 120")
    got = same(spark, calls, rules_of(150, rng, 0.4))
    assert got.where("rule_name is not null").count() > 20
    monkeypatch.setattr(rule_index, "FEW", 0)
    same(spark, calls, rules_of(60, rng, 0.4))


def test_thousands_of_rules(spark):
    """The decisions of 5,000 rules are those of the few that any call matches, and few pairs are verified."""
    rules = rules_of(5000, random.Random(8))
    calls, table = q.calls(spark, SF), spark.createDataFrame(rules, policy.RULE)
    got = sorted(map(tuple, rule_index.first_match(calls, table).collect()), key=str)
    anchored = {r.ord for r in rule_index.anchored(table).where("literals is not null").collect()}
    assert len(anchored) > 4500
    pairs = rule_index.candidates(calls, table, "call_id").where(F.col("rule.ord").isin(*anchored))
    assert pairs.count() < 40 * calls.count()
    used = {r[2] for r in got if r[2]}
    near = [r for r in rules if r[1] in used]
    want = calls.select("call_id", policy.compiled(near).alias("d")).select("call_id", "d.action", "d.rule_name", "d.message")
    assert sorted(map(tuple, want.collect()), key=str) == got and len(used) > 3


def test_odd_rules_and_calls(spark):
    calls = spark.createDataFrame([(1, "t", {"x": "KELVIN ſecret İsing"}), (2, "t", None), (3, None, {"x": None}), (4, "t", {}), (5, "t", {"y": "secret", "x": "n" * 50_000 + "Needle"})], "call_id int, tool string, args map<string,string>")
    for patterns, hit in ((["kelvin"], {1}), (["secret"], {1}), (["ising"], {1}), (["needle$"], {5}), ([""], {1, 2, 3, 4, 5}), ([], set()), (["ab", "needle"], {5})):
        rule = spark.createDataFrame([(0, "r", "*", "BLOCK", "m", [("pattern_match", "x", patterns, [])])], policy.RULE)
        got = {r.call_id for r in rule_index.first_match(calls, rule).collect() if r.action == "BLOCK"}
        assert got == hit, patterns
    none = spark.createDataFrame([], policy.RULE)
    assert {r.action for r in rule_index.first_match(calls, none).collect()} == {"ALLOW"} and rule_index.first_match(calls.limit(0), none).isEmpty()
    two = spark.createDataFrame([(0, "a", "*", "BLOCK", "", [("pattern_match", "x", ["needle"], [])]), (0, "b", "*", "ALLOW", "", [("pattern_match", "y", ["secret"], [])])], policy.RULE)
    assert rule_index.first_match(calls, two).where("call_id = 5").first().rule_name == "a"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calls_are_not_dealt_out_by_tool(spark):
    """Tools are few: dealt out by them, all calls are a few tasks. Nor do rules' texts go with each pair through a sort."""
    rules = policy.rule_rows() + [(90, "any", "*", "BLOCK", "m", [("pii_detection", "", [r"\d{3}-\d{2}"], [])])]
    plan = plan_of(rule_index.first_match(q.calls(spark, SF), spark.createDataFrame(rules, policy.RULE)))
    assert "hashpartitioning(tool" not in plan and "min_by" not in plan


def test_rules_of_tools(spark):
    """Rules come to calls: each call keeps its row, and no call is shuffled."""
    calls = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "*")], "call_id int, tool string")
    rules = spark.createDataFrame([("a", 3), ("*", 1), ("a", 0), ("*", 1)], "tool string, ord int")
    assert sorted((r.call_id, r.ords) for r in policy.of_tool(calls, rules).collect()) == [(1, [0, 1, 3]), (1, [0, 1, 3]), (2, [1]), (3, [1]), (4, [1])]
    assert [r.ords for r in policy.of_tool(calls, rules.where("tool = 'a'")).orderBy("call_id").collect()] == [[0, 3], [0, 3], [], [], []]
    assert "hashpartitioning(call_id" not in (plan := plan_of(q.QUERIES["tool_match"](spark, SF))) and "SortMergeJoin" not in plan
