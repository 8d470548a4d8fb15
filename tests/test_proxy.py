"""Operators of a proxy beyond what the tables hold: colliding ids, deep JSON, corpus files, configuration."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardline import catalogue as c
from wardline.functions import leaves
from wardline.operators import correlate, policy, proxy, scan
from wardline.plans import pipeline
from wardline.sources import corpus

SSN = "ssn 123-45-6789"


def test_responses_take_the_last_request_once(spark):
    asked = spark.createDataFrame([("s", 1, 1, "old"), ("s", 1, 2, "new"), ("t", 1, 1, "other"), ("s", 2, 9, "late"), ("s", 3, 1, "failing"), ("s", 4, 1, "waits"), ("s", 4, 2, "waits longer")], "session_id string, id long, seq long, tool string")
    told = spark.createDataFrame([("s", 1, 3, SSN, None), ("s", 1, 4, SSN, None), ("s", 2, 5, SSN, None), ("s", 3, 2, SSN, "failed"), ("u", 1, 1, SSN, None)], "session_id string, id long, seq long, text string, error string")
    got = sorted((r.session_id, r.id, r.seq, r.tool, r.text) for r in correlate.correlated(asked, told).collect())
    redacted = "ssn [REDACTED-SSN]"
    assert got == [("s", 1, 3, "new", redacted), ("s", 1, 4, None, SSN), ("s", 2, 5, None, SSN), ("s", 3, 2, "failing", SSN), ("u", 1, 1, None, SSN)]
    assert sorted((r.session_id, r.id, r.tool, r.code) for r in correlate.orphans(asked, told).collect()) == [("s", 2, "late", -32000), ("s", 4, "waits longer", -32000), ("t", 1, "other", -32000)]
    bare = correlate.correlated(asked.where("id = 3").drop("seq"), told.where("id = 3").drop("seq", "error")).collect()
    assert [(r.tool, r.text) for r in bare] == [("failing", redacted)]
    assert correlate.correlated(asked.limit(0), told.limit(0)).isEmpty() and correlate.orphans(asked.limit(0), told).isEmpty()


def test_correlation_as_replay(spark):
    rng, asked, told, want, waiting = random.Random(3), [], [], [], {}
    for seq in range(3000):
        key = (f"s{rng.randrange(4)}", rng.randrange(5))
        if rng.random() < 0.5:
            waiting[key] = f"t{rng.randrange(9)}"
            asked.append((*key, seq, waiting[key]))
        else:
            told.append((*key, seq, SSN))
            want.append((*key, seq, waiting.pop(key, None)))
    a = spark.createDataFrame(asked, "session_id string, id long, seq long, tool string")
    b = spark.createDataFrame(told, "session_id string, id long, seq long, text string")
    assert sorted((r.session_id, r.id, r.seq, r.tool or "") for r in correlate.correlated(a, b).collect()) == sorted((*w[:3], w[3] or "") for w in want)
    assert {(r.session_id, r.id): r.tool for r in correlate.orphans(a, b).collect()} == waiting


def test_leaves_of_any_depth_and_kind(spark):
    deep = '{"a":[' * 6000 + '"x"' + "]}" * 6000
    rows = [(1, '{"z":1,"a":[true,false,null,-1.5e3,""],"q\\"uote, :{":"v,]"}'), (2, deep), (3, '"top"'), (4, "{bad"), (5, None), (6, "{}"), (7, '{"a":1} x'), (8, " [ 1 , [ 2 ] ] "), (9, "[" * 60_000 + "bad" + "]" * 60_000), (10, "[" * 60_000), (11, "[" * 60_000 + "7" + "]" * 60_000)]
    df = spark.createDataFrame([(k, t, "kept") for k, t in rows], "k int, j string, path string")
    got = {}
    for r in leaves.leaves(df, "j").collect():
        got.setdefault(r.k, []).append((r.path, r.type, r.value))
    assert got[1] == [("$.z", "BIGINT", "1"), ("$.a[0]", "BOOLEAN", "True"), ("$.a[1]", "BOOLEAN", "False"), ("$.a[2]", "VOID", ""), ("$.a[3]", "DOUBLE", "-1500.0"), ("$.a[4]", "STRING", ""), ('$.q"uote, :{', "STRING", "v,]")]
    assert [x[1:] for x in got[2]] == [("STRING", "x")] and got[2][0][0] == "$" + ".a[0]" * 6000
    assert got[3] == [("$", "STRING", "top")] and got[8] == [("$[0]", "BIGINT", "1"), ("$[1][0]", "BIGINT", "2")] and got[11] == [("$" + "[0]" * 60_000, "BIGINT", "7")] and set(got) == {1, 2, 3, 8, 11}


def test_leaves_as_a_recursive_walk(spark):
    rng = random.Random(5)

    def value(n):
        kind = rng.randrange(6 if n else 4)
        if kind == 4:
            return {rng.choice('ab ":,{}[]\\é') + str(k): value(n - 1) for k in range(rng.randrange(4))}
        return [value(n - 1) for _ in range(rng.randrange(4))] if kind == 5 else (rng.randrange(99), 'te"x\\t', None, rng.random() < 0.5)[kind]

    def walk(v, path):
        if isinstance(v, dict):
            return [x for k, w in v.items() for x in walk(w, f"{path}.{k}")]
        return [x for k, w in enumerate(v) for x in walk(w, f"{path}[{k}]")] if isinstance(v, list) else [(path, "" if v is None else str(v))]

    values = [value(5) for _ in range(300)]
    df = spark.createDataFrame([(k, json.dumps(v, indent=k % 3 or None, ensure_ascii=k % 2 == 0)) for k, v in enumerate(values)], "k int, j string")
    got = {}
    for r in leaves.leaves(df, "j").collect():
        got.setdefault(r.k, []).append((r.path, r.value))
    assert all(got.get(k, []) == walk(v, "$") for k, v in enumerate(values))


def test_corpus_files(spark, tmp_path):
    path = tmp_path / "attacks.yaml"
    path.write_text('payloads:\n  - id: "a-1"\n    name: N\n    category: pii_leak\n    tool: file_read\n    arguments: {path: /x}\n    expected_behavior: redact\n    severity: high\n    description: D\n  - {id: b, name: M, category: c, tool: t}\n')
    assert [tuple(r) for r in corpus.read(spark, str(path)).orderBy("ord").collect()] == [(0, "a-1", "N", "pii_leak", "file_read", '{"path": "/x"}', "redact", "high", "D"), (1, "b", "M", "c", "t", "{}", "", "low", "")]
    assert corpus.read(spark, None).isEmpty()
    for bad in ("payloads: [{id: 1}]", "a: [", "payloads:\n  - x"):
        path.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017 - of several kinds
            corpus.read(spark, str(path))
    with pytest.raises(OSError):
        corpus.read(spark, str(tmp_path / "none.yaml"))


def test_discovery_fails_on_errors(spark):
    for body in ('{"error":{"code":1}}', '{"result":{"tools":{}}}', "{}", "{bad"):
        with pytest.raises(PySparkException):
            scan.discovered(spark.createDataFrame([(body,)], "body string")).collect()
    body = '{"result":{"tools":[{"name":"t","inputSchema":{"properties":{"zeta":{"type":"string"},"cmd":{"type":"string"},"opt":{}},"required":["zeta"]}}]}}'
    tools = scan.discovered(spark.createDataFrame([(body,)], "body string")).select("name", scan.string_properties(F.col("schema")).alias("properties"), scan.required(F.col("schema")).alias("needed"))
    assert {r.id: r.args for r in scan.dynamic_payloads(tools).collect()} == {"dyn-cmd-t-cmd": {"cmd": c.PROBES["cmd"], "zeta": "test"}, "dyn-pi-t-zeta": {"zeta": c.PROBES["pi"]}}


def test_defaults_are_worked_out_once(spark):
    """What a row's schema says is parsed once, not for each property or once more for a filter; odd properties and needs don't matter."""
    from wardline.queries import QUERIES

    plan = QUERIES["fill_defaults"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("from_json("), plan.count("get_json_object(")) == (3, 3)  # tools, properties, needed
    rows = [({"a": "1"}, ["a", "b", "c", "d"], ["c", None, "b", "x"]), (None, ["a"], ["a"]), ({"a": "1"}, None, ["a"]), ({"a": None}, ["a", None, "d"], None), ({"x": None}, ["a", None, "d"], [None, "d"]), ({}, [], [])]
    df = spark.createDataFrame(rows, "a map<string,string>, p array<string>, n array<string>").coalesce(1)
    got = [r.x for r in df.select(scan.with_defaults(F.col("a"), F.col("p"), F.col("n")).alias("x")).collect()]
    assert got == [{"a": "1", "b": "test", "c": "test"}, None, None, {"a": None}, {"x": None, "d": "test"}, {}]


def test_configuration_and_access(spark):
    assert [proxy.upstream_error(*x) for x in (("u", None), (None, "c"), ("u", "c"), (None, ""))] == [None, None, 503, 503]
    row = spark.range(1).select(proxy.authorised(F.lit("POST"), F.lit(None), None).alias("open"), proxy.authorised(F.lit("POST"), F.lit(None).cast("string"), "t").alias("shut"), proxy.route(F.lit(None).cast("string")).alias("route"))
    assert tuple(row.first()) == (True, False, "error")


def test_rules_say_why(spark):
    calls = spark.createDataFrame([(1, "shell_exec", {"command": "sudo ls"}), (2, "email_send", {"to": "a@b.c"}), (3, "x", {})], "id long, tool string, args map<string,string>")
    assert [r.message for r in pipeline.decided(calls).orderBy("id").collect()] == ["Blocked: dangerous shell command", "Email to external domain requires approval", ""]
    assert policy.rules_frame(spark).where("message = ''").isEmpty()
    failed = spark.createDataFrame([(0, "p", "pii_leak", "file_read", {"path": "/a/b.txt"}), (1, "q", "prompt_injection", "email_send", {"body": "one two three four five"}), (2, "r", "data_exfiltration", "shell_exec", {"command": "ls"}), (3, "s", "new kind", "x", {})], "ord int, id string, category string, tool string, args map<string,string>")
    assert [(r.name, r.message) for r in scan.generated_rules(failed).orderBy("ord").collect()] == [("autogen_p", "blocks reads of b.txt"), ("autogen_q", "blocks prompt injection in email body"), ("autogen_r", "blocks data exfiltration via shell")]
