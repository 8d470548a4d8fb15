"""Similar names, and tools mapped by them, against comparing all pairs."""

import difflib
import random

from conftest import SF
from pyspark.sql import functions as F

from wardline import catalogue as c
from wardline.operators import scan


def test_similar_names_as_all_pairs(spark):
    parts = [r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").distinct().orderBy("p_name").limit(150).collect()]
    rng = random.Random(4)
    names = list(dict.fromkeys(parts + ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["ab", "ba", "é日", "x" * 250 + "yz"]))
    asked = list(dict.fromkeys(["".join(rng.sample(n, len(n))) if rng.random() < 0.3 else n[: rng.randrange(len(n) + 1)] for n in names] + ["ab", "ba", "abc", "", "x" * 240]))
    want = {}
    for x in asked:
        if close := difflib.get_close_matches(x, names, n=1, cutoff=scan.ALIKE):
            want[x] = close[0]
    rows = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.normal for r in scan.similar_names(rows(asked), rows(names)).collect()} == want and len(want) > 100
    assert scan.similar_names(rows([]), rows(names)).isEmpty() and scan.similar_names(rows(asked), rows([])).isEmpty()


def one(tool, names):
    """The steps for one tool, one after the other."""
    if tool in names:
        return tool
    lower = {n.lower(): n for n in names}
    if tool.lower() in lower:
        return lower[tool.lower()]
    norm = lambda s: s.lower().replace("_", "").replace("-", "")
    normal = {}
    for n in names:
        normal.setdefault(norm(n), n)
    if close := difflib.get_close_matches(norm(tool), [norm(n) for n in names], n=1, cutoff=scan.ALIKE):
        return normal[close[0]]
    return next((n for n in names if any(h in n.lower() for h in c.HINTS.get(tool, ()))), None)


def test_tools_of_many_servers(spark):
    rng = random.Random(5)
    words = ["read", "file", "shell", "exec", "bash", "Email", "send", "mail", "cmd", "open", "note", "x"]
    servers = {s: list(dict.fromkeys(rng.choice("_-").join(rng.sample(words, rng.randrange(1, 4))) for _ in range(rng.randrange(6)))) for s in range(60)}
    servers[60] = ["File_Read", "FILE_READ", "file-read", "file__read"]
    served = spark.createDataFrame([(s, k, n) for s, names in servers.items() for k, n in enumerate(names)], "s int, pos int, name string")
    tools = ["email_send", "shell_exec", "file_read", "file_write", "note", "Read_File", None]
    wanted = spark.createDataFrame([(s, k, t) for s in servers for k, t in enumerate(tools)], "s int, k int, tool string").withColumn("server_tool", F.lit("old"))
    got = {(r.s, r.k): r.server_tool for r in scan.mapped_tools(wanted, served, ("s",)).collect()}
    assert got == {(s, k): None if t is None else one(t, names) for s, names in servers.items() for k, t in enumerate(tools)}
    alone = scan.mapped_tools(spark.createDataFrame([("a", t) for t in tools], "id string, tool string"), served.where("s = 60").drop("s"))
    assert {r.tool: r.server_tool for r in alone.collect()} == {t: None if t is None else one(t, servers[60]) for t in tools}
