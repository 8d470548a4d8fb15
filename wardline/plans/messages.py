"""What a proxy does with raw messages, in both modes: from lines to decisions, and from answers to what the client is told.

``requests`` needs no shuffle and no Python: envelope, route, typed arguments, findings in all their leaves, policy. Answers then meet their
requests (one join over HTTP; by session and id in order over pipes) and are redacted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free
from ..functions.sanitise import sanitised_answer
from ..functions.text import findings
from ..operators import correlate, proxy
from ..operators.policy import compiled, rule_rows
from .pipeline import FINDINGS, suspicious

#: What is said of calls that are refused.
BAD_NAME, BAD_ARGUMENTS = "Invalid params: 'name' must be a string.", "Invalid params: 'arguments' must be an object."
INJECTED, BY_POLICY = "Blocked: critical prompt injection pattern detected", "Blocked by policy"
EVALUATED = '{"_proxy":{"safe_scan":true,"would_forward":true}}'


def typed_arguments(text: Column) -> Column:
    """The members of a JSON object as text, as policies see them: strings as they are, True and False, numbers, nested values as JSON; null for null."""
    said, kinds = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    return F.map_zip_with(said, kinds, lambda _, x, v: F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(x)).otherwise(x))


def requests(lines: DataFrame, mode: str = "http", rules: list[tuple] | None = None) -> DataFrame:
    """``lines`` (line: a message; bypassed and safe: booleans, if there are such columns) with what becomes of each.

    method, id (JSON, so that 1 and "1" differ; null: none), tool, arguments (JSON), findings, rule_name; decision: INVALID (no message),
    NO_METHOD, FORWARD (nothing to inspect), BYPASS, BAD_NAME, BAD_ARGUMENTS, INJECT, or the policy's action; handled: drop, answer, or
    forward; answer: what the client is told at once; counted: whether it is one of the calls that counters tell of.

    Over HTTP, a message needs an id, unknown methods are refused, and a call may be evaluated only (safe). Over pipes (``stdio``), a
    message of another version or method is passed on, and so is, whatever is found, a call without an id, since nobody could be answered.
    Columns with these names are replaced.
    """
    n_m, n_call, n_id, n_bypassed, n_safe, n_route, n_args, n_d = names = free(lines, "_m", "_call", "_id", "_bypassed", "_safe", "_route", "_args", "_d")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) if c in lines.columns else F.lit(False) for c in ("bypassed", "safe")}
    m = F.try_parse_json("line")
    id_ = F.try_variant_get(n_m, "$.id", "variant")
    told = id_.isNotNull() & ~F.coalesce(F.is_variant_null(id_), F.lit(False))
    x = lines.withColumn(n_m, m).withColumns({
        n_call: proxy.tool_call(F.try_variant_get(n_m, "$.params", "variant")), n_id: id_, n_bypassed: flags["bypassed"], n_safe: flags["safe"],
        "id": F.when(told, F.to_json(id_)),
        "method": F.when(proxy.kind(F.try_variant_get(n_m, "$.method", "variant")) == "STRING", F.try_variant_get(n_m, "$.method", "string")),
    })
    if mode == "http":
        code = proxy.envelope_code(F.col(n_m))
        route = F.when(code.isNotNull(), "INVALID").otherwise(F.coalesce(*[F.when(proxy.route(F.col("method")) == a, b) for a, b in (("error", "NO_METHOD"), ("forward", "FORWARD"))]))
        route = F.coalesce(route, F.when(F.col(n_bypassed) & ~F.col(n_safe), "BYPASS"))
    else:
        ours = F.coalesce((F.try_variant_get(n_m, "$.jsonrpc", "string") == "2.0") & (F.col("method") == "tools/call"), F.lit(False))
        route = F.when(~F.coalesce(proxy.kind(F.col(n_m)) == "OBJECT", F.lit(False)), "INVALID").when(~ours, "FORWARD")
    x = x.withColumn(n_route, route).withColumn("tool", F.when(F.col(n_route).isNull(), F.col(n_call)["name"]))
    given = F.col(n_route).isNull() & F.col("tool").isNotNull() & F.col(n_call)["arguments"].isNotNull()
    x = x.withColumn("arguments", F.when(given, F.get_json_object("line", "$.params.arguments"))).withColumn(n_args, typed_arguments(F.col("arguments")))
    found = F.flatten(F.transform(suspicious(F.col("arguments"), "arguments"), lambda v: findings(v["value"], v["path"], F.col("tool"))))
    x = x.withColumn("findings", F.coalesce(found, F.array().cast(FINDINGS))).withColumn(n_d, compiled(rule_rows() if rules is None else rules, args=n_args, whole="arguments"))
    decision = (
        F.when(F.col(n_route).isNotNull(), F.col(n_route)).when(F.col("tool").isNull(), "BAD_NAME").when(F.col("arguments").isNull(), "BAD_ARGUMENTS")
        .when(F.exists("findings", lambda f: f["severity"] == "critical"), "INJECT").otherwise(F.col(n_d)["action"])
    )
    x = x.withColumn("decision", decision)
    refused = F.col("decision").isin("NO_METHOD", "BAD_NAME", "BAD_ARGUMENTS", "INJECT", "BLOCK") & F.col("id").isNotNull()
    evaluated = F.col(n_safe) & F.col("decision").isin("ALLOW", "REQUIRE_APPROVAL", "REDACT_OUTPUT") if mode == "http" else F.lit(False)
    said = (
        F.when(F.col("decision") == "NO_METHOD", F.concat(F.lit("Method not found: "), "method")).when(F.col("decision") == "BAD_NAME", BAD_NAME)
        .when(F.col("decision") == "BAD_ARGUMENTS", BAD_ARGUMENTS).when(F.col("decision") == "INJECT", INJECTED).otherwise(F.coalesce(F.nullif(F.col(n_d)["message"], F.lit("")), F.lit(BY_POLICY)))
    )
    code = F.when(F.col("decision") == "NO_METHOD", proxy.NO_METHOD).when(F.col("decision").isin("BAD_NAME", "BAD_ARGUMENTS"), proxy.BAD_PARAMS).otherwise(proxy.BLOCKED)
    safe = F.concat(F.lit('{"jsonrpc":"2.0","id":'), "id", F.lit(f',"result":{EVALUATED}}}'))
    return x.withColumns({
        "handled": F.when(F.col("decision") == "INVALID", "drop").when(refused | evaluated, "answer").otherwise("forward"),
        "answer": F.when(refused, proxy.error_response(F.col(n_id), code, said, mode)).when(evaluated, safe),
        "rule_name": F.when(F.col("decision").isin("ALLOW", "BLOCK", "REQUIRE_APPROVAL", "REDACT_OUTPUT"), F.col(n_d)["rule_name"]),
        "counted": F.col(n_route).isNull(),
    }).drop(*names)


def _told(x: DataFrame, inspected: Column) -> DataFrame:
    """``x`` (response: a message, tool) with answer and redactions: redacted where ``inspected``."""
    (s,) = free(x, "_s")
    x = x.withColumn(s, sanitised_answer(F.when(inspected, F.col("response")), F.col("tool")))
    return x.withColumns({"redactions": F.coalesce(F.col(s)["findings"], F.array().cast(FINDINGS)), "answer": F.coalesce(F.col("answer"), F.col(s)["text"], F.col("response"))}).drop(s)


def answered(handled: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Over HTTP: ``handled`` (of ``requests``) with the answer of each that was forwarded, redacted if it was an inspected call, and its redactions.

    ``responses``: ``key`` and response (a message), at most one for each key; what else is there is left out.
    """
    inspected = F.col("decision").isin("ALLOW", "REQUIRE_APPROVAL", "REDACT_OUTPUT")
    (k,) = free(handled, "_key")
    met = handled.drop("response").join(responses.select(F.col(key).alias(k), "response"), (F.col(key) == F.col(k)) & (F.col("handled") == "forward"), "left").drop(k)
    return _told(met, inspected).drop("response")


def relayed(handled: DataFrame, responses: DataFrame) -> DataFrame:
    """Over pipes: session_id, seq, id, tool, answer and redactions for each of ``responses`` (session_id, seq, response: a message of the server).

    ``handled`` (of ``requests``, with session_id and seq): a call that was forwarded waits for the first answer of its id (JSON: 1 is not "1") in its
    session; a later call of the same id takes its place. That answer is redacted, unless it is an error. Requests of the server, answers to
    nothing, and lines that are no messages pass as they are, without a tool.
    """
    waits = (F.col("handled") == "forward") & F.col("counted") & F.col("tool").isNotNull() & F.col("arguments").isNotNull() & F.col("id").isNotNull()
    v = responses.select("session_id", F.col("seq").cast("long").alias("seq"), "response", F.try_parse_json("response").alias("_m"))
    id_ = F.try_variant_get("_m", "$.id", "variant")
    asks = F.coalesce(proxy.kind(F.try_variant_get("_m", "$.method", "variant")) == "STRING", F.lit(False))
    v = v.withColumn("id", F.when(~asks & id_.isNotNull() & ~F.is_variant_null(id_), F.to_json(id_)))
    error = F.try_variant_get("_m", "$.error", "variant")
    v = v.withColumn("error", F.when(error.isNotNull() & ~F.is_variant_null(error), "error"))
    # generated, not filtered by an id that would be parsed anew for each place of the filter where responses are read
    those = lambda has: v.select(F.inline(F.when(has, F.array(F.struct("session_id", "id", "seq", F.col("response").alias("text"), "error")))))
    met = correlate.met(handled, those(F.col("id").isNotNull()), waits).withColumnRenamed("text", "response").withColumn("answer", F.lit(None).cast("string"))
    told = _told(met, F.col("tool").isNotNull() & F.col("error").isNull()).select("session_id", "seq", "id", "tool", "answer", "redactions")
    nothing = F.lit(None).cast("string").alias("tool"), F.col("text").alias("answer"), F.array().cast(FINDINGS).alias("redactions")
    return told.unionByName(those(F.col("id").isNull()).select("session_id", "seq", "id", *nothing))


def counters(told: DataFrame, *by: str) -> DataFrame:
    """Counters of traffic as a proxy keeps them: calls (those with wrong parameters too, bypassed ones not), blocked, flagged and approved, redacted answers."""
    is_ = lambda *d: F.count_if(F.col("counted") & F.col("decision").isin(*d))
    return told.groupBy(*by).agg(
        F.count_if("counted").alias("total_requests"), is_("BLOCK", "INJECT").alias("blocked"), is_("REQUIRE_APPROVAL").alias("flagged"), is_("REQUIRE_APPROVAL").alias("approved"),
        F.count_if(F.size("redactions") > 0).alias("redacted"),
    )
