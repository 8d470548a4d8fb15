"""What a proxy does with each message, as Columns: validation, routing, extraction, answers, access, and the lines of its log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes: no JSON, no valid request, unknown method, wrong parameters, blocked, no answer.
NO_JSON, INVALID, NO_METHOD, BAD_PARAMS, BLOCKED, UNANSWERED = -32700, -32600, -32601, -32602, -32001, -32000
#: What a log calls each outcome, padded to one width.
WORDS = {"ALLOW": "[ALLOW]  ", "BLOCK": "[BLOCK]  ", "APPROVE": "[APPROVE]", "REDACT": "[REDACT] ", "INJECT": "[INJECT] "}
#: Words of a response that tell of personal data or secrets.
MARKERS = ("ssn", "credit card", "api_key", "secret", "passwd", "stripe_secret")


def kind(v: Column) -> Column:
    """The JSON type of a VARIANT: OBJECT, ARRAY, STRING, BIGINT, ..., VOID for null; null where nothing is."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def envelope_code(message: Column) -> Column:
    """The error code of a message (VARIANT; null: no JSON): a request needs jsonrpc 2.0, a method, and an id that is a text or a whole number."""
    id_kind = kind(F.try_variant_get(message, "$.id", "variant"))
    valid = (
        F.coalesce(F.try_variant_get(message, "$.jsonrpc", "string") == "2.0", F.lit(False))
        & F.coalesce(kind(F.try_variant_get(message, "$.method", "variant")) == "STRING", F.lit(False))
        & F.coalesce(id_kind.isin("STRING", "BIGINT", "TINYINT", "SMALLINT", "INT"), F.lit(False))
        & F.coalesce(kind(F.try_variant_get(message, "$.params", "variant")).isin("OBJECT", "VOID"), F.lit(True))
    )
    return F.when(message.isNull(), NO_JSON).when(~valid, INVALID).cast("int")


def route(method: Column, mode: str = "http") -> Column:
    """forward, inspect or error. Over HTTP, methods that are not known are errors; over pipes, all but tool calls are forwarded."""
    other = {"http": "error", "stdio": "forward"}[mode]
    return F.when(method == "tools/call", "inspect").when(method.isin("initialize", "tools/list"), "forward").otherwise(other)


def tool_call(params: Column) -> Column:
    """struct(name, arguments) of a call's parameters (VARIANT): no name unless it is a text, no arguments unless they are an object."""
    name, arguments = (F.try_variant_get(params, f"$.{x}", "variant") for x in ("name", "arguments"))
    named = F.coalesce(kind(name) == "STRING", F.lit(False))
    return F.struct(
        F.when(named, F.try_variant_get(params, "$.name", "string")).alias("name"),
        F.when(named & F.coalesce(kind(arguments) == "OBJECT", F.lit(False)), arguments).alias("arguments"),
    )


def error_response(id: Column, code: Column, message: Column, mode: str = "http") -> Column:
    """The answer to a request that is refused, as JSON. Over HTTP it says that it has no data; over pipes it says nothing of data."""
    data = ',"data":null' if mode == "http" else ""
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(F.get(F.regexp_extract_all(F.to_json(F.struct(id.alias("id"))), F.lit(r'^\{"id":(.*)\}$')), F.lit(0)), F.lit("null")), F.lit(',"error":'), F.regexp_replace(F.to_json(F.struct(code.alias("code"), message.alias("message"))), r"\}$", data + "}"), F.lit("}"))


def bypassed(action: Column, enabled: Column, safe: Column) -> Column:
    """The action where a policy can be switched off: calls then pass, uncounted, unless they are only evaluated."""
    return F.when(~enabled & ~safe, "ALLOW").otherwise(action)


def authorised(method: Column, header: Column, token: str | None) -> Column:
    """Whether a request may come in: all may without a token; what asks for options needs none."""
    if not token:
        return F.lit(True)
    return (method == "OPTIONS") | F.coalesce(header == f"Bearer {token}", F.lit(False))


def upstream_error(url: str | None, command: str | None) -> int | None:
    """A server is reached by a URL or by a command: 503 for both at once, or neither."""
    return 503 if bool(url) == bool(command) else None


def sensitive(tool: Column, args: Column, response: Column, paths: list[str]) -> Column:
    """Whether a call reads one of ``paths``, or its response names what should not get out."""
    text = F.lower(F.coalesce(response, F.lit("")))
    path = (tool == "file_read") & F.coalesce(args["path"].isin(paths), F.lit(False))
    marked = F.lit(False)
    for m in MARKERS:
        marked |= text.contains(m)
    return path | marked


def audit_line(word: Column, tool: Column, detail: Column) -> Column:
    """A console line: what was done, the tool in ten columns, the detail."""
    said = F.coalesce(*[F.when(word == k, v) for k, v in WORDS.items()])
    return F.format_string("%s %-10s %s", said, tool, detail)


def audit_detail(word: Column, arguments: Column, reason: Column, redactions: Column) -> Column:
    """An audit line's detail: the arguments (JSON), and the reason where there is one; or how much was redacted."""
    return (
        F.when(word == "REDACT", F.format_string("(%d PII items redacted)", redactions)).when(word == "INJECT", "prompt injection detected (critical)")
        .when(word == "ALLOW", arguments).otherwise(F.concat(arguments, F.lit("  <- "), reason))
    )


def relay_line(direction: Column, method: Column, decision: Column, details: Column) -> Column:
    """A line of the log of a relay over pipes."""
    return F.format_string("%s method=%s decision=%s %s", direction, F.coalesce(method, F.lit("-")), decision, details)


def session(method: Column, header: Column, new: Column) -> Column:
    """The session that an answer names: a new one for initialize, else the request's own, if any."""
    return F.when(method == "initialize", new).otherwise(header)
