"""Leaves of JSON values of any shape."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = re.compile(r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?+|[{}\[\],]|[^\s{}\[\],:"]++')


def _leaf(path: str, value) -> tuple[str, str, str]:
    kind = "STRING" if isinstance(value, str) else "VOID" if value is None else "BOOLEAN" if isinstance(value, bool) else "BIGINT" if isinstance(value, int) else "DOUBLE"
    return path, kind, "" if value is None else str(value)


def _parts(text: str):
    """The leaves of a JSON text that is nested deeper than Python's parser goes; none if its brackets don't match."""
    stack, path, out = [], ["$"], []
    for m in _PARTS.finditer(text):
        token = m.group()
        if token in "{[":
            stack.append(None if token == "{" else 0)
            path.append("" if token == "{" else "[0]")
        elif token in "}]":
            if not stack:
                return []
            stack.pop()
            path.pop()
        elif token == ",":
            if stack and stack[-1] is not None:
                stack[-1] += 1
                path[-1] = f"[{stack[-1]}]"
        elif token[-1] == ":":
            path[-1] = "." + json.loads(token[:-1])
        else:
            out.append(_leaf("".join(path), json.loads(token)))
    return [] if stack else out


def _valid(text: str) -> bool:
    try:
        json.loads(text)
    except RecursionError:
        return True
    except ValueError:
        return False
    return True


def _walk(text: str) -> list[tuple[str, str, str]]:
    """path, type and value as text of each leaf of a JSON text, in its order, at any depth; of equal keys the last one's."""
    try:
        below = [("$", json.loads(text))]
    except RecursionError:
        try:
            return _parts(text)
        except ValueError:
            return []
    except ValueError:
        return []
    out = []
    while below:
        path, value = below.pop()
        if isinstance(value, dict):
            below += [(f"{path}.{k}", x) for k, x in reversed(value.items())]
        elif isinstance(value, list):
            below += [(f"{path}[{k}]", value[k]) for k in range(len(value) - 1, -1, -1)]
        else:
            out.append(_leaf(path, value))
    return out


def leaf_texts(text: str) -> list[str]:
    """The leaves of a text that is a JSON object or array, as text; any other text is its own only leaf."""
    return [x for _, _, x in _walk(text)] if text.lstrip()[:1] in ("{", "[") and _valid(text) else [text]


def leaves(df: DataFrame, column: str) -> DataFrame:
    """``df`` without the text ``column``, with a row for each leaf of its JSON, at any depth: path, type (STRING, BIGINT, DOUBLE, BOOLEAN
    or VOID) and value as text (null: empty; booleans as True and False).

    Texts that are no JSON have no leaves. One walk over each text, without a shuffle. Columns named as results are replaced.
    """
    kept = df.drop(column, "path", "type", "value")
    n = len(kept.columns)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part, row, found = batch.slice(a, 1000), [], []
                for k, text in enumerate(part.column(n).to_pylist()):
                    if text is not None:
                        mine = _walk(text)
                        row += [k] * len(mine)
                        found += mine
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int32())) for c in part.columns[:n]), *(pa.array(c, pa.string()) for c in columns)], names=[*part.schema.names[:n], "path", "type", "value"])

    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.StringType()) for c in ("path", "type", "value")]])
    return df.select(*[df[c] for c in kept.columns], F.col(column).alias("_text")).mapInArrow(run, schema)


#: Of a JSON text: its strings, keys with their colon, marks of structure, numbers and words.
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\.[^"\\\x00-\x1f]*+)*+"'
_TOKENS = rf'{_STRING}(?:\s*+:)?+|[{{}}\[\],]|[^\s{{}}\[\],:"]++'
_SCALAR = r"^(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)$"
#: Tokens are walked in runs of runs: a fold copies its state at every step, so that only the runs' starts are listed, and leaves in short runs alone.
RUNS = (1024, 32)
#: Between the steps that lead to a place; in keys it is written as a replacement character.
_BETWEEN = "\x01"
#: What may come next, by first characters: a value (v: a leaf), what is behind a value in an array or an object, nothing.
_VALUES, _IN_ARRAY, _IN_OBJECT, _NOTHING = "v{[", ",]", ",}", "!"
_FOUND = "array<struct<path:string,value:string>>"


def _unquoted(token: Column) -> Column:
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.contains("\\"), F.coalesce(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0], plain)).otherwise(plain)


def as_text(token: Column) -> Column:
    """A leaf's token as text: a string without quotes and escapes, True and False, nothing for null, numbers as they are."""
    return F.when(token.startswith('"'), _unquoted(token)).when(token == "true", "True").when(token == "false", "False").when(token == "null", "").otherwise(token)


def _state(around, step, pos, may) -> Column:
    """around: the steps to what the token is in; step: the one behind them; pos: the place in an array, -1 in an object, -2 outside, -3 after a token that is out of place; may: what may come next."""
    may = F.lit(may) if isinstance(may, str) else may
    return F.struct(around.alias("around"), step.alias("step"), pos.cast("int").alias("pos"), may.alias("may"))


def _walked(s: Column, x: Column) -> Column:
    """The state behind a token ``x`` (mark: itself for marks of structure, v for a leaf, a dot and the key for a key)."""
    around, step, pos, first = s["around"], s["step"], s["pos"], F.substring(x["mark"], 1, 1)
    outside = F.substring_index(around, _BETWEEN, -1)
    rest = F.substring(around, F.lit(1), F.length(around) - F.length(outside) - 1)
    back = F.when(rest == "", F.struct(F.lit(-2).alias("pos"), F.lit(_NOTHING).alias("may"))).when(outside.startswith("["), F.struct(F.substring(outside, F.lit(2), F.length(outside) - 2).cast("int").alias("pos"), F.lit(_IN_ARRAY).alias("may")))
    inner = F.concat(around, F.lit(_BETWEEN), step)
    return (
        F.when(~s["may"].contains(first), _state(around, step, F.lit(-3), _NOTHING))
        .when(first == "v", _state(around, step, pos, F.when(pos >= 0, _IN_ARRAY).otherwise(_IN_OBJECT)))
        .when((first == ",") & (pos >= 0), _state(around, F.concat(F.lit("["), (pos + 1).cast("string"), F.lit("]")), pos + 1, _VALUES))
        .when(first == ",", _state(around, step, pos, "."))
        .when(first == ".", _state(around, x["mark"], pos, _VALUES))
        .when(first == "{", _state(inner, F.lit(""), F.lit(-1), ".}"))
        .when(first == "[", _state(inner, F.lit("[0]"), F.lit(0), _VALUES + "]"))
        .otherwise(bound(back.otherwise(F.struct(F.lit(-1).alias("pos"), F.lit(_IN_OBJECT).alias("may"))), lambda b: _state(rest, outside, b["pos"], b["may"])))
    )


def bound(x: Column, f) -> Column:
    """``f(x)``, where ``x`` is worked out once."""
    return F.transform(F.array(x), f)[0]


def _runs(tokens: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), ((F.size(tokens) - 1) / size).cast("int")), lambda k: F.slice(tokens, k * size + 1, F.lit(size)))


def _starts(runs: Column, start: Column) -> Column:
    """The state before each run, and behind the last one."""
    def onward(a, run):
        return F.struct(F.aggregate(run, a["s"], _walked).alias("s"), F.concat(a["starts"], F.array(a["s"])).alias("starts"))

    none = F.array().cast("array<struct<around:string,step:string,pos:int,may:string>>")
    return F.aggregate(runs, F.struct(start.alias("s"), none.alias("starts")), onward)


def leaves_where(json: Column, root: Column | str, wanted, scalars: bool = False) -> Column:
    """Those string leaves of a JSON object or array (with ``scalars`` the other leaves too) whose text is ``wanted`` (a function of a Column):
    array of path (from ``root``) and value, in order. Null where the text is no object or array.

    There is no limit of depth, and time is in proportion to the text and, for each leaf that is wanted, to its path. Of equal keys all are
    walked. Built-in functions only: no Python, no shuffle.
    """
    root = F.lit(root) if isinstance(root, str) else root
    none = F.array().cast(_FOUND)

    def read(token):
        string = token.endswith('"')
        leaf = string | token.rlike(_SCALAR)
        key = F.translate(_unquoted(F.regexp_replace(token, r"\s*:$", "")), _BETWEEN, "�")
        mark = F.when(string, "v").when(token.isin("{", "}", "[", "]", ","), token).when(token.endswith(":"), F.concat(F.lit("."), key)).when(leaf, "v").otherwise("?")
        return bound(F.when(leaf if scalars else string, as_text(token)), lambda said: F.struct(mark.alias("mark"), F.when(wanted(said), said).alias("said")))

    def any_in(run):
        return F.exists(run, lambda x: x["said"].isNotNull())

    def leaves(run, start):
        """Of a short run: its wanted leaves."""
        def step(a, x):
            path = F.concat(root, F.translate(a["s"]["around"], _BETWEEN, ""), a["s"]["step"])
            found = F.when(x["said"].isNotNull(), F.concat(a["out"], F.array(F.struct(path.alias("path"), x["said"].alias("value"))))).otherwise(a["out"])
            return F.struct(_walked(a["s"], x).alias("s"), found.alias("out"))

        return F.when(any_in(run), F.aggregate(run, F.struct(start.alias("s"), none.alias("out")), step, lambda a: a["out"])).otherwise(none)

    def split(run, start):
        short = lambda runs: F.flatten(F.zip_with(runs, _starts(runs, start)["starts"], leaves))
        return F.when(any_in(run), bound(_runs(run, RUNS[1]), short)).otherwise(none)

    def of(runs):
        done = lambda a: F.when((a["s"]["pos"] == -2) & (a["s"]["may"] == _NOTHING), F.flatten(F.zip_with(runs, a["starts"], split)))
        return bound(_starts(runs, _state(F.lit(""), F.lit(""), F.lit(-2), _VALUES)), done)

    opened = F.coalesce(json.rlike(r"^\s*[{\[]"), F.lit(False))
    text = F.when(opened, json)
    whole = F.regexp_replace(text, rf"(?:{_TOKENS}|\s)", "") == ""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), read)
    return F.when(opened & whole, bound(tokens, lambda x: bound(_runs(x, RUNS[0]), of)))


def string_leaves(json: Column, root: Column | str) -> Column:
    """The string leaves of a JSON object or array at any depth: array of path (from ``root``) and value. Other texts have none."""
    return F.coalesce(leaves_where(json, root, lambda _: F.lit(True)), F.array().cast(_FOUND))
