"""Redaction of JSON of any shape, with a finding for each match: where it is, and what it is.

A text's tokens are folded once, with a stack of the steps to where they are. Strings that change are written anew in their place; all the rest
of the text stays as it is, numbers and white space too, so that JSON stays JSON. No limit of depth.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalogue import PII, PII_KINDS

_PART = re.compile(r'[ \t\r\n]*+(?:("[^"\\\x00-\x1f]*+(?:\\.[^"\\\x00-\x1f]*+)*+")|([{}\[\],:])|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?+|true|false|null)')
_FINDING = pa.struct([(n, pa.string()) for n in ("severity", "pattern", "field", "description", "matched_pattern")])
SANITISED = "struct<text:string,findings:array<struct<severity:string,pattern:string,field:string,description:string,matched_pattern:string>>>"


def _clean(x: str) -> str:
    """``x`` without halves of characters, which no UTF-8 text holds."""
    return x.encode("utf-8", "replace").decode()


def folded(text: str, leaf, start: list[str], under: str | None = None) -> str | None:
    """``text`` (JSON) with ``leaf(steps, string)`` in the place of each string leaf, where that isn't None. With ``under``, only leaves in an
    object that is the member ``under`` of the outermost object. None if ``text`` is no JSON.

    ``start`` are the steps to the outermost value. Of equal keys, all are folded.
    """
    steps, around, out, done, at = list(start), [], [], 0, 0
    may = "v"  # v: a value, k: a key, c: a colon, else marks of structure
    inside = under is None
    while m := _PART.match(text, at):
        at = m.end()
        string, mark = m.group(1), m.group(2)
        if mark and mark in "{[":
            if "v" not in may:
                return None
            if under is not None and len(around) == 1 and mark == "{" and around[0] == "{" and steps[-1] == f".{under}":
                inside = True
            around.append(mark)
            steps.append("" if mark == "{" else "[0]")
            may = "k}" if mark == "{" else "v]"
            continue
        if mark and mark in "}]":
            if mark not in may:
                return None
            around.pop()
            steps.pop()
            if under is not None and len(around) == 1:
                inside = False
        elif mark == ",":
            if "," not in may:
                return None
            if around[-1] == "[":
                steps[-1] = f"[{int(steps[-1][1:-1]) + 1}]"
            may = "k" if around[-1] == "{" else "v"
            continue
        elif mark == ":":
            if may != "c":
                return None
            may = "v"
            continue
        elif string and "k" in may:
            try:
                steps[-1] = "." + json.loads(string)
            except ValueError:
                return None
            may = "c"
            continue
        else:
            if "v" not in may:
                return None
            if string:
                try:
                    value = json.loads(string) if "\\" in string else string[1:-1]
                except ValueError:
                    return None
                if inside and (new := leaf(steps, value)) is not None:
                    out += (text[done : m.start(1)], json.dumps(new))
                    done = m.end(1)
        may = ("," + ("}" if around[-1] == "{" else "]")) if around else ""
    return "".join([*out, text[done:]]) if may == "" and not text[at:].strip(" \t\r\n") else None


class Sanitiser:
    """``kinds``: (label, pattern) in the order of redaction, each over what the last one left."""

    def __init__(self, kinds=PII):
        self.kinds = [(re.compile(p, re.IGNORECASE), f"[REDACTED-{label}]", PII_KINDS.get(label, label.lower()), p) for label, p in kinds]

    def __call__(self, text: str, tool: str, root: str, under: str | None = None) -> tuple[str, list[dict]]:
        found = []

        def leaf(steps, value):
            new = value
            for pattern, label, kind, said in self.kinds:
                new, n = pattern.subn(label, new)
                if n:
                    path = _clean("".join(steps)).removeprefix("." if under else "")
                    found.extend([{"severity": "medium", "pattern": kind, "field": path, "description": f"PII detected in {tool}: {kind}", "matched_pattern": said}] * n)
            return new if found and new != value else None

        done = folded(text, leaf, [] if under else [root], under)
        if done is None:  # no JSON: a text of its own
            found.clear()
            if under:
                return text, found
            new = leaf([root], text)
            return text if new is None else new, found
        if not under and not done.lstrip().startswith("{"):
            done = f'{{"result":{done}}}'
        return done, found


def sanitiser(kinds, root: str, under: str | None = None):
    """The Arrow UDF of texts and tools."""
    kinds = tuple(kinds)

    @F.arrow_udf(SANITISED)
    def run(texts: pa.Array, tools: pa.Array) -> pa.Array:
        each = Sanitiser(kinds)
        rows = [(None, []) if x is None else each(x, t or "", root, under) for x, t in zip(texts.to_pylist(), tools.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(_FINDING))], ["text", "findings"])

    return run


def sanitised(json: Column, tool: Column | None = None, root: str = "result", kinds=PII) -> Column:
    """struct(text, findings) of a JSON text: every string leaf redacted, and a finding for each match with its path from ``root``.

    A root that is no object comes back as the member ``result`` of one. What is no JSON is redacted as a text. Null stays null, without findings.
    """
    return sanitiser(kinds, root)(json, F.lit("text") if tool is None else tool)


def sanitised_answer(line: Column, tool: Column, kinds=PII) -> Column:
    """struct(text, findings) of an answer as a message: the leaves of its ``result`` redacted if that is an object; all else stays as it is."""
    return sanitiser(kinds, "result", "result")(line, tool)
