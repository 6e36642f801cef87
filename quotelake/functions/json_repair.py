"""Broken JSON of model answers: what can be kept of it, in time that grows with the text.

A text is parsed once; where that fails, the place of the fault is known. One scan up to it keeps, at each comma and bracket outside
of texts, the brackets that are open there, so that everything whole before the fault is kept and closed. Items of an item list behind the fault
are parsed one by one, each once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS = re.compile(r'"(?:line_items|items)"\s*:\s*\[')
PIECE = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\],]', re.S)
CLOSING = {"{": "}", "[": "]"}


def dumped(value: object) -> str:
    return json.dumps(value, sort_keys=True)


def loaded(text: str) -> tuple[object, int]:
    """(value, -1), or (None, the place of the first fault)."""
    try:
        return json.loads(text), -1
    except json.JSONDecodeError as e:
        return None, e.pos
    except RecursionError:  # brackets too deep
        return None, 0


def stripped(text: str | None) -> str:
    """From the first bracket on, without a fence."""
    t = (text or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", t, re.S | re.I)
    t = fence[1].strip() if fence else re.sub(r"^```(?:json)?\s*", "", t)
    start = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=-1)
    return t[start:] if start >= 0 else ""


def closed_before(text: str, fault: int) -> tuple[str, str]:
    """(the text closed at its end, the text closed behind the last whole value before `fault`)."""
    stack: list[str] = []
    at, open_then, in_text = 0, "", False
    for m in PIECE.finditer(text):
        p = m[0]
        if p[0] == '"':
            in_text = m.end() == len(text) and (len(p) == 1 or p[-1] != '"' or bool(re.search(r'(?<!\\)(\\\\)*\\"$', p)))
            continue
        if p in CLOSING:
            stack.append(CLOSING[p])
        elif p != ",":
            if not stack or stack[-1] != p:
                break
            stack.pop()
        if m.start() < fault and p != "{":  # an object that has just begun is nothing yet
            at, open_then = (m.start() if p == "," else m.end()), "".join(reversed(stack))
        if not stack:
            break
    return text + '"' * in_text + "".join(reversed(stack)), text[:at] + open_then


def whole_items(text: str) -> list[str]:
    """Objects that stand whole in the list of items, those that parse."""
    m = ITEMS.search(text)
    out, depth, start = [], 0, 0
    for p in PIECE.finditer(text, m.end()) if m else ():
        if p[0] == "{":
            start = p.start() if depth == 0 else start
            depth += 1
        elif p[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                value, fault = loaded(text[start : p.end()])
                if fault < 0:
                    out.append(dumped(value))
    return out


def items_of(value: object) -> list | None:
    for v in (value, *(value.get(k) for k in ("line_items", "items"))) if isinstance(value, dict) else (value,):
        if isinstance(v, list):
            return v
    return None


def recovered(text: str | None) -> tuple[str | None, list[str], str]:
    """(JSON, the items of its list that stand whole as JSON, how): whole, closed (at its end), cut (behind the last whole value), items (those that are whole, others lost) or lost."""
    t = stripped(text)
    if not t:
        return None, [], "lost"
    if '"' not in t:
        t = t.replace("'", '"')
    value, fault = loaded(t)
    how = "whole"
    if fault >= 0 and (end := max(t.rfind("}"), t.rfind("]")) + 1):  # words behind it, commas before brackets
        for plain in (t[:end], re.sub(r",\s*([}\]])", r"\1", t[:end])):
            value, at = loaded(plain)
            if at < 0:
                fault = -1
                break
    if fault >= 0:
        at_end, before = closed_before(t, fault)
        for how, x in (("closed", at_end), ("cut", before)):
            value, still = loaded(x)
            if still < 0:
                break
        else:
            value = None
        own = whole_items(t)
        if own and len(own) > len(items_of(value) or []):
            head = value if isinstance(value, dict) else {}
            return dumped({k: v for k, v in head.items() if k not in ("line_items", "items")} | {"line_items": [json.loads(x) for x in own]}), own, "items"
        if value is not None and ITEMS.search(t):
            return dumped(value), own, how  # the item at the fault may be kept in part, but isn't one of the items
    if value is None:
        return None, [], "lost"
    return dumped(value), [dumped(x) for x in items_of(value) or []], how


RECOVERED = T.StructType([T.StructField("json", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("how", T.StringType())])


@F.pandas_udf(RECOVERED)
def recovered_json(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in parts:
        yield pd.DataFrame([recovered(x) for x in s], columns=["json", "items", "how"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def recovered_items(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The items alone; never null."""
    for s in parts:
        yield pd.Series([recovered(x)[1] for x in s], dtype=object)
