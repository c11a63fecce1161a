"""Reading the answers of language models: free text that should hold JSON.

Answers that are JSON are read by Catalyst; only the rest, wrapped in prose or fences, goes through Arrow to Python.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "struct<value:string,type:string>"
PARSED = f"struct<ok:boolean,items:array<{ITEM}>>"
VERDICT = "is_pii boolean, category string, confidence double, reason string"

_WRAPS = [re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S), re.compile(r"\{.*\}", re.S), re.compile(r"\[.*\]", re.S)]


def find_json(answer: str | None):
    """The first of the whole answer, its fence, its outermost object, its outermost array that is JSON; else None."""
    if answer is None:
        return None
    tries = [answer, *(m[1] if m.re.groups else m[0] for m in (w.search(answer) for w in _WRAPS) if m)]
    for text in tries:
        try:
            return json.loads(text)
        except ValueError:
            continue
    return None


def _items(answer: str | None, lone_object: bool) -> dict:
    found = find_json(answer)
    if isinstance(found, dict):
        found = found.get("spans", [found] if lone_object else None)
    if not isinstance(found, list):
        return {"ok": False, "items": []}
    text = lambda x: x if isinstance(x, str) else None if x is None else json.dumps(x)
    return {"ok": True, "items": [{"value": x["value"], "type": text(x.get("type"))} for x in found if isinstance(x, dict) and isinstance(x.get("value"), str)]}


def span_items(answer: Column, lone_object: bool = False) -> Column:
    """``struct<ok, items>``: the (value, type) pairs of a span answer: an array, or an object with ``spans``.

    ``lone_object`` takes an object without ``spans`` as the one item.
    """

    @F.pandas_udf(PARSED)
    def parse(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_items(a, lone_object) for a in answers], columns=["ok", "items"])

    return parse(answer)


def verdict(answer: Column) -> Column:
    """``struct<is_pii, category, confidence, reason>`` of a column answer: its outermost object; nulls if unreadable."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), VERDICT)


def keep(answer: Column) -> Column:
    """Whether an answer says to keep a span: a JSON boolean, else the bare words; null if neither."""
    flag = F.get_json_object(answer, "$.keep")
    quoted = answer.rlike(r'^\s*\{\s*"keep"\s*:\s*"')
    squeezed = F.lower(F.regexp_replace(answer, r"\s", ""))
    strict = F.when(~quoted & flag.isin("true", "false"), flag == "true")
    return F.coalesce(strict, F.when(squeezed.contains('"keep":true'), F.lit(True)).when(squeezed.contains('"keep":false'), F.lit(False)))


def unreadable(answer: Column) -> Column:
    """Whether an answer holds neither an array nor an object."""
    return answer.isNull() | ~answer.rlike(r"[\[{]")
