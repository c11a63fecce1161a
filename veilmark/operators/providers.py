"""Language models behind one small interface, with offline implementations.

A provider answers a batch of prompts.  ``complete`` runs it once per row inside Spark, with retries, and gives a
status instead of failing; callers check the share of failures before they publish anything.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_csv
from .governance import fail_closed


class LlmProvider(Protocol):
    """Must be picklable; ``answer`` is called on executors."""

    def answer(self, prompts: list[str]) -> list[str | None]: ...


class RuleProvider:
    """Answers by a function of the prompt: for tests and dry runs."""

    def __init__(self, rule: Callable[[str], str | None]):
        self.rule = rule

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [self.rule(p) for p in prompts]


class HttpProvider:
    """A chat endpoint: POSTs {"messages": [...]}, reads choices or predictions."""

    def __init__(self, url: str, headers: dict[str, str] | None = None, timeout: float = 60.0):
        self.url, self.headers, self.timeout = url, headers or {}, timeout

    def answer(self, prompts: list[str]) -> list[str | None]:
        from urllib.request import Request, urlopen

        out = []
        for p in prompts:
            body = json.dumps({"messages": [{"role": "user", "content": p}], "temperature": 0.0}).encode()
            with urlopen(Request(self.url, body, {"Content-Type": "application/json", **self.headers}), timeout=self.timeout) as r:
                out.append(chat_text(json.load(r)))
        return out


def chat_text(reply) -> str | None:
    """The text of a reply: of its first choice, else of its first prediction."""
    if isinstance(reply, dict) and reply.get("choices"):
        content = reply["choices"][0].get("message", {}).get("content")
        if content is not None:
            return content
    found = reply.get("predictions", reply) if isinstance(reply, dict) else reply
    first = found[0] if isinstance(found, list) and found else found
    first = first.get("response", first) if isinstance(first, dict) else first
    return first if first is None or isinstance(first, str) else json.dumps(first)


def complete(df: DataFrame, prompt: str, provider: LlmProvider, out: str = "llm_raw", batch: int = 64, retries: int = 2, wait: float = 2.0) -> DataFrame:
    """``df`` with the provider's answers and ``<out>_ok``.  Filter before calling: nothing is pushed through."""

    def ask(prompts: list[str]) -> list[str | None]:
        for attempt in range(retries + 1):
            try:
                return provider.answer(prompts)
            except Exception:  # any failure of the service counts as no answer
                if attempt == retries:
                    return [None] * len(prompts)
                time.sleep(wait * (attempt + 1))
        return [None] * len(prompts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[str | None] = []
            for at in range(0, len(frame), batch):
                found += ask(frame[prompt].iloc[at : at + batch].tolist())
            yield frame.assign(**{out: found, f"{out}_ok": [x is not None for x in found]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{out}` string, `{out}_ok` boolean")


def complete_or_fail(df: DataFrame, prompt: str, provider: LlmProvider, limit: float = 0.05, out: str = "llm_raw", readable: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """``df`` with a provider's answers, those that failed asked once more; raises if over ``limit`` of them still fail.

    ``readable`` says whether an answer counts; without it any answer does.  Answers are gathered once (``df`` is
    persisted until they are), so that nobody is asked again when the result is used.
    """
    first = complete(df, prompt, provider, out, **options)
    good = F.col(f"{out}_ok") & (F.coalesce(readable(F.col(out)), F.lit(False)) if readable else F.lit(True))
    first = first.withColumn(f"{out}_ok", good).persist()
    again = complete(first.filter(~F.col(f"{out}_ok")).select(*df.columns), prompt, provider, out, **options).withColumn(f"{out}_ok", good)
    both = first.filter(f"{out}_ok").unionByName(again).persist()
    return fail_closed(both, ~F.col(f"{out}_ok"), limit, "answers that failed twice")


def health(provider: LlmProvider) -> str:
    """PASS if the provider answers at all, else what went wrong."""
    try:
        return "PASS" if provider.answer(["ping"])[0] is not None else "WARN: no answer"
    except Exception as e:  # the report is the point, whatever is wrong
        return f"WARN: {type(e).__name__}"


def recorded(spark: SparkSession, path: str, backend: str | None = None) -> DataFrame:
    """Recorded answers from a CSV file with a header (backend, keys, llm_raw); JSON in them has doubled quotes."""
    rows = read_csv(spark, path)
    return rows if backend is None else rows.filter(F.col("backend") == backend)


def replay(df: DataFrame, recorded: DataFrame, keys: list[str], out: str = "llm_raw") -> DataFrame:
    """``df`` with recorded answers instead of a model's."""
    return df.join(recorded.select(*keys, out), keys, "left").withColumn(f"{out}_ok", F.col(out).isNotNull())


#: What span and audit prompts ask for: the types and how answers are to look.
SPAN_TYPES = "PERSON, PHONE, RRN, CARD, ACCOUNT, EMAIL, ADDRESS, IMEI, PASSPORT"
SPAN_HEAD = f'List all personal data in the text below as a JSON array of {{"value": string, "type": string}}, values copied exactly, types out of {SPAN_TYPES}. Answer [] if there is none, and with nothing but the array.\n\n'
AUDIT_HEAD = f'You audit for personal data: miss nothing, doubtful strings included (landlines, numbers without hyphens, new passport formats). Answer with nothing but a JSON array of {{"value": string, "type": string}}, values copied exactly, types out of {SPAN_TYPES}; [] if there is none.\n\n'


def span_prompt(text: Column, audit: bool = False) -> Column:
    """The prompt that asks for the spans of a text; ``audit``: one that would rather report too much."""
    return F.concat(F.lit(AUDIT_HEAD if audit else SPAN_HEAD), text)
