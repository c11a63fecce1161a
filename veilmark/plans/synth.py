"""A deterministic synthetic corpus with gold spans: values and templates by integer arithmetic over a key.

Nothing is random and nothing is collected: any number of keys gives a lazy DataFrame, the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import once

#: Invented people and places for the synthetic corpus.
PEOPLE = ["김하늘", "이바다", "박노을", "최이슬", "정가람", "강다온", "조새봄", "윤해솔", "장미르", "임보라"]
PLACES = ["서울시 강남구 하늘로", "부산시 해운대구 바다길", "대구시 수성구 노을로", "인천시 연수구 이슬길", "광주시 서구 가람로"]

#: Templates: literal strings and, as tuples, slots.
TEMPLATES: list[list[str | tuple[str]]] = [
    ["신청자 ", ("PERSON",), " / 휴대 ", ("PHONE",), " / 등록번호 ", ("RRN",), " 접수"],
    ["📦 배송지 ", ("ADDRESS",), " 받는 분 ", ("PERSON",), ", 메일 ", ("EMAIL",)],
    ["결제 카드 ", ("CARD",), " 환급 계좌 ", ("ACCOUNT",), " 예금주 ", ("PERSON",)],
    ["단말 ", ("IMEI",), " 여권 ", ("PASSPORT",), " 재확인 바랍니다"],
    ["특이사항 없음, 다음 주 다시 연락"],
    [("PHONE",), " ", ("PHONE",), " 두 번호 모두 ", ("PERSON",), " 명의"],
    ["담당 ", ("PERSON",), ": ", ("EMAIL",), " / ", ("CARD",)],
]
#: Formats that the built-in patterns don't know, for drift.
DRIFT = [
    ["본인 확인 ", ("RRN",), " 고객 ", ("PERSON",)],
    ["여권 사본 ", ("PASSPORT",), " 보관"],
    ["대표 번호 ", ("PHONE",), " 회신"],
    ["이체 계좌 ", ("ACCOUNT",), " 등록"],
]


def padded(number: str, width: int) -> str:
    """SQL for a whole number as a string of fixed width; the same text in Spark and in other engines."""
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


def card_sql(groups: list[tuple[str, int]]) -> str:
    """SQL for a card number of 16 digits: groups of 15 digits (numbers and their widths) and the Luhn check digit."""
    digits = [f"(CAST(floor({number} / {10 ** (width - 1 - i)}) AS BIGINT) % 10)" for number, width in groups for i in range(width)]
    total = " + ".join(f"(2 * {d} - 9 * CAST({d} > 4 AS BIGINT))" if i % 2 == 0 else d for i, d in enumerate(digits))
    parts = ", '-', ".join(padded(number, width) for number, width in groups)
    return f"concat({parts}, CAST((10 - ({total}) % 10) % 10 AS STRING))"


def value_sql(k: str = "k") -> dict[str, str]:
    """SQL for a value of each type, from a key."""
    p = padded
    people = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PEOPLE))
    places = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(PLACES))
    return {
        "PERSON": f"CASE ({k} * 3) % 10 {people} END",
        "ADDRESS": f"concat(CASE {k} % 5 {places} END, ' ', CAST({k} % 90 + 1 AS STRING))",
        "PHONE": f"concat('010-', {p(f'({k} * 7919) % 9000 + 1000', 4)}, '-', {p(f'({k} * 104729) % 10000', 4)})",
        "RRN": f"concat({p(f'({k} * 31) % 100', 2)}, {p(f'({k} * 7) % 12 + 1', 2)}, {p(f'({k} * 13) % 28 + 1', 2)}, '-', CAST({k} % 4 + 1 AS STRING), {p(f'({k} * 611953) % 1000000', 6)})",
        "EMAIL": f"concat('user', CAST({k} AS STRING), '@mail', CAST({k} % 7 AS STRING), '.example.com')",
        "CARD": card_sql([(f"(({k} * 17) % 9000 + 1000)", 4), (f"(({k} * 37) % 10000)", 4), (f"(({k} * 53) % 10000)", 4), (f"(({k} * 71) % 1000)", 3)]),
        "ACCOUNT": f"concat({p(f'({k} * 11) % 900 + 100', 3)}, '-', {p(f'({k} * 19) % 90 + 10', 2)}, '-', {p(f'({k} * 7717) % 1000000', 6)})",
        "IMEI": f"concat('35', {p(f'({k} * 9973) % 1000000', 6)}, {p(f'({k} * 6131) % 10000000', 7)})",
        "PASSPORT": f"concat('M', {p(f'({k} * 48611) % 100000000', 8)})",
    }


def drift_sql(k: str = "k") -> dict[str, str]:
    """SQL for values in formats that came later: foreign or unhyphenated numbers, a new passport, landlines, other accounts."""
    p = padded
    date = f"{p(f'({k} * 31) % 100', 2)}, {p(f'({k} * 7) % 12 + 1', 2)}, {p(f'({k} * 13) % 28 + 1', 2)}"
    return value_sql(k) | {
        "RRN": f"CASE WHEN {k} % 8 < 4 THEN concat({date}, '-', CAST({k} % 4 + 5 AS STRING), {p(f'({k} * 611953) % 1000000', 6)}) ELSE concat({date}, CAST({k} % 4 + 1 AS STRING), {p(f'({k} * 611953) % 1000000', 6)}) END",
        "PASSPORT": f"concat('M', {p(f'({k} * 17) % 1000', 3)}, 'A', {p(f'({k} * 71) % 10000', 4)})",
        "PHONE": f"concat('02-', {p(f'({k} * 7) % 900 + 100', 3)}, '-', {p(f'({k} * 71) % 10000', 4)})",
        "ACCOUNT": f"concat({p(f'({k} * 101) % 900000 + 100000', 6)}, '-', {p(f'({k} * 19) % 90 + 10', 2)}, '-', {p(f'({k} * 7717) % 1000000', 6)})",
    }


def filled(keys: DataFrame, prefix: str, templates: list, values: dict[str, str]) -> DataFrame:
    """doc_id, k, text, gold (spans in order) for each key in column ``k``: template ``k`` modulo their number."""
    part = "struct<etype:string,part:string>"

    def parts(template: list) -> Column:
        return F.array(*(F.struct(F.lit(None if isinstance(x, str) else x[0]).cast("string").alias("etype"), (F.lit(x) if isinstance(x, str) else F.expr(values[x[0]])).alias("part")) for x in template)).cast(f"array<{part}>")

    chosen = parts(templates[-1])
    for i, t in reversed(list(enumerate(templates[:-1]))):
        chosen = F.when(F.col("k") % len(templates) == i, parts(t)).otherwise(chosen)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_char:int,end_char:int,entity_type:string,pii_value:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["part"])
        gold = F.struct(acc["at"].alias("start_char"), end.alias("end_char"), x["etype"].alias("entity_type"), x["part"].alias("pii_value"))
        return F.struct(end.alias("at"), F.when(x["etype"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(gold))).alias("out"))

    rows = once(keys.select("k", chosen.alias("parts")))
    return once(rows.select(
        F.concat(F.lit(prefix), F.col("k").cast("string")).alias("doc_id"), "k",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"),
        F.aggregate("parts", zero, add)["out"].alias("gold"),
    ))


def corpus(keys: DataFrame) -> DataFrame:
    return filled(keys, "notes.body.", TEMPLATES, value_sql())


def drift(keys: DataFrame) -> DataFrame:
    return filled(keys, "drift.body.", DRIFT, drift_sql())


#: Invented people with names of other forms, for a corpus that a model of the main one hasn't seen.
NEW_PEOPLE = ["남궁하늘이", "제갈 바다", "황보노을빛", "선우 이슬비", "독고가람결", "사공 다온해"]
NEW_TEMPLATES: list[list[str | tuple[str]]] = [
    ["문의하신 분은 ", ("PERSON",), " 이며 연락처 ", ("PHONE",)],
    ["수신 ", ("PERSON",), " / 주소 ", ("ADDRESS",)],
    ["확인자 [", ("PERSON",), "] 서명 완료"],
]


def new_names(keys: DataFrame) -> DataFrame:
    people = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(NEW_PEOPLE))
    return filled(keys, "newname.body.", NEW_TEMPLATES, value_sql() | {"PERSON": f"CASE (k * 5) % {len(NEW_PEOPLE)} {people} END"})


def gold_spans(docs: DataFrame) -> DataFrame:
    """A row per gold span, with the layer that is to find it."""
    s = docs.select("doc_id", F.explode("gold").alias("g")).select("doc_id", "g.*")
    return s.withColumn("source_layer", F.when(F.col("entity_type").isin("PERSON", "ADDRESS"), "NER").otherwise("PATTERN"))


def sql(name: str, source: str, prefix: str, templates: list, values: dict[str, str]) -> str:
    """The same corpus as common table expressions in SQL: ``<name>_parts`` and ``<name>`` (doc_id, k, text), ``<name>_gold``."""
    rows = []
    for t, template in enumerate(templates):
        for i, x in enumerate(template):
            part = f"'{x}'" if isinstance(x, str) else values[x[0]]
            etype = "NULL" if isinstance(x, str) else f"'{x[0]}'"
            rows.append(f"SELECT k, {i} AS i, {etype} AS etype, {part} AS part FROM {source} WHERE k % {len(templates)} = {t}")
    union = "\nUNION ALL ".join(rows)
    return f"""{name}_parts AS ({union}),
{name} AS (SELECT '{prefix}' || CAST(k AS VARCHAR) AS doc_id, k, string_agg(part, '' ORDER BY i) AS text FROM {name}_parts GROUP BY k),
{name}_gold AS (SELECT '{prefix}' || CAST(k AS VARCHAR) AS doc_id, k, (e - length(part))::INT AS start_char, e::INT AS end_char, etype AS entity_type, part AS pii_value,
  CASE WHEN etype IN ('PERSON', 'ADDRESS') THEN 'NER' ELSE 'PATTERN' END AS source_layer
  FROM (SELECT *, sum(length(part)) OVER (PARTITION BY k ORDER BY i) AS e FROM {name}_parts) WHERE etype IS NOT NULL)"""
