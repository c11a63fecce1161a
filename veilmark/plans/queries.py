"""The engine's registered queries.

Each runs over whole tables.  Text operators run over ``documents`` and ``pages`` and over a synthetic corpus with a
document per customer, whose gold spans follow from the key; language-model answers are simulated from gold with
malformed, fenced, invented and missing parts, so that parsers and recovery are really exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, masks
from ..functions import spans as S
from ..functions.patterns import CATEGORIES, TYPE_MAP
from ..operators import cascade, columns, evaluate, governance, monitor, ner, providers, verify
from ..sources.tables import TABLES, read, shared_folder, stored
from . import synth

#: Columns that the column track samples, by table (text and whole numbers: their strings are the same everywhere).
SAMPLED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "events": ["event_id", "user_id", "event_type", "props"],
    "documents": ["doc_id", "lang", "source"],
    "pages": ["page_id", "url"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role"],
    "people": ["name_ko", "phone", "rrn", "email", "card_number", "bank_account", "imei", "address", "birth_date", "salary", "memo"],
}
PERSONAL = {
    "name_ko": ("PERSON", "PERSONAL_INFO"), "phone": ("PHONE", "PERSONAL_INFO"), "rrn": ("RRN", "IDENTIFICATION"), "email": ("EMAIL", "PERSONAL_INFO"),
    "card_number": ("CARD", "PAYMENT_INFO"), "bank_account": ("ACCOUNT", "PAYMENT_INFO"), "imei": ("IMEI", "IDENTIFICATION"), "address": ("ADDRESS", "PERSONAL_INFO"),
}
BIRTH = f"concat('19', {synth.padded('(k * 31) % 100', 2)}, '-', {synth.padded('(k * 7) % 12 + 1', 2)}, '-', {synth.padded('(k * 13) % 28 + 1', 2)})"
MEMO = "CASE WHEN k % 3 = 0 THEN 'called back' ELSE concat('note ', CAST(k % 5 AS STRING)) END"


#: Keys of a task: a file of keys is small enough to be read by one task, but what is made of each key costs far more.
KEYS_PER_TASK = 5_000


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k`` of each customer, dealt out evenly to as many tasks as their number (which the file's footer tells) calls for.

    ``once`` keeps filters on what is made of keys (an inferred one on spans, say) from being moved before the dealing.
    """
    found = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return S.once(found.repartition(-(-found.count() // KEYS_PER_TASK) or 1))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of personal columns, a row per customer."""
    value = synth.value_sql()
    return keys(spark, sf_dir).select("k", *(F.expr(value[t]).alias(c) for c, (t, _) in PERSONAL.items()), F.expr(BIRTH).alias("birth_date"), (F.col("k") % 50 * 100 + 3000).alias("salary"), F.expr(MEMO).alias("memo"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.corpus(keys(spark, sf_dir))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.drift(keys(spark, sf_dir))


def exploded(df: DataFrame, *more: str) -> DataFrame:
    """A row per span of column ``spans``."""
    return df.select("doc_id", *more, F.explode("spans").alias("s")).select("doc_id", *more, "s.start_char", "s.end_char", "s.entity_type", "s.pii_value")


def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def s1_regex_spans_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(read(spark, sf_dir, "documents").select("doc_id", S.regex_spans(F.col("text")).alias("spans")))


def s1_regex_spans_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), S.regex_spans(F.col("html")).alias("spans")))


def s1_spans_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(docs(spark, sf_dir).select("doc_id", S.regex_spans(F.col("text")).alias("spans")))


NESTED = f"concat('😀 ', {synth.padded('(k * 99991) % 100000000', 8)}, {synth.padded('(k * 31337) % 100000000', 8)}, '@mail.example.com, ', {synth.padded('(k * 7777) % 100000000', 8)}, {synth.padded('(k * 3331) % 100000000', 8)}, ' 010', {synth.padded('(k * 523) % 100000000', 8)})"


def s1_overlap_email_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that begin with what would be a card number."""
    rows = keys(spark, sf_dir).select(F.col("k").alias("doc_id"), F.expr(NESTED).alias("text"))
    return exploded(rows.select("doc_id", S.regex_spans(F.col("text")).alias("spans")))


def s1_span_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s1_spans_synth(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"))


def s1_doc_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(S.regex_spans(F.col("text"))).cast("long").alias("n_spans"))


def corpus_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, key, text in (("documents", "doc_id", "text"), ("conversations", "concat(conv_id, '-', turn)", "text"), ("benchmark", "item_id", "text")):
        part = read(spark, sf_dir, table).select(F.concat(F.lit(f"{table}.{text}."), F.expr(key).cast("string")).alias("doc_id"), F.lit(table).alias("table_name"), F.lit(text).alias("column_name"), F.expr(key).cast("string").alias("row_key"), F.col(text).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out.filter("text is not null and text <> ''")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, chosen in SAMPLED.items():
        df = people(spark, sf_dir) if table == "people" else read(spark, sf_dir, table)
        part = columns.long_form(df, table, chosen)
        out = part if out is None else out.unionByName(part)
    return columns.sample_values(out)


def column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.profile(samples(spark, sf_dir))


def column_rule_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = columns.long_form(people(spark, sf_dir), "people", SAMPLED["people"])
    return values.groupBy("column_name", columns.value_category(F.col("val")).alias("category")).agg(F.count("*").alias("n"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.rule_results(samples(spark, sf_dir))


def column_rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(spark, sf_dir)


def truth(spark: SparkSession) -> DataFrame:
    rows = [(t, c, t == "people" and (c in PERSONAL or c in ("birth_date", "memo")), PERSONAL.get(c, ("", "FREE_TEXT_PII" if c == "memo" else "PERSONAL_INFO"))[1] if t == "people" and (c in PERSONAL or c in ("birth_date", "memo")) else "NON_PII") for t, cs in SAMPLED.items() for c in cs]
    return spark.createDataFrame(rows, "table_name string, column_name string, is_pii boolean, category string")


def digit(column: Column, at: int) -> Column:
    """A pseudo-random digit 0 to 15 from a name."""
    return F.conv(F.substring(F.md5(column), at, 1), 16, 10).cast("int")


def column_answers(spark: SparkSession) -> DataFrame:
    """Simulated answers of a language model about each column, as raw text, some of it wrong or unreadable."""
    name = F.concat_ws(".", "table_name", "column_name")
    d = digit(name, 1)
    says = F.when(d < 2, ~F.col("is_pii")).otherwise(F.col("is_pii"))
    body = F.concat(F.lit('{"is_pii": '), says.cast("string"), F.lit(', "category": "'), F.when(says, F.when(F.col("category") == "NON_PII", "personal_info").otherwise(F.lower("category"))).otherwise("non_pii"), F.lit('", "confidence": 0.'), (digit(name, 2) % 5 + 5).cast("string"), F.lit(', "reason": "name"}'))
    raw = F.when(digit(name, 3) == 0, F.lit("I cannot tell.")).when(digit(name, 3) < 4, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(body)
    return truth(spark).select("table_name", "column_name", raw.alias("llm_raw"))


def parsed_answers(spark: SparkSession) -> DataFrame:
    j = answers.verdict(F.col("llm_raw"))
    return column_answers(spark).select("table_name", "column_name", F.coalesce(j["is_pii"], F.lit(False)).alias("llm_is_pii"), F.coalesce(F.nullif(F.upper(j["category"]), F.lit("")), F.lit("NON_PII")).alias("llm_category"), F.coalesce(j["confidence"], F.lit(0.5)).alias("llm_conf"))


def column_answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_answers(spark)


def column_verdict_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.hybrid(rules(spark, sf_dir), parsed_answers(spark)).drop("hybrid_score")


def column_verdict_llm_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.model_only(parsed_answers(spark))


def column_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select(F.lit("people").alias("table_name"), F.when(F.col("entity_type") == "PERSON", "memo").otherwise("salary").alias("column_name"))


def column_verdict_ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.with_entities(rules(spark, sf_dir), column_owners(spark, sf_dir))


def column_predictions(spark: SparkSession, sf_dir: str, ruled: DataFrame | None = None) -> DataFrame:
    """Verdicts of all stages; ``ruled`` is what ``rules`` gives, if that is stored already."""
    named = lambda df, stage, backend: df.select(F.lit(stage).alias("stage"), F.lit(backend).alias("backend"), "table_name", "column_name", "pred_is_pii", "pred_category")
    r = rules(spark, sf_dir) if ruled is None else ruled
    s1 = r.select("table_name", "column_name", F.col("rule_is_pii").alias("pred_is_pii"), F.col("rule_category").alias("pred_category"))
    return named(s1, "S1", "NA").unionByName(named(columns.hybrid(r, parsed_answers(spark)), "S2", "sim")).unionByName(named(columns.with_entities(r, column_owners(spark, sf_dir)), "S3", "NA")).unionByName(named(column_verdict_llm_only(spark, sf_dir), "S5", "sim"))


def col_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_scores(column_predictions(spark, sf_dir), truth(spark))


def synth_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "text")


def synth_gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.gold_spans(docs(spark, sf_dir))


def synth_offset_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return offset_integrity(synth.gold_spans(d), d)


def offset_integrity(gold: DataFrame, d: DataFrame) -> DataFrame:
    return gold.agg(F.count("*").alias("n_spans")).crossJoin(evaluate.offset_mismatches(gold, d).agg(F.count("*").alias("n_wrong")))


def luhn_card_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr(f"concat('4', {synth.padded('(p_partkey * 48271) % 10000000', 7)}, {synth.padded('(p_partkey * 16807) % 100000000', 8)})")
    return read(spark, sf_dir, "part").select("p_partkey", number.alias("number")).select("p_partkey", "number", S.luhn(F.col("number")).alias("valid"))


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated span answers per document of the synthetic corpus."""
    item = lambda x: F.concat(F.lit('{"value": "'), x["pii_value"], F.lit('", "type": "'), F.lower(x["entity_type"]), F.lit('"}'))
    case = F.col("k") % 9
    kept = F.when(case == 4, F.slice("gold", F.lit(2), F.greatest(F.size("gold") - 1, F.lit(0)))).otherwise(F.col("gold"))
    items = F.transform(kept, item)
    items = F.when(case == 3, F.concat(items, F.array(F.lit('{"value": "nowhere at all", "type": "PERSON"}')))).otherwise(items)
    body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    raw = F.when(case == 0, F.concat(F.lit("Sorry: "), F.substring(body, 1, 7))).when(case == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(case == 2, F.concat(F.lit('Here: {"spans": '), body, F.lit("} done"))).otherwise(body)
    return S.once(docs(spark, sf_dir).select("doc_id", "k", "text", "gold", F.lit("sim").alias("backend"), raw.alias("llm_raw")))


def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = raw_answers(spark, sf_dir).select("doc_id", "k", "text", "gold", answers.span_items(F.col("llm_raw")).alias("parsed"))
    return S.once(parsed).select("doc_id", "k", "text", "gold", F.col("parsed.ok").alias("ok"), F.size("parsed.items").cast("long").alias("n_items"), S.recover_spans(F.col("text"), F.col("parsed.items")).alias("spans")).transform(S.once)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, text, gold and the spans of each stage (s1, s2, s3, s5): every document is read, matched and parsed once."""
    found = S.once(recovered(spark, sf_dir).select("doc_id", "k", "text", "gold", S.regex_spans(F.col("text")).alias("s1"), F.col("spans").alias("s5")))
    named = F.transform(F.filter("gold", lambda g: g["entity_type"].isin("PERSON", "ADDRESS")), lambda g: F.struct(g["start_char"], g["end_char"], g["entity_type"], entity_score(F.col("k"), g["start_char"]).alias("score")))
    sure = F.filter(named, lambda e: (e["score"] >= cascade.TAU) | F.coalesce(answers.keep(simulated_decision(e["start_char"])), F.lit(False)))
    return found.select("doc_id", "k", "text", "gold", "s1", S.merge_spans(F.col("s1"), F.col("s5")).alias("s2"), S.merge_spans(F.col("s1"), cascade.with_values(F.col("text"), sure)).alias("s3"), "s5").transform(S.once)


def cells(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """stage, backend, doc_id, p, g: a row per cell and document that it covers, with what was found and the gold.

    Here and below ``found`` is what ``detected`` gives, if that is stored already.
    """
    found = detected(spark, sf_dir) if found is None else found
    short = lambda c: F.transform(c, lambda x: F.struct(x["start_char"].alias("s"), x["end_char"].alias("e"), x["entity_type"].alias("t")))
    one = lambda stage, backend, c: F.struct(F.lit(stage).alias("stage"), F.lit(backend).alias("backend"), short(c).alias("p"))
    ran = F.array(one("S1", "NA", "s1"), one("S2", "sim", "s2"), one("S3", "sim", "s3"))
    every = F.when(F.col("k") % 9 != 0, F.concat(ran, F.array(one("S5", "sim", "s5")))).otherwise(ran)  # a model alone covers what it answered readably
    return found.select("doc_id", F.array_sort(short("gold")).alias("g"), F.explode(every).alias("c")).select("c.stage", "c.backend", "doc_id", F.array_sort("c.p").alias("p"), "g")


def llm_response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovered(spark, sf_dir).select("doc_id", "ok", "n_items")


def llm_parse_fail_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.parse_fail_rate(raw_answers(spark, sf_dir))


def llm_recover_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(recovered(spark, sf_dir))


def merge_regex_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(recovered(spark, sf_dir).select("doc_id", S.merge_spans(S.regex_spans(F.col("text")), F.col("spans")).alias("spans")))


def entity_score(k: Column, start: Column) -> Column:
    return (F.lit(0.5) + (k * 7 + start) % 50 / 100).cast("double")


def simulated_decision(start: Column) -> Column:
    """An answer about an unsure span: JSON, bare words or rubbish by place; most say to keep."""
    c = start % 4
    return F.when(c == 0, '{"keep": true}').when(c == 1, 'So: "keep" : TRUE.').when(c == 2, '{"keep": false}').otherwise("who knows")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated spans of two entity models: names and places of the gold, scored by key; the second is surer."""
    gold = docs(spark, sf_dir).select("doc_id", "k", F.explode("gold").alias("g")).select("doc_id", "k", "g.*").filter("entity_type in ('PERSON', 'ADDRESS')")
    base = entity_score(F.col("k"), F.col("start_char"))
    models = F.explode(F.array(F.struct(F.lit("base").alias("model"), base.alias("score")), F.struct(F.lit("ft").alias("model"), (base + 0.25).alias("score"))))
    return gold.select("*", models.alias("m")).select(F.col("m.model").alias("model"), "doc_id", "k", "start_char", "end_char", "entity_type", F.col("m.score").alias("score"))


def ner_route_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.route_rate(entities(spark, sf_dir))


def cascade_lowconf(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = cascade.keyed(entities(spark, sf_dir).filter("model = 'base'")).filter(F.col("score") < cascade.TAU)
    return low.select("k", "doc_id", "start_char", "end_char", "entity_type")


def cascade_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.prompts(entities(spark, sf_dir).filter("model = 'base'"), docs(spark, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade_lowconf(spark, sf_dir).select("k", answers.keep(simulated_decision(F.col("start_char"))).alias("keep"))


def even_length(prompt: str) -> str:
    """What a stand-in for a model says of a span: to keep it if its value has an even length."""
    return '{"keep": %s}' % ("true" if len(prompt.split('"')[1]) % 2 == 0 else "false")


def cascade_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confirm step as it runs with a model: prompts, a provider's answers, the limit on failures, decisions."""
    return cascade.confirm(entities(spark, sf_dir).filter("model = 'base'"), docs(spark, sf_dir), providers.RuleProvider(even_length))


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.finalize(docs(spark, sf_dir), entities(spark, sf_dir).filter("model = 'base'"), decisions(spark, sf_dir))


def cascade_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(finalized(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = detected(spark, sf_dir) if found is None else found
    named = lambda stage, backend, c: F.transform(c, lambda x: F.struct(F.lit(stage).alias("stage"), F.lit(backend).alias("backend"), x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), x["entity_type"].alias("entity_type")))
    every = F.concat(named("S1", "NA", "s1"), named("S2", "sim", "s2"), named("S3", "sim", "s3"), named("S5", "sim", "s5"))
    return found.select("doc_id", F.explode(every).alias("p")).select("p.stage", "p.backend", "doc_id", "p.start_char", "p.end_char", "p.entity_type")


def coverage(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """stage, backend, doc_id: what each cell covers, as ``cells`` has it."""
    return cells(spark, sf_dir, found).select("stage", "backend", "doc_id")


def span_scores(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    return evaluate.totals(evaluate.row_counts(cells(spark, sf_dir, found)))


def span_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_scores(spark, sf_dir)


def eval_shifted_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions up to three characters off, all of a document's alike, in all regimes."""
    gold = synth.gold_spans(docs(spark, sf_dir))
    moved = gold.select(F.lit("SX").alias("stage"), F.lit("NA").alias("backend"), "doc_id", (F.col("start_char") + F.length("doc_id") % 4).alias("start_char"), (F.col("end_char") + F.length("doc_id") % 4).alias("end_char"), "entity_type")
    cells = moved.limit(0).select("stage", "backend", "doc_id")
    return evaluate.evaluate_spans(moved, cells, gold).select("regime", "tp", "fp", "fn", "n_docs", "n_gt")


def arch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid, but for latencies: those are measured, by ``evaluate.measure_latency``, and are not the same twice."""
    predicted = column_predictions(spark, sf_dir, stored(rules(spark, sf_dir), "rules"))
    return gridded(spark, sf_dir, stored(span_scores(spark, sf_dir), "scores"), stored(columns.column_scores(predicted, truth(spark)), "scores"))


def gridded(spark: SparkSession, sf_dir: str, span_scores: DataFrame, column_scores: DataFrame) -> DataFrame:
    return evaluate.grid(span_scores, column_scores, cost_table(spark, sf_dir)).drop("latency_p50_ms", "latency_p95_ms", "est_cost_usd_per_1k")


def grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that should be in the grid and aren't."""
    expected = spark.createDataFrame([(s, b) for s in ("S1", "S2", "S3", "S4", "S5") for b in ("NA", "sim")], "stage string, backend string")
    found = predictions(spark, sf_dir).select("stage", "backend").distinct()
    return expected.join(found, ["stage", "backend"], "left_anti")


def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven masks over values that fit them and values that don't."""
    wide = people(spark, sf_dir)
    odd = F.when(F.col("k") % 11 == 0, F.lit(None).cast("string")).when(F.col("k") % 11 == 1, F.lit("")).when(F.col("k") % 11 == 2, F.lit("x"))
    pick = lambda c: F.when(F.col("k") % 11 < 3, odd).otherwise(F.col(c))
    of = {"mask_phone": "phone", "mask_rrn": "rrn", "mask_email": "email", "mask_name": "name_ko", "mask_card": "card_number", "mask_account": "bank_account", "mask_default": "address"}
    return wide.select("k", *(masks.apply_mask(m, pick(c)).alias(m) for m, c in of.items()))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.policies(column_predictions(spark, sf_dir).filter("stage = 'S1' and table_name = 'people'"))


def risk_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies(spark, sf_dir)


def masked_people_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.secured(people(spark, sf_dir), list(PERSONAL)).select("k", *PERSONAL)


def whole(gold: str) -> Column:
    """A column of gold spans with a score, as masks take them."""
    return F.transform(gold, lambda g: S.span(g["start_char"], g["end_char"], g["entity_type"], g["pii_value"], F.lit(1.0)))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "text", whole("gold").alias("spans"))


def span_mask_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.masked_corpus(masked(spark, sf_dir)).select("doc_id", "masked")


def span_mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", "text", S.regex_spans(F.col("text")).alias("spans"))
    return governance.masked_corpus(found).select("doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").cast("long").alias("n_chars"))


def span_mask_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.mask_audit(masked(spark, sf_dir))


def residual_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can still be read after masking pattern spans alone."""
    found = docs(spark, sf_dir).select("doc_id", "text", S.regex_spans(F.col("text")).alias("spans"))
    return governance.residual_leaks(governance.masked_corpus(found), synth.gold_spans(docs(spark, sf_dir)))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling operator: the 300 documents whose ids hash lowest."""
    return docs(spark, sf_dir).select("doc_id").orderBy(F.md5("doc_id"), "doc_id").limit(300)


def train_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.filled(keys(spark, sf_dir).select((F.col("k") * 3).alias("k")), "train.body.", synth.TEMPLATES, synth.value_sql())


def verbatim_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents whose text is also an evaluation document's."""
    evaluation = docs(spark, sf_dir).select("text").distinct()
    return train_corpus(spark, sf_dir).join(evaluation, "text", "left_semi").agg(F.count("*").alias("n_overlap"))


def train_eval_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluation = docs(spark, sf_dir).select("text").distinct()
    return train_corpus(spark, sf_dir).join(evaluation, "text", "left_anti").select("doc_id", "text")


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_docs and n_silent of the drift corpus and of the main one; the model's spans are the gold ones."""
    out = None
    for name, d in (("drift", drift(spark, sf_dir)), ("main", docs(spark, sf_dir))):
        rule = d.select("doc_id", S.regex_spans(F.col("text")).alias("spans")).filter("size(spans) > 0")
        part = monitor.silent_rate(d, rule, d.filter("size(gold) > 0")).select(F.lit(name).alias("corpus"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def silent_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir)


def health_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rates(spark, sf_dir).select("corpus", (F.col("n_silent") / F.col("n_docs")).alias("rate"))
    one = r.agg(F.max(F.when(F.col("corpus") == "drift", F.col("rate"))).alias("now"), F.max(F.when(F.col("corpus") == "main", F.col("rate"))).alias("base"))
    return one.select(F.lit("rule_silent").alias("metric"), monitor.breach(F.col("now"), F.col("base")).alias("breach"), monitor.breach(F.col("base"), F.col("base")).alias("breach_main"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The auditor's spans on the drift corpus: gold ones but for a few, and a word that it takes for an account."""
    d = drift(spark, sf_dir)
    wrong = d.filter("k % 12 = 3").select("doc_id", (F.length("text") - 2).alias("start_char"), F.length("text").alias("end_char"), F.lit("ACCOUNT").alias("entity_type"), F.expr("right(text, 2)").alias("pii_value"))
    return synth.gold_spans(d).filter("length(doc_id) % 2 = 0 or start_char % 5 <> 0").drop("source_layer").unionByName(wrong)


def audit_cosign(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = docs(spark, sf_dir)
    return monitor.cosigned(synth.gold_spans(main).drop("source_layer"), main)


def auditor_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.calibration(audit(spark, sf_dir), synth.gold_spans(drift(spark, sf_dir)), drift(spark, sf_dir))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = exploded(drift(spark, sf_dir).select("doc_id", S.regex_spans(F.col("text")).alias("spans")))
    return monitor.leaked(audit(spark, sf_dir), rule)


def leaked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, sf_dir).select("doc_id", "start_char", "end_char", "entity_type", "pii_value")


def shape_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.shape_clusters(leaks(spark, sf_dir))


def shadowed(spark: SparkSession, sf_dir: str) -> tuple[list, DataFrame]:
    members = stored(leaks(spark, sf_dir), "leaked")
    found = monitor.proposals(monitor.shape_clusters(members))
    main = docs(spark, sf_dir)
    out = monitor.shadow(found, members, drift(spark, sf_dir), main, synth.gold_spans(main))
    return found, stored(monitor.promoted(out, approve=True), "shadowed")


def shape_regex_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shadowed(spark, sf_dir)[1].select("entity_type", "regex", "recall_gain", "clean_fp", "shadow_pass", "promoted")


def repair_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the rules that passed their shadow run alone."""
    return monitor.repair_recall(drift(spark, sf_dir), synth.gold_spans(drift(spark, sf_dir)), monitor.passing(*shadowed(spark, sf_dir)))


def drift_honesty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.honesty(drift(spark, sf_dir), synth.gold_spans(drift(spark, sf_dir)))


def regex_vs_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.regex_against_gold(docs(spark, sf_dir), synth_gold_spans(spark, sf_dir))


def col_scores_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.column_scores_again(column_predictions(spark, sf_dir), truth(spark), col_eval(spark, sf_dir))


def span_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(detected(spark, sf_dir), "detected")
    return verify.span_identities(span_scores(spark, sf_dir, found), predictions(spark, sf_dir, found), coverage(spark, sf_dir, found))


def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten checks of a run, a row each; what several of them judge is made once and stored."""
    found = stored(detected(spark, sf_dir), "detected")
    main = found.select("doc_id", "k", "text", "gold")
    gold = synth.gold_spans(main)
    predicted = stored(column_predictions(spark, sf_dir, stored(rules(spark, sf_dir), "rules")), "predicted")
    scores, column_scores = stored(span_scores(spark, sf_dir, found), "scores"), stored(columns.column_scores(predicted, truth(spark)), "scores")
    columns_ = ["doc_id", "start_char", "end_char", "entity_type", "pii_value"]
    sums = evaluate.checksum(gold, columns_).crossJoin(evaluate.checksum(gold.repartition(7, "entity_type"), columns_).toDF("n2", "checksum2"))
    grid = stored(gridded(spark, sf_dir, scores, column_scores), "grid")
    wanted = spark.createDataFrame([("S1", "NA"), ("S2", "sim"), ("S3", "sim"), ("S4", "sim"), ("S5", "sim")], "stage string, backend string")
    bad = lambda df: df.agg(F.count("*").alias("n"))
    rows = verify.span_identities(scores, predictions(spark, sf_dir, found), coverage(spark, sf_dir, found))
    hidden = main.select("doc_id", "text", whole("gold").alias("spans"))
    c = F.col
    return verify.report([
        verify.check("C1a", offset_integrity(gold, main), (c("n_wrong") == 0) & (c("n_spans") > 0)),
        verify.check("C1b", verify.legal_categories(truth(spark)), c("n_wrong") == 0),
        verify.check("C2", sums, (c("checksum") == c("checksum2")) & (c("n_rows") > 0)),
        verify.check("C3", verify.column_scores_again(predicted, truth(spark), column_scores), (c("n_wrong") == 0) & (c("n_cells") > 0)),
        verify.check("C4", rows.agg(F.count("*").alias("n"), F.count_if(~(c("gold_ok") & c("said_ok") & c("scores_ok"))).alias("n_wrong")), (c("n_wrong") == 0) & (c("n") > 0)),
        verify.check("C5a", bad(wanted.join(grid, ["stage", "backend"], "left_anti")), c("n") == 0),
        verify.check("C5b", monitor.no_json(raw_answers(spark, sf_dir)), c("n_failed") == 0),
        verify.check("C6", bad(governance.residual_leaks(governance.masked_corpus(hidden), gold)), c("n") == 0),
        verify.check("C7", verify.monotone(grid, ("S1", "NA"), ("S2", "sim")), c("f1_first") < c("f1_second")),
        verify.check("C8", verify.regex_against_gold(main, gold), (c("n_spurious") == 0) & (c("n_matched") >= verify.LEAST_MATCH * c("n_gold"))),
    ])


def monitor_verification(spark: SparkSession, sf_dir: str, approve: bool = True) -> DataFrame:
    """The six checks of the monitor, a row each."""
    d = drift(spark, sf_dir)
    gold = synth.gold_spans(d)
    found, out = shadowed(spark, sf_dir)
    c = F.col
    one = rates(spark, sf_dir).agg(F.max(F.when(c("corpus") == "drift", c("n_silent") / c("n_docs"))).alias("now"), F.max(F.when(c("corpus") == "main", c("n_silent") / c("n_docs"))).alias("base"))
    return verify.report([
        verify.check("M1", evaluate.offset_mismatches(gold, d).agg(F.count("*").alias("n")), c("n") == 0),
        verify.check("M2", monitor.honesty(d, gold), (c("n_missed") == c("n_checked")) & (c("n_checked") > 0)),
        verify.check("M3", one, c("now") > c("base")),
        verify.check("M4", monitor.repair_recall(d, gold, monitor.passing(found, out)), c("n_after") > c("n_before")),
        verify.check("M5", predictions(spark, sf_dir).agg(F.count_if(c("stage").isin("S1_FIXED") | c("doc_id").startswith("drift.")).alias("n")), c("n") == 0),
        verify.check("M6", out.agg(F.count_if("promoted").alias("n"), F.count_if("shadow_pass").alias("ok")), (c("n") > 0) == (F.lit(approve) & (c("ok") > 0))),
    ])


def ner_champion(spark: SparkSession, sf_dir: str, approve: bool = True) -> DataFrame:
    """Champion against challenger: a decision and the checks on it, in one row.

    The champion knows the names of the main corpus; the challenger is fitted to those and to a half of documents with
    new names.  Both are saved and loaded again before they are compared on the other half, on main documents and on
    canaries; the samples are the ``300`` documents whose ids hash lowest.
    """
    part = lambda df, n: df.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == n)
    some = lambda df: stored(df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300), "sample")
    old, new, canary = docs(spark, sf_dir), synth.new_names(keys(spark, sf_dir)), train_corpus(spark, sf_dir)
    base = shared_folder(spark, "models")
    champion = ner.saved(ner.fit(part(old, 0)), f"{base}/champion")
    challenger = ner.saved(ner.fit(ner.train_union(part(old, 0), part(new, 0))), f"{base}/challenger")
    corpora = {"stress": some(part(new, 1)), "main": some(part(old, 1)), "canary": some(canary)}
    recall = {name: {k: ner.person_recall(model, c) for k, c in corpora.items()} for name, model in (("champion", champion), ("challenger", challenger))}
    row = evaluate.decision(recall["champion"], recall["challenger"], approve, f"{base}/champion", f"{base}/challenger")
    log = spark.createDataFrame([row], evaluate.DECISION)
    log.write.mode("append").parquet(f"{base}/log")
    last = spark.read.schema(evaluate.DECISION).parquet(f"{base}/log").agg(F.max_by("active_model", "ts").alias("active"), F.max_by("decision", "ts").alias("decision"))
    c = F.col
    checks = verify.report([
        verify.check("B1", log, c("chal_stress") >= c("champ_stress")),
        verify.check("B2", log, (c("decision") == "PROMOTE") == ((c("delta_stress") >= 0.01) & c("main_ok") & c("canary_ok"))),
        verify.check("B3", last, c("active").endswith("challenger") == ((c("decision") == "PROMOTE") & F.lit(approve))),
        verify.check("B4", predictions(spark, sf_dir).agg(F.count_if(c("doc_id").startswith("newname.") | c("doc_id").startswith("drift.")).alias("n")), c("n") == 0),
    ])
    return checks.crossJoin(log.select("decision", "champ_stress", "chal_stress", "main_ok", "canary_ok", "approved"))


def overlap_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predictions(spark, sf_dir).filter("stage = 'S3' and entity_type = 'PERSON'")
    return evaluate.overlap_recall(found, synth.gold_spans(docs(spark, sf_dir)).filter("entity_type = 'PERSON'"))


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over a range of recall differences."""
    d = read(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") - 5) / 500).alias("s"), ((F.col("n_nationkey") % 7 - 3) / 500).alias("m"), ((F.col("n_nationkey") % 5 - 3) / 250).alias("c"))
    return d.select("n_nationkey", evaluate.gate_column(F.col("s"), F.col("m"), F.col("c")).alias("decision"))


def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = ner_route_rate(spark, sf_dir).select(F.when(F.col("model") == "base", "S3").otherwise("S4").alias("stage"), (F.col("n_routed") / F.col("n_spans")).alias("llm_route_rate"))
    fixed = spark.createDataFrame([("S1", 0.0), ("S2", 1.0), ("S5", 1.0)], "stage string, llm_route_rate double")
    both = rate.unionByName(fixed).withColumn("backend", F.when(F.col("stage") == "S1", "NA").otherwise("sim"))
    empty = F.lit(None).cast("double")
    return both.select("stage", "backend", empty.alias("latency_p50_ms"), empty.alias("latency_p95_ms"), evaluate.stage_cost(F.col("stage"), F.col("llm_route_rate")).alias("est_cost_usd_per_1k"), "llm_route_rate")


def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-dollars for a thousand documents, by stage."""
    return cost_table(spark, sf_dir).select("stage", F.round(F.col("est_cost_usd_per_1k") * 1e6).cast("long").alias("micro_usd_per_1k"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by index: of the users of events, by type."""
    return evaluate.percentiles(read(spark, sf_dir, "events"), "event_type", "user_id")


def gt_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.checksum(synth_gold_spans(spark, sf_dir), ["doc_id", "start_char", "end_char", "entity_type", "pii_value"])


def ner_train_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the token classifier to one half of the keys' documents and score the other; they are made once and stored."""
    half = stored(docs(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(2))), "documents")
    model = ner.fit(half.filter("part = 0"))
    return ner.entity_scores(ner.tag(model, half.filter("part = 1")), half.filter("part = 1"))


def ground_truth_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the truth that aren't in the vocabulary."""
    return truth(spark).filter(~F.col("category").isin(*CATEGORIES)).groupBy("category").agg(F.count("*").alias("n"))


def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(TYPE_MAP, "entity_type string, category string, mask_token string, source_layer string")


def queries() -> dict:
    chosen = (
        table_row_counts, s1_regex_spans_documents, s1_regex_spans_pages, s1_spans_synth, s1_overlap_email_wins, s1_span_type_distribution, s1_doc_span_counts, corpus_long_form,
        column_samples, column_profile, column_rule_ladder, column_rule_verdict, column_answer_parse, column_verdict_hybrid, column_verdict_llm_only, column_verdict_ner, col_eval,
        synth_corpus, synth_gold_spans, synth_offset_integrity, luhn_card_check, llm_response_parse, llm_parse_fail_rate, llm_recover_spans, merge_regex_llm,
        ner_route_rate, cascade_lowconf, cascade_prompts, cascade_confirm, cascade_finalize, span_eval, eval_shifted_partial, arch_grid, grid_completeness,
        mask_values, risk_tags, masked_people_view, span_mask_synth, span_mask_documents, span_mask_audit, residual_leaks,
        hash_sample, verbatim_overlap, train_eval_antijoin, silent_rate, health_breach, audit_cosign, auditor_calibration, leaked_spans, shape_clusters, shape_regex_shadow, repair_recall,
        overlap_recall, promotion_gate, cost_model, latency_percentiles, gt_checksum, ner_train_eval, ground_truth_categories, type_map,
        drift_honesty, regex_vs_gold, col_scores_again, span_identities, verification_report, monitor_verification, ner_champion,
    )
    return {f.__name__: f for f in chosen}
