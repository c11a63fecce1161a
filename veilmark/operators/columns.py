"""The column track: samples, profiles, rules by value and by name, and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import NAME_RULES, NAME_WORDS, VALUE_RULES


def long_form(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """table_name, column_name, val: all non-null values of the atomic columns, from one scan of the table."""
    atomic = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    chosen = [c for c in columns or atomic if c in atomic]
    wide = df.select(*(F.col(c).cast("string").alias(c) for c in chosen))
    return wide.unpivot([], chosen, "column_name", "val").filter("val is not null").select(F.lit(table).alias("table_name"), "column_name", "val")


def sample_values(values: DataFrame, n: int = 20) -> DataFrame:
    """At most ``n`` distinct values of each column, by the order of their MD5: the same ones on every run."""
    distinct = values.groupBy("table_name", "column_name", "val").agg(F.lit(1).alias("_")).drop("_")
    order = Window.partitionBy("table_name", "column_name").orderBy(F.md5("val"), "val")
    return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("table_name", "column_name", "val")


def profile(samples: DataFrame, n: int = 10) -> DataFrame:
    """How many samples a column has, and the first of them in one string, as a prompt shows them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.md5("val").alias("h"), "val"))), lambda x: x["val"])
    return samples.groupBy("table_name", "column_name").agg(F.count("*").alias("n_samples"), F.array_join(F.slice(ordered, 1, n), " | ").alias("samples_str"))


def value_category(value: Column) -> Column:
    """The category that a value's format speaks for; the first rule that holds decides."""
    out = F.lit("NON_PII")
    for regex, category in reversed(VALUE_RULES):
        out = F.when(value.rlike(regex), category).otherwise(out)
    return out


def name_category(column: Column) -> Column:
    out = F.lit("NON_PII")
    for regex, category in reversed(NAME_RULES):
        out = F.when(F.lower(column).rlike(regex), category).otherwise(out)
    return out


def rule_results(samples: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per column: share of samples that a rule hits, category, confidence and verdict; one aggregation per column.

    A single hit sets the category, whatever the verdict.  Ties between categories go to the first by name.
    """
    each = samples.groupBy("table_name", "column_name", value_category(F.col("val")).alias("cat")).agg(F.count("*").alias("c"))
    best = F.min_by("cat", F.struct((F.col("cat") == "NON_PII").alias("none"), (-F.col("c")).alias("n"), F.col("cat").alias("name")))
    per = each.groupBy("table_name", "column_name").agg(F.sum("c").alias("tot"), F.sum(F.when(F.col("cat") != "NON_PII", F.col("c")).otherwise(0)).alias("hits"), best.alias("value_cat"))
    share = F.round(F.col("hits") / F.col("tot"), 3)
    conf = F.greatest(F.when(F.col("value_cat") != "NON_PII", share).otherwise(0.0), F.when(F.lower("column_name").rlike(NAME_WORDS), 0.6).otherwise(0.0))
    return per.select(
        "table_name", "column_name", share.alias("pii_frac"),
        F.when(F.col("value_cat") != "NON_PII", F.col("value_cat")).otherwise(name_category(F.col("column_name"))).alias("rule_category"),
        conf.alias("rule_conf"), (conf >= threshold).alias("rule_is_pii"),
    )


def hybrid(rules: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdicts from rules and a model's answers (llm_is_pii, llm_category, llm_conf), weighed 4 to 6."""
    rule = F.when(F.col("rule_is_pii"), F.col("rule_conf")).otherwise(0.0)
    model = F.when(F.col("llm_is_pii"), F.col("llm_conf")).otherwise(1 - F.col("llm_conf"))
    score = F.round(0.4 * rule + 0.6 * model, 3)
    category = F.when(score < 0.5, "NON_PII").when(F.col("llm_is_pii"), F.col("llm_category")).otherwise(F.col("rule_category"))
    return rules.join(answers, ["table_name", "column_name"]).select("table_name", "column_name", (score >= 0.5).alias("pred_is_pii"), category.alias("pred_category"), score.alias("hybrid_score"))


def model_only(answers: DataFrame) -> DataFrame:
    category = F.when(F.col("llm_is_pii"), F.col("llm_category")).otherwise("NON_PII")
    return answers.select("table_name", "column_name", F.col("llm_is_pii").alias("pred_is_pii"), category.alias("pred_category"))


def with_entities(rules: DataFrame, entities: DataFrame) -> DataFrame:
    """Verdicts from rules and entity spans: a column is personal if a rule says so or it owns a span (table_name, column_name)."""
    owns = entities.select("table_name", "column_name").distinct().withColumn("owns", F.lit(True))
    found = F.coalesce("owns", F.lit(False))
    category = F.when(F.col("rule_is_pii"), F.col("rule_category")).when(found, "PERSONAL_INFO").otherwise("NON_PII")
    return rules.join(owns, ["table_name", "column_name"], "left").select("table_name", "column_name", (F.col("rule_is_pii") | found).alias("pred_is_pii"), category.alias("pred_category"))


def column_scores(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and category accuracy by stage and backend; null where a denominator is 0."""
    rows = predictions.join(truth, ["table_name", "column_name"])
    hit, said, true = F.col("pred_is_pii") & F.col("is_pii"), F.col("pred_is_pii"), F.col("is_pii")
    n = rows.groupBy("stage", "backend").agg(
        F.count_if(hit).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"),
        F.count_if(hit & (F.col("category") != "FREE_TEXT_PII") & (F.col("pred_category") == F.col("category"))).alias("same"),
        F.count_if(true & (F.col("category") != "FREE_TEXT_PII")).alias("typed"),
    )
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("stage", "backend", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("same"), F.col("typed")).alias("category_acc"))


def column_prompt(table: Column, column: Column, samples: Column) -> Column:
    """A prompt that asks for a column's verdict as JSON."""
    head = "Decide whether this database column holds personal data. Answer with one JSON object: {\"is_pii\": bool, \"category\": string, \"confidence\": number, \"reason\": string}.\n"
    return F.concat(F.lit(head), F.lit("table: "), table, F.lit("\ncolumn: "), column, F.lit("\nsamples: "), samples)
