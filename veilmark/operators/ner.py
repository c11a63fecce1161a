"""A token classifier for names and places, on Spark ML: the offline stand-in for an entity model.

Tokens are runs of one character class, with offsets; features are the token, its ends, its form and its
neighbours, hashed; labels come from overlap with gold.  Any provider that yields the same spans can replace it.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import shape
from ..sources.tables import stored
from .evaluate import f1_columns, overlap_recall

TOKEN = r"[0-9]+|[A-Za-z]+|[가-힣]+|[^0-9A-Za-z가-힣\s]"
FEATURES = ["w", "first", "last", "form", "size", "prev", "next", "prev2", "next2"]
LABELS = ("O", "B-PERSON", "I-PERSON", "B-ADDRESS", "I-ADDRESS")


def tokens(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, i, start_char, end_char and features of each token, and these columns of its document."""
    from ..functions.spans import occurrences

    rows = docs.select("doc_id", *more, occurrences(F.col("text"), TOKEN).alias("t"))
    at = lambda i: F.coalesce(F.get(F.col("t"), i)["value"], F.lit("^"))

    def feature(x: Column, i: Column) -> Column:
        w = x["value"]
        return F.struct(
            i.alias("i"), x["start"].alias("start_char"), (x["start"] + F.length(w)).alias("end_char"), w.alias("w"), F.substring(w, 1, 1).alias("first"), F.right(w, F.lit(1)).alias("last"),
            F.when(w.rlike("^[가-힣]"), "K").otherwise(shape(w)).alias("form"), F.length(w).cast("string").alias("size"),
            at(i - 1).alias("prev"), at(i + 1).alias("next"), at(i - 2).alias("prev2"), at(i + 2).alias("next2"),
        )

    return rows.select("doc_id", *more, F.explode(F.transform("t", feature)).alias("f")).select("doc_id", *more, "f.*")


def labelled(docs: DataFrame) -> DataFrame:
    """Tokens with labels: the first token of a gold name or place begins it, the others are inside.

    Gold comes along in the document's own row: nothing is joined, so nothing is shuffled or sent to the driver.
    """
    t = tokens(docs.select("doc_id", "text", F.filter("gold", lambda g: g["entity_type"].isin("PERSON", "ADDRESS")).alias("gold")), "gold")
    hit = F.try_element_at(F.filter("gold", lambda g: (g["start_char"] < F.col("end_char")) & (g["end_char"] > F.col("start_char"))), F.lit(1))
    label = F.when(hit.isNull(), "O").otherwise(F.concat(F.when(F.col("start_char") <= hit["start_char"], "B-").otherwise("I-"), hit["entity_type"]))
    return t.withColumn("label", label).drop("gold")


def fit(docs: DataFrame, buckets: int = 4096, rounds: int = 30) -> PipelineModel:
    """Multinomial logistic regression over hashed features; ``docs`` has doc_id, text and gold.

    Tokens with labels are stored: each stage passes over them, and the regression twice before it keeps its own copy.
    """
    stages = [
        FeatureHasher(inputCols=FEATURES, outputCol="features", numFeatures=buckets, categoricalCols=FEATURES),
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="y", maxIter=rounds, regParam=1e-4, family="multinomial"),
    ]
    return Pipeline(stages=stages).fit(stored(labelled(docs).select(*FEATURES, "label"), "tokens"))


def tag(model: PipelineModel, docs: DataFrame, floor: float = 0.0) -> DataFrame:
    """doc_id, start_char, end_char, entity_type, score: entity spans, a span's score being its tokens' least."""
    names = model.stages[1].labels
    scored = model.stages[2].transform(model.stages[0].transform(tokens(docs)))
    best = F.array_max(F.zip_with(vector_to_array("probability"), F.array(*(F.lit(n) for n in names)), lambda p, n: F.struct(p.alias("p"), n.alias("n"))))
    marked = scored.select("doc_id", "i", "start_char", "end_char", best.alias("b")).filter("b.n <> 'O'")
    per = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "start_char", "end_char", F.col("b.n").alias("n"), F.col("b.p").alias("p")))).alias("t"))

    def join(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        kind = F.substring(x["n"], 3, 20)
        one = F.struct(x["i"].alias("i"), x["start_char"].alias("start_char"), x["end_char"].alias("end_char"), kind.alias("entity_type"), x["p"].alias("score"))
        grown = F.struct(x["i"].alias("i"), last["start_char"].alias("start_char"), x["end_char"].alias("end_char"), kind.alias("entity_type"), F.least(last["score"], x["p"]).alias("score"))
        goes_on = x["n"].startswith("I-") & (last["entity_type"] == kind) & (last["i"] == x["i"] - 1)
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(one)))

    spans = F.aggregate("t", F.array().cast("array<struct<i:int,start_char:int,end_char:int,entity_type:string,score:double>>"), join)
    return per.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.start_char", "s.end_char", "s.entity_type", "s.score").filter(F.col("score") >= floor)


def entity_scores(found: DataFrame, docs: DataFrame) -> DataFrame:
    """entity_type, tp, fp, fn, precision, recall, f1, support, by exact place and type."""
    gold = docs.select("doc_id", F.explode("gold").alias("g")).select("doc_id", "g.start_char", "g.end_char", "g.entity_type").filter("entity_type in ('PERSON', 'ADDRESS')").distinct().withColumn("g", F.lit(1))
    both = found.select("doc_id", "start_char", "end_char", "entity_type").distinct().withColumn("p", F.lit(1)).join(gold, ["doc_id", "start_char", "end_char", "entity_type"], "full")
    n = both.groupBy("entity_type").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return n.select("entity_type", "tp", "fp", "fn", *f1_columns(), (F.col("tp") + F.col("fn")).alias("support"))


def saved(model: PipelineModel, path: str) -> PipelineModel:
    """The model, written and read again: what is compared is what would be used."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def train_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new training documents with gold of names and places alone."""
    kept = lambda df: df.select("doc_id", "text", F.filter("gold", lambda g: g["entity_type"].isin("PERSON", "ADDRESS")).alias("gold"))
    return kept(old).unionByName(kept(new))


def person_recall(model: PipelineModel, docs: DataFrame) -> float:
    """The share of gold names that a name found touches; 0 without gold."""
    gold = docs.select("doc_id", F.explode("gold").alias("g")).select("doc_id", "g.*").filter("entity_type = 'PERSON'")
    n = overlap_recall(tag(model, docs).filter("entity_type = 'PERSON'"), gold).first()
    return n.n_hit / n.n_gold if n.n_gold else 0.0
