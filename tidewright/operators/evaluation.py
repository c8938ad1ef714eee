"""Extraction quality from annotated sheets: sampling, precision, intervals, agreement, matching and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.search import folded
from tidewright.operators.skew import cut

Z = 1.96
#: Answers that mean yes, and the levels of agreement. Fixed values.
YES = ("y", "yes", "true", "1")
LEVELS = ((0.8, "excellent"), (0.6, "good"), (0.4, "moderate"))
SHEETS = ("distance", "method", "legal_reference")


def sheets(read: dict[str, DataFrame]) -> DataFrame:
    """All annotated sheets as one table with their category."""
    columns = ("id", "source_file", "exact_text", "confidence", "marine_relevance", "is_correct", "is_relevant", "error_type", "notes")
    return reduce(DataFrame.unionByName, [df.select(F.lit(c).alias("category"), *columns) for c, df in read.items()])


def yes(c: str) -> Column:
    """TRUE, FALSE, or NULL where nothing was annotated."""
    answer = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return answer.isin(*YES)


def wilson(p: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; (0, 0) for n = 0."""
    middle = p + z * z / (2 * n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    size = 1 + z * z / n
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / size)))
    return bound(middle - half), bound(middle + half)


def precision(annotated: DataFrame) -> DataFrame:
    """Per category: correct, incorrect and unannotated rows, precision with its interval (6 decimals)."""
    c = annotated.groupBy("category").agg(F.count_if(yes("is_correct")).alias("n_correct"), F.count_if(~yes("is_correct")).alias("n_incorrect"), F.count_if(yes("is_correct").isNull()).alias("n_unannotated"))
    n = F.col("n_correct") + F.col("n_incorrect")
    p = F.when(n == 0, 0.0).otherwise(F.col("n_correct") / n)
    low, high = wilson(p, n.cast("double"))
    return c.select("*", F.round(p, 6).alias("precision"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def macro_micro(annotated: DataFrame) -> DataFrame:
    """(measure, value): macro and micro precision and the micro interval."""
    c = precision(annotated).where("n_correct + n_incorrect > 0")
    row = c.agg(F.avg(F.col("n_correct") / (F.col("n_correct") + F.col("n_incorrect"))).alias("macro"), F.sum("n_correct").alias("k"), F.sum(F.col("n_correct") + F.col("n_incorrect")).alias("n"))
    p = F.col("k") / F.col("n")
    low, high = wilson(p, F.col("n").cast("double"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.round(x, 6).alias("value")) for name, x in (("macro_precision", F.col("macro")), ("micro_precision", p), ("micro_low", low), ("micro_high", high))])).alias("r")).select("r.*")


def kappa(annotated: DataFrame, a: str = "is_correct", b: str = "is_relevant") -> DataFrame:
    """Cohen's kappa of two annotations per category, with its level; NULL without common rows, 1 if chance agreement is 1."""
    both = annotated.select("category", yes(a).alias("a"), yes(b).alias("b")).where("a is not null and b is not null")
    c = both.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    k = F.when(pe == 1, 1.0).otherwise(F.round((F.col("po") - pe) / (1 - pe), 6))
    level = reduce(lambda rest, x: F.when(F.col("kappa") >= x[0], x[1]).otherwise(rest), reversed(LEVELS), F.lit("poor"))
    return c.select("category", "n", k.alias("kappa")).withColumn("level", level)


def errors(annotated: DataFrame) -> DataFrame:
    """Per error type of incorrect rows: count, share of all errors, first example; blank is "unspecified"."""
    kind = F.coalesce(F.nullif(F.trim("error_type"), F.lit("")), F.lit("unspecified"))
    wrong = annotated.where(~yes("is_correct"))
    c = wrong.groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("category", "id")).alias("f"))
    total = wrong.agg(F.count(F.lit(1)).alias("total"))
    return c.crossJoin(F.broadcast(total)).select("error_type", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.col("f.category").alias("first_category"), F.col("f.id").cast("bigint").alias("first_id"))


def confidence_by_outcome(annotated: DataFrame) -> DataFrame:
    """Average confidence and relevance of correct and incorrect rows per category."""
    return annotated.where(yes("is_correct").isNotNull()).groupBy("category", yes("is_correct").alias("correct")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence") + 1e-9, 3).alias("avg_confidence"), F.round(F.avg("marine_relevance") + 1e-9, 3).alias("avg_relevance"))


def sample(df: DataFrame, per_category: int, seed: int, least: int = 5) -> DataFrame:
    """Up to ``per_category`` rows of each category with at least ``least``, by the hash of seed and id: the same rows anywhere."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    few = df.groupBy("category").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select("category")
    kept = df.join(F.broadcast(few), "category").withColumn("__o", order)
    w = Window.partitionBy("category").orderBy("__o", "id")
    return kept.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= per_category).drop("__k", "__o")


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Rows with their rank (from 0) in the order of the columns, which must be unique together; ranks are counted per range partition."""
    parts = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__in", inside).join(F.broadcast(before.drop("__n")), "__p").withColumn("rank", F.col("__in") + F.col("__before")).drop("__p", "__in", "__before")


def middle_documents(extractions: DataFrame) -> DataFrame:
    """(document_id, n, rank): documents between the first and third quarter by number of extractions."""
    n = extractions.where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    r = ranked(n, "n", "document_id")
    total = r.agg(F.count(F.lit(1)).alias("__t"))
    q = lambda k: F.floor(F.lit(k) * F.col("__t") / 4)
    return r.crossJoin(F.broadcast(total)).where((F.col("rank") >= q(1)) & (F.col("rank") < q(3))).select("document_id", "n", "rank")


def exact_match(found: DataFrame, truth: DataFrame, key: str = "exact_text") -> DataFrame:
    """Per category: distinct keys of both, of the found only, of the truth only; precision, recall, F1."""
    keys = lambda df, side: df.select("category", F.trim(folded(key)).alias("__k"), F.lit(side).alias("__s")).where("__k <> ''")
    both = keys(found, 1).unionByName(keys(truth, 2)).groupBy("category", "__k").agg(F.sum_distinct("__s").alias("__m"))
    c = both.groupBy("category").agg(F.count_if(F.col("__m") == 3).alias("tp"), F.count_if(F.col("__m") == 1).alias("fp"), F.count_if(F.col("__m") == 2).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def recall_by_category(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(category, n_human, n_matched, recall, low, high): summed over documents, with the Wilson interval of recall."""
    keys = ["source_file", "category"]
    human = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("human"))
    both = truth.join(found.select(*keys, "__k").distinct(), [*keys, "__k"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"))
    c = human.join(both, keys, "left").groupBy("category").agg(F.sum("human").alias("n_human"), F.coalesce(F.sum("matched"), F.lit(0)).alias("n_matched"))
    r = F.when(F.col("n_human") == 0, 0.0).otherwise(F.col("n_matched") / F.col("n_human"))
    low, high = wilson(r, F.col("n_human").cast("double"))
    return c.select("*", F.round(r, 6).alias("recall"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def overall(matched: DataFrame) -> DataFrame:
    """(measure, value): macro and micro precision, recall and F1 of the counts of :func:`exact_match`."""
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    of = lambda tp, fp, fn: (ratio(tp, tp + fp), ratio(tp, tp + fn))
    f1 = lambda p, r: ratio(2 * p * r, p + r)
    p, r = of(F.col("tp"), F.col("fp"), F.col("fn"))
    row = matched.agg(F.avg(p).alias("mp"), F.avg(r).alias("mr"), F.avg(f1(p, r)).alias("mf"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r = of(F.col("tp"), F.col("fp"), F.col("fn"))
    values = (("macro_precision", F.col("mp")), ("macro_recall", F.col("mr")), ("macro_f1", F.col("mf")), ("micro_precision", p), ("micro_recall", r), ("micro_f1", f1(p, r)))
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.round(F.coalesce(v, F.lit(0.0)), 6).alias("value")) for n, v in values])).alias("r")).select("r.*")


def error_examples(annotated: DataFrame, k: int = 3) -> DataFrame:
    """(category, error_type, position, id, text): the first k wrong rows of each error type by id."""
    kind = F.coalesce(F.nullif(F.lower(F.trim("error_type")), F.lit("")), F.lit("unspecified"))
    wrong = annotated.where(~yes("is_correct")).select("category", kind.alias("error_type"), F.col("id").cast("bigint").alias("id"), F.substring("exact_text", 1, 100).alias("text"))
    w = Window.partitionBy("category", "error_type").orderBy("id")
    return wrong.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def worst_category(annotated: DataFrame) -> DataFrame:
    """The category of the lowest precision, and of the most errors; ties by name."""
    c = precision(annotated).where("n_correct + n_incorrect > 0")
    return c.agg(F.min_by("category", F.struct("precision", "category")).alias("least_precise"), F.min_by("category", F.struct(-F.col("n_incorrect"), F.col("category"))).alias("most_errors"))
