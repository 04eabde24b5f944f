"""Text classifiers on pyspark.ml (M16, M17, M41): n-gram TF-IDF, linear heads, out-of-fold averages, a rated ensemble."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelindan.operators.metrics import confusion, summary
from kelindan.operators.sampling import group_folds
from kelindan.operators.textsim import grams_of


def features(text: str = "text", words: tuple[int, ...] = (1, 2), chars: tuple[int, ...] = (3, 4, 5), size: int = 1 << 16) -> list:
    """Stages that turn a text column into hashed word n-grams and, if ``chars``, the character grams in column ``grams``."""
    stages: list = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False)]
    parts = []
    for n in words:
        stages += [NGram(n=n, inputCol="_words", outputCol=f"_w{n}"), HashingTF(inputCol=f"_w{n}", outputCol=f"_tf{n}", numFeatures=size), IDF(inputCol=f"_tf{n}", outputCol=f"_x{n}", minDocFreq=2)]
        parts.append(f"_x{n}")
    if chars:
        stages += [HashingTF(inputCol="grams", outputCol="_tfc", numFeatures=size), IDF(inputCol="_tfc", outputCol="_xc", minDocFreq=2)]
        parts.append("_xc")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def with_grams(df: DataFrame, text: str = "text", chars: Sequence[int] = (3, 4, 5)) -> DataFrame:
    """``df`` with padded character grams of several lengths in ``grams`` (built in the JVM)."""
    return df.withColumn("grams", F.concat(*[grams_of(F.lower(text), n) for n in chars]))


def classifier(kind: str = "logistic", iterations: int = 30):
    """A linear head: logistic (class-weighted by column ``weight``) or svm (one against the rest; see ``probabilities`` for its calibration)."""
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.01))
    return LogisticRegression(maxIter=iterations, regParam=0.01, weightCol="weight")


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with ``weight`` = rows / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    both = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))))  # one row
    return df.join(both.select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight")), label)


def fit(df: DataFrame, kind: str = "logistic", iterations: int = 30) -> PipelineModel:
    """A pipeline fitted on (text, label double); texts of null are empty."""
    data = balanced(with_grams(df.withColumn("text", F.coalesce("text", F.lit("")))))
    return Pipeline(stages=[*features(), classifier(kind, iterations)]).fit(data)


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``p``, the array of class probabilities; those of an svm head are the softmax of its margins."""
    out = model.transform(with_grams(df.withColumn("text", F.coalesce("text", F.lit("")))))
    if "probability" in out.columns:
        return out.withColumn("p", vector_to_array("probability")).select(*df.columns, "p")
    margins = out.withColumn("_m", vector_to_array("rawPrediction"))
    e = F.transform("_m", lambda x: F.exp(x - F.array_max("_m")))
    return margins.withColumn("_e", e).withColumn("p", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b))).select(*df.columns, "p")


def save(model: PipelineModel, path: str) -> None:
    """Write a fitted pipeline, replacing what is there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """A fitted pipeline as it was saved."""
    return PipelineModel.load(path)


def out_of_fold(df: DataFrame, key: str, group: str, folds: int = 3, repeats: int = 1, iterations: int = 20, kind: str = "logistic") -> DataFrame:
    """``(key, label, p)``: mean probabilities of models that haven't seen the row's group."""
    parts = None
    for seed in range(repeats):
        held = group_folds(df, group, folds, seed)
        for k in range(folds):
            model = fit(held.where(F.col("fold") != k).drop("fold"), kind, iterations)
            one = probabilities(model, held.where(F.col("fold") == k).drop("fold"))
            parts = one if parts is None else parts.unionByName(one)
    exploded = parts.select(key, "label", F.posexplode("p").alias("i", "v")).groupBy(key, "label", "i").agg(F.avg("v").alias("v"))
    return exploded.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a")).select(key, "label", F.col("a.v").alias("p"))


def ensemble(members: Sequence[DataFrame], key: str) -> DataFrame:
    """Mean of several members' probability arrays by key."""
    rows = None
    for m in members:
        one = m.select(key, F.posexplode("p").alias("i", "v"))
        rows = one if rows is None else rows.unionByName(one)
    mean = rows.groupBy(key, "i").agg(F.avg("v").alias("v"))
    return mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a")).select(key, F.col("a.v").alias("p"))


def top_two(found: dict[str, DataFrame], key: str, labels: Sequence[str], gain: float = 0.002) -> DataFrame:
    """``(model, macro_f1, chosen)`` of each model's out-of-fold predictions ``(key, label, p)`` and of the mean of the two best.

    The mean is chosen only if it gains at least ``gain`` on the best single model; ties go to the first name.
    """
    names = F.array(*[F.lit(x) for x in labels])

    def score(p: DataFrame) -> float:
        pred = names[F.array_position("p", F.array_max("p")).cast("int") - 1]
        cells = confusion(p.select(names[F.col("label").cast("int")].alias("t"), pred.alias("q")), "t", "q")
        return float(summary(cells, labels).first().macro_f1 or 0.0)

    scores = {n: score(p) for n, p in found.items()}
    best = sorted(scores, key=lambda n: (-scores[n], n))
    out = dict(scores)
    if len(best) > 1:
        mean = ensemble([found[n] for n in best[:2]], key).join(found[best[0]].select(key, "label"), key)
        out["+".join(sorted(best[:2]))] = score(mean)
    both = [n for n in out if n not in scores]
    chosen = both[0] if both and out[both[0]] >= scores[best[0]] + gain else best[0]
    spark = found[best[0]].sparkSession
    return spark.createDataFrame([(n, round(f, 9), n == chosen) for n, f in out.items()], "model string, macro_f1 double, chosen boolean")
