"""Models that Spark ML trains: logistic fusion, calibration and the TF-IDF baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text as T
from ..tables import spread, table
from .sampling import group_folds


#: Steps of a fit at most.
ITERATIONS = 100


def _scaling(df: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations, 1 where a column does not vary; one row."""
    r = df.agg(*[F.avg(n).alias(f"m{k}") for k, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s{k}") for k, n in enumerate(names)]).first()
    return [float(r[f"m{k}"] or 0.0) for k in range(len(names))], [float(r[f"s{k}"] or 1.0) for k in range(len(names))]


def _with_vector(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, written, with ``features``: the columns ``names`` as a dense vector."""
    none = lambda t: F.lit(None).cast(t)
    values = F.array(*[F.col(n).cast("double") for n in names])
    return _as_vectors(df.withColumn("features", F.struct(F.lit(1).cast("tinyint").alias("type"), none("int").alias("size"), none("array<int>").alias("indices"), values.alias("values"))), "features")


def _fitted(df: DataFrame, n: int):
    """A logistic model of ``features`` as they are. Its penalty is that of standardised ones, with the weight 1 on the loss of all
    ``n`` rows: Spark standardises inside the fit, so no data are scaled before, but by sample deviations, hence the factor."""
    n = max(1, n)
    return LogisticRegression(labelCol="label", regParam=max(1, n - 1) / n / n, standardization=True, maxIter=ITERATIONS).fit(df)


#: Topics whose folds are broadcast at most; with more, their rows are written with the fold.
FEW_TOPICS = 50_000


def _held_out(d: DataFrame, topic: str, folds: int, columns: list[str]) -> DataFrame:
    """``columns`` of a table with features, and ``p``: each row scored by a model that saw no row of its topic's fold. All models
    are applied in one pass, each to the rows of its fold only."""
    of = table(group_folds(d.groupBy(topic).agg(F.count("*").alias("rows")), topic, folds, "rows"), "folds")
    rows = {r["fold"]: r["n"] for r in of.groupBy("fold").agg(F.sum("rows").alias("n")).collect()}  # a row for each fold
    of = of.select(topic, "fold")
    d = d.join(F.broadcast(of), topic) if of.count() <= FEW_TOPICS else table(d.join(of, topic), "folds")
    out, p = d, []
    for k in range(folds):
        model = _fitted(d.where(F.col("fold") != k), sum(n for fold, n in rows.items() if fold != k))
        out = model.setProbabilityCol(f"_p{k}").setRawPredictionCol("").setPredictionCol("").transform(out)
        p.append(F.when(F.col("fold") == k, vector_to_array(f"_p{k}")[1]))
    return out.withColumn("p", F.coalesce(*p)).select(*columns, "p")


def out_of_fold(df: DataFrame, names: list[str], topic: str, folds: int = 5) -> DataFrame:
    """``df`` with ``p``: each row scored by a model that saw no row of its topic's fold; the inputs are written once and
    read by every fit."""
    return _held_out(_with_vector(df.withColumn("label", F.col("label").cast("double")), names), topic, folds, df.columns)


def train_fusion(df: DataFrame, names: list[str], topic: str, folds: int = 5) -> dict:
    """A stored model (see ``scoring.load_model``) of ``df`` (label and ``names``): fitted to all rows, its threshold the
    first of 0.05 to 0.95 with the best macro-F1, its calibration curve isotonic over the out-of-fold scores."""
    from .metrics import threshold_search

    d = _with_vector(df.select(topic, *names, F.col("label").cast("double").alias("label")), names)
    means, scales = _scaling(d, names)
    model = _fitted(d, d.count())
    coefficients = [float(c) * s for c, s in zip(model.coefficients, scales, strict=True)]
    intercept = float(model.intercept) + sum(float(c) * m for c, m in zip(model.coefficients, means, strict=True))
    scored = model.transform(d.select("label", "features")).select("label", vector_to_array("probability")[1].alias("score"))
    threshold = threshold_search(scored, 5, 95).first().threshold
    oof = table(_held_out(d.select(topic, "label", "features"), topic, folds, ["label"]), "held-out")  # a sort reads it twice
    curve = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="y").fit(oof)
    grid = df.sparkSession.range(101).select("id", (F.col("id") / 100.0).alias("p"))
    y = [min(1.0, max(0.0, r.y)) for r in curve.transform(grid).orderBy("id").collect()]  # 101 rows
    return {
        "feature_names": list(names), "coefficients": coefficients, "intercept": intercept,
        "scaler_mean": means, "scaler_scale": scales, "val_threshold": float(threshold), "calibrator_x": [k / 100 for k in range(101)], "calibrator_y": y,
    }


#: The grid of weights of three scores: twentieths that add up to one, by the first and then the second.
SIMPLEX = [(i, j, 20 - i - j) for i in range(21) for j in range(21 - i)]


def gate(df: DataFrame, names: list[str]) -> tuple[list[float], float]:
    """Weights and intercept of a logistic model of ``names`` as they are, with the weight 1 of a squared penalty on all rows' loss."""
    d = VectorAssembler(inputCols=names, outputCol="features").transform(df.select(*names, F.col("label").cast("double").alias("label")))
    m = LogisticRegression(labelCol="label", regParam=1.0 / max(1, df.count()), standardization=False, maxIter=1000, tol=1e-9).fit(d)
    return [float(c) for c in m.coefficients], float(m.intercept)


def simplex_counts(df: DataFrame, triples: dict[str, tuple[str, str, str]], threshold: float = 0.5) -> DataFrame:
    """(triple, w1, w2, w3, tn, fp, fn, tp) of every weighting in SIMPLEX (in twentieths) of each triple of columns. One pass:
    a task adds each row to a vector of counts for all weightings at once, and only these are shuffled."""
    columns = sorted({c for t in triples.values() for c in t})
    where = {n: [columns.index(c) for c in t] for n, t in triples.items()}
    grid = np.array(SIMPLEX, np.float64).T / 20.0
    names = ["triple", "at", "tn", "fp", "fn", "tp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = {n: np.zeros((2, len(SIMPLEX)), np.int64) for n in where}
        rows = np.zeros(2, np.int64)
        for b in batches:
            label = np.asarray(b.column(0), np.int64)
            x = np.stack([np.asarray(c, np.float64) for c in b.columns[1:]], axis=1)
            rows += np.bincount(label, minlength=2)
            for n, at in where.items():
                hit = np.round(x[:, at] @ grid, 9) >= threshold
                for k in (0, 1):
                    hits[n][k] += hit[label == k].sum(axis=0)
        if rows.any():
            for n, (fp, tp) in hits.items():
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(SIMPLEX)), pa.array(np.arange(len(SIMPLEX), dtype=np.int32)), pa.array(rows[0] - fp), pa.array(fp), pa.array(rows[1] - tp), pa.array(tp)], names=names)

    d = df.select((F.col("label") == 1).cast("int").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    part = d.mapInArrow(run, "triple string, at int, tn long, fp long, fn long, tp long").groupBy("triple", "at").agg(*[F.sum(c).alias(c) for c in names[2:]])
    of = lambda k: F.get(F.array(*(F.lit(w[k]) for w in SIMPLEX)), F.col("at"))
    return part.select("triple", *[of(k).alias(f"w{k + 1}") for k in range(3)], *names[2:])


def best_simplex(df: DataFrame, triples: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(triple, w1, w2, w3, macro_f1): the weighting with the best macro F1 at 0.5, the first of equals."""
    from .metrics import rates

    r = rates(simplex_counts(df, triples))
    return r.groupBy("triple").agg(F.max_by(F.struct("w1", "w2", "w3"), F.struct(F.round("macro_f1", 12), -F.col("w1"), -F.col("w2"))).alias("w"), F.max("macro_f1").alias("macro_f1")).select("triple", *[(F.col(f"w.w{k}") / 20.0).alias(f"w{k}") for k in (1, 2, 3)], "macro_f1")


def platt(df: DataFrame, score: str = "score") -> DataFrame:
    """``df`` with ``calibrated``: a logistic model of the score's logit."""
    d = df.withColumn("_x", T.logit(score)).withColumn("label", F.col("label").cast("double"))
    m = Pipeline(stages=[VectorAssembler(inputCols=["_x"], outputCol="features"), LogisticRegression(labelCol="label", regParam=1.0 / max(1, df.count()))]).fit(d)
    return m.transform(d).withColumn("calibrated", vector_to_array("probability")[1]).select(*df.columns, "calibrated")


def isotonic(df: DataFrame, score: str = "score") -> DataFrame:
    """``df`` with ``calibrated``: the best non-decreasing step function of the score."""
    d = df.withColumn("label", F.col("label").cast("double"))
    return IsotonicRegression(featuresCol=score, labelCol="label", predictionCol="calibrated").fit(d).transform(d).select(*df.columns, "calibrated")


#: Terms of a vocabulary at most.
VOCABULARY = 50_000


def grams(c: Column) -> Column:
    """Words of two letters, digits or underscores or more in lower case, without STOP_WORDS, and pairs of neighbours among them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    one = F.filter(found, lambda w: ~w.isin(*T.STOP_WORDS))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    # the words are named in an array of one, so that they are found once
    return F.element_at(F.transform(F.array(one), lambda w: F.concat(w, pairs(w))), 1)


def _counted(g: Column) -> Column:
    """An array's elements, each once, with the number of times that it is there, by sorting it."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        of = lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n")))
        return F.element_at(F.transform(F.array(starts), of), 1)

    return F.element_at(F.transform(F.array(F.sort_array(g)), lambda s: F.when(F.size(s) > 0, runs(s))), 1)


def _as_vectors(df: DataFrame, parts: str) -> DataFrame:
    """``df`` with the struct ``parts`` of a sparse vector's kind, size, indices and values as the vector. In a file a vector is that
    struct, so it is written as one and read as the other, and no Python touches a row."""
    held = table(df, "vectors")
    schema = StructType([StructField(f.name, VectorUDT() if f.name == parts else f.dataType) for f in held.schema.fields])
    return df.sparkSession.read.schema(schema).parquet(held._textloom_path)


def _weighted(docs: DataFrame, vocabulary: int, key: str) -> tuple[DataFrame, DataFrame, bool]:
    """``docs`` with ``features``, the vector of TF-IDF weights, in place of text; the terms as of ``tfidf``; and whether several rows
    have one key, whose texts are then counted together."""
    n = docs.count()
    words = spread(docs).withColumn("grams", grams(F.col("text"))).drop("text")
    many = not docs.groupBy(key).count().where("count > 1").isEmpty()
    if many:
        words = docs.drop("text").join(words.groupBy(key).agg(F.flatten(F.collect_list("grams")).alias("grams")), key)
    found = spread(docs).select(F.explode(grams(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    found = found.orderBy(F.desc("n"), "term").limit(vocabulary)
    names = [r.term for r in found.select("term").orderBy("term").collect()]  # ``vocabulary`` at most
    count = CountVectorizerModel.from_vocabulary(names or [""], inputCol="grams", outputCol="_counts")
    part = F.unwrap_udt("_counts")
    values = F.transform(part["values"], lambda c: 1 + F.log(c))
    counts = _as_vectors(count.transform(words).select(*[c for c in docs.columns if c != "text"], F.struct(part["type"].alias("type"), part["size"].alias("size"), part["indices"].alias("indices"), values.alias("values")).alias("_tf")), "_tf")
    each = counts.dropDuplicates([key]) if many else counts
    df = each.select(F.explode(F.unwrap_udt("_tf")["indices"]).alias("index")).groupBy("index").agg(F.count("*").alias("df"))
    df = df.withColumn("idf", F.log((1 + F.lit(float(n))) / (1 + F.col("df"))) + 1)
    terms = table(docs.sparkSession.createDataFrame(list(enumerate(names)), "index int, term string").join(df, "index").select("term", "index", "df", "idf"), "terms")
    idf = [0.0] * max(1, len(names))
    for r in terms.select("index", "idf").collect():  # ``vocabulary`` at most
        idf[r["index"]] = r["idf"]
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_w")
    out = Normalizer(inputCol="_w", outputCol="features").transform(scale.transform(counts))
    return out.drop("_tf", "_w"), terms, many


def tfidf(docs: DataFrame, vocabulary: int = VOCABULARY, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, indices, weights) of ``docs`` (key, text), and the terms (term, index, df, idf): words and pairs by how often the corpus
    has them, ``vocabulary`` at most, ties by name, numbered by name.

    A weight is (1 + ln count) * (1 + ln((1 + texts) / (1 + texts with the term))), and a text's weights have length one. Only a task's
    sums of each term are shuffled. A text's terms in the vocabulary are counted inside its row, and those counts alone are written;
    texts are read twice, which costs less than writing all their terms. Texts without terms have empty arrays.
    """
    v, terms, _ = _weighted(docs.select(key, "text"), vocabulary, key)
    part = F.unwrap_udt("features")
    return v.select(key, part["indices"].alias("indices"), part["values"].alias("weights")), terms


def tfidf_baseline(df: DataFrame, vocabulary: int = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """``df`` (key, text, label) with ``p``: a logistic model of TF-IDF weights with balanced class weights, and the weight 1 of a
    squared penalty on all rows' loss."""
    f, _, many = _weighted(df.select(key, "text", F.col("label").cast("double").alias("label")), vocabulary, key)
    f = f.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    n = f.groupBy("label").count().collect()  # a row for each class
    total, k = sum(r["count"] for r in n), len(n)
    w = F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(total / (k * r["count"]))) for r in n], F.lit(1.0))
    m = LogisticRegression(weightCol="w", regParam=1.0 / max(1, total), standardization=False, maxIter=ITERATIONS).fit(f.withColumn("w", w))
    p = m.transform(f).select(key, vector_to_array("probability")[1].alias("p"))
    return df.drop("p").join(p.dropDuplicates([key]) if many else p, key)
