"""MLlib models for the text and tree estimators.

Fits are distributed MLlib jobs; fold loops run k small fits over
hash-assigned folds; evaluation metrics are aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (CountVectorizer, CountVectorizerModel, IDF, NGram, RegexTokenizer, SQLTransformer,
                                VectorAssembler, VectorSlicer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import confusion


def tfidf_stages(text: str, n: int = 1, vocab: int = 1000, sublinear: bool = False, idf: bool = True):
    st = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}]+", gaps=False, toLowercase=True)]
    src = "_tok"
    if n > 1:
        grams = []
        for k in range(1, n + 1):
            if k == 1:
                continue
            st.append(NGram(n=k, inputCol="_tok", outputCol=f"_ng{k}"))
            grams.append(f"_ng{k}")
        st.append(SQLTransformer(statement="SELECT *, concat(_tok, " + ", ".join(grams) + ") AS _terms FROM __THIS__"))
        src = "_terms"
    st.append(CountVectorizer(inputCol=src, outputCol="_tf", vocabSize=vocab, minDF=1.0))
    if sublinear:
        st.append(SQLTransformer(statement="SELECT *, _tf AS _tf_raw FROM __THIS__"))
    if idf:
        st.append(IDF(inputCol="_tf", outputCol="features"))
    else:
        st.append(SQLTransformer(statement="SELECT *, _tf AS features FROM __THIS__"))
    return st


def term_counts(df: DataFrame, text: str, vocab: int, n: int = 1, fold: str | None = None, k: int = 0, keep=()):
    """(table, vocabularies): the texts' counts of the terms in any vocabulary as one sparse vector ``_all``, next to the
    ``keep`` columns and stored, and for each of ``k`` folds (or for all rows) the places in it of the ``vocab`` most
    frequent terms outside the fold, most frequent first, and the terms.  Every text is cut into terms twice, whatever
    the number of folds, models and passes over the table."""
    from ..session import materialize
    stages = tfidf_stages(text, n, vocab)
    cut = next(i for i, s in enumerate(stages) if isinstance(s, CountVectorizer))
    src = stages[cut].getInputCol()
    for s in stages[:cut]:
        df = s.transform(df)
    one = [F.when(F.col(fold) != f, 1) for f in range(k)] if fold else [F.lit(1)]
    split = df.select(F.explode(src).alias("term"), *[c.cast("long").alias(f"n{i}") for i, c in enumerate(one)])
    counts = materialize(split.groupBy("term").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(one))]), "term_counts")
    tops = [[r["term"] for r in counts.where(F.col(f"n{i}") > 0).orderBy(F.desc(f"n{i}"), "term").limit(vocab).collect()]
            for i in range(len(one))]
    at = {t: i for i, t in enumerate(dict.fromkeys(t for top in tops for t in top))}  # at most folds * vocab terms
    counter = CountVectorizerModel.from_vocabulary(list(at), inputCol=src, outputCol="_all")
    return materialize(counter.transform(df).select(*keep, "_all"), "term_vectors"), [([at[t] for t in top], top) for top in tops]


def cv_classifier(df: DataFrame, text: str, label: str, fold: str, k: int, model: str = "logistic",
                  n: int = 1, vocab: int = 1000) -> DataFrame:
    """Per fold fit pipeline(text → tf-idf → classifier) on the
    other folds, predict the fold, report the confusion metrics per fold."""
    return cv_classifiers(df, text, label, fold, k, [model], n, vocab)


def cv_classifiers(df: DataFrame, text: str, label: str, fold: str, k: int, models, n: int = 1,
                   vocab: int = 1000) -> DataFrame:
    """``cv_classifier`` for several models, which share the texts' term counts."""
    d, vocabularies = term_counts(df, text, vocab, n, fold, k, keep=[label, fold])
    out = []
    for model in models:
        for f in range(k):
            tr, te = d.where(F.col(fold) != f), d.where(F.col(fold) == f)
            stages = [VectorSlicer(inputCol="_all", outputCol="_tf", indices=vocabularies[f][0])]
            if model == "complement_nb":
                clf = NaiveBayes(featuresCol="_tf", labelCol=label, modelType="complement", smoothing=1.0)
            else:
                stages.append(IDF(inputCol="_tf", outputCol="features"))
                if model == "random_forest":
                    clf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=50, seed=7)
                else:
                    clf = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=100)
            m = Pipeline(stages=stages + [clf]).fit(tr)
            pr = m.transform(te).select(F.col(label).cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
            out.append(pr.agg(*confusion("t", "p")).withColumn("fold", F.lit(f)).withColumn("model", F.lit(model)))
    return reduce(lambda a, b: a.unionByName(b), out)


def topic_clusters(df: DataFrame, text: str, k: int = 5, n: int = 2, vocab: int = 1000, top: int = 5,
                   seed: int = 1) -> DataFrame:
    """TF-IDF (1..n-grams) + k-means; top terms per cluster by centre weight."""
    d, [(_, terms)] = term_counts(df, text, vocab, n)
    model = Pipeline(stages=[IDF(inputCol="_all", outputCol="features"), KMeans(k=k, seed=seed, featuresCol="features")]).fit(d)
    km = model.stages[-1]
    spark = df.sparkSession
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(km.clusterCenters())]
    cdf = spark.createDataFrame(centers, "cluster int, center array<double>")
    vocab_df = spark.createDataFrame(list(enumerate(terms)), "idx int, term string")
    long = cdf.select("cluster", F.posexplode("center").alias("idx", "weight"))
    from pyspark.sql import Window
    w = Window.partitionBy("cluster").orderBy(F.col("weight").desc(), F.col("idx"))
    topt = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    sizes = model.transform(d).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return topt.join(F.broadcast(vocab_df), "idx").join(sizes, "cluster", "left") \
               .select("cluster", "rank", "term", "weight", "size")


def vector_classifier(df: DataFrame, vec: str, label: str, fold: str, k: int) -> DataFrame:
    """Logistic regression on given document vectors; area under PR and
    ROC per fold."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    d = df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    rows = []
    for f in range(k):
        tr, te = d.where(F.col(fold) != f), d.where(F.col(fold) == f)
        m = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=100).fit(tr)
        pr = m.transform(te)
        ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction")
        rows.append((f, float(ev.setMetricName("areaUnderPR").evaluate(pr)),
                     float(ev.setMetricName("areaUnderROC").evaluate(pr))))
    return df.sparkSession.createDataFrame(rows, "fold int, area_under_pr double, area_under_roc double")


def rf_time_folds(df: DataFrame, label: str, features, fold: str, k: int, trees: int = 50, depth: int = 5) -> DataFrame:
    """Random forest over expanding time folds (train on folds < f)."""
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    out = []
    for f in range(1, k):
        tr, te = df.where(F.col(fold) < f), df.where(F.col(fold) == f)
        m = Pipeline(stages=[va, RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=3)]).fit(tr)
        pr = m.transform(te).select(F.col(label).cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
        out.append(pr.agg(*confusion("t", "p")).withColumn("fold", F.lit(f)))
    return reduce(lambda a, b: a.unionByName(b), out)


def chained_impute(df: DataFrame, cols, rounds: int = 2, trees: int = 20, checkpoint: bool = True) -> DataFrame:
    """Iterative imputation: each round, for every column, a random forest
    on the other columns (current fills) predicts its missing cells.  Columns
    that are null everywhere become 0.  Starts from column means."""
    cols = list(cols)
    if checkpoint:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
    means = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    d = df.withColumns({f"_miss_{c}": F.col(c).isNull() for c in cols})
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(means[c] if means[c] is not None else 0.0)) for c in cols})
    for _ in range(rounds):
        for c in cols:
            if means[c] is None:
                continue
            others = [o for o in cols if o != c]
            va = VectorAssembler(inputCols=others, outputCol="_f")
            rf = RandomForestRegressor(featuresCol="_f", labelCol=c, numTrees=trees, maxDepth=5, seed=11)
            model = Pipeline(stages=[va, rf]).fit(d.where(~F.col(f"_miss_{c}")))
            d = model.transform(d).withColumn(c, F.when(F.col(f"_miss_{c}"), F.col("prediction")).otherwise(F.col(c))) \
                     .drop("_f", "prediction")
        if checkpoint:
            # cut the growing lineage once per round (reliable checkpoint in
            # the shared spark.checkpoint.dir; survives executor loss)
            d = d.checkpoint(eager=True)
    return d.drop(*[f"_miss_{c}" for c in cols])


def pooled_regressors(df: DataFrame, label: str, features, train_cond, models=("forest", "boosting", "poisson"),
                      seed: int = 5) -> DataFrame:
    """C20: one pooled MLlib regressor per model over all events (trained on
    the pre-period rows), predictions for every row; metrics per model and
    period from one aggregate.  Without a training row there is no prediction
    (null metrics); without any row the result is empty."""
    from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    out = []
    none = df.where(train_cond).isEmpty()
    for m in models:
        if m == "forest":
            reg = RandomForestRegressor(labelCol=label, numTrees=30, maxDepth=5, seed=seed)
        elif m == "boosting":
            reg = GBTRegressor(labelCol=label, maxIter=20, maxDepth=4, seed=seed)
        else:
            reg = GeneralizedLinearRegression(labelCol=label, family="poisson", link="log", maxIter=50, regParam=1e-6)
        pr = (df.withColumn("prediction", F.lit(None).cast("double")) if none
              else Pipeline(stages=[va, reg]).fit(df.where(train_cond)).transform(df))
        pr = pr.withColumn("model", F.lit(m)).withColumn("period", F.when(train_cond, "pre").otherwise("post"))
        err = F.col(label) - F.col("prediction")
        out.append(pr.groupBy("model", "period").agg(F.avg(err * err).alias("mse"), F.avg(err).alias("bias"),
                                                       F.count(F.lit(1)).alias("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


def model_filter_chain(labelled: DataFrame, docs: DataFrame, text: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Fit a text classifier, score every document, keep predicted
    positives above the threshold with their score, ordered by score."""
    pipe = Pipeline(stages=tfidf_stages(text, 1, 1000) + [
        LogisticRegression(featuresCol="features", labelCol=label, regParam=0.01, maxIter=100)])
    m = pipe.fit(labelled)
    sc = m.transform(docs).withColumn("score", vector_to_array("probability").getItem(1))
    return sc.where((F.col("prediction") == 1) & (F.col("score") > threshold)) \
             .select("doc_id", "score").orderBy(F.col("score").desc(), "doc_id")
