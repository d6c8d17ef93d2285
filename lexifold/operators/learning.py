"""Clustering and topics by Spark's own library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL_WORDS = 1 << 17


def kmeans(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, cluster, x, y): k-means of v and its first two principal components."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector("v").alias("features"))
    found = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)
    flat = PCA(k=2, inputCol="features", outputCol="xy").fit(rows).transform(found)
    xy = vector_to_array("xy")
    return flat.select("id", "cluster", xy[0].alias("x"), xy[1].alias("y"))


def topics(df: DataFrame, k: int, tokens: str = "tokens", vocabulary: int = 0, iterations: int = 5, words: int = 10, seed: int = 1):
    """(rows (id, topic), topics (topic, terms)): LDA over token counts. vocabulary: only the most frequent words (0: all).

    Spark's library holds the vocabulary and the topics' weights in the driver, so
    beyond LOCAL_WORDS words of all the weights are a table (operators.topics).
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    from .graph import written
    from .topics import Topics, term_counts

    counted = None if vocabulary else written(term_counts(df, tokens))
    size = vocabulary or max(1, counted.count())
    if not vocabulary and size > LOCAL_WORDS:
        found = Topics(df, k, tokens, iterations, seed, counted=counted)
        return found.assigned(), found.described(words)
    cv = CountVectorizer(inputCol=tokens, outputCol="features", vocabSize=size, minDF=1).fit(df)
    rows = cv.transform(df).select("id", "features")
    model = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="features").fit(rows)
    d = vector_to_array("topicDistribution")
    best = F.array_position(d, F.array_max(d)) - 1
    names = cv.vocabulary
    terms = [(r.topic, [names[i] for i in r.termIndices]) for r in model.describeTopics(words).collect()]
    return model.transform(rows).select("id", best.alias("topic")), df.sparkSession.createDataFrame(terms, "topic int, terms array<string>")


def scatter(found: DataFrame, notation: str) -> DataFrame:
    """(label, x, y, notation): the table a plot is drawn from."""
    return found.select(F.col("cluster").alias("label"), "x", "y", F.col(notation).alias("notation"))
