"""Clustering queries on the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from calorix.functions.distances import distance
from calorix.operators import clusters as cl
from calorix.operators import fits
from calorix.operators.compare import metric_diff
from calorix.plans.base import query, rounded, table
from calorix.session import collect_bounded

CENTER = [((i * 7) % 11 - 5) / 10 for i in range(64)]


@query(
    "pair_distance",
    f"""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
                  FROM embeddings),
    c AS (SELECT i, {CENTER}[i] AS c FROM range(1, 65) r(i)),
    j AS (SELECT vec_id, x, c, x - avg(x) OVER v AS xm, c - avg(c) OVER v AS cm
          FROM p JOIN c USING (i) WINDOW v AS (PARTITION BY vec_id))
    SELECT vec_id, round(sqrt(sum(pow(x - c, 2))), 6) AS euclidean,
      round(sum(pow(x - c, 2)), 6) AS sqeuclidean, round(sum(abs(x - c)), 6) AS cityblock,
      round(max(abs(x - c)), 6) AS chebyshev,
      round(1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 6) AS cosine,
      round(1 - sum(xm * cm) / (sqrt(sum(xm * xm)) * sqrt(sum(cm * cm))), 6) AS correlation,
      round(sum(abs(x - c) / (abs(x) + abs(c))), 6) AS canberra,
      round(sum(abs(x - c)) / sum(abs(x + c)), 6) AS braycurtis,
      round(sum(CASE WHEN x <> c THEN 1 ELSE 0 END) / 64, 6) AS hamming,
      round(pow(sum(pow(abs(x - c), 3)), 1.0 / 3), 6) AS minkowski
    FROM j GROUP BY vec_id""",
)
def _pair_distance(spark, folder):
    names = [
        "euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine", "correlation",
        "canberra", "braycurtis", "hamming",
    ]
    out = table(spark, folder, "embeddings").select(
        "vec_id",
        *[distance("embedding", CENTER, n).alias(n) for n in names],
        distance("embedding", CENTER, "minkowski", p=3).alias("minkowski"),
    )
    return rounded(out, 6, *names, "minkowski")


@query(
    "boolean_distance",
    f"""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) > 0 AS x
                  FROM embeddings),
    c AS (SELECT i, {CENTER}[i] > 0 AS c FROM range(1, 65) r(i)),
    t AS (SELECT vec_id, count(*) FILTER (x AND c) AS tt, count(*) FILTER (x AND NOT c) AS tf,
            count(*) FILTER (NOT x AND c) AS ft, count(*) FILTER (NOT x AND NOT c) AS ff
          FROM p JOIN c USING (i) GROUP BY vec_id)
    SELECT vec_id, round((tf + ft) / (2 * tt + tf + ft), 6) AS dice,
      round((tf + ft) / (tt + tf + ft), 6) AS jaccard, round(tt / (tf + ft), 6) AS kulczynski1,
      round((tf + ft) / 64, 6) AS matching,
      round(2 * (tf + ft) / (tt + ff + 2 * (tf + ft)), 6) AS rogerstanimoto,
      round((64 - tt) / 64, 6) AS russellrao,
      round(2 * (tf + ft) / (tt + ff + 2 * (tf + ft)), 6) AS sokalmichener,
      round(2 * (tf + ft) / (tt + 2 * (tf + ft)), 6) AS sokalsneath,
      round(CASE WHEN tf * ft = 0 THEN 0 ELSE 2 * tf * ft / (tt * ff + tf * ft) END, 6) AS yule
    FROM t""",
)
def _boolean_distance(spark, folder):
    names = [
        "dice", "jaccard", "kulczynski1", "matching", "rogerstanimoto", "russellrao",
        "sokalmichener", "sokalsneath", "yule",
    ]
    center = [1.0 if x > 0 else 0.0 for x in CENTER]
    signs = F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    out = table(spark, folder, "embeddings").withColumn("signs", signs)
    out = out.select("vec_id", *[distance("signs", center, n).alias(n) for n in names])
    return rounded(out, 6, *names)


def class_means(spark, folder) -> list[list[float]]:
    """Mean vector of each label: ten centres of 64 numbers."""
    rows = cl.cluster_means(table(spark, folder, "embeddings"), "embedding", "label")
    found = collect_bounded(rows.orderBy("label"), 1_000, "labels")
    return [list(r["center"]) for r in found]


ASSIGNED = """
p AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
      FROM embeddings),
m AS (SELECT label AS k, i, avg(x) AS c FROM p GROUP BY label, i),
d AS (SELECT vec_id, any_value(label) AS label, k, sum((x - c) * (x - c)) AS d2
      FROM p JOIN m USING (i) GROUP BY vec_id, k),
a AS (SELECT vec_id, label, k AS cluster, d2 FROM d
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sqrt(d2), k) = 1)"""


@query(
    "nearest_center",
    f"WITH {ASSIGNED} SELECT vec_id, cluster, round(sqrt(d2), 6) AS distance FROM a",
)
def _nearest_center(spark, folder):
    placed = cl.nearest_center(
        table(spark, folder, "embeddings"), "embedding", class_means(spark, folder)
    )
    return rounded(placed.select("vec_id", "cluster", "distance"), 6, "distance")


@query(
    "lloyd_step",
    f"""WITH {ASSIGNED},
    n AS (SELECT cluster, i, avg(x) AS c FROM a JOIN p USING (vec_id) GROUP BY 1, 2),
    s AS (SELECT cluster, count(*) AS n_samples, round(sum(sqrt(d2)), 5) AS inertia FROM a GROUP BY cluster)
    SELECT cluster, n_samples, inertia, (i - 1)::INTEGER AS position, round(c, 6) AS center
    FROM s JOIN n USING (cluster)""",
)
def _lloyd_step(spark, folder):
    step = cl.lloyd_step(
        table(spark, folder, "embeddings"), "embedding", class_means(spark, folder)
    )
    out = step.select(
        "cluster",
        "n_samples",
        "inertia",
        F.posexplode("center").alias("position", "center"),
    )
    return rounded(rounded(out, 5, "inertia"), 6, "center")


def assigned_counts(spark, folder):
    placed = cl.nearest_center(
        table(spark, folder, "embeddings").withColumn("y", F.col("label") % 3),
        "embedding",
        class_means(spark, folder),
        "sqeuclidean",
    )
    return cl.cluster_class_counts(placed, "cluster", "y", "distance")


_COUNTS = f"""{ASSIGNED},
n AS (SELECT cluster, label % 3 AS y, count(*) AS n, sum(d2) AS ss FROM a GROUP BY 1, 2),
r AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY y) AS ratio FROM n),
g AS (SELECT *, first(y) OVER (PARTITION BY cluster ORDER BY ratio DESC, y) AS dominant FROM r)"""


@query(
    "cluster_eval",
    f"""WITH {_COUNTS}
    SELECT cluster, round(sum(ss), 5) AS inertia, round(sum(ss) / sum(n), 6) AS variance,
      sum(n)::BIGINT AS n_samples, max(dominant) AS class_,
      coalesce(sum(n) FILTER (y = 0), 0)::BIGINT AS class_0_samples,
      round(coalesce(sum(ratio) FILTER (y = 0), 0), 6) AS class_0_ratio,
      coalesce(sum(n) FILTER (y = 1), 0)::BIGINT AS class_1_samples,
      round(coalesce(sum(ratio) FILTER (y = 1), 0), 6) AS class_1_ratio,
      coalesce(sum(n) FILTER (y = 2), 0)::BIGINT AS class_2_samples,
      round(coalesce(sum(ratio) FILTER (y = 2), 0), 6) AS class_2_ratio
    FROM g GROUP BY cluster""",
)
def _cluster_eval(spark, folder):
    out = cl.cluster_evaluation(assigned_counts(spark, folder), [0, 1, 2])
    out = rounded(out, 6, "variance", *[f"class_{c}_ratio" for c in range(3)])
    return rounded(out, 5, "inertia")


@query(
    "cluster_class_eval",
    f"""WITH {_COUNTS},
    t AS (SELECT sum(n) AS total FROM g),
    x AS (SELECT y AS label, sum(n) AS act, sum(n) FILTER (dominant = y) AS hit FROM g GROUP BY y),
    q AS (SELECT dominant AS label, sum(n) AS pred FROM g GROUP BY dominant),
    z AS (SELECT label, coalesce(hit, 0) AS tp, coalesce(pred, 0) - coalesce(hit, 0) AS fp,
            act - coalesce(hit, 0) AS fn, total - act - coalesce(pred, 0) + coalesce(hit, 0) AS tn
          FROM x LEFT JOIN q USING (label), t)
    SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn,
      round(tp / (tp + fn), 6) AS tpr, round(fp / (fp + tn), 6) AS fpr FROM z""",
)
def _cluster_class_eval(spark, folder):
    return rounded(cl.class_evaluation(assigned_counts(spark, folder)), 6, "tpr", "fpr")


@query(
    "cluster_accuracy",
    f"""WITH {_COUNTS}
    SELECT round(sum(ss), 5) AS inertia, round(sum(ss) / sum(n), 6) AS variance,
      sum(n)::BIGINT AS n_samples, sum(n) FILTER (dominant = y) / sum(n) AS accuracy FROM g""",
)
def _cluster_accuracy(spark, folder):
    out = cl.clustering_accuracy(assigned_counts(spark, folder))
    return rounded(rounded(out, 5, "inertia"), 6, "variance")


@query(
    "calinski_harabasz",
    """WITH p AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
                   unnest(embedding)::DOUBLE AS x FROM embeddings),
    g AS (SELECT i, avg(x) AS gm FROM p GROUP BY i),
    c AS (SELECT label, i, avg(x) AS cm, count(*) AS n FROM p GROUP BY label, i),
    b AS (SELECT sum(n * pow(cm - gm, 2)) AS b FROM c JOIN g USING (i)),
    w AS (SELECT sum(pow(x - cm, 2)) AS w FROM p JOIN c USING (label, i)),
    k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings)
    SELECT k AS n_clusters, round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz_score
    FROM b, w, k""",
)
def _calinski_harabasz(spark, folder):
    out = cl.calinski_harabasz(table(spark, folder, "embeddings"), "embedding", "label")
    return rounded(out, 5, "calinski_harabasz_score")


def _center_rows(spark, centers):
    rows = [(i, j, x) for i, c in enumerate(centers) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "place int, position int, value double")


@query(
    "farthest_point_init",
    """WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
                  FROM embeddings),
    d1 AS (SELECT p.vec_id, sqrt(sum(pow(p.x - q.x, 2))) AS d FROM p JOIN p q USING (i)
           WHERE q.vec_id = 0 GROUP BY 1),
    c2 AS (SELECT vec_id FROM d1 ORDER BY d DESC, vec_id LIMIT 1),
    d2 AS (SELECT p.vec_id, sqrt(sum(pow(p.x - q.x, 2))) AS d FROM p JOIN p q USING (i)
           WHERE q.vec_id = (SELECT vec_id FROM c2) GROUP BY 1),
    c3 AS (SELECT vec_id FROM d1 JOIN d2 USING (vec_id)
           ORDER BY least(d1.d, d2.d) DESC, vec_id LIMIT 1),
    c AS (SELECT 0 AS place, 0 AS vec_id UNION ALL SELECT 1, vec_id FROM c2
          UNION ALL SELECT 2, vec_id FROM c3)
    SELECT place, i::INTEGER - 1 AS position, x AS value FROM c JOIN p USING (vec_id)""",
)
def _farthest_point_init(spark, folder):
    centers = cl.farthest_point_init(
        table(spark, folder, "embeddings"), "embedding", "vec_id", 3, 0
    )
    return _center_rows(spark, centers)


@query("proportional_init")
def _proportional_init(spark, folder):
    centers = cl.proportional_init(
        table(spark, folder, "embeddings"), "embedding", "vec_id", 3, 0, seed=7
    )
    return _center_rows(spark, centers)


@query(
    "best_k",
    """WITH d AS (SELECT CAST(epoch(ts) AS BIGINT) // 86400 % 12 AS n_clusters,
                    round(sum(value), 2) AS inertia FROM events GROUP BY 1),
    x AS (SELECT *, round(inertia - lag(inertia) OVER (ORDER BY n_clusters), 2) AS diff FROM d)
    SELECT n_clusters, inertia, diff AS inertia_diff FROM x WHERE diff IS NOT NULL
    ORDER BY diff, n_clusters LIMIT 1""",
)
def _best_k(spark, folder):
    k = (F.floor(F.unix_timestamp("ts") / 86400) % 12).alias("n_clusters")
    series = table(spark, folder, "events").groupBy(k).agg(
        F.round(F.sum("value"), 2).alias("inertia")
    )
    search = rounded(metric_diff(series, "n_clusters", ["inertia"]), 2, "inertia_diff")
    return cl.best_k(search)


@query("metric_kmeans")
def _metric_kmeans(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = cl.MetricKMeans(k=4, max_iter=5, metric="cityblock", seed=3)
    placed = model.fit(rows, "embedding", "vec_id").predict(rows, "embedding")
    return placed.groupBy("cluster").agg(
        F.count("*").alias("n_samples"), F.round(F.sum("distance"), 4).alias("inertia")
    )


@query("kmeans_assign")
def _kmeans_assign(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = cl.fit_kmeans(rows, "embedding", 4, n_init=2, max_iter=20, seed=1)
    centers = [c.tolist() for c in model.clusterCenters()]
    placed = cl.nearest_center(rows, "embedding", centers)
    return placed.select("vec_id", "cluster", "distance")


@query("pca_variance")
def _pca_variance(spark, folder):
    rows = table(spark, folder, "embeddings")
    return cl.fit_reduction(rows, "embedding").variance_frame(rows)


@query("pca_components")
def _pca_components(spark, folder):
    """Spread of each whitened component, which is one by construction."""
    rows = table(spark, folder, "embeddings")
    white = cl.fit_reduction(rows, "embedding", 0.5).transform(rows)
    parts = white.select(F.posexplode("components").alias("component", "x"))
    return parts.groupBy("component").agg(
        F.round(F.stddev_samp("x"), 6).alias("std"), F.count("*").alias("n")
    )


@query("search_k")
def _search_k(spark, folder):
    return cl.search_k(table(spark, folder, "embeddings"), "embedding", [2, 3, 4], max_iter=10)


@query(
    "fold_single_cluster",
    """WITH p AS (SELECT vec_id % 3 AS fold, vec_id, generate_subscripts(embedding, 1) AS i,
                   unnest(embedding)::DOUBLE AS x FROM embeddings),
    f AS (SELECT unnest([0, 1, 2]) AS f),
    m AS (SELECT f, i, avg(x) AS m FROM p JOIN f ON fold <> f GROUP BY f, i)
    SELECT f AS fold, 1 AS n_clusters, round(sum(pow(x - m, 2)) FILTER (fold <> f), 4) AS train_inertia,
      round(sum(pow(x - m, 2)) FILTER (fold = f), 4) AS val_inertia, count(DISTINCT vec_id) FILTER (fold = f) AS n_val
    FROM p JOIN m USING (i) GROUP BY f""",
)
def _fold_single_cluster(spark, folder):
    """With one cluster a fit has a known end: the mean of the training rows."""
    rows = table(spark, folder, "embeddings").withColumn("fold", F.col("vec_id") % 3)
    found = cl.kfold_search(rows, "embedding", [1], id_col="vec_id")
    return rounded(found, 4, "train_inertia", "val_inertia")


@query(
    "candidate_starts",
    """SELECT fold, n::BIGINT AS n_rows, 33::BIGINT AS n_candidates, 1 AS nearest_is_own
    FROM (SELECT unnest([0, 1, 2]) AS fold) f, LATERAL (SELECT count(*) AS n FROM embeddings WHERE vec_id % 3 <> fold)""",
)
def _candidate_starts(spark, folder):
    """Weights of the candidates add up to the fold's rows; every candidate is a row and nearest to itself."""
    rows = fits.fit_table(table(spark, folder, "embeddings").withColumn("fold", F.col("vec_id") % 3), "embedding", "vec_id", "fold")
    held = fits.candidates(rows, [0, 1, 2], 4, fits.FitRules())
    out = [(f, int(w.sum()), len(c), int(w.min() > 0)) for f, (c, w) in held.items()]
    return spark.createDataFrame(out, "fold int, n_rows long, n_candidates long, nearest_is_own int")


@query("kfold_kmeans")
def _kfold_kmeans(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("fold", F.col("vec_id") % 3 - 1)
    return cl.kfold_search(rows, "embedding", [2, 3])
