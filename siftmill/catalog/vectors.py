"""Vector operators: arithmetic, neighbours, densities, soft labels, projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftmill import settings
from siftmill.catalog import query
from siftmill.catalog import views as V
from siftmill.functions import vectors as fv
from siftmill.operators import knn, reduction, scoring

K = settings.NEIGHBOURS
RISK_CUT = 0.13
SAFE_CUT = 0.20
HEAT = 0.5


def ranked_sql(name: str, left: str, right: str, k: int = K, self_pairs: bool = True) -> str:
    """CTEs that end in `name(qid, rid, sim, rank, right columns)` over all pairs."""
    where = "" if self_pairs else "WHERE a.vec_id <> b.vec_id"
    return f"""{name}_p AS (SELECT a.vec_id AS qid, b.vec_id AS rid, b.label, b.binary_label,
  list_cosine_similarity(a.v, b.v) AS sim FROM {left} a, {right} b {where}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid)
  AS rank FROM {name}_p) WHERE rank <= {k})"""


@query(
    "v01_normalize",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) *
        CASE WHEN vec_id % 50 = 0 THEN 0 ELSE 3 END) AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s),
    u AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS u FROM n)
    SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm,
      round(u[1], 6) AS u1, round(u[2], 6) AS u2 FROM u""",
)
def v01_normalize(spark, d):
    scaled = F.transform(
        "embedding",
        lambda x: x.cast("double") * F.when(F.col("vec_id") % 50 == 0, 0).otherwise(3),
    )
    rows = V.table(spark, d, "embeddings").select("vec_id", scaled.alias("v"))
    unit = rows.select("vec_id", fv.normalise(F.col("v")).alias("u"))
    return unit.select(
        "vec_id", V.six(fv.norm(F.col("u"))).alias("norm"), V.six(F.col("u")[0]).alias("u1"),
        V.six(F.col("u")[1]).alias("u2"),
    )


@query(
    "v02_cosine",
    f"""WITH {V.VECTORS} SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS product,
      round(list_cosine_similarity(a.v, b.v), 6) AS cosine,
      round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance
    FROM vectors a JOIN vectors b ON a.vec_id + 1 = b.vec_id""",
)
def v02_cosine(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.join(after, "vec_id").select(
        "vec_id", V.six(fv.dot(a, b)).alias("product"), V.six(fv.cosine(a, b)).alias("cosine"),
        V.six(1 - fv.cosine(a, b)).alias("distance"),
    )


@query(
    "v03_knn_exact",
    f"""WITH {V.VECTORS}, {ranked_sql('near', 'vectors', 'vectors')}
    SELECT qid, rid, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM near""",
)
def v03_knn_exact(spark, d):
    rows = V.table(spark, d, "embeddings")
    near = knn.knn(rows, rows, K)
    return near.select("qid", "rid", "rank", V.six(F.col("sim")).alias("sim"))


@query("v04_knn_cells")
def v04_knn_cells(spark, d):
    rows = V.table(spark, d, "embeddings")
    pivots = knn.trained_pivots(rows, "embedding", 32)
    return knn.knn(rows, rows, K, pivots=pivots, nprobe=8)


@query(
    "v04_knn_sampled_cells",
    f"""WITH {V.VECTORS}, pivots AS (SELECT vec_id AS cell, v AS c FROM vectors
      ORDER BY md5('42:' || vec_id), vec_id LIMIT 24),
    away AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id
      ORDER BY list_cosine_similarity(v, c) DESC, cell) AS r FROM vectors, pivots),
    cand AS (SELECT q.vec_id AS qid, b.vec_id AS rid FROM away q JOIN away b ON q.cell = b.cell
      WHERE q.r <= 6 AND b.r = 1),
    sims AS (SELECT qid, rid, list_cosine_similarity(a.v, b.v) AS sim FROM cand
      JOIN vectors a ON qid = a.vec_id JOIN vectors b ON rid = b.vec_id)
    SELECT qid, rid, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS sim FROM (SELECT *,
      row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid) AS rank FROM sims) WHERE rank <= {K}""",
)
def v04_knn_sampled_cells(spark, d):
    rows = V.table(spark, d, "embeddings")
    pivots = knn.sampled_pivots(rows, "vec_id", "embedding", 24)
    near = knn.knn(rows, rows, K, pivots=pivots, nprobe=6)
    return near.select("qid", "rid", "rank", V.six(F.col("sim")).alias("sim"))


@query(
    "v05_self_density",
    f"""WITH {V.VECTORS}, {ranked_sql('near', 'vectors', 'vectors')}
    SELECT qid, round(avg(sim), 6) AS density FROM near GROUP BY qid""",
)
def v05_self_density(spark, d):
    made = knn.density(V.table(spark, d, "embeddings"), k=K)
    return made.select("qid", V.six(F.col("density")).alias("density"))


SIDES = """safe AS (SELECT * FROM vectors WHERE binary_label = 0),
risk AS (SELECT * FROM vectors WHERE binary_label = 1)"""


@query(
    "v06_cross_density",
    f"""WITH {V.VECTORS}, {SIDES}, {ranked_sql('near', 'safe', 'risk')},
    dens AS (SELECT qid, avg(sim) AS density FROM near GROUP BY qid)
    SELECT qid, round(density, 6) AS density,
      row_number() OVER (ORDER BY density DESC, qid) AS rank FROM dens""",
)
def v06_cross_density(spark, d):
    rows = V.vectors(spark, d)
    made = knn.hard_negatives(rows.where("binary_label = 0"), rows.where("binary_label = 1"), K)
    return made.select("qid", V.six(F.col("density")).alias("density"), "rank")


@query(
    "v07_density_filter",
    f"""WITH {V.VECTORS}, {SIDES}, {ranked_sql('near', 'risk', 'risk')}
    SELECT qid AS vec_id, round(avg(sim), 6) AS density FROM near GROUP BY qid
    HAVING avg(sim) > {RISK_CUT}""",
)
def v07_density_filter(spark, d):
    risk = V.vectors(spark, d).where("binary_label = 1").select("vec_id", "embedding")
    kept = knn.dense(risk, knn.density(risk, k=K), "vec_id", RISK_CUT)
    return kept.select("vec_id", V.six(F.col("density")).alias("density"))


@query(
    "v08_soft_labels",
    f"""WITH {V.VECTORS}, {ranked_sql('near', 'vectors', 'vectors')},
    w AS (SELECT qid, label, sum(exp(sim / {HEAT})) AS w FROM near GROUP BY qid, label)
    SELECT qid, label AS class_idx, round(w / sum(w) OVER (PARTITION BY qid), 6) AS p FROM w""",
)
def v08_soft_labels(spark, d):
    rows = V.table(spark, d, "embeddings")
    made = knn.soft_labels(rows, rows, K, HEAT, label="label")
    return made.select("qid", "class_idx", V.six(F.col("p")).alias("p"))


@query(
    "v09_idw_risk",
    f"""WITH {V.VECTORS}, {ranked_sql('near', 'vectors', 'vectors', 100, False)}
    SELECT qid, round(sum(binary_label / (1 - sim + 1e-6)) / sum(1 / (1 - sim + 1e-6)), 6) AS risk
    FROM near GROUP BY qid""",
)
def v09_idw_risk(spark, d):
    rows = V.vectors(spark, d)
    made = knn.risk_score(rows, rows, 100, exclude_self=True)
    return made.select("qid", V.six(F.col("risk")).alias("risk"))


@query("v10_pca")
def v10_pca(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    reduced = reduction.fit_pca(rows, "embedding", 10).apply(rows, "embedding")
    return reduced.select("vec_id", F.posexplode("reduced").alias("component", "value"))


@query(
    "v10_pca_energy",
    f"""WITH {V.VECTORS}, x AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(v) AS x FROM vectors),
    m AS (SELECT dim, avg(x) AS m FROM x GROUP BY dim)
    SELECT vec_id, round(sum((x - m) * (x - m)), 6) AS energy FROM x JOIN m ON x.dim = m.dim
    GROUP BY vec_id""",
)
def v10_pca_energy(spark, d):
    """Squared length of the projection plus that of what it leaves out: the components are
    orthonormal and centred exactly if this is the squared distance from the mean."""
    rows = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    reducer = reduction.fit_pca(rows, "embedding", 10)
    axes = reducer.model.pc.toArray()
    made = reducer.apply(rows, "embedding").withColumn(
        "back", scoring.linear_scores(F.col("reduced"), axes, np.array(reducer.mean))
    )
    left = F.zip_with(F.col("embedding").cast("array<double>"), F.col("back"), lambda x, b: x - b)
    return made.select(
        "vec_id", V.six(fv.dot(F.col("reduced"), F.col("reduced")) + fv.dot(left, left)).alias("energy")
    )


@query(
    "v11_standardize",
    f"""WITH {V.VECTORS}, x AS (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(v) AS x
      FROM vectors), m AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY dim)
    SELECT vec_id, CAST(x.dim AS INTEGER) AS dim, round((x - m) / s, 6) AS z
    FROM x JOIN m ON x.dim = m.dim""",
)
def v11_standardize(spark, d):
    rows = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    scaler = reduction.fit_scaler(rows, "embedding")
    long = rows.select("vec_id", F.posexplode(scaler.apply(F.col("embedding"))).alias("dim", "z"))
    return long.select("vec_id", "dim", V.six(F.col("z")).alias("z"))
