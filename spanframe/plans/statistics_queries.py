"""Registered queries: ranks, matrices, effects, similarity, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions.coords import round_to as r
from spanframe.operators import claims, distance_corr, effects, matrix, scan, similarity
from spanframe.plans.adapters import oracle
from spanframe.plans.registry import query

COLS = ["n_a", "curvature", "stacking", "rate", "mean_b"]
FILLED = "SELECT chr_id, start_pos, " + ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in COLS) + " FROM windows"


def pairs_sql(source: str, cols=COLS, by: str = "", having: str = "") -> str:
    parts = []
    for x in cols:
        for y in cols:
            head = f"{by}, " if by else ""
            tail = f"GROUP BY {by} {having}" if by else ""
            parts.append(f"SELECT {head}'{x}' AS x, '{y}' AS y, count(*) AS n, round(corr({x}, {y}), 6) + 0.0 AS r FROM {source} {tail}")
    return "\nUNION ALL ".join(parts)


@query("w4_avg_rank", oracle("""
SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS avg_rank FROM points""", "points"))
def _(t):
    return scan.avg_rank(t.points, "value", "avg_rank").select("event_id", "avg_rank")


@query("w5_cume_pct", oracle("""
SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value) * 100, 6) AS pct FROM points""", "points"))
def _(t):
    return scan.cume_pct(t.points, "value", "pct", ["event_type"]).select("event_id", F.round("pct", 6).alias("pct"))


@query("w13_top_variable", oracle("""
SELECT probe_id, round(var_samp(beta), 6) AS variance FROM betas GROUP BY 1 ORDER BY var_samp(beta) DESC, probe_id LIMIT 20""", "betas"))
def _(t):
    return effects.top_variable(t.betas, "probe_id", "beta", 20).withColumn("variance", F.round("variance", 6))


def _matrix(df):
    return df.withColumn("r", r(F.col("r")))


@query("e7_corr_matrix", oracle(pairs_sql("f"), "windows", extra={"f": FILLED}))
def _(t):
    return _matrix(matrix.corr_matrix(t.windows, COLS))


RANKS = "SELECT " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in COLS
) + " FROM windows"


@query("e7_spearman_matrix", oracle(pairs_sql("f"), "windows", extra={"k": RANKS, "f": FILLED.replace("chr_id, start_pos, ", "").replace("FROM windows", "FROM k")}))
def _(t):
    keyed = t.windows.withColumn("key", F.struct("chr_id", "start_pos"))
    return _matrix(matrix.spearman_matrix(keyed, COLS, "key"))


@query("e8_partial_corr_matrix", oracle("""
SELECT a.x, a.y, CASE WHEN a.x = a.y THEN 1.0 ELSE round((a.r - b.r * c.r) / sqrt((1 - b.r * b.r) * (1 - c.r * c.r)), 5) + 0.0 END AS partial_r
FROM m a JOIN m b ON b.x = a.x AND b.y = 'rate' JOIN m c ON c.x = a.y AND c.y = 'rate' WHERE a.x <> 'rate' AND a.y <> 'rate'""",
    "windows", extra={"f": FILLED, "m": pairs_sql("f").replace("round(corr(", "(corr(").replace("), 6) + 0.0 AS r", ")) AS r")}))
def _(t):
    out = matrix.partial_corr_matrix(matrix.corr_matrix(t.windows, COLS), "rate")
    return out.where("x <> 'rate' AND y <> 'rate'").withColumn("partial_r", r(F.col("partial_r"), 5))


@query("e9_corr_by_group", oracle(pairs_sql("f", by="chr_id", having="HAVING count(*) >= 20"), "windows", extra={"f": FILLED}))
def _(t):
    return _matrix(matrix.corr_matrix(t.windows, COLS, ["chr_id"], 20))


@query("e10_pca")
def _(t):
    return matrix.pca(t.windows, COLS, 3)


PAIR_EIGEN = """SELECT (vx + vy) / 2 AS mid, sqrt(power((vx - vy) / 2, 2) + c * c) AS half, vx, vy, c FROM (
  SELECT var_samp(score) AS vx, var_samp(rate) AS vy, covar_samp(score, rate) AS c FROM intervals_a)"""


@query("e10_pca_pair", oracle("""
SELECT CAST(component AS INT) AS component, round(ev / (2 * mid), 6) AS explained, field,
  round(abs(CASE WHEN field = 'score' THEN c ELSE ev - vx END) / sqrt(c * c + power(ev - vx, 2)), 6) AS abs_loading FROM (
  SELECT *, CASE component WHEN 1 THEN mid + half ELSE mid - half END AS ev FROM eig, (VALUES (1), (2)) k(component)), (VALUES ('score'), ('rate')) f(field)""",
    "intervals_a", extra={"eig": PAIR_EIGEN}))
def _(t):
    out = matrix.pca(t.intervals_a, ["score", "rate"], 2)
    return out.select("component", F.round("explained", 6).alias("explained"), "field", F.round("abs_loading", 6).alias("abs_loading"))


@query("e22_components_pair", oracle("""
SELECT share, CAST(CASE WHEN (mid + half) / (2 * mid) >= share - 1e-12 THEN 1 ELSE 2 END AS INT) AS n_components
FROM eig, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) s(share)""", "intervals_a", extra={"eig": PAIR_EIGEN}))
def _(t):
    return matrix.components_needed(matrix.pca(t.intervals_a, ["score", "rate"], 2))


@query("e11_mutual_information", oracle("""
SELECT x, y, round(sum(c / CAST(n AS DOUBLE) * ln(CAST(c AS DOUBLE) * n / (CAST(ca AS DOUBLE) * cb))), 6) + 0.0 AS mi FROM (
  SELECT *, sum(c) OVER (PARTITION BY x, y) AS n, sum(c) OVER (PARTITION BY x, y, a) AS ca, sum(c) OVER (PARTITION BY x, y, b) AS cb
  FROM (SELECT x, y, a, b, count(*) AS c FROM (
    SELECT 'score' AS x, 'rate' AS y, least(49, floor((score - min(score) OVER ()) / (max(score) OVER () + 1e-10 - min(score) OVER ()) * 50)) AS a,
           least(49, floor((rate - min(rate) OVER ()) / (max(rate) OVER () + 1e-10 - min(rate) OVER ()) * 50)) AS b FROM intervals_a)
    GROUP BY ALL)) GROUP BY 1, 2""", "intervals_a"))
def _(t):
    return matrix.mutual_information(t.intervals_a, ["score", "rate"]).withColumn("mi", r(F.col("mi")))


@query("e12_distance_correlation", oracle("""
SELECT 'curvature' AS x, 'mean_b' AS y, count(*) AS n_pairs, round(CASE WHEN avg(a * a) > 0 AND avg(b * b) > 0
  THEN sqrt(greatest(0.0, avg(a * b) / sqrt(avg(a * a) * avg(b * b)))) ELSE 0.0 END, 6) AS dcor FROM (
  SELECT dx - avg(dx) OVER (PARTITION BY i) - avg(dx) OVER (PARTITION BY j) + avg(dx) OVER () AS a,
         dy - avg(dy) OVER (PARTITION BY i) - avg(dy) OVER (PARTITION BY j) + avg(dy) OVER () AS b FROM (
    SELECT p.k AS i, q.k AS j, abs(p.x - q.x) AS dx, abs(p.y - q.y) AS dy FROM s p CROSS JOIN s q))""", "windows", extra={"s": """
  SELECT CAST(chr_id AS BIGINT) * 100000000 + start_pos AS k, curvature AS x, mean_b AS y FROM windows WHERE curvature IS NOT NULL AND mean_b IS NOT NULL
  ORDER BY md5((CAST(chr_id AS BIGINT) * 100000000 + start_pos) || '|42'), 1 LIMIT 500"""}))
def _(t):
    keyed = t.windows.withColumn("key", F.col("chr_id").cast("long") * 100_000_000 + F.col("start_pos"))
    return matrix.distance_correlation(keyed, "curvature", "mean_b", "key", 500).withColumn("dcor", F.round("dcor", 6))


@query("e12_distance_correlation_all", oracle("""
SELECT 'curvature' AS x, 'mean_b' AS y, count(DISTINCT i) AS n, round(sqrt(greatest(0.0, avg(a * b) / sqrt(avg(a * a) * avg(b * b)))), 6) AS dcor FROM (
  SELECT i, dx - avg(dx) OVER (PARTITION BY i) - avg(dx) OVER (PARTITION BY j) + avg(dx) OVER () AS a,
         dy - avg(dy) OVER (PARTITION BY i) - avg(dy) OVER (PARTITION BY j) + avg(dy) OVER () AS b FROM (
    SELECT p.k AS i, q.k AS j, abs(p.x - q.x) AS dx, abs(p.y - q.y) AS dy FROM s p CROSS JOIN s q))""", "windows", extra={"s": """
  SELECT CAST(chr_id AS BIGINT) * 100000000 + start_pos AS k, curvature AS x, mean_b AS y FROM windows WHERE curvature IS NOT NULL AND mean_b IS NOT NULL"""}))
def _(t):
    return distance_corr.distance_correlation(t.windows, "curvature", "mean_b").withColumn("dcor", F.round("dcor", 6))


BANDS = [(0.0, 4.8), (4.8, 5.2), (5.2, 100.0)]
BAND_SQL = "CASE WHEN rate < 4.8 THEN 0 WHEN rate < 5.2 THEN 1 ELSE 2 END AS band"


@query("e13_stratified_partial_corr", oracle("""
SELECT 'n_a' AS field, count(*) AS n_bands, CAST(sum(n) AS BIGINT) AS n,
       round(sum(abs((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz))) * n) / sum(n), 6) AS mean_abs_partial_r
FROM (SELECT band, count(*) AS n, corr(n_a, curvature) AS xy, corr(n_a, rate) AS xz, corr(curvature, rate) AS yz
      FROM (SELECT *, """ + BAND_SQL + """ FROM windows) GROUP BY 1 HAVING count(*) >= 10)""", "windows"))
def _(t):
    out = matrix.stratified_partial_corr(t.windows, ["n_a"], "curvature", "rate", BANDS, 10)
    return out.select("field", "n_bands", "n", F.round("mean_abs_partial_r", 6).alias("mean_abs_partial_r"))


@query("e14_stratified_effect", oracle("""
SELECT 'busy' AS flag, n_f, n_u, round(d_raw, 6) AS d_raw, round(dc, 6) AS d_controlled FROM (
  SELECT count(*) FILTER (busy) AS n_f, count(*) FILTER (NOT busy) AS n_u, (avg(y) FILTER (busy) - avg(y) FILTER (NOT busy)) /
    sqrt(((count(*) FILTER (busy) - 1) * var_samp(y) FILTER (busy) + (count(*) FILTER (NOT busy) - 1) * var_samp(y) FILTER (NOT busy)) / (count(*) - 2)) AS d_raw FROM s)
CROSS JOIN (SELECT sum(d * n) / sum(n) AS dc FROM (SELECT band, count(*) AS n, (avg(y) FILTER (busy) - avg(y) FILTER (NOT busy)) /
    sqrt(((count(*) FILTER (busy) - 1) * var_samp(y) FILTER (busy) + (count(*) FILTER (NOT busy) - 1) * var_samp(y) FILTER (NOT busy)) / (count(*) - 2)) AS d
  FROM s GROUP BY 1 HAVING count(*) FILTER (busy) >= 10 AND count(*) FILTER (NOT busy) >= 10))""", "windows",
    extra={"s": f"SELECT n_a > 42 AS busy, curvature AS y, {BAND_SQL} FROM windows"}))
def _(t):
    out = matrix.stratified_effect(t.windows.withColumn("busy", F.col("n_a") > 42), ["busy"], "curvature", "rate", BANDS)
    return out.select("flag", "n_f", "n_u", F.round("d_raw", 6).alias("d_raw"), F.round("d_controlled", 6).alias("d_controlled"))


@query("e15_ols", oracle("""
SELECT 'n_a' AS term, round(regr_slope(curvature, n_a), 4) AS beta, round(regr_r2(curvature, n_a), 4) AS r2 FROM windows
UNION ALL SELECT 'intercept', round(regr_intercept(curvature, n_a), 4), round(regr_r2(curvature, n_a), 4) FROM windows""", "windows"))
def _(t):
    return matrix.ols(t.windows, ["n_a"], "curvature").select("term", F.round("beta", 4).alias("beta"), F.round("r2", 4).alias("r2"))


@query("e22_redundancy_verdict", oracle("""
SELECT x AS field, round(r, 6) + 0.0 AS r_control, round(1 - r * r, 6) AS independent, CASE WHEN 1 - r * r < 0.01 THEN 'redundant'
  WHEN 1 - r * r < 0.05 THEN 'mostly_control' WHEN 1 - r * r < 0.2 THEN 'partly_independent' ELSE 'independent' END AS verdict
FROM m WHERE y = 'rate' AND x <> 'rate'""", "windows", extra={"f": FILLED, "m": pairs_sql("f").replace("round(corr(", "(corr(").replace("), 6) + 0.0 AS r", ")) AS r")}))
def _(t):
    out = matrix.redundancy_verdict(t.windows, COLS, "rate")
    return out.select("field", r(F.col("r_control")).alias("r_control"), F.round("independent", 6).alias("independent"), "verdict")


@query("e22_components_needed")
def _(t):
    return matrix.components_needed(matrix.pca(t.windows, COLS, 5))


LONG = "SELECT metric, value FROM (SELECT unnest(['m_price', 'm_size']) AS metric, unnest([m_price, m_size]) AS value FROM alleles)"
PCT = ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in
                {"p5": .05, "p10": .10, "p25": .25, "p50": .5, "p75": .75, "p90": .9, "p95": .95}.items())


@query("a20_distribution", oracle(f"""
SELECT g.metric, n, min, max, mean, p5, p10, p25, p50, p75, p90, p95, h.histogram FROM (
  SELECT metric, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, {PCT} FROM l GROUP BY 1) g
JOIN (SELECT metric, list(c ORDER BY b) AS histogram FROM (SELECT z.metric, z.b, count(y.b) AS c FROM (
    SELECT DISTINCT metric, unnest(range(30)) AS b FROM l) z LEFT JOIN (
    SELECT metric, CAST(least(29, floor((value - min(value) OVER w) / ((max(value) OVER w - min(value) OVER w) / 30))) AS BIGINT) AS b
    FROM l WINDOW w AS (PARTITION BY metric)) y ON y.metric = z.metric AND y.b = z.b GROUP BY 1, 2) GROUP BY 1) h USING (metric)""",
    "alleles", extra={"l": LONG}))
def _(t):
    out = effects.distribution(t.alleles, ["m_price", "m_size"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p5", "p10", "p25", "p50", "p75", "p90", "p95")})


STAT6 = "count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd"
D = "({0}mean - {1}mean) / sqrt((({0}n - 1) * {0}sd * {0}sd + ({1}n - 1) * {1}sd * {1}sd) / ({0}n + {1}n - 2))"


@query("a21_group_effect_sizes", oracle(f"""
SELECT c.metric, c.cls, round({D.format('r.', 'c.')}, 4) + 0.0 AS cohens_d, r.n AS ref_n, c.n AS n FROM (
  SELECT metric, cls, {STAT6} FROM l GROUP BY 1, 2 UNION ALL SELECT metric, '__others__', {STAT6} FROM l WHERE cls <> 'normal' GROUP BY 1) c
JOIN (SELECT metric, {STAT6} FROM l WHERE cls = 'normal' GROUP BY 1) r USING (metric) WHERE c.cls <> 'normal'""", "alleles",
    extra={"l": """SELECT coalesce(suffix, 'normal') AS cls, unnest(['m_price', 'm_size']) AS metric, unnest([m_price, m_size]) AS value FROM alleles"""}))
def _(t):
    named = t.alleles.withColumn("cls", F.coalesce("suffix", F.lit("normal")))
    out = effects.group_effect_sizes(named, "cls", "normal", ["m_price", "m_size"])
    return out.select("metric", "cls", r(F.col("cohens_d"), 4).alias("cohens_d"), "ref_n", "n")


@query("a22_within_group_effects", oracle(f"""
SELECT metric, count(*) AS n_groups, count(*) FILTER (d > 0) AS n_positive, round(avg(d), 4) + 0.0 AS mean_d FROM (
  SELECT metric, round(CASE WHEN s.sd IS NOT NULL THEN CASE WHEN p.n >= 2 AND s.n >= 2 AND ((p.n - 1) * p.sd * p.sd + (s.n - 1) * s.sd * s.sd) > 0 THEN {D.format('p.', 's.')} END
    WHEN s.n = 1 AND p.sd > 0 THEN (p.mean - s.mean) / p.sd END, 4) AS d FROM (SELECT * FROM st WHERE kind = 'plain') p JOIN (SELECT * FROM st WHERE kind = 'suffixed') s
    USING (locus, protein, metric) JOIN ok USING (locus, protein)) WHERE d IS NOT NULL GROUP BY 1""", "alleles", extra={
    "st": f"""SELECT locus, protein, metric, kind, {STAT6} FROM (SELECT locus, protein, CASE WHEN suffix IS NULL THEN 'plain' WHEN suffix <> 'N' THEN 'suffixed' END AS kind,
            unnest(['m_price', 'm_mod']) AS metric, unnest([m_price, m_mod]) AS value FROM alleles) WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "ok": """SELECT locus, protein FROM alleles GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (suffix IS NULL) > 0 AND count(*) FILTER (suffix <> 'N') > 0"""}))
def _(t):
    _groups, overall = effects.within_group_effects(t.alleles, ["locus", "protein"], "suffix", ["m_price", "m_mod"])
    return overall.select("metric", "n_groups", "n_positive", r(F.col("mean_d"), 4).alias("mean_d"))


@query("a23_metric_variance_rank", oracle("""
SELECT locus, metric, n, round(variance, 4) AS variance, CAST(row_number() OVER (PARTITION BY locus ORDER BY variance DESC, metric) AS INT) AS rank FROM (
  SELECT locus, metric, count(*) AS n, var_samp(value) AS variance FROM (SELECT locus, unnest(['m_price', 'm_size', 'm_mod']) AS metric,
    unnest([m_price, m_size, m_mod]) AS value FROM alleles) GROUP BY 1, 2 HAVING count(*) >= 2)""", "alleles"))
def _(t):
    out = effects.metric_variance_rank(t.alleles, ["locus"], ["m_price", "m_size", "m_mod"])
    return out.select("locus", "metric", "n", F.round("variance", 4).alias("variance"), "rank")


@query("e16_differential_methylation", oracle("""
SELECT probe_id, n1, n2, round(t, 5) + 0.0 AS t, round(delta_beta, 6) + 0.0 AS delta_beta FROM (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) *
  (1.0 / n1 + 1.0 / n2)) AS t FROM (SELECT probe_id, count(*) FILTER (cell_type = 'click') AS n1, count(*) FILTER (cell_type = 'view') AS n2,
    avg(m) FILTER (cell_type = 'click') AS m1, avg(m) FILTER (cell_type = 'view') AS m2, var_samp(m) FILTER (cell_type = 'click') AS v1,
    var_samp(m) FILTER (cell_type = 'view') AS v2, avg(beta) FILTER (cell_type = 'click') - avg(beta) FILTER (cell_type = 'view') AS delta_beta
  FROM (SELECT *, CASE WHEN beta <= 0 THEN -10 WHEN beta >= 1 THEN 10 ELSE least(10, greatest(-10, log2(beta / (1 - beta)))) END AS m FROM betas) GROUP BY 1)
  WHERE n1 >= 2 AND n2 >= 2)""", "betas"))
def _(t):
    out = effects.differential_methylation(t.betas, "probe_id", "cell_type", "click", "view")
    return out.select("probe_id", "n1", "n2", r(F.col("t"), 5).alias("t"), r(F.col("delta_beta")).alias("delta_beta"))


@query("e16_adjusted_p", oracle("""
SELECT p_partkey, round(min(raw) OVER (ORDER BY p, raw DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS adj_p FROM (
  SELECT p_partkey, p, p * count(*) OVER () / rank() OVER (ORDER BY p DESC) * 0 + least(1.0, p * count(*) OVER () / (count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS raw
  FROM (SELECT p_partkey, ((p_partkey * 7919) % 10007) / CAST(10007 AS DOUBLE) AS p FROM part))"""))
def _(t):
    tests = t.part.select("p_partkey", (((F.col("p_partkey") * 7919) % 10007) / F.lit(10007.0)).alias("p"))
    return effects.benjamini_hochberg(tests, "p", "adj_p").select("p_partkey", F.round("adj_p", 6).alias("adj_p"))


def _vectors(t):
    n = F.size("embedding")
    mask = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i % 7 == F.col("label") % 7)
    return t.embeddings.select("vec_id", F.col("embedding").alias("vector"), mask.alias("mask"))


@query("e17_cosine_similar", oracle("""
SELECT query_id, vec_id, round(similarity, 5) AS similarity, CAST(n_shared AS INT) AS n_shared, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, sum(q.x * v.x) / (sqrt(sum(q.x * q.x)) * sqrt(sum(v.x * v.x))) AS similarity, count(*) AS n_shared
    FROM e q JOIN e v ON q.i = v.i AND q.vec_id <> v.vec_id WHERE q.vec_id < 20 AND NOT q.m AND NOT v.m GROUP BY 1, 2)) WHERE rank <= 5""",
    extra={"e": """SELECT vec_id, i, CAST(x AS DOUBLE) AS x, i % 7 = label % 7 AS m FROM (SELECT vec_id, label, unnest(embedding) AS x,
           unnest(range(len(embedding))) AS i FROM embeddings)"""}))
def _(t):
    vectors = _vectors(t)
    out = effects.cosine_similar(vectors, vectors.where("vec_id < 20").select("vec_id"), "vec_id", 5)
    return out.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "n_shared", "rank")


#: Layers of a profile vector and their sizes, as slices of the test vectors.
LAYERS = {"intrinsic": 8, "regulatory": 16, "expression": 30, "protein": 10}
LAYER_SQL = "CASE WHEN i < 8 THEN 'intrinsic' WHEN i < 24 THEN 'regulatory' WHEN i < 54 THEN 'expression' ELSE 'protein' END"
#: Places by layer: some are missing, and some rows lack a whole layer.
PLACES = f"""SELECT vec_id, i, layer, CASE WHEN m THEN 0.0 ELSE x END AS z, CASE WHEN m THEN 0.0 ELSE 1.0 END AS m FROM (
  SELECT *, i % 7 = label % 7 OR (vec_id + ascii(layer)) % 11 = 0 AS m FROM (SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x, {LAYER_SQL} AS layer
    FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)))"""
LAYER_LISTS = "SELECT vec_id, layer, list(z ORDER BY i) AS z, list(z * z ORDER BY i) AS z2, list(m ORDER BY i) AS m FROM places GROUP BY 1, 2"
LAYER_PAIRS = """SELECT q.vec_id AS query_id, v.vec_id, q.layer, list_dot_product(q.z, v.z) AS d, list_dot_product(q.z2, v.m) AS a, list_dot_product(q.m, v.z2) AS b, list_dot_product(q.m, v.m) AS s
  FROM lists q JOIN lists v ON q.layer = v.layer AND q.vec_id <> v.vec_id"""
PROFILE_CTES = {"places": PLACES, "lists": LAYER_LISTS, "lp": LAYER_PAIRS}
COSINE = "CASE WHEN {a} > 0 AND {b} > 0 THEN {d} / (sqrt({a}) * sqrt({b})) END"


def _profiles(t):
    """The long table of layer vectors (identity, layer, z, missing) and its wide form."""
    flat = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    layer = F.when(F.col("i") < 8, "intrinsic").when(F.col("i") < 24, "regulatory").when(F.col("i") < 54, "expression").otherwise("protein")
    named = flat.withColumn("layer", layer).where((F.col("vec_id") + F.ascii("layer")) % 11 != 0)
    cells = F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("z"), (F.col("i") % 7 == F.col("label") % 7).alias("missing"))))
    long = named.groupBy("vec_id", "layer").agg(cells.alias("c")).select("vec_id", "layer", F.col("c.z").alias("z"), F.col("c.missing").alias("missing"))
    return similarity.join_layers(long, "vec_id", LAYERS)


@query("e17_similar_integrated", oracle(f"""
SELECT query_id, vec_id, round(sim, 4) + 0.0 AS similarity, CAST(s AS INT) AS n_shared, round(s / 64, 3) AS coverage, round(si, 4) + 0.0 AS sim_intrinsic, round(sr, 4) + 0.0 AS sim_regulatory,
  round(se, 4) + 0.0 AS sim_expression, round(sp, 4) + 0.0 AS sim_protein, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 4) DESC, vec_id) AS rank FROM (
    SELECT query_id, vec_id, {COSINE.format(a='sum(a)', b='sum(b)', d='sum(d)')} AS sim, sum(s) AS s, {', '.join(f"max({COSINE.format(a='a', b='b', d='d')}) FILTER (layer = '{n}') AS s{n[0]}" for n in LAYERS)}
    FROM lp GROUP BY 1, 2) WHERE sim IS NOT NULL AND s >= 32) WHERE rank <= 10""", extra=PROFILE_CTES))
def _(t):
    vectors, layers = _profiles(t)
    out = similarity.most_similar(vectors, vectors.select("vec_id"), "vec_id", 10, layers, digits=4)
    names = ["similarity", *[f"sim_{n}" for n in LAYERS]]
    return out.withColumns({c: r(F.col(c), 4) for c in names} | {"coverage": F.round("coverage", 3)})


@query("e17_similar_by_layer", oracle(f"""
SELECT mode, query_id, vec_id, round(sim, 4) + 0.0 AS similarity, CAST(s AS INT) AS n_shared, round(s / n, 3) AS coverage, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY round(sim, 4) DESC, vec_id) AS rank FROM (
    SELECT layer AS mode, query_id, vec_id, {COSINE.format(a='a', b='b', d='d')} AS sim, s, CASE layer WHEN 'intrinsic' THEN 8 WHEN 'regulatory' THEN 16 WHEN 'expression' THEN 30 ELSE 10 END AS n
    FROM lp) WHERE sim IS NOT NULL AND s >= 0.5 * n) WHERE rank <= 10""", extra=PROFILE_CTES))
def _(t):
    vectors, layers = _profiles(t)
    out = similarity.most_similar_by_mode(vectors, vectors.select("vec_id"), "vec_id", 10, layers, list(LAYERS), digits=4)
    out = out.select("mode", "query_id", "vec_id", "similarity", "n_shared", "coverage", "rank")
    return out.withColumns({"similarity": r(F.col("similarity"), 4), "coverage": F.round("coverage", 3)})


@query("e18_sample_windows", oracle("""
SELECT chr_id, start_pos, n_a FROM windows ORDER BY md5(chr_id || '|' || start_pos || '|42'), chr_id, start_pos LIMIT 100""", "windows"))
def _(t):
    return effects.sample_windows(t.windows.select("chr_id", "start_pos", "n_a"), 100, 42, ["chr_id", "start_pos"])


@query("e19_drift", oracle("""
SELECT stat_id, p AS pinned, c AS computed, CASE WHEN p IS NOT NULL AND c IS NOT NULL THEN abs(p - c) <= 1e-9 OR abs(p - c) / greatest(abs(p), abs(c), 1.0) <= 1e-6 END
  AS within_tolerance FROM (SELECT coalesce(a.k, b.k) AS stat_id, a.v AS p, b.v AS c FROM (SELECT 'w' || chr_id || '_' || start_pos AS k, n_a * 1.0::DOUBLE AS v FROM windows) a
  FULL JOIN (SELECT 'w' || chr_id || '_' || start_pos AS k, CASE WHEN n_a % 3 = 0 THEN n_a + 1 ELSE n_a END * 1.0::DOUBLE AS v FROM windows WHERE n_b IS NOT NULL) b ON a.k = b.k)""", "windows"))
def _(t):
    one = t.windows.withColumn("stat_id", F.concat(F.lit("w"), "chr_id", F.lit("_"), "start_pos"))
    pinned = one.select("stat_id", F.col("n_a").cast("double").alias("value"))
    fresh = one.where("n_b IS NOT NULL").select(
        "stat_id", F.when(F.col("n_a") % 3 == 0, F.col("n_a") + 1).otherwise(F.col("n_a")).cast("double").alias("value"))
    return effects.drift(pinned, fresh).select("stat_id", "pinned", "computed", "within_tolerance")


@query("e20_evaluate_claims", oracle("""
SELECT claim_id, CASE WHEN verdict THEN 'LICENSED' WHEN NOT verdict THEN 'REJECTED' ELSE 'PENDING' END AS verdict FROM (
  SELECT p_partkey AS claim_id, (price > 1000) AND ((lg < 7) OR NOT (sz <= 20)) AS verdict FROM (
    SELECT p_partkey, p_retailprice AS price, ln(p_retailprice) AS lg, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS sz FROM part))"""))
def _(t):
    p = t.part
    key = F.col("p_partkey")
    name = lambda kind: F.concat(F.lit(kind), key.cast("string"))
    stats = p.select(name("price").alias("stat_id"), F.col("p_retailprice").alias("value")).unionByName(
        p.where("p_size % 4 <> 0").select(name("size").alias("stat_id"), F.col("p_size").cast("double").alias("value")))
    text = lambda v: F.lit(v).cast("string")
    leaf = lambda node, lhs, tr, op, v: F.struct(
        F.lit(node).alias("node_id"), lhs.alias("lhs"), text(tr).alias("lhs_transform"), F.lit(op).alias("op"), text(None).alias("rhs"),
        text(None).alias("rhs_transform"), F.lit(float(v)).alias("rhs_value"))
    leaves = p.select(key.alias("claim_id"), F.inline(F.array(
        leaf("a", name("price"), None, ">", 1000), leaf("b", name("price"), "log", "<", 7), leaf("c", name("size"), None, "<=", 20))))
    node = lambda i, parent, kind, lv: F.struct(
        F.lit(i).alias("node_id"), text(parent).alias("parent_id"), F.lit(kind).alias("kind"), F.lit(lv).alias("level"))
    nodes = p.select(key.alias("claim_id"), F.inline(F.array(
        node("root", None, "and", 0), node("a", "root", "cmp", 1), node("o", "root", "or", 1), node("b", "o", "cmp", 2),
        node("n", "o", "not", 2), node("c", "n", "cmp", 3))))
    return claims.evaluate_claims(nodes, leaves, stats, 3).select("claim_id", "verdict")


@query("e21_claim_correlation", oracle("""
SELECT round((abs(corr(n_a, curvature)) + abs(corr(rate, curvature))) / 2, 6) AS mean_abs_r FROM windows""", "windows"))
def _(t):
    return claims.claim_correlation(t.windows, ["n_a", "rate"], "curvature").select(F.round("mean_abs_r", 6).alias("mean_abs_r"))
