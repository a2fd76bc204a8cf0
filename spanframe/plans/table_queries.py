"""Registered queries: probes, genes, alleles, families, cells, catalog and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.coords import bin_start
from spanframe.functions.coords import round_to as r
from spanframe.operators import genes as gn
from spanframe.operators import probes as pb
from spanframe.operators import quality, reference, summary, topk
from spanframe.operators.overlap import KEYS
from spanframe.plans.adapters import oracle
from spanframe.plans.registry import query

# ---- probes -----------------------------------------------------------------------

FIRST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY chr_id, pos) AS rn FROM (
  SELECT DISTINCT probe_id, build, chr_id, pos FROM probes)) WHERE rn = 1"""
PLACED = """SELECT f.probe_id, f.chr_id, f.pos, w.n_a, w.curvature, w.rate FROM f LEFT JOIN windows w ON f.chr_id = w.chr_id
  AND w.start_pos = f.pos // 1000 * 1000"""


def places(t):
    return t.probes.select("probe_id", *KEYS, "pos").distinct()


@query("j3_attach_window", oracle("SELECT probe_id, chr_id, pos, n_a, round(curvature, 4) AS curvature FROM p", "probes", "windows",
                                  extra={"f": FIRST, "p": PLACED}))
def _(t):
    out = pb.attach_window(places(t), t.windows, ["probe_id"])
    return out.select("probe_id", "chr_id", "pos", "n_a", F.round("curvature", 4).alias("curvature"))


EDGES = """SELECT a.platform AS src_platform, a.probe_id AS src_probe_id, b.platform AS dst_platform, b.probe_id AS dst_probe_id, a.chr_id AS s_chr,
    a.pos AS s_pos, b.chr_id AS d_chr, b.pos AS d_pos, 'exact_id' AS method FROM byid a JOIN byid b ON a.probe_id = b.probe_id AND a.platform < b.platform
  UNION ALL SELECT a.platform, a.probe_id, b.platform, b.probe_id, a.chr_id, a.pos, b.chr_id, b.pos, 'coord_overlap' FROM bypl a JOIN byid b
  ON a.chr_id = b.chr_id AND a.pos = b.pos AND a.platform < b.platform AND a.probe_id <> b.probe_id"""
EDGE_CTES = {
    "byid": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, probe_id ORDER BY row_id DESC) AS rn FROM probes) WHERE rn = 1",
    "bypl": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY platform, chr_id, pos ORDER BY row_id DESC) AS rn FROM probes) WHERE rn = 1",
    "pairs": EDGES,
    "edges": """SELECT src_platform, src_probe_id, dst_platform, dst_probe_id, s_chr AS chr_id, s_pos AS pos, method FROM pairs
      UNION ALL SELECT dst_platform, dst_probe_id, src_platform, src_probe_id, d_chr, d_pos, method FROM pairs"""}


@query("j9_cross_map_ids", oracle("SELECT * FROM edges", "probes", extra=EDGE_CTES))
def _(t):
    return pb.cross_map(t.probes).drop("build", "confidence")


PRIORITY = "CASE method WHEN 'exact_id' THEN 0 WHEN 'coord_overlap' THEN 1 ELSE 2 END"


@query("j20_crossmap_of", oracle(f"""
SELECT src_probe_id, dst_platform, dst_probe_id, method FROM (SELECT *, row_number() OVER (PARTITION BY src_probe_id, dst_platform, dst_probe_id
  ORDER BY {PRIORITY}, src_platform, chr_id, pos) AS rn FROM edges) WHERE rn = 1""", "probes", extra=EDGE_CTES))
def _(t):
    out = pb.crossmap_of(t.probes.select("probe_id"), pb.cross_map(t.probes))
    return out.select("src_probe_id", "dst_platform", "dst_probe_id", "method")


@query("w2_dedup_by_priority", oracle(f"""
SELECT src_probe_id, dst_probe_id, method, src_platform FROM (SELECT *, row_number() OVER (PARTITION BY src_probe_id, dst_probe_id
  ORDER BY {PRIORITY}, src_platform || dst_platform || chr_id || ':' || pos) AS rn FROM edges) WHERE rn = 1""", "probes", extra=EDGE_CTES))
def _(t):
    edges = pb.cross_map(t.probes).withColumn("id", F.concat("src_platform", "dst_platform", "chr_id", F.lit(":"), "pos"))
    return topk.dedup_by_priority(edges, ["src_probe_id", "dst_probe_id"]).select("src_probe_id", "dst_probe_id", "method", "src_platform")


FAILS = """SELECT p.probe_id, p.row_id, CASE WHEN d.probe_id IS NOT NULL THEN 'detection' WHEN p.row_id % 11 = 0 THEN 'snp'
  WHEN p.chr_id IN (23, 24) THEN 'sex_chromosome' WHEN c.probe_id IS NOT NULL THEN 'cross_reactive' END AS reason
  FROM (SELECT probe_id, max(row_id) AS row_id, max(chr_id) AS chr_id FROM probes GROUP BY 1) p
  LEFT JOIN (SELECT DISTINCT probe_id FROM betas WHERE beta > 0.9) d USING (probe_id)
  LEFT JOIN (SELECT DISTINCT probe_id FROM probes WHERE coef < 0) c USING (probe_id)"""


@query("f15_filter_probes_qc", oracle("SELECT reason, count(*) AS n FROM fails WHERE reason IS NOT NULL GROUP BY 1", "probes", "betas",
                                      extra={"fails": FAILS}))
def _(t):
    base = t.probes.groupBy("probe_id").agg(F.max("row_id").alias("row_id"), F.max("chr_id").alias("chr_id"))
    detection = t.betas.select("probe_id", F.when(F.col("beta") > 0.9, 1.0).otherwise(0.0).alias("p_value"))
    _kept, removed = pb.filter_probes(base, detection, base.where("row_id % 11 = 0"), t.probes.where("coef < 0"))
    return removed


@query("f18_id_lookup_batch", oracle("""
SELECT probe_id, 'unresolved' AS status, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT probe_id FROM betas) b WHERE probe_id NOT IN (SELECT probe_id FROM probes)
UNION ALL SELECT probe_id, 'resolved', count(*) FROM probes WHERE probe_id IN (SELECT probe_id FROM betas) GROUP BY 1""", "probes", "betas"))
def _(t):
    found, missing = pb.id_lookup(t.betas, t.probes, "probe_id")
    hits = found.groupBy("probe_id").agg(F.lit("resolved").alias("status"), F.count(F.lit(1)).alias("n"))
    return missing.select("probe_id", F.lit("unresolved").alias("status"), F.lit(0).cast("long").alias("n")).unionByName(hits)


@query("f23_probe_repeat_lookup", oracle("""
SELECT platform, family, count(DISTINCT probe_id) AS n_probes FROM xr WHERE family IN ('A', 'R') GROUP BY 1, 2""", "probes",
    extra={"xr": "SELECT probe_id, platform, CASE row_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS family FROM probes"}))
def _(t):
    fam = F.when(F.col("row_id") % 3 == 0, "A").when(F.col("row_id") % 3 == 1, "N").otherwise("R")
    xref = t.probes.select("probe_id", "platform", fam.alias("family")).where(F.col("family").isin("A", "R"))
    return pb.platform_coverage(xref)


@query("a25_clock_summary", oracle("""
SELECT c.platform AS clock, count(*) AS n_probes, round(avg(curvature), 4) AS mean_curvature, round(stddev_samp(curvature), 4) AS sd_curvature,
  round(sum(abs(c.coef) * curvature) / sum(CASE WHEN curvature IS NOT NULL THEN abs(c.coef) END), 4) AS wmean_curvature
FROM probes c LEFT JOIN p USING (probe_id) GROUP BY 1""", "probes", "windows", extra={"f": FIRST, "p": PLACED}))
def _(t):
    clocks = t.probes.select(F.col("platform").alias("clock"), "probe_id", "coef")
    out = pb.clock_summary(clocks, places(t), t.windows, ["curvature"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean_curvature", "sd_curvature", "wmean_curvature")})


@query("a25_clock_contexts", oracle("""
SELECT platform AS clock, CASE row_id % 4 WHEN 0 THEN 'island' WHEN 1 THEN 'shore' WHEN 2 THEN 'open_sea' ELSE 'unknown' END AS context, count(*) AS n_probes
FROM probes GROUP BY 1, 2""", "probes"))
def _(t):
    context = F.expr("CASE row_id % 4 WHEN 0 THEN 'island' WHEN 1 THEN 'shore' WHEN 2 THEN 'open_sea' END")
    return pb.clock_contexts(t.probes.select(F.col("platform").alias("clock"), context.alias("cpg_context")))


@query("a26_clock_compare", oracle("""
SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS unique_a, count(*) FILTER (b AND NOT a) AS unique_b,
  round(count(*) FILTER (a AND b) / CAST(count(*) AS DOUBLE), 6) AS jaccard, round(avg(rate) FILTER (b) - avg(rate) FILTER (a), 6) + 0.0 AS delta_rate
FROM (SELECT probe_id, bool_or(platform = 'epic_v1') AS a, bool_or(platform = 'epic_v2') AS b FROM probes WHERE platform IN ('epic_v1', 'epic_v2') GROUP BY 1)
LEFT JOIN p USING (probe_id)""", "probes", "windows", extra={"f": FIRST, "p": PLACED}))
def _(t):
    values = pb.attach_window(places(t), t.windows, ["probe_id"]).select("probe_id", "rate")
    out = pb.clock_compare(t.probes.where("platform = 'epic_v1'"), t.probes.where("platform = 'epic_v2'"), values, ["rate"])
    return out.withColumns({"jaccard": F.round("jaccard", 6), "delta_rate": r(F.col("delta_rate"))})


@query("a27_clock_predict", oracle("""
SELECT sample, clock, round(10.0 + s, 4) + 0.0 AS age, n_used, round(n_used / CAST(n_total AS DOUBLE), 6) AS coverage,
  round(10.0 + s - 40, 4) + 0.0 AS acceleration FROM (SELECT sample, platform AS clock, sum(beta * coef) AS s, count(*) AS n_used FROM betas
  JOIN probes USING (probe_id) GROUP BY 1, 2) JOIN (SELECT platform AS clock, count(*) AS n_total FROM probes GROUP BY 1) USING (clock)""", "betas", "probes"))
def _(t):
    coefs = t.probes.select(F.col("platform").alias("clock"), "probe_id", "coef")
    intercepts = coefs.select("clock").distinct().withColumn("intercept", F.lit(10.0))
    ages = t.betas.select("sample").distinct().withColumn("chronological_age", F.lit(40.0))
    out = pb.clock_predict(t.betas.select("sample", "probe_id", "beta"), coefs, intercepts, ages)
    return out.select("sample", "clock", r(F.col("age"), 4).alias("age"), "n_used", F.round("coverage", 6).alias("coverage"),
                      r(F.col("acceleration"), 4).alias("acceleration"))


@query("a28_family_methylation_risk", oracle("""
SELECT sample, family, round(mb, 6) AS mean_beta, n AS n_probes, round(0.7 * greatest(0, (0.75 - mb) / 0.75), 3) AS risk, CASE
  WHEN round(0.7 * greatest(0, (0.75 - mb) / 0.75), 3) < 0.1 THEN 'low' WHEN round(0.7 * greatest(0, (0.75 - mb) / 0.75), 3) < 0.25 THEN 'moderate'
  WHEN round(0.7 * greatest(0, (0.75 - mb) / 0.75), 3) < 0.4 THEN 'elevated' ELSE 'high' END AS level FROM (
  SELECT sample, platform AS family, avg(beta) AS mb, count(*) AS n FROM betas JOIN probes USING (probe_id) GROUP BY 1, 2)""", "betas", "probes"))
def _(t):
    member = t.probes.select("probe_id", F.col("platform").alias("family"))
    families = member.select("family").distinct().withColumns({"ref_low": F.lit(0.5), "ref_high": F.lit(1.0), "score": F.lit(0.7)})
    out = pb.family_risk(t.betas.select("sample", "probe_id", "beta"), member, families)
    return out.select("sample", "family", F.round("mean_beta", 6).alias("mean_beta"), "n_probes", "risk", "level")


@query("t4_key_sets", oracle("""
SELECT probe_id, CASE WHEN a AND b THEN 'shared' WHEN a THEN 'only_a' ELSE 'only_b' END AS member FROM (SELECT probe_id,
  bool_or(platform = 'epic_v1') AS a, bool_or(platform = 'hm450') AS b FROM probes WHERE platform <> 'epic_v2' GROUP BY 1)""", "probes"))
def _(t):
    return pb.key_sets(t.probes.where("platform = 'epic_v1'"), t.probes.where("platform = 'hm450'"), "probe_id")


@query("a29_lead_variant", oracle("""
SELECT klass, chr_id, feature_id, score FROM (SELECT *, row_number() OVER (PARTITION BY klass, chr_id ORDER BY score, feature_id) AS rn FROM intervals_b) WHERE rn = 1""",
    "intervals_b"))
def _(t):
    return topk.lead_variant(t.intervals_b, ["klass", "chr_id"], "score", "feature_id").select("klass", "chr_id", "feature_id", "score")


# ---- genes ------------------------------------------------------------------------

ASKED = """SELECT gene_id, CASE size % 3 WHEN 0 THEN lower(symbol) WHEN 1 THEN concat('alias_', gene_id) ELSE 'nothing' END AS query FROM genes"""


def asked(t):
    text = F.when(F.col("size") % 3 == 0, F.lower("symbol")).when(F.col("size") % 3 == 1, F.concat(F.lit("alias_"), "gene_id"))
    return t.genes.select("gene_id", F.coalesce(text, F.lit("nothing")).alias("query"))


def aliases(t):
    return t.genes.select(F.concat(F.lit("ALIAS_"), "gene_id").alias("alias"), F.col("symbol").alias("canonical"))


@query("j10_resolve_symbols", oracle("""
SELECT q.gene_id, q.query, CASE WHEN query <> 'nothing' THEN g.symbol END AS resolved, CASE WHEN query LIKE 'alias%' THEN 'alias'
  WHEN query <> 'nothing' THEN 'symbol' END AS matched_by FROM q JOIN genes g USING (gene_id)""", "genes", extra={"q": ASKED}))
def _(t):
    return gn.resolve_symbols(asked(t), t.genes, aliases(t))


@query("f16_gene_lookup", oracle("""
SELECT q.query, CASE WHEN query <> 'nothing' THEN g.symbol END AS symbol, CASE WHEN query <> 'nothing' THEN g.start_pos END AS start_pos
FROM q JOIN genes g USING (gene_id)""", "genes", extra={"q": ASKED}))
def _(t):
    out = gn.gene_lookup(asked(t).select("query", F.col("gene_id").alias("_row")), t.genes, aliases(t))
    return out.select("query", "symbol", "start_pos")


@query("f17_prefix_search", oracle("""
SELECT symbol, 'symbol' AS matched_by FROM genes WHERE starts_with(symbol, 'RED') ORDER BY symbol LIMIT 20""", "genes"))
def _(t):
    return gn.prefix_search(t.genes, aliases(t), "red", 20)


@query("j11_attach_gene_coordinates", oracle("""
SELECT x.gene_id, x.tissue, x.tpm, g.chr_id, g.start_pos, g.end_pos, g.symbol FROM gene_tpm x JOIN genes g ON x.gene_id = split_part(g.gene_id, '.', 1)""",
    "genes", "gene_tpm"))
def _(t):
    return gn.attach_gene_coordinates(t.gene_tpm, t.genes).drop("build")


@query("f20_gene_report", oracle("""
SELECT g.symbol, x.tissue, x.tpm FROM gene_tpm x JOIN genes g ON x.gene_id = split_part(g.gene_id, '.', 1) WHERE g.klass = 'Brand#7'""", "genes", "gene_tpm"))
def _(t):
    table = gn.attach_gene_coordinates(t.gene_tpm, t.genes).select("symbol", "tissue", "tpm")
    return gn.gene_report(t.genes.where("klass = 'Brand#7'"), table, order=[F.col("tpm").desc(), "tissue"])


def _reports(t):
    """Gene tables of other kinds, keyed by symbol: constraint, cost, pathways, sets, abundance by organ, atlas."""
    g = t.genes
    some = lambda **c: g.select("symbol", *[F.expr(e).alias(n) for n, e in c.items()])
    return {
        "constraint": some(name="'loeuf'", value="CAST(size AS DOUBLE) / 8"), "cost": some(name="'ecpa'", value="price"),
        "pathways": some(name="explode(array(concat('P', size), concat('Q', size % 3)))", value="CAST(NULL AS DOUBLE)"), "sets": some(name="klass", value="CAST(NULL AS DOUBLE)"),
        "abundance": attach_report(t), "atlas": some(name="explode(array('nucleus', 'cytosol'))", value="CAST(size % 4 AS DOUBLE)"),
    }


def attach_report(t):
    return gn.attach_gene_coordinates(t.gene_tpm, t.genes).select("symbol", F.col("tissue").alias("name"), F.col("tpm").alias("value"))


@query("f20_gene_reports", oracle("""
SELECT kind, symbol, name, value FROM (
  SELECT 'constraint' AS kind, symbol, 'loeuf' AS name, CAST(size AS DOUBLE) / 8 AS value FROM g UNION ALL SELECT 'cost', symbol, 'ecpa', price FROM g
  UNION ALL SELECT 'pathways', symbol, unnest(['P' || size, 'Q' || (size % 3)]), NULL FROM g UNION ALL SELECT 'sets', symbol, klass, NULL FROM g
  UNION ALL SELECT 'abundance', symbol, x.tissue, x.tpm FROM g JOIN gene_tpm x ON x.gene_id = split_part(g.gene_id, '.', 1)
  UNION ALL SELECT 'atlas', symbol, unnest(['nucleus', 'cytosol']), CAST(size % 4 AS DOUBLE) FROM g)""", "genes", "gene_tpm", extra={"g": "SELECT * FROM genes WHERE klass = 'Brand#7'"}))
def _(t):
    asked, out = t.genes.where("klass = 'Brand#7'"), None
    for kind, table in _reports(t).items():
        part = gn.gene_report(asked, table, order=[F.col("value").desc_nulls_last(), "name"]).select(F.lit(kind).alias("kind"), "symbol", "name", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("a31_tissue_specificity", oracle("""
SELECT gene_id, round(CASE WHEN max(tpm) > 0 THEN (count(*) - sum(tpm) / max(tpm)) / (count(*) - 1) END, 6) + 0.0 AS tau,
  round(log2(quantile_cont(tpm, 0.5) + 1), 6) AS log_median_tpm, round(log2(list_avg(list_sort(list(tpm), 'DESC')[1:3]) + 1), 6) AS log_robust_max_tpm,
  count(*) FILTER (tpm > 1) AS n_tissues_detected FROM gene_tpm GROUP BY 1 HAVING count(*) >= 2""", "gene_tpm"))
def _(t):
    out = gn.tissue_specificity(t.gene_tpm)
    return out.select("gene_id", *[r(F.col(c)).alias(c) for c in ("tau", "log_median_tpm", "log_robust_max_tpm")], "n_tissues_detected")


@query("a32_metabolic_burden", oracle("""
SELECT split_part(g.gene_id, '.', 1) AS gene_id, x.tissue, round(g.price * g.size * x.tpm * ln(2) / CASE WHEN g.size % 2 = 0 THEN 10.0 + g.size ELSE 46.0 END, 3) AS burden
FROM genes g JOIN gene_tpm x ON x.gene_id = split_part(g.gene_id, '.', 1)""", "genes", "gene_tpm"))
def _(t):
    costs = t.genes.select(gn.unversioned(F.col("gene_id")).alias("gene_id"), "symbol", F.col("price").alias("ecpa"), F.col("size").alias("length"))
    lives = t.genes.where("size % 2 = 0").select("symbol", (F.col("size") + 10.0).alias("half_life"))
    return gn.metabolic_burden(costs, lives, t.gene_tpm).withColumn("burden", F.round("burden", 3))


@query("a33_intrinsic_profile", oracle("""
SELECT g.gene_id, round(avg(w.curvature), 4) AS mean_curvature FROM genes g LEFT JOIN windows w ON g.chr_id = w.chr_id AND w.start_pos < g.end_pos
AND w.end_pos > g.start_pos GROUP BY 1""", "genes", "windows"))
def _(t):
    out = gn.intrinsic_profile(t.genes, t.windows, "curvature", [8192])
    return out.withColumn("mean_curvature", F.round("mean_curvature", 4))


ZS = """SELECT gene_id, tissue AS dimension, tpm, (tpm - avg(tpm) OVER w) / CASE WHEN stddev_samp(tpm) OVER w > 0 THEN stddev_samp(tpm) OVER w ELSE 1 END AS z,
  cume_dist() OVER (PARTITION BY tissue ORDER BY tpm) * 100 AS pct FROM gene_tpm WINDOW w AS (PARTITION BY tissue)"""


@query("a33_intrinsic_layer", oracle("""
SELECT g.gene_id, CASE WHEN g.size % 3 > 0 THEN CAST(g.size AS DOUBLE) / 8 END AS loeuf, CASE WHEN g.size % 3 > 0 THEN CAST(-g.size AS DOUBLE) END AS mis_z, round(m.v, 6) AS gc_body,
  round(log2((g.end_pos - g.start_pos) / 1000.0), 6) AS gene_length_log_kb
FROM genes g LEFT JOIN (SELECT k.gene_id, avg(w.curvature) AS v FROM genes k JOIN windows w ON k.chr_id = w.chr_id AND k.start_pos < w.end_pos AND w.start_pos < k.end_pos GROUP BY 1) m
  ON m.gene_id = g.gene_id""", "genes", "windows"))
def _(t):
    constraint = t.genes.where("size % 3 > 0").select(F.lower("symbol").alias("symbol"), (F.col("size") / 8.0).alias("loeuf"), (-F.col("size")).cast("double").alias("mis_z"))
    windows = t.windows.select(*KEYS, "start_pos", "end_pos", F.col("curvature").alias("gc"))
    out = gn.intrinsic_layer(t.genes, windows, constraint, "gc", [8192])
    return out.withColumns({"gc_body": F.round("gc_body", 6), "gene_length_log_kb": F.round("gene_length_log_kb", 6)})


@query("a33_protein_profile", oracle("""
SELECT g.gene_id, round(log2(m.v + 1), 6) AS log_max_ppm, CASE WHEN g.size % 4 > 0 THEN CAST(g.size AS DOUBLE) / 64 + CASE WHEN g.size % 2 = 0 THEN 0.25 ELSE 0.0 END END AS frac_expensive_aa,
  CASE WHEN g.size % 4 > 0 THEN g.price END AS ecpa_b20
FROM genes g LEFT JOIN (SELECT gene_id, max(tpm) AS v FROM gene_tpm GROUP BY 1) m ON m.gene_id = split_part(g.gene_id, '.', 1)""", "genes", "gene_tpm"))
def _(t):
    abundance = gn.attach_gene_coordinates(t.gene_tpm, t.genes).select(F.lower("symbol").alias("symbol"), F.col("tpm").alias("abundance_ppm"))
    costs = t.genes.where("size % 4 > 0").select(
        "symbol", (F.col("size") / 64.0).alias("frac_expensive"), F.when(F.col("size") % 2 == 0, 0.25).alias("frac_very_expensive"), F.col("price").alias("ecpa_b20"))
    return gn.protein_profile(t.genes, abundance, costs).withColumn("log_max_ppm", F.round("log_max_ppm", 6))


def long_profile(t):
    return gn.profile_long(t.gene_tpm.select("gene_id", F.col("tissue").alias("dimension"), F.col("tpm").alias("value")))


@query("a34_profile_long", oracle("SELECT gene_id, dimension, round(z, 6) + 0.0 AS z, round(pct, 6) AS percentile FROM zs", "gene_tpm", extra={"zs": ZS}))
def _(t):
    return long_profile(t).select("gene_id", "dimension", r(F.col("z")).alias("z"), F.round("percentile", 6).alias("percentile"))


@query("a34_profile_vectors", oracle("""
SELECT gene_id, round(sqrt(sum(z * z)), 5) AS norm, CAST(count(*) AS INT) AS n_present FROM zs GROUP BY 1""", "gene_tpm", extra={"zs": ZS}))
def _(t):
    values = t.gene_tpm.select("gene_id", F.col("tissue").alias("dimension"), F.col("tpm").alias("value"))
    out = gn.profile_vectors(values, [f"t{i}" for i in range(1, 8)])
    return out.select("gene_id", F.round("norm", 5).alias("norm"), "n_present")


@query("a35_tail_anomalies", oracle("""
SELECT gene_id, dimension, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS direction FROM zs WHERE abs(z) > 1.6""", "gene_tpm", extra={"zs": ZS}))
def _(t):
    return gn.tail_anomalies(long_profile(t), 1.6).select("gene_id", "dimension", "direction")


@query("j19_gene_profile_report", oracle("""
SELECT g.symbol, count(z.dimension) AS n_present, count(*) FILTER (abs(z.z) > 1.6) AS n_high FROM genes g LEFT JOIN zs z
ON z.gene_id = split_part(g.gene_id, '.', 1) GROUP BY 1""", "genes", "gene_tpm", extra={"zs": ZS}))
def _(t):
    values = t.gene_tpm.select("gene_id", F.col("tissue").alias("dimension"), F.col("tpm").alias("value"))
    vectors = gn.profile_vectors(values, [f"t{i}" for i in range(1, 8)])
    named = t.genes.withColumn("gene_id", gn.unversioned(F.col("gene_id")))
    long = long_profile(t).withColumn("z", F.col("z") * (2.0 / 1.6))
    out = gn.gene_profile_report(named, vectors, long)
    return out.select("symbol", F.coalesce("n_present", F.lit(0)).cast("long").alias("n_present"),
                      F.when(F.col("anomalies").isNull(), 0).otherwise(F.size("anomalies")).cast("long").alias("n_high"))


SITE = """SELECT p.event_id, n.symbol AS nearest_gene, n.distance, (SELECT count(*) FROM genes g WHERE g.chr_id = p.chr_id AND p.pos >= g.start_pos AND p.pos < g.end_pos) AS n_genes,
  (SELECT count(*) FROM intervals_b g WHERE g.chr_id = p.chr_id AND p.pos >= g.start_pos AND p.pos < g.end_pos) AS n_elements, w.n_a
FROM points p LEFT JOIN nn n ON n.event_id = p.event_id LEFT JOIN windows w ON w.chr_id = p.chr_id AND w.start_pos = p.pos // 1000 * 1000"""
NN = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY distance, start_pos, end_pos, symbol) AS rn FROM (
  SELECT p.event_id, g.symbol, g.start_pos, g.end_pos, abs(g.start_pos - p.pos) AS distance FROM points p JOIN genes g
  ON p.chr_id = g.chr_id AND g.start_pos < p.pos + 100000 AND g.end_pos > p.pos - 100000)) WHERE rn = 1"""


@query("j18_site_profile", oracle(SITE, "points", "genes", "intervals_b", "windows", extra={"nn": NN}))
def _(t):
    out = gn.site_profile(t.points, "event_id", t.genes, t.intervals_b, t.windows.select(*KEYS, "start_pos", "end_pos", "n_a"), [512])
    return out.select("event_id", "nearest_gene", "distance", "n_genes", "n_elements", "n_a")


NEAR_ISLAND = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(start_pos - pos), start_pos, end_pos) AS rn FROM (
  SELECT p.event_id, p.pos, d.start_pos, d.end_pos FROM points p JOIN domains d ON p.chr_id = d.chr_id AND d.start_pos < p.pos + 4001 AND d.end_pos > p.pos - 4001)) WHERE rn = 1"""
CONTEXT = """SELECT event_id, CASE WHEN pos >= start_pos AND pos < end_pos THEN 'island' WHEN pos < start_pos THEN CASE WHEN start_pos - pos <= 2000 THEN 'n_shore'
  WHEN start_pos - pos <= 4000 THEN 'n_shelf' ELSE 'open_sea' END WHEN pos - end_pos + 1 <= 2000 THEN 's_shore' WHEN pos - end_pos + 1 <= 4000 THEN 's_shelf' ELSE 'open_sea' END AS context FROM island"""
STATES = """SELECT event_id, string_agg(state || ':' || epigenome, ',' ORDER BY state, epigenome) AS chromatin FROM (SELECT DISTINCT p.event_id, a.klass AS state, a.strand AS epigenome
  FROM points p JOIN intervals_a a ON p.chr_id = a.chr_id AND a.start_pos <= p.pos AND p.pos < a.end_pos) GROUP BY 1"""
OVER = """SELECT p.event_id, min(g.symbol) AS first_gene FROM points p JOIN genes g ON p.chr_id = g.chr_id AND p.pos >= g.start_pos AND p.pos < g.end_pos GROUP BY 1"""


@query("j18_site_layers", oracle("""
SELECT event_id, context, chromatin, conserved, gene_evidence, loeuf, max_tpm, lp_bare, round((CAST(50 AS DOUBLE) - lp_bare) / lp_bare * 100, 1) AS delta_lp_pct FROM (
  SELECT p.event_id, coalesce(c.context, 'open_sea') AS context, s.chromatin, CAST(w.n_b AS BIGINT) AS conserved, CASE WHEN o.first_gene IS NOT NULL THEN 'overlap' WHEN n.symbol IS NOT NULL THEN 'nearest' END AS gene_evidence,
    CASE WHEN g.size % 3 > 0 THEN CAST(g.size AS DOUBLE) / 8 END AS loeuf, CASE WHEN g.size % 4 > 0 THEN g.price END AS max_tpm,
    CASE WHEN w.n_a IS NOT NULL THEN round(CAST(49.0 AS DOUBLE) + CAST(43.75 AS DOUBLE) * (least(w.n_a, 64) / CAST(64 AS DOUBLE) - CAST(0.30 AS DOUBLE)), 1) END AS lp_bare
  FROM points p LEFT JOIN ctx c ON c.event_id = p.event_id LEFT JOIN states s ON s.event_id = p.event_id LEFT JOIN ov o ON o.event_id = p.event_id LEFT JOIN nn n ON n.event_id = p.event_id
  LEFT JOIN windows w ON w.chr_id = p.chr_id AND w.start_pos = p.pos // 1000 * 1000 LEFT JOIN genes g ON g.symbol = coalesce(o.first_gene, n.symbol))""",
    "points", "genes", "intervals_a", "domains", "windows", extra={"nn": NN, "island": NEAR_ISLAND, "ctx": CONTEXT, "states": STATES, "ov": OVER}))
def _(t):
    gc = t.windows.select(*KEYS, "start_pos", "end_pos", (F.least("n_a", F.lit(64)) / 64.0).alias("gc"))
    profile = gn.site_profile(t.points, "event_id", t.genes, t.intervals_b, gc, [512])
    out = gn.site_layers(
        profile, "event_id", t.domains, t.intervals_a.select(*KEYS, "start_pos", "end_pos", F.col("klass").alias("state"), F.col("strand").alias("epigenome")),
        t.windows.select(*KEYS, "start_pos", "end_pos", F.col("n_b").alias("conserved")),
        t.genes.where("size % 3 > 0").select(F.lower("symbol").alias("symbol"), (F.col("size") / 8.0).alias("loeuf")),
        t.genes.where("size % 4 > 0").select("symbol", F.col("price").alias("max_tpm")))
    states = F.array_join(F.transform("chromatin", lambda s: F.concat_ws(":", s["state"], s["epigenome"])), ",")
    return out.select("event_id", "context", states.alias("chromatin"), "conserved", "gene_evidence", "loeuf", "max_tpm", "lp_bare", "delta_lp_pct")


@query("j17_variant_cross_reference", oracle("""
SELECT p.event_id AS variant_id, w.n_a, w.n_b AS conserved, coalesce(k.n, 0) AS n_known, e.elements FROM points p LEFT JOIN windows w ON w.chr_id = p.chr_id AND w.start_pos = p.pos // 1000 * 1000
LEFT JOIN (SELECT p.event_id, count(*) AS n FROM points p JOIN probes b ON p.chr_id = b.chr_id AND p.pos = b.pos GROUP BY 1) k USING (event_id)
LEFT JOIN (SELECT event_id, list(feature_id ORDER BY rn) AS elements FROM (SELECT p.event_id, b.feature_id, row_number() OVER (PARTITION BY p.event_id ORDER BY b.start_pos, b.feature_id) AS rn
  FROM points p JOIN intervals_b b ON p.chr_id = b.chr_id AND p.pos >= b.start_pos AND p.pos < b.end_pos) GROUP BY 1) e USING (event_id)""",
    "points", "windows", "probes", "intervals_b"))
def _(t):
    out = gn.variant_cross_reference(
        t.points.withColumnRenamed("event_id", "variant_id"), t.windows.select(*KEYS, "start_pos", "end_pos", "n_a"),
        t.probes.withColumnRenamed("platform", "label"), t.intervals_b.withColumnRenamed("feature_id", "element_id"), [512],
        conservation=t.windows.select(*KEYS, "start_pos", "end_pos", F.col("n_b").alias("conserved")))
    return out.select("variant_id", "n_a", "conserved", "n_known", "elements")


# ---- families, alleles, cells --------------------------------------------------------

REPEATS = """SELECT 'b1' AS build, chr_id, start_pos, end_pos, CASE klass WHEN 'A' THEN 'LINE' WHEN 'N' THEN 'SINE' ELSE 'LTR' END AS repeat_class,
  concat('ERV', CAST(feature_id % 5 AS STRING)) AS repeat_family, rate * 4 AS divergence_pct FROM intervals_a"""


def repeats(t):
    return t.spark.sql(REPEATS.replace("FROM intervals_a", "FROM {a}"), a=t.intervals_a)


FAMILY = """SELECT repeat_class, repeat_family, count(*) AS copy_count, CAST(sum(end_pos - start_pos) AS BIGINT) AS total_bp, round(avg(divergence_pct), 2) AS avg_divergence,
  quantile_cont(CAST(end_pos - start_pos AS DOUBLE), 0.5) AS median_length FROM rp GROUP BY 1, 2"""


@query("a15_family_summary", oracle(FAMILY, "intervals_a", extra={"rp": REPEATS}))
def _(t):
    return summary.family_summary(repeats(t))


XREF = """SELECT probe_id, platform, CASE WHEN row_id % 2 = 0 THEN 'LINE' ELSE 'LTR' END AS repeat_class, concat('ERV', CAST(row_id % 5 AS STRING)) AS repeat_family FROM probes"""
COUNTS = """SELECT repeat_class, repeat_family, count(*) FILTER (platform = 'epic_v1') AS epic_v1_probes, count(*) FILTER (platform = 'hm450') AS hm450_probes
  FROM xr GROUP BY 1, 2"""


def xref(t):
    return t.spark.sql(XREF.replace("FROM probes", "FROM {p}"), p=t.probes)


@query("a16_family_probe_counts", oracle(COUNTS, "probes", extra={"xr": XREF}))
def _(t):
    return summary.family_probe_counts(xref(t), ["epic_v1", "hm450"])


@query("a17_family_chr_density", oracle("""
SELECT repeat_class, repeat_family, chr_id, round(sum(end_pos - start_pos) / CAST(max(2000000 + chr_id * 1000) AS DOUBLE) * 1000, 3) AS density FROM rp GROUP BY 1, 2, 3""",
    "intervals_a", extra={"rp": REPEATS}))
def _(t):
    sizes = reference.chromosomes(t.spark).select("chr_id", (F.col("chr_id") * 1000 + 2_000_000).alias("length"))
    return summary.family_chr_density(repeats(t), sizes)


@query("a18_family_scores", oracle("""
SELECT f.repeat_class, f.repeat_family, coalesce(epic_v1_probes, 0) AS epic_v1_probes, round(least(1.0, b * (0.5 + 0.5 * greatest(0.0, 1 - avg_divergence / 40.0))), 3) AS reactivation_score,
  CASE f.repeat_class WHEN 'LTR' THEN 'mixed' ELSE 'methylation' END AS silencing, CASE f.repeat_class WHEN 'LTR' THEN ['aging', 'dnmti', 'tet2_lof', 'setdb1_lof']
  WHEN 'LINE' THEN ['aging', 'dnmti'] ELSE ['aging'] END AS contexts
FROM (SELECT *, CASE repeat_class WHEN 'LTR' THEN 0.7 WHEN 'LINE' THEN 0.5 ELSE 0.3 END AS b FROM fm) f LEFT JOIN ct USING (repeat_class, repeat_family)""",
    "intervals_a", "probes", extra={"rp": REPEATS, "fm": FAMILY, "xr": XREF, "ct": COUNTS}))
def _(t):
    out = summary.family_scores(summary.family_summary(repeats(t)), summary.family_probe_counts(xref(t), ["epic_v1", "hm450"]))
    return out.select("repeat_class", "repeat_family", "epic_v1_probes", "reactivation_score", "silencing", "contexts")


@query("a30_loci_from_fragments", oracle("""
SELECT chr_id, CAST(feature_id % 100 AS BIGINT) AS locus, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_fragments, max(end_pos) - min(start_pos) AS locus_length
FROM intervals_a GROUP BY 1, 2""", "intervals_a"))
def _(t):
    return summary.loci_from_fragments(t.intervals_a.withColumn("locus", F.col("feature_id") % 100)).drop("build")


@query("a19_locus_summary", oracle("""
SELECT locus, count(*) AS n_alleles, count(*) FILTER (has_genomic) AS n_genomic, count(suffix) AS n_suffixed, count(DISTINCT protein) AS n_proteins,
  round(avg(m_price) FILTER (has_genomic), 6) AS mean_m_price FROM alleles GROUP BY 1""", "alleles"))
def _(t):
    return summary.locus_summary(t.alleles, ["m_price"]).withColumn("mean_m_price", F.round("mean_m_price", 6))


@query("f22_allele_list", oracle("""
SELECT allele_name, locus FROM alleles WHERE locus = 'ECONOMY' ORDER BY allele_name LIMIT 15 OFFSET 5""", "alleles"))
def _(t):
    return summary.allele_list(t.alleles, {"locus": "ECONOMY"}, 15, 5).select("allele_name", "locus")


CASES = """SELECT allele_id // 4 AS case_id, 'L' AS locus, CASE WHEN allele_id % 4 < 2 THEN 'donor' ELSE 'recipient' END AS role, allele_id, allele_group, protein, m_size, m_mod FROM alleles"""


@query("a24_match_score", oracle("""
SELECT d.case_id, round(avg(abs(d.m_size - c.m_size)) + avg(abs(d.m_mod - c.m_mod)), 6) AS divergence,
  list_sort(list_distinct(list(d.allele_group || ':' || d.protein))) = list_sort(list_distinct(list(c.allele_group || ':' || c.protein))) AS protein_match
FROM cs d JOIN cs c ON d.case_id = c.case_id AND d.role = 'donor' AND c.role = 'recipient' GROUP BY 1""", "alleles", extra={"cs": CASES}))
def _(t):
    pairs = t.alleles.select(F.floor(F.col("allele_id") / 4).alias("case_id"), F.lit("L").alias("locus"),
                             F.when(F.col("allele_id") % 4 < 2, "donor").otherwise("recipient").alias("role"), "allele_id")
    out = summary.match_score(pairs, t.alleles, ["m_size", "m_mod"])
    return out.select("case_id", F.round("divergence", 6).alias("divergence"), "protein_match")


@query("a24_pair_delta", oracle("""
SELECT r.allele_id AS ref_id, o.allele_id AS other_id, round(o.m_price - r.m_price, 6) + 0.0 AS delta_m_price, round(o.m_size - r.m_size, 6) + 0.0 AS delta_m_size
FROM alleles o JOIN alleles r ON r.allele_id = greatest(1, o.allele_id // 8 * 8)""", "alleles"))
def _(t):
    pairs = t.alleles.select(F.expr("CAST(greatest(1, floor(allele_id / 8) * 8) AS BIGINT)").alias("ref_id"), F.col("allele_id").alias("other_id"))
    return summary.pair_delta(pairs, t.alleles, "allele_id", ["m_price", "m_size"])


@query("a40_allele_feature_summary", oracle("""
SELECT allele_id, count(*) AS n_features, count(*) FILTER (nc) AS n_noncoding, round(avg(v), 6) AS whole_v, round(avg(v) FILTER (nc), 6) AS nc_v FROM (
  SELECT l_partkey AS allele_id, l_returnflag <> 'A' AS nc, l_quantity AS v FROM lineitem) GROUP BY 1"""))
def _(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("allele_id"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("v"))
    out = summary.allele_feature_summary(rows, ["v"], F.col("kind") != "A")
    return out.withColumns({"whole_v": F.round("whole_v", 6), "nc_v": F.round("nc_v", 6)})


def cells(t):
    mat = t.betas.select(F.col("probe_id").alias("feature"), "sample", F.col("beta").alias("value"))
    groups = t.betas.select("sample").distinct().where("sample <> 's5'").withColumn(
        "bucket", F.concat(F.lit("b"), (F.substring("sample", 2, 1).cast("int") % 3).cast("string")))
    return mat, groups


CELL = "SELECT probe_id AS feature, concat('b', CAST(event_id % 6 % 3 AS STRING)) AS bucket, beta FROM betas WHERE event_id % 6 <> 5"


@query("a36_collapse_donors", oracle("""
SELECT feature, bucket, round(avg(beta), 6) AS mean, round(quantile_cont(beta, 0.5), 6) AS median FROM c GROUP BY 1, 2""", "betas", extra={"c": CELL}))
def _(t):
    mat, groups = cells(t)
    mean = summary.collapse_donors(mat, groups).withColumnRenamed("value_out", "mean")
    med = summary.collapse_donors(mat, groups, "median").withColumnRenamed("value_out", "median")
    return mean.join(med, ["feature", "bucket"]).select("feature", "bucket", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("a37_shannon_entropy", oracle("""
SELECT sample, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM (
  SELECT sample, beta / sum(beta) OVER (PARTITION BY sample) AS p FROM betas WHERE beta > 0) GROUP BY 1""", "betas"))
def _(t):
    return summary.shannon_entropy(t.betas, ["sample"], "beta").withColumn("entropy", F.round("entropy", 6))


BUCKETS = "SELECT feature, bucket, avg(beta) AS value FROM c GROUP BY 1, 2"
CHANGE = """SELECT 'b0' AS from_node, b.bucket AS to_node, a.feature, abs(a.value - b.value) AS delta FROM bk a JOIN bk b ON a.feature = b.feature
  AND a.bucket = 'b0' AND b.bucket IN ('b1', 'b2') WHERE abs(a.value - b.value) > 0.01"""


def edges(t):
    mat, groups = cells(t)
    long = summary.collapse_donors(mat, groups).withColumnRenamed("value_out", "value")
    nodes = groups.where("bucket <> 'b0'").select(F.lit("b0").alias("from_node"), F.col("bucket").alias("to_node")).distinct()
    return summary.edge_change(nodes, long, 0.01, 10)


@query("a38_edge_change", oracle("SELECT from_node, to_node, count(*) AS n_changed FROM ch GROUP BY 1, 2", "betas", extra={"c": CELL, "bk": BUCKETS, "ch": CHANGE}))
def _(t):
    return edges(t)[0]


@query("a38_edge_top", oracle("""
SELECT from_node, to_node, feature, round(delta, 6) AS delta, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY from_node, to_node
  ORDER BY delta DESC, feature) AS rank FROM ch) WHERE rank <= 10""", "betas", extra={"c": CELL, "bk": BUCKETS, "ch": CHANGE}))
def _(t):
    return edges(t)[1].withColumn("delta", F.round("delta", 6))


@query("a39_row_zscore", oracle("""
SELECT event_id, round((beta - avg(beta) OVER w) / nullif(stddev_samp(beta) OVER w, 0), 6) + 0.0 AS z FROM betas WINDOW w AS (PARTITION BY probe_id)""", "betas"))
def _(t):
    return summary.row_zscore(t.betas, "probe_id", "beta").select("event_id", r(F.col("z")).alias("z"))


# ---- catalog and quality --------------------------------------------------------------

LAYERS = """SELECT concat('layer_', CAST(s_suppkey // 2 AS STRING)) AS layer_key, CAST(s_suppkey % 2 + 1 AS INT) AS version, concat('type_', CAST(s_suppkey % 5 AS STRING)) AS layer_type,
  CASE WHEN s_nationkey % 2 = 0 THEN 'b1' ELSE 'b2' END AS genome_build, CASE WHEN s_suppkey % 3 = 0 THEN 'measured' ELSE 'derived' END AS evidence_class,
  CAST(s_suppkey * 10 AS BIGINT) AS row_count, s_nationkey % 7 <> 0 AS is_active, s_suppkey % 2 = 1 AS is_default FROM supplier"""


def layers(t):
    return t.spark.sql(LAYERS.replace("s_suppkey // 2", "s_suppkey DIV 2").replace("FROM supplier", "FROM {s}"), s=t.supplier)


@query("f9_list_layers", oracle("""
SELECT layer_key, version, layer_type FROM ly WHERE is_active AND is_default AND genome_build = 'b1'""", extra={"ly": LAYERS}))
def _(t):
    return quality.list_layers(layers(t), genome_build="b1").select("layer_key", "version", "layer_type")


@query("a5_layer_summary", oracle("""
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n_layers, CAST(sum(row_count) AS BIGINT) AS n_rows, count(DISTINCT layer_type) AS n_types FROM ly
UNION ALL SELECT 'genome_build', genome_build, count(*), CAST(sum(row_count) AS BIGINT), count(DISTINCT layer_type) FROM ly GROUP BY 2
UNION ALL SELECT 'layer_type', layer_type, count(*), CAST(sum(row_count) AS BIGINT), count(DISTINCT layer_type) FROM ly GROUP BY 2
UNION ALL SELECT 'evidence_class', evidence_class, count(*), CAST(sum(row_count) AS BIGINT), count(DISTINCT layer_type) FROM ly GROUP BY 2""", extra={"ly": LAYERS}))
def _(t):
    return summary.layer_summary(layers(t))


@query("a5_platform_summary", oracle("""
SELECT count(*) AS total_layers, count(DISTINCT layer_type) AS distinct_layer_types, count(DISTINCT genome_build) AS supported_builds, CAST(sum(row_count) AS BIGINT) AS total_rows
FROM ly WHERE is_active AND is_default""", extra={"ly": LAYERS}))
def _(t):
    return summary.platform_summary(layers(t))


@query("k4_register_layer", oracle("""
SELECT layer_key, version, genome_build, row_count, row_number() OVER (PARTITION BY layer_key, genome_build ORDER BY version DESC) = 1 AS is_default FROM (
  SELECT layer_key, version, genome_build, row_count FROM ly WHERE NOT (version = 2 AND evidence_class = 'measured')
  UNION ALL SELECT layer_key, version, genome_build, row_count + 7 FROM ly WHERE version = 2 AND evidence_class = 'measured')""", extra={"ly": LAYERS}))
def _(t):
    old = layers(t)
    fresh = old.where("version = 2 AND evidence_class = 'measured'").withColumn("row_count", F.col("row_count") + 7)
    return quality.register_layer(old, fresh).select("layer_key", "version", "genome_build", "row_count", "is_default")


PART_SUMS = " || ':' || ".join(f"CAST(sum(CAST('0x' || substring(d, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT)" for i in range(8))


@query("k3_content_hash", oracle(f"""
SELECT sha256(string_agg(x, '|' ORDER BY x)) AS content_hash, CAST(sum(n) AS BIGINT) AS row_count FROM (
  SELECT substring(d, 1, 2) || ':' || count(*) || ':' || {PART_SUMS} AS x, count(*) AS n FROM (
    SELECT sha256(CAST(to_json(struct_pack(build := build, chr_id := chr_id, end_pos := end_pos, feature_id := feature_id, klass := klass,
      score := CAST(CAST(score AS DECIMAL(20, 2)) AS VARCHAR), start_pos := start_pos)) AS VARCHAR)) AS d FROM intervals_b) GROUP BY substring(d, 1, 2))""",
    "intervals_b"))
def _(t):
    named = t.intervals_b.select("build", "chr_id", "end_pos", "feature_id", "klass", "start_pos", F.col("score").cast("decimal(20,2)").cast("string").alias("score"))
    return quality.content_hash(named)


@query("k6_check_layer", oracle("""
SELECT 'row_count' AS "check", '*' AS field, CAST(count(*) AS DOUBLE) AS value, count(*) >= 100 AS passed FROM windows
UNION ALL SELECT 'value_range', 'rate', CAST(count(*) FILTER (rate < 4 OR rate > 6) AS DOUBLE), count(*) FILTER (rate < 4 OR rate > 6) = 0 FROM windows
UNION ALL SELECT 'null_fraction', 'rate', count(*) FILTER (rate IS NULL) / CAST(count(*) AS DOUBLE), true FROM windows
UNION ALL SELECT 'value_range', 'mean_b', 0.0, true FROM windows GROUP BY 1
UNION ALL SELECT 'null_fraction', 'mean_b', count(*) FILTER (mean_b IS NULL) / CAST(count(*) AS DOUBLE), count(*) FILTER (mean_b IS NULL) / CAST(count(*) AS DOUBLE) <= 0.001 FROM windows""",
    "windows"))
def _(t):
    return quality.check_layer(t.windows, 100, {"rate": {"low": 4, "high": 6}, "mean_b": {"max_null": 0.001}})


@query("k7_check_cross_fields", oracle("""
SELECT 'n_a' AS x, 'curvature' AS y, round(corr(n_a, curvature), 6) AS r, coalesce(corr(n_a, curvature) > 0 AND abs(corr(n_a, curvature)) >= 0.01, false) AS passed FROM windows""", "windows"))
def _(t):
    return quality.check_cross_fields(t.windows, [("n_a", "curvature", "+", 0.01)]).withColumn("r", F.round("r", 6))


@query("k10_null_audit", oracle("""
SELECT field, round(f, 6) AS null_fraction, CASE WHEN f > 0.5 THEN 'warning' WHEN f > 0 THEN 'some' ELSE 'none' END AS level FROM (
  SELECT unnest(['n_b', 'stacking', 'rate']) AS field, unnest([avg(CAST(n_b IS NULL AS INT)), avg(CAST(stacking IS NULL AS INT)), avg(CAST(rate IS NULL AS INT))]) AS f FROM windows)""", "windows"))
def _(t):
    return quality.null_audit(t.windows.select("n_b", "stacking", "rate")).withColumn("null_fraction", F.round("null_fraction", 6))


@query("k5_assert_base_rows", oracle("SELECT chr_id, start_pos FROM windows", "windows"))
def _(t):
    return quality.assert_base_rows(t.windows, 10).select("chr_id", "start_pos")


@query("f21_reference_lookup", oracle("""
SELECT s.seq_id, count(*) AS n_cg, round(count(*) * CAST(-2.17 AS DOUBLE), 6) AS energy FROM (SELECT seq_id, unnest(regexp_extract_all(sequence, 'CG')) AS d FROM sequences) s GROUP BY 1""", "sequences"))
def _(t):
    from spanframe.functions.seqexpr import pair_count

    table = reference.nn_parameters(t.spark).where("duplex = 'dna_dna' AND dinucleotide = 'CG'").select("dinucleotide", "delta_g_37")
    counted = t.sequences.select("seq_id", F.lit("CG").alias("dinucleotide"), pair_count(F.col("sequence"), "CG").cast("long").alias("n_cg"))
    out = counted.where("n_cg > 0").join(F.broadcast(table), "dinucleotide")  # the one row looked up
    return out.select("seq_id", "n_cg", F.round(F.col("n_cg") * F.col("delta_g_37"), 6).alias("energy"))


@query("f21_dinucleotide_lookup", oracle(f"""
SELECT seq_id, p.property, round(CAST(sum(c * p.value) AS DOUBLE) / 100.0 / sum(c), 8) + 0.0 AS mean_value FROM (
  SELECT seq_id, d, count(*) AS c FROM (SELECT seq_id, substring(sequence, i, 2) AS d FROM (SELECT seq_id, sequence, unnest(range(1, length(sequence))) AS i FROM sequences)) GROUP BY 1, 2) n
JOIN (VALUES {', '.join(f"('{name}', '{d}', {round(table[d] * 100)})" for name, table in K.STEP_PROPERTIES.items() if name in ('roll', 'twist', 'z_form') for d in K.DINUCLEOTIDES)}) p(property, d, value)
  ON p.d = n.d GROUP BY 1, 2""", "sequences"))
def _(t):
    from spanframe.functions.seqexpr import with_step_counts

    wanted = reference.dinucleotide_properties(t.spark).where("property IN ('roll', 'twist', 'z_form')")
    counted = with_step_counts(t.sequences.select("seq_id", "sequence"))
    long = counted.select("seq_id", F.inline(F.array(*[F.struct(F.lit(d).alias("dinucleotide"), F.col(f"c_{d}").alias("c")) for d in K.DINUCLEOTIDES]))).where("c > 0")
    joined = long.join(F.broadcast(wanted), "dinucleotide")  # 48 rows looked up
    return joined.groupBy("seq_id", "property").agg((F.round(F.sum(F.col("c") * F.round(F.col("value") * 100).cast("long")) / 100.0 / F.sum("c"), 8) + F.lit(0.0)).alias("mean_value"))  # whole hundredths: exact sums


@query("f21_amino_acid_lookup", oracle(f"""
SELECT seq_id, count(*) AS n_residues, round(CAST(sum(h) AS DOUBLE) / 100.0 / count(*), 5) + 0.0 AS mean_hydropathy, CAST(sum(m) AS DOUBLE) / 100.0 AS total_mass FROM (
  SELECT doc_id AS seq_id, unnest(string_split(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '')) AS letter FROM documents WHERE text IS NOT NULL) x
JOIN (VALUES {', '.join(f"('{a[0]}', {round(a[6] * 100)}, {round(a[3] * 100)})" for a in K.AMINO_ACIDS)}) p(letter, h, m) USING (letter) GROUP BY 1"""))
def _(t):
    whole = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)  # noqa: E731  whole hundredths: exact sums
    table = reference.amino_acids(t.spark).select("letter", whole("hydropathy"), whole("mass"))
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    counts = [F.struct(F.lit(a[0]).alias("letter"), (F.length("_s") - F.length(F.replace(F.col("_s"), F.lit(a[0]), F.lit("")))).cast("long").alias("c")) for a in K.AMINO_ACIDS]
    long = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("seq_id"), letters.alias("_s")).select("seq_id", F.inline(F.array(*counts))).where("c > 0")
    joined = long.join(F.broadcast(table), "letter")  # one row for each amino acid
    n = F.sum("c")
    return joined.groupBy("seq_id").agg(n.alias("n_residues"), (F.round(F.sum(F.col("c") * F.col("hydropathy")) / 100.0 / n, 5) + F.lit(0.0)).alias("mean_hydropathy"),
        (F.sum(F.col("c") * F.col("mass")) / 100.0).alias("total_mass"))


@query("f18_binned_probe_windows", oracle("""
SELECT chr_id, pos // 10000 * 10000 AS bin_start, count(*) AS n FROM probes GROUP BY 1, 2""", "probes"))
def _(t):
    return t.probes.groupBy("chr_id", bin_start(F.col("pos"), 10_000).alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))
