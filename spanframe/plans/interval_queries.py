"""Registered queries: coordinates, joins, windows, regions, intersection, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import classify, coords
from spanframe.functions.coords import round_to as r
from spanframe.operators import correlate as co
from spanframe.operators import lift, merge, nearest, overlap, region, topk, windows
from spanframe.operators.overlap import KEYS
from spanframe.plans.adapters import oracle
from spanframe.plans.registry import query

SHORT = [512]
TILE = [1024, 16384]
OVER = "a.chr_id = b.chr_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos"

# ---- coordinates and predicates -------------------------------------------------

REGION_TEXT = """CASE WHEN klass = '5-LOW' THEN concat('chr', CAST(chr_id AS STRING), ':', CAST(end_pos AS STRING), '-',
                 CAST(start_pos AS STRING)) WHEN klass = '2-HIGH' THEN concat('scaffold', CAST(chr_id AS STRING))
            ELSE concat('chr', CAST(chr_id AS STRING), ':', CAST(start_pos + 1 AS STRING), '-', CAST(end_pos AS STRING))
            END"""


@query("f1_parse_regions", oracle(f"""
SELECT feature_id, region, CASE WHEN klass = '2-HIGH' THEN 'format' WHEN klass = '5-LOW' THEN 'order' END AS reject,
       CASE WHEN klass NOT IN ('2-HIGH', '5-LOW') THEN chr_id END AS chr_id,
       CASE WHEN klass NOT IN ('2-HIGH', '5-LOW') THEN start_pos END AS start_pos,
       CASE WHEN klass NOT IN ('2-HIGH', '5-LOW') THEN end_pos END AS end_pos
FROM (SELECT *, {REGION_TEXT} AS region FROM intervals_b)""", "intervals_b"))
def _(t):
    return coords.parse_regions(t.intervals_b.select("feature_id", F.expr(REGION_TEXT).alias("region")))


@query("f2_coordinates", oracle("""
SELECT feature_id, start_pos + 1 AS "start", end_pos AS "end", end_pos - start_pos AS width, start_pos, end_pos
FROM intervals_b""", "intervals_b"))
def _(t):
    out = coords.to_external(t.intervals_b.select("feature_id", "start_pos", "end_pos")).drop("start_pos", "end_pos")
    return coords.to_internal(out)


@query("f3_region_query", oracle("""
SELECT *, CASE WHEN n_returned >= 20 THEN 'truncated' ELSE 'complete' END AS status FROM (
  SELECT *, count(*) OVER (PARTITION BY region_id) AS n_returned FROM (
    SELECT a.region_id, b.feature_id AS f_feature_id, b.start_pos AS f_start_pos, b.end_pos AS f_end_pos,
           CAST(row_number() OVER (PARTITION BY a.region_id ORDER BY b.start_pos, b.feature_id) AS INT) AS rank
    FROM regions a JOIN intervals_b b ON a.chr_id = b.chr_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos)
  WHERE rank <= 20)""", "regions", "intervals_b"))
def _(t):
    out = region.region_query(t.intervals_b, t.regions, 20, ("feature_id",), TILE)
    return out.select("region_id", "f_feature_id", "f_start_pos", "f_end_pos", "rank", "n_returned", "status")


@query("f4_region_query_points", oracle("""
SELECT a.region_id, b.event_id AS f_event_id, b.pos AS f_pos
FROM regions a JOIN points b ON a.chr_id = b.chr_id AND b.pos >= a.start_pos AND b.pos < a.end_pos""",
    "regions", "points"))
def _(t):
    out = region.region_query(overlap.as_interval(t.points), t.regions, levels=[8192])
    return out.select("region_id", "f_event_id", "f_pos")


@query("f5_window_start_query", oracle("""
SELECT a.region_id, b.start_pos, round(b.mean_b, 4) AS mean_b FROM regions a JOIN windows b
ON a.chr_id = b.chr_id AND b.start_pos >= a.start_pos AND b.start_pos < a.end_pos WHERE b.mean_b IS NOT NULL""",
    "regions", "windows"))
def _(t):
    out = region.window_start_query(t.windows.drop("end_pos"), t.regions, "mean_b", 1000)
    return out.select("region_id", "start_pos", F.round("mean_b", 4).alias("mean_b"))


@query("f6_page_after", oracle("""
SELECT event_id, pos FROM points WHERE pos > 5000 OR (pos = 5000 AND event_id > 250) ORDER BY pos, event_id LIMIT 100""", "points"))
def _(t):
    return topk.page_after(t.points.select("event_id", "pos"), (5000, 250), 100, ("pos", "event_id"))


@query("f7_select_fields", oracle("""
SELECT build, chr_id, start_pos, end_pos, klass FROM intervals_b""", "intervals_b"))
def _(t):
    return region.select_fields(t.intervals_b, ["klass", "not_there"])


@query("f8_field_predicate", oracle("""
SELECT klass, count(*) AS n FROM intervals_a
WHERE score BETWEEN 20000 AND 60000 AND rate <> 5 AND klass >= 'N' GROUP BY 1""", "intervals_a"))
def _(t):
    rules = [("score", "between", (20000, 60000)), ("rate", "!=", 5), ("klass", ">=", "N"), ("", "overlaps", None)]
    keep = coords.all_of([coords.field_predicate(f, op, v, ("score", "rate", "klass")) for f, op, v in rules])
    return t.intervals_a.where(keep).groupBy("klass").agg(F.count(F.lit(1)).alias("n"))


@query("f10_gc_band", oracle("""
SELECT seq_id, round(gc, 6) AS gc, CASE WHEN gc < 0.37 THEN 'L1' WHEN gc < 0.41 THEN 'L2' WHEN gc < 0.46 THEN 'H1'
       WHEN gc < 0.53 THEN 'H2' ELSE 'H3' END AS band
FROM (SELECT seq_id, CAST(length(regexp_replace(sequence, '[AT]', '', 'g')) AS DOUBLE) / length(sequence) AS gc
      FROM sequences WHERE length(sequence) > 0)""", "sequences"))
def _(t):
    from spanframe.functions.seqexpr import gc_fraction

    out = t.sequences.where(F.length("sequence") > 0).withColumn("gc", gc_fraction(F.col("sequence")))
    return out.select("seq_id", F.round("gc", 6).alias("gc"), classify.gc_band(F.col("gc")).alias("band"))


ISLANDS = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_row ORDER BY d, start_pos, end_pos) AS rn FROM (
  SELECT p.event_id AS p_row, b.start_pos, b.end_pos, abs(b.start_pos - p.pos) AS d
  FROM points p JOIN domains b ON p.chr_id = b.chr_id AND b.start_pos < p.pos + 4001 AND b.end_pos > p.pos - 4001))
  WHERE rn = 1"""


@query("f11_site_context", oracle("""
SELECT p.event_id, CASE WHEN i.start_pos IS NULL THEN 'open_sea'
  WHEN p.pos >= i.start_pos AND p.pos < i.end_pos THEN 'island'
  WHEN p.pos < i.start_pos AND i.start_pos - p.pos <= 2000 THEN 'n_shore'
  WHEN p.pos < i.start_pos AND i.start_pos - p.pos <= 4000 THEN 'n_shelf'
  WHEN p.pos >= i.end_pos AND p.pos - i.end_pos + 1 <= 2000 THEN 's_shore'
  WHEN p.pos >= i.end_pos AND p.pos - i.end_pos + 1 <= 4000 THEN 's_shelf' ELSE 'open_sea' END AS context
FROM points p LEFT JOIN i ON p.event_id = i.p_row""", "points", "domains", extra={"i": ISLANDS}))
def _(t):
    return nearest.classify_sites(t.points, t.domains, ["event_id"]).select("event_id", "context")


@query("f12_fragility_level", oracle("""
SELECT level, count(*) AS n FROM (SELECT CASE WHEN s >= 0.8 THEN 'extreme' WHEN s >= 0.6 THEN 'high'
  WHEN s >= 0.3 THEN 'moderate' ELSE 'low' END AS level FROM (SELECT rate / 10.0 AS s FROM intervals_a)) GROUP BY 1""",
    "intervals_a"))
def _(t):
    level = classify.fragility_level(F.col("rate") / 10.0)
    return t.intervals_a.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


REPEATS = """SELECT *, CASE p_size % 5 WHEN 0 THEN 'LINE' WHEN 1 THEN 'SINE' WHEN 2 THEN 'LTR' WHEN 3 THEN 'DNA' ELSE 'Simple' END
  AS repeat_class, CASE p_size % 8 WHEN 0 THEN 'L1HS' WHEN 1 THEN 'L1PB2' WHEN 2 THEN 'AluY' WHEN 3 THEN 'AluSx'
  WHEN 4 THEN 'MIR3' WHEN 5 THEN 'HERV-K14' WHEN 6 THEN 'L2a' ELSE 'MLT1' END AS repeat_name,
  CASE p_size % 3 WHEN 0 THEN 'ERV1' WHEN 1 THEN 'ERVL' ELSE 'MaLR' END AS repeat_family,
  p_retailprice / 40.0 AS divergence_pct FROM part"""


@query("f13_repeat_age", oracle("""
SELECT repeat_class, repeat_name, repeat_family, count(*) AS n, max(CASE
  WHEN repeat_class = 'LINE' AND repeat_name = 'L1HS' THEN 'young'
  WHEN repeat_class = 'LINE' AND repeat_name = 'L1PB2' THEN 'intermediate'
  WHEN repeat_class = 'LINE' AND repeat_name = 'L2a' THEN 'ancient'
  WHEN repeat_class = 'SINE' AND repeat_name = 'AluY' THEN 'young'
  WHEN repeat_class = 'SINE' AND repeat_name = 'AluSx' THEN 'intermediate'
  WHEN repeat_class = 'SINE' AND repeat_name = 'MIR3' THEN 'ancient'
  WHEN repeat_class = 'LTR' AND repeat_name = 'HERV-K14' THEN 'young'
  WHEN repeat_class = 'LTR' AND repeat_family = 'ERV1' THEN 'intermediate'
  WHEN repeat_class = 'LTR' AND repeat_family = 'ERVL' THEN 'ancient'
  WHEN repeat_class = 'DNA' THEN 'ancient' END) AS age
FROM repeats GROUP BY 1, 2, 3""", extra={"repeats": REPEATS}))
def _(t):
    rep = t.spark.sql(REPEATS.replace("FROM part", "FROM {part}"), part=t.part)
    age = classify.repeat_age(F.col("repeat_name"), F.col("repeat_class"), F.col("repeat_family"))
    return rep.groupBy("repeat_class", "repeat_name", "repeat_family").agg(
        F.count(F.lit(1)).alias("n"), F.max(age).alias("age")
    )


@query("f14_divergence_age", oracle("""
SELECT p_partkey, round(a, 4) AS age_my,
       CASE WHEN a > 100 THEN 'ancient' WHEN a > 25 THEN 'old' WHEN a > 5 THEN 'recent' ELSE 'young' END AS age_group
FROM (SELECT p_partkey, divergence_pct / 100.0 / (2 * CAST(2.2e-9 AS DOUBLE)) / 1000000 AS a FROM repeats)""",
    extra={"repeats": REPEATS}))
def _(t):
    rep = t.spark.sql(REPEATS.replace("FROM part", "FROM {part}"), part=t.part)
    age = classify.divergence_age_my(F.col("divergence_pct"))
    return rep.select("p_partkey", F.round(age, 4).alias("age_my"), classify.divergence_age_group(age).alias("age_group"))


@query("f19_tiles", oracle("""
SELECT feature_id, unnest(range(CAST(start_pos // 100 AS BIGINT), CAST((end_pos - 1) // 100 + 1 AS BIGINT))) AS tile
FROM intervals_b""", "intervals_b"))
def _(t):
    return coords.tiles_of_region(t.intervals_b, 100).select("feature_id", "tile")


@query("f19_tile_query", oracle("""
SELECT chr_id, t.tile, t.tile * 10000 AS tile_start, count(*) AS n FROM (
  SELECT chr_id, feature_id,
         unnest(range(CAST(start_pos // 10000 AS BIGINT), CAST((end_pos - 1) // 10000 + 1 AS BIGINT))) AS tile
  FROM intervals_b) t GROUP BY 1, 2""", "intervals_b"))
def _(t):
    tiles = coords.tiles_of_region(t.intervals_b, 10_000)
    return tiles.groupBy("chr_id", "tile", "tile_start").agg(F.count(F.lit(1)).alias("n"))


@query("f24_to_columnar", oracle("""
SELECT chr_id, list(start_pos + 1 ORDER BY start_pos, end_pos, feature_id) AS starts,
       list(end_pos ORDER BY start_pos, end_pos, feature_id) AS ends,
       list(feature_id ORDER BY start_pos, end_pos, feature_id) AS feature_id
FROM (SELECT CAST(chr_id AS BIGINT) * 1000000 + start_pos // 5000 AS chr_id, start_pos, end_pos, feature_id
      FROM intervals_b) GROUP BY 1""", "intervals_b"))
def _(t):
    tile = F.col("chr_id").cast("long") * 1_000_000 + F.floor(F.col("start_pos") / 5000)
    return region.to_columnar(t.intervals_b.withColumn("chr_id", tile), "chr_id", "start_pos", "end_pos", ["feature_id"])


# ---- joins ----------------------------------------------------------------------


@query("j1_overlap_join", oracle(f"""
SELECT a.chr_id, a.feature_id, a.start_pos, a.end_pos, b.feature_id AS b_feature_id,
       least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) AS bp
FROM intervals_a a JOIN intervals_b b ON {OVER}""", "intervals_a", "intervals_b"))
def _(t):
    pairs = overlap.overlap_join(
        t.intervals_a.select(*KEYS, "start_pos", "end_pos", "feature_id"),
        t.intervals_b.select(*KEYS, "start_pos", "end_pos", "feature_id"), levels=SHORT,
    )
    return pairs.select("chr_id", "feature_id", "start_pos", "end_pos", "b_feature_id",
                        overlap.overlap_length().alias("bp"))


@query("j1_overlap_summary", oracle(f"""
SELECT a.klass, b.klass AS b_klass, count(*) AS n,
       CAST(sum(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) AS BIGINT) AS bp
FROM intervals_a a JOIN intervals_b b ON {OVER} GROUP BY 1, 2""", "intervals_a", "intervals_b"))
def _(t):
    pairs = overlap.overlap_join(
        t.intervals_a.select(*KEYS, "start_pos", "end_pos", "klass"),
        t.intervals_b.select(*KEYS, "start_pos", "end_pos", "klass"), levels=SHORT,
    )
    return pairs.groupBy("klass", "b_klass").agg(
        F.count(F.lit(1)).alias("n"), F.sum(overlap.overlap_length()).alias("bp")
    )


@query("j2_point_overlap_best", oracle("""
SELECT event_id, b_klass, b_score, b_start_pos FROM (
  SELECT p.event_id, b.klass AS b_klass, b.score AS b_score, b.start_pos AS b_start_pos,
         row_number() OVER (PARTITION BY p.event_id ORDER BY b.score DESC NULLS LAST, b.start_pos, b.end_pos) AS rn
  FROM points p JOIN intervals_b b ON p.chr_id = b.chr_id AND p.pos >= b.start_pos AND p.pos < b.end_pos)
WHERE rn = 1""", "points", "intervals_b"))
def _(t):
    out = overlap.point_overlap_best(t.points, t.intervals_b, ["event_id"], "score", SHORT)
    return out.select("event_id", "b_klass", "b_score", "b_start_pos")


NEAREST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {order}) AS rn FROM (
  SELECT p.event_id, b.symbol, b.start_pos, b.end_pos, abs(b.start_pos - p.pos) AS distance
  FROM points p JOIN genes b ON p.chr_id = b.chr_id AND b.start_pos < p.pos + {radius} AND b.end_pos > p.pos - {radius}))
  WHERE rn = 1"""


@query("j4_nearest_within", oracle("""
SELECT p.event_id, m.symbol AS b_symbol, m.distance FROM points p LEFT JOIN m ON p.event_id = m.event_id""",
    "points", "genes", extra={"m": NEAREST.format(order="distance, start_pos, end_pos, symbol", radius=10000)}))
def _(t):
    out = nearest.nearest_within(t.points, t.genes.select(*KEYS, "start_pos", "end_pos", "symbol"), ["event_id"],
                                 10_000, symbol="symbol", levels=[16384])
    return out.select("event_id", "b_symbol", "distance")


@query("j4b_first_symbol_within", oracle("""
SELECT p.event_id, m.symbol AS b_symbol, m.distance FROM points p LEFT JOIN m ON p.event_id = m.event_id""",
    "points", "genes", extra={"m": NEAREST.format(order="symbol, distance, start_pos, end_pos", radius=10000)}))
def _(t):
    out = nearest.nearest_within(t.points, t.genes.select(*KEYS, "start_pos", "end_pos", "symbol"), ["event_id"],
                                 10_000, order="symbol", symbol="symbol", levels=[16384])
    return out.select("event_id", "b_symbol", "distance")


@query("j5_containment_join", oracle("""
SELECT a.chr_id, a.start_pos, b.domain_id AS b_domain_id FROM windows a JOIN domains b
ON a.chr_id = b.chr_id AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos""", "windows", "domains"))
def _(t):
    out = overlap.overlap_join(t.windows.select(*KEYS, "start_pos", "end_pos"), t.domains, contained=True)
    return out.select("chr_id", "start_pos", "b_domain_id")


@query("j6_window_star_join", oracle("""
SELECT w.chr_id, w.start_pos, w.n_a, round(n.nonb_density, 4) + 0.0 AS nonb_density,
       round(m.m_rate, 6) AS m_rate, d.domain_score
FROM windows w LEFT JOIN nonb n ON w.chr_id = n.chr_id AND w.start_pos = n.start_pos
LEFT JOIN (SELECT chr_id, CAST(pos // 1000 * 1000 AS BIGINT) AS start_pos, avg(beta) AS m_rate FROM betas GROUP BY 1, 2) m
  ON w.chr_id = m.chr_id AND w.start_pos = m.start_pos
LEFT JOIN (SELECT a.chr_id, a.start_pos, arg_max(b.score, b.start_pos) AS domain_score FROM windows a JOIN domains b
  ON a.chr_id = b.chr_id AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos GROUP BY 1, 2) d
  ON w.chr_id = d.chr_id AND w.start_pos = d.start_pos""", "windows", "nonb", "betas", "domains"))
def _(t):
    rates = t.betas.groupBy(*KEYS, coords.bin_start(F.col("pos"), 1000).alias("start_pos")).agg(
        F.avg("beta").alias("m_rate")
    )
    wide = windows.window_star_join(t.windows, [t.nonb, rates])
    wide = overlap.containing_value(wide, t.domains, "score", "domain_score")
    return wide.select("chr_id", "start_pos", "n_a", r(F.col("nonb_density"), 4).alias("nonb_density"),
                       F.round("m_rate", 6).alias("m_rate"), "domain_score")


@query("j7_within_radius", oracle("""
SELECT g.symbol, b.feature_id AS b_feature_id FROM (
  SELECT symbol, chr_id, greatest(min(start_pos) - 500, 0) AS start_pos, max(end_pos) + 500 AS end_pos
  FROM genes GROUP BY 1, 2) g
JOIN intervals_b b ON g.chr_id = b.chr_id AND g.start_pos < b.end_pos AND b.start_pos < g.end_pos""",
    "genes", "intervals_b"))
def _(t):
    return region.gene_neighbourhood(t.genes, t.intervals_b, 500, TILE).select("symbol", "b_feature_id")


RECIPROCAL = """(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) >= 0.5 * (a.end_pos - a.start_pos)
  AND (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) >= 0.5 * (b.end_pos - b.start_pos)"""


@query("j8_reciprocal_overlap", oracle(f"""
SELECT a.feature_id, a.start_pos, b.feature_id AS b_feature_id FROM intervals_a a JOIN intervals_b b
ON {OVER} AND {RECIPROCAL}""", "intervals_a", "intervals_b"))
def _(t):
    out = overlap.reciprocal_overlap(t.intervals_a, t.intervals_b, levels=SHORT)
    return out.select("feature_id", "start_pos", "b_feature_id")


@query("j8_match_quality", oracle(f"""
SELECT 'computed' AS side, count(*) AS n, count(h.start_pos) AS hit, round(count(h.start_pos) / count(*), 6) AS fraction
FROM intervals_a x LEFT JOIN (SELECT DISTINCT a.chr_id, a.start_pos, a.end_pos FROM intervals_a a JOIN intervals_b b
  ON {OVER} AND {RECIPROCAL}) h ON x.chr_id = h.chr_id AND x.start_pos = h.start_pos AND x.end_pos = h.end_pos
UNION ALL
SELECT 'truth', count(*), count(h.start_pos), round(count(h.start_pos) / count(*), 6)
FROM intervals_b x LEFT JOIN (SELECT DISTINCT b.chr_id, b.start_pos, b.end_pos FROM intervals_a a JOIN intervals_b b
  ON {OVER} AND {RECIPROCAL}) h ON x.chr_id = h.chr_id AND x.start_pos = h.start_pos AND x.end_pos = h.end_pos""",
    "intervals_a", "intervals_b"))
def _(t):
    a = t.intervals_a.select(*KEYS, "start_pos", "end_pos")
    b = t.intervals_b.select(*KEYS, "start_pos", "end_pos")
    out = overlap.match_quality(a, b, levels=SHORT)
    return out.withColumn("fraction", F.round("fraction", 6))


BINS = """SELECT chr_id, CAST(floor({pos} / {res}) * {res} AS BIGINT) AS bin_start, {value} AS value_{side}
  FROM {layer} GROUP BY 1, 2"""


def aligned_sql(res=10000, a="points", pa="pos", va="count(*)", b="intervals_b", pb="start_pos", vb="count(*)"):
    return {
        "ba": BINS.format(pos=pa, res=res, value=va, side="a", layer=a),
        "bb": BINS.format(pos=pb, res=res, value=vb, side="b", layer=b),
        "al": """SELECT coalesce(ba.chr_id, bb.chr_id) AS chr_id, coalesce(ba.bin_start, bb.bin_start) AS bin_start,
                 coalesce(value_a, 0) AS value_a, coalesce(value_b, 0) AS value_b
                 FROM ba FULL JOIN bb ON ba.chr_id = bb.chr_id AND ba.bin_start = bb.bin_start""",
    }


@query("j12_align_bins", oracle("SELECT * FROM al", "points", "intervals_b", extra=aligned_sql(1000)))
def _(t):
    a = co.bin_layer(t.points, 1000, F.count(F.lit(1)), "value_a", "pos")
    b = co.bin_layer(t.intervals_b, 1000, F.count(F.lit(1)), "value_b")
    return co.align_bins(a, b).drop("build")


@query("j13_nearest_distance", oracle("""
SELECT p.event_id, p.pos, min(CASE WHEN d.start_pos <= p.pos AND p.pos <= d.end_pos THEN 0
  ELSE least(abs(p.pos - d.start_pos), abs(p.pos - d.end_pos)) END) AS distance
FROM points p LEFT JOIN domains d ON p.chr_id = d.chr_id GROUP BY 1, 2""", "points", "domains"))
def _(t):
    return nearest.nearest_distance(t.points, t.domains).select("event_id", "pos", "distance")


@query("j14_signal_over_regions", oracle("""
SELECT g.region_id, round(avg(b.score), 4) AS mean_signal, max(b.score) AS max_signal FROM regions g
LEFT JOIN intervals_a b ON g.chr_id = b.chr_id AND g.start_pos < b.end_pos AND b.start_pos < g.end_pos GROUP BY 1""",
    "regions", "intervals_a"))
def _(t):
    out = overlap.signal_over_regions(t.intervals_a.select(*KEYS, "start_pos", "end_pos", "score"), t.regions,
                                      ["region_id"], levels=TILE)
    return out.select("region_id", F.round("mean_signal", 4).alias("mean_signal"), "max_signal")


@query("j15_count_overlaps", oracle("""
SELECT g.gene_id, CAST(count(*) FILTER (b.start_pos < g.tss + 500 AND b.end_pos > g.tss - 500) > 0 AS INT) AS near_flag,
       count(*) FILTER (b.start_pos < g.tss + 2000 AND b.end_pos > g.tss - 2000) AS promoter_count,
       round(count(*) FILTER (b.start_pos < g.end_pos AND b.end_pos > g.start_pos) /
             ((max(g.end_pos) - max(g.start_pos)) / 1000.0), 6) AS body_density
FROM (SELECT *, CASE WHEN strand = '-' THEN end_pos ELSE start_pos END AS tss FROM genes) g
LEFT JOIN intervals_b b ON g.chr_id = b.chr_id AND b.start_pos < g.end_pos + 2000 AND b.end_pos > g.start_pos - 2000
GROUP BY 1""", "genes", "intervals_b"))
def _(t):
    out = overlap.count_overlaps_of_genes(t.genes, t.intervals_b)
    return out.withColumn("body_density", F.round("body_density", 6))


BLOCKS = """SELECT 'b1' AS build, chr_id, start_pos, end_pos, domain_id, CAST(chr_id % 7 + 1 AS INT) AS dst_chr_id,
  domain_id * 10 - 300 AS "offset" FROM domains"""


def blocks(t):
    return t.domains.select(*KEYS, "start_pos", "end_pos", (F.col("chr_id") % 7 + 1).alias("dst_chr_id"),
                            (F.col("domain_id") * 10 - 300).alias("offset"))


@query("j16_lift_intervals", oracle("""
SELECT feature_id, dst AS chr_id, start_pos + off AS start_pos, end_pos + off AS end_pos FROM (
  SELECT a.feature_id, a.start_pos, a.end_pos, b.dst_chr_id AS dst, b."offset" AS off,
         row_number() OVER (PARTITION BY a.feature_id ORDER BY b.start_pos, b.end_pos, b.dst_chr_id) AS rn
  FROM intervals_b a JOIN blocks b ON a.chr_id = b.chr_id AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos)
WHERE rn = 1""", "intervals_b", "domains", extra={"blocks": BLOCKS}))
def _(t):
    mapped, _unmapped = lift.lift_intervals(t.intervals_b.drop("klass", "score"), blocks(t), ["feature_id"])
    return mapped.drop("build")


@query("j16_unmapped_intervals", oracle("""
SELECT feature_id FROM intervals_b a WHERE NOT EXISTS (SELECT 1 FROM domains b
  WHERE a.chr_id = b.chr_id AND b.start_pos <= a.start_pos AND a.end_pos <= b.end_pos)""", "intervals_b", "domains"))
def _(t):
    return lift.lift_intervals(t.intervals_b, blocks(t), ["feature_id"])[1].select("feature_id")


# ---- aggregations over bins, regions and windows ---------------------------------


@query("a1_binned_density", oracle("""
SELECT chr_id, CAST(floor(start_pos / 10000) * 10000 AS BIGINT) AS bin_start, count(*) AS n,
       count(*) / CAST(10000 AS DOUBLE) AS density, round(avg(score), 4) AS mean_score, max(rate) AS max_rate
FROM intervals_a GROUP BY 1, 2""", "intervals_a"))
def _(t):
    out = region.binned_density(t.intervals_a, 10_000, {"mean_score": F.avg("score"), "max_rate": F.max("rate")})
    return out.drop("build").withColumn("mean_score", F.round("mean_score", 4))


@query("a2_region_stats", oracle("""
SELECT region_id, field, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, min(v) AS min,
       max(v) AS max, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median,
       round(quantile_cont(v, 0.75), 4) AS p75
FROM (SELECT g.region_id, unnest(['score', 'rate']) AS field, unnest([b.score, b.rate]) AS v FROM regions g
  JOIN intervals_a b ON g.chr_id = b.chr_id AND g.start_pos < b.end_pos AND b.start_pos < g.end_pos)
GROUP BY 1, 2""", "regions", "intervals_a"))
def _(t):
    out = region.region_stats(t.intervals_a, t.regions, ["score", "rate"], TILE)
    return out.select("region_id", "field", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd")], "min", "max",
                      *[F.round(c, 4).alias(c) for c in ("p25", "median", "p75")])


@query("a2_region_counts", oracle("""
SELECT g.region_id, count(b.chr_id) AS n, round(count(b.chr_id) / 5.0, 6) AS density_per_kb FROM regions g
LEFT JOIN intervals_a b ON g.chr_id = b.chr_id AND g.start_pos < b.end_pos AND b.start_pos < g.end_pos GROUP BY 1""",
    "regions", "intervals_a"))
def _(t):
    out = region.region_counts(t.intervals_a, t.regions)
    return out.select("region_id", "n", F.round("density_per_kb", 6).alias("density_per_kb"))


PROFILE = """SELECT g.region_id, l.layer, count(x.chr_id) AS feature_count, 5000 AS region_length
  FROM regions g CROSS JOIN (SELECT unnest(['sites', 'elements', 'structures']) AS layer) l
  LEFT JOIN (SELECT 'sites' AS layer, chr_id, pos AS start_pos, pos + 1 AS end_pos FROM points
    UNION ALL SELECT 'elements', chr_id, start_pos, end_pos FROM intervals_a
    UNION ALL SELECT 'structures', chr_id, start_pos, end_pos FROM domains) x
  ON x.layer = l.layer AND x.chr_id = g.chr_id AND x.start_pos < g.end_pos AND x.end_pos > g.start_pos GROUP BY 1, 2"""


def profile(t):
    return region.region_profile(
        t.regions, {"sites": overlap.as_interval(t.points), "elements": t.intervals_a, "structures": t.domains}
    )


@query("a3_region_profile", oracle("""
SELECT region_id, layer, feature_count, CAST(region_length AS BIGINT) AS region_length,
       feature_count / 5.0 AS density_per_kb, feature_count > 0 AS present FROM pr""",
    "regions", "points", "intervals_a", "domains", extra={"pr": PROFILE}))
def _(t):
    return profile(t)


@query("a4_significance_flags", oracle("""
SELECT * FROM (SELECT region_id, layer, feature_count, CASE WHEN layer = 'sites' AND feature_count / 5.0 > 80 THEN 'HIGH_CPG_DENSITY'
  WHEN layer = 'sites' AND feature_count > 0 AND feature_count / 5.0 < 5 THEN 'LOW_CPG_DENSITY'
  WHEN layer = 'elements' AND feature_count / 5.0 > 5 THEN 'REGULATORY_DENSE'
  WHEN layer = 'structures' AND feature_count > 0 THEN 'NONB_DNA_PRESENT' END AS code,
  CASE WHEN layer = 'structures' THEN 'warning' ELSE 'info' END AS type FROM pr) WHERE code IS NOT NULL""",
    "regions", "points", "intervals_a", "domains", extra={"pr": PROFILE}))
def _(t):
    flags = region.significance_flags(
        profile(t), {"sites": "cpg", "elements": "regulatory", "structures": "nonb_dna"}
    )
    return flags.select("region_id", "layer", "feature_count", "code", "type")


SPREAD = """SELECT {cols}, w AS start_pos, least(end_pos, w + 1000) - greatest(start_pos, w) AS bp FROM (
  SELECT *, unnest(range(start_pos // 1000 * 1000, (end_pos - 1) // 1000 * 1000 + 1, 1000)) AS w FROM {layer})"""


@query("a6_overlap_count_per_window", oracle("""
SELECT w.chr_id, w.start_pos, count(s.bp) AS n_elements FROM windows w LEFT JOIN s
ON w.chr_id = s.chr_id AND w.start_pos = s.start_pos GROUP BY 1, 2""", "windows", "intervals_b",
    extra={"s": SPREAD.format(cols="chr_id", layer="intervals_b")}))
def _(t):
    base = t.windows.select(*KEYS, "start_pos")
    return windows.overlap_count_per_window(base, t.intervals_b, "n_elements").drop("build")


@query("a7_max_signal_per_window", oracle("""
SELECT chr_id, start_pos, max(score) FILTER (klass = 'A') AS "A", max(score) FILTER (klass = 'N') AS "N",
       max(score) FILTER (klass = 'R') AS "R" FROM s GROUP BY 1, 2""", "intervals_a",
    extra={"s": SPREAD.format(cols="chr_id, klass, score", layer="intervals_a")}))
def _(t):
    return windows.max_signal_per_window(t.intervals_a, "klass", ["A", "N", "R"], "score").drop("build")


@query("a8_coverage_fraction", oracle("""
SELECT chr_id, start_pos, round(a, 6) AS frac_a, round(n, 6) AS frac_n, round(least(1.0, a + n), 6) AS total FROM (
  SELECT w.chr_id, w.start_pos, least(1.0, coalesce(sum(s.bp) FILTER (klass = 'A'), 0) / CAST(1000 AS DOUBLE)) AS a,
         least(1.0, coalesce(sum(s.bp) FILTER (klass = 'N'), 0) / CAST(1000 AS DOUBLE)) AS n
  FROM windows w LEFT JOIN s ON w.chr_id = s.chr_id AND w.start_pos = s.start_pos GROUP BY 1, 2)""",
    "windows", "intervals_a", extra={"s": SPREAD.format(cols="chr_id, klass", layer="intervals_a")}))
def _(t):
    classes = {"frac_a": F.col("klass") == "A", "frac_n": F.col("klass") == "N"}
    layer = t.intervals_a.select(*KEYS, "start_pos", "end_pos", "klass")
    out = windows.coverage_fraction(t.windows.select(*KEYS, "start_pos"), layer, classes, total="total")
    return out.select("chr_id", "start_pos", *[F.round(c, 6).alias(c) for c in ("frac_a", "frac_n", "total")])


@query("a9_median_per_window", oracle("""
SELECT chr_id, start_pos, round(quantile_cont(score, 0.5), 4) AS median FROM s GROUP BY 1, 2""", "intervals_b",
    extra={"s": SPREAD.format(cols="chr_id, score", layer="intervals_b")}))
def _(t):
    out = windows.median_per_window(t.intervals_b, "score").drop("build")
    return out.withColumn("median", F.round("median", 4))


@query("a10_window_weighted_mean", oracle("""
SELECT chr_id, start_pos, round(sum(score * bp) / 1000, 3) AS mean FROM s GROUP BY 1, 2""", "intervals_b",
    extra={"s": SPREAD.format(cols="chr_id, score", layer="intervals_b")}))
def _(t):
    return windows.window_weighted_mean(t.intervals_b, "score").drop("build").withColumn("mean", F.round("mean", 3))


@query("a11_broadcast_to_windows", oracle("""
SELECT chr_id, start_pos, arg_max(score, pos) AS score FROM (
  SELECT chr_id, start_pos AS pos, score, unnest(range(greatest(0, start_pos - 20000), start_pos + 20000, 1000)) AS start_pos
  FROM domains) GROUP BY 1, 2""", "domains"))
def _(t):
    centers = t.domains.withColumn("pos", F.col("start_pos")).select(*KEYS, "pos", "score")
    return windows.broadcast_to_windows(centers, ["score"], 40_000).drop("build")


@query("a12_bin_mutations", oracle("""
SELECT chr_id, CAST(pos // 1000 * 1000 AS BIGINT) AS start_pos, count(*) AS total,
       count(*) FILTER (length(ref) = 1 AND length(alt) = 1) AS snv,
       count(*) FILTER (NOT (length(ref) = 1 AND length(alt) = 1)) AS indel,
       count(*) FILTER (project IN ('click', 'view')) AS web, count(*) FILTER (project = 'purchase') AS shop
FROM (SELECT chr_id, pos, event_type AS project, substring('ACGT', 1, CAST(event_id % 3 AS INT)) AS ref, 'A' AS alt
      FROM points) GROUP BY 1, 2""", "points"))
def _(t):
    muts = t.points.select(
        *KEYS, "pos", F.col("event_type").alias("project"), F.lit("A").alias("alt"),
        F.expr("substring('ACGT', 1, CAST(event_id % 3 AS INT))").alias("ref"),
    )
    groups = t.spark.createDataFrame(
        [("click", "web"), ("view", "web"), ("purchase", "shop")], "project string, cancer_group string"
    )
    return windows.bin_mutations(muts, groups, ["web", "shop"]).drop("build")


@query("a13_bin_methylation", oracle("""
SELECT chr_id, start_pos, max(n) AS n_cpgs, round(max(beta) FILTER (cell_type = 'click'), 6) AS click,
       round(max(beta) FILTER (cell_type = 'view'), 6) AS view, round(avg(beta), 6) AS mean_beta,
       round(coalesce(var_samp(beta), 0), 6) AS beta_variance, round(max(beta) - min(beta), 6) AS beta_range
FROM (SELECT chr_id, CAST(pos // 1000 * 1000 AS BIGINT) AS start_pos, cell_type, avg(beta) AS beta, count(*) AS n
      FROM betas GROUP BY 1, 2, 3) GROUP BY 1, 2""", "betas"))
def _(t):
    out = windows.bin_methylation(t.betas, ["click", "view"]).drop("build")
    return out.select("chr_id", "start_pos", "n_cpgs", *[
        F.round(c, 6).alias(c) for c in ("click", "view", "mean_beta", "beta_variance", "beta_range")])


@query("a14_summary_bins", oracle("""
SELECT chr_id, cell_type, CAST(pos // 10000 * 10000 AS BIGINT) AS start_pos, round(avg(beta), 6) AS mean_beta,
       count(*) AS n_probes FROM betas GROUP BY 1, 2, 3""", "betas"))
def _(t):
    return windows.summary_bins(t.betas).drop("build").withColumn("mean_beta", F.round("mean_beta", 6))


@query("a41_hotspot_summary", oracle("""
SELECT g.region_id, 'events' AS label, count(x.chr_id) AS n, CAST(NULL AS DOUBLE) AS mean FROM regions g
LEFT JOIN intervals_b x ON x.chr_id = g.chr_id AND x.start_pos < g.end_pos AND x.end_pos > g.start_pos GROUP BY 1
UNION ALL SELECT g.region_id, 'hotspots', count(x.chr_id), NULL FROM regions g
LEFT JOIN domains x ON x.chr_id = g.chr_id AND x.start_pos < g.end_pos AND x.end_pos > g.start_pos GROUP BY 1
UNION ALL SELECT g.region_id, 'rates', count(*), round(avg(x.rate), 6) FROM regions g
JOIN windows x ON x.chr_id = g.chr_id AND x.start_pos >= g.start_pos AND x.start_pos < g.end_pos
WHERE x.rate IS NOT NULL GROUP BY 1""", "regions", "intervals_b", "domains", "windows"))
def _(t):
    out = region.hotspot_summary(t.regions, t.intervals_b, t.domains, t.windows.drop("end_pos"), "rate", 1000)
    return out.withColumn("mean", F.round("mean", 6))


@query("a42_bin_signal", oracle("""
SELECT chr_id, start_pos, round(sum(score * bp) FILTER (klass = 'A') / sum(bp) FILTER (klass = 'A'), 4) AS "A_mean",
       min(score) FILTER (klass = 'A') AS "A_min", max(score) FILTER (klass = 'A') AS "A_max",
       round(sum(score * bp) FILTER (klass = 'R') / sum(bp) FILTER (klass = 'R'), 4) AS "R_mean",
       min(score) FILTER (klass = 'R') AS "R_min", max(score) FILTER (klass = 'R') AS "R_max"
FROM s GROUP BY 1, 2""", "intervals_a", extra={"s": SPREAD.format(cols="chr_id, klass, score", layer="intervals_a")}))
def _(t):
    out = windows.bin_signal(t.intervals_a.withColumnRenamed("klass", "track"), ["A", "R"]).drop("build")
    return out.withColumns({c: F.round(c, 4) for c in ("A_mean", "R_mean")})


@query("a43_recurrence_count", oracle("""
SELECT c1 AS chr_id, lo AS lifted_start, hi AS lifted_end, w_start, w_end, n_tissues FROM (
  SELECT w.w_start, w.w_end, w.n_tissues, l.dst AS c1, h.dst AS c2, l.p + l.off AS lo, h.p + 1 + h.off AS hi FROM (
    SELECT chr_id, w_start, w_end, count(DISTINCT tissue) AS n_tissues FROM hits GROUP BY 1, 2, 3) w
  JOIN ends l ON l.chr_id = w.chr_id AND l.p = w.w_start AND l.rn = 1
  JOIN ends h ON h.chr_id = w.chr_id AND h.p = w.w_end - 1 AND h.rn = 1)
WHERE c1 = c2 AND hi - lo BETWEEN 50000 AND 200000""", "intervals_a", "domains", extra={
    "blocks": BLOCKS,
    "hits": """SELECT chr_id, start_pos // 60000 * 60000 AS w_start, start_pos // 60000 * 60000 + 60000 AS w_end,
               klass AS tissue FROM intervals_a""",
    "ends": """SELECT p.chr_id, p.p, b.dst_chr_id AS dst, b."offset" AS off,
               row_number() OVER (PARTITION BY p.chr_id, p.p ORDER BY b.start_pos, b.end_pos) AS rn
               FROM (SELECT DISTINCT chr_id, w_start AS p FROM hits UNION SELECT DISTINCT chr_id, w_end - 1 FROM hits) p
               JOIN blocks b ON p.chr_id = b.chr_id AND b.start_pos <= p.p AND p.p + 1 <= b.end_pos"""}))
def _(t):
    start = coords.bin_start(F.col("start_pos"), 60_000)
    hits = t.intervals_a.select(*KEYS, start.alias("start_pos"), (start + 60_000).alias("end_pos"),
                                F.col("klass").alias("tissue"))
    out = lift.recurrence_count(hits, blocks(t))
    return out.select("chr_id", "lifted_start", "lifted_end", "w_start", "w_end", "n_tissues")


# ---- window tables ----------------------------------------------------------------


@query("k2_add_tracks", oracle("""
SELECT w.chr_id, w.start_pos, round(CASE WHEN s.chr_id IS NOT NULL THEN s.rate ELSE w.rate END, 6) AS rate,
       round(s.fresh, 4) AS fresh FROM windows w LEFT JOIN (
  SELECT chr_id, start_pos, max(value) FILTER (track = 'rate') AS rate, max(value) FILTER (track = 'fresh') AS fresh
  FROM st GROUP BY 1, 2) s ON w.chr_id = s.chr_id AND w.start_pos = s.start_pos""", "windows", "points", extra={
    "st": """SELECT chr_id, CAST(pos // 1000 * 1000 AS BIGINT) AS start_pos,
             CASE WHEN event_type = 'click' THEN 'rate' ELSE 'fresh' END AS track, max(value) AS value
             FROM points GROUP BY 1, 2, 3"""}))
def _(t):
    track = F.when(F.col("event_type") == "click", "rate").otherwise("fresh")
    staging = t.points.groupBy(*KEYS, coords.bin_start(F.col("pos"), 1000).alias("start_pos"),
                               track.alias("track")).agg(F.max("value").alias("value"))
    out = windows.add_tracks(t.windows.select(*KEYS, "start_pos", "rate"), staging, ["rate", "fresh"])
    return out.select("chr_id", "start_pos", F.round("rate", 6).alias("rate"), F.round("fresh", 4).alias("fresh"))


@query("w1_merge_intervals", oracle("""
SELECT chr_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_merged FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_pos - reach > 20 THEN 1 ELSE 0 END)
            OVER (PARTITION BY chr_id ORDER BY start_pos, end_pos, rid) AS island FROM (
    SELECT *, max(end_pos) OVER (PARTITION BY chr_id ORDER BY start_pos, end_pos, rid
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM (SELECT *, row_number() OVER () AS rid FROM intervals_b)))
GROUP BY chr_id, island""", "intervals_b"))
def _(t):
    return merge.merge_intervals(t.intervals_b, 20).drop("build")


@query("w6_minmax_by", oracle("""
SELECT chr_id, start_pos, round(CASE WHEN v IS NULL THEN NULL WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) + 0.0
  AS scaled FROM (SELECT chr_id, start_pos, mean_b AS v, min(mean_b) OVER (PARTITION BY chr_id) AS lo,
                  max(mean_b) OVER (PARTITION BY chr_id) AS hi FROM windows)""", "windows"))
def _(t):
    out = windows.minmax_by(t.windows, "mean_b", "scaled")
    return out.select("chr_id", "start_pos", r(F.col("scaled")).alias("scaled"))


@query("w7_fragility_composite", oracle("""
SELECT chr_id, start_pos, round(s, 6) AS fragility_score, CASE WHEN s >= 0.8 THEN 'extreme' WHEN s >= 0.6 THEN 'high'
  WHEN s >= 0.3 THEN 'moderate' ELSE 'low' END AS fragility_level FROM (
SELECT chr_id, start_pos, 0.35 * CASE WHEN max(n) OVER w > min(n) OVER w THEN (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w) ELSE 0 END
  + 0.25 * CASE WHEN max(c) OVER w > min(c) OVER w THEN (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) ELSE 0 END
  + 0.25 * (1 - CASE WHEN max(k) OVER w > min(k) OVER w THEN (k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w) ELSE 0 END)
  + 0.15 * coalesce(exp(-ln(2) / 500000 * dist), 0) AS s
FROM (SELECT x.chr_id, x.start_pos, coalesce(b.nonb_density, 0) AS n, coalesce(x.curvature, 0) AS c,
        coalesce(x.stacking, 0) AS k, (SELECT min(CASE WHEN d.start_pos <= x.start_pos + 500 AND x.start_pos + 500 <= d.end_pos
        THEN 0 ELSE least(abs(x.start_pos + 500 - d.start_pos), abs(x.start_pos + 500 - d.end_pos)) END) FROM domains d
        WHERE d.chr_id = x.chr_id) AS dist
      FROM windows x JOIN nonb b ON x.chr_id = b.chr_id AND x.start_pos = b.start_pos)
WINDOW w AS (PARTITION BY chr_id))""", "windows", "nonb", "domains"))
def _(t):
    out = windows.fragility_composite(t.windows, t.nonb, t.domains)
    return out.select("chr_id", "start_pos", F.round("fragility_score", 6).alias("fragility_score"), "fragility_level")


@query("w8_rolling_mean", oracle("""
SELECT chr_id, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 5 PRECEDING
  AND 5 FOLLOWING), 6) AS smooth FROM points""", "points"))
def _(t):
    out = windows.rolling_mean(t.points, ["event_type"], "event_id", "value", "smooth", 10)
    return out.select("chr_id", "event_id", F.round("smooth", 6).alias("smooth"))


@query("w9_tile_mean", oracle("""
SELECT event_type, event_id // 100 AS tile, round(avg(value), 6) AS mean FROM points GROUP BY 1, 2""", "points"))
def _(t):
    out = windows.tile_mean(t.points, ["event_type"], "event_id", "value", 100)
    return out.withColumn("mean", F.round("mean", 6))


@query("w11_top_k_per_group", oracle("""
SELECT klass, feature_id, score, rank FROM (SELECT klass, feature_id, score, CAST(row_number() OVER (PARTITION BY klass
  ORDER BY score DESC, feature_id) AS INT) AS rank FROM intervals_b) WHERE rank <= 10""", "intervals_b"))
def _(t):
    out = topk.top_k_per_group(t.intervals_b, ["klass"], [F.col("score").desc(), F.col("feature_id")], 10, "rank")
    return out.select("klass", "feature_id", "score", "rank")


@query("w12_global_top_k", oracle("""
SELECT feature_id, score FROM intervals_b ORDER BY score DESC, feature_id LIMIT 25""", "intervals_b"))
def _(t):
    order = [F.col("score").desc(), F.col("feature_id")]
    return topk.global_top_k(t.intervals_b.select("feature_id", "score"), order, 25)


@query("w3_distinct_on", oracle("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC,
  event_id) AS rn FROM events) WHERE rn = 1"""))
def _(t):
    out = topk.distinct_on(t.events, ["user_id"], [F.col("value").desc(), F.col("event_id")])
    return out.select("user_id", "event_id", "event_type")


# ---- set operations ---------------------------------------------------------------

WIN = "SELECT chr_id, CAST({pos} // 1000 * 1000 AS BIGINT) AS start_pos, CAST({pos} // 1000 * 1000 + 1000 AS BIGINT) AS end_pos FROM {layer}"


def _tile(df, pos="start_pos"):
    start = coords.bin_start(F.col(pos), 1000)
    return df.withColumns({"_s": start, "end_pos": start + 1000}).withColumn("start_pos", F.col("_s")).drop("_s")


@query("t1_intersect_layers", oracle(f"""
{WIN.format(pos='start_pos', layer="intervals_a WHERE klass = 'R'")}
INTERSECT {WIN.format(pos='start_pos', layer='intervals_b WHERE score > 250000')}
INTERSECT {WIN.format(pos='pos', layer='points')}""", "intervals_a", "intervals_b", "points"))
def _(t):
    layers = [
        region.filtered(_tile(t.intervals_a), {"field": "klass", "op": "==", "value": "R"}),
        region.filtered(_tile(t.intervals_b), {"field": "score", "op": ">", "value": 250000}),
        _tile(t.points, "pos"),
    ]
    return region.intersect_layers(layers).drop("build")


@query("t1_intersect_overlap", oracle("""
SELECT DISTINCT chr_id, start_pos, end_pos FROM intervals_a a WHERE klass = 'R'
AND EXISTS (SELECT 1 FROM intervals_b b WHERE a.chr_id = b.chr_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos
            AND b.score > 450000)""", "intervals_a", "intervals_b"))
def _(t):
    layers = [t.intervals_a.where("klass = 'R'"), t.intervals_b.where("score > 450000")]
    return region.intersect_layers(layers, "overlap").drop("build")


@query("t2_annotate_positions", oracle("""
SELECT p.start_pos, b.feature_id AS b_feature_id FROM (SELECT DISTINCT chr_id, start_pos, end_pos FROM intervals_a
  WHERE score > 90000) p JOIN intervals_b b ON p.chr_id = b.chr_id AND p.start_pos < b.end_pos AND b.start_pos < p.end_pos""",
    "intervals_a", "intervals_b"))
def _(t):
    hits = t.intervals_a.where("score > 90000").select(*KEYS, "start_pos", "end_pos").distinct()
    return region.annotate_positions(hits, t.intervals_b, levels=SHORT).select("start_pos", "b_feature_id")


@query("t3_recipe", oracle(f"""
{WIN.format(pos='start_pos', layer='intervals_a')} INTERSECT {WIN.format(pos='start_pos', layer='domains')}
INTERSECT SELECT chr_id, start_pos, end_pos FROM windows WHERE curvature > 1.5""", "intervals_a", "domains", "windows"))
def _(t):
    layers = {"tad_domain": _tile(t.domains), "ccre": _tile(t.intervals_a),
              "conservation": t.windows.withColumnRenamed("curvature", "phylop_mean")}
    return region.run_recipe("tad_boundary_enrichment", layers).drop("build")


# ---- correlation -------------------------------------------------------------------

P_VALUE = """CASE WHEN abs(r) >= 1 THEN 0.0 ELSE 1 - 2 / exp(lgamma(0.5) + lgamma((n - 2) / 2.0) - lgamma((n - 1) / 2.0)) *
  list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END
    * pow(cos(atan(abs(t) / sqrt(n - 2)) * k / 2000.0), n - 3))) * atan(abs(t) / sqrt(n - 2)) / 6000.0 END"""
PEARSON = """SELECT chr_id, n, round(r, 6) AS r, round({p}, 6) + 0.0 AS p_value,
  round((exp(2 * (z - se)) - 1) / (exp(2 * (z - se)) + 1), 6) AS ci_low,
  round((exp(2 * (z + se)) - 1) / (exp(2 * (z + se)) + 1), 6) AS ci_high,
  round(mean_a, 4) AS mean_a, round(mean_b, 4) AS mean_b, round(sd_a, 4) AS sd_a, round(sd_b, 4) AS sd_b
FROM (SELECT *, 0.5 * ln((1 + r) / (1 - r)) AS z, 1.96 / sqrt(n - 3) AS se, r * sqrt((n - 2) / (1 - r * r)) AS t
FROM (SELECT chr_id, count(*) AS n, corr(value_a, value_b) AS r, avg(value_a) AS mean_a, avg(value_b) AS mean_b,
        stddev_samp(value_a) AS sd_a, stddev_samp(value_b) AS sd_b FROM {source} GROUP BY 1))"""


def _pearson_out(df):
    return df.select("chr_id", "n", F.round("r", 6).alias("r"), r(F.col("p_value")).alias("p_value"), *[
        F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")], *[
        F.round(c, 4).alias(c) for c in ("mean_a", "mean_b", "sd_a", "sd_b")])


@query("e1_correlate_pearson", oracle(PEARSON.format(p=P_VALUE, source="al"), "points", "intervals_a",
       extra=aligned_sql(1000, a="points", b="intervals_a", vb="avg(score)")))
def _(t):
    return _pearson_out(co.correlate(t.points, t.intervals_a, "pearson_r", 1000, value_b=F.avg("score"), pos_a="pos",
                                     modes=("count", "continuous")))


RANKED = """SELECT chr_id, rank() OVER (PARTITION BY chr_id ORDER BY value_a) + (count(*) OVER (PARTITION BY chr_id, value_a) - 1) / 2.0
  AS value_a, rank() OVER (PARTITION BY chr_id ORDER BY value_b) + (count(*) OVER (PARTITION BY chr_id, value_b) - 1) / 2.0
  AS value_b FROM al"""


@query("e2_correlate_spearman", oracle(PEARSON.format(p=P_VALUE, source="rk"), "points", "intervals_a",
       extra={**aligned_sql(1000, b="intervals_a", vb="max(score)"), "rk": RANKED}))
def _(t):
    return _pearson_out(co.correlate(t.points, t.intervals_a, "spearman_rho", 1000, value_b=F.max("score"),
                                     pos_a="pos", modes=("count", "continuous")))


TABLE = """SELECT chr_id, count(*) AS n, count(*) FILTER (value_a > 0) AS n_a, count(*) FILTER (value_b > 0) AS n_b,
  count(*) FILTER (value_a > 0 AND value_b > 0) AS n_both, count(*) FILTER (value_a > 0 OR value_b > 0) AS n_either
  FROM {source} GROUP BY 1"""
FISHER = """least(1.0, list_sum(list_transform(range(greatest(0, n_b - (n - n_a)), least(n_a, n_b) + 1), lambda k: CASE WHEN
  -lgamma(k + 1) - lgamma(n_a - k + 1) - lgamma(n_b - k + 1) - lgamma(n - n_a - n_b + k + 1) <=
  -lgamma(n_both + 1) - lgamma(n_a - n_both + 1) - lgamma(n_b - n_both + 1) - lgamma(n - n_a - n_b + n_both + 1) + 1e-10
  THEN exp(lgamma(n_a + 1) + lgamma(n - n_a + 1) + lgamma(n_b + 1) + lgamma(n - n_b + 1) - lgamma(n + 1)
  - lgamma(k + 1) - lgamma(n_a - k + 1) - lgamma(n_b - k + 1) - lgamma(n - n_a - n_b + k + 1)) ELSE 0 END)))"""


def _aligned(t, res=1000, dense=False):
    a = co.bin_layer(t.points, res, F.count(F.lit(1)), "value_a", "pos")
    b = co.bin_layer(t.intervals_b, res, F.count(F.lit(1)), "value_b")
    out = co.align_bins(a, b)
    return co.dense_bins(out, res) if dense else out


@query("e3_overlap_enrichment", oracle(f"""
SELECT chr_id, n, n_a, n_b, n_both, round(n_a * n_b / CAST(n AS DOUBLE), 6) AS expected,
       round(n_both / (n_a * n_b / CAST(n AS DOUBLE)), 6) AS value, round({FISHER}, 6) + 0.0 AS p_value FROM tb""",
    "points", "intervals_b", extra={**aligned_sql(1000), "tb": TABLE.format(source="al")}))
def _(t):
    out = co.STATISTICS["overlap_enrichment"](_aligned(t), ["chr_id"])
    return out.withColumns({"expected": F.round("expected", 6), "value": F.round("value", 6),
                            "p_value": r(F.col("p_value"))})


@query("e4_jaccard", oracle("""
SELECT chr_id, n, n_both, n_either, round(n_both / CAST(n_either AS DOUBLE), 6) AS value FROM tb""", "points",
    "intervals_b", extra={**aligned_sql(1000), "tb": TABLE.format(source="al")}))
def _(t):
    return co.STATISTICS["jaccard"](_aligned(t), ["chr_id"]).withColumn("value", F.round("value", 6))


FISHER_OUT = f"""SELECT chr_id, n, n_both AS "both", n_a - n_both AS a_only, n_b - n_both AS b_only,
  n - n_a - n_b + n_both AS neither, round(CASE WHEN n_a > n_both AND n_b > n_both THEN
  (n_both * (n - n_a - n_b + n_both)) / CAST((n_a - n_both) * (n_b - n_both) AS DOUBLE) END, 6) AS value,
  round({FISHER}, 6) + 0.0 AS p_value FROM tb"""


@query("e5_fisher_exact", oracle(FISHER_OUT, "points", "intervals_b",
                                 extra={**aligned_sql(1000), "tb": TABLE.format(source="al")}))
def _(t):
    out = co.STATISTICS["fisher_exact"](_aligned(t), ["chr_id"])
    return out.withColumns({"value": F.round("value", 6), "p_value": r(F.col("p_value"))})


@query("e5_fisher_exact_dense", oracle(FISHER_OUT, "points", "intervals_b", extra={
    **aligned_sql(1000), "de": """SELECT s.chr_id, coalesce(value_a, 0) AS value_a, coalesce(value_b, 0) AS value_b FROM (
      SELECT chr_id, unnest(range(min(bin_start), max(bin_start) + 1, 1000)) AS bin_start FROM al GROUP BY 1) s
      LEFT JOIN al ON s.chr_id = al.chr_id AND s.bin_start = al.bin_start""", "tb": TABLE.format(source="de")}))
def _(t):
    out = co.STATISTICS["fisher_exact"](_aligned(t, dense=True), ["chr_id"])
    return out.withColumns({"value": F.round("value", 6), "p_value": r(F.col("p_value"))})


@query("u1_register_statistic", oracle("""
SELECT chr_id, CAST(max(abs(value_a - value_b)) AS BIGINT) AS largest_gap FROM al GROUP BY 1""", "points", "intervals_b",
    extra=aligned_sql(1000)))
def _(t):
    def gap(aligned, by):
        return aligned.groupBy(*by).agg(F.max(F.abs(F.col("value_a") - F.col("value_b"))).alias("largest_gap"))

    co.register_statistic("largest_gap", gap)
    return co.correlate(t.points, t.intervals_b, "largest_gap", 1000, pos_a="pos").drop("build")
