"""Registered queries: sequence operators over whole documents read as sequences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spanframe.functions import classify
from spanframe.functions import constants as K
from spanframe.functions.coords import round_to as r
from spanframe.operators.sequence import constructs, flags, motifs, steps, thermo, variants
from spanframe.plans.adapters import oracle
from spanframe.plans.registry import query
from spanframe.session import scratch_dir

# Shared oracle CTEs: one row per base, per step, and the step property table.
BASES = """SELECT seq_id, unnest(generate_series(0, length(sequence) - 1)) AS i, unnest(string_split(sequence, '')) AS b
  FROM sequences WHERE length(sequence) > 0"""
STEPS = """SELECT seq_id, i, d FROM (SELECT seq_id, i, b || lead(b) OVER (PARTITION BY seq_id ORDER BY i) AS d FROM bases)
  WHERE d IS NOT NULL"""
_COLS = list(K.STEP_PROPERTIES)
PROPS = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([f"'{d}'", *[f"{round(K.STEP_PROPERTIES[c][d] * 100)}" for c in _COLS]]) + ")" for d in K.DINUCLEOTIDES
) + f") AS p(d, {', '.join(_COLS)})"
COUNTS = "SELECT seq_id, d, count(*) AS c FROM steps GROUP BY 1, 2"
BASE = {"bases": BASES, "steps": STEPS, "props": PROPS, "counts": COUNTS}


def total(col: str) -> str:
    return f"(CAST(coalesce(sum(c * {col}), 0) AS DOUBLE) / 100.0)"


def seq_oracle(body: str, *views: str, **extra: str) -> str:
    return oracle(body, "sequences", *views, extra={**BASE, **extra})


SALT = 0.368 * math.log(0.15)
LIST = "(SELECT s.seq_id, c.d, c.c FROM sequences s LEFT JOIN counts c ON s.seq_id = c.seq_id) x LEFT JOIN props USING (d)"


@query("q1_thermo_summary", seq_oracle(f"""
SELECT seq_id, CAST(n AS INT) AS n_steps, round(h, 2) + 0.0 AS total_delta_h, round(s, 2) + 0.0 AS total_delta_s,
       round(g, 2) + 0.0 AS total_delta_g_37, round(gs, 2) + 0.0 AS total_delta_g_salt,
       CASE WHEN n > 0 THEN round(gs / n, 3) ELSE 0 END AS mean_delta_g_per_step
FROM (SELECT *, h - (273.15 + 37) * (s + n * ({SALT!r})) / 1000.0 AS gs FROM (
  SELECT seq_id, coalesce(sum(c), 0) AS n, {total('delta_h')} AS h, {total('delta_s')} AS s, {total('delta_g_37')} AS g
  FROM {LIST} GROUP BY 1))"""))
def _(t):
    out = thermo.thermo_summary(t.sequences, 150.0)
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in out.columns if c.startswith("total")})


@query("q2_thermo_profile", seq_oracle("""
SELECT seq_id, i, d AS dinucleotide, delta_h / 100.0 AS delta_h, delta_s / 100.0 AS delta_s,
       delta_g_37 / 100.0 AS delta_g_37, round(g / CAST(1e6 AS DOUBLE), 6) AS delta_g_salt,
       round(CAST(sum(g) OVER (PARTITION BY seq_id ORDER BY i) AS DOUBLE) / CAST(1e6 AS DOUBLE), 6) AS cumulative_dg
FROM (SELECT *, CAST(round((delta_h / 100.0 - (273.15 + 37) * (delta_s / 100.0) / 1000.0) * 1e6) AS BIGINT) AS g
      FROM steps JOIN props USING (d))"""))
def _(t):
    return thermo.thermo_profile(t.sequences, digits=6).withColumn("i", F.col("i").cast("long"))


@query("q3_extinction", seq_oracle(f"""
SELECT x.seq_id, CAST(n AS INT) AS n_steps, e - m AS total_extinction_260, e AS sum_dinucleotide_ext,
       m AS sum_internal_mono_ext
FROM (SELECT seq_id, coalesce(sum(c), 0) AS n, {total('extinction_260')} AS e FROM {LIST} GROUP BY 1) x
JOIN (SELECT s.seq_id, CAST(coalesce(sum(CASE b.b WHEN 'A' THEN 15400 WHEN 'C' THEN 7400 WHEN 'G' THEN 11500 ELSE 8700 END)
        FILTER (b.i > 0 AND b.i < length(s.sequence) - 1), 0) AS DOUBLE) AS m
      FROM sequences s LEFT JOIN bases b ON s.seq_id = b.seq_id GROUP BY 1) y ON x.seq_id = y.seq_id"""))
def _(t):
    return thermo.extinction(t.sequences)


def mean_sql(names: dict[str, tuple[str, int]], more: str = "") -> str:
    cols = ", ".join(f"round({total(c)} / sum(c), {d}) + 0.0 AS {a}" for a, (c, d) in names.items())
    return f"SELECT seq_id, CAST(coalesce(sum(c), 0) AS INT) AS n_steps, {cols}{more} FROM {LIST} GROUP BY 1"


@query("q4_form_propensity", seq_oracle(mean_sql(
    {"mean_a_form_propensity": ("a_form", 3), "mean_z_form_propensity": ("z_form", 3)},
    f", round({total('z_form')}, 2) AS total_z_penalty")))
def _(t):
    return thermo.form_propensity(t.sequences)


@query("q4_groove", seq_oracle(mean_sql({f"mean_{g}": (g, 2) for g in thermo.GROOVES})))
def _(t):
    return thermo.groove(t.sequences)


@query("q4_structural", seq_oracle(mean_sql({f"mean_{p}": (p, 3) for p in thermo.STRUCTURE})))
def _(t):
    return thermo.structural(t.sequences)


@query("q5_contextual", seq_oracle("""
SELECT seq_id, count(*) AS n_steps, round(avg(b), 4) AS mean_bubble_propensity, round(max(b), 4) AS max_bubble_propensity,
       round(avg(f), 2) AS mean_flexibility
FROM (SELECT seq_id, 1 / (1 + exp(-4.0 * (avg(delta_g_37 / 100.0) OVER w + 1.2))) AS b, avg(deformability / 100.0) OVER w AS f
      FROM steps JOIN props USING (d) WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
GROUP BY 1"""))
def _(t):
    return thermo.contextual(t.sequences)


@query("q6_curvature", seq_oracle("""
SELECT seq_id, count(*) AS n_steps, round(avg(k), 3) AS mean_curvature, round(max(k), 3) AS max_curvature FROM (
  SELECT seq_id, sqrt(power(sum(x) OVER w, 2) + power(sum(y) OVER w, 2)) / count(*) OVER w AS k FROM (
    SELECT seq_id, i, roll * cos(a) - tilt * sin(a) AS x, roll * sin(a) + tilt * cos(a) AS y FROM (
      SELECT seq_id, i, roll / 100.0 AS roll, tilt / 100.0 AS tilt,
             radians((sum(twist) OVER (PARTITION BY seq_id ORDER BY i)) / 100.0) AS a FROM steps JOIN props USING (d)))
  WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) GROUP BY 1"""))
def _(t):
    return thermo.curvature(t.sequences)


def hits_sql(pattern: str, text: str = "sequence") -> str:
    return f"""SELECT seq_id, k, gaps[k] AS gap, m[k] AS hit, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x)))
  + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
  SELECT seq_id, gaps, m, unnest(range(1, len(m) + 1)) AS k FROM (
    SELECT seq_id, string_split_regex({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS m FROM sequences))"""


G4, RUN5, RY = motifs.G4, motifs.runs_pattern(5), motifs.ALTERNATING_8


@query("q7_motif_hits", seq_oracle("""
SELECT seq_id, start, CAST(start + length(hit) AS BIGINT) AS "end", 'g_quadruplex' AS motif, CAST(NULL AS DOUBLE) AS score FROM g4
UNION ALL SELECT seq_id, start, CAST(start + length(hit) AS BIGINT), 'poly_' || hit[1], NULL FROM runs
UNION ALL SELECT z.seq_id, z.start, CAST(z.start + length(z.hit) AS BIGINT), 'z_dna_prone', round(avg(p.z_form / 100.0), 2) FROM zr z
  JOIN steps s ON s.seq_id = z.seq_id AND s.i >= z.start AND s.i < z.start + length(z.hit) - 1 JOIN props p USING (d)
  GROUP BY z.seq_id, z.start, z.hit HAVING sum(p.z_form) / 100.0 / count(*) < 2.5""",
    g4=hits_sql(G4), runs=hits_sql(RUN5), zr=hits_sql(RY, "translate(sequence, 'AGCT', 'RRYY')")))
def _(t):
    return motifs.motif_hits(t.sequences)


RC = "reverse(translate({x}, 'ACGT', 'TGCA'))"


@query("q8_inverted_repeats", seq_oracle(f"""
SELECT seq_id, i AS "start", i + 12 + loop_length AS "end", CAST(loop_length AS INT) AS loop_length, stem AS stem_5prime FROM (
  SELECT seq_id, i, stem, instr(ahead, {RC.format(x='stem')}) - 1 AS loop_length FROM (
    SELECT s.seq_id, b.i, substring(s.sequence, b.i + 1, 6) AS stem, substring(s.sequence, b.i + 7, 18) AS ahead
    FROM sequences s JOIN bases b USING (seq_id) WHERE b.i < length(s.sequence) - 13)) WHERE loop_length >= 3"""))
def _(t):
    out = motifs.inverted_repeats(t.sequences)
    return out.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


GC_SQL = "CAST(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')) AS DOUBLE)"


@query("q9_gc_cpg", seq_oracle("""
SELECT s.seq_id, CAST(length(s.sequence) AS INT) AS length_bp, round(CASE WHEN n > 0 THEN (c + g) / CAST(n AS DOUBLE) ELSE 0 END, 6) AS gc_content,
       CAST(p AS INT) AS cpg_count, round(CASE WHEN c * g > 0 THEN p / (c * g / CAST(n - 1 AS DOUBLE)) ELSE 0 END, 6) AS obs_exp,
       round(CASE WHEN c * g > 0 THEN p * n / CAST(c * g AS DOUBLE) ELSE 0 END, 6) AS obs_exp_window
FROM sequences s JOIN (SELECT q.seq_id, count(b.b) AS n, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g
  FROM sequences q LEFT JOIN bases b USING (seq_id) GROUP BY 1) x USING (seq_id)
JOIN (SELECT q.seq_id, count(*) FILTER (d = 'CG') AS p FROM sequences q LEFT JOIN steps USING (seq_id) GROUP BY 1) y USING (seq_id)"""))
def _(t):
    out = thermo.gc_cpg(t.sequences)
    return out.withColumns({c: F.round(c, 6) for c in ("gc_content", "obs_exp", "obs_exp_window")})


@query("q10_cpg_sites", seq_oracle("""
SELECT seq_id, i AS pos, round(near_gc, 6) AS gc_content FROM (
  SELECT seq_id, i, d, avg(gc) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN 500 PRECEDING AND 499 FOLLOWING) AS near_gc
  FROM (SELECT b.seq_id, b.i, s.d, CASE WHEN b.b IN ('G', 'C') THEN 1 ELSE 0 END AS gc
        FROM bases b LEFT JOIN steps s ON b.seq_id = s.seq_id AND b.i = s.i)) WHERE d = 'CG'"""))
def _(t):
    return motifs.cpg_sites(t.sequences).select(
        "seq_id", F.col("pos").cast("long").alias("pos"), F.round("gc_content", 6).alias("gc_content")
    )


RUNNING = """SELECT seq_id, i, c, g, p, sum(c) OVER w AS wc, sum(g) OVER w AS wg,
  sum(p) OVER (PARTITION BY seq_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 198 FOLLOWING) AS wp, count(*) OVER w AS wn FROM (
  SELECT b.seq_id, b.i, CAST(b.b = 'C' AS INT) AS c, CAST(b.b = 'G' AS INT) AS g, CAST(coalesce(s.d = 'CG', false) AS INT) AS p
  FROM bases b LEFT JOIN steps s ON b.seq_id = s.seq_id AND b.i = s.i)
  WINDOW w AS (PARTITION BY seq_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING)"""
GOOD = "SELECT seq_id, i FROM running WHERE wn = 200 AND (wc + wg) / 200.0 >= 0.5 AND wc * wg > 0 AND wp / (wc * wg / CAST(200 AS DOUBLE)) >= 0.6"


def islands_sql(gap: int) -> str:
    return f"""SELECT seq_id, min(i) AS s, max(i) + 200 AS e FROM (
  SELECT seq_id, i, sum(CASE WHEN prev IS NULL OR i - (prev + 200) > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY i) AS grp
  FROM (SELECT seq_id, i, lag(i) OVER (PARTITION BY seq_id ORDER BY i) AS prev FROM good)) GROUP BY seq_id, grp"""


ISLAND_STATS = """SELECT k.seq_id, k.s AS start_pos, k.e AS end_pos, k.e - k.s AS length_bp,
  (sum(r.c) + sum(r.g)) / CAST(k.e - k.s AS DOUBLE) AS gc,
  sum(r.p) FILTER (r.i < k.e - 1) / (CAST(sum(r.c) AS DOUBLE) * sum(r.g) / (k.e - k.s - 1)) AS obs_exp_cpg,
  sum(r.p) FILTER (r.i < k.e - 1) * (k.e - k.s) / (CAST(sum(r.c) AS DOUBLE) * sum(r.g)) AS oe_n,
  CAST(sum(r.p) FILTER (r.i < k.e - 1) AS BIGINT) AS cpg_count
  FROM isl k JOIN running r ON k.seq_id = r.seq_id AND r.i >= k.s AND r.i < k.e GROUP BY k.seq_id, k.s, k.e"""
ISLAND_OUT = "SELECT seq_id, start_pos, end_pos, length_bp, round(gc, 6) AS gc, round(obs_exp_cpg, 6) AS obs_exp_cpg, cpg_count FROM st"


def _islands_out(df):
    return df.select("seq_id", "start_pos", "end_pos", "length_bp", F.round("gc", 6).alias("gc"),
                     F.round("obs_exp_cpg", 6).alias("obs_exp_cpg"), "cpg_count")


@query("q11_cpg_islands", seq_oracle(ISLAND_OUT, running=RUNNING, good=GOOD, isl=islands_sql(0), st=ISLAND_STATS))
def _(t):
    return _islands_out(motifs.cpg_islands(t.sequences))


@query("q11_cpg_islands_genome", seq_oracle(ISLAND_OUT + " WHERE gc >= 0.5 AND oe_n >= 0.6", running=RUNNING, good=GOOD,
                                             isl=islands_sql(100), st=ISLAND_STATS))
def _(t):
    return _islands_out(motifs.cpg_islands(t.sequences, 100, True))


@query("q12_homopolymers", seq_oracle("""
SELECT seq_id, start + 1 AS "start", CAST(start + length(hit) AS BIGINT) AS "end", hit[1] AS base, CAST(length(hit) AS INT) AS length
FROM h""", h=hits_sql(motifs.runs_pattern(6))))
def _(t):
    return motifs.homopolymers(t.sequences, 6)


@query("q12_dinuc_repeats", seq_oracle("""
SELECT seq_id, start + 1 AS "start", CAST(start + length(hit) AS BIGINT) AS "end", hit[1:2] AS motif, CAST(length(hit) AS INT) AS length
FROM h""", h=hits_sql(motifs.tandem_pattern(8))))
def _(t):
    return motifs.dinuc_repeats(t.sequences, 8)


KMERS = """SELECT s.seq_id, b.i, substring(s.sequence, b.i + 1, 15) AS kmer FROM sequences s JOIN bases b USING (seq_id)
  WHERE b.i <= length(s.sequence) - 15"""
REPEATS = f"""SELECT seq_id, 'direct' AS kind, kmer, min(i) + 1 AS "first", min(i) FILTER (n = 2) + 1 AS "second" FROM (
  SELECT *, row_number() OVER (PARTITION BY seq_id, kmer ORDER BY i) AS n FROM kmers) GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL
SELECT a.seq_id, 'inverted', a.kmer, max(k.i) + 1, a.hit + 1 FROM (
  SELECT x.seq_id, x.kmer, min(y.i) AS hit FROM (SELECT seq_id, kmer, min(i) AS i FROM kmers GROUP BY 1, 2) x
  JOIN kmers y ON x.seq_id = y.seq_id AND y.kmer = {RC.format(x='x.kmer')} AND y.i > x.i GROUP BY 1, 2) a
JOIN kmers k ON k.seq_id = a.seq_id AND k.kmer = a.kmer AND k.i < a.hit GROUP BY a.seq_id, a.kmer, a.hit"""


@query("q13_kmer_repeats", seq_oracle(REPEATS, kmers=KMERS))
def _(t):
    out = motifs.kmer_repeats(t.sequences)
    return out.withColumns({"first": F.col("first").cast("long"), "second": F.col("second").cast("long")})


def melt_sql(na: float, oligo: float) -> str:
    ln_na, log_na, ct = 0.368 * math.log(na), 16.6 * math.log10(na), 1.987 * math.log(oligo * 1e-9 / 4.0)
    return f"""SELECT seq_id, n, CASE WHEN len BETWEEN 2 AND 60 AND n > 0 THEN CASE WHEN ent >= 0 THEN 0 ELSE ent_h / ent - 273.15 END
    WHEN len > 0 THEN 81.5 + ({log_na!r}) + 41.0 * gc - 600.0 / len ELSE 0 END AS tm,
    CASE WHEN len BETWEEN 2 AND 60 AND n > 0 THEN 'nearest_neighbor' ELSE 'empirical' END AS tm_method FROM (
    SELECT *, (h + CASE WHEN sequence[1] IN ('G', 'C') THEN 0.1 ELSE 2.3 END + CASE WHEN sequence[-1] IN ('G', 'C') THEN 0.1 ELSE 2.3 END) * 1000 AS ent_h,
      s + CASE WHEN sequence[1] IN ('G', 'C') THEN -2.8 ELSE 4.1 END + CASE WHEN sequence[-1] IN ('G', 'C') THEN -2.8 ELSE 4.1 END
      + n * ({ln_na!r}) + ({ct!r}) AS ent FROM (
      SELECT q.seq_id, q.sequence, length(q.sequence) AS len, {GC_SQL.replace('sequence', 'q.sequence')} / greatest(length(q.sequence), 1) AS gc,
        z.n, z.h, z.s FROM sequences q JOIN (SELECT seq_id, coalesce(sum(c), 0) AS n, {total('delta_h')} AS h, {total('delta_s')} AS s
        FROM {LIST} GROUP BY 1) z USING (seq_id)))"""


@query("q14_melting_temp", seq_oracle("SELECT seq_id, round(tm, 1) AS melting_temp, tm_method FROM melt", melt=melt_sql(0.15, 250)))
def _(t):
    return thermo.melting_temp(t.sequences, 150.0)


GCW = f"""SELECT seq_id, w, w * 100 + 1 AS s, least((w + 1) * 100, n) AS e, round({GC_SQL} / length(sequence), 4) AS gc FROM (
  SELECT seq_id, w, n, substring(sequence, w * 100 + 1, 100) AS sequence FROM (SELECT seq_id, sequence, length(sequence) AS n,
  unnest(range(0, CAST(ceil(length(sequence) / 100.0) AS BIGINT))) AS w FROM sequences))"""
DGW = """SELECT seq_id, i // 100 AS w, round(CAST(sum(delta_g_37) AS DOUBLE) / 100.0 / count(*), 4) AS dg FROM steps JOIN props USING (d) GROUP BY 1, 2"""
FLAG_SQL = """
SELECT seq_id, 'feature' AS type, 'CPG_ISLAND' AS code, s + 1 AS "start", e AS "end" FROM isl
UNION ALL SELECT seq_id, 'info', CASE WHEN gc > 0.70 THEN 'HIGH_GC' ELSE 'LOW_GC' END, s, e FROM gcw WHERE gc > 0.70 OR gc < 0.30
UNION ALL SELECT d.seq_id, 'info', CASE WHEN dg > -0.8 THEN 'LOW_STABILITY' ELSE 'HIGH_STABILITY' END, w * 100 + 1,
  least((w + 1) * 100, length(q.sequence)) FROM dgw d JOIN sequences q USING (seq_id) WHERE dg > -0.8 OR dg < -1.8
UNION ALL SELECT seq_id, 'feature', 'HOMOPOLYMER', start + 1, start + length(hit) FROM runs
UNION ALL SELECT seq_id, 'feature', 'LONG_HOMOPOLYMER', start + 1, start + length(hit) FROM runs WHERE length(hit) >= 12
UNION ALL SELECT seq_id, 'feature', 'DINUC_REPEAT', start + 1, start + length(hit) FROM tandem
UNION ALL SELECT seq_id, 'warning', 'EXTREME_GC_WINDOW', s, e FROM gcw WHERE gc > 0.80 OR gc < 0.15
UNION ALL SELECT seq_id, 'warning', 'SILENCING_RISK', NULL, NULL FROM isl GROUP BY seq_id HAVING count(*) >= 3
UNION ALL SELECT seq_id, 'feature', CASE kind WHEN 'direct' THEN 'DIRECT_REPEAT' ELSE 'INVERTED_REPEAT' END, "first", "first" + 14
  FROM rep"""
FLAG_CTES = {"running": RUNNING, "good": GOOD, "isl": islands_sql(0), "gcw": GCW, "dgw": DGW,
             "runs": hits_sql(motifs.runs_pattern(8)), "tandem": hits_sql(motifs.tandem_pattern(20)), "kmers": KMERS, "rep": REPEATS}


def once(t, df):
    """A result that is read twice, written to the shared folder."""
    path = scratch_dir(t.spark, "once")
    df.write.parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)


EVAL_SQL = f"""
SELECT q.seq_id, CASE WHEN length(q.sequence) < 10 THEN 'too_short' END AS reject,
  CASE WHEN ok THEN CAST(length(q.sequence) AS INT) END AS length_bp, CASE WHEN ok THEN round({GC_SQL.replace('sequence', 'q.sequence')} / greatest(1, length(q.sequence)), 4) END AS gc_content,
  CASE WHEN ok THEN round(tm, 1) END AS melting_temp, CASE WHEN ok THEN coalesce(f.n_flags, 0) END AS n_flags,
  CASE WHEN ok THEN coalesce(f.n_warning, 0) END AS n_warning, CASE WHEN ok THEN coalesce(f.n_info, 0) END AS n_info,
  CASE WHEN ok THEN coalesce(f.isl, 0) END AS cpg_island_count
FROM (SELECT *, length(sequence) >= 10 AS ok FROM sequences) q JOIN melt USING (seq_id) LEFT JOIN (
  SELECT seq_id, count(*) AS n_flags, count(*) FILTER (type = 'warning') AS n_warning, count(*) FILTER (type = 'info') AS n_info,
  count(*) FILTER (code = 'CPG_ISLAND') AS isl FROM fl GROUP BY 1) f USING (seq_id)"""


@query("q15_evaluate", seq_oracle(EVAL_SQL, **FLAG_CTES, melt=melt_sql(1.0, 250), fl=FLAG_SQL))
def _(t):
    return flags.evaluate(t.sequences).select(
        "seq_id", "reject", "length_bp", "gc_content", "melting_temp", "n_flags", "n_warning", "n_info", "cpg_island_count"
    )


@query("q15_profile_windows", seq_oracle("SELECT seq_id, CAST(w AS INT) AS w, gc, dg FROM gcw LEFT JOIN dgw USING (seq_id, w)", gcw=GCW, dgw=DGW))
def _(t):
    return flags.profile_windows(t.sequences)


@query("q16_flags", seq_oracle(FLAG_SQL, **FLAG_CTES))
def _(t):
    return flags.flags(t.sequences)


@query("q17_compare", seq_oracle("""
SELECT a.seq_id, b.seq_id AS base_id, CAST(a.length_bp - b.length_bp AS DOUBLE) AS delta_length, round(a.gc_content - b.gc_content, 4) + 0.0 AS delta_gc,
       CAST(a.cpg_island_count - b.cpg_island_count AS DOUBLE) AS delta_cpg_islands, round(a.melting_temp - b.melting_temp, 4) + 0.0 AS delta_melting_temp,
       CAST(a.n_warning - b.n_warning AS DOUBLE) AS delta_warnings, round(a.dg - b.dg, 4) + 0.0 AS delta_mean_dg37
FROM ev a JOIN ev b ON b.seq_id = a.seq_id // 10 * 10 AND a.seq_id <> b.seq_id""", **FLAG_CTES, melt=melt_sql(1.0, 250), fl=FLAG_SQL, ev15=EVAL_SQL, ev=f"""
  SELECT e.*, CASE WHEN e.reject IS NULL THEN round(round(g, 2) / n, 3) END AS dg
  FROM ev15 e JOIN melt USING (seq_id) JOIN (SELECT seq_id, {total('delta_g_37')} AS g FROM {LIST} GROUP BY 1) USING (seq_id)"""))
def _(t):
    base = t.sequences.select("seq_id", (F.floor(F.col("seq_id") / 10) * 10).alias("base_id"))
    out = flags.compare(once(t, flags.evaluate(t.sequences)), base)
    deltas = ("delta_length", "delta_gc", "delta_cpg_islands", "delta_melting_temp", "delta_warnings", "delta_mean_dg37")
    return out.select("seq_id", "base_id", *[F.col(d).cast("double").alias(d) for d in deltas])


def parts(t):
    return t.sequences.select(F.floor(F.col("seq_id") / 4).alias("construct_id"), (F.col("seq_id") % 4).alias("part_no"),
                              "sequence", (F.floor(F.col("seq_id") / 4) % 2 == 0).alias("circular"))


PARTS = "SELECT *, seq_id // 4 AS construct_id, seq_id % 4 AS part_no, (seq_id // 4) % 2 = 0 AS circular FROM sequences"
JOINTS = """SELECT construct_id, part_no AS left_part, coalesce(nxt, first_part) AS right_part, right(sequence, 25) || coalesce(nh, fh) AS sequence
  FROM (SELECT *, lead(part_no) OVER w AS nxt, lead(left(sequence, 25)) OVER w AS nh, min(part_no) OVER v AS first_part,
        first_value(left(sequence, 25)) OVER w AS fh, count(*) OVER v AS n FROM parts
        WINDOW w AS (PARTITION BY construct_id ORDER BY part_no), v AS (PARTITION BY construct_id))
  WHERE nxt IS NOT NULL OR (circular AND n > 1)"""


@query("q18_junctions", seq_oracle("SELECT * FROM joints", parts=PARTS, joints=JOINTS))
def _(t):
    return constructs.junctions(parts(t))


def mer_sql(k: int) -> str:
    """Every k bases in a row with their construct and part; shorter at a sequence's end."""
    return f"""SELECT seq_id // 4 AS construct_id, seq_id % 4 AS part_no, i, substring(sequence, CAST(i + 1 AS BIGINT), {k}) AS mer
  FROM (SELECT seq_id, sequence, unnest(range(0, length(sequence))) AS i FROM sequences)"""


K13 = "SELECT construct_id, part_no, mer AS kmer, min(i) + 1 AS position FROM m13 WHERE length(mer) = 13 GROUP BY 1, 2, 3"
SITES = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in K.RESTRICTION_SITES.items()) + ") AS v(enzyme, site)"


CONSTRUCT_FLAGS = """
SELECT construct_id, 'INTERNAL_RESTRICTION_SITE' AS code, part_no, enzyme AS detail, i + 1 AS position
  FROM m8 JOIN rs ON left(m8.mer, length(rs.site)) = rs.site
UNION ALL SELECT construct_id, 'JUNCTION_HOMOPOLYMER', left_part, hit[1] || 'x' || length(hit), start + 1 FROM jr
UNION ALL SELECT a.construct_id, 'CROSS_PART_REPEAT', a.part_no, a.kmer || '@' || b.part_no, a.position
  FROM k13 a JOIN k13 b ON a.construct_id = b.construct_id AND a.kmer = b.kmer AND a.part_no < b.part_no
UNION ALL SELECT p.construct_id, 'EXTREME_GC_WINDOW', p.part_no, CASE WHEN g.gc < 0.25 THEN 'low' ELSE 'high' END, o.off + g.s
  FROM gcw g JOIN parts p USING (seq_id) JOIN (SELECT seq_id, coalesce(sum(length(sequence)) OVER (PARTITION BY construct_id ORDER BY part_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM parts) o USING (seq_id) WHERE g.gc < 0.25 OR g.gc > 0.75"""
CONSTRUCT_CTES = {
    "parts": PARTS, "joints": JOINTS, "m8": mer_sql(8), "m13": mer_sql(13), "k13": K13, "rs": SITES, "gcw": GCW,
    "jr": hits_sql(motifs.runs_pattern(7)).replace("SELECT seq_id", "SELECT construct_id, left_part").replace("FROM sequences", "FROM joints"),
}


@query("q18_construct_flags", seq_oracle(CONSTRUCT_FLAGS, **CONSTRUCT_CTES))
def _(t):
    return constructs.construct_flags(parts(t))


CONSTRUCT_REPORT = f"""
SELECT construct_id, total_length_bp, n_parts, round(gc, 6) AS gc_content, n_junctions, coalesce(n, 0) AS n_assembly_flags FROM (
  SELECT construct_id, CAST(sum(length(sequence)) AS BIGINT) AS total_length_bp, count(*) AS n_parts, sum({GC_SQL}) / sum(length(sequence)) AS gc,
       count(*) - 1 + CASE WHEN bool_or(circular) AND count(*) > 1 THEN 1 ELSE 0 END AS n_junctions FROM parts GROUP BY 1)
LEFT JOIN (SELECT construct_id, count(*) AS n FROM cf GROUP BY 1) USING (construct_id)"""


@query("q18_construct_report", seq_oracle(CONSTRUCT_REPORT, **CONSTRUCT_CTES, cf=CONSTRUCT_FLAGS))
def _(t):
    out = constructs.construct_report(parts(t))
    return out.select("construct_id", "total_length_bp", "n_parts", F.round("gc_content", 6).alias("gc_content"), "n_junctions", "n_assembly_flags")


@query("q18_compare_constructs", seq_oracle("""
SELECT a.construct_id, b.construct_id AS base_id, a.total_length_bp - b.total_length_bp AS delta_total_length_bp, round(a.gc_content - b.gc_content, 4) + 0.0 AS delta_gc_content,
  a.n_assembly_flags - b.n_assembly_flags AS delta_n_assembly_flags FROM rep a JOIN rep b ON b.construct_id = a.construct_id // 5 * 5 AND a.construct_id <> b.construct_id""",
    **CONSTRUCT_CTES, cf=CONSTRUCT_FLAGS, rep=CONSTRUCT_REPORT))
def _(t):
    report = once(t, constructs.construct_report(parts(t)).withColumn("gc_content", F.round("gc_content", 6)))
    base = report.select("construct_id", (F.floor(F.col("construct_id") / 5) * 5).alias("base_id"))
    out = constructs.compare_constructs(report, base)
    return out.withColumn("delta_gc_content", F.round("delta_gc_content", 4) + F.lit(0.0))


TWO = """SELECT variant_id, least(pos, 50) AS p, substring(s, pos + 1 - least(pos, 50), least(pos, 50)) || ref || substring(s, pos + 2, 50) AS rs,
  substring(s, pos + 1 - least(pos, 50), least(pos, 50)) || alt || substring(s, pos + 2, 50) AS al
  FROM (SELECT v.*, q.sequence AS s FROM variants v JOIN sequences q USING (seq_id))"""
ALLELES = """SELECT variant_id, allele, sequence, p FROM (SELECT variant_id, 'ref' AS allele, rs AS sequence, p FROM two
  UNION ALL SELECT variant_id, 'alt', al, p FROM two)"""
VSTEP = """SELECT variant_id, allele, i, substring(sequence, i + 1, 2) AS d FROM (SELECT *, unnest(range(0, length(sequence) - 1)) AS i FROM va)"""
VPER = """SELECT variant_id, allele, (coalesce(nullif(corr(x, y10), 'nan'::DOUBLE), 0) + coalesce(nullif(corr(x, y11), 'nan'::DOUBLE), 0)) / 2 AS per FROM (
  SELECT variant_id, allele, x, lag(x, 10) OVER w AS y10, lag(x, 11) OVER w AS y11 FROM (SELECT variant_id, allele, i,
    CASE WHEN d IN ('AA', 'TT', 'AT', 'TA') THEN 1.0 ELSE 0.0 END AS x FROM vs) WINDOW w AS (PARTITION BY variant_id, allele ORDER BY i)) GROUP BY 1, 2"""


SUMMED = {"dg37": "delta_g_37", "dh": "delta_h", "ds": "delta_s"}
STEP_MEANS = (*thermo.STRUCTURE, *thermo.GROOVES)
# Means of about 100 steps often end in a tie at the third place: rounded in whole numbers, half away from zero.
VALL = f"""SELECT variant_id, allele, {", ".join(f"round(sum({c}) / 100.0, 2) AS {k}" for k, c in SUMMED.items())},
  round((sum(delta_h) / 100.0 - (273.15 + 37) * (sum(delta_s) / 100.0) / 1000.0) / count(*), 3) AS mean_dg,
  {", ".join(f"sign(sum({c})) * ((20 * abs(CAST(sum({c}) AS BIGINT)) + count(*)) // (2 * count(*))) / 1000.0 AS mean_{c}" for c in STEP_MEANS)} FROM vs JOIN props USING (d) GROUP BY 1, 2"""
VTEXT = f"""SELECT variant_id, allele, len(regexp_extract_all(sequence, '{motifs.G4}')) AS g4, len(regexp_extract_all(sequence, '{motifs.runs_pattern(5)}')) AS runs,
  CASE WHEN p > 0 AND substring(sequence, p, 2) = 'CG' THEN 1 ELSE 0 END + CASE WHEN substring(sequence, p + 1, 2) = 'CG' THEN 1 ELSE 0 END AS cpg_here,
  (length(sequence) - length(replace(sequence, 'CG', ''))) // 2 AS cpg_all FROM va"""
VBEND = """SELECT variant_id, allele, round(avg(k), 3) AS mean_curvature, round(max(k), 3) AS max_curvature FROM (
  SELECT variant_id, allele, sqrt(power(sum(x) OVER w, 2) + power(sum(y) OVER w, 2)) / count(*) OVER w AS k FROM (
    SELECT variant_id, allele, i, roll * cos(a) - tilt * sin(a) AS x, roll * sin(a) + tilt * cos(a) AS y FROM (
      SELECT variant_id, allele, i, roll / 100.0 AS roll, tilt / 100.0 AS tilt,
             radians((sum(twist) OVER (PARTITION BY variant_id, allele ORDER BY i)) / 100.0) AS a FROM vs JOIN props USING (d)))
  WINDOW w AS (PARTITION BY variant_id, allele ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) GROUP BY 1, 2"""
VVALUES = [*SUMMED, "mean_dg", *(f"mean_{c}" for c in STEP_MEANS), "g4", "runs", "cpg_here", "cpg_all", "mean_curvature", "max_curvature"]
VSIDE = """SELECT * FROM vall JOIN vtext USING (variant_id, allele) JOIN vbend USING (variant_id, allele) LEFT JOIN vper USING (variant_id, allele)"""
VDELTA = f"""SELECT variant_id, {", ".join(f"CAST(round(a.{c} - r.{c}, 4) AS DOUBLE) + 0.0 AS delta_{c}" for c in VVALUES)}, round(coalesce(a.per, 0) - coalesce(r.per, 0), 4) + 0.0 AS delta_periodicity,
  round(round(a.mean_dg - r.mean_dg, 4) * 3.0, 4) + 0.0 AS delta_tm
  FROM (SELECT * FROM vside WHERE allele = 'ref') r JOIN (SELECT * FROM vside WHERE allele = 'alt') a USING (variant_id)"""
VSAID = """SELECT *, CASE WHEN delta_cpg_here > 0 THEN 'cpg_created' WHEN delta_cpg_here < 0 THEN 'cpg_destroyed' ELSE 'no_change' END AS cpg_impact,
  CASE WHEN delta_periodicity < -0.05 THEN 'nucleosome_destabilized' WHEN delta_periodicity > 0.05 THEN 'nucleosome_stabilized' ELSE 'minimal_disruption' END AS nucleosome
  FROM vdelta"""


@query("q19_variant_deltas", seq_oracle("""
SELECT * EXCLUDE (said), CASE WHEN said = '' THEN 'minimal perturbation' ELSE said END AS mechanism FROM (SELECT *, concat_ws('; ',
  CASE WHEN delta_dg37 > 0.5 THEN 'destabilizes local duplex' WHEN delta_dg37 < -0.5 THEN 'stabilizes local duplex' END,
  CASE WHEN delta_tm > 1.0 THEN 'raises melting temperature' WHEN delta_tm < -1.0 THEN 'lowers melting temperature' END,
  CASE WHEN cpg_impact <> 'no_change' THEN cpg_impact END,
  CASE WHEN delta_g4 > 0 THEN 'g_quadruplex created' WHEN delta_g4 < 0 THEN 'g_quadruplex destroyed' END,
  CASE WHEN nucleosome <> 'minimal_disruption' THEN nucleosome END,
  CASE WHEN abs(delta_mean_twist) > 0.5 THEN 'alters helical twist' END) AS said FROM vsaid)""",
    "variants", two=TWO, va=ALLELES, vs=VSTEP, vall=VALL, vtext=VTEXT, vbend=VBEND, vper=VPER, vside=VSIDE, vdelta=VDELTA, vsaid=VSAID))
def _(t):
    out = variants.mechanisms(variants.variant_deltas(t.variants, t.sequences))
    whole = [c for c in out.columns if c.startswith("delta_")]
    return out.select("variant_id", *[F.col(c).cast("double").alias(c) for c in whole], "cpg_impact", "nucleosome", F.array_join("mechanism", "; ").alias("mechanism"))


WIN = """SELECT seq_id, w * 1000 AS start_pos, substring(sequence, w * 1000 + 1, 1000) AS sequence FROM (SELECT seq_id, sequence,
  unnest(range(0, CAST(ceil(length(sequence) / 1000.0) AS BIGINT))) AS w FROM sequences) WHERE length(sequence) - w * 1000 >= 500"""


def n_match(pattern: str) -> str:
    return f"len(regexp_extract_all(sequence, '{pattern}'))"


@query("q20_nonb_density", seq_oracle(f"""
SELECT seq_id, CAST(start_pos AS INT) AS start_pos, round(g4 / kb, 4) AS g4, round(z / kb, 4) AS zdna, round(cr / kb, 4) AS cruciform,
  round(t / kb, 4) AS triplex, round(rl, 4) AS rloop FROM (SELECT *, length(sequence) / 1000.0 AS kb,
  {n_match(G4)} + {n_match(motifs.C4)} AS g4, {n_match(motifs.ALTERNATING_12)} AS z, {n_match(motifs.TRIPLEX[0])} + {n_match(motifs.TRIPLEX[1])} AS t,
  (SELECT count(*) FROM (SELECT substring(sequence, CAST(x.j + 1 AS BIGINT), 6) AS stem, substring(sequence, CAST(x.j + 7 AS BIGINT), 14) AS ah FROM (SELECT unnest(range(0, length(sequence) - 13)) AS j) x)
   WHERE instr(ah, {RC.format(x='stem')}) > 0) AS cr,
  (SELECT coalesce(sum(abs(CAST(g - c AS DOUBLE) / (g + c)) * (g / CAST(50 AS DOUBLE))), 0) / greatest(1, count(*)) FROM (
    SELECT length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'C', '')) AS c FROM (
      SELECT substring(sequence, CAST(x.j + 1 AS BIGINT), 50) AS s FROM (SELECT unnest(range(0, length(sequence) - 49, 25)) AS j) x)) WHERE g + c > 0) AS rl
  FROM win)""", win=WIN))
def _(t):
    out = motifs.nonb_density(t.sequences)
    return out.select("seq_id", "start_pos", *[F.round(c, 4).alias(c) for c in ("g4", "zdna", "cruciform", "triplex", "rloop")])


P_OPEN = "exp((delta_h / 100.0 - k * (delta_s / 100.0) / 1000.0) / (0.001987 * k))"


@query("q21_melting_curve", seq_oracle(f"""
SELECT q.seq_id, round(coalesce(max(f) FILTER (k = 310.15), 0), 6) AS bubble_propensity,
  round(coalesce(min(k) FILTER (k <> 310.15 AND f >= 0.8) - min(k) FILTER (k <> 310.15 AND f >= 0.2), 120), 4) AS melting_width,
  round(1e-5 * exp(2 * (1 - CASE WHEN length(q.sequence) > 0 THEN max(gc) ELSE 1 END)) * 1e6, 6) AS cooperativity_e6
FROM (SELECT *, {GC_SQL} / greatest(1, length(sequence)) AS gc FROM sequences) q LEFT JOIN (
  SELECT seq_id, k, sum(c * ({P_OPEN} / (1 + {P_OPEN}))) / sum(c) AS f FROM counts JOIN props USING (d)
  CROSS JOIN (SELECT CAST(20 + 0.5 * i + 273.15 AS DOUBLE) AS k FROM range(241) r(i) UNION ALL SELECT CAST(310.15 AS DOUBLE)) GROUP BY 1, 2) c
ON q.seq_id = c.seq_id GROUP BY q.seq_id, q.sequence"""))
def _(t):
    out = thermo.melting_curve(t.sequences)
    return out.select("seq_id", F.round("bubble_propensity", 6).alias("bubble_propensity"),
                      F.round("melting_width", 4).alias("melting_width"),
                      F.round(F.col("melting_cooperativity") * 1e6, 6).alias("cooperativity_e6"))


SBS = ", ".join(f"coalesce(CAST(sum(CAST(round(abs(ml{a} + mr{a} - wl - wr) * 1e6) AS BIGINT)) FILTER (b = '{ref}') AS DOUBLE) / "
                f"nullif(count(*) FILTER (b = '{ref}'), 0) / CAST(1e6 AS DOUBLE), 0) AS sbs_{n}_ddg"
                for n, (ref, a) in K.SBS_CHANNELS.items())


@query("q22_sbs_ddg", seq_oracle(f"""
SELECT seq_id, {SBS} FROM sequences LEFT JOIN (SELECT x.seq_id, x.b, e1.e AS wl, e2.e AS wr,
  {', '.join(f"l{a}.e AS ml{a}, r{a}.e AS mr{a}" for a in 'AGT')} FROM (SELECT seq_id, i, b, lag(b) OVER w AS p, lead(b) OVER w AS q FROM bases
    WINDOW w AS (PARTITION BY seq_id ORDER BY i)) x JOIN en e1 ON e1.d = p || b JOIN en e2 ON e2.d = b || q
  {' '.join(f"JOIN en l{a} ON l{a}.d = p || '{a}' JOIN en r{a} ON r{a}.d = '{a}' || q" for a in 'AGT')}) USING (seq_id) GROUP BY 1""",
    en="SELECT d, delta_h / 100.0 - 310.15 * (delta_s / 100.0) / 1000.0 AS e FROM props"))
def _(t):
    return thermo.sbs_ddg(t.sequences)


@query("q24_dinuc_index", seq_oracle("""
SELECT seq_id, i, CAST((instr('ACGT', d[1]) - 1) * 4 + instr('ACGT', d[2]) - 1 AS INT) AS code FROM steps"""))
def _(t):
    return steps.dinuc_index(t.sequences).withColumn("i", F.col("i").cast("long"))


# Log-odds matrix of the example motif CCTCCCT, rows A C G T.
MOTIF = [[0.05, 0.05, 0.1, 0.05, 0.1, 0.05, 0.1], [0.8, 0.8, 0.1, 0.7, 0.6, 0.85, 0.1],
         [0.05, 0.1, 0.1, 0.1, 0.2, 0.05, 0.1], [0.1, 0.05, 0.7, 0.15, 0.1, 0.05, 0.7]]
ODDS = motifs.pwm_log_odds(MOTIF)
PWM_ROWS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', {pos}, '{K.BASES[b]}', {m[b][pos]!r})" for s, m in (("+", ODDS), ("-", [row[::-1] for row in ODDS[::-1]]))
    for b in range(4) for pos in range(7)) + ") AS v(strand, l, base, s)"


@query("q25_pwm_scan", seq_oracle("""
SELECT seq_id, i AS "start", i + 7 AS "end", strand, round(score, 6) AS score FROM (SELECT x.seq_id, x.i, p.strand, CAST(sum(p.s) AS DOUBLE) AS score FROM (
  SELECT c.seq_id, c.i - g.l AS i, g.l, c.b AS base FROM bases c CROSS JOIN (SELECT unnest(range(0, 7)) AS l) g WHERE c.i >= g.l) x
  JOIN pwm p ON p.l = x.l AND p.base = x.base GROUP BY 1, 2, 3 HAVING count(*) = 7) WHERE score >= 8""", pwm=PWM_ROWS))
def _(t):
    out = motifs.pwm_scan(t.sequences, MOTIF, 8.0)
    return out.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand",
                      F.round("score", 6).alias("score"))


@query("q26_persistence_length", seq_oracle(f"""
SELECT seq_id, round(49.0 + 43.75 * (gc - 0.30), 6) AS lp_nm, round((49.0 + 43.75 * (gc - 0.30) - 50) / 50 * 100, 6) AS pct_change
FROM (SELECT seq_id, {GC_SQL} / length(sequence) AS gc FROM sequences WHERE length(sequence) > 0)"""))
def _(t):
    from spanframe.functions.seqexpr import gc_fraction

    lp = classify.persistence_length(gc_fraction(F.col("sequence")))
    return t.sequences.where(F.length("sequence") > 0).select(
        "seq_id", F.round(lp, 6).alias("lp_nm"), F.round((lp - 50.0) / 50.0 * 100.0, 6).alias("pct_change")
    )


@query("q27_sequence_slice", seq_oracle("""
SELECT seq_id AS region_id, seq_id, 5 AS start_pos, CAST(length(sequence) - length(sequence) // 3 AS INT) AS end_pos,
       substring(sequence, 6, length(sequence) - length(sequence) // 3 - 5) AS sequence FROM sequences WHERE length(sequence) > 100"""))
def _(t):
    n = F.length("sequence")
    regions = t.sequences.where(n > 100).select(
        F.col("seq_id").alias("region_id"), "seq_id", F.lit(5).alias("start_pos"), (n - F.floor(n / 3)).cast("int").alias("end_pos")
    )
    return steps.slice_regions(regions, t.sequences)


@query("q27_region_physics", seq_oracle("""
SELECT s.seq_id AS region_id, round(sum(p.delta_g_37) / 100.0, 2) AS total_delta_g_37, round(sum(p.roll) / 100.0 / count(*), 3) + 0.0 AS mean_roll
FROM steps s JOIN props p USING (d) JOIN sequences q USING (seq_id) WHERE length(q.sequence) > 100 AND s.i >= 5
  AND s.i < length(q.sequence) - length(q.sequence) // 3 - 1 GROUP BY 1"""))
def _(t):
    n = F.length("sequence")
    regions = t.sequences.where(n > 100).select(
        F.col("seq_id").alias("region_id"), "seq_id", F.lit(5).alias("start_pos"), (n - F.floor(n / 3)).cast("int").alias("end_pos")
    )
    cut = steps.slice_regions(regions, t.sequences).select(F.col("region_id").alias("seq_id"), "sequence")
    both = thermo.thermo_summary(cut).join(thermo.structural(cut).drop("n_steps"), "seq_id")
    return both.select(F.col("seq_id").alias("region_id"), "total_delta_g_37", "mean_roll")


@query("q28_allele_summary", seq_oracle(f"""
SELECT q.seq_id, round({GC_SQL.replace('sequence', 'q.sequence')} / length(q.sequence), 4) AS gc_content,
  CAST(coalesce(sum(c) FILTER (d = 'CG'), 0) AS INT) AS cpg_count,
  round(81.5 + 41.0 * ({GC_SQL.replace('sequence', 'q.sequence')} / length(q.sequence)) - 600.0 / length(q.sequence), 1) AS melting_temp_est,
  round(round({total('delta_g_37')}, 2) / sum(c), 4) AS mean_stacking_dg37, round({total('a_form')} / sum(c), 3) AS mean_a_form_prop,
  round({total('major_groove_width')} / sum(c), 2) AS mean_major_groove_w
FROM sequences q JOIN counts USING (seq_id) JOIN props USING (d) WHERE length(q.sequence) >= 2 GROUP BY q.seq_id, q.sequence"""))
def _(t):
    out = flags.allele_summary(t.sequences)
    return out.select("seq_id", "gc_content", "cpg_count", "melting_temp_est", "mean_stacking_dg37", "mean_a_form_prop",
                      "mean_major_groove_w")


STEPPED = f"""SELECT seq_id, s FROM (SELECT seq_id, s, {GC_SQL} / 200 AS gc, length(sequence) - length(replace(sequence, 'C', '')) AS c,
  length(sequence) - length(replace(sequence, 'G', '')) AS g, (length(sequence) - length(replace(sequence, 'CG', ''))) / 2 AS p FROM (
  SELECT seq_id, s, substring(sequence, s + 1, 200) AS sequence FROM (SELECT seq_id, sequence, unnest(range(0, length(sequence) - 199, 10)) AS s
  FROM sequences WHERE length(sequence) >= 200))) WHERE gc >= 0.5 AND c * g > 0 AND p / (c * g / CAST(199 AS DOUBLE)) >= 0.6"""


@query("q28_quick_flags", seq_oracle(f"""
SELECT q.seq_id, CAST(w + CASE WHEN k.seq_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS n_flags, CAST(w AS INT) AS n_warnings FROM (
  SELECT seq_id, CASE WHEN gc > 0.70 THEN 1 ELSE 0 END + CASE WHEN gc < 0.30 THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(sequence, '{motifs.runs_pattern(8)}') THEN 1 ELSE 0 END AS w
  FROM (SELECT *, {GC_SQL} / greatest(1, length(sequence)) AS gc FROM sequences)) q
LEFT JOIN (SELECT DISTINCT seq_id FROM stepped) k USING (seq_id)""", stepped=STEPPED))
def _(t):
    return flags.quick_flags(t.sequences)


@query("q29_window_tracks", seq_oracle(f"""
SELECT w.seq_id, CAST(w.start_pos AS INT) AS start_pos, round({GC_SQL.replace('sequence', 'max(w.sequence)')} / length(max(w.sequence)), 6) AS gc_content,
  round(sum(delta_g_37) / 100.0 / count(*), 4) AS stacking_dg37, round(sum(delta_h) * 1000.0 / sum(delta_s) - 273.15, 2) AS melting_temp,
  round(sqrt(power(sum(roll * cos(a) - tilt * sin(a)), 2) + power(sum(roll * sin(a) + tilt * cos(a)), 2)) / 100.0 / count(*), 5) AS curvature,
  round(CASE WHEN sum(x) * (1 - sum(x) / max(m)) > 0 THEN (power(sum(x * cos(2 * pi() * kk * i / m)), 2) + power(sum(x * sin(2 * pi() * kk * i / m)), 2))
   / ((max(m) * (sum(x) - sum(x) * sum(x) / max(m)) + CASE WHEN max(m) % 2 = 0 THEN power(sum(x * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END), 2) ELSE 0 END) / 2)
   ELSE 0 END, 5) AS periodicity_power
FROM win w JOIN (SELECT *, radians((sum(twist) OVER (PARTITION BY seq_id, start_pos ORDER BY i)) / 100.0) AS a,
  CASE WHEN abs(floor(m / 10.5) / m - 1 / 10.5) <= abs((floor(m / 10.5) + 1) / m - 1 / 10.5) THEN floor(m / 10.5) ELSE floor(m / 10.5) + 1 END AS kk FROM (
  SELECT s.seq_id, s.i // 1000 * 1000 AS start_pos, s.i % 1000 AS i, CAST(length(v.sequence) - 1 AS DOUBLE) AS m, p.*,
         CASE WHEN d IN ('AA', 'TT', 'AT', 'TA') THEN 1.0 ELSE 0.0 END AS x
  FROM steps s JOIN props p USING (d) JOIN win v ON v.seq_id = s.seq_id AND v.start_pos = s.i // 1000 * 1000
  WHERE s.i % 1000 < length(v.sequence) - 1)) z ON z.seq_id = w.seq_id AND z.start_pos = w.start_pos GROUP BY 1, 2""", win=WIN))
def _(t):
    out = thermo.window_tracks(t.sequences)
    return out.select("seq_id", "start_pos", F.round("gc_content", 6).alias("gc_content"),
                      F.round("stacking_dg37", 4).alias("stacking_dg37"), F.round("melting_temp", 2).alias("melting_temp"),
                      F.round("curvature", 5).alias("curvature"), F.round("periodicity_power", 5).alias("periodicity_power"))


@query("q30_region_features", seq_oracle(f"""
SELECT seq_id, round({total('delta_g_37')} / sum(c), 6) AS mean_dg37, round({total('twist')} / sum(c), 6) AS mean_twist,
  round(sqrt((sum(c * (delta_g_37 / 100.0) * (delta_g_37 / 100.0)) - power(sum(c * delta_g_37 / 100.0), 2) / sum(c)) / (sum(c) - 1)), 5) AS std_dg37,
  round(-sum(c / n * log2(c / n)), 6) AS dinuc_entropy
FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY seq_id) AS DOUBLE) AS n FROM counts JOIN props USING (d)) GROUP BY 1 HAVING sum(c) > 1"""))
def _(t):
    out = thermo.region_features(t.sequences)
    return out.select("seq_id", F.round("mean_dg37", 6).alias("mean_dg37"), F.round("mean_twist", 6).alias("mean_twist"),
                      F.round("std_dg37", 5).alias("std_dg37"), r(F.col("dinuc_entropy")).alias("dinuc_entropy"))


@query("w10_fixed_windows", seq_oracle(f"""
SELECT seq_id, CAST(s AS INT) AS start_pos, CAST(s + length(sequence) AS INT) AS end_pos, round(gc, 6) AS gc, CASE WHEN gc < 0.37 THEN 'L1'
  WHEN gc < 0.41 THEN 'L2' WHEN gc < 0.46 THEN 'H1' WHEN gc < 0.53 THEN 'H2' ELSE 'H3' END AS band FROM (
  SELECT seq_id, s, sequence, {GC_SQL} / length(sequence) AS gc FROM (SELECT seq_id, s, substring(sequence, s + 1, 3000) AS sequence FROM (
    SELECT seq_id, sequence, unnest(range(0, length(sequence), 3000)) AS s FROM sequences)))"""))
def _(t):
    from spanframe.functions.seqexpr import gc_fraction

    wins = steps.fixed_windows(t.sequences, 3000).withColumn("gc", gc_fraction(F.col("window")))
    return wins.select("seq_id", "start_pos", "end_pos", F.round("gc", 6).alias("gc"), classify.gc_band(F.col("gc")).alias("band"))
