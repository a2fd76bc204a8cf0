"""Registered queries: format parsers over text lines that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.plans.adapters import oracle
from spanframe.operators.overlap import KEYS
from spanframe.plans.registry import query
from spanframe.session import scratch_dir
from spanframe.sources import readers, sinks
from spanframe.streaming import incremental


def lines(t, table, text, *keep):
    """Tab-separated lines built from columns of a table."""
    return table.select(F.concat_ws("\t", *[F.expr(x) for x in text]).alias("value"), *keep)


CHR = "concat('chr', CAST(chr_id AS STRING))"


@query("s2_peaks", oracle("""
SELECT chr_id, start_pos, end_pos, CASE WHEN klass <> '1-URGENT' THEN score END AS signal_value, CASE WHEN feature_id % 3 > 0 THEN CAST(feature_id % 3 AS INT) - 1 END AS peak_offset
FROM intervals_b WHERE feature_id % 10 <> 0""", "intervals_b"))
def _(t):
    chrom = f"CASE WHEN feature_id % 10 = 0 THEN 'chrUn_x' ELSE {CHR} END"
    raw = lines(t, t.intervals_b, [chrom, "start_pos", "end_pos", "'p'", "'0'", "'.'", "CASE WHEN klass = '1-URGENT' THEN '.' ELSE CAST(score AS STRING) END",
                                   "'3.5'", "'.'", "CAST(feature_id % 3 - 1 AS INT)"])
    return readers.shape_peaks(raw).select("chr_id", "start_pos", "end_pos", "signal_value", "peak_offset")


@query("s3_segmentation", oracle("""
SELECT chr_id, start_pos, end_pos, CAST(feature_id % 15 AS INT) AS state_id, 'Tss_' || klass AS state_name FROM intervals_b WHERE feature_id % 4 <> 0""", "intervals_b"))
def _(t):
    raw = lines(t, t.intervals_b, [CHR, "start_pos", "end_pos", "CASE WHEN feature_id % 4 = 0 THEN 'bad' ELSE concat(feature_id % 15, '_Tss_', klass) END"])
    return readers.shape_segmentation(raw)


@query("s4_elements", oracle("""
SELECT chr_id, start_pos, end_pos, 'E' || feature_id AS accession, CAST(7 AS INT) AS score, klass AS ccre_class, 'pELS' AS encode_label, score AS z_score
FROM intervals_b""", "intervals_b"))
def _(t):
    raw = lines(t, t.intervals_b, [CHR, "start_pos", "end_pos", "concat('E', feature_id)", "'7'", "'.'", "'0'", "'0'", "'c'", "klass", "'pELS'", "score"])
    return readers.shape_elements(raw).drop("description")


@query("s5_domains", oracle("""
SELECT chr_id, start_pos, end_pos, CASE WHEN domain_id % 2 = 0 THEN 5.0::DOUBLE ELSE score END AS score FROM domains""", "domains"))
def _(t):
    raw = lines(t, t.domains, ["CAST(chr_id AS STRING)", "start_pos", "end_pos", "'x'", "'y'", "'z'", "'0'", "'5.0'", "'0'", "'0'", "'0'",
                               "CASE WHEN domain_id % 2 = 0 THEN 0.0 ELSE score END", "'1'", "'2'"])
    return readers.shape_domains(raw).drop("uvar_score", "lvar_score")


@query("s6_gtf", oracle("""
SELECT chr_id, start_pos, end_pos, strand, symbol AS gene_symbol, gene_id, CASE WHEN size % 3 = 0 THEN 'exon' ELSE 'gene' END AS feature_type
FROM genes WHERE size % 3 <> 2""", "genes"))
def _(t):
    kind = "CASE size % 3 WHEN 0 THEN 'exon' WHEN 1 THEN 'gene' ELSE 'Selenocysteine' END"
    raw = lines(t, t.genes, [CHR, "'HAVANA'", kind, "start_pos + 1", "end_pos", "'.'", "strand", "'.'",
                             "concat('gene_id \"', gene_id, '\"; gene_name \"', symbol, '\"; gene_type \"x\";')"])
    return readers.shape_gtf(raw).drop("transcript_id", "gene_type")


@query("s7_clinical_vcf", oracle("""
SELECT chr_id, pos AS start_pos, pos + 2 AS end_pos, event_type AS gene_symbol, 'missense' AS consequence FROM points WHERE event_id % 3 = 0""", "points"))
def _(t):
    info = "concat('CLNSIG=', CASE event_id % 3 WHEN 0 THEN 'Pathogenic/Likely' ELSE 'Benign' END, ';GENEINFO=', event_type, ':12|OTHER:3;MC=SO:1|missense,SO:2|x')"
    raw = lines(t, t.points, ["CAST(chr_id AS STRING)", "pos + 1", "event_id", "'AC'", "'A'", "'.'", "'.'", info])
    return readers.shape_clinical_vcf(raw).select("chr_id", "start_pos", "end_pos", "gene_symbol", "consequence")


@query("s8_sv_vcf", oracle("""
SELECT chr_id, pos AS start_pos, CASE event_id % 3 WHEN 0 THEN pos + 101 WHEN 1 THEN pos + 50 ELSE pos + 1 END AS end_pos, 'DEL' AS sv_type, 0.25::DOUBLE AS allele_freq,
  'GENE' AS gene_symbol FROM points""", "points"))
def _(t):
    place = "CASE event_id % 3 WHEN 0 THEN concat('END=', pos + 101, ';') WHEN 1 THEN 'SVLEN=-50;' ELSE '' END"
    raw = lines(t, t.points, [CHR, "pos + 1", "event_id", "'N'", "'<DEL>'", "'.'", "'PASS'", f"concat({place}, 'SVTYPE=DEL;AF=0.25;CSQ=A|stop|HIGH|GENE|x')"])
    return readers.shape_sv_vcf(raw).select("chr_id", "start_pos", "end_pos", "sv_type", "allele_freq", "gene_symbol")


@query("s9_gwas", oracle("""
SELECT chr_id, pos - 1 AS start_pos, pos AS end_pos, 'rs' || event_id AS rsid, event_type AS trait FROM points WHERE event_id % 2 = 0 AND event_id % 5 <> 0""", "points"))
def _(t):
    table = t.points.select(
        F.expr("CAST(chr_id AS STRING)").alias("CHR_ID"), F.expr("concat(pos, ';77')").alias("CHR_POS"), F.expr("concat('rs', event_id)").alias("SNPS"),
        F.expr("CASE WHEN event_id % 2 = 0 THEN '1e-9' ELSE '0.01' END").alias("P-VALUE"), F.lit("1.2").alias("OR or BETA"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END").alias("DISEASE/TRAIT"), F.lit("NR").alias("MAPPED_GENE"))
    return readers.shape_gwas(table).select("chr_id", "start_pos", "end_pos", "rsid", "trait")


@query("s10_gene_table", oracle("""
SELECT symbol AS gene_symbol, CASE WHEN size % 2 = 0 THEN price END AS half_life_hours FROM genes""", "genes"))
def _(t):
    table = t.genes.select(F.col("symbol").alias("gene"), F.expr("CASE WHEN size % 2 = 0 THEN CAST(price AS STRING) ELSE 'NA' END").alias("half_life_hours"))
    return readers.shape_gene_table(table, *readers.GENE_TABLES["turnover"])


@query("s11_expression_matrix", oracle("""
SELECT gene_id, quantile_cont(v, 0.5) AS median_tpm, max(v) AS max_tpm, arg_max(k, v * 10 - o) AS max_tissue, count(*) FILTER (v > 0.1) AS n_tissues_detected FROM (
  SELECT split_part(gene_id, '.', 1) AS gene_id, unnest([0, 1, 2]) AS o, unnest(['liver', 'lung', 'brain']) AS k,
    unnest([CAST(size % 7 AS DOUBLE), CAST(size % 5 AS DOUBLE), CAST(size % 3 AS DOUBLE)]) AS v FROM genes) GROUP BY 1""", "genes"))
def _(t):
    table = t.genes.select(F.col("gene_id").alias("Name"), F.col("symbol").alias("Description"), F.expr("CAST(size % 7 AS STRING)").alias("L"),
                           F.expr("CAST(size % 5 AS STRING)").alias("G"), F.expr("CAST(size % 3 AS STRING)").alias("B"))
    return readers.shape_expression(table, {"liver": "L", "lung": "G", "brain": "B"})[0].drop("gene_symbol")


@query("s12_abundance_dir", oracle("""
SELECT 'brain stem' AS tissue, split_part(gene_id, '.', 1) AS protein_id, price AS abundance_ppm, 'nervous' AS organ FROM genes""", "genes"))
def _(t):
    raw = lines(t, t.genes, ["'1'", "concat('9606.', split_part(gene_id, '.', 1))", "price"], F.lit("9606-BRAIN_STEM-integrated.tsv").alias("file"))
    return readers.shape_abundance(raw, {"brain": "nervous", "liver": "digestive"})


@query("s14_gmt", oracle("""
SELECT c_name AS gene_symbol, 'C2' AS collection, 'KEGG_' || c_mktsegment AS gene_set_name FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'G' || c_nationkey, 'C2', 'KEGG_' || c_mktsegment FROM customer"""))
def _(t):
    raw = lines(t, t.customer, ["concat('KEGG_', c_mktsegment)", "'desc'", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END", "concat('G', c_nationkey)"])
    return readers.shape_gmt(raw).drop("description")


@query("s15_pathways", oracle("""
SELECT 'g' || c_custkey AS gene_id, 'R-' || c_nationkey AS pathway_id, c_name AS pathway_name, 'TAS' AS evidence_code FROM customer WHERE c_custkey % 3 = 0"""))
def _(t):
    raw = lines(t, t.customer, ["concat('g', c_custkey)", "concat('R-', c_nationkey)", "'url'", "c_name", "'TAS'",
                                "CASE WHEN c_custkey % 3 = 0 THEN 'Homo sapiens' ELSE 'Mus musculus' END"])
    return readers.shape_pathways(raw)


@query("s16_aliases", oracle("""
SELECT unnest(['A' || c_custkey, 'B' || c_custkey]) AS alias, c_name AS canonical, c_custkey AS ncbi_gene_id FROM customer WHERE c_custkey % 4 <> 0"""))
def _(t):
    raw = lines(t, t.customer, ["'9606'", "c_custkey", "c_name", "'-'", "CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE concat('A', c_custkey, '|', c_name, '|B', c_custkey) END"])
    return readers.shape_aliases(raw)


@query("s17_repeats", oracle("""
SELECT chr_id, start_pos, end_pos, CASE WHEN strand = '-' THEN '-' ELSE '+' END AS strand, klass AS repeat_class, 100 AS sw_score, rate / 10 AS divergence_pct FROM intervals_a""",
    "intervals_a"))
def _(t):
    wide = ["'585'", "'100'", "CAST(rate AS INT)", "'0'", "'0'", CHR, "start_pos", "end_pos", "'-1'", "CASE WHEN strand = '-' THEN 'C' ELSE '+' END", "'n'", "klass", "'f'",
            "'1'", "'2'", "'3'", "'4'"]
    narrow = [CHR, "start_pos", "end_pos", "strand", "'n'", "klass", "'f'", "'100'", "rate / 10", "'0'", "'0'"]
    raw = lines(t, t.intervals_a.where("klass = 'A'"), wide).unionByName(lines(t, t.intervals_a.where("klass <> 'A'"), narrow))
    return readers.shape_repeats(raw).select("chr_id", "start_pos", "end_pos", "strand", "repeat_class", "sw_score", "divergence_pct")


@query("s18_fasta_windows", oracle("""
SELECT 'seq' || seq_id AS seq_id, CAST(w * 1000 AS INT) AS start_pos, CAST(least(w * 1000 + 1000, length(sequence)) AS INT) AS end_pos FROM (SELECT seq_id, sequence,
  unnest(range(0, CAST(ceil(length(sequence) / 1000.0) AS BIGINT))) AS w FROM sequences) WHERE length(sequence) - w * 1000 >= 500""", "sequences"))
def _(t):
    wrapped = F.regexp_replace("sequence", "(.{60})", "$1\n")
    raw = t.sequences.select(F.concat(F.lit("seq"), "seq_id", F.lit(" test\n"), wrapped, F.lit("\n")).alias("value"))
    return readers.fasta_windows(readers.shape_fasta(raw)).drop("window")


@query("s19_allele_fasta", oracle("""
SELECT 'H' || p_partkey AS accession, 'HLA-' || CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'DRB1' END AS locus, CAST(p_size AS VARCHAR) AS allele_group, '01' AS protein,
  CASE WHEN p_size % 3 = 0 THEN 'N' END AS expression_suffix, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS hla_class, 8 AS length FROM part"""))
def _(t):
    name = "concat(CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'DRB1' END, '*', p_size, ':01:02', CASE WHEN p_size % 3 = 0 THEN 'N' ELSE '' END)"
    raw = t.part.select(F.expr(f"concat('H', p_partkey, ' ', {name}, ' 8 bp\\nacgt\\nACGT\\n')").alias("value"))
    return readers.shape_allele_fasta(raw).select("accession", "locus", "allele_group", "protein", "expression_suffix", "hla_class", "length")


@query("s20_probe_manifest", oracle("SELECT probe_id, chr_id, pos, platform FROM probes WHERE platform = 'hm450'", "probes"))
def _(t):
    table = t.probes.select("probe_id", F.expr(CHR).alias("chr"), F.expr("CAST(pos AS STRING)").alias("pos"), F.lit("").alias("strand"), "platform")
    return readers.filter_platform(readers.shape_manifest(table, ["epic_v1", "epic_v2", "hm450"]), "hm450").drop("strand")


@query("s21_beta_matrix", oracle("""
SELECT probe_id, chr_id, pos, unnest(['gran', 'mono']) AS cell_type, unnest([beta, CASE WHEN event_id % 2 = 0 THEN beta END]) AS beta FROM betas""", "betas"))
def _(t):
    table = t.betas.select("probe_id", F.expr(CHR).alias("chr"), F.expr("CAST(pos AS STRING)").alias("pos"), F.expr("CAST(beta AS STRING)").alias("gran"),
                           F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(beta AS STRING) WHEN event_id % 3 = 0 THEN '7.5' ELSE 'NA' END").alias("mono"))
    return readers.shape_beta_matrix(table, ["gran", "mono"])


@query("s22_eqtl", oracle("""
SELECT 'G' || chr_id AS gene_id, start_pos - 1 AS start_pos, start_pos AS end_pos, p_value FROM (SELECT *, row_number() OVER (PARTITION BY chr_id ORDER BY p_value, variant_id) AS rn
  FROM (SELECT chr_id, start_pos, 'chr' || chr_id || '_' || start_pos || '_A_C_b38' AS variant_id, score / 1000000 AS p_value FROM intervals_b)) WHERE rn = 1""", "intervals_b"))
def _(t):
    table = t.intervals_b.select(F.expr(f"concat({CHR}, '_', start_pos, '_A_C_b38')").alias("variant_id"), F.expr("concat('G', chr_id, '.3')").alias("gene_id"),
                                 F.lit("5").alias("tss_distance"), F.lit("0.1").alias("slope"), F.expr("CAST(score / 1000000 AS STRING)").alias("pval_nominal"),
                                 F.lit("0.5").alias("pval_beta"), F.lit("Liver.txt").alias("file"))
    return readers.shape_eqtl(table).select("gene_id", "start_pos", "end_pos", "p_value")


@query("s23_meqtl", oracle("""
SELECT probe_id, chr_id, pos, p_value FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY p_value, snp) AS rn FROM (
  SELECT probe_id, chr_id, pos, chr_id || ':' || pos AS snp, beta / 1000000000 AS p_value FROM betas WHERE event_id % 2 = 0)) WHERE rn = 1 AND p_value < 1e-8""", "betas"))
def _(t):
    table = t.betas.select(F.expr("concat(chr_id, ':', pos)").alias("snp"), F.col("probe_id").alias("cpg"), F.lit("0.1").alias("beta_a1"), F.lit("0.2").alias("se"),
                           F.expr("CAST(beta / 1000000000 AS STRING)").alias("pval"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END").alias("cistrans"))
    return readers.shape_meqtl(table).select("probe_id", "chr_id", "pos", "p_value")


@query("s24_enhancer_links", oracle("SELECT chr_id, start_pos, end_pos, klass AS target_gene, rate AS abc_score FROM intervals_a", "intervals_a"))
def _(t):
    table = t.intervals_a.select(F.expr(CHR).alias("chr"), F.expr("CAST(start_pos AS STRING)").alias("start"), F.expr("CAST(end_pos AS STRING)").alias("end"),
                                 F.col("klass").alias("TargetGene"), F.expr("CAST(rate AS STRING)").alias("ABC.Score"), F.lit("9").alias("distance"),
                                 F.lit("promoter").alias("class"), F.lit("K562").alias("CellType"))
    return readers.shape_enhancer_links(table).select("chr_id", "start_pos", "end_pos", "target_gene", "abc_score")


@query("s25_rate_map", oracle("SELECT chr_id, start_pos, end_pos, score AS rate FROM intervals_b", "intervals_b"))
def _(t):
    return readers.shape_rate_map(lines(t, t.intervals_b, ["'1'", CHR, "start_pos", "end_pos", "'x'", "score"]))


@query("s26_rle_scores", oracle("""
SELECT 'chr' || chr_id AS file, CAST(e - n AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos, score FROM (SELECT chr_id, score, n, sum(n) OVER (PARTITION BY chr_id ORDER BY feature_id) AS e
  FROM (SELECT chr_id, feature_id, score, end_pos - start_pos AS n FROM intervals_b))""", "intervals_b"))
def _(t):
    raw = t.intervals_b.select(F.expr(CHR).alias("file"), F.floor(F.col("feature_id") / 500).alias("block"), F.col("feature_id").alias("line"),
                               F.expr("concat(score, ' ', end_pos - start_pos)").alias("value"))
    return readers.shape_rle(raw)


@query("s27_pair_events", oracle("SELECT chr_id, start_pos, end_pos, score FROM intervals_b", "intervals_b"))
def _(t):
    table = t.intervals_b.select(F.expr("CAST(chr_id AS STRING)").alias("chr"), F.expr("concat(start_pos, '.0')").alias("from"),
                                 F.expr("CAST(end_pos AS STRING)").alias("to"), F.expr("CAST(score AS STRING)").alias("count"))
    return readers.shape_events(table).drop("gene")


@query("s28_tumor_methylation", oracle("""
SELECT b.probe_id, b.event_id, p.chr_id, p.pos, CASE WHEN b.event_id % 3 = 0 THEN 'hyper' WHEN b.beta > 0.5 THEN 'hyper' ELSE 'hypo' END AS direction FROM betas b JOIN (
  SELECT probe_id, min(chr_id) AS chr_id, min(pos) AS pos FROM probes GROUP BY 1) p USING (probe_id)""", "betas", "probes"))
def _(t):
    places = t.probes.groupBy("probe_id").agg(F.min("chr_id").alias("chr_id"), F.min("pos").alias("pos"))
    table = t.betas.select("probe_id", F.expr("concat(event_id, '.tsv')").alias("file"), F.expr("CAST(beta - 0.5 AS STRING)").alias("delta_beta"), F.lit("0.01").alias("p_value"),
                           F.expr("CASE WHEN event_id % 3 = 0 THEN 'hyper' ELSE ' ' END").alias("direction"))
    out = readers.shape_tumor_methylation(table, places)
    return out.select("probe_id", F.col("cancer_type").cast("long").alias("event_id"), "chr_id", "pos", "direction")


@query("s29_signal_bedgraph", oracle("SELECT 'atac' AS track, chr_id, start_pos, end_pos, score FROM intervals_b", "intervals_b"))
def _(t):
    raw = lines(t, t.intervals_b, [CHR, "start_pos", "end_pos", "score"], F.lit("atac.bedgraph.gz").alias("file"))
    return readers.shape_bedgraph(raw).drop("file")


@query("s30_clock_coefficients", oracle("SELECT 'horvath' AS clock, probe_id, coef FROM probes", "probes"))
def _(t):
    table = t.probes.select(F.lit("horvath.tsv").alias("file"), F.col("probe_id").alias("CpG"), F.expr("CAST(coef AS STRING)").alias("weight"))
    return readers.shape_clock(table)


@query("s13_protein_atlas", oracle("""
SELECT gene_id, unnest(['nucleus', 'cytosol']) AS location FROM genes""", "genes"))
def _(t):
    table = t.genes.select(F.col("gene_id").alias("Gene"), F.col("symbol").alias("Gene name"), F.lit("Approved").alias("Reliability"),
                           F.lit("nucleus;cytosol").alias("Main location"))
    return readers.shape_protein_atlas(table, "subcellular").select("gene_id", "location")


# ---- stored layers and incremental loading ------------------------------------------------

LAYER_SCHEMA = "start_pos bigint, end_pos bigint, klass string, score double, feature_id bigint, build string, chr_id int"


@query("s1_k1_layer_round_trip", oracle("""
SELECT chr_id, count(*) AS n, CAST(sum(end_pos - start_pos) AS BIGINT) AS bp FROM intervals_b WHERE chr_id IN (2, 3) GROUP BY 1""", "intervals_b"))
def _(t):
    path = scratch_dir(t.spark, "layer")
    sinks.write_layer(t.intervals_b, path)
    layer = readers.read_layer(t.spark, path, LAYER_SCHEMA, "b1", [2, 3])
    return layer.groupBy("chr_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bp"))


@query("k8_export_by", oracle("SELECT cell_type, count(*) AS n, sum(beta) AS total FROM betas GROUP BY 1", "betas"))
def _(t):
    path = scratch_dir(t.spark, "export")
    sinks.export_by(t.betas.select("probe_id", "cell_type", "beta"), "cell_type", path)
    back = t.spark.read.schema("probe_id string, beta double, cell_type string").parquet(path)
    return back.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.sum("beta").alias("total"))


@query("k9_export_matrix", oracle("""
SELECT field, round(f, 6) AS null_fraction, CASE WHEN f > 0.5 THEN 'warning' WHEN f > 0 THEN 'some' ELSE 'none' END AS level FROM (
  SELECT unnest(['n_a', 'mean_b']) AS field, unnest([avg(CAST(n_a IS NULL AS INT)), avg(CAST(mean_b IS NULL AS INT))]) AS f FROM windows)""", "windows"))
def _(t):
    audit = sinks.export_matrix(t.windows.select("n_a", "mean_b"), scratch_dir(t.spark, "matrix"))
    return audit.withColumn("null_fraction", F.round("null_fraction", 6))


@query("st1_incremental_load", oracle("""
SELECT chr_id, CAST(start_pos // 1000 * 1000 AS BIGINT) AS bin_start, count(*) AS n FROM intervals_b GROUP BY 1, 2""", "intervals_b"))
def _(t):
    base = scratch_dir(t.spark, "stream")
    source = f"{base}/in"
    # Arrives in two loads; the second call picks up only what is new.
    for part in (0, 1):
        t.intervals_b.where(F.col("feature_id") % 2 == part).select(*KEYS, "start_pos", "end_pos").write.mode("append").parquet(source)
        run = incremental.incremental_load(t.spark, source, "build string, chr_id int, start_pos bigint, end_pos bigint", f"{base}/layer", f"{base}/log")
        run.awaitTermination()
    return incremental.current_bins(t.spark, f"{base}/layer_bins").drop("build")


# ---- text folders in the shared folder, written and read back -----------------------------


def folder(t, name, raw):
    """A folder of text files with these lines."""
    path = scratch_dir(t.spark, name)
    raw.select("value").write.text(path)
    return path


@query("s2_peak_files", oracle("""
SELECT chr_id, start_pos, end_pos, score AS signal_value, 3.5::DOUBLE AS p_value, CASE WHEN feature_id % 3 > 0 THEN CAST(feature_id % 3 AS INT) - 1 END AS peak_offset
FROM intervals_b""", "intervals_b"))
def _(t):
    raw = lines(t, t.intervals_b, [CHR, "start_pos", "end_pos", "'p'", "'0'", "'.'", "score", "'3.5'", "'.'", "CAST(feature_id % 3 - 1 AS INT)"])
    found = readers.read(t.spark, folder(t, "peaks", raw), "narrow_peak")
    return found.select("chr_id", "start_pos", "end_pos", "signal_value", "p_value", "peak_offset")


@query("s5_domain_files", oracle("SELECT chr_id, start_pos, end_pos, nullif(score, 0.0) AS score FROM domains", "domains"))
def _(t):
    raw = lines(t, t.domains, [CHR, "start_pos", "end_pos", "score"])
    return readers.read(t.spark, folder(t, "domains", raw), "domains_bed").select("chr_id", "start_pos", "end_pos", "score")


@query("s6_gtf_files", oracle("""
SELECT chr_id, start_pos, end_pos, strand, symbol AS gene_symbol, gene_id, 'gene' AS feature_type FROM genes""", "genes"))
def _(t):
    raw = lines(t, t.genes, [CHR, "'HAVANA'", "'gene'", "start_pos + 1", "end_pos", "'.'", "strand", "'.'", "concat('gene_id \"', gene_id, '\"; gene_name \"', symbol, '\";')"])
    found = readers.read(t.spark, folder(t, "models", raw), "gtf")
    return found.select("chr_id", "start_pos", "end_pos", "strand", "gene_symbol", "gene_id", "feature_type")


@query("s18_fasta_files", oracle("""
SELECT 'seq' || seq_id || ' >test' AS header, CAST(w * 512 AS BIGINT) AS start_pos, md5(substring(sequence, CAST(w * 512 + 1 AS BIGINT), 512)) AS digest FROM (SELECT seq_id, sequence,
  unnest(range(0, CAST(ceil(length(sequence) / 512.0) AS BIGINT))) AS w FROM sequences)""", "sequences"))
def _(t):
    wrapped = F.regexp_replace("sequence", "(.{60})", "$1\n")
    path = folder(t, "fasta", t.sequences.select(F.concat(F.lit(">seq"), "seq_id", F.lit(" >test\n"), wrapped).alias("value")))
    chunks = readers.read_fasta_chunks(t.spark, path, 512)
    return chunks.select("header", F.col("start_pos").cast("long").alias("start_pos"), F.md5("sequence").alias("digest"))


@query("s18_fasta_file_windows", oracle("""
SELECT g AS grid, 'seq' || seq_id AS seq_id, CAST(w * 1000 AS BIGINT) AS start_pos, CAST(least(w * 1000 + 1000, length(sequence)) AS BIGINT) AS end_pos,
  md5(substring(sequence, CAST(w * 1000 + 1 AS BIGINT), 1000)) AS digest
FROM (SELECT seq_id, sequence, unnest(range(0, CAST(ceil(length(sequence) / 1000.0) AS BIGINT))) AS w FROM sequences), (VALUES ('default'), ('odd')) v(g)
WHERE length(sequence) - w * 1000 >= 500""", "sequences"))
def _(t):
    wrapped = F.regexp_replace("sequence", "(.{60})", "$1\n")
    path = folder(t, "fasta", t.sequences.select(F.concat(F.lit(">seq"), "seq_id", F.lit(" >test\n"), wrapped).alias("value")))
    grids = {"default": readers.read_fasta_chunks(t.spark, path), "odd": readers.read_fasta_chunks(t.spark, path, 1536)}
    made = [readers.fasta_chunk_windows(c).select(F.lit(g).alias("grid"), "seq_id", "start_pos", "end_pos", F.md5("window").alias("digest")) for g, c in grids.items()]
    return made[0].unionByName(made[1])


@query("s27_duplication_files", oracle("""
SELECT chr_id, start_pos, end_pos, chr_id AS other_chr_id, start_pos + 5000 AS other_start, end_pos + 5000 AS other_end, 0.5::DOUBLE AS frac_match FROM intervals_b""", "intervals_b"))
def _(t):
    fill = ["'x'"] * 16
    raw = lines(t, t.intervals_b, ["'585'", CHR, "start_pos", "end_pos", "'n'", "'0'", "'+'", CHR, "start_pos + 5000", "end_pos + 5000", *fill, "'0.5'", "'x'", "'0.1'"])
    found = readers.read(t.spark, folder(t, "pairs", raw), "pair_events")
    return found.select("chr_id", "start_pos", "end_pos", "other_chr_id", "other_start", "other_end", "frac_match")


#: Headers of a gene-keyed table's file and the text of its fields; every third gene has NA in its numbers.
GENE_FILES = {
    "constraint": {"gene": "symbol", "transcript": "concat('T', size)", "pLI": "price / 4096", "oe_lof_upper": "size / 8", "mis_z": "-size", "syn_z": "size % 7"},
    "costs": {"gene": "symbol", "ecpa_b20": "price", "cai": "size / 64", "mean_tpm": "size * 2", "protein_length": "price + size"},
    "properties": {"gene": "symbol", "pI": "size / 4", "instability_index": "price / 2", "aliphatic_index": "size + 0.5", "gravy": "-size / 16"},
    "dnds": {"gene": "symbol", "ensembl_id": "gene_id", "dN": "size / 128", "dS": "size / 32", "omega": "0.25"},
}


def _gene_file(t, kind: str):
    """A folder with a headered file of a gene-keyed table, read back by its reader."""
    fields = GENE_FILES[kind]
    text = [src for src in readers.GENE_TABLES[kind][0].values()]
    cells = [F.expr(f"CAST({e} AS STRING)") if h in text else F.expr(f"CASE WHEN size % 3 = 0 THEN 'NA' ELSE CAST(CAST({e} AS DOUBLE) AS STRING) END") for h, e in fields.items()]
    path = scratch_dir(t.spark, kind)
    t.genes.select(*[c.alias(h) for c, h in zip(cells, fields)]).write.csv(path, sep="\t", header=True)
    return readers.read_gene_table(t.spark, path, kind)


def _gene_sql(kind: str) -> str:
    text, numbers = readers.GENE_TABLES[kind]
    parts = [f"{GENE_FILES[kind][src]} AS {dst}" for dst, src in text.items()]
    parts += [f"CASE WHEN size % 3 > 0 THEN CAST({GENE_FILES[kind][src].replace('size /', 'CAST(size AS DOUBLE) /')} AS DOUBLE) END AS {dst}" for dst, src in numbers.items()]
    return f"SELECT {', '.join(parts)} FROM genes"


for _kind in GENE_FILES:
    query(f"s10_{_kind}_files", oracle(_gene_sql(_kind), "genes"))(lambda t, kind=_kind: _gene_file(t, kind))


@query("s13_tissue_atlas_files", oracle("""
SELECT gene_id, symbol AS gene_symbol, tissue, 'cell ' || tissue AS cell_type, CASE WHEN size % 2 = 0 THEN 'High' ELSE 'Low' END AS level,
  CASE WHEN size % 5 > 0 THEN 'Approved' END AS reliability FROM (SELECT *, unnest(['liver', 'lung']) AS tissue FROM genes)""", "genes"))
def _(t):
    cells = {"Gene": "gene_id", "Gene name": "symbol", "Tissue": "tissue", "Cell type": "concat('cell ', tissue)", "Level": "CASE WHEN size % 2 = 0 THEN 'High' ELSE 'Low' END",
             "Reliability": "CASE WHEN size % 5 = 0 THEN 'NA' ELSE 'Approved' END"}
    path = scratch_dir(t.spark, "atlas")
    long = t.genes.withColumn("tissue", F.explode(F.array(F.lit("liver"), F.lit("lung"))))
    long.select(*[F.expr(e).alias(h) for h, e in cells.items()]).write.csv(path, sep="\t", header=True)
    return readers.shape_protein_atlas(readers.read_table(t.spark, path), "tissue")
