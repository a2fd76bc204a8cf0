"""Sequence operators: known answers, chunk independence, brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions.seqexpr import with_step_counts
from spanframe.operators.sequence import flags, motifs, steps, thermo, variants
from spanframe.sources import readers


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string")


def random_seq(seed, n, letters="ACGT"):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_step_counts_equal_brute_force(spark):
    texts = ["", "A", "AA", "AAAA", "CGCGCG", "AANAA", random_seq(1, 300, "ACGTN"), "N" * 5]
    for r in with_step_counts(seqs(spark, *texts)).collect():
        text = texts[r["seq_id"]]
        for d in K.DINUCLEOTIDES:
            assert r[f"c_{d}"] == sum(text[i:i + 2] == d for i in range(len(text) - 1)), (text, d)


def test_thermo_known_answer(spark):
    row = thermo.thermo_summary(seqs(spark, "CGTTGA")).first()
    # CG GT TT TG GA at 1 M NaCl.
    assert row["total_delta_g_37"] == pytest.approx(-2.17 - 1.44 - 1.0 - 1.45 - 1.30)
    assert row["n_steps"] == 5


def test_melting_method_switches_at_sixty(spark):
    rows = {r["seq_id"]: r for r in thermo.melting_temp(seqs(spark, "ACGT" * 15, "ACGT" * 16)).collect()}
    assert rows[0]["tm_method"] == "nearest_neighbor" and rows[1]["tm_method"] == "empirical"


def test_profiles_do_not_depend_on_chunks(spark):
    df = seqs(spark, random_seq(2, 700), random_seq(3, 64), "CG" * 150)

    def rows(out, *cols):
        return sorted(tuple(round(r[c], 8) if isinstance(r[c], float) else r[c] for c in cols) for r in out.collect())

    for small in (32, 64):
        assert rows(thermo.thermo_profile(df, size=small), "seq_id", "i", "cumulative_dg") == rows(thermo.thermo_profile(df), "seq_id", "i", "cumulative_dg")
        assert rows(thermo.curvature_profile(df, size=small), "seq_id", "i", "curvature") == rows(thermo.curvature_profile(df), "seq_id", "i", "curvature")
        assert rows(motifs.cpg_sites(df, 50, size=small), "seq_id", "pos", "gc_content") == rows(motifs.cpg_sites(df, 50), "seq_id", "pos", "gc_content")
        assert rows(motifs.inverted_repeats(df, size=small), "seq_id", "start", "end") == rows(motifs.inverted_repeats(df), "seq_id", "start", "end")
    assert rows(motifs.cpg_islands(df, size=256), "seq_id", "start_pos", "end_pos", "cpg_count") == rows(
        motifs.cpg_islands(df), "seq_id", "start_pos", "end_pos", "cpg_count")


def test_blocks_of_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(steps, "BLOCK", 128)
    text = random_seq(4, 1000)
    pieces = steps.chunks(seqs(spark, text), 3, 5, 32).orderBy("chunk").collect()
    assert "".join(p["piece"][p["core_start"] - p["piece_start"]:p["core_end"] - p["piece_start"]] for p in pieces) == text
    for p in pieces:
        assert p["piece"] == text[max(0, p["core_start"] - 3):min(1000, p["core_end"] + 5)]


def test_islands_and_repeats_known(spark):
    island = motifs.cpg_islands(seqs(spark, "AT" * 150 + "CG" * 150 + "AT" * 150)).collect()
    assert len(island) == 1 and island[0]["cpg_count"] > 100
    kmer = "ACGTTGCAAGGCTTA"
    df = seqs(spark, kmer + "CCC" + kmer + "TT" + kmer)
    direct = [(r["first"], r["second"]) for r in motifs.kmer_repeats(df).where("kind = 'direct'").where(F.col("kmer") == kmer).collect()]
    assert direct == [(1, 19)]


def test_kmer_repeats_brute_force(spark):
    text = random_seq(9, 400, "AC") + random_seq(10, 200, "GT")
    k, comp = 5, str.maketrans("ACGT", "TGCA")
    seen, last, want, done = {}, {}, set(), set()
    for i in range(len(text) - k + 1):
        word = text[i:i + k]
        rc = word.translate(comp)[::-1]
        if word in seen and seen[word] >= 0:
            want.add(("direct", word, seen[word] + 1, i + 1))
            seen[word] = -1
        seen.setdefault(word, i)
        if rc in last and rc not in done:
            want.add(("inverted", rc, last[rc] + 1, i + 1))
            done.add(rc)
        last[word] = i
    got = {(r["kind"], r["kmer"], r["first"], r["second"]) for r in motifs.kmer_repeats(seqs(spark, text), k).collect()}
    assert got == want


def test_pwm_both_strands_and_unknown_bases(spark):
    matrix = [[0.97, 0.01, 0.01], [0.01, 0.97, 0.01], [0.01, 0.01, 0.97], [0.01, 0.01, 0.01]]
    hits = {(r["start"], r["strand"]) for r in motifs.pwm_scan(seqs(spark, "TTACGNACGTCGT"), matrix, 5.0).collect()}
    assert hits == {(2, "+"), (6, "+"), (7, "-"), (10, "-")}


def test_evaluation_rejects(spark):
    out = {r["seq_id"]: r["reject"] for r in flags.evaluate(seqs(spark, "ACG", "ACGT" * 10, "ACGTXACGTACGT")).collect()}
    assert out == {0: "too_short", 1: None, 2: "invalid_characters"}


def test_variant_mismatch_and_cpg(spark):
    base = "A" * 60 + "CA" + "T" * 60
    var = spark.createDataFrame([(0, 0, 61, "A", "G"), (1, 0, 61, "C", "G")], "variant_id long, seq_id long, pos int, ref string, alt string")
    rows = {r["variant_id"]: r for r in variants.variant_deltas(var, seqs(spark, base)).collect()}
    assert rows[0]["cpg_impact"] == "cpg_created" and rows[0]["reject"] is None
    assert rows[1]["reject"] == "reference_mismatch"


VARIANT = "variant_id long, seq_id long, pos int, ref string, alt string"


def test_variant_windows_over_chunk_seams_equal_slices(spark):
    text, other = random_seq(21, 700), random_seq(22, 90)
    rng = random.Random(23)
    rows = [(i, 0, at, text[at:at + span], rng.choice(["", "A", "CG", "TTTTT"])) for i, (at, span) in enumerate(
        [(0, 1), (49, 2), (63, 3), (64, 1), (127, 0), (128, 140), (300, 1), (300, 1), (699, 1), (650, 50), (690, 4)])]
    rows += [(100, 1, 40, other[40].lower(), "G"), (101, 1, 89, other[89] + "A", "G"), (102, 1, 500, "A", "C"), (103, 7, 5, "A", "C"),
             (104, 1, -1, "A", "C"), (105, None, 3, "A", "C"), (106, 0, None, "A", "C"), (107, 0, 5, None, "C"), (108, 0, 5, text[5], None)]
    var = spark.createDataFrame(rows, VARIANT)
    whole = spark.createDataFrame([(0, text), (1, other), (2, ""), (3, None)], "seq_id long, sequence string")
    cuts = [0, 100, 163, 164, 420, 700]
    pieces = [(0, k, a, text[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(1, 0, 0, other)]
    cut = spark.createDataFrame(pieces, "seq_id long, chunk long, start_pos long, sequence string")
    for table in (whole, cut):
        got = {r["variant_id"]: r for r in variants.apply_variants(var, table, 20, 64).collect()}
        assert len(got) == len(rows)
        for i, seq_id, at, ref, alt in rows:
            source = {0: text, 1: other}.get(seq_id, "")
            if i < 101:
                low = max(0, at - 20)
                tail = source[at + len(ref):at + len(ref) + 20]
                assert got[i]["ref_seq"] == source[low:at] + ref.upper() + tail, i
                assert got[i]["alt_seq"] == source[low:at] + alt + tail, i
            else:
                assert got[i]["reject"] == "reference_mismatch" and got[i]["ref_seq"] is None, i


def test_periodicity_does_not_depend_on_chunks(spark, monkeypatch):
    texts = ["A" * 22, "A" * 40, random_seq(31, 23), random_seq(32, 600, "AATC"), random_seq(33, 64, "ACGTN"), "GC" * 30, "TTGCGCGCGC" * 9]
    rows = spark.createDataFrame([(i, "ref", s) for i, s in enumerate(texts)], "variant_id long, allele string, sequence string")
    plain = variants.chunks
    found = []
    for size in (64, 8192):
        monkeypatch.setattr(variants, "chunks", lambda *a, size=size, **k: plain(*a, size=size, **k))
        found.append({r["variant_id"]: r["periodicity"] for r in variants._periodicity(rows).collect()})
    assert found[0] == found[1] and 0 not in found[0] and set(found[0]) == set(range(1, len(texts)))
    for i, text in list(enumerate(texts))[1:]:
        x = [float(text[k:k + 2] in ("AA", "TT", "AT", "TA")) for k in range(len(text) - 1)]
        r = []
        for lag in (10, 11):
            a, b = x[lag:], x[:-lag]
            varied = len(set(a)) > 1 and len(set(b)) > 1
            r.append(statistics.correlation(a, b) if varied else 0.0)
        assert found[0][i] == pytest.approx(sum(r) / 2 if sum(x) >= 2 else 0.0), text


def test_rle_and_fasta_files(spark, tmp_path):
    (tmp_path / "chr1.rle").write_text("5 10\n7 3\n0 2\n")
    got = [(r["start_pos"], r["end_pos"], r["score"]) for r in readers.read_rle_scores(spark, str(tmp_path)).orderBy("start_pos").collect()]
    assert got == [(0, 10, 5.0), (10, 13, 7.0), (13, 15, 0.0)]
    fasta = tmp_path / "fa"
    fasta.mkdir()
    (fasta / "x.fa").write_text(">s1 first\nacgt\nAC\n>s2\nGGG\n")
    got = {r["header"]: r["sequence"] for r in readers.read_fasta(spark, str(fasta)).collect()}
    assert got == {"s1 first": "ACGTAC", "s2": "GGG"}


def test_bed_file_reader(spark, tmp_path):
    (tmp_path / "H3K4me3.bed").write_text("#c\ntrack x\nchr1\t5\t9\tn\t0\t.\t1.5\t.\t2\t-1\nchrUn\t1\t2\tn\t0\t.\t1\t1\t1\t1\nchr2\tx\t9\tn\t0\t.\t1\t1\t1\t1\n")
    rows = readers.read(spark, str(tmp_path), "narrow_peak").collect()
    assert [(r["chr_id"], r["start_pos"], r["signal_value"], r["p_value"], r["peak_offset"], r["file"]) for r in rows] == [
        (1, 5, 1.5, None, None, "H3K4me3.bed")]


def test_fasta_chunks_over_many_file_blocks(spark, tmp_path):
    rng = random.Random(5)
    records = {f"r{i} >odd|{i}": "".join(rng.choice("ACGTn") for _ in range(rng.choice([0, 1, 37, 400, 2500]))) for i in range(9)}
    folder = tmp_path / "fa"
    folder.mkdir()
    (folder / "x.fa").write_text("".join(f">{h}\n" + "".join(f"{s[k:k + 50]}\n" for k in range(0, len(s), 50)) for h, s in records.items()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        chunks = readers.read_fasta_chunks(spark, str(folder), 128)
        assert chunks.agg(F.max(F.length("sequence"))).first()[0] <= 128
        got = {}
        for r in sorted(chunks.collect(), key=lambda r: r["chunk"]):
            assert len(got.get(r["header"], "")) == r["start_pos"]
            got[r["header"]] = got.get(r["header"], "") + r["sequence"]
        assert got == {h: s.upper() for h, s in records.items() if s}
        assert {r["header"]: r["sequence"] for r in readers.read_fasta(spark, str(folder)).collect()} == got
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_windows_of_any_chunk_grid(spark, tmp_path):
    rng = random.Random(8)
    own = {f"r{i}": "".join(rng.choice("ACGT" if rng.random() < 0.9 else "N" * 40) for _ in range(n)) for i, n in enumerate((1, 499, 500, 999, 1000, 1001, 2499, 2500, 70_001))}
    own["n"] = "N" * 600 + "A" * 400 + "N" * 500 + "A" * 500
    for i, names in enumerate((list(own)[:4], list(own)[4:])):
        (tmp_path / f"f{i}.fa").write_text("".join(f">{n} of a file\n" + "\n".join(own[n][j : j + 61] for j in range(0, len(own[n]), 61)) + "\n" for n in names))
    want = sorted((k, w, min(w + 1000, len(s)), s[w : w + 1000]) for k, s in own.items() for w in range(0, len(s), 1000)
                  if len(s[w : w + 1000]) >= 500 and s[w : w + 1000].count("N") <= 0.5 * len(s[w : w + 1000]))
    for size in (1 << 16, 1000, 700, 1536, 333):
        got = readers.fasta_chunk_windows(readers.read_fasta_chunks(spark, str(tmp_path), size))
        assert sorted(map(tuple, got.collect())) == want, size
