"""Patterns over chunks against regular expressions over the whole sequence, whatever the chunk size, and over tables that come as chunks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.operators.sequence import flags, motifs, runs


def made() -> dict[str, str]:
    rng = random.Random(9)
    pieces = ["A", "C", "G", "T", "N", "ACAC", "CACA", "GGG", "GGGG", "CCCCC", "ATATATAT", "GCGCGC", "ACACACACAC", "CCCCCCCC", "GTGTGTG", "TTTTTTTTTT", "GGGTTGGGAGGGTTTGGG", "CGCGCG"]
    own = {f"s{i}": "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 120))) for i in range(40)}
    own |= {"one": "A", "two": "AC", "empty": "", "g": "G" * 300, "chain": "ACACACACACCCCCCCCCCGCGCGCGCGGGGGGGGGGTGTGTGTGTG" * 4, "pairs": "AC" * 150, "far": "GGG" + "A" * 7 + "GGG" + "C" * 7 + "GGGT" + "GGG" + "A" * 8 + "GGG"}
    return own


@pytest.fixture(scope="module")
def sequences():
    return made()


def tables(spark, sequences, cut):
    df = spark.createDataFrame(list(sequences.items()), "seq_id string, sequence string")
    if not cut:
        return df
    rows = [(k, i // cut, i, s[i : i + cut]) for k, s in sequences.items() for i in range(0, len(s), cut)]
    return spark.createDataFrame(rows, "seq_id string, chunk int, start_pos int, sequence string")


@pytest.mark.parametrize("size,cut", [(8192, 0), (64, 0), (16, 0), (8192, 24), (8192, 7)])
def test_patterns(spark, sequences, size, cut):
    df = tables(spark, sequences, cut)
    spans = lambda pattern: sorted((k, m.start(), m.end()) for k, s in sequences.items() for m in re.finditer(pattern, s))
    got = lambda out: sorted((r["seq_id"], r["start"], r["end"]) for r in out.collect())
    for least in (5, 8):
        assert got(runs.base_runs(df, "same", least, size)) == spans(motifs.runs_pattern(least))
    for total in (6, 8, 20):
        hits = runs.tandem_runs(df, total, size).collect()
        assert sorted((r["seq_id"], r["start"], r["end"]) for r in hits) == spans(motifs.tandem_pattern(total))
        assert all(sequences[r["seq_id"]][r["start"] : r["start"] + 2] == r["motif"] for r in hits)
    assert got(runs.quadruplexes(df, size)) == spans(runs.G4)
    want = []
    for k, s in sequences.items():
        classes = s.translate(str.maketrans("AGCT", "RRYY"))
        for m in re.finditer(motifs.ALTERNATING_8, classes):
            part = s[m.start() : m.end()]
            score = sum(K.Z_FORM[part[i : i + 2]] for i in range(len(part) - 1)) / (len(part) - 1)
            if score < 2.5:
                want.append((k, m.start(), m.end(), round(score, 2)))
    found = sorted((r["seq_id"], r["start"], r["end"], r["score"]) for r in motifs.z_runs(df, size).collect())
    assert [x[:3] for x in found] == [x[:3] for x in sorted(want)]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in sorted(want)], abs=0.011)


def test_stepped_islands_do_not_depend_on_chunks(spark):
    rng = random.Random(3)
    own = {i: "".join(rng.choice("CGCGCGAT" if (j // 300) % 2 else "ATATACGT") for j in range(2500)) for i in range(4)} | {9: "N" * 300 + "CG" * 200, 10: "CG" * 20}
    df = spark.createDataFrame(list(own.items()), "seq_id int, sequence string")
    want = {}
    for k, s in own.items():
        good = []
        for at in range(0, len(s) - 199, 10):
            w = s[at : at + 200]
            c, g, known = w.count("C"), w.count("G"), 200 - w.count("N")
            good.append(known > 0 and (c + g) / known >= K.ISLAND_GC and c * g > 0 and w.count("CG") / (c * g / 199) >= K.ISLAND_OE)
        want[k] = sum(x and not y for x, y in zip(good, [False, *good]))
    for size in (8192, 256):
        assert {r["seq_id"]: r["island_count"] for r in flags.stepped_island_count(df, size=size).collect()} == want
    assert max(want.values()) > 1


def test_a_long_sequence_runs_in_several_tasks(spark):
    unit = "ACGTTGCAAGGCT" * 7 + "A" * 9 + "GT" * 12 + "GGGTAGGGTAGGGTAGGG"
    rows = [(i, i * 4096, (unit * 60)[:4096]) for i in range(2500)]  # ten million bases as chunks
    df = spark.createDataFrame(rows, "chunk int, start_pos long, sequence string").withColumn("seq_id", F.lit("chr"))
    out = runs.base_runs(df, "same", 8)
    assert out.count() > 50_000
    assert runs.tandem_runs(df, 20).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_structures_of_windows(spark, sequences):
    rng = random.Random(5)
    own = {k: s * 3 for k, s in sequences.items() if len(s) > 200} | {"x": "".join(rng.choice("ACGGGT") for _ in range(3200)), "y": "AGGAGGAAGAGAAGGAAG" * 60 + "CTTCCTCTCTCCTTTCN" * 40}
    df = spark.createDataFrame(list(own.items()), "seq_id string, sequence string")
    got = {(r["seq_id"], r["start_pos"]): r for r in motifs.nonb_density(df).collect()}
    flip = str.maketrans("ACGT", "TGCA")
    for k, s in own.items():
        for at in range(0, len(s), 1000):
            w = s[at : at + 1000]
            if len(w) < 500 or w.count("N") > len(w) / 2:
                assert (k, at) not in got
                continue
            row, kb = got.pop((k, at)), len(w) / 1000
            n = lambda *patterns: sum(len(re.findall(p, w)) for p in patterns) / kb  # noqa: B023,E731
            assert row["g4"] == pytest.approx(n(motifs.G4, motifs.C4)) and row["zdna"] == pytest.approx(n(motifs.ALTERNATING_12)) and row["triplex"] == pytest.approx(n(*motifs.TRIPLEX))
            stems = sum(w[i : i + 6][::-1].translate(flip) in w[i + 6 : i + 20] for i in range(len(w) - 13))
            assert row["cruciform"] == pytest.approx(stems / kb)
            parts = [(w[i : i + 50].count("G"), w[i : i + 50].count("C")) for i in range(0, len(w) - 49, 25)]
            scores = [abs(g - c) / (g + c) * g / 50 for g, c in parts if g + c]
            assert row["rloop"] == pytest.approx(sum(scores) / max(1, len(scores)))
    assert not got


def test_sites_of_any_chunk_size(spark, sequences):
    df = spark.createDataFrame(list(sequences.items()), "seq_id string, sequence string")
    want = sorted((k, i, sum(b in "GC" for b in s[max(0, i - 50) : i + 50]) / len(s[max(0, i - 50) : i + 50])) for k, s in sequences.items() for i in range(len(s) - 1) if s[i : i + 2] == "CG")
    for size in (8192, 64, 10):
        got = sorted((r["seq_id"], r["pos"], r["gc_content"]) for r in motifs.cpg_sites(df, 50, size).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
