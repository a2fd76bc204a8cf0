"""Chunks and steps: the shared core of the position-based sequence operators.

A sequence is cut into chunks with a halo; the compact chunk strings are what
gets shuffled (one byte per base), and bases are exploded after the shuffle, so
windows over ``(seq_id, chunk)`` reuse that partitioning and no task sees more
than one chunk at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.constants import DINUCLEOTIDES
from spanframe.functions.seqexpr import normalise

CHUNK = 8192
BLOCK = 1 << 20


def _bytes(sequence: Column) -> Column:
    """Bytes of the normal form, none for a null: a column that is never null gives the optimizer no null filter to compute beforehand."""
    return F.coalesce(normalise(sequence), F.lit("")).cast("binary")


def chunks(
    df: DataFrame, left: int = 0, right: int = 0, size: int = CHUNK, sequence: str = "sequence", spread: bool = True
) -> DataFrame:
    """(seq_id, chunk, core_start, core_end, piece_start, piece, n): pieces with ``left``/``right`` halo bases.

    A table that has ``chunk`` and ``start_pos`` beside the sequence is already cut (a FASTA reader's chunks) and gets its halos from its neighbours. Very long sequences are cut in two steps, so that no byte is scanned once
    per chunk. Slices are taken from bytes, where a slice costs its own length.
    """
    if {"chunk", "start_pos"} <= set(df.columns):
        return halo_pieces(df, left, right, sequence)
    keep = [c for c in df.columns if c != sequence]
    n = F.col("n")
    raw = df.select(*keep, _bytes(F.col(sequence)).alias("_raw")).withColumn("n", F.length("_raw"))
    halo = left + right
    # Empty sequences drop out behind the explode: a filter on the text would be pushed below a shuffle of the rows, and the text computed twice.
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")))
    blocks = raw.withColumn("_b", F.explode_outer(starts)).where("_b IS NOT NULL")
    low = F.greatest(F.lit(0), F.col("_b") * BLOCK - left)
    blocks = blocks.withColumn("_lo", low).withColumn(
        "_blk", F.substring("_raw", F.col("_lo") + 1, F.lit(BLOCK + halo + left))
    ).drop("_raw")
    per_block = BLOCK // size
    first = F.col("_b") * per_block
    last = F.least(first + per_block - 1, F.floor((n - 1) / size).cast("int"))
    cut = blocks.withColumn("chunk", F.explode(F.sequence(first, last)))
    core_start = F.col("chunk") * size
    core_end = F.least(n, core_start + size)
    piece_start = F.greatest(F.lit(0), core_start - left)
    piece_end = F.least(n, core_end + right)
    out = cut.select(
        *keep, "chunk", "n", core_start.alias("core_start"), core_end.alias("core_end"),
        piece_start.alias("piece_start"),
        F.substring("_blk", piece_start - F.col("_lo") + 1, piece_end - piece_start).cast("string").alias("piece"),
    )
    return out.repartition("seq_id", "chunk") if spread else out


def halo_pieces(cut: DataFrame, left: int = 0, right: int = 0, sequence: str = "sequence") -> DataFrame:
    """Pieces of sequences that come as chunks (seq_id, chunk, start_pos, sequence, ...): consecutive numbers, end to end, each but the last as long as the halo at least.

    Each chunk sends copies of its ends to its two neighbours, so no task sees more than a chunk, and no row holds more than one.
    """
    keep = [c for c in cut.columns if c not in (sequence, "start_pos", "chunk")]
    text = normalise(F.col(sequence))
    own = cut.where(F.length(sequence) > 0).select(*keep, "chunk", F.col("start_pos").alias("core_start"), text.alias("_text"))
    length = F.length("_text")
    total = own.groupBy("seq_id").agg(F.max(F.col("core_start") + length).alias("n"))
    nothing = F.lit("")
    sent = F.array(
        F.struct(F.col("chunk").alias("to"), F.lit(1).alias("side"), F.col("_text").alias("_part")),
        F.struct((F.col("chunk") + 1).alias("to"), F.lit(0).alias("side"), (F.substring("_text", F.greatest(length - left, F.lit(0)) + 1, F.lit(left)) if left else nothing).alias("_part")),
        F.struct((F.col("chunk") - 1).alias("to"), F.lit(2).alias("side"), (F.substring("_text", 1, right) if right else nothing).alias("_part")),
    )
    parts = own.select(*keep, "core_start", F.inline(sent))
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    joined = parts.groupBy("seq_id", F.col("to").alias("chunk")).agg(
        *[pick(c, 1).alias(c) for c in keep if c != "seq_id"], pick("core_start", 1).alias("core_start"), pick("_part", 1).alias("_own"),
        F.coalesce(pick("_part", 0), nothing).alias("_before"), F.coalesce(pick("_part", 2), nothing).alias("_after")).where("_own IS NOT NULL")
    place = F.col("core_start")
    return joined.join(total, "seq_id").select(
        *keep, "chunk", "n", place.alias("core_start"), (place + F.length("_own")).alias("core_end"), (place - F.length("_before")).alias("piece_start"),
        F.concat("_before", "_own", "_after").alias("piece"))


def bases(pieces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per base of a piece: position ``i`` in the sequence and the piece's bytes."""
    return (
        pieces.withColumn("_bytes", F.col("piece").cast("binary"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)))
        .select(
            "seq_id", "chunk", "n", "core_start", "core_end", *keep, "_bytes", "_o",
            (F.col("piece_start") + F.col("_o")).alias("i"),
        )
    )


def at(offset: int = 0, length: int = 1) -> Column:
    """Slice of the piece starting ``offset`` bases after the current one."""
    return F.substring("_bytes", F.col("_o") + (offset + 1), F.lit(length)).cast("string")


def base_code(base: Column) -> Column:
    """A, C, G, T to 0..3; anything else to null."""
    return F.nullif(F.instr(F.lit("ACGT"), base), F.lit(0)) - 1


def step_code(pair: Column) -> Column:
    """Index 0..15 of a dinucleotide, null with an unknown base."""
    first = F.instr(F.lit("ACGT"), F.substring(pair, 1, 1))
    second = F.instr(F.lit("ACGT"), F.substring(pair, 2, 1))
    return F.when((first > 0) & (second > 0) & (F.length(pair) == 2), (first - 1) * 4 + second - 1)


def by_code(code: Column, table: dict[str, float]) -> Column:
    """Property of a step index."""
    values = F.array(*[F.lit(float(table[d])) for d in DINUCLEOTIDES])
    return F.get(values, code)


def steps(df: DataFrame, left: int = 0, right: int = 0, size: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per dinucleotide step: (seq_id, chunk, i, dinucleotide, code, core).

    ``core`` tells the rows of the chunk itself from those of its halo.
    """
    cut = bases(chunks(df, left, right + 1, size), keep).where(F.col("i") < F.col("n") - 1)
    cut = cut.where(F.col("_o") < F.length("_bytes") - 1)
    return cut.select(
        "seq_id", "chunk", "n", "i", *keep, at(0, 2).alias("dinucleotide"),
        ((F.col("i") >= F.col("core_start")) & (F.col("i") < F.col("core_end"))).alias("core"),
    ).withColumn("code", step_code(F.col("dinucleotide")))


def dinuc_index(df: DataFrame) -> DataFrame:
    """Step index per position, 255 where a base is unknown."""
    return steps(df).select("seq_id", "i", F.coalesce("code", F.lit(255)).alias("code"))


def fixed_windows(df: DataFrame, size: int, step: int | None = None, min_length: int = 1) -> DataFrame:
    """Windows of each sequence, the last one truncated: (seq_id, start_pos, end_pos, window)."""
    step = step or size
    n = F.length("_raw")
    raw = df.select("seq_id", _bytes(F.col("sequence")).alias("_raw"))
    starts = raw.withColumn("start_pos", F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))))).where("start_pos IS NOT NULL")
    out = starts.select(
        "seq_id", "start_pos", F.least(F.col("start_pos") + size, n).alias("end_pos"),
        F.substring("_raw", F.col("start_pos") + 1, F.lit(size)).cast("string").alias("window"),
    )
    return out.where(F.col("end_pos") - F.col("start_pos") >= min_length)


def known_windows(df: DataFrame, size: int = 1000) -> DataFrame:
    """Non-overlapping windows without short ends (under half) and without windows over half unknown."""
    unknown = F.length("window") - F.length(F.replace(F.col("window"), F.lit("N"), F.lit("")))
    out = fixed_windows(df, size, min_length=size // 2)
    return out.where(unknown <= 0.5 * F.length("window"))


def slice_regions(regions: DataFrame, sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """Sequence text of each region (region_id, seq_id, start_pos, end_pos), read chunk by chunk."""
    wanted = regions.withColumn(
        "chunk", F.explode(F.sequence(F.floor(F.col("start_pos") / size).cast("int"),
                                      F.floor((F.col("end_pos") - 1) / size).cast("int")))
    )
    pieces = chunks(sequences.select("seq_id", "sequence"), size=size, spread=False)
    joined = wanted.join(pieces, ["seq_id", "chunk"])
    low = F.greatest(F.col("start_pos"), F.col("core_start"))
    high = F.least(F.col("end_pos"), F.col("core_end"))
    parts = joined.where(high > low).select(
        *regions.columns, "chunk",
        F.substring("piece", (low - F.col("core_start") + 1).cast("int"), (high - low).cast("int")).alias("part"),
    )
    return parts.groupBy(*regions.columns).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda s: s["part"]), "")
        .alias("sequence")
    )
