"""Published physical parameters and classification tables.

All tables below are fixed values that results depend on. Dinucleotide tables
are listed in the order AA AC AG AT CA CC CG CT GA GC GG GT TA TC TG TT.
"""

from __future__ import annotations

BASES = ("A", "C", "G", "T")
DINUCLEOTIDES = tuple(a + b for a in BASES for b in BASES)


def _table(*values):
    return dict(zip(DINUCLEOTIDES, values, strict=True))


# SantaLucia 1998 (PNAS 95:1460), DNA/DNA nearest neighbours, 1 M NaCl.
NN_DELTA_H = _table(-7.9, -8.4, -7.8, -7.2, -8.5, -8.0, -10.6, -7.8, -8.2, -9.8, -8.0, -8.4, -7.2, -8.2, -8.5, -7.9)
NN_DELTA_S = _table(
    -22.2, -22.4, -21.0, -20.4, -22.7, -19.9, -27.2, -21.0, -22.2, -24.4, -19.9, -22.4, -21.3, -22.2, -22.7, -22.2
)
NN_DELTA_G37 = _table(
    -1.0, -1.44, -1.28, -0.88, -1.45, -1.84, -2.17, -1.28, -1.30, -2.24, -1.84, -1.44, -0.58, -1.30, -1.45, -1.0
)
# Xia & Turner 1998 (Biochemistry 37:14719), RNA/RNA; U is written as T here.
RNA_DELTA_H = _table(
    -6.82, -11.40, -10.48, -9.38, -10.44, -13.39, -10.64, -10.48, -12.44, -14.88, -13.39, -11.40, -7.69, -12.44,
    -10.44, -6.82,
)
RNA_DELTA_S = _table(
    -19.0, -29.5, -27.1, -26.7, -26.9, -32.7, -26.7, -27.1, -32.5, -36.9, -32.7, -29.5, -20.5, -32.5, -26.9, -19.0
)
RNA_DELTA_G37 = _table(
    -0.93, -2.24, -2.08, -1.10, -2.11, -3.26, -2.36, -2.08, -2.35, -3.42, -3.26, -2.24, -1.33, -2.35, -2.11, -0.93
)
# Sugimoto 1995 (Biochemistry 34:11211), RNA/DNA hybrids; U is written as T here.
HYBRID_DELTA_H = _table(
    -7.8, -5.9, -9.1, -8.3, -9.0, -9.3, -16.3, -7.0, -5.5, -8.0, -12.8, -7.8, -7.8, -8.6, -10.4, -11.5
)
HYBRID_DELTA_S = _table(
    -21.9, -12.3, -23.5, -23.9, -26.1, -23.2, -47.1, -19.7, -13.5, -17.1, -31.9, -21.6, -23.2, -22.9, -28.4, -36.4
)
HYBRID_DELTA_G37 = _table(
    -1.0, -2.1, -1.8, -0.9, -0.9, -2.1, -1.7, -0.9, -1.3, -2.7, -2.9, -1.1, -0.6, -1.5, -1.6, -0.2
)
# Tataurov 2008 (Biophys Chem 133:66), extinction at 260 nm.
EXTINCTION = _table(
    27400, 21200, 25000, 22800, 21200, 14600, 18000, 15200, 25200, 17600, 21600, 20000, 23400, 19000, 19000, 16800
)
MONO_EXTINCTION = {"A": 15400, "C": 7400, "G": 11500, "T": 8700}
# Ho 1986 / Ellison 1985, B-to-Z penalty (kcal/mol per step).
Z_FORM = _table(4.40, 5.20, 3.40, 6.20, 1.40, 2.40, 0.66, 3.40, 3.30, 4.20, 2.40, 5.20, 2.50, 3.30, 1.40, 4.40)
# El Hassan & Calladine 1996, A-form propensity.
A_FORM = _table(0.28, 0.60, 0.68, 0.42, 0.52, 0.88, 0.85, 0.68, 0.74, 0.89, 0.92, 0.60, 0.34, 0.74, 0.52, 0.28)
# Groove geometry in Angstrom (El Hassan & Calladine 1997 and crystal averages).
MAJOR_WIDTH = _table(
    11.7, 11.5, 11.8, 11.6, 11.0, 10.8, 11.2, 11.8, 11.8, 11.0, 10.8, 11.5, 12.0, 11.8, 11.0, 11.7
)
MAJOR_DEPTH = _table(8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 8.0, 8.5, 8.5, 8.5)
MINOR_WIDTH = _table(5.7, 5.4, 5.5, 4.8, 6.0, 5.8, 5.5, 5.5, 5.3, 5.0, 5.8, 5.4, 6.2, 5.3, 6.0, 5.7)
MINOR_DEPTH = _table(7.5, 7.5, 7.5, 8.0, 7.0, 7.0, 7.5, 7.5, 7.5, 7.5, 7.0, 7.5, 7.0, 7.5, 7.0, 7.5)
# Olson 2001 base-pair step parameters (degrees / Angstrom).
ROLL = _table(0.7, 4.8, 2.5, -2.4, 6.5, 1.6, 3.5, 2.5, 0.7, -6.2, 1.6, 4.8, 1.4, 0.7, 6.5, 0.7)
TILT = _table(-1.0, 0.1, -0.1, 0.0, 0.5, -0.1, 0.0, 0.1, 0.7, 0.0, 0.1, -0.1, 0.0, -0.7, -0.5, 1.0)
TWIST = _table(
    35.6, 34.4, 27.7, 31.5, 34.5, 33.7, 29.8, 27.7, 36.9, 40.0, 33.7, 34.4, 36.0, 36.9, 34.5, 35.6
)
RISE = _table(
    3.33, 3.38, 3.38, 3.34, 3.35, 3.38, 3.42, 3.38, 3.38, 3.36, 3.38, 3.38, 3.37, 3.38, 3.35, 3.33
)
SLIDE = _table(
    -0.08, -0.06, 0.27, -0.55, 0.49, 0.17, 0.26, 0.27, -0.01, -0.46, 0.17, -0.06, 0.19, -0.01, 0.49, -0.08
)
SHIFT = _table(0.0, 0.43, -0.04, 0.0, 0.46, 0.10, 0.0, 0.04, -0.03, 0.0, -0.10, -0.43, 0.0, 0.03, -0.46, 0.0)
# Heddi 2010 (NAR 38:1034), TRX flexibility.
DEFORMABILITY = _table(5, 4, 9, 0, 42, 42, 43, 9, 22, 25, 42, 4, 14, 22, 42, 5)

STEP_PROPERTIES = {
    "delta_h": NN_DELTA_H,
    "delta_s": NN_DELTA_S,
    "delta_g_37": NN_DELTA_G37,
    "extinction_260": EXTINCTION,
    "a_form": A_FORM,
    "z_form": Z_FORM,
    "major_groove_width": MAJOR_WIDTH,
    "major_groove_depth": MAJOR_DEPTH,
    "minor_groove_width": MINOR_WIDTH,
    "minor_groove_depth": MINOR_DEPTH,
    "roll": ROLL,
    "tilt": TILT,
    "twist": TWIST,
    "rise": RISE,
    "slide": SLIDE,
    "shift": SHIFT,
    "deformability": DEFORMABILITY,
}
# Every table value times this scale is an integer, so sums over steps are exact.
STEP_SCALE = 100

# Duplex initiation (SantaLucia 1998 Table 2) and gas constant in cal/(mol K).
INIT_DH = {"GC": 0.1, "AT": 2.3}
INIT_DS = {"GC": -2.8, "AT": 4.1}
GAS_CONSTANT_CAL = 1.987
SALT_ENTROPY = 0.368
KELVIN_37 = 273.15 + 37
OLIGO_LIMIT = 60

# Substitution channels by reference and alternative base.
SBS_CHANNELS = {"c_to_a": ("C", "A"), "c_to_g": ("C", "G"), "c_to_t": ("C", "T"), "t_to_a": ("T", "A")}
SBS_TYPES = (("C", "A"), ("C", "G"), ("C", "T"), ("T", "A"), ("T", "C"), ("T", "G"))

# Recognition sites of six-cutters used in cloning.
RESTRICTION_SITES = {
    "EcoRI": "GAATTC",
    "BamHI": "GGATCC",
    "HindIII": "AAGCTT",
    "XbaI": "TCTAGA",
    "SalI": "GTCGAC",
    "NotI": "GCGGCCGC",
}

# Chromosome ids (1..22, X=23, Y=24, M=25).
CHROMOSOME_IDS = {**{f"chr{i}": i for i in range(1, 23)}, "chrX": 23, "chrY": 24, "chrM": 25}

# Sequence flag thresholds.
FLAG_HIGH_GC, FLAG_LOW_GC = 0.70, 0.30
FLAG_LOW_STABILITY, FLAG_HIGH_STABILITY = -0.80, -1.80
FLAG_Z_FORM = 0.40
FLAG_HOMOPOLYMER, FLAG_LONG_HOMOPOLYMER = 8, 12
FLAG_DINUC_REPEAT = 20
FLAG_EXTREME_HIGH, FLAG_EXTREME_LOW = 0.80, 0.15
FLAG_KMER = 15
FLAG_SILENCING_ISLANDS = 3
ISLAND_LENGTH, ISLAND_GC, ISLAND_OE = 200, 0.50, 0.60

# Epigenetic context distances.
SHORE_DISTANCE, SHELF_DISTANCE = 2000, 4000

# Method order of id mappings, best first.
MAPPING_METHODS = ("exact_id", "coord_overlap", "liftover", "sequence_match")

# Repeat-class heuristics.
REACTIVATION_BASE = {"LTR": 0.7, "LINE": 0.5, "SINE": 0.3, "DNA": 0.1, "SVA": 0.6}
REACTIVATION_DEFAULT = 0.2
SILENCING = {
    "LINE": ("methylation", 0.85),
    "SINE": ("methylation", 0.90),
    "LTR": ("mixed", 0.80),
    "DNA": ("none", 0.70),
    "SVA": ("methylation", 0.75),
}
SILENCING_DEFAULT = ("none", 0.50)

# Fragility composite weights and breakpoint decay half life (bp).
FRAGILITY_WEIGHTS = {"nonb": 0.35, "curvature": 0.25, "stacking": 0.25, "bp_prox": 0.15}
BREAKPOINT_HALF_LIFE = 500_000

# Default protein half life in hours.
DEFAULT_HALF_LIFE = 46.0

# Amino acids (letter, code, name, mass, volume, area, hydropathy, interface,
# consensus, side pKa, charge at pH 7, cost).
AMINO_ACIDS = (
    ("G", "Gly", "Glycine", 57.02, 60, 75, -0.4, -0.01, 0.62, None, 0.0, 11.7),
    ("A", "Ala", "Alanine", 71.08, 88, 115, 1.8, 0.17, 0.62, None, 0.0, 11.7),
    ("V", "Val", "Valine", 99.13, 140, 155, 4.2, -0.07, 0.84, None, 0.0, 23.3),
    ("L", "Leu", "Leucine", 113.16, 166, 170, 3.8, -0.56, 0.94, None, 0.0, 27.3),
    ("I", "Ile", "Isoleucine", 113.16, 169, 175, 4.5, -0.31, 0.88, None, 0.0, 32.3),
    ("P", "Pro", "Proline", 97.12, 112, 145, -1.6, -0.45, 0.12, None, 0.0, 20.3),
    ("F", "Phe", "Phenylalanine", 147.18, 189, 210, 2.8, 1.13, 1.19, None, 0.0, 52.0),
    ("W", "Trp", "Tryptophan", 186.21, 228, 255, -0.9, 1.85, 0.81, None, 0.0, 74.3),
    ("M", "Met", "Methionine", 131.20, 163, 185, 1.9, -0.23, 0.74, None, 0.0, 34.3),
    ("S", "Ser", "Serine", 87.08, 89, 115, -0.8, 0.13, 0.18, None, 0.0, 11.7),
    ("T", "Thr", "Threonine", 101.10, 116, 140, -0.7, -0.14, 0.05, None, 0.0, 18.7),
    ("C", "Cys", "Cysteine", 103.14, 108, 135, 2.5, -0.24, 0.29, 8.3, 0.0, 24.7),
    ("Y", "Tyr", "Tyrosine", 163.18, 194, 230, -1.3, 0.94, 0.26, 10.1, 0.0, 50.0),
    ("H", "His", "Histidine", 137.14, 153, 195, -3.2, 0.11, -0.40, 6.0, 0.1, 38.3),
    ("D", "Asp", "Aspartate", 115.09, 111, 150, -3.5, -1.23, -0.90, 3.65, -1.0, 12.7),
    ("E", "Glu", "Glutamate", 129.12, 138, 190, -3.5, -2.02, -0.74, 4.25, -1.0, 15.3),
    ("N", "Asn", "Asparagine", 114.10, 114, 160, -3.5, -0.42, -0.78, None, 0.0, 14.7),
    ("Q", "Gln", "Glutamine", 128.13, 143, 180, -3.5, -0.58, -0.85, None, 0.0, 16.3),
    ("K", "Lys", "Lysine", 128.17, 168, 200, -3.9, -0.99, -1.50, 10.5, 1.0, 30.3),
    ("R", "Arg", "Arginine", 156.19, 173, 225, -4.5, -0.81, -2.53, 12.5, 1.0, 27.3),
)
