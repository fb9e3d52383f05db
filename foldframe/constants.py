"""Fixed numeric values and small code tables of the method."""

# Contact probability and cutting.
CONTACT_D0 = 6.0
CONTACT_DELTA = 1.5
PU_MIN = 30
SS_LIMIT = 8
CI_STOP = 98.0
PU_LIMIT = 30
LEVEL_CAP = 64

# Merging.
SIZE_EXPONENT = 0.43
EXTERNAL_FLOOR = 0.001
KEEP_NNC = 0.01
BEAM = 501
DOMAIN_SIZE = 30

# Domain-count model.
COUNT_INTERCEPT = 2.818831
COUNT_SLOPE = 3.582524
COUNT_KNEE = 0.09434462
COUNT_HORIZONTAL = 3.166823
COUNT_VERTICAL = 0.231845

# Quality model.
QX_MIN, QX_MAX = 0.008501, 1.099581
QY_MIN, QY_MAX = 1.797981, 4.124218
QH, QV = 0.5884363, 0.2046999
QM, QQ = 1.680319, 0.4474396
QDV, QDH = 0.2075470, 0.7867766
QD = 0.3288426
STAR_CUTS = ((0.15, 5), (0.05, 4), (-0.05, 3), (-0.15, 2))
OVERLAP_REDUNDANT = 85.0
ALT_MAX_DISTANCE = 0.2
ALT_COMPARE = 20

# Hydrogen bonds and chain breaks.
HB_Q = -27888.0
HB_LOW = -9900
HB_HIGH = -500
HB_MIN_DIST = 0.5
HB_CA_DIST = 9.0
BREAK_DIST = 2.5
SS_BOND_DIST = 3.0

# Statistical potential.
POT_MAX = 15.0
POT_BIN = 0.1
POT_SEP_MIN = 3
POT_SEP_MAX = 5100
POT_CAP = 10.0

# The twenty residues.
THREE_TO_ONE = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}
ONE_TO_THREE = {v: k for k, v in THREE_TO_ONE.items()}

# Common modified residues; pass a larger table to ``standardise_residues`` when needed.
MODIFIED = {"MSE": "MET", "SEP": "SER", "TPO": "THR", "PTR": "TYR", "CSO": "CYS", "CME": "CYS", "HYP": "PRO", "KCX": "LYS",
            "MLY": "LYS", "M3L": "LYS", "LLP": "LYS", "CGU": "GLU", "OCS": "SER", "CSD": "CYS", "ALY": "LYS", "NLE": "LEU"}

# Side-chain atoms per residue (heavy atoms, standard nomenclature).
SIDE_CHAIN = {
    "A": "CB", "C": "CB SG", "D": "CB CG OD1 OD2", "E": "CB CG CD OE1 OE2", "F": "CB CG CD1 CD2 CE1 CE2 CZ", "G": "",
    "H": "CB CG ND1 CD2 CE1 NE2", "I": "CB CG1 CG2 CD1", "K": "CB CG CD CE NZ", "L": "CB CG CD1 CD2", "M": "CB CG SD CE",
    "N": "CB CG OD1 ND2", "P": "CB CG CD", "Q": "CB CG CD OE1 NE2", "R": "CB CG CD NE CZ NH1 NH2", "S": "CB OG",
    "T": "CB OG1 CG2", "V": "CB CG1 CG2", "W": "CB CG CD1 CD2 NE1 CE2 CE3 CZ2 CZ3 CH2", "Y": "CB CG CD1 CD2 CE1 CE2 CZ OH",
}
BACKBONE = ("N", "CA", "C", "O")
# Number of coarse side-chain beads per residue.
SC_BEADS = {"A": 0, "C": 1, "D": 1, "E": 1, "F": 3, "G": 0, "H": 3, "I": 1, "K": 2, "L": 1, "M": 1, "N": 1, "P": 1, "Q": 1, "R": 2,
            "S": 1, "T": 1, "V": 1, "W": 4, "Y": 3}

# Four-atom chains of the side-chain torsions.
CHI_ATOMS = {
    "R": ("N CA CB CG", "CA CB CG CD", "CB CG CD NE", "CG CD NE CZ", "CD NE CZ NH1"), "N": ("N CA CB CG", "CA CB CG OD1"),
    "D": ("N CA CB CG", "CA CB CG OD1"), "C": ("N CA CB SG",), "Q": ("N CA CB CG", "CA CB CG CD", "CB CG CD OE1"),
    "E": ("N CA CB CG", "CA CB CG CD", "CB CG CD OE1"), "H": ("N CA CB CG", "CA CB CG ND1"),
    "I": ("N CA CB CG1", "CA CB CG1 CD1"), "L": ("N CA CB CG", "CA CB CG CD1"),
    "K": ("N CA CB CG", "CA CB CG CD", "CB CG CD CE", "CG CD CE NZ"), "M": ("N CA CB CG", "CA CB CG SD", "CB CG SD CE"),
    "F": ("N CA CB CG", "CA CB CG CD1"), "P": ("N CA CB CG", "CA CB CG CD"), "S": ("N CA CB OG",), "T": ("N CA CB OG1",),
    "W": ("N CA CB CG", "CA CB CG CD1"), "Y": ("N CA CB CG", "CA CB CG CD1"), "V": ("N CA CB CG1",),
}

# Nucleotide and solvent names, element masses, van der Waals radii, largest exposed areas.
RNA_NAMES = ("U",)
DNA_NAMES = ("A", "T", "G", "C")
SOLVENT_NAMES = ("HOH", "H2O", "WAT", "DOD")
AMINO_NAMES = tuple(THREE_TO_ONE) + (
    "5HP", "ABA", "PCA", "FGL", "BHD", "HTR", "MSE", "CEA", "ALS", "TRO", "TPQ", "MHO", "IAS", "HYP", "CGU", "CSE", "RON", "3GA",
    "TYS", "AYA", "FME", "CXM", "SAC", "CSO", "MME", "SEG", "HSE", "HSP", "HSD")
MASSES = {"H": 1.00794, "C": 12.0107, "N": 14.00674, "O": 15.9994, "P": 30.973761, "S": 32.066, "SE": 78.96}
RADII = {"N": 1.65, "CA": 1.87, "C": 1.76, "O": 1.40}
RADIUS_SIDE = 1.80
RADIUS_WATER = 1.40
MAX_AREA = {"A": 115.0, "R": 225.0, "D": 150.0, "N": 160.0, "C": 135.0, "E": 190.0, "Q": 180.0, "G": 75.0, "H": 195.0, "I": 175.0,
            "L": 170.0, "K": 200.0, "M": 185.0, "F": 210.0, "P": 145.0, "S": 115.0, "T": 140.0, "W": 255.0, "Y": 230.0, "V": 155.0}


def representation(name: str) -> list[str]:
    """Atom types (one-letter code + atom name) of one of the nine representations, built from the residue tables."""
    side = [a + atom for a, atoms in SIDE_CHAIN.items() for atom in atoms.split()]
    backbone = [a + atom for a in SIDE_CHAIN for atom in BACKBONE]
    beads = [f"{a}SC{k}" for a, n in SC_BEADS.items() for k in range(1, n + 1)]
    small = ["ABB", "GBB"]
    table = {
        "allatom": side + backbone,
        "allatomCG": [a + "BB" for a in SIDE_CHAIN] + beads,
        "backbone": backbone,
        "sidechains": side + ["GCA"],
        "sidechainsCG": small + beads,
        "CA": [a + "CA" for a in SIDE_CHAIN],
        "CB": [a + ("CA" if a == "G" else "CB") for a in SIDE_CHAIN],
        "BB": [a + "BB" for a in SIDE_CHAIN],
        "SC1": small + [f"{a}SC1" for a, n in SC_BEADS.items() if n],
    }
    return sorted(table[name])
