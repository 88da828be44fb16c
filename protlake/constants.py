"""Fixed values of the data formats this library reads and writes."""

# Annotation aspects in report order.
ASPECTS = ("BPO", "CCO", "MFO")

# One-hot slot order of residue letters; X collects everything else.
RESIDUE_LETTERS = "ARNDCQEGHILKMFPSTWYVX"

# The twenty standard residues, alphabetical (k-mer vocabulary order).
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"

# Three-letter residue names of the structure file format.
RESIDUE_NAME3 = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "ASX": "B", "GLX": "Z", "SEC": "U", "PYL": "O", "UNK": "X",
}

# Maximum accessible surface per residue (Tien et al. 2013, theoretical).
MAX_SURFACE = {
    "A": 121.0, "R": 265.0, "N": 187.0, "D": 187.0, "C": 148.0, "Q": 214.0, "E": 214.0,
    "G": 97.0, "H": 216.0, "I": 195.0, "L": 191.0, "K": 230.0, "M": 203.0, "F": 228.0,
    "P": 154.0, "S": 143.0, "T": 163.0, "W": 264.0, "Y": 255.0, "V": 165.0,
}
DEFAULT_MAX_SURFACE = 1.0

# Secondary-structure codes that count as helix and as sheet.
HELIX_CODES = ("H", "G", "I")
SHEET_CODES = ("E", "B")

# Widths of the node blocks, edge vector, protein summary and masks.
BASE_WIDTH = 32
STRUCTURE_WIDTH = 10
EMBEDDING_WIDTH = 640
EDGE_WIDTH = 6
SUMMARY_WIDTH = 13

# Clamps used by evaluation and by label priors.
SCORE_CLAMP = 1e-7
PRIOR_CLAMP = 1e-6
RATIO_EPS = 1e-12
