"""Fixed values. Every entry must equal the published table it names, or results change."""

# The twenty standard residues.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

# Maximum solvent accessible area per residue, square angstroms (Tien et al. 2013).
MAX_ASA = {
    "A": 129.0, "R": 274.0, "N": 195.0, "D": 193.0, "C": 167.0, "E": 223.0, "Q": 225.0,
    "G": 104.0, "H": 224.0, "I": 197.0, "L": 201.0, "K": 236.0, "M": 224.0, "F": 240.0,
    "P": 159.0, "S": 155.0, "T": 172.0, "W": 285.0, "Y": 263.0, "V": 174.0,
}

# Side-chain and terminal pKa sets.
PKA = {
    "emboss": {
        "Nterm": 8.6, "Cterm": 3.6, "K": 10.8, "R": 12.5, "H": 6.5,
        "D": 3.9, "E": 4.1, "C": 8.5, "Y": 10.1,
    },
    "bjellqvist": {
        "Nterm": 7.5, "Cterm": 3.55, "K": 10.0, "R": 12.0, "H": 5.98,
        "D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0,
    },
}

# Letters that count in each charge definition.
SIMPLE_POSITIVE, SIMPLE_NEGATIVE = "KR", "DE"
TITRATING_POSITIVE, TITRATING_NEGATIVE = "KRH", "DECY"

# Kyte and Doolittle (1982) hydropathy, its minimum and its range.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4,
    "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8,
    "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
HYDROPATHY_MIN, HYDROPATHY_RANGE = -4.5, 9.0

# Charge-hydropathy boundary (Uversky, Gillespie and Fink 2000).
BOUNDARY_SLOPE, BOUNDARY_INTERCEPT = 2.785, -1.151

# Residue names to letters.
RESIDUE_LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E",
    "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F",
    "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
MODIFIED_LETTERS = {
    "MSE": "M", "FME": "M", "MHO": "M", "HYP": "P", "CSO": "C", "CME": "C", "CSD": "C",
    "OCS": "C", "HIC": "H", "MLY": "K", "M3L": "K", "ALY": "K", "KCX": "K", "LLP": "K",
    "SEP": "S", "TPO": "T", "PTR": "Y", "PCA": "Q",
}
CHARGE_ALTERING = ("SEP", "TPO", "PTR", "ALY", "KCX", "PCA")

# Side-chain atoms that carry the charge.
POSITIVE_ATOMS = {"LYS": ("NZ",), "ARG": ("NE", "NH1", "NH2"), "HIS": ("ND1", "NE2")}
NEGATIVE_ATOMS = {"ASP": ("OD1", "OD2"), "GLU": ("OE1", "OE2")}

# Van der Waals radii in angstroms (Bondi 1964), and the radius of any other element.
ATOM_RADII = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8, "P": 1.8}
OTHER_RADIUS = 1.8

# Cell texts that stand for a missing value and are refused.
PLACEHOLDERS = ("", "na", "n/a", "nan", "none", "null", "-")
