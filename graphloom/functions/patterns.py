"""Names, patterns and kinds of functional groups, ring systems and their priorities."""

PRIORITY = {"ring": 30, "multi_atom": 20, "single_atom": 10}

FUNCTIONAL = {
    "carboxyl": ("[CX3](=O)[OX2H1]", "multi_atom"),
    "ester": ("[CX3](=O)[OX2][#6]", "multi_atom"),
    "amide": ("[CX3](=O)[NX3]", "multi_atom"),
    "anhydride": ("[CX3](=O)[OX2][CX3](=O)", "multi_atom"),
    "aldehyde": ("[CX3H1](=O)", "multi_atom"),
    "ketone": ("[#6][CX3](=O)[#6]", "multi_atom"),
    "nitro": ("[NX3+](=O)[O-]", "multi_atom"),
    "nitrile": ("[CX2]#[NX1]", "multi_atom"),
    "imine": ("[CX3]=[NX2]", "multi_atom"),
    "azo": ("[NX2]=[NX2]", "multi_atom"),
    "sulfonyl": ("[SX4](=O)(=O)", "multi_atom"),
    "sulfoxide": ("[SX3](=O)", "multi_atom"),
    "thioether": ("[#6][SX2][#6]", "multi_atom"),
    "phosphate": ("[PX4](=O)([OX2])([OX2])[OX2]", "multi_atom"),
    "phosphonate": ("[PX4](=O)([OX2])([OX2])[#6]", "multi_atom"),
    "fluoride": ("[FX1]", "single_atom"),
    "chloride": ("[ClX1]", "single_atom"),
    "bromide": ("[BrX1]", "single_atom"),
    "iodide": ("[IX1]", "single_atom"),
    "hydroxyl": ("[OX2H]", "single_atom"),
    "ether_o": ("[OX2]([#6])[#6]", "single_atom"),
    "epoxide": ("[OX2r3]", "single_atom"),
    "primary_amine": ("[NX3H2]", "single_atom"),
    "secondary_amine": ("[NX3H1]([#6])[#6]", "single_atom"),
    "tertiary_amine": ("[NX3]([#6])([#6])[#6]", "single_atom"),
    "methyl": ("[CH3]", "single_atom"),
    "tert_butyl": ("[CX4]([CH3])([CH3])[CH3]", "multi_atom"),
    "isopropyl": ("[CX4H]([CH3])[CH3]", "multi_atom"),
}

RINGS = {
    "benzene": "c1ccccc1",
    "pyridine": "c1ccncc1",
    "pyrimidine": "c1cncnc1",
    "pyrazine": "c1cnccn1",
    "pyrrole": "c1cc[nH]c1",
    "furan": "c1ccoc1",
    "thiophene": "c1ccsc1",
    "imidazole": "c1cnc[nH]1",
    "oxazole": "c1cocn1",
    "thiazole": "c1cscn1",
    "naphthalene": "c1ccc2ccccc2c1",
    "indole": "c1ccc2[nH]ccc2c1",
    "quinoline": "c1ccc2ncccc2c1",
    "benzofuran": "c1ccc2occc2c1",
    "benzothiophene": "c1ccc2sccc2c1",
    "cyclopropane": "C1CC1",
    "cyclobutane": "C1CCC1",
    "cyclopentane": "C1CCCC1",
    "cyclohexane": "C1CCCCC1",
    "cyclohexene": "C1=CCCCC1",
    "cyclopentene": "C1=CCCC1",
}

#: Motifs that are counted when two sets of molecules are compared. Fixed values.
EVALUATION = {
    "benzene": "c1ccccc1",
    "pyridine": "c1ccncc1",
    "pyrrole": "c1cc[nH]c1",
    "furan": "c1ccoc1",
    "thiophene": "c1ccsc1",
    "imidazole": "c1cnc[nH]1",
    "pyrimidine": "c1cncnc1",
    "naphthalene": "c1ccc2ccccc2c1",
    "hydroxyl": "[OX2H]",
    "carboxyl": "[CX3](=O)[OX2H1]",
    "carbonyl": "[CX3]=[OX1]",
    "aldehyde": "[CX3H1](=O)[#6]",
    "ester": "[#6][CX3](=O)[OX2H0][#6]",
    "amide": "[NX3][CX3](=[OX1])[#6]",
    "amine_primary": "[NX3;H2;!$(NC=O)]",
    "amine_secondary": "[NX3;H1;!$(NC=O)]",
    "amine_tertiary": "[NX3;H0;!$(NC=O)]",
    "nitro": "[$([NX3](=O)=O),$([NX3+](=O)[O-])]",
    "nitrile": "[NX1]#[CX2]",
    "halogen": "[F,Cl,Br,I]",
    "fluorine": "[F]",
    "chlorine": "[Cl]",
    "bromine": "[Br]",
    "iodine": "[I]",
    "ether": "[OD2]([#6])[#6]",
    "thioether": "[#16X2]",
    "sulfone": "[#16X4](=[OX1])(=[OX1])([#6])[#6]",
    "sulfonamide": "[#16X4](=[OX1])(=[OX1])([NX3])[#6]",
    "phosphate": "[PX4](=[OX1])([OX2])([OX2])[OX2]",
}

#: Groups on a benzene ring. Fixed values.
SUBSTITUENTS = {
    "Hydroxyl (-OH)": "cO",
    "Amino (-NH2)": "cN",
    "Methyl (-CH3)": "c[CH3]",
    "Halogen (-X)": "[c;$([cF]),$([cCl]),$([cBr]),$([cI])]",
    "Fluoro (-F)": "cF",
    "Chloro (-Cl)": "cCl",
    "Bromo (-Br)": "cBr",
    "Carbonyl (C=O)": "cC=O",
    "Carboxyl (-COOH)": "cC(=O)O",
    "Nitro (-NO2)": "c[N+](=O)[O-]",
    "Cyano (-CN)": "cC#N",
    "Ether (-OR)": "cOC",
    "Alkyl chain": "c[CH2]",
}
