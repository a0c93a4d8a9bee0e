"""Column sets, alias maps and fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MUTATION_COLUMNS = ["pdb_id", "chain", "position", "wild_type", "mutation", "ddG", "pH", "temperature", "protein_name"]

# Names under which tables of mutations give each column.
ALIASES = {
    "pdb_id": ["pdb", "pdb_id", "pdbid", "#pdb", "pdb code"],
    "chain": ["chain", "chain_id"],
    "position": ["position", "pos", "residue_number", "resnum", "residue number", "mutation_position"],
    "wild_type": ["wild", "wt", "wild_type", "wildtype", "wild type", "from"],
    "mutation": ["mutant", "mut", "mutation", "mutant_type", "to"],
    "ddG": ["ddg", "delta_delta_g", "ddg(kcal/mol)", "ddg_exp", "ddg (kcal/mol)", "experimental_ddg"],
    "pH": ["ph"],
    "temperature": ["temp", "temperature", "t"],
    "protein_name": ["protein", "protein_name", "name"],
}

# Amino acids by one letter, with hydrophobicity (Kyte-Doolittle), formal charge at pH 7, volume (Zamyatnin).
AMINO_ACIDS = [
    ("A", "ALA", 1.8, 0.0, 88.6),
    ("R", "ARG", -4.5, 1.0, 173.4),
    ("N", "ASN", -3.5, 0.0, 114.1),
    ("D", "ASP", -3.5, -1.0, 111.1),
    ("C", "CYS", 2.5, 0.0, 108.5),
    ("Q", "GLN", -3.5, 0.0, 143.8),
    ("E", "GLU", -3.5, -1.0, 138.4),
    ("G", "GLY", -0.4, 0.0, 60.1),
    ("H", "HIS", -3.2, 0.5, 153.2),
    ("I", "ILE", 4.5, 0.0, 166.7),
    ("L", "LEU", 3.8, 0.0, 166.7),
    ("K", "LYS", -3.9, 1.0, 168.6),
    ("M", "MET", 1.9, 0.0, 162.9),
    ("F", "PHE", 2.8, 0.0, 189.9),
    ("P", "PRO", -1.6, 0.0, 112.7),
    ("S", "SER", -0.8, 0.0, 89.0),
    ("T", "THR", -0.7, 0.0, 116.1),
    ("W", "TRP", -0.9, 0.0, 227.8),
    ("Y", "TYR", -1.3, 0.0, 193.6),
    ("V", "VAL", 4.2, 0.0, 140.0),
]
LETTERS = "".join(x[0] for x in AMINO_ACIDS)
#: What an unknown amino acid counts as: hydrophobicity, charge, volume.
UNKNOWN = (0.0, 0.0, 100.0)

# The features of a mutation by group, in order.
FEATURE_GROUPS = {
    "resistance_distance": ["delta_R_active_site", "delta_R_global_mean", "delta_R_max", "delta_R_std", "R_eccentricity_wt", "delta_R_eccentricity"],
    "global_circuit": ["delta_kirchhoff", "propagation_radius", "delta_algebraic_connectivity", "spectral_gap_ratio"],
    "current_flow_centrality": ["current_flow_betweenness_wt", "delta_current_flow_betweenness", "resistance_centrality_wt", "delta_resistance_centrality"],
    "voltage_potential": ["voltage_wt", "delta_voltage", "transfer_voltage_active_wt", "delta_transfer_voltage_active"],
    "spectral_mode": ["fiedler_component_wt", "delta_fiedler_component", "conductance_degree_wt"],
    "current_flow_patterns": [
        "effective_conductance_to_active_wt", "delta_effective_conductance_to_active", "max_edge_current_wt", "delta_max_edge_current",
        "current_entropy_wt", "delta_current_entropy", "site_current_fraction_wt", "delta_site_current_fraction", "current_redistribution",
        "current_concentration_wt", "delta_current_concentration", "neighbor_current_asymmetry_wt",
    ],
    "voltage_transfer": ["voltage_transfer_ratio_wt", "delta_voltage_transfer_ratio", "mutual_conductance_wt", "delta_mutual_conductance", "voltage_influence_radius_wt"],
    "power_dissipation": ["power_local_fraction_wt", "delta_power_local_fraction", "power_entropy_wt", "delta_power_entropy", "max_power_edge_wt"],
    "multiscale_dynamics": ["R_shell_1_mean_wt", "R_shell_2_mean_wt", "delta_R_shell_ratio", "commute_time_to_active_wt", "effective_path_count_wt"],
    "green_function": ["green_trace_fraction_wt", "green_row_entropy_wt", "delta_green_row_entropy", "green_anisotropy_wt", "delta_green_anisotropy"],
    "thevenin_norton": ["R_active_site_wt", "circuit_gain_wt", "delta_circuit_gain", "norton_current_wt"],
    "spectral_descriptors": ["spectral_radius_ratio_wt", "eigenvalue_entropy_wt", "delta_eigenvalue_entropy", "effective_graph_resistance_wt"],
    "resistance_geometry": [
        "R_harmonic_mean_wt", "delta_R_harmonic_mean", "R_median_wt", "delta_R_median",
        "R_skewness_wt", "delta_R_skewness", "R_kurtosis_wt", "delta_R_kurtosis",
    ],
    "fold_change": ["R_active_fold_change", "kirchhoff_fold_change", "conductance_degree_fold_change", "R_global_fold_change", "voltage_fold_change"],
    "multiscale_extended": ["R_shell_3_mean_wt", "shell_gradient_wt", "delta_shell_gradient", "R_local_global_ratio_wt"],
    "cross_products": ["conductance_R_active_product", "fiedler_squared_wt", "current_R_product_wt", "voltage_conductance_product_wt", "power_deltaR_product"],
}
FEATURES = [name for group in FEATURE_GROUPS.values() for name in group]


def scales(spark: SparkSession) -> DataFrame:
    """The amino acids as a small dimension table."""
    return spark.createDataFrame(AMINO_ACIDS, "aa1 string, aa3 string, hydrophobicity double, charge double, volume double")
