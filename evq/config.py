"""Analysis constants. Every operator reads them at call time, so assigning a
new value to a module attribute changes the behaviour of later calls."""

# --- fixed values -----------------------------------------------------------

RANDOM_STATE = 414
LUMI = 139.0
DEFAULT_POI = "SigXsecOverSM"
UNSCORED = -9999.0

SELECTIONS = {
    "1j1b": "(reg1j1b == True) & (OS == True)",
    "2j1b": "(reg2j1b == True) & (OS == True)",
    "2j2b": "(reg2j2b == True) & (OS == True)",
}

FEATURES = {
    "1j1b": [
        "cent_lep1lep2",
        "deltapT_lep1_lep2",
        "mass_lep1jet1",
        "mass_lep2jet1",
        "mass_lep2jet1met",
        "mT_jet1met",
        "pT_jetS1",
        "pTsys_jet1met",
        "pTsys_lep1lep2",
        "pTsys_lep1lep2jet1met",
    ],
    "2j1b": [
        "deltaR_lep2_jet1",
        "HTratio_lep1lep2_lep1lep2jet1jet2met",
        "HTratio_lep1lep2_lep1lep2jet1met",
        "mass_lep1jet1",
        "mass_lep1jet2",
        "pTsys_lep1lep2",
        "pTsys_lep1lep2jet1jet2met",
        "pTsys_lep1lep2jet1met",
    ],
    "2j2b": [
        "mass_lep1jet1",
        "mass_lep1jet2",
        "mass_lep2jet1",
        "mass_lep2jet2",
        "pT_jet2",
        "pTsys_jet1jet2",
        "pTsys_lep1lep2met",
    ],
}

# Alternative feature sets.
FEATURES_TMVA = {
    "1j1b": [
        "cent_lep1lep2",
        "deltapT_lep1_jet1",
        "deltaR_lep1_lep2",
        "deltaR_lep2_jet1",
        "mass_lep1jet1",
        "mass_lep2jet1",
        "mT_lep2met",
        "nsoftbjets",
        "nsoftjets",
        "pTsys_lep1lep2",
        "pTsys_lep1lep2jet1",
        "pTsys_lep1lep2jet1met",
    ],
    "2j1b": [
        "mass_lep1jet1",
        "mass_lep1jet2",
        "mass_lep2jet1",
        "mass_lep2jet2",
        "psuedoContTagBin_jet1",
        "psuedoContTagBin_jet2",
        "pT_jet2",
        "pTsys_lep1lep2jet1jet2met",
    ],
    "2j2b": [
        "deltaR_lep1_jet1",
        "mass_lep1jet1",
        "mass_lep1jet2",
        "mass_lep2jet1",
        "mass_lep2jet2",
        "pT_jet2",
        "pTsys_lep1lep2met",
    ],
}

AVOID = [
    "E_jet1",
    "E_jet2",
    "E_jetL1",
    "E_jetS1",
    "eta_jetL1",
    "eta_jetS1",
    "eta_met",
    "mass_jet1",
    "mass_jet2",
    "mass_jetF",
    "mass_jetL1",
    "mass_jetS1",
    "nbjets",
    "njets",
    "phi_jet1",
    "phi_jet2",
    "phi_lep1",
    "phi_lep2",
    "pT_jetL1",
    "pT_lep3",
    "sumet",
    "tmva_bdt_response",
]

AVOID_BY_REGION = {
    "1j1b": ["_nothing"],
    "2j1b": ["HT_jet1jet2", "deltaR_lep1lep2_jet1jet2met", "mass_lep2jet1", "pT_jet2"],
    "2j2b": ["deltaR_jet1_jet2"],
}

META_COLUMNS = [
    "reg1j1b",
    "reg2j1b",
    "reg2j2b",
    "reg1j0b",
    "reg2j0b",
    "isMC16a",
    "isMC16d",
    "isMC16e",
    "OS",
    "SS",
    "elmu",
    "elel",
    "mumu",
    "charge_lep1",
    "charge_lep2",
    "pdgId_lep1",
    "pdgId_lep2",
    "runNumber",
    "randomRunNumber",
    "eventNumber",
]

SCAN_GRID = {
    "max_depth": [3, 4, 5, 6, 7],
    "num_leaves": [8, 16, 32, 64, 128],
    "learning_rate": [0.05, 0.07, 0.1, 0.2],
    "min_child_samples": [100, 250, 500, 1000, 2000],
    "reg_lambda": [0],
}

TRAIN_AXES = {
    "learning_rate": 0.1,
    "max_depth": 5,
    "min_child_samples": 50,
    "num_leaves": 31,
    "reg_lambda": 0.0,
}

REGION_TUNES = {
    "1j1b": {"learning_rate": 0.2, "num_leaves": 20, "min_child_samples": 50, "max_depth": 4, "reg_lambda": 0},
    "2j1b": {"learning_rate": 0.1, "num_leaves": 20, "min_child_samples": 120, "max_depth": 7, "reg_lambda": 0},
    "2j2b": {"learning_rate": 0.2, "num_leaves": 20, "min_child_samples": 50, "max_depth": 4, "reg_lambda": 0},
}

# (nbins, lo, hi) of the two-sample response templates, and the excluded response ranges.
TEMPLATE_BINNING = {"1j1b": (18, 0.2, 0.75), "2j1b": (18, 0.2, 0.85), "2j2b": (18, 0.2, 0.90)}
TEMPLATE_KEPT = {"1j1b": (0.35, None), "2j1b": (None, 0.70), "2j2b": (0.45, 0.775)}

# Background fraction used by ``background_fraction="auto"``.
AUTO_BACKGROUND_FRACTION = {"1j1b": 1.0, "2j1b": 0.60, "2j2b": 0.70}

# Columns never written to the per-region samples.
ALWAYS_DROP = {
    "1j1b": ["eta_met", "bdt_response", "minimaxmbl"],
    "2j1b": ["eta_met", "bdt_response"],
    "2j2b": ["eta_met", "bdt_response"],
}

MINOR_BACKGROUNDS = ["Zjets", "Diboson", "MCNP"]

# Regions drawn on a logarithmic axis.
LOG_SCALE_PATTERNS = [r"genericMT2$"]

# Ordered literal replacements of parameter labels (the order matters).
LABEL_REPLACEMENTS = [
    ("_", " "),
    ("ttbar", r"$t\bar{t}$"),
    ("tW", r"$tW$"),
    ("muF", r"$\mu_F$"),
    ("muR", r"$\mu_R$"),
    ("AR ", ""),
    ("RhoT", "Rho T"),
    ("hdamp", r"$h_{\mathrm{damp}}$"),
    ("DRDS", "DR vs DS"),
    ("EffectiveNP", "Eff. NP"),
    ("EffNP", "Eff. NP"),
    ("ptreweight", r"top-$p_{\mathrm{T}}$-reweight"),
    ("MET", r"$E_{\mathrm{T}}^{\mathrm{miss}}$"),
]

# sample group -> (process, dataset ids, simulation type)
SAMPLE_GROUPS = {
    "tW_DR": ("tW_DR", "410648|410649", "FS"),
    "tW_DR_AFII": ("tW_DR", "410648|410649", "AFII"),
    "tW_DR_PS": ("tW_DR", "411038|411039", "AFII"),
    "tW_DR_inc": ("tW_DR", "410646|410647", "FS"),
    "tW_DR_inc_AFII": ("tW_DR", "410646|410647", "AFII"),
    "tW_DS": ("tW_DS", "410656|410657", "FS"),
    "tW_DS_inc": ("tW_DS", "410654|410655", "FS"),
    "ttbar": ("ttbar", "410472", "FS"),
    "ttbar_AFII": ("ttbar", "410472", "AFII"),
    "ttbar_PS": ("ttbar", "410558", "AFII"),
    "ttbar_PS713": ("ttbar", "411234", "AFII"),
    "ttbar_hdamp": ("ttbar", "410482", "AFII"),
    "ttbar_inc": ("ttbar", "410470", "FS"),
    "ttbar_inc_AFII": ("ttbar", "410470", "AFII"),
    "Diboson": ("Diboson", "[0-9]{6}", "FS"),
    "Zjets": ("Zjets", "[0-9]{6}", "FS"),
    "MCNP": ("MCNP", "[0-9]{6}", "FS"),
}

# campaign -> data-taking years (last digits)
DATA_YEARS = {None: "5|6|7|8", "MC16a": "5|6", "MC16d": "7", "MC16e": "8"}

# Kolmogorov distribution: sqrt(2*pi) as rounded by the published routine, and -pi^2/8 * (1, 9, 25).
KOLMOGOROV_W = 2.50662827
KOLMOGOROV_C = [-1.2337005501361697, -11.103304951225528, -30.842513753404244]
