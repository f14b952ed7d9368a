"""Constants, code lists and level orders the results depend on.

Everything in this file is data, not logic. Values must stay exactly as they
are for results to agree with the published inventory summaries.
"""

import math

# --- plot geometry and unit conversions -------------------------------------
PLOT_RADIUS_M = 14
ACRES_PER_HECTARE = 2.47105
PLOT_AREA_HA = math.pi * (PLOT_RADIUS_M / 100) ** 2
PLOT_AREA_AC = PLOT_AREA_HA * ACRES_PER_HECTARE
CM_PER_INCH = 2.54
SQFT_PER_SQM = 10.7639

# --- tree thresholds and size classes ----------------------------------------
MIN_DBH_CM = 10.0
TEN_INCHES_CM = 25.4
SIZE_CLASS_UPPER_IN = (10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0)
SIZE_CLASSES = ("04-10", "10-20", "20-30", "30-40", "40-50", "50-60", "60-70")

# --- species groups ----------------------------------------------------------
SPECIES_GROUPS = ("unknown", "tanoak", "hardwood", "pine", "shade_tolerant")
SHADE_TOLERANT_CODES = ("ABCO", "ABMA", "CADE", "PSME", "TABR")
PINE_CODES = ("PILA", "PINUS", "PIPO", "PIJE")
PINE_CODES_ONE_YEAR = ("PILA", "PINUS", "PIPO")
HARDWOOD_CODES = ("ACMA", "ARME", "CONU", "QUCH", "QUKE")
TANOAK_CODES = ("LIDE",)

# --- plot attributes ---------------------------------------------------------
ELEV_CLASSES = ("Low elev", "High elev")
ELEV_SPLIT_M = 1305.0
CWHR_TYPE_CODES = {
    "Douglas fir": "DFR",
    "Douglas Fir": "DFR",
    "Ponderosa Pine": "PPN",
    "Sierran mixed conifer": "SMC",
}
CWHR_COVER_CODES = {"60+": "D"}
CWHR_COVERS = ("S", "P", "M", "D")
CWHR_SIZES = ("0", "1", "2", "3", "4", "5", "6")
TREATED_VALUES = ("y", "inferred")
PLOT_COLUMNS_2025 = {
    "cavities_l": "cavities_large",
    "cavities_s": "cavities_small",
    "Observer_o": "Observer_other",
}
UTM_ZONE = 10
DEM_ZOOM = 12

# --- planar-transect fuel mass (tons per acre) -------------------------------
# class: (squared diameter in2, specific gravity, transect length m)
FUEL_CLASSES = {
    "1hr": (0.021, 0.56, 2),
    "10hr": (0.212, 0.55, 2),
    "100hr": (2.672, 0.53, 3),
}
FUEL_K = 11.64
FUEL_ANGLE = 1.023
FUEL_SLOPE_CORRECTION = 1
FUEL_TRANSECTS = 2
FEET_PER_M_FUEL = 3.28

# --- survey corrections ------------------------------------------------------
PLOT_ID_FIXES_2024 = {"TR_GY_R001": "TR_GV_R001", "TR_GY_R002": "TR_GV_R002"}
DBH_FIX = {
    "match": {"year": "2025", "plot_id": "TR_TP_103", "species_code": "PSME", "dbh_cm": 168.0},
    "dbh_cm": 16.8,
}
TREE_NUM_FIX = {
    "match": {"year": "2025", "plot_id": "TR_TP_121", "tree_num": 23.0, "dbh_cm": 15.0},
    "tree_num": 9000.0,
}
RESURVEYED_PLOTS = (("2024", "TR_TP_R002"), ("2025", "TR_TP_112"))
