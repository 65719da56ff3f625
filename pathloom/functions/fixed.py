"""Names and numbers the results depend on.

Fixed values: variable names, warming factors, unit factors, screening limits,
metric labels. Everything here is a default that callers may override.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: variable names -------------------------------------------
NET_TOTAL = "Emissions|CO2|Energy and Industrial Processes"
NET_ENERGY = "Emissions|CO2|Energy"
NET_INDUSTRY = "Emissions|CO2|Industrial Processes"
GROSS_TOTAL = "Emissions|CO2|Energy and Industrial Processes|Gross"
NET_HARMONISED = "Emissions|CO2|Energy and Industrial Processes|Harmonized-DB"
GROSS_HARMONISED = "Emissions|CO2|Energy and Industrial Processes|Gross|Harmonized-DB"

BECCS = "Carbon Sequestration|CCS|Biomass"
DIRECT_AIR = "Carbon Sequestration|Direct Air Capture"
WEATHERING = "Carbon Sequestration|Enhanced Weathering"
REMOVALS = (BECCS, DIRECT_AIR, WEATHERING)
REMOVALS_SUM = "Carbon Sequestration|Sum"

CCS = "Carbon Sequestration|CCS"
CCS_FOSSIL = "Carbon Sequestration|CCS|Fossil"
CCS_INDUSTRY = "Carbon Sequestration|CCS|Industrial Processes"
LAND_USE = "Carbon Sequestration|Land Use"
AFFORESTATION = "Carbon Sequestration|Land Use|Afforestation"

AFOLU_CO2 = "Emissions|CO2|AFOLU"
AFOLU_CH4 = "Emissions|CH4|AFOLU"
AFOLU_N2O = "Emissions|N2O|AFOLU"

N2O_ENERGY = "Emissions|N2O|Energy"
N2O_SECTORS = (
    "Emissions|N2O|Energy",
    "Emissions|N2O|Industrial Processes",
    "Emissions|N2O|Other",
    "Emissions|N2O|Waste",
)
CH4_SECTORS = (
    "Emissions|CH4|Energy",
    "Emissions|CH4|Industrial Processes",
    "Emissions|CH4|Other",
    "Emissions|CH4|Waste",
)
F_GASES = ("Emissions|HFC", "Emissions|PFC", "Emissions|SF6")

GAS_VARIABLES = {
    "N2O": N2O_SECTORS,
    "CH4": CH4_SECTORS,
    "HFC": ("Emissions|HFC",),
    "PFC": ("Emissions|PFC",),
    "SF6": ("Emissions|SF6",),
}

BIOENERGY = "Primary Energy|Biomass"
PRIMARY_ENERGY = "Primary Energy"
RENEWABLES = "Primary Energy|Renewables (incl. Biomass)"
FINAL_ENERGY = "Final Energy"

# --- fixed values: 100-year warming factors per assessment vintage ------------
KT_TO_MT = 0.001
GT_TO_MT = 1000.0
WARMING_FACTORS = {
    ("AR5", "N2O"): 265.0,
    ("AR5", "CH4"): 28.0,
    ("AR6", "CH4"): 29.8,
    ("AR6", "N2O"): 273.0,
    ("AR6", "HFC"): 1530.0,
    ("AR6", "PFC"): 7380.0,
    ("AR6", "SF6"): 25200.0,
}
# unit each gas is reported in, as a factor to Mt
GAS_UNIT_TO_MT = {"CH4": 1.0, "N2O": KT_TO_MT, "HFC": KT_TO_MT, "PFC": KT_TO_MT, "SF6": KT_TO_MT}

# --- fixed values: anchors ----------------------------------------------------
GROSS_2020_ANCHOR = 35289.751  # Mt CO2
HARMONISE_YEAR = 2022
AMBITION_CUT = -0.89
AFOLU_CO2E_LINE = 217000.0
AFOLU_CO2_LINE = 40000.0
LAND_USE_LINE = 3600.0
LAND_USE_MISSING = -1000.0

# --- fixed values: target-tool domains ----------------------------------------
TARGET_METHODS = ("SDA", "ARA")
TARGET_SECTORS = ("power", "buildings_res", "buildings_serv", "cement")
TARGET_ACTIVITY_TYPES = ("fixed_market_share", "ty_output")

# --- fixed values: metric labels shown in the key-metric panels ---------------
PANEL_METRICS = (
    ("Final energy demand, 2050 (EJ)", "Final energy demand, 2050 (EJ)"),
    ("Share of primary energy from renewables, 2050 (%)",
     "Share of primary energy from renewables, 2050 (%)"),
    ("Maximum yearly primary energy from bioenergy, 2020-2050 (EJ)",
     "Max yearly primary energy from bioenergy, 2010-2050 (EJ)"),
    ("Total atmospheric CDR, 2050 (Gt CO2)", "CDR, 2050 (GtCO2)"),
    ("Cumulative CCS, 2010-2050 (Gt CO2)", "Total cumulative CCS, 2020-2050 (GtCO2)"),
    ("Gross fossil CO2, 2020-2050 (Gt CO2)", "Gross fossil CO2, 2020-2050 (Gt)"),
)
WIDE_PANEL_METRICS = (
    ("Final energy demand, 2050 (EJ)", "Final energy demand, 2050 (EJ)"),
    ("Share of primary energy from renewables, 2050 (%)", "Renewable energy share, 2050 (%)"),
    ("Maximum yearly primary energy from bioenergy, 2020-2050 (EJ)", "Max bioenergy, 2010-2050 (EJ)"),
    ("Total atmospheric CDR, 2050 (Gt CO2)", "CDR, 2050 (GtCO2)"),
    ("Cumulative CCS, 2010-2050 (Gt CO2)", "Total CCS, 2020-2050 (GtCO2)"),
)
PANEL_SOURCES = (
    ("IEA NZE", "NZE"),
    ("Median of filtered scenarios", "Filtered"),
    ("AR6 C1 (25th percentile)", "AR6 C1-25"),
    ("AR6 C1 (75th percentile)", "AR6 C1-75"),
)
# --- fixed values: categories, markers and row labels the reports select and write ----
TARGET_CATEGORY = "C1"
MARKERS = ("SP", "LD", "Ren")
FOCAL_MARKERS = ("LD", "Ren")
OLDER_CATEGORIES = ("1.5C low overshoot", "Below 1.5C")
OLDER_IN_RANGE = "in range"
OLDER_LABELS = {
    "25th perc": "IPCC SR15 (25th percentile)",
    "median": "IPCC SR15 (median)",
    "75th perc": "IPCC SR15 (75th percentile)",
}
OLDER_MEAN_LABEL = "IPCC SR15 (mean)"
EXTERNAL_CH4_LABEL = "IEA_NZE"
N2O_ENERGY_CO2E = "Emissions|N2O|Energy_CO2eq"
CH4_FOSSIL_CO2E = "Emissions|CH4|Fossil_CO2eq"
COHORT_LABEL = "AR6 C1"
LIST_A_LABEL = "AR6 C1+IISD"
LIST_B_LABEL = "OECD"
FILTERED_LABEL = "filtered C1"
BENCHMARK = "Cross sector benchmark"
GROSS_CO2 = "Gross fossil CO2"
GROSS_CO2E = "Gross fossil CO2e"
PATHWAY = "cross-sector pathway"
EXTERNAL_ID = "NZE 2023"
MEDIAN_OF_C1 = "median of C1"
MEDIAN_OF_FILTERED = "median of filtered scenarios"
REMOVED, NOT_REMOVED = "Removed by filter", "Not filtered"
PROJECT = "ENGAGE"
SUBSET = "C1a_NZGHGs"
FILTERED_MEDIAN = "Median of filtered scenarios"


@dataclass(frozen=True)
class Limits:
    """Screening limits; the defaults are fixed values in EJ or Mt."""

    bioenergy: float = 100.0
    afforestation: float = 3.6 * GT_TO_MT
    total_ccs: float = 214 * GT_TO_MT
    removals_2020: float = 2.3
    land_sector: float = -99.54 * GT_TO_MT
    beccs_high: float = 7 * GT_TO_MT
    beccs_medium: float = 3 * GT_TO_MT
    fossil_ccs_high: float = 8.8 * GT_TO_MT
    fossil_ccs_medium: float = 3.8 * GT_TO_MT
    land_use: float = 3.6 * GT_TO_MT


# fixed values: which criteria each screening flag combines
SCREEN_FLAGS = {
    0: (),
    1: ("bio",),
    2: ("afforestation",),
    3: ("ccs",),
    4: ("bio", "ccs"),
    5: ("bio", "afforestation", "ccs"),
    6: ("bio", "ccs", "land"),
    7: ("bio", "afforestation", "ccs", "land", "removals"),
}
