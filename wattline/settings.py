"""Locations, stations, grids, windows.  They must equal the published conventions, so they are plain text."""

from __future__ import annotations

from datetime import date

MARKET_TZ = "America/New_York"

# fixed values: pricing locations
INTERNAL_ZONES = ["WEST", "GENESE", "CENTRL", "NORTH", "MHK VL", "CAPITL", "HUD VL", "MILLWD", "DUNWOD", "N.Y.C.", "LONGIL"]
EXTERNAL_ZONES = ["H Q", "NPX", "O H", "PJM"]
LOCATIONS = INTERNAL_ZONES + EXTERNAL_ZONES
SYSTEM_ZONE = "SYSTEM"          # label of the operator-total row; pass the label your feed uses to the plans
ENERGY_ZONE = "CAPITL"          # the energy component is the same everywhere, so it is fitted on one zone

# fixed values: weather station code -> zones it represents
STATION_ZONES = [
    ("BUF", "WEST"), ("ROC", "GENESE"), ("SYR", "CENTRL"), ("MSS", "NORTH"), ("ART", "MHK VL"), ("ALB", "CAPITL"),
    ("POU", "HUD VL"), ("HPN", "MILLWD"), ("HPN", "DUNWOD"), ("LGA", "N.Y.C."), ("JFK", "N.Y.C."), ("ISP", "LONGIL"),
]

FUELS = ["Nuclear", "Hydro", "Dual Fuel", "Natural Gas", "Wind", "Other Renewables", "Other Fossil Fuels"]
RENEWABLE_FUELS = ["Wind", "Hydro", "Other Renewables"]
CARBON_FREE_FUELS = RENEWABLE_FUELS + ["Nuclear"]

MARKETS = ("da", "rt")
COMPONENTS = ("total", "energy", "loss", "congestion")
TARGETS = [f"{m}_{c}" for m in MARKETS for c in COMPONENTS]

QUANTILES = (0.01, *[i / 100 for i in range(5, 100, 5)], 0.99)
QCOLS = [f"q{round(100 * q):02d}" for q in QUANTILES]

ISSUE_HOUR = 5                  # local hour on the day before delivery at which the forecast is issued
NOMINAL_MINUTES = 5             # length assumed for an interval whose neighbour stamp is missing
MAX_GAP_MINUTES = 15            # a neighbour further away than this counts as missing
EMBARGO_DAYS = 7
BURN_IN_START = date(2021, 10, 1)
VALIDATION_START = date(2022, 10, 1)
VALIDATION_END = date(2025, 10, 1)
HOLDOUT_START = date(2025, 10, 1)
HOLDOUT_END = date(2026, 10, 1)
BASE_TEMP_C = 18.3
TRADE_COST = 0.50               # $ per cleared MWh

PRED_KEYS = ["delivery_date", "ts_utc", "zone", "hour_local", "market", "component"]
