"""Values fixed by the screening contract. Results depend on them, so they are stated here, once and plainly."""

from __future__ import annotations

# --- fixed values: scoring -------------------------------------------------------------------------------------
MATCH_THRESHOLD = 0.82
DIFFERENT_DOB_CAP = 0.75
SAME_DOB_BOOST = 0.03
SCORE_DIGITS = 4
LOOKUP_PAGE = 50

# --- fixed values: lists, in the order they are queried ------------------------------------------------------------
PROVIDER_OF_LIST = {
    "sanctions": "world_check",
    "pep": "dow_jones",
    "adverse_media": "comply_advantage",
}
LIST_ORDER = list(PROVIDER_OF_LIST)

# --- fixed values: decisions -------------------------------------------------------------------------------------
SEVERITY = {"CLEAR": 1, "FLAG": 2, "ESCALATE": 3}
NO_MATCH_CODE = "NO_MATCH"
# (code, list_type, outcome, minimum score, tiers or None)
RULES = [
    ("SANCTIONS_MATCH", "sanctions", "ESCALATE", MATCH_THRESHOLD, None),
    ("PEP_TIER_1_2", "pep", "ESCALATE", MATCH_THRESHOLD, [1, 2]),
    ("PEP_TIER_3_4", "pep", "FLAG", MATCH_THRESHOLD, [3, 4]),
    ("ADVERSE_MEDIA", "adverse_media", "FLAG", MATCH_THRESHOLD, None),
]

# --- fixed values: domains of stored columns ---------------------------------------------------------------------
SOURCES = ["rest", "kafka"]
SCREENING_STATUSES = ["completed", "failed"]
LIST_CHANGES = ["add", "remove", "version_bump"]
PIPELINE_STAGES = ["ingest", "normalize", "screen", "decide"]
ERROR_MESSAGE_CHARS = 1000
BREACH_SAMPLE = 25
MIN_PRECISION = 0.95
MIN_RECALL = 0.90
MEDIA_CONFIDENCE_RANGE = (0.3, 0.99)

# --- fixed values: ISO code by country name (lower case, romanised) -----------------------------------------------
COUNTRY_BY_NAME = {
    "russia": "RU",
    "russian federation": "RU",
    "cyprus": "CY",
    "ukraine": "UA",
    "united kingdom": "GB",
    "great britain": "GB",
    "england": "GB",
    "united states": "US",
    "united states of america": "US",
    "usa": "US",
    "germany": "DE",
    "deutschland": "DE",
    "france": "FR",
    "spain": "ES",
    "italy": "IT",
    "netherlands": "NL",
    "switzerland": "CH",
    "china": "CN",
    "iran": "IR",
    "islamic republic of iran": "IR",
    "syria": "SY",
    "syrian arab republic": "SY",
    "north korea": "KP",
    "south korea": "KR",
    "korea": "KR",
    "belarus": "BY",
    "kazakhstan": "KZ",
    "turkey": "TR",
    "turkiye": "TR",
    "poland": "PL",
    "portugal": "PT",
    "greece": "GR",
    "austria": "AT",
    "belgium": "BE",
    "sweden": "SE",
    "norway": "NO",
    "finland": "FI",
    "denmark": "DK",
    "ireland": "IE",
    "india": "IN",
    "japan": "JP",
    "brazil": "BR",
    "canada": "CA",
    "australia": "AU",
    "mexico": "MX",
    "egypt": "EG",
    "saudi arabia": "SA",
    "united arab emirates": "AE",
    "uae": "AE",
    "israel": "IL",
    "south africa": "ZA",
    "nigeria": "NG",
    "argentina": "AR",
    "venezuela": "VE",
    "georgia": "GE",
    "armenia": "AM",
    "azerbaijan": "AZ",
    "moldova": "MD",
    "estonia": "EE",
    "latvia": "LV",
    "lithuania": "LT",
    "malta": "MT",
    "luxembourg": "LU",
    "romania": "RO",
    "bulgaria": "BG",
    "hungary": "HU",
    "czechia": "CZ",
    "czech republic": "CZ",
    "slovakia": "SK",
    "slovenia": "SI",
    "croatia": "HR",
    "serbia": "RS",
    "indonesia": "ID",
    "zimbabwe": "ZW",
}
COUNTRY_CODES = sorted(set(COUNTRY_BY_NAME.values()))
