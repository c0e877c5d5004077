"""Fixed values of the engine."""

from __future__ import annotations

# Weights and score floors of the presets.
PRESETS = {
    "strict": {"name_vector": 0.6, "name_trigram": 0.25, "alias_match": 0.2, "dob_match": 0.05, "country_match": 0.05, "threshold": 0.75},
    "balanced": {"name_vector": 0.55, "name_trigram": 0.2, "alias_match": 0.35, "dob_match": 0.1, "country_match": 0.05, "threshold": 0.65},
    "lenient": {"name_vector": 0.5, "name_trigram": 0.15, "alias_match": 0.4, "dob_match": 0.1, "country_match": 0.1, "threshold": 0.55},
}
# Score floor, lexical floor and display floor of the strictness levels.
LEVELS = {
    "lenient": {"floor": 0.30, "min_lexical": 0.0, "display_floor": 0.0},
    "balanced": {"floor": 0.30, "min_lexical": 0.35, "display_floor": 0.40},
    "strict": {"floor": 0.40, "min_lexical": 0.50, "display_floor": 0.0},
}
# Titles that a canonical name leaves out.
TITLES = [
    "mr", "mrs", "miss", "ms", "dr", "prof", "professor", "sir", "dame", "lord", "lady", "hon", "honorable", "rev",
    "reverend", "fr", "father", "sr", "sister", "br", "brother",
]
# Month names of dates of birth.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
MIN_YEAR, MAX_YEAR = 1850, 2100

ALIAS_FULL, ALIAS_PARTIAL, ALIAS_FUZZY = 1.0, 0.5, 0.25
ALIAS_SORT_FLOOR, ALIAS_SET_FLOOR = 0.95, 0.6
STRONG_SIMILARITY, STRONG_TIER = 0.8, 0.8
DOB_MENTIONED = 0.5

DF_RATIO = 0.01
MAX_LEXICAL = 600
VECTOR_FACTOR = 2
DEFAULT_K = 20
EMBEDDING_DIM = 384
RISK_CATEGORIES = ["SANCTION", "PEP", "CUSTOM", "WHITELIST"]
