"""Word lists and rule tables. They are data: operators take them as arguments."""

from briefloom.lexicons.model import (
    Brand,
    Category,
    Competitor,
    Country,
    LabelRule,
    Lexicon,
    RuleSet,
    Signal,
    Term,
)
from briefloom.lexicons.vehicle_care import VEHICLE_CARE_LEXICON, VEHICLE_CARE_RULES, vehicle_care_rules

__all__ = [
    "Brand", "Category", "Competitor", "Country", "LabelRule", "Lexicon", "RuleSet", "Signal", "Term",
    "VEHICLE_CARE_LEXICON", "VEHICLE_CARE_RULES", "vehicle_care_rules",
]
