"""Record layouts, the closed taxonomy, limits and stable codes."""

from __future__ import annotations

from dataclasses import asdict, dataclass

CLEAN = "ad_id string, headline string, description string, category string, advertiser_id string, bid_cpm_usd double, created_at string"
CLEAN_COLUMNS = tuple(c.split()[0] for c in CLEAN.split(", "))
REQUIRED = tuple(c for c in CLEAN_COLUMNS if c != "description")
#: Text fields in the order in which a wrong type is looked for; the bid is read by its own rules.
TEXT_FIELDS = ("ad_id", "headline", "category", "advertiser_id", "created_at", "description")
# The taxonomy of records.
CATEGORIES = frozenset("apparel beauty education electronics finance fitness food_delivery footwear gaming home_kitchen pet_supplies travel".split())

FATAL = {
    "E001": "line is not JSON", "E002": "field missing or null", "E003": "wrong type", "E004": "no text left after cleaning", "E005": "headline too short", "E006": "text too long",
    "E007": "bid is no number", "E008": "bid out of range", "E009": "category outside the taxonomy", "E010": "id taken by an earlier record", "E011": "content of an earlier record", "E012": "timestamp unreadable",
}
WARNINGS = {"W001": "white space", "W002": "markup", "W003": "Unicode form", "W004": "control characters", "W005": "bid from text", "W006": "no description", "W007": "timestamp rewritten"}


@dataclass(frozen=True)
class Limits:
    """Bounds of the rules; both lengths and the bid's ceiling are inclusive, the bid's floor is not."""

    headline_min: int = 10
    headline_max: int = 120
    description_max: int = 1000
    bid_floor: float = 0.0
    bid_max: float = 50.0
    examples: int = 5
    excerpt: int = 200
    categories: frozenset[str] = CATEGORIES

    def config(self) -> dict:
        return asdict(self) | {"categories": sorted(self.categories)}
