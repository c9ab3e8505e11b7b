"""Instance-based column matching on Spark."""

from .plans.matching import MatchResult, audit_cells, mapped_pairs, match_columns
from .plans.profiles import PROFILES, Profile, get_profile

__all__ = ["PROFILES", "MatchResult", "Profile", "audit_cells", "get_profile", "mapped_pairs", "match_columns"]
