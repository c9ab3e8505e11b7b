"""The eight parameter sets of the one matching engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from types import MappingProxyType

# Score weights, thresholds and penalties the results depend on.
CONTAINMENT_WEIGHTS = {"exact": 0.35, "substring": 0.30, "list_item": 0.20, "token": 0.10, "char": 0.05}
UNIFIED_WEIGHTS = {
    "exact": 0.25,
    "substring": 0.25,
    "list_item": 0.20,
    "token_containment": 0.10,
    "char3_containment": 0.05,
    "rf_partial": 0.10,
    "rf_ratio": 0.03,
    "levenshtein": 0.01,
    "tfidf": 0.01,
}
ROWWISE_WEIGHTS = {
    "exact": 0.3,
    "substring": 0.3,
    "list_item": 0.2,
    "rf_partial": 0.1,
    "rf_ratio": 0.05,
    "tfidf": 0.05,
}
BLEND_WEIGHTS = {"partial": 0.25, "ratio": 0.25, "levenshtein": 0.20, "tfidf": 0.30}
TAG_THRESHOLDS = {"direct": 0.70, "list": 0.70, "listlike": 0.70, "similarity": 0.45, "none": 1.00}
CONTAINER_PENALTY = {"single": 1.00, "wrapped_list": 0.94, "delimited_list": 0.90, "empty": 0.00}
TAGS = ("direct", "list", "listlike", "similarity")


@dataclass(frozen=True)
class Profile:
    name: str
    #: ``containment``, ``unified``, ``rowwise``, ``hybrid``, ``guarded`` or ``tagged``.
    scorer: str
    merge_duplicates: bool = False
    #: Documents the gram weights are fitted on: every merged cell of both tables
    #: (``all_cells``), every filled cell on common ids (``common_cells``), or the
    #: distinct values on common ids without or with the id itself.
    corpus: str | None = None
    split: str | None = None
    fuzzy_backend: str = "indel"
    weights: Mapping[str, float] = MappingProxyType(BLEND_WEIGHTS)
    # Long-text guard.
    long_chars: int = 95
    long_words: int = 15
    short_chars: int = 35
    short_words: int = 4
    min_precision: float = 0.40
    min_partial: float = 0.90
    min_tfidf: float = 0.45
    #: Score of an element pair that is equal after normalising; ``None`` adds a boost instead.
    equal_score: float | None = None
    substring_score: float = 0.95
    score_cap: float = 1.0
    # Fast paths of the tagged scorer.
    direct_score: float = 0.99
    list_score: float = 0.94
    listlike_score: float = 0.90
    container_penalty: Mapping[str, float] = MappingProxyType(CONTAINER_PENALTY)
    # Hit rule: one threshold, or one per tag.
    min_ratio: float = 0.70
    tag_thresholds: Mapping[str, float] | None = None
    high_ratio: float = 0.85
    high_score: float = 0.95
    #: ``mean`` over all cells, ``hits`` or hit-``weighted``.
    statistics: str = "mean"
    tag_counts: bool = False
    min_support: int = 0
    coverage_over: str | None = None
    one_to_one: bool = False
    audit_hits_only: bool = False
    audit_needs_common_ids: bool = False
    zero_sample_is_empty: bool = False

    def replace(self, **changes) -> Profile:
        return replace(self, **changes)

    def threshold(self, tag: str) -> float:
        if self.tag_thresholds is None:
            return self.min_ratio
        return self.tag_thresholds.get(tag, self.min_ratio)

    @property
    def best_equal(self) -> float | None:
        """Score of a cell pair that shares an equal element, if nothing can beat it.

        With an added boost an equal pair is the three edit weights plus at least
        0.40, or plus 0.20 for a long text, whose cosine is then 1.  The default
        weights bring both to the cap; tuned ones may not (``None``: score it).
        """
        if self.equal_score is not None:
            return self.equal_score if self.equal_score >= self.score_cap else None
        w = self.weights
        edit = w["partial"] + w["ratio"] + w["levenshtein"]
        lowest = min(edit + min(w["tfidf"], 0.0) + 0.40, edit + w["tfidf"] + 0.20)
        return self.score_cap if lowest >= self.score_cap and self.min_precision <= 1 else None

    @property
    def prune_floor(self) -> float | None:
        """Element score below which a similarity can be no hit; ``None`` rules pruning out."""
        floor = self.threshold("similarity")
        if not self.counts_hits or floor <= 0 or min(self.weights.values()) < 0:
            return None
        scale = max(self.container_penalty.values()) if self.scorer == "tagged" else 1.0
        return floor / max(scale, 1.0)

    @property
    def counts_hits(self) -> bool:
        return self.statistics in ("hits", "weighted")


_WHOLE_TABLE = dict(min_support=10, one_to_one=True, audit_needs_common_ids=True, zero_sample_is_empty=True)
_GUARD_80 = dict(long_chars=80, short_chars=24, min_tfidf=0.50)

PROFILES: dict[str, Profile] = {
    p.name: p
    for p in (
        Profile(
            "containment",
            "containment",
            split="dedup",
            weights=MappingProxyType(CONTAINMENT_WEIGHTS),
            coverage_over="sampled",
            **_WHOLE_TABLE,
        ),
        Profile(
            "unified",
            "unified",
            split="dedup_strict",
            corpus="common_distinct_with_id",
            weights=MappingProxyType(UNIFIED_WEIGHTS),
            coverage_over="aligned",
            **_WHOLE_TABLE,
        ),
        Profile(
            "rowwise",
            "rowwise",
            split="delim",
            corpus="common_distinct",
            weights=MappingProxyType(ROWWISE_WEIGHTS),
        ),
        Profile(
            "hybrid", "hybrid", split="delim", corpus="common_cells", statistics="hits", equal_score=1.0
        ),
        Profile(
            "longguard",
            "guarded",
            split="delim",
            corpus="all_cells",
            merge_duplicates=True,
            statistics="hits",
            equal_score=1.0,
            **_GUARD_80,
        ),
        Profile(
            "weighted",
            "guarded",
            split="delim",
            corpus="all_cells",
            merge_duplicates=True,
            statistics="weighted",
            score_cap=0.999,
            **_GUARD_80,
        ),
        Profile(
            "fastpath",
            "tagged",
            split="wrapped",
            corpus="all_cells",
            merge_duplicates=True,
            statistics="weighted",
            tag_counts=True,
            score_cap=0.999,
            audit_hits_only=True,
        ),
        Profile(
            "tagged",
            "tagged",
            split="wrapped",
            corpus="all_cells",
            merge_duplicates=True,
            statistics="weighted",
            tag_counts=True,
            score_cap=0.999,
            tag_thresholds=MappingProxyType(TAG_THRESHOLDS),
        ),
    )
}


def get_profile(profile: str | Profile, **changes) -> Profile:
    if isinstance(profile, str):
        if profile not in PROFILES:
            raise ValueError(f"unknown profile {profile!r}; one of {sorted(PROFILES)}")
        profile = PROFILES[profile]
    return profile.replace(**changes) if changes else profile
