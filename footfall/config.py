"""Settings shared by every model, with the shipped defaults."""

from __future__ import annotations

from dataclasses import dataclass

#: Timeline slices in one slice of a value carried in time.
CARRY = 8


@dataclass(frozen=True)
class Rule:
    """Fill-in for a source without campaign tags.

    ``condition``, ``source`` and ``medium`` are Spark SQL expressions over the
    columns of a source candidate (``clid``, ``utm``, ``referrer``,
    ``referring_domain``, ``is_ext_referrer``, ``landing_page``, ...).
    """

    condition: str
    source: str = "'(not set)'"
    medium: str = "'(not set)'"


@dataclass(frozen=True)
class Metric:
    """A conditional count per session; ``once`` caps it at 0/1."""

    name: str
    condition: str
    once: bool = False


# --- Fixed values -----------------------------------------------------------
# These must equal the reference's for equal results.
INTERNAL_REFERRERS = r"paddle\.com|stripe\.com|accounts\.google\."
BOT_PATTERN = "[Bb]ot|[sS]ite|measure|Adwords|censys|jsdom|python|http|[Tt]ask|[Tt]est|[Hh]eadless|[Ss]pider"
CLICK_ID_PARAMETERS = ("gclid", "fbclid", "wbraid", "gbraid", "tblci", "li_fat_id")
PAGE_CLEANUP = r"(https?://[^/?#]+|#tblci[^&#]+$)"
REQUEST_PAGEVIEW_PATTERN = r"(?:https?://[^/]+$|/$|\.html$|/[^/\.]+$)"
LEGACY_ID_CUTOFF = "2023-10-08"

UTM_RULES = (
    Rule("clid.parameter IN ('gclid', 'wbraid', 'gbraid')", "'google'", "'cpc'"),
    Rule("clid.parameter = 'fbclid'", "'facebook'"),
    Rule(r"referring_domain RLIKE r'^(www\.)?google\.\w+'", "'google'", "'organic'"),
    # The source is the quoted word, as shipped; see Config.referral_from_domain.
    Rule("is_ext_referrer", "'referring_domain'", "'referral'"),
)

SESSION_METRICS = (
    Metric(
        "logged_in",
        "event_name = 'pageview' AND url LIKE '%app.ga3-exporter%'"
        " AND url NOT LIKE '%login%' AND url NOT LIKE '%register%'",
        once=True,
    ),
    # AND binds tighter than OR: only the first LIKE is tied to pageviews.
    Metric(
        "activated",
        "event_name = 'pageview' AND url LIKE '%pricing%'"
        " OR url LIKE '%login%' OR url LIKE '%register%'",
        once=True,
    ),
)
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    internal_referrers: str = INTERNAL_REFERRERS
    bot_pattern: str = BOT_PATTERN
    click_ids: tuple[str, ...] = CLICK_ID_PARAMETERS
    page_cleanup: str = PAGE_CLEANUP
    request_pageviews: bool = True
    request_pageview_pattern: str = REQUEST_PAGEVIEW_PATTERN
    utm_rules: tuple[Rule, ...] = UTM_RULES
    session_metrics: tuple[Metric, ...] = SESSION_METRICS
    referral_from_domain: bool = False

    # A pause longer than this many whole milliseconds ends a block.
    gap_ms: int = 30 * 60 * 1000
    # Events before this instant take the block's repaired id; None: no such era.
    legacy_id_cutoff: str | None = LEGACY_ID_CUTOFF
    # How far back a session may borrow an external source.
    client_lookback_days: int = 30
    hash_lookback_hours: int = 24

    # Physical layout; none of these changes a result.
    bin_seconds: int = 1800  # visitor timeline slice; must not exceed the gap
    session_bin_seconds: int = 3600  # client timeline slice for session scans

    def __post_init__(self) -> None:
        if self.bin_seconds * 1000 > self.gap_ms:
            raise ValueError("bin_seconds must not exceed the inactivity gap")
        if min(self.bin_seconds, self.session_bin_seconds) < 1:
            raise ValueError("layout settings must be positive")

    @property
    def carry_seconds(self) -> int:
        """The slice in which events meet their facts and sources: most blocks lie in one."""
        return CARRY * self.bin_seconds

    @property
    def lookback_seconds(self) -> int:
        """The slice in which sessions meet their donors."""
        return CARRY * self.session_bin_seconds

    @property
    def click_id_pattern(self) -> str:
        return "|".join(self.click_ids)

    @property
    def rules(self) -> tuple[Rule, ...]:
        if not self.referral_from_domain:
            return self.utm_rules
        return tuple(
            Rule(r.condition, "referring_domain", r.medium)
            if r.source == "'referring_domain'"
            else r
            for r in self.utm_rules
        )


DEFAULT = Config()
