"""Text and URL expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Starts of the names of query parameters that only track, in any case (fixed values).
TRACKING = ("utm_", "fbclid", "gclid", "mc_", "ref", "spm")

#: What a question's words tell of it (fixed values): it leads to another company's own filings; risks; figures; business.
BRIDGE_CUES = ("supplier", "suppliers", "customer", "customers", "vendor", "partner", "partners", "its own", "their own", "in its filings", "in their filings", "in its own", "in their own")
RISK_CUES = ("risk", "warn", "concern", "threat", "uncertain", "adverse", "litigation", "regulat", "exposure", "liabilit", "disrupt")
FINANCIAL_CUES = ("revenue", "margin", "profit", "earnings", "cash flow", "guidance", "capital", "debt", "cost", "expense", "gross", "operating income", "eps", "dividend")
BUSINESS_CUES = ("product", "segment", "customer", "supplier", "manufactur", "market", "strategy", "acquisition", "operation", "compet", "partner", "platform")

#: Phrases by which a text forecasts by itself, in any case (fixed values).
FORECASTS = (
    r"\b\d+(\.\d+)?\s*%?\s*(chance|probability|odds|likelihood)\b",
    r"\b(probability|chance|odds|likelihood)\s+(of|that)\b",
    r"\b(my|our|I\s+set|we\s+set)\s+(a\s+)?price\s+target\b",
    r"\b(expected|projected|forecast(ed)?|predicted)\s+(return|price|gain|loss)\b",
    r"\b\d+(\.\d+)?\s*%\s*(upside|downside)\s+(potential|target|from here)\b",
    r"\b(will|expected to|likely to)\s+\w+\s+(by\s+)?\d+(\.\d+)?\s*%",
)

#: Title words of four kinds of events, in any case (fixed values).
TITLE_EVENTS = {
    "has_earnings": r"\b(earnings?|eps|beat|miss(ed)?|revenue|quarter|guidance)\b",
    "has_regulatory": r"\b(sec|ftc|doj|antitrust|regulat|probe|investigation|fine|lawsuit)\b",
    "has_upgrade": r"\b(upgrade[sd]?|raised?|reiterat|outperform|overweight|buy)\b",
    "has_downgrade": r"\b(downgrade[sd]?|lowered?|underperform|underweight|sell|reduce)\b",
}


def clean(x: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " "))


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def canonical_url(u: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking or blank parameters, no closing slash."""
    u = F.regexp_replace(F.trim(u), "#.*$", "")
    scheme, rest = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    path = F.when(F.regexp_replace(path, "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p.rlike("=.") & ~p.rlike("(?i)^(" + "|".join(TRACKING) + ")"))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def slug(x: Column, longest: int = 60) -> Column:
    """Lower-case letters and digits with single hyphens between, at most ``longest`` characters."""
    s = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, longest), "-+$", "")


#: Closing words of company names (fixed values).
SUFFIXES = "inc|incorporated|corp|corporation|co|company|companies|ltd|limited|llc|lp|plc|ag|sa|nv|se|kk|gmbh|holdings|holding|group"


def core_name(x: Column) -> Column:
    """A company's name without closing legal words; never empty."""
    n = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    return F.regexp_replace(n, f"^(.+?)( ({SUFFIXES}))+$", "$1")


def thousands_stripped(x: Column) -> Column:
    """Digits without thousands commas; other commas stay."""
    return F.regexp_replace(x, r"(?<=\d),(?=\d{3}(?:\D|$))", "")
