"""The region dimension: ordered (code, full-match pattern, languages) and expressions over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    code: str
    pattern: str = "a^"  # never matches
    languages: tuple[str, ...] = ()


# The default region table, in its order (code, pattern of a name's token, languages).
DEFAULT = (
    Region("ASI", "(?i)Asia", ("zh",)),
    Region("ARG", "(?i)Argentina", ("es",)),
    Region("AUS", "(?i)Australia", ("en",)),
    Region("BRA", "(?i)Brazil", ("pt",)),
    Region("CAN", "(?i)Canada", ("en", "fr")),
    Region("CHN", "(?i)China", ("zh",)),
    Region("DAN", "(?i)Denmark", ("da",)),
    Region("EUR", "(?i)(?:Europe)|(?:World)", ("en",)),
    Region("FRA", "(?i)France", ("fr",)),
    Region("FYN", "(?i)Finland", ("fi",)),
    Region("GER", "(?i)Germany", ("de",)),
    Region("GRE", "(?i)Greece", ("el",)),
    Region("HK", "(?i)Hong Kong", ("zh",)),
    Region("HOL", "(?i)Netherlands", ("nl",)),
    Region("HUN", "(?i)Hungary", ("hu",)),
    Region("ITA", "(?i)Italy", ("it",)),
    Region("JPN", "(?i)(?:Japan)|(?:World)", ("ja",)),
    Region("KOR", "(?i)Korea", ("ko",)),
    Region("MEX", "(?i)Mexico", ("es",)),
    Region("NOR", "(?i)Norway", ("no",)),
    Region("NZ", "(?i)New Zealand", ("en",)),
    Region("POL", "(?i)Poland", ("pl",)),
    Region("POR", "(?i)Portugal", ("pt",)),
    Region("RUS", "(?i)Russia", ("ru",)),
    Region("SPA", "(?i)Spain", ("es",)),
    Region("SWE", "(?i)Sweden", ("sv",)),
    Region("TAI", "(?i)Taiwan", ("zh",)),
    Region("UK", "(?i)United Kingdom", ("en",)),
    Region("UKN", "(?i)Unknown", ("en",)),
    Region("USA", "(?i)(?:USA)|(?:World)", ("en",)),
)


def no_strings() -> Column:
    return F.array().cast("array<string>")


def full(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def codes_of(token: Column, table: tuple[Region, ...]) -> Column:
    """Codes whose patterns match the whole token, in table order. Patterns are literals, so each is compiled once."""
    if not table:
        return no_strings()
    return F.array_compact(F.array(*(F.when(token.rlike(full(r.pattern)), F.lit(r.code)) for r in table)))


def languages_of(codes: Column, table: tuple[Region, ...]) -> Column:
    """Languages of all codes, concatenated; unknown codes have none."""
    known = [(r.code, F.array(*map(F.lit, r.languages))) for r in table if r.languages]
    if not known:
        return no_strings()
    by_code = F.create_map(*(x for code, langs in known for x in (F.lit(code), langs)))
    return F.flatten(F.transform(codes, lambda c: F.coalesce(F.try_element_at(by_code, c), no_strings())))
