"""Column expressions over item names: sections, numbers, trimming, ordering."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The naming convention's patterns (java.util.regex syntax, found anywhere in a name).
SECTIONS = r"\(([^()]+)\)"
LANGUAGES = r"(?i)\(([a-z]{2}(?:[,+][a-z]{2})*)\)"
PROTO = r"(?i)\(Proto(?:\s*([a-z0-9.]+))?\)"
BETA = r"(?i)\(Beta(?:\s*([a-z0-9.]+))?\)"
DEMO = r"(?i)\(Demo(?:\s*([a-z0-9.]+))?\)"
SAMPLE = r"(?i)\(Sample(?:\s*([a-z0-9.]+))?\)"
REVISION = r"(?i)\(Rev\s*([a-z0-9.]+)\)"
VERSION = r"(?i)\(v\s*([a-z0-9.]+)(?:,\s*v\s*([a-z0-9.]+))?\)"
BIOS = r"(?i)\Q[BIOS]\E"
BAD = r"(?i)\Q[b]\E"
BUILT_IN = {
    "bad": BAD,
    "program": r"(?i)\((?:Test\s*)?Program\)",
    "chip": r"(?i)\(Enhancement\s*Chip\)",
    "unlicensed": r"(?i)\Q(Unl)\E",
    "pirate": r"(?i)\Q(Pirate)\E",
    "promo": r"(?i)\Q(Promo)\E",
    "dlc": r"(?i)\Q(DLC)\E",
    "update": r"(?i)\Q(Update)\E",
}
#: Hexadecimal components of up to 63 bits; longer ones take the folding branch.
HEXADECIMAL = r"^-?0*([0-7][a-fA-F0-9]{15}|[a-fA-F0-9]{1,15})$"


def quote(literal: str) -> str:
    """A pattern that matches the literal, case-sensitively."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def trimmed(col: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def sections(name: Column) -> Column:
    """Contents of all innermost parenthesised sections, in order."""
    return F.regexp_extract_all(name, F.lit(SECTIONS), F.lit(1))


def section_tokens(name: Column) -> Column:
    return F.transform(F.flatten(F.transform(sections(name), lambda s: F.split(s, ","))), trimmed)


def _number(part: Column) -> Column:
    folded = F.aggregate(
        F.transform(F.filter(F.split(F.lower(part), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")),
        F.lit(0).cast("long"), lambda acc, c: F.coalesce(F.try_add(F.try_multiply(acc, F.lit(16).cast("long")), c), acc),
    )
    hexadecimal = F.conv(F.regexp_replace(part, "^-?0*(?=.)", ""), 16, 10).cast("long")
    return F.when(part.rlike(HEXADECIMAL), F.when(part.startswith("-"), -hexadecimal).otherwise(hexadecimal)).otherwise(folded)


def _numbers(group: Column) -> Column:
    """Components of a dotted group; trailing empty ones are dropped, an empty group is one zero."""
    core = F.regexp_replace(group, r"\.+$", "")
    none = F.array().cast("array<bigint>")
    return F.when((core == "") & (group != ""), none).otherwise(F.transform(F.split(core, "[.]"), _number))


def parse_numbers(name: Column, pattern: str, groups: int = 1) -> Column:
    """Numbers of the first match of pattern: hexadecimal components, letters folded by 16; [] without a match. A first
    group that took no part counts as empty, so gives [0]; later groups only count if they took part."""
    out = _numbers(F.regexp_extract(name, pattern, 1))
    for g in range(2, groups + 1):
        more = F.regexp_extract(name, pattern, g)
        out = F.concat(out, F.when(more != "", _numbers(more)).otherwise(F.array().cast("array<bigint>")))
    return F.when(name.rlike(pattern), out).otherwise(F.array().cast("array<bigint>"))


def any_match(name: Column, patterns: list[str]) -> Column:
    """Whether some pattern is found in the name; patterns stay apart, so their inline flags do not leak."""
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(p)
    return out


def count_matches(name: Column, patterns: list[str]) -> Column:
    if len(patterns) > 32:  # a flat expression; a chain of sums would be too deep
        return F.aggregate(F.array(*(name.rlike(p).cast("int") for p in patterns)), F.lit(0), lambda n, x: n + x)
    out = F.lit(0)
    for p in patterns:
        out = out + name.rlike(p).cast("int")
    return out


SPECIAL = "[{(#"
#: Code points whose collation elements are asked from the JVM: Latin letters, marks and punctuation. What the collator's rules
#: leave out, as other scripts, comes after them by code point.
COLLATED = (*range(0x01, 0x370), *range(0x1E00, 0x2070), *range(0x20A0, 0x20C0))
#: Letters whose pairs are tried for being one element together, as in some languages.
PAIRED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The first weight of characters that the collator's rules leave out.
OUTSIDE = "8000"
#: Where expansions are put between two steps: a private area.
PRIVATE = 0xF0000


class Collation:
    """A locale's collation elements at secondary strength, as tables for `translate`: every weight is the character of its rank, so
    that the order of keys is that of strings. Characters and pairs of several elements (`several`) are put in their place first."""

    def __init__(self, locale: str | None):
        jvm = SparkSession.getActiveSession()._jvm
        collator = jvm.java.text.Collator.getInstance(*([jvm.java.util.Locale.forLanguageTag(locale)] if locale else []))
        collator.setStrength(1)  # SECONDARY

        def elements(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
            key = bytes(collator.getCollationKey(text).toByteArray())
            units = [key[i : i + 2].hex() for i in range(0, len(key), 2)]
            cut = units.index("0000")
            return tuple(units[:cut]), tuple(u for u in units[cut + 1 :] if u != "0000")

        of = {chr(c): e for c in COLLATED if (e := elements(chr(c)))[0][:1] != (OUTSIDE,)}
        pairs = {a + b: e for a in PAIRED for b in PAIRED if (e := elements(a + b)) != tuple(x + y for x, y in zip(of[a], of[b]))} if locale else {}
        self.tables, self.expansions = [], []
        simple = "".join(c for c, e in of.items() if max(map(len, e)) <= 1)
        for k in (0, 1):
            every = sorted({u for e in (*of.values(), *pairs.values()) for u in e[k]} | ({"0001"} if k else set()))
            rank = {u: chr(1 + i) for i, u in enumerate(every)}  # below all characters without elements
            if 1 + len(every) > min([0x370, *(x for x in COLLATED if chr(x) not in of)]):
                raise ValueError(f"the collation of {locale} has {len(every)} weights")
            known = [c for c in simple if of[c][k]]
            private = [chr(PRIVATE + i) for i in range(len(every))]
            gone = "".join(c for c in simple if not of[c][k])
            self.tables.append(("".join([*known, *private, gone]), "".join([*(rank[of[c][k][0]] for c in known), *(rank[u] for u in every)])))
            at = {u: private[i] for i, u in enumerate(every)}
            self.expansions.append({t: "".join(at[u] for u in e[k]) for t, e in (*of.items(), *pairs.items()) if t not in simple})
        self.plain = at["0001"]  # the secondary weight of characters without elements
        self.simple, self.pairs = simple, sorted(pairs)


@lru_cache(None)
def _collation(session: str, locale: str | None) -> Collation:
    return Collation(locale)


def name_order(name: Column, locale: str | None = None) -> list[Column]:
    """Sort keys for names: those that start with one of [ { ( # first, by that character only; then the order of the JVM's
    collator for a locale (a language tag; by default the JVM's own) at secondary strength: spaces, hyphens and accents break
    ties, case never does. Names of plain Latin characters take two table look-ups a character; only others are cut into
    elements first."""
    c = _collation(SparkSession.getActiveSession().sparkContext.applicationId, locale)
    first = F.substring(name, 1, 1)
    special = F.coalesce(first.isin(*SPECIAL), F.lit(False))
    odd = F.translate(name, c.simple, "") != ""
    if c.pairs:
        odd = odd | name.rlike("|".join(c.pairs))
    tokens = F.regexp_extract_all(name, F.lit("(?s)" + "|".join([*c.pairs, "."])), F.lit(0))

    def key(k: int) -> Column:
        table = F.from_json(F.lit(json.dumps(c.expansions[k])), "map<string,string>")
        other = lambda t: F.when(F.translate(t, c.simple, "") != "", F.lit(c.plain)).otherwise(t) if k else t
        whole = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(table, t), other(t))), "")
        return F.translate(F.when(odd, whole).otherwise(name), *c.tables[k])

    return [F.when(special, 0).otherwise(1), F.when(special, first).otherwise(""), F.when(special, "").otherwise(key(0)), F.when(special, "").otherwise(key(1))]
