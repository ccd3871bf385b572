"""Place names: normal forms, facility kinds, cores, qualifiers and similarity."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .scalars import squeeze

#: Facility vocabularies, suffixes, opposing qualifiers and score weights (fixed values).
TREATMENT = ("SEWAGE TREATMENT WORKS", "WASTEWATER TREATMENT WORKS", "WASTE WATER TREATMENT WORKS", "WATER RECYCLING CENTRE", "WATER RECYCLING CENTER", "WATER RECYCLING CTR", "WATER POLLUTION CONTROL WORKS", "SEWAGE WORKS", "TREATMENT WORKS", "TREATMENT PLANT", "WWTW", "WWTP", "STW", "STP", "WRC", "WPC")
OVERFLOW = ("COMBINED SEWER OVERFLOW", "EMERGENCY OVERFLOW", "STORM OVERFLOW", "STORM TANK", "STORM DISCHARGE", "STORM SEWAGE", "FINAL EFFLUENT", "FINAL DISCHARGE", "OUTFALL", "OUTLET", "SSO", "CSO", "CEO", "EMO", "EO", "SO", "F E")
PUMPING = ("TERMINAL PUMPING STATION", "PUMPING STATION", "TPS", "SPS", "PS", "SP")
SUFFIXES = ("STORM",)
OPPOSING = (("NORTH", "SOUTH"), ("EAST", "WEST"), ("UPPER", "LOWER"), ("NEW", "OLD"), ("LITTLE", "GREAT"))
COMPATIBLE = ("TREATMENT WORKS", "STORM OVERFLOW", "STORM TANK", "OUTFALL", "OUTLET", "FINAL EFFLUENT", "EMERGENCY OVERFLOW", "PUMPING STATION")
WEIGHT_LEVENSHTEIN, WEIGHT_TOKEN_SET, WEIGHT_WEIGHTED = 0.40, 0.35, 0.25


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def full_name(c: Column, ascii_only: bool = False) -> Column:
    """NFKC, capitals, every run of other characters than letters A-Z and digits a space. ascii_only: the input is known to need no NFKC, and all stays in the JVM."""
    text = squeeze(c)
    if not ascii_only:
        text = F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(text)).otherwise(text)
    return F.trim(F.regexp_replace(F.upper(text), "[^0-9A-Z]+", " "))


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """Alternatives from the longest (in words) on, bounded by word ends."""
    ordered = sorted(set(phrases), key=lambda p: (-len(p.split()), p))
    return "(?<![0-9A-Z])(?:" + "|".join(ordered) + ")(?![0-9A-Z])"


def without_phrases(full: Column, phrases: tuple[str, ...]) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(full, phrase_pattern(phrases), ""), " +", " "))


def has_phrase(full: Column, *phrases: str) -> Column:
    return F.coalesce(full.rlike(phrase_pattern(phrases)), F.lit(False))


def facility_kind(full: Column) -> Column:
    """The kind of facility that a normal name speaks of, by priority; '' if none."""
    return (
        F.when(has_phrase(full, "EMERGENCY OVERFLOW", "EMO", "EO"), "EMERGENCY OVERFLOW")
        .when(has_phrase(full, "FINAL EFFLUENT", "F E", "FINAL DISCHARGE"), "FINAL EFFLUENT")
        .when(has_phrase(full, "STORM TANK"), "STORM TANK")
        .when(has_phrase(full, "OUTFALL"), "OUTFALL")
        .when(has_phrase(full, "OUTLET"), "OUTLET")
        .when(has_phrase(full, *OVERFLOW), "STORM OVERFLOW")
        .when(has_phrase(full, *PUMPING), "PUMPING STATION")
        .when(has_phrase(full, *TREATMENT), "TREATMENT WORKS")
        .otherwise("")
    )


def place_core(full: Column) -> Column:
    """The name without facility words and trailing suffix words."""
    core = without_phrases(full, TREATMENT + OVERFLOW + PUMPING)
    return F.trim(F.regexp_replace(core, f"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", ""))


def tokens(core: Column) -> Column:
    return F.array_distinct(F.filter(F.split(core, " "), lambda t: t != ""))


def qualifier_conflict(left: Column, right: Column) -> Column:
    """Whether opposing qualifiers or numbers of two cores differ."""
    a, b = tokens(left), tokens(right)

    def differ(x: Column, y: Column) -> Column:
        return (F.size(x) > 0) & (F.size(y) > 0) & (F.array_sort(x) != F.array_sort(y))

    out = differ(*(F.filter(t, lambda v: v.rlike("^(?:(?:NO|NUMBER)?[0-9]+[A-Z]?|[IVX]+)$")) for t in (a, b)))
    for group in OPPOSING:
        words = F.array(*map(F.lit, group))
        out = out | differ(F.array_intersect(a, words), F.array_intersect(b, words))
    return out


def subset_match(left: Column, right: Column) -> Column:
    """Whether one core's words are among the other's, with a distinctive word of four letters, and no qualifier differs."""
    a, b = tokens(left), tokens(right)
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    distinctive = F.exists(short, lambda t: (F.length(t) >= 4) & t.rlike("^[A-Z]+$"))
    return (left != "") & (right != "") & (left != right) & ~qualifier_conflict(left, right) & (F.size(F.array_except(short, long)) == 0) & distinctive


def levenshtein_similarity(left: Column, right: Column) -> Column:
    most = F.greatest(F.length(left), F.length(right))
    return F.when((left != "") & (right != ""), 100.0 * (1.0 - F.levenshtein(left, right) / most)).otherwise(0.0)


def token_overlap(left: Column, right: Column) -> Column:
    a, b = tokens(left), tokens(right)
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, 100.0 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


@lru_cache(4096)
def _places(a: str) -> dict[str, int]:
    """The places of each character, as bits."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    return places


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence."""
    # bit-parallel: after each character of b the zero bits count the subsequence so far
    get = _places(a).get
    full = (1 << len(a)) - 1
    bits = full
    for y in b:
        if at := get(y):
            hit = bits & at
            bits = ((bits + hit) | (bits - hit)) & full
    return len(a) - bits.bit_count()


def _indel(a: str, b: str) -> float:
    """200 * the longest common subsequence over the summed lengths."""
    if not a and not b:
        return 100.0
    return 200.0 * _common(a, b) / (len(a) + len(b))


def token_set_score(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with either side's rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if shared and (not left or not right):
        return 100.0
    base, one, two = " ".join(shared), " ".join(shared + left), " ".join(shared + right)
    best = _indel(one, two)
    return max(best, _indel(base, one), _indel(base, two)) if shared else best


@lru_cache(1 << 16)
def _partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    # a window has no more in common than the characters that both hold, counted as it moves on
    left = Counter(short)
    shared, bounds = 0, []
    for k in range(1 - n, len(long)):
        if k + n <= len(long):
            c = long[k + n - 1]
            shared += left[c] > 0
            left[c] -= 1
        if k > 0:
            c = long[k - 1]
            left[c] += 1
            shared -= left[c] > 0
        bounds.append((200.0 * shared / (n + min(k + n, len(long)) - max(0, k)), k))
    for bound, k in sorted(bounds, reverse=True):
        if bound <= best:
            break
        best = max(best, _indel(short, long[max(0, k) : k + n]))
    return best


@lru_cache(4096)
def _ordered(s: str) -> str:
    return " ".join(sorted(s.split()))


def weighted_score(a: str, b: str) -> float:
    """The best of the plain, sorted-word and word-set ratios, or of the partial ones where lengths differ much, each with its published scale."""
    if not a or not b:
        return 0.0
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    plain = _indel(a, b)
    if ratio < 1.5:
        return max(plain, 0.95 * max(_indel(_ordered(a), _ordered(b)), token_set_score(a, b)))
    scale = 0.9 if ratio <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 100.0 if x & y else _partial(" ".join(sorted(x - y)), " ".join(sorted(y - x)))
    return max(plain, scale * _partial(a, b), 0.95 * scale * max(_partial(_ordered(a), _ordered(b)), words))


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def weighted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_score(x or "", y or "") for x, y in zip(a, b, strict=True)])


def composite_score(left: Column, right: Column) -> Column:
    """The weighted score of two cores: 100 where equal, 0 where either is empty."""
    score = WEIGHT_LEVENSHTEIN * levenshtein_similarity(left, right) + WEIGHT_TOKEN_SET * token_set_ratio(left, right) + WEIGHT_WEIGHTED * weighted_ratio(left, right)
    return F.when((left == "") | (right == ""), 0.0).when(left == right, 100.0).otherwise(score)


def compatible(kind: Column) -> Column:
    return kind.isin(*COMPATIBLE)
