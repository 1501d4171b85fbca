"""Text functions: normalisation, keyword patterns and scores, tokens, dates, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The default keyword model, category by category.
DEFAULT_KEYWORDS = {
    "bauen": [
        "bebauungsplan", "bebauungsplaene", "flaechennutzungsplan", "flaechennutzungsplaene", "bauleitplanung", "baugenehmigung", "bauvorhaben", "neubau",
        "sanierung", "sanierungsgebiet", "stadtumbaugebiet", "stadtentwicklung", "dorfentwicklung", "entwicklung", "planungsbeteiligung", "buergerbeteiligung",
        "oeffentlichkeitsbeteiligung", "oeffentliche-auslegung", "planfeststellung", "satzungsbeschluss",
    ],
    "verwaltung": ["amtliche-bekanntmachung", "oeffentliche-bekanntmachung", "ausschreibung", "vergabe", "vergabeverfahren", "gemeinderatsbeschluss", "satzung", "verordnung", "amtsblatt", "bekanntmachungsblatt"],
    "wirtschaft": ["gewerbegebiet", "gewerbeflaeche", "wirtschaftsfoerderung", "foerderprogramm", "foerderbescheid", "investitionsprogramm", "breitbandausbau", "glasfaserausbau"],
    "infrastruktur": ["radverkehrskonzept", "verkehrskonzept", "mobilitaetskonzept", "nahverkehrsplan", "strassenausbau", "radwegebau", "radweg"],
    "aktuelles": ["pressemitteilung", "bekanntmachung", "mitteilung", "neuigkeit", "meldung", "ankuendigung", "allgemein"],
}
# Plural endings that a keyword may take.
PLURAL = "(?:e|en|es|n|s)?"
# How umlauts are written out.
UMLAUTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]


# A token of a text in lower case.
TOKEN = "[a-zäöüß][a-zäöüß-]{2,}"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(text: Column | str) -> Column:
    """null to '', lower case, umlauts written out, white space collapsed and trimmed."""
    out = F.lower(F.coalesce(_col(text), F.lit("")))
    for a, b in UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def normalize_url_text(text: Column | str) -> Column:
    """percent-decoded, separators to blanks, then F1. A bad escape leaves the text as it is."""
    text = _col(text)
    decoded = F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    return normalize_text(F.regexp_replace(decoded, "[/_=&+-]+", " "))


def normalized(text: str) -> str:
    text = text.lower()
    for a, b in UMLAUTS:
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", text).strip()


def keyword_pattern(keyword: str) -> str:
    r"""whole words, an optional plural ending, blank and hyphen alike; for use on normalised text."""
    parts = re.split("[- ]", normalized(keyword))
    return r"(?U)\b" + r"[\s-]".join(re.sub(r"([^\w])", r"\\\1", p) for p in parts) + PLURAL + r"\b"


def longest_part(keyword: str) -> str:
    return max(re.split("[- ]", normalized(keyword)), key=len)


def keyword_hits(norm: Column, keywords: list[str]) -> Column:
    """The keywords of a list that occur in a normalised text, in the order of the list (J14 as one projection).

    A plain substring test goes first, so that the pattern only runs over texts that hold the keyword's longest part.
    """
    return F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(longest_part(k))) & norm.rlike(keyword_pattern(k)), F.lit(k)) for k in keywords]))


def category_hits(norm: Column, model: dict[str, list[str]]) -> Column:
    """A map from category to its keywords that occur."""
    return F.create_map(*[x for c, ks in model.items() for x in (F.lit(c), keyword_hits(norm, ks))])


@lru_cache(maxsize=4)
def _automaton(keywords: tuple[str, ...]):
    """Finds all keywords' longest parts in one pass over a text, and the keywords' patterns."""
    import ahocorasick

    by_part: dict[str, list[int]] = {}
    for i, k in enumerate(keywords):
        by_part.setdefault(longest_part(k), []).append(i)
    anywhere, parts = by_part.pop("", []), ahocorasick.Automaton()
    for part, ids in by_part.items():
        parts.add_word(part, ids)
    if by_part:
        parts.make_automaton()
    return parts, anywhere, [re.compile(keyword_pattern(k).removeprefix("(?U)")) for k in keywords]


def keyword_numbers(keywords: list[str]) -> Callable[[Column], Column]:
    """The numbers of the keywords that occur in a normalised text, in order, by one automaton over all of them.

    Like keyword_hits(), it looks for a keyword's longest part first; patterns are tried only where the part is there, so the
    cost follows what a text holds and not the number of keywords.
    """

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        parts, anywhere, patterns = _automaton(tuple(keywords))
        held = ({*anywhere, *(i for _, ids in parts.iter(t) for i in ids)} if len(parts) else anywhere for t in texts)
        return pd.Series([[i for i in sorted(some) if patterns[i].search(t)] for some, t in zip(held, texts)], dtype=object)

    return found


def numbered_hits(numbers: Column, model: dict[str, list[str]]) -> Column:
    """The same map as category_hits(), from the numbers of all categories' keywords, one category after the other."""
    within = lambda lo, hi: lambda i: (i >= lo) & (i < hi)
    names, at, per = F.split(F.lit("\n".join(k for ks in model.values() for k in ks)), "\n"), 0, []
    for ks in model.values():
        mine = F.filter(numbers, within(at, at + len(ks)))
        per.append(F.transform(mine, lambda i: F.get(names, i)))
        at += len(ks)
    return F.map_from_arrays(F.array(*[F.lit(c) for c in model]), F.array(*per))


def coverage_score(hits: Column, model: dict[str, list[str]]) -> Column:
    """F4 from category_hits(): 0.6 x matched share of a tenth of all keywords + 0.4 x best category over twice their number, both at most 1; 4 decimals."""
    total = len({k for ks in model.values() for k in ks})
    matched = F.size(F.array_distinct(F.flatten(F.map_values(hits))))
    best = F.array_max(F.transform(F.map_values(hits), lambda a: F.size(a)))
    breadth = F.least(F.lit(1.0), matched / F.lit(max(1.0, total * 0.1)))
    depth = F.least(F.lit(1.0), best / F.lit(float(max(1, 2 * len(model)))))
    return F.round(breadth * 0.6 + depth * 0.4, 4)


def tokens(text: Column | str) -> Column:
    """German letters and hyphens, three or more, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def substring_hits(text: Column, keywords: list[str], most: int = 20) -> Column:
    """keywords contained in the text, sorted, the first so many."""
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(k)), F.lit(k)) for k in keywords])))), 1, most)


def sanitize_text(text: Column | str, most: int) -> Column:
    """without NUL characters, cut to a length."""
    return F.substring(F.replace(_col(text), F.char(F.lit(0)), F.lit("")), 1, most)


def sanitize_date(text: Column | str) -> Column:
    """strings that begin like YYYY-MM-DD, trimmed; else null."""
    text = _col(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(text))


def date_range_text(start: Column, end: Column) -> Column:
    """'a – b', one of them alone, or '-'."""
    return F.when(start.isNotNull() & end.isNotNull(), F.concat(start, F.lit(" – "), end)).otherwise(F.coalesce(start, end, F.lit("-")))


def display_time(ts: Column, seconds: bool = False) -> Column:
    """dd.MM.yyyy HH:mm, '-' for null."""
    return F.coalesce(F.date_format(ts, "dd.MM.yyyy HH:mm" + (":ss" if seconds else "")), F.lit("-"))


def iso_time(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss, null for null."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def display_date(day: Column) -> Column:
    """yyyy-MM-dd text as dd.MM.yyyy; other text stays, empty is null."""
    parts = F.split(day, "-")
    return F.when(F.size(parts) == 3, F.concat_ws(".", parts[2], parts[1], parts[0])).otherwise(F.nullif(day, F.lit("")))


def map_range_text(start: Column, end: Column) -> Column:
    """F43 as maps show it: both ends, '?' for a missing one; null if both are missing."""
    a, b = display_date(start), display_date(end)
    return F.when(a.isNotNull() | b.isNotNull(), F.concat(F.coalesce(a, F.lit("?")), F.lit(" – "), F.coalesce(b, F.lit("?"))))


def chunk_step(size: int, overlap: int) -> tuple[int, int]:
    """Overlap and step of the chunker; an overlap that is not under the size becomes a tenth of it."""
    overlap = overlap if overlap < size else size // 10
    return overlap, max(1, size - overlap)


def chunks(text: Column | str, size: int, overlap: int) -> Column:
    """Array of struct(start, body, prefix); later chunks carry the `overlap` characters before them."""
    text = F.coalesce(_col(text), F.lit(""))
    overlap, step = chunk_step(size, overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    prefix = lambda p: F.when(p > 0, F.substring(text, F.greatest(p - overlap, F.lit(0)) + 1, F.least(p, F.lit(overlap))))
    return F.transform(starts, lambda p: F.struct(p.alias("start"), F.substring(text, p + 1, F.lit(size)).alias("body"), prefix(p).alias("prefix")))


def token_estimate(text: Column | str) -> Column:
    """characters by four."""
    return F.floor(F.length(_col(text)) / 4)


def slugify(text: Column | str) -> Column:
    """umlauts written out, accents dropped, words joined by hyphens."""
    flat = F.translate(normalize_text(text), "áàâãåéèêëíìîïóòôõúùûñçýÿ", "aaaaaeeeeiiiioooouuuncyy")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9 _-]+", ""), "[ _-]+", "-"), "^-|-$", "")


def overlap_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the token sets of two arrays of titles; both empty 1, one empty 0; 4 decimals."""
    words = lambda a: F.filter(F.array_distinct(F.flatten(F.transform(a, lambda t: F.split(F.lower(t), r"[ \t\n]+")))), lambda w: w != "")
    p, g = words(predicted), words(gold)
    both = F.size(F.array_intersect(p, g))
    f1 = 2.0 * both / (F.size(p) + F.size(g))
    return F.round(F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1), 4)
