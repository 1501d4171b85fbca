"""URL functions: keys for identity and comparison, parts, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainfield.functions.text import _col, normalize_url_text

# File endings that are never pages.
SKIP_ENDINGS = [
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "mp4", "mp3", "avi", "mov", "wmv", "woff", "woff2", "ttf", "eot",
    "css", "zip", "tar", "gz", "rar", "xls", "xlsx", "doc", "docx", "ppt", "pptx",
]
# Patterns of empty category pages.
SKIP_PATTERN = "jsf=jet-engine|tax=adressen-kategorie|stadtplan-query"
MOST_DEPTH = 8
# Words of urls that are never relevant, and of file names of documents that come first.
IGNORED_WORDS = ["impressum", "datenschutz", "kontakt", "sitemap", "login", ".jpg", ".png", ".gif", ".svg", ".webp"]
PRIORITY_WORDS = [
    "bekanntmachung", "bebauungsplan", "b-plan", "bplan", "satzung", "erschließung", "erschliessung", "ausschreibung", "vergabe", "foerderung", "förderung",
    "sanierung", "strassenbau", "straßenbau", "brueckenbau", "brückenbau", "brueckensanierung", "brückensanierung", "leitungsbau",
]
# Query parameters that don't tell pages apart.
IGNORED_PARAMETERS = ["sort", "page", "order", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]


def authority(url: Column | str) -> Column:
    """host with port."""
    return F.coalesce(F.regexp_extract(_col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"\?([^#]*)", 1)


def strip_www(host: Column | str) -> Column:
    """F8: a leading www. goes."""
    return F.regexp_replace(_col(host), r"^www\.", "")


def url_base(url: Column | str) -> Column:
    """without query and fragment, path without trailing slashes."""
    return F.regexp_replace(F.regexp_replace(_col(url), r"[?#].*$", ""), r"(?<![:/])/+$", "")


def url_base_with_parameters(url: Column | str, ignored: list[str] = IGNORED_PARAMETERS) -> Column:
    """https, no fragment, parameters but the ignored ones."""
    url = F.regexp_replace(F.regexp_replace(_col(url), "#.*$", ""), "^http://", "https://")
    keep = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*ignored))
    return F.concat(F.regexp_replace(url, r"\?.*$", ""), F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise(F.lit("")))


def compare_key(url: Column | str) -> Column:
    """lower case without query, fragment, scheme, www., trailing slashes and index page."""
    out = F.lower(F.regexp_replace(F.trim(_col(url)), r"[?#].*$", ""))
    out = F.regexp_replace(F.regexp_replace(out, "^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(out, "/+$", ""), r"/index\.(html?|php)$", "")


def segments(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def parent_key(url: Column | str, depth: int) -> Column:
    """host and the first segments of the path."""
    return F.concat(authority(url), F.lit("/"), F.array_join(F.slice(segments(url), 1, depth), "/"))


def is_skipped(url: Column | str) -> Column:
    """By ending, pattern or depth."""
    low = F.lower(path(url))
    return low.rlike(r"\.(" + "|".join(SKIP_ENDINGS) + ")$") | F.lower(_col(url)).rlike(SKIP_PATTERN) | (F.size(segments(url)) > MOST_DEPTH)


def is_document(url: Column | str) -> Column:
    """F18."""
    return F.lower(_col(url)).endswith(".pdf")


def is_ignored(url: Column | str) -> Column:
    """Urls that hold a word of pages or images never read."""
    return F.lower(_col(url)).rlike("|".join(w.replace(".", r"\.") for w in IGNORED_WORDS))


def in_sub_path(url: Column | str, start: Column | str) -> Column:
    """The url's path begins with the path of the start."""
    return path(url).startswith(path(start))


def is_priority_document(url: Column | str) -> Column:
    """by words of the file name."""
    return F.lower(F.substring_index(_col(url), "/", -1)).rlike("|".join(PRIORITY_WORDS))


def document_order(url: Column | str, pos: Column | str) -> list[Column]:
    """Priority documents in the order found, then the others by year, the latest (or none) first."""
    priority = is_priority_document(url)
    return [F.when(priority, 0).otherwise(1), F.when(priority, 0).otherwise(-document_year(url)), _col(pos)]


def is_recent_document(created: Column | str, least: int) -> Column:
    """Creation dates D:YYYY... of a year on; others pass."""
    created = _col(created)
    year = F.when(created.startswith("D:"), F.substring(created, 3, 4).try_cast("int"))
    return F.coalesce(year >= least, F.lit(True))


def document_year(url: Column | str) -> Column:
    """F16: a year 20xx in the file name, 9999 if there is none."""
    return F.coalesce(F.regexp_extract(F.substring_index(_col(url), "/", -1), r"(20\d{2})", 1).try_cast("int"), F.lit(9999))


def same_site(a: Column | str, b: Column | str) -> Column:
    """P14."""
    return strip_www(authority(a)) == strip_www(authority(b))


def slug_variants(host: Column | str) -> Column:
    """the host without www. and its last label, with and without leading town words."""
    slug = F.regexp_replace(strip_www(host), r"\.[^.]*$", "")
    return F.array_distinct(F.array(slug, F.regexp_replace(slug, "^(stadt|markt|gemeinde|bad)-", "")))


def redirect_accepted(base_host: Column | str, final_url: Column | str) -> Column:
    """A variant of the home slug is a segment of the final url's path."""
    return F.arrays_overlap(slug_variants(base_host), F.transform(segments(final_url), lambda s: F.lower(s)))


def url_text(url: Column | str) -> Column:
    """F32: the words of path and query, for a keyword score."""
    return F.concat(normalize_url_text(path(url)), F.lit(" "), normalize_url_text(query(url)))


def absolute_url(url: Column | str, base: Column | str) -> Column:
    """empty becomes the base, a relative one hangs on it."""
    url, base = _col(url), _col(base)
    empty = url.isNull() | (F.trim(url) == "")
    return F.when(empty, base).when(url.rlike("^https?://"), url).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", "")))


def redirect_target(status: Column | str) -> Column:
    """the host named by an EXTERNAL_REDIRECT status, with https."""
    host = F.regexp_extract(_col(status), "^EXTERNAL_REDIRECT:(.+)$", 1)
    return F.when(host == "", None).when(host.rlike("^https?://"), host).otherwise(F.concat(F.lit("https://"), host))
