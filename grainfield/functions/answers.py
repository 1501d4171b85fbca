"""Model answers (url, raw text) to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.functions.text import sanitize_date
from grainfield.functions.urls import absolute_url

ROOT = "massnahmen array<string>, funde array<string>, results array<string>, massnahme string"
ITEM = "massnahme string, titel string, title string, kategorie string, category string, adresse string, ort string, massnahme_start string, start string, massnahme_ende string, ende string, quelle_url string, url string, konfidenz double"
# Categories of the model by category of the domain.
CATEGORIES = {"Bauen": "bauen", "Verkehr": "infrastruktur", "Wirtschaft": "wirtschaft", "Verwaltung": "verwaltung"}


def strip_wrapping(raw: Column) -> Column:
    """Code fences and think blocks go; the outermost braces stay (null if there are none)."""
    text = F.regexp_replace(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", F.regexp_replace(found, "[\\n\\r\\t]", " "))


def repair_json(text: Column) -> Column:
    """Trailing commas go, missing commas between objects come."""
    return F.regexp_replace(F.regexp_replace(text, r",\s*([}\]])", "$1"), r"\}\s*\{", "},{")


def parse_answers(answers: DataFrame) -> DataFrame:
    """The other columns, status (ok, repaired, empty_response, parse_error), items (array of JSON strings or titles).

    The text that is valid (as it stands, or repaired) is found first, so that JSON is parsed once.
    """
    keep = [c for c in answers.columns if c != "raw"]
    valid = lambda c: F.try_parse_json(c).isNotNull()
    rows = answers.select(*keep, F.coalesce("raw", F.lit("")).alias("raw")).withColumn("body", strip_wrapping(F.col("raw")))
    rows = rows.withColumn("fixed", F.when(~valid(F.col("body")), repair_json(F.col("body"))))
    rows = rows.withColumn("good", F.when(F.col("fixed").isNull(), F.col("body")).when(valid(F.col("fixed")), F.col("fixed")))
    state = F.when(F.trim("raw") == "", "empty_response").when(F.col("good").isNull(), "parse_error").when(F.col("fixed").isNull(), "ok").otherwise("repaired")
    rows = rows.withColumn("status", state).withColumn("r", F.from_json("good", ROOT))
    single = F.when(F.col("r.massnahme").isNotNull(), F.array("good"))
    last = F.regexp_extract_all(F.col("body"), F.lit(r'(\{[^{}]*"massnahme"[^{}]*\})'), F.lit(1))
    items = F.coalesce("r.massnahmen", "r.funde", "r.results", single, F.when(F.col("status") == "parse_error", last), F.array().cast("array<string>"))
    return rows.select(*keep, "status", items.alias("items"))


def _first(*names: str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(F.col(f"i.{n}")), F.lit("")) for n in names])


def findings(parsed: DataFrame) -> DataFrame:
    """one row per item: the other columns, pos, massnahme, kategorie, adresse, start, ende, quelle_url, konfidenz; a bare string is a title."""
    keep = [c for c in parsed.columns if c not in ("status", "items")]
    rows = parsed.select(*keep, F.posexplode_outer("items").alias("pos", "item")).where("pos is not null")  # without outer, Spark filters by the items first and parses all for that, too
    rows = rows.withColumn("i", F.from_json("item", ITEM))
    bare = ~F.trim("item").startswith("{")
    title = F.when(bare, F.trim("item")).otherwise(_first("massnahme", "titel", "title"))
    return rows.select(
        *keep, "pos", title.alias("massnahme"), _first("kategorie", "category").alias("kategorie"), _first("adresse", "ort").alias("adresse"),
        sanitize_date(_first("massnahme_start", "start")).alias("start"), sanitize_date(_first("massnahme_ende", "ende")).alias("ende"),
        absolute_url(_first("quelle_url", "url"), F.col("url")).alias("quelle_url"), F.coalesce("i.konfidenz", F.lit(1.0)).alias("konfidenz"),
    )


def measure_records(rows: DataFrame, default: str = "verwaltung", categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """Domain category by mapping, place as the address's last part, validity."""
    mapping = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    place = F.nullif(F.trim(F.element_at(F.split("adresse", ","), -1)), F.lit(""))
    out = rows.withColumn("kategorie_domain", F.coalesce(F.try_element_at(mapping, "kategorie"), F.lit(default))).withColumn("ort", place)
    return out.withColumn("gueltig", (F.length(F.coalesce("massnahme", F.lit(""))) > 0) & (F.length("quelle_url") > 0) & (F.length("kategorie_domain") > 0))


def known_category(category: Column | str, known: list[str]) -> Column:
    """Whether a category is one of the known; rows are kept either way."""
    return F.coalesce((F.col(category) if isinstance(category, str) else category).isin(known), F.lit(False))


def quality_issues(title: Column, address: Column, start: Column, end: Column, url: Column, today: str) -> Column:
    """names of the faults of a finding."""
    flag = lambda test, name: F.when(F.coalesce(test, F.lit(True)), F.lit(name))
    return F.array_compact(
        F.array(
            flag(F.length(F.coalesce(title, F.lit(""))) < 15, "short_title"),
            flag(F.length(F.coalesce(address, F.lit(""))) < 5, "generic_address"),
            flag(start.isNull() & end.isNull(), "no_date"),
            F.when(end < F.lit(today), F.lit("expired")),
            flag(~url.rlike("^https?://"), "bad_url"),
        )
    )
