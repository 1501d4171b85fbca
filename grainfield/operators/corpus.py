"""Texts for models: assembled target texts, contexts, training pairs, seeded choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.operators.tables import first_rows


def assemble_text(parts: DataFrame, key: str, limit: int, *order: str) -> DataFrame:
    """Per key the parts (url, text) in order, each under its url, cut at the limit.

    Every part takes at least its mark, so only so many parts of a key can matter; they are picked in many tasks. A running
    length then drops those whose blank line begins beyond the limit before any are gathered, and each is cut at the limit, so
    that a key of any size gathers at most the limit and one part.
    """
    gap = len("\n\n")
    item = F.concat(F.lit("=== "), F.coalesce("url", F.lit("")), F.lit(" ===\n"), F.coalesce("text", F.lit("")))
    line = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.select(key, *order, F.substring(item, 1, limit).alias("_t"), (F.length(item) + gap).alias("_size"))
    rows = first_rows(rows, key, (limit + gap - 1) // len("===  ===\n\n\n") + 1, *order)
    near = rows.withColumn("_at", F.coalesce(F.sum("_size").over(line), F.lit(0))).where(F.col("_at") < limit + gap)
    joined = near.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))
    return joined.select(key, F.substring("text", 1, limit).alias("text"))


def rolling_context(rows: DataFrame, most: int = 5) -> DataFrame:
    """Target, grp and the last findings (txt) of earlier groups, oldest first. Only the last `most` of each group can count."""
    back = Window.partitionBy("target", "grp").orderBy(F.desc("pos"))
    tail = rows.withColumn("r", F.row_number().over(back)).where(F.col("r") <= most)
    groups = tail.groupBy("target", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "txt"))).alias("mine"))
    before = F.flatten(F.collect_list("mine").over(Window.partitionBy("target").orderBy("grp").rowsBetween(-most, -1)))
    texts = groups.withColumn("a", F.transform(before, lambda x: x["txt"]))
    return texts.select("target", "grp", F.slice("a", F.greatest(F.size("a") - most + 1, F.lit(1)), most).alias("context"))


def seeded_order(key: Column | str, seed: int) -> Column:
    """A reproducible random order, the same however the rows are dealt out."""
    return F.md5(F.concat(F.lit(f"{seed}#"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def seed_filter(seeds: DataFrame, overrides: DataFrame, state: str | None = None, least: int = 0) -> DataFrame:
    """Seeds with an http url, of a state (ignoring case), with enough people, whose url is no override's."""
    same = F.lower("bundesland") == state.lower() if state else F.lit(True)
    enough = F.coalesce(F.col("einwohner").try_cast("int"), F.lit(0)) >= least
    return seeds.where(F.col("url").startswith("http") & same & enough).join(overrides.select("url"), "url", "left_anti")


def seed_select(seeds: DataFrame, overrides: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """Overrides first, then seeds without override in seeded order up to `most` in all."""
    rest = max(0, most - overrides.count())
    picked = seeds.join(overrides.select(key), key, "left_anti").orderBy(seeded_order(F.col(key), seed), key).limit(rest)
    return overrides.select(key, F.lit(True).alias("override")).unionByName(picked.select(key, F.lit(False).alias("override")))


def train_eval_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Column `part`, train or eval by the row's hash; a table of any size is split without sorting it."""
    return df.withColumn("part", F.when(F.substring(seeded_order(key, seed), 1, 8) < f"{int(share * (1 << 32)):08x}", "eval").otherwise("train"))


# Labels of the lines of a text made from findings, by column.
LABELS = {"massnahme": "Projekt: ", "adresse": "Standort: ", "start": "Baubeginn: ", "ende": "Fertigstellung: ", "quelle_url": "Weitere Infos: "}


def made_text(items: Column, place: Column) -> Column:
    """a text about a place from an array of findings, a line per known column."""
    lines = lambda m: F.concat_ws("\n", *[F.when(F.coalesce(m[c], F.lit("")) != "", F.concat(F.lit(label), m[c])) for c, label in LABELS.items()])
    return F.concat(F.lit("Offizielle Website von "), place, F.lit("\n\n"), F.array_join(F.transform(items, lines), "\n\n"))


def training_pairs(findings: DataFrame, texts: DataFrame, key: str, instruction: str, most: int = 8000) -> DataFrame:
    """Instruction, input (the stored text, or one made from the findings), output JSON, metadata, n.

    findings: key, id, pos and what LABELS names; texts: key, text, one row per key.
    """
    item = F.struct("id", "pos", F.struct(*LABELS).alias("m"))
    grouped = findings.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("a")).withColumn("m", F.transform("a", lambda x: x["m"]))
    rows = grouped.join(texts.select(key, F.substring("text", 1, most).alias("text")), key, "left")
    given = F.substring(F.coalesce(F.nullif("text", F.lit("")), made_text(F.col("m"), F.col(key))), 1, most)
    output = F.to_json(F.struct(F.col("m").alias("massnahmen")), {"ignoreNullFields": "false"})
    meta = F.create_map(F.lit("url"), F.col(key), F.lit("massnahmen_count"), F.size("m").cast("string"))
    return rows.select(key, F.lit(instruction).alias("instruction"), given.alias("input"), output.alias("output"), meta.alias("metadata"), F.size("m").alias("n"))


def with_negatives(pairs: DataFrame, pool: DataFrame, instruction: str) -> DataFrame:
    """The pairs, and negative ones (the first texts of a small pool (pos, input, reason) by a fifth of the pairs' number, two at least) with an empty answer."""
    most = max(2, pairs.count() // 5)
    chosen = pool.orderBy("pos").limit(most)
    meta = F.create_map(F.lit("typ"), F.lit("negativ"), F.lit("grund"), F.col("reason"))
    negative = chosen.select(F.lit(instruction).alias("instruction"), "input", F.lit('{"massnahmen":[]}').alias("output"), meta.alias("metadata"))
    return pairs.unionByName(negative, allowMissingColumns=True)


def instruction_text(snippet: Column, base: Column, categories: list[str], today: str) -> Column:
    """what a model is asked for one chunk, with the categories, the dates' rule and the base address."""
    head = f"Kategorien: {', '.join(categories)}. Stichtag {today}; nichts, was mehr als drei Jahre vorher endete. Basis: "
    return F.concat(F.lit(head), base, F.lit("\n---\n"), F.substring(snippet, 1, 12000))


def chat_text(instruction: Column, given: Column, answer: Column, template: tuple[str, str, str] = ("<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n", "<end_of_turn>")) -> Column:
    """a pair in the template's turns; the given text is left out if empty."""
    asked = F.when(F.coalesce(given, F.lit("")) != "", F.concat(instruction, F.lit("\n\nText:\n"), given)).otherwise(instruction)
    return F.concat(F.lit(template[0]), asked, F.lit(template[1]), answer, F.lit(template[2]))


def changed_pages(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New pages (key, hash) whose hash is not the stored one, or that have none."""
    return new.join(old.select(*key, F.col("hash").alias("_old")), key, "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).select(*key, "hash", F.col("_old").isNull().alias("is_new"))


def page_hash_map(rows: DataFrame, target: str, url_key: str, hash_col: str, size: int = 10_000) -> DataFrame:
    """Target, piece, pieces, page_hashes: a target's map from url key to hash, of a repeated key the least hash.

    A map of any size is kept whole, as numbered pieces of about `size` keys (by a hash of the key), so that no row grows with
    its target; together they are the target's map. A target of up to `size` keys is one piece. page_hashes() keeps the entries as rows.
    """
    entries = page_hashes(rows, target, url_key, hash_col)
    sizes = entries.groupBy(F.col(target).alias("_target")).agg(F.ceil(F.count("*") / size).cast("int").alias("pieces"))
    dealt = F.conv(F.substring(F.md5(F.col(url_key).cast("string")), 1, 8), 16, 10).cast("long")
    entries = entries.where(F.col(url_key).isNotNull()).join(sizes, F.col(target).eqNullSafe(F.col("_target"))).withColumn("piece", (dealt % F.col("pieces")).cast("int"))
    return entries.groupBy(target, "piece", "pieces").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(url_key, "h")))).alias("page_hashes"))


def page_hashes(rows: DataFrame, target: str, url_key: str, hash_col: str) -> DataFrame:
    """A29 as rows: target, url key, h (the least hash of a repeated key)."""
    return rows.groupBy(target, url_key).agg(F.min(hash_col).alias("h"))
