"""Policies as data: key allow-lists, overrides, scrub rules and the joins that apply them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dictionary keys of the document format, by holder and by the switch that keeps
# them (None: always kept; "never": never kept). Keys not named go by the switch "unknown_objects".
PAGE_KEYS: dict[str | None, tuple[str, ...]] = {
    None: ("Type", "MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox", "Rotate", "UserUnit", "Resources", "Contents", "Group", "Annots", "Parent"),
    "structure": ("StructParents", "Tabs"),
    "navigation": ("B",),
    "viewer_preferences": ("Dur", "Trans", "AA"),
    "never": ("Thumb",),
    "private_authoring_data": ("PieceInfo",),
    "metadata": ("Metadata", "LastModified"),
    "output_intents": ("SeparationInfo", "PresSteps"),
}
PAGE_TREE_KEYS = PAGE_KEYS | {None: ("Type", "Parent", "Kids", "Count", "Resources", "MediaBox", "CropBox", "Rotate")}
CATALOG_KEYS: dict[str | None, tuple[str, ...]] = {
    None: ("Type", "Pages", "Version", "Extensions"),
    "forms": ("AcroForm",),
    "navigation": ("Outlines", "Names", "Dests", "PageLabels", "OpenAction", "Threads"),
    "optional_content": ("OCProperties",),
    "structure": ("StructTreeRoot", "MarkInfo", "Lang"),
    "output_intents": ("OutputIntents",),
    "viewer_preferences": ("ViewerPreferences", "PageMode", "PageLayout"),
    "private_authoring_data": ("PieceInfo",),
    "metadata": ("Metadata", "LastModified"),
}
SWITCHES = ("links", "forms", "navigation", "optional_content", "structure", "output_intents", "viewer_preferences", "metadata", "private_authoring_data", "unknown_objects")
PRESETS: dict[str, frozenset[str]] = {
    "functional": frozenset(SWITCHES) - {"private_authoring_data"},
    "known-functional": frozenset(SWITCHES) - {"private_authoring_data", "metadata", "unknown_objects"},
    "visible-surface": frozenset({"optional_content", "output_intents"}),
}
DANGEROUS_ACTIONS = ("JavaScript", "Launch", "SubmitForm", "ImportData", "Rendition", "RichMediaExecute")
#: Visual keys that a link keeps as a bare shell.
LINK_SHELL_KEYS = ("Rect", "Border", "BS", "C", "F", "CA")


def keeps(key: Column, table: Mapping[str | None, Sequence[str]], on: frozenset[str] | set[str]) -> Column:
    """Whether a holder keeps a key under the switches that are on."""
    known = F.lit("unknown_objects" in on)
    for switch, keys in table.items():
        known = F.when(key.isin(*keys), F.lit(switch is None or switch in on)).otherwise(known)
    return known


def project_dictionary(df: DataFrame, dictionary: str, table: Mapping[str | None, Sequence[str]], on: frozenset[str] | set[str]) -> DataFrame:
    """The map column without keys that the policy drops, and `dropped`, how many went."""
    kept = F.map_filter(dictionary, lambda k, _: keeps(k, table, on))
    return df.withColumn("_kept", kept).withColumn("dropped", F.size(dictionary) - F.size("_kept")).drop(dictionary).withColumnRenamed("_kept", dictionary)


def drop_keys(df: DataFrame, dictionary: str, names: Sequence[str]) -> DataFrame:
    """The map column without the named keys, and `dropped`."""
    kept = F.map_filter(dictionary, lambda k, _: ~k.isin(*names))
    return df.withColumn("_kept", kept).withColumn("dropped", F.size(dictionary) - F.size("_kept")).drop(dictionary).withColumnRenamed("_kept", dictionary)


def keeps_annotation(subtype: Column, protected: Column, on: frozenset[str] | set[str], others: bool) -> Column:
    """Protected ones stay; others where these are kept and their kind isn't switched off."""
    off = F.lit(False)
    if "links" not in on:
        off = off | (subtype == "Link")
    if "forms" not in on:
        off = off | (subtype == "Widget")
    return F.coalesce(protected, F.lit(False)) | (F.lit(others) & ~F.coalesce(off, F.lit(False)))


def link_shell(dictionary: Column) -> Column:
    """A link's dictionary with what it shows only."""
    return F.map_filter(dictionary, lambda k, _: k.isin(*LINK_SHELL_KEYS, "Type", "Subtype"))


def apply_overrides(findings: DataFrame, overrides: DataFrame, defaults: DataFrame, key: str, category: str, action: str = "action") -> DataFrame:
    """`findings` with `remove`: an override of the key decides, else whether the category's is remove.

    `overrides` is (key, action), `defaults` (category) lists the categories to remove.
    """
    over = overrides.select(F.col(key), F.col(action).alias("_over")).dropDuplicates([key])
    listed = defaults.select(category).distinct().withColumn("_listed", F.lit(True))
    rows = findings.join(over, key, "left").join(listed, category, "left")
    return rows.withColumn("remove", F.coalesce(F.col("_over") == "remove", F.col("_listed"), F.lit(False))).drop("_over", "_listed")


def used_resources(resources: DataFrame, used: DataFrame, on: Sequence[str], complete: DataFrame | None = None, scope: str = "scope") -> DataFrame:
    """Resources that are used; of a scope that isn't known whole, all."""
    live = resources.join(used.select(*on).distinct(), list(on), "left_semi")
    if complete is None:
        return live
    partial = resources.join(complete.where("NOT complete").select(scope).distinct(), scope, "left_semi")
    rest = live.join(complete.where("NOT complete").select(scope).distinct(), scope, "left_anti")
    return rest.unionByName(partial)


def unused_resources(resources: DataFrame, used: DataFrame, on: Sequence[str]) -> DataFrame:
    return resources.join(used.select(*on).distinct(), list(on), "left_anti")


def label_with_overrides(items: DataFrame, labels: DataFrame, overrides: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`items` with `label`: the override's text, else the label's; an empty text suppresses it."""
    rows = items.join(labels.select(key, F.col(text).alias("_label")), key, "left").join(overrides.select(key, F.col(text).alias("_over")), key, "left")
    return rows.withColumn("label", F.nullif(F.coalesce("_over", "_label"), F.lit(""))).drop("_label", "_over")


def scrub_rules(spark: SparkSession) -> DataFrame:
    """(key, label, level, switch): what privacy levels remove. Levels: 1 metadata, 2 best effort."""
    # Keys and the names under which removals are reported.
    rows = [
        ("Info", "info-dictionary", 1, None),
        ("ID", "document-id", 1, None),
        ("Metadata", "xmp-reference", 1, None),
        ("PieceInfo", "piece-info", 1, None),
        ("LastModified", "last-modified", 1, None),
        ("Thumb", "thumbnail", 2, None),
        ("AA", "additional-actions", 2, "active_content"),
        ("V", "form-value", 2, "form_values"),
        ("DV", "form-value", 2, "form_values"),
        ("RV", "form-value", 2, "form_values"),
    ]
    return spark.createDataFrame(rows, "key string, label string, level int, switch string")


def scrub(entries: DataFrame, level: int, on: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(entries that stay, counts of removals by label) for (…, key[, is_field]) rows.

    Form values go only from dictionaries that are fields (`is_field`). Level 0 removes nothing.
    """
    rules = scrub_rules(entries.sparkSession).where(F.col("level") <= level).where(F.col("switch").isNull() | F.col("switch").isin(*on, ""))
    field = F.col("is_field") if "is_field" in entries.columns else F.lit(True)
    rows = entries.join(F.broadcast(rules.drop("level")), "key", "left")  # ten rules at most
    gone = F.col("label").isNotNull() & ((F.col("label") != "form-value") | F.coalesce(field, F.lit(False)))
    marked = rows.withColumn("_gone", gone)
    return marked.where("NOT _gone").drop("_gone", "label", "switch"), marked.where("_gone").groupBy("label").agg(F.count("*").alias("removed"))
