"""A dictionary of coded tests from JSON files, with its schema enforced: entries, aliases, and what was rejected and why.

A file is an object with schemaVersion 1 and its entries. Every entry is checked on its own: one that breaks the schema is
rejected with the path and rule that it breaks first, and the others are read. A code counts once in all files; its later
entries, by file and place, are rejected.

Defined cases: a file that is no JSON, or not an object of this form, is rejected as a whole; an empty list of entries is
a dictionary without entries; a unit whose conversion is listed twice takes the first; aliases that repeat within an entry
are one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.functions import names, shapes
from assayline.functions.shapes import Name, member, text_of
from assayline.operators import dictionary

# The form of a code, and the kinds of values.
CODE = r"^\d{1,7}-\d\z"
VALUE_TYPES = ("quantity", "qualitative", "titer")

FILE = shapes.strict(schemaVersion=shapes.exactly(1), note=shapes.optional(shapes.string()), entries=shapes.many(shapes.anything))


def entry_shape(categories: tuple[str, ...], vendors: tuple[str, ...]) -> shapes.Shape:
    """The schema of an entry: nothing but these members, each of its form."""
    some, several = shapes.string(least=1), shapes.many
    return shapes.strict(
        loinc=shapes.string(pattern=CODE), display=some, text=some, category=shapes.literal(*categories), valueType=shapes.literal(*VALUE_TYPES), ucum=shapes.nullable(some),
        unitAliases=shapes.optional(shapes.record_of(shapes.string())),
        unitConversions=shapes.optional(several(shapes.strict(**{"from": some, "factor": shapes.positive, "note": shapes.optional(shapes.string())}))),
        answers=shapes.optional(several(some, least=1)),
        plausible=shapes.optional(shapes.strict(min=shapes.number, max=shapes.number)),
        aliases=several(shapes.strict(vendor=shapes.literal(*vendors), name=some, panel=shapes.optional(some)), least=1),
        excludeFromSigning=shapes.optional(shapes.boolean),
    )


@dataclass(frozen=True)
class Dictionary:
    """entries: code, display, text, category, value_type, ucum, unit_aliases, conversions (maps), answers, low, high,
    excluded; aliases: code, vendor, panel, name (normalised); rejects: file, path, message."""

    entries: DataFrame
    aliases: DataFrame
    rejects: DataFrame

    def index(self) -> DataFrame:
        """vendor, panel, name and the codes that they lead to."""
        return self.aliases.groupBy("vendor", "panel", "name").agg(F.array_sort(F.collect_set("code")).alias("codes"))

    def violations(self) -> DataFrame:
        """What the schema cannot say: alias keys that lead to several codes (see operators.dictionary)."""
        return dictionary.violations(self.entries.select("code"), self.aliases)


def read_dictionary(spark: SparkSession, path: str, categories: tuple[str, ...], vendors: tuple[str, ...]) -> Dictionary:
    """The dictionary of all JSON files under ``path``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    return load(files, categories, vendors)


def load(files: DataFrame, categories: tuple[str, ...], vendors: tuple[str, ...]) -> Dictionary:
    """The dictionary of ``files`` (file, content)."""
    parsed = files.select("file", F.try_parse_json("content").alias("_v"))
    whole = parsed.select("file", FILE(F.col("_v"), "$", Name()).alias("_issue"), shapes.elements(F.col("_v"), "$.entries").alias("_entries"))
    broken = whole.where("_issue is not null").select("file", "_issue.path", "_issue.message")
    listed = whole.where("_issue is null").select("file", F.posexplode("_entries").alias("at", "e"))
    place = F.concat(F.lit("entries["), F.col("at").cast("string"))
    checked = listed.withColumn("_issue", entry_shape(categories, vendors)(F.col("e"), "$", Name("]", place))).withColumn("code", text_of(F.col("e"), "$.loinc"))
    nth = F.row_number().over(Window.partitionBy("code").orderBy("file", "at"))
    valid = checked.where("_issue is null").withColumn("_nth", nth)
    again = valid.where("_nth > 1").select("file", F.concat(place, F.lit("].loinc")).alias("path"), F.concat(F.lit("duplicate LOINC in dictionary: "), "code").alias("message"))
    rejects = broken.unionByName(checked.where("_issue is not null").select("file", "_issue.path", "_issue.message")).unionByName(again)

    e, text = F.col("e"), lambda at: text_of(F.col("e"), at)
    pairs = F.transform(shapes.elements(e, "$.unitConversions"), lambda c: F.struct(text_of(c, "$.from").alias("k"), F.try_variant_get(c, "$.factor", "double").alias("v")))
    once = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    number = lambda at: F.try_variant_get(e, at, "double")
    kept = valid.where("_nth = 1")
    entries = kept.select(
        "code", text("$.display").alias("display"), text("$.text").alias("text"), text("$.category").alias("category"), text("$.valueType").alias("value_type"), text("$.ucum").alias("ucum"),
        F.coalesce(F.try_variant_get(e, "$.unitAliases", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("unit_aliases"),
        F.coalesce(F.map_from_entries(once), F.create_map().cast("map<string,double>")).alias("conversions"),
        F.try_variant_get(e, "$.answers", "array<string>").alias("answers"), number("$.plausible.min").alias("low"), number("$.plausible.max").alias("high"),
        F.coalesce(F.try_variant_get(e, "$.excludeFromSigning", "boolean"), F.lit(False)).alias("excluded"),
    )
    each = kept.select("code", F.explode(shapes.elements(e, "$.aliases")).alias("a"))
    aliases = each.select("code", text_of(F.col("a"), "$.vendor").alias("vendor"), names.normalize_name(text_of(F.col("a"), "$.panel")).alias("panel"), names.normalize_name(text_of(F.col("a"), "$.name")).alias("name")).distinct()
    return Dictionary(entries, aliases, rejects)
