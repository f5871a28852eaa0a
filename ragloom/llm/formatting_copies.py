"""Copies hidden by formatting: canonical keys and skew-safe grouping.

Two contents are the same when they have the same letters and digits in the same order, field by field for
records. Blanks, letter case and punctuation do not count, except a decimal point between two digits.

Defined results: null contents belong to no set; contents without letters and digits all have the empty key and
form one set; a text that looks like a record but has fewer than two fields is running text; of repeated rows
with one id, the id counts once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.operators.durable import durable
from ragloom.operators.skew import HOT_LIMIT, HOT_ROWS, SALTS

# A point between digits is kept under this private code point while punctuation is removed.
_POINT = "\ue000"


def letters_and_digits(text: Column) -> Column:
    """Lower-cased letters, marks and digits of a text, with decimal points inside numbers."""
    kept = F.regexp_replace(F.lower(text), r"(?<=\p{Nd})\.(?=\p{Nd})", _POINT)
    return F.regexp_replace(kept, r"[^\p{L}\p{M}\p{N}" + _POINT + "]+", "")


def _pairs(text: Column, pattern: str) -> Column:
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"),
    )


def record_fields(text: Column) -> Column:
    """array<struct<name,value>> of a record in JSON, `Name: value` lines or `name = value` between bars; else null."""
    body = F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+", "")
    parsed = F.from_json(body, "map<string,string>")
    as_json = F.transform(
        F.map_entries(parsed), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))
    )
    as_bars = _pairs(body, r"(?s)(?:^|\|)\s*(\w+)\s*=(.*?)(?=\|\s*\w+\s*=|\z)")
    as_lines = _pairs(body, r"(?ms)^[ \t\p{Z}]*(\w+)[ \t\p{Z}]*:(.*?)(?=^[ \t\p{Z}]*\w+[ \t\p{Z}]*:|\z)")
    return (
        F.when(body.startswith("{") & (F.size(as_json) >= 2), as_json)
        .when(body.rlike(r"^\w+\s*=") & body.contains("|") & (F.size(as_bars) >= 2), as_bars)
        .when(body.rlike(r"^\w+[ \t\p{Z}]*:") & (F.size(as_lines) >= 2), as_lines)
    )


def canonical_key(text: Column) -> Column:
    """128-bit key of the canonical form. Records are keyed by their fields in name order."""
    fields = record_fields(text)
    parts = F.array_sort(F.transform(
        fields, lambda f: F.concat(letters_and_digits(f["name"]), F.lit("="), letters_and_digits(F.coalesce(f["value"], F.lit(""))))
    ))
    form = F.when(fields.isNotNull(), F.concat(F.lit("r:"), F.array_join(parts, ";"))).otherwise(
        F.concat(F.lit("t:"), letters_and_digits(text)))
    return F.unhex(F.md5(form.cast("binary")))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), canonical_key(F.col(text_col)).alias("key"))


def copy_sets(df: DataFrame, id_col: str, text_col: str, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """One row (keep_id, id, copies) per row of `df`: its set's smallest id and number of members.

    The keys are written once. Hot keys come from exact partial counts (at most HOT_LIMIT of them, a proven bound);
    their rows are aggregated in two levels over salts and get the representative by broadcast of one small row a
    key. All other rows take one shuffle by key.
    """
    keys = durable(keyed(df, id_col, text_col))
    hot = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_rows)
           .orderBy(F.desc("n"), "key").limit(HOT_LIMIT).select("key"))
    marked = keys.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    rest = marked.where(F.col("hot").isNull()).select("id", "key")
    large = marked.where(F.col("hot")).select("id", "key")

    salted = large.select("id", "key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).distinct()
    level = salted.groupBy("key", "salt").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    heads = level.groupBy("key").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    large_out = salted.join(F.broadcast(heads), "key").select("keep_id", "id", "copies")

    members = rest.groupBy("key").agg(F.collect_set("id").alias("ids"))
    rest_out = members.select(
        F.array_min("ids").alias("keep_id"), F.size("ids").cast("long").alias("copies"), F.explode("ids").alias("id")
    ).select("keep_id", "id", "copies")
    return rest_out.unionByName(large_out)


def collapse(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a set: the smallest id and the number of copies."""
    return copy_sets(df, id_col, text_col).where(F.col("id") == F.col("keep_id")).select(
        F.col("keep_id").alias(id_col), "copies")
