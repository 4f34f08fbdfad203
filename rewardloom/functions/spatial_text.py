"""Boxes, points and actions spelled in free text.

Patterns find candidates by flat character classes (no repeated groups, whose length would cost stack), and the pieces are then
read as numbers or as JSON in which single quotes are allowed. What cannot be read is left out, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.bind import let

BOX_SIZE = 9
LEAST_NUMBERS = 6
_LENIENT = {"allowSingleQuotes": "true"}
_NUMBERS = r"[\s\d.,eE+\-]+"
_KEYED = rf"""["']bbox_3d["']\s*:\s*\[({_NUMBERS})\]"""
_BARE = r"\[([\s\d.,\-]+)\]"
_OBJECT = r"""(?s)(\{[^{}]*["']center["'][^{}]*\}|\{[^{}]*["']x["'][^{}]*\})"""
_PLACED = r"\(([\d.,\-\s]+)\)"


def numbers(listed: Column) -> Column:
    """Numbers between commas; null when one of them cannot be read, blanks count as nothing."""
    parts = F.filter(F.split(F.regexp_replace(listed, r"^\s+|\s+$|\s*(,)\s*", "$1"), ","), lambda x: x != "")
    read = F.transform(parts, lambda x: x.try_cast("double"))
    return let(read, lambda r: F.when(~F.exists(r, lambda x: x.isNull()), r))


def as_box(values: Column) -> Column:
    """The first nine numbers, or the first six and no rotation; null for fewer."""
    flat = F.concat(F.slice(values, 1, LEAST_NUMBERS), F.array_repeat(F.lit(0.0), BOX_SIZE - LEAST_NUMBERS))
    return F.when(F.size(values) >= BOX_SIZE, F.slice(values, 1, BOX_SIZE)).when(F.size(values) >= LEAST_NUMBERS, flat)


def boxes_in_text(text: Column) -> Column:
    """Every list under a key ``bbox_3d``, in order; lists that are too short or hold something else are left out."""
    found = F.regexp_extract_all(text, F.lit(_KEYED), F.lit(1))
    return F.coalesce(F.filter(F.transform(found, lambda x: let(numbers(x), as_box)), lambda b: b.isNotNull()), F.array().cast("array<array<double>>"))


def _of_object(text: Column) -> Column:
    kind = "center array<double>, size array<double>, rotation array<double>, x double, y double, z double, width double, height double, length double"

    def read(o: Column) -> Column:
        turn = F.coalesce(o["rotation"], F.array_repeat(F.lit(0.0), 3))
        side = lambda c: F.coalesce(o[c], F.lit(0.0))
        by_axes = F.concat(F.array(o["x"], o["y"], o["z"], side("width"), side("height"), side("length")), turn)
        return F.when(o["center"].isNotNull() & o["size"].isNotNull(), F.concat(o["center"], o["size"], turn)).when(
            o["x"].isNotNull() & o["y"].isNotNull() & o["z"].isNotNull(), by_axes)

    return let(F.from_json(F.regexp_extract(text, _OBJECT, 1), kind, _LENIENT), read)


def _of_words(text: Column) -> Column:
    part = lambda name: numbers(F.regexp_extract(text, rf"(?i){name}[:\s]*{_PLACED}", 1))

    def read(p: Column) -> Column:
        turn = F.when(F.size(p["r"]) > 0, p["r"]).otherwise(F.array_repeat(F.lit(0.0), 3))
        return F.when((F.size(p["c"]) > 0) & (F.size(p["s"]) > 0), F.concat(p["c"], p["s"], turn))

    return let(F.struct(part("center").alias("c"), part("size").alias("s"), part("rotation").alias("r")), read)


def box_in_text(text: Column) -> Column:
    """One box in any spelling: a ``bbox_3d`` list, an object with center and size or x, y, z, the first bare list of numbers, words.

    The first spelling that gives a box decides; null when none does.
    """
    first = F.get(boxes_in_text(text), F.lit(0))
    listed = let(numbers(F.regexp_extract(text, _BARE, 1)), as_box)
    return F.coalesce(first, _of_object(text), listed, _of_words(text))


def boxes_well_formed(text: Column) -> Column:
    """Whether the text is nothing but a list of objects, each with a label and a box of at least six numbers."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "s")
    bare = F.regexp_replace(bare, r"'[^'\\]*+(?:\\.[^'\\]*+)*+'", "s")
    shape = F.regexp_replace(F.regexp_replace(bare, r"\{[^{}]*\}", "o"), r"\s+", "")
    items = F.from_json(text, "array<struct<bbox_3d:array<double>,label:string>>", _LENIENT)
    whole = lambda x: F.coalesce(x["label"].isNotNull() & (F.size(x["bbox_3d"]) >= LEAST_NUMBERS) & ~F.exists(x["bbox_3d"], lambda v: v.isNull()), F.lit(False))
    return F.coalesce(shape.rlike(r"^\[o(?:,o)*\]$") & let(items, lambda i: (F.size(i) > 0) & F.forall(i, whole)), F.lit(False))


def point_in_text(text: Column) -> Column:
    """(label, u, v): the last letter that stands alone and the first two numbers in brackets, else an object's answer and point."""
    letter = F.get(F.reverse(F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z])\b"), F.lit(1))), F.lit(0))
    placed = numbers(F.coalesce(F.nullif(F.regexp_extract(text, r"\[([\d.,\-\s]+)\]|\(([\d.,\-\s]+)\)", 1), F.lit("")),
                                F.regexp_extract(text, r"\[([\d.,\-\s]+)\]|\(([\d.,\-\s]+)\)", 2)))
    named = F.from_json(F.regexp_extract(text, r"""(?s)(\{[^{}]*["'](?:answer|label)["'][^{}]*\})""", 1), "answer string, label string, point array<double>", _LENIENT)

    def read(p: Column) -> Column:
        two = F.size(p["at"]) >= 2
        spelled = F.struct(p["letter"].alias("label"), F.when(two, F.get(p["at"], F.lit(0))).alias("u"), F.when(two, F.get(p["at"], F.lit(1))).alias("v"))
        name = F.upper(F.coalesce(p["named"]["answer"], p["named"]["label"]))
        by_key = F.struct(name.alias("label"), F.get(p["named"]["point"], F.lit(0)).alias("u"), F.get(p["named"]["point"], F.lit(1)).alias("v"))
        return F.when(p["letter"].isNotNull(), spelled).when(name.isNotNull(), by_key)

    return let(F.struct(letter.alias("letter"), placed.alias("at"), named.alias("named")), read)


def actions_in_json(text: Column) -> Column:
    """The items of the first object with a list of actions: (kind, direction, amount); turns to the right are clockwise."""
    flat = F.regexp_extract(text, r"""(?s)\{[^{}\[\]]*["']actions["']\s*:\s*(\[[^\[\]]*\])""", 1)
    items = F.from_json(flat, "array<struct<type:string,direction:string,distance:double,angle:double>>", _LENIENT)
    side = lambda d: F.when(d == "clockwise", "right").when(d == "counterclockwise", "left").otherwise(d)

    def read(a: Column) -> Column:
        kind, way = F.lower(a["type"]), F.lower(a["direction"])
        return F.struct(kind.alias("kind"), F.when(kind == "turn", side(way)).otherwise(way).alias("direction"),
                        F.coalesce(F.when(kind == "turn", a["angle"]).otherwise(a["distance"]), F.lit(0.0)).alias("amount"))

    return F.transform(F.filter(items, lambda a: a["type"].isNotNull()), read)
