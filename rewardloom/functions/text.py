"""Text expressions: answer extraction, normalisation and chat markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def hash_answer(text: Column, required: bool = False) -> Column:
    """First ``#### number`` without commas; missing is null or an error."""
    found = F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1)
    missing = F.raise_error(F.lit("no #### answer")).cast("string") if required else F.lit(None).cast("string")
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(missing)


def _balanced_head(tail: Column) -> Column:
    """Text up to the brace that closes one already opened before it; null when it never closes.

    Works on the pieces between closing braces, not on characters.
    """
    pieces = F.split(tail, r"\}", -1)
    opened = lambda p: (F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))).cast("int")
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + opened(piece) - 1
        seen = acc["seen"] + 1
        closes = (acc["end"] == 0) & (depth == 0) & (seen < F.size(pieces))
        return F.struct(
            depth.alias("depth"), seen.alias("seen"), F.when(closes, seen).otherwise(acc["end"]).alias("end")
        )

    end = F.aggregate(pieces, start, step, lambda acc: acc["end"])
    return F.when(end > 0, F.array_join(F.slice(pieces, F.lit(1), end), "}"))


def boxed_answer(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}`` with balanced braces."""
    marker = "\\boxed{"
    tail = F.element_at(F.split(text, r"\\boxed\{", -1), -1)
    return F.when(F.contains(text, F.lit(marker)), _balanced_head(tail))


def tag_answer(text: Column, tag: str = "answer") -> Column:
    """Trimmed content of the first pair of tags; null when absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def last_tag_answer(text: Column, tag: str = "answer") -> Column:
    """Trimmed content of the last pair of tags; null when absent."""
    return F.trim(last(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))))


# Fixed value: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalize_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    bare = F.regexp_replace(bare, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / len(needle)).cast("int")


def clean_cloze(text: Column) -> Column:
    """Drop bracketed artefacts of cloze data and halve double blanks."""
    out = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    out = F.regexp_replace(out, r"\[.*?\]", "")
    return F.replace(out, F.lit("  "), F.lit(" "))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def word_count(text: Column) -> Column:
    """Blank-separated tokens; the default length measure."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def tool_calls(text: Column) -> Column:
    """(name, arguments JSON) of every well-formed ``<tool_call>`` block."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.transform(blocks, lambda b: F.struct(
        F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")
    ))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def without_tool_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")


_CHANNEL_CALL = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"


def without_analysis(text: Column) -> Column:
    """Drop the analysis channel, with or without its opening."""
    return F.regexp_replace(text, r"(?s)(<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")


def channel_tool_calls(text: Column) -> Column:
    """(name, arguments) of every call in the channel format; arguments are not checked."""
    rest = without_analysis(text)
    names = F.regexp_extract_all(rest, F.lit(_CHANNEL_CALL), F.lit(1))
    bodies = F.regexp_extract_all(rest, F.lit(_CHANNEL_CALL), F.lit(2))
    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("arguments")))


def without_channel_calls(text: Column) -> Column:
    return F.regexp_replace(without_analysis(text), _CHANNEL_CALL, "")
