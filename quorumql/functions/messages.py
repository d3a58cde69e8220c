"""Reading chat messages: content parts and tool-call arguments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quorumql.functions.text import strip

PART_TYPE = "array<struct<type:string,text:string,thinking:string>>"


def flatten_content(content: Column, parts: Column, include_thinking: bool = True) -> Column:
    """Text of a message: its plain content, or its parts joined by newlines.

    With ``include_thinking`` thinking parts count too and only empty parts are dropped; without it only text
    counts, and parts of blanks are dropped as well.
    """
    if include_thinking:
        picked = F.transform(
            parts,
            lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "thinking", p["thinking"]),
        )
        kept = F.filter(picked, lambda t: t.isNotNull() & (t != ""))
    else:
        kept = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (strip(t) != ""))
    return F.coalesce(content, F.array_join(kept, "\n"), F.lit(""))


def argument_sql(arguments: Column) -> Column:
    """The trimmed ``sql`` argument of a tool call; anything but a JSON object with a string there gives ''."""
    parsed = F.try_parse_json(arguments)
    found = F.try_variant_get(parsed, "$.sql", "variant")
    is_text = F.schema_of_variant(found) == "STRING"
    return F.coalesce(F.when(is_text, strip(F.try_variant_get(parsed, "$.sql", "string"))), F.lit(""))
