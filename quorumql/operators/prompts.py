"""Chat prompts for every example: the example joined to the context of its database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quorumql.functions.text import strip

SYSTEM_TEXT = "You write SQL queries that answer questions about a database."
TOOL_RULES = (
    "A `query` tool runs read-only SQL on the database. Use it sparingly to look at rows, values and counts, keep "
    "each call small, and give the final statement in a ```sql block when you are done."
)
TOOL_FORMAT = (
    'Write a call as <tool_call>{"name":"query","args":{"sql":"..."}}</tool_call> and wait for its result before '
    "going on."
)
ENGINE = "Spark SQL"
INSTRUCTIONS = (
    "Return exactly the columns and rows the question asks for. Work out the steps first, then put the final "
    "query into a ```sql block."
)
TOOL_NOTE = "Look things up with `query` calls where needed, then return only the final SQL."


def system_message(with_tool: bool, tool_schema: str | None = None) -> str:
    """System text; tool rules only with the tool, call format and schema only where a trainer needs them."""
    if not with_tool:
        return SYSTEM_TEXT
    parts = [SYSTEM_TEXT, TOOL_RULES]
    if tool_schema is not None:
        parts += [TOOL_FORMAT, f"Tool schema: {tool_schema}"]
    return "\n".join(parts)


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"{title}:\n"), body)


def user_message(include_evidence: bool = False, with_tool: bool = False) -> Column:
    """User text: engine, schema, question, instructions, then evidence, dictionary and tool note where present."""
    parts = [
        _section("Engine", F.lit(ENGINE)),
        _section("Schema", F.coalesce("schema_text", F.lit(""))),
        _section("Question", F.col("question")),
        _section("Instructions", F.lit(INSTRUCTIONS)),
    ]
    if include_evidence:
        evidence = strip(F.coalesce("evidence", F.lit("")))
        parts.append(F.when(evidence != "", _section("Evidence", evidence)))
    notes = F.coalesce("data_dictionary_text", F.lit(""))
    parts.append(F.when(notes != "", _section("Data dictionary", notes)))
    if with_tool:
        parts.append(F.lit(TOOL_NOTE))
    return F.concat_ws("\n\n", *parts)


def build_prompts(
    examples: DataFrame,
    contexts: DataFrame,
    include_evidence: bool = False,
    with_tool: bool = False,
    tool_schema: str | None = None,
) -> DataFrame:
    """Add ``messages`` (system and user) to every example.

    Contexts hold one row per database; whether they are broadcast is left to their measured size, and a database
    asked about by most examples is split by the adaptive skew join.
    """

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = F.lit(system_message(with_tool, tool_schema))
    joined = examples.join(contexts, "db_id", "left")
    return joined.withColumn(
        "messages",
        F.array(message("system", system), message("user", user_message(include_evidence, with_tool))),
    ).select(*examples.columns, "messages")
