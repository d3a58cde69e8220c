"""Cleaning, splitting, normalising and gating SQL text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quorumql.functions.text import squeeze, strip

# Fixed values. Answers are only read the same way everywhere if these stay as they are.
THINK_BLOCK = "<think>.*?</think>"
FENCED_BLOCK = r"```(?:sql)?\s*(.*?)```"
READ_ONLY_PREFIXES = ("select", "with", "pragma", "explain")
MUTATING_KEYWORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "replace", "attach", "detach", "vacuum",
    "reindex", "analyze", "begin", "commit", "rollback", "savepoint", "release",
)

# Quoted runs for the tokenizer: possessive, so a long literal cannot exhaust the regex stack; an open quote
# runs to the end of the text.
_SINGLE = r"'[^']*+(?:''[^']*+)*+(?:'|\z)"
_DOUBLE = r'"[^"]*+(?:""[^"]*+)*+(?:"|\z)'
_BACKTICK = r"`[^`]*+(?:`|\z)"
_LINE_COMMENT = r"--[^\n]*"
_BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
TOKEN = rf"""{_LINE_COMMENT}|{_BLOCK_COMMENT}|{_SINGLE}|{_DOUBLE}|{_BACKTICK}|;|[^;'"`/\-]++|[/\-]"""

# Literals to blank out before the keyword scan. The second form of each pair covers a literal that never
# closes: it then ends at the last doubled quote.
_CLOSED_LITERALS = (
    r"""'[^']*+(?:''[^']*+)*+'|'[\s\S]*'(?='[^']*+\z)"""
    r"""|"[^"]*+(?:""[^"]*+)*+"|"[\s\S]*"(?="[^"]*+\z)"""
)

_MARK = "\u0001"
_STATEMENT_END = _MARK + ";"


def strip_think(text: Column) -> Column:
    """Remove closed think blocks; an unclosed one stays."""
    return strip(F.regexp_replace(text, f"(?s){THINK_BLOCK}", ""))


def extract_fence(text: Column) -> Column:
    """Body of the first fenced block, or the text itself when no block is closed."""
    pattern = f"(?isU){FENCED_BLOCK}"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(text)


def split_statements(text: Column) -> Column:
    """Array of the statements in ``text``: comments dropped, split at semicolons outside quotes, blanks dropped.

    Tokens are joined again with a marker where a separating semicolon stood and split at the marker, which is
    linear in the text length. The marker character is escaped first, so no input can fake one.
    """
    escaped = F.replace(text, F.lit(_MARK), F.lit(_MARK + "a"))
    tokens = F.regexp_extract_all(escaped, F.lit(TOKEN), F.lit(0))
    code = F.filter(tokens, lambda t: ~(t.startswith("--") | t.startswith("/*")))
    marked = F.transform(code, lambda t: F.when(t == ";", F.lit(_STATEMENT_END)).otherwise(t))
    pieces = F.transform(
        F.split(F.array_join(marked, ""), _STATEMENT_END),
        lambda s: strip(F.replace(s, F.lit(_MARK + "a"), F.lit(_MARK))),
    )
    # Without a semicolon or comment opener the text is one statement and needs no tokens.
    plain = F.array(strip(text))
    statements = F.when(text.rlike(r";|--|/\*"), pieces).otherwise(plain)
    return F.filter(statements, lambda s: s != "")


def first_statement(statements: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_element_at(statements, F.lit(1)), strip(fallback))


def extract_sql(text: Column) -> Column:
    """The one statement an answer stands for: think blocks off, fence opened, first statement taken."""
    body = extract_fence(strip_think(text))
    return first_statement(split_statements(body), body)


def is_read_only(sql: Column) -> Column:
    """True when the text starts like a query and holds no mutating keyword outside quoted literals.

    Known sharp edges, kept on purpose: the start is a plain prefix test, the function ``REPLACE`` counts as a
    mutating word, and comments and backticks are not skipped.
    """
    body = strip(sql)
    starts = F.lower(body).rlike(rf"\A\(*(?:{'|'.join(READ_ONLY_PREFIXES)})")
    literal_free = F.regexp_replace(body, _CLOSED_LITERALS, "''")
    mutates = literal_free.rlike(rf"(?iU)\b(?:{'|'.join(MUTATING_KEYWORDS)})\b")
    return F.coalesce((body != "") & starts & ~mutates, F.lit(False))


def normalize_sql(sql: Column) -> Column:
    """Comparison form: lower case (literals too), closing semicolons off, blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(strip(sql)), r";+\z", ""))


def exact_match(predicted: Column, gold: Column) -> Column:
    """Predicted text is not empty and equals gold in comparison form."""
    return F.coalesce((predicted != "") & (normalize_sql(predicted) == normalize_sql(gold)), F.lit(False))
