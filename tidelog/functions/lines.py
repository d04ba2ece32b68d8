"""Tokenisers of the two command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[ \t\n\x0B\f\r]"


def blank_tokens(line: Column) -> Column:
    """Words between blanks; an empty array for none."""
    return F.filter(F.split(line, f"{_BLANK}+"), lambda x: x != "")


def rest_after(line: Column, key: Column) -> Column:
    """What follows the first occurrence of the key's text anywhere in the line, without leading blanks."""
    return F.regexp_replace(F.substring(line, F.instr(line, key) + F.length(key), F.length(line)), f"^{_BLANK}+", "")


def repl(line: Column) -> Column:
    """command, key, value and error of a line; an error for missing arguments and unknown commands."""
    words = blank_tokens(line)
    name, key, n = F.upper(F.get(words, F.lit(0))), F.get(words, F.lit(1)), F.size(words)
    problem = (
        F.when((name == "SET") & (n < 3), "Error: SET requires a key and a value")
        .when((name == "GET") & (n < 2), "Error: GET requires a key")
        .when((name == "DEL") & (n < 2), "Error: DEL requires a key")
        .when((n > 0) & ~name.isin("SET", "GET", "DEL", "SYNC", "DEBUG", "EXIT", "QUIT"), "Unknown command.")
    )
    value = F.when((name == "SET") & problem.isNull(), rest_after(line, key))
    return F.struct(name.alias("command"), F.when(name.isin("SET", "GET", "DEL") & problem.isNull(), key).alias("key"), value.alias("value"), problem.alias("error"))


#: A word of a client's line: quotes may open anywhere, hold spaces, and need not close.
QUOTED = r'(?:[^ "]|"[^"]*(?:"|$))+'


def quoted_tokens(line: Column) -> Column:
    """Words between spaces; quotes toggle and vanish, so a quoted space joins and an empty pair gives nothing."""
    found = F.regexp_extract_all(line, F.lit(QUOTED), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit('"'), F.lit(""))), lambda x: x != "")
