"""Scanning texts line by line for what must not be released."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.sanitize import CREDENTIALS, PERSONAL

#: Rules a line can show by itself (an object of a cookie jar needs its fields looked at, a private key shows in its first line).
RULES = [(label, pattern) for label, pattern in [*CREDENTIALS, *PERSONAL] if label not in ("PRIVATE_KEY", "COOKIE_JAR")] + [("PRIVATE_KEY", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")]


def scan(texts: DataFrame, key: str, text: Column, rules: list[tuple[str, str]] | None = None, denied: list[str] | None = None) -> DataFrame:
    """key, line, rule of every line that matches a rule, or holds a denied term (named by its place in the list, never echoed).

    The text itself isn't in the result.  Null texts have no lines.
    """
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("_at", "_line"))
    tests = [F.when(F.col("_line").rlike(pattern), F.lit(label)) for label, pattern in (RULES if rules is None else rules)]
    tests += [F.when(F.lower("_line").contains(term.lower()), F.lit(f"DENIED_{n}")) for n, term in enumerate(denied or [], 1)]
    found = lines.select(key, (F.col("_at") + 1).alias("line"), F.array_distinct(F.array_compact(F.array(*tests))).alias("rules"))
    return found.select(key, "line", F.explode("rules").alias("rule"))
