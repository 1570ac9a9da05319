"""Scrubbing of personal data, credentials, error texts and chat turns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# What is masked, in this order.
SCRUB = [
    (r"(?i)(?:bearer\s+[a-zA-Z0-9_\-\.]{20,}|(?:sk|pk|api|key)[-_][a-zA-Z0-9]{16,})", "[API_KEY]"),
    (r"""(?i)((?:password|passwd|pwd|secret|key)\s*=\s*)[^\s;&,'"]+""", "$1[PASSWORD]"),
    (r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\b", "[EMAIL]"),
    (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN]"),
    (r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b", "[CC]"),
    (r"\b(?:\+?[0-9]{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", "[PHONE]"),
]
SQL_MARKER = "SQL Query Executed:"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scrub(text: Column | str) -> Column:
    out = F.coalesce(_col(text), F.lit(""))
    for pattern, to in SCRUB:
        out = F.regexp_replace(out, pattern, to)
    return out


def normalise_error(error: Column | str, most: int = 500) -> Column:
    """One line without traceback, credentials and paths."""
    e = F.trim(_col(error))
    e = F.trim(F.regexp_replace(e, r"(?s)Traceback \(most recent call last\):.*?(?=[a-zA-Z0-9_]+Error:|\z)", ""))
    e = F.regexp_replace(e, r"(?i)((?:password|passwd|pwd|secret|key)=)[^\s;&,]+", "$1***")
    e = F.regexp_replace(e, r"(?:/[a-zA-Z0-9_.\-]+)+", "[path]")
    line = F.array_join(F.filter(F.transform(F.split(e, r"\r?\n"), strip), lambda x: x != ""), " | ")
    line = F.when(line == "", "unknown_error").otherwise(line)
    return F.coalesce(F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line), F.lit("unknown_error"))


def sanitise_turn(content: Column | str, model: Column | None = None, most_sql: int = 400) -> Column:
    """An assistant turn without database rows: the statement stays, text before it only if a model wrote it."""
    t = strip(F.coalesce(_col(content), F.lit("")))
    at = F.instr(t, SQL_MARKER)
    sql = F.trim(F.regexp_extract(t, r"(?s)SQL Query Executed:\s*`(.*?)`", 1))
    sql = F.when(F.length(sql) > most_sql, F.concat(F.rtrim(F.substring(sql, 1, most_sql)), F.lit("..."))).otherwise(sql)
    note = F.when(sql != "", F.concat(F.lit("[Database result omitted. SQL executed: "), sql, F.lit("]"))).otherwise("[A live database result was shown to the user.]")
    by_code = F.lit(True) if model is None else F.coalesce((model == "") | (model == "sql/direct") | model.startswith("fast_path/"), F.lit(True))
    head = F.when(by_code, "").otherwise(strip(F.substring(t, F.lit(1), at - 1)))
    return F.when(at == 0, t).when(head == "", note).otherwise(F.concat(head, F.lit("\n\n"), note))


def safe_basename(path: Column | str) -> Column:
    """The last part of a path in either style; null if nothing safe is left."""
    base = F.regexp_replace(F.element_at(F.split(_col(path), r"[/\\]"), -1), r"[\x00-\x1F]", "")
    return F.when(base.isin("", ".", ".."), None).otherwise(base)


def inside(path: Column | str, root: str) -> Column:
    """Whether a path stays below ``root``, without any step up."""
    p = _col(path)
    return p.startswith(root.rstrip("/") + "/") & ~p.rlike(r"(^|/)\.\.(/|$)")
