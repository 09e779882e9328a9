"""Reading free-form ISO-like times as UTC instants, without a session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a readable time looks like once its separators are put in and its fraction is dropped.
SHAPE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})(?:Z|[+-]\d{2}(?::\d{2})?)$"

#: The spelling of most times that name their zone.
USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$"


def epoch_seconds(text: Column) -> Column:
    """Whole seconds since 1970 in UTC; null when the text is missing or names no real instant.

    A time without a zone is UTC. ``T`` may be lower case or a blank, and blanks
    around the text are ignored. A time without seconds has second 0. Every step
    uses the one before it once, so that generated code stays small; the usual
    spelling needs none of them.
    """
    usual = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), F.concat(text, F.lit("Z"))).when(text.rlike(USUAL), text)
    value = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    value = F.regexp_replace(value, r"^(\d{4})-?(\d{2})-?(\d{2})[T ](\d{2}):?(\d{2})", "$1-$2-$3T$4:$5")
    value = F.regexp_replace(value, r"(T\d{2}:\d{2}):?(\d{2})(?:[.,]\d*)?", "$1:$2")
    value = F.regexp_replace(value, r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    value = F.regexp_replace(value, r"(T[0-9:]+)$", "$1Z")
    value = F.regexp_replace(value, r"(T\d{2}:\d{2})(?=Z|[+-])", "$1:00")
    return F.unix_seconds(F.coalesce(usual, F.regexp_extract(value, SHAPE, 0)).try_cast("timestamp"))


def hour_label(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH`` of an instant in UTC."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    hour = F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("string")
    return F.concat(day.cast("string"), F.lit("T"), F.lpad(hour, 2, "0"))


#: The same reading for the checking SQL, of the column {c}.
_SQL_FIELD = r"try_cast(nullif(regexp_extract(upper(trim({c}, E' \t\n\r')), '^(\d{{4}})-?(\d{{2}})-?(\d{{2}})[T ](\d{{2}}):?(\d{{2}}):?(\d{{2}})?(?:[.,]\d*)?(Z|([+-]\d{{2}}):?(\d{{2}}))?$', %s), '') AS %s)"
SQL_EPOCH = "(CASE WHEN %s < 24 AND %s < 60 AND coalesce(%s, 0) < 60 THEN date_diff('second', TIMESTAMP '1970-01-01', CAST(%s AS TIMESTAMP)) + %s * 3600 + %s * 60 + coalesce(%s, 0) - coalesce(%s * 3600 + (CASE WHEN %s < 0 THEN -1 ELSE 1 END) * %s * 60, 0) END)" % (
    _SQL_FIELD % (4, "INT"),
    _SQL_FIELD % (5, "INT"),
    _SQL_FIELD % (6, "INT"),
    r"try_cast(regexp_replace(regexp_extract(trim({c}, E' \t\n\r'), '^\d{{4}}-?\d{{2}}-?\d{{2}}'), '^(\d{{4}})-?(\d{{2}})-?(\d{{2}})$', '\1-\2-\3') AS DATE)",
    _SQL_FIELD % (4, "INT"),
    _SQL_FIELD % (5, "INT"),
    _SQL_FIELD % (6, "INT"),
    _SQL_FIELD % (8, "INT"),
    _SQL_FIELD % (8, "DOUBLE"),
    _SQL_FIELD % (9, "INT"),
)
