"""Small text expressions shared by the operators; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind (the letters of Unicode's White_Space and the zero-width ones).
_SPACE = r"[\p{IsWhite_Space}\x{200B}\x{FEFF}]+"


def strip_unicode(column: Column) -> Column:
    """Without surrounding white space of any kind; null stays null."""
    return F.regexp_replace(column, f"^{_SPACE}|{_SPACE}$", "")


def key_form(column: Column) -> Column:
    """The form in which keys are compared: stripped, lower case; null when blank."""
    stripped = F.lower(strip_unicode(column))
    return F.when(stripped != "", stripped)
