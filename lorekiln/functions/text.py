"""Text predicates and normal forms shared by the operators (JVM expressions unless said otherwise)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-ins for a value nobody entered, in the form of ``_bare`` (lower case, only letters, digits and single spaces).
STAND_INS = (
    "tbd", "tba", "to be added", "to be determined", "to be done", "to be defined", "todo", "to do", "n a", "na", "nan", "none", "none given",
    "not given", "not available", "not applicable", "null", "nil", "blank", "empty", "unknown", "unspecified",
    "undefined", "no value", "no data", "missing", "not specified", "not provided", "placeholder", "xxx",
)


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def is_missing(c: Column) -> Column:
    """True where a text is null, holds no letter or digit, or is only a stand-in."""
    return c.isNull() | ~c.rlike(r"[\p{L}\p{N}]") | _bare(c).isin(*STAND_INS)


_NOT_WORD = re.compile(r"[^\w]|_")
_BARE = re.compile(r"[\W_]+")


def missing_py(t: str | None) -> bool:
    """``is_missing`` for one Python string."""
    if t is None:
        return True
    b = _BARE.sub(" ", t.lower()).strip()
    return not b or b in STAND_INS


def identity_form(t: str | None) -> str:
    """Letters and digits of a text in one case and character form: texts that differ only in case, spacing,
    punctuation or character form share it. Empty for null."""
    if not t:
        return ""
    return _NOT_WORD.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()))
