"""What can go wrong, as exceptions; errors in rows are columns instead, which `detail` takes apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class WeaveError(Exception):
    """Any error of the engine."""


class SelectorError(WeaveError):
    """A selector that can't be compiled."""


class SchemaError(WeaveError):
    """A field or schema that isn't defined."""


class MatchError(WeaveError):
    """No element is like the stored fingerprint."""


class ExportError(WeaveError):
    """Nothing to write, or nowhere to write it to."""


class ConfigError(WeaveError):
    """A setting that isn't allowed."""


#: How the message of a row's error begins: its code, its stage, whether other data or settings may mend it, and how.
KINDS = (
    ("Required field ", "REQUIRED_FIELD", "validate", True, "give the field a default, or select it elsewhere"),
    ("Field ", "FIELD_TYPE", "validate", True, "normalise the value with a rule, or take another type"),
    ("no fingerprint of ", "NO_FINGERPRINT", "match", True, "capture fingerprints while the selector still selects"),
    ("nothing is like ", "NO_MATCH", "match", True, "lower the threshold, or mend the selector"),
    ("Content-Length ", "RECORD_LENGTH", "read", False, "the record's bytes are kept as they stand"),
)


def detail(error: str | Column) -> Column:
    """A column of errors as structs (code, stage, recoverable, suggestion, message); null where there is none."""
    text = F.col(error) if isinstance(error, str) else error
    made = lambda code, stage, mends, how: F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"), F.lit(mends).alias("recoverable"), F.lit(how).alias("suggestion"), text.alias("message"))
    found = made("OTHER", "extract", False, "")
    for begins, *rest in reversed(KINDS):
        found = F.when(text.startswith(begins), made(*rest)).otherwise(found)
    return F.when(text.isNotNull(), found)
