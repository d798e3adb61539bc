"""Regular expressions of linear-time engines, on Spark's own."""

import re

from pyspark.sql import Column

from ..errors import IncompatibleValue

#: Java accepts these; the dialect offered here does not.
_EXCLUDED = re.compile(r"(?<!\\)(?:\\\\)*(?:[*+?}]\+|\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<)")


def matches(column: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found anywhere in the text; raises for a bad one."""
    bare = re.sub(r"\[(?:\\.|[^\]\\])*\]", "[]", pattern)  # what stands in a class is literal
    if _EXCLUDED.search(bare):
        raise IncompatibleValue(f"the pattern {pattern!r} uses possessive quantifiers, lookaround or back-references")
    try:
        re.compile(re.sub(r"\\[pP](?:\{\^?\w+\}|\w)|\\z|\\Q.*?\\E|\(\?<", lambda m: "(?P<" if m[0] == "(?<" else "x", pattern))
    except re.error as e:
        raise IncompatibleValue(f"bad pattern {pattern!r}: {e}") from None
    return column.rlike(pattern)
