"""Token counts by the public WordPunct pattern, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: runs of letters, digits and underscore, or runs of anything else but white space.
#: White space is spelled out, because the JVM's \s has only its ASCII part.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x85\p{Z}]+"


def n_tokens(text: Column) -> Column:
    """Tokens of the whole text; 0 for null and for texts without any."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")
