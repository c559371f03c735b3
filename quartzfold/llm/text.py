"""Token counts of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as Unicode has it, and the controls that count as separators.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A run of letters, digits and underscores, or a run of other marks. Written
#: out so that Java, RE2 and Python agree on what a letter is.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def token_count(text: Column) -> Column:
    """Number of word-punctuation tokens; 0 for a null or an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")
