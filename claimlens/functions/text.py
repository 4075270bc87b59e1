"""Text functions (F4, F5): tokenisation and lengths, JVM-side.

The reference tokenises with a pretrained WordPiece model that is not
available here; the default tokenizer is a Unicode word split that any engine
can reproduce. Whole texts are tokenised, never a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SPLIT = r"[^\p{L}\p{N}]+"


def tokenize(text: Column, lower: bool = True) -> Column:
    """Words of letters and digits; empty pieces removed."""
    t = F.lower(text) if lower else text
    return F.filter(F.split(t, WORD_SPLIT), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(tokenize(text, lower=False))
