"""Which words a score rests on, as a table.

Per real evidence both sides' token weights are joined to the words of their texts, a text at a time:
no token is a row before the result. The encoder's special first token is cut; where a text has more words
than weights (an encoder that cuts texts) or the other way round, the shorter side ends it. Levels are W5's
bins over what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(name: str, words: str, weights: str, levels: tuple[int, ...]) -> Column:
    """An array with a struct for each word: side, tok_pos, token, weight, level_<n> for each n."""
    w = F.slice(weights, 2, F.size(weights))
    n = F.least(F.size(words), F.size(w))
    both = F.arrays_zip(F.slice(words, 1, n).alias("token"), F.slice(w, 1, n).alias("weight"))
    ends = F.struct(F.array_min(both["weight"]).alias("least"), F.array_max(both["weight"]).alias("most"))

    def each(b: Column) -> Column:
        span = b["most"] - b["least"]
        scaled = lambda x: F.when(span == 0, 0.0).otherwise((x - b["least"]) / span * 0.99)
        return F.transform(both, lambda z, i: F.struct(
            F.lit(name).alias("side"), (i + 1).alias("tok_pos"), z["token"].alias("token"), z["weight"].alias("weight"),
            *(F.floor(scaled(z["weight"]) * k).cast("int").alias(f"level_{k}") for k in levels)))

    # A lambda's variable: the ends are worked out once a text, not once a word.
    return F.flatten(F.transform(F.array(ends), each))


def explain_tokens(maps: DataFrame, words: DataFrame, levels: tuple[int, ...] = (6, 8)) -> DataFrame:
    """(claim_id, evi_pos, side, tok_pos, token, weight, level_6, level_8) of real evidences.

    ``maps`` is ``scoring.pair_slots`` with maps; ``words`` has claim_id, evi_pos (-1: the claim's text)
    and the text's words, without the special token."""
    claim = words.filter("evi_pos < 0").select("claim_id", F.col("words").alias("cwords"))
    evidence = words.filter("evi_pos >= 0").select("claim_id", "evi_pos", F.col("words").alias("ewords"))
    rows = maps.select("claim_id", "evi_pos", "claim_map", "evidence_map").join(evidence, ["claim_id", "evi_pos"]).join(claim, "claim_id")
    both = F.concat(_side("claim", "cwords", "claim_map", levels), _side("evidence", "ewords", "evidence_map", levels))
    return rows.select("claim_id", "evi_pos", F.inline(both))
