"""Scoring functions as column arithmetic over (tf, dl, df, cf, qtf, n_docs, total_len)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"okapi": "okapi", "bm25": "okapi", "l": "l", "bm25l": "l", "plus": "plus", "bm25+": "plus", "bm25plus": "plus", "adpt": "adpt", "adaptive": "adpt", "bm25adpt": "adpt"}
DELTA = {"plus": 1.0, "l": 0.5}


def single(x: float) -> float:
    """x as a 32-bit float holds it."""
    return float(np.float32(x))


@dataclass(frozen=True)
class Scoring:
    """variant: okapi, plus, l, adpt, field (weighted tf, no length norm) or compact.

    compact is Okapi without the floor of IDF, with parameters in full precision; the
    others hold parameters as 32-bit floats.
    """

    variant: str = "okapi"
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    delta: float | None = None

    def __post_init__(self):
        known = {*ALIASES.values(), "field", "compact"}
        name = ALIASES.get(str(self.variant).lower(), str(self.variant).lower())
        if name not in known:
            raise ValueError(f"unknown variant {self.variant!r}; known: {', '.join(sorted(known))}")
        hold = float if name == "compact" else single
        delta = DELTA.get(name, 0.0) if self.delta is None else self.delta
        for field, value in (("variant", name), ("k1", hold(self.k1)), ("b", hold(self.b)), ("epsilon", hold(self.epsilon)), ("delta", hold(delta))):
            object.__setattr__(self, field, value)

    def idf(self) -> Column:
        n, df = F.col("n_docs").cast("double"), F.col("df").cast("double")
        plain = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
        return plain if self.variant == "compact" else F.greatest(F.lit(self.epsilon), plain)

    def term_k1(self) -> Column:
        """k1 of each term: for adpt it grows with the term's mean tf where it occurs."""
        if self.variant != "adpt":
            return F.lit(self.k1)
        return F.lit(self.k1) * F.ln(1.0 + F.col("cf") / F.col("df").cast("double"))

    def part(self, tf: Any, dl: Any, k1: Any, avgdl: Any) -> Any:
        """What a term of weight 1 adds to a document's score, of columns or of numpy arrays."""
        if self.variant == "field":
            return tf * (k1 + 1.0) / (tf + k1)
        norm = (1.0 - self.b) + self.b / avgdl * dl
        if self.variant == "l":
            c = tf / norm
            return (k1 + 1.0) * c / (k1 + c) + self.delta
        core = tf * (k1 + 1.0) / (tf + k1 * norm)
        return core + self.delta if self.variant == "plus" else core

    def avgdl(self) -> Column:
        avgdl = F.col("total_len") / F.col("n_docs").cast("double")
        return F.greatest(F.lit(1.0), avgdl) if self.variant == "compact" else avgdl

    def contribution(self) -> Column:
        """What a term adds to a document's score, for rows that have idf and term_k1 too."""
        tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
        return F.col("qtf") * F.col("idf") * self.part(tf, dl, F.col("term_k1"), self.avgdl())
