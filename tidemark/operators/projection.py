"""What a read gets of an understanding: the parts that share a token with its query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens
from .matching import emits_raw


def project_claims(claims: Column, query: Column, passthrough: Column | None = None) -> Column:
    """Claims that share a token with the query; all of them if none does, or if the unit is passed through."""
    asked = tokens(query)
    kept = F.filter(claims, lambda c: F.arrays_overlap(tokens(c), asked))
    whole = F.size(kept) == 0
    return F.when(whole if passthrough is None else whole | passthrough, claims).otherwise(kept)


def project_facts(facts: Column, query: Column, passthrough: Column | None = None) -> Column:
    """Facts whose name or value shares a token with the query, with the same exceptions."""
    asked = tokens(query)
    kept = F.map_filter(facts, lambda k, v: F.arrays_overlap(tokens(F.concat_ws(" ", k, v)), asked))
    whole = F.size(kept) == 0
    return F.when(whole if passthrough is None else whole | passthrough, facts).otherwise(kept)


def context(summary: Column, claims: Column, facts: Column, evidence: Column, query: Column, strategy: Column, escalated: Column, passthrough: Column) -> Column:
    """The context of a result: projected understanding, and raw evidence where the strategy shows it."""
    raw = F.when(emits_raw(strategy, escalated), evidence).otherwise(F.filter(evidence, lambda _: F.lit(False)))
    return F.struct(
        F.struct(
            summary.alias("summary"), project_claims(claims, query, passthrough).alias("claims"),
            project_facts(facts, query, passthrough).alias("facts"),
        ).alias("understanding"),
        raw.alias("raw"),
    )
