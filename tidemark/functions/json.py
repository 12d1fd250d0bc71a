"""JSON expressions: tolerant parsing, citations, and structured records as understanding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_kind(text: Column) -> Column:
    """object, array, null, other, or text for what is not JSON. Duplicate keys don't matter here."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    parsed = F.try_parse_json(t)
    kind = F.schema_of_variant(parsed)
    return (
        F.when(parsed.isNull(), F.lit("text"))
        .when(F.is_variant_null(parsed), F.lit("null"))
        .when(kind.startswith("OBJECT"), F.lit("object"))
        .when(kind.startswith("ARRAY"), F.lit("array"))
        .otherwise(F.lit("other"))
    )


def object_entries(text: Column) -> Column:
    """Top-level entries of a JSON object as map<string, string>; values keep their JSON text, strings bare."""
    return F.from_json(text, "map<string,string>")


def tolerant_object(text: Column) -> Column:
    """The JSON object in a reply: all of it, else from the first { to the last }; null for anything else.

    A reply that is valid JSON but no object is null: its inside isn't tried.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    inner = F.when((first > 0) & (last > first), F.substring(t, first, last - first + 1))
    kind = json_kind(t)
    return F.when(kind == "object", t).when((kind == "text") & (json_kind(inner) == "object"), inner)


def coerce_citations(used: Column, n: Column) -> Column:
    """Source numbers of a JSON list: whole numbers in range only (no booleans, fractions or strings), each once, in order."""
    items = F.try_variant_get(F.try_parse_json(used), "$", "array<variant>")
    whole = F.filter(items, lambda v: F.schema_of_variant(v) == "BIGINT")
    numbers = F.transform(whole, lambda v: F.try_variant_get(v, "$", "bigint"))
    kept = F.filter(F.array_distinct(numbers), lambda i: (i >= 0) & (i < n))
    return F.coalesce(kept, F.array().cast("array<bigint>"))


def passthrough_facts(texts: Column) -> Column:
    """Entries of all objects among JSON texts, later ones over earlier, as map<string, string>."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def merged(acc: Column, text: Column) -> Column:
        new = F.coalesce(object_entries(text), empty)
        old = F.map_filter(acc, lambda k, _: ~F.map_contains_key(new, k))
        return F.map_concat(old, new)

    objects = F.filter(texts, lambda t: json_kind(t) == "object")
    return F.aggregate(objects, empty, merged)


def passthrough_claims(texts: Column, merge: bool = True) -> Column:
    """What passes as claims: texts that are no objects, and objects too unless they merge into facts."""
    return F.filter(texts, lambda t: json_kind(t) != "object") if merge else texts


def passthrough_summary(texts: Column, summary: str | None = None) -> Column:
    return F.lit(summary) if summary is not None else F.concat(F.size(texts).cast("string"), F.lit(" record(s) from source."))
