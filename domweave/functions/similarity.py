"""How like two elements are: scores between 0 and 1, and their weighted mean."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"text": 2.0, "class": 1.5, "ancestor": 1.5, "attribute": 1.0, "tag": 1.0, "depth": 0.5}


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 for two empty ones."""

    def of(v: Column) -> Column:
        union = F.size(F.array_union(v["a"], v["b"]))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(v["a"], v["b"])) / union)

    # so that each side is computed once
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), F.lit(0))


def attribute_similarity(a: Column, b: Column) -> Column:
    """Of two maps as sets of pairs."""
    return jaccard(F.map_entries(a), F.map_entries(b))


def depth_score(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.abs(a.cast("double") - b.cast("double")) + 1.0)


def tag_score(a: Column, b: Column) -> Column:
    return (F.lower(a) == F.lower(b)).cast("double")


def jaro_winkler(a: str, b: str) -> float:
    """Over characters; up to four common first ones raise a Jaro score above 0.7. 1 for two empty strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    taken, used = bytearray(len(b)), {c: 0 for c in places}
    first = []
    for i, c in enumerate(a):
        at = places.get(c)
        if at is None:
            continue
        # the places of a character are taken in order: those before the window never come back
        k = used[c]
        while k < len(at) and at[k] < i - reach:
            k += 1
        if k < len(at) and at[k] <= i + reach:
            taken[at[k]] = 1
            first.append(c)
            k += 1
        used[c] = k
    m = len(first)
    if not m:
        return 0.0
    second = (b[j] for j in range(len(b)) if taken[j])
    moved = sum(x != y for x, y in zip(first, second)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        jaro += 0.1 * prefix * (1 - jaro)
    return jaro


def most_alike(a: int, b: int) -> float:
    """The greatest `jaro_winkler` of two strings of these lengths."""
    if not a or not b:
        return float(a == b)
    jaro = (min(a, b) / a + min(a, b) / b + 1) / 3
    return jaro + 0.4 * (1 - jaro) if jaro > 0.7 else jaro


def text_similarity(a: Column, b: Column) -> Column:
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    return F.arrow_udf(score, "double")(a, b)


def ancestor_score(path: list[dict], stored: list[dict]) -> float:
    """Of two chains from the parent up: each takes of the other's unused elements with its tag the one most like it."""
    if not path or not stored:
        return float(not path and not stored)
    free, total = list(range(len(stored))), 0.0
    for mine in path:
        best, chosen = 0.0, None
        for k in free:
            other = stored[k]
            if mine["tag"] != other["tag"]:
                continue
            score = 0.4 + 0.3 * (bool(mine["id"]) and mine["id"] == other["id"]) + 0.3 * (bool(mine["class"]) and mine["class"] == other["class"])
            if not (mine["id"] or other["id"] or mine["class"] or other["class"]):
                score += 0.6
            if score > best:
                best, chosen = score, k
        if chosen is not None:
            free.remove(chosen)
            total += best
    return total / max(len(path), len(stored))


def ancestor_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of structs (tag, class, id, depth)."""

    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else ancestor_score(x, y) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    return F.arrow_udf(score, "double")(a, b)


def composite(scores: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """The mean of the scores named in `WEIGHTS`, weighted by them; `weights` overrides some."""
    w = WEIGHTS | dict(weights or {})
    total = sum((F.lit(w[k]) * scores[k] for k in WEIGHTS), F.lit(0.0))
    return total / F.lit(sum(w[k] for k in WEIGHTS))
