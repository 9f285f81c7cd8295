"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domweave.llm.common import spread, token_count, unit_hash, written

#: Constraints up to which a Newton step is solved as a dense matrix; beyond, by conjugate gradients over the pairs that occur.
MOST_DENSE = 4000


def _rates_of_one(cells: DataFrame, column: str, given: Mapping | None, power: float) -> DataFrame:
    """The rates for one column: its constraints share no cell, so each rate is its wanted tokens over those it has."""
    held = F.coalesce(F.col("tokens") > 0, F.lit(False))
    if given is None:
        weighed = cells.withColumn("__w", F.pow(F.col("tokens").cast("double"), F.lit(float(power))))
    else:
        kind = cells.schema[column].dataType.simpleString()
        table = cells.sparkSession.createDataFrame([(v, float(w)) for v, w in given.items()], f"__v {kind}, __w double")
        weighed = cells.join(table, F.col(column).eqNullSafe(F.col("__v")), "left")
    n, total, weights = weighed.where(held).agg(F.count("*"), F.sum("tokens"), F.sum("__w")).first()
    if n and not weights:
        raise ValueError(f"no value of {column} has a target weight")
    share = F.lit(float(total) / weights if n else 0.0)
    rate = F.when(F.col("__w") > 0, F.col("__w") * share / F.col("tokens")).otherwise(0.0)
    return weighed.select(column, F.when(held, rate).otherwise(1.0).alias("rate"))


def _sparse_step(i: np.ndarray, j: np.ndarray, x: np.ndarray, gradient: np.ndarray, iterations: int = 2000) -> np.ndarray:
    """The least-squares Newton step of the symmetric matrix with `x` at (i, j) and (j, i), by conjugate gradients (CGLS) scaled by its diagonal."""
    size, off = len(gradient), i != j
    diagonal = np.bincount(i[~off], x[~off], size)
    scale = np.where(diagonal > 0, 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1)), 0)
    x = x * scale[i] * scale[j]

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(i, x * v[j], size) + np.bincount(j[off], (x * v[i])[off], size)

    step, rest = np.zeros(size), gradient * scale
    s = p = times(rest)
    norm = first = s @ s
    for _ in range(iterations):
        if norm <= 1e-24 * first or not norm:
            break
        q = times(p)
        a = norm / (q @ q)
        step, rest = step + a * p, rest - a * q
        s = times(rest)
        norm, old = s @ s, norm
        p = s + norm / old * p
    return step * scale


def solve_rates(cells: DataFrame, columns: Sequence[str], targets: Sequence[Mapping | None], power: float = 0.5, iterations: int = 60, tolerance: float = 1e-11) -> DataFrame:
    """(columns..., rate): the rate of the documents of each cell, exponentially tilted.

    `cells` has, for each combination of the columns' values, `tokens`, the
    sufficient statistic of its documents: a document's rate depends only on
    its cell. For a column without targets each value's weight is its tokens
    to the `power`. Among all rates with the wanted tokens of every value, the
    one nearest to 1 in entropy, weighted by tokens, is exp(sum of the values'
    multipliers); the multipliers minimise the convex dual
    sum(tokens * rate) - sum(multiplier * target). For one column that is solved
    per value, without the driver. For more, every Newton iteration is one
    aggregation over the cells, giving the gradient and the Hessian: the driver
    holds a number for each value, and for each pair of values that share a cell.
    """
    if len(columns) == 1:
        return _rates_of_one(cells, columns[0], targets[0], power)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    index: list[tuple[int, object]] = []
    wanted: list[float] = []
    for k, column in enumerate(columns):
        held = [(r[0], r[1]) for r in cells.groupBy(column).agg(F.sum("tokens").alias("t")).where("t > 0").collect()]
        held.sort(key=lambda x: (x[0] is not None, str(x[0])))
        given = targets[k]
        weight = [float(given.get(v, 0)) if given is not None else float(t) ** power for v, t in held]
        if held and not sum(weight):
            raise ValueError(f"no value of {column} has a target weight")
        index += [(k, v) for v, _ in held]
        wanted += [total * w / sum(weight) for w in weight]
    spark, schema = cells.sparkSession, cells.schema
    multiplier, b = np.zeros(len(index)), np.array(wanted)
    live = b > 0
    multiplier[~live] = -np.inf

    def tilted() -> DataFrame:
        out = cells
        for k, column in enumerate(columns):
            kind = schema[column].dataType.simpleString()
            rows = [(i, v, float(multiplier[i])) for i, (c, v) in enumerate(index) if c == k]
            table = spark.createDataFrame(rows, f"__i{k} int, __v{k} {kind}, __m{k} double")
            out = out.join(table, F.col(column).eqNullSafe(F.col(f"__v{k}")), "left")
        tilt = sum((F.coalesce(F.col(f"__m{k}"), F.lit(0.0)) for k in range(len(columns))), F.lit(0.0))
        return out.withColumn("rate", F.exp(tilt))

    def dual() -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The dual's value, its gradient, and the Hessian's entries (i, j, x), of one aggregation over the cells."""
        pairs = F.array(*[F.struct(F.least(f"__i{a}", f"__i{c}").alias("i"), F.greatest(f"__i{a}", f"__i{c}").alias("j")) for a, c in combinations_with_replacement(range(len(columns)), 2)])
        sums = tilted().where("tokens > 0").select(F.explode(pairs).alias("p"), (F.col("tokens") * F.col("rate")).alias("x")).groupBy("p.i", "p.j").agg(F.sum("x").alias("x")).collect()
        i, j, x = np.array([r.i for r in sums], dtype=int), np.array([r.j for r in sums], dtype=int), np.array([r.x for r in sums], dtype=float)
        held = np.bincount(i[i == j], x[i == j], len(index))
        value = held.sum() / len(columns) - multiplier[live] @ b[live]
        return value, held - b, i, j, x

    value, gradient, i, j, x = dual() if live.any() else (0.0, np.zeros(len(index)), *[np.zeros(0, dtype=int)] * 3)
    for _ in range(iterations):
        if not live.any() or np.abs(gradient[live]).max() <= tolerance * total:
            break
        if len(index) <= MOST_DENSE:
            hessian = np.zeros((len(index), len(index)))
            hessian[i, j] = hessian[j, i] = x
            step = np.linalg.lstsq(hessian[np.ix_(live, live)] / total, gradient[live] / total, rcond=1e-12)[0]
        else:
            place, both = np.cumsum(live) - 1, live[i] & live[j]
            step = _sparse_step(place[i[both]], place[j[both]], x[both] / total, gradient[live] / total)
        step = np.clip(step, -2, 2)
        start, before, promised = multiplier[live].copy(), value, gradient[live] @ step
        for halved in range(12):
            multiplier[live] = start - step / 2**halved
            value, gradient, i, j, x = dual()
            if value <= before - 1e-4 * promised / 2**halved + 1e-12 * total:
                break
    else:
        if live.any() and np.abs(gradient[live]).max() > 1e-6 * total:
            warnings.warn("the token constraints contradict each other, or the Newton iterations don't converge", RuntimeWarning, stacklevel=2)
    return tilted().select(*columns, "rate")


def mix_sources(docs: DataFrame, weights: Mapping | None = None, power: float = 0.5, balance: Mapping[str, Mapping | None] | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of every document.

    `weights` are the sources' shares of the tokens after mixing, up to a
    factor; without them a source's weight is its token count to the `power`.
    `balance` adds token constraints on other columns, of any name, in the same
    way. The number of tokens stays as it is. The fraction of a rate becomes
    one more copy for the documents whose `unit_hash` of doc_id is below it, so
    that a document's copies don't depend on where or when its row is read.

    Defined results: null or empty text has 0 tokens and takes its source's
    rate, 1 where a source has no tokens; very long texts are counted whole; a
    null source is a source of its own; a source without weight in `weights`
    gets rate 0; repeated rows are counted and drawn alike; where constraints
    contradict each other the rates are those of the last Newton iteration and
    a warning says so; an empty table gives an empty table. Other columns are
    not read, so their names can't clash.
    """
    names = ["source", *(balance or {})]
    columns = [f"k{n}" for n in range(len(names))]
    counted = docs.select("doc_id", *[F.col(f"`{c}`").alias(k) for c, k in zip(names, columns)], token_count("text").alias("n_tokens"))
    counted = written(counted, "tokens")
    cells = written(counted.groupBy(*columns).agg(F.sum("n_tokens").alias("tokens")), "cells")
    rates = solve_rates(cells, columns, [weights, *(balance or {}).values()], power)
    on = [F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    joined = counted.alias("d").join(rates.alias("r"), on, "left")
    whole = F.floor("rate")
    copies = whole + F.when(F.col("u") < F.col("rate") - whole, 1).otherwise(0)
    return joined.select("d.doc_id", F.col("d.k0").alias("source"), "n_tokens", F.col("rate"), unit_hash("d.doc_id").alias("u")).select(
        "doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), copies.cast("long").alias("copies")
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Copies of every document that flatten the token shares of sources and of languages to the square root, both at once."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
    return mix_sources(docs, balance={"lang": None})


def _raking(rounds: int = 60) -> str:
    """SQL that scales the cells' rates to the sources' tokens and to the languages' by turns, which has the dual's optimum as its limit."""
    steps = ["r0 AS MATERIALIZED (SELECT source, lang, t, 1.0::DOUBLE AS rate FROM c)"]
    for n in range(rounds):
        column, target = ("source", "ts") if n % 2 == 0 else ("lang", "tl")
        steps.append(
            f"r{n + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.t, CASE WHEN m.now > 0 THEN r.rate * x.want / m.now ELSE r.rate END AS rate FROM r{n} r "
            f"JOIN (SELECT {column}, sum(t * rate) AS now FROM r{n} GROUP BY {column}) m ON r.{column} IS NOT DISTINCT FROM m.{column} "
            f"JOIN {target} x ON r.{column} IS NOT DISTINCT FROM x.{column})"
        )
    return ",\n".join(steps)


SQL = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n_tokens FROM documents),
c AS MATERIALIZED (SELECT source, lang, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY source, lang),
ts AS MATERIALIZED (SELECT source, sqrt(sum(t)) * (SELECT sum(t) FROM c) / (SELECT sum(sqrt(x)) FROM (SELECT sum(t) AS x FROM c GROUP BY source)) AS want FROM c GROUP BY source),
tl AS MATERIALIZED (SELECT lang, sqrt(sum(t)) * (SELECT sum(t) FROM c) / (SELECT sum(sqrt(x)) FROM (SELECT sum(t) AS x FROM c GROUP BY lang)) AS want FROM c GROUP BY lang),
{_raking()},
u AS (SELECT d.*, rate, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN r60 r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, round(rate, 6) AS rate,
  (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM u
"""
