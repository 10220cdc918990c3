"""Embedding whitening with a weighted multiplicity covariance.

Equal vectors are grouped first, so that each distinct one is multiplied and
whitened once, whatever the number of its copies; the fit weighs it by that number
or by one, and the results are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseloom.llm.common import checkpointed

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**40  # entries of this size and more have no exact place on the lattice
EXACT = 2**53  # whole numbers below it are exact as doubles
SHARE = 1_000  # a vector with more than this part of all rows is a hot one


def lattice(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The key and ``x``, floor(64 c) + 1000000 of each entry c; vectors that are null or hold null, non-finite or huge entries are left out."""
    usable = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.where(F.col(column).isNotNull()).where(usable).select(key, x.alias("x"))


def _block(frame: pd.DataFrame, column: str, dtype: type) -> np.ndarray:
    return np.stack(frame[column].to_list()).astype(dtype) if len(frame) else np.zeros((0, 0), dtype)


def whole_products(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The exact weighted products y'wy of whole numbers, as Python integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest * largest * int(w.sum()) < EXACT:
        z = y.astype(np.float64)
        return ((z * w[:, None]).T @ z).astype(np.int64).astype(object)
    y = y.astype(object)
    return (y * w.astype(object)[:, None]).T @ y


def whole_gemm(distinct: DataFrame, centre: list[int], dims: int) -> dict[tuple[int, int], int]:
    """Weighted products of the ``x`` less ``centre``, exact: one matrix a task, added up by cell."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims), dtype=object)
        for frame in frames:
            for low in range(0, len(frame), 4096):
                part = frame.iloc[low : low + 4096]
                total = total + whole_products(_block(part, "x", np.int64) - np.array(centre), part["w"].to_numpy())
        i, j = np.triu_indices(dims)
        yield pd.DataFrame({"i": i, "j": j, "v": [str(v) for v in total[i, j]]})

    cells = distinct.select("x", "w").mapInPandas(run, "i int, j int, v string")
    rows = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # dims^2 / 2 numbers
    return {(r["i"], r["j"]): int(r["v"]) for r in rows}


def real_gemm(whitened: DataFrame, n: int, size: int) -> np.ndarray:
    """The weighted covariance of ``z``, centred before it is multiplied; divisor ``n``."""
    part = whitened.select("w", F.posexplode("z").alias("i", "v"))
    mean = np.zeros(size)
    for r in part.groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("s")).collect():
        mean[r["i"]] = r["s"] / n

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for frame in frames:
            if len(frame):
                z = _block(frame, "z", np.float64) - mean
                total += (z * frame["w"].to_numpy()[:, None]).T @ z
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    out = np.zeros((size, size))
    cells = whitened.select("z", "w").mapInPandas(run, "i int, j int, v double")
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def principal(products: dict[tuple[int, int], int], rest: list[int], n: int, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (as columns) and eigenvalues by falling value, and the trace, of the covariance.

    ``products`` are sums over vectors centred on whole numbers; what is left of
    the mean, ``rest / n`` (0 to 1), is taken out in whole numbers too, so each
    entry of the covariance is rounded once. An eigenvector's largest entry is
    positive. Eigenvalues that are nothing but rounding are left out.
    """
    dims = len(rest)
    cov = np.zeros((dims, dims))
    for (i, j), g in products.items():
        cov[i, j] = cov[j, i] = (n * g - rest[i] * rest[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    there = values > dims * np.finfo(float).eps * max(values[0], 0.0)
    values, vectors = values[there][:size], vectors[:, there][:, :size]
    if len(values):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return vectors, values, float(np.trace(cov))


def deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n y - rest)^2 of each row, exact; null where a long can't hold it."""
    largest = n * (int(np.abs(y).max(initial=0)) + 1)
    if largest * largest * max(1, y.shape[1]) < 2**63:
        d = n * y - rest
        return (d * d).sum(axis=1).tolist()
    found = [sum((n * int(v) - int(r)) ** 2 for v, r in zip(row, rest)) for row in y]
    return [v if v < 2**63 else None for v in found]


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "count", key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Whitened coordinates of each row: ``key``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``weights`` "count" fits on all rows, "one" on each distinct vector once; ``n``
    is the sum of the weights. Only sums by dimension, one matrix of dims x dims
    cells and the eigenvectors come to the driver.

    Vectors that are null or hold null or non-finite entries (or entries of 2^40 and
    more) are dropped; so are those of another length than most have (of the longest
    such length). Repeated rows and null keys stay rows. Components without variance
    are left out: vectors that are all alike, and an empty table, give no row.
    Other columns are not read.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights are 'count' or 'one'")
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = lattice(vectors, key, column)
    distinct = rows.groupBy("x").agg(F.count("*").alias("c"))
    distinct = checkpointed(distinct.withColumn("w", F.col("c") if weights == "count" else F.lit(1).cast("long")))
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("c").alias("rows"), F.sum("w").alias("n"))
    most = sizes.orderBy(F.desc("rows"), F.desc("d")).first()
    none = spark.createDataFrame(
        [], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if most is None or not most["d"]:
        return none
    dims, n, total = most["d"], most["n"], most["rows"]
    distinct = distinct.where(F.size("x") == dims)
    summed = distinct.select("w", F.posexplode("x").alias("i", "v")).groupBy("i")
    sums = {r["i"]: int(r["s"]) for r in summed.agg(F.sum(F.col("v").cast("decimal(38,0)") * F.col("w")).alias("s")).collect()}
    centre, rest = [sums[i] // n for i in range(dims)], [sums[i] % n for i in range(dims)]
    axes, values, trace = principal(whole_gemm(distinct, centre, dims), rest, n, components)
    if not len(values):
        return none
    project = axes / np.sqrt(values)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 4096):
                part = frame.iloc[low : low + 4096]
                y = _block(part, "x", np.int64) - np.array(centre)
                z = (y - np.array(rest) / n) @ project
                dev = pd.array(deviations(y, n, np.array(rest)), dtype="Int64")
                yield pd.DataFrame({"x": part["x"], "c": part["c"], "w": part["w"], "deviation": dev, "z": list(z)})

    made = "x array<long>, c long, w long, deviation long, z array<double>"
    whitened = checkpointed(distinct.mapInPandas(run, made))
    error = float(np.abs(real_gemm(whitened, n, len(values)) - np.eye(len(values))).max())

    # vectors that many rows share, fewer than SHARE of them, go to the rows; the rows of all others go to their vectors
    hot = F.broadcast(whitened.where(F.col("c") * SHARE > total).select("x", "deviation", "z"))
    rare = whitened.where(F.col("c") * SHARE <= total).select("x", "deviation", "z")
    back = rows.join(hot, "x").union(rows.join(hot, "x", "left_anti").join(rare, "x"))
    each = back.select(key, "deviation", F.posexplode("z").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return each.select(
        key,
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
