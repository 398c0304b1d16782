"""Hyperparameter sweeps and many small models."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Spark's limit on the depth of a tree, and models fitted at the same time.
DEEPEST, PARALLEL = 30, 4


def trial_points(grid: Mapping[str, Sequence]) -> list[dict]:
    """Cartesian product with keys in sorted order, the last one fastest."""
    keys = sorted(grid)
    return [dict(zip(keys, values)) for values in itertools.product(*(grid[k] for k in keys))]


def fold_of(id_col: str, cv: int):
    """Fold of a row, a function of its id only."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col)), F.lit(cv)).cast("int")


def _depth(params: Mapping) -> int:
    """Depth of the trees; unlimited ones grow to the deepest that Spark allows."""
    depth = params.get("max_depth")
    if depth is None:
        return DEEPEST
    if int(depth) > DEEPEST:
        raise ValueError(f"max_depth {depth} is beyond Spark's limit of {DEEPEST}")
    return int(depth)


def _texts(params: Mapping) -> dict[str, str]:
    """The parameters as fitted: an unlimited depth shows the one that was used."""
    out = {k: str(v) for k, v in params.items()}
    if params.get("model") == "rf" and "max_depth" in params:
        out["max_depth"] = str(_depth(params))
    return out


def _estimator(params: Mapping, rows: int):
    kind = params.get("model", "logreg")
    if kind == "logreg":
        c = float(params.get("C", 1.0))
        return LogisticRegression(
            featuresCol="vector",
            maxIter=500,
            # The penalty is divided by the number of rows here, and by C there.
            regParam=1.0 / (c * rows),
            standardization=False,
        )
    if kind == "rf":
        depth = _depth(params)
        return RandomForestClassifier(
            featuresCol="vector",
            numTrees=int(params.get("n_estimators", 50)),
            maxDepth=depth,
            seed=0,
        )
    raise ValueError(f"unsupported model {kind!r} (logreg or rf)")


def cv_scores(predictions: DataFrame) -> DataFrame:
    """Accuracy per trial: mean over folds, the folds themselves, rows scored."""
    folds = predictions.groupBy("trial", "fold").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("score"),
        F.count(F.lit(1)).alias("rows"),
    )
    return folds.groupBy("trial").agg(
        F.avg("score").alias("accuracy_mean"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]
        ).alias("accuracy_folds"),
        F.sum("rows").alias("n_samples"),
    )


def sweep(
    df: DataFrame, grid: Mapping[str, Sequence] | Sequence[Mapping], cv: int = 3, id_col: str = "id"
) -> DataFrame:
    """Cross-validated accuracy of every grid point: ``trial, params, accuracy_mean,
    accuracy_folds, n_samples``, best first on equal footing by trial number.

    ``df``: ``id, features ARRAY<DOUBLE>, label``. Each model is fitted by Spark over
    the whole training fold.
    """
    trials = trial_points(grid) if isinstance(grid, Mapping) else [dict(t) for t in grid]
    data = df.select(
        array_to_vector("features").alias("vector"),
        F.col("label").cast("double").alias("label"),
        fold_of(id_col, cv).alias("fold"),
    ).persist()
    try:
        sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
        total = sum(sizes.values())

        def fitted(job: tuple[int, int]) -> DataFrame:
            fold, i = job
            model = _estimator(trials[i], total - sizes.get(fold, 0)).fit(data.filter(F.col("fold") != fold))
            held_out = model.transform(data.filter(F.col("fold") == fold))
            return held_out.select(F.lit(i).alias("trial"), "fold", "label", "prediction")

        with ThreadPool(PARALLEL) as pool:  # the threads only wait for Spark
            parts = pool.map(fitted, itertools.product(range(cv), range(len(trials))))
        predictions = parts[0]
        for p in parts[1:]:
            predictions = predictions.unionByName(p)
        scores = cv_scores(predictions).collect()
    finally:
        data.unpersist()
    texts = {i: _texts(t) for i, t in enumerate(trials)}
    return df.sparkSession.createDataFrame(
        [
            (r["trial"], texts[r["trial"]], r["accuracy_mean"], r["accuracy_folds"], r["n_samples"])
            for r in scores
        ],
        "trial int, params map<string,string>, accuracy_mean double, "
        "accuracy_folds array<double>, n_samples bigint",
    )


def fit_many(
    df: DataFrame,
    group: str,
    fn: Callable[[pd.DataFrame], dict],
    schema: str,
) -> DataFrame:
    """One small model per group: ``group, error`` and the columns of ``schema``.

    ``fn`` gets a group's rows and returns one value per column. A group it fails
    on becomes a row with ``error`` set. A group is one task and must fit in its memory:
    this is for many small groups, and larger ones belong in :func:`sweep`. A task reads
    its groups one after another out of common batches, which a handful of rows a group
    fill, and gives back a batch of results for each batch read.
    """
    fields = T.StructType.fromDDL(schema).fields
    out = T.StructType([df.schema[group], T.StructField("error", T.StringType()), *fields])
    names = [f.name for f in fields]
    columns, at = df.columns, df.columns.index(group)
    timed = [isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)) for f in out]
    # Pandas makes other types of integers and booleans with nulls: that is for a group to
    # decide, not for the batch it is in, so they travel without nulls beside their nulls.
    whole = [i for i, f in enumerate(df.schema) if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
    as_object = {i for i in whole if isinstance(df.schema[i].dataType, T.BooleanType)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def fitted(rows: pd.DataFrame, gone: np.ndarray, key) -> list:
            rows.index = pd.RangeIndex(len(rows))
            if gone.any():
                rows = rows.copy()
                for j, i in enumerate(whole):
                    if gone[:, j].any():
                        values = rows.iloc[:, i].astype(object if i in as_object else np.float64)
                        rows.isetitem(i, values.mask(gone[:, j], None if i in as_object else np.nan))
            row = {group: key, "error": None, **dict.fromkeys(names)}
            try:
                row.update(fn(rows))
            except Exception as exc:  # noqa: BLE001 - one bad group must not stop the others
                row["error"] = f"{type(exc).__name__}: {exc}"
            return [row[f.name] for f in out.fields]

        def column(values: list, time: bool) -> pd.Series:
            alike = len({type(v) for v in values}) == 1  # then as pandas has a single one
            return pd.Series(values, dtype=None if alike or time else object)

        def frame(done: list[list]) -> pd.DataFrame:
            return pd.DataFrame({f.name: column([r[i] for r in done], timed[i]) for i, f in enumerate(out.fields)})

        def joined(pieces: list[tuple]) -> list:
            key = pieces[0][2]
            return fitted(pd.concat([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]), key)

        open_: list[tuple] = []  # pieces of the group that may go on in the next batch
        for batch in batches:
            first = np.flatnonzero(batch.iloc[:, -1].to_numpy())
            rows, gone = batch.iloc[:, : len(columns)], batch.iloc[:, len(columns) : -1].to_numpy(dtype=bool)
            rows.columns = columns
            keys, null_key = rows.iloc[:, at].array, gone[:, whole.index(at)] if at in whole else None
            done, ends = [], [*first.tolist(), len(batch)]
            key = lambda a: None if null_key is not None and null_key[a] else keys[a]  # noqa: B023, E731
            with pd.option_context("mode.chained_assignment", None):  # rows of a batch belong to one group
                if ends[0]:
                    open_.append((rows.iloc[: ends[0]].copy(), gone[: ends[0]], open_[0][2]))
                if len(first):
                    if open_:
                        done.append(joined(open_))
                    done += [fitted(rows.iloc[a:b], gone[a:b], key(a)) for a, b in itertools.pairwise(ends[:-1])]
                    open_ = [(rows.iloc[ends[-2] :].copy(), gone[ends[-2] :], key(ends[-2]))]
            if done:
                yield frame(done)
        if open_:
            yield frame([joined(open_)])

    own = df.toDF(*[f"c{i}" for i in range(len(columns))])
    key = own.columns[at]
    zero = lambda i: F.lit(0).cast(df.schema[i].dataType)
    values = [F.coalesce(c, zero(i)).alias(c) if i in whole else F.col(c) for i, c in enumerate(own.columns)]
    nulls = [F.col(f"c{i}").isNull().alias(f"n{i}") for i in whole]
    first = F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1
    flagged = own.withColumn("first", first)
    return flagged.select(*values, *nulls, "first").mapInPandas(run, out)
