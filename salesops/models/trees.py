"""Boosted trees on lag and calendar features, an ensemble per key, in two configurations.

A grows best first with at least 20 rows a leaf and no penalty, B level by level with second-order gains, a
penalty on leaf values, and rows and columns drawn anew for every tree. Both are fitted by
``boosting.tree_rows`` in one pass over the rows in order of key. The model is a table, one row per key and tree
with its nodes as flat arrays, beside one row per key with the mean that the trees start from.
``mean_below`` keeps what configuration A does on short series: below 40 training rows a leaf minimum of 20
allows no split, and the model is the key's mean. It is stored with every key, 0 for never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesops.functions.params import check_range
from salesops.models.boosting import Forest, TreeParams, tree_rows
from salesops.operators.series import by_key, dealt, keyed, next_months, training_features
from salesops.plans.lineage import written
from salesops.scopes import DEFAULT_HORIZON, DEFAULT_LAGS, scope_keys

HISTORY = max(DEFAULT_LAGS)
SPLITTABLE_ROWS = 40
# The features of a row, in the order in which trees number them.
INPUTS = (*(f"lag_{k}" for k in DEFAULT_LAGS), "month", "year")
# A round costs time for every row, and has a price of its own for every block of rows: a task gets so many rows,
# or fewer if there are not enough for all cores of the cluster.
ROWS_PER_TASK, LEAST_ROWS_PER_TASK = 20_000, 2_500
# Keys that meet their trees in one task: a task has its price too, and a key's trees are some 200 KB.
FORESTS_PER_TASK = 64

# The two configurations.
TREES_A = TreeParams(rounds=200, step=0.1, leaves=31, leaf_rows=20, bins=255, mean_below=SPLITTABLE_ROWS)
TREES_B = TreeParams(rounds=300, step=0.05, depth=6, leaf_rows=1, bins=256, l2=1.0, row_share=0.9, column_share=0.9)


def fit_mean(features: DataFrame, scope: str) -> DataFrame:
    """One row per key: the mean of y over its feature rows, and their number."""
    return features.groupBy(*scope_keys(scope)).agg(
        F.avg("y").alias("mean_y"), F.count("*").alias("n_obs")
    )


def fit_keys(features: DataFrame, scope: str, params: TreeParams) -> DataFrame:
    """As ``fit_mean``, with the ``mean_below`` that a key's forecast has to follow."""
    return fit_mean(features, scope).withColumn("mean_below", F.lit(params.mean_below))


def fit_trees(features: DataFrame, scope: str, params: TreeParams, kept: bool = True) -> DataFrame:
    """Rows (keys, tree, feature, left, value); none for keys below ``mean_below`` or without a split.

    The rows of a key come together, ordered by month, in one of as many tasks as the number of rows asks for.
    The trees are by far larger than the rows. They are written once, unless they are not to be ``kept``: then they are
    fitted while they are read, for a single reader that keeps its own result.
    """
    keys = scope_keys(scope)
    rows = features.withColumn("n_obs", F.count("*").over(by_key(scope)))
    rows = rows.filter(F.col("n_obs") >= params.mean_below).select(
        *keys,
        "ds",
        F.col("y").cast("double").alias("y"),
        *[F.col(c).cast("double").alias(c) for c in INPUTS],
        F.xxhash64(*keys, "ds").alias("row_draw"),
        F.xxhash64(*keys).alias("key_draw"),
    )
    rows = written(rows, "tree-rows")
    nodes = [("feature", T.IntegerType()), ("left", T.IntegerType()), ("value", T.DoubleType())]
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("tree", T.IntegerType())])
    for name, kind in nodes:
        schema = schema.add(name, T.ArrayType(kind))
    tasks = _tasks(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    dealt_out = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "ds")
    trees = dealt_out.mapInArrow(tree_rows(keys, list(INPUTS), params), schema)
    return written(trees, "trees") if kept else trees


def _tasks(rows: int, cores: int) -> int:
    """As many tasks as fill all cores evenly, as long as they have rows enough."""
    waves = -(-rows // (ROWS_PER_TASK * cores))
    return max(min(waves * cores, -(-rows // LEAST_ROWS_PER_TASK)), 1)


def _forest(trees: pa.Table) -> Forest:
    """The nodes of all trees of a key one after the other, walked in order of their number."""
    feature, left, value = (trees.column(c).combine_chunks() for c in ("feature", "left", "value"))
    sizes = feature.value_lengths().to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    roots = ends - sizes
    nodes = [c.flatten().to_numpy() for c in (feature, left, value)]
    nodes[1] = nodes[1] + np.repeat(roots, sizes)
    return Forest(*nodes, roots[np.argsort(trees.column("tree").to_numpy(), kind="stable")][None, :])


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def predict_trees(rows: DataFrame, model: DataFrame | None, scope: str) -> DataFrame:
    """Adds yhat to feature rows that also hold the columns of ``fit_keys``.

    The rows of a key meet its trees; both are bounded, by the months there are and by the rounds.
    """
    if model is None:
        return rows.withColumn("yhat", F.col("mean_y"))
    keys = scope_keys(scope)
    schema = T.StructType(list(rows.schema.fields)).add("yhat", T.DoubleType())

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        yhat = _numbers(left, "mean_y").copy()
        if len(left) and len(right) and _numbers(left, "n_obs")[0] >= _numbers(left, "mean_below")[0]:
            yhat += _forest(right).sums(np.column_stack([_numbers(left, c) for c in INPUTS]))
        return left.append_column("yhat", pa.array(yhat, from_pandas=True))

    # A key's trees are many times its rows: the keys are dealt out by their number, and the trees follow them.
    return dealt(rows, scope, FORESTS_PER_TASK).groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(scored, schema)


def _needed_positions(horizon: int) -> list[int]:
    """How far back the lags of the next ``horizon`` months reach into known history."""
    return sorted({k - step for k in DEFAULT_LAGS for step in range(horizon) if k > step})


def _walk(history: list, year: int, month: int, trees: Forest, mean: float, horizon: int) -> Iterator[float]:
    """Month by month; every value becomes the history of the next."""
    history = [np.nan if v is None else v for v in history]
    for _ in range(horizon):
        year, month = year + month // 12, month % 12 + 1
        x = np.array([[*(history[-k] for k in DEFAULT_LAGS), month, year]], dtype=float)
        history.append(mean + float(trees.sums(x)[0]))
        yield history[-1]


def forecast_trees(
    series: DataFrame,
    keys_model: DataFrame,
    model: DataFrame | None,
    scope: str,
    horizon: int = DEFAULT_HORIZON,
) -> DataFrame:
    """(keys, ds, yhat, yhat_lower, yhat_upper); every predicted value feeds the later lags.

    One row per key with its last twelve values meets the key's trees and walks the whole horizon; its length
    changes nothing in the plan. Keys whose lags would meet a NULL are left out.
    """
    check_range("horizon", horizon, 1)
    keys = scope_keys(scope)
    newest = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    # One more row than the lags reach tells a key with enough history.
    recent = dealt(keyed(series, scope), scope, FORESTS_PER_TASK).withColumn("_place", F.row_number().over(newest))
    points = F.sort_array(F.collect_list(F.struct("ds", "y")))
    state = (
        recent.filter(F.col("_place") <= HISTORY + 1)
        .groupBy(*keys)
        .agg(points.alias("points"), F.max("ds").alias("last_ds"))
        .filter(F.size("points") > HISTORY)
        .select(*keys, "last_ds", F.slice(F.col("points.y"), -HISTORY, HISTORY).alias("hist"))
        .join(keys_model.select(*keys, "mean_y", "n_obs", "mean_below"), keys)
    )
    for back in _needed_positions(horizon):
        state = state.filter(F.element_at("hist", -back).isNotNull())
    if model is None:
        walks = state.withColumn("walk", F.array_repeat(F.col("mean_y"), horizon))
    else:
        walks = _walks(state, model, keys, horizon)
    forecast = F.arrays_zip(next_months(F.col("last_ds"), horizon).alias("ds"), F.col("walk").alias("yhat"))
    return walks.select(*keys, F.inline(forecast).alias("ds", "yhat")).withColumns(
        {"yhat_lower": F.col("yhat"), "yhat_upper": F.col("yhat")}
    )


def _walks(state: DataFrame, model: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    dated = state.withColumns({"year": F.year("last_ds"), "month": F.month("last_ds")})

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        walks = []
        forest = _forest(right) if len(left) and len(right) else None
        fitted = _numbers(left, "n_obs") >= _numbers(left, "mean_below")
        for key, mean, fits in zip(left.to_pylist(), _numbers(left, "mean_y").tolist(), fitted):
            own = _walk(key["hist"], key["year"], key["month"], forest, mean, horizon) if forest and fits else [mean] * horizon
            walks.append(list(own))
        walks = pa.array(walks, pa.list_(pa.float64()), from_pandas=True)
        return left.select([*keys, "last_ds"]).append_column("walk", walks)

    schema = T.StructType([state.schema[c] for c in (*keys, "last_ds")]).add("walk", T.ArrayType(T.DoubleType()))
    return dated.groupBy(*keys).cogroup(model.groupBy(*keys)).applyInArrow(walk, schema)


def save_trees(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def checked_trees(model: DataFrame) -> DataFrame:
    """The table, if it is one of trees."""
    missing = {"tree", "feature", "left", "value"} - set(model.columns)
    if missing:
        raise ValueError(f"no table of trees, it lacks {sorted(missing)}")
    return model


def load_trees(spark: SparkSession, path: str) -> DataFrame:
    return checked_trees(spark.read.parquet(path))


def train_rows(series: DataFrame, scope: str) -> DataFrame:
    return training_features(series, scope, DEFAULT_LAGS)
