"""Chains of the block model over vintages, as Spark jobs: states in a table, warm starts, refusals, densities from stored draws.

A vintage's chains start from the states that the vintage before left, so vintages come one after another, seeds beside each other. Each
vintage is a folder of its own, written whole or not at all: a run that was stopped goes on with the first vintage that is missing, and
its chains give the same draws as if nothing had happened, since a state holds its generator (bit for bit where numpy sums in the same order).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import blocks

DRAWS = "as_of date, seed int, draw int, layout string, state binary"
ROWS = "as_of date, key string, category string, date date, x double"
TARGET = "target"


def layout_of(rows: pd.DataFrame) -> dict:
    """Series (the target last), their blocks, places and scales, from a vintage's rows; a block of one series is none."""
    own = rows.drop_duplicates("key").set_index("key")["category"]
    keys = [k for k in sorted(own.index) if k != TARGET] + [TARGET]
    categories = sorted(c for c, n in own.drop(TARGET).value_counts().items() if n > 1)
    x = rows.groupby("key")["x"]
    sd = x.std(ddof=1).reindex(keys)
    return {"keys": keys, "blocks": ["global", *categories], "of": [own[k] for k in keys], "mean": x.mean().reindex(keys).tolist(), "sd": sd.where(sd > 0, 1.0).tolist()}


def panel_of(rows: pd.DataFrame, layout: dict) -> tuple[np.ndarray, blocks.Pattern]:
    """Months x series in the layout's order and scale, on every month from the first to the last, and the pattern for it."""
    w = rows.pivot(index="date", columns="key", values="x")
    months = pd.period_range(pd.Timestamp(w.index.min()), pd.Timestamp(w.index.max()), freq="M")
    w.index = pd.PeriodIndex(pd.to_datetime(w.index), freq="M")
    y = (w.reindex(index=months, columns=layout["keys"]).to_numpy() - layout["mean"]) / layout["sd"]
    table = np.zeros((len(layout["keys"]), len(layout["blocks"])))
    table[:, 0] = 1
    for j, name in enumerate(layout["blocks"][1:], 1):
        members = [i for i, c in enumerate(layout["of"]) if c == name]
        table[members, j] = 1
        table[members[0], j] = 100  # the first names its block
    table[0, 0] = 100
    trend = np.zeros(len(table))
    trend[-1] = 1
    p = blocks.pattern(table, len(y), 1, trend=trend)
    return blocks.visible(y, p), p


def run_chain(rows: pd.DataFrame, seed: int, layout: dict, state: bytes | None, burn: int, draws: int) -> list[bytes]:
    """States of `draws` sweeps after `burn`, from a state or from the seeds of the loadings."""
    y, p = panel_of(rows, layout)
    chain = blocks.started(y, p, seed) if state is None else blocks.Chain.from_bytes(state).longer(len(y))
    out = []
    for k in range(burn + draws):
        blocks.sweep(chain, y, p)
        if k >= burn:
            out.append(chain.to_bytes())
    return out


def written(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _step(burn: int, draws: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What runs for a seed: from the vintage's rows and the states before, if there are any."""

    def run(key: tuple, own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"seed": [], "draw": [], "layout": [], "state": []})
        last = old.sort_values("draw").iloc[-1] if len(old) else None
        layout = layout_of(own) if last is None else json.loads(last["layout"])
        states = run_chain(own, int(key[0]), layout, None if last is None else last["state"], burn, draws)
        return pd.DataFrame({"seed": np.int32(key[0]), "draw": np.arange(len(states), dtype=np.int32), "layout": json.dumps(layout), "state": states})

    return run


def advanced(rows: DataFrame, vintages: list[dt.date], seeds: int, folder: str, first: tuple[int, int], later: tuple[int, int]) -> DataFrame:
    """The draws of all vintages (DRAWS), those missing in the folder computed. first, later: (burn, draws) of the first vintage and of the warm ones."""
    spark = rows.sparkSession
    before: str | None = None
    for v in vintages:
        path = f"{folder}/as_of={v}"
        if not written(spark, path):
            mine = rows.where(F.col("as_of") == F.lit(v)).select("*", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
            old = spark.read.parquet(before) if before else spark.createDataFrame([], "seed int, draw int, layout string, state binary")
            # one seed a task: a chain is long and its panel small
            dealt = [df.repartition(seeds, "seed").groupBy("seed") for df in (mine, old)]
            dealt[0].cogroup(dealt[1]).applyInPandas(_step(*(first if before is None else later)), "seed int, draw int, layout string, state binary").write.mode("overwrite").parquet(path)
        before = path
    return spark.read.schema(DRAWS).parquet(folder).where(F.col("as_of").isin(vintages))


def loadings(draws: DataFrame) -> DataFrame:
    """as_of, seed, draw, key, block, loading of every draw."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                layout, load = json.loads(r.layout), blocks.Chain.from_bytes(r.state).load
                i, j = np.nonzero(load)
                yield pd.DataFrame({"as_of": r.as_of, "seed": r.seed, "draw": r.draw, "key": np.array(layout["keys"])[i], "block": np.array(layout["blocks"])[j], "loading": load[i, j]})

    return draws.mapInPandas(run, "as_of date, seed int, draw int, key string, block string, loading double")


def refusals(draws: DataFrame, floor: float) -> DataFrame:
    """as_of, seed, loading, refused: whether the target's mean loading on the global block is under the floor; such a chain's estimates aren't to be published."""
    own = loadings(draws).where((F.col("key") == TARGET) & (F.col("block") == "global"))
    return own.groupBy("as_of", "seed").agg(F.avg("loading").alias("loading")).withColumn("refused", F.abs("loading") < floor)


def density(rows: DataFrame, draws: DataFrame, groups: int = 4) -> DataFrame:
    """as_of, seed, draw, value: for every vintage of rows and every stored draw, one draw of the target in the vintage's last month; no parameter is estimated again.

    A group is a vintage and a block of draws. A draw's generator comes from vintage, seed and draw, so grouping doesn't change it.
    """

    def run(key: tuple, own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = [(key[0], int(r.seed), int(r.draw), drawn_value(own, r.layout, r.state, key[0], int(r.seed), int(r.draw))) for r in stored.itertuples()] if len(own) else []
        return pd.DataFrame(out, columns=["as_of", "seed", "draw", "value"])

    vintages = rows.select(F.col("as_of").alias("vintage")).distinct()
    part = F.pmod(F.xxhash64("seed", "draw"), F.lit(groups)).cast("int").alias("block")
    each = draws.select("seed", "draw", "layout", "state", part).join(F.broadcast(vintages))  # a row a vintage
    own = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    return own.groupBy("as_of", "part").cogroup(each.groupBy("vintage", "block")).applyInPandas(run, "as_of date, seed int, draw int, value double")


def drawn_value(rows: pd.DataFrame, layout: str, state: bytes, as_of: dt.date, seed: int, draw: int) -> float:
    names = json.loads(layout)
    y, p = panel_of(rows[rows["key"].isin(names["keys"])], names)
    chain = blocks.Chain.from_bytes(state).longer(len(y))
    chain.sigma, chain.scale = chain.sigma[: len(y)], chain.scale[: len(y)]
    chain.rng = np.random.default_rng([as_of.toordinal(), seed, draw])
    value = blocks.density_draw(chain, y, p, len(y) - 1, len(names["keys"]) - 1)
    return names["mean"][-1] + names["sd"][-1] * value
