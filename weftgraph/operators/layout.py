"""Positions for drawing: communities on a force layout of their own, members around them, one task per community."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.metrics import pair_weights, with_communities


def force(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 200, seed: int = 42) -> np.ndarray:
    """n points: linked ones attract, all repel; beyond 500 points each is repelled by 200 drawn ones.  The seed fixes the result."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(n, 3))
    k = max(n, 1) ** (-1 / 3)
    for r in range(rounds):
        other = np.arange(n) if n <= 500 else rng.choice(n, 200, replace=False)
        d = at[:, None] - at[None, other]
        push = (d * (k * k / np.maximum((d * d).sum(2), 1e-6))[..., None]).sum(1) * (n / max(len(other), 1))
        if len(a):
            e = at[a] - at[b]
            pull = e * (np.sqrt((e * e).sum(1)) / k * w)[:, None]
            np.add.at(push, a, -pull)
            np.add.at(push, b, pull)
        size = np.sqrt((push * push).sum(1, keepdims=True))
        at += push / np.maximum(size, 1e-9) * np.minimum(size, 0.1 * (1 - r / rounds))
    return at


def layout(g: Graph, spread: float = 10.0) -> DataFrame:
    """(id, cid, x, y, z): every member near its community's place; one task sees the graph of communities, and one task each community."""
    size = g.communities.groupBy("cid").agg(F.count("*").alias("n"))
    pairs = pair_weights(g).filter("c1 <> c2")
    rows = size.select("cid", F.lit(None).cast("bigint").alias("far"), F.col("n").cast("double").alias("w")).unionByName(pairs.select(F.col("c1").alias("cid"), F.col("c2").alias("far"), F.col("weight").alias("w")))

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["far"].isna()].sort_values("cid")
        code = {c: i for i, c in enumerate(own["cid"])}
        e = pdf[pdf["far"].notna()].sort_values(["cid", "far"])
        w = e["w"].to_numpy(float)
        at = force(len(own), e["cid"].map(code).to_numpy(np.int64), e["far"].astype("int64").map(code).to_numpy(np.int64), w / max(w.max(initial=0), 1e-9), 500) * spread
        return pd.DataFrame({"cid": own["cid"].to_numpy(), "cx": at[:, 0], "cy": at[:, 1], "cz": at[:, 2]})

    centres = rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(places, "cid long, cx double, cy double, cz double")
    within = with_communities(g).filter("ca = cb and source <> target").select(F.col("ca").alias("cid"), F.col("source").alias("a"), F.col("target").alias("b"), "weight")
    member = g.communities.select("cid", F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["b"].isna(), "a"].to_numpy(str))
        e = pdf[pdf["b"].notna()].sort_values(["a", "b"])
        w = e["weight"].to_numpy(float)
        at = force(len(ids), np.searchsorted(ids, e["a"].to_numpy(str)), np.searchsorted(ids, e["b"].to_numpy(str)), w / max(w.max(initial=0), 1e-9), 100)
        return pd.DataFrame({"cid": int(pdf["cid"].iloc[0]), "id": ids, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    local = member.unionByName(within).groupBy("cid").applyInPandas(inside, "cid long, id string, x double, y double, z double")
    return local.join(centres, "cid").select("id", "cid", (F.col("x") + F.col("cx")).alias("x"), (F.col("y") + F.col("cy")).alias("y"), (F.col("z") + F.col("cz")).alias("z"))
