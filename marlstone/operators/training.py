"""Merges of a vocabulary from its scores, dictionaries by cover, and rounding with error feedback."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import ranks
from marlstone.operators.kernels import fit_scale


def merges_from_scores(vocabulary: DataFrame) -> DataFrame:
    """(rank, left, right): the merges that a scored vocabulary (id, piece, score) implies.

    Every way to cut a piece into two pieces is a merge. They are ordered by the merged piece's score, then the
    lengths of its halves, from the highest; then by the ids of piece, left and right. Scores that hardly
    differ (under one in a hundred pieces has its own) say nothing: the pieces' ids order the merges.
    """
    v = vocabulary.select("id", "piece", F.col("score").cast("double").alias("score"))
    told = v.agg(F.countDistinct("score").alias("d"), F.count("*").alias("n")).select(((F.col("d") > 1) & (100 * F.col("d") >= F.col("n"))).alias("told"))
    cuts = v.where("length(piece) > 1").withColumn("at", F.explode(F.expr("sequence(1, length(piece) - 1)")))
    cuts = cuts.select("id", "score", F.expr("substring(piece, 1, at)").alias("left"), F.expr("substring(piece, at + 1)").alias("right"))
    half = lambda side: v.select(F.col("piece").alias(side), F.col("id").alias(f"{side}_id"))
    found = cuts.join(half("left"), "left").join(half("right"), "right").crossJoin(F.broadcast(told))
    down = lambda c: F.when(F.col("told"), -c).otherwise(0)
    keyed = found.select("left", "right", down(F.col("score")).cast("double").alias("k1"), down(F.length("left")).alias("k2"), down(F.length("right")).alias("k3"), F.col("id").alias("k4"), F.col("left_id").alias("k5"), F.col("right_id").alias("k6"))
    return ranks.numbered(keyed, ["k1", "k2", "k3", "k4", "k5", "k6"], "rank").select("rank", "left", "right")


def cover(samples: list[bytes], budget: int, segment: int = 64, width: int = 8) -> bytes:
    """Content for a dictionary of up to ``budget`` bytes: the samples' bytes in as many epochs as segments fit,
    and from each the segment whose distinct strings of ``width`` bytes are the most frequent; strings that a
    chosen segment has count for no later one. Earlier epochs' segments stand last."""
    data, parts = b"".join(samples), budget // segment
    if not parts or len(data) < segment:
        return b""
    place = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), width)
    _, word = np.unique(np.ascontiguousarray(place).view(f"V{width}").ravel(), return_inverse=True)
    worth = np.bincount(word).astype(np.int64)
    epoch, inside, chosen = max(len(data) // parts, segment), segment - width + 1, []
    for begin in range(0, len(data) - segment + 1, epoch):
        stop = min(begin + epoch, len(data)) - segment + 1  # segments start before this
        held: Counter = Counter(word[begin:begin + inside].tolist())
        score = best = int(worth[list(held)].sum())
        at = begin
        for k in range(begin + 1, stop):
            gone, new = int(word[k - 1]), int(word[k + inside - 1])
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
                score -= int(worth[gone])
            if new not in held:
                score += int(worth[new])
            held[new] += 1
            if score > best:
                best, at = score, k
        if best:
            chosen.append(data[at:at + segment])
            worth[word[at:at + inside]] = 0
    return b"".join(reversed(chosen[:parts]))


def dictionaries(rows: DataFrame, group: str, key: str, text: str, budget: int = 1024, sample: int = 32) -> DataFrame:
    """(group, dictionary) by ``cover`` over the first ``sample`` texts of each group by digest of their key: a
    dictionary is fitted to a bounded sample by design. The sample is picked by partial aggregates."""
    entry = F.struct(F.sha2(F.concat_ws(":", F.lit("dictionary"), F.col(key).cast("string")), 256).alias("digest"), F.col(text).alias("text"))
    # Each partition keeps its own least digests before anything is exchanged.
    salted = rows.where(F.col(text).isNotNull()).select(group, F.pmod(F.xxhash64(key), F.lit(64)).alias("salt"), entry.alias("e"))
    least = lambda d, *by: d.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("e")), 1, sample).alias("es"))
    few = least(salted, group, "salt").select(group, F.explode("es").alias("e"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        samples = [e["text"].encode() for e in f["es"].iloc[0]]
        return pd.DataFrame({group: [f[group].iloc[0]], "dictionary": [cover(samples, budget)]})

    return least(few, group).groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, dictionary binary")


def feedback_rounding(weights: np.ndarray, hessian: np.ndarray, bits: int = 4, damp: float = 0.01, run_length: int = 32) -> np.ndarray:
    """Rows rounded to scaled codes one by one, the rows after each re-fitted for its error (GPTQ).

    ``hessian`` are the rows' second moments, E[a a^T]. Rows are taken by falling diagonal; with U the upper
    Cholesky factor of the damped inverse, an error e of row i moves row r by -(e / U_ii) U_ir.
    """
    order = np.argsort(-np.diag(hessian), kind="stable")
    h = hessian[np.ix_(order, order)].astype(float)
    h += np.eye(len(h)) * damp * max(float(np.diag(h).mean()), 1e-12)
    upper = np.linalg.cholesky(np.linalg.inv(h)).T
    left, out = weights[order].astype(float).copy(), np.empty_like(weights, dtype=float)
    for i in range(len(left)):
        for a in range(0, left.shape[1], run_length):
            scale, codes = fit_scale(left[i, a:a + run_length], bits)
            out[order[i], a:a + run_length] = codes * scale
        error = (left[i] - out[order[i]]) / upper[i, i]
        left[i + 1:] -= np.outer(upper[i, i + 1:], error)
    return out
