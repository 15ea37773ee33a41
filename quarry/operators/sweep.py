"""Parameter sweep (M7) over density clustering, scored by M6, with the
reference's pruning rules; the Pareto front (M8) picks the best trial.

Each trial is a handful of Spark jobs on the (checkpointed) reduced points;
the trial loop itself is driver control flow over a bounded number of
trials, and the trials table it returns has one row per trial.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import density, quality
from quarry.session import reliable_checkpoint

# Fixed values of the reference's search space and budget (those of its
# non-linear reduction, which is not built, are left out).
N_TRIALS = 100
SEED = 3
RANGES = {
    "min_cluster_size": (400, 500),
    "min_samples": (25, 50),
    "epsilon": (0.05, 0.075),
}


def draw(rng: np.random.Generator, ranges: dict) -> dict:
    out = {}
    for k, (lo, hi) in ranges.items():
        out[k] = int(rng.integers(lo, hi + 1)) if isinstance(lo, int) else float(rng.uniform(lo, hi))
    return out


def param_sweep(points: DataFrame, id_col: str = "id", vec_col: str = "vec",
                n_trials: int = N_TRIALS, seed: int = SEED, ranges: dict | None = None) -> DataFrame:
    """M7: trials (number, ss, dbi, chi, params..., state)."""
    spark = points.sparkSession
    ranges = ranges or RANGES
    pts = reliable_checkpoint(points.select(F.col(id_col).alias("id"),
                                            F.col(vec_col).cast("array<double>").alias("vec")))
    rng = np.random.default_rng(seed)
    drawn = [draw(rng, ranges) for _ in range(n_trials)]
    # the neighbours of the largest min_samples serve every trial
    most = max((p["min_samples"] for p in drawn), default=2) - 1
    near = reliable_checkpoint(density.nearest_distances(pts, max(most, 1), pts.count()))
    rows = []
    for number, p in enumerate(drawn):
        lab = density.density_cluster(pts, p["min_samples"], p["epsilon"], p["min_cluster_size"], near=near)
        lab = reliable_checkpoint(lab.join(pts, "id"))
        nr = quality.noise_ratio(lab).first()
        state, ss, dbi, chi = "COMPLETE", None, None, None
        if not (quality.MIN_CLUSTERS <= nr.n_clusters <= quality.MAX_CLUSTERS) or \
                nr.noise_ratio > quality.MAX_NOISE_RATIO:
            state = "PRUNED"
        else:
            ss = quality.silhouette(lab, "id", "vec").first()[0]
            dbi = quality.davies_bouldin(lab, "vec").first()[0]
            chi = quality.calinski_harabasz(lab, "vec").first()[0]
        rows.append((number, ss, dbi, chi, p["min_cluster_size"], p["min_samples"], p["epsilon"], state))
    schema = ("number int, ss double, dbi double, chi double, min_cluster_size int, min_samples int, "
              "epsilon double, state string")
    return spark.createDataFrame(rows, schema)


def best_trials(trials: DataFrame) -> DataFrame:
    """M8 over completed trials."""
    return quality.pareto_front(trials.where(F.col("state") == "COMPLETE"))
