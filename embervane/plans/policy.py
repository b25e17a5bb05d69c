"""What to do at run time, from what was measured: the cheap path where it is shown to be safe, else the careful one."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROCEED = "proceed"


@dataclass(frozen=True)
class Decision:
    situation: str
    action: str
    reason: str
    measured: dict = field(default_factory=dict)

    @property
    def conservative(self) -> bool:
        return self.action != PROCEED


@dataclass(frozen=True)
class Policy:
    gap_floor: float = 1e-3
    oversample: int = 8
    tau_floor: float = 0.5
    margin_floor: float = 0.05
    slow_ceiling: float = 0.5
    tangential_floor: float = 0.5
    drop_ceiling: float = 0.05

    def retrieval(self, hits: DataFrame) -> Decision:
        """From (query, rank, id, score): where the last two scores of half the queries lie within the gap, rank more."""
        from pyspark.sql.window import Window

        last = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank")))).where("r <= 2")
        gap = last.groupBy("query").agg((F.max("score") - F.min("score")).alias("gap"), F.count("*").alias("n")).where("n = 2")
        s = gap.agg(F.percentile("gap", F.lit(0.5)).alias("m"), F.avg(F.when(F.col("gap") < self.gap_floor, 1.0).otherwise(0.0)).alias("tied")).first()
        if s["m"] is None:
            raise ValueError("queries need two hits or more")
        fragile = s["tied"] > 0 and s["m"] < self.gap_floor
        return Decision("retrieval", "rerank_more" if fragile else PROCEED, f"median gap {s['m']:.4g}", {"median_gap": s["m"], "tied": s["tied"], "oversample": self.oversample if fragile else 1})

    def certificate(self, row: dict) -> Decision:
        tau = row["tau_floor"]
        weak = row["vacuous"] or not math.isfinite(tau) or tau < self.tau_floor
        return Decision("certificate", "require_exact_rerank" if weak else PROCEED, "vacuous" if row["vacuous"] else f"tau floor {tau:.4g}", {"tau_floor": tau})

    def routing(self, report: dict) -> Decision:
        fragile = report["margin_p10"] < self.margin_floor
        return Decision("routing", "keep_router_fp16" if fragile else PROCEED, f"p10 margin {report['margin_p10']:.4g}", {"margin_p10": report["margin_p10"]})

    def decay(self, report: dict) -> Decision:
        fragile = report["slow_channel_fraction"] > self.slow_ceiling
        return Decision("decay", "log_tau_or_fp16" if fragile else PROCEED, f"slow fraction {report['slow_channel_fraction']:.4g}", {"max_gain": report["max_gain"]})

    def displacement(self, median_fraction: float) -> Decision:
        fragile = median_fraction < self.tangential_floor
        return Decision("a2", "recalibrate_or_disable_polar" if fragile else PROCEED, f"median tangential fraction {median_fraction:.4g}", {"median_fraction": median_fraction})

    def kv_keys(self, tangential: float | None = None, regime: str | None = None) -> Decision:
        """Keys of unknown regime, or whose displacements are radial, take a grid of their own for each channel."""
        if regime is not None and regime.lower() in ("", "unk", "unknown"):
            return Decision("kv_keys", "per_channel_or_fp16", "unknown regime", {"regime": regime})
        if tangential is None:
            raise ValueError("the median tangential fraction or the regime is needed")
        safe = tangential >= self.tangential_floor
        return Decision("kv_keys", PROCEED if safe else "per_channel_or_fp16", f"median tangential fraction {tangential:.4g}", {"median_fraction": tangential})

    def index_drift(self, drift) -> Decision:
        return Decision("index_drift", "refit_or_migrate" if drift.stale else PROCEED, f"retained variance fell by {drift.drop:.4g}", {"drop": drift.drop})

    def all(self, **inputs) -> list[Decision]:
        """The decisions of all inputs given by situation, in the order of this class."""
        return [getattr(self, name)(inputs[name]) for name in ("retrieval", "certificate", "kv_keys", "routing", "decay", "displacement", "index_drift") if name in inputs]
