"""When to retrain and whether the recent rows allow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import col
from tidemark.operators.detectors import CooldownFold
from tidemark.operators.ordering import running
from tidemark.operators.streams import fold_streams

MINIMUM_ROWS = 500  # fixed value: fewer recent rows than this do not start a retrain
WINDOW_ROWS = 20_000


class RetrainPolicy:
    """Extension point: a policy picks the trigger positions of a dense stream."""

    name = "policy"
    #: whether triggers depend on the drifts of the run itself; if not, ``planned`` knows them in advance
    needs_drifts = False
    #: position the first trigger is counted from
    first_trigger_base = 0

    def planned(self, last: int, at: int, end: int, most: int) -> list[int]:
        """The next triggers after ``last`` in positions at .. end - 1, at most ``most``."""
        return []

    def triggers(self, stream: DataFrame, drifts: DataFrame) -> DataFrame:
        """``stream`` has pos; ``drifts`` has the pos of every drift; the result has pos."""
        raise NotImplementedError


class Static(RetrainPolicy):
    name = "static"

    def triggers(self, stream, drifts):
        return stream.select("pos").filter(F.lit(False))


class Periodic(RetrainPolicy):
    def __init__(self, period: int = 10_000):
        self.period = period
        self.name = f"periodic_{period}"

    def planned(self, last, at, end, most):
        return list(range(last + self.period, end, self.period))[:most]

    def triggers(self, stream, drifts):
        return retrain_periodic(stream, self.period).select("pos")


class DriftTriggered(RetrainPolicy):
    name = "drift_triggered"
    needs_drifts = True

    def __init__(self, cooldown: int = 2_000):
        self.cooldown = cooldown
        self.first_trigger_base = -cooldown

    def triggers(self, stream, drifts):
        return retrain_cooldown(drifts, [], "pos", self.cooldown).filter("kept").select("pos")


def retrain_periodic(stream: DataFrame, period: int, pos: str = "pos") -> DataFrame:
    """Every ``period`` positions of a dense stream, counted from its start: a plain filter."""
    return stream.filter((col(pos) > 0) & (col(pos) % period == 0)).select(
        col(pos).alias("pos"), (col(pos) / period).cast("long").alias("retrain_no")
    )


def retrain_cooldown(drifts: DataFrame, key: list[str], pos: str, cooldown: int, **kw) -> DataFrame:
    """Every drift with ``kept``: true when the last kept one is at least ``cooldown`` back.

    Inherently sequential, but over drift events and not over rows.
    """
    # the order column doubles as the value the fold reads
    rows = drifts.select(*key, col(pos).alias("pos"), col(pos).alias("_at"))
    return fold_streams(rows, key, ["pos"], "_at", lambda: CooldownFold(cooldown), "kept boolean, n_retrains long", **kw)


def retrain_guards(
    stream: DataFrame, triggers: DataFrame, label: str, window_rows: int = WINDOW_ROWS, minimum: int = MINIMUM_ROWS
) -> DataFrame:
    """Rows and classes among the last ``window_rows`` rows at every trigger.

    Instead of joining each window to its rows, the two ends of every window are counted
    along the stream once per label.
    """
    labels = stream.groupBy(col(label).alias("_label")).count().agg(F.collect_list("_label")).scalar()
    ends = triggers.select("pos", F.explode(labels).alias("_label")).select(
        "_label",
        F.explode(F.array(
            F.struct(F.col("pos").alias("_at"), F.lit(1).cast("long").alias("_sign"), F.col("pos").alias("_trigger")),
            F.struct((F.col("pos") - window_rows).alias("_at"), F.lit(-1).cast("long").alias("_sign"), F.col("pos").alias("_trigger")),
        )).alias("e"),
    ).select("_label", "e.*", F.lit(0).cast("long").alias("_one"))
    rows = stream.select(
        col(label).alias("_label"), col("pos").alias("_at"), F.lit(0).cast("long").alias("_sign"),
        F.lit(None).cast("long").alias("_trigger"), F.lit(1).cast("long").alias("_one"),
    )
    # a row at the probed position counts, so rows come before probes
    both = rows.unionByName(ends).withColumn("_probe", F.col("_trigger").isNotNull())
    counted = running(both, ["_label"], ["_at", "_probe", "_trigger"], {"_upto": ("sum", F.col("_one"))})
    per_label = counted.filter("_probe").groupBy("_trigger", "_label").agg(F.sum(F.col("_sign") * F.col("_upto")).alias("_n"))
    out = per_label.groupBy(F.col("_trigger").alias("pos")).agg(
        F.sum("_n").alias("window_rows"), F.count_if(F.col("_n") > 0).alias("n_classes")
    )
    allowed = (F.col("window_rows") >= minimum) & (F.col("n_classes") >= 2)
    return out.withColumn("triggered", F.lit(True)).withColumn("retrained", allowed)


def compare_policies(
    stream: DataFrame, drifts: DataFrame, policies: list[RetrainPolicy], label: str, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Retrains every policy asks for and the guards let through."""
    plans = None
    for p in policies:
        t = p.triggers(stream, drifts).withColumn("strategy", F.lit(p.name))
        plans = t if plans is None else plans.unionByName(t)
    guards = retrain_guards(stream, plans.select("pos").distinct(), label, window_rows)
    joined = plans.join(guards, "pos")
    counts = joined.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_triggered"), F.count_if("retrained").alias("n_retrains"))
    names = F.array(*[F.lit(p.name) for p in policies])
    every = stream.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.explode(names).alias("strategy"))
    return every.join(counts, "strategy", "left").fillna(0, ["n_triggered", "n_retrains"])


