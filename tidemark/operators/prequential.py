"""Predict, then learn: whole grids of adaptive runs over one stream, with triggers at their exact place.

A run is one policy under one seed.  It scores the stream with its current model up to and
including the row that triggers a retrain, fits a new model on the rows before it and goes on
behind it.  All runs of a grid advance together in turns; a turn is a few jobs for all of them:

* policies that know their triggers in advance (none, periodic) are planned many segments at
  a time (with a learner whose models are tables all at once, as joins, see ``CellLearner.run``);
  a drift-triggered run is scored a stretch ahead with its current model,
* one job scores all stretches of all runs and writes them,
* per drift-triggered run, one task folds the detector over its stretch and stops at the first
  drift that is due; the stretch counts up to there and the detector's state is kept,
* one call fits all models that are due, side by side.

What a stretch is long for changes only the number of turns, never the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.expressions import col, hash_uniform
from tidemark.operators.adapt import MINIMUM_ROWS, WINDOW_ROWS, RetrainPolicy
from tidemark.operators.detectors import create
from tidemark.operators.models import settings, train_many
from tidemark.operators.trees import LOCAL_CELLS, Trees, fit_table
from tidemark.workspace import materialize, new_path, ship_package

STRETCH_ROWS = 100_000  # rows a drift-triggered run is scored ahead at first; one task folds a stretch
MOST_STRETCHES = 16  # a stretch without a drift makes the next one twice as long, up to this many times the first
SCORE_ROWS = 10_000  # positions one task scores for all runs
WINDOW_CELLS = LOCAL_CELLS >> 4  # values (rows x features) of a window up to which planned models are fitted as a table
AHEAD = 64  # models of one turn, over all runs


@dataclass
class Planned:
    """Runs whose triggers are known in advance, as tables.

    Rows meet the spans that models are fitted on, and the stretches that they score, by
    blocks of positions, so no task gets more than a few blocks.
    """

    rows: DataFrame  # pos, y, the learner's columns, seeds that draw the row, _block
    runs: DataFrame  # run, strategy, seed
    spans: DataFrame  # strategy, trigger, a, z: first and last position a model is fitted on
    seen: DataFrame  # rows within spans
    guards: DataFrame  # strategy, trigger, window_rows, n_classes
    passed: DataFrame  # strategy, trigger of the models to fit
    n_spans: int
    block_rows: int
    end: int

    @staticmethod
    def of(stored: DataFrame, label: str, columns: list[Column], runs: dict[int, Run], end: int, warm_rows: int, window_rows: int, minimum: int, key: list[str], share: float, first: bool) -> Planned:
        """``first`` adds the span of the first models, which all policies share, as that of the strategy ""."""
        spark, policies = stored.sparkSession, {r.strategy: r.policy for r in runs.values()}
        numbered = spark.createDataFrame([(i, r.strategy, r.seed) for i, r in runs.items()], "run int, strategy string, seed long")
        seeds = sorted({r.seed for r in runs.values()})
        spans = [("", -1, -warm_rows, -1)] if first else []
        for name, policy in policies.items():
            spans += [(name, t, max(0, t - window_rows + 1), t) for t in policy.planned(policy.first_trigger_base, 0, end, max(end, 0))]
        n_spans, spans = len(spans), materialize(spark.createDataFrame(spans, "strategy string, trigger long, a long, z long"), "spans")
        drawn = F.array(*[F.lit(s) for s in seeds]) if share >= 1 else F.array_compact(F.array(*[F.when(hash_uniform(s, *key) < share, F.lit(s)) for s in seeds]))
        rows = stored.select(
            (F.col("pos") - warm_rows).alias("pos"), col(label).cast("string").alias("y"), *columns, drawn.cast("array<long>").alias("seeds")
        ).withColumn("_block", F.floor(F.col("pos") / F.lit(window_rows)))
        plan = Planned(rows, numbered, spans, rows, spans, spans, n_spans, window_rows, end)
        plan.seen = plan.within(rows, spans)
        guards = plan.seen.groupBy("strategy", "trigger").agg(F.count(F.lit(1)).alias("window_rows"), F.count_distinct("y").cast("int").alias("n_classes"))
        plan.guards = materialize(guards, "guards")
        plan.passed = plan.guards.filter((F.col("strategy") == "") | ((F.col("window_rows") >= minimum) & (F.col("n_classes") >= 2))).select("strategy", "trigger")
        return plan

    def within(self, rows: DataFrame, spans: DataFrame) -> DataFrame:
        block = lambda c: F.floor(F.col(c) / F.lit(self.block_rows))
        dealt = spans.filter("a <= z").select("*", F.explode(F.sequence(block("a"), block("z"))).alias("_block"))
        return rows.join(dealt, "_block").filter("pos BETWEEN a AND z")

    def stretches(self, models: DataFrame) -> DataFrame:
        """A model (run, trigger) scores from the row after its trigger up to the next one's; one row per model."""
        following = F.lead("trigger").over(Window.partitionBy("run").orderBy("trigger"))
        return models.withColumns({"a": F.col("trigger") + 1, "z": F.coalesce(following, F.lit(self.end - 1).cast("long"))})

    def log(self, fitted: DataFrame) -> DataFrame:
        """``fitted``: strategy, trigger, seed, train_seconds of the models."""
        log = self.spans.filter("strategy <> ''").join(self.runs.drop("run"), "strategy").join(self.guards, ["strategy", "trigger"], "left")
        log = log.join(fitted.withColumn("retrained", F.lit(True)), ["strategy", "trigger", "seed"], "left")
        log = log.fillna(0, ["window_rows", "n_classes"]).fillna(False, ["retrained"]).fillna(0.0, ["train_seconds"])
        return materialize(log.select("strategy", "seed", F.col("trigger").alias("pos"), "window_rows", "n_classes", "retrained", "train_seconds"), "log")


class Learner:
    """Extension point: fits one model per name; a model has ``features``, ``labels`` and ``probabilities(columns)``."""

    features: list[str]

    def in_tables(self, window_rows: int) -> bool:
        """Whether ``run`` does all runs whose triggers are known in advance."""
        return False

    def fit(self, rows: DataFrame, name: str, label: str, seeds: dict[str, int]) -> dict[str, object]:
        raise NotImplementedError

    def run(
        self, stored: DataFrame, label: str, runs: dict[int, Run], end: int, warm_rows: int, window_rows: int, minimum: int, key: list[str], share: float,
        first: Callable[[], dict[int, object]],
    ) -> tuple[DataFrame, DataFrame]:
        """Predictions (``SCORED``) and log (``LOG``) of runs, by number; ``first`` fits the first model of every seed."""
        raise NotImplementedError


class TreeLearner(Learner):
    """Boosted trees or forests; the seed of the run is that of the model."""

    def __init__(self, features: list[str], algorithm: str = "gbt", **params):
        self.features, self.algorithm, self.params = features, algorithm, params

    def in_tables(self, window_rows):
        return self.algorithm == "gbt" and window_rows * len(self.features) <= WINDOW_CELLS

    def fit(self, rows, name, label, seeds):
        how = {m: settings(self.algorithm, seed=s, **self.params) for m, s in seeds.items()}
        return {m: c.model for m, c in train_many(rows, name, self.features, label, how).items()}

    def run(self, stored, label, runs, end, warm_rows, window_rows, minimum, key, share, first):
        """All later models are fitted in one job, a task each, and stay a table; another job scores all rows.

        A stretch is scored in parts of ``window_rows`` positions, each next to its model.
        """
        spark, n = stored.sparkSession, len(self.features)
        names = [f"_f{j}" for j in range(n)]
        columns = [col(f).cast("double").alias(c) for f, c in zip(self.features, names)]
        plan = Planned.of(stored, label, columns, runs, end, warm_rows, window_rows, minimum, key, share, first=False)
        firsts = first()
        how = {s: settings(self.algorithm, seed=s, **self.params) for s in firsts}
        model = ["strategy", "trigger", "seed"]
        chosen = plan.seen.join(F.broadcast(plan.passed), ["strategy", "trigger"]).select("strategy", "trigger", "seeds", "y", *names)
        models = materialize(fit_table(chosen, ["strategy", "trigger"], names, "y", "seeds", how, plan.n_spans), "models")
        begin = spark.createDataFrame([(s, bytearray(m.to_bytes())) for s, m in firsts.items()], "seed long, model binary")  # one row per seed
        begin = begin.join(plan.runs, "seed").select("run", F.lit(-1).cast("long").alias("trigger"), "model")
        held = begin.unionByName(models.join(plan.runs, ["strategy", "seed"]).select("run", "trigger", "model"))
        stretches = materialize(plan.stretches(held.select("run", "trigger")), "stretches")
        part = lambda c: F.floor((F.col(c) - F.col("a")) / F.lit(window_rows))
        ask = plan.within(plan.rows.filter("pos >= 0").drop("seeds"), stretches).select("run", "trigger", part("pos").alias("part"), "pos", "y", *names)
        parts = stretches.filter("a <= z").select("run", "trigger", F.explode(F.sequence(F.lit(0).cast("long"), part("z"))).alias("part"))
        at = ["run", "trigger", "part"]

        def score(place: tuple, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})
            fitted = Trees.from_bytes(bytes(model["model"].iloc[0]))
            p = fitted.probabilities([rows[f].to_numpy(dtype=float, na_value=np.nan) for f in names])
            y, y_pred = rows["y"].to_numpy(dtype=object), np.array(fitted.labels, dtype=object)[p.argmax(axis=1)]
            return pd.DataFrame({
                "run": np.int32(place[0]), "pos": rows["pos"], "y_true": y, "y_pred": y_pred,
                "err": ((y != y_pred) & pd.notna(y)).astype(np.int32), "confidence": p.max(axis=1),
            })

        near = parts.join(held, ["run", "trigger"]).withColumnsRenamed({c: f"_{c}" for c in at})
        scored = ask.groupBy(*at).cogroup(near.groupBy(*[f"_{c}" for c in at])).applyInPandas(score, SCORED)
        return materialize(scored, "scored"), plan.log(models.select(*model, F.col("seconds").alias("train_seconds")))


@dataclass
class CellTable:
    """The most frequent label of every cell, and the overall one for cells never seen."""

    features: list[str]
    labels: list[str]
    cells: dict[int, int]
    otherwise: int
    metadata: dict = field(default_factory=dict)

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), len(self.labels)))
        at = [self.cells.get(int(c), self.otherwise) if np.isfinite(c) else self.otherwise for c in columns[0]]
        out[np.arange(len(at)), at] = 1.0
        return out


class CellLearner(Learner):
    """Majority label per value of one whole-number column with few values; ties go to the smaller label."""

    def __init__(self, cell: str):
        self.features = [cell]

    def in_tables(self, window_rows):
        return True

    def run(self, stored, label, runs, end, warm_rows, window_rows, minimum, key, share, first):
        """All models as one table, counted in one job, and all rows scored in another."""
        plan = Planned.of(stored, label, [col(self.features[0]).alias("cell")], runs, end, warm_rows, window_rows, minimum, key, share, first=True)
        model = ["strategy", "trigger", "seed"]
        counts = plan.seen.filter("y IS NOT NULL").join(plan.passed, ["strategy", "trigger"]).select("strategy", "trigger", F.explode("seeds").alias("seed"), "cell", "y")
        counts = counts.groupBy(*model, "cell", "y").agg(F.count(F.lit(1)).alias("n"))
        counts = materialize(counts, "counts")
        most = F.min(F.struct((-F.col("n")).alias("n"), "y"))["y"]
        per_cell = counts.filter("cell IS NOT NULL").groupBy(*model, "cell").agg(most.alias("y"))
        tables = per_cell.groupBy(*model).agg(F.map_from_entries(F.collect_list(F.struct("cell", "y"))).alias("cells"))
        overall = counts.groupBy(*model, "y").agg(F.sum("n").alias("n")).groupBy(*model).agg(most.alias("otherwise"))
        models = materialize(overall.join(tables, model, "left"), "models")
        first_ones = models.filter("strategy = ''").drop("strategy").join(plan.runs, "seed")
        later = models.filter("strategy <> ''").join(plan.runs, ["strategy", "seed"])
        kept = ["run", "trigger", "cells", "otherwise"]
        stretches = plan.stretches(first_ones.select(*kept).unionByName(later.select(*kept)))
        asked = plan.within(plan.rows.filter("pos >= 0").drop("seeds"), stretches)
        guess = F.coalesce(F.try_element_at("cells", F.col("cell")), F.col("otherwise"))
        wrong = F.coalesce((F.col("y") != guess).cast("int"), F.lit(0))
        scored = asked.select("run", "pos", F.col("y").alias("y_true"), guess.alias("y_pred"), wrong.alias("err"), F.lit(1.0).alias("confidence"))
        return materialize(scored, "scored"), plan.log(models.select(*model, F.lit(0.0).alias("train_seconds")))

    def fit(self, rows, name, label, seeds):
        cell = self.features[0]
        counts = rows.filter(col(label).isNotNull()).groupBy(name, cell, label).agg(F.count(F.lit(1)).alias("n"))
        found: dict[str, dict] = {}
        for r in counts.collect():  # models x cells x labels
            found.setdefault(r[name], {}).setdefault(r[cell], {})[r[label]] = r["n"]
        out = {}
        for m, cells in found.items():
            total: dict[str, int] = {}
            for by_label in cells.values():
                for x, n in by_label.items():
                    total[x] = total.get(x, 0) + n
            labels = sorted(total)
            first = lambda d: labels.index(min(d, key=lambda x: (-d[x], x)))  # noqa: E731, B023
            out[m] = CellTable(self.features, labels, {int(c): first(d) for c, d in cells.items() if c is not None}, first(total))
        return out


@dataclass
class Run:
    """State of one run between turns."""

    name: str
    strategy: str
    seed: int
    policy: RetrainPolicy
    at: int = 0  # next position to score
    reach: int = 1  # length of the next stretch, in first lengths
    last: int = 0  # position of the last trigger
    model: str = ""
    detector: bytes = b""
    due: int | None = None  # trigger whose model is still to be fitted
    log: list[dict] = field(default_factory=list)


@dataclass
class Grid:
    """Predictions of all runs and one log row per trigger."""

    predictions: DataFrame
    log: DataFrame


LOG = "strategy string, seed long, pos long, window_rows long, n_classes int, retrained boolean, train_seconds double"
SCORED = "run int, pos long, y_true string, y_pred string, err int, confidence double"


def run_grid(
    stream: DataFrame,
    learner: Learner,
    label: str,
    policies: list[RetrainPolicy],
    warm_rows: int,
    seeds: tuple[int, ...] = (42,),
    window_rows: int = WINDOW_ROWS,
    minimum: int = MINIMUM_ROWS,
    method: str = "adwin",
    detector_params: dict | None = None,
    key: list[str] | None = None,
    share: float = 1.0,
    stretch_rows: int = STRETCH_ROWS,
) -> Grid:
    """Run every policy under every seed over ``stream`` (dense ``pos`` from 0).

    The first ``warm_rows`` rows fit the first model, one per seed.  Positions of triggers and
    periods count from the row after them.  A trigger needs ``minimum`` rows and two labels among
    the last ``window_rows`` rows of the stream so far, else the model stays; it takes effect with
    the next row.  With ``share`` below 1 a model sees that share of its rows, drawn by the run's
    seed and the ``key`` columns.  Rows without a label are scored and count as no error.
    """
    spark = stream.sparkSession
    ship_package(spark)
    key = key or ["pos"]
    needed = list(dict.fromkeys(["pos", label, *learner.features, *key]))
    # sorted, so that a range of positions reads few row groups
    stored = materialize(stream.select(*[col(c) for c in needed]).repartitionByRange("pos").sortWithinPartitions("pos"), "stream")
    end = (stored.agg(F.max("pos")).first()[0] or -1) + 1 - warm_rows
    runs = []
    for seed in seeds:
        for policy in policies:
            run = Run(f"{policy.name}|{seed}", policy.name, seed, policy, last=policy.first_trigger_base, model=f"first|{seed}")
            run.detector = pickle.dumps(create(method, **(detector_params or {}))) if policy.needs_drifts else b""
            runs.append(run)
    models: dict[str, object] = {}
    fits = {f"first|{seed}": (seed, -warm_rows, -1) for seed in seeds}
    guards: dict[str, tuple[int, int]] = {}

    def first() -> dict[int, object]:
        guards.update(_fit(stored, learner, label, fits, warm_rows, key, share, minimum, models))
        fits.clear()
        return {seed: models[f"first|{seed}"] for seed in seeds}

    known, done = {i: r for i, r in enumerate(runs) if not r.policy.needs_drifts}, None
    if known and end > 0 and learner.in_tables(window_rows):
        done = learner.run(stored, label, known, end, warm_rows, window_rows, minimum, key, share, first)
        for i in known:
            runs[i].at = end
        if len(known) == len(runs):
            fits = {}
    folder, cuts, turn = new_path(spark, "grid"), [], 0
    while fits or any(r.at < end for r in runs):
        facts = _fit(stored, learner, label, fits, warm_rows, key, share, minimum, models)
        guards |= facts
        for run in runs:
            if run.due is not None:
                _settle(run, run.due, _name(run, run.due), guards, models)
                run.due = None
        fits = {}
        plans = [_plan(run, end, max(1, AHEAD // len(runs)), stretch_rows) for run in runs]
        ahead = {_name(run, t): (run.seed, max(0, t - window_rows + 1), t) for run, (_, triggers) in zip(runs, plans) for t in triggers if not run.policy.needs_drifts}
        if ahead:
            guards |= _fit(stored, learner, label, ahead, warm_rows, key, share, minimum, models)
        segments = []
        for i, (run, (stop, triggers)) in enumerate(zip(runs, plans)):
            for t in triggers:
                segments.append((i, run.at, t, run.model))
                _settle(run, t, _name(run, t), guards, models)
                run.at, run.last = t + 1, t
            if run.at <= stop:
                segments.append((i, run.at, stop, run.model))
        segments = [s for s in segments if s[1] <= s[2]]
        if not segments:
            break
        _score(stored, label, warm_rows, segments, models).write.parquet(f"{folder}/turn={turn}")
        found = _fold(spark.read.parquet(f"{folder}/turn={turn}"), runs, [s for s in segments if runs[s[0]].policy.needs_drifts])
        for i, start, stop, _ in segments:
            run = runs[i]
            if i in found:
                trigger, state = found[i]
                run.detector = state
                stop = stop if trigger is None else trigger
                run.reach = min(2 * run.reach, MOST_STRETCHES) if trigger is None else 1
                if trigger is not None:
                    run.last, run.due = trigger, trigger
                    fits[_name(run, trigger)] = (run.seed, max(0, trigger - window_rows + 1), trigger)
            run.at = max(run.at, stop + 1)
            cuts.append((turn, i, start, stop))
        live = {r.model for r in runs}
        for name in [m for m in models if m not in live]:
            del models[name]
        turn += 1
    names = spark.createDataFrame([(i, r.strategy, r.seed) for i, r in enumerate(runs)], "run int, strategy string, seed long")
    log = spark.createDataFrame([(r.strategy, r.seed, *[e[k] for k in ("pos", "window_rows", "n_classes", "retrained", "train_seconds")]) for r in runs for e in r.log], LOG)
    if done:
        log = log.unionByName(done[1])
    if not turn:
        rows = done[0] if done else spark.createDataFrame([], SCORED)
        return Grid(rows.join(F.broadcast(names), "run").drop("run"), log)
    # one row per run and turn, so the cuts are small
    kept = spark.createDataFrame(cuts, "turn int, run int, start long, stop long").groupBy("turn", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    scored = spark.read.option("basePath", folder).parquet(folder)
    rows = scored.join(F.broadcast(kept), ["turn", "run"]).filter("pos BETWEEN start AND stop").drop("turn", "start", "stop")
    rows = rows.unionByName(done[0]) if done else rows
    return Grid(rows.join(F.broadcast(names), "run").drop("run"), log)


def _name(run: Run, trigger: int) -> str:
    return f"{run.name}|{trigger}"


def _settle(run: Run, trigger: int, name: str, guards: dict, models: dict) -> None:
    """Log a trigger and go over to its model, if the guard let it be fitted."""
    rows, classes = guards.get(name, (0, 0))
    fitted = name in models
    seconds = float(getattr(models.get(name), "metadata", {}).get("training_time_s", 0.0)) if fitted else 0.0
    run.log.append({"pos": trigger, "window_rows": rows, "n_classes": classes, "retrained": fitted, "train_seconds": seconds})
    if fitted:
        run.model = name


def _plan(run: Run, end: int, ahead: int, stretch_rows: int) -> tuple[int, list[int]]:
    """Last position of the stretch to score now, and the triggers known to lie in it."""
    if run.at >= end:
        return run.at - 1, []
    if run.policy.needs_drifts:
        return min(run.at + run.reach * stretch_rows, end) - 1, []
    triggers = run.policy.planned(run.last, run.at, end, ahead)
    return (end - 1 if len(triggers) < ahead else triggers[-1]), triggers


def _fit(stored, learner, label, fits, warm_rows, key, share, minimum, models) -> dict[str, tuple[int, int]]:
    """Fit the models whose rows (first, last position, counted after the warm rows) pass the guard."""
    if not fits:
        return {}
    spans = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a + warm_rows).alias("a"), F.lit(b + warm_rows).alias("b"), F.lit(s).alias("seed")) for n, (s, a, b) in fits.items()])
    low, high = min(a for _, a, _ in fits.values()) + warm_rows, max(b for _, _, b in fits.values()) + warm_rows
    mine = F.filter(spans, lambda s: (s["a"] <= F.col("pos")) & (F.col("pos") <= s["b"]))
    rows = stored.filter((F.col("pos") >= low) & (F.col("pos") <= high)).select("*", F.explode(mine).alias("_fit")).select("*", F.col("_fit.name").alias("_name"), F.col("_fit.seed").alias("_seed")).drop("_fit")
    counts = rows.groupBy("_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k")).collect()  # one row per model
    facts = {r["_name"]: (r["n"], r["k"]) for r in counts}
    passed = [n for n, (rows_, k) in facts.items() if n.startswith("first|") or (rows_ >= minimum and k >= 2)]
    if passed:
        chosen = rows.filter(F.col("_name").isin(passed))
        if share < 1:
            bits = None
            for seed in sorted({fits[n][0] for n in passed}):
                here = F.when(F.col("_seed") == seed, hash_uniform(seed, *key) < share)
                bits = here if bits is None else F.coalesce(bits, here)
            chosen = chosen.filter(bits)
        models |= learner.fit(chosen, "_name", label, {n: fits[n][0] for n in passed})
    return facts


def _score(stored: DataFrame, label: str, warm_rows: int, segments: list, models: dict) -> DataFrame:
    """All segments (run, first, last position, model) in one pass over the stream."""
    spark = stored.sparkSession
    names = sorted({s[3] for s in segments})
    held = spark.sparkContext.broadcast({n: models[n] for n in names})  # at most AHEAD models and one per run
    low, high = min(s[1] for s in segments) + warm_rows, max(s[2] for s in segments) + warm_rows

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            pos = chunk["pos"].to_numpy() - warm_rows
            seen: dict[tuple, tuple] = {}
            for i, first, last, name in segments:
                at = np.flatnonzero((pos >= first) & (pos <= last))
                if not len(at):
                    continue
                mark = (name, int(at[0]), len(at), int(at[-1]))
                if mark not in seen:  # runs that still share a model score once
                    model, part = held.value[name], chunk.iloc[at]
                    p = model.probabilities([part[f].to_numpy(dtype=float, na_value=np.nan) for f in model.features])
                    seen[mark] = (np.array(model.labels, dtype=object)[p.argmax(axis=1)], p.max(axis=1))
                y_pred, confidence = seen[mark]
                y = chunk[label].to_numpy(dtype=object)[at]
                known = pd.notna(y)
                yield pd.DataFrame({
                    "run": np.full(len(at), i, dtype=np.int32), "pos": pos[at], "y_true": y, "y_pred": y_pred,
                    "err": ((y != y_pred) & known).astype(np.int32), "confidence": confidence,
                })

    # dealt anew, as a few files hold the whole stretch; runs that share a model are told apart by sorted positions
    dealt = stored.filter((F.col("pos") >= low) & (F.col("pos") <= high)).repartition(-(-(high - low + 1) // SCORE_ROWS), F.floor(F.col("pos") / F.lit(SCORE_ROWS)))
    return dealt.sortWithinPartitions("pos").mapInPandas(run, SCORED)


def _fold(scored: DataFrame, runs: list[Run], segments: list) -> dict[int, tuple[int | None, bytes]]:
    """Per drift-triggered run: the first due drift of its stretch, if any, and the detector after it."""
    if not segments:
        return {}
    states = {i: (runs[i].detector, runs[i].last, runs[i].policy.cooldown) for i, *_ in segments}

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raw, last, cooldown = states[key[0]]
        detector, rows = pickle.loads(raw), rows.sort_values("pos")
        pos, due = rows["pos"].to_numpy(), None
        for i, state in detector.scan(rows["err"].to_numpy(dtype=float)):
            if state == "drift" and pos[i] - last >= cooldown:
                due = int(pos[i])
                break
        return pd.DataFrame({"run": [key[0]], "due": pd.Series([due], dtype="Int64"), "state": [pickle.dumps(detector)]})

    # a stretch of one run is one task's input, bounded by its length
    chosen = scored.filter(F.col("run").isin(list(states))).select("run", "pos", "err")
    found = chosen.groupBy("run").applyInPandas(fold, "run int, due long, state binary").collect()  # one row per run
    return {r["run"]: (r["due"], bytes(r["state"])) for r in found}


def policy_table(grid: Grid) -> DataFrame:
    """Triggers, retrains and training seconds per run."""
    runs = grid.predictions.groupBy("strategy", "seed").agg(F.count(F.lit(1)).alias("n_rows"))
    costs = grid.log.groupBy("strategy", "seed").agg(
        F.count(F.lit(1)).alias("n_triggered"), F.count_if("retrained").alias("n_retrains"), F.sum("train_seconds").alias("train_seconds")
    )
    return runs.join(costs, ["strategy", "seed"], "left").fillna(0, ["n_triggered", "n_retrains"]).fillna(0.0, ["train_seconds"])
