"""Training by many tasks at once: each has a part of the examples, and every step sums all parts' gradients.

A step is a job: weights go out with it, a gradient a task comes back (those of more than MOST_SUMS tasks are added up by tasks first), and the driver moves the weights. All examples count, however many there are: they stay in
the executors' memory between steps, what doesn't fit on their disks, and are made again where an executor is lost. (A barrier stage whose tasks keep the weights and exchange gradients by allGather was tried: its steps took as long.)
Gradients are summed in the order of tasks, steps take examples by a hash of their key, and nothing else is random, so results don't depend on how examples are dealt out but for the last bits of sums.

Two phases: the head alone, then all weights. Steps are by AdamW (decay apart from the gradient), with a cosine schedule in each phase, smoothed labels, class weights, and gradients clipped by their norm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import spectral
from ..operators.evaluate import report
from ..operators.lapped import apply_matrix, slices, worker_path
from ..operators.quant import let
from ..operators.spectral import FRAME, HOP, short_time
from ..registry import query
from ..tables import N1, traces
from .network import Network

#: Rows of a part up to MOST_SUMS parts and the most beyond that, and the sums that come to the driver at most.
PART_ROWS, MOST_PART_ROWS, MOST_SUMS = 500, 5_000, 64
#: Grids that a task puts through the network at once: each takes some 500 kB while gradients are made.
SLICE_ROWS = 64


@dataclass(frozen=True)
class Plan:
    """Epochs of each phase and their first learning rates, steps an epoch, and the rules of a step."""

    epochs: tuple[int, int] = (1, 5)
    rates: tuple[float, float] = (0.02, 0.008)
    steps: int = 4
    decay: float = 1e-4
    smoothing: float = 0.1
    clip: float = 5.0
    moments: tuple[float, float] = (0.9, 0.999)
    seed: int = 42

    def rate(self, phase: int, step: int) -> float:
        """The cosine schedule: from the phase's rate towards 0 at its end."""
        return self.rates[phase] * 0.5 * (1 + np.cos(np.pi * step / max(1, self.epochs[phase] * self.steps)))


@dataclass
class Adam:
    """AdamW's state; frozen parameters keep their values."""

    plan: Plan
    size: int
    step: int = 0
    mean: np.ndarray = field(init=False)
    square: np.ndarray = field(init=False)

    def __post_init__(self):
        self.mean, self.square = np.zeros(self.size), np.zeros(self.size)

    def moved(self, weights: np.ndarray, gradient: np.ndarray, rate: float, free: np.ndarray) -> np.ndarray:
        gradient = np.where(free, gradient, 0)
        norm = np.linalg.norm(gradient)
        if norm > self.plan.clip:
            gradient = gradient * (self.plan.clip / norm)
        self.step += 1
        a, b = self.plan.moments
        self.mean = a * self.mean + (1 - a) * gradient
        self.square = b * self.square + (1 - b) * gradient * gradient
        by = self.mean / (1 - a**self.step) / (np.sqrt(self.square / (1 - b**self.step)) + 1e-8)
        return np.where(free, weights - rate * (by + self.plan.decay * weights), weights)


@dataclass(frozen=True)
class Trained:
    network: Network
    classes: list
    weights: np.ndarray
    history: list[dict]


HISTORY = "epoch int, phase string, rate double, loss double, accuracy double, val_loss double, val_accuracy double, best boolean"


def parts_of(rows: int) -> int:
    """How many parts so many rows are dealt out to: they grow with the rows, so that a task's work has a bound."""
    return max(1, min(-(-rows // PART_ROWS), MOST_SUMS), -(-rows // MOST_PART_ROWS))


def added(sums: DataFrame) -> DataFrame:
    """Sums of parts (part: integer, sums: binary, doubles) added up in MOST_SUMS tasks, each in the order of parts; a task without any gives no row."""

    def run(batches):
        import pyarrow as pa

        total = 0.0
        for batch in batches:
            for one in batch.column(1):
                total = total + np.frombuffer(one.as_py())
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sums.select("part", "sums").repartition(MOST_SUMS, F.col("part") % MOST_SUMS).sortWithinPartitions("part").mapInArrow(run, "sums binary")


def train(examples: DataFrame, network: Network, classes: list, plan: Plan = Plan(), parts: int | None = None) -> Trained:
    """Trains on examples (key: integer, grid: array of height x width numbers, label, held_out: boolean); the held-out ones choose the epoch whose weights count, the first of the best.

    Rows whose label is none of the classes, or whose grid is null or of another size, don't count. Classes weigh the same, however many rows each has.
    """
    if not classes or len(set(classes)) != len(classes) or network.classes != len(classes):
        raise ValueError("there must be as many different classes as the network has")
    spark = examples.sparkSession
    worker_path(spark)
    spark.sparkContext.environment["OMP_NUM_THREADS"] = "1"  # tasks share the cores already
    size = network.height * network.width
    usable = examples.where(F.col("label").isin(classes) & (F.size("grid") == size) & F.col("key").isNotNull())
    numbers = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    parts = parts or parts_of(usable.count())
    dealt = usable.select(F.col("key").cast("long"), F.col("grid").cast("array<double>"), numbers.cast("int").alias("label"), F.when(F.col("held_out"), -1).otherwise(F.pmod(draws.mix(F.col("key")), F.lit(plan.steps))).cast("int").alias("turn"), (~F.col("held_out")).alias("free")).repartition(parts, "key", F.xxhash64("grid")).persist()
    counts = {classes[r["label"]]: r["n"] for r in dealt.where("free").groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a class
    if not counts:
        dealt.unpersist()
        raise ValueError("no examples to learn from")
    each = np.array([sum(counts.values()) / (len(counts) * counts[c]) if c in counts else 0.0 for c in classes])

    def summed(flat: np.ndarray, turn: int, back: bool) -> np.ndarray:
        """Over the rows of a turn (-1: held out): gradient (if back), weighted loss, weights, cross-entropy, hits and rows."""

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            total, weights = np.zeros(len(flat) * back + 5), network.named(flat)
            for batch in batches:
                for part in slices([batch], SLICE_ROWS):
                    x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, network.height, network.width)
                    y = part.column(1).to_numpy()
                    targets = np.eye(len(classes))[y] * (1 - plan.smoothing) + plan.smoothing / len(classes)
                    chance = network.chances(weights, x)
                    judged = [-(targets * np.log(np.maximum(chance, 1e-300))).sum(), (chance.argmax(1) == y).sum(), len(y)]
                    loss, gradient = network.gradients(weights, x, targets, each[y]) if back else (0.0, [])
                    total += np.concatenate([gradient, [loss, each[y].sum()], judged])
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

        rows = dealt.where(F.col("turn") == turn).select("grid", "label").mapInArrow(run, "part int, sums binary")  # a row a part
        return np.sum([np.frombuffer(r["sums"]) for r in (added(rows) if parts > MOST_SUMS else rows).collect()], 0)

    of = lambda s, i: float(s[i] / s[-1]) if s[-1] else None
    flat, head_only = network.flat(network.initial(plan.seed)), ~network.backbone()
    best, best_score, history, epoch = flat, None, [], 0
    try:
        for phase in range(2):
            free, adam = head_only if phase == 0 else np.ones(len(flat), bool), Adam(plan, len(flat))
            for k in range(plan.epochs[phase]):
                sums = np.zeros(3)
                for step in range(plan.steps):
                    got = summed(flat, step, True)
                    rate, sums = plan.rate(phase, k * plan.steps + step), sums + got[-3:]
                    if got[-4] > 0:
                        flat = adam.moved(flat, got[: len(flat)] / got[-4], rate, free)
                val = summed(flat, -1, False)
                history.append({"epoch": epoch, "phase": ("head", "all")[phase], "rate": float(rate), "loss": of(sums, -3), "accuracy": of(sums, -2), "val_loss": of(val, -3), "val_accuracy": of(val, -2), "best": False})
                score = (of(val, -2), -of(val, -3)) if val[-1] else (-of(sums, -3),)
                if best_score is None or score > best_score:
                    best, best_score = flat, score
                    for row in history:
                        row["best"] = row["epoch"] == epoch
                epoch += 1
    finally:
        dealt.unpersist()
    return Trained(network, classes, best, history)


def predicted(examples: DataFrame, model: Trained) -> DataFrame:
    """Adds pred (a class) and confidence to examples with a grid; null for a null grid or one of another size. The weights go to all tasks: as many numbers as the network has."""
    worker_path(examples.sparkSession)
    network, weights, size = model.network, model.network.named(model.weights), model.network.height * model.network.width
    kept = [c for c in examples.columns if c not in ("pred", "confidence")]
    ready = examples.select(*kept, F.when(F.size("grid") == size, F.col("grid").cast("array<double>")).alias("pred"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(len(kept))
            there = column.is_valid().to_numpy(zero_copy_only=False)
            x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, network.height, network.width)
            chance = np.concatenate([network.chances(weights, x[a : a + SLICE_ROWS]) for a in range(0, max(1, len(x)), SLICE_ROWS)])
            number, confidence = np.full(len(there), -1), np.full(len(there), np.nan)
            number[there], confidence[there] = chance.argmax(1), chance.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(number, pa.int32()), pa.array(confidence)], [*kept, "pred", "confidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    out = ready.mapInArrow(run, f"{schema}, pred int, confidence double")
    there = F.col("pred") >= 0
    return out.withColumn("confidence", F.when(there, F.col("confidence"))).withColumn("pred", F.when(there, F.element_at(F.array(*map(F.lit, model.classes)), F.greatest(F.col("pred"), F.lit(0)) + 1)))


HEIGHT, WIDTH = (N1 - FRAME) // HOP + 1, FRAME // 2 + 1


def spectrograms(df: DataFrame) -> DataFrame:
    """Adds grid to traces: amplitudes of the bins of overlapping frames, from -0.5 to 2.5 for the largest."""
    t = apply_matrix(df, "samples", short_time(), "s")
    half = HEIGHT * WIDTH
    power = F.zip_with(F.slice("s", 1, half), F.slice("s", half + 1, half), lambda c, s: c * c + s * s)
    return t.withColumn("grid", let(power, lambda p: let(F.array_max(p), lambda top: F.transform(p, lambda v: F.when(top > 0, F.sqrt(v / top)).otherwise(0.0) * 3 - 0.5)))).drop("s")


#: Bands of a trace's spectrum that its largest power may lie in: the classes.
BANDS = 4


def _fitted(spark, d, plan: Plan = Plan()) -> tuple[DataFrame, Trained]:
    """Traces as examples of the band that has their largest power (the given labels are independent of the traces), a tenth held out and a tenth left for tests, and the network trained on them."""
    band = spectral.power(spark, d).select("trace_id", F.least(F.floor((F.array_position("power", F.array_max(F.slice("power", 2, spectral.BINS - 1))) - 2) * BANDS / (spectral.BINS - 1)), F.lit(BANDS - 1)).cast("int").alias("label"))
    t = spectrograms(traces(spark, d)).join(band, "trace_id")
    part = F.floor(draws.uniform(F.col("trace_id"), 5) * 10)
    examples = t.select(F.col("trace_id").alias("key"), "grid", "label", (part == 8).alias("held_out"), (part == 9).alias("test"))
    return examples, train(examples.where("not test"), Network(HEIGHT, WIDTH, BANDS), list(range(BANDS)), plan)


@query("cnn_train_eval")
def cnn_train_eval(spark, d):
    """Precision, recall, f1 and support of each class of traces that a residual network hasn't seen."""
    examples, model = _fitted(spark, d)
    return report(predicted(examples.where("test"), model).select("label", "pred"))


@query("cnn_history")
def cnn_history(spark, d):
    """Epochs of a network's training: phase, last rate, losses and accuracies, and which epoch's weights count."""
    _, model = _fitted(spark, d)
    return spark.createDataFrame([tuple(r.values()) for r in model.history], HISTORY)
