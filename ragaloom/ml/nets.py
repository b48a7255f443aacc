"""Neural nets in numpy, trained where the rows are: each part of the rows runs an epoch, and the parts' weights are averaged."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragaloom.functions import arrays
from ragaloom.operators import evaluate
from ragaloom.session import Written

#: What a model reads: the 12 shares of pitch classes, or a contour of a fixed number of cents.
MODES = {"pcd": 12, "contour": 4000}
#: Parts whose weights are averaged in one task, at most.
PARTS = 64


class Dense:
    """A linear layer."""

    def __init__(self, inputs: int, outputs: int, draw: np.random.Generator) -> None:
        reach = 1 / np.sqrt(inputs)
        self.weights = {"w": draw.uniform(-reach, reach, (inputs, outputs)), "b": draw.uniform(-reach, reach, outputs)}
        self.state: dict[str, np.ndarray] = {}

    def forward(self, x: np.ndarray, learning: bool, draw: np.random.Generator) -> np.ndarray:
        self.x = x
        return x @ self.weights["w"] + self.weights["b"]

    def backward(self, slope: np.ndarray) -> np.ndarray:
        self.slopes = {"w": self.x.T @ slope, "b": slope.sum(0)}
        return slope @ self.weights["w"].T


class Convolution:
    """A convolution over (rows, channels, places) that keeps the number of places; the width is odd."""

    def __init__(self, inputs: int, outputs: int, width: int, draw: np.random.Generator) -> None:
        reach = 1 / np.sqrt(inputs * width)
        self.width = width
        self.weights = {"w": draw.uniform(-reach, reach, (outputs, inputs, width)), "b": draw.uniform(-reach, reach, outputs)}
        self.state: dict[str, np.ndarray] = {}

    def _views(self, x: np.ndarray) -> np.ndarray:
        pad = self.width // 2
        return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (pad, pad))), self.width, axis=2)

    def forward(self, x: np.ndarray, learning: bool, draw: np.random.Generator) -> np.ndarray:
        self.views = self._views(x)
        return np.einsum("rcpk,ock->rop", self.views, self.weights["w"], optimize=True) + self.weights["b"][:, None]

    def backward(self, slope: np.ndarray) -> np.ndarray:
        self.slopes = {"w": np.einsum("rop,rcpk->ock", slope, self.views, optimize=True), "b": slope.sum((0, 2))}
        return np.einsum("ropk,ock->rcp", self._views(slope), self.weights["w"][:, :, ::-1], optimize=True)


class Normal:
    """Batch normalisation over channels; running moments are used when not learning."""

    def __init__(self, channels: int, momentum: float = 0.1) -> None:
        self.momentum = momentum
        self.weights = {"g": np.ones(channels), "b": np.zeros(channels)}
        self.state = {"mean": np.zeros(channels), "var": np.ones(channels)}

    def forward(self, x: np.ndarray, learning: bool, draw: np.random.Generator) -> np.ndarray:
        mean, var = (x.mean((0, 2)), x.var((0, 2))) if learning else (self.state["mean"], self.state["var"])
        if learning:
            n = x.shape[0] * x.shape[2]
            self.state["mean"] = (1 - self.momentum) * self.state["mean"] + self.momentum * mean
            self.state["var"] = (1 - self.momentum) * self.state["var"] + self.momentum * var * n / max(n - 1, 1)
        self.scale = 1 / np.sqrt(var + 1e-5)
        self.normal = (x - mean[:, None]) * self.scale[:, None]
        return self.normal * self.weights["g"][:, None] + self.weights["b"][:, None]

    def backward(self, slope: np.ndarray) -> np.ndarray:
        self.slopes = {"g": (slope * self.normal).sum((0, 2)), "b": slope.sum((0, 2))}
        inner = slope * self.weights["g"][:, None]
        centred = inner - inner.mean((0, 2))[:, None] - self.normal * (inner * self.normal).mean((0, 2))[:, None]
        return centred * self.scale[:, None]


class _Plain:
    weights: dict[str, np.ndarray] = {}
    state: dict[str, np.ndarray] = {}
    slopes: dict[str, np.ndarray] = {}


class Rectify(_Plain):
    """What is over 0."""

    def forward(self, x: np.ndarray, learning: bool, draw: np.random.Generator) -> np.ndarray:
        self.on = x > 0
        return x * self.on

    def backward(self, slope: np.ndarray) -> np.ndarray:
        return slope * self.on


class Dropout(_Plain):
    """Leaves out a part of the values while learning."""

    def __init__(self, part: float) -> None:
        self.part = part

    def forward(self, x: np.ndarray, learning: bool, draw: np.random.Generator) -> np.ndarray:
        self.kept = (draw.random(x.shape) >= self.part) / (1 - self.part) if learning else np.ones(1)
        return x * self.kept

    def backward(self, slope: np.ndarray) -> np.ndarray:
        return slope * self.kept


class Pool(_Plain):
    """The largest of every few places; a tail that is shorter is dropped."""

    def __init__(self, width: int) -> None:
        self.width = width

    def forward(self, x: np.ndarray, learning: bool, draw: np.random.Generator) -> np.ndarray:
        self.shape, n = x.shape, x.shape[2] // self.width
        cut = x[:, :, : n * self.width].reshape(*x.shape[:2], n, self.width)
        self.best = cut.argmax(3)
        return cut.max(3)

    def backward(self, slope: np.ndarray) -> np.ndarray:
        out, cut = np.zeros(self.shape), np.zeros((*slope.shape, self.width))
        np.put_along_axis(cut, self.best[..., None], slope[..., None], 3)
        out[:, :, : slope.shape[2] * self.width] = cut.reshape(*slope.shape[:2], -1)
        return out


class Mean(_Plain):
    """The mean over all places."""

    def forward(self, x: np.ndarray, learning: bool, draw: np.random.Generator) -> np.ndarray:
        self.shape = x.shape
        return x.mean(2)

    def backward(self, slope: np.ndarray) -> np.ndarray:
        return np.broadcast_to(slope[:, :, None] / self.shape[2], self.shape)


class Net:
    """Layers for a mode: ``pcd`` is inputs(12)-128-64-classes with dropout, ``contour`` three convolutions of width 7, each
    normalised, rectified and pooled by 4, their mean, and two linear layers. Null vectors can't be read."""

    def __init__(self, mode: str, labels: list[str], hidden: tuple[int, ...] | None = None, dropout: float = 0.3, seed: int = 42, inputs: int | None = None) -> None:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        self.mode, self.labels, self.dropout, self.seed = mode, list(labels), dropout, seed
        self.inputs = inputs or MODES[mode]
        self.hidden = hidden or ((128, 64) if mode == "pcd" else (16, 32, 64))
        draw, n = np.random.default_rng(seed), len(labels)
        if mode == "pcd":
            sizes = (self.inputs, *self.hidden)
            self.layers = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (Dense(a, b, draw), Rectify(), Dropout(dropout))] + [Dense(sizes[-1], n, draw)]
        else:
            sizes = (1, *self.hidden)
            self.layers = [x for a, b in zip(sizes, sizes[1:], strict=False) for x in (Convolution(a, b, 7, draw), Normal(b), Rectify(), Pool(4))]
            self.layers += [Mean(), Dense(sizes[-1], sizes[-1], draw), Rectify(), Dropout(dropout), Dense(sizes[-1], n, draw)]

    def shaped(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors as the first layer takes them: (rows, 12), or (rows, 1, places)."""
        return vectors if self.mode == "pcd" else vectors[:, None, :]

    def logits(self, vectors: np.ndarray, learning: bool = False, draw: np.random.Generator | None = None) -> np.ndarray:
        x = self.shaped(np.asarray(vectors, np.float64))
        for layer in self.layers:
            x = layer.forward(x, learning, draw or np.random.default_rng(0))
        return x

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        z = self.logits(vectors)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def parameters(self) -> dict[str, np.ndarray]:
        """All weights and running moments by layer and name."""
        return {f"{i}.{k}": v for i, layer in enumerate(self.layers) for k, v in {**layer.weights, **layer.state}.items()}

    def take(self, parameters: dict[str, np.ndarray]) -> Net:
        """Sets the weights and moments."""
        for name, value in parameters.items():
            layer, key = self.layers[int(name.split(".")[0])], name.split(".")[1]
            (layer.weights if key in layer.weights else layer.state)[key] = np.array(value)
        return self

    def packed(self) -> bytes:
        """The net as bytes: its shape, labels and weights."""
        out = io.BytesIO()
        about = {"mode": self.mode, "labels": self.labels, "hidden": self.hidden, "dropout": self.dropout, "seed": self.seed, "inputs": self.inputs}
        np.savez(out, about=np.frombuffer(json.dumps(about, ensure_ascii=False).encode(), np.uint8), **self.parameters())
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Net:
        """A net from its bytes."""
        with np.load(io.BytesIO(data)) as held:
            about = json.loads(held["about"].tobytes())
            net = Net(about["mode"], about["labels"], tuple(about["hidden"]), about["dropout"], about["seed"], about["inputs"])
            return net.take({k: held[k] for k in held.files if k != "about"})


@dataclass
class Adam:
    """Adam with its published defaults."""

    rate: float = 1e-3
    step: int = 0
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def update(self, net: Net) -> None:
        self.step += 1
        for i, layer in enumerate(net.layers):
            for key in layer.weights:
                g = layer.slopes[key]
                first, second = self.moments.get(f"{i}.{key}", (np.zeros_like(g), np.zeros_like(g)))
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                self.moments[f"{i}.{key}"] = first, second
                layer.weights[key] -= self.rate * (first / (1 - 0.9**self.step)) / (np.sqrt(second / (1 - 0.999**self.step)) + 1e-8)


def run_epoch(net: Net, vectors: np.ndarray, codes: np.ndarray, adam: Adam | None, batch: int, draw: np.random.Generator, change: Callable[[np.ndarray, np.random.Generator], np.ndarray] | None = None) -> tuple[float, int]:
    """(summed loss, right answers) over the rows in batches; with ``adam`` the net learns, in a drawn order."""
    order, loss, right = draw.permutation(len(codes)) if adam else np.arange(len(codes)), 0.0, 0
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        x, y = vectors[some], codes[some]
        if adam and change:
            x = np.stack([change(v, draw) for v in x])
        z = net.logits(x, adam is not None, draw)
        z = z - z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
        right += int((p.argmax(1) == y).sum())
        if adam:
            slope = p
            slope[np.arange(len(y)), y] -= 1
            slope /= len(y)
            for layer in reversed(net.layers):
                slope = layer.backward(slope)
            adam.update(net)
    return loss, right


def _coded(rows: DataFrame, net: Net) -> DataFrame:
    """(code, features) of rows (label, features); an unknown label fails the job, null labels or features are left out."""
    labels = F.array(*[F.lit(x) for x in net.labels])
    code = F.array_position(labels, F.col("label")) - 1
    fine = rows.filter("label is not null and features is not null")
    unknown = F.raise_error(F.concat(F.lit("unknown label "), "label")).cast("long")
    return fine.select(F.when(code >= 0, code).otherwise(unknown).cast("int").alias("code"), fitting(F.col("features"), net.mode, net.inputs).alias("features"))


def fitting(features: Column, mode: str, length: int | None = None) -> Column:
    """The features in the length that the mode takes: contours are cut or padded around their middle."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    values = features.cast("array<double>")
    return values if mode == "pcd" else arrays.fixed_length(values, length or MODES[mode])


def _pass(rows: DataFrame, net: Net, learning: dict | None) -> tuple[float, int, int, bytes | None]:
    """One epoch over all rows, part by part in the tasks: (summed loss, right, rows, averaged net)."""
    shared = rows.sparkSession.sparkContext.broadcast((net.packed(), learning))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        codes = np.concatenate([b["code"].to_numpy() for b in held])
        vectors = np.stack([np.asarray(v, np.float64) for b in held for v in b["features"]])
        data, how = shared.value
        mine = Net.unpacked(data)
        draw = np.random.default_rng([*(how or {}).get("seed", (0,)), len(codes), int(codes[0])])
        loss, right = run_epoch(mine, vectors, codes, Adam(how["rate"]) if how else None, how["batch"] if how else 1024, draw, how and how["change"])
        yield pd.DataFrame([(loss, right, len(codes), mine.packed() if how else None, int(codes.sum() + len(codes)) % PARTS)], columns=["loss", "right", "n", "net", "part"])

    schema = "loss double, right long, n long, net binary, part int"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        nets, n = [Net.unpacked(x).parameters() for x in pdf["net"]], pdf["n"].to_numpy(float)
        mean = {k: sum(p[k] * w for p, w in zip(nets, n, strict=True)) / n.sum() for k in nets[0]}
        whole = Net.unpacked(pdf["net"].iloc[0]).take(mean)
        return pd.DataFrame([(pdf["loss"].sum(), pdf["right"].sum(), pdf["n"].sum(), whole.packed(), 0)], columns=list(pdf.columns))

    parts = rows.mapInPandas(part, schema)
    if learning is None:
        told = parts.agg(F.sum("loss").alias("loss"), F.sum("right").alias("right"), F.sum("n").alias("n")).first()
        return told["loss"] or 0.0, told["right"] or 0, told["n"] or 0, None
    halves = parts.groupBy("part").applyInPandas(merge, schema).toPandas()
    if not len(halves):
        return 0.0, 0, 0, None
    whole = merge(halves).iloc[0]
    return float(whole["loss"]), int(whole["right"]), int(whole["n"]), bytes(whole["net"])


@dataclass
class History:
    """What a training was like: mean loss and accuracy of each epoch, the best one, and whether it was stopped early."""

    train_loss: list[float] = field(default_factory=list)
    train_accuracy: list[float] = field(default_factory=list)
    val_loss: list[float] = field(default_factory=list)
    val_accuracy: list[float] = field(default_factory=list)
    best_epoch: int = 0
    best_val_loss: float = float("inf")
    stopped: bool = False


def train(net: Net, rows: DataFrame, held_out: DataFrame | None = None, epochs: int = 50, batch: int = 32, rate: float = 1e-3, patience: int = 8,
          change: Callable[[np.ndarray, np.random.Generator], np.ndarray] | None = None, checkpoint: str | None = None, part_rows: int = 4096) -> tuple[Net, History]:
    """The net trained on ``rows`` (label, features), and its history. Nothing of the rows goes to the driver.

    The rows are dealt into parts of about ``part_rows``. In each epoch every part starts from the same weights, runs
    over its rows in batches with Adam, and the parts' weights are averaged by their rows; one part is plain training.
    Losses and accuracies are means over rows. With ``held_out`` the net of the lowest loss on it is kept, and training
    ends after ``patience`` epochs without a lower one; without, the last net is kept. The kept net is written to
    ``checkpoint`` whenever it changes. ``change`` alters a vector while learning (see ``augment``). Rows without label
    or features are left out, an unknown label is an error, and without rows the net stays as it is.
    """
    spark, history, best = rows.sparkSession, History(), net
    known = Written(_coded(rows, net), "train").df
    n = known.count()
    parts = max(1, -(-n // part_rows))
    dealt = Written(known.repartition(parts) if parts > 1 else known.coalesce(1), "parts").df
    seen = Written(_coded(held_out, net), "held").df if held_out is not None else None
    for epoch in range(1, (epochs if n else 0) + 1):
        loss, right, n, data = _pass(dealt, net, {"rate": rate, "batch": batch, "change": change, "seed": (net.seed, epoch)})
        net = Net.unpacked(data)
        history.train_loss.append(loss / max(n, 1))
        history.train_accuracy.append(right / max(n, 1))
        if seen is None:
            best, history.best_epoch = net, epoch
        else:
            loss, right, m, _ = _pass(seen, net, None)
            history.val_loss.append(loss / max(m, 1))
            history.val_accuracy.append(right / max(m, 1))
            if history.val_loss[-1] < history.best_val_loss:
                best, history.best_epoch, history.best_val_loss = net, epoch, history.val_loss[-1]
        if checkpoint and history.best_epoch == epoch:
            save(spark, best, checkpoint)
        if seen is not None and epoch - history.best_epoch >= patience:
            history.stopped = True
            break
    return best, history


def told(net: Net, rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` (features and any others) with ``probabilities`` array<double>, by label; null where features are null."""
    shared = rows.sparkSession.sparkContext.broadcast(net.packed())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Net.unpacked(shared.value)
        for batch in batches:
            fine = batch.pop("_vector").reset_index(drop=True)
            fine = fine[fine.notna()]
            out = pd.Series([None] * len(batch), dtype=object)
            for at in range(0, len(fine), 256):
                some = fine.iloc[at : at + 256]
                out.loc[some.index] = pd.Series(list(mine.probabilities(np.stack(some.to_list()))), index=some.index)
            yield batch.assign(probabilities=out.to_numpy())

    read = rows.withColumn("_vector", fitting(F.col("features"), net.mode, net.inputs))
    return read.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType()))]))


def top(net: Net, rows: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, rank, raga_name, confidence) of the k likeliest labels of each row; ties go to the label that sorts first."""
    names = F.array(*[F.lit(x) for x in net.labels])
    each = told(net, rows.select(key, "features")).filter("probabilities is not null").select(key, F.posexplode("probabilities").alias("code", "confidence"))
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "code")
    return each.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "rank", F.get(names, F.col("code")).alias("raga_name"), "confidence")


def evaluated(net: Net, rows: DataFrame) -> tuple[dict, DataFrame, DataFrame]:
    """(overall accuracy, mean loss and n; accuracy of each label that occurs; confusion counts) on rows (label, features)."""
    names = F.array(*[F.lit(x) for x in net.labels])
    scored = told(net, rows.filter("label is not null and features is not null").select("label", "features")).select(
        "label", F.get(names, F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1).alias("prediction"),
        (-F.ln(F.greatest(F.get("probabilities", F.array_position(names, F.col("label")).cast("int") - 1), F.lit(1e-300)))).alias("loss"))
    held = Written(scored, "scored").df
    whole = held.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.avg("loss").alias("loss")).first()
    return {"n": whole["n"], "overall_accuracy": whole["accuracy"] or 0.0, "loss": whole["loss"] or 0.0}, evaluate.by_class(held), evaluate.confusion(held)


def save(spark: SparkSession, net: Net, path: str) -> None:
    """Writes the net with its labels; what was there is replaced."""
    spark.createDataFrame([(net.mode, net.labels, net.packed())], "mode string, labels array<string>, net binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, mode: str | None = None) -> Net:
    """The net of a path; a mode other than its own is an error."""
    row = spark.read.parquet(path).first()
    if mode is not None and row["mode"] != mode:
        raise ValueError(f"the net reads {row['mode']}, not {mode}")
    return Net.unpacked(bytes(row["net"]))
