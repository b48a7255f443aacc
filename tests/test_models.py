"""Nets, their training and storage, changes to vectors, and the classifiers over them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragaloom.ml import augment, nets, raga


def rows(spark, n=180, size=12, seed=3, mode="pcd"):
    r = np.random.default_rng(seed)
    def one(k):
        x = r.dirichlet(np.ones(size)) * 0.3
        x[k * 3] += 0.7
        return x
    if mode == "contour":
        t = np.arange(size)
        def one(k):  # noqa: F811
            return 200 * np.sin(2 * np.pi * t / (8 * (k + 1) ** 2)) + r.normal(0, 20, size)
    data = [(i, f"r{i % 3}", [float(v) for v in one(i % 3)]) for i in range(n)]
    return spark.createDataFrame(data, "id long, label string, features array<double>")


@pytest.mark.parametrize("mode,size,hidden", [("pcd", 5, (4, 3)), ("contour", 70, (2, 3, 2))])
def test_slopes_equal_differences(mode, size, hidden):
    r = np.random.default_rng(0)
    net = nets.Net(mode, ["a", "b", "c"], hidden=hidden, dropout=0.0, inputs=size)
    x, y = r.normal(size=(6, size)), r.integers(0, 3, 6)

    def loss():
        z = net.logits(x, True, r)
        return -(z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(6), y].mean()

    class Still:
        def update(self, net):
            pass

    nets.run_epoch(net, x, y, Still(), 6, np.random.default_rng(1))
    for layer in net.layers:
        for key, w in layer.weights.items():
            slope = layer.slopes[key].copy()
            for at in list(np.ndindex(w.shape))[:6]:
                held = w[at]
                w[at] = held + 1e-5
                up = loss()
                w[at] = held - 1e-5
                down = loss()
                w[at] = held
                assert abs((up - down) / 2e-5 - slope[at]) < 1e-7


@pytest.mark.parametrize("part_rows", [4096, 50])
def test_training_stops_early_and_is_kept(spark, tmp_path, part_rows):
    df = rows(spark)
    train, held = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    net = nets.Net("pcd", ["r0", "r1", "r2"])
    best, history = nets.train(net, train, held, epochs=30, rate=0.01, patience=3, checkpoint=str(tmp_path / "net"), part_rows=part_rows)
    assert history.val_loss[history.best_epoch - 1] == min(history.val_loss) == history.best_val_loss
    assert len(history.val_loss) == len(history.train_loss) <= 30 and (not history.stopped or len(history.val_loss) == history.best_epoch + 3)
    whole, by_label, confusion = nets.evaluated(best, held)
    assert whole["overall_accuracy"] > 0.9 and abs(whole["loss"] - history.best_val_loss) < 1e-6 and whole["n"] == 45
    assert {r["label"] for r in by_label.collect()} == {"r0", "r1", "r2"} and sum(r["n"] for r in confusion.collect()) == 45
    again = nets.load(spark, str(tmp_path / "net"), "pcd")
    assert nets.top(again, held, "id").collect() == nets.top(best, held, "id").collect()
    with pytest.raises(ValueError):
        nets.load(spark, str(tmp_path / "net"), "contour")


def test_training_edges(spark):
    df = rows(spark, 12)
    net = nets.Net("pcd", ["r0", "r1", "r2"])
    odd = df.unionByName(spark.createDataFrame([(90, None, [0.1] * 12), (91, "r0", None)], df.schema))
    _, history = nets.train(net, odd, epochs=2)
    assert len(history.train_loss) == 2 and history.val_loss == [] and history.best_epoch == 2
    same, history = nets.train(net, df.limit(0), df, epochs=3)
    assert same is net and history.train_loss == []
    with pytest.raises(Exception, match="unknown label other"):
        nets.train(net, df.withColumn("label", F.lit("other")), epochs=1)
    with pytest.raises(ValueError):
        nets.Net("other", ["a"])
    told = nets.top(net, odd, "id", 9).groupBy("id").count().collect()
    assert len(told) == 13 and {r["count"] for r in told} == {3}


def test_convolutions_learn_contours(spark):
    df = rows(spark, 90, 200, mode="contour")
    net, history = nets.train(nets.Net("contour", ["r0", "r1", "r2"], hidden=(4, 6, 8), inputs=256), df, df, epochs=12, rate=0.01)
    assert history.val_accuracy[history.best_epoch - 1] > 0.9
    vector = np.zeros((2, 256))
    assert net.shaped(vector).shape == (2, 1, 256) and nets.Net("pcd", ["a"]).shaped(np.zeros((1, 12))).shape == (1, 12)
    assert np.allclose(nets.Net.unpacked(net.packed()).probabilities(vector), net.probabilities(vector))


def test_changes():
    draw = np.random.default_rng(5)
    x = np.array([0.0, 1.0, 0.0, 2.0])
    assert sorted(augment.Roll()(x, draw)) == sorted(x)
    moved = augment.Offset(100)(x, draw)
    assert (moved[[0, 2]] == 0).all() and abs((moved - x)[1] - (moved - x)[3]) < 1e-12 and abs((moved - x)[1]) <= 100
    assert (augment.Noise(0.1)(x, draw) != x).all()
    both = augment.Compose([lambda v, d: v + 1, lambda v, d: v * 2])
    assert (both(x, draw) == (x + 1) * 2).all() and (augment.Compose([])(x, draw) == x).all()
    assert len(augment.usual("pcd").changes) == len(augment.usual("contour").changes) == 2
    with pytest.raises(ValueError):
        augment.usual("other")


def test_trained_with_changes(spark):
    net, history = nets.train(nets.Net("pcd", ["r0", "r1", "r2"]), rows(spark), epochs=2, change=augment.Compose([augment.Noise(0.01)]))
    assert len(history.train_accuracy) == 2 and np.isfinite(history.train_loss).all()


def test_stored_pipelines(spark, tmp_path):
    df = rows(spark, 60)
    model = raga.fit(df, "forest", trees=5)
    raga.save(model, str(tmp_path / "m"))
    again = raga.Classifier(spark, str(tmp_path / "m"))
    assert again.classify(df, "id").collect() == raga.top(model, df, "id").collect()
    labels = raga.labels_of(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in labels.orderBy("code").collect()] == [(0, "r0"), (1, "r1"), (2, "r2")]
    coded = raga.encoded(df.select("id", "label"), labels, "label")
    assert raga.decoded(coded.select("id", "code"), labels).join(df, ["id", "label"]).count() == 60
    with pytest.raises(Exception, match="unknown label"):
        raga.encoded(df.select("id", F.lit("x").alias("label")), labels, "label").collect()
    with pytest.raises(Exception, match="out of range"):
        raga.decoded(df.select("id", F.lit(7).alias("code")), labels).collect()
    assert raga.load(str(tmp_path / "none")) is None and raga.Classifier(spark, str(tmp_path / "none"), "pcd").model is None
    nothing = raga.Classifier(spark, None)
    assert nothing.classify(df, "id").collect() == [] and raga.Classifier.uncertain(nothing.classify(df, "id"), df, "id").filter("uncertain").count() == 60
    sure = raga.Classifier.uncertain(again.classify(df, "id"), df, "id")
    assert sure.filter("not uncertain").count() > 50
    nets.save(spark, nets.Net("pcd", ["a", "b"]), str(tmp_path / "n"))
    assert raga.Classifier(spark, str(tmp_path / "n"), "pcd").classify(df, "id", 1).count() == 60
    with pytest.raises(ValueError):
        raga.Classifier(spark, None, "other")


def test_cross_validation_picks_the_better(spark):
    r = np.random.default_rng(2)
    data = [(i, f"r{i % 2}", [float(i % 2) + float(r.normal(0, 0.1))] * 120 + [float(r.normal())] * 360) for i in range(40)]
    df = spark.createDataFrame(data, "id long, label string, features array<double>")
    mean, deviation = raga.cross_validated(df, "id", "forest", 2, trees=5)
    assert mean > 0.9 and 0 <= deviation <= 0.5
    model, about = raga.best_of(df, "id", ("forest",), ("histogram", "all"), 2, trees=5)
    assert set(about["scores"]) == {("forest", "histogram"), ("forest", "all")} and about["scores"][about["best"]][0] == max(m for m, _ in about["scores"].values())
    assert len(model.stages[0].labels) == 2
