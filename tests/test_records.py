"""Descriptions of several ages, and watches that pass over what is there."""

import json

from strandworks.operators.entropy import code_table, improved
from strandworks.sources.records import parse_models, parse_runs
from strandworks.streaming.streams import lines_after

START = 1577836800  # 2020-01-01 00:00:00


def runs(spark, *rows):
    lines = spark.createDataFrame([(n, None if m is None else m if isinstance(m, str) else json.dumps(m), None if s is None else s if isinstance(s, str) else json.dumps(s), w) for n, m, s, w in rows], "name string, meta string, sidecar string, written long")
    return {r["name"]: r for r in parse_runs(lines).collect()}


def test_runs_of_several_ages(spark):
    got = runs(
        spark,
        ("a_20200101_000000", {"best_val_accuracy": 0, "val_accuracy": 0.8, "epochs": 9}, None, START + 125),
        ("b_20200101_000000", {"best_val_accuracy": 0.9, "p1_epochs": 2, "p2_epochs": 0, "epochs": 9}, {"start_time": 10.5, "end_time": 75.0, "gpu_energy_wh": 3.5}, START + 5),
        ("c", {"best_val_accuracy": 0.9}, "{", START + 5),
        ("d_20209999_000000", None, {"start_time": 1, "end_time": 2}, None),
        ("e", "{", None, None),
        ("f_20200101_000000", {}, {"start_time": 0, "end_time": 2}, START + 86400),
        ("g", "", None, None),
    )
    assert "e" not in got and "g" not in got
    a, b, c, d, f = (got[k] for k in ("a_20200101_000000", "b_20200101_000000", "c", "d_20209999_000000", "f_20200101_000000"))
    assert (a["accuracy"], a["epochs"], a["training_time"], a["is_best"]) == (0.8, 9, "2m 5s", False)
    assert (b["accuracy"], b["epochs"], b["training_time"], b["energy"], b["is_best"]) == (0.9, 2, "1m 4s", 3.5, False)
    assert (c["started"], c["training_time"], c["epochs"], c["is_best"]) == (None, None, None, True)
    assert d["started"] is None and d["accuracy"] is None and d["training_time"] is None
    assert f["training_time"] is None and f["accuracy"] is None


def test_no_runs(spark):
    assert runs(spark) == {}


def test_models_without_settings(spark):
    rows = [("das_cnn_1", '{"class_names": ["a"]}'), ("x", '{"class_names": ["a", "b"], "norm_mean": [0.1]}'), ("y", "{}"), ("z", "nothing"), ("n", None)]
    got = {r["name"]: r for r in parse_models(spark.createDataFrame(rows, "name string, meta string")).collect()}
    assert set(got) == {"das_cnn_1", "x"}
    assert (got["das_cnn_1"]["channels"], got["das_cnn_1"]["mean"], got["das_cnn_1"]["side"]) == (1, [0.5], 224)
    assert (got["x"]["channels"], got["x"]["mean"], len(got["x"]["std"]), got["x"]["threshold"]) == (3, [0.1], 3, 0.6)


def test_pages_of_a_log_lose_no_line(spark):
    log, at, seen = spark.range(1, 26).withColumnRenamed("id", "line").repartition(3), 0, []
    while page := lines_after(log, at, 10).collect():
        seen += sorted(r["line"] for r in page)
        at = page[0]["next"]
    assert seen == list(range(1, 26))


def test_a_table_search_never_gets_worse():
    aim = {s: 2**s for s in range(12)}
    found, bits = improved(dict.fromkeys(aim, 1), aim, 400)
    assert bits == sorted(bits, reverse=True) and bits[-1] < bits[0]
    best = sum(n * code_table(aim)[s][1] for s, n in aim.items())
    assert best <= bits[-1] == sum(n * code_table(found)[s][1] for s, n in aim.items())
