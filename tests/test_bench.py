"""The benchmark harness: parameters, verification before timing, output, and one small run of each benchmark."""

import json

import pytest

from ndgrid.bench import benches, cli, harness  # noqa: F401
from ndgrid.bench.registry import REGISTRY, Benchmark, Case, benchmark

SMALL = {"read-path": {"mib": 2, "chunk_mib": 0.5}, "blosc-e2e": {"mib": 1, "chunk_mib": 0.5}, "array-read": {"mib": 1, "chunk_mib": 0.5}}


def test_a_name_is_taken_once():
    with pytest.raises(ValueError):
        benchmark("read-path")(lambda c: None)


def test_parameters_are_typed_by_their_defaults():
    b = Benchmark("x", lambda c: None, {"n": 3, "f": 0.5, "on": False, "s": "a"}, {"n": (1, 2), "on": (False, True)})
    assert b.resolve({"n": "7", "f": "2", "on": "true", "s": "4"}) == {"n": 7, "f": 2.0, "on": True, "s": "4"}
    for unknown in ({"m": 1},):
        with pytest.raises(KeyError):
            b.resolve(unknown)
    with pytest.raises(ValueError):
        b.resolve({"on": "perhaps"})
    assert [(p["n"], p["on"]) for p in b.points({})] == [(1, False), (1, True), (2, False), (2, True)]
    assert [(p["n"], p["on"]) for p in b.points({"n": "9"})] == [(9, False), (9, True)]


def test_a_wrong_result_gets_no_time(spark):
    runs = []
    b = Benchmark("wrong", lambda c: Case(lambda: runs.append(1), lambda r: False))
    with pytest.raises(harness.WrongResult):
        harness.run(spark, b)
    assert len(runs) == 1


def test_median_of_the_repetitions(spark):
    runs = []
    row = harness.run(spark, Benchmark("right", lambda c: Case(lambda: runs.append(1), lambda r: True, 1 << 30)), warmups=2, repetitions=3)
    assert len(runs) == 6 and row["least"] <= row["seconds"] <= row["greatest"] and row["gib_s"] > 0


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_benchmarks_are_right(spark, name):
    for point in ({}, {"sharded": True} if name == "read-path" else {"way": "drop-in"} if name == "array-read" else {}):
        row = harness.run(spark, REGISTRY[name], SMALL[name] | point, warmups=0, repetitions=1)
        assert row["bench"] == name and row["gib_s"] > 0


def test_rows_are_written_and_shown(tmp_path, monkeypatch, capsys):
    assert harness.render_table([]) == "(no rows)"
    lines = harness.render_table([{"a": 1, "b": "xx"}, {"a": 22, "c": None}]).splitlines()
    assert [x.split() for x in lines] == [["a", "b", "c"], ["1", "xx"], ["22", "None"]]
    monkeypatch.setenv("NDGRID_BENCH_DIR", str(tmp_path))
    for n in (1, 2):
        at = harness.write_jsonl({"n": n})
    assert [json.loads(x)["n"] for x in at.read_text().splitlines()] == [1, 2]
    assert cli.main(["list"]) == 0 and "read-path" in capsys.readouterr().out


def test_a_sweep_goes_on_after_a_failure(monkeypatch, capsys, tmp_path):
    def measure(name, given, args):
        if given["chunk_mib"] == 1.0:
            raise RuntimeError("no room")
        return {"bench": name, **given, "seconds": 1.0}

    monkeypatch.setattr(cli, "_apart", measure)
    assert cli.main(["sweep", "blosc-e2e", "--out", str(tmp_path / "o.jsonl"), "--json"]) == 1
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(rows) == 3 and [("failed" in r) for r in rows] == [True, False, False]
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing"])


def test_telemetry_and_capture(spark):
    assert harness.telemetry(spark)["cores"] > 0
    with harness.Capture(spark, "count") as seen:
        spark.range(10).repartition(2).count()
    assert seen.jobs >= 1 and seen.tasks >= 1
