import pytest

from pagelore.streaming import live


def arrive(spark, folder, name, rows):
    spark.createDataFrame(rows, "doc int, v array<double>").coalesce(1).write.parquet(f"{folder}/{name}")


def started(spark, tmp_path):
    catalog = spark.createDataFrame([("t", [1.0, 0.0], 0.5)], "tag string, paradigm array<double>, threshold double")
    results = live.live_search(spark, f"{tmp_path}/in/*", "doc int, v array<double>", catalog, "tag", "doc", "v")
    return live.write_totals(results, f"{tmp_path}/out", f"{tmp_path}/state", "doc", 3)


def state(spark, tmp_path):
    totals, last = live.live_state(spark, f"{tmp_path}/out", "doc")
    return tuple(totals.first()), [r.doc for r in last.collect()]


def test_totals_outlive_a_stopped_stream(spark, tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        live.live_state(spark, f"{tmp_path}/out", "doc")
    arrive(spark, f"{tmp_path}/in", "a", [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    started(spark, tmp_path).awaitTermination(120)
    assert state(spark, tmp_path) == ((2, 1, 0.5), [2, 1])

    arrive(spark, f"{tmp_path}/in", "b", [(3, [0.6, 0.8]), (4, [0.0, 1.0])])
    whole = live._before

    def cut_off(*args):
        raise RuntimeError("cut off")

    monkeypatch.setattr(live, "_before", cut_off)  # hits are written, totals are not
    with pytest.raises(Exception, match="cut off"):
        started(spark, tmp_path).awaitTermination(120)
    monkeypatch.setattr(live, "_before", whole)
    assert state(spark, tmp_path) == ((2, 1, 0.5), [2, 1])
    started(spark, tmp_path).awaitTermination(120)
    assert state(spark, tmp_path) == ((4, 2, 0.5), [4, 3, 2])
    assert sorted(r.doc for r in spark.read.parquet(f"{tmp_path}/out/hits").collect()) == [1, 3]

    started(spark, tmp_path).awaitTermination(120)  # nothing new arrives
    assert state(spark, tmp_path) == ((4, 2, 0.5), [4, 3, 2])
