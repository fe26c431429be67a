import json
import threading

import pytest
from pyspark.sql import functions as F

from pagelore.functions import text
from pagelore.operators import jobs
from pagelore.operators.catalog import Catalog, CatalogError
from pagelore.sources import files


def rows(spark, *tags, threshold=0.5):
    return spark.createDataFrame([(t, "m", 0, threshold, "p05", [1.0, 0.0]) for t in tags], "tag string, model string, page_index int, threshold double, method string, paradigm array<double>")


def test_racing_writers_both_land(spark, tmp_path):
    catalog, failed = Catalog(spark, f"file://{tmp_path}/catalog"), []

    def write(tag):
        try:
            Catalog(spark, catalog.root).put(rows(spark, tag))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(t,)) for t in "abc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and catalog.versions() == [1, 2, 3]
    assert sorted(r.tag for r in catalog.entries().collect()) == ["a", "b", "c"] and catalog.events().count() == 3
    same = [threading.Thread(target=write, args=("d",)) for _ in range(2)]
    [t.start() for t in same]
    [t.join() for t in same]
    assert len(failed) == 1 and isinstance(failed[0], CatalogError) and catalog.entries().count() == 4


def test_a_write_that_is_cut_off_loses_nothing(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    catalog.put(rows(spark, "a", "b"))
    inbox = tmp_path / "requests"
    inbox.mkdir()
    (inbox / "one.json").write_text(json.dumps({"tag": "a", "authorize": True}) + "\n")

    with monkeypatch.context() as m:  # the process ends before the rename, and gives nothing back
        m.setattr(Catalog, "_renamed", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        m.setattr(Catalog, "_given_back", lambda *_: None)
        with pytest.raises(KeyboardInterrupt):
            catalog.put(rows(spark, "a", threshold=0.7), update=True, requests=f"file://{inbox}")
    assert catalog.versions() == [1] and catalog.resolve("a")["threshold"] == 0.5 and catalog.events().count() == 2
    assert not list(inbox.glob("*.json"))
    assert catalog.recover() == 1 and [f.name for f in inbox.glob("*.json")] == ["one.json"]
    assert catalog.put(rows(spark, "a", threshold=0.7), update=True, requests=f"file://{inbox}") == 2
    assert catalog.resolve("a")["threshold"] == 0.7 and not list(inbox.glob("*.json")) and list((tmp_path / "catalog/versions/v=2/requests").glob("one.json"))
    assert [(r.tag, r.change) for r in catalog.snapshot(2).collect()] == [("a", "changed")]
    assert {(r.tag, r.change) for r in catalog.snapshot(1).collect()} == {("a", "added"), ("b", "added")}


def test_requests_authorize_once_and_come_back(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    catalog.put(rows(spark, "a", "b"))
    inbox = tmp_path / "requests"
    inbox.mkdir()
    (inbox / "r.json").write_text('{"tag": "a", "authorize": true}\n{"tag": "b", "authorize": false}\n')
    with pytest.raises(CatalogError, match="no request authorizes.*b"):
        catalog.put(rows(spark, "a", "b"), update=True, requests=f"file://{inbox}")
    assert (inbox / "r.json").exists() and catalog.versions() == [1]
    catalog.put(rows(spark, "a"), update=True, requests=f"file://{inbox}")
    with pytest.raises(CatalogError, match="no request"):
        catalog.put(rows(spark, "a"), update=True, requests=f"file://{inbox}")
    (inbox / "bad.json").write_text("{nothing\n")
    with pytest.raises(CatalogError, match="not a request"):
        catalog.put(rows(spark, "a"), update=True, requests=f"file://{inbox}")
    assert (inbox / "bad.json").exists() and not list((tmp_path / "catalog/staging").glob("*"))


def test_numbers_in_any_order_and_group(spark):
    data = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", (i * 7919) % 1000) for i in range(2000)]
    df = spark.createDataFrame(data, "id int, `g.h` string, o int").withColumn("number", F.lit("clash")).withColumnRenamed("number", "n")
    got = {r.id: r.number for r in files.numbered(df.repartition(6), ("g.h",), F.struct("o", "id")).collect()}
    for g in {d[1] for d in data}:
        want = sorted((d[2], d[0]) for d in data if d[1] == g)
        assert [got[i] for _, i in want] == list(range(1, len(want) + 1))
    whole = {r.id: r.number for r in files.numbered(df.select("id", "o"), (), F.struct("o", "id")).collect()}
    assert [whole[i] for _, i in sorted((d[2], d[0]) for d in data)] == list(range(1, 2001))


def test_payloads_paths_and_times(spark):
    out = jobs.payload("j", spark.createDataFrame([(1, 'x"y', None)], "a int, `b.c` string, d string"), source='a"b')
    assert json.loads(out.first().payload) == {"source": 'a"b', "rows": [{"a": 1, "b.c": 'x"y', "d": None}]}
    listing = spark.createDataFrame([("/x/1.pdf",), ("d/2.pdf",), ("3.pdf",), ("d/1.pdf",)], "path string")
    asked = spark.createDataFrame([(1, "/x/1.pdf", "d", "1.pdf"), (2, "none", "d", "2.pdf"), (3, None, "q", "3.pdf"), (4, "a", "b", "c")], "id int, path string, source_dir string, file string")
    assert {r.id: r.resolved for r in files.resolved_path(listing, asked, "id").collect()} == {1: "/x/1.pdf", 2: "d/2.pdf", 3: "3.pdf", 4: None}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        row = spark.range(1).select(text.utc_iso(F.timestamp_seconds(F.lit(0))).alias("t"), text.utc_iso(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), zoned=False).alias("n")).first()
        assert (row.t, row.n) == ("1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
