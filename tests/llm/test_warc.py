import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagelore.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    last, out = {}, []
    for at, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        if len(data) >= 1000:
            last[data] = max(last.get(data, (False, 0, -1)), (page is not None, page or 0, at))
    for at, (page, _, html) in enumerate(rows):
        data = (html or "").encode()
        to = last.get(data)
        other = to is not None and to[2] != at
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", (to[1] if to[0] else None) if other else None))
    return sorted(out, key=str)


def odd_pages():
    rng = random.Random(4)
    texts = ["<p>" + "".join(rng.choice("abcdé \r\n☃") for _ in range(rng.randint(0, 3000))) for _ in range(40)]
    rows = [(i, f"http://a.b/{i}", t) for i, t in enumerate(texts)]
    rows += [(100 + i, "http://c.d/x y\r\nPage-Id: 7", texts[i % 5]) for i in range(30)]
    rows += [(200, None, None), (201, "", ""), (None, None, texts[1]), (None, None, texts[1]), (None, "u", "z" * 5000), (None, "u", "z" * 5000)]
    rows += [(300, "same", texts[2] * 9), (300, "same", texts[2] * 9), (300, "same", texts[2] * 9), (301, "é☃", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 90)]
    rows += [(400, "edge", "a" * 1000), (401, "edge", "a" * 1000), (402, "edge", "a" * 999), (403, "edge", "a" * 999), (404, "wide", "é" * 500), (405, "wide", "é" * 500)]
    return [*rows, (500, "long", "0123456789 " * 400_000)]


@pytest.mark.parametrize("sent", [warc.SENT, 0])
def test_query_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    rows = odd_pages()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("file", F.lit("clash")).withColumn("a.b", F.lit("clash")).repartition(3)
    out = warc.op12_warc(df)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert sorted(got, key=str) == brute(rows)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert warc.op12_warc(df.limit(0)).collect() == []


def test_archive_files(spark, tmp_path):
    rows = odd_pages()
    files = warc.archived(spark.createDataFrame(rows, SCHEMA).coalesce(2), str(tmp_path), most=20_000)
    held = files.collect()
    assert len(held) > 4 and sum(r.records for r in held) == len(rows) and not (tmp_path / "monoliths").exists()
    back = warc.read_back(files, batch=50_000).collect()
    texts = {r.page: bytes(r.payload).decode() for r in back if r.type == "response" and r.page}
    for page, _, html in rows:
        if page is not None and str(page) in texts:
            assert texts[str(page)] == (html or "")
    ids = [r for r in back if r.type == "revisit"]
    assert ids and all(r.payload is None and r.refers_to.startswith("<urn:uuid:") for r in ids)
    for row in held:
        whole = list(warc.records(warc.inflated(open(row.file, "rb"), 777)))  # the members in a row are a stream as well
        assert len(whole) == row.records
        with gzip.open(row.file) as f:
            assert f.read(9) == b"WARC/1.1\r"


def test_streams_in_small_pieces_and_broken_ones():
    made = [warc.response(f"urn:{i}", "u\nv", str(i), bytes([65 + i]) * (i * 700)) for i in range(6)]
    data = b"".join(map(warc.written, made))
    for size in (1, 3, 64, 100_000):
        held = list(warc.records(warc.inflated(io.BytesIO(gzip.compress(data)), size)))
        assert held == [r._replace(fields=r.fields) for r in made]
        assert [warc.payload_of(r) for r in held] == [warc.payload_of(r) for r in made]
    members = b"".join(gzip.compress(warc.written(r)) for r in made)
    assert list(warc.records(warc.inflated(io.BytesIO(members), 50))) == made
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(gzip.compress(data[:-9])))))
    with pytest.raises(ValueError):
        list(warc.records(iter([b"nothing of the kind\r\n\r\n"])))
    with pytest.raises(zlib.error):
        list(warc.inflated(io.BytesIO(b"not gzip")))


def test_string_ids_come_back(spark, tmp_path):
    pages = spark.createDataFrame([("a%20 b\r\nX: y", "u", "t" * 2000), ("é", "u", "t" * 2000)], "page_id string, url string, html string")
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.op12_warc(pages).collect()}
    assert out == {"é": ("response", None), "a%20 b\r\nX: y": ("revisit", "é")}
