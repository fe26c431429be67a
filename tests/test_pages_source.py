import pytest
from pyspark.sql import functions as F

from pagelore.sources.pages import page_counts, pages, write_page_files


class Fragile(list):
    """Pages of which some fail when they are asked for."""

    def __getitem__(self, i):
        if (text := super().__getitem__(i)) == "BOOM":
            raise KeyError(i)
        return text


def fragile(content: bytes):
    return Fragile(content.decode().split("|"))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "deep").mkdir()
    (root / "a.txt").write_bytes(b"one\ftwo\fthree\f")
    (root / "b.txt").write_bytes("é\f\fü".encode())
    (root / "empty.txt").write_bytes(b"")
    (root / "bad.txt").write_bytes(b"\xff\xfe\xfd")
    (root / "deep" / "c.txt").write_bytes(b"deep")
    (root / "other.bin").write_bytes(b"x")
    (root / "_hidden.txt").write_bytes(b"x")
    return root


def test_pages_errors_and_counts(spark, tree):
    got = sorted((r.file, r.page_index, r.text, r.status) for r in pages(spark, str(tree), pattern="*.txt", group=4).collect() if r.file != "bad.txt")
    assert got == [("a.txt", 0, "one", "ok"), ("a.txt", 1, "two", "ok"), ("a.txt", 2, "three", "ok"), ("b.txt", 0, "é", "ok"), ("b.txt", 1, "", "ok"), ("b.txt", 2, "ü", "ok")]
    whole = pages(spark, f"file://{tree}", pattern="*.txt", recursive=True)
    bad = whole.where("status = 'unreadable_file'").collect()
    assert [(r.file, r.page_index) for r in bad] == [("bad.txt", None)] and "UnicodeDecodeError" in bad[0].reason
    assert {r.status: (r.pages, r.files) for r in page_counts(whole).collect()} == {"ok": (7, 3), "page_out_of_range": (0, 0), "unreadable_page": (0, 0), "unreadable_file": (1, 1)}
    second = pages(spark, str(tree), pattern="*.txt", page=1)
    assert {r.status: r.pages for r in page_counts(second).collect()} == {"ok": 2, "page_out_of_range": 1, "unreadable_page": 0, "unreadable_file": 1}
    assert second.where("status = 'page_out_of_range'").first().reason == "page 1 of 0"


def test_only_wanted_pages_are_asked_for(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"zero|BOOM|two")
    parser = {"parser": "tests.test_pages_source:fragile"}
    held = pages(spark, str(tmp_path), **parser)
    assert sorted((r.page_index, r.status) for r in held.collect()) == [(0, "ok"), (1, "unreadable_page"), (2, "ok")]
    assert [held.where("page_index = 2").count(), held.count(), held.where("page_index = 9").count()] == [1, 3, 0]
    assert [r.text for r in pages(spark, str(tmp_path), strict=True, page=2, **parser).collect()] == ["two"]
    assert sorted(r.text for r in pages(spark, str(tmp_path), strict=True, page="2,0", **parser).collect()) == ["two", "zero"]
    for options in ({}, {"page": 9}):
        with pytest.raises(Exception, match="KeyError|has 3 pages"):
            pages(spark, str(tmp_path), strict=True, **options, **parser).collect()
    with pytest.raises(Exception, match="no \\*.pdf"):
        pages(spark, str(tmp_path), pattern="*.pdf").collect()


def test_written_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i, None if i == 4 else f"t{i}\nline\fend") for i in range(20)], "g int, n int, t string")
    write_page_files(rows.repartition(4), f"{tmp_path}/out", "g", ["n"], "t", 2)
    held = pages(spark, f"{tmp_path}/out", recursive=True, pattern="*.txt").collect()
    by = {}
    for r in held:
        by.setdefault(r.path.split("of=")[1].split("/")[0], {})[r.page_index] = r.text
    assert {g: [p[i] for i in sorted(p)] for g, p in by.items()} == {str(g): ["" if n == 4 else f"t{n}\nline end" for n in range(g, 20, 3)] for g in range(3)}
