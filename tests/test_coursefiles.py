"""Listing, dealing by size, decoding, and files written and read back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from larkspur.sources import corpus, coursefiles


def make(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)


def test_skipped_folders_are_never_opened(spark, tmp_path, monkeypatch):
    root = tmp_path / "root"
    make(root, {"a.md": b"a", "x/b.TXT": b"b", ".git/c.md": b"", "x/node_modules/d.py": b"", "x/y/.venv/e/f.py": b"", "x/.md": b"", "x/g.bin": b"", "x/h": b"", "dist.md": b"i", "x/build": b"", "x/a.md.": b""})
    os.symlink(root / "x", root / "linked")
    seen, one = [], coursefiles.fs.LocalFileSystem.get_file_info

    class Watched(coursefiles.fs.LocalFileSystem):
        def get_file_info(self, what):
            seen.append(what.base_dir)
            return one(self, what)

    monkeypatch.setattr(coursefiles, "opened", lambda uri: (Watched(), str(uri)))
    assert coursefiles.listed(str(root)) == [("a.md", 1), ("dist.md", 1), ("x/b.TXT", 1)]
    assert sorted(os.path.relpath(s, root) for s in seen) == [".", "x", "x/y"]


def test_roots(spark, tmp_path):
    make(tmp_path / "build" / "in", {"a.md": b"a"})
    (tmp_path / "empty").mkdir()
    assert coursefiles.listed(str(tmp_path / "build" / "in")) == []
    assert corpus.documents(spark, f"file:{tmp_path}/empty").collect() == []
    with pytest.raises(Exception, match="nowhere"):
        coursefiles.read(spark, str(tmp_path / "nowhere")).collect()


def test_files_are_dealt_by_size(spark, tmp_path):
    make(tmp_path, {f"f{i:02d}.txt": b"x" * (3 << 20 if i == 4 else 10) for i in range(12)})
    df = coursefiles.read(spark, str(tmp_path), partition_bytes=4 << 20)
    held = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 12 and max(held) <= 4 and len(held) >= 4
    assert {r.source_path: r.size for r in df.collect()} == {f"f{i:02d}.txt": 3 << 20 if i == 4 else 10 for i in range(12)}


def test_decoding(spark):
    rng = random.Random(3)
    bits = [b"a", b"\r\n", b"\r", "é".encode(), "�".encode(), "".encode(), "\U0001f600".encode(), b"\xff", b"\xe2\x82", b"\xc0\x80", b"\xed\xa0\x80", b"\xf5\x80\x80\x80", b"\xef\xbf", b"\xbd", b"\xf0\x9f", b"\x80"]
    bodies = [b"", *bits, *(b"".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(2000))]
    got = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, b binary").select("i", corpus.decoded(F.col("b")).alias("t")).orderBy("i").collect()
    for r, b in zip(got, bodies, strict=True):
        assert r.t == b.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"), b
    assert spark.range(1).select(corpus.decoded(F.lit(None).cast("binary"))).first()[0] is None


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", bytearray(b"x\xff")), ("c.py", bytearray(b"")), (None, bytearray(b"q")), ("d.md", None)], "source_path string, content binary")
    assert coursefiles.write(df, f"file://{tmp_path}/out") == 2
    assert coursefiles.write(df, f"file://{tmp_path}/out") == 2  # again over what is there
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "c.py"] and (tmp_path / "out/a/b.md").read_bytes() == b"x\xff"
    assert {r.source_path: r.text for r in corpus.documents(spark, f"file://{tmp_path}/out").collect()} == {"a/b.md": "x", "c.py": ""}


def test_json_form(spark, tmp_path):
    """SRC6, SRC7: only documents with a text are written; legacy chunk rows keep their nesting."""
    df = spark.createDataFrame([("a", "x\ny", "t"), ("b", "", "t"), ("c", None, "t")], "id string, text string, title string")
    corpus.write_json(df.select("id", "text", F.struct("title").alias("metadata")), str(tmp_path / "j"))
    (row,) = corpus.read_json(spark, str(tmp_path / "j"), "id string, text string, metadata struct<title:string>").collect()
    assert row.asDict(True) == {"id": "a", "text": "x\ny", "metadata": {"title": "t"}}
