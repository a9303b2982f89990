"""Text files in and out."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.sources import files


def put(folder, contents):
    folder.mkdir(exist_ok=True)
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    return f"file://{folder}"


def test_texts(spark, tmp_path):
    path = put(tmp_path / "in", {"a b.txt": b"\xef\xbb\xbf\xc3\xa9\nx\n", "c+d.md": b"#", "e.txt": b"last", "empty.txt": b"", "bad.txt": b"a\xffb"})
    docs = files.read_texts(spark, path)
    assert {r.name: r.text for r in docs.collect()} == {"a b.txt": "é\nx\n", "c+d.md": "#", "e.txt": "last", "empty.txt": "", "bad.txt": "a�b"}
    assert {r.extension: r.n for r in files.kinds(docs).collect()} == {"txt": 4, "md": 1}
    assert {r.name: r.route for r in files.read_files(spark, path).collect()}["e.txt"] == "txt"
    assert [r["size"] for r in files.read_whole(spark, path, pathGlobFilter="*.md").collect()] == [1]
    assert [r.text for r in files.read_texts(spark, f"{path}/e.txt").collect()] == ["last"]


def test_every_file_comes_back_byte_for_byte(spark, tmp_path):
    texts = {f"n{i}.txt": "é\r\n" * (i % 7) + "end" * (i % 3) for i in range(60)} | {"no newline.txt": "x", "nothing.txt": "", "two.txt": "a\n\n", ".hidden": "h"}
    docs = files.read_texts(spark, put(tmp_path / "in", {k: v.encode() for k, v in texts.items()}))
    files.write_texts(docs.repartition(3), f"file://{tmp_path}/out", text="text")
    back = files.read_whole(spark, f"file://{tmp_path}/out")
    want = {f"{k.rpartition('.')[0] if k[0] != '.' else k}_prv.txt" if k[0] != "." else ".hidden_prv.txt": v.encode() for k, v in texts.items()}
    assert {r.name: bytes(r.content) for r in back.collect()} == want
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_equal_names_do_not_mix(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", f"text {i}") for i in range(9)] + [("a.txt", None), ("b.txt", "")], "name string, redacted string")
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        files.write_texts(rows.repartition(2), f"file://{tmp_path}/out", mode=mode)
        back = files.read_whole(spark, f"file://{tmp_path}/out").collect()
        assert Counter((r.name, r.text) for r in back) == Counter({("a_prv.txt", f"text {i}"): times for i in range(9)} | {("a_prv.txt", ""): times, ("b_prv.txt", ""): times})


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([("a.txt", "kept")], "name string, redacted string")
    files.write_texts(good, f"file://{tmp_path}/out")
    bad = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("redacted")).repartition(4)
    with pytest.raises(Exception):
        files.write_texts(bad, f"file://{tmp_path}/out", mode="overwrite")
    assert [(r.name, r.text) for r in files.read_texts(spark, f"file://{tmp_path}/out").collect()] == [("a_prv.txt", "kept")]
    assert [p.name.startswith("part-") for p in (tmp_path / "out").iterdir()] == [True]
    slash = spark.createDataFrame([("a/b", "x")], "name string, text string")
    with pytest.raises(Exception, match="no name of a file"):
        slash.write.format(files.FORMAT).mode("append").save(f"file://{tmp_path}/other")


def test_files_are_packed_by_size():
    groups = files.pack([(f"p{i:03d}", 0 if i % 2 else 10 << 20) for i in range(100)])
    assert [p for g in groups for p, _ in g] == sorted(f"p{i:03d}" for i in range(100))
    assert 8 <= len(groups) <= 10 and all(sum(n for _, n in g) <= files.PACK for g in groups)
    assert len(files.pack([("big", 1 << 40), ("small", 1)])) == 2 and files.pack([]) == []
