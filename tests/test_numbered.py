"""Line numbers and offsets of files that are read in many ranges, and files that grow."""

import random

import pytest

from fluvia.sources import numbered, readers


@pytest.fixture
def narrow(spark):
    """Ranges of a few hundred bytes."""
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(name, data):
    """(file, number, offset, line) of a file's bytes."""
    out, at = [], 0
    for n, line in enumerate(data.split(b"\n"), 1):
        if at < len(data):
            out.append((name, n, at, line))
        at += len(line) + 1
    return out


def test_ranges(spark, tmp_path, narrow):
    rng, want = random.Random(1), []
    for name in ("a.log", "b.log", "c.log"):
        lines = [bytes(rng.choices(b"xyz \xc3\xa9", k=rng.choice((0, 1, 5, 40, 900)))) for _ in range(300)]
        data = b"\n".join(lines) + rng.choice((b"", b"\n", b"\n\n"))
        (tmp_path / name).write_bytes(data)
        want += plain(name, data)
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "blank.log").write_bytes(b"\n")
    want.append(("blank.log", 1, 0, b""))
    got = numbered.numbered_lines(spark, f"{tmp_path}/*.log")
    assert got.rdd.getNumPartitions() > 100
    assert sorted((r["filename"], r["ln"], r["offset"], bytes(r["value"])) for r in got.collect()) == sorted(want)


def test_join_of_many_ranges(spark, tmp_path, narrow, monkeypatch):
    monkeypatch.setattr(numbered, "SENT", 0)
    (tmp_path / "a.log").write_text("".join(f"line {i}\r\n" for i in range(500)))
    got = readers.line_files(spark, f"{tmp_path}/*.log").collect()
    assert sorted((r["ln"], r["original_message"]) for r in got) == [(i + 1, f"line {i}") for i in range(500)]


def test_encoding(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("é\r\nü".encode("latin-1"))
    got = readers.line_files(spark, f"{tmp_path}/*.log", encoding="ISO-8859-1").collect()
    assert sorted((r["ln"], r["original_message"]) for r in got) == [(1, "é"), (2, "ü")]


def test_tail(spark, tmp_path, narrow):
    """Whole lines once each; a file that became shorter is read again from its start."""
    a, b = tmp_path / "a.log", tmp_path / "b.log"

    def step(marks):
        rows, after = numbered.tail(spark, f"{tmp_path}/*.log", marks)
        got = sorted((r["filename"], r["ln"], r["original_message"]) for r in rows.collect())
        return got, spark.createDataFrame(after.collect(), "path string, offset long, ln long")

    a.write_text("one\ntwo\nthr")
    b.write_text("x\n")
    got, marks = step(None)
    assert got == [("a.log", 1, "one"), ("a.log", 2, "two"), ("b.log", 1, "x")]
    a.write_text("one\ntwo\nthree\nfour\n")
    got, marks = step(marks)
    assert got == [("a.log", 3, "three"), ("a.log", 4, "four")]
    assert step(marks)[0] == []
    a.write_text("new\n")
    b.write_text("x\n" + "y\n" * 400)
    got, marks = step(marks)
    assert got == sorted([("a.log", 1, "new")] + [("b.log", i, "y") for i in range(2, 402)])
    b.unlink()
    got, marks = step(marks)
    assert got == [] and marks.count() == 2
