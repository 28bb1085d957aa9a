"""Records of quoted CSV in splits of any size, against the reader of whole files."""

from __future__ import annotations

import contextlib
import os
import random

import pytest
from pyspark.sql import functions as F

from movekit.session import scratch
from movekit.sources import csvio as V
from movekit.sources import csvsplits as S

HOSTILE = ["", None, " ", "a,b", '"', '""', 'say "hi"', "line\nbreak", "cr\rlf\r\n", "\\", "\\\\N", "tail\\", "\t", "é漢", " lead", "trail ", "''", "null", "#x", "\n\n\n", '"\n"', ',"\n', "x" * 300, "y\n" * 90]


@contextlib.contextmanager
def split_size(spark, n):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in names]
    try:
        for c in names:
            spark.conf.set(c, str(n))
        yield
    finally:
        for c, v in zip(names, before, strict=True):
            spark.conf.set(c, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def hostile(spark):
    rng = random.Random(7)
    return spark.createDataFrame([(i, rng.choice(HOSTILE), rng.choice(HOSTILE)) for i in range(1500)], "i int, a string, b string").coalesce(1)


@pytest.mark.parametrize("size", [9000])
@pytest.mark.parametrize("encoding", ["bitmap", "backslash-n"])
def test_splits_equal_whole_files(spark, hostile, size, encoding):
    path = scratch(spark, "splits")
    V.write_csv(hostile, path, encoding)
    want = rows_of(V.read_csv(spark, path, encoding))
    assert len(want) == 1500
    with split_size(spark, size):
        found = V.read_csv(spark, path, encoding, splits=True)
        assert rows_of(found) == want
        assert found.count() == 1500
        if encoding == "bitmap":
            assert S._lines(spark, path).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("limit", [0, 60])
def test_pieces_beyond_the_limit_are_read_when_needed(spark, hostile, limit, monkeypatch):
    path = scratch(spark, "splits")
    V.write_csv(hostile, path)
    want = rows_of(V.read_text(spark, path, ["i", "a", "b", V.BITMAP]))
    with split_size(spark, 9000):
        records = S.split_records(spark, path, 4, piece_bytes=limit)
        found = S.parse_records(records, ["i", "a", "b", V.BITMAP], {**V._DIALECT, "header": "false", "nullValue": "", "emptyValue": ""})
        assert sorted(tuple(x or "" for x in r) for r in rows_of(found)) == sorted(tuple(x or "" for x in r) for r in want)


def write(spark, text, name="part.csv"):
    path = scratch(spark, "raw").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/{name}", "wb") as f:
        f.write(text)
    return path


def test_many_files_gzip_and_crlf(spark, hostile):
    path = scratch(spark, "splits")
    V.write_csv(hostile.repartition(3), path, compression="gzip")
    with split_size(spark, 9000):
        assert rows_of(V.read_csv(spark, path, splits=True)) == rows_of(V.read_csv(spark, path))
    crlf = write(spark, b"a,b\r\n" + b'1,"x\r\ny"\r\n\r\n2,z\r\n"3\n",""\r\n' * 1000)
    with split_size(spark, 7001):
        assert rows_of(V.read_csv(spark, crlf, "none", splits=True)) == sorted([("1", "x\r\ny"), ("2", "z"), ("3\n", "")] * 1000)


def test_ends_of_files(spark):
    no_newline = write(spark, b'a,b\n1,"' + b"x\n" * 9000 + b'y"')  # one record over several splits
    only_header = write(spark, b"a,b\n")
    with split_size(spark, 5000):
        assert rows_of(V.read_csv(spark, no_newline, "none", splits=True)) == [("1", "x\n" * 9000 + "y")]
        assert V.read_csv(spark, only_header, "none", splits=True).count() == 0


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (b"1,2\n3\n", "1 fields instead of 2"),
        (b'1,2\n"3",4,5\n', "3 fields instead of 2"),
        (b'1,x"y"\n', "bare quote"),
        (b'1,"x"y\n', "bare quote"),
        (b'1,"open\n2,3\n', "never closed"),
    ],
)
def test_bad_records_fail(spark, text, error):
    path = write(spark, b"a,b\n" + b"good,row\n" * 1000 + text)
    with split_size(spark, 4000), pytest.raises(Exception, match=error):
        V.read_csv(spark, path, "none", splits=True).count()


def test_every_header_is_checked(spark):
    path = write(spark, b"a,b\n1,2\n")
    with open(f"{path}/other.csv", "wb") as f:
        f.write(b"a,c\n1,2\n")
    with split_size(spark, 4000), pytest.raises(Exception, match="header differs"):
        V.read_text(spark, path, ["a", "b"], splits=True).collect()


def test_too_many_splits_are_read_whole(spark, hostile, monkeypatch):
    path = scratch(spark, "splits")
    V.write_csv(hostile, path)
    with split_size(spark, 9000):
        assert S.split_records(spark, path, 4, most_splits=3) is None
        monkeypatch.setattr(V, "split_records", lambda *a: None)
        assert V.read_csv(spark, path, splits=True).agg(F.count("i")).first()[0] == 1500
