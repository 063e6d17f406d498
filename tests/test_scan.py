"""Scans of shards read what they select, and nothing else."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from textmill.session import scratch_path
from textmill.sources import shards as S

SCHEMA = "doc_id long, text string, row_in_shard long, shard_id int"
SIZE = 8


@pytest.fixture
def folder(spark):
    path = scratch_path(spark, "scan")
    rows = [(s * 1000 + k, f"text {s} {k} " * 20, k, s) for s in range(4) for k in range(100)]
    S.write_text_shards(spark.createDataFrame(rows, SCHEMA), path, row_group=SIZE)
    return path


def files(path, shard):
    found = glob.glob(f"{path.removeprefix('file:')}/shard_id={shard}/*.parquet")
    assert found
    return found


def spoil(file, groups=None):
    """Overwrite a file, or only the pages of some of its row groups; its checksums, which cover neighbours, go."""
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with open(file, "r+b") as f:
        if groups is None:
            f.truncate(0)
            f.write(b"not a file of columns")
            return
        meta = pq.ParquetFile(file).metadata
        for g in groups:
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                f.seek(min(x for x in (col.dictionary_page_offset, col.data_page_offset) if x is not None))
                f.write(b"\xff" * col.total_compressed_size)


def ids(df):
    return sorted((r["shard_id"], r["row_in_shard"]) for r in df.select("shard_id", "row_in_shard", "text").collect() if r["text"])


def test_row_groups_are_written_as_asked(spark, folder):
    for shard in range(4):
        meta = [pq.ParquetFile(f).metadata for f in files(folder, shard)]
        sizes = [m.row_group(g).num_rows for m in meta for g in range(m.num_row_groups)]
        assert sizes == [SIZE] * 12 + [4]


@pytest.mark.parametrize("split", ["train", "val", None])
def test_splits(spark, folder, split):
    wanted = {"train": range(3), "val": [3], None: range(4)}[split]
    for shard in set(range(4)) - set(wanted):
        for f in files(folder, shard):
            spoil(f)
    assert ids(S.scan_text_shards(spark, folder, split, schema=SCHEMA, size=SIZE)) == [(s, k) for s in wanted for k in range(100)]


@pytest.mark.parametrize("terms", [64, 2])
def test_ranks_read_their_row_groups(spark, folder, terms, monkeypatch):
    whole = S.row_groups_of_rank
    monkeypatch.setattr(S, "row_groups_of_rank", lambda *a, **k: whole(*a, **k, terms=terms))
    if terms == 64:
        for shard in range(3):
            for f in files(folder, shard):
                spoil(f, [g for g in range(13) if g % 3 != 1])
    got = ids(S.scan_text_shards(spark, folder, "train", rank=1, world=3, size=SIZE, schema=SCHEMA))
    assert got == [(s, k) for s in range(3) for k in range(100) if k // SIZE % 3 == 1]


def test_resume_reads_what_is_left(spark, folder):
    for f in files(folder, 0):
        spoil(f)
    for f in files(folder, 1):
        spoil(f, range(7))
    got = ids(S.scan_text_shards(spark, folder, None, rank=1, world=2, size=SIZE, after=(1, 5), schema=SCHEMA))
    assert got == [(s, k) for s in range(1, 4) for k in range(100) if k // SIZE % 2 == 1 and (s > 1 or k // SIZE > 5)]


def test_nothing_there(spark):
    path = scratch_path(spark, "scan-none")
    spark.createDataFrame([], "doc_id long, text string, row_in_shard long").write.parquet(path)
    for split in ("train", "val"):
        assert S.scan_text_shards(spark, path, split, schema=SCHEMA).count() == 0
    with pytest.raises(ValueError):
        S.scan_text_shards(spark, path, "test")
