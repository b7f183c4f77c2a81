"""Folders of very many files: what listing and writing them costs beside the files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from quillspark.plans import derive
from quillspark.sources import readers


@pytest.mark.parametrize("read", [readers.text_folder, lambda spark, path: readers.pdf_folder(spark, path, names="*.txt"), lambda spark, path: readers.bounded_pdfs(spark, path, names="*.txt")])
def test_listing_takes_few_tasks(spark, tmp_path, read):
    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "a.txt").write_text(f"%PDF-{i}")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup(tmp_path.name, "")
    files = read(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(tmp_path.name) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert files.count() == 60


def test_files_have_no_others_beside_them(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    path = derive.written_files(rows, "test-files")
    found = sorted(p.parent.name for p in Path(path.removeprefix("file:")).rglob("*") if p.is_file() and p.parent.name.startswith("doc_id="))
    assert found == sorted(f"doc_id={i}" for i in range(20))
    got = {r.path.split("doc_id=")[1].split("/")[0]: r.text for r in readers.text_folder(spark, path).collect()}
    assert got == {str(i): f"text {i}\n" for i in range(20)}


@pytest.mark.parametrize("read", [readers.text_folder, lambda spark, path: readers.pdf_folder(spark, path, names="*.txt"), lambda spark, path: readers.bounded_pdfs(spark, path, names="*.txt")])
def test_small_files_share_tasks(spark, tmp_path, read):
    for i in range(60):
        (tmp_path / f"{i}.txt").write_text(f"%PDF-{i}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # what Spark reckons for opening a file: a task for each
    try:
        files = read(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert files.count() == 60
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10")  # large files keep their own tasks
        assert read(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_each_row_has_its_file(spark):
    """Rows of one document, equal ones too, are files of their own; the names don't depend on the order of rows."""
    rows = [(1, "ä"), (1, "b"), (1, "b"), (2, None), (3, "")]
    names = []
    for k in (1, -1):
        path = derive.written_files(spark.createDataFrame(rows[::k], "doc_id long, text string").coalesce(1), "test-files")
        names.append(sorted(str(p.relative_to(path.removeprefix("file:"))) for p in Path(path.removeprefix("file:")).rglob("*") if p.is_file()))
        got = readers.text_folder(spark, path).select(derive.document_of(F.col("path")).alias("doc_id"), "text")
        assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "b\n"), (1, "b\n"), (1, "ä\n"), (2, "\n"), (3, "\n")]
    assert names[0] == names[1]
    path = derive.written_files(spark.createDataFrame([], "doc_id long, text string"), "test-files")
    assert readers.text_folder(spark, path).count() == readers.pdf_folder(spark, path).count() == 0


def test_folders_of_some_files_at_a_time(spark, monkeypatch):
    """Each folder holds some of the documents, goes when it is read, and all rows are there."""
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(derive, "FILES_AT_ONCE", 20)
    sizes, paths = [], []

    def read(path):
        paths.append(Path(path.removeprefix("file:")))
        sizes.append(len(list(paths[-1].rglob("*.txt"))))
        return readers.text_folder(spark, path).select(derive.document_of(F.col("path")).alias("doc_id"), "text")

    got = derive.through_files(rows, 60, "test-files", read)
    assert len(sizes) == 3 and sum(sizes) == 60 and max(sizes) < 40
    assert not any(p.exists() for p in paths)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(i, f"text {i}\n") for i in range(60)]
