"""Many small files: written by tasks, scanned by few."""

import glob

import pytest

from doctables.sources import files, sinks

DOCS = [("b", "text"), ("a c.d", "two\nlines \u00e9"), ("a=1/x:%", ""), ("b", "text"), (None, "no name"), ("", "empty name"), ("n", None)]


def contents(folder):
    """What the files of each folder hold together, in any order."""
    found = {}
    for f in glob.glob(f"{folder}/*/part-*"):
        with open(f, encoding="utf-8") as x:
            found.setdefault(f.split("/")[-2], []).append(x.read())
    return {k: sorted("".join(v).split("\n")) for k, v in found.items()}


@pytest.mark.parametrize("kind", ["text", "json"])
def test_files_of_documents_are_those_of_the_writer(spark, tmp_path, monkeypatch, kind):
    docs = spark.createDataFrame(DOCS, "file_name string, value string").coalesce(1)
    own, other = str(tmp_path / "own"), f"file:{tmp_path}/other"
    for _ in range(2):  # the second one replaces the first
        sinks.write_files(docs, own, kind)
    assert not glob.glob(f"{own}/*/.*") and glob.glob(f"{own}/_SUCCESS")
    monkeypatch.setattr(sinks, "_mounted", lambda *_: None)
    sinks.write_files(docs, other, kind)
    assert contents(own) == contents(tmp_path / "other") and len(contents(own)) == 5
    assert {f.rsplit(".", 1)[1] for f in glob.glob(f"{own}/*/*")} == {"txt" if kind == "text" else "json"}


def test_small_files_are_scanned_by_few_tasks(spark, tmp_path):
    docs = spark.range(600).selectExpr("CAST(id AS STRING) AS file_name", "concat('text ', id) AS markdown")
    sinks.write_markdown(docs, str(tmp_path), per_document=True)
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "8m")
    try:
        pages, (accepted, _) = files.scan_text_pages(spark, str(tmp_path)), files.scan_files(spark, str(tmp_path))
        assert max(pages.rdd.getNumPartitions(), accepted.rdd.getNumPartitions()) <= 4 * spark.sparkContext.defaultParallelism
        assert sorted(r.content for r in pages.collect()) == sorted(f"text {i}\n" for i in range(600))
        assert accepted.count() == 600
    finally:
        spark.conf.set(name, old)
