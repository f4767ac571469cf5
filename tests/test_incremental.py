"""Jobs that run again: what they read, what they leave when they break."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpuscope.plans import corpus_job, incremental_job
from corpuscope.plans.corpus_job import run_corpus_job
from corpuscope.plans.incremental_job import clean, compact, current_records, run_incremental_job
from corpuscope.sources import sinks
from corpuscope.sources.versions import Conflict, commit_version, current_version, new_folder

TS = "2024-05-06T07:08:09.000Z"
RULES = {"filename": {"source": "filename", "transform": "uppercase"}, "size": {"source": "size", "transform": "multiply", "factor": 0.5}}


@pytest.fixture
def folder(tmp_path):
    target = tmp_path / "in"
    target.mkdir()
    for i in range(12):
        (target / f"f{i}.txt").write_text(f"text {i}\n" * (i + 1))
    (target / "odd [x]{y,z}*?.json").write_text('{"a": 1}')
    return target


def state(spark, out):
    version = current_version(spark, out)
    totals = json.loads(spark.read.text(f"{out}/{version.folder}/totals").first().value)
    types = {r.extension: r.files for r in spark.read.json(f"{out}/{version.folder}/file_types").collect()}
    records = sorted(r.t for r in current_records(spark, out).select(F.to_json(F.struct(*sorted(current_records(spark, out).columns))).alias("t")).collect())
    return totals, types, records


def read_files(spark, out):
    version = current_version(spark, out)
    return {os.path.basename(r._path) for r in spark.read.parquet(f"{out}/{version.folder}/extracted").select("_path").collect()}


def change(folder):
    (folder / "f3.txt").write_text("changed now, and longer than before " * 5)
    (folder / "new.md").write_text("new")
    (folder / "f5.txt").unlink()
    (folder / "odd [x]{y,z}*?.json").write_text('{"a": 1, "b": [2]}')


@pytest.mark.parametrize("rules", [None, RULES])
def test_second_run_reads_the_changes_only(spark, folder, tmp_path, rules):
    out, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    run_incremental_job(spark, str(folder), out, rules, TS)
    assert len(read_files(spark, out)) == 13
    change(folder)
    total = run_incremental_job(spark, str(folder), out, rules, TS).first()
    assert read_files(spark, out) == {"f3.txt", "new.md", "odd [x]{y,z}*?.json"}
    assert total.totalFiles == 13
    run_incremental_job(spark, str(folder), whole, rules, TS)
    assert state(spark, out) == state(spark, whole)
    run_incremental_job(spark, str(folder), out, rules, TS)  # nothing has changed
    assert read_files(spark, out) == set() and state(spark, out) == state(spark, whole)
    compact(spark, out)
    assert state(spark, out) == state(spark, whole)
    assert len(clean(spark, out)) == 3
    (folder / "f0.txt").unlink()
    run_incremental_job(spark, str(folder), out, rules, TS)
    run_incremental_job(spark, str(folder), whole, rules, TS)
    assert state(spark, out) == state(spark, whole)


def test_other_rules_read_all(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    run_incremental_job(spark, str(folder), out, None, TS)
    run_incremental_job(spark, str(folder), out, RULES, TS)
    assert len(read_files(spark, out)) == 13


def test_blocks_of_paths(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental_job, "PATHS", 2)
    out, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    run_incremental_job(spark, str(folder), out, None, TS)
    change(folder)
    run_incremental_job(spark, str(folder), out, None, TS)
    run_incremental_job(spark, str(folder), whole, None, TS)
    assert state(spark, out) == state(spark, whole)


def test_a_broken_run_leaves_the_old_version(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    run_incremental_job(spark, str(folder), out, None, TS)
    before, version = state(spark, out), current_version(spark, out)
    change(folder)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(incremental_job, "add_averages", broken)
        with pytest.raises(RuntimeError):
            run_incremental_job(spark, str(folder), out, None, TS)
    assert current_version(spark, out) == version and state(spark, out) == before
    assert len(clean(spark, out)) == 1
    run_incremental_job(spark, str(folder), out, None, TS)
    assert read_files(spark, out) == {"f3.txt", "new.md", "odd [x]{y,z}*?.json"}


def test_two_runs_at_once(spark, tmp_path):
    out = str(tmp_path / "out")
    assert current_version(spark, out) is None
    first, second = new_folder(), new_folder()
    commit_version(spark, out, first, None)
    with pytest.raises(Conflict):
        commit_version(spark, out, second, None)
    assert current_version(spark, out).folder == first
    commit_version(spark, out, second, current_version(spark, out))
    assert (current_version(spark, out).folder, current_version(spark, out).seq) == (second, 2)


def test_a_broken_job_leaves_the_old_output(spark, folder, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    first = run_corpus_job(spark, str(folder), out, run_ts=TS).first()
    change(folder)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(corpus_job, "_report", broken)
        with pytest.raises(RuntimeError):
            run_corpus_job(spark, str(folder), out, run_ts=TS)
    assert spark.read.schema("totalFiles bigint, totalSize bigint").json(f"{out}/totals").first() == (first.totalFiles, first.totalSize)
    assert spark.read.parquet(f"{out}/extracted").count() == 13
    assert sorted(os.listdir(out)) == ["data", "extracted", "file_types", "report", "totals", "transformed"]
    assert run_corpus_job(spark, str(folder), out, run_ts=TS).first().totalSize != first.totalSize


def test_a_broken_write_leaves_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_json(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        sinks.write_json(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("broken"))).alias("x")), path)
    assert spark.read.json(path).count() == 3 and os.listdir(tmp_path) == ["out"]
    # what is read may be what is replaced
    sinks.write_json(spark.read.schema("id bigint").json(path).filter("id > 0"), path)
    assert spark.read.json(path).count() == 2


def test_a_switch_that_was_broken_off(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_text(spark.createDataFrame([("a",)], "line string"), path)
    os.rename(path, str(tmp_path / "_old-out"))
    sinks.recover(spark, path)
    assert spark.read.text(path).first().value == "a"
    os.rename(path, str(tmp_path / "_old-out"))
    sinks.write_text(spark.createDataFrame([("b",)], "line string"), path)
    assert spark.read.text(path).first().value == "b" and os.listdir(tmp_path) == ["out"]
