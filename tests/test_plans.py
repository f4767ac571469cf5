"""Properties every physical plan must have."""

import pytest

from corpuscope.functions.text import count_words
from corpuscope.operators import corpus, probes
from corpuscope.plans import QUERIES
from corpuscope.plans.bases import corpus_files
from corpuscope.plans.registry import table
from corpuscope.sources.files import read_text_files
from pyspark.sql import functions as F
from tests.conftest import DATA

FORBIDDEN = [
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "EvalPython",
    "InPandas",
    "collect_list",
    "collect_set",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_forbidden_operator(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not [word for word in FORBIDDEN if word in text]
    lines = text.split("\n")
    for above, below in zip(lines, lines[1:]):
        assert not ("Exchange SinglePartition" in below and ("Window" in above or " Sort " in above)), above


def test_scan_reads_only_what_is_needed(spark):
    documents = table(spark, DATA, "documents")
    assert "ReadSchema: struct<text:string>" in plan(documents.select(count_words(F.col("text"))))
    totals = corpus.file_type_counts(corpus.extract_stage(corpus_files(spark, DATA)))
    text = plan(totals)
    assert "encode" not in text and "from_json" not in text


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    listed = read_text_files(spark, str(tmp_path)).select("filename")
    assert "content" not in plan(listed).split("ReadSchema")[1]


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("file_type_counts", "directory_summary", "last_wins", "result_counts", "all_passed", "log_counts"):
        text = plan(QUERIES[name](spark, DATA))
        below_exchange = text.split("Exchange hashpartitioning", 1)[1]
        assert "partial_" in below_exchange, name


def test_sections_are_filled_by_block(spark):
    text = plan(probes.probe_sections(spark.createDataFrame([(1, 2, "x")], "run int, line_no int, text string")))
    assert "hashpartitioning(run" in text and "_block" in text.split("Window", 1)[1]


def test_parsing_happens_once(spark):
    for name in ("extract_stage", "transform_stage", "merge_sources", "merge_summary", "api_result", "resolve_calls",
                 "rule_default"):
        text = plan(QUERIES[name](spark, DATA))
        assert text.count("from_json(VariantType") == 1, name
        # the reason why a text has no value is looked for in such texts only
        assert text.count("from_json(") <= 2, name
        assert "parse_json" not in text and "json_object_keys" not in text, name


def test_report_reads_each_text_a_fixed_number_of_times(spark):
    text = plan(QUERIES["report_lines"](spark, DATA))
    # a check, then values and raw texts of the members (or items), and the members of a nested object
    assert text.count("from_json(") <= 7 and "json_object_keys" not in text


def test_lookups_leave_the_plan_to_adaptive_execution(spark):
    jobs = spark.sparkContext.statusTracker()
    for name in ("exists_flag", "existing_only", "missing_only", "catalog_lookup", "resolve_calls", "download_info",
                 "env_overlay", "hot_lookup"):
        spark.sparkContext.setJobGroup(f"plan {name}", name)
        text = plan(QUERIES[name](spark, DATA))
        # only the schemas of the tables are read while the query is built
        assert len(jobs.getJobIdsForGroup(f"plan {name}")) <= 4
        assert "SinglePartition" not in text, name
        assert "_hash" in text or "xxhash64" in text, name
    spark.sparkContext.setJobGroup("", "")
