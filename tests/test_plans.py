"""Physical plans: what must and must not be in them."""

import re

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from fleetlens.operators import analysis, guide, inventory, request_log, sanitize
from fleetlens.sources import derived
from tests.helpers import files, records

SF = "/root/testdata/sf0.001"
PYTHON_ROWS = re.compile(r"BatchEvalPython")
STREAMS = {"cache_outcomes_stream", "fallback_alerts_stream"}


def operators(df):
    """Operator names of the plan; expressions may quote any word."""
    return set(re.findall(r"^[\s:+*()\d-]*([A-Z]\w+)", plan(df), re.M))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - STREAMS))
def test_no_cross_join_or_row_udf(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not PYTHON_ROWS.search(text)


def test_guide_and_sanitiser_are_projections(spark):
    parsed, _ = records(spark, {"languages": ["Go"]})
    for df in (guide.generate_onboarding(parsed), sanitize.sanitize(parsed)):
        assert operators(df) <= {"Project", "Filter", "Generate", "Scan", "LocalTableScan", "Coalesce"}


def test_path_facts_read_no_content(spark, tmp_path):
    files(spark, ("r", "a/b.py")).write.parquet(str(tmp_path / "files"))
    landed = inventory.scan(spark.read.parquet(str(tmp_path / "files")))
    for df in (inventory.language_counts(landed), inventory.structure_flags(landed),
               analysis.path_items(landed)):
        text = plan(df)
        assert "ReadSchema: struct<repo_id:string,path:string>" in text
        assert "partial_count" in text and text.count("Exchange hashpartitioning") == 1


def test_files_are_read_once_a_purpose(spark, tmp_path):
    """Paths, directories, manifests and READMEs are read once each, the hidden files with the others."""
    files(spark, ("r", "a/b.py"), ("r", "node_modules/x/y.js"), ("r", "a\\.x/SPECS/c.py"), ("s", "a/.git/z"), ("s", ".git/z"), ("s", None),
          ("t", "a//.b"), ("t", "/etc/c"), ("t", "tESTs/dist/x")).write.parquet(str(tmp_path / "files"))
    scanned = inventory.scan(spark.read.parquet(str(tmp_path / "files")))

    def reads(df):
        return plan(df).count("FileScan parquet")

    assert (reads(scanned), reads(analysis.assemble_analyses(scanned)), reads(analysis.repo_facts(scanned))) == (1, 3, 4)
    assert sorted((r.repo_id, r.path, r.name, r.file_class, r.content) for r in scanned.collect()) == [
        ("r", "", "", "directory", None), ("r", "a/b.py", "b.py", "other", "x"), ("r", "a\\.x/SPECS/c.py", "c.py", "other", "x"),
        ("s", "", "", "directory", None), ("s", "a/", "", "directory", None),
        ("t", "/etc/c", "c", "other", "x"), ("t", "a//.b", ".b", "other", "x"), ("t", "tESTs/", "", "directory", None)]
    got = {r.repo_id: (r.total_files, r.total_dirs, r.has_tests) for r in analysis.repo_facts(scanned).collect()}
    assert got == {"r": (2, 3, True), "s": (0, 1, False), "t": (2, 5, True)}


def test_word_lists_are_read_as_split(spark):
    rows = spark.createDataFrame([(v,) for v in (None, 0, 1, 2, 3, -2, -3, 10**12)], "v long").repartition(2)
    text = derived._pick(("a", "bc", "", "d e"), "v * 2")
    got = rows.select(F.expr(text).alias("split"), derived._spark(text).alias("listed")).where("not split <=> listed")
    assert "split_part" not in plan(rows.select(derived._spark(derived.FILE_NAME.replace("l_partkey", "v").replace("l_suppkey", "v").replace("l_linenumber", "v"))))
    assert got.count() == 0


def test_languages_are_broadcast(spark):
    text = plan(inventory.with_language(inventory.scan(files(spark, ("r", "a.py")))))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_log_windows_are_cut_into_blocks(spark):
    requests = derived.requests_from_events(spark, SF)
    text = plan(request_log.fallback_streaks(requests, "cache_key"))
    assert re.search(r"hashpartitioning\((?:_scope|cache_key)#\d+, _block#\d+L", text)
    assert "SinglePartition" not in text
    # Without a scope only the block summaries meet in one task.
    whole = plan(request_log.fallback_streaks(requests))
    assert re.search(r"hashpartitioning\(_block#\d+L", whole)
    for part in whole.split("Exchange SinglePartition")[1:]:
        below = re.findall(r"^\W*([A-Z]\w+)", part.split("\n", 1)[1], re.M)
        assert any("Aggregate" in node for node in below[:2]) or below[0] == "Window", below[:4]


def test_one_scope_and_hour_make_many_blocks(spark):
    log = derived.requests_from_events(spark, SF).withColumns({
        "ts": F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, request_id * 0.01)")})
    blocks = request_log._row_blocks(request_log._scoped(log, None), 100, 1_000).groupBy("_block").count().collect()
    total = log.count()
    assert sum(r["count"] for r in blocks) == total and max(r["count"] for r in blocks) <= 110 and len(blocks) >= total // 110
    small = {r.request_id: r.streak for r in request_log.fallback_streaks(log, block_rows=100, tick_micros=1_000).collect()}
    assert small == {r.request_id: r.streak for r in request_log.fallback_streaks(log).collect()}


def test_scan_reads_only_needed_columns(spark):
    text = plan(entry.queries()["document_secrets"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_responses_lie_on_all_cores(spark, tmp_path):
    from fleetlens.sources import derived

    spark.createDataFrame([(i,) for i in range(40)], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    responses = derived.responses_from_part(spark, str(tmp_path))
    assert responses.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.part_id for r in responses.collect()) == list(range(40))


def test_failures_are_read_without_a_rule_based_guide(spark):
    from fleetlens import catalogs
    from fleetlens.operators import analysis, prompts

    texts = spark.createDataFrame([(1, '{"project_name": "p", "languages": ["Go"]}')], "id long, source_text string")
    records, _ = analysis.parse_analyses(texts, "source_text")
    answers = spark.createDataFrame([(1, "{bad")], "id long, response string")
    merged = prompts.merge_responses(records.drop("source_text"), answers, "id", "response")
    plans = [merged.select("id", c)._jdf.queryExecution().optimizedPlan().toString() for c in ("tech_stack", "failures")]
    # The role of a rule-based stack is a text of its own.
    assert [catalogs.ROLE in p for p in plans] == [True, False]
    assert merged.first().failures == [] and not merged.first().used_llm
