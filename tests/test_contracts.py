import json

import pytest

from fleetlens.operators import prompts
from tests.helpers import records

GOOD = {
    "project_overview": "o", "tech_stack": [{"name": "a", "role": "r", "category": None}, {"name": "b", "role": "r"}], "architecture": "a",
    "important_files": [], "dependencies": [{"name": "x", "purpose": "p"}], "setup_guide": ["s"], "development_workflow": [],
    "starter_tasks": [], "data_completeness_notes": ["é"], "extra": 1}
CASES = [
    (GOOD, []),
    ({**GOOD, "project_overview": 5}, ["project_overview: not a string"]),
    ({**GOOD, "architecture": {"a": 1}}, ["architecture: not a string"]),
    ({**GOOD, "setup_guide": [1, None, "x"]}, ["setup_guide[0]: not a string", "setup_guide[1]: not a string"]),
    ({**GOOD, "tech_stack": [{"name": 1, "role": "r", "category": 2}]}, ["tech_stack[0].name: not a string", "tech_stack[0].category: not a string"]),
    ({**GOOD, "tech_stack": ["x", None, {"name": "n"}]}, ["tech_stack[0]: not an object", "tech_stack[1]: not an object", "tech_stack[2].role: missing"]),
    ({**GOOD, "dependencies": {}}, ["dependencies: not a list"]),
    ({**GOOD, "starter_tasks": None}, ["starter_tasks: not a list"]),
    ({k: v for k, v in GOOD.items() if k != "architecture"}, ["architecture: missing"]),
    ([1], ["not a JSON object"]), ("x", ["not a JSON object"]),
]


def test_problems(spark):
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(CASES)] + [(90, "{bad"), (91, None), (92, "")]
    got = {r.i: r for r in prompts.parse_generated(spark.createDataFrame(rows, "i int, j string"), "j").collect()}
    assert [got[i].problems for i in range(len(CASES))] == [p for _, p in CASES]
    assert all(got[i].problems == ["not a JSON object"] for i in (90, 91, 92))
    assert [i for i, r in got.items() if r.is_complete] == [0]


@pytest.mark.parametrize("answer", [c for c, p in CASES if p])
def test_a_mistyped_answer_falls_back_to_the_rules(spark, answer):
    record, _ = records(spark, {"project_name": "p", "languages": ["Go"]})
    merged = prompts.merge_responses(record, spark.createDataFrame([(0, json.dumps(answer))], "id int, response string"), "id", "response").first()
    assert merged.used_llm is False and "software project" in merged.project_overview
