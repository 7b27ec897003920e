import json
import random

from fleetlens.functions.json_layout import indented
from fleetlens.operators import prompts
from tests.helpers import evaluate, records

ODD = [None, True, False, 0, -1, 10 ** 30, 1.5, -0.0, 0.1, 1e-7, 1.25e22, 123456789.0, 12345678901234.5, 1e16, 0.0001, "", "plain", 'q"b\\s/', "tab\tnl\n\r\b\f\x01\x7f",
       "é ü 日本 \U0001f600", "[]{},: \"x\"", {}, [], [[]], [{}], {"a": {}}, {"k é": [1, {"x": None}]}]


def build(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(ODD)
    if rng.random() < 0.5:
        return [build(rng, depth - 1) for _ in range(rng.randint(0, 6))]
    return {f"{rng.choice(['a', 'ü', '\"'])}{i}": build(rng, depth - 1) for i in range(rng.randint(0, 6))}


def test_layout_is_that_of_the_common_writer(spark):
    rng = random.Random(4)
    values = [*ODD, *[build(rng, 5) for _ in range(120)], [list(range(500)), {str(i): [i] for i in range(300)}]]
    texts = [json.dumps(v, ensure_ascii=bool(i % 2), separators=((",", ":"), (" ,\n ", " : "))[i % 3 == 0]) for i, v in enumerate(values)]
    assert evaluate(spark, indented, *texts, None) == [json.dumps(v, indent=2) for v in values] + [None]


def test_prompts_have_no_python_in_their_plan(spark):
    record, _ = records(spark, {"project_name": "é", "languages": ["Go"], "project_structure": {"a": ["b", {"c": 1.50}]}})
    df = prompts.build_prompts(record)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
    prompt = df.first().prompt
    body = json.loads(prompt[prompt.index("{"):prompt.rindex("}") + 1])
    assert json.dumps(body, indent=2) in prompt and body["project_structure"] == {"a": ["b", {"c": 1.5}]}
