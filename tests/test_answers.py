"""Execution that is stopped and goes on."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from respeval.operators.execute import execute_prompts
from respeval.plans.workflows import evaluate
from respeval.streaming import answers


def noting(folder):
    """A model that leaves a file for every call."""

    def fn(text: str) -> str:
        import os
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        if text == "bad":
            raise KeyError("bad")
        return text.upper()

    return fn


def calls(folder) -> Counter:
    return Counter(open(f"{folder}/{n}").read() for n in os.listdir(folder))


@pytest.fixture
def prompts(table):
    texts = [f"prompt {i % 60}" for i in range(90)] + ["bad", "bad", None, ""]
    return table([(str(i), t) for i, t in enumerate(texts)], "id string, text string")


def rows(df):
    return sorted(map(repr, df.drop("timestamp").collect()))


def test_killed_run_goes_on(spark, prompts, tmp_path):
    """After half the batches, the rest is asked once each."""
    path, folder = str(tmp_path / "log"), tmp_path / "calls"
    folder.mkdir()
    fn = noting(folder)
    answers.submit_prompts(prompts, path, "m", per_file=5)
    n = len([f for f in os.listdir(f"{path}/questions") if f.endswith(".parquet")])
    seen = []

    def lost(batch_id):
        seen.append(batch_id)
        if batch_id == 2:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        answers.answer_questions(spark, path, fn, "m", 2, files_per_batch=-(-n // 6), then=lost)
    asked = calls(folder)
    assert seen == [0, 1, 2] and set(asked.values()) == {1} and 20 <= len(asked) <= 45
    repeated = {r.prompt for r in spark.read.parquet(f"{path}/answers/batch_id=2").collect()}

    results = answers.execute_resumable(prompts, fn, path, "m", 2, per_file=5)
    assert rows(results) == rows(execute_prompts(prompts, noting(str(tmp_path)), "m"))
    twice = {t for t, k in calls(folder).items() if k > 1}
    assert max(calls(folder).values()) <= 2 and twice == repeated
    assert set(calls(folder)) == {f"prompt {i}" for i in range(60)} | {"bad", ""}

    # Nothing is asked again; new prompts are.
    before = sum(calls(folder).values())
    more = prompts.union(spark.createDataFrame([("x", "new"), ("y", "prompt 3")], prompts.schema))
    assert answers.execute_resumable(more, fn, path, "m").count() == prompts.count() + 2
    assert sum(calls(folder).values()) == before + 1
    other = answers.execute_resumable(more, fn, path, "n")
    assert {r.model for r in other.collect()} == {"n"} and other.count() == prompts.count() + 2


def test_evaluate_goes_on(spark, tmp_path):
    import json

    folder = tmp_path / "calls"
    folder.mkdir()
    (tmp_path / "prompts").mkdir()
    listed = [{"id": f"p{i}", "text": f"question {i}", "category": "c"} for i in range(30)]
    (tmp_path / "prompts" / "a.json").write_text(json.dumps({"metadata": {}, "prompts": listed}))
    fn, out = noting(folder), str(tmp_path / "out")
    answers.execute_resumable(  # what a lost run had asked
        spark.createDataFrame([(f"question {i}",) for i in range(12)], "text string"), fn, f"{out}/calls", "gpt-4"
    )
    scored = evaluate(spark, str(tmp_path / "prompts"), fn, out)
    assert scored.count() == 30 and set(calls(folder).values()) == {1} and len(calls(folder)) == 30
    assert not os.path.exists(f"{out}/calls")
    evaluate(spark, str(tmp_path / "prompts"), fn, out)  # a run that came to its end starts anew
    assert set(calls(folder).values()) == {2}


def test_a_large_run_has_no_more_batches(spark, tmp_path, monkeypatch):
    """Many files of questions are answered in a bounded number of batches, each question once."""
    monkeypatch.setattr(answers, "BATCHES", 3, raising=False)
    folder, path = tmp_path / "calls", str(tmp_path / "log")
    folder.mkdir()
    asked = spark.createDataFrame([(str(i), f"prompt {i}") for i in range(100)], "id string, text string")
    answers.submit_prompts(asked, path, "m", per_file=2)
    assert len([f for f in os.listdir(f"{path}/questions") if f.endswith(".parquet")]) >= 50
    results = answers.execute_resumable(asked, noting(folder), path, "m", 2)
    assert results.count() == 100 and set(calls(folder).values()) == {1} and len(calls(folder)) == 100
    batches = [f for f in os.listdir(f"{path}/answers") if f.startswith("batch_id=")]
    assert 2 <= len(batches) <= 3
