from __future__ import annotations

import pytest
from conftest import final_plan
from pyspark.sql import functions as F

from chatloom import schemas
from chatloom.operators import grading, resume
from chatloom.plans import evaluate

PROBLEMS = [
    # id, title, description, statement, input, output, examples, limit, tests
    ("a", "T", "D", "S", "I", "O", [{"input": " 1 ", "output": "2\n"}], 2.0, 5),
    ("b", "", "", "S", None, "", [{"input": None, "output": None}], None, None),
    ("c", None, None, None, None, None, [], 1.0, None),
    ("d", None, None, None, None, None, None, None, 3),
]


@pytest.fixture
def problems(spark):
    return spark.createDataFrame(PROBLEMS, schemas.PROBLEMS)


def runs(spark, rows):
    return spark.createDataFrame(rows, schemas.RUNS)


def test_user_prompt(problems):
    got = {r["id"]: r["user_prompt"] for r in grading.with_user_prompt(problems).collect()}
    assert got["a"] == (
        "# T\n\nProblem: D\n\n\n## Input\n\nI\n\n\n## Output\n\nO\n\n\n## Example\n\n"
        "```input\n1\n```\n\n```output\n2\n```"
    )
    assert got["b"] == "Problem: S\n\n\n## Example\n\n```input\n\n```\n\n```output\n\n```"
    assert got["c"] == got["d"] == ""


def test_time_limits(problems):
    timed = grading.with_time_limit(problems)
    assert [r[0] for r in timed.orderBy("id").select("total_time_limit").collect()] == [10.0, 30.0, 10.0, 9.0]


def test_passes(problems):
    repeated = grading.repeat_passes(problems, 3)
    assert [tuple(r) for r in repeated.filter("id = 'a'").select("id", "pass_idx").collect()] == [
        ("a", 1), ("a", 2), ("a", 3)
    ]
    assert grading.repeat_passes(problems, 0).count() == 0


def test_grading_ignores_the_exit_code_and_counts_a_time_out_as_empty(spark, problems):
    rows = [("a", 1, 1, " 2", "crash", 1), ("a", 2, 1, "3", "", 0), ("b", 1, 1, "", "TIMEOUT", -1),
            ("c", 1, 1, "", "", 0), ("d", 1, 1, "x", "", 0)]
    graded = grading.grade(runs(spark, rows), problems)
    assert sorted((r["id"], r["pass_idx"], r["ok"]) for r in graded.collect()) == [
        ("a", 1, True), ("a", 2, False), ("b", 1, True)
    ]
    assert sorted(map(tuple, grading.solved_by_any_pass(graded).collect())) == [("a", True), ("b", True)]


def test_totals_and_rates(spark, problems):
    rows = [("a", 1, 1, "3", "", 0), ("a", 2, 1, "2", "", 0), ("b", 1, 1, "no", "", 0)]
    texts = [("a", "", "x y", 1), ("a", "", "z", 2), ("c", "", "q!", 1)]
    outcomes = grading.problem_outcomes(
        problems, runs(spark, rows), spark.createDataFrame(texts, schemas.GENERATIONS)
    )
    assert tuple(grading.summarize_outcomes(outcomes).first()) == (4, 2, 1, 0.5, 1.25)
    nothing = grading.summarize_outcomes(outcomes.filter("false"))
    assert tuple(nothing.first()) == (0, 0, 0, 0.0, 0.0)


def test_resume_comes_before_the_sample(spark, problems):
    done = spark.createDataFrame([("a", 1)], "id STRING, pass_idx INT")
    asked = evaluate.pending_prompts(problems, done, 2, 2, "id")
    assert sorted((r["id"], r["pass_idx"]) for r in asked.collect()) == [("b", 1), ("b", 2), ("c", 1), ("c", 2)]
    # By pass the sample comes after the resume too: the next rerun goes on.
    one = evaluate.pending_prompts(problems, done, 2, 2, "id", done_keys=("id", "pass_idx")).select("id", "pass_idx")
    assert sorted(map(tuple, one.collect())) == [("a", 2), ("b", 1), ("b", 2)]
    two = evaluate.pending_prompts(problems, done.union(one), 2, 2, "id", done_keys=("id", "pass_idx"))
    assert sorted((r["id"], r["pass_idx"]) for r in two.collect()) == [("c", 1), ("c", 2), ("d", 1), ("d", 2)]
    by_pass = evaluate.pending_prompts(problems, done, 0, 2, "id", done_keys=("id", "pass_idx"))
    assert by_pass.filter("id = 'a'").select("pass_idx").collect() == [(2,)]
    assert by_pass.count() == 7


def test_null_keys_among_the_finished_do_not_empty_the_rest(spark, problems):
    done = spark.createDataFrame([(None,), ("a",)], "id STRING")
    assert resume.not_done(problems, done, "id").count() == 3
    assert tuple(resume.resume_report(problems, done, "id").first()) == (4, 1, 3)


def test_first_rows_without_a_limit(problems):
    assert resume.first_rows(problems, 0, "id").count() == 4
    assert [r["id"] for r in resume.first_rows(problems, 2, "id").collect()] == ["a", "b"]


def test_repair_flow(spark, problems):
    rows = [("a", 1, 1, "3", "bad", 1), ("a", 1, 2, "2", "", 0), ("b", 1, 1, "", "", 0), ("b", 1, 2, "", "", 0)]
    results = evaluate.repair_results(problems, runs(spark, rows))
    assert sorted(map(tuple, results.collect())) == [("a", "T", False, True), ("b", "", True, False)]
    assert tuple(evaluate.repair_summary(results).first()) == (2, 1, 1)
    # A problem that was never run has its row, too.
    some = evaluate.repair_results(problems, runs(spark, rows[:2]))
    assert sorted(map(tuple, some.collect())) == [("a", "T", False, True), ("b", "", False, False)]
    texts = spark.createDataFrame([("a", "T", "```python\nP\n```", 1), ("b", "", "Q", 1)], schemas.GENERATIONS)
    asked = evaluate.repair_requests(problems, texts, runs(spark, rows)).collect()
    assert [r["id"] for r in asked] == ["a"]
    assert asked[0]["repair_user"].startswith("Original Problem:\\n# T\n\nProblem: D")
    assert asked[0]["repair_user"].endswith(
        "\\n\\nProgram:\\n```python\\nP\n\\n```\\n\\nInput:\\n 1 \\n\\nObserved:\\n3\\nErrors:\\nbad"
        "\\n\\nPlease return a corrected program."
    )


def test_log_rows_of_several_runs(spark, problems):
    """Two runs of one subset keep their own figures; a run without problems has a row."""
    rest = ("test", 0.2, 0.95, 64, 1, "2024-01-02 03:04:05", "2024-01-02 03:04:07.125")
    settings = spark.createDataFrame(
        [("r1", "v", "base", "", "w", *rest), ("r2", "v", "other", None, None, *rest), ("r3", "v", "base", "ck", None, *rest)],
        "run_id STRING, subset STRING, model_id STRING, checkpoint_path STRING, weights_path STRING, split STRING, "
        "temperature DOUBLE, top_p DOUBLE, max_new_tokens INT, passes INT, s STRING, f STRING",
    ).withColumns({"started_at": F.to_timestamp("s"), "finished_at": F.to_timestamp("f")})
    texts = spark.createDataFrame(
        [("r1", i, "x " * 9) for i in "abcd"] + [("r2", "a", "y"), ("r2", "a", "z z")], "run_id STRING, id STRING, generation STRING"
    )
    rows = runs(spark, [("a", 1, 1, "2", "", 0), ("a", 1, 2, "3", "", 0)]).withColumn(
        "run_id", F.when(F.col("phase") == 1, "r1").otherwise("r2")
    )
    log = evaluate.eval_log(problems, rows, texts, settings)
    assert log.schema.fieldNames() == schemas.EVAL_LOG.fieldNames()
    same = ("2024-01-02T03:04:07.125000Z",)
    assert sorted(map(tuple, log.collect())) == [
        (*same, "base+w", "v", "test", 4, 0.2, 0.95, 64, 1, 4, 2, 1, 0.5, 9.0, 2.12),
        (*same, "ck", "v", "test", 0, 0.2, 0.95, 64, 1, 0, 0, 0, 0.0, 0.0, 2.12),
        (*same, "other", "v", "test", 1, 0.2, 0.95, 64, 1, 1, 1, 0, 0.0, 3.0, 2.12),
    ]


def test_null_parts_of_a_repair_request_are_empty(spark):
    from chatloom.functions.problems import repair_prompt

    df = spark.createDataFrame([("P", None, None, None, None)], "p STRING, c STRING, i STRING, o STRING, e STRING")
    text = df.select(repair_prompt(*[F.col(c) for c in "pcioe"])).first()[0]
    assert text.startswith("Original Problem:\\nP\\n") and text.endswith("corrected program.")


def test_log_rounding_is_pythons(spark):
    values = [0.125, 2.675, 2.665, 0.03125, 1.005]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    got = [r[0] for r in df.select(evaluate.log_rounded(F.col("v"), 2)).collect()]
    assert got == [round(v, 2) for v in values]


def test_iso_time_drops_a_zero_fraction(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05' AS t")
    assert df.select(evaluate.iso_utc("t")).first()[0] == "2024-01-02T03:04:05Z"


def test_a_hot_problem_is_split_by_the_grading_join(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "32KB")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32KB")
    many = spark.range(0, 60_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "p0").otherwise(F.concat(F.lit("p"), F.col("id") % 500)).alias("id"),
        F.col("id").cast("int").alias("pass_idx"), F.lit(1).alias("phase"),
        F.col("id").cast("string").alias("stdout"), F.lit("").alias("stderr"), F.lit(0).alias("rc"),
    )
    example = F.struct(F.lit("").alias("input"), F.col("id").cast("string").alias("output"))
    asked = spark.range(500).select(F.concat(F.lit("p"), F.col("id")).alias("id"), F.array(example).alias("examples"))
    solved = grading.solved_by_any_pass(grading.grade(many, asked))
    assert "skew=true" in final_plan(solved)
    assert solved.count() == 500
    assert solved.filter("solved").count() == many.filter("id = concat('p', stdout)").select("id").distinct().count()
