"""Input views over the given tables.

The column expressions are plain SQL that reads the same in Spark and in the
oracle, so both sides derive their inputs from one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chatloom.operators.chats import assemble_chats
from chatloom.operators.scan import number_rows
from chatloom.operators.scoring import with_reference
from chatloom.schemas import MESSAGE

PASSES = 3
# Fixed value: the length of an embedding.
VOCABULARY = 64

# Replies with reasoning marks and code blocks in seven layouts.
CHAT_CONTENT = """CASE WHEN role <> 'assistant' THEN text
 WHEN (conv_id+turn)%7=0 THEN concat('<think>', text, '</think>', chr(10), '```python', chr(10), 'print(', CAST(conv_id AS STRING), ')', chr(10), '```')
 WHEN (conv_id+turn)%7=1 THEN concat(text, chr(10), '```C++ ', chr(10), chr(10), '  int x;', chr(10), '```', chr(10), 'done')
 WHEN (conv_id+turn)%7=2 THEN text
 WHEN (conv_id+turn)%7=3 THEN concat('<think>first</think><THINK> ', text, chr(10), '``` second</Think>', chr(10), '```py', chr(10), 'a=1', chr(10), '```', chr(10), '```', chr(10), 'b=2  ', chr(10), '```')
 WHEN (conv_id+turn)%7=4 THEN concat('```js', chr(10), text, chr(10), '```')
 WHEN (conv_id+turn)%7=5 THEN concat('```c#', chr(10), 'foo', chr(10), '```', chr(10), 'bar', chr(10), '```py', chr(10), text, '```')
 ELSE '' END"""

PROBLEM_COLUMNS = {
    "id": "concat('p', CAST(doc_id AS STRING))",
    "doc_id": "doc_id",
    "subset": "lang",
    "title": "CASE WHEN doc_id%11=0 THEN '' WHEN doc_id%13=0 THEN NULL ELSE concat(source, ' ', CAST(doc_id AS STRING)) END",
    "description": "CASE WHEN doc_id%5=0 THEN NULL ELSE text END",
    "statement": "CASE WHEN doc_id%5=0 AND doc_id%10<>0 THEN text END",
    "input_format": "CASE WHEN doc_id%4=0 THEN NULL ELSE concat('n=', CAST(n_chars AS STRING)) END",
    "output_format": "CASE WHEN doc_id%4=1 THEN '' ELSE 'one integer' END",
    "time_limit": "CASE WHEN doc_id%9=0 THEN NULL ELSE CAST(1+doc_id%3 AS DOUBLE) END",
    "testset_size": "CASE WHEN doc_id%8=0 THEN NULL ELSE 5+doc_id%20 END",
    "ex_input": "CASE WHEN doc_id%6=0 THEN NULL ELSE concat('  ', CAST(doc_id AS STRING), chr(10)) END",
    "ex_output": "CASE WHEN doc_id%6=0 THEN NULL ELSE concat(CAST(n_chars AS STRING), chr(10), ' ') END",
}

GENERATION = """CASE (doc_id*3+pass_idx)%4
  WHEN 0 THEN concat('plan', chr(10), '```python', chr(10), 'print(', CAST(n_chars AS STRING), ')', chr(10), text, chr(10), '```')
  WHEN 1 THEN concat('```cpp', chr(10), 'x', chr(10), '```', chr(10), ' mid ```python', chr(10), text, chr(10), '```')
  WHEN 2 THEN text
  ELSE concat('```', chr(10), text, chr(10), '``````python', chr(10), 'b', chr(10), '```') END"""

RUN_CASE = "(doc_id*3+pass_idx*5+phase*2)%7"
RUN_COLUMNS = {
    "stdout": f"CASE WHEN {RUN_CASE} IN (0,1) THEN concat(' ', CAST(n_chars AS STRING), chr(10)) "
              f"WHEN {RUN_CASE}=2 THEN '' ELSE CAST(n_chars+1 AS STRING) END",
    "stderr": f"CASE WHEN {RUN_CASE}=2 THEN 'TIMEOUT' ELSE '' END",
    "rc": f"CASE WHEN {RUN_CASE}=2 THEN -1 ELSE 0 END",
}

LOG_STEP = "10*CAST(floor((n+1)*2/3.0) AS BIGINT) - CASE WHEN log_id%17=0 THEN 30 ELSE 0 END"
LABEL = "CASE WHEN vec_id%3=0 THEN -100 ELSE label END"

# Evaluation runs: the first covers a subset with all passes; a second one, of
# another model, covers every other English problem with one pass. A third has no
# problem at all. Paths, limits and the clock follow from the data.
RUN_ID = "concat(lang, '-', CAST(run_no AS STRING))"
RUN_COVERS = "run_no = 1 OR (lang = 'en' AND doc_id % 2 = 0 AND pass_idx = 1)"
SECOND_RUN = "lang = 'en'"
SETTING_COLUMNS = {
    "model_id": "CASE WHEN run_no = 1 THEN 'base-model' ELSE concat('model-', CAST(run_no AS STRING)) END",
    "checkpoint_path": "CASE WHEN min(doc_id)%2=1 THEN concat('ckpt-', CAST(min(doc_id) AS STRING)) END",
    "weights_path": "CASE WHEN min(doc_id)%4=2 THEN concat('weights-', CAST(min(doc_id) AS STRING)) END",
    "split": "'test'",
    "temperature": "CAST(0.2 AS DOUBLE)",
    "top_p": "CAST(0.95 AS DOUBLE)",
    "max_new_tokens": "8192",
    "passes": f"CASE WHEN run_no = 1 THEN {PASSES} ELSE 1 END",
    "started_us": "1700000000000000 + min(doc_id)*1000000 + run_no*86400000000",
    "elapsed_us": "count(*)*3000000 + max(n_chars)*10000",
}


SCHEMAS = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{text} AS {name}" for name, text in columns.items()])


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS source_idx", "turn", "role", f"{CHAT_CONTENT} AS content"
    )


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_chats(chat_turns(spark, sf_dir))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _select(table(spark, sf_dir, "documents"), PROBLEM_COLUMNS)
    example = F.struct(F.col("ex_input").alias("input"), F.col("ex_output").alias("output"))
    examples = F.when(F.col("ex_input").isNotNull(), F.array(example))
    return flat.withColumn("examples", examples).drop("ex_input", "ex_output")


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.withColumn("pass_idx", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_passes(spark, sf_dir), {
        "id": PROBLEM_COLUMNS["id"], "title": PROBLEM_COLUMNS["title"],
        "pass_idx": "pass_idx", "generation": GENERATION,
    })


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    phased = _passes(spark, sf_dir).withColumn("phase", F.explode(F.array(F.lit(1), F.lit(2))))
    return _select(phased, {
        "id": PROBLEM_COLUMNS["id"], "pass_idx": "pass_idx", "phase": "phase", **RUN_COLUMNS
    })


def _evaluated(rows: DataFrame) -> DataFrame:
    """Rows per document and pass, for each run that covers them."""
    return rows.withColumn("run_no", F.explode(F.array(F.lit(1), F.lit(2)))).filter(RUN_COVERS)


def evaluated_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_evaluated(_passes(spark, sf_dir)), {
        "run_id": RUN_ID, "id": PROBLEM_COLUMNS["id"], "pass_idx": "pass_idx", "generation": GENERATION,
    })


def evaluated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First attempts; the second run's outcomes differ, as if it were another phase."""
    phased = _evaluated(_passes(spark, sf_dir)).withColumn("phase", F.col("run_no"))
    return _select(phased, {
        "run_id": RUN_ID, "id": PROBLEM_COLUMNS["id"], "pass_idx": "pass_idx", **RUN_COLUMNS
    })


def run_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run; the third run's settings are there, but no generation."""
    numbered = table(spark, sf_dir, "documents").withColumn("run_no", F.explode(
        F.when(F.expr(SECOND_RUN), F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))
    ))
    per_run = numbered.groupBy("run_no", F.expr(RUN_ID).alias("run_id"), F.col("lang").alias("subset")).agg(
        *[F.expr(text).alias(name) for name, text in SETTING_COLUMNS.items()]
    ).drop("run_no")
    return per_run.withColumns({
        "started_at": F.timestamp_micros("started_us"),
        "finished_at": F.timestamp_micros(F.col("started_us") + F.col("elapsed_us")),
    })


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("user_id AS run_id", "event_id AS log_id", "ts")
    numbered = number_rows(events, "n", ["ts", "log_id"], ["run_id"])
    return numbered.selectExpr("run_id", "log_id", "ts", f"{LOG_STEP} AS step")


def short_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows of which some have no message list, and some an empty one."""
    return chat_rows(spark, sf_dir).withColumn("messages", F.when(F.col("source_idx") % 11 == 0, None).when(
        F.col("source_idx") % 13 == 0, F.array().cast(T.ArrayType(MESSAGE))
    ).otherwise(F.col("messages")))


def _token_columns(token: Column) -> list[Column]:
    """Eight tokens make a sequence."""
    return [F.floor(token / 8).cast("bigint").alias("seq_id"), (token % 8).alias("pos")]


def student_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        *_token_columns(F.col("vec_id")),
        F.expr(LABEL).alias("label"),
        F.col("embedding").alias("logits"),
    )


def reference_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's vector of a token is the embedding that follows it."""
    vectors = table(spark, sf_dir, "embeddings")
    total = vectors.agg(F.count(F.lit(1))).scalar()
    return vectors.select(
        *_token_columns((F.col("vec_id") + total - 1) % total),
        F.col("embedding").alias("ref_logits"),
    )


def token_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_reference(student_logits(spark, sf_dir), reference_logits(spark, sf_dir))
