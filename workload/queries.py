"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatloom import schemas
from chatloom.functions import chat, problems as rules, text
from chatloom.functions.tokens import count_tokens, counter_from, turn_tokens
from chatloom.operators import (
    chats, cutlosses, filters, generate, grading, packing, positions, resume, scan, scoring,
    throughput,
)
from chatloom.plans import evaluate, prepare
from chatloom.session import fresh_folder, tune
from chatloom.sources import prompts, readers, writers
from chatloom.streaming import prepare as stream_prepare, throughput as stream_throughput
from workload import views

# Parameters shared with the reference SQL.
MAX_SEQ_LEN = 512
PACK_LEN = 2048
SAMPLE = 200
RERUN_SAMPLE = 60
PART_BYTES = 700
TOKENS_IN_STEP = throughput.tokens_per_step(8192, 1, 8, 8)
KL_COEF = 0.1
KL_TEMPERATURE = 2.0

REGISTRY = {}


def query(build):
    """Register a query under its function name, run on a tuned session."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(tune(spark), sf_dir)
    return build


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.chat_turns(spark, sf_dir)
    return turns.filter("role = 'assistant'").select("source_idx", "turn", "content")


def _rounded(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


def _as_text(prepared: DataFrame) -> DataFrame:
    """Prepared chats with the message list as serialised text."""
    return prepared.select(
        "source_idx", "language", "num_tokens_serialized",
        chat.chat_text(F.col("messages")).alias("chat"),
    )


def _prepared(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return prepare.prepare_turns(
        views.chat_turns(spark, sf_dir), max_seq_len=MAX_SEQ_LEN, **options
    )


def _first_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.runs(spark, sf_dir).filter(F.col("phase") == evaluate.FIRST_ATTEMPT)


# ---- preparation -----------------------------------------------------------


@query
def sft_build(spark, sf_dir):
    return _as_text(_prepared(spark, sf_dir))


@query
def sft_build_rows(spark, sf_dir):
    rows = views.chat_rows(spark, sf_dir)
    return _as_text(prepare.prepare_chats(rows, max_seq_len=MAX_SEQ_LEN))


@query
def sft_build_parts(spark, sf_dir):
    """Chats cut into parts of a few hundred bytes, in which turns of very different
    lengths stand alone or together: the same training chats."""
    rows = chats.assemble_chats(views.chat_turns(spark, sf_dir), part_bytes=PART_BYTES)
    return _as_text(prepare.prepare_chats(rows, max_seq_len=MAX_SEQ_LEN))


@query
def sft_build_resume(spark, sf_dir):
    return _as_text(_prepared(spark, sf_dir, done=_done_chats(spark, sf_dir)))


@query
def skip_funnel(spark, sf_dir):
    profile = prepare.profile_turns(views.chat_turns(spark, sf_dir))
    return prepare.funnel(profile, "python", MAX_SEQ_LEN)


@query
def skip_funnel_rows(spark, sf_dir):
    """The funnel on chat rows, some of them without messages."""
    profile = prepare.profile_chats(views.short_of_messages(spark, sf_dir))
    return prepare.funnel(profile, "python", MAX_SEQ_LEN)


@query
def observed_funnel(spark, sf_dir):
    """The funnel of ``skip_funnel`` as the run that writes the chats has counted it."""
    seen = prepare.Funnel()
    _prepared(spark, sf_dir, language="python", seen=seen).write.parquet(fresh_folder(spark, "funnel"))
    return spark.createDataFrame(sorted(seen.chats().items()), "outcome STRING, chats BIGINT")


@query
def stream_funnel(spark, sf_dir):
    """The same counts from the micro-batches of a stream, summed."""
    folder = fresh_folder(spark, "stream")
    stream_prepare.stream_prepare(
        _stored_chats(spark, sf_dir, folder), f"{folder}/out", f"{folder}/checkpoint",
        max_seq_len=MAX_SEQ_LEN, language="python", funnel=True,
    ).awaitTermination()
    return stream_prepare.read_stream_funnel(spark, f"{folder}/out")


@query
def lang_filter(spark, sf_dir):
    return _prepared(spark, sf_dir, language="python").select("source_idx", "language")


@query
def token_guard(spark, sf_dir):
    profile = prepare.profile_turns(views.chat_turns(spark, sf_dir))
    asked = prepare.screen(profile).filter("reason IS NULL")
    return prepare.draft(asked, MAX_SEQ_LEN).select(
        "source_idx", "num_tokens_serialized", F.col("reason").isNull().alias("kept")
    )


# ---- text rules ------------------------------------------------------------


@query
def last_think(spark, sf_dir):
    return _replies(spark, sf_dir).select(
        "source_idx", "turn", text.last_think(F.col("content")).alias("think")
    )


@query
def last_code_block(spark, sf_dir):
    fenced = _replies(spark, sf_dir).withColumn("fence", text.last_fence(F.col("content")))
    fence = F.col("fence")
    return fenced.select(
        "source_idx", "turn",
        text.fence_tag(fence).alias("tag"), text.fence_body(fence).alias("code"),
    )


@query
def code_language(spark, sf_dir):
    tag = text.fence_tag(text.last_fence(F.col("content")))
    return _replies(spark, sf_dir).select(
        "source_idx", "turn", text.code_language(tag).alias("language")
    )


@query
def sanitize_text(spark, sf_dir):
    return _replies(spark, sf_dir).select(
        "source_idx", "turn", text.sanitize_explanation(F.col("content")).alias("explanation")
    )


@query
def lenient_code(spark, sf_dir):
    return evaluate.submitted_code(views.generations(spark, sf_dir)).select("id", "pass_idx", "code")


# ---- chats -----------------------------------------------------------------


@query
def last_assistant_turn(spark, sf_dir):
    return chats.last_of_role(views.chat_turns(spark, sf_dir))


@query
def sys_user_prefix(spark, sf_dir):
    rows = views.chat_rows(spark, sf_dir)
    asked = chat.prompt_turns(F.col("messages"))

    def opened(default):
        """Only a chat's first row opens it."""
        prefixed = F.when(F.col("part") == 0, chat.ensure_system(asked, default)).otherwise(asked)
        return chat.chat_text(prefixed)

    return rows.select(
        "source_idx", "part",
        opened(prompts.CHAT_DEFAULT_SYSTEM).alias("prompt"),
        opened(prompts.TRAINER_DEFAULT_SYSTEM).alias("trainer_prompt"),
    )


@query
def compose_reply(spark, sf_dir):
    fenced = _replies(spark, sf_dir).withColumn("fence", text.last_fence(F.col("content")))
    think = text.sanitize_explanation(F.coalesce(text.last_think(F.col("content")), F.lit("")))
    language = text.code_language(text.fence_tag(F.col("fence")))
    answer = text.compose_reply(think, language, text.fence_body(F.col("fence")))
    return fenced.filter("fence IS NOT NULL").select("source_idx", "turn", answer.alias("answer"))


@query
def chat_text(spark, sf_dir):
    rows = views.chat_rows(spark, sf_dir)
    messages = F.col("messages")
    return rows.select(
        "source_idx", "part",
        chat.chat_text(messages).alias("chat"),
        chat.chat_text(messages, add_reply_prompt=True).alias("open_chat"),
        count_tokens(chat.chat_text(messages)).alias("tokens"),
    )


@query
def turns_round_trip(spark, sf_dir):
    return chats.explode_turns(views.chat_rows(spark, sf_dir))


@query
def struct_of_arrays(spark, sf_dir):
    columns = views.chat_rows(spark, sf_dir).select(
        "source_idx", "part", chat.as_struct_of_arrays(F.col("messages")).alias("m")
    )
    back = columns.withColumn("messages", chat.as_array_of_structs(F.col("m")))
    return back.select(
        "source_idx", "part",
        F.array_join("m.role", ",").alias("roles"),
        F.array_join("m.content", "|").alias("contents"),
        chat.chat_text(F.col("messages")).alias("chat"),
    )


@query
def assistant_tokens(spark, sf_dir):
    return chats.role_token_profile(views.chat_turns(spark, sf_dir))


@query
def length_filter(spark, sf_dir):
    counted = chats.role_token_profile(views.chat_turns(spark, sf_dir))
    return filters.filter_counts(counted, filters.within_length("tokens", MAX_SEQ_LEN))


@query
def rank_slice(spark, sf_dir):
    turns = views.chat_turns(spark, sf_dir)
    return turns.filter(filters.row_share("source_idx", 4, 1)).select("source_idx", "turn", "role")


@query
def language_profile(spark, sf_dir):
    tokens = F.col("num_tokens_serialized")
    return _prepared(spark, sf_dir).groupBy("language").agg(
        F.count(F.lit(1)).alias("chats"),
        F.sum(tokens).alias("tokens"),
        F.round(F.avg(tokens), 6).alias("avg_tokens"),
        F.max(tokens).alias("max_tokens"),
    )


# ---- resume ----------------------------------------------------------------


def _chat_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations")
    return turns.groupBy(F.col("conv_id").alias("source_idx")).agg(F.count(F.lit(1)).alias("turns"))


def _done_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys an earlier run has written: repeated, as its file would hold them."""
    turns = views.table(spark, sf_dir, "conversations").filter("conv_id % 3 = 0")
    return turns.select(F.col("conv_id").alias("source_idx"))


@query
def resume_anti(spark, sf_dir):
    return resume.not_done(_chat_keys(spark, sf_dir), _done_chats(spark, sf_dir), "source_idx")


@query
def resume_semi(spark, sf_dir):
    return resume.already_done(_chat_keys(spark, sf_dir), _done_chats(spark, sf_dir), "source_idx")


@query
def resume_report(spark, sf_dir):
    return resume.resume_report(_chat_keys(spark, sf_dir), _done_chats(spark, sf_dir), "source_idx")


@query
def todo_except(spark, sf_dir):
    return resume.todo_keys(_chat_keys(spark, sf_dir), _done_chats(spark, sf_dir), "source_idx")


@query
def first_n_after_resume(spark, sf_dir):
    todo = resume.not_done(views.problems(spark, sf_dir), _done_ids(spark, sf_dir), "id")
    return resume.first_rows(todo, SAMPLE, "doc_id").select("id", "title")


@query
def merge_summaries(spark, sf_dir):
    replies = chats.last_of_role(views.chat_turns(spark, sf_dir)).select("source_idx", "content")
    stored = replies.filter("source_idx % 4 <> 0").select(
        "source_idx", text.sanitize_explanation(F.col("content")).alias("summary")
    )
    return resume.attach_summaries(replies, stored).select("source_idx", "summary")


# ---- evaluation prompts ----------------------------------------------------


def _done_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations an earlier run has written: the first pass of every fifth problem."""
    written = views.generations(spark, sf_dir).filter("pass_idx = 1")
    return written.filter("CAST(substring(id, 2) AS BIGINT) % 5 = 0").select("id", "pass_idx")


@query
def problem_prompt(spark, sf_dir):
    return grading.with_user_prompt(views.problems(spark, sf_dir)).select("id", "user_prompt")


@query
def prompt_passes(spark, sf_dir):
    asked = evaluate.pending_prompts(
        views.problems(spark, sf_dir), _done_ids(spark, sf_dir), SAMPLE, views.PASSES, "doc_id"
    )
    return asked.select("id", "pass_idx", F.md5("prompt").alias("prompt_md5"), "total_time_limit")


@query
def prompt_passes_all(spark, sf_dir):
    """A sample of 0 asks for every problem that is not finished."""
    asked = evaluate.pending_prompts(
        views.problems(spark, sf_dir), _done_ids(spark, sf_dir), 0, views.PASSES, "doc_id"
    )
    return asked.select("id", "pass_idx", F.md5("prompt").alias("prompt_md5"), "total_time_limit")


@query
def prompt_passes_by_pass(spark, sf_dir):
    """The second of two reruns: it goes on where the first one's sample ended."""
    done = _done_ids(spark, sf_dir)
    for _ in range(2):
        asked = evaluate.pending_prompts(
            views.problems(spark, sf_dir), done, RERUN_SAMPLE, views.PASSES, "doc_id", done_keys=("id", "pass_idx"),
        ).select("id", "pass_idx")
        done = done.unionByName(asked)
    return asked


@query
def prompt_by_version(spark, sf_dir):
    version = F.when(F.col("doc_id") % 2 == 0, "current").otherwise("previous")
    asked = grading.with_user_prompt(views.problems(spark, sf_dir).withColumn("version", version))
    asked = prompts.with_system_text(asked, "solve")
    return grading.with_chat_prompt(asked, F.col("system_text")).select("id", "version", "prompt")


@query
def time_limits(spark, sf_dir):
    timed = grading.with_time_limit(views.problems(spark, sf_dir))
    example = rules.first_example(F.col("examples"))
    return grading.evaluable(timed).select(
        "id", "total_time_limit", example["input"].alias("example_input")
    )


@query
def repair_prompt(spark, sf_dir):
    asked = evaluate.repair_requests(
        views.problems(spark, sf_dir), views.generations(spark, sf_dir), views.runs(spark, sf_dir)
    )
    return asked.select("id", "repair_user", F.md5("repair_prompt").alias("prompt_md5"))


@query
def summary_prompt(spark, sf_dir):
    thought = _replies(spark, sf_dir).withColumn("think", text.last_think(F.col("content")))
    request = chat.two_turn_prompt(
        F.lit(prompts.SUMMARY_SYSTEM), rules.summary_request(F.col("think"))
    )
    return thought.filter(~text.is_blank(F.col("think"))).select(
        "source_idx", "turn", request.alias("prompt")
    )


@query
def strip_prompt(spark, sf_dir):
    asked = grading.with_user_prompt(views.problems(spark, sf_dir)).select("id", "user_prompt")
    decoded = views.generations(spark, sf_dir).join(asked, "id").withColumn(
        "decoded", F.concat("user_prompt", "generation")
    )
    added = text.strip_prompt(F.col("decoded"), F.col("user_prompt"))
    return decoded.select("id", "pass_idx", added.alias("added"))


# ---- grading ---------------------------------------------------------------


@query
def grade_runs(spark, sf_dir):
    graded = grading.grade(views.runs(spark, sf_dir), views.problems(spark, sf_dir))
    return graded.select("id", "pass_idx", "phase", "ok")


@query
def pass_any_of_k(spark, sf_dir):
    graded = grading.grade(_first_runs(spark, sf_dir), views.problems(spark, sf_dir))
    return grading.solved_by_any_pass(graded)


@query
def eval_summary(spark, sf_dir):
    outcomes = grading.problem_outcomes(
        views.problems(spark, sf_dir), _first_runs(spark, sf_dir), views.generations(spark, sf_dir)
    )
    return grading.summarize_outcomes(outcomes).select(
        "problems_total", "problems_evaluable", "solved_on_example",
        _rounded("example_pass_rate"), _rounded("avg_new_tokens"),
    )


def _eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.eval_log(
        views.problems(spark, sf_dir), views.evaluated_runs(spark, sf_dir),
        views.evaluated_generations(spark, sf_dir), views.run_settings(spark, sf_dir),
    )


@query
def eval_log_row(spark, sf_dir):
    return _eval_log(spark, sf_dir)


@query
def repair_flags(spark, sf_dir):
    """Every seventh problem has never been run."""
    runs = views.runs(spark, sf_dir).filter("CAST(substring(id, 2) AS BIGINT) % 7 <> 0")
    return evaluate.repair_results(views.problems(spark, sf_dir), runs)


@query
def repair_summary(spark, sf_dir):
    return evaluate.repair_summary(
        evaluate.repair_results(views.problems(spark, sf_dir), views.runs(spark, sf_dir))
    )


# ---- throughput and packing ------------------------------------------------


def _train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it is kept: its rows are numbered once and stored."""
    path = fresh_folder(spark, "train-log")
    log = views.train_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    writers.save_table(log.select(*schemas.TRAIN_LOG.fieldNames()), path)
    return readers.read_table(spark, path, schema=schemas.TRAIN_LOG)


@query
def tokens_per_sec(spark, sf_dir):
    rates = throughput.throughput(_train_log(spark, sf_dir), TOKENS_IN_STEP)
    return rates.select("run_id", "log_id", "step", _rounded("tokens_per_sec", 4))


@query
def tokens_per_sec_avg(spark, sf_dir):
    rates = throughput.throughput(_train_log(spark, sf_dir), TOKENS_IN_STEP)
    return rates.select("run_id", "log_id", _rounded("tokens_per_sec_avg", 4))


@query
def pack_sequences(spark, sf_dir):
    counted = views.chat_turns(spark, sf_dir).select(
        "source_idx", "turn", turn_tokens(F.col("role"), F.col("content")).alias("tokens")
    )
    return packing.pack_sequences(counted, "tokens", ["source_idx", "turn"], PACK_LEN)


@query
def row_numbers(spark, sf_dir):
    """Narrow keys are numbered; the texts join by their unique id."""
    documents = views.table(spark, sf_dir, "documents")
    numbered = scan.number_rows(documents.select("doc_id", "source"), "source_idx", ["source", "doc_id"])
    return documents.select("doc_id", "text").join(numbered, "doc_id")


@query
def storage_numbers(spark, sf_dir):
    """Rows of several files numbered where they stand."""
    path = fresh_folder(spark, "numbers")
    place = F.md5(F.col("doc_id").cast("string"))
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    writers.save_table(documents.repartitionByRange(5, place).sortWithinPartitions(place), path)
    stored = readers.read_table(spark, path, schema=documents.schema)
    return positions.number_stored(stored, "number").select("doc_id", "number")


@query
def zip_answers(spark, sf_dir):
    """Replies and answers without a key, stored in one order but in other files."""
    folder = fresh_folder(spark, "zip")
    ordered = lambda files: _replies(spark, sf_dir).repartitionByRange(
        files, "source_idx", "turn"
    ).sortWithinPartitions("source_idx", "turn")
    writers.save_table(ordered(4).select("source_idx", "turn"), f"{folder}/asked")
    writers.save_table(ordered(7).select(F.md5("content").alias("answer")), f"{folder}/answers")
    return positions.zip_stored(readers.read_table(spark, f"{folder}/asked"), readers.read_table(spark, f"{folder}/answers"))


@query
def first_half(spark, sf_dir):
    """Half of a table in key order, selected where its rows stand."""
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return resume.select_first(documents, documents.count() // 2, "source", "n_chars", "doc_id")


# ---- losses ----------------------------------------------------------------


@query
def token_kl(spark, sf_dir):
    terms = scoring.kl_terms(views.token_logits(spark, sf_dir), KL_TEMPERATURE)
    return terms.select("seq_id", "pos", _rounded("kl"))


@query
def token_ce(spark, sf_dir):
    terms = scoring.cross_entropy_terms(views.student_logits(spark, sf_dir))
    return terms.select("seq_id", "pos", _rounded("ce"))


@query
def gem_loss(spark, sf_dir):
    tokens = views.student_logits(spark, sf_dir)
    return scoring.gem_loss(tokens, "seq_id").select("seq_id", _rounded("gem_loss"))


@query
def gem_loss_linear(spark, sf_dir):
    tokens = views.student_logits(spark, sf_dir)
    loss = scoring.gem_loss(tokens, num_items=1000, weights="linear")
    return loss.select(_rounded("gem_loss"))


@query
def seq_loss(spark, sf_dir):
    loss = scoring.combined_loss(views.token_logits(spark, sf_dir), "seq_id", kl_coef=KL_COEF)
    return loss.select(
        "seq_id", "trained_tokens", _rounded("loss_ce"), _rounded("loss_kl"), _rounded("loss")
    )


@query
def total_loss(spark, sf_dir):
    loss = scoring.combined_loss(views.token_logits(spark, sf_dir), kl_coef=KL_COEF)
    return loss.select("trained_tokens", _rounded("loss_ce"), _rounded("loss_kl"), _rounded("loss"))


@query
def reference_kl(spark, sf_dir):
    terms = scoring.kl_terms(views.token_logits(spark, sf_dir))
    return terms.groupBy("seq_id").agg(F.round(F.avg("kl"), 6).alias("mean_kl"))


def _cut(tokens: DataFrame, *vectors: str) -> DataFrame:
    """Each vector in four rows."""
    return cutlosses.cut_vectors(tokens, -(-views.VOCABULARY // 4), *vectors)


@query
def token_kl_cut(spark, sf_dir):
    pieces = _cut(views.token_logits(spark, sf_dir), "logits", "ref_logits")
    return cutlosses.cut_kl_terms(pieces, KL_TEMPERATURE).select("seq_id", "pos", _rounded("kl"))


@query
def token_ce_cut(spark, sf_dir):
    pieces = _cut(views.student_logits(spark, sf_dir), "logits")
    return cutlosses.cut_cross_entropy_terms(pieces).select("seq_id", "pos", _rounded("ce"))


@query
def gem_loss_cut(spark, sf_dir):
    pieces = _cut(views.student_logits(spark, sf_dir), "logits")
    return cutlosses.cut_gem_loss(pieces, "seq_id").select("seq_id", _rounded("gem_loss"))


@query
def gem_loss_linear_cut(spark, sf_dir):
    pieces = _cut(views.student_logits(spark, sf_dir), "logits")
    return cutlosses.cut_gem_loss(pieces, num_items=1000, weights="linear").select(_rounded("gem_loss"))


@query
def seq_loss_cut(spark, sf_dir):
    pieces = _cut(views.token_logits(spark, sf_dir), "logits", "ref_logits")
    loss = cutlosses.cut_combined_loss(pieces, "seq_id", kl_coef=KL_COEF)
    return loss.select(
        "seq_id", "trained_tokens", _rounded("loss_ce"), _rounded("loss_kl"), _rounded("loss")
    )


@query
def align_vectors(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    student = vectors.select(F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector"))
    older = vectors.filter("vec_id % 5 < 3").select(
        F.col("vec_id").alias("token_id"),
        F.transform("embedding", lambda v: -v).alias("vector"),
    )
    doubled = lambda df: df.withColumn("vector", F.transform("vector", lambda v: v * 2))
    both = scoring.align_vectors(student, older).withColumn("part", F.lit("input")).unionByName(
        scoring.align_vectors(doubled(student), doubled(older)).withColumn("part", F.lit("output"))
    )
    millionths = F.transform("vector", lambda v: F.round(v.cast("double") * 1e6).cast("bigint"))
    return both.select("part", "token_id", "copied_from_student", F.array_join(millionths.cast("array<string>"), ",").alias("millionths"))


# ---- sources and sinks -----------------------------------------------------


@query
def jsonl_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "jsonl")
    writers.append_jsonl(_prepared(spark, sf_dir), path)
    return _as_text(readers.read_prepared(spark, path))


@query
def save_parquet(spark, sf_dir):
    path = fresh_folder(spark, "table")
    writers.save_table(_prepared(spark, sf_dir), path, "language")
    return _as_text(readers.read_table(spark, path))


@query
def filtered_table(spark, sf_dir):
    """Length filter on a stored table, where it reaches the Parquet scan."""
    path = fresh_folder(spark, "table")
    writers.save_table(_prepared(spark, sf_dir), path)
    stored = readers.read_table(spark, path, schema=schemas.PREPARED_CHATS)
    short = stored.filter(filters.within_length("num_tokens_serialized", MAX_SEQ_LEN // 2))
    return short.select("source_idx", "num_tokens_serialized")


@query
def tolerant_keys(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 6
    line = (
        F.when(kind == 0, F.concat(F.lit('{"source_idx": '), key, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"source_idx": '), key))
        .when(kind == 2, F.concat(F.lit('{"other": '), key, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('{"source_idx": "'), key, F.lit('"}')))
        .when(kind == 4, F.concat(F.lit('{"source_idx": '), key, F.lit(".9}")))
        .otherwise(F.concat(F.lit('{"source_idx": '), (F.col("doc_id") - 5).cast("string"), F.lit("}")))
    )
    path = fresh_folder(spark, "keys")
    views.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return readers.read_done_indices(spark, path)


@query
def finished_ids(spark, sf_dir):
    path = fresh_folder(spark, "generations")
    written = views.generations(spark, sf_dir)
    writers.append_generations(written.filter("pass_idx = 1"), path)
    writers.append_generations(written.filter("pass_idx = 2"), path)
    return readers.read_done_ids(spark, path)


@query
def shard_union(spark, sf_dir):
    folder = fresh_folder(spark, "shards")
    stored = f"{folder}/all"
    writers.save_table(_prepared(spark, sf_dir), stored)
    prepared = readers.read_table(spark, stored)
    for share_number, rank in enumerate((0, 1, 10)):
        share = filters.row_share("source_idx", 3, share_number)
        writers.append_jsonl(prepared.filter(share), f"{folder}/data.rank{rank}.jsonl")
    shards = readers.read_shards(spark, f"{folder}/data", schemas.PREPARED_CHATS)
    return shards.select("source_idx", "language", "shard", "rank").orderBy("shard", "source_idx")


@query
def finalize(spark, sf_dir):
    """Two shards that overlap with other content, the second torn in places."""
    folder = fresh_folder(spark, "shards")
    writers.append_jsonl(_prepared(spark, sf_dir), f"{folder}/data.rank0.jsonl")
    again = readers.read_prepared(spark, f"{folder}/data.rank0.jsonl").filter("source_idx % 2 = 0")
    line = F.to_json(F.struct("messages", F.lit("other").alias("language"), "num_tokens_serialized", "source_idx"))
    torn = F.when(F.col("source_idx") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    again.select(torn.alias("value")).write.text(f"{folder}/data.rank1.jsonl")
    return _as_text(writers.finalize_shards(
        spark, f"{folder}/data", f"{folder}/merged", dedup=True, broken="aside"
    ))


@query
def broken_lines(spark, sf_dir):
    """What the merge of ``finalize`` sets aside, per shard."""
    folder = fresh_folder(spark, "shards")
    keys = views.table(spark, sf_dir, "documents").select("doc_id")
    whole = F.to_json(F.struct(F.col("doc_id").alias("source_idx")))
    torn = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit('{"source_idx": '), F.col("doc_id").cast("string"))).otherwise(whole)
    keys.select(torn.alias("value")).write.text(f"{folder}/data.rank3.jsonl")
    writers.finalize_shards(spark, f"{folder}/data", f"{folder}/merged", broken="aside")
    return readers.read_table(spark, f"{folder}/merged-broken").select("shard", "rank", "line")


@query
def subset_split(spark, sf_dir):
    """Problems stored by subset and split; reading one of each prunes the rest."""
    path = fresh_folder(spark, "problems")
    split = F.when(F.col("doc_id") % 10 < 2, "test").otherwise("train")
    writers.save_table(views.problems(spark, sf_dir).withColumn("split", split), path, "subset", "split")
    return readers.read_table(spark, path, subset="en", split="test").select("id", "title", "description")


@query
def shard_names(spark, sf_dir):
    """The name each worker's shard of a table gets."""
    turns = views.chat_turns(spark, sf_dir)
    name = readers.shard_name(F.lit("data"), F.col("source_idx") % 12, F.lit(".jsonl"))
    return turns.groupBy(name.alias("shard")).agg(F.count(F.lit(1)).alias("turns"))


@query
def peek_rows(spark, sf_dir):
    return readers.peek(views.table(spark, sf_dir, "documents").orderBy("doc_id"), 10)


@query
def sharded_write(spark, sf_dir):
    path = fresh_folder(spark, "sharded")
    turns = views.chat_turns(spark, sf_dir).select("source_idx", "turn", "role")
    writers.write_shards(turns, path, 4, "source_idx", "turn")
    schema = "source_idx BIGINT, turn BIGINT, role STRING, rank INT"
    return spark.read.schema(schema).json(path).drop("rank")


@query
def append_log(spark, sf_dir):
    """The log table after two appends, exported as CSV with a header."""
    folder = fresh_folder(spark, "log")
    rows = _eval_log(spark, sf_dir).persist()  # one row per run
    writers.append_log(rows.filter("subset = 'en'"), f"{folder}/log")
    writers.append_log(rows.filter("subset <> 'en'"), f"{folder}/log")
    rows.unpersist()
    log = readers.read_table(spark, f"{folder}/log", schema=schemas.EVAL_LOG)
    writers.export_csv(log, f"{folder}/csv")
    return spark.read.schema(schemas.EVAL_LOG).option("header", "true").csv(f"{folder}/csv")


@query
def repair_output(spark, sf_dir):
    path = fresh_folder(spark, "repair")
    results = evaluate.repair_results(views.problems(spark, sf_dir), views.runs(spark, sf_dir))
    writers.write_repair_results(results, path)
    return readers.read_jsonl(spark, path, schemas.REPAIR_RESULTS)


@query
def json_records(spark, sf_dir):
    """Generation records encoded to one JSON text and decoded again."""
    record = F.to_json(F.struct("id", "title", "generation"))
    decoded = views.generations(spark, sf_dir).select(
        "pass_idx", F.from_json(record, schemas.GENERATIONS).alias("r")
    )
    return decoded.select("r.id", "pass_idx", "r.title", "r.generation")


# ---- streaming -------------------------------------------------------------


def _stored_chats(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Chats in parts of two kilobytes, so that parts come in different batches; whole
    chats among them have no part number."""
    rows = chats.assemble_chats(views.chat_turns(spark, sf_dir), part_bytes=2048)
    rows = rows.withColumns({
        "num_tokens": F.lit(None).cast("bigint"),
        "part": F.when(F.col("parts") > 1, F.col("part")), "parts": F.when(F.col("parts") > 1, F.col("parts")),
    })
    spread = rows.select(*schemas.CHAT_ROWS.fieldNames()).repartition(8, "source_idx", "part")
    writers.save_table(spread, f"{folder}/in")
    return stream_prepare.read_chat_stream(spark, f"{folder}/in", files_per_batch=2)


@query
def stream_build(spark, sf_dir):
    folder = fresh_folder(spark, "stream")
    stream = _stored_chats(spark, sf_dir, folder)
    stream_prepare.stream_prepare(
        stream, f"{folder}/out", f"{folder}/checkpoint", max_seq_len=MAX_SEQ_LEN
    ).awaitTermination()
    return _as_text(stream_prepare.read_prepared_stream(spark, f"{folder}/out"))


@query
def stream_resume(spark, sf_dir):
    """A stream into a table another run has begun, replayed from scratch once."""
    folder = fresh_folder(spark, "stream")
    writers.save_table(_prepared(spark, sf_dir).filter("source_idx % 3 = 0"), f"{folder}/out")
    for attempt in (1, 2):
        stream = (
            _stored_chats(spark, sf_dir, folder) if attempt == 1
            else stream_prepare.read_chat_stream(spark, f"{folder}/in")
        )
        stream_prepare.stream_resume(
            stream, f"{folder}/out", f"{folder}/checkpoint-{attempt}", max_seq_len=MAX_SEQ_LEN
        ).awaitTermination()
    return _as_text(readers.read_table(spark, f"{folder}/out", schema=schemas.PREPARED_CHATS))


@query
def stream_tokens_per_sec(spark, sf_dir):
    """The log arrives in four batches, in which runs begin, rest and go on."""
    folder = fresh_folder(spark, "stream")
    log = views.train_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    ends = log.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - ends["a"]) * 4 / (ends["b"] - ends["a"] + 1))).cast("int")
    columns = schemas.TRAIN_LOG.fieldNames()
    writers.save_table(log.select(*columns, quarter.alias("quarter")), f"{folder}/all", "quarter")
    for part in range(4):
        rows = spark.read.schema(schemas.TRAIN_LOG).parquet(f"{folder}/all/quarter={part}")
        rows.write.mode("append").parquet(f"{folder}/in")
        stream_throughput.stream_throughput(
            stream_throughput.read_log_stream(spark, f"{folder}/in"), TOKENS_IN_STEP,
            f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint",
        ).awaitTermination()
    rates = stream_throughput.read_throughput(spark, f"{folder}/out")
    return rates.select(
        "run_id", "log_id", "step", _rounded("tokens_per_sec", 4), _rounded("tokens_per_sec_avg", 4)
    )


# ---- user functions --------------------------------------------------------


def _echo(batch: list[str]) -> list[str]:
    return [f"{len(prompt)} characters: {prompt}" for prompt in batch]


@query
def generate_batches(spark, sf_dir):
    thought = _replies(spark, sf_dir).withColumn("think", text.last_think(F.col("content")))
    summed = generate.summarize_thinks(thought, "think", "summary", _echo)
    return summed.select("source_idx", "turn", "summary")


@query
def generate_by_length(spark, sf_dir):
    """The same texts from batches of prompts of like lengths."""
    thought = _replies(spark, sf_dir).withColumn("think", text.last_think(F.col("content")))
    summed = generate.summarize_thinks(thought, "think", "summary", _echo, token_budget=4000)
    return summed.select("source_idx", "turn", "summary")


def _lengths(batch: list[str]) -> list[int]:
    pattern = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")
    return [len(pattern.findall(line)) for line in batch]


@query
def udf_token_count(spark, sf_dir):
    counter = counter_from(_lengths)
    return views.chat_turns(spark, sf_dir).select(
        "source_idx", "turn", counter(F.col("content")).alias("tokens")
    )
