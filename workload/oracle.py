"""Reference SQL (DuckDB dialect) of every registered query that SQL can state."""

from __future__ import annotations

from chatloom.functions.distributions import GEM_BETA, GEM_SLOPE
from chatloom.sources import prompts
from workload import queries as q
from workload import views


# The white space of the rules, in DuckDB's notation.
WS_POINTS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


# ---- text rules as SQL expressions -----------------------------------------

WS = f"[{WS_POINTS}]"
FENCE = rf"```([a-zA-Z0-9_+\-]*){WS}*\n(.*?)```"
TOKEN = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{WS_POINTS}]"


def strip(x):
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def rstrip(x):
    return f"regexp_replace({x}, '{WS}+\\z', '', 'g')"


def tokens(x):
    return f"CAST(len(regexp_extract_all({x}, '{TOKEN}')) AS BIGINT)"


def think(x):
    return f"list_extract(regexp_extract_all({x}, '<think>(.*?)</think>', 1, 'is'), -1)"


def fence(x):
    return f"list_extract(regexp_extract_all({x}, '{FENCE}', 0, 's'), -1)"


def tag(x):
    return f"lower(regexp_extract({x}, '{FENCE}', 1, 's'))"


def body(x):
    return f"regexp_extract({x}, '{FENCE}', 2, 's')"


def language(x):
    return (
        f"CASE WHEN {x} IN ('python', 'py', '') THEN 'python' "
        f"WHEN {x} IN ('cpp', 'c++', 'cc') THEN 'cpp' ELSE {x} END"
    )


def lenient(x):
    hits = f"regexp_extract_all({x}, '```(?:python)?\\n(.*?)```', 1, 's')"
    return f"coalesce(list_extract({hits}, -1), {x})"


def plain(x):
    no_think = f"regexp_replace({x}, '<think>.*?</think>', ' ', 'gis')"
    one_line = f"regexp_replace(replace({no_think}, '```', ' '), '{WS}+', ' ', 'g')"
    return f"regexp_replace({one_line}, '^ | $', '', 'g')"


def cut(x):
    return (
        f"CASE WHEN length({x}) > 320 "
        f"THEN regexp_replace(left({x}, 320), ' [^ ]*$', '') || '...' ELSE {x} END"
    )


def turn_text(role, content):
    return f"('<|im_start|>' || {role} || chr(10) || {content} || '<|im_end|>' || chr(10))"


def prompt_text(system, user):
    return f"({turn_text(_quote('system'), system)} || {turn_text(_quote('user'), user)} || '<|im_start|>assistant' || chr(10))"


def compose(summary, lang, code):
    return (
        f"(CASE WHEN {strip(summary)} <> '' THEN {strip(summary)} || chr(10) || chr(10) ELSE '' END"
        f" || '```' || {lang} || chr(10) || {rstrip(code)} || chr(10) || '```')"
    )


# ---- views -----------------------------------------------------------------

PASSES = "(SELECT unnest(range(1, 4))::INTEGER AS pass_idx)"
PHASES = "(SELECT unnest(range(1, 3))::INTEGER AS phase)"

CHAT_TURNS = (
    f"chat_turns AS (SELECT conv_id AS source_idx, turn, role, {views.CHAT_CONTENT} AS content "
    "FROM conversations)"
)
REPLIES = f"{CHAT_TURNS}, replies AS (SELECT source_idx, turn, content FROM chat_turns WHERE role = 'assistant')"
PROBLEMS = f"problems AS (SELECT {_columns(views.PROBLEM_COLUMNS)} FROM documents)"
GENERATIONS = (
    f"generations AS (SELECT {views.PROBLEM_COLUMNS['id']} AS id, {views.PROBLEM_COLUMNS['title']} AS title, "
    f"pass_idx, {views.GENERATION} AS generation FROM documents CROSS JOIN {PASSES})"
)
RUNS = (
    f"runs AS (SELECT {views.PROBLEM_COLUMNS['id']} AS id, pass_idx, phase, {_columns(views.RUN_COLUMNS)} "
    f"FROM documents CROSS JOIN {PASSES} CROSS JOIN {PHASES})"
)
RUN_NUMBERS = "(SELECT unnest(range(1, 4))::INTEGER AS run_no)"
SETTINGS = (
    f"settings AS (SELECT {views.RUN_ID} AS run_id, lang AS subset, {_columns(views.SETTING_COLUMNS)} "
    f"FROM documents CROSS JOIN {RUN_NUMBERS} WHERE run_no = 1 OR {views.SECOND_RUN} GROUP BY lang, run_no)"
)
TRAIN_LOG = (
    "numbered AS (SELECT user_id AS run_id, event_id AS log_id, ts, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events), "
    f"train_log AS (SELECT run_id, log_id, ts, {views.LOG_STEP} AS step FROM numbered)"
)
TOKEN_LOGITS = (
    "token_logits AS (SELECT CAST(floor(a.vec_id/8.0) AS BIGINT) AS seq_id, a.vec_id%8 AS pos, "
    f"{views.LABEL.replace('vec_id', 'a.vec_id').replace('ELSE label', 'ELSE a.label')} AS label, "
    "a.embedding::DOUBLE[] AS logits, b.embedding::DOUBLE[] AS ref_logits "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id+1)%(SELECT count(*) FROM embeddings))"
)


def _user_prompt() -> str:
    gap = "chr(10) || chr(10)"
    sample = (
        f"chr(10) || '## Example' || {gap} || '```input' || chr(10) || {strip('ex_input')} || chr(10) || '```'"
        f" || {gap} || '```output' || chr(10) || {strip('ex_output')} || chr(10) || '```'"
    )
    parts = [
        "'# ' || nullif(title, '')",
        "'Problem: ' || coalesce(nullif(description, ''), nullif(statement, ''))",
        f"chr(10) || '## Input' || {gap} || nullif(input_format, '')",
        f"chr(10) || '## Output' || {gap} || nullif(output_format, '')",
        f"CASE WHEN ex_input IS NOT NULL THEN {sample} END",
    ]
    return f"concat_ws(chr(10) || chr(10), {', '.join(parts)})"


ASKED = f"{PROBLEMS}, asked AS (SELECT *, {_user_prompt()} AS user_prompt FROM problems)"
TIME_LIMIT = "coalesce(time_limit, 3.0::DOUBLE) * coalesce(testset_size, 10)"
GRADED = (
    f"{PROBLEMS}, {RUNS}, graded AS (SELECT r.id, r.pass_idx, r.phase, r.stdout, r.stderr, "
    f"{strip('r.stdout')} = {strip('p.ex_output')} AS ok "
    "FROM runs r JOIN problems p ON p.id = r.id WHERE p.ex_input IS NOT NULL)"
)

# ---- the preparation plan, one common table per stage -----------------------

DEFAULT_SYSTEM_TURN = turn_text(_quote("system"), _quote(prompts.CHAT_DEFAULT_SYSTEM))
STAGES = f"""{CHAT_TURNS},
asked_turns AS (SELECT source_idx,
  string_agg({turn_text('role', 'content')}, '' ORDER BY turn) AS asked,
  arg_min(role, turn) AS opening_role
  FROM chat_turns WHERE role IN ('system', 'user') GROUP BY source_idx),
last_reply AS (SELECT source_idx, arg_max(content, turn) AS reply
  FROM chat_turns WHERE role = 'assistant' GROUP BY source_idx),
profile AS (SELECT c.source_idx, l.reply,
  CASE WHEN a.opening_role = 'system' THEN '' ELSE {DEFAULT_SYSTEM_TURN} END || coalesce(a.asked, '') AS prompt
  FROM (SELECT DISTINCT source_idx FROM chat_turns) c
  LEFT JOIN asked_turns a USING (source_idx) LEFT JOIN last_reply l USING (source_idx)),
found AS (SELECT *, {fence('reply')} AS fence, {think('reply')} AS think FROM profile),
named AS (SELECT *, {tag('fence')} AS tag, {body('fence')} AS code, {plain("coalesce(think, '')")} AS line FROM found),
worded AS (SELECT *, {language('tag')} AS language, {cut('line')} AS summary FROM named),
answered AS (SELECT *, {compose('summary', 'language', 'code')} AS answer FROM worded),
drafted AS (SELECT *, prompt || {turn_text(_quote('assistant'), 'answer')} AS chat FROM answered),
counted AS (SELECT *, {tokens('chat')} AS num_tokens_serialized FROM drafted)"""

HAS_CODE = "coalesce(reply, '') <> '' AND fence IS NOT NULL"
KEPT = f"{HAS_CODE} AND num_tokens_serialized <= {q.MAX_SEQ_LEN}"
PREPARED = f"WITH {STAGES} SELECT source_idx, language, num_tokens_serialized, chat FROM counted WHERE {KEPT}"


# ---- losses -----------------------------------------------------------------


def _log_softmax(x):
    shifted = f"list_transform({x}, lambda v: v - list_max({x}))"
    return f"(SELECT list_transform(s, lambda v: v - ln(list_sum(list_transform(s, lambda w: exp(w))))) FROM (SELECT {shifted} AS s))"


def _tempered(x, temperature):
    return f"list_transform({x}, lambda v: v / {temperature})"


LSE = "ln(list_sum(list_transform({x}, lambda v: exp(v - list_max({x}))))) + list_max({x})"
TRAINED = "label <> -100"


def _lse(x):
    return LSE.format(x=x)


def _kl_tables(temperature) -> str:
    return (
        f"tempered AS (SELECT *, {_tempered('logits', temperature)} AS x, "
        f"{_tempered('ref_logits', temperature)} AS y FROM token_logits), "
        f"normed AS (SELECT *, {_lse('x')} AS lx, {_lse('y')} AS ly, {_lse('logits')} AS ll FROM tempered), "
        "scored AS (SELECT *, ll - logits[label + 1] AS ce, "
        "list_sum(list_transform(list_zip(x, y), lambda e: exp(e[1] - lx) * ((e[1] - lx) - (e[2] - ly)))) AS kl "
        "FROM normed)"
    )


GEM_TABLES = (
    "shifted AS (SELECT seq_id, pos, logits, lead(label) OVER (PARTITION BY seq_id ORDER BY pos) AS label FROM token_logits), "
    f"chosen AS (SELECT *, logits[label + 1] AS xl, {_lse('logits')} AS ll, "
    f"list_transform(logits, lambda v: v / {GEM_BETA}) AS xb FROM shifted WHERE label IS NOT NULL AND {TRAINED}), "
    f"normed AS (SELECT *, {_lse('xb')} AS lb FROM chosen)"
)


def _gem(weight: str) -> str:
    return (
        f"-list_sum(list_transform(logits, lambda v: exp(v / {GEM_BETA} - lb) * {weight} "
        "* ((xl - ll) - (v - ll))))"
    )


SIGMOID = f"(1 / (1 + exp(-{GEM_SLOPE} * (v - xl))))"


def _loss(by: str) -> str:
    first = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    ce = f"avg(CASE WHEN {TRAINED} THEN ce END)"
    kl = f"coalesce(sum(CASE WHEN {TRAINED} THEN kl END), 0) / greatest(count(*) FILTER ({TRAINED}), 1)"
    return (
        f"WITH {TOKEN_LOGITS}, {_kl_tables(1.0)} SELECT {first}count(*) FILTER ({TRAINED}) AS trained_tokens, "
        f"round({ce}, 6) AS loss_ce, round({kl}, 6) AS loss_kl, round({ce} + {q.KL_COEF} * ({kl}), 6) AS loss "
        f"FROM scored{group}"
    )


# ---- throughput -------------------------------------------------------------

RATES = f"""{TRAIN_LOG},
stepped AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY run_id) AS begin_us FROM train_log),
placed AS (SELECT *, lag(us, 1, begin_us) OVER w AS last_us,
  greatest(0, coalesce(max(step) OVER (PARTITION BY run_id ORDER BY ts, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS last_step
  FROM stepped WINDOW w AS (PARTITION BY run_id ORDER BY ts, log_id)),
rates AS (SELECT run_id, log_id, step,
  round({float(q.TOKENS_IN_STEP)}::DOUBLE * (step - last_step) / greatest((us - last_us) / 1e6, 1e-9), 4) AS tokens_per_sec,
  round({float(q.TOKENS_IN_STEP)}::DOUBLE * step / greatest((us - begin_us) / 1e6, 1e-9), 4) AS tokens_per_sec_avg
  FROM placed WHERE step > last_step)"""


# ---- evaluation --------------------------------------------------------------

OUTCOMES = (
    f"{GRADED}, {GENERATIONS}, "
    "solved AS (SELECT id, bool_or(ok) AS solved FROM graded WHERE phase = 1 GROUP BY id), "
    f"spent AS (SELECT id, sum({tokens('generation')}) AS new_tokens FROM generations GROUP BY id), "
    "outcomes AS (SELECT p.id, p.subset, p.ex_input IS NOT NULL AS evaluable, "
    "coalesce(s.solved, false) AS solved, coalesce(t.new_tokens, 0) AS new_tokens "
    "FROM problems p LEFT JOIN solved s USING (id) LEFT JOIN spent t USING (id))"
)
TOTALS = (
    "count(*) AS problems_total, count(*) FILTER (evaluable) AS problems_evaluable, "
    "count(*) FILTER (solved) AS solved_on_example"
)
PASS_RATE = "coalesce(count(*) FILTER (solved)::DOUBLE / nullif(count(*) FILTER (evaluable), 0), 0)"
NEW_TOKENS = "coalesce(sum(new_tokens)::DOUBLE / nullif(count(*), 0), 0)"
RUN_RULE = views.RUN_CASE.replace("phase", "run_no")
COVERED = f"documents CROSS JOIN {PASSES} CROSS JOIN {RUN_NUMBERS} WHERE run_no < 3 AND ({views.RUN_COVERS})"
EVAL_LOG = f"""WITH {SETTINGS}, covered AS (SELECT {views.RUN_ID} AS run_id, doc_id, pass_idx,
  {views.GENERATION} AS generation, {views.PROBLEM_COLUMNS['ex_output']} AS ex_output,
  {views.RUN_COLUMNS['stdout'].replace(views.RUN_CASE, RUN_RULE)} AS stdout FROM {COVERED}),
outcomes AS (SELECT run_id, doc_id, bool_or(ex_output IS NOT NULL) AS evaluable,
  coalesce(bool_or({strip('stdout')} = {strip('ex_output')}), false) AS solved,
  sum({tokens('generation')}) AS new_tokens FROM covered GROUP BY run_id, doc_id),
totals AS (SELECT run_id, {TOTALS}, {PASS_RATE} AS rate, {NEW_TOKENS} AS average FROM outcomes GROUP BY run_id)
SELECT replace(strftime(make_timestamp(started_us + elapsed_us), '%Y-%m-%dT%H:%M:%S.%fZ'), '.000000Z', 'Z') AS timestamp,
 CASE WHEN weights_path IS NOT NULL THEN model_id || '+' || weights_path
   WHEN checkpoint_path IS NOT NULL THEN checkpoint_path ELSE model_id END AS model_id,
 subset, split, coalesce(problems_total, 0) AS sample, temperature, top_p, max_new_tokens, passes,
 coalesce(problems_total, 0) AS problems_total, coalesce(problems_evaluable, 0) AS problems_evaluable,
 coalesce(solved_on_example, 0) AS solved_on_example,
 round(coalesce(rate, 0), 4) AS example_pass_rate, round(coalesce(average, 0), 2) AS avg_new_tokens,
 round(elapsed_us / 1e6, 2) AS elapsed_sec
FROM settings LEFT JOIN totals USING (run_id)"""


def _repaired(been_run: str = "true") -> str:
    return (
        f"{GRADED}, flags AS (SELECT id, bool_or(CASE WHEN phase = 1 THEN ok END) AS first_ok, "
        f"bool_or(CASE WHEN phase = 2 THEN ok END) AS second_ok FROM graded WHERE pass_idx = 1 AND {been_run} GROUP BY id), "
        "repaired AS (SELECT p.id, p.title, coalesce(first_ok, false) AS pass_after_first, "
        "NOT coalesce(first_ok, false) AND coalesce(second_ok, false) AS pass_after_repair "
        "FROM problems p LEFT JOIN flags USING (id) WHERE p.ex_input IS NOT NULL)"
    )


REPAIRED = _repaired()


def _repair_request() -> str:
    return (
        r"'Original Problem:\n' || a.user_prompt || '\n\nProgram:\n```python\n' || "
        + lenient("n.generation")
        + r" || '\n```\n\nInput:\n' || coalesce(a.ex_input, '') || '\n\nObserved:\n' || g.stdout || '\nErrors:\n' || g.stderr"
        r" || '\n\nPlease return a corrected program.'"
    )


CHAT_KEYS = "chat_keys AS (SELECT conv_id AS source_idx, count(*) AS turns FROM conversations GROUP BY conv_id)"
DONE_CHATS = "done AS (SELECT DISTINCT conv_id AS source_idx FROM conversations WHERE conv_id % 3 = 0)"
SOLVE_PROMPT = prompt_text(_quote(prompts.SOLVE_SYSTEM), "user_prompt")
# No chat is above the budget of a row.
PART = "CAST(0 * turn AS BIGINT)"
ASSEMBLED = f"{CHAT_TURNS}, rows AS (SELECT source_idx, {PART} AS part, string_agg({turn_text('role', 'content')}, '' ORDER BY turn) AS chat FROM chat_turns GROUP BY source_idx, {PART})"


def statements() -> dict[str, str]:
    asked_roles = "role IN ('system', 'user')"

    def opened(default: str) -> str:
        added = turn_text(_quote("system"), _quote(default))
        return f"CASE WHEN opening_role = 'system' OR part > 0 THEN '' ELSE {added} END || coalesce(asked, '')"

    sql = {
        "sft_build": PREPARED,
        "sft_build_rows": PREPARED,
        "sft_build_parts": PREPARED,
        "sft_build_resume": f"{PREPARED} AND source_idx % 3 <> 0",
        "skip_funnel": f"""WITH {STAGES} SELECT CASE WHEN coalesce(reply, '') = '' THEN 'no_reply'
            WHEN fence IS NULL THEN 'no_code' WHEN language <> 'python' THEN 'other_language'
            WHEN num_tokens_serialized > {q.MAX_SEQ_LEN} THEN 'too_long' ELSE 'kept' END AS outcome,
            count(*) AS chats FROM counted GROUP BY 1""",
        "skip_funnel_rows": f"""WITH {STAGES} SELECT CASE WHEN source_idx % 11 = 0 OR source_idx % 13 = 0 THEN 'no_messages'
            WHEN coalesce(reply, '') = '' THEN 'no_reply' WHEN fence IS NULL THEN 'no_code' WHEN language <> 'python' THEN 'other_language'
            WHEN num_tokens_serialized > {q.MAX_SEQ_LEN} THEN 'too_long' ELSE 'kept' END AS outcome,
            count(*) AS chats FROM counted GROUP BY 1""",
        "lang_filter": f"WITH {STAGES} SELECT source_idx, language FROM counted WHERE {KEPT} AND language = 'python'",
        "token_guard": f"""WITH {STAGES} SELECT source_idx, num_tokens_serialized,
            num_tokens_serialized <= {q.MAX_SEQ_LEN} AS kept FROM counted WHERE {HAS_CODE}""",
        "language_profile": f"""WITH {STAGES} SELECT language, count(*) AS chats,
            CAST(sum(num_tokens_serialized) AS BIGINT) AS tokens, round(avg(num_tokens_serialized), 6) AS avg_tokens,
            max(num_tokens_serialized) AS max_tokens FROM counted WHERE {KEPT} GROUP BY language""",
        "last_think": f"WITH {REPLIES} SELECT source_idx, turn, {think('content')} AS think FROM replies",
        "last_code_block": f"""WITH {REPLIES}, f AS (SELECT *, {fence('content')} AS fence FROM replies)
            SELECT source_idx, turn, {tag('fence')} AS tag, {body('fence')} AS code FROM f""",
        "code_language": f"""WITH {REPLIES}, f AS (SELECT *, {fence('content')} AS fence FROM replies),
            t AS (SELECT *, {tag('fence')} AS tag FROM f) SELECT source_idx, turn, {language('tag')} AS language FROM t""",
        "sanitize_text": f"""WITH {REPLIES}, p AS (SELECT *, {plain('content')} AS line FROM replies)
            SELECT source_idx, turn, {cut('line')} AS explanation FROM p""",
        "lenient_code": f"WITH {GENERATIONS} SELECT id, pass_idx, {lenient('generation')} AS code FROM generations",
        "last_assistant_turn": f"""WITH {CHAT_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_idx
            ORDER BY turn DESC) AS rn FROM chat_turns WHERE role = 'assistant')
            SELECT source_idx, turn, content FROM r WHERE rn = 1""",
        "sys_user_prefix": f"""WITH {CHAT_TURNS}, a AS (SELECT source_idx, {PART} AS part,
            string_agg({turn_text('role', 'content')}, '' ORDER BY turn) FILTER ({asked_roles}) AS asked,
            arg_min(role, turn) FILTER ({asked_roles}) AS opening_role FROM chat_turns GROUP BY source_idx, {PART})
            SELECT source_idx, part, {opened(prompts.CHAT_DEFAULT_SYSTEM)} AS prompt,
            {opened(prompts.TRAINER_DEFAULT_SYSTEM)} AS trainer_prompt FROM a""",
        "compose_reply": f"""WITH {REPLIES}, f AS (SELECT *, {fence('content')} AS fence, {think('content')} AS think FROM replies),
            n AS (SELECT *, {tag('fence')} AS tag, {body('fence')} AS code, {plain("coalesce(think, '')")} AS line FROM f WHERE fence IS NOT NULL),
            w AS (SELECT *, {language('tag')} AS language, {cut('line')} AS summary FROM n)
            SELECT source_idx, turn, {compose('summary', 'language', 'code')} AS answer FROM w""",
        "chat_text": f"""WITH {ASSEMBLED} SELECT source_idx, part, chat, chat || '<|im_start|>assistant' || chr(10) AS open_chat,
            {tokens('chat')} AS tokens FROM rows""",
        "turns_round_trip": f"WITH {CHAT_TURNS} SELECT * FROM chat_turns",
        "struct_of_arrays": f"""WITH {CHAT_TURNS} SELECT source_idx, {PART} AS part, string_agg(role, ',' ORDER BY turn) AS roles,
            string_agg(content, '|' ORDER BY turn) AS contents,
            string_agg({turn_text('role', 'content')}, '' ORDER BY turn) AS chat FROM chat_turns GROUP BY source_idx, {PART}""",
        "assistant_tokens": f"""WITH {CHAT_TURNS}, t AS (SELECT *, {tokens(turn_text('role', 'content'))} AS tok FROM chat_turns)
            SELECT source_idx, count(*) AS turns, CAST(sum(tok) AS BIGINT) AS tokens,
            CAST(sum(CASE WHEN role = 'assistant' THEN tok ELSE 0 END) AS BIGINT) AS assistant_tokens FROM t GROUP BY source_idx""",
        "length_filter": f"""WITH {ASSEMBLED}, t AS (SELECT {tokens('chat')} AS tokens FROM rows)
            SELECT count(*) AS rows_before, count(*) FILTER (tokens <= {q.MAX_SEQ_LEN} + 128) AS rows_after FROM t""",
        "rank_slice": "SELECT conv_id AS source_idx, turn, role FROM conversations WHERE conv_id % 4 = 1",
        "resume_anti": f"WITH {CHAT_KEYS}, {DONE_CHATS} SELECT * FROM chat_keys WHERE source_idx NOT IN (SELECT source_idx FROM done)",
        "resume_semi": f"WITH {CHAT_KEYS}, {DONE_CHATS} SELECT * FROM chat_keys WHERE source_idx IN (SELECT source_idx FROM done)",
        "resume_report": f"""WITH {CHAT_KEYS}, {DONE_CHATS} SELECT count(*) AS rows_total, count(d.source_idx) AS rows_done,
            count(*) - count(d.source_idx) AS rows_todo FROM chat_keys c LEFT JOIN done d USING (source_idx)""",
        "todo_except": f"WITH {CHAT_KEYS}, {DONE_CHATS} SELECT source_idx FROM chat_keys EXCEPT SELECT source_idx FROM done",
        "first_n_after_resume": f"""WITH {PROBLEMS} SELECT id, title FROM (SELECT * FROM problems
            WHERE doc_id % 5 <> 0 ORDER BY doc_id LIMIT {q.SAMPLE})""",
        "merge_summaries": f"""WITH {REPLIES}, l AS (SELECT source_idx, arg_max(content, turn) AS content FROM replies GROUP BY source_idx),
            p AS (SELECT *, {plain('content')} AS line FROM l)
            SELECT source_idx, CASE WHEN source_idx % 4 = 0 THEN '' ELSE {cut('line')} END AS summary FROM p""",
        "problem_prompt": f"WITH {ASKED} SELECT id, user_prompt FROM asked",
        "prompt_passes": f"""WITH {ASKED} SELECT id, pass_idx, md5({SOLVE_PROMPT}) AS prompt_md5,
            {TIME_LIMIT} AS total_time_limit FROM (SELECT * FROM asked WHERE doc_id % 5 <> 0
            ORDER BY doc_id LIMIT {q.SAMPLE}) CROSS JOIN {PASSES}""",
        "prompt_passes_all": f"""WITH {ASKED} SELECT id, pass_idx, md5({SOLVE_PROMPT}) AS prompt_md5,
            {TIME_LIMIT} AS total_time_limit FROM (SELECT * FROM asked WHERE doc_id % 5 <> 0) CROSS JOIN {PASSES}""",
        "prompt_passes_by_pass": f"""WITH {PROBLEMS} SELECT id, pass_idx FROM (SELECT * FROM problems ORDER BY doc_id
            LIMIT {q.RERUN_SAMPLE} OFFSET {q.RERUN_SAMPLE}) CROSS JOIN {PASSES}
            WHERE NOT (doc_id % 5 = 0 AND pass_idx = 1)""",
        "prompt_by_version": f"""WITH {ASKED} SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'current' ELSE 'previous' END AS version,
            CASE WHEN doc_id % 2 = 0 THEN {SOLVE_PROMPT}
            ELSE {prompt_text(_quote(prompts.SOLVE_SYSTEM_PREVIOUS), 'user_prompt')} END AS prompt FROM asked""",
        "time_limits": f"""WITH {PROBLEMS} SELECT id, {TIME_LIMIT} AS total_time_limit, ex_input AS example_input
            FROM problems WHERE ex_input IS NOT NULL""",
        "repair_prompt": f"""WITH {GRADED}, {GENERATIONS}, asked AS (SELECT *, {_user_prompt()} AS user_prompt FROM problems),
            r AS (SELECT g.id, {_repair_request()} AS repair_user FROM graded g JOIN asked a ON a.id = g.id
            JOIN generations n ON n.id = g.id AND n.pass_idx = 1 WHERE g.phase = 1 AND g.pass_idx = 1 AND NOT g.ok)
            SELECT id, repair_user, md5({prompt_text(_quote(prompts.REPAIR_SYSTEM), 'repair_user')}) AS prompt_md5 FROM r""",
        "summary_prompt": f"""WITH {REPLIES}, t AS (SELECT *, {think('content')} AS think FROM replies)
            SELECT source_idx, turn, {_summary_prompt()} AS prompt FROM t WHERE {strip('think')} <> ''""",
        "strip_prompt": f"WITH {GENERATIONS} SELECT id, pass_idx, generation AS added FROM generations",
        "grade_runs": f"WITH {GRADED} SELECT id, pass_idx, phase, ok FROM graded",
        "pass_any_of_k": f"WITH {GRADED} SELECT id, bool_or(ok) AS solved FROM graded WHERE phase = 1 GROUP BY id",
        "eval_summary": f"""WITH {OUTCOMES} SELECT {TOTALS}, round({PASS_RATE}, 6) AS example_pass_rate,
            round({NEW_TOKENS}, 6) AS avg_new_tokens FROM outcomes""",
        "eval_log_row": EVAL_LOG,
        "append_log": EVAL_LOG,
        "repair_flags": f"WITH {_repaired('CAST(substring(id, 2) AS BIGINT) % 7 <> 0')} SELECT * FROM repaired",
        "repair_output": f"WITH {REPAIRED} SELECT * FROM repaired",
        "repair_summary": f"""WITH {REPAIRED} SELECT count(*) AS problems, count(*) FILTER (pass_after_first) AS solved_at_first,
            count(*) FILTER (pass_after_repair) AS solved_by_repair FROM repaired""",
        "tokens_per_sec": f"WITH {RATES} SELECT run_id, log_id, step, tokens_per_sec FROM rates",
        "tokens_per_sec_avg": f"WITH {RATES} SELECT run_id, log_id, tokens_per_sec_avg FROM rates",
        "stream_tokens_per_sec": f"WITH {RATES} SELECT * FROM rates",
        "pack_sequences": f"""WITH {CHAT_TURNS}, t AS (SELECT source_idx, turn, {tokens(turn_text('role', 'content'))} AS tokens FROM chat_turns),
            s AS (SELECT *, CAST(coalesce(sum(tokens) OVER (ORDER BY source_idx, turn ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0) AS BIGINT) AS token_start FROM t)
            SELECT *, CAST(floor(token_start / {q.PACK_LEN}) AS BIGINT) AS bin FROM s""",
        "row_numbers": "SELECT doc_id, text, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS source_idx FROM documents",
        "token_kl": f"WITH {TOKEN_LOGITS}, {_kl_tables(q.KL_TEMPERATURE)} SELECT seq_id, pos, round(kl, 6) AS kl FROM scored WHERE {TRAINED}",
        "token_ce": f"WITH {TOKEN_LOGITS}, {_kl_tables(1.0)} SELECT seq_id, pos, round(ce, 6) AS ce FROM scored WHERE {TRAINED}",
        "gem_loss": f"WITH {TOKEN_LOGITS}, {GEM_TABLES} SELECT seq_id, round(avg({_gem(SIGMOID)}), 6) AS gem_loss FROM normed GROUP BY seq_id",
        "gem_loss_linear": f"WITH {TOKEN_LOGITS}, {GEM_TABLES} SELECT round(sum({_gem('1')}) / 1000.0, 6) AS gem_loss FROM normed",
        "seq_loss": _loss("seq_id"),
        "total_loss": _loss(""),
        "reference_kl": f"WITH {TOKEN_LOGITS}, {_kl_tables(1.0)} SELECT seq_id, round(avg(kl), 6) AS mean_kl FROM scored WHERE {TRAINED} GROUP BY seq_id",
        "align_vectors": """WITH kinds AS (SELECT 'input' AS part, 1 AS factor UNION ALL SELECT 'output', 2),
            aligned AS (SELECT part, vec_id AS token_id, vec_id % 5 >= 3 AS copied_from_student, list_transform(embedding,
            lambda v: CASE WHEN vec_id % 5 < 3 THEN -v ELSE v END * factor) AS vector FROM embeddings CROSS JOIN kinds)
            SELECT part, token_id, copied_from_student, array_to_string(list_transform(vector,
            lambda v: CAST(CAST(round(v::DOUBLE * 1e6) AS BIGINT) AS VARCHAR)), ',') AS millionths FROM aligned""",
        "jsonl_round_trip": PREPARED,
        "save_parquet": PREPARED,
        "finalize": PREPARED,
        "broken_lines": """SELECT 'data.rank3.jsonl' AS shard, 3 AS rank, '{"source_idx": ' || doc_id AS line
            FROM documents WHERE doc_id % 10 = 0""",
        "subset_split": f"WITH {PROBLEMS} SELECT id, title, description FROM problems WHERE subset = 'en' AND doc_id % 10 < 2",
        "shard_names": """SELECT 'data.rank' || (conv_id % 12) || '.jsonl' AS shard, count(*) AS turns
            FROM conversations GROUP BY conv_id % 12""",
        "peek_rows": "SELECT * FROM documents ORDER BY doc_id LIMIT 10",
        "filtered_table": f"""WITH {STAGES} SELECT source_idx, num_tokens_serialized FROM counted
            WHERE {KEPT} AND num_tokens_serialized <= {q.MAX_SEQ_LEN // 2} + 128""",
        "tolerant_keys": """SELECT DISTINCT CASE WHEN doc_id % 6 = 5 THEN doc_id - 5 ELSE doc_id END AS source_idx
            FROM documents WHERE doc_id % 6 IN (0, 3, 4, 5)""",
        "finished_ids": f"WITH {PROBLEMS} SELECT id FROM problems",
        "shard_union": f"""WITH {STAGES}, r AS (SELECT source_idx, language,
            CASE source_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 10 END AS rank FROM counted WHERE {KEPT})
            SELECT source_idx, language, 'data.rank' || rank || '.jsonl' AS shard, rank FROM r""",
        "sharded_write": f"WITH {CHAT_TURNS} SELECT source_idx, turn, role FROM chat_turns",
        "json_records": f"WITH {GENERATIONS} SELECT id, pass_idx, title, generation FROM generations",
        "stream_build": PREPARED,
        "stream_resume": PREPARED,
        "generate_batches": f"""WITH {REPLIES}, t AS (SELECT *, {think('content')} AS think FROM replies),
            p AS (SELECT *, CASE WHEN {strip("coalesce(think, '')")} <> '' THEN {_summary_prompt()} END AS prompt FROM t),
            l AS (SELECT *, {plain("coalesce(length(prompt) || ' characters: ' || prompt, '')")} AS line FROM p)
            SELECT source_idx, turn, {cut('line')} AS summary FROM l""",
        "udf_token_count": f"WITH {CHAT_TURNS} SELECT source_idx, turn, {tokens('content')} AS tokens FROM chat_turns",
    }
    # Counted while the chats are written, in one run or per micro-batch.
    sql["observed_funnel"] = sql["stream_funnel"] = sql["skip_funnel"]
    # A vocabulary in pieces has the same losses.
    for name in ("token_kl", "token_ce", "gem_loss", "gem_loss_linear", "seq_loss"):
        sql[f"{name}_cut"] = sql[name]
    sql["storage_numbers"] = "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS number FROM documents"
    sql["zip_answers"] = f"WITH {REPLIES} SELECT source_idx, turn, md5(content) AS answer FROM replies"
    sql["first_half"] = """SELECT doc_id, source, n_chars FROM documents
        ORDER BY source NULLS FIRST, n_chars NULLS FIRST, doc_id NULLS FIRST LIMIT (SELECT count(*) // 2 FROM documents)"""
    sql["generate_by_length"] = sql["generate_batches"]
    return sql


def _summary_prompt() -> str:
    user = "'Chain-of-thought:' || chr(10) || think || chr(10) || chr(10) || 'Write the short explanation now.'"
    return prompt_text(_quote(prompts.SUMMARY_SYSTEM), f"({user})")
