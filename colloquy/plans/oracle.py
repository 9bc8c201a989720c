"""DuckDB oracle SQL, one statement per query of ``plans.catalog``.

Written independently of the Spark code: plain SQL over the driver's
pre-registered views, with windows, ``string_agg`` and ``contains``
stating each rule directly (row by row where the Spark plan decomposes).
"""

from __future__ import annotations

from colloquy.plans import bindings as B

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"

# ------------------------------------------------------------------ B1

B1_GOLD = "gold(disease, ord, symptom, weight) AS (VALUES " + ", ".join(
    f"({_q(d)}, {o}, {_q(s)}, {_q(w)})" for d, o, s, w in B.B1_GOLD_ROWS) + ")"

B1_BASE = f"""
{B1_GOLD},
b AS (
  SELECT user_id AS dialogue_id, 'd' || CAST(user_id % 5 AS VARCHAR) AS disease, event_id, ts,
         CASE WHEN value > 50 THEN 'repeat ' || event_type ELSE event_type END AS resp,
         props AS reason
  FROM events),
gl AS (SELECT disease, string_agg('-' || symptom, {NL} ORDER BY ord) AS gold_list FROM gold GROUP BY disease),
lw AS (SELECT disease, symptom, arg_min(weight, ord) AS weight FROM gold GROUP BY disease, symptom),
a AS (
  SELECT b.*, coalesce(contains(coalesce(gl.gold_list, ''), b.resp), false) AS hit, lw.weight
  FROM b LEFT JOIN gl ON gl.disease = b.disease
         LEFT JOIN lw ON lw.disease = b.disease AND lw.symptom = b.resp),
p AS (
  SELECT *, hit AND weight IS NULL AS poison,
         CASE WHEN hit THEN resp ELSE 'Not in Gold Label' END AS label,
         row_number() OVER (PARTITION BY dialogue_id ORDER BY ts, event_id) AS pos
  FROM a),
k AS (SELECT *, min(CASE WHEN poison THEN pos END) OVER (PARTITION BY dialogue_id) AS brk FROM p),
l AS (SELECT *, (brk IS NULL OR pos < brk) AS live FROM k),
s AS (
  SELECT *,
    coalesce(contains(
      string_agg(CASE WHEN live THEN '- ' || label || {NL} END, '')
        OVER (PARTITION BY dialogue_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      resp), false) AS seen_sub,
    count(*) OVER (PARTITION BY dialogue_id, label ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen_exact
  FROM l),
scored AS (
  SELECT dialogue_id, any_value(disease) AS disease, count(*) AS n_bullets,
    count(*) FILTER (WHERE live) AS n_live,
    max(CASE WHEN pos = brk THEN event_id END) AS break_event_id,
    CASE WHEN max(brk) IS NOT NULL THEN -1 ELSE count(*) FILTER (WHERE live AND hit) END AS score,
    CASE WHEN max(brk) IS NOT NULL THEN -1
         ELSE coalesce(sum(CASE WHEN live AND hit THEN (CASE WHEN weight = 'h' THEN 2 ELSE 1 END) END), 0) END
      AS weighted_score,
    coalesce(sum(CASE WHEN live AND hit THEN (CASE WHEN seen_sub THEN 0.5 ELSE 1.0 END) END), 0)::DOUBLE
      AS penalty_score,
    coalesce(sum(CASE WHEN live AND hit THEN (CASE WHEN seen_sub THEN 1.5 ELSE 1.0 END) END), 0)::DOUBLE
      AS reward_score,
    CASE WHEN max(brk) IS NOT NULL THEN 'match_error' ELSE 'clean' END AS status,
    coalesce(string_agg(CASE WHEN live THEN '- ' || label || {NL} END, '' ORDER BY pos), '') AS label_trace,
    coalesce(string_agg(CASE WHEN live THEN '- ' || reason || {NL} END, '' ORDER BY pos), '') AS reason_trace
  FROM s GROUP BY dialogue_id)
"""


# ------------------------------------------------------------------- D

_D_DISEASE = "'Brand#' || (o_custkey % 5 + 1)::VARCHAR || ((o_custkey // 5) % 6 + 1)::VARCHAR"
_D_FIRST, _D_REST = "split_part(p_type, ' ', 1)", "substr(p_type, instr(p_type, ' ') + 1)"
D_GOLD = f"""gold AS (SELECT p_brand AS disease, p_partkey AS ord, CASE p_size % 5 WHEN 0 THEN {_D_FIRST} || {NL} || '- ' || {_D_REST} WHEN 1 THEN {_D_FIRST} || {NL} || {_D_REST}
  WHEN 2 THEN {_D_FIRST} WHEN 3 THEN {_D_REST} ELSE p_type END AS symptom, CASE WHEN p_size > 25 THEN 'h' ELSE 'm' END AS weight FROM part)"""
_D_B = f"""
b AS (
  SELECT o_custkey AS dialogue_id, {_D_DISEASE} AS disease, o_orderkey AS event_id, o_orderkey AS ts, o_orderpriority AS reason,
         CASE WHEN o_orderkey % 97 = 0 THEN substr(symptom, 2, 100) WHEN o_orderkey % 11 = 0 THEN 'Not there' ELSE coalesce(symptom, '') END AS resp
  FROM orders LEFT JOIN gold ON gold.ord = (o_orderkey * 31) % (SELECT count(*) FROM part) + 1),
"""
# the same rules over these tables
D_BASE = D_GOLD + "," + _D_B + B1_BASE[B1_BASE.index("gl AS ("):]


def _d(select: str) -> str:
    return f"WITH {D_BASE} {select}"


def _b1(select: str) -> str:
    return f"WITH {B1_BASE} {select}"


ORACLE["bullet_scoring"] = _b1(
    "SELECT dialogue_id, disease, n_bullets, n_live, break_event_id, score::BIGINT AS score, "
    "weighted_score::BIGINT AS weighted_score, round(penalty_score, 6) AS penalty_score, "
    "round(reward_score, 6) AS reward_score, status, label_trace, reason_trace FROM scored")
ORACLE["score_plain"] = _b1("SELECT dialogue_id, score::BIGINT AS score FROM scored")
ORACLE["score_weighted"] = _b1("SELECT dialogue_id, weighted_score::BIGINT AS weighted_score FROM scored")
ORACLE["score_penalty"] = _b1("SELECT dialogue_id, round(penalty_score, 6) AS penalty_score FROM scored")
ORACLE["score_reward"] = _b1("SELECT dialogue_id, round(reward_score, 6) AS reward_score FROM scored")
ORACLE["poison_break"] = _b1("SELECT dialogue_id, break_event_id, n_live FROM scored")
ORACLE["label_trace"] = _b1("SELECT dialogue_id, label_trace FROM scored")
ORACLE["reason_trace"] = _b1("SELECT dialogue_id, reason_trace FROM scored")
ORACLE["trace_rows"] = _b1("SELECT dialogue_id, event_id, label, reason FROM s WHERE live")
ORACLE["gold_contains"] = _d("SELECT event_id, dialogue_id, resp, hit FROM a")
ORACLE["label_weight"] = _d("SELECT event_id, resp, weight FROM a")
ORACLE["join_gold"] = f"""WITH {D_GOLD},
d AS (SELECT DISTINCT o_custkey AS dialogue_id, {_D_DISEASE} AS disease FROM orders)
SELECT d.dialogue_id, d.disease, g.ord::BIGINT AS ord, g.symptom, g.weight
FROM d LEFT JOIN gold g ON g.disease = d.disease"""
ORACLE["score_lines"] = _d("SELECT dialogue_id, n_bullets, n_live, score::BIGINT AS score, weighted_score::BIGINT AS weighted_score, round(penalty_score, 6) AS penalty_score, "
                           "round(reward_score, 6) AS reward_score, label_trace, status FROM scored")
ORACLE["seen_before"] = _b1(
    "SELECT event_id, dialogue_id, label, live, (live AND hit AND seen_sub) AS seen FROM s")
ORACLE["seen_before_exact"] = _b1(
    "SELECT event_id, dialogue_id, label, live, (live AND hit AND seen_exact) AS seen FROM s")
ORACLE["gold_list_text"] = f"""WITH {D_GOLD},
gl AS (SELECT disease, string_agg('-' || symptom, {NL} ORDER BY ord) AS gold_list FROM gold GROUP BY disease),
d AS (SELECT DISTINCT o_custkey AS dialogue_id, {_D_DISEASE} AS disease FROM orders)
SELECT d.dialogue_id, d.disease, gl.gold_list FROM d LEFT JOIN gl ON gl.disease = d.disease"""
ORACLE["first_label"] = _b1(
    "SELECT dialogue_id, label, arg_min(event_id, pos) AS first_event_id, count(*) AS n_rows "
    "FROM p GROUP BY dialogue_id, label")

# ------------------------------------------------------------------ B3

B3_BASE = """
r0 AS (
  SELECT d.source AS model, CAST(d.doc_id % 4 + 2 AS BIGINT) AS turn, d.doc_id AS pid, d.lang,
         l.quality, l.toxic, d.n_chars,
         CASE d.doc_id % 5 WHEN 0 THEN 'QA format Error.' WHEN 1 THEN 'Early Stop Error.'
              WHEN 2 THEN 'Error' WHEN 3 THEN NULL ELSE '- ' || d.lang END AS organized_QA,
         CAST(CASE WHEN d.doc_id % 5 < 3 THEN -1 ELSE d.n_chars % 7 - 1 END AS BIGINT) AS score,
         CASE WHEN d.doc_id % 5 < 3 THEN -1.0 ELSE (d.n_chars % 11) / 2.0 END::DOUBLE AS penalty_score,
         CASE WHEN d.doc_id % 5 < 3 THEN -1.0 ELSE (d.n_chars % 13) / 2.0 + 1 END::DOUBLE AS reward_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
r AS (
  SELECT *,
    CAST(CASE WHEN score = -1 THEN -1 ELSE score + (n_chars % 2) * score END AS BIGINT) AS weighted_score,
    CASE WHEN score = -1 THEN false ELSE quality = 1 END AS top1_result,
    CASE WHEN score = -1 THEN false ELSE quality = 1 OR toxic = 1 END AS topk_result,
    score IS DISTINCT FROM -1 AS clean
  FROM r0)
"""

_SCORES = ["score", "weighted_score", "penalty_score", "reward_score"]


def _stats(c: str, describe: bool = False) -> str:
    x = f"CASE WHEN clean THEN {c}::DOUBLE END"
    s = (f"round(avg({x}), 6) AS {c}_mean, round(quantile_cont({x}, 0.5), 6) AS {c}_median, "
         f"round(stddev_samp({x}), 6) AS {c}_std")
    if describe:
        s += (f", count({x}) AS {c}_count, min({x}) AS {c}_min, round(quantile_cont({x}, 0.25), 6) AS {c}_p25, "
              f"round(quantile_cont({x}, 0.75), 6) AS {c}_p75, max({x}) AS {c}_max")
    return s


_RATES = ("round(count(*) FILTER (WHERE clean AND top1_result IS NOT DISTINCT FROM true)::DOUBLE "
          "/ nullif(count(*) FILTER (WHERE clean), 0), 6) AS top1_accuracy, "
          "round(count(*) FILTER (WHERE clean AND topk_result IS NOT DISTINCT FROM true)::DOUBLE "
          "/ nullif(count(*) FILTER (WHERE clean), 0), 6) AS topk_accuracy")

_FLAGS = """
    clean,
    coalesce(organized_QA = 'Early Stop Error.', false) AS early_stop,
    coalesce(organized_QA = 'QA format Error.', false) AS format_error,
    NOT coalesce(contains(organized_QA, 'Error'), false) AND coalesce(score = -1, false) AS matching_error
"""

_COUNTS = ("count(*) FILTER (WHERE clean) AS clean_len, count(*) FILTER (WHERE early_stop) AS early_stop_len, "
           "count(*) FILTER (WHERE format_error) AS format_error_len, "
           "count(*) FILTER (WHERE matching_error) AS matching_error_len, "
           "count(*) FILTER (WHERE NOT (clean OR early_stop OR format_error OR matching_error)) AS other_error_len, "
           "count(*) AS total_len")

B3_FLAGGED = B3_BASE + f", f AS (SELECT *, {_FLAGS.replace(chr(10) + '    clean,', '')} FROM r)"


def _b3(select: str) -> str:
    return f"WITH {B3_FLAGGED} {select}"


ORACLE["score_stats"] = _b3(
    "SELECT model, turn, " + ", ".join(_stats(c) for c in _SCORES) + " FROM f GROUP BY model, turn")
ORACLE["score_describe"] = _b3("""
SELECT model, turn, metric, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
       round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
FROM (SELECT model, turn, 'score' AS metric, score::DOUBLE AS v FROM f WHERE clean
      UNION ALL SELECT model, turn, 'weighted_score', weighted_score::DOUBLE FROM f WHERE clean
      UNION ALL SELECT model, turn, 'penalty_score', penalty_score FROM f WHERE clean
      UNION ALL SELECT model, turn, 'reward_score', reward_score FROM f WHERE clean)
GROUP BY model, turn, metric""")
ORACLE["accuracy_rates"] = _b3(f"SELECT model, turn, {_RATES} FROM f GROUP BY model, turn")
ORACLE["error_counts"] = _b3(f"SELECT model, turn, {_COUNTS} FROM f GROUP BY model, turn")
ORACLE["run_leaderboard"] = _b3(
    "SELECT model, turn, " + ", ".join(_stats(c) for c in _SCORES) + f", {_RATES}, {_COUNTS} "
    "FROM f GROUP BY model, turn")


def _metric_rows() -> str:
    names = [(f"{c}.{n}", f"{c}_{k}") for c in _SCORES for n, k in (
        ("mean", "mean"), ("median", "median"), ("std_dev", "std"), ("describe.count", "count"), ("describe.min", "min"),
        ("describe.25%", "p25"), ("describe.75%", "p75"), ("describe.max", "max"))]
    names += [(n, n) for n in ("top1_accuracy", "topk_accuracy", "clean_len", "early_stop_len", "format_error_len",
                               "matching_error_len", "other_error_len")]
    return " UNION ALL ".join(f"SELECT model, turn, '{n}' AS name, round({c}::DOUBLE, 6) AS value FROM w" for n, c in names)


ORACLE["metrics_json"] = (f"WITH {B3_FLAGGED}, w AS (SELECT model, turn, " + ", ".join(_stats(c, True) for c in _SCORES)
                          + f", {_RATES}, {_COUNTS} FROM f GROUP BY model, turn) {_metric_rows()}")
ORACLE["status_taxonomy"] = _b3("""
SELECT pid, model, turn,
  CASE WHEN clean THEN 'clean' WHEN early_stop THEN 'early_stop' WHEN format_error THEN 'format_error'
       WHEN matching_error THEN 'matching_error' ELSE 'other_error' END AS status
FROM f""")
ORACLE["clean_rows"] = _b3("SELECT pid, model, turn, score, weighted_score FROM f WHERE clean")
ORACLE["error_guard"] = _b3("""
SELECT pid, coalesce(contains(organized_QA, 'Error'), true) AS guarded,
  CASE WHEN coalesce(contains(organized_QA, 'Error'), true) THEN -1 ELSE score END::BIGINT AS score,
  CASE WHEN coalesce(contains(organized_QA, 'Error'), true) THEN 'Error.' END AS referred_gold_label
FROM f""")
ORACLE["sentinel_default"] = _b3("""
SELECT pid, CASE WHEN score = -1 THEN NULL ELSE lang || '-disease' END AS model_predictions,
  CASE WHEN score = -1 THEN false ELSE topk_result END AS topk_result,
  CASE WHEN score = -1 THEN false ELSE top1_result END AS top1_result,
  CAST(CASE WHEN score = -1 THEN 0 ELSE 3 END AS BIGINT) AS n_calls
FROM f""")

# ------------------------------------------------------------------ B2

BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '\\A{BLANK}+|{BLANK}+\\z', '', 'g')"


T2 = B.B2_TURNS
SEP = "chr(30)"
B2_CUT = f"""
cut AS (
  SELECT conv_id, count(*) AS n_items, string_agg(text, {SEP} ORDER BY turn) AS qa_text,
    max(CASE WHEN turn = 0 THEN text END) AS head,
    coalesce(string_agg(CASE WHEN turn BETWEEN 1 AND {2 * T2} THEN text END, {SEP} ORDER BY turn), '') AS body_text,
    coalesce(string_agg(CASE WHEN turn BETWEEN 1 AND {2 * T2} THEN text END, {NL} ORDER BY turn), '') AS body_nl,
    coalesce(string_agg(CASE WHEN turn BETWEEN 1 AND {2 * T2} THEN text END, '' ORDER BY turn), '') AS body_cat,
    count(*) FILTER (WHERE turn BETWEEN 1 AND {2 * T2}) AS n_body,
    string_agg(replace(text, {NL} || {NL}, {NL}), {NL} || {NL} ORDER BY turn) AS history
  FROM conversations WHERE turn < {2 * T2 + 1} GROUP BY conv_id),
v AS (
  SELECT *, (length(body_cat) - length(replace(body_cat, '{B.B2_MARKER}', ''))) // {len(B.B2_MARKER)} AS n_marker,
    {strip_sql("'Main Symptom: ' || head || " + NL + " || " + NL + " || body_nl")} AS rendered
  FROM cut),
vs AS (
  SELECT *, CASE WHEN n_marker > {T2} THEN 'QA format Error.' WHEN n_marker < {T2} THEN 'Early Stop Error.'
                 WHEN n_body < {2 * T2} THEN 'Error' ELSE 'valid' END AS status
  FROM v)
"""


def _b2(select: str) -> str:
    return f"WITH {B2_CUT} {select}"


ORACLE["assemble_dialogue"] = (f"SELECT conv_id, count(*) AS n_items, string_agg(text, {SEP} ORDER BY turn) AS qa_text "
                               "FROM conversations GROUP BY conv_id")
ORACLE["cut_run"] = (f"SELECT o_orderkey, turn, least(n, turn * 2 + 1)::BIGINT AS n_items FROM (SELECT o_orderkey, "
                     f"CASE WHEN o_orderkey % 9 = 2 THEN 3 WHEN o_orderkey % 9 > 2 AND o_orderkey % 2 = 0 THEN 7 ELSE 5 END AS n FROM orders), "
                     f"(SELECT unnest([{B.C_TURNS}, 9])::BIGINT AS turn)")
ORACLE["cut_turns"] = _b2("SELECT conv_id, n_items, qa_text FROM cut")
ORACLE["split_head_body"] = _b2("SELECT conv_id, head, body_text, n_body FROM cut")
ORACLE["render_dialogue"] = _b2(
    f"SELECT conv_id, CASE WHEN n_body >= {2 * T2} THEN rendered END AS dialogue_text FROM v")
ORACLE["render_history"] = _b2("SELECT conv_id, history FROM cut")


def _chat(mode: str, template: str) -> str:
    user_parity = 0 if mode == "doctor" else 1
    sys_content = "replace(" + _q(template).replace("\n", "' || chr(10) || '") + \
        ", '{patient_information}', 'conversation ' || CAST(conv_id AS VARCHAR))"
    return (f"SELECT DISTINCT conv_id, '{mode}' AS mode, CAST(0 AS BIGINT) AS msg_idx, 'system' AS role, "
            f"{sys_content} AS content FROM conversations "
            f"UNION ALL SELECT conv_id, '{mode}', CAST(turn + 1 AS BIGINT), "
            f"CASE WHEN turn % 2 = {user_parity} THEN 'user' ELSE 'assistant' END, text FROM conversations")


def _chat_all() -> str:
    return _chat("doctor", B.DOCTOR_SYSTEM) + " UNION ALL " + _chat("patient", B.PATIENT_SYSTEM)


ORACLE["validate_turns"] = _b2("SELECT conv_id, n_marker::BIGINT AS n_marker, status FROM vs")
ORACLE["count_marker"] = (f"SELECT conv_id, turn, ((length(text) - length(replace(text, '{B.B2_MARKER}', ''))) "
                          f"// {len(B.B2_MARKER)})::BIGINT AS n_marker FROM conversations")


def _emit() -> str:
    tpl = _q(B.ORGANIZER_TEMPLATE).replace("\n", "' || chr(10) || '")
    org_prompt = f"replace(replace({tpl}, '{{input}}', rendered), '{{disease}}', 'd' || CAST(conv_id % 5 AS VARCHAR))"
    rid = ("sha256('{stage}|13:conversations|1:" + str(T2) + "|' || length(CAST(conv_id AS VARCHAR)) || ':' "
           "|| CAST(conv_id AS VARCHAR) || '|1:0')")
    pred_prompt = ("'patient_info: ' || chr(10) || 'conversation ' || CAST(conv_id AS VARCHAR) || chr(10) || chr(10) "
                   "|| 'medical_history: ' || chr(10) || history")
    return _b2(f"SELECT {rid.format(stage='organize')} AS request_id, 'organize' AS stage, conv_id, "
               f"'You are a helpful assistant.' AS system, {org_prompt} AS prompt FROM vs WHERE status = 'valid' "
               f"UNION ALL SELECT {rid.format(stage='predict')}, 'predict', conv_id, 'You are a helpful assistant.', "
               f"{pred_prompt} FROM vs WHERE status = 'valid'")


ORACLE["chat_messages"] = _chat_all()
ORACLE["emit_requests"] = _emit()

# ------------------------------------------------------------------ B5

from colloquy.functions.scrub import scrub_sql  # noqa: E402


def _lit(s: str) -> str:
    """SQL literal for any text (newlines and other controls via chr())."""
    parts, cur = [], ""
    for ch in s:
        if ch == "\n" or (ord(ch) < 32) or ch in " 　 ":
            if cur:
                parts.append(_q(cur))
                cur = ""
            parts.append(f"chr({ord(ch)})")
        else:
            cur += ch
    if cur or not parts:
        parts.append(_q(cur))
    return "(" + " || ".join(parts) + ")"


B5_REPLIES = f"""
docs AS (
  SELECT doc_id, text, lang, source, n_chars,
    CASE doc_id % 5
      WHEN 0 THEN 'Reason: ' || text || {NL} || 'Final Response: **' || lang || '**'
      WHEN 1 THEN text
      WHEN 2 THEN 'Final Response:'
      WHEN 3 THEN 'Reason: Reason: ' || source || ' Final Response: ' || lang || ' Final Response: ' || source
      ELSE 'Reason: ' || text || {NL} || 'Final Response: ** ' || source || ' **' END AS verdict,
    CASE doc_id % 7
      WHEN 0 THEN 'Sure.' || {NL} || '```yaml' || {NL} || 'Diseases:' || {NL} || '  - ' || lang || {NL} || '  - '
                  || source || {NL} || '```' || {NL} || text
      WHEN 1 THEN 'Diseases:' || {NL} || '  - ' || source
      WHEN 2 THEN '```yaml' || {NL} || 'Diseases: [' || lang || ', ''a b'', "Crohn''s"]' || {NL} || 'Notes:' || {NL} || '- none' || {NL} || '```'
      WHEN 3 THEN 'x' WHEN 4 THEN 'x' WHEN 5 THEN 'x'
      ELSE text END AS predictor
  FROM documents),
vr AS (SELECT doc_id, {strip_sql("replace(verdict, 'Reason:', '')")} AS r FROM docs),
vi AS (SELECT doc_id, r, strpos(r, 'Final Response:') AS i FROM vr),
fb AS (SELECT doc_id,
    CASE WHEN contains(predictor, '```yaml') THEN split_part(split_part(predictor, '```yaml', 2), '```', 1)
         ELSE predictor END AS pblock
  FROM docs),
-- what a reader of each reply would list; whole texts (6) hold no list
pr AS (SELECT doc_id, CASE doc_id % 7
    WHEN 0 THEN [lang, source] WHEN 1 THEN [source] WHEN 2 THEN [lang, 'a b', 'Crohn''s'] WHEN 3 THEN [source, 'Crohn''s'] END AS p
  FROM documents)
"""


def _b5(select: str) -> str:
    return f"WITH {B5_REPLIES} {select}"


ORACLE["parse_verdict"] = _b5(f"""
SELECT doc_id,
  translate({strip_sql("CASE WHEN i > 0 THEN substring(r, 1, i - 1) WHEN length(r) = 0 THEN '' "
                       "ELSE substring(r, 1, length(r) - 1) END")}, {NL} || '-', '') AS reason,
  replace({strip_sql("CASE WHEN i > 0 THEN substring(r, i + 15) ELSE substring(r, 15) END")}, '*', '') AS answer,
  i > 0 AS marker_found
FROM vi""")
ORACLE["clean_verdict"] = (f"SELECT doc_id, translate({strip_sql('text')}, {NL} || '-', '') AS no_breaks, "
                           f"replace({strip_sql('text')}, '*', '') AS no_stars FROM documents")
ORACLE["fenced_block"] = _b5(f"""
SELECT doc_id, CASE doc_id % 7
    WHEN 3 THEN 'Diseases:' || {NL} || '- "' || source || '"' || {NL} || '- Crohn''s' || {NL} || {NL} || 'Notes:' || {NL} || '- not one' || {NL}
    WHEN 4 THEN 'Diseases:' || {NL} || 'Notes:' || {NL} || '- not one'
    WHEN 5 THEN '  Diseases:' || {NL} || '  - ' || source ELSE pblock END AS block
FROM fb JOIN documents USING (doc_id)""")
ORACLE["parse_predictions"] = _b5(
    "SELECT doc_id, len(p)::BIGINT AS n_predictions, array_to_string(p, '|') AS predictions FROM pr")
ORACLE["top1_slice"] = _b5("""
SELECT doc_id, p[1] AS top1, CASE WHEN p IS NULL THEN NULL ELSE '[''' || p[1] || ''']' END AS top1_text,
  CASE WHEN p IS NULL THEN 'prediction_parse_error' ELSE 'ok' END AS status
FROM pr""")
# what a reader of each judge reply would note down
ORACLE["parse_judgement"] = f"""
SELECT doc_id,
  CASE doc_id % 8 WHEN 0 THEN source || ' matches' WHEN 1 THEN 'no match' WHEN 2 THEN lang
       WHEN 3 THEN source || ' fits' || {NL} || '  well' || {NL} || 'Result: False' WHEN 4 THEN source || ' fits'
       WHEN 6 THEN 'it goes on' END AS reasoning,
  CASE doc_id % 8 WHEN 0 THEN 'True' WHEN 1 THEN CASE WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'True/False' END
       WHEN 2 THEN 'False' WHEN 3 THEN 'True' WHEN 4 THEN 'no' WHEN 6 THEN '"True"' END AS result_text,
  CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN CASE WHEN n_chars % 2 = 0 THEN true END WHEN 2 THEN false
       WHEN 3 THEN true WHEN 4 THEN false END AS result,
  CASE WHEN doc_id % 8 IN (5, 7) THEN 'judge_parse_error' ELSE 'ok' END AS status
FROM documents"""
_PADDED = f"{_lit(B.B5_STRIP_PAD_LEFT)} || text || {_lit(B.B5_STRIP_PAD_RIGHT)}"
ORACLE["strip_unicode"] = (f"SELECT doc_id, {strip_sql(_PADDED)} AS stripped, "
                           f"length({strip_sql(_PADDED)})::BIGINT AS n_stripped FROM documents")
ORACLE["fill_template"] = (f"SELECT doc_id, replace(replace({_lit(B.B5_TEMPLATE)}, '{{input}}', text), "
                           f"'{{disease}}', lang) AS prompt FROM documents")
_SCRUB_RESP = _lit("- 체중 변화는 없다.\n- 두통이 없다.\n- 기침은 없다.\n") + " || text || " + \
    _lit("\n- 발열은 없다.\n- 피로감이 없다.\n")
_SCRUB_CTX = "(CASE WHEN doc_id % 3 = 0 THEN text || ' 두통 피곤' ELSE text END)"
ORACLE["scrub_negations"] = f"SELECT doc_id, {scrub_sql(_SCRUB_RESP, _SCRUB_CTX)} AS scrubbed FROM documents"
ORACLE["explode_bullets"] = (f"SELECT doc_id, (i - 1)::BIGINT AS pos, {strip_sql('parts[i]')} AS bullet "
                             f"FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM documents), "
                             f"LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)")
ORACLE["route_requests"] = f"""
SELECT doc_id, model, n_messages,
  CASE WHEN n_messages % 2 = 0 THEN
    CASE WHEN contains(model, 'gpt') OR contains(model, 'mini') OR contains(model, 'o1') THEN 'openai'
         WHEN contains(model, 'claude') OR contains(model, 'haiku') THEN 'anthropic'
         WHEN contains(model, '/') THEN 'local' ELSE 'unsupported' END
  ELSE 'openai' END AS provider,
  CASE WHEN n_messages % 2 = 0 THEN model ELSE 'gpt-4o-mini' END AS target_model
FROM (SELECT doc_id,
        CASE doc_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'claude-3-haiku'
             WHEN 2 THEN 'org/' || lang || '-model' ELSE 'llama-' || source END AS model,
        (len(string_split(text, {NL})) + 1)::BIGINT AS n_messages
      FROM documents)"""
ORACLE["batch_ids"] = (f"SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) "
                       f"// {B.B5_BATCH})::BIGINT AS batch_id FROM documents")

# ------------------------------------------------------------------ B4

PROFILES = """
prof AS (
  SELECT printf('%08d', c.c_custkey) AS pid, c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment, n.n_name, r.r_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
res AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS total_qty FROM lineitem GROUP BY l_orderkey)
"""


def _b4(select: str) -> str:
    return f"WITH {PROFILES} {select}"


ORACLE["join_profile"] = _b4("SELECT o.o_orderkey, p.pid, p.c_name, p.n_name, p.r_name "
                             "FROM orders o LEFT JOIN (SELECT * FROM prof WHERE c_acctbal >= 0) p ON printf('%08d', o.o_custkey) = p.pid")
ORACLE["unmatched_profiles"] = _b4(
    "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS "
    "(SELECT 1 FROM prof p WHERE p.c_acctbal >= 0 AND p.pid = printf('%08d', o.o_custkey))")
ORACLE["pad_key"] = "SELECT c_custkey, printf('%08d', c_custkey) AS pid FROM customer"
ORACLE["dedup_last"] = ("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER "
                        "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) "
                        "WHERE rn = 1")
ORACLE["attach_results"] = _b4("SELECT o.o_orderkey, o.o_custkey, res.n_lines, res.total_qty "
                               "FROM orders o LEFT JOIN res ON res.l_orderkey = o.o_orderkey")
ORACLE["join_responses"] = _b4(
    "SELECT sha256('diagnose|' || length(CAST(o.o_orderkey AS VARCHAR)) || ':' || CAST(o.o_orderkey AS VARCHAR)) AS request_id, o.o_orderkey, "
    "'lines=' || CAST(res.n_lines AS VARCHAR) AS response FROM orders o JOIN res ON res.l_orderkey = o.o_orderkey")
ORACLE["missing_results"] = _b4(
    "SELECT o.o_orderkey, coalesce('lines=' || CAST(res.n_lines AS VARCHAR), 'Error') AS response, "
    "res.n_lines IS NULL AS missing FROM orders o LEFT JOIN res ON res.l_orderkey = o.o_orderkey")
ORACLE["pending_rows"] = ("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS "
                          "(SELECT 1 FROM lineitem l WHERE l.l_linestatus = 'F' AND l.l_orderkey = o.o_orderkey)")
ORACLE["resume_batch"] = _b4("SELECT o.o_orderkey, o.o_orderstatus, res.n_lines "
                             "FROM orders o LEFT JOIN res ON res.l_orderkey = o.o_orderkey")
ORACLE["union_runs"] = ("SELECT CASE WHEN o_orderstatus IS NOT DISTINCT FROM 'F' THEN 'finished' ELSE 'open' END "
                        "AS run, o_orderkey, o_custkey FROM orders")
ORACLE["ordered_export"] = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders"
ORACLE["project_core"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
ORACLE["append_rows"] = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"
ORACLE["stage_write"] = "SELECT o_orderkey, o_orderpriority FROM orders"

# ---------------------------------------------------------- profile maps

_PKEY = "CASE WHEN user_id % 2 = 0 THEN '주증상' ELSE 'Chief Complaint' END"
_K = "json_extract_string(props, '$.k')"
_PTEXT = (f"'pid: ' || CAST(event_id AS VARCHAR) || {NL} || {_PKEY} || ': ' || event_type || {NL} || 'Hx: ' "
          f"|| event_type || ', ' || {_K} || {NL} || 'Age: ' || {_K} || {NL} || 'token: t' || CAST(user_id AS VARCHAR)")
ORACLE["render_profile"] = (f"SELECT event_id, {_PTEXT} AS profile_text, {_PTEXT} || {NL} AS profile_text_nl "
                            "FROM events")
ORACLE["profile_text"] = (f"SELECT event_id, '{{\"' || {_PKEY} || '\": \"' || event_type || '\", \"Hx\": [\"' || event_type || '\",\"' || {_K} "
                          f"|| '\"], \"Age\": \"' || {_K} || '\"}}' AS profile_text FROM events")
ORACLE["chief_complaint"] = "SELECT event_id, event_type AS chief_complaint FROM events"
ORACLE["profile_drop_keys"] = (f"SELECT event_id, {_PKEY} || ',Hx,Age' AS keys_csv, CAST(3 AS BIGINT) AS n_keys "
                               "FROM events")
ORACLE["parse_list_cell"] = ("SELECT event_id, CAST(3 AS BIGINT) AS n_items, CASE WHEN event_id % 4 = 0 THEN event_type || 'A' || chr(7) || '|it''s' "
                             "|| chr(11) || '|u' || CAST(user_id AS VARCHAR) || chr(128512) || 'A' "
                             "ELSE event_type || '|' || props || '|u' || CAST(user_id AS VARCHAR) || chr(9) || 'x' END AS items FROM events")

# ------------------------------------------------- staged files and streams

ORACLE["scan_dialogues"] = (f"SELECT conv_id, 'd' || CAST(conv_id % 5 AS VARCHAR) AS disease, count(*) AS n_items, "
                            f"string_agg(text, {SEP} ORDER BY turn) AS qa_text FROM conversations GROUP BY conv_id")
ORACLE["scan_gold"] = ("SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS ord, p_brand AS disease, "
                       "p_name AS symptom, CASE WHEN p_size > 25 THEN 'h' ELSE 'm' END AS weight FROM part")
ORACLE["scan_profiles"] = _b4("SELECT pid, n_name AS disease_name, CAST(3 AS BIGINT) AS n_info, "
                              "c_mktsegment AS chief_complaint, 'Chief Complaint,Region,Name' AS keys_csv FROM prof")
ORACLE["scan_runs"] = _b3("SELECT model, turn, pid, organized_QA, score, CAST(top1_result AS VARCHAR) AS top1_result "
                          "FROM f")
ORACLE["run_identity"] = _b3("SELECT model, turn, count(*) AS n_rows FROM f GROUP BY model, turn")
ORACLE["resume_stream"] = ORACLE["validate_turns"]
ORACLE["apply_model"] = ("SELECT sha256('echo|' || length(conv_id::VARCHAR) || ':' || conv_id::VARCHAR || '|' || length(turn::VARCHAR) || ':' || turn::VARCHAR) "
                         "AS request_id, 'ok:' || sha256(text) AS response, CAST(NULL AS VARCHAR) AS error, "
                         "CAST(1 AS BIGINT) AS attempts FROM conversations")
ORACLE["apply_model_errors"] = (
    "SELECT sha256('echo|' || length(conv_id::VARCHAR) || ':' || conv_id::VARCHAR || '|' || length(turn::VARCHAR) || ':' || turn::VARCHAR) AS request_id, "
    "CASE WHEN length(text) % 7 = 0 THEN NULL ELSE 'ok:' || sha256(text) END AS response, "
    "CASE WHEN length(text) % 7 = 0 THEN 'ValueError: refused' END AS error, "
    "CAST(CASE WHEN length(text) % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts FROM conversations")

ORACLE["call_model"] = ORACLE["apply_model"]
ORACLE["reply_ledger"] = (
    "SELECT sha256('echo|' || length(conv_id::VARCHAR) || ':' || conv_id::VARCHAR || '|' || length(turn::VARCHAR) || ':' || turn::VARCHAR) AS request_id, "
    "'ok:' || sha256(text) AS response, CAST(NULL AS VARCHAR) AS error, "
    "CAST(CASE WHEN length(text) % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS attempts FROM conversations")
ORACLE["leaderboard_states"] = ORACLE["run_leaderboard"]
ORACLE["exact_quantiles"] = ("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {p / 100}), 6) AS p{p}" for p in (25, 50, 75))
                             + " FROM lineitem GROUP BY l_returnflag")

# --------------------------------------------------- C the whole evaluation
# The chain stated row by row: what each order's dialogue, statements and
# replies are, then the scoring rule over a running trace text.

C_BASE = f"""
g AS (SELECT p_brand AS disease, p_type AS symptom, min(p_partkey) AS ord,
    arg_min(CASE WHEN p_size > 25 THEN 'h' ELSE 'm' END, p_partkey) AS weight FROM part GROUP BY ALL),
gt AS (SELECT disease, string_agg('-' || symptom, {NL} ORDER BY ord) AS txt, min(symptom) AS lo, max(symptom) AS hi FROM g GROUP BY disease),
d AS (SELECT o_orderkey AS k, o_custkey AS cust, o_orderpriority AS prio, o_orderstatus AS st, 'Brand#' || (o_orderkey % 27 + 1) AS disease,
    CASE o_orderkey % 9 WHEN 0 THEN 'QA format Error.' WHEN 1 THEN 'Early Stop Error.' WHEN 2 THEN 'Error' ELSE
      CASE WHEN o_orderkey % 17 = 0 THEN 'Error' WHEN o_orderkey % 19 = 0 THEN 'Error in service'
           ELSE array_to_string(list_transform(range(0, o_orderkey % 4 + 1), lambda i: '- statement ' || i), {NL}) END END AS organized,
    CASE WHEN o_orderkey % 9 = 2 THEN 3 ELSE 5 END::BIGINT AS n_items
  FROM orders),
b0 AS (SELECT d.k, d.disease, i AS pos, (d.k * 7 + i) % 41 = 0 AS absent,
    CASE WHEN (d.k + i) % 6 = 2 THEN coalesce(hi, 'none') WHEN (d.k + i) % 6 = 3 THEN 'Not there'
         WHEN (d.k + i) % 6 = 5 AND d.k % 3 = 0 THEN substring(coalesce(lo, 'none'), 2) ELSE coalesce(lo, 'none') END AS said, coalesce(txt, '') AS txt
  FROM d LEFT JOIN gt USING (disease), LATERAL (SELECT unnest(range(0, d.k % 4 + 1)) AS i)
  WHERE NOT contains(organized, 'Error')),
b1 AS (SELECT b0.*, contains(txt, said) AS hit, g.weight FROM b0 LEFT JOIN g ON g.disease = b0.disease AND g.symptom = said),
b2 AS (SELECT *, min(CASE WHEN hit AND weight IS NULL THEN pos END) OVER (PARTITION BY k) AS brk, CASE WHEN hit THEN said ELSE 'Not in Gold Label' END AS label FROM b1),
b3 AS (SELECT *, brk IS NULL OR pos < brk AS live FROM b2),
b4 AS (SELECT *, coalesce(contains(string_agg(CASE WHEN live THEN '- ' || label || {NL} END, '') OVER (PARTITION BY k ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), said), false) AS seen FROM b3),
sc AS (SELECT k, bool_or(absent) AS absent, max(brk) IS NOT NULL AS bad, count(*) FILTER (WHERE live AND hit) AS hits,
    coalesce(sum(CASE WHEN live AND hit THEN CASE WHEN weight = 'h' THEN 2 ELSE 1 END END), 0) AS w,
    coalesce(sum(CASE WHEN live AND hit THEN CASE WHEN seen THEN 0.5 ELSE 1 END END), 0) AS pen,
    coalesce(sum(CASE WHEN live AND hit THEN CASE WHEN seen THEN 1.5 ELSE 1 END END), 0) AS rew,
    coalesce(string_agg(CASE WHEN live THEN '- ' || label || {NL} END, '' ORDER BY pos), '') AS labels,
    coalesce(string_agg(CASE WHEN live THEN '- r' || pos || {NL} END, '' ORDER BY pos), '') AS reasons FROM b4 GROUP BY k),
cmp AS (SELECT d.*, CASE WHEN contains(organized, 'Error') THEN 'organizer_error' WHEN absent THEN 'missing_reply' WHEN bad THEN 'match_error' ELSE 'ok' END AS cs,
    hits, w, pen, rew, labels, reasons FROM d LEFT JOIN sc USING (k)),
cmp2 AS (SELECT *, CASE cs WHEN 'organizer_error' THEN -1 WHEN 'match_error' THEN -1 WHEN 'ok' THEN hits END::BIGINT AS score,
    CASE cs WHEN 'organizer_error' THEN -1 WHEN 'match_error' THEN -1 WHEN 'ok' THEN w END::BIGINT AS weighted_score,
    CASE cs WHEN 'organizer_error' THEN -1 WHEN 'missing_reply' THEN NULL ELSE pen END::DOUBLE AS penalty_score,
    CASE cs WHEN 'organizer_error' THEN -1 WHEN 'missing_reply' THEN NULL ELSE rew END::DOUBLE AS reward_score,
    CASE cs WHEN 'organizer_error' THEN 'Error.' WHEN 'missing_reply' THEN NULL ELSE labels END AS referred_gold_label,
    CASE cs WHEN 'organizer_error' THEN 'Error.' WHEN 'missing_reply' THEN NULL ELSE reasons END AS why FROM cmp),
pq AS (SELECT k, disease, c.c_custkey IS NOT NULL AND k % 13 <> 0 AS has,
    'patient_info: ' || {NL} || 'Chief Complaint: ' || c_mktsegment || {NL} || 'Name: ' || c_name || {NL} || 'Hx: None' || {NL} || {NL} || 'medical_history: ' || {NL}
      || prio || {NL} || {NL} || 'Question: since ' || st || '?' || {NL} || {NL} || 'answer ' || cust || {NL} || {NL} || 'Question: how?' || {NL} || {NL} || 'badly' || {NL} || 'very' AS prompt
  FROM cmp2 LEFT JOIN customer c ON c.c_custkey = cust AND c.c_custkey % 7 <> 0 WHERE cs = 'ok'),
ps AS (SELECT *, CASE WHEN NOT has THEN 'no_profile' WHEN k % 8 = 3 THEN 'missing_prediction' WHEN k % 8 = 2 THEN 'prediction_parse_error' ELSE 'ok' END AS status,
    CASE k % 8 WHEN 0 THEN ['Asthma', 'Crohn''s'] WHEN 1 THEN ['Asthma', 'COPD'] ELSE [disease, 'Other'] END AS p,
    CASE k % 8 WHEN 0 THEN '[''Asthma'', "Crohn''s"]' WHEN 1 THEN '[''Asthma'', ''COPD'']' ELSE '[''' || disease || ''', ''Other'']' END AS shown FROM pq),
jq AS (SELECT k, n, stage, 'model_predictions: ' || {NL} || CASE n WHEN 0 THEN shown ELSE '[''' || p[1] || ''']' END || {NL} || 'golden_standard: ' || {NL} || disease AS prompt,
    (k + n) % 7 AS c FROM ps, (VALUES (0, 'judge_topk'), (1, 'judge_top1')) s(n, stage) WHERE status = 'ok'),
jr AS (SELECT *, CASE c WHEN 0 THEN 'fine match' || {NL} || 'Result: False' || {NL} || 'more' WHEN 1 THEN 'no' WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'plain goes on' ELSE 'ok' END AS reasoning,
    CASE c WHEN 1 THEN false WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE true END AS result FROM jq)
"""


def _c(select: str) -> str:
    return f"WITH {C_BASE} {select}"


ORACLE["stage_organize"] = _c("SELECT k AS o_orderkey, organized AS organized_QA, n_items FROM d")
ORACLE["stage_compare"] = _c("SELECT k AS o_orderkey, cs AS status, score, weighted_score, penalty_score, reward_score, referred_gold_label, why AS reasons FROM cmp2")
ORACLE["stage_predict"] = _c(
    f"SELECT k AS o_orderkey, CASE WHEN has THEN {_q(B.C_PREDICTOR_SYSTEM)} END AS system, CASE WHEN has THEN prompt END AS prompt, status, "
    "CASE WHEN status = 'ok' THEN array_to_string(p, '|') END AS predictions FROM ps")
ORACLE["stage_judge"] = _c(f"SELECT k AS o_orderkey, stage, {_q(B.C_JUDGE_SYSTEM)} AS system, prompt, reasoning, result FROM jr")
ORACLE["evaluate_run"] = _c("""
SELECT cmp2.k AS o_orderkey, CASE WHEN cs <> 'ok' THEN cs WHEN ps.status <> 'ok' THEN ps.status WHEN a.c = 2 OR b.c = 2 THEN 'missing_judgement'
    WHEN a.c = 3 OR b.c = 3 THEN 'judge_parse_error' ELSE 'ok' END AS status, score, weighted_score, penalty_score, reward_score,
  CASE WHEN ps.status = 'ok' THEN array_to_string(p, '|') END AS predictions,
  a.reasoning AS topk_reason, CASE WHEN score = -1 THEN false ELSE a.result END AS topk_result,
  b.reasoning AS top1_reason, CASE WHEN score = -1 THEN false ELSE b.result END AS top1_result
FROM cmp2 LEFT JOIN ps USING (k) LEFT JOIN (SELECT * FROM jr WHERE n = 0) a ON a.k = cmp2.k LEFT JOIN (SELECT * FROM jr WHERE n = 1) b ON b.k = cmp2.k""")
