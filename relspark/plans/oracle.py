"""DuckDB SQL oracles for the registered queries.

Each string is self-contained: the ``rel_*`` fixture views are spelled out as CTEs over the
driver tables (``documents labels nation region embeddings``), mirroring
:mod:`relspark.plans.fixtures`.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

# ASCII templates with the reference arity, used by the oracle-checked queries.
ASCII_TWO_SENTENCE = "How are {} and {} related?"
ASCII_HYPOTHESES = ("Is {}'s {} {}?", "Is {} the {} {}'s {}?")

REL_LABELS = """
rel_labels AS (
  SELECT CAST(n_nationkey AS INTEGER) AS label_id, concat(r_name, ':', n_name) AS label_name,
         string_split(concat(r_name, ':', n_name), ':')[1] AS subject_part,
         string_split(concat(r_name, ':', n_name), ':')[2] AS attribute_part
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

REL_EXAMPLES = """
b AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS sentence FROM documents),
t AS (SELECT doc_id, sentence,
        string_split(sentence, ' ')[1] AS a, string_split(sentence, ' ')[-1] AS z
      FROM b WHERE sentence <> ''),
rel_examples AS (
  SELECT t.doc_id AS example_id, sentence,
    CASE WHEN t.doc_id % 2 = 0 THEN a ELSE z END AS entity_01,
    CASE WHEN t.doc_id % 2 = 0 THEN z ELSE a END AS entity_02,
    CAST(CASE WHEN t.doc_id % 2 = 0 THEN 0 ELSE length(sentence) - length(z) END AS INTEGER) AS e1_s,
    CAST(CASE WHEN t.doc_id % 2 = 0 THEN length(a) - 1 ELSE length(sentence) - 1 END AS INTEGER) AS e1_e,
    CAST(CASE WHEN t.doc_id % 2 = 1 THEN 0 ELSE length(sentence) - length(z) END AS INTEGER) AS e2_s,
    CAST(CASE WHEN t.doc_id % 2 = 1 THEN length(a) - 1 ELSE length(sentence) - 1 END AS INTEGER) AS e2_e,
    CASE WHEN l.doc_id IS NULL THEN 'blind' ELSE concat(r_name, ':', n_name) END AS relation
  FROM t LEFT JOIN labels l ON t.doc_id = l.doc_id
  JOIN nation ON n_nationkey = t.doc_id % 25
  JOIN region ON n_regionkey = r_regionkey),
enc AS (
  SELECT e.*, CAST(CASE WHEN relation = 'blind' THEN 100 ELSE rl.label_id END AS INTEGER) AS label
  FROM rel_examples e LEFT JOIN rel_labels rl ON e.relation = rl.label_name)"""

REL_SCORES = """
rel_scores AS (
  SELECT vec_id AS example_id, 0 AS variant, CAST(m AS VARCHAR) AS model_id,
         list_transform(embedding[m * 16 + 1 : m * 16 + 16], lambda e: CAST(e AS DOUBLE)) AS scores
  FROM embeddings CROSS JOIN (VALUES (0), (1), (2), (3)) AS mm(m)),
rel_answers AS (SELECT vec_id AS example_id, CAST(label AS INTEGER) AS answer FROM embeddings),
sx AS (
  SELECT example_id, model_id, generate_subscripts(scores, 1) - 1 AS pos, unnest(scores) AS v
  FROM rel_scores),
sm AS (SELECT example_id, model_id, pos, v, max(v) OVER (PARTITION BY example_id, model_id) AS mx FROM sx),
soft AS (
  SELECT example_id, model_id, pos, v,
         exp(v - mx) / sum(exp(v - mx)) OVER (PARTITION BY example_id, model_id) AS p
  FROM sm)"""

REL_HYP = """
hs AS (
  SELECT vec_id AS example_id, CAST(v AS INTEGER) AS variant,
         list_transform(embedding[v * 2 + 1 : v * 2 + 2], lambda e: CAST(e AS DOUBLE)) AS scores
  FROM embeddings CROSS JOIN range(32) AS vv(v))"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


EX = _with(REL_LABELS, REL_EXAMPLES)
SC = _with(REL_SCORES)

# argmax decode of each model, and the four-model soft vote
ARGMAX_CTE = """,
am AS (SELECT example_id, variant, model_id,
              CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred FROM rel_scores)"""

ENSEMBLE_CTE = """,
ens_p AS (SELECT example_id, pos, avg(p) AS p FROM soft GROUP BY example_id, pos),
ens AS (SELECT example_id, CAST(pos AS INTEGER) AS pred FROM (
  SELECT example_id, pos, row_number() OVER (PARTITION BY example_id ORDER BY p DESC, pos) AS rn
  FROM ens_p) WHERE rn = 1)"""

TWO_SENTENCE_SQL = ASCII_TWO_SENTENCE.replace("{}", "%s")
HYP_FWD_SQL = ASCII_HYPOTHESES[0].replace("{}", "%s").replace("'", "''")
HYP_REV_SQL = ASCII_HYPOTHESES[1].replace("{}", "%s").replace("'", "''")

# tagger of the fixture: initial capital letter -> CAP, otherwise LOW
TAG_SQL = "CASE WHEN regexp_matches({e}, '^[A-Z]') THEN 'CAP' ELSE 'LOW' END"

MARK_SQL = """
  CASE WHEN e1_s = e2_s AND e1_e = 0 THEN '[E1]' || sentence || '[/E1][E2]' || sentence || '[/E2]'
  WHEN e1_s = e2_s THEN  -- a one-word sentence: both spans are the word
    '[E1]' || substr(sentence, 1, 1) || '[/E2]' || substr(sentence, 2, e1_e - 1) || '[E1]'
    || substr(sentence, e1_e + 1, 1) || '[/E2]'
  WHEN e1_s <= e2_s THEN
    substr(sentence, 1, e1_s) || '[E1]' || substr(sentence, e1_s + 1, e1_e - e1_s + 1) || '[/E1]'
    || substr(sentence, e1_e + 2, greatest(e2_s - e1_e - 1, 0)) || '[E2]'
    || substr(sentence, e2_s + 1, e2_e - e2_s + 1) || '[/E2]' || substr(sentence, e2_e + 2)
  ELSE
    substr(sentence, 1, e2_s) || '[E2]' || substr(sentence, e2_s + 1, e2_e - e2_s + 1) || '[/E2]'
    || substr(sentence, e2_e + 2, greatest(e1_s - e2_e - 1, 0)) || '[E1]'
    || substr(sentence, e1_s + 1, e1_e - e1_s + 1) || '[/E1]' || substr(sentence, e1_e + 2)
  END"""

ENCODE_PAIR_SQL = EX + """,
tk AS (
  SELECT example_id,
    list_filter(string_split_regex(entity_01 || '[SEP]' || entity_02, '\\s+'), lambda x: x <> '') AS ta,
    list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '') AS tb
  FROM enc),
ln AS (SELECT example_id, ta, tb, len(ta) AS la, len(tb) AS lb, 97 AS bud FROM tk),
cut AS (
  SELECT example_id, ta, tb, la, lb,
    greatest(la + lb - bud, 0) AS ov, abs(la - lb) AS d, least(la, lb) AS m FROM ln),
kp AS (
  SELECT example_id, ta, tb,
    CAST(CASE WHEN ov <= d THEN (CASE WHEN la > lb THEN la - ov ELSE la END)
         ELSE m - floor((ov - d) / 2) END AS INTEGER) AS n_a,
    CAST(CASE WHEN ov <= d THEN (CASE WHEN la > lb THEN lb ELSE lb - ov END)
         ELSE m - ceil((ov - d) / 2) END AS INTEGER) AS n_b
  FROM cut)
SELECT example_id, n_a, n_b, 100 AS n_tokens,
  array_to_string(list_concat(list_concat(list_concat(list_concat(['[CLS]'], ta[1:n_a]), ['[SEP]']),
    tb[1:n_b]), ['[SEP]']), ' ') || repeat(' [PAD]', CAST(97 - n_a - n_b AS BIGINT)) AS input_text,
  repeat('0', CAST(n_a + 2 AS BIGINT)) || repeat('1', CAST(n_b + 1 AS BIGINT)) || repeat('0', CAST(97 - n_a - n_b AS BIGINT)) AS segments,
  repeat('1', CAST(n_a + n_b + 3 AS BIGINT)) || repeat('0', CAST(97 - n_a - n_b AS BIGINT)) AS mask
FROM kp"""



def _linear(name: str, a: int, b: int) -> str:
    """Scores of a fixed dense 64x10 layer as a CTE."""
    return f"""{name} AS (
  SELECT vec_id AS example_id, list_transform(range(10), lambda j: list_sum(list_transform(range(64),
    lambda i: CAST(embedding[i + 1] AS DOUBLE) * ((i * {a} + j * {b}) % 11 - 5) / 8.0))) AS scores
  FROM embeddings)"""


_LINEAR_TOP = """
SELECT example_id, '{name}' AS model_id, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred,
  round(list_max(scores), 6) AS top_score FROM {name}"""

ORACLE: dict[str, str] = {
    # --- projections and label lookups ------------------------------------------------
    "project_examples": EX + "SELECT example_id, sentence, entity_01, entity_02, label FROM enc",
    "encode_label": EX + "SELECT example_id, relation, label FROM enc",
    "decode_label": EX
    + """SELECT e.example_id, e.label,
  CASE WHEN e.label = 100 THEN 'blind' ELSE rl.label_name END AS label_name
FROM enc e LEFT JOIN rel_labels rl ON e.label = rl.label_id""",
    "is_blind": EX + "SELECT example_id, relation, relation = 'blind' AS is_blind FROM rel_examples",
    "example_filter_none": EX + "SELECT example_id, label FROM enc WHERE label <> 0",
    "mark_entities": EX
    + "SELECT example_id, "
    + MARK_SQL
    + """ AS sentence, e1_s, e1_e, e2_s, e2_e, label,
  (e1_s <= e2_e AND e2_s <= e1_e) AS spans_overlap FROM enc""",
    # --- model-input builders ----------------------------------------------------------
    "pair_input": EX
    + """SELECT example_id, 0 AS variant, 'pair' AS style, entity_01 || '[SEP]' || entity_02 AS text,
  sentence AS text_pair, 100 AS max_length FROM enc""",
    "single_input": EX
    + """SELECT example_id, 0 AS variant, 'single' AS style, sentence AS text,
  CAST(NULL AS VARCHAR) AS text_pair, 150 AS max_length FROM enc""",
    "two_sentence_input": EX
    + f"""SELECT example_id, 0 AS variant, 'two_sentence' AS style, sentence AS text,
  printf('{TWO_SENTENCE_SQL}', entity_01, entity_02) AS text_pair, 150 AS max_length FROM enc
UNION ALL
SELECT example_id, 1, 'two_sentence', sentence,
  printf('{TWO_SENTENCE_SQL}', entity_02, entity_01), 150 FROM enc""",
    "tag_entities": EX
    + "SELECT example_id, entity_01, "
    + TAG_SQL.format(e="entity_01")
    + " AS tag_01, entity_02, "
    + TAG_SQL.format(e="entity_02")
    + " AS tag_02 FROM enc",
    "typed_pair_input": EX
    + "SELECT example_id, 0 AS variant, 'typed_pair' AS style, '[E1][E1-NER]' || "
    + TAG_SQL.format(e="entity_01")
    + " || '[E1-NER]' || entity_01 || '[E1][E2][E2-NER]' || "
    + TAG_SQL.format(e="entity_02")
    + " || '[E2-NER]' || entity_02 || '[E2]' AS text, sentence AS text_pair, 200 AS max_length FROM enc",
    "expand_hypotheses": EX
    + """SELECT e.example_id, CAST((rl.label_id - 1) * 2 + d.direction AS INTEGER) AS variant,
  rl.label_id, CAST(d.direction AS INTEGER) AS direction, rl.subject_part, rl.attribute_part
FROM enc e CROSS JOIN rel_labels rl CROSS JOIN (VALUES (0), (1)) AS d(direction)
WHERE rl.label_id <> 0""",
    "hypothesis_input": EX
    + f"""SELECT e.example_id, CAST((rl.label_id - 1) * 2 + d.direction AS INTEGER) AS variant,
  rl.label_id, CAST(d.direction AS INTEGER) AS direction, e.sentence AS text,
  CASE WHEN d.direction = 0
       THEN printf('{HYP_FWD_SQL}', e.entity_01, rl.attribute_part, e.entity_02)
       ELSE printf('{HYP_REV_SQL}', e.entity_02, rl.subject_part, e.entity_01, rl.attribute_part) END
    AS text_pair,
  200 AS max_length, CAST(e.label = rl.label_id AS INTEGER) AS target
FROM enc e CROSS JOIN rel_labels rl CROSS JOIN (VALUES (0), (1)) AS d(direction)
WHERE rl.label_id <> 0""",
    "encode_pair": ENCODE_PAIR_SQL,
    "first_example": EX
    + """SELECT example_id, entity_01 || '[SEP]' || entity_02 AS text, sentence AS text_pair
FROM enc ORDER BY example_id LIMIT 5""",
    # --- targets -----------------------------------------------------------------------
    "class_target": EX + "SELECT example_id, label AS target FROM enc",
    "variant_target": EX
    + """SELECT example_id, CAST(v AS INTEGER) AS variant, label AS target
FROM enc CROSS JOIN (VALUES (0), (1)) AS vv(v)""",
    "hypothesis_target": EX
    + """SELECT e.example_id, CAST((rl.label_id - 1) * 2 + d.direction AS INTEGER) AS variant,
  rl.label_id, CAST(e.label = rl.label_id AS INTEGER) AS target
FROM enc e CROSS JOIN rel_labels rl CROSS JOIN (VALUES (0), (1)) AS d(direction)
WHERE rl.label_id <> 0""",
    "soft_target": SC
    + """SELECT a.example_id, CAST(i AS INTEGER) AS pos,
  round(CASE WHEN a.answer = 0 THEN 1.0 / 16 WHEN i = a.answer - 1 THEN 1.0 ELSE 0.0 END, 6) AS value
FROM rel_answers a CROSS JOIN range(16) AS ii(i)""",
    "smoothed_target": SC
    + """SELECT a.example_id, CAST(i AS INTEGER) AS pos,
  round(0.5 / 16 + CASE WHEN i = a.answer THEN 0.5 ELSE 0.0 END, 6) AS value
FROM rel_answers a CROSS JOIN range(16) AS ii(i)""",
    # --- score math and decoders ---------------------------------------------------------
    "softmax": SC
    + "SELECT example_id, model_id, CAST(pos AS INTEGER) AS pos, round(p, 6) AS value FROM soft",
    "sigmoid": SC
    + """SELECT example_id, model_id, CAST(pos AS INTEGER) AS pos,
  round(1 / (1 + exp(-v)), 6) AS value FROM sx""",
    "argmax": SC
    + """SELECT example_id, model_id,
  CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS idx FROM rel_scores""",
    "argmax_decode": SC + ARGMAX_CTE + "\nSELECT * FROM am",
    "threshold_decode": SC
    + """SELECT example_id, variant, model_id,
  CAST(CASE WHEN 1 / (1 + exp(-list_max(scores))) < 0.55 THEN 0
       ELSE list_position(scores, list_max(scores)) END AS INTEGER) AS pred
FROM rel_scores""",
    "pair_soft_vote": """WITH pv AS (
  SELECT vec_id AS example_id, v, list_transform(embedding[v * 32 + 1 : v * 32 + 32], lambda e: CAST(e AS DOUBLE)) AS s
  FROM embeddings CROSS JOIN (VALUES (0), (1)) AS vv(v)),
px AS (SELECT example_id, v, generate_subscripts(s, 1) - 1 AS pos, exp(unnest(s)) AS e FROM pv),
ps AS (SELECT example_id, pos, e / sum(e) OVER (PARTITION BY example_id, v) AS p FROM px),
pp AS (SELECT example_id, pos, avg(p) AS p FROM ps GROUP BY example_id, pos)
SELECT example_id, 'pair' AS model_id, CAST(pos AS INTEGER) AS pred FROM (
  SELECT example_id, pos, row_number() OVER (PARTITION BY example_id ORDER BY p DESC, pos) AS rn
  FROM pp) WHERE rn = 1""",
    "ensemble_soft_vote": SC + ENSEMBLE_CTE
    + "\nSELECT example_id, pred FROM ens",
    "hard_vote": SC
    + ARGMAX_CTE
    + """,
cnt AS (SELECT example_id, pred, count(*) AS n FROM am GROUP BY example_id, pred)
SELECT example_id, pred, CAST(n AS INTEGER) AS votes FROM (
  SELECT example_id, pred, n, row_number() OVER (PARTITION BY example_id ORDER BY n DESC, pred) AS rn
  FROM cnt) WHERE rn = 1""",
    "stack_predictions": SC
    + ARGMAX_CTE
    + """
SELECT CAST(row_number() OVER (PARTITION BY model_id ORDER BY example_id) - 1 AS BIGINT) AS example_id,
  'pred_' || model_id AS model_id, pred FROM am""",
    "hypothesis_decode": _with(REL_HYP)
    + """SELECT example_id, variant, '0' AS model_id,
  CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred FROM hs""",
    "hypothesis_rollup": _with(REL_HYP)
    + """,
hp AS (SELECT example_id, variant,
         exp(scores[2] - list_max(scores)) /
           (exp(scores[1] - list_max(scores)) + exp(scores[2] - list_max(scores))) AS p FROM hs),
lm AS (SELECT example_id, variant // 2 + 1 AS label_id, avg(p) AS m FROM hp GROUP BY 1, 2),
best AS (SELECT example_id, label_id, m,
           row_number() OVER (PARTITION BY example_id ORDER BY m DESC, label_id) AS rn FROM lm)
SELECT example_id, '0' AS model_id, CAST(CASE WHEN m < 0.5 THEN 0 ELSE label_id END AS INTEGER) AS pred,
  round(m, 6) AS score
FROM best WHERE rn = 1""",
    # --- evaluation ----------------------------------------------------------------------
    "align_predictions": SC
    + ENSEMBLE_CTE
    + "\nSELECT e.example_id, e.pred, a.answer FROM ens e JOIN rel_answers a USING (example_id)",
    "accuracy": SC
    + ENSEMBLE_CTE
    + """
SELECT round(avg(CASE WHEN e.pred = a.answer THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM ens e JOIN rel_answers a USING (example_id)""",
    "accuracy_from_scores": SC
    + """SELECT s.model_id, round(avg(CASE WHEN list_position(s.scores, list_max(s.scores)) - 1 = a.answer
                THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM rel_scores s JOIN rel_answers a USING (example_id) GROUP BY s.model_id""",
    "confusion_counts": SC
    + ENSEMBLE_CTE
    + """
SELECT a.answer, e.pred, count(*) AS n FROM ens e JOIN rel_answers a USING (example_id)
GROUP BY a.answer, e.pred""",
    "bce_with_logits": SC
    + """, tg AS (
  SELECT a.example_id, CAST(i AS INTEGER) AS pos,
    CASE WHEN a.answer = 0 THEN 1.0 / 16 WHEN i = a.answer - 1 THEN 1.0 ELSE 0.0 END AS z
  FROM rel_answers a CROSS JOIN range(16) AS ii(i))
SELECT x.model_id, round(avg(greatest(x.v, 0) - x.v * tg.z + ln(1 + exp(-abs(x.v)))), 6) AS loss,
  count(DISTINCT x.example_id) AS n
FROM sx x JOIN tg ON x.example_id = tg.example_id AND x.pos = tg.pos GROUP BY x.model_id""",
    # --- scoring -------------------------------------------------------------------------
    "score_batches": "WITH " + _linear("linear", 7, 3) + _LINEAR_TOP.format(name="linear"),
    "score_two_models": "WITH " + _linear("first", 7, 3) + ", " + _linear("second", 5, 4)
    + _LINEAR_TOP.format(name="first") + " UNION ALL " + _LINEAR_TOP.format(name="second"),
    # --- sources (written by Spark from the driver tables, read back) --------------------
    "read_raw_examples": EX + "SELECT example_id, sentence, entity_01, entity_02, label FROM enc",
    "read_tagged_examples": EX + "SELECT example_id, sentence, entity_01, entity_02, label FROM enc",
}
ORACLE["read_marked_examples"] = ORACLE["mark_entities"]
ORACLE["hypothesis_statements"] = ORACLE["hypothesis_input"]

ORACLE["score_hypotheses"] = EX + f""",
hyp AS (
  SELECT e.example_id, rl.label_id, d.direction,
    CASE WHEN d.direction = 0
         THEN printf('{HYP_FWD_SQL}', e.entity_01, rl.attribute_part, e.entity_02)
         ELSE printf('{HYP_REV_SQL}', e.entity_02, rl.subject_part, e.entity_01, rl.attribute_part) END
      AS text_pair
  FROM enc e CROSS JOIN rel_labels rl CROSS JOIN (VALUES (0), (1)) AS d(direction)
  WHERE rl.label_id <> 0),
sc AS (
  SELECT example_id, label_id,
    CAST(((length(text_pair) + label_id * 3 + direction) % 11 - 5) AS DOUBLE) * 0.5 AS s
  FROM hyp),
pr AS (
  SELECT example_id, label_id,
    exp(s - greatest(s, 0.0)) / (exp(0.0 - greatest(s, 0.0)) + exp(s - greatest(s, 0.0))) AS p
  FROM sc),
lm AS (SELECT example_id, label_id, sum(p) / 2 AS m FROM pr GROUP BY example_id, label_id),
best AS (SELECT example_id, label_id, m,
           row_number() OVER (PARTITION BY example_id ORDER BY m DESC, label_id) AS rn FROM lm)
SELECT example_id, CAST(CASE WHEN m < 0.5 THEN 0 ELSE label_id END AS INTEGER) AS pred,
  round(m, 6) AS score
FROM best WHERE rn = 1"""
ORACLE["write_predictions"] = ORACLE["align_predictions"]

ORACLE["score_two_sentence"] = EX + f""",
q AS (
  SELECT example_id, 0 AS variant, printf('{TWO_SENTENCE_SQL}', entity_01, entity_02) AS tp FROM enc
  UNION ALL
  SELECT example_id, 1 AS variant, printf('{TWO_SENTENCE_SQL}', entity_02, entity_01) AS tp FROM enc),
lg AS (
  SELECT example_id, variant, c,
    CASE c WHEN 0 THEN CAST(length(tp) % 5 AS DOUBLE) * CAST(0.3 AS DOUBLE)
           WHEN 1 THEN CAST(length(tp) % 3 AS DOUBLE) * CAST(0.5 AS DOUBLE)
           ELSE CAST(variant AS DOUBLE) * CAST(0.2 AS DOUBLE) END AS x
  FROM q CROSS JOIN (VALUES (0), (1), (2)) AS cc(c)),
mx AS (SELECT example_id, variant, c, x, max(x) OVER (PARTITION BY example_id, variant) AS m FROM lg),
sm AS (SELECT example_id, variant, c,
         exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY example_id, variant) AS p FROM mx),
av AS (SELECT example_id, c, sum(p) / 2 AS p FROM sm GROUP BY example_id, c),
best AS (SELECT example_id, c, p,
           row_number() OVER (PARTITION BY example_id ORDER BY p DESC, c) AS rn FROM av)
SELECT example_id, CAST(c AS INTEGER) AS pred, round(p, 6) AS score FROM best WHERE rn = 1"""


ORACLE["train_linear_classifier"] = """
SELECT doc_id AS example_id, 0 AS variant, 'bow_lr' AS model_id, CAST(((doc_id % 5) + 5) % 5 AS INTEGER) AS pred
FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''"""

ORACLE["row_position"] = EX + """
SELECT example_id, CAST(row_number() OVER (ORDER BY example_id) - 1 AS BIGINT) AS position, true AS file_positions_ok
FROM rel_examples"""

ORACLE["read_predictions"] = SC + ARGMAX_CTE + """
SELECT CAST(row_number() OVER (PARTITION BY model_id ORDER BY example_id) - 1 AS BIGINT) AS example_id,
  'm' || model_id AS model_id, pred FROM am"""

ORACLE["hard_vote_files"] = SC + ARGMAX_CTE + """,
placed AS (SELECT row_number() OVER (PARTITION BY model_id ORDER BY example_id) - 1 AS position, pred FROM am),
cnt AS (SELECT position, pred, count(*) AS n FROM placed GROUP BY position, pred)
SELECT CAST(position AS BIGINT) AS example_id, pred, CAST(n AS INTEGER) AS votes FROM (
  SELECT position, pred, n, row_number() OVER (PARTITION BY position ORDER BY n DESC, pred) AS rn FROM cnt) WHERE rn = 1"""

ORACLE["read_quoted_breaks"] = EX + """
SELECT e.example_id AS doc_id, CAST(row_number() OVER (ORDER BY e.example_id) - 1 AS BIGINT) AS position,
  trim(d.text) AS sentence, e.relation
FROM rel_examples e JOIN documents d ON d.doc_id = e.example_id"""

ORACLE["label_dimension"] = "WITH " + REL_LABELS + "\nSELECT label_id, label_name, subject_part, attribute_part FROM rel_labels"

ORACLE["read_templates"] = "WITH " + REL_LABELS + """
SELECT label_id, label_name, attribute_part || ' of?' AS forward, subject_part || ' to?' AS reverse,
  CASE WHEN label_id % 5 = 0 THEN '{1} ' || attribute_part || '|{2} ' || subject_part ELSE '' END AS extra
FROM rel_labels"""

CONFIGS = """WITH conf AS (
  SELECT n_nationkey AS k, CAST(n_nationkey AS BIGINT) AS seed, n_name AS MODEL_NAME,
    './out/' || CASE WHEN n_nationkey % 12 = 3 THEN 'shared' ELSE n_name END AS output_dir,
    './log/' || n_regionkey || '/' || CASE WHEN n_nationkey % 9 = 4 THEN 'same' ELSE n_name END AS logging_dir,
    CAST(2 AS BIGINT) AS EPOCH, 'SGD' AS optimizer, CAST(0.25 AS DOUBLE) AS learning_rate,
    CASE WHEN n_nationkey % 8 <> 7 THEN CAST(4 AS BIGINT) END AS batch_size,
    CASE WHEN n_nationkey % 5 = 1 THEN 'on' ELSE 'off' END AS rtq,
    CASE WHEN n_nationkey % 3 = 0 THEN 'on' ELSE 'off' END AS two_sentence,
    CASE WHEN n_nationkey % 4 = 2 THEN 'on' ELSE 'off' END AS except_0,
    CASE WHEN n_nationkey % 10 <> 9 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'on' ELSE 'off' END END AS entity_token,
    CASE WHEN n_nationkey % 9 = 4 THEN 'same' ELSE n_name END || '_2' AS run
  FROM nation)
"""
ORACLE["read_experiments"] = CONFIGS + "SELECT * EXCLUDE (k, run) FROM conf"
ORACLE["num_labels"] = CONFIGS + """SELECT MODEL_NAME AS model,
  CASE WHEN rtq = 'on' THEN 2 WHEN except_0 = 'on' THEN 41 ELSE 42 END AS num_labels FROM conf"""
ORACLE["input_style"] = CONFIGS + """SELECT MODEL_NAME AS model,
  CASE WHEN rtq = 'on' THEN 'hypothesis' WHEN two_sentence = 'on' THEN 'two_sentence'
       WHEN entity_token IS NULL THEN NULL WHEN entity_token = 'on' THEN 'typed_pair' ELSE 'pair' END AS style,
  CASE WHEN rtq = 'on' THEN 'hypothesis_decode' WHEN two_sentence = 'on' THEN 'pair_soft_vote'
       WHEN except_0 = 'on' THEN 'threshold_decode' ELSE 'argmax_decode' END AS decoder FROM conf"""
ORACLE["experiment_check"] = CONFIGS + """, c AS (
  SELECT MODEL_NAME AS model,
    concat_ws(',', CASE WHEN batch_size IS NULL THEN 'batch_size' END, CASE WHEN entity_token IS NULL THEN 'entity_token' END) AS missing_keys,
    count(*) OVER (PARTITION BY output_dir) > 1 AS duplicate_output_dir,
    count(*) OVER (PARTITION BY run) > 1 AS duplicate_run_name,
    rtq = 'on' AND except_0 = 'on' AS conflict FROM conf)
SELECT *, missing_keys = '' AND NOT duplicate_output_dir AND NOT duplicate_run_name AND NOT conflict AS ok FROM c"""
ORACLE["run_name"] = CONFIGS + "SELECT MODEL_NAME AS model, run AS run_name FROM conf"

_POSITIONED = EX + """,
placed AS (SELECT CAST(row_number() OVER (ORDER BY example_id) - 1 AS BIGINT) AS position, * FROM enc)"""
ORACLE["load_test_dataset"] = _POSITIONED + f"""
SELECT position AS example_id, 0 AS variant, 'two_sentence' AS style, sentence AS text,
  printf('{TWO_SENTENCE_SQL}', entity_01, entity_02) AS text_pair, 150 AS max_length FROM placed
UNION ALL
SELECT position, 1, 'two_sentence', sentence, printf('{TWO_SENTENCE_SQL}', entity_02, entity_01), 150 FROM placed"""
_TYPED = (
    "'[E1][E1-NER]' || " + TAG_SQL.format(e="entity_01") + " || '[E1-NER]' || entity_01 || '[E1][E2][E2-NER]' || "
    + TAG_SQL.format(e="entity_02") + " || '[E2-NER]' || entity_02 || '[E2]'"
)
ORACLE["tagged_test_dataset"] = _POSITIONED + f"""
SELECT position AS example_id, 0 AS variant, 'typed_pair' AS style, {_TYPED} AS text, sentence AS text_pair, 200 AS max_length FROM placed"""
ORACLE["ensemble_files"] = _POSITIONED + f""",
tx AS (SELECT position, example_id, length(entity_01 || '[SEP]' || entity_02) AS p, length({_TYPED}) AS t, length(sentence) AS m FROM placed),
md AS (SELECT * FROM (VALUES ('p', 5, 3), ('p', 7, 4), ('t', 6, 5), ('t', 9, 2)) AS v(kind, a, b)),
ln AS (SELECT position, example_id, a, b, CASE kind WHEN 'p' THEN p ELSE t END AS n, m FROM tx CROSS JOIN md),
lg AS (SELECT position, example_id, a, b, c, CAST(CASE c WHEN 0 THEN (n % a) * 0.23 WHEN 1 THEN (m % b) * 0.51 ELSE ((n + m) % (a + b)) * 0.117 END AS DOUBLE) AS x
       FROM ln CROSS JOIN (VALUES (0), (1), (2)) AS cc(c)),
sf AS (SELECT position, example_id, c, exp(x) / sum(exp(x)) OVER (PARTITION BY position, a, b) AS p FROM lg),
av AS (SELECT position, example_id, c, round(avg(p), 12) AS p FROM sf GROUP BY position, example_id, c),
vt AS (SELECT position, example_id, c, row_number() OVER (PARTITION BY position ORDER BY p DESC, c) AS rn FROM av)
SELECT round(avg(CASE WHEN c = example_id % 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM vt WHERE rn = 1"""


# --- subword pieces --------------------------------------------------------------------------------

_PIECE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
_MARKED_WORD = r"\[E1-NER\]|\[E2-NER\]|\[/E1\]|\[/E2\]|\[SEP\]|\[E1\]|\[E2\]|" + _PIECE_WORD
ORACLE["encode_subwords"] = EX.replace("WITH", "WITH RECURSIVE", 1) + f""",
bw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_PIECE_WORD}')) AS w FROM benchmark),
named AS (
  SELECT w AS piece FROM bw UNION SELECT w[1:n] FROM bw, range(1, 4) AS r(n)
  UNION SELECT '##' || w[i : i + n - 1] FROM bw, range(2, length(w) + 1) AS p(i), range(1, 3) AS r(n)),
special AS (SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[E1]', 4), ('[/E1]', 5),
  ('[E2]', 6), ('[/E2]', 7), ('[E1-NER]', 8), ('[E2-NER]', 9)) AS v(piece, id)),
pieces AS (SELECT piece, (row_number() OVER (ORDER BY piece) + 9)::INTEGER AS id FROM named UNION ALL SELECT * FROM special),
pairs AS (SELECT example_id, regexp_extract_all(entity_01 || '[SEP]' || entity_02, '{_MARKED_WORD}') AS wa,
  regexp_extract_all(sentence, '{_MARKED_WORD}') AS wb FROM enc),
words AS (SELECT DISTINCT unnest(wa || wb) AS w FROM pairs),
best AS (
  SELECT w, i, max(n) AS n, arg_max(p.id, n) AS id FROM (SELECT w, i FROM words, range(1, length(w) + 1) AS t(i) WHERE length(w) <= 100),
    range(1, (SELECT max(length(piece)) FROM pieces) + 1) AS t2(n), pieces p
  WHERE i + n - 1 <= length(w) AND p.piece = CASE WHEN i > 1 THEN '##' ELSE '' END || w[i : i + n - 1] GROUP BY w, i),
walk AS (
  SELECT w, 1::BIGINT AS pos, []::INTEGER[] AS ids FROM words
  UNION ALL SELECT walk.w, pos + n, list_append(ids, best.id) FROM walk JOIN best ON best.w = walk.w AND best.i = pos),
cut AS (SELECT words.w, CASE WHEN s.id IS NOT NULL THEN [s.id] ELSE coalesce(walk.ids, [1]) END AS ids
  FROM words LEFT JOIN walk ON walk.w = words.w AND walk.pos = length(words.w) + 1 LEFT JOIN special s ON s.piece = words.w),
placed AS (
  SELECT example_id, 0 AS side, k, wa[k] AS w FROM pairs, range(1, len(wa) + 1) AS t(k)
  UNION ALL SELECT example_id, 1, k, wb[k] FROM pairs, range(1, len(wb) + 1) AS t(k)),
whole AS (SELECT example_id, coalesce(flatten(list(ids ORDER BY k) FILTER (side = 0)), []::INTEGER[]) AS a,
  coalesce(flatten(list(ids ORDER BY k) FILTER (side = 1)), []::INTEGER[]) AS b FROM placed JOIN cut USING (w) GROUP BY example_id),
ln AS (SELECT *, len(a) AS la, len(b) AS lb, greatest(len(a) + len(b) - 97, 0) AS ov, abs(len(a) - len(b)) AS d, least(len(a), len(b)) AS m FROM whole),
kp AS (SELECT *, CAST(CASE WHEN ov <= d THEN (CASE WHEN la > lb THEN la - ov ELSE la END) ELSE m - floor((ov - d) / 2) END AS INTEGER) AS n_a,
    CAST(CASE WHEN ov <= d THEN (CASE WHEN la > lb THEN lb ELSE lb - ov END) ELSE m - ceil((ov - d) / 2) END AS INTEGER) AS n_b FROM ln),
lay AS (SELECT *, 97 - n_a - n_b AS p FROM kp)
SELECT example_id, la::INTEGER AS pieces_a, lb::INTEGER AS pieces_b, md5(array_to_string(a, ',') || '|' || array_to_string(b, ',')) AS whole_md5, n_a, n_b,
  array_to_string([2] || a[1:n_a] || [3] || b[1:n_b] || [3] || list_transform(range(p), lambda x: 0), ',') AS input_ids,
  array_to_string(list_transform(range(100), lambda x: CASE WHEN x >= n_a + 2 AND x < n_a + n_b + 3 THEN 1 ELSE 0 END), ',') AS segments,
  array_to_string(list_transform(range(100), lambda x: CASE WHEN x < n_a + n_b + 3 THEN 1 ELSE 0 END), ',') AS mask
FROM lay"""


# --- training on soft targets ----------------------------------------------------------------------


def _gradient_steps(epochs: int, features: int = 1024, classes: int = 3, rate: float = 0.5, threshold: float = 0.6) -> str:
    """Full gradient steps by moments as CTEs; ``told`` has the figures of every epoch."""
    out = [f"""WITH ex AS (
  SELECT doc_id AS id, coalesce(replace(text, chr(10), ' '), '') AS sentence, doc_id % 5 = 0 AS held,
    CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 ELSE 0 END AS label FROM documents),
wd AS (SELECT id, held, unnest(list_filter(string_split(sentence, ' '), lambda w: w <> '')) AS w FROM ex),
ft AS (SELECT id, held, ('0x' || substr(md5(w), 1, 7))::BIGINT % {features} AS f FROM wd),
x AS (
  SELECT id, held, f, count(*) / (sum(count(*)) OVER (PARTITION BY id))::DOUBLE AS v FROM ft GROUP BY id, held, f
  UNION ALL SELECT id, held, {features}, 1.0 FROM ex),
t AS (SELECT id, held, label, k, CASE WHEN label = 0 THEN 1.0::DOUBLE / {classes} WHEN label = k + 1 THEN 1.0 ELSE 0.0 END AS t
  FROM ex, range({classes}) AS r(k)),
w0 AS (SELECT f, k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2 FROM range({features} + 1) AS a(f), range({classes}) AS b(k))"""]
    loss = "avg(greatest(z, 0.0) - z * t + ln(1 + exp(-abs(z))))"
    for e in range(epochs + 1):
        out.append(f"""z{e} AS (SELECT t.id, t.held, label, t.k, t, sum(v * w) AS z
  FROM t JOIN x ON x.id = t.id JOIN w{e} w ON w.f = x.f AND w.k = t.k GROUP BY 1, 2, 3, 4, 5)""")
        if e < epochs:
            out.append(f"""g{e} AS (SELECT f, k, sum(v * (1 / (1 + exp(-z)) - t)) / (SELECT count(*) FROM t WHERE NOT held) AS g
  FROM z{e} z JOIN x ON x.id = z.id WHERE NOT z.held GROUP BY f, k),
m{e} AS (SELECT w.f, w.k, w, 0.9 * m1 + 0.1 * coalesce(g, 0) AS m1, 0.999 * m2 + 0.001 * coalesce(g, 0) * coalesce(g, 0) AS m2
  FROM w{e} w LEFT JOIN g{e} g ON g.f = w.f AND g.k = w.k),
w{e + 1} AS (SELECT f, k, w * (1 - {rate} * 0.01) - {rate} * (m1 / (1 - power(0.9::DOUBLE, {e + 1}))) / (sqrt(m2 / (1 - power(0.999::DOUBLE, {e + 1}))) + 1e-6) AS w, m1, m2 FROM m{e})""")
    for e in range(1, epochs + 1):
        out.append(f"""p{e} AS (SELECT id, label, CASE WHEN 1 / (1 + exp(-max(z))) < {threshold} THEN 0 ELSE arg_max(k, z) + 1 END AS pred
  FROM z{e} WHERE held GROUP BY id, label)""")
    one = [f"""SELECT {e} AS epoch, (SELECT {loss} FROM z{e - 1} WHERE NOT held) AS train_loss, (SELECT {loss} FROM z{e} WHERE held) AS held_loss,
  (SELECT avg((pred = label)::DOUBLE) FROM p{e}) AS held_accuracy""" for e in range(1, epochs + 1)]
    out.append("told AS (" + "\nUNION ALL ".join(one) + ")")
    return ",\n".join(out)


_TOLD = "epoch, round(train_loss, 6) AS train_loss, round(held_loss, 6) AS held_loss, round(held_accuracy, 6) AS held_accuracy"
ORACLE["train_soft_targets"] = _gradient_steps(4) + f"\nSELECT {_TOLD} FROM told"
ORACLE["resume_training"] = _gradient_steps(8) + f"""
SELECT {_TOLD}, epoch = 8 OR row_number() OVER (ORDER BY held_accuracy DESC, held_loss, epoch DESC) <= 3 AS kept FROM told"""


# --- thresholds ------------------------------------------------------------------------------------

_SWEEP = SC + """,
best AS (SELECT model_id, list_max(scores) AS top, list_position(scores, list_max(scores)) AS pred, answer
  FROM rel_scores JOIN rel_answers USING (example_id)),
per AS (SELECT model_id, top, count(*) AS n, count(*) FILTER (pred = answer) AS hits, count(*) FILTER (answer = 0) AS none FROM best GROUP BY 1, 2),
swept AS (
  SELECT model_id, 1 / (1 + exp(-top)) AS threshold, n,
    (sum(hits) OVER (PARTITION BY model_id ORDER BY top DESC) + sum(none) OVER (PARTITION BY model_id ORDER BY top) - none)::DOUBLE
      / sum(n) OVER (PARTITION BY model_id) AS accuracy FROM per)"""
ORACLE["threshold_sweep"] = _SWEEP + """
SELECT model_id, round(threshold, 6) AS threshold, n, round(accuracy, 6) AS accuracy FROM swept"""
ORACLE["best_threshold"] = _SWEEP + """
SELECT model_id, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM swept
QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY accuracy DESC, threshold) = 1"""


# --- scores kept by content --------------------------------------------------------------------------

ORACLE["score_store"] = EX + """,
seen AS (SELECT DISTINCT entity_01 || '[SEP]' || entity_02 AS a, sentence AS b FROM enc),
again AS (SELECT example_id, CASE WHEN example_id % 7 = 0 THEN entity_02 || '[SEP]' || entity_01 ELSE entity_01 || '[SEP]' || entity_02 END AS a, sentence AS b FROM enc),
sc AS (SELECT *, [(length(a) % 7) * 0.3::DOUBLE, ((length(a) + length(b)) % 5) * 0.5::DOUBLE] AS s FROM again)
SELECT example_id, (list_position(s, list_max(s)) - 1)::INTEGER AS pred, round(list_max(s), 6) AS top_score, (a, b) NOT IN (SELECT (a, b) FROM seen) AS fresh FROM sc"""


# --- interval of the accuracy ------------------------------------------------------------------------

ORACLE["accuracy_interval"] = SC + """,
hit AS (SELECT example_id, model_id, (list_position(scores, list_max(scores)) - 1 = answer)::INTEGER AS hit FROM rel_scores JOIN rel_answers USING (example_id)),
drawn AS (SELECT *, ('0x' || substr(md5(example_id || ':' || (b // 8)), (4 * (b % 8) + 1)::INTEGER, 4))::INTEGER AS u FROM hit, range(96) AS r(b)),
weighed AS (SELECT *, list_sum(list_transform([24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535], lambda t: (u >= t)::INTEGER)) AS w FROM drawn),
per AS (SELECT model_id, b, sum(w * hit)::DOUBLE / sum(w) AS a FROM weighed GROUP BY model_id, b),
ranked AS (SELECT model_id, a, row_number() OVER (PARTITION BY model_id ORDER BY a) AS k FROM per)
SELECT model_id, (SELECT round(avg(hit), 6) FROM hit h WHERE h.model_id = r.model_id) AS accuracy,
  round(max(a) FILTER (k = 3), 6) AS low, round(max(a) FILTER (k = 94), 6) AS high, (SELECT count(*) FROM hit h WHERE h.model_id = r.model_id) AS n
FROM ranked r GROUP BY model_id"""


# --- batches under a token budget --------------------------------------------------------------------

_TOKEN_BATCHES = EX.replace("WITH", "WITH RECURSIVE", 1) + """,
tk AS (SELECT example_id, entity_01 || '[SEP]' || entity_02 AS a, sentence AS b,
  len(list_filter(string_split_regex(entity_01 || '[SEP]' || entity_02, '\\s+'), lambda x: x <> '')) AS la,
  len(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '')) AS lb FROM enc),
ln AS (SELECT *, least(la + lb, 97) + 3 AS n_tokens FROM tk),
hist AS (SELECT n_tokens AS l, count(*) AS n, row_number() OVER (ORDER BY n_tokens) AS i, greatest(1, 2000 // n_tokens) AS cap FROM ln GROUP BY n_tokens),
pack AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS l, 0::BIGINT AS fill, 0::BIGINT AS first, 0::BIGINT AS next, 1::BIGINT AS cap, 0::BIGINT AS held, 0::BIGINT AS batch
  UNION ALL
  SELECT i, l, fill, batch, next, cap, CASE WHEN n > fill THEN (n - fill - 1) % cap + 1 ELSE held + fill END,
    CASE WHEN n > fill THEN next + (n - fill - 1) // cap ELSE batch END
  FROM (SELECT h.*, pack.held, pack.batch, pack.batch + CASE WHEN pack.held > 0 THEN 1 ELSE 0 END AS next,
          CASE WHEN pack.held > 0 THEN least(h.n, greatest(0, h.cap - pack.held)) ELSE 0 END AS fill
        FROM pack JOIN hist h ON h.i = pack.i + 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY n_tokens ORDER BY example_id) - 1 AS k FROM ln),
dealt AS (SELECT numbered.*, CASE WHEN k < fill THEN first ELSE next + (k - fill) // cap END AS batch FROM numbered JOIN pack ON l = n_tokens)"""
ORACLE["token_batches"] = _TOKEN_BATCHES + """,
sc AS (SELECT *, [(length(a) % 7) * 0.3::DOUBLE, ((length(a) + length(b)) % 5) * 0.5::DOUBLE] AS s FROM dealt)
SELECT example_id, batch, (list_position(s, list_max(s)) - 1)::INTEGER AS pred, round(list_max(s), 6) AS top_score FROM sc"""
ORACLE["padding_report"] = _TOKEN_BATCHES + """,
per AS (SELECT batch, count(*) AS n, sum(n_tokens) AS t, max(n_tokens) AS m FROM dealt GROUP BY batch)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_batches, sum(t)::BIGINT AS n_tokens, sum(n * m)::BIGINT AS n_padded,
  round(1 - sum(t)::DOUBLE / sum(n * m), 6) AS padding_share FROM per"""


# --- trained tagger ------------------------------------------------------------------------------------

ORACLE["tag_paths"] = EX.replace("WITH", "WITH RECURSIVE", 1) + """,
sq AS (
  SELECT 'p' || p_partkey AS sequence, list_transform(string_split(p_type, ' '), lambda w: {'w': w, 't': 'TYPE'}) || list_transform(string_split(p_name, ' '), lambda w: {'w': w, 't': 'NAME'})
    || list_transform(string_split(p_brand, ' '), lambda w: {'w': w, 't': 'BRAND'}) AS l FROM part
  UNION ALL SELECT 'n' || n_nationkey, list_transform(string_split(n_name, ' '), lambda w: {'w': w, 't': 'PLACE'}) || list_transform(string_split(r_name, ' '), lambda w: {'w': w, 't': 'AREA'})
  FROM nation JOIN region ON n_regionkey = r_regionkey),
tt AS (SELECT sequence, i, l[i].w AS w, l[i].t AS t, l[i - 1].t AS b FROM (SELECT sequence, l, unnest(range(1, len(l) + 1)) AS i FROM sq)),
tags AS (SELECT t, row_number() OVER (ORDER BY t) AS k, count(*) AS n FROM tt GROUP BY t),
st AS (SELECT CASE WHEN i > 1 THEN b END AS b, t, count(*) AS n FROM tt GROUP BY 1, 2),
pairs AS (SELECT f.b, f.k0, g.t, g.k FROM (SELECT NULL AS b, 0 AS k0 UNION ALL SELECT t, k FROM tags) f, tags g),
tr AS (SELECT k0, k, ln((coalesce(n, 0) + 0.5::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY k0) + 0.5 * (SELECT count(*) FROM tags))::DOUBLE) AS v
  FROM pairs LEFT JOIN st ON st.b IS NOT DISTINCT FROM pairs.b AND st.t = pairs.t),
step AS (SELECT list(v ORDER BY k) FILTER (k0 = 0) AS starts FROM tr),
inn AS (SELECT list(l ORDER BY k) AS into_ FROM (SELECT k, list(v ORDER BY k0) AS l FROM tr WHERE k0 > 0 GROUP BY k)),
sz AS (SELECT count(DISTINCT w) + 1 AS size FROM tt),
em AS (SELECT w, list(ln((n + 0.5::DOUBLE) / (total + 0.5 * size)::DOUBLE) ORDER BY k) AS e
  FROM (SELECT ws.w, k, tags.n AS total, count(tt.w) AS n FROM (SELECT DISTINCT w FROM tt) ws CROSS JOIN tags LEFT JOIN tt ON tt.w = ws.w AND tt.t = tags.t GROUP BY 1, 2, 3), sz GROUP BY w),
un AS (SELECT list(ln(0.5::DOUBLE / (n + 0.5 * size)::DOUBLE) ORDER BY k) AS e FROM tags, sz),
en AS (SELECT DISTINCT e FROM (SELECT unnest([p_name, p_name || ' ' || p_type, p_brand || ' ' || p_name]) AS e FROM part
  UNION ALL SELECT unnest([entity_01, entity_02]) FROM enc)),
tk AS (SELECT e AS entity, i, ws[i] AS w, len(ws) AS m FROM (SELECT e, list_filter(string_split_regex(e, '\\s+'), lambda x: x <> '') AS ws FROM en), range(1, len(ws) + 1) AS r(i)),
lg AS (SELECT entity, i, m, coalesce(em.e, un.e) AS e FROM tk CROSS JOIN un LEFT JOIN em ON em.w = tk.w),
walk AS (
  SELECT entity, i, m, list_transform(range(1, len(e) + 1), lambda t: {'v': starts[t] + e[t], 'p': [t]::BIGINT[]}) AS s FROM lg, step WHERE i = 1
  UNION ALL
  SELECT entity, i, m, list_transform(range(1, len(e) + 1), lambda t: {'v': b[t].v + e[t], 'p': s[-b[t].neg].p || [t]::BIGINT[]}) FROM (
    SELECT lg.entity, lg.i, lg.m, lg.e, walk.s, list_transform(range(1, len(lg.e) + 1), lambda t:
      list_max(list_transform(range(1, len(lg.e) + 1), lambda f: {'v': walk.s[f].v + into_[t][f], 'neg': -f}))) AS b
    FROM walk JOIN lg ON lg.entity = walk.entity AND lg.i = walk.i + 1, inn)),
done AS (SELECT entity, s[-list_max(list_transform(range(1, len(s) + 1), lambda f: {'v': s[f].v, 'neg': -f})).neg].p AS p FROM walk WHERE i = m),
names AS (SELECT list(t ORDER BY k) AS nm FROM tags)
SELECT e AS entity, array_to_string(list_transform(p, lambda i: nm[i]), ' ') AS tags, nm[p[1]] AS tag FROM en CROSS JOIN names LEFT JOIN done ON entity = e"""
ORACLE["stream_confusion"] = ORACLE["confusion_counts"]
