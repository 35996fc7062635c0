"""DuckDB oracle SQL for every SQL-checkable query key.

Written independently of the Spark code path: row_number windows instead
of histogram cuts, unnest + joins instead of higher-order functions.
Common table expressions are composed from the fragments below.
"""

from __future__ import annotations

# labelled relation L with names (general family)
L = """
L AS (
  SELECT d.doc_id, d.text AS sentence, d.lang, d.source,
         CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS label
  FROM documents d JOIN labels l USING (doc_id)),
LN AS (
  SELECT *, CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label_name
  FROM L)"""


def split_cte(src: str, key: str, name: str = "SPLIT", seed: int = 42) -> str:
    """Exact stratified split of ``src`` (columns include label, <key>)."""
    p = name
    return f"""
{p}_S0 AS (SELECT *, md5('{seed}:' || CAST({key} AS VARCHAR)) AS _h FROM {src}),
{p}_C AS (SELECT label, count(*) AS n_c FROM {p}_S0 GROUP BY label),
{p}_Q1 AS (SELECT label, n_c, sum(n_c) OVER () AS n_all,
                 sum(n_c) OVER () - (30 * sum(n_c) OVER () + 99) // 100 AS t_total FROM {p}_C),
{p}_Q2 AS (SELECT *, (n_c * t_total) // n_all AS fl, (n_c * t_total) % n_all AS rem FROM {p}_Q1),
{p}_Q3 AS (SELECT label, n_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                                   <= t_total - sum(fl) OVER () THEN 1 ELSE 0 END AS train_c FROM {p}_Q2),
{p}_Q4 AS (SELECT label, n_c, train_c, n_c - train_c AS hold_c,
                  sum(n_c - train_c) OVER () AS h_all FROM {p}_Q3),
{p}_Q5 AS (SELECT *, h_all - (50 * h_all + 99) // 100 AS v_total FROM {p}_Q4),
{p}_Q6 AS (SELECT *, (hold_c * v_total) // h_all AS fl, (hold_c * v_total) % h_all AS rem FROM {p}_Q5),
{p}_Q7 AS (SELECT label, hold_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                                   <= v_total - sum(fl) OVER () THEN 1 ELSE 0 END AS val_c FROM {p}_Q6),
{p}_QU AS (SELECT label, val_c, hold_c - val_c AS test_c FROM {p}_Q7),
{p} AS (
  SELECT r.* EXCLUDE (_h, _r),
         CASE WHEN _r <= q.test_c THEN 'test'
              WHEN _r <= q.test_c + q.val_c THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY _h) AS _r FROM {p}_S0) r
  JOIN {p}_QU q USING (label))"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["class_distribution"] = with_(L) + """
SELECT label_name, count(*) AS n FROM LN GROUP BY label_name"""

ORACLE["label_decode"] = with_(L) + """
SELECT doc_id, label, label_name FROM LN"""

ORACLE["label_remap"] = with_(L) + """
SELECT doc_id, label_name,
       CAST(CASE label WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS INTEGER) AS label
FROM LN"""

ORACLE["stratified_split"] = with_(L, split_cte("LN", "doc_id")) + """
SELECT doc_id, label, label_name, split FROM SPLIT"""

ORACLE["split_counts"] = with_(L, split_cte("LN", "doc_id")) + """
SELECT split, label_name, count(*) AS n FROM SPLIT GROUP BY ROLLUP (split, label_name)
HAVING split IS NOT NULL"""

ORACLE["split_disjoint"] = with_(L, split_cte("LN", "doc_id")) + """
, K AS (SELECT doc_id, count(*) AS k, count(DISTINCT split) AS s FROM SPLIT GROUP BY doc_id),
  SRC AS (SELECT DISTINCT doc_id, 1 AS in_source FROM LN),
  J AS (SELECT * FROM SRC FULL OUTER JOIN K USING (doc_id))
SELECT CAST(sum(CASE WHEN in_source = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_source,
       CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_assigned,
       CAST(sum(CASE WHEN s > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi_split,
       CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicated,
       CAST(sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
       CAST(sum(CASE WHEN in_source IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_extra
FROM J"""

ORACLE["sample_rows"] = with_(L) + """
SELECT doc_id, label_name, sentence
FROM LN ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)) LIMIT 5"""


# ---------------------------------------------------------------------------
# SQL building blocks for text / heads
# ---------------------------------------------------------------------------
from lexlab.constants import STRIP_CHARS  # noqa: E402


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = lit(STRIP_CHARS)
SPLIT_RE = r"'[^\p{L}\p{N}_]+'"


def tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), {SPLIT_RE}), lambda t: t <> '')"


def idx_sql(tokens: str, d: int) -> str:
    return (f"list_transform({tokens}, lambda t: CAST((('0x' || substr(md5(t), 1, 8))::BIGINT) % {d}"
            f" AS INTEGER))")


def unit_sql(text_expr: str) -> str:
    return f"((('0x' || substr(md5({text_expr}), 1, 8))::BIGINT)::DOUBLE / 4294967295.0::DOUBLE)"


def fold_sql(idx: str, arr: str) -> str:
    return f"list_reduce(list_transform({idx}, lambda i: {arr}[i + 1]), lambda a, b: a + b, 0.0::DOUBLE)"


def dense_fold_sql(vec: str, arr: str) -> str:
    return (f"list_reduce(list_transform({vec}, lambda x, k: x::DOUBLE * {arr}[k]), "
            f"lambda a, b: a + b, 0.0::DOUBLE)")


def weights_cte(name: str, seed: int, n_classes: int, dim: int) -> str:
    """One row: w0..w{C-1}, each a list of ``dim`` fixed-head weights."""
    cols = ", ".join(f"any_value(wl) FILTER (WHERE c = {c}) AS w{c}" for c in range(n_classes))
    return f"""
{name} AS (
  SELECT {cols} FROM (
    SELECT c, list(w ORDER BY j) AS wl FROM (
      SELECT c.range AS c, j.range AS j,
             {unit_sql(f"'w:{seed}:' || c.range || ':' || j.range")} - 0.5::DOUBLE AS w
      FROM range({n_classes}) c, range({dim}) j) GROUP BY c))"""


def predict_sql(src: str, lg: str = "lg") -> str:
    """SELECT adding pred (first argmax) and confidence (softmax at pred)."""
    return f"""(SELECT * EXCLUDE (_m, _e),
          list_reduce(_e, lambda a, b: a + b, 0.0::DOUBLE) AS _s FROM (
     SELECT *, list_transform({lg}, lambda x: exp(x - _m)) AS _e FROM (
       SELECT *, list_max({lg}) AS _m, CAST(list_position({lg}, list_max({lg})) - 1 AS INTEGER) AS pred
       FROM {src})))"""


def predicted_cte(name: str, src: str, lg: str = "lg") -> str:
    """CTE ``name`` = src + pred + confidence."""
    return f"""
{name} AS (
  SELECT * EXCLUDE (_s, _e2), _e2 / _s AS confidence FROM (
    SELECT *, list_transform({lg}, lambda x: exp(x - list_max({lg})))[pred + 1] AS _e2
    FROM {predict_sql(src, lg)}))"""


def nb_ctes(prefix: str, src: str, n_classes: int = 3, d: int = 1024, where: str = "true") -> str:
    """NB tables from the train rows of ``src`` (columns label, idx, split):
    {prefix}_T one row with t0..t{C-1} (log theta lists) and p0.. (log priors)."""
    tcols = ", ".join(f"any_value(tl) FILTER (WHERE label = {c}) AS t{c}" for c in range(n_classes))
    pcols = ", ".join(f"any_value(lp) FILTER (WHERE label = {c}) AS p{c}" for c in range(n_classes))
    return f"""
{prefix}_C AS (SELECT label, i, count(*) AS n FROM (
    SELECT label, unnest(idx) AS i FROM {src} WHERE split = 'train' AND {where}) GROUP BY label, i),
{prefix}_TOT AS (SELECT label, sum(n) AS tot FROM {prefix}_C GROUP BY label),
{prefix}_D AS (SELECT label, count(*) AS d FROM {src} WHERE split = 'train' AND {where} GROUP BY label),
{prefix}_TH AS (
  SELECT g.c AS label, list(ln((coalesce(n.n, 0) + 1.0::DOUBLE) / (coalesce(t.tot, 0) + 1024.0::DOUBLE))
                            ORDER BY g.j) AS tl
  FROM (SELECT c.range AS c, j.range AS j FROM range({n_classes}) c, range({d}) j) g
  LEFT JOIN {prefix}_C n ON n.label = g.c AND n.i = g.j
  LEFT JOIN {prefix}_TOT t ON t.label = g.c
  GROUP BY g.c),
{prefix}_PR AS (SELECT label, ln(d::DOUBLE / (sum(d) OVER ())::DOUBLE) AS lp FROM {prefix}_D),
{prefix}_T AS (
  SELECT * FROM (SELECT {tcols} FROM {prefix}_TH), (SELECT {pcols} FROM {prefix}_PR))"""


def text_p_ctes(seed: int = 42) -> str:
    """L -> SPLIT -> TOK(idx) -> FIX (fixed head) -> NB -> P(model_id, doc_id, split, label, lang,
    pred, confidence)."""
    scale = "(1.0::DOUBLE / sqrt(greatest(len(idx), 1)::DOUBLE))"
    fixed_lg = "[" + ", ".join(f"{fold_sql('idx', f'w{c}')} * {scale}" for c in range(3)) + "]"
    nb_lg = "[" + ", ".join(f"{fold_sql('idx', f't{c}')} + p{c}" for c in range(3)) + "]"
    return ",".join([
        L.strip("\n"), split_cte("LN", "doc_id").strip("\n"),
        f"""
TOK AS (SELECT doc_id, split, label, lang, sentence, {idx_sql(tokens_sql('sentence'), 1024)} AS idx
        FROM SPLIT)""".strip("\n"),
        weights_cte("FW", seed, 3, 1024).strip("\n"),
        f"""
FIXL AS (SELECT TOK.*, {fixed_lg} AS lg FROM TOK, FW WHERE split = 'test')""".strip("\n"),
        predicted_cte("FIX", "FIXL").strip("\n"),
        nb_ctes("NB", "TOK").strip("\n"),
        f"""
NBL AS (SELECT TOK.*, {nb_lg} AS lg FROM TOK, NB_T WHERE split = 'test')""".strip("\n"),
        predicted_cte("NBP", "NBL").strip("\n"),
        f"""
P AS (
  SELECT 'fixed_s{seed}' AS model_id, doc_id, split, label, lang, pred, confidence FROM FIX
  UNION ALL
  SELECT 'nb' AS model_id, doc_id, split, label, lang, pred, confidence FROM NBP)""".strip("\n"),
    ])


def confusion_cte(src: str = "P", groups: str = "model_id, split", n_classes: int = 3) -> str:
    return f"""
CELLS AS (SELECT {groups}, label, pred, count(*) AS n FROM {src} GROUP BY {groups}, label, pred),
GRID AS (SELECT g.*, CAST(a.range AS INTEGER) AS label, CAST(b.range AS INTEGER) AS pred
         FROM (SELECT DISTINCT {groups} FROM CELLS) g, range({n_classes}) a, range({n_classes}) b),
CM AS (SELECT g.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_cell FROM GRID g
       LEFT JOIN CELLS c USING ({groups}, label, pred)),
PC0 AS (
  SELECT {groups}, cls AS class, sum(sup) AS support, sum(tp) AS tp, sum(prd) AS predicted FROM (
    SELECT {groups}, label AS cls, n_cell AS sup, CASE WHEN label = pred THEN n_cell ELSE 0 END AS tp,
           0 AS prd FROM CM
    UNION ALL
    SELECT {groups}, pred AS cls, 0, 0, n_cell FROM CM) GROUP BY {groups}, cls),
PC AS (
  SELECT *, (2 * prec * rec) / nullif(prec + rec, 0) AS f1_raw FROM (
    SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0)::DOUBLE, 0.0) AS prec,
              coalesce(tp::DOUBLE / nullif(support, 0)::DOUBLE, 0.0) AS rec,
              (support > 0 OR predicted > 0) AS observed FROM PC0)),
PCF AS (SELECT * EXCLUDE (f1_raw), coalesce(f1_raw, 0.0) AS f1 FROM PC),
SUMM AS (
  SELECT {groups}, CAST(sum(support) AS BIGINT) AS n,
         coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0)::DOUBLE, 0.0) AS accuracy,
         avg(prec) FILTER (WHERE observed) AS macro_precision,
         avg(rec) FILTER (WHERE observed) AS macro_recall,
         avg(f1) FILTER (WHERE observed) AS macro_f1,
         coalesce(sum(prec * support) / nullif(sum(support), 0)::DOUBLE, 0.0) AS weighted_precision,
         coalesce(sum(rec * support) / nullif(sum(support), 0)::DOUBLE, 0.0) AS weighted_recall,
         coalesce(sum(f1 * support) / nullif(sum(support), 0)::DOUBLE, 0.0) AS weighted_f1
  FROM PCF GROUP BY {groups})"""


# ---------------------------------------------------------------------------
# stage 2: corpus lines
# ---------------------------------------------------------------------------
ONE_LINE = "translate(sentence, chr(13) || chr(10), '  ')"


def parse_sql(src: str) -> str:
    """Rows of ``src`` (doc_id, line) with sentence / label / reason."""
    return f"""
PARSE0 AS (SELECT doc_id, line, split_part(line, '@', -1) AS tail, strpos(line, '@') > 0 AS has
           FROM {src}),
PARSED AS (
  SELECT doc_id, line,
         CASE WHEN has THEN trim(left(line, length(line) - length(tail) - 1), {WS}) END AS sentence,
         CAST(CASE WHEN has THEN CASE trim(tail, {WS}) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
                                      WHEN 'positive' THEN 2 END END AS INTEGER) AS label
  FROM PARSE0),
PARSED_R AS (
  SELECT *, CASE WHEN line IS NULL OR strpos(line, '@') = 0 THEN 'no_delimiter'
                 WHEN label IS NULL THEN 'unknown_label' END AS reason FROM PARSED)"""


ORACLE["parse_labelled_lines"] = with_(L, f"""
LINES AS (SELECT doc_id, {ONE_LINE} || '@' || label_name AS line FROM LN)""", parse_sql("LINES")) + """
SELECT doc_id, sentence, label FROM PARSED_R WHERE reason IS NULL"""

ORACLE["parse_quarantine"] = with_(L, f"""
LINES AS (
  SELECT doc_id,
         CASE substr(md5('dmg:' || CAST(doc_id AS VARCHAR)), 1, 1)
              WHEN '0' THEN replace({ONE_LINE}, '@', '')
              WHEN '1' THEN {ONE_LINE} || '@mixed'
              ELSE {ONE_LINE} || '@' || label_name END AS line
  FROM LN)""", parse_sql("LINES")) + """
SELECT doc_id, reason, line FROM PARSED_R WHERE reason IS NOT NULL"""

ORACLE["select_agreement"] = with_(L, f"""
AG AS (SELECT doc_id, label_name, {unit_sql("'agree:' || CAST(doc_id AS VARCHAR)")} AS u FROM LN)""") + """
SELECT doc_id, label_name, agreement_pct FROM (
  SELECT doc_id, label_name,
         CAST(CASE WHEN u < 0.40 THEN 100 WHEN u < 0.65 THEN 75 WHEN u < 0.85 THEN 66 ELSE 50 END
              AS INTEGER) AS agreement_pct FROM AG)
WHERE agreement_pct >= 66"""

# ---------------------------------------------------------------------------
# stage 5: text, padding, scoring
# ---------------------------------------------------------------------------
ORACLE["tokenize_truncate"] = f"""
WITH T AS (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(least(len(toks), 128) AS BIGINT) AS n_kept,
       array_to_string(toks[1:128], ' ') AS tokens_text
FROM T"""

ORACLE["vocab_counts"] = f"""
WITH T AS (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents),
D AS (SELECT doc_id, token, count(*) AS c FROM T GROUP BY doc_id, token)
SELECT token, CAST(sum(c) AS BIGINT) AS n_occurrences, CAST(count(*) AS BIGINT) AS n_docs
FROM D GROUP BY token"""

ORACLE["pad_batches"] = f"""
WITH I AS (SELECT doc_id, list_transform({idx_sql(tokens_sql('text'), 32768)}, lambda i: i + 1) AS ids
      FROM documents),
B AS (SELECT I.*, CAST((('0x' || substr(md5('batch:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT) % 256
                       AS INTEGER) AS bucket FROM I),
R AS (SELECT *, CAST((row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // 32 AS BIGINT)
                AS batch_no, CAST(len(ids) AS BIGINT) AS seq_len FROM B),
M AS (SELECT *, max(seq_len) OVER (PARTITION BY bucket, batch_no) AS padded_len FROM R)
SELECT doc_id, bucket, batch_no, seq_len, padded_len,
       md5(array_to_string(list_resize(ids, padded_len, 0), ' ')) AS input_ids_md5,
       seq_len AS mask_sum
FROM M"""


def emb_fixed_sql(seed: int = 42, n_classes: int = 10, dim: int = 64) -> str:
    lg = "[" + ", ".join(dense_fold_sql("embedding", f"w{c}") for c in range(n_classes)) + "]"
    return ",".join([weights_cte("EW", seed, n_classes, dim).strip("\n"),
                     f"\nEL AS (SELECT vec_id, label, {lg} AS lg FROM embeddings, EW)".strip("\n"),
                     predicted_cte("EP", "EL").strip("\n")])


ORACLE["score_fixed_head"] = with_(emb_fixed_sql()) + """
SELECT vec_id, label, pred, round(confidence, 6) AS confidence FROM EP"""


def score_new_text_sql() -> str:
    nb_lg = "[" + ", ".join(f"{fold_sql('idx', f't{c}')} + p{c}" for c in range(3)) + "]"
    return with_(L, split_cte("LN", "doc_id"), f"""
TOK AS (SELECT doc_id, split, label, {idx_sql(tokens_sql('sentence'), 1024)} AS idx FROM SPLIT)""",
                 nb_ctes("NB", "TOK"), f"""
NEW AS (SELECT d.doc_id, d.text, {idx_sql(tokens_sql('d.text'), 1024)} AS idx
        FROM documents d ANTI JOIN labels l USING (doc_id)),
NL AS (SELECT NEW.*, {nb_lg} AS lg FROM NEW, NB_T)""", predicted_cte("NP", "NL")) + """,
NP2 AS (SELECT *, list_transform(lg, lambda x: exp(x - list_max(lg))) AS e FROM NP),
NP3 AS (SELECT *, list_transform(e, lambda x: x / list_reduce(e, lambda a, b: a + b, 0.0::DOUBLE)) AS p
        FROM NP2)
SELECT doc_id, ['negative', 'neutral', 'positive'][pred + 1] AS prediction,
       upper(['negative', 'neutral', 'positive'][pred + 1]) AS prediction_upper,
       round(confidence, 6) AS confidence,
       printf('negative: %.3f, neutral: %.3f, positive: %.3f', p[1], p[2], p[3]) AS scores_text,
       round(p[1], 6) AS score_negative, round(p[2], 6) AS score_neutral, round(p[3], 6) AS score_positive,
       text, substr(text, 1, 80) AS preview
FROM NP3"""


ORACLE["score_new_text"] = score_new_text_sql()

ORACLE["score_term_table"] = with_(L, split_cte("LN", "doc_id"), f"""
VT AS (SELECT label, unnest({tokens_sql('sentence')}) AS term FROM SPLIT WHERE split = 'train'),
VC AS (SELECT term, label, count(*) AS n FROM VT GROUP BY term, label),
VN AS (SELECT label, sum(n) AS tot FROM VC GROUP BY label),
VV AS (SELECT count(DISTINCT term) AS v FROM VC),
VP AS (SELECT label AS c, ln(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE) AS prior FROM SPLIT WHERE split = 'train' GROUP BY label),
VW AS (SELECT t.term, p.c, ln((coalesce(VC.n, 0) + 1.0::DOUBLE) / (VN.tot + VV.v)::DOUBLE) AS w
       FROM (SELECT DISTINCT term FROM VC) t CROSS JOIN VP p CROSS JOIN VV JOIN VN ON VN.label = p.c
       LEFT JOIN VC ON VC.term = t.term AND VC.label = p.c),
ND AS (SELECT doc_id, text FROM documents d ANTI JOIN labels l USING (doc_id)),
NT AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM ND) GROUP BY doc_id, term),
NS AS (SELECT doc_id, c, sum(n * w) AS s FROM NT JOIN VW USING (term) GROUP BY doc_id, c),
NZ AS (SELECT ND.doc_id, p.c, coalesce(s, 0.0) + prior AS z FROM ND CROSS JOIN VP p LEFT JOIN NS ON NS.doc_id = ND.doc_id AND NS.c = p.c),
NM AS (SELECT *, max(z) OVER (PARTITION BY doc_id) AS zm FROM NZ),
NQ AS (SELECT doc_id, list(z ORDER BY c) AS z, list(exp(z - zm) / (es) ORDER BY c) AS p
       FROM (SELECT *, sum(exp(z - zm)) OVER (PARTITION BY doc_id) AS es FROM NM) GROUP BY doc_id)""") + """
SELECT doc_id, ['negative', 'neutral', 'positive'][list_position(z, list_max(z))] AS prediction,
       round(p[list_position(z, list_max(z))], 6) AS confidence,
       round(p[1], 6) AS score_negative, round(p[2], 6) AS score_neutral, round(p[3], 6) AS score_positive FROM NQ"""

# ---------------------------------------------------------------------------
# stage 4: metrics over P
# ---------------------------------------------------------------------------
P_WITH = "WITH " + text_p_ctes(42) + "," + confusion_cte().strip("\n") + "\n"
NAMES = "['negative', 'neutral', 'positive']"

ORACLE["confusion_long"] = P_WITH + """
SELECT model_id, split, label, pred, n_cell AS n FROM CM"""

ORACLE["confusion_wide"] = P_WITH + """
SELECT model_id, split, label,
       CAST(sum(n_cell) FILTER (WHERE pred = 0) AS BIGINT) AS pred_0,
       CAST(sum(n_cell) FILTER (WHERE pred = 1) AS BIGINT) AS pred_1,
       CAST(sum(n_cell) FILTER (WHERE pred = 2) AS BIGINT) AS pred_2, CAST(0 AS BIGINT) AS pred_other
FROM CM GROUP BY model_id, split, label"""

ORACLE["classification_report"] = P_WITH + f"""
SELECT model_id, split, {NAMES}[class + 1] AS row_name, round(prec, 6) AS precision,
       round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM PCF
UNION ALL
SELECT model_id, split, 'accuracy', NULL, NULL, round(accuracy, 6), n FROM SUMM
UNION ALL
SELECT model_id, split, 'macro avg', round(macro_precision, 6), round(macro_recall, 6),
       round(macro_f1, 6), n FROM SUMM
UNION ALL
SELECT model_id, split, 'weighted avg', round(weighted_precision, 6), round(weighted_recall, 6),
       round(weighted_f1, 6), n FROM SUMM"""

ORACLE["macro_f1"] = P_WITH + """
SELECT model_id, split, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, n FROM SUMM"""

# ids outside the domain and NULLs: straight counts, no grid
DAMAGED = "WITH " + text_p_ctes(42) + """,
PK AS (SELECT *, substr(md5('ood:' || CAST(doc_id AS VARCHAR)), 1, 1) AS k FROM P WHERE model_id = 'fixed_s42'),
PD AS (SELECT model_id, split,
              CAST(CASE WHEN k = '0' THEN 5 WHEN k <> '1' THEN label END AS INTEGER) AS label,
              CAST(CASE WHEN k IN ('0', '2') THEN 7 WHEN k <> '3' THEN pred END AS INTEGER) AS pred,
              CASE WHEN k <> '4' THEN lang END AS lang FROM PK)
"""

ORACLE["confusion_out_of_domain"] = DAMAGED + """
SELECT model_id, split, label, pred, count(*) AS n FROM PD GROUP BY ALL"""

ORACLE["macro_f1_null_group"] = DAMAGED + """
, G AS (SELECT coalesce(lang, '<none>') AS g, lang, label, pred FROM PD),
CL AS (SELECT g, label AS c FROM G WHERE label IS NOT NULL UNION SELECT g, pred FROM G WHERE pred IS NOT NULL),
ST AS (SELECT CL.g, CL.c,
              count(*) FILTER (WHERE G.label = CL.c) AS sup, count(*) FILTER (WHERE G.pred = CL.c) AS prd,
              count(*) FILTER (WHERE G.label = CL.c AND G.pred = CL.c) AS tp
       FROM CL JOIN G ON G.g = CL.g GROUP BY CL.g, CL.c),
MF AS (SELECT g, avg(CASE WHEN tp = 0 THEN 0.0::DOUBLE
                          ELSE 2 * (tp::DOUBLE / prd) * (tp::DOUBLE / sup) / (tp::DOUBLE / prd + tp::DOUBLE / sup) END) AS f
       FROM ST GROUP BY g),
NN AS (SELECT g, any_value(lang) AS lang, count(*) AS n,
              sum(CASE WHEN label = pred THEN 1 ELSE 0 END)::DOUBLE / count(*) AS acc FROM G GROUP BY g)
SELECT NN.lang, round(f, 6) AS macro_f1, round(acc, 6) AS accuracy, CAST(n AS BIGINT) AS n FROM NN JOIN MF USING (g)"""

ORACLE["paired_compare"] = P_WITH + """
, PW AS (SELECT a.split, a.label, a.pred AS pred_a, b.pred AS pred_b
         FROM P a JOIN P b ON a.doc_id = b.doc_id AND a.model_id = 'fixed_s42' AND b.model_id = 'nb')
SELECT split, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN pred_a = label AND pred_b = label THEN 1 ELSE 0 END) AS BIGINT) AS both_right,
       CAST(sum(CASE WHEN pred_a = label AND pred_b <> label THEN 1 ELSE 0 END) AS BIGINT) AS only_a,
       CAST(sum(CASE WHEN pred_a <> label AND pred_b = label THEN 1 ELSE 0 END) AS BIGINT) AS only_b,
       CAST(sum(CASE WHEN pred_a <> label AND pred_b <> label THEN 1 ELSE 0 END) AS BIGINT) AS both_wrong,
       CAST(sum(CASE WHEN pred_a = pred_b THEN 1 ELSE 0 END) AS BIGINT) AS agree
FROM PW GROUP BY split"""

ORACLE["lift"] = P_WITH + """
, F AS (SELECT model_id, split, round(macro_f1, 6) AS macro_f1 FROM SUMM),
W AS (SELECT split, max(macro_f1) FILTER (WHERE model_id = 'fixed_s42') AS base_f1,
             max(macro_f1) FILTER (WHERE model_id = 'nb') AS adapted_f1 FROM F GROUP BY split)
SELECT split, base_f1, adapted_f1, round(adapted_f1 - base_f1, 6) AS abs_lift,
       round((adapted_f1 - base_f1) / nullif(base_f1, 0) * 100, 6) AS rel_lift_pct FROM W"""

ORACLE["calibration_ece"] = P_WITH + """
, RB AS (SELECT model_id, split, CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin,
                CAST(count(*) AS BIGINT) AS n,
                avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END::DOUBLE) AS accuracy,
                avg(confidence) AS avg_confidence
         FROM P GROUP BY ALL),
RG AS (SELECT *, abs(accuracy - avg_confidence) AS gap FROM RB),
RE AS (SELECT *, sum(n * gap) OVER (PARTITION BY model_id, split)
                 / sum(n) OVER (PARTITION BY model_id, split) AS ece FROM RG)
SELECT model_id, split, bin, n, round(accuracy, 6) AS accuracy, round(avg_confidence, 6) AS avg_confidence,
       round(gap, 6) AS gap, round(ece, 6) AS ece FROM RE"""


# ---------------------------------------------------------------------------
# generalised builders: several seeds, embeddings, slices
# ---------------------------------------------------------------------------
NEG_WORDS = "[" + ", ".join(lit(w) for w in (
    "not no never none nobody nothing neither nor cannot ne pas jamais aucun aucune rien personne nicht kein keine "
    "keinen nie niemals nichts niemand weder nunca jamás ningún ninguno ninguna nada nadie tampoco").split()) + "]"


def tok_cte() -> str:
    return f"""
TOK0 AS (SELECT doc_id, split, label, lang, sentence, {tokens_sql('sentence')} AS toks FROM SPLIT),
TOK AS (
  SELECT doc_id, split, label, lang, sentence, {idx_sql('toks', 1024)} AS idx,
         list_filter(['all',
              CASE WHEN len(toks) < 200 THEN 'len_short' WHEN len(toks) < 1000 THEN 'len_medium'
                   ELSE 'len_long' END,
              CASE WHEN list_has_any(toks, {NEG_WORDS}) THEN 'negation' END,
              CASE WHEN len(toks) > 0 AND coalesce(lang, '') <> 'de'
                        AND len(regexp_extract_all(sentence, '\\p{{Lu}}\\p{{Ll}}+')) * 5 >= len(toks)
                   THEN 'entity_heavy' END], lambda x: x IS NOT NULL) AS slices
  FROM TOK0)"""


def in_fit_sql(seed: int, key: str = "doc_id") -> str:
    return unit_sql(f"'fit{seed}:' || CAST({key} AS VARCHAR)") + " < 0.8::DOUBLE"


def text_p_multi(seeds=(42,), nb: bool = True, nb_seeds=(), splits: str = "('test')", nb_where: str = "true") -> str:
    scale = "(1.0::DOUBLE / sqrt(greatest(len(idx), 1)::DOUBLE))"
    cols = "doc_id, split, label, lang, slices, pred, confidence"
    parts = [L.strip("\n"), split_cte("LN", "doc_id").strip("\n"), tok_cte().strip("\n")]
    selects = []
    for s in seeds:
        lg = "[" + ", ".join(f"{fold_sql('idx', f'w{c}')} * {scale}" for c in range(3)) + "]"
        parts.append(weights_cte(f"FW{s}", s, 3, 1024).strip("\n"))
        parts.append(f"FIXL{s} AS (SELECT TOK.*, {lg} AS lg FROM TOK, FW{s} WHERE split IN {splits})")
        parts.append(predicted_cte(f"FIX{s}", f"FIXL{s}").strip("\n"))
        selects.append(f"SELECT 'fixed_s{s}' AS model_id, {cols} FROM FIX{s}")
    models = [("NB", "nb", nb_where)] if nb else []
    models += [(f"NB{s}", f"nb_s{s}", in_fit_sql(s)) for s in nb_seeds]
    nb_lg = "[" + ", ".join(f"{fold_sql('idx', f't{c}')} + p{c}" for c in range(3)) + "]"
    for prefix, name, where in models:
        parts.append(nb_ctes(prefix, "TOK", where=where).strip("\n"))
        parts.append(f"{prefix}L AS (SELECT TOK.*, {nb_lg} AS lg FROM TOK, {prefix}_T WHERE split IN {splits})")
        parts.append(predicted_cte(f"{prefix}P", f"{prefix}L").strip("\n"))
        selects.append(f"SELECT '{name}' AS model_id, {cols} FROM {prefix}P")
    parts.append("P AS (\n  " + "\n  UNION ALL\n  ".join(selects) + ")")
    return ",\n".join(parts)


def emb_p_multi(seeds=(42, 43, 44), n_classes: int = 10, dim: int = 64) -> str:
    parts = [split_cte("embeddings", "vec_id", name="ESPLIT").strip("\n"),
             "EEVAL AS (SELECT * FROM ESPLIT WHERE split IN ('validation', 'test'))"]
    selects = []
    mus = ", ".join(f"any_value(mu) FILTER (WHERE label = {c}) AS m{c}" for c in range(n_classes))
    bs = ", ".join(f"any_value(b) FILTER (WHERE label = {c}) AS b{c}" for c in range(n_classes))
    for s in seeds:
        lg = "[" + ", ".join(dense_fold_sql("embedding", f"w{c}") for c in range(n_classes)) + "]"
        parts.append(weights_cte(f"EW{s}", s, n_classes, dim).strip("\n"))
        parts.append(f"EL{s} AS (SELECT EEVAL.*, {lg} AS lg FROM EEVAL, EW{s})")
        parts.append(predicted_cte(f"EF{s}", f"EL{s}").strip("\n"))
        selects.append(f"SELECT 'fixed_s{s}' AS model_id, vec_id AS doc_id, split, label, pred FROM EF{s}")
        lg = "[" + ", ".join(f"{dense_fold_sql('embedding', f'm{c}')} + b{c}" for c in range(n_classes)) + "]"
        parts.append(f"""
EC{s} AS (SELECT label, j, avg(x::DOUBLE) AS m FROM (
         SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j
         FROM ESPLIT WHERE split = 'train' AND {in_fit_sql(s, 'vec_id')}) GROUP BY label, j),
ECL{s} AS (SELECT label, list(m ORDER BY j) AS mu FROM EC{s} GROUP BY label),
ECB{s} AS (SELECT label, mu,
               -0.5::DOUBLE * list_reduce(list_transform(mu, lambda v: v * v), lambda a, b: a + b, 0.0::DOUBLE)
               AS b FROM ECL{s}),
ECT{s} AS (SELECT {mus}, {bs} FROM ECB{s}),
ECLG{s} AS (SELECT EEVAL.*, {lg} AS lg FROM EEVAL, ECT{s})""".strip("\n"))
        parts.append(predicted_cte(f"ECP{s}", f"ECLG{s}").strip("\n"))
        selects.append(f"SELECT 'centroid_s{s}' AS model_id, vec_id AS doc_id, split, label, pred FROM ECP{s}")
    parts.append("EP AS (\n  " + "\n  UNION ALL\n  ".join(selects) + ")")
    return ",\n".join(parts)


def f1_cte(name: str, src: str, groups: str, n_classes: int) -> str:
    """{name}(groups..., macro_f1, accuracy, n) with the metric contract, prefixed CTEs."""
    p = name
    return f"""
{p}_CELLS AS (SELECT {groups}, label, pred, count(*) AS n FROM {src} GROUP BY {groups}, label, pred),
{p}_CM AS (SELECT g.*, CAST(coalesce(c.n, 0) AS BIGINT) AS n_cell FROM (
             SELECT g.*, CAST(a.range AS INTEGER) AS label, CAST(b.range AS INTEGER) AS pred
             FROM (SELECT DISTINCT {groups} FROM {p}_CELLS) g, range({n_classes}) a, range({n_classes}) b) g
           LEFT JOIN {p}_CELLS c USING ({groups}, label, pred)),
{p}_PC0 AS (
  SELECT {groups}, cls, sum(sup) AS support, sum(tp) AS tp, sum(prd) AS predicted FROM (
    SELECT {groups}, label AS cls, n_cell AS sup, CASE WHEN label = pred THEN n_cell ELSE 0 END AS tp,
           0 AS prd FROM {p}_CM
    UNION ALL
    SELECT {groups}, pred AS cls, 0, 0, n_cell FROM {p}_CM) GROUP BY {groups}, cls),
{p}_PC AS (
  SELECT *, coalesce((2 * prec * rec) / nullif(prec + rec, 0), 0.0) AS f1 FROM (
    SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0)::DOUBLE, 0.0) AS prec,
              coalesce(tp::DOUBLE / nullif(support, 0)::DOUBLE, 0.0) AS rec,
              (support > 0 OR predicted > 0) AS observed FROM {p}_PC0)),
{name} AS (
  SELECT {groups}, round(avg(f1) FILTER (WHERE observed), 6) AS macro_f1,
         round(coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0)::DOUBLE, 0.0), 6) AS accuracy,
         CAST(sum(support) AS BIGINT) AS n
  FROM {p}_PC GROUP BY {groups})"""


def results_sql() -> str:
    """RES: D11 rows for word/emb x eval_only/head_only x seeds 42..44, each a fit of its own."""
    def res(fname: str, backbone: str, head: str, eval_params: int, head_params: int) -> str:
        is_head = f"starts_with(model_id, '{head}_s')"
        return f"""
SELECT '{backbone}_' || CASE WHEN {is_head} THEN 'head_only' ELSE 'eval_only' END AS experiment_id,
       '{backbone}' AS backbone,
       CASE WHEN {is_head} THEN 'head_only' ELSE 'eval_only' END AS method,
       CAST(right(model_id, 2) AS INTEGER) AS seed,
       max(macro_f1) FILTER (WHERE split = 'test') AS test_f1_macro,
       CASE WHEN {is_head} THEN max(macro_f1) FILTER (WHERE split = 'validation') END AS val_f1_macro,
       CAST(CASE WHEN {is_head} THEN {head_params} ELSE 0 END AS BIGINT) AS trainable_params,
       CAST(CASE WHEN {is_head} THEN {head_params} ELSE {eval_params} END AS BIGINT) AS total_params,
       CASE WHEN {is_head} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS trainable_pct
FROM {fname} GROUP BY model_id"""
    return ",\n".join([
        text_p_multi((42, 43, 44), False, nb_seeds=(42, 43, 44), splits="('validation', 'test')"),
        emb_p_multi((42, 43, 44)),
        f1_cte("WF1", "P", "model_id, split", 3).strip("\n"),
        f1_cte("EF1", "EP", "model_id, split", 10).strip("\n"),
        "RES AS (" + res("WF1", "word", "nb", 3 * 1024, 3 * 1024 + 3) + "\nUNION ALL\n"
        + res("EF1", "emb", "centroid", 10 * 64, 10 * 64 + 10) + ")",
    ])


ORACLE["seed_summary"] = "WITH " + results_sql() + """
SELECT experiment_id, CAST(count(test_f1_macro) AS BIGINT) AS n_runs, round(avg(test_f1_macro), 6) AS mean,
       round(stddev_samp(test_f1_macro), 6) AS std, round(min(test_f1_macro), 6) AS min,
       round(max(test_f1_macro), 6) AS max
FROM RES GROUP BY experiment_id"""

ORACLE["rank_methods"] = "WITH " + results_sql() + """
, SM AS (SELECT experiment_id, round(avg(test_f1_macro), 6) AS mean FROM RES GROUP BY experiment_id)
SELECT experiment_id, mean, CAST(rank() OVER (ORDER BY mean DESC NULLS LAST) AS INTEGER) AS rank FROM SM"""

ORACLE["marginal_value"] = "WITH " + results_sql() + """
, BM AS (SELECT backbone, method, round(avg(test_f1_macro), 6) AS mean FROM RES GROUP BY backbone, method),
W AS (SELECT backbone, max(mean) FILTER (WHERE method = 'eval_only') AS base_mean,
             max(mean) FILTER (WHERE method = 'head_only') AS adapted_mean FROM BM GROUP BY backbone)
SELECT backbone, base_mean, adapted_mean, round(adapted_mean - base_mean, 6) AS marginal FROM W"""


def best_epoch_sql(seeds=(42, 43, 44), epochs: int = 3) -> str:
    svals = ", ".join(f"({s})" for s in seeds)
    tcols = ", ".join(f"any_value(tl) FILTER (WHERE label = {c}) AS t{c}" for c in range(3))
    pcols = ", ".join(f"any_value(lp) FILTER (WHERE label = {c}) AS p{c}" for c in range(3))
    lg = "[" + ", ".join(f"{fold_sql('idx', f't{c}')} + p{c}" for c in range(3)) + "]"
    return "WITH " + ",\n".join([L.strip("\n"), split_cte("LN", "doc_id").strip("\n"), tok_cte().strip("\n"), f"""
MEM AS (SELECT s.seed, e.range AS epoch, t.label, t.idx
        FROM TOK t, (VALUES {svals}) s(seed), range(1, {epochs + 1}) e
        WHERE t.split = 'train'
          AND {unit_sql("CAST(s.seed AS VARCHAR) || ':' || CAST(t.doc_id AS VARCHAR)")}
              < e.range::DOUBLE / {float(epochs)}::DOUBLE),
LC AS (SELECT seed, epoch, label, i, count(*) AS n FROM (
         SELECT seed, epoch, label, unnest(idx) AS i FROM MEM) GROUP BY ALL),
LTOT AS (SELECT seed, epoch, label, sum(n) AS tot FROM LC GROUP BY ALL),
LD AS (SELECT seed, epoch, label, count(*) AS d FROM MEM GROUP BY ALL),
LTH AS (
  SELECT g.seed, g.epoch, g.c AS label,
         list(ln((coalesce(n.n, 0) + 1.0::DOUBLE) / (coalesce(t.tot, 0) + 1024.0::DOUBLE)) ORDER BY g.j) AS tl
  FROM (SELECT s.seed, e.range AS epoch, c.range AS c, j.range AS j
        FROM (VALUES {svals}) s(seed), range(1, {epochs + 1}) e, range(3) c, range(1024) j) g
  LEFT JOIN LC n ON n.seed = g.seed AND n.epoch = g.epoch AND n.label = g.c AND n.i = g.j
  LEFT JOIN LTOT t ON t.seed = g.seed AND t.epoch = g.epoch AND t.label = g.c
  GROUP BY g.seed, g.epoch, g.c),
LPR AS (SELECT seed, epoch, label, ln(d::DOUBLE / (sum(d) OVER (PARTITION BY seed, epoch))::DOUBLE) AS lp
        FROM LD),
LT AS (SELECT a.seed, a.epoch, a.t0, a.t1, a.t2, b.p0, b.p1, b.p2 FROM
        (SELECT seed, epoch, {tcols} FROM LTH GROUP BY seed, epoch) a
        JOIN (SELECT seed, epoch, {pcols} FROM LPR GROUP BY seed, epoch) b USING (seed, epoch)),
VL AS (SELECT t.doc_id, t.label, LT.seed, LT.epoch, {lg} AS lg
       FROM (SELECT * FROM TOK WHERE split = 'validation') t, LT)""", predicted_cte("VP", "VL").strip("\n"),
        f1_cte("LF1", "VP", "seed, epoch", 3).strip("\n")]) + """
SELECT 'word_head_only_seed' || seed AS run, CAST(epoch AS INTEGER) AS best_epoch, macro_f1 AS best_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY macro_f1 DESC, epoch) AS r FROM LF1) WHERE r = 1"""


ORACLE["learning_curve"] = best_epoch_sql()


# ---------------------------------------------------------------------------
# the trainer: every step as a join, a softmax and a grouped sum over long rows
# ---------------------------------------------------------------------------
def trainer_ctes(rows: str, feats: str, n_classes: int, dim: int, p: str = "T", rank: int = 0, seeds=(42, 43, 44), epochs: int = 3,
                 steps: int = 4, rate: float = 0.5, momentum: float = 0.9, decay: float = 1e-4) -> str:
    """CTEs from ``rows`` (key, split, label) and ``feats`` (key, i, x): {p}EV (seed, epoch, key, split, label, pred,
    p_label) after each pass, {p}LOG (seed, epoch, n_train, train_loss, macro_f1) and {p}BEST (seed, epoch, macro_f1).
    With a ``rank`` the trained numbers are two factors and the bias beside a frozen head."""
    svals = ", ".join(f"({s})" for s in seeds)
    seeded = lambda name, a, b: unit_sql(f"'{name}:' || seed || ':' || {a} || ':' || {b}") + " - 0.5::DOUBLE"
    move = lambda g: f"{momentum}::DOUBLE * v + {g} + {decay}::DOUBLE * w"
    first = f"CASE WHEN i = {dim} THEN 0.0::DOUBLE ELSE 0.02::DOUBLE * ({seeded('w', 'c', 'i')}) END"
    parts = [f"""
{p}R AS MATERIALIZED (SELECT key, split, label, CAST((('0x' || substr(md5('step:' || CAST(key AS VARCHAR)), 1, 8))::BIGINT) % {steps}
                                                     AS INTEGER) AS bucket FROM {rows}),
{p}F AS MATERIALIZED (SELECT key, i, x FROM {feats} UNION ALL SELECT key, {dim}, 1.0::DOUBLE FROM {p}R),
{p}N AS (SELECT label, count(*) AS n FROM {p}R WHERE split = 'train' GROUP BY label),
{p}CW AS MATERIALIZED (SELECT label, (sum(n) OVER ())::DOUBLE / ((count(*) OVER ()) * n)::DOUBLE AS w FROM {p}N),
{p}W0 AS MATERIALIZED (
  SELECT seed, c, i, {first} AS w, 0.0::DOUBLE AS v
  FROM (SELECT s.seed, a.range AS c, b.range AS i FROM (VALUES {svals}) s(seed), range({n_classes}) a, range({dim + 1}) b))"""]
    if rank:
        parts.append(f"""
{p}A0 AS MATERIALIZED (SELECT seed, i, k, {seeded('a', 'i', 'k')} AS w, 0.0::DOUBLE AS v
  FROM (SELECT s.seed, a.range AS i, b.range AS k FROM (VALUES {svals}) s(seed), range({dim}) a, range({rank}) b)),
{p}B0 AS MATERIALIZED (SELECT s.seed, a.range AS c, b.range AS k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v
  FROM (VALUES {svals}) s(seed), range({n_classes}) a, range({rank}) b),
{p}C0 AS MATERIALIZED (SELECT s.seed, a.range AS c, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM (VALUES {svals}) s(seed), range({n_classes}) a)""")
    softmax = "exp(z - zm) / sum(exp(z - zm)) OVER (PARTITION BY seed, key)"
    evals = []
    for k in range(1, epochs * steps + 1):
        bucket = (k - 1) % steps
        parts.append(f"""
{p}Z{k} AS (SELECT w.seed, f.key, w.c, sum(f.x * w.w) AS z
          FROM {p}F f JOIN {p}R r ON r.key = f.key AND r.split = 'train' AND r.bucket = {bucket}
          JOIN {p}W{k - 1} w ON w.i = f.i GROUP BY w.seed, f.key, w.c),
{p}P{k} AS (SELECT seed, key, c, {softmax} AS p FROM (SELECT *, max(z) OVER (PARTITION BY seed, key) AS zm FROM {p}Z{k})),
{p}T{k} AS (SELECT sum(cw.w) AS t FROM {p}R r JOIN {p}CW cw ON cw.label = r.label WHERE r.split = 'train' AND r.bucket = {bucket}),
{p}G{k} AS MATERIALIZED (SELECT p.seed, p.c, f.i, sum(cw.w * (p.p - CASE WHEN r.label = p.c THEN 1 ELSE 0 END) * f.x) / any_value(t) AS g
          FROM {p}P{k} p JOIN {p}R r ON r.key = p.key JOIN {p}CW cw ON cw.label = r.label JOIN {p}F f ON f.key = p.key CROSS JOIN {p}T{k}
          GROUP BY p.seed, p.c, f.i)""")
        if not rank:
            parts.append(f"""
{p}W{k} AS MATERIALIZED (
  SELECT seed, c, i, w - {rate}::DOUBLE * v2 AS w, v2 AS v FROM (
    SELECT seed, c, i, w, CASE WHEN t IS NULL THEN 0.0 ELSE {move('coalesce(g, 0.0)')} END AS v2
    FROM {p}W{k - 1} CROSS JOIN {p}T{k} LEFT JOIN {p}G{k} USING (seed, c, i)))""")
        else:
            step = f"w - {rate}::DOUBLE * v2 AS w, v2 AS v"
            j = k - 1
            parts.append(f"""
{p}A{k} AS MATERIALIZED (SELECT seed, i, k, {step} FROM (
  SELECT seed, i, k, w, {move('coalesce(g, 0.0)')} AS v2 FROM {p}A{j} LEFT JOIN
    (SELECT b.seed, g.i, b.k, sum(g.g * b.w) AS g FROM {p}G{k} g JOIN {p}B{j} b ON b.seed = g.seed AND b.c = g.c
     GROUP BY b.seed, g.i, b.k) USING (seed, i, k))),
{p}B{k} AS MATERIALIZED (SELECT seed, c, k, {step} FROM (
  SELECT seed, c, k, w, {move('coalesce(g, 0.0)')} AS v2 FROM {p}B{j} LEFT JOIN
    (SELECT a.seed, g.c, a.k, sum(g.g * a.w) AS g FROM {p}G{k} g JOIN {p}A{j} a ON a.seed = g.seed AND a.i = g.i
     GROUP BY a.seed, g.c, a.k) USING (seed, c, k))),
{p}C{k} AS MATERIALIZED (SELECT seed, c, {step} FROM (
  SELECT seed, c, w, {move('coalesce(g, 0.0)')} AS v2 FROM {p}C{j} LEFT JOIN
    (SELECT seed, c, g FROM {p}G{k} WHERE i = {dim}) USING (seed, c))),
{p}W{k} AS MATERIALIZED (
  SELECT o.seed, o.c, o.i, o.w + coalesce(d.w, 0.0) + CASE WHEN o.i = {dim} THEN z.w ELSE 0.0 END AS w
  FROM {p}W0 o JOIN {p}C{k} z USING (seed, c) LEFT JOIN
    (SELECT a.seed, b.c, a.i, sum(a.w * b.w) AS w FROM {p}A{k} a JOIN {p}B{k} b ON a.seed = b.seed AND a.k = b.k
     GROUP BY a.seed, b.c, a.i) d ON d.seed = o.seed AND d.c = o.c AND d.i = o.i)""")
        if k % steps == 0:
            parts.append(f"""
{p}E{k} AS (SELECT w.seed, f.key, w.c, sum(f.x * w.w) AS z FROM {p}F f JOIN {p}W{k} w ON w.i = f.i GROUP BY w.seed, f.key, w.c)""")
            evals.append(f"SELECT {k // steps} AS epoch, seed, key, list(z ORDER BY c) AS z FROM {p}E{k} GROUP BY seed, key")
    parts.append(f"\n{p}ZS AS (" + " UNION ALL ".join(evals) + ")")
    parts.append(f"""
{p}EV AS MATERIALIZED (
  SELECT seed, epoch, key, split, label, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred,
         exp(z[label + 1] - list_max(z)) / list_sum(list_transform(z, lambda q: exp(q - list_max(z)))) AS p_label
  FROM {p}ZS JOIN {p}R USING (key)),
{p}LOSS AS (SELECT seed, epoch, count(*) AS n_train, sum(-ln(p_label) * w) / sum(w) AS train_loss
          FROM {p}EV JOIN {p}CW USING (label) WHERE split = 'train' GROUP BY seed, epoch),
{p}VAL AS (SELECT * FROM {p}EV WHERE split = 'validation')""")
    parts.append(f1_cte(f"{p}F1", f"{p}VAL", "seed, epoch", n_classes))
    parts.append(f"""
{p}LOG AS (SELECT seed, epoch, n_train, train_loss, macro_f1 FROM {p}LOSS JOIN {p}F1 USING (seed, epoch)),
{p}BEST AS (SELECT seed, epoch, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY macro_f1 DESC, epoch) AS r FROM {p}LOG) WHERE r = 1)""")
    return ",".join(x.strip("\n") for x in parts)


TEXT_TRAINER = with_(L, split_cte("LN", "doc_id"), f"""
TX AS (SELECT doc_id AS key, split, label, {tokens_sql('sentence')} AS toks FROM SPLIT),
TXI AS (SELECT key, len(toks) AS n, unnest({idx_sql('toks', 1024)}) AS i FROM TX),
TXF AS (SELECT key, i, count(*)::DOUBLE / sqrt(any_value(n)::DOUBLE) AS x FROM TXI GROUP BY key, i)""",
                     trainer_ctes("TX", "TXF", 3, 1024))

ORACLE["best_epoch"] = TEXT_TRAINER + """
SELECT 'word_head_only_seed' || seed AS run, CAST(epoch AS INTEGER) AS best_epoch, macro_f1 AS best_f1 FROM TBEST"""

ORACLE["epoch_log"] = TEXT_TRAINER + """
SELECT 'word_head_only_seed' || seed AS run, CAST(epoch AS INTEGER) AS epoch, CAST(n_train AS BIGINT) AS n_train,
       round(train_loss, 6) AS train_loss, macro_f1 AS f1_macro FROM TLOG"""

ORACLE["user_metric"] = P_WITH + """
, MT AS (SELECT model_id, split, label AS c, count(*) AS t, 0 AS p, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS h
         FROM P GROUP BY ALL UNION ALL SELECT model_id, split, pred, 0, count(*), 0 FROM P GROUP BY ALL),
MC AS (SELECT model_id, split, c, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(h)::DOUBLE AS h FROM MT GROUP BY ALL),
MS AS (SELECT model_id, split, sum(t) AS n, sum(h) AS h, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp FROM MC GROUP BY ALL)
SELECT model_id, split, round(CASE WHEN (n * n - tt) * (n * n - pp) = 0 THEN 0.0
                                   ELSE (h * n - tp) / sqrt((n * n - tt) * (n * n - pp)) END, 6) AS mcc FROM MS"""

ORACLE["param_budget"] = f"""
WITH TK AS (SELECT DISTINCT lang, token FROM (
              SELECT lang, unnest({tokens_sql('text')}) AS token FROM documents)),
PARAMS AS (
  SELECT 'word_' || lang AS model_id, 'embeddings.word.' || md5(token) AS name, 64 AS numel FROM TK
  UNION ALL
  SELECT 'word_' || l.lang, h.name, h.numel
  FROM (SELECT DISTINCT lang FROM documents) l,
       (VALUES ('pre_classifier.weight', 4096), ('pre_classifier.bias', 64),
               ('classifier.weight', 192), ('classifier.bias', 3)) h(name, numel)),
PT AS (SELECT *, (contains(name, 'classifier') OR contains(name, 'pre_classifier') OR contains(name, 'score'))
                 AS trainable FROM PARAMS),
AG AS (SELECT model_id, CAST(count(*) AS BIGINT) AS n_tensors,
              CAST(coalesce(sum(numel) FILTER (WHERE trainable), 0) AS BIGINT) AS trainable_params,
              CAST(coalesce(sum(numel), 0) AS BIGINT) AS total_params FROM PT GROUP BY model_id)
SELECT *, total_params - trainable_params AS frozen_params,
       CASE WHEN total_params = 0 THEN 0.0::DOUBLE
            ELSE ((trainable_params::HUGEINT * 20000 + total_params) // (total_params::HUGEINT * 2))::DOUBLE
                 / 100.0::DOUBLE END AS trainable_pct
FROM AG"""

P42 = "WITH " + text_p_multi((42,), True)

ORACLE["slice_report"] = P42 + """,
PS AS (SELECT model_id, label, pred, unnest(slices) AS slice FROM P WHERE split = 'test'),""" + \
    f1_cte("SF1", "PS", "model_id, slice", 3).strip("\n") + """
SELECT model_id, slice, macro_f1, accuracy, n FROM SF1"""

ORACLE["domain_shift"] = "WITH " + text_p_multi((42,), True, nb_where="lang = 'en'") + """,
""" + f1_cte("DF1", "P", "model_id, lang", 3).strip("\n") + """
, W AS (SELECT lang, max(macro_f1) FILTER (WHERE model_id = 'fixed_s42') AS base_f1,
             max(macro_f1) FILTER (WHERE model_id = 'nb') AS adapted_f1 FROM DF1 GROUP BY lang)
SELECT lang, lang = 'en' AS in_domain, base_f1, adapted_f1, round(adapted_f1 - base_f1, 6) AS delta FROM W"""

GOLD = unit_sql("'golden:' || CAST(doc_id AS VARCHAR)") + " < 0.25::DOUBLE"
ORACLE["gate_report"] = P42 + f""",
PG AS (SELECT 'gold' AS s, label, pred FROM P WHERE model_id = 'nb' AND {GOLD}),
""" + f1_cte("GF1", "P", "model_id, split", 3).strip("\n") + ",\n" + f1_cte("GG1", "PG", "s", 3).strip("\n") + """
, W AS (SELECT max(macro_f1) FILTER (WHERE model_id = 'fixed_s42') AS base_f1,
             max(macro_f1) FILTER (WHERE model_id = 'nb') AS adapted_f1 FROM GF1 WHERE split = 'test')
SELECT 'abs_lift' AS gate, round(adapted_f1 - base_f1, 6)::DOUBLE AS value, 0.15::DOUBLE AS threshold,
       coalesce(round(adapted_f1 - base_f1, 6) >= 0.15, false) AS passed FROM W
UNION ALL
SELECT 'golden_f1', macro_f1::DOUBLE, 0.5::DOUBLE, coalesce(macro_f1 >= 0.5, false) FROM GG1
UNION ALL
SELECT 'trainable_pct', 100.0::DOUBLE, 5.0::DOUBLE, false"""


def stream_score_sql(seed: int = 42) -> str:
    scale = "(1.0::DOUBLE / sqrt(greatest(len(idx), 1)::DOUBLE))"
    lg = "[" + ", ".join(f"{fold_sql('idx', f'w{c}')} * {scale}" for c in range(3)) + "]"
    return with_(f"""
DT AS (SELECT doc_id, {idx_sql(tokens_sql('text'), 1024)} AS idx FROM documents)""",
                 weights_cte("SW", seed, 3, 1024), f"""
SL AS (SELECT DT.*, {lg} AS lg FROM DT, SW)""", predicted_cte("SP", "SL")) + """
SELECT doc_id, pred, round(confidence, 6) AS confidence FROM SP"""


ORACLE["stream_score"] = stream_score_sql()


ORACLE["split_test_partition"] = with_(L, split_cte("LN", "doc_id")) + """
SELECT doc_id, label, split FROM SPLIT WHERE split = 'test'"""


# ---------------------------------------------------------------------------
# training, ladder, artifacts: what is the same in every run
# ---------------------------------------------------------------------------
def emb_train_sql(trainable: str, frozen: int) -> str:
    return with_(split_cte("embeddings", "vec_id")) + f"""
, K AS (SELECT max(label) + 1 AS c FROM embeddings)
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(any_value({trainable}) AS BIGINT) AS trainable_params,
       CAST(any_value({trainable}) + {frozen} AS BIGINT) AS total_params, true AS beats_majority
FROM SPLIT, K GROUP BY split"""


ORACLE["head_only_train"] = with_(split_cte("embeddings", "vec_id"), """
EX AS (SELECT vec_id AS key, split, label FROM SPLIT),
EXF AS (SELECT vec_id AS key, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM SPLIT)""",
                                  trainer_ctes("EX", "EXF", 10, 64), """
EBEST AS (SELECT TEV.* FROM TEV JOIN TBEST USING (seed, epoch))""", f1_cte("EBF", "EBEST", "seed, epoch, split", 10)) + """
SELECT 'seed' || seed AS run, split, CAST(epoch AS INTEGER) AS best_epoch, n, macro_f1, accuracy,
       CAST(10 * 65 AS BIGINT) AS trainable_params, CAST(10 * 65 AS BIGINT) AS total_params FROM EBF"""
ORACLE["rank_r_train"] = with_(split_cte("embeddings", "vec_id"), """
EX AS (SELECT vec_id AS key, split, label FROM SPLIT),
EXF AS (SELECT vec_id AS key, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM SPLIT)""",
                               trainer_ctes("EX", "EXF", 10, 64, rank=2), """
EBEST AS (SELECT TEV.* FROM TEV JOIN TBEST USING (seed, epoch))""", f1_cte("EBF", "EBEST", "seed, epoch, split", 10)) + """
SELECT 'seed' || seed AS run, split, CAST(epoch AS INTEGER) AS best_epoch, n, macro_f1, accuracy,
       CAST(64 * 2 + 10 * 2 + 10 AS BIGINT) AS trainable_params, CAST(64 * 2 + 10 * 2 + 10 + 640 AS BIGINT) AS total_params FROM EBF"""


def trained_ladder_sql() -> str:
    """LR: a row per experiment and seed, as the grid's results file has it."""
    grams = "list_transform(range(1, greatest(length(s) - 1, 1)), lambda q: substr(s, q, 3))"
    parts = [L.strip("\n"), split_cte("LN", "doc_id").strip("\n"), f"""
GT AS (SELECT doc_id AS key, split, label, {tokens_sql('sentence')} AS word,
              ' ' || regexp_replace(lower(sentence), {SPLIT_RE}, ' ', 'g') || ' ' AS s FROM SPLIT),
GW AS (SELECT key, split, label, word AS toks FROM GT),
GC AS (SELECT key, split, CASE label WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS label, {grams} AS toks FROM GT)""".strip("\n")]
    selects = []
    for src, backbone in (("GW", "word_tf"), ("GC", "char3_tf")):
        parts.append(f"""
{src}I AS (SELECT key, len(toks) AS n, unnest({idx_sql('toks', 1024)}) AS i FROM {src}),
{src}F AS MATERIALIZED (SELECT key, i, count(*)::DOUBLE / sqrt(any_value(n)::DOUBLE) AS x FROM {src}I GROUP BY key, i),
{src}0W AS (SELECT seed, c, i, {unit_sql("'w:' || seed || ':' || c || ':' || i")} - 0.5::DOUBLE AS w
           FROM (SELECT s.seed, a.range AS c, b.range AS i FROM (VALUES (42), (43), (44)) s(seed), range(3) a, range(1024) b)),
{src}0Z AS (SELECT w.seed, r.key, w.c, sum(coalesce(f.x, 0.0) * w.w) AS z
           FROM {src} r LEFT JOIN {src}F f USING (key) JOIN {src}0W w ON w.i = coalesce(f.i, 0) WHERE r.split = 'test' GROUP BY w.seed, r.key, w.c),
{src}0P AS (SELECT seed, key, CAST(list_position(list(z ORDER BY c), max(z)) - 1 AS INTEGER) AS pred FROM {src}0Z GROUP BY seed, key),
{src}0V AS (SELECT seed, label, pred FROM {src}0P JOIN {src} USING (key))""".strip("\n"))
        parts.append(f1_cte(f"{src}0F", f"{src}0V", "seed", 3).strip("\n"))
        selects.append(f"SELECT '{backbone}' AS backbone, 'eval_only' AS method, seed, CAST(NULL AS INTEGER) AS epoch, macro_f1 AS test_f1, "
                       f"CAST(NULL AS DOUBLE) AS val_f1, 0 AS t, 3 * 1024 AS n FROM {src}0F")
        for p, method, rank, t, n in ((f"{src}H", "head_only", 0, 3 * 1025, 3 * 1025),
                                      (f"{src}L", "rank_r", 2, 1024 * 2 + 3 * 2 + 3, 1024 * 2 + 3 * 2 + 3 + 3 * 1024)):
            parts.append(trainer_ctes(src, f"{src}F", 3, 1024, p=p, rank=rank))
            parts.append(f"{p}TST AS (SELECT e.* FROM {p}EV e JOIN {p}BEST b USING (seed, epoch) WHERE e.split = 'test')")
            parts.append(f1_cte(f"{p}TF", f"{p}TST", "seed, epoch", 3).strip("\n"))
            selects.append(f"SELECT '{backbone}', '{method}', seed, epoch, f.macro_f1, b.macro_f1, {t}, {n} FROM {p}TF f JOIN {p}BEST b USING (seed, epoch)")
    parts.append("LR AS (SELECT *, backbone || '_' || method AS experiment_id FROM (" + "\n UNION ALL ".join(selects) + "))")
    return "WITH " + ",\n".join(parts)


ORACLE["trained_ladder"] = trained_ladder_sql() + """
SELECT experiment_id, backbone, method, CAST(seed AS INTEGER) AS seed, CAST(epoch AS INTEGER) AS best_epoch, test_f1 AS test_f1_macro,
       val_f1 AS val_f1_macro, CAST(t AS BIGINT) AS trainable_params, CAST(n AS BIGINT) AS total_params,
       round(100.0::DOUBLE * t / n, 2) AS trainable_pct,
       CASE WHEN method <> 'eval_only' THEN experiment_id || '_seed' || seed END AS output_dir
FROM LR"""

ORACLE["trained_ladder_summary"] = trained_ladder_sql() + """
, LM AS (SELECT experiment_id, any_value(backbone) AS backbone, CAST(count(test_f1) AS BIGINT) AS n_runs, round(avg(test_f1), 6) AS mean,
                round(stddev_samp(test_f1), 6) AS std, round(min(test_f1), 6) AS min, round(max(test_f1), 6) AS max,
                any_value(t) AS t, any_value(n) AS n FROM LR GROUP BY experiment_id),
LB AS (SELECT backbone AS b, mean AS base FROM LM WHERE ends_with(experiment_id, 'eval_only'))
SELECT experiment_id, n_runs, mean, std, min, max, round(mean - base, 6) AS lift, 42 AS split_seed, 3 AS epochs,
       format('{:,}', t) AS trainable_text, format('{:,}', n) AS total_text,
       format('{:.2f}%', round(100.0::DOUBLE * t / n, 2)) AS pct_text, format('{:.4f}', mean) AS mean_text,
       CASE WHEN base = 0 THEN 'n/a' ELSE format('{:+.1f}%', (mean - base) / base * 100) END AS lift_text
FROM LM JOIN LB ON LB.b = LM.backbone"""

ORACLE["reload_parity"] = with_(split_cte("embeddings", "vec_id")) + """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_diff FROM SPLIT WHERE split = 'test'"""

ORACLE["score_text_reloaded"] = """
SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_bad_sums
FROM documents d ANTI JOIN labels l USING (doc_id)"""

ORACLE["ladder_results"] = """
SELECT b || '_' || m AS experiment_id, b AS backbone, m AS method, CAST(s AS INTEGER) AS seed,
       CAST(t AS BIGINT) AS trainable_params, CAST(n AS BIGINT) AS total_params,
       CASE m WHEN 'eval_only' THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * t / n, 2) END AS trainable_pct,
       CASE WHEN m <> 'eval_only' THEN b || '_' || m || '_seed' || s END AS output_dir,
       true AS has_test_f1, m <> 'eval_only' AS has_val_f1
FROM (VALUES ('word_tfidf'), ('char3_tfidf')) x(b),
     (VALUES ('eval_only', 0, 3 * 1024), ('head_only', 3 * 1024 + 3, 3 * 1024 + 3 + 1024),
             ('rank_r', 3 * 8 + 3, 3 * 8 + 3 + 1024 + 1024 * 8)) y(m, t, n),
     (VALUES (42), (43), (44)) z(s)"""

ORACLE["ladder_summary"] = """
SELECT b || '_' || m AS experiment_id, CAST(3 AS BIGINT) AS n_runs, true AS min_ok, true AS max_ok, true AS has_std
FROM (VALUES ('word_tfidf'), ('char3_tfidf')) x(b), (VALUES ('eval_only'), ('head_only'), ('rank_r')) y(m)"""

ORACLE["artifact_manifest"] = with_(split_cte("embeddings", "vec_id")) + """
SELECT 'splits/split=' || split AS folder, true AS has_bytes, CAST(count(*) AS BIGINT) AS n_rows FROM SPLIT GROUP BY split
UNION ALL SELECT 'head_only', true, NULL UNION ALL SELECT 'rank_r', true, NULL"""

CONFIG = ('{"features":"word_hash_1024","head":"naive_bayes","split_seed":42,'
          '"test_of_holdout_pct":50,"train_pct":70}')
ORACLE["registry_row"] = with_(L, split_cte("LN", "doc_id")) + f"""
SELECT split, count(*) AS n_rows,
       CAST(sum(CAST(('0x' || substr(md5('=' || CAST(doc_id AS VARCHAR) || '|=' || sentence || '|=' || CAST(label AS VARCHAR)),
                                     1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS data_hash,
       sha256('{CONFIG}') AS config_hash, 'v-' || substr(sha256('{CONFIG}'), 1, 12) AS version, 'pending' AS approver
FROM SPLIT GROUP BY split"""

ORACLE["latency_p95"] = """
SELECT lang, CAST(3 AS BIGINT) AS runs, count(*) AS rows_per_run, 3 * count(*) AS rows, true AS ordered
FROM documents WHERE lang IS NOT NULL GROUP BY lang"""

ORACLE["registry_approved"] = with_(L, split_cte("LN", "doc_id")) + """
, TL AS (SELECT lang, count(*) AS n, sum(label) AS s, row_number() OVER (ORDER BY lang) AS k FROM SPLIT WHERE split = 'train' GROUP BY lang),
TM AS (SELECT *, count(*) OVER () AS c, n > avg(n) OVER () AS more FROM TL)
SELECT lang, CAST(CASE WHEN more THEN c + k ELSE k END AS BIGINT) AS version,
       CASE WHEN more THEN 'second' ELSE 'first' END AS approver, n AS n_rows, CAST(s AS BIGINT) AS labels,
       CAST(CASE WHEN more THEN 1 ELSE 0 END AS INTEGER) AS round FROM TM"""

_SCALE = "(1.0::DOUBLE / sqrt(greatest(len(idx), 1)::DOUBLE))"
_FIXED = "[" + ", ".join(f"{fold_sql('idx', f'w{c}')} * {_SCALE}" for c in range(3)) + "]"
ORACLE["stream_metrics"] = with_(L, f"""
AR AS (SELECT doc_id, label, {idx_sql(tokens_sql('sentence'), 1024)} AS idx,
              (doc_id * 4) // ((SELECT max(doc_id) FROM L) + 1)
              + CASE WHEN substr(md5('late:' || CAST(doc_id AS VARCHAR)), 1, 1) = '0' THEN 1 ELSE 0 END AS landing
       FROM L)""", weights_cte("AW", 42, 3, 1024), f"""
AL AS (SELECT AR.*, {_FIXED} AS lg FROM AR, AW)""", predicted_cte("AP", "AL"), """
-- minutes: a row is dropped if its window ends at or before the latest time of earlier landings less the delay
WM AS (SELECT landing, max(max(doc_id)) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 30 AS mark
       FROM AR GROUP BY landing),
KEPT AS (SELECT strftime(make_timestamp((1704067200 + (doc_id // 60) * 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS window_start,
                label, pred
         FROM AP JOIN WM USING (landing) WHERE mark IS NULL OR (doc_id // 60 + 1) * 60 > mark)""",
                                f1_cte("SMF", "KEPT", "window_start", 3)) + """
SELECT window_start, macro_f1, accuracy, n FROM SMF"""

ORACLE["read_corpus_files"] = with_(L, f"""
AG AS (SELECT doc_id, label_name, {ONE_LINE} AS body, {unit_sql("'agree:' || CAST(doc_id AS VARCHAR)")} AS u,
              substr(md5('file:' || CAST(doc_id AS VARCHAR)), 1, 1) AS k FROM LN),
SUB AS (SELECT 'all' AS agreement, * FROM AG WHERE u < 0.40 UNION ALL SELECT '66', * FROM AG WHERE u < 0.85),
LN2 AS (SELECT agreement, doc_id, CASE WHEN k = '0' THEN 'a' || chr(0) || 'b ' || body ELSE body END AS body, k, label_name
        FROM SUB),
LINES AS (SELECT agreement || '/' || doc_id AS doc_id, unnest(CASE k WHEN '1' THEN ['', body || '@' || label_name]
                                    WHEN '2' THEN [body, body || '@' || label_name]
                                    ELSE [body || '@' || label_name] END) AS line FROM LN2)""", parse_sql("LINES")) + """
SELECT split_part(doc_id, '/', 1) AS agreement, md5(line) AS line_md5, CAST(length(line) AS BIGINT) AS n_chars,
       CASE WHEN sentence IS NOT NULL THEN md5(sentence) END AS sentence_md5, label, reason FROM PARSED_R"""
