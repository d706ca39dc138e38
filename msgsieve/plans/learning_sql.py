"""The trained regression once more, as SQL that trains it anew.

The regularised optimum is unique, so another solver must come to the same numbers: here
accelerated gradient steps on the coefficients' representation by training rows (a row's
score is its products with them), in a recursive query.  The steps are as many as make the
remaining error smaller than what is compared, by a wide margin, for some hundred rows.
"""

from __future__ import annotations

from msgsieve import fixed_values as fixed
from msgsieve.plans import catalog_sql as base

CLASSES = range(len(fixed.LABELS))
STEPS, MOMENTUM = 3500, 0.98

_MOMENTS = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in fixed.SIGNALS)
_SIGNAL_ROWS = " UNION ALL ".join(
    f"SELECT r, {k} AS idx, ({n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END AS x FROM parts, moments"
    for k, n in enumerate(fixed.SIGNALS)
)

# Features of all documents and their products with the training rows: k1 of terms, k2 of signals.
LEARNING = f"""every AS (SELECT d.doc_id, label, text, {base.clean_sql()} AS text_clean, {base.signal_list()},
    {base.unit32("'42' || text")} / 4294967296.0 AS u
  FROM documents d LEFT JOIN (SELECT doc_id, {base.CLASS} AS label FROM labels) l ON l.doc_id = d.doc_id),
named AS (SELECT *, CASE WHEN label IS NULL OR length(text_clean) = 0 THEN NULL WHEN u < 0.7 THEN 'train'
  WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM every),
parts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY coalesce(split, '') <> 'train', doc_id, text) AS r, * FROM named),
n AS (SELECT count(*) AS n FROM parts WHERE split = 'train'),
toks AS (SELECT r, split, unnest(t) AS tok, generate_subscripts(t, 1) AS pos
  FROM (SELECT r, split, regexp_extract_all(lower(text_clean), '[\\p{{L}}\\p{{N}}_]+') AS t FROM parts)),
tf AS MATERIALIZED (SELECT r, split, term, count(*) AS tf FROM (SELECT r, split, tok AS term FROM toks
  UNION ALL SELECT r, split, tok || ' ' || nxt FROM (SELECT *, lead(tok) OVER (PARTITION BY r ORDER BY pos) AS nxt FROM toks)
  WHERE nxt IS NOT NULL) GROUP BY ALL),
vocab AS MATERIALIZED (SELECT term, ln((1.0::DOUBLE + n.n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf,
    CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx
  FROM n, (SELECT term, count(*) AS df, sum(tf) AS ctf FROM tf, n WHERE split = 'train' GROUP BY term, n.n
    HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * n.n ORDER BY ctf DESC, term LIMIT 5000)),
moments AS MATERIALIZED (SELECT {_MOMENTS} FROM parts WHERE split = 'train'),
x1 AS MATERIALIZED (SELECT r, idx, w / sqrt(sum(w * w) OVER (PARTITION BY r)) AS x
  FROM (SELECT r, idx, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term))),
x2 AS MATERIALIZED ({_SIGNAL_ROWS}),
products AS (SELECT r, i, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2
  FROM (SELECT p.r, t.r AS i FROM parts p, parts t WHERE t.split = 'train')
  LEFT JOIN (SELECT a.r, b.r AS i, sum(a.x * b.x) AS s1 FROM x1 a JOIN x1 b USING (idx), n WHERE b.r <= n.n GROUP BY ALL) USING (r, i)
  LEFT JOIN (SELECT a.r, b.r AS i, sum(a.x * b.x) AS s2 FROM x2 a JOIN x2 b USING (idx), n WHERE b.r <= n.n GROUP BY ALL) USING (r, i)),
kernel AS MATERIALIZED (SELECT r, list(s1 ORDER BY i) AS k1, list(s2 ORDER BY i) AS k2 FROM products GROUP BY r),
weights AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM parts WHERE split = 'train' GROUP BY label),
gram AS MATERIALIZED (SELECT r AS i, label, weight::DOUBLE AS weight, k1, k2
  FROM kernel JOIN parts USING (r) JOIN weights USING (label) WHERE split = 'train'),
-- no eigenvalue of a matrix is above its largest row sum of absolute values
rates AS MATERIALIZED (SELECT 1.0 / (1.0 + max(l1)) AS eta1, 1.0 / (1.0 + max(l2)) AS eta2 FROM (
  SELECT list_sum(list_transform(k1, lambda v: abs(v))) * max(weight) OVER () AS l1,
    (list_sum(list_transform(k2, lambda v: abs(v))) + len(k2)) * max(weight) OVER () AS l2 FROM gram))"""


def _softmax(k: int) -> str:
    top = "greatest(z0, z1, z2)"
    return f"exp(z{k} - {top}) / (" + " + ".join(f"exp(z{j} - {top})" for j in CLASSES) + ")"


def _fitting() -> str:
    """``solved``: step by step a (weights of training rows) and v (their extrapolation), for terms, signals and intercept."""
    z = ", ".join(f"vb{k} + list_dot_product(k1, v1{k}) + list_dot_product(k2, v2{k}) AS z{k}" for k in CLASSES)
    g = ", ".join(f"weight * ({_softmax(k)} - (label = {k})::INTEGER) AS g{k}" for k in CLASSES)
    on = f"* {1 + MOMENTUM} - {MOMENTUM} *"
    moved, names, first = [], [], []
    for k in CLASSES:
        for b in (1, 2):
            new = f"(v{b}{k}[i] - eta{b} * (g{k} + v{b}{k}[i]))"
            moved += [f"list({new} ORDER BY i) AS n{b}{k}", f"list({new} {on} a{b}{k}[i] ORDER BY i) AS m{b}{k}"]
            names += [f"n{b}{k}", f"m{b}{k}"]
            first += [f"zero AS a{b}{k}", f"zero AS v{b}{k}"]
        new = f"(any_value(vb{k}) - any_value(eta2) * sum(g{k}))"
        moved += [f"{new} AS nb{k}", f"{new} {on} any_value(ab{k}) AS mb{k}"]
        names += [f"nb{k}", f"mb{k}"]
        first += [f"0.0::DOUBLE AS ab{k}", f"0.0::DOUBLE AS vb{k}"]
    return f"""solved AS (SELECT 0 AS step, {', '.join(first)} FROM (SELECT list(0.0::DOUBLE) AS zero FROM gram)
  UNION ALL SELECT step, {', '.join(names)} FROM (SELECT step + 1 AS step, {', '.join(moved)}
    FROM (SELECT *, {g} FROM (SELECT *, {z} FROM solved, gram, rates)) GROUP BY step) WHERE step <= {STEPS}),
fitted AS MATERIALIZED (SELECT * FROM solved WHERE step = {STEPS})"""


_LOGITS = ", ".join(f"ab{k} + list_dot_product(k1, a1{k}) + list_dot_product(k2, a2{k}) AS z{k}" for k in CLASSES)
# All documents with the probabilities of the fitted model.
FITTED = f"""{LEARNING}, {_fitting()},
results AS (SELECT parts.*, {', '.join(f'{_softmax(k)} AS p{k}' for k in CLASSES)}
  FROM (SELECT r, {_LOGITS} FROM kernel, fitted) JOIN parts USING (r)),
predicted AS (SELECT *, {base.ARGMAX} AS prediction FROM results)"""


def judged(split: str) -> str:
    return f"judged AS (SELECT doc_id, p0, p1, p2, prediction, label FROM predicted WHERE split = '{split}')"


CLASSIFIED = f"""{FITTED}, cls AS (SELECT *, CAST(doc_id AS VARCHAR) AS message_id, 'u' || CAST(doc_id % 97 AS VARCHAR) AS user_id,
  prediction AS ml_label_id, greatest(p0, p1, p2) AS ml_confidence FROM predicted)"""
SCORES = "doc_id, round(p0, 6) AS ham, round(p1, 6) AS spam, round(p2, 6) AS phishing"
_ERROR = ", ".join(f"weight * ({_softmax(k)} - (label = {k})::INTEGER) AS g{k}" for k in CLASSES)
_TOP = "greatest(z0, z1, z2)"
# Loss, penalty and gradient of the coefficients that the weights of the training rows stand for.
_OWN = f"own AS MATERIALIZED (SELECT *, {_ERROR} FROM (SELECT gram.*, {_LOGITS} FROM gram, fitted))"


def _certificate() -> str:
    loss = f"SELECT sum(weight * (ln({' + '.join(f'exp(z{j} - {_TOP})' for j in CLASSES)}) + {_TOP} - [z0, z1, z2][label + 1])) AS loss FROM own"
    penalty = " + ".join(f"a{b}{k}[i] * list_dot_product(k{b}, a{b}{k})" for b in (1, 2) for k in CLASSES)
    length = " + ".join(
        f"(g{k} + a{b}{k}[i]) * (list_dot_product(k{b}, gs{k}) + list_dot_product(k{b}, a{b}{k}))" for b in (1, 2) for k in CLASSES)
    lists = ", ".join(f"list(g{k} ORDER BY i) AS gs{k}" for k in CLASSES)
    rest = " + ".join(f"pow(sum(g{k}), 2)" for k in CLASSES)
    return f"""{_OWN}, errors AS (SELECT {lists} FROM own)
SELECT {len(CLASSES)} * ((SELECT count(*) FROM vocab) + {len(fixed.SIGNALS) + 1}) AS numbers,
  round(loss + penalty / 2, 6) AS objective, round(sqrt(greatest(length, 0)), 6) AS gradient
FROM ({loss}), (SELECT sum({penalty}) AS penalty, sum({length}) + {rest} AS length FROM own, errors, fitted)"""


def _coefficients() -> str:
    parts = []
    mean = "(" + " + ".join(f"ab{k}" for k in CLASSES) + f") / {len(CLASSES)}"
    signals = base.sql_list(fixed.SIGNALS)
    for k in CLASSES:
        parts += [
            f"SELECT {k} AS label_id, idx, term AS name, sum(x * a1{k}[r]) AS weight FROM x1 JOIN vocab USING (idx), n, fitted WHERE r <= n.n GROUP BY ALL",
            f"SELECT {k}, CAST((SELECT count(*) FROM vocab) + idx AS INTEGER), {signals}[idx + 1], sum(x * a2{k}[r]) FROM x2, n, fitted WHERE r <= n.n GROUP BY ALL",
            f"SELECT {k}, -1, 'intercept', ab{k} - {mean} FROM fitted"]
    return "SELECT label_id, idx, name, round(weight, 4) AS weight FROM (" + " UNION ALL ".join(parts) + ")"


def _metrics(split: str) -> str:
    return f"WITH RECURSIVE {FITTED}, {judged(split)}, {base.CLASS_ROWS}, {base.AUC}"


SQL = {
    "logistic_regression_scores": f"WITH RECURSIVE {FITTED} SELECT split, CAST(label AS INTEGER) AS label, prediction, {SCORES} FROM predicted WHERE split IS NOT NULL",
    "coefficient_scores": f"WITH RECURSIVE {FITTED} SELECT {SCORES} FROM predicted WHERE split IS NOT NULL",
    "model_coefficients": f"WITH RECURSIVE {LEARNING}, {_fitting()} {_coefficients()}",
    "regression_certificate": f"WITH RECURSIVE {LEARNING}, {_fitting()}, {_certificate()}",
    "regression_runs": f"""{_metrics('val')} SELECT m AS model, (SELECT n FROM n) AS train_samples, support AS val_samples,
  round(accuracy, 6) AS accuracy, round(f1_weighted, 6) AS f1_weighted, (SELECT round(sum(auc * positives) / sum(positives), 6) FROM auc) AS auc_roc
  FROM ov, (SELECT unnest(['lr', 'soft_vote']) AS m)""",
    "test_set_metrics": f"{_metrics('test')} {base.METRIC_ROWS}",
    "decision_records_of_model": f"WITH RECURSIVE {base.records(False, CLASSIFIED, fixed.SPAM_KEYWORDS, fixed.PHISHING_KEYWORDS)} {base.FLAT}",
}
