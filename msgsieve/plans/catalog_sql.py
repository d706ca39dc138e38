"""The registered queries once more, as SQL for an independent engine.

The texts are written against DuckDB.  Its regular expressions have no
lookaround and ASCII-only shorthands, so character classes are spelled out.
"""

from __future__ import annotations

from msgsieve import fixed_values as fixed
from msgsieve.plans import catalog as c

WS_SET = r"\p{Z}\t-\r\x{1c}-\x{1f}\x{85}"
NWS = f"[^{WS_SET}]"
URL = rf"(?i)(?:https?://|www\.){NWS}+|[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z]{{2,}}(?:/{NWS}*)?"
PHONE = r"(?:\+66|0)[0-9]{8,9}|0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|1[0-9]{3,4}"
DROP = rf"[^\x{{0E00}}-\x{{0E7F}}a-zA-Z0-9{WS_SET}.,!?%]"
SIGNALS = fixed.SIGNALS


def q(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def count_of(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def signal_sql(text: str = "text") -> dict[str, str]:
    words = count_of(f"{NWS}+", text)
    return {
        "text_length": f"length({text})",
        "word_count": words,
        "url_count": count_of(URL, text),
        "phone_count": count_of(PHONE, text),
        "exclamation_count": f"(length({text}) - length(replace({text}, '!', '')))",
        "number_ratio": f"({count_of(r'\p{Nd}+', text)}::DOUBLE / greatest({words}, 1))",
        "caps_ratio": f"({count_of(r'\p{Lu}', text)}::DOUBLE / greatest(length({text}), 1))",
    }


def signal_list(text: str = "text", digits: int | None = None) -> str:
    parts = []
    for name, value in signal_sql(text).items():
        if digits is not None and name.endswith("_ratio"):
            value = f"round({value}, {digits})"
        parts.append(f"{value} AS {name}")
    return ", ".join(parts)


def clean_sql(text: str = "text", url: str = " URL ", phone: str = " PHONE ") -> str:
    marked = f"regexp_replace(regexp_replace({text}, {q(URL)}, {q(url)}, 'g'), {q(PHONE)}, {q(phone)}, 'g')"
    return f"trim(regexp_replace(regexp_replace(lower({marked}), {q(DROP)}, ' ', 'g'), {q(f'[{WS_SET}]+')}, ' ', 'g'))"


CLASS = "CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END"


def name_of(label: str) -> str:
    return f"({sql_list(fixed.LABELS)})[{label} + 1]"


RAW = f"""raw AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS message_id, text, source, label, {name_of('label')} AS label_name
  FROM documents d JOIN (SELECT doc_id, {CLASS} AS label FROM labels) USING (doc_id))"""
PREPARED = f"""prep AS (
  SELECT * FROM (SELECT doc_id, text, lang, {clean_sql()} AS text_clean, {signal_list()} FROM documents)
  WHERE length(text_clean) > 0)"""


def scored(source: str, coefficients=None, intercepts=None, prefix: str = "") -> str:
    """CTEs from a table of signals ``source`` to probabilities."""
    coefficients = coefficients or c.COEFFICIENTS
    intercepts = intercepts or c.INTERCEPTS
    moments = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in SIGNALS)
    scaled = ", ".join(f"({n} - m_{n}) / CASE WHEN s_{n} = 0 THEN 1 ELSE s_{n} END AS z_{n}" for n in SIGNALS)
    logits = ", ".join(
        " + ".join([str(i), *[f"z_{n} * {w}" for n, w in weights.items()]]) + f" AS l{k}"
        for k, (weights, i) in enumerate(zip(coefficients, intercepts))
    )
    p = prefix
    return f"""{p}moments AS (SELECT {moments} FROM {source}),
{p}scaled AS (SELECT {source}.*, {scaled} FROM {source}, {p}moments),
{p}logits AS (SELECT *, {logits} FROM {p}scaled),
{p}powers AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1,
  exp(l2 - greatest(l0, l1, l2)) AS e2 FROM {p}logits),
{p}proba AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM {p}powers)"""


ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
CLASSIFIED = f"""msgs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS message_id, text, 'u' || CAST(doc_id % 97 AS VARCHAR) AS user_id,
    {signal_list()} FROM documents),
{scored('msgs')},
cls AS (SELECT *, {ARGMAX} AS ml_label_id, greatest(p0, p1, p2) AS ml_confidence FROM proba)"""
JUDGED = f"""{CLASSIFIED},
judged AS (SELECT cls.doc_id, cls.text, p0, p1, p2, ml_label_id AS prediction, label
  FROM cls JOIN (SELECT doc_id, {CLASS} AS label FROM labels) l ON l.doc_id = cls.doc_id)"""


def hits(words, text: str = "text") -> str:
    return f"list_filter({sql_list(words)}, lambda k: contains(lower({text}), lower(k)))"


REASONS = f"""list_filter([
  CASE WHEN url_count > 0 THEN {q(fixed.REASON_URL)} END,
  CASE WHEN phone_count > 0 THEN {q(fixed.REASON_PHONE)} END,
  CASE WHEN exclamation_count > 2 THEN {q(fixed.REASON_EXCLAMATION)} END], lambda r: r IS NOT NULL)"""


def hit_list(label: str, spam=c.SPAM_WORDS, phishing=c.PHISHING_WORDS) -> str:
    return (
        f"CASE {label} WHEN 1 THEN {hits(spam)} WHEN 2 THEN {hits(phishing)} "
        "ELSE CAST([] AS VARCHAR[]) END"
    )


def explanation(label: str) -> str:
    def sentence(prefix: str, default: str) -> str:
        parts = (
            f"list_concat(CASE WHEN len(hits) > 0 THEN [{q(prefix)} || array_to_string(hits[1:5], ', ')] "
            "ELSE CAST([] AS VARCHAR[]) END, reasons)"
        )
        return f"CASE WHEN len(hits) + len(reasons) > 0 THEN array_to_string({parts}, ' | ') ELSE {q(default)} END"

    return (
        f"CASE {label} WHEN 0 THEN {q(fixed.EXPLAIN_HAM)} "
        f"WHEN 1 THEN {sentence(fixed.EXPLAIN_SPAM_PREFIX, fixed.EXPLAIN_SPAM_DEFAULT)} "
        f"ELSE {sentence(fixed.EXPLAIN_PHISHING_PREFIX, fixed.EXPLAIN_PHISHING_DEFAULT)} END"
    )


# Keyword lists and reasons have no entry twice and none in common.
RISK_WORDS = "list_concat(hits, reasons)[1:8]"

RESPONSES = f"""resp AS (
  SELECT CAST(doc_id AS VARCHAR) AS message_id, CASE doc_id % 10
    WHEN 0 THEN '{{"label": "' || name || '", "confidence": ' || conf || ', "reason": "r' || doc_id || '"}}'
    WHEN 1 THEN 'Sure:' || chr(10) || '{{"label": " PHISHING ", "confidence": 1.7}}. {{"label": "ham"}}'
    WHEN 2 THEN '{{"label": "' || name || '", "confidence": "' || conf || '", "reason": " x "}}'
    WHEN 3 THEN 'no answer'
    WHEN 4 THEN '{{"label": "unknown", "confidence": ' || conf || '}}'
    WHEN 5 THEN '{{"label": "ham", "confidence": null}}'
    WHEN 6 THEN '{{"label": "spam", "confidence": "high"}}'
    WHEN 7 THEN '{{"label": "' || name || '", "reason": "a ' || doc_id || '"}}'
    WHEN 8 THEN '{{"label": "spam", "confidence": 0.5'
    ELSE '{{"a": {{"label": "ham", "confidence": -3, "reason": "inner"}}}}' END AS response
  FROM (SELECT doc_id, {name_of('doc_id % 3')} AS name,
    '0.' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS conf FROM documents)),
fields AS (
  SELECT message_id, lower(trim(j ->> '$.label')) AS l,
    CASE WHEN NOT json_exists(j, '$.confidence') THEN 0.5 ELSE try_cast(j ->> '$.confidence' AS DOUBLE) END AS conf,
    CASE WHEN json_exists(j, '$.reason') THEN trim(j ->> '$.reason') ELSE '' END AS reason
  FROM (SELECT message_id, CASE WHEN json_valid(found) THEN CAST(found AS JSON) END AS j
    FROM (SELECT message_id, nullif(regexp_extract(response, '(?s)\\{{[^{{}}]*\\}}'), '') AS found FROM resp))),
parsed AS (
  SELECT message_id, ok AS parse_ok, CASE WHEN ok THEN l END AS label,
    CASE WHEN ok THEN greatest(0.0, least(1.0, conf)) END AS confidence, CASE WHEN ok THEN reason END AS reason
  FROM (SELECT *, coalesce(l IN ('ham', 'spam', 'phishing') AND conf IS NOT NULL, false) AS ok FROM fields))"""


def records(
    with_answers: bool, classified: str = CLASSIFIED, spam=c.SPAM_WORDS, phishing=c.PHISHING_WORDS, counts: str = "parse_ok"
) -> str:
    """CTEs up to ``rec``: the flat decision records, with the answers that count."""
    answers = (
        f", {RESPONSES}, best AS (SELECT * FROM parsed WHERE {counts})" if with_answers else ""
    )
    joined = (
        "SELECT cls.*, best.label AS s_label, best.confidence AS s_conf, best.reason AS s_reason FROM cls "
        "LEFT JOIN best ON best.message_id = cls.message_id AND cls.ml_confidence < 0.8"
        if with_answers
        else "SELECT *, CAST(NULL AS VARCHAR) AS s_label, CAST(NULL AS DOUBLE) AS s_conf, CAST(NULL AS VARCHAR) AS s_reason FROM cls"
    )

    def pick(values) -> str:
        return f"({sql_list(values)})[label_id + 1]"

    return f"""{classified}{answers},
joined AS ({joined}),
seconds AS (SELECT *, list_position({sql_list(fixed.LABELS)}, s_label) - 1 AS s_id FROM joined),
decided AS (SELECT *, CAST(CASE WHEN s_label IS NOT NULL AND s_id <> ml_label_id THEN s_id ELSE ml_label_id END AS INTEGER) AS label_id,
  CASE WHEN s_label IS NULL THEN ml_confidence WHEN s_id = ml_label_id THEN round((ml_confidence + s_conf) / 2, 4)
    ELSE round(s_conf, 4) END AS final_confidence FROM seconds),
worded AS (SELECT *, {hit_list('label_id', spam, phishing)} AS hits, {REASONS} AS reasons FROM decided),
rec AS (SELECT message_id, user_id, text, {pick(fixed.LABELS)} AS label, {pick(fixed.LABELS_TH)} AS label_th, label_id,
  round(final_confidence, 4) AS confidence, {pick(fixed.RISK_LEVELS)} AS risk_level, {pick(fixed.RISK_LEVELS_TH)} AS risk_level_th,
  {explanation('label_id')} AS explanation, {RISK_WORDS} AS words,
  array_to_string({RISK_WORDS}, ',') AS keywords,
  round(p0, 4) AS p_ham, round(p1, 4) AS p_spam, round(p2, 4) AS p_phishing,
  CASE WHEN s_label IS NULL THEN 'ml' ELSE 'hybrid' END AS confidence_source, s_reason AS llm_explanation FROM worded)"""


FLAT = (
    "SELECT message_id, label, label_th, label_id, confidence, risk_level, risk_level_th, explanation, keywords, "
    "p_ham, p_spam, p_phishing, confidence_source, llm_explanation FROM rec"
)

TOKENS = """toks AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text_clean), '[\\p{L}\\p{N}_]+') AS t FROM prep)),
terms AS (SELECT doc_id, tok AS term FROM toks UNION ALL
  SELECT doc_id, tok || ' ' || nxt FROM (SELECT *, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM toks)
  WHERE nxt IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
tstat AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ctf FROM tf GROUP BY term)"""
VOCABULARY = f"""{PREPARED}, {TOKENS},
n AS (SELECT count(*) AS n FROM prep),
top AS (SELECT term, df, ctf FROM tstat, n WHERE df >= 2 AND df <= 0.95 * n.n ORDER BY ctf DESC, term LIMIT 5000),
vocab AS (SELECT term, df, ctf, ln((1.0 + n.n) / (1.0 + df)) + 1.0 AS idf,
  CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM top, n)"""


def histogram(value: str, bins: int) -> str:
    return f"""WITH v AS (SELECT lang, CAST({value} AS DOUBLE) AS v FROM documents),
lim AS (SELECT lang, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM v GROUP BY lang)
SELECT lang, CAST(least(floor((v - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
FROM v JOIN lim USING (lang) GROUP BY ALL"""


def replacement() -> str:
    text = "text"
    for word, new in c.REPLACEMENTS.items():
        pattern = rf"(?i)(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])"
        once = r"\1" + new.replace("\\", r"\\") + r"\2"
        for _ in range(2):  # neighbours share their border character
            text = f"regexp_replace({text}, {q(pattern)}, {q(once)}, 'g')"
    return text


CONFUSION = " UNION ALL ".join(
    f"SELECT {a} AS actual, {p} AS predicted, count(*) FILTER (WHERE label = {a} AND prediction = {p}) AS n FROM judged"
    for a in range(3)
    for p in range(3)
)
CLASS_ROWS = f"""conf AS ({CONFUSION}),
cm AS (SELECT k.k AS label_id, sum(n) FILTER (WHERE actual = k AND predicted = k) AS hit,
  sum(n) FILTER (WHERE actual = k) AS support, sum(n) FILTER (WHERE predicted = k) AS predicted
  FROM conf, (SELECT unnest([0, 1, 2]) AS k) k GROUP BY k.k),
pc AS (SELECT label_id, {name_of('label_id')} AS class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
  CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hit / (support + predicted) END AS f1, hit FROM cm),
ov AS (SELECT sum(hit) / sum(support) AS accuracy,
  {', '.join(f'sum({m} * support) / sum(support) AS {m}_weighted, avg({m}) FILTER (WHERE support + predicted > 0) AS {m}_macro, avg({m}) AS {m}_all' for m in ('precision', 'recall', 'f1'))},
  CAST(sum(support) AS BIGINT) AS support FROM pc)"""
AUC = """pairs AS (SELECT k AS label_id, [p0, p1, p2][k + 1] AS score, label = k AS hit
  FROM judged, (SELECT unnest([0, 1, 2]) AS k)),
g AS (SELECT label_id, score, count(*) FILTER (WHERE hit) AS pos, count(*) FILTER (WHERE NOT hit) AS neg FROM pairs GROUP BY ALL),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
auc AS (SELECT label_id, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
  sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY label_id)"""

METRIC_ROWS = (
    " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST(NULL AS VARCHAR) AS class, round({m}, 6) AS value FROM ov" for m in ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro"))
    + "".join(f" UNION ALL SELECT '{m}', class, round({m}, 6) FROM pc WHERE support > 0" for m in ("precision", "recall", "f1"))
    + " UNION ALL SELECT 'auc_roc_weighted', NULL, round(sum(auc * positives) / sum(positives), 6) FROM auc UNION ALL SELECT 'auc_roc_macro', NULL, round(avg(auc), 6) FROM auc"
)

EVENT_LABEL = "CASE event_type WHEN 'click' THEN 'spam' WHEN 'error' THEN 'phishing' ELSE 'ham' END"
WINDOWS = f"""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(s + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS period_end,
  count(*) AS total_predictions, count(*) FILTER (WHERE label = 'spam') AS spam_count,
  count(*) FILTER (WHERE label = 'phishing') AS phishing_count, count(*) FILTER (WHERE label = 'ham') AS ham_count,
  round(count(*) FILTER (WHERE label = 'spam') / count(*), 4) AS spam_rate,
  round(count(*) FILTER (WHERE label = 'phishing') / count(*), 4) AS phishing_rate
FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, {EVENT_LABEL} AS label FROM events) e"""

STABLE_DATE = "strftime(DATE '2022-01-01' + CAST(('0x' || substr(md5('date' || message_id), 1, 8))::BIGINT % 731 AS INTEGER), '%Y-%m-%d %H:%M:%S')"

HISTORY = """hist AS (SELECT *, list({{'role': role, 'content': text}}) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS h FROM conversations)"""
JOINED = "md5(array_to_string(list_transform({h}, lambda x: x.role || ':' || x.content), '|'))"

FEEDBACK = f"""{JUDGED}, fb AS (SELECT doc_id, text, {name_of('prediction')} AS predicted_label,
  CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE {name_of('label')} END AS actual_label FROM judged)"""
LANG_RUNS = f"""{JUDGED}, byclass AS (SELECT lang, k, count(*) FILTER (WHERE label = k) AS support,
    count(*) FILTER (WHERE label = k AND prediction = k) AS hit, count(*) FILTER (WHERE prediction = k) AS predicted
  FROM judged JOIN documents USING (doc_id), (SELECT unnest([0, 1, 2]) AS k) GROUP BY lang, k),
f1s AS (SELECT lang, sum(CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hit * support / (support + predicted) END) / sum(support) AS f1
  FROM byclass GROUP BY lang),
runs AS (SELECT lang, avg(CAST(label = prediction AS DOUBLE)) AS accuracy, any_value(f1) AS f1, count(*) AS n, max(doc_id) AS last
  FROM judged JOIN documents USING (doc_id) JOIN f1s USING (lang) GROUP BY lang)"""


def rules(pairs) -> str:
    """Names of the broken rules joined by commas."""
    cases = ", ".join(f"CASE WHEN {condition} THEN {q(name)} END" for name, condition in pairs)
    return f"array_to_string(list_filter([{cases}], lambda r: r IS NOT NULL), ',')"


BLANK_TEXT = f"NOT regexp_matches(text, {q(NWS)})"
RAW_RULES = [
    ("text_too_short", "text", "length(text) < 5"),
    ("text_too_long", "text", "length(text) > 1000"),
]


def unit32(value: str) -> str:
    return f"('0x' || substr(md5({value}), 1, 8))::BIGINT"


# --- generated messages -------------------------------------------------------


class Draws:
    """The numbered draws of a generated row."""

    def __init__(self):
        self.used = 0

    def number(self) -> str:
        block, position = divmod(self.used, 4)
        self.used += 1
        return f"('0x' || substr(md5('42|{block}|' || doc_id), {position * 8 + 1}, 8))::BIGINT"

    def choice(self, values) -> str:
        return f"({sql_list(values)})[CAST({self.number()} % {len(values)} AS INTEGER) + 1]"

    def integer(self, low: int, high: int) -> str:
        return f"CAST({low} + {self.number()} % {high - low + 1} AS VARCHAR)"


def generated() -> str:
    d = Draws()
    position = d.number()
    template = "CASE label " + " ".join(
        f"WHEN {k} THEN ({sql_list(t)})[CAST({position} % {len(t)} AS INTEGER) + 1]"
        for k, t in enumerate((fixed.HAM_TEMPLATES, fixed.SPAM_TEMPLATES, fixed.PHISHING_TEMPLATES))
    ) + " END"
    price = d.choice(fixed.COURSE_PRICES)

    def day() -> str:
        return f"{d.integer(1, 28)} || '/' || {d.integer(1, 12)} || '/' || {d.integer(67, 68)}"

    values = {}
    values["prize"] = f"format('{{:,}}', {d.choice(fixed.PRIZES)})"
    values["discount"] = f"CAST({d.choice(fixed.DISCOUNTS)} AS VARCHAR)"
    values["profit"] = f"CAST({d.choice(fixed.PROFITS)} AS VARCHAR)"
    for name, options in (("bank", fixed.BANKS), ("location", fixed.LOCATIONS), ("place", fixed.PLACES), ("url", fixed.FAKE_URLS), ("phone", fixed.FAKE_PHONES)):
        values[name] = d.choice(options)
    values["phone_short"] = f"'0' || {d.integer(80, 99)} || '-xxx-' || {d.integer(1000, 9999)}"
    for name, options in (("otp", fixed.FAKE_OTPS), ("time", fixed.TIMES), ("time2", fixed.TIMES)):
        values[name] = d.choice(options)
    values["nights"] = d.integer(3, 7)
    values["bonus"] = f"format('{{:,}}', {d.choice(fixed.PRIZES)} * 2)"
    values["date"] = day()
    for name, options in (("legit_url", fixed.LEGIT_URLS), ("university", fixed.UNIVERSITIES), ("course_name", fixed.COURSE_NAMES)):
        values[name] = d.choice(options)
    values["course_price"] = f"CAST({price} AS VARCHAR)"
    values["course_price2"] = f"CAST({price} + {d.choice([200, 300, 500])} AS VARCHAR)"
    values["batch"] = d.integer(1, 20)
    values["seats"] = f"CAST({d.choice([20, 30, 40, 50, 60])} AS VARCHAR)"
    values["year"] = f"CAST({d.choice([2568, 2569])} AS VARCHAR)"
    values["years"] = d.integer(5, 30)
    values["date2"] = day()
    values["phone_real"] = d.choice(fixed.REAL_PHONES)
    text = "template"
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    prefix = f"CASE WHEN {d.number()} / 4294967296.0 < 0.3 THEN {d.choice(fixed.NOISE_PREFIXES)} ELSE '' END"
    suffix = f"CASE WHEN {d.number()} / 4294967296.0 < 0.2 THEN {d.choice(fixed.NOISE_SUFFIXES)} ELSE '' END"
    days = f"CAST({d.number()} % 731 AS INTEGER)"
    return f"""WITH t AS (SELECT doc_id, label, {template} AS template FROM (SELECT doc_id, {CLASS} AS label FROM labels))
SELECT substr(sha256('synthetic' || chr(31) || '42' || chr(31) || doc_id), 1, 32) AS message_id,
  trim({prefix} || {text} || {suffix}) AS text, CAST(label AS INTEGER) AS label, {name_of('label')} AS label_name,
  'synthetic' AS source, strftime(DATE '2023-01-01' + {days}, '%Y-%m-%d %H:%M:%S') AS created_at FROM t"""


def report_stats(pairs) -> str:
    return " UNION ALL ".join(f"SELECT {q(name)} AS stat, round(CAST({value} AS DOUBLE), 6) AS value FROM agg" for name, value in pairs)


RAW_REPORT = f"""WITH {RAW}, agg AS (SELECT count(*) AS n_rows, {', '.join(f'count(*) FILTER (WHERE label = {k}) AS label_{k}' for k in range(3))},
  count(*) FILTER (WHERE length(text) < 5) AS short, count(*) FILTER (WHERE length(text) > 1000) AS long,
  count(*) - count(DISTINCT text) AS dups, avg(length(text)) AS a, min(length(text)) AS lo, max(length(text)) AS hi FROM raw),
iss AS (SELECT agg.*, list_filter([
  CASE WHEN short > 0 THEN 'Schema: text_too_short failed on column ''text'' (' || short || ' rows)' END,
  CASE WHEN long > 0 THEN 'Schema: text_too_long failed on column ''text'' (' || long || ' rows)' END,
  CASE WHEN dups > 0 THEN 'Found ' || dups || ' duplicate messages' END,
  CASE WHEN greatest(label_0, label_1, label_2) / n_rows > 0.8 THEN 'Class ' ||
    CASE WHEN label_0 / n_rows > 0.8 THEN 0 WHEN label_1 / n_rows > 0.8 THEN 1 ELSE 2 END
    || format(' dominates at {{:.1f}}%', 100.0 * greatest(label_0, label_1, label_2) / n_rows) END,
  CASE WHEN least(label_0, label_1, label_2) < 100 THEN 'Smallest class has only ' || least(label_0, label_1, label_2) || ' samples (min: 100)' END
  ], lambda i: i IS NOT NULL) AS issues FROM agg),
st AS ({report_stats([('total_rows', 'n_rows'), ('avg_text_length', 'a'), ('min_text_length', 'lo'), ('max_text_length', 'hi'), ('n_duplicates', 'dups')])})
SELECT len(issues) = 0 AS passed, n_rows, label_0, label_1, label_2, array_to_string(issues, '; ') AS issues, stat, value FROM iss, st"""

PROCESSED_REPORT = f"""WITH {RAW}, p AS (SELECT * FROM (SELECT *, {clean_sql()} AS tc, {count_of(URL)} AS u, {count_of(PHONE)} AS ph FROM raw) WHERE length(tc) > 0),
agg AS (SELECT count(*) AS n_rows, {', '.join(f'count(*) FILTER (WHERE label = {k}) AS label_{k}' for k in range(3))},
  avg(length(tc)) AS a, avg(u) AS au, avg(ph) AS ap FROM p),
st AS ({report_stats([('total_rows', 'n_rows'), ('avg_clean_length', 'a'), ('avg_url_count', 'au'), ('avg_phone_count', 'ap'), ('empty_texts', '0')])})
SELECT true AS passed, n_rows, label_0, label_1, label_2, '' AS issues, stat, value FROM agg, st"""


def reply_sql() -> str:
    def lines(kind: str) -> str:
        texts = fixed.REPLY_TEXTS[kind]
        before, after = texts["header"].split("{pct}")
        advice = " || chr(10) || ".join(["''", *[q(a) for a in texts["advice"]]])
        return (
            f"{q(before)} || CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || {q(after)} || chr(10) || chr(10) || explanation"
            " || CASE WHEN coalesce(llm_explanation, '') <> '' THEN chr(10) || chr(10) || llm_explanation ELSE '' END"
            f" || CASE WHEN len(words) > 0 THEN chr(10) || chr(10) || {q(texts['keywords'])} || array_to_string(words, ', ') ELSE '' END"
            f" || chr(10) || {advice}"
        )

    return f"CASE label WHEN 'spam' THEN {lines('spam')} ELSE {lines('phishing')} END"


def webhook_reply_sql() -> str:
    moments = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in SIGNALS)
    turns = f"turns AS (SELECT 't-' || conv_id || '-' || turn AS reply_token, 'u' || conv_id AS user_id, text, {signal_list()} FROM conversations WHERE role = 'user')"
    body = scored("turns", c.COEFFICIENTS, c.WEBHOOK_INTERCEPTS).split(",\n", 1)[1]
    found = (
        f"CASE label_id WHEN 1 THEN {hits(fixed.SPAM_KEYWORDS)} WHEN 2 THEN {hits(fixed.PHISHING_KEYWORDS)} "
        "ELSE CAST([] AS VARCHAR[]) END"
    )
    return f"""WITH {PREPARED}, moments AS (SELECT {moments} FROM prep), {turns}, {body},
worded AS (SELECT *, {found} AS hits, {REASONS} AS reasons FROM (SELECT *, {ARGMAX} AS label_id FROM proba)),
rec AS (SELECT reply_token, user_id, {name_of('label_id')} AS label, round(greatest(p0, p1, p2), 4) AS confidence,
  {explanation('label_id')} AS explanation, {RISK_WORDS} AS words, CAST(NULL AS VARCHAR) AS llm_explanation FROM worded)
SELECT reply_token, user_id, {reply_sql()} AS reply FROM rec WHERE label <> 'ham'"""


LOGGED = f"""SELECT substr(sha256(message_id || chr(31) || user_id || chr(31) || text), 1, 32) AS id, substr(text, 1, 500) AS text,
  label, label_id, confidence, risk_level, user_id, {q(c.LOGGED_AT)} AS created_at FROM rec"""

MERGED = f"""WITH u AS (
  SELECT {name_of('label')} AS label_name, text, d.doc_id AS o, 0 AS pr, 'documents' AS source, label
    FROM documents d JOIN (SELECT doc_id, {CLASS} AS label FROM labels) USING (doc_id)
  UNION ALL SELECT 'ham', text, item_id, 1, 'benchmark', 0 FROM benchmark
  UNION ALL SELECT CASE role WHEN 'user' THEN 'spam' ELSE 'ham' END, text, conv_id * 1000000 + turn, 2, 'conversations',
    CASE role WHEN 'user' THEN 1 ELSE 0 END FROM conversations WHERE role IN ('user', 'assistant')),
f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pr, o) AS rn,
  substr(sha256(source || chr(31) || o), 1, 32) AS message_id FROM u WHERE text IS NOT NULL)
SELECT message_id, text, CAST(label AS INTEGER) AS label, label_name, source, {STABLE_DATE} AS created_at FROM f WHERE rn = 1"""

USER_COUNTERS = f"SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS total_checked, count(*) FILTER (WHERE {EVENT_LABEL} <> 'ham') AS flagged FROM events GROUP BY user_id"

SQL: dict[str, str] = {
    "signals": f"SELECT doc_id, {signal_list(digits=6)} FROM documents",
    "clean_text": f"SELECT doc_id, {clean_sql()} AS text_clean, md5({clean_sql(url=' ', phone=' ')}) AS without_marks FROM documents",
    "processed_text": f"SELECT doc_id, array_to_string(list_filter(string_split({clean_sql()}, ' '), lambda t: t <> '' AND NOT list_contains({sql_list(c.STOPWORDS)}, t)), ' ') AS text_processed FROM documents",
    "prepared_messages": f"""WITH u AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, url FROM pages
  UNION ALL SELECT 'h' || page_id, html FROM pages UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 's-' || conv_id || '-' || turn, CASE WHEN conv_id % 2 = 0 THEN ' -*- ' ELSE '' END FROM conversations WHERE role = 'system')
SELECT id, {clean_sql()} AS text_clean, {signal_list(digits=6)} FROM u WHERE length({clean_sql()}) > 0""",
    "keyword_replacement": f"SELECT doc_id, {replacement()} AS text FROM documents",
    "url_signals_of_pages": f"SELECT page_id, {signal_list('html', digits=6)} FROM pages",
    "term_statistics": f"WITH {PREPARED}, {TOKENS} SELECT term, df, ctf FROM tstat",
    "merged_corpus": MERGED,
    "label_distribution": f"WITH {RAW} SELECT CAST(label AS INTEGER) AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM raw GROUP BY label",
    "duplicate_texts": "SELECT count(*) - count(DISTINCT text) - max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS n_duplicates FROM documents",
    "raw_report": RAW_REPORT,
    "raw_violations": f"WITH {RAW} SELECT * FROM (SELECT message_id, {rules([(n, cond) for n, _, cond in RAW_RULES])} AS broken_rules FROM raw) WHERE broken_rules <> ''",
    "raw_rule_counts": f"WITH {RAW} "
    + " UNION ALL ".join(
        [f"SELECT '{col}_not_null' AS rule, '{col}' AS column, count(*) FILTER (WHERE {col} IS NULL) AS n FROM raw" for col in ("message_id", "text", "label", "label_name", "source")]
        + ["SELECT 'created_at_not_null', 'created_at', 0"]
        + [f"SELECT '{n}', '{col}', count(*) FILTER (WHERE {cond}) FROM raw" for n, col, cond in RAW_RULES]
        + ["SELECT 'label_in_set', 'label', count(*) FILTER (WHERE label NOT IN (0, 1, 2)) FROM raw"]
        + ["SELECT 'label_name_in_set', 'label_name', count(*) FILTER (WHERE label_name NOT IN ('ham', 'spam', 'phishing')) FROM raw"]
    ),
    "processed_report": PROCESSED_REPORT,
    "split_by_hash": f"SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {unit32(chr(39) + '42' + chr(39) + ' || text')} / 4294967296.0 AS u FROM documents)",
    "split_exact": f"""SELECT doc_id, CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= round(n * (0.7 + 0.15)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {unit32(chr(39) + '42' + chr(39) + ' || doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)""",
    "split_table": f"""WITH {RAW} SELECT split, CAST(label AS INTEGER) AS label, count(*) AS n FROM (SELECT label, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT label, {unit32(chr(39) + '42' + chr(39) + ' || text')} / 4294967296.0 AS u FROM raw)) GROUP BY ALL""",
    "describe_lengths": f"WITH {PREPARED}, m AS (SELECT lang, 'text_length' AS metric, CAST(text_length AS DOUBLE) AS v FROM prep UNION ALL SELECT lang, 'word_count', word_count FROM prep) "
    "SELECT lang, metric, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, "
    "round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM m GROUP BY lang, metric",
    "length_histogram": histogram("length(text)", 30),
    "word_histogram": histogram(signal_sql()["word_count"], 20),
    "signal_means": f"WITH {PREPARED} SELECT lang, " + ", ".join(f"round(avg({n}), 4) AS {n}" for n in SIGNALS) + " FROM prep GROUP BY lang",
    "sample_per_class": f"SELECT lang, CAST(rank AS INTEGER) AS rank, doc_id, text FROM (SELECT lang, doc_id, substr(text, 1, 100) AS text, row_number() OVER (PARTITION BY lang ORDER BY {unit32(chr(39) + '42' + chr(39) + ' || doc_id')}, doc_id) AS rank FROM documents) WHERE rank <= 3",
    "shuffled_order": f"SELECT doc_id FROM documents ORDER BY {unit32(chr(39) + '42' + chr(39) + ' || doc_id')}, doc_id",
    "vocabulary": f"WITH {VOCABULARY} SELECT term, df, ctf, round(idf, 6) AS idf, idx FROM vocab",
    "tfidf_weights": f"""WITH {VOCABULARY}, w AS (SELECT doc_id, idx, term, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "feature_vectors": f"""WITH {VOCABULARY}, {scored('prep')}, w AS (SELECT doc_id, idx, (1 + ln(tf.tf)) * idf AS w FROM tf JOIN vocab USING (term)),
size AS (SELECT count(*) AS size FROM vocab)
SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM w
{' '.join(f"UNION ALL SELECT doc_id, CAST(size + {k} AS INTEGER), round(z_{n}, 6) FROM scaled, size" for k, n in enumerate(SIGNALS))}""",
    "dominated_report": RAW_REPORT.replace(CLASS, "CASE WHEN toxic = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END"),
    "split_checks": f"""WITH {RAW}, r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY {unit32(chr(39) + '42' + chr(39) + ' || message_id')}, message_id) AS rank,
  count(*) OVER (PARTITION BY label) AS n FROM raw)
SELECT CASE WHEN rank <= round(n * 0.7) THEN 'train' WHEN rank <= round(n * (0.7 + 0.15)) THEN 'val' ELSE 'test' END AS split,
  CAST(label AS INTEGER) AS label, count(*) AS n, CAST(0 AS BIGINT) AS n_shared FROM r GROUP BY ALL""",
    "tsv_corpus": f"WITH {RAW} SELECT CAST(label AS INTEGER) AS label, label_name, 'uci_sms_spam' AS source, 0 AS priority, md5(text) AS text_md5 FROM raw WHERE label_name IN ('ham', 'spam')",
    "csv_corpus": f"WITH {RAW} "
    + " UNION ALL ".join(
        f"SELECT '{form}' AS form, message_id, CAST(label AS INTEGER) AS label, label_name, source, '2024-01-01 00:00:00' AS created_at, md5({text}) AS text_md5 FROM raw"
        for form, text in (("multi", "text"), ("single", "replace(text, chr(10), ' ')"))
    ),
    "feature_names": f"WITH {VOCABULARY}, size AS (SELECT count(*) AS size FROM vocab) SELECT CAST(idx AS INTEGER) AS idx, term AS name FROM vocab "
    + " ".join(f"UNION ALL SELECT CAST(size + {k} AS INTEGER), '{n}' FROM size" for k, n in enumerate(SIGNALS)),
    "blank_decisions": f"""WITH {records(False)} SELECT message_id, CASE WHEN b THEN 'ham' ELSE label END AS label, CASE WHEN b THEN 1.0 ELSE confidence END AS confidence,
  CASE WHEN b THEN {q(fixed.EXPLAIN_BLANK)} ELSE explanation END AS explanation, CASE WHEN b THEN '' ELSE keywords END AS keywords
  FROM (SELECT *, CAST(message_id AS BIGINT) % 5 = 0 AS b FROM rec)""",
    "evaluation_report": f"""WITH {JUDGED}, {CLASS_ROWS} SELECT 'n-' || actual || '-' || predicted AS name, CAST(n AS DOUBLE) AS value FROM conf
  UNION ALL SELECT 'accuracy', round(accuracy, 6) FROM ov UNION ALL SELECT 'f1_weighted', round(f1_weighted, 6) FROM ov""",
    "stream_feedback": f"WITH {FEEDBACK} SELECT substr(text, 1, 500) AS text, predicted_label, actual_label FROM fb WHERE length(text) BETWEEN 1 AND 2000 AND actual_label <> 'unknown'",
    "stream_webhook": webhook_reply_sql(),
    "scaled_signals": f"WITH {PREPARED}, {scored('prep')} SELECT doc_id, " + ", ".join(f"round(z_{n}, 6) AS {n}" for n in SIGNALS) + " FROM scaled",
    "class_weights": f"WITH {RAW} SELECT CAST(label AS INTEGER) AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM raw GROUP BY label",
    "linear_scores": f"WITH {CLASSIFIED} SELECT message_id, round(p0, 6) AS ham, round(p1, 6) AS spam, round(p2, 6) AS phishing, ml_label_id, round(ml_confidence, 6) AS ml_confidence FROM cls",
    "soft_vote": f"""WITH {PREPARED}, {scored('prep', prefix='a_')}, {scored('prep', c.SECOND_COEFFICIENTS, c.SECOND_INTERCEPTS, 'b_')},
v AS (SELECT a.doc_id, (a.p0 * 2 + b.p0 + 1.0) / 5 AS p0, (a.p1 * 2 + b.p1 + 0.6) / 5 AS p1, (a.p2 * 2 + b.p2 + 0.4) / 5 AS p2 FROM a_proba a JOIN b_proba b USING (doc_id))
SELECT doc_id, round(p0, 6) AS ham, round(p1, 6) AS spam, round(p2, 6) AS phishing, {ARGMAX} AS prediction FROM v""",
    "decision_records": f"WITH {records(False)} {FLAT}",
    "second_opinion_requests": f"WITH {CLASSIFIED} SELECT message_id, md5({q(fixed.SECOND_OPINION_PROMPT)}) AS system_md5, md5('ข้อความ: \"' || text || '\"') AS user_md5, round(ml_confidence, 6) AS ml_confidence FROM cls WHERE ml_confidence < 0.8",
    "parsed_responses": f"WITH {RESPONSES} SELECT message_id, parse_ok, label, confidence, reason FROM parsed",
    "arbitrated_records": f"WITH {records(True)} {FLAT}",
    "stream_arbitration": f"WITH {records(True, counts='parse_ok AND CAST(message_id AS BIGINT) % 7 <= 3')} {FLAT}",
    "explanations": f"""WITH s AS (SELECT doc_id, text, label, {signal_list()} FROM documents JOIN (SELECT doc_id, {CLASS} AS label FROM labels) USING (doc_id)),
w AS (SELECT *, {hit_list('label')} AS hits, {REASONS} AS reasons FROM s)
SELECT doc_id, array_to_string(hits, ',') AS hits, array_to_string(reasons, ',') AS reasons, {explanation('label')} AS explanation,
  array_to_string({RISK_WORDS}, ',') AS risk_words FROM w""",
    "reply_texts": f"WITH {records(True)} SELECT message_id, {reply_sql()} AS reply FROM rec WHERE label <> 'ham'",
    "confusion_matrix": f"WITH {JUDGED}, conf AS ({CONFUSION}) SELECT * FROM conf",
    "overall_metrics": f"WITH {JUDGED}, {CLASS_ROWS} SELECT round(accuracy, 6) AS accuracy, "
    + ", ".join(f"round({m}_{a}, 6) AS {m}_{a}" for m in ("precision", "recall", "f1") for a in ("weighted", "macro"))
    + ", support FROM ov",
    "class_metrics": f"WITH {JUDGED}, {CLASS_ROWS} SELECT label_id, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, predicted FROM pc",
    "auc_by_class": f"WITH {JUDGED}, {AUC} SELECT label_id, positives, negatives, round(auc, 6) AS auc FROM auc",
    "metrics_table": f"WITH {JUDGED}, {CLASS_ROWS}, {AUC} {METRIC_ROWS}",
    "classification_report": f"WITH {JUDGED}, {CLASS_ROWS} SELECT label_id AS position, class AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc "
    "UNION ALL SELECT 3, 'accuracy', NULL, NULL, round(accuracy, 6), support FROM ov "
    "UNION ALL SELECT 4, 'macro avg', round(precision_all, 6), round(recall_all, 6), round(f1_all, 6), support FROM ov "
    "UNION ALL SELECT 5, 'weighted avg', round(precision_weighted, 6), round(recall_weighted, 6), round(f1_weighted, 6), support FROM ov",
    "prediction_log": f"WITH {records(False)} {LOGGED}",
    "telemetry": f"""WITH {records(False)} SELECT message_id, label, risk_level, confidence_source, CASE WHEN user_id = 'u0' THEN 'anonymous' ELSE user_id END AS user_id,
  replace(substr(text, 1, 200), chr(10), ' ') AS text_preview, confidence, CAST(label_id AS DOUBLE) AS label_id, CAST(0 AS DOUBLE) AS processing_time_ms,
  p_ham AS prob_ham, p_spam AS prob_spam, p_phishing AS prob_phishing, CAST(length(text) AS BIGINT) AS text_length, CAST(len(words) AS BIGINT) AS keywords_count FROM rec""",
    "feedback_quarantine": f"WITH {FEEDBACK} SELECT doc_id, "
    + rules([("text_empty", "length(text) < 1"), ("text_too_long", "length(text) > 2000"), ("actual_label_invalid", "actual_label = 'unknown'")])
    + " AS reasons FROM fb",
    "feedback_log": f"WITH {FEEDBACK} SELECT substr(text, 1, 500) AS text, predicted_label, actual_label FROM fb WHERE length(text) BETWEEN 1 AND 2000 AND actual_label <> 'unknown'",
    "feedback_log_scan": f"WITH {FEEDBACK} SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS job, substr(text, 1, 500) AS text, predicted_label, actual_label FROM fb WHERE length(text) BETWEEN 1 AND 2000 AND actual_label <> 'unknown'",
    "request_quarantine": f"""WITH r AS (SELECT doc_id, text, {rules([('text_missing', 'text IS NULL'), ('text_empty', 'length(text) < 1'), ('text_too_long', 'length(text) > 2000'), ('text_blank', 'length(text) BETWEEN 1 AND 2000 AND ' + BLANK_TEXT), ('user_id_too_long', 'length(repeat(source, 25)) > 100')])} AS reasons FROM documents)
SELECT doc_id, reasons, md5(CASE WHEN reasons = '' THEN regexp_replace(text, {q(f'^[{WS_SET}]+|[{WS_SET}]+$')}, '', 'g') ELSE text END) AS text_md5 FROM r""",
    "chat_quarantine": f"WITH {HISTORY.format(n=10)} SELECT conv_id, turn, "
    + rules([("message_empty", "length(text) < 1"), ("message_too_long", "length(text) > 400"), ("message_blank", "length(text) BETWEEN 1 AND 400 AND " + BLANK_TEXT), ("history_invalid", "len(list_filter(coalesce(h, []), lambda x: length(x.content) NOT BETWEEN 1 AND 900)) > 0")])
    + " AS reasons FROM hist",
    "prediction_stats": f"""WITH {FEEDBACK}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE ml_label_id = 1) AS s, count(*) FILTER (WHERE ml_label_id = 2) AS p, count(*) FILTER (WHERE ml_label_id = 0) AS h FROM cls)
SELECT n AS total_predictions, s AS spam_count, p AS phishing_count, h AS ham_count, round(s / n, 4) AS spam_rate, round(p / n, 4) AS phishing_rate,
  (SELECT count(*) FROM fb WHERE predicted_label <> actual_label) AS feedback_count FROM t""",
    "user_counters": USER_COUNTERS,
    "stream_user_counters": USER_COUNTERS,
    "windowed_stats": WINDOWS + " GROUP BY s",
    "stream_windowed_stats": WINDOWS + " GROUP BY s HAVING s + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    "model_info": f"""WITH {LANG_RUNS} SELECT true AS model_loaded, lang AS model_name, '1.0.0' AS version,
  strftime(make_timestamp((1700000000 + last) * 1000000), '%Y-%m-%dT%H:%M:%S') AS trained_at, round(accuracy, 6) AS val_accuracy,
  n AS train_samples, 'ham,spam,phishing' AS label_names FROM runs ORDER BY last DESC LIMIT 1""",
    "model_comparison": f"WITH {LANG_RUNS} SELECT lang AS model, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1_weighted, CAST(0 AS DOUBLE) AS auc_roc, CAST(NULL AS DOUBLE) AS train_seconds FROM runs",
    "chat_context": f"WITH {HISTORY.format(n=3)} SELECT conv_id, turn, CAST(len(coalesce(h, [])) AS INTEGER) AS n, {JOINED.format(h='coalesce(h, [])')} AS history_md5 FROM hist",
    "chat_messages": f"WITH {HISTORY.format(n=10)}, m AS (SELECT conv_id, turn, list_concat([{{'role': 'system', 'content': 'Be kind.'}}], list_concat(coalesce(h, []), [{{'role': 'user', 'content': text}}])) AS m FROM hist WHERE role = 'user') "
    f"SELECT conv_id, turn, CAST(len(m) AS INTEGER) AS n, {JOINED.format(h='m')} AS messages_md5 FROM m",
    "faq_topics": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(lower(text), {q(w.lower())}) THEN {q(t)}" for w, t in c.FAQ_WORDS) + " END AS topic FROM conversations",
    "chat_answers": f"""WITH a AS (SELECT q.conv_id || '-' || q.turn AS message_id, r.text AS told, CASE {' '.join(f'WHEN contains(lower(q.text), {q(w)}) THEN {q(fixed.FAQ_ANSWERS[t])}' for w, t in fixed.FAQ_KEYWORDS)} END AS faq
  FROM conversations q LEFT JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND r.role = 'assistant' WHERE q.role = 'user')
SELECT message_id, CASE WHEN told IS NOT NULL THEN 'llm' WHEN faq IS NOT NULL THEN 'faq' ELSE 'fallback' END AS source, md5(coalesce(told, faq, {q(fixed.CHAT_FALLBACK)})) AS reply_md5 FROM a""",
    "webhook_events": "SELECT 1 AS position, t AS reply_token, u AS user_id, text, substr(sha256(t || chr(31) || u || chr(31) || text), 1, 32) AS message_id FROM (SELECT 't-' || conv_id || '-' || turn AS t, 'u' || conv_id AS u, text FROM conversations WHERE role = 'user')",
    "webhook_replies": webhook_reply_sql(),
    "generated_messages": generated(),
    "stream_scoring": f"WITH {records(False)} SELECT substr(sha256(message_id || chr(31) || chr(31) || text), 1, 32) AS id, label, label_id, confidence, risk_level, md5(substr(text, 1, 500)) AS text_md5 FROM rec WHERE length(text) <= 2000",
}
