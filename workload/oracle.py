"""The same results in plain SQL, straight from the definitions."""

from __future__ import annotations

from tallymill.functions.keywords import KNOWN_MERCHANTS, STOP_WORDS
from tallymill.functions.windows import PHRASES, WINDOWS
from tallymill.operators.grounding import FOUND, NOT_FOUND
from tallymill.operators.normalize import CATEGORY_OF_CODE
from workload.queries import LETTERS, RULES
from workload.tables import KNOWN, ODD_NAMES, PHRASE_OF, RANGE_WORDS, RULE_MERCHANTS


def _texts(values) -> str:
    return "([" + ", ".join(f"'{value}'" for value in values) + "]::VARCHAR[])"


TXNS = """
txns AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         CASE WHEN l_returnflag = 'R' THEN 'Income' ELSE p_type END AS category,
         p_name AS merchant, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey
), newest AS (SELECT max(date) AS latest FROM txns)"""

FIRST_DAYS = """
first_days AS (
  SELECT 'last month' AS "window", CAST(latest - INTERVAL 1 MONTH AS DATE) AS lo FROM newest
  UNION ALL SELECT 'this month', CAST(date_trunc('month', latest) AS DATE) FROM newest
  UNION ALL SELECT 'last week', latest - 7 FROM newest
  UNION ALL SELECT 'this week', CAST(date_trunc('week', latest) AS DATE) FROM newest
  UNION ALL SELECT 'last year', CAST(latest - INTERVAL 1 YEAR AS DATE) FROM newest
  UNION ALL SELECT 'this year', CAST(date_trunc('year', latest) AS DATE) FROM newest
  UNION ALL SELECT 'today', latest FROM newest
  UNION ALL SELECT 'yesterday', latest - 1 FROM newest
  UNION ALL SELECT 'all', NULL FROM newest
)"""

PART_QUESTIONS = """
questions AS (
  SELECT p_partkey AS question_id, CASE WHEN p_partkey % 53 <> 0 THEN CASE p_partkey % 12
    WHEN 0 THEN 'How much did I spend on ' || split_part(p_name, ' ', 2) || ' last month'
    WHEN 1 THEN 'Spending on ' || lower(p_type) || ' this month'
    WHEN 2 THEN 'Top merchant for the last year'
    WHEN 3 THEN 'Total spending last week'
    WHEN 4 THEN 'Show income this month'
    WHEN 5 THEN p_name || ' this year'
    WHEN 6 THEN 'Compare spending this month vs last month'
    WHEN 7 THEN split_part(p_name, ' ', 2) || ' this week'
    WHEN 8 THEN split_part(p_name, ' ', 2) || ' yesterday'
    WHEN 9 THEN 'List transactions today'
    WHEN 10 THEN 'Recent transactions at ' || p_brand
    ELSE 'Spending on ' || p_type || ' or ' || p_name END END AS query
  FROM part
)"""


def window_questions(what: str) -> str:
    return f"""
questions AS (
  SELECT p_partkey AS question_id,
         {what} || ' ' || {_texts(PHRASE_OF)}[CAST(p_partkey % {len(PHRASE_OF)} + 1 AS INTEGER)]
           AS query
  FROM part
)"""


def parsed(known) -> str:
    windows = " ".join(
        f"WHEN contains(lower(coalesce(query, '')), '{phrase}') THEN '{phrase}'" for phrase in PHRASES
    )
    return f"""
worded AS (
  SELECT question_id, query, CASE {windows} ELSE 'all' END AS "window",
         list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(query, '')), '[a-z]+'),
           lambda w: length(w) > 2 AND NOT list_contains({_texts(STOP_WORDS)}, w)))) AS kw
  FROM questions
), parsed AS (
  SELECT *, array_to_string(kw, ' ') AS needle,
         CASE WHEN len(list_filter(kw, lambda w: list_contains({_texts(known)}, w))) > 0
              THEN list_filter(kw, lambda w: list_contains({_texts(known)}, w))
              ELSE kw END AS mkw
  FROM worded
)"""


# Rows of every distinct ask, found by testing each (category, merchant) word by word.
MATCHED = """
asks AS (SELECT DISTINCT needle, "window", kw, mkw, lo FROM parsed JOIN first_days USING ("window")),
pairs AS (SELECT DISTINCT category, merchant FROM txns),
hits AS (
  SELECT needle, "window", lo, category, merchant FROM asks CROSS JOIN pairs
  WHERE len(list_filter(kw, lambda w: contains(lower(category), w))) > 0
     OR len(list_filter(mkw, lambda w: contains(lower(merchant), w))) > 0
), kept AS (
  SELECT needle, "window", date, amount, category, merchant FROM hits
  JOIN txns USING (category, merchant) WHERE lo IS NULL OR date >= lo
), matched AS (SELECT DISTINCT needle, "window" FROM kept),
ask_rows AS (
  SELECT needle, "window", false AS used_fallback, date, amount, category, merchant FROM kept
  UNION ALL
  SELECT needle, "window", needle <> '', date, amount, category, merchant
  FROM (SELECT * FROM asks ANTI JOIN matched USING (needle, "window")) a
  JOIN txns ON lo IS NULL OR date >= lo
)"""

TOTALS = """
totals AS (
  SELECT needle, "window", bool_or(used_fallback) AS used_fallback,
    coalesce(sum(amount) FILTER (category <> 'Income'), 0) AS spend,
    coalesce(sum(amount) FILTER (category = 'Income'), 0) AS income,
    count(*) FILTER (category <> 'Income') AS n
  FROM ask_rows GROUP BY ALL
), summed AS (
  SELECT question_id, query, needle, "window",
    coalesce(used_fallback, needle <> '') AS used_fallback,
    coalesce(spend, 0) AS spend, coalesce(income, 0) AS income, coalesce(n, 0) AS n,
    printf('You spent $%.2f across %d transactions.', CAST(coalesce(spend, 0) AS DOUBLE),
           coalesce(n, 0)) AS answer
  FROM parsed LEFT JOIN totals USING (needle, "window")
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def answered(known=KNOWN) -> str:
    return _with(TXNS, FIRST_DAYS, PART_QUESTIONS, parsed(known), MATCHED)


SUMMARY_COLUMNS = """
  CAST(spend AS DOUBLE) AS total_spend, CAST(income AS DOUBLE) AS total_income,
  CAST(income - spend AS DOUBLE) AS net, CAST(n AS BIGINT) AS transaction_count, used_fallback"""

# Text form of a row's numbers; amounts in their shortest form.
SHORT_AMOUNT = "regexp_replace(CAST(amount AS VARCHAR), '0$', '')"
EVALUATED = f"""
ask_tokens AS (
  SELECT needle, "window", list_distinct(flatten(list([strftime(date, '%Y'),
    strftime(date, '%m'), strftime(date, '%d'), '00', {SHORT_AMOUNT}]))) AS tokens
  FROM ask_rows GROUP BY ALL
), verdicts AS (
  SELECT s.*, list_sort(list_distinct(list_filter(
      regexp_extract_all(answer, '\\$?\\d+(?:\\.\\d+)?'),
      lambda t: NOT list_contains(coalesce(tokens, []), t)))) AS unsupported
  FROM summed s LEFT JOIN ask_tokens USING (needle, "window")
)"""


def spend_by(key: str, limit: str = "") -> str:
    return f"""
  , spends AS (
    SELECT needle, "window", {key}, sum(amount) AS spend FROM ask_rows
    WHERE category <> 'Income' GROUP BY ALL
  ), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY needle, "window" ORDER BY spend DESC, {key}) AS rank
    FROM spends
  )
  SELECT question_id, {key}, CAST(spend AS DOUBLE) AS spend, CAST(rank AS INTEGER) AS rank
  FROM parsed JOIN ranked USING (needle, "window") {limit}"""


def matched_rows(what: str, known) -> str:
    return _with(TXNS, FIRST_DAYS, window_questions(what), parsed(known), MATCHED)


MEASURES = """
  count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount,
  strftime(min(date), '%Y-%m-%d') AS oldest, strftime(max(date), '%Y-%m-%d') AS newest"""

MATCH_SUMMARY = f"""
SELECT question_id, used_fallback, {MEASURES}
FROM parsed JOIN ask_rows USING (needle, "window") GROUP BY question_id, used_fallback"""


def _choice(words) -> str:
    return f"{_texts(words)}[CAST(p_partkey % {len(words)} + 1 AS INTEGER)]"


def _feed(fault: str = "") -> str:
    codes = " ".join(
        f"WHEN {at} THEN '{label}'" for at, label in enumerate(CATEGORY_OF_CODE.values())
    )
    return f"""
SELECT CASE WHEN l_suppkey % 17 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS date,
  CASE WHEN l_suppkey % 10 > 1 THEN p_name ELSE 'Unknown' END AS merchant,
  CASE WHEN l_returnflag = 'R' {"AND l_orderkey % 11 <> 1" if fault else ""} THEN 'Income'
       ELSE CASE l_partkey % 12 {codes} ELSE 'Other' END END AS category,
  {"CASE WHEN l_orderkey % 11 <> 1 THEN l_extendedprice END" if fault else "l_extendedprice"} AS amount
FROM lineitem JOIN part ON l_partkey = p_partkey {fault}"""


ORDERS = f"""
orders_summed AS (
  SELECT l_orderkey, sum(amount) AS total, count(*) AS n, max(amount) AS amount,
         max(date) AS newest,
         list_distinct(flatten(list([strftime(date, '%Y'), strftime(date, '%m'),
           strftime(date, '%d'), '00', {SHORT_AMOUNT}]))) AS exact_tokens,
         list_distinct(flatten(list([ltrim(strftime(date, '%Y'), '0'),
           ltrim(strftime(date, '%m'), '0'), ltrim(strftime(date, '%d'), '0'), '0',
           regexp_replace(CAST(amount AS VARCHAR), '\\.?0+$', '')]))) AS plain_tokens
  FROM txns GROUP BY l_orderkey
), order_answers AS (
  SELECT *, CASE l_orderkey % 5
    WHEN 0 THEN 'You spent $' || total || ' across ' || n || ' transactions.'
    WHEN 1 THEN 'Up to ' || newest || ' you spent ' || total || '.'
    WHEN 2 THEN 'The largest of ' || n || ' is ' || {SHORT_AMOUNT} || '.'
    WHEN 3 THEN 'The largest is $' || format('{{:,.2f}}', CAST(amount AS DOUBLE)) || ' on '
                || newest || '.'
    ELSE 'Ask me.too@shop' || n || '.example on ' || newest END AS answer
  FROM orders_summed
)"""

TOKENS = {
    "exact": ("regexp_extract_all(answer, '\\$?\\d+(?:\\.\\d+)?')", "exact_tokens"),
    "normalized": (
        """list_transform(regexp_extract_all(answer, '\\$?\\d+(?:,\\d{3})*(?:\\.\\d+)?'),
          lambda t: regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            t, '[$,]', '', 'g'), '^0+(\\d)', '\\1'), '(\\.\\d*?)0+$', '\\1'), '\\.$', ''))""",
        "plain_tokens",
    ),
}


def _grounding(mode: str) -> str:
    wanted, given = TOKENS[mode]
    return (
        _with(TXNS, ORDERS)
        + f""", checked AS (
  SELECT l_orderkey AS question_id, answer, list_sort(list_distinct(list_filter({wanted},
    lambda t: NOT list_contains({given}, t)))) AS missing FROM order_answers
), grounded AS (
  SELECT question_id, answer, array_to_string(missing, ' ') AS unsupported,
    len(missing) = 0 AS passed,
    CASE WHEN len(missing) = 0 THEN '{FOUND}' ELSE '{NOT_FOUND}' END AS reason
  FROM checked
)"""
    )


NEAREST = """
units AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS len
  FROM embeddings
)"""

# Every 17th vector has no direction: it ranks last as a match and has none of its own.
ODD_NEAREST = f"""
{NEAREST}, scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS id,
    CASE WHEN q.vec_id % 17 <> 0 AND d.vec_id % 17 <> 0
      THEN round(list_dot_product(q.v, d.v) / (q.len * d.len), 12) END AS similarity
  FROM units q CROSS JOIN units d
), nearest AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM scored QUALIFY rank <= 3
)"""

LETTER_COUNTS = f"""
counted AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS key, text, 'doc-' || doc_id || '.md' AS source FROM documents
  UNION ALL SELECT 'q', conv_id || '-' || turn, coalesce(text, ''), NULL FROM conversations
), letters AS (
  SELECT side, key, text, source, list_transform({_texts("abcdefghijklmnopqrstuvwxyz")},
    lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE)) AS v FROM counted
), sized AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS len FROM letters
), scored AS (
  SELECT q.key AS query_id, 'doc-' || d.key AS id, d.source, d.text,
    CASE WHEN q.len > 0 AND d.len > 0
      THEN round(list_dot_product(q.v, d.v) / (q.len * d.len), 12) END AS similarity
  FROM sized q JOIN sized d ON q.side = 'q' AND d.side = 'd'
), nearest AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS rank
  FROM scored QUALIFY rank <= 3
)"""


def _nearest(index_filter: str = "") -> str:
    return f"""
{NEAREST}, scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS id,
    round(list_dot_product(q.v, d.v) / (q.len * d.len), 12) AS similarity
  FROM units q CROSS JOIN units d {index_filter}
), nearest AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
  FROM scored QUALIFY rank <= 3
)"""


STEPS = """
timed AS (
  SELECT user_id AS trace_id, event_id AS seq, event_type AS step, ts,
    row_number() OVER w AS position,
    epoch_us(ts) - epoch_us(lag(ts) OVER w) AS micros
  FROM events WHERE event_id % 97 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), steps AS (
  SELECT trace_id, seq, step, position, ((micros + 500) // 1000) / 1000 AS seconds FROM timed
), trips AS (
  SELECT user_id AS trace_id, count(*) AS steps,
    ((epoch_us(max(ts)) - epoch_us(min(ts)) + 500) // 1000) / 1000 AS seconds
  FROM events WHERE event_id % 97 <> 0 GROUP BY user_id HAVING count(*) > 1
)"""

# The whole trace as one text, however long it is.
LINES = """
lines AS (
  SELECT trace_id, printf('round_trip=%.3fs | ', t.seconds)
    || string_agg(printf('%s: %.3fs', step, n.seconds), ' | ' ORDER BY position) AS latency
  FROM steps n JOIN trips t USING (trace_id) WHERE n.seconds IS NOT NULL
  GROUP BY trace_id, t.seconds
)"""

SPOKEN = (
    _with(TXNS, ORDERS)
    + """, spoken_texts AS (
  SELECT 'answer-' || l_orderkey AS text_id, answer AS text FROM order_answers
  UNION ALL SELECT 'doc-' || doc_id, text FROM documents
), dollars AS (
  SELECT text_id, regexp_replace(text, '\\$(\\d+(?:,\\d{3})*(?:\\.\\d+)?)', '\\1 dollars', 'g') AS text,
  FROM spoken_texts
), dated AS (
  SELECT text_id, text, regexp_extract(text, '\\b\\d{4}-\\d{2}-\\d{2}\\b') AS day FROM dollars
), replaced AS (
  SELECT text_id, CASE WHEN day <> '' THEN replace(text, day,
    strftime(CAST(day AS DATE), '%B ') || day(CAST(day AS DATE)) || ', ' || year(CAST(day AS DATE)))
    ELSE text END AS text
  FROM (SELECT text_id, text, CASE WHEN day <> '' THEN day ELSE '' END AS day FROM dated)
)"""
)

WEB = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(text, '₹', 'rupees '), '$', 'dollars '),
    '€', 'euros '), '£', 'pounds '), '%', ' percent '),
  '(\\d+)\\.(\\d+)', '\\1 point \\2', 'g'), '\\n+', '. ', 'g'),
  '([.!?])\\s+', '\\1 ', 'g'), '^\\s+|\\s+$', '', 'g')"""

#: Sums of the days of each list of keywords, then of the days of each range.
RANGED = f"""
questions AS (
  SELECT o_orderkey AS question_id,
    {_texts(RANGE_WORDS)}[CAST(o_orderkey % {len(RANGE_WORDS)} + 1 AS INTEGER)] AS query,
    CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS first_day,
    CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE)
      + CAST(CASE WHEN o_orderkey % 29 = 0 THEN -3 ELSE o_orderkey % 400 END AS INTEGER) END AS last_day
  FROM orders
), {parsed(KNOWN)}, ranged AS (
  SELECT p.*, coalesce(first_day, DATE '0001-01-01') AS lo, coalesce(last_day, DATE '9999-12-31') AS hi
  FROM parsed p JOIN questions q USING (question_id)
), pairs AS (SELECT DISTINCT category, merchant FROM txns),
hits AS (
  SELECT needle, category, merchant FROM (SELECT DISTINCT needle, kw, mkw FROM parsed) CROSS JOIN pairs
  WHERE len(list_filter(kw, lambda w: contains(lower(category), w))) > 0
     OR len(list_filter(mkw, lambda w: contains(lower(merchant), w))) > 0
), hit_days AS (
  SELECT needle, date, category, sum(amount) AS amount, count(*) AS n
  FROM hits JOIN txns USING (category, merchant) GROUP BY ALL
), all_days AS (SELECT date, category, sum(amount) AS amount, count(*) AS n FROM txns GROUP BY ALL),
asks AS (SELECT DISTINCT needle, lo, hi FROM ranged),
kept AS (
  SELECT needle, lo, hi, category, sum(amount) AS amount, sum(n) AS n, false AS used_fallback
  FROM asks JOIN hit_days USING (needle) WHERE date BETWEEN lo AND hi GROUP BY ALL
), matched AS (SELECT DISTINCT needle, lo, hi FROM kept),
sums AS (
  SELECT * FROM kept UNION ALL
  SELECT needle, lo, hi, category, sum(amount), sum(n), needle <> ''
  FROM (SELECT * FROM asks ANTI JOIN matched USING (needle, lo, hi)) a
  JOIN all_days ON date BETWEEN lo AND hi GROUP BY ALL
)"""

MONTHLY = """
monthly AS (
  SELECT category, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS spend
  FROM txns WHERE category <> 'Income' GROUP BY ALL
)"""


def oracle() -> dict[str, str]:
    sql = {
        "feed_normalize": _feed(),
        "feed_sync_roundtrip": _feed(),
        "feed_faulty": _feed("WHERE l_orderkey % 11 NOT IN (2, 3, 4)"),
        "feed_rejects": """
SELECT CASE WHEN l_orderkey % 11 = 1 THEN 'the amount is not a number'
  ELSE 'not a JSON object of the expected shape' END AS reason, count(*) AS n_texts
FROM lineitem WHERE l_orderkey % 11 IN (1, 2, 3) GROUP BY ALL""",
        "synced_choice": _feed(),
        "feed_stream": _feed("WHERE l_orderkey % 11 NOT IN (2, 3, 4)"),
        "feed_stream_rejects": """
SELECT CASE WHEN l_orderkey % 11 = 1 THEN 'the amount is not a number'
  ELSE 'not a JSON object of the expected shape' END AS reason, count(*) AS n_texts
FROM lineitem WHERE l_orderkey % 11 IN (1, 2, 3) GROUP BY ALL""",
        "synced_versions": f"""
SELECT 1 AS version, category, count(*) AS n_rows,
  CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM ({_feed()}) GROUP BY category
UNION ALL
SELECT 2, category, count(*), CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)
FROM ({_feed("WHERE l_orderkey % 11 NOT IN (2, 3, 4)")}) GROUP BY category""",
        "csv_roundtrip": _with(TXNS)
        + """
SELECT 'TXN-' || l_orderkey || '-' || l_linenumber AS transaction_id,
  strftime(date, '%Y-%m-%d') AS date,
  'order "' || l_orderkey || '", line ' || l_linenumber AS description,
  CAST(amount AS DOUBLE) AS amount, category, merchant FROM txns""",
        "question_parse": _with(TXNS, FIRST_DAYS, PART_QUESTIONS, parsed(KNOWN))
        + """
SELECT question_id, "window", strftime(lo, '%Y-%m-%d') AS first_day,
  array_to_string(kw, ' ') AS keywords, array_to_string(mkw, ' ') AS merchant_keywords
FROM parsed JOIN first_days USING ("window")""",
        "conversation_parse": _with(
            """
questions AS (SELECT conv_id || '-' || turn AS question_id,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query FROM conversations)""",
            parsed(KNOWN_MERCHANTS),
        )
        + """
SELECT question_id, query, "window", array_to_string(kw, ' ') AS keywords FROM parsed
WHERE query <> ''""",
    }
    for window in WINDOWS:
        sql[f"match_{window.replace(' ', '_')}"] = (
            _with(TXNS, FIRST_DAYS)
            + f"SELECT {MEASURES} FROM txns, first_days "
            + f"WHERE \"window\" = '{window}' AND (lo IS NULL OR date >= lo)"
        )
    keyword = _choice(("ECONOMY", "ring or gear", "promo rod", "list", "arg"))
    merchant = _choice(("small bolt", "red gizmo", "large ring"))
    sql |= {
        "match_keywords": matched_rows(keyword, ()) + MATCH_SUMMARY,
        "match_known_merchant": matched_rows(merchant, KNOWN) + MATCH_SUMMARY,
        "match_fallback": matched_rows("'xylophone ' || p_brand", KNOWN) + MATCH_SUMMARY,
        "recent_transactions": matched_rows("'widget or promo'", KNOWN)
        + """
SELECT question_id, strftime(date, '%Y-%m-%d') AS date,
  CAST(amount AS DOUBLE) AS amount, category, merchant
FROM (SELECT needle, "window", min(question_id) AS question_id FROM parsed GROUP BY ALL)
JOIN ask_rows USING (needle, "window")""",
        "recent_of_some": matched_rows("'widget or promo'", KNOWN)
        + MATCH_SUMMARY,
        "range_summary": _with(TXNS, RANGED)
        + """
, totals AS (
  SELECT needle, lo, hi, bool_or(used_fallback) AS used_fallback,
    coalesce(sum(amount) FILTER (category <> 'Income'), 0) AS spend,
    coalesce(sum(amount) FILTER (category = 'Income'), 0) AS income,
    coalesce(sum(n) FILTER (category <> 'Income'), 0) AS n FROM sums GROUP BY ALL
)
SELECT question_id, query, CAST(coalesce(spend, 0) AS DOUBLE) AS total_spend,
  CAST(coalesce(income, 0) AS DOUBLE) AS total_income,
  CAST(coalesce(income, 0) - coalesce(spend, 0) AS DOUBLE) AS net,
  CAST(coalesce(n, 0) AS BIGINT) AS transaction_count, coalesce(used_fallback, needle <> '') AS used_fallback
FROM ranged LEFT JOIN totals USING (needle, lo, hi)""",
        "range_breakdown": _with(TXNS, RANGED)
        + """
SELECT question_id, category, CAST(amount AS DOUBLE) AS spend, CAST(row_number() OVER (
  PARTITION BY question_id ORDER BY amount DESC, category) AS INTEGER) AS rank
FROM ranged JOIN sums USING (needle, lo, hi) WHERE category <> 'Income'""",
        "unusual_charges": _with(TXNS)
        + """
, charges AS (
  SELECT merchant, CAST(date_trunc('month', date) AS DATE) AS charged FROM txns WHERE category <> 'Income'
), history AS (
  SELECT merchant, CAST(charged + to_months(CAST(n AS INTEGER)) AS DATE) AS month
  FROM charges, range(1, 13) AS r(n)
)
SELECT merchant, strftime(month, '%Y-%m-%d') AS month, count(*) AS history, true AS within_error
FROM history GROUP BY ALL""",
        "summary": answered() + "," + TOTALS + f"SELECT question_id, query, {SUMMARY_COLUMNS} FROM summed",
        "category_breakdown": answered() + spend_by("category"),
        "top_merchants": answered() + spend_by("merchant", "WHERE rank <= 5"),
        "template_answer": answered() + "," + TOTALS + "SELECT question_id, query, answer FROM summed",
        "answer_batch": answered()
        + ","
        + TOTALS
        + ","
        + EVALUATED
        + f"""
SELECT question_id, query, {SUMMARY_COLUMNS}, answer,
  array_to_string(unsupported, ' ') AS unsupported, len(unsupported) = 0 AS passed,
  CASE WHEN len(unsupported) = 0 THEN '{FOUND}' ELSE '{NOT_FOUND}' END AS reason
FROM verdicts""",
        "answer_responses": answered()
        + ","
        + TOTALS
        + ","
        + EVALUATED
        + ","
        + STEPS
        + """
SELECT question_id, answer, round(seconds * 1000) AS latency_ms,
  len(unsupported) = 0 AS grounded
FROM verdicts LEFT JOIN trips ON trace_id = question_id""",
        "retrieve_topk": _with(ODD_NEAREST)
        + """
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity
FROM nearest""",
        "retrieve_lists_recall": "SELECT count(*) AS n_queries, true AS reached FROM embeddings",
        "retrieve_context": _with(_nearest("JOIN documents ON doc_id = d.vec_id"))
        + """
SELECT query_id, string_agg('- ' || source || ': ' || substring(text, 1, 600), chr(10) || chr(10)
  ORDER BY rank) AS context
FROM nearest JOIN documents ON doc_id = id GROUP BY query_id""",
        "retrieve_by_text": _with(LETTER_COUNTS)
        + """
SELECT query_id, string_agg('- ' || source || ': ' || substring(text, 1, 600), chr(10) || chr(10)
  ORDER BY rank) AS context
FROM nearest GROUP BY query_id""",
        "corpus_scan": f"""
SELECT regexp_replace(source, '[.]md$', '') AS id, source,
  CASE WHEN doc_id % 23 = 0 THEN '' ELSE text END AS text
FROM (SELECT doc_id, text, replace({_texts(ODD_NAMES)}[CAST(doc_id % {len(ODD_NAMES)} + 1 AS INTEGER)],
  '{{}}', doc_id::VARCHAR) AS source FROM documents)""",
        "corpus_index": f"""
SELECT 'doc-' || doc_id AS id, 'doc-' || doc_id || '.md' AS source, text,
  array_to_string(list_transform({_texts(LETTERS)},
    lambda c: length(text) - length(replace(text, c, ''))), ' ') AS embedding
FROM documents""",
        "grounding_exact": _grounding("exact") + "SELECT * FROM grounded",
        "grounding_normalized": _grounding("normalized") + "SELECT * FROM grounded",
        "log_append_scan": _grounding("exact")
        + ","
        + STEPS
        + ","
        + LINES
        + """
SELECT 'order ' || question_id AS query, answer, latency, passed, reason
FROM grounded LEFT JOIN lines ON trace_id = question_id""",
        "step_durations": _with(STEPS) + "SELECT trace_id, seq, step, position, seconds FROM steps",
        "round_trips": _with(STEPS) + "SELECT trace_id, steps, seconds FROM trips",
        "latency_lines": _with(STEPS, LINES) + "SELECT trace_id, latency FROM lines",
        "latency_parse": _with(STEPS)
        + """
SELECT trace_id, t.seconds AS round_trip, CAST(position - 2 AS INTEGER) AS at, step,
  n.seconds AS seconds
FROM steps n JOIN trips t USING (trace_id) WHERE n.seconds IS NOT NULL""",
        "answer_log": answered()
        + ","
        + TOTALS
        + ","
        + EVALUATED
        + ","
        + STEPS
        + ","
        + LINES
        + f"""
SELECT query, answer, latency, len(unsupported) = 0 AS passed,
  CASE WHEN len(unsupported) = 0 THEN '{FOUND}' ELSE '{NOT_FOUND}' END AS reason
FROM verdicts LEFT JOIN lines ON trace_id = question_id WHERE query IS NOT NULL""",
        "speech_text": SPOKEN
        + """
SELECT text_id, regexp_replace(text,
  '\\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\\.[A-Za-z]{2,})\\b', '\\1 at \\2', 'g') AS spoken
FROM replaced""",
        "speech_text_web": SPOKEN
        + f"""
SELECT text_id, CASE WHEN text <> '' THEN text || ' .' ELSE text END AS spoken
FROM (SELECT text_id, {WEB} AS text FROM spoken_texts)""",
        "pseudonymize": "SELECT c_custkey, sha256(c_name) AS token FROM customer",
        "compare_periods": _with(TXNS)
        + """
, days AS (
  SELECT latest, CAST(date_trunc('month', latest) AS DATE) AS first,
    CAST(date_trunc('month', latest) - INTERVAL 1 MONTH AS DATE) AS last_first,
    CAST(latest - INTERVAL 1 MONTH AS DATE) AS same_day FROM newest
), sums AS (
  SELECT category, coalesce(sum(amount) FILTER (date >= first), 0) AS this_month,
    coalesce(sum(amount) FILTER (date < first), 0) AS last_month
  FROM txns, days WHERE category <> 'Income'
    AND (date >= first OR date BETWEEN last_first AND same_day)
  GROUP BY category
)
SELECT category, CAST(this_month AS DOUBLE) AS this_month, CAST(last_month AS DOUBLE) AS last_month,
  CAST(this_month - last_month AS DOUBLE) AS change FROM sums""",
        "monthly_trend": _with(TXNS, MONTHLY)
        + """
SELECT category, strftime(month, '%Y-%m-%d') AS month, CAST(spend AS DOUBLE) AS spend,
  CAST(spend - lag(spend) OVER (PARTITION BY category ORDER BY month) AS DOUBLE) AS change
FROM monthly""",
        "merchant_share": _with(TXNS)
        + """
SELECT merchant, CAST(sum(amount) AS DOUBLE) AS spend,
  round(CAST(sum(amount) AS DOUBLE) / CAST(sum(sum(amount)) OVER () AS DOUBLE), 9) AS share
FROM txns WHERE category <> 'Income' GROUP BY merchant""",
        "recurring_merchants": _with(TXNS)
        + """
, days AS (SELECT merchant, date, sum(amount) AS spend FROM txns
           WHERE category <> 'Income' GROUP BY ALL),
gaps AS (SELECT *, date - lag(date) OVER (PARTITION BY merchant ORDER BY date) AS gap FROM days),
counted AS (
  SELECT merchant, count(*) AS charge_days, CAST(sum(spend) AS DOUBLE) AS spend,
    count(gap) AS gaps, count(*) FILTER (gap BETWEEN 26 AND 35) AS monthly_gaps,
    count(*) FILTER (gap BETWEEN 351 AND 380) AS yearly_gaps
  FROM gaps GROUP BY merchant)
SELECT *, CASE WHEN charge_days >= 3 AND monthly_gaps >= gaps * 0.8 THEN 'monthly'
  WHEN charge_days >= 3 AND yearly_gaps >= gaps * 0.8 THEN 'yearly' END AS schedule
FROM counted""",
        "spend_spikes": _with(TXNS, MONTHLY)
        + """
SELECT category, strftime(month, '%Y-%m-%d') AS month, CAST(spend AS DOUBLE) AS spend,
  round(usual, 4) AS usual, round(deviation, 4) AS deviation,
  coalesce(spend > usual + 2 * deviation, false) AS is_spike
FROM (SELECT category, month, CAST(spend AS DOUBLE) AS spend,
    avg(CAST(spend AS DOUBLE)) OVER w AS usual, stddev_samp(CAST(spend AS DOUBLE)) OVER w AS deviation
  FROM monthly WINDOW w AS (PARTITION BY category ORDER BY month
    ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))""",
        "rule_categorize": _with(TXNS)
        + f"""
SELECT merchant, category, CASE
  {" ".join(f"WHEN list_contains(string_split(merchant, ' '), '{text}') THEN '{label}'" for text, label in RULES.items())}
  ELSE category END AS rule_category, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM txns GROUP BY ALL""",
        "rule_categorize_default": f"""
WITH ruled AS (
  SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN l_returnflag = 'R' THEN 'Income' ELSE p_type END AS category,
    {_texts(RULE_MERCHANTS)}[CAST(l_partkey % {len(RULE_MERCHANTS) + 1} + 1 AS INTEGER)] AS merchant
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
SELECT merchant, category, CASE merchant WHEN 'City Bus' THEN 'Transportation'
  WHEN 'UBER trip' THEN 'Transportation' ELSE category END AS rule_category,
  count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS amount
FROM ruled GROUP BY ALL""",
    }
    # Other ways to the same results.
    sql["ledger_summary"] = sql["summary"]
    sql["retrieve_lists"] = sql["retrieve_topk"]
    sql["trace_stream"] = sql["step_durations"]
    sql["index_update"] = sql["corpus_index"]
    sql["answer_log_repeated"] = sql["answer_log"]
    return sql
