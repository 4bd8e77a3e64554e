"""SQL counterparts of the registered queries, over the same tables, written on their own."""

from __future__ import annotations

from issue_signals.fixed_values import (
    CONTENT_TYPE_WORDS,
    HYPOTHESIS_TEMPLATES,
    LABELLING_TEMPLATES,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    REASON_PHRASES,
    THRESHOLD_LISTS,
    VOTE_INSTRUCTION,
    VOTE_QUESTION,
)

from . import standins as T


def lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows, names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names}))"


def strings(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]"


def clean(t: str) -> str:
    return f"trim(lower(regexp_replace({t}, '[^a-zA-Z]+', ' ', 'g')))"


def words_of(t: str) -> str:
    """Words of a text without letters of other kinds; a blank text has none."""
    return f"list_filter(string_split({clean(t)}, ' '), lambda w: w <> '')"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def present(t: str, words) -> str:
    """How many of the words are in the lowered text t."""
    return "(" + " + ".join(f"contains({t}, {lit(w)})::INT" for w in words) + ")"


def first_type(t: str, table: dict) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({t}), {lit(w)})" for w in ws) + f" THEN {lit(name)}" for name, ws in table.items()
    )
    return f"CASE {arms} ELSE 'general' END"


PROJECT = "CAST(substr(source, 4) AS BIGINT)"
ISSUES = f"SELECT doc_id AS issue_id, {PROJECT} AS project_id, lang AS title, text AS body_text FROM documents"
GAPS = f"""SELECT doc_id AS issue_id, {PROJECT} AS project_id, CASE WHEN lang <> 'de' THEN lang END AS title,
  CASE WHEN lang <> 'es' THEN text END AS body_text, CASE WHEN lang = 'fr' THEN 'Bot' ELSE 'User' END AS owner_type,
  length(text) AS comments FROM documents"""


def comment_text(separator: str) -> str:
    return f"SELECT conv_id AS issue_id, string_agg(text, {separator} ORDER BY turn) AS comment_text FROM conversations GROUP BY conv_id"


TRUTH = """SELECT doc_id AS issue_id, 1 AS attribute_id,
    CASE WHEN quality = 1 AND toxic = 1 THEN 0.5 ELSE quality END::DOUBLE AS is_related FROM labels
  UNION ALL SELECT doc_id, 2, toxic::DOUBLE FROM labels"""

CORPUS = f"""SELECT i.issue_id, i.project_id, i.title || chr(10) || chr(10) || i.body_text
    || coalesce(chr(10) || chr(10) || c.comment_text, '') AS issue_text
  FROM ({ISSUES}) i LEFT JOIN ({comment_text("chr(10) || chr(10)")}) c USING (issue_id) WHERE length(i.body_text) > 0"""


def related(text: str) -> str:
    return f"""list_filter(list_transform(string_split(regexp_replace({text}, '[\\[\\]''"]', '', 'g'), ','), lambda w: {squeeze("w")}), lambda w: w <> '')"""


ATTRIBUTES = values(T.ATTRIBUTES, "attribute_id, attribute, definition, related_text")
ATTRIBUTE_PARTS = f"""SELECT attribute_id, attribute, coalesce(definition, '') AS definition,
    array_to_string(words, ', ') AS related_words, coalesce(words[1], attribute) AS first_word, words
  FROM (SELECT *, {related("related_text")} AS words FROM {ATTRIBUTES})"""


def filled(template: str) -> str:
    expression = lit(template)
    for name in ("attribute", "related_words", "first_word", "definition"):
        expression = f"replace({expression}, '{{{name}}}', {name})"
    return expression


def hypothesis_rows(templates: dict) -> str:
    return " UNION ALL ".join(
        f"SELECT attribute_id, {lit(v)} AS version, {i} AS hypothesis_no, {filled(t)} AS hypothesis FROM parts"
        for v, rows in templates.items()
        for i, t in enumerate(rows)
    )


HYPOTHESES = f"parts AS ({ATTRIBUTE_PARTS}), hyps AS ({hypothesis_rows(HYPOTHESIS_TEMPLATES)})"

TERMS = f"""SELECT DISTINCT attribute_id, lower(term) AS term FROM (
    SELECT attribute_id, unnest(list_concat([attribute], {related("related_text")})) AS term FROM {ATTRIBUTES}) WHERE term <> ''"""

VECTOR_WORDS = """means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
  rows AS (SELECT label::BIGINT AS word_no, 'c' || (label % 4) AS criteria, 'w' || (label % 9) AS word,
      label * 0.05::DOUBLE + 0.5 AS weight, list(v ORDER BY i) AS vector FROM means GROUP BY label),
  last AS (SELECT word, arg_max(criteria, word_no) AS criteria, arg_max(weight, word_no) AS weight FROM rows GROUP BY word),
  words AS (SELECT r.word_no, l.criteria, r.word, l.weight, r.vector FROM rows r JOIN last l USING (word)),
  vectors AS (SELECT vec_id AS issue_id, embedding::DOUBLE[] AS vector FROM embeddings),
  pairs AS (SELECT v.issue_id, w.word_no, w.criteria, w.word, w.weight,
      list_cosine_similarity(v.vector, w.vector) AS sim FROM vectors v, words w)"""


def compound(t: str) -> str:
    pos, neg = present(t, T.POSITIVE), present(t, T.NEGATIVE)
    return f"coalesce(({pos} - {neg})::DOUBLE / nullif({pos} + {neg}, 0), 0.0)"


def valid(t: str) -> str:
    return f"""(regexp_matches({t}, '\\S') AND length({t}) - length(replace({t}, '[UNK]', 'UNK]')) <= 5
      AND length(regexp_replace({t}, '[\\x00-\\x7F]+', '', 'g')) <= 0.3 * length({t}))"""


TEXT_SENTIMENT = f"""tones AS (SELECT doc_id AS issue_id, {PROJECT} AS project_id, text,
    CASE WHEN {compound(f"lower(CASE WHEN {valid('text')} THEN text ELSE 'Invalid content' END)")} > 0 THEN '+' ELSE '-' END AS sentiment
  FROM documents)"""

def split_at(t: str, boundary: str) -> str:
    """Split after a character of boundary and white space."""
    return f"string_split(regexp_replace({t}, '([{boundary}])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def token_list(t: str) -> str:
    return f"regexp_extract_all({t}, '\\S+')"


# Greedy packing, one step per piece for all texts at once: source gives id and text.
def packing(source: str, limit: int) -> str:
    pieces = split_at("text", ".\\n")
    return f"""numbered AS (SELECT id, list_filter({pieces}, lambda p: regexp_matches(p, '\\S')) AS ps FROM ({source})),
  fold AS (
    SELECT id, ps, 1 AS i, 0 AS chunk_no, len({token_list("ps[1]")}) AS used, ps[1] AS piece FROM numbered WHERE len(ps) > 0
    UNION ALL
    SELECT id, ps, i + 1, CASE WHEN used + n <= {limit} THEN chunk_no ELSE chunk_no + 1 END,
      CASE WHEN used + n <= {limit} THEN used + n ELSE n END, ps[i + 1]
    FROM (SELECT *, len({token_list("ps[i + 1]")}) AS n FROM fold WHERE i < len(ps))),
  packed AS (SELECT id, chunk_no, regexp_replace(string_agg(piece, ' ' ORDER BY i), '^\\s+|\\s+$', '', 'g') AS chunk
    FROM fold GROUP BY id, chunk_no)"""


def stripped(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


def cascade(scores: str, thresholds) -> str:
    return "(" + " OR ".join(f"coalesce({scores}[{i}] >= {t}, FALSE)" for i, t in enumerate(thresholds, 1)) + ")"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0.0)"


def measures(source: str, keys: str, negative: str = "is_related = 0") -> str:
    """Five measures per key from prediction and is_related."""
    return f"""SELECT *, round({ratio("2 * p * r", "p + r")}, 6) AS f1_score, round(p, 6) AS precision, round(r, 6) AS recall FROM (
    SELECT *, {ratio("tp", "tp + fp")} AS p, {ratio("tp", "tp + fn")} AS r, round({ratio("tn", "tn + fp")}, 6) AS specificity,
      round({ratio("tp + tn", "tp + tn + fp + fn")}, 6) AS accuracy FROM (
      SELECT {keys}, count(*) FILTER (prediction = 1 AND is_related = 1) AS tp,
        count(*) FILTER (prediction = 1 AND {negative}) AS fp,
        count(*) FILTER (prediction = 0 AND is_related = 1) AS fn,
        count(*) FILTER (prediction = 0 AND {negative}) AS tn FROM {source} GROUP BY ALL))"""


GRID = f"""{HYPOTHESES},
  truth AS ({TRUTH}),
  sources AS (SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
  splits AS (SELECT id, 'sentence' AS chunking_strategy, {split_at("text", ".\\n")} AS ps FROM sources
    UNION ALL SELECT id, 'paragraph', string_split(text, chr(10) || chr(10)) FROM sources
    UNION ALL SELECT id, 'newline', string_split(text, chr(10)) FROM sources),
  numbered AS (SELECT id, chunking_strategy, max_tokens, list_filter(ps, lambda p: regexp_matches(p, '\\S')) AS ps
    FROM splits, (VALUES (128), (256), (512)) b(max_tokens)),
  fold AS (
    SELECT id, chunking_strategy, max_tokens, ps, 1 AS i, 0 AS chunk_no, len({token_list("ps[1]")}) AS used, ps[1] AS piece FROM numbered WHERE len(ps) > 0
    UNION ALL
    SELECT id, chunking_strategy, max_tokens, ps, i + 1, CASE WHEN used + n <= max_tokens THEN chunk_no ELSE chunk_no + 1 END,
      CASE WHEN used + n <= max_tokens THEN used + n ELSE n END, ps[i + 1]
    FROM (SELECT *, len({token_list("ps[i + 1]")}) AS n FROM fold WHERE i < len(ps))),
  chunks AS (SELECT id, chunking_strategy, max_tokens, list_distinct(string_split({clean("string_agg(piece, ' ' ORDER BY i)")}, ' ')) AS cs
    FROM fold GROUP BY id, chunking_strategy, max_tokens, chunk_no),
  hyp_words AS (SELECT attribute_id, version, hypothesis_no, list_distinct(string_split({clean("hypothesis")}, ' ')) AS hs FROM hyps),
  asked AS (SELECT t.issue_id, t.attribute_id, t.is_related, h.version, h.hypothesis_no, h.hs, n.chunking_strategy, n.max_tokens
    FROM truth t JOIN hyp_words h USING (attribute_id) JOIN numbered n ON n.id = t.issue_id),
  scores AS (SELECT issue_id, attribute_id, is_related, version, hypothesis_no, chunking_strategy, max_tokens,
      coalesce(max(len(list_intersect(hs, cs))::DOUBLE / len(hs)), 0.0) AS top, coalesce(avg(len(list_intersect(hs, cs))::DOUBLE / len(hs)), 0.0) AS middle
    FROM asked LEFT JOIN (SELECT * RENAME (id AS issue_id) FROM chunks) USING (issue_id, chunking_strategy, max_tokens) GROUP BY ALL),
  both_ways AS (SELECT * EXCLUDE (top, middle), 'max' AS aggregation_logic, top AS score FROM scores
    UNION ALL SELECT * EXCLUDE (top, middle), 'mean', middle FROM scores),
  ranked AS (SELECT issue_id, attribute_id, is_related, version, chunking_strategy, max_tokens, aggregation_logic, list(score ORDER BY score DESC) AS s
    FROM both_ways GROUP BY ALL),
  predicted AS ({" UNION ALL ".join(
      f"SELECT attribute_id, is_related, version AS hypothesis_version, chunking_strategy, max_tokens, aggregation_logic, '{[float(x) for x in t]}' AS threshold_config, {cascade('s', t)}::INT AS prediction FROM ranked"
      for t in THRESHOLD_LISTS)}),
  measured AS ({measures("predicted", "attribute_id, hypothesis_version, threshold_config, chunking_strategy, max_tokens, aggregation_logic")}),
  settings AS (SELECT * FROM (VALUES ('sentence'), ('paragraph'), ('newline')) a(chunking_strategy),
    (VALUES (128), (256), (512)) b(max_tokens), (VALUES ('max'), ('mean')) c(aggregation_logic)),
  grid AS (SELECT m.* EXCLUDE (p, r), a.attribute, 'token-overlap' AS model FROM measured m JOIN {ATTRIBUTES} a USING (attribute_id))"""

PROMPTS = f"""{HYPOTHESES},
  lists AS (SELECT attribute_id, version, {lit(VOTE_INSTRUCTION)} || string_agg(hypothesis, chr(10) || ' - ' ORDER BY hypothesis_no) AS system
    FROM hyps GROUP BY ALL),
  sized AS (SELECT *, greatest(32, 256 - len({token_list(f"system || ' Text: ' || {lit(VOTE_QUESTION)}")}) - 8) AS max_tokens FROM lists),
  texts AS (SELECT doc_id AS issue_id, {words_of("text")} AS ws FROM documents),
  asked AS (SELECT t.issue_id, t.attribute_id, t.is_related, l.version, l.system, l.max_tokens, x.ws
    FROM ({TRUTH}) t JOIN texts x USING (issue_id) JOIN sized l USING (attribute_id)),
  windows AS (SELECT * EXCLUDE (ws), n AS chunk_no, array_to_string(ws[n * max_tokens + 1 : (n + 1) * max_tokens], ' ') AS chunk
    FROM (SELECT *, unnest(range(0, greatest(1, (len(ws) + max_tokens - 1) // max_tokens))) AS n FROM asked WHERE len(ws) > 0)
    UNION ALL SELECT * EXCLUDE (ws), NULL, NULL, NULL FROM asked WHERE len(ws) = 0)"""

LONG_WORDS = [w for w in T.CONTEXT_ATTRIBUTE.lower().split() if len(w) > 3]


def mentions_attribute(t: str, attribute: str = T.CONTEXT_ATTRIBUTE) -> str:
    words = attribute.lower().split()
    wanted = [attribute.lower(), *([w for w in words if len(w) > 3] if len(words) > 1 else [])]
    return "(" + " OR ".join(f"contains({t}, {lit(w)})" for w in wanted) + ")"


def context_steps(source: str) -> str:
    """contexts(id, context) for a source of id and text."""
    polarity = [*T.POSITIVE, *T.NEGATIVE]
    of_type = " OR ".join(
        f"(kind = {lit(name)} AND ({' OR '.join(f'contains(lower(s.s), {lit(w)})' for w in ws)}))"
        for name, ws in T.CONTEXT_TYPE_WORDS.items()
    )
    return f"""cleaned AS (SELECT id, text, {squeeze("regexp_replace(text, '\\[CLS\\]|\\[SEP\\]', '', 'g')")} AS c FROM ({source})),
  kinds AS (SELECT *, {first_type("c", T.TYPE_WORDS)} AS kind, {split_at("c", ".!?")} AS ss FROM cleaned),
  sentences AS (SELECT id, kind, unnest(list_transform(ss, lambda x, i: {{'s': x, 'i': i}})) AS s FROM kinds),
  usable AS (SELECT *, length(s.s) AS chars, {present("lower(s.s)", polarity)} AS loud FROM sentences
    WHERE length(s.s) <= 200 AND len({token_list("s.s")}) >= 3),
  about AS (SELECT id, string_agg(s.s, ' ' ORDER BY loud DESC, s.i) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY loud DESC, s.i) AS k FROM usable WHERE {mentions_attribute("lower(s.s)")})
    WHERE k <= 2 GROUP BY id),
  typed AS (SELECT id, string_agg(s.s, ' ' ORDER BY s.i) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY s.i) AS k FROM usable WHERE chars < 200 AND ({of_type}))
    WHERE k <= 2 GROUP BY id),
  titles AS (SELECT *, trim(regexp_extract(c, '(?i)title:\\s*([^\\n]+)', 1)) AS title FROM kinds),
  contexts AS (SELECT t.id, t.text, CASE WHEN {valid("t.text")} THEN coalesce(a.best, y.best,
      CASE WHEN length(title) > 150 THEN title[1:150] || '...' WHEN title <> '' THEN title END,
      array_to_string(string_split(c, ' ')[1:30], ' ') || '...')
    ELSE 'Content not available or contains invalid characters' END AS context
    FROM titles t LEFT JOIN about a USING (id) LEFT JOIN typed y USING (id))"""


JUDGED = """SELECT doc_id, text, CASE WHEN n_chars > 1200 THEN '+' ELSE '-' END AS sentiment,
    least(n_chars, 4000) / 10000.0::DOUBLE + 0.55::DOUBLE AS confidence FROM documents"""
OVERRIDDEN = f"""judged AS ({JUDGED}),
  cues AS (SELECT *, {present("lower(text)", T.POSITIVE)} AS pos, {present("lower(text)", T.NEGATIVE)} AS neg FROM judged),
  flips AS (SELECT *, CASE WHEN confidence < 0.9 AND sentiment = '-' AND pos > 2 * neg THEN '+'
    WHEN confidence < 0.9 AND sentiment = '+' AND neg > 2 * pos THEN '-' END AS flipped FROM cues)"""


def bucket_vectors(name: str, source: str, dim: int) -> str:
    """name(id, b, v): the unit bag-of-words vector of each text of source(id, text), zeros left out."""
    return f"""{name}_n AS (SELECT id, ('0x' || md5(w)[1:6])::INT % {dim} AS b, count(*) AS n
      FROM (SELECT id, unnest({words_of("text")}) AS w FROM ({source})) GROUP BY ALL),
  {name} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS v FROM {name}_n)"""


TEXT_PAIRS = f"""{VECTOR_WORDS}, {bucket_vectors("tv", "SELECT doc_id AS id, text FROM documents", 64)},
  places AS (SELECT word_no, unnest(range(0, 64)) AS b, unnest(vector) AS x FROM words),
  units AS (SELECT word_no, b, x / sqrt(sum(x * x) OVER (PARTITION BY word_no)) AS x FROM places),
  sims AS (SELECT tv.id AS issue_id, u.word_no, sum(tv.v * u.x) AS sim FROM tv JOIN units u USING (b) GROUP BY ALL),
  text_pairs AS (SELECT s.issue_id, s.sim, w.word_no, w.criteria, w.word, w.weight FROM sims s JOIN words w USING (word_no))"""

MENTIONS = f"""{TEXT_PAIRS}, {TEXT_SENTIMENT},
  totals AS (SELECT issue_id, criteria, count(*) AS words, sum(sim * weight) AS score FROM text_pairs WHERE sim > 0.05 GROUP BY ALL),
  mentions AS (SELECT t.project_id, s.criteria,
      CASE WHEN CASE WHEN t.sentiment = '+' THEN s.score ELSE -s.score END > 0 THEN '+' ELSE '-' END AS semantic,
      round(abs(s.score), 4) AS similarity_score, s.issue_id, s.words, t.text
    FROM totals s JOIN tones t USING (issue_id) WHERE abs(s.score) > 0.05)"""


NEIGHBOURS = f"""tokens AS (SELECT list_filter({words_of("text")}, lambda w: NOT list_contains({strings(T.STOP_WORDS)}, w)) AS ws FROM documents),
  seqs AS (SELECT ws, unnest(range(1, len(ws))) AS i FROM tokens),
  counted AS (SELECT ws[i] AS word, ws[i + 1] AS neighbour, count(*) AS n FROM seqs GROUP BY ALL),
  neighbours AS (SELECT word, neighbour, sum(n)::BIGINT AS n FROM (
    SELECT * FROM counted UNION ALL SELECT neighbour, word, n FROM counted) GROUP BY ALL)"""


def relevance(attribute: str) -> str:
    return f"SELECT doc_id, {lit(attribute)} AS attribute, {mentions_attribute('lower(text)', attribute)} AS relevant FROM documents"


ORACLES: dict[str, str] = {
    "q_land_issues": f"""SELECT doc_id AS issue_id, 'https://api.github.com/i/' || doc_id AS url,
        'https://api.github.com/i/' || doc_id || '/comments' AS comments_url, {PROJECT} AS project_id, 'a/b' AS repository_path,
        doc_id::INT AS number, source AS title, CASE WHEN lang <> 'es' THEN lang END AS owner,
        CASE WHEN lang <> 'es' THEN 'User' END AS owner_type, CASE WHEN lang <> 'es' THEN doc_id END AS owner_id,
        CASE WHEN lang = 'en' THEN '[{{"name":"' || source || '"}}]' ELSE '[]' END AS labels, FALSE AS locked,
        '2024-01-02 03:04:05' AS created_at, text AS body_text, '{{}}' AS reactions, NULL::VARCHAR AS state_reason FROM documents""",
    "q_land_comments": """SELECT conv_id * 1000 + turn AS id, conv_id AS issue_id, role AS owner, '2024-01-02 03:04:05' AS created_at,
        text AS body_text FROM conversations""",
    "q_insert_if_absent": """SELECT doc_id, source, text_key FROM (
        SELECT doc_id, source, md5(text) AS text_key, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents)
        WHERE k = 1 AND text_key NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""",
    "q_bucketed_merge": """WITH steps AS (
          SELECT c_custkey AS key, c_acctbal AS value, -1 AS arrival, 0 AS step FROM customer
          UNION ALL SELECT o_custkey, o_totalprice, o_orderkey, o_orderkey % 4 + 1 FROM orders)
        SELECT key, value::DOUBLE AS value, arrival::BIGINT AS arrival FROM steps
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY step DESC, arrival DESC) = 1""",
    "q_keyed_merge": """WITH latest AS (SELECT o_custkey AS key, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1)
        SELECT coalesce(l.key, c.c_custkey) AS key, CASE WHEN l.key IS NOT NULL THEN l.value ELSE c.c_acctbal END AS value
        FROM customer c FULL JOIN latest l ON l.key = c.c_custkey""",
    "q_orphans": """SELECT doc_id, count(*) AS rows FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY doc_id""",
    "q_csv_roundtrip": "SELECT doc_id, text, lang FROM documents",
    "q_append_run": """SELECT user_id AS project_id, event_type AS criteria,
        CASE WHEN event_type <> 'error' THEN value END AS similarity_score, event_id AS issue_id FROM events""",
    "q_land_stream": f"SELECT doc_id AS issue_id, {PROJECT} AS project_id, source AS title FROM documents",
    # A first run that skips lower ids of a project leaves them behind its mark.
    "q_tracked_runs": f"""WITH marks AS (SELECT source, max(doc_id) AS mark FROM documents
          WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source)
        SELECT {PROJECT} AS project_id, doc_id AS issue_id FROM documents LEFT JOIN marks USING (source)
        WHERE doc_id > coalesce(mark, 0) OR (doc_id > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
    "q_alert_stream": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS criteria, count(*) AS mentions FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL HAVING count(*) > 60""",
    "q_criteria_health": """WITH partials AS (
          SELECT ts::DATE AS day, event_type AS criteria, count(*) AS mentions, count(*) FILTER (value >= 10) AS positive, avg(value) AS mean_score
          FROM events GROUP BY ALL),
        filled AS (
          SELECT c.criteria, d.day, coalesce(p.mentions, 0) AS mentions, coalesce(p.positive, 0) AS positive, p.mean_score
          FROM (SELECT DISTINCT criteria FROM partials) c
          CROSS JOIN (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM partials) d
          LEFT JOIN partials p ON p.criteria = c.criteria AND p.day = d.day),
        periods AS (
          SELECT *, sum(mentions) OVER r AS recent, sum(positive) OVER r AS recent_positive, coalesce(sum(mentions) OVER b, 0) AS preceding FROM filled
          WINDOW r AS (PARTITION BY criteria ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
            b AS (PARTITION BY criteria ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING))
        SELECT strftime(day, '%Y-%m-%d') AS day, criteria, mentions, recent::BIGINT AS recent, preceding::BIGINT AS preceding,
          round(mean_score, 6) AS mean_score, round(recent_positive / nullif(recent, 0), 6) AS recent_positive_share,
          round(recent / nullif(preceding, 0) - 1, 6) AS change FROM periods""",
    "q_combine_a": f"""SELECT issue_id, project_id,
        concat_ws(' ', 'title: ' || title, body_text, 'comment: ' || comment_text) AS text
        FROM ({GAPS}) i LEFT JOIN ({comment_text("chr(10)")}) c USING (issue_id) WHERE title IS NOT NULL OR body_text IS NOT NULL""",
    "q_combine_b": f"""SELECT issue_id, project_id,
        trim(coalesce(title, '') || ' ' || coalesce(body_text, '') || ' ' || coalesce(comment_text, '')) AS text
        FROM ({GAPS}) i LEFT JOIN ({comment_text("chr(10)")}) c USING (issue_id) WHERE title IS NOT NULL OR body_text IS NOT NULL""",
    "q_combine_c": f"""SELECT *, {clean("issue_text")} AS clean_issue_text FROM (
        SELECT issue_id, project_id, issue_id::INT AS number, 'open' AS state, comments,
          strftime(TIMESTAMP '2024-01-01' + to_minutes(issue_id), '%Y-%m-%d %H:%M:%S') AS created_at,
          title || chr(10) || chr(10) || body_text || coalesce(chr(10) || chr(10) || comment_text, '') AS issue_text
        FROM ({GAPS}) i LEFT JOIN ({comment_text("chr(10) || chr(10)")}) c USING (issue_id)
        WHERE length(body_text) > 0 AND owner_type = 'User')""",
    "q_new_corpus_rows": f"""SELECT issue_id, project_id, issue_text, {clean("issue_text")} AS clean_issue_text
        FROM ({CORPUS}) WHERE issue_id > (SELECT coalesce(max(doc_id), 0) FROM labels WHERE toxic = 1 AND quality = 0)""",
    "q_text_dedupe": f"""SELECT doc_id AS issue_id, {PROJECT} AS project_id, sha256(text) AS text_key,
        count(*) OVER (PARTITION BY source, text) AS issues, length(text) AS chars FROM documents""",
    "q_valid_text": f"SELECT doc_id, {valid('text')} AS valid FROM documents",
    "q_content_type": f"""SELECT doc_id, {first_type("text", CONTENT_TYPE_WORDS)} AS content_type,
        {first_type("text", T.TYPE_WORDS)} AS prose_type FROM documents""",
    "q_relevance": " UNION ALL ".join(relevance(a) for a in [*(a[1] for a in T.ATTRIBUTES), T.CONTEXT_ATTRIBUTE]),
    "q_override": f"""WITH {OVERRIDDEN} SELECT doc_id, coalesce(flipped, sentiment) AS sentiment,
        round(CASE WHEN flipped IS NOT NULL THEN 0.7 ELSE confidence END, 4) AS confidence FROM flips""",
    "q_context": f"""WITH {context_steps("SELECT doc_id AS id, text || chr(10) || chr(10) || 'Title:  ' || source || ' ' || lang AS text FROM documents")}
        SELECT id AS doc_id, context FROM contexts""",
    "q_reason": f"""WITH {OVERRIDDEN}, {context_steps("SELECT doc_id AS id, text FROM documents")},
        phrases AS (SELECT * FROM {values([(k, '+', p) for k, (p, _) in REASON_PHRASES.items()] + [(k, '-', n) for k, (_, n) in REASON_PHRASES.items()], "kind, tone, phrase")}),
        finals AS (SELECT *, coalesce(flipped, sentiment) AS tone, CASE WHEN flipped IS NOT NULL THEN 0.7 ELSE confidence END AS sure,
          {first_type("text", T.TYPE_WORDS)} AS kind FROM flips)
        SELECT f.doc_id, CASE WHEN {valid("f.text")}
          THEN printf('%s sentiment (%.2f) about %s: ', CASE WHEN f.tone = '+' THEN 'Positive' ELSE 'Negative' END, sure, {lit(T.CONTEXT_ATTRIBUTE)})
            || CASE WHEN {mentions_attribute("lower(f.text)")} THEN p.phrase ELSE 'Content may indirectly relate to' END
            || ' ' || {lit(T.CONTEXT_ATTRIBUTE.lower())} || '. ' || c.context
          ELSE printf('%s sentiment (%.2f) about %s: ', CASE WHEN f.sentiment = '+' THEN 'Positive' ELSE 'Negative' END, confidence, {lit(T.CONTEXT_ATTRIBUTE)})
            || 'Content not available or contains invalid characters' END AS reason
        FROM finals f JOIN contexts c ON c.id = f.doc_id JOIN phrases p ON p.kind = f.kind AND p.tone = f.tone""",
    "q_clean_sent": f"""SELECT doc_id, CASE WHEN {valid("'[CLS] ' || text || ' [SEP]'")} THEN {squeeze("text")} ELSE 'Invalid content' END AS clean
        FROM documents""",
    "q_clean_issue": f"SELECT doc_id, {clean('text')} AS clean_issue_text FROM documents",
    "q_split": " UNION ALL ".join(
        f"SELECT doc_id, {lit(n)} AS strategy, unnest(range(0, len(p)))::INT AS piece_no, unnest(p) AS piece FROM (SELECT doc_id, {p} AS p FROM documents)"
        for n, p in {
            "polarity": split_at("text", ".!?"), "sentence": split_at("text", ".\\n"),
            "paragraph": "string_split(text, chr(10) || chr(10))", "newline": "string_split(text, chr(10))",
        }.items()
    ),
    "q_chunk_pack": f"""WITH RECURSIVE {packing("SELECT doc_id AS id, text FROM documents", 32)}
        SELECT id AS doc_id, chunk_no::INT AS chunk_no, chunk FROM packed""",
    "q_chunk_fixed": f"""SELECT doc_id, n::INT AS chunk_no, array_to_string(ts[n * 48 + 1 : n * 48 + 48], ' ') AS chunk FROM (
        SELECT doc_id, ts, unnest(range(0, (len(ts) + 47) // 48)) AS n FROM (SELECT doc_id, {token_list("text")} AS ts FROM documents))""",
    "q_chunk_lines": f"""WITH RECURSIVE sized AS (SELECT doc_id, text, len({token_list("text")}) AS n FROM documents),
        fold AS (
          SELECT doc_id, string_split(text, chr(10)) AS ls, 0 AS i, '' AS held, 0 AS used, []::VARCHAR[] AS out FROM sized WHERE n > 48
          UNION ALL
          SELECT doc_id, ls, i + 1,
            CASE WHEN c > 48 THEN '' WHEN used + c > 48 THEN line || chr(10) ELSE held || line || chr(10) END,
            CASE WHEN c > 48 THEN 0 WHEN used + c > 48 THEN c ELSE used + c END,
            list_concat(CASE WHEN held <> '' AND used + c > 48 THEN list_append(out, {stripped("held")}) ELSE out END,
              CASE WHEN c > 48 THEN flatten(list_transform(list_filter(string_split(line, '.'), lambda p: regexp_matches(p, '\\S')),
                lambda p: CASE WHEN len({token_list("p")}) <= 48 THEN [{stripped("p")}]
                  ELSE list_transform(range(0, len({token_list("p")}), 48), lambda k: array_to_string({token_list("p")}[k + 1 : k + 48], ' ')) END))
                ELSE []::VARCHAR[] END)
          FROM (SELECT *, ls[i + 1] AS line, len({token_list("ls[i + 1]")}) AS c FROM fold WHERE i < len(ls))),
        done AS (SELECT doc_id, CASE WHEN {stripped("held")} <> '' THEN list_append(out, {stripped("held")}) ELSE out END AS chunks FROM fold WHERE i = len(ls)
          UNION ALL SELECT doc_id, [text] FROM sized WHERE n <= 48)
        SELECT doc_id, (unnest(range(0, len(chunks))))::INT AS chunk_no, unnest(chunks) AS chunk FROM done""",
    "q_fit_context": f"SELECT doc_id, array_to_string(ts[greatest(1, len(ts) - 127) : ], ' ') AS tail FROM (SELECT doc_id, {token_list('text')} AS ts FROM documents)",
    "q_related_words": f"""SELECT doc_id, unnest(range(0, len(ws)))::INT AS word_no, unnest(ws) AS word
        FROM (SELECT doc_id, {related("text")} AS ws FROM documents)""",
    "q_stopwords": f"""SELECT doc_id, array_to_string(list_filter({words_of("text")}, lambda w: NOT list_contains({strings(T.STOP_WORDS)}, w)), ' ') AS tokens
        FROM documents""",
    "q_eligible_projects": f"SELECT {PROJECT} AS project_id, count(*) AS issues FROM documents GROUP BY 1 HAVING count(*) > 9",
    "q_projects_todo": """SELECT min(c_custkey) AS id, 'https://github.com/' || c_mktsegment || '/' || c_nationkey AS repository_url,
        c_mktsegment || '/' || c_nationkey AS path, TRUE AS fetchable FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY c_mktsegment, c_nationkey""",
    "q_unprocessed": f"""WITH marks AS (SELECT source, max(doc_id) AS mark FROM documents
          WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY source)
        SELECT {PROJECT} AS project_id, count(*) AS issues FROM documents LEFT JOIN marks USING (source)
        WHERE doc_id > coalesce(mark, 0) GROUP BY 1 HAVING count(*) > 1""",
    "q_tracker": f"""SELECT {PROJECT} AS project_id, max(doc_id) AS last_issue_id FROM documents
        WHERE lang = 'de' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1""",
    "q_not_analyzed": """SELECT o_custkey AS project_id, count(*) AS issues FROM orders
        WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1 HAVING count(*) > 3""",
    "q_progress": f"""SELECT total, existing, total - existing AS remaining, last_issue_id FROM (
        SELECT (SELECT count(DISTINCT issue_id) FROM ({GAPS}) WHERE length(body_text) > 0 AND owner_type = 'User') AS total,
          (SELECT count(*) FROM labels) AS existing, (SELECT coalesce(max(doc_id), 0) FROM labels) AS last_issue_id)""",
    "q_next_batch": f"""SELECT issue_id, project_id FROM ({ISSUES})
        WHERE issue_id > (SELECT coalesce(max(doc_id), 0) FROM labels WHERE toxic = 1 AND quality = 0) ORDER BY issue_id LIMIT 100""",
    "q_page": f"SELECT issue_id, project_id FROM ({ISSUES}) ORDER BY issue_id LIMIT 30 OFFSET 30",
    "q_mean_vector": """SELECT label, (i - 1)::INT AS position, round(avg(embedding[i]::DOUBLE), 6) AS value
        FROM embeddings, range(1, 65) r(i) GROUP BY ALL""",
    "q_embed": f"""WITH {bucket_vectors("vec", "SELECT doc_id AS id, text FROM documents", 32)}
        SELECT doc_id, p::INT AS position, round(coalesce(v, 0.0), 5) AS value FROM documents
        CROSS JOIN range(0, 32) r(p) LEFT JOIN vec ON id = doc_id AND b = p""",
    "q_sim_join_v1": f"WITH {MENTIONS} SELECT * EXCLUDE (text) FROM mentions",
    "q_matched_words": f"""WITH {VECTOR_WORDS} SELECT issue_id, criteria, word_no, word, round(sim * weight, 4) AS score
        FROM pairs WHERE sim > 0.05""",
    "q_sim_join_v2": f"""WITH {TEXT_PAIRS}, tones AS (SELECT doc_id AS issue_id,
          {compound(f"lower(CASE WHEN {valid('text')} THEN text ELSE 'Invalid content' END)")} AS c FROM documents)
        SELECT issue_id, word AS attribute, round(sim, 4) AS similarity_score,
          CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '-' ELSE '0' END AS sentiment FROM text_pairs JOIN tones USING (issue_id) WHERE sim >= 0.1""",
    "q_large_catalogue": f"""WITH cat AS (SELECT DISTINCT lang || ' ' || w AS text FROM (SELECT lang, unnest({words_of("text")}) AS w FROM documents) WHERE w <> ''),
        numbered AS (SELECT row_number() OVER (ORDER BY text) AS id, text FROM cat),
        {bucket_vectors("cv", "SELECT id, text FROM numbered", 64)}, {bucket_vectors("tv", "SELECT doc_id AS id, text FROM documents", 64)},
        sims AS (SELECT tv.id AS doc_id, cv.id AS word_no, sum(tv.v * cv.v) AS sim FROM tv JOIN cv USING (b) GROUP BY ALL)
        SELECT doc_id, count(*) AS words, round(max(sim), 6) AS best, round(sum(sim), 4) AS total FROM sims WHERE sim > 0.507 GROUP BY doc_id""",
    "q_word_lookup": f"""WITH counted AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({words_of("text")}) AS w FROM documents) GROUP BY ALL),
        last AS (SELECT w, max(lang) AS criteria, arg_max(n, lang) AS n FROM counted GROUP BY w)
        SELECT c.lang || ' ' || w AS word_no, l.criteria, w AS word, round(1.0 / (l.n + 1), 6)::DOUBLE AS weight FROM counted c JOIN last l USING (w)""",
    "q_words_per_criteria": f"WITH {VECTOR_WORDS} SELECT criteria, string_agg(word, ',' ORDER BY word_no) AS words FROM words GROUP BY criteria",
    "q_keyword_join": f"""SELECT DISTINCT issue_id, project_id, attribute_id FROM (SELECT issue_id, project_id, {clean("issue_text")} AS t FROM ({CORPUS})) x
        JOIN ({TERMS}) y ON contains(x.t, y.term)""",
    "q_hypotheses": f"""WITH parts AS ({ATTRIBUTE_PARTS}), hyps AS ({hypothesis_rows(HYPOTHESIS_TEMPLATES | {"prod": LABELLING_TEMPLATES})})
        SELECT t.issue_id, t.attribute_id, version, hypothesis_no, hypothesis FROM ({TRUTH}) t JOIN hyps USING (attribute_id)""",
    "q_prompts": f"""WITH {PROMPTS} SELECT issue_id, attribute_id, version, max_tokens::INT AS max_tokens, chunk_no::INT AS chunk_no, chunk,
        md5(system || chr(10) || 'Text: ' || coalesce(chunk, '') || {lit(VOTE_QUESTION)}) AS prompt_md5 FROM windows""",
    "q_truth": f"""SELECT *, CASE is_related WHEN 1 THEN 'maybe-relevant' WHEN 0.5 THEN 'maybe-not-relevant' WHEN 0 THEN 'not-relevant' END AS label
        FROM ({TRUTH})""",
    "q_nli_scores": f"""WITH RECURSIVE {packing("SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", 32)},
        {HYPOTHESES},
        hyp_words AS (SELECT attribute_id, row_number() OVER (PARTITION BY attribute_id ORDER BY version, hypothesis_no) - 1 AS position,
          list_distinct(string_split({clean("hypothesis")}, ' ')) AS hs FROM hyps),
        chunks AS (SELECT id, list_distinct(string_split({clean("chunk")}, ' ')) AS cs FROM packed)
        SELECT t.issue_id, t.attribute_id, 'sentence' AS chunking_strategy, 32 AS max_tokens, h.position::INT AS position,
          round(max(len(list_intersect(h.hs, c.cs))::DOUBLE / len(h.hs)), 8) AS max_score,
          round(avg(len(list_intersect(h.hs, c.cs))::DOUBLE / len(h.hs)), 8) AS mean_score
        FROM ({TRUTH}) t JOIN hyp_words h USING (attribute_id) JOIN chunks c ON c.id = t.issue_id GROUP BY ALL""",
    "q_entailment": """SELECT vec_id, round(e[3] / list_sum(e), 7) AS sweep, round(e[1] / list_sum(e), 7) AS production,
        round(e[64] / (e[1] + e[64]), 7) AS two_classes
        FROM (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE * 10)) AS e FROM embeddings)""",
    "q_cascade": f"""SELECT vec_id, {cascade("s", THRESHOLD_LISTS[0])} AS lenient, {cascade("s", THRESHOLD_LISTS[1])} AS middle,
        {cascade("s", THRESHOLD_LISTS[2])} AS strict, l AS nli_label, '{{"label":"' || l || '","score":' || s[1]::VARCHAR || '}}' AS nli_json FROM (
        SELECT vec_id, s, CASE WHEN {cascade("s", [0.9, 0.85, 0.8, 0.75, 0.7])} THEN 'maybe-relevant' ELSE 'maybe-not-relevant' END AS l FROM (
        SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda v: round(least(abs(v::DOUBLE) * 2.5, 1.0), 4))) AS s FROM embeddings))""",
    # A cleaned text is one line without full stops: above the budget it is cut into windows.
    "q_label_corpus": f"""WITH parts AS ({ATTRIBUTE_PARTS}), hyps AS ({hypothesis_rows({"prod": LABELLING_TEMPLATES})}),
        hyp_words AS (SELECT attribute_id, hypothesis_no, list_distinct(string_split({clean("hypothesis")}, ' ')) AS hs FROM hyps),
        texts AS (SELECT issue_id, project_id, {clean("issue_text")} AS t, {words_of("issue_text")} AS ws FROM ({CORPUS})),
        found AS (SELECT DISTINCT issue_id, project_id, attribute_id, ws FROM texts JOIN ({TERMS}) y ON contains(t, y.term)),
        chunks AS (SELECT issue_id, project_id, attribute_id, ws[n * 512 + 1 : n * 512 + 512] AS cs
          FROM (SELECT *, unnest(range(0, (len(ws) + 511) // 512)) AS n FROM found)),
        scores AS (SELECT issue_id, project_id, attribute_id, hypothesis_no, max(len(list_intersect(hs, cs))::DOUBLE / len(hs)) AS score
          FROM chunks JOIN hyp_words USING (attribute_id) GROUP BY ALL),
        ranked AS (SELECT issue_id, project_id, attribute_id, list(score ORDER BY score DESC) AS s FROM scores GROUP BY ALL)
        SELECT issue_id, project_id, attribute_id, round(s[1], 4) AS score,
          CASE WHEN {cascade("s", [0.9, 0.85, 0.8, 0.75, 0.7])} THEN 'maybe-relevant' ELSE 'maybe-not-relevant' END AS nli_label FROM ranked""",
    "q_votes": """WITH trials AS (SELECT user_id, date_trunc('day', ts) AS trial, bool_or(event_type = 'error') AS yes FROM events GROUP BY ALL)
        SELECT user_id, CASE WHEN 2 * y = n THEN f WHEN 2 * y > n THEN 1 ELSE 0 END::DOUBLE AS majority_vote, (y = n)::INT::DOUBLE AS unanimous,
          (y > 0)::INT::DOUBLE AS first_yes, (y / n >= 0.6)::INT::DOUBLE AS trial_ratio_threshold
        FROM (SELECT user_id, count(*) AS n, count(*) FILTER (yes) AS y, arg_min(yes, trial)::INT AS f FROM trials GROUP BY user_id)""",
    "q_vote_eval": f"""WITH {PROMPTS},
        answers AS (SELECT issue_id, attribute_id, is_related, version AS hypothesis_version, max_tokens::INT AS max_tokens,
          coalesce(bool_or(len(list_filter(p.words, lambda w: contains(chunk, lower(w)))) > 0), FALSE)::INT AS prediction
          FROM windows JOIN parts p USING (attribute_id) GROUP BY ALL),
        measured AS ({measures("answers", "attribute_id, hypothesis_version, max_tokens")})
        SELECT m.* EXCLUDE (p, r, tp, fp, fn, tn), a.attribute, rule AS aggregation_logic, 'keyword-rule' AS model, 'token' AS chunking_strategy,
          'default' AS threshold_config
        FROM measured m JOIN {ATTRIBUTES} a USING (attribute_id),
          (VALUES ('majority_vote'), ('unanimous'), ('first_yes'), ('trial_ratio_threshold')) r(rule)""",
    "q_metrics": f"""WITH hits AS (SELECT DISTINCT doc_id AS issue_id, attribute_id FROM documents JOIN ({TERMS}) y ON contains({clean("text")}, y.term)),
        judged AS (SELECT t.*, (h.issue_id IS NOT NULL)::INT AS prediction FROM ({TRUTH}) t LEFT JOIN hits h USING (issue_id, attribute_id))
        SELECT * EXCLUDE (p, r), 'drop' AS half_label FROM ({measures("judged", "attribute_id")})
        UNION ALL BY NAME SELECT * EXCLUDE (p, r), 'negative' AS half_label FROM ({measures("judged", "attribute_id", "is_related <> 1")})""",
    "q_grid": f"WITH RECURSIVE {GRID} SELECT * FROM grid",
    "q_grid_todo": f"""WITH RECURSIVE {GRID}, wanted AS (SELECT a.attribute_id, 'token-overlap' AS model, s.*, t.threshold_config, v.hypothesis_version
          FROM {ATTRIBUTES} a, settings s, {values([(str([float(x) for x in t]),) for t in THRESHOLD_LISTS], "threshold_config")} t,
            {values([(v,) for v in HYPOTHESIS_TEMPLATES], "hypothesis_version")} v)
        SELECT w.* FROM wanted w ANTI JOIN (SELECT * FROM grid WHERE f1_score > 0) g
          USING (attribute_id, model, chunking_strategy, threshold_config, hypothesis_version, max_tokens, aggregation_logic)""",
    "q_vote_todo": """WITH done AS (SELECT user_id, dayofweek(ts) + 1 AS weekday FROM events WHERE value > 20 GROUP BY ALL
          HAVING count(DISTINCT event_type) >= 5)
        SELECT DISTINCT user_id, (dayofweek(ts) + 1)::INT AS weekday FROM events ANTI JOIN done ON done.user_id = events.user_id AND done.weekday = dayofweek(ts) + 1""",
    "q_best_config": f"""WITH RECURSIVE {GRID} SELECT attribute_id, chunking_strategy, threshold_config, hypothesis_version, max_tokens, aggregation_logic, f1_score
        FROM (SELECT *, row_number() OVER (PARTITION BY attribute_id ORDER BY f1_score DESC, chunking_strategy, threshold_config, hypothesis_version,
          max_tokens, aggregation_logic) AS k FROM grid) WHERE k = 1""",
    "q_macro_mean": f"""WITH RECURSIVE {GRID} SELECT hypothesis_version, threshold_config, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall,
        round(avg(specificity), 9) AS specificity, round(avg(accuracy), 9) AS accuracy, round(avg(f1_score), 9) AS f1_score FROM grid GROUP BY ALL""",
    "q_sentiment": f"""SELECT doc_id, CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '-' ELSE '0' END AS sentiment, round((abs(c) + 1) / 2, 5) AS confidence
        FROM (SELECT doc_id, {compound(f"lower(CASE WHEN {valid('text')} THEN text ELSE 'Invalid content' END)")} AS c FROM documents)""",
    "q_weighted_sentiment": f"""WITH lexicon AS (SELECT DISTINCT w, length(w) - 4 AS weight FROM (SELECT unnest({words_of("text")}) AS w FROM benchmark)),
        ws AS (SELECT doc_id, unnest({words_of("text")}) AS w FROM documents),
        scored AS (SELECT doc_id, round(coalesce(avg(weight), 0.0), 5) AS compound FROM documents LEFT JOIN ws USING (doc_id) LEFT JOIN lexicon USING (w) GROUP BY doc_id)
        SELECT *, CASE WHEN compound > 0 THEN '+' WHEN compound < 0 THEN '-' ELSE '0' END AS sentiment FROM scored""",
    "q_mentions": f"""WITH last AS (SELECT word, arg_max(criteria, no) AS criteria, arg_max(weight, no) AS weight
          FROM {values(T.WORDS, "no, criteria, word, weight")} GROUP BY word),
        words AS (SELECT r.no, l.criteria, r.word, l.weight::DOUBLE AS weight FROM {values(T.WORDS, "no, criteria, word, weight")} r JOIN last l USING (word)),
        texts AS (SELECT issue_id, project_id, concat_ws(' ', 'title: ' || title, body_text, 'comment: ' || comment_text) AS text
          FROM ({ISSUES}) i LEFT JOIN ({comment_text("chr(10)")}) c USING (issue_id)),
        tones AS (SELECT *, CASE WHEN {compound(f"lower(CASE WHEN {valid('text')} THEN text ELSE 'Invalid content' END)")} > 0 THEN 1 ELSE -1 END AS tone FROM texts),
        {bucket_vectors("tv", "SELECT issue_id AS id, text FROM texts", 64)},
        {bucket_vectors("wv", "SELECT no AS id, 'Software quality attribute: ' || word AS text FROM words", 64)},
        sims AS (SELECT tv.id AS issue_id, wv.id AS no, sum(tv.v * wv.v) AS sim FROM tv JOIN wv USING (b) GROUP BY ALL),
        totals AS (SELECT issue_id, criteria, sum(sim * weight) AS score FROM sims JOIN words USING (no) WHERE sim > 0.213 GROUP BY ALL)
        SELECT project_id, criteria, CASE WHEN tone * score > 0 THEN '+' ELSE '-' END AS semantic, round(abs(score), 4) AS similarity_score, issue_id
        FROM totals JOIN tones USING (issue_id) WHERE abs(score) > 0.213""",
    "q_matches": f"""WITH texts AS (SELECT issue_id, project_id, trim(title || ' ' || body_text || ' ' || coalesce(comment_text, '')) AS text
          FROM ({ISSUES}) i LEFT JOIN ({comment_text("chr(10)")}) c USING (issue_id)),
        tones AS (SELECT *, {compound(f"lower(CASE WHEN {valid('text')} THEN text ELSE 'Invalid content' END)")} AS c FROM texts),
        {bucket_vectors("tv", "SELECT issue_id AS id, text FROM texts", 64)},
        {bucket_vectors("av", f"SELECT attribute AS id, definition AS text FROM {ATTRIBUTES} WHERE definition IS NOT NULL", 64)},
        sims AS (SELECT tv.id AS issue_id, av.id AS attribute, sum(tv.v * av.v) AS sim FROM tv JOIN av USING (b) GROUP BY ALL)
        SELECT project_id, issue_id, attribute, CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '-' ELSE '0' END AS sentiment, round(sim, 4) AS similarity_score
        FROM sims JOIN tones USING (issue_id) WHERE sim >= 0.3""",
    "q_top_criteria": f"WITH {MENTIONS} SELECT criteria, count(*) AS mentions FROM mentions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "q_top_projects": f"WITH {MENTIONS} SELECT project_id, count(*) AS mentions FROM mentions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "q_crosstab": f"""WITH {MENTIONS} SELECT criteria, count(*) FILTER (semantic = '+') AS positive, count(*) FILTER (semantic = '-') AS negative
        FROM mentions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5""",
    "q_histogram": """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
        counted AS (SELECT least(floor((value - lo) / (hi - lo) * 20)::INT + 1, 20) AS bin, count(*) AS n FROM events, b GROUP BY 1)
        SELECT k::INT AS bin, round(lo + (k - 1) * ((hi - lo) / 20), 4) AS low, round(lo + k * ((hi - lo) / 20), 4) AS high, coalesce(n, 0) AS n
        FROM b, range(1, 21) r(k) LEFT JOIN counted ON bin = k""",
    "q_cap_matches": f"""WITH {MENTIONS} SELECT project_id, criteria, issue_id, similarity_score FROM (SELECT *, row_number() OVER (
        PARTITION BY project_id ORDER BY similarity_score DESC, issue_id, criteria) AS k FROM mentions) WHERE k <= 7""",
    "q_sample_matches": f"""WITH {MENTIONS} SELECT project_id, criteria, issue_id FROM (SELECT *, row_number() OVER (
        PARTITION BY project_id ORDER BY md5('0:' || issue_id || ':' || criteria), issue_id, criteria) AS k FROM mentions) WHERE k <= 7""",
    "q_distinct_attributes": "SELECT DISTINCT source AS attribute, lang AS definition FROM documents",
    "q_criteria_report": f"""WITH {MENTIONS}, {context_steps("SELECT doc_id AS id, text FROM documents")},
        ranked AS (SELECT m.*, c.context, row_number() OVER (PARTITION BY criteria ORDER BY similarity_score DESC, issue_id) AS k
          FROM mentions m JOIN contexts c ON c.id = m.issue_id)
        SELECT criteria, count(*) AS mentions, round(avg((semantic = '+')::INT), 5) AS positive_share,
          string_agg(context, ' | ' ORDER BY k) FILTER (k <= 3) AS examples FROM ranked GROUP BY criteria""",
    "q_neighbours": f"WITH {NEIGHBOURS} SELECT * FROM neighbours",
    "q_synonyms": f"""WITH {NEIGHBOURS}, lengths AS (SELECT word, sqrt(sum(n * n)) AS length FROM neighbours GROUP BY word),
        dots AS (SELECT a.word AS criteria, b.word AS similar_word, sum(a.n * b.n) AS dot FROM neighbours a JOIN neighbours b USING (neighbour)
          WHERE a.word IN ('license', 'test', 'that', 'with', 'on') AND a.word <> b.word GROUP BY ALL),
        scored AS (SELECT criteria, similar_word, round(dot / (x.length * y.length), 6) AS max_w2v_score FROM dots
          JOIN lengths x ON x.word = criteria JOIN lengths y ON y.word = similar_word)
        SELECT criteria, similar_word, max_w2v_score FROM (SELECT *, row_number() OVER (PARTITION BY criteria ORDER BY max_w2v_score DESC, similar_word) AS k
          FROM scored) WHERE k <= 10""",
    "q_criteria_daily": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS criteria, count(*) AS mentions FROM events GROUP BY ALL HAVING count(*) > 60""",
}
# A run that is repeated stores what one run finds; every project has more than ten issues, and marks start at 0.
ORACLES["q_run_mentions"] = f"SELECT * FROM ({ORACLES['q_mentions']}) WHERE issue_id > 0"
ORACLES["q_null_text"] = "SELECT doc_id, " + ", ".join(
    f"CASE WHEN lang <> 'es' THEN round(len(list_intersect({strings(h.split())}, {words_of('text')}))::DOUBLE / {len(h.split())}, 6) ELSE 0.0 END AS {name}"
    for name, h in (("first", "the license of it"), ("second", "with that server on"))
) + " FROM documents"
ORACLES["q_model_sentiment"] = f"""SELECT doc_id, CASE WHEN contains(CASE WHEN {valid('text')} THEN text ELSE 'Invalid content' END, ' the ') THEN '+' ELSE '-' END
    AS sentiment, 0.75::DOUBLE AS confidence, NULL::VARCHAR AS sentiment_error FROM documents"""
ORACLES["q_run_labels"] = f"SELECT * EXCLUDE (score) FROM ({ORACLES['q_label_corpus']})"
ORACLES["q_run_votes"] = f"SELECT *, 1.5::DOUBLE AS duration_seconds FROM ({ORACLES['q_vote_eval']})"
ORACLES["q_run_grid"] = f"SELECT * EXCLUDE (tp, fp, fn, tn), 2.5::DOUBLE AS duration_seconds FROM ({ORACLES['q_grid']})"
