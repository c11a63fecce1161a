"""DuckDB SQL for the registered queries, written apart from the DataFrame code.

Its regular expressions have no look-around: structured formats are found as maximal runs of characters that match
in full.  Offsets come from the lengths of what lies between runs.
"""

from __future__ import annotations

from ..functions.patterns import MASK_TOKENS, NAME_RULES, NAME_WORDS, TYPE_MAP, VALUE_RULES
from . import synth
from .queries import BIRTH, MEMO, NESTED, PERSONAL, SAMPLED

KEYS = "keys AS (SELECT c_custkey AS k FROM customer)"
MAIN = f"{KEYS},\n" + synth.sql("docs", "keys", "notes.body.", synth.TEMPLATES, synth.value_sql())
DRIFT = synth.sql("drift", "keys", "drift.body.", synth.DRIFT, synth.drift_sql())
_VALUE = synth.value_sql()
PEOPLE = "people AS (SELECT k, " + ", ".join(f"{_VALUE[t]} AS {c}" for c, (t, _) in PERSONAL.items()) + f", {BIRTH} AS birth_date, k % 50 * 100 + 3000 AS salary, {MEMO} AS memo FROM keys)"


def runs(name: str, source: str, run: str) -> str:
    """``name`` (doc_id, i, v, s): the maximal runs of a class of characters in (doc_id, text), with offsets."""
    return f"""{name} AS (SELECT doc_id, i, v[i] AS v, g[i + 1] AS gap_after, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::INT AS s
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{run}') AS v, string_split_regex(text, '{run}') AS g FROM {source})))"""


def spans(name: str, source: str) -> str:
    """``name`` (doc_id, start_char, end_char, entity_type, pii_value): pattern spans of (doc_id, text)."""
    n = name
    email = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
    return f"""{runs(f"{n}_h", source, "[0-9-]+")},
{runs(f"{n}_d", source, "[0-9]+")},
{runs(f"{n}_w", source, "[A-Za-z0-9]+")},
{runs(f"{n}_e", source, email)},
{n}_all AS (
  SELECT doc_id, s, s + length(v) AS e, 'ACCOUNT' AS t, v FROM {n}_h WHERE regexp_full_match(v, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{6}}')
  UNION ALL SELECT doc_id, s, s + length(v), 'CARD', v FROM {n}_h WHERE regexp_full_match(v, '[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}')
  UNION ALL SELECT doc_id, s, s + length(v), 'PHONE', v FROM {n}_h WHERE regexp_full_match(v, '01[016789]-[0-9]{{3,4}}-[0-9]{{4}}')
  UNION ALL SELECT doc_id, s, s + length(v), 'CARD', v FROM {n}_d WHERE length(v) = 16
  UNION ALL SELECT doc_id, s, s + length(v), 'IMEI', v FROM {n}_d WHERE length(v) = 15
  UNION ALL SELECT doc_id, s, s + length(v), 'PHONE', v FROM {n}_d WHERE regexp_full_match(v, '01[016789][0-9]{{7,8}}')
  UNION ALL SELECT doc_id, s, s + length(v), 'PASSPORT', v FROM {n}_w WHERE regexp_full_match(v, '[MSROD][0-9]{{8}}')
  UNION ALL SELECT a.doc_id, a.s, a.s + 14, 'RRN', a.v || '-' || b.v FROM {n}_d a JOIN {n}_d b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND b.i = a.i + 1
    WHERE length(a.v) = 6 AND length(b.v) = 7 AND a.gap_after = '-' AND b.v[1] BETWEEN '1' AND '4'),
{n} AS (SELECT doc_id, s::INT AS start_char, e::INT AS end_char, t AS entity_type, v AS pii_value FROM {n}_all x
    WHERE NOT EXISTS (SELECT 1 FROM {n}_e y WHERE y.doc_id = x.doc_id AND y.s < x.e AND y.s + length(y.v) > x.s)
  UNION ALL SELECT doc_id, s::INT, (s + length(v))::INT, 'EMAIL', v FROM {n}_e)"""


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables)


SPAN = "doc_id, start_char, end_char, entity_type, pii_value"
_samples = "\n  UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS val FROM {t}" for t, cs in SAMPLED.items() for c in cs)
SAMPLES = f"""vals AS (SELECT DISTINCT table_name, column_name, val FROM ({_samples}) WHERE val IS NOT NULL),
samples AS (SELECT table_name, column_name, val FROM vals QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY md5(val), val) <= 20)"""
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(val, '{r}') THEN '{c}'" for r, c in VALUE_RULES) + " ELSE 'NON_PII' END"
_by_name = "CASE " + " ".join(f"WHEN regexp_matches(lower(column_name), '{r}') THEN '{c}'" for r, c in NAME_RULES) + " ELSE 'NON_PII' END"
RULES = f"""cats AS (SELECT table_name, column_name, {CATEGORY} AS cat, count(*) AS c FROM samples GROUP BY ALL),
picked AS (SELECT table_name, column_name, cat AS value_cat FROM cats QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY (cat <> 'NON_PII') DESC, c DESC, cat) = 1),
tallied AS (SELECT table_name, column_name, round(sum(CASE WHEN cat <> 'NON_PII' THEN c ELSE 0 END) / sum(c), 3) AS share FROM cats GROUP BY ALL),
rules AS (SELECT table_name, column_name, share AS pii_frac, CASE WHEN value_cat <> 'NON_PII' THEN value_cat ELSE {_by_name} END AS rule_category,
    greatest(CASE WHEN value_cat <> 'NON_PII' THEN share ELSE 0.0 END, CASE WHEN regexp_matches(lower(column_name), '{NAME_WORDS}') THEN 0.6 ELSE 0.0 END)::DOUBLE AS rule_conf
  FROM tallied JOIN picked USING (table_name, column_name))"""
_truth = ", ".join(
    f"('{t}', '{c}', {str(p).lower()}, '{cat}')"
    for t, cs in SAMPLED.items() for c in cs
    for p in [t == "people" and (c in PERSONAL or c in ("birth_date", "memo"))]
    for cat in ["NON_PII" if not p else PERSONAL[c][1] if c in PERSONAL else "FREE_TEXT_PII" if c == "memo" else "PERSONAL_INFO"]
)
TRUTH = f"truth AS (SELECT * FROM (VALUES {_truth}) t(table_name, column_name, is_pii, category))"
#: What the simulated answers say, and what is left of them when one in sixteen can't be read.
_hex = lambda i: f"strpos('0123456789abcdef', md5(table_name || '.' || column_name)[{i}]) - 1"
ANSWERS = f"""said AS (SELECT *, CASE WHEN {_hex(1)} < 2 THEN NOT is_pii ELSE is_pii END AS says, {_hex(3)} = 0 AS lost, ({_hex(2)}) % 5 + 5 AS tenth FROM truth),
llm AS (SELECT table_name, column_name, says AND NOT lost AS llm_is_pii,
    CASE WHEN lost OR NOT says THEN 'NON_PII' WHEN category = 'NON_PII' THEN 'PERSONAL_INFO' ELSE category END AS llm_category, CASE WHEN lost THEN 0.5 ELSE tenth / 10.0 END::DOUBLE AS llm_conf FROM said)"""
VERDICTS = """hybrid AS (SELECT table_name, column_name, score >= 0.5 AS pred_is_pii, CASE WHEN score < 0.5 THEN 'NON_PII' WHEN llm_is_pii THEN llm_category ELSE rule_category END AS pred_category
  FROM (SELECT *, round(0.4 * CASE WHEN rule_conf >= 0.6 THEN rule_conf ELSE 0 END + 0.6 * CASE WHEN llm_is_pii THEN llm_conf ELSE 1 - llm_conf END, 3) AS score FROM rules JOIN llm USING (table_name, column_name))),
modelled AS (SELECT table_name, column_name, llm_is_pii AS pred_is_pii, CASE WHEN llm_is_pii THEN llm_category ELSE 'NON_PII' END AS pred_category FROM llm),
owned AS (SELECT table_name, column_name, rule_conf >= 0.6 OR o AS pred_is_pii, CASE WHEN rule_conf >= 0.6 THEN rule_category WHEN o THEN 'PERSONAL_INFO' ELSE 'NON_PII' END AS pred_category
  FROM (SELECT *, table_name = 'people' AND column_name IN ('memo', 'salary') AS o FROM rules)),
columns_said AS (SELECT 'S1' AS stage, 'NA' AS backend, table_name, column_name, rule_conf >= 0.6 AS pred_is_pii, rule_category AS pred_category FROM rules
  UNION ALL SELECT 'S2', 'sim', * FROM hybrid UNION ALL SELECT 'S3', 'NA', * FROM owned UNION ALL SELECT 'S5', 'sim', * FROM modelled)"""
COLUMNS = with_(KEYS, PEOPLE, SAMPLES, RULES, TRUTH, ANSWERS, VERDICTS)
COL_EVAL = """scores AS (SELECT stage, backend, count(*) FILTER (is_pii AND pred_is_pii) AS tp, count(*) FILTER (NOT is_pii AND pred_is_pii) AS fp, count(*) FILTER (is_pii AND NOT pred_is_pii) AS fn,
    count(*) FILTER (is_pii AND pred_is_pii AND category <> 'FREE_TEXT_PII' AND category = pred_category) AS same, count(*) FILTER (is_pii AND category <> 'FREE_TEXT_PII') AS typed
  FROM columns_said JOIN truth USING (table_name, column_name) GROUP BY stage, backend)"""

#: Items that the simulated answers hold, then the places where their values stand in the text, in turn.
RECOVERED = """items AS (SELECT doc_id, k, entity_type, pii_value, start_char, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) AS i FROM docs_gold),
counted AS (SELECT doc_id, pii_value, count(*) AS n FROM items WHERE k % 9 <> 0 AND (k % 9 <> 4 OR i > 1) GROUP BY ALL),
placed AS (SELECT g.*, row_number() OVER (PARTITION BY g.doc_id, g.pii_value ORDER BY g.start_char) AS nth FROM docs_gold g),
recovered AS (SELECT p.doc_id, p.start_char, p.end_char, p.entity_type, p.pii_value FROM placed p JOIN counted c ON c.doc_id = p.doc_id AND c.pii_value = p.pii_value AND p.nth <= c.n)"""
MERGED = """merged AS (SELECT * FROM ruled UNION ALL SELECT r.* FROM recovered r WHERE NOT EXISTS (SELECT 1 FROM ruled x WHERE x.doc_id = r.doc_id AND x.start_char < r.end_char AND x.end_char > r.start_char))"""
ENTITIES = """named AS (SELECT doc_id, k, start_char, end_char, entity_type, pii_value, (k * 7 + start_char) % 50 AS points FROM docs_gold WHERE source_layer = 'NER'),
low AS (SELECT *, doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char, entity_type) - 1) AS key FROM named)"""
FINAL = """final AS (SELECT * FROM ruled UNION ALL SELECT doc_id, start_char, end_char, entity_type, pii_value FROM low l
  WHERE (points >= 20 OR start_char % 4 IN (0, 1)) AND NOT EXISTS (SELECT 1 FROM ruled x WHERE x.doc_id = l.doc_id AND x.start_char < l.end_char AND x.end_char > l.start_char))"""
STAGES = with_(MAIN, spans("ruled", "docs"), RECOVERED, MERGED, ENTITIES, FINAL) + """,
said AS (SELECT 'S1' AS stage, 'NA' AS backend, doc_id, start_char, end_char, entity_type FROM ruled UNION ALL SELECT 'S2', 'sim', doc_id, start_char, end_char, entity_type FROM merged
  UNION ALL SELECT 'S3', 'sim', doc_id, start_char, end_char, entity_type FROM final UNION ALL SELECT 'S5', 'sim', doc_id, start_char, end_char, entity_type FROM recovered),
covered AS (SELECT 'S1' AS stage, 'NA' AS backend, doc_id FROM docs UNION ALL SELECT 'S2', 'sim', doc_id FROM docs UNION ALL SELECT 'S3', 'sim', doc_id FROM docs UNION ALL SELECT 'S5', 'sim', doc_id FROM docs WHERE k % 9 <> 0)"""


def regimes(said: str, covered: str, gold: str) -> str:
    """Counts by regime.  Gold spans are disjoint here, and so are a cell's, so that partial matches pair off by best overlap."""
    return f"""cell_gold AS (SELECT c.stage, c.backend, g.doc_id, g.start_char AS s, g.end_char AS e, g.entity_type AS t FROM {covered} c JOIN {gold} g USING (doc_id)),
cell_said AS (SELECT DISTINCT p.stage, p.backend, p.doc_id, p.start_char AS s, p.end_char AS e, p.entity_type AS t FROM {said} p JOIN {covered} c USING (stage, backend, doc_id)),
sizes AS (SELECT stage, backend, count(*) AS n_docs FROM {covered} GROUP BY ALL),
ng AS (SELECT stage, backend, count(*) AS n, sum(e - s) AS chars FROM cell_gold GROUP BY ALL), np AS (SELECT stage, backend, count(*) AS n, sum(e - s) AS chars FROM cell_said GROUP BY ALL),
pairs AS (SELECT g.stage, g.backend, g.doc_id, g.s, g.e, g.t, p.s AS ps, p.e AS pe, p.t AS pt, least(g.e, p.e) - greatest(g.s, p.s) AS shared FROM cell_gold g JOIN cell_said p
  ON p.stage = g.stage AND p.backend = g.backend AND p.doc_id = g.doc_id AND p.s < g.e AND p.e > g.s),
hits AS (SELECT stage, backend, count(*) FILTER (s = ps AND e = pe AND t = pt) AS exact, count(*) FILTER (s = ps AND e = pe) AS type_agnostic,
    count(DISTINCT (doc_id, s)) FILTER (t = pt AND 2 * shared >= (e - s) + (pe - ps) - shared) AS partial, sum(shared) AS char FROM pairs GROUP BY ALL),
counts AS (SELECT stage, backend, r.regime, r.tp, (CASE WHEN r.regime = 'char' THEN coalesce(np.chars, 0) ELSE coalesce(np.n, 0) END - r.tp) AS fp,
    (CASE WHEN r.regime = 'char' THEN ng.chars ELSE ng.n END - r.tp) AS fn, n_docs, ng.n AS n_gt
  FROM sizes JOIN ng USING (stage, backend) LEFT JOIN np USING (stage, backend) LEFT JOIN hits USING (stage, backend),
  LATERAL (SELECT unnest(['exact', 'type_agnostic', 'partial', 'char']) AS regime, unnest([coalesce(exact, 0), coalesce(type_agnostic, 0), coalesce(partial, 0), coalesce(char, 0)]::BIGINT[]) AS tp) r)"""


_mask = "CASE x.entity_type " + " ".join(f"WHEN '{t}' THEN '{m}'" for t, m in MASK_TOKENS.items()) + " ELSE '[PII]' END"


def masked(name: str, source: str, found: str) -> str:
    """``name`` (doc_id, masked): texts of (doc_id, text) with disjoint spans replaced, put together from gaps and tokens."""
    return f"""{name}_parts AS (SELECT x.doc_id, x.start_char, substring(d.text, coalesce(lag(x.end_char) OVER w, 0) + 1, x.start_char - coalesce(lag(x.end_char) OVER w, 0)) || {_mask} AS part,
    x.end_char, lead(x.start_char) OVER w IS NULL AS is_last, d.text FROM {found} x JOIN {source} d USING (doc_id) WINDOW w AS (PARTITION BY x.doc_id ORDER BY x.start_char)),
{name} AS (SELECT d.doc_id, coalesce(m.masked, d.text) AS masked FROM {source} d LEFT JOIN (SELECT doc_id, string_agg(part, '' ORDER BY start_char) || max(CASE WHEN is_last THEN substring(text, end_char + 1) END) AS masked FROM {name}_parts GROUP BY doc_id) m USING (doc_id))"""


_odd = lambda c: f"CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE {c} END"
_stars = lambda v, n: f"{v}[1:1] || repeat('*', greatest(length({v}) - 1, {n}))"
MASKS = {
    "mask_phone": ("phone", lambda v: f"CASE WHEN regexp_full_match({v}, '01[0-9]-?[0-9]{{3,4}}-?[0-9]{{4}}') THEN {v}[1:3] || '-****-' || right({v}, 4) ELSE {_stars(v, 3)} END"),
    "mask_rrn": ("rrn", lambda v: f"{v}[1:6] || '-*******'"),
    "mask_email": ("email", lambda v: f"CASE WHEN regexp_full_match({v}, '.+@.+') THEN {v}[1:1] || '***@' || split_part({v}, '@', -1) ELSE {_stars(v, 3)} END"),
    "mask_name": ("name_ko", lambda v: _stars(v, 1)),
    "mask_card": ("card_number", lambda v: f"'****-****-****-' || right(regexp_replace({v}, '[^0-9]', '', 'g'), 4)"),
    "mask_account": ("bank_account", lambda v: f"{v}[1:3] || '-**-******'"),
    "mask_default": ("address", lambda v: f"{v}[1:1] || '***'"),
}
_view = {"phone": "mask_phone", "rrn": "mask_rrn", "email": "mask_email", "name_ko": "mask_name", "card_number": "mask_card", "bank_account": "mask_account"}
AUDIT = "audit AS (SELECT doc_id, k, start_char, end_char, entity_type, pii_value FROM drift_gold WHERE length(doc_id) % 2 = 0 OR start_char % 5 <> 0\n  UNION ALL SELECT doc_id, k, (length(text) - 2)::INT, length(text)::INT, 'ACCOUNT', right(text, 2) FROM drift WHERE k % 12 = 3)"
def _shape(v: str) -> str:
    return f"""array_to_string(list_transform(regexp_extract_all({v}, '[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+'), lambda r:
    CASE WHEN r[1] BETWEEN '0' AND '9' THEN 'D' || length(r) WHEN r[1] BETWEEN 'A' AND 'Z' THEN 'L' || length(r) WHEN r[1] BETWEEN 'a' AND 'z' THEN 'l' || length(r) ELSE r END), '')"""


LEAKS = with_(MAIN, DRIFT, spans("ruled", "drift"), AUDIT) + """,
leaks AS (SELECT doc_id, start_char, end_char, entity_type, pii_value FROM audit a WHERE entity_type NOT IN ('PERSON', 'ADDRESS') AND NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc_id = a.doc_id AND r.start_char = a.start_char AND r.end_char = a.end_char)),
shaped AS (SELECT *, """ + _shape("pii_value") + """ AS shape FROM leaks),
clusters AS (SELECT entity_type, shape, count(*) AS support FROM shaped GROUP BY ALL HAVING count(*) > 1)"""
#: Matches in clean texts that aren't gold: whole words of a cluster's shape, or a cluster's literal wherever it stands.
SHADOW = """words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*')) AS v FROM docs),
clean AS (SELECT """ + _shape("v") + """ AS shape, count(*) AS n FROM words w WHERE NOT EXISTS (SELECT 1 FROM docs_gold g WHERE g.doc_id = w.doc_id AND g.pii_value = w.v) GROUP BY 1),
shadowed AS (SELECT entity_type, c.shape, support, CASE WHEN regexp_matches(c.shape, '[0-9A-Za-z]') THEN coalesce(clean.n, 0)
    ELSE (SELECT sum((length(text) - length(replace(text, c.shape, ''))) // length(c.shape)) FROM docs) END::BIGINT AS clean_fp FROM clusters c LEFT JOIN clean ON clean.shape = c.shape),
after AS (SELECT count(*) AS n_gold, count(*) FILTER (is_found) AS n_before, count(*) FILTER (is_found OR shape IN (SELECT shape FROM shadowed WHERE clean_fp = 0)) AS n_after
  FROM (SELECT g.*, """ + _shape("g.pii_value") + """ AS shape, EXISTS (SELECT 1 FROM ruled r WHERE r.doc_id = g.doc_id AND r.start_char = g.start_char AND r.end_char = g.end_char) AS is_found FROM drift_gold g WHERE source_layer = 'PATTERN'))"""
RATES = with_(MAIN, DRIFT, spans("ruled", "docs"), spans("ruled_drift", "drift")) + """,
rates AS (SELECT 'drift' AS corpus, count(*) AS n_docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM drift_gold) AND doc_id NOT IN (SELECT doc_id FROM ruled_drift)) AS n_silent FROM drift
  UNION ALL SELECT 'main', count(*), count(*) FILTER (doc_id IN (SELECT doc_id FROM docs_gold) AND doc_id NOT IN (SELECT doc_id FROM ruled)) FROM docs)"""
_breach = lambda a, b: f"CASE WHEN {a} > greatest({b} * 3, 0.2) THEN 'CRIT' WHEN {a} > greatest({b} * 2, 0.1) THEN 'WARN' ELSE 'OK' END"
TRAIN = "three AS (SELECT k * 3 AS k FROM keys),\n" + synth.sql("train", "three", "train.body.", synth.TEMPLATES, synth.value_sql())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_whole = [("documents", "doc_id", "doc_id"), ("conversations", "concat(conv_id, '-', turn)", "conv_id"), ("benchmark", "item_id", "item_id")]
_costs = "costs AS (SELECT CASE m WHEN 'base' THEN 'S3' ELSE 'S4' END AS stage, count(*) FILTER (points + plus < 20) / count(*) AS r FROM named, (VALUES ('base', 0), ('ft', 25)) v(m, plus) GROUP BY m UNION ALL VALUES ('S1', 0.0), ('S2', 1.0), ('S5', 1.0))"


#: Scores from counts, and one row per cell.
MARKS = """marks AS (SELECT stage, backend, regime, tp, fp, fn, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1, n_docs, n_gt FROM (
  SELECT stage, backend, regime, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, n_docs, n_gt FROM counts))"""
GRID = """picked_marks AS (SELECT stage, backend, max(precision) FILTER (regime = 'exact') AS span_exact_prec, max(recall) FILTER (regime = 'exact') AS span_exact_recall, max(f1) FILTER (regime = 'exact') AS span_exact_f1,
    max(f1) FILTER (regime = 'partial') AS span_partial_f1, max(f1) FILTER (regime = 'type_agnostic') AS span_detect_f1, max(recall) FILTER (regime = 'char') AS span_char_recall, max(n_docs) AS span_n_docs FROM marks GROUP BY ALL),
celled AS (SELECT stage, CASE stage WHEN 'S1' THEN 'NA' ELSE 'sim' END AS backend, r::DOUBLE AS r FROM costs),
grid AS (SELECT stage, backend FROM marks UNION SELECT stage, backend FROM scores UNION SELECT stage, backend FROM celled)"""


def oracle_sql() -> dict[str, str]:
    doc_spans = lambda table, key, text: with_(f"src AS (SELECT {key} AS doc_id, {text} AS text FROM {table})", spans("ruled", "src"))
    gold = with_(MAIN)
    ruled = with_(MAIN, spans("ruled", "docs"))
    recovered = with_(MAIN, spans("ruled", "docs"), RECOVERED, MERGED)
    entity = with_(MAIN, ENTITIES)
    stages = STAGES + ",\n" + regimes("said", "covered", "docs_gold")
    everything = stages + ",\n" + ",\n".join([MARKS, PEOPLE, SAMPLES, RULES, TRUTH, ANSWERS.replace("said AS (", "answered AS (", 1).replace("FROM said)", "FROM answered)"), VERDICTS, COL_EVAL, _costs, masked("bare", "docs", "docs_gold"), GRID])
    moved = with_(MAIN) + """,
moved AS (SELECT 'SX' AS stage, 'NA' AS backend, doc_id, (start_char + length(doc_id) % 4)::INT AS start_char, (end_char + length(doc_id) % 4)::INT AS end_char, entity_type FROM docs_gold),
seen AS (SELECT DISTINCT stage, backend, doc_id FROM moved),\n""" + regimes("moved", "seen", "docs_gold")
    number = f"concat('4', {synth.padded('(p_partkey * 48271) % 10000000', 7)}, {synth.padded('(p_partkey * 16807) % 100000000', 8)})"
    luhn = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (2 * number[i]::INT) // 10 + (2 * number[i]::INT) % 10 ELSE number[i]::INT END)) % 10 = 0"
    view = ", ".join(f"{MASKS[_view.get(c, 'mask_default')][1](c)} AS {c}" for c in PERSONAL)
    risk_ = "CASE WHEN pred_category IN ('IDENTIFICATION', 'PAYMENT_INFO') THEN 'HIGH' ELSE 'MEDIUM' END"
    masks_ = "CASE " + " ".join(f"WHEN column_name = '{c}' THEN '{m}'" for c, m in _view.items()) + " ELSE 'mask_default' END"
    return {
        "table_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
        "s1_regex_spans_documents": doc_spans("documents", "doc_id", "text") + f"\nSELECT {SPAN} FROM ruled",
        "s1_regex_spans_pages": doc_spans("pages", "page_id", "html") + f"\nSELECT {SPAN} FROM ruled",
        "s1_spans_synth": ruled + f"\nSELECT {SPAN} FROM ruled",
        "s1_overlap_email_wins": with_(KEYS, f"src AS (SELECT k AS doc_id, {NESTED} AS text FROM keys)", spans("ruled", "src")) + f"\nSELECT {SPAN} FROM ruled",
        "s1_span_type_distribution": ruled + "\nSELECT entity_type, count(*) AS n FROM ruled GROUP BY 1",
        "s1_doc_span_counts": doc_spans("documents", "doc_id", "text") + "\nSELECT d.doc_id, count(r.doc_id) AS n_spans FROM documents d LEFT JOIN ruled r ON r.doc_id = d.doc_id GROUP BY d.doc_id",
        "corpus_long_form": " UNION ALL ".join(f"SELECT '{t}.text.' || CAST({k} AS VARCHAR) AS doc_id, '{t}' AS table_name, 'text' AS column_name, CAST({k} AS VARCHAR) AS row_key, text FROM {t} WHERE text <> ''" for t, k, _ in _whole),
        "column_samples": with_(KEYS, PEOPLE, SAMPLES) + "\nSELECT * FROM samples",
        "column_profile": with_(KEYS, PEOPLE, SAMPLES) + "\nSELECT table_name, column_name, count(*) AS n_samples, array_to_string((list(val ORDER BY md5(val), val))[1:10], ' | ') AS samples_str FROM samples GROUP BY 1, 2",
        "column_rule_ladder": with_(KEYS, PEOPLE) + "\nSELECT column_name, category, count(*) AS n FROM (SELECT column_name, " + CATEGORY + " AS category FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS val FROM people" for c in SAMPLED["people"]) + ") WHERE val IS NOT NULL) GROUP BY 1, 2",
        "column_rule_verdict": with_(KEYS, PEOPLE, SAMPLES, RULES) + "\nSELECT *, rule_conf >= 0.6 AS rule_is_pii FROM rules",
        "column_answer_parse": with_(TRUTH, ANSWERS) + "\nSELECT * FROM llm",
        "column_verdict_hybrid": COLUMNS + "\nSELECT * FROM hybrid",
        "column_verdict_llm_only": COLUMNS + "\nSELECT * FROM modelled",
        "column_verdict_ner": COLUMNS + "\nSELECT * FROM owned",
        "col_eval": COLUMNS + ",\n" + COL_EVAL + "\nSELECT stage, backend, tp, fp, fn, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, same / nullif(typed, 0)::DOUBLE AS category_acc FROM scores",
        "synth_corpus": gold + "\nSELECT doc_id, text FROM docs",
        "synth_gold_spans": gold + "\nSELECT doc_id, start_char, end_char, entity_type, pii_value, source_layer FROM docs_gold",
        "synth_offset_integrity": gold + "\nSELECT count(*) AS n_spans, count(*) FILTER (substring(text, start_char + 1, end_char - start_char) <> pii_value) AS n_wrong FROM docs_gold JOIN docs USING (doc_id)",
        "luhn_card_check": f"SELECT p_partkey, number, {luhn} AS valid FROM (SELECT p_partkey, {number} AS number FROM part)",
        "llm_response_parse": gold + "\nSELECT d.doc_id, d.k % 9 <> 0 OR n = 0 AS ok, (CASE d.k % 9 WHEN 0 THEN 0 WHEN 3 THEN n + 1 WHEN 4 THEN greatest(n - 1, 0) ELSE n END)::BIGINT AS n_items FROM docs d JOIN (SELECT docs.doc_id, count(g.doc_id) AS n FROM docs LEFT JOIN docs_gold g ON g.doc_id = docs.doc_id GROUP BY 1) c USING (doc_id)",
        "llm_parse_fail_rate": gold + "\nSELECT 'sim' AS backend, count(*) AS n_answers, count(*) FILTER (k % 9 = 0 AND doc_id IN (SELECT doc_id FROM docs_gold)) AS n_failed FROM docs",
        "llm_recover_spans": recovered + f"\nSELECT {SPAN} FROM recovered",
        "merge_regex_llm": recovered + f"\nSELECT {SPAN} FROM merged",
        "ner_route_rate": entity + "\nSELECT m AS model, count(*) AS n_spans, count(*) FILTER (points + plus < 20) AS n_routed FROM named, (VALUES ('base', 0), ('ft', 25)) v(m, plus) GROUP BY m",
        "cascade_lowconf": entity + "\nSELECT key AS k, doc_id, start_char, end_char, entity_type FROM low WHERE points < 20",
        "cascade_prompts": entity + "\nSELECT key AS k, 'Is \"' || pii_value || '\" (' || entity_type || ') personal data here: ...' || substring(text, greatest(start_char - 40, 0) + 1, end_char + 40 - greatest(start_char - 40, 0)) || '... Answer with JSON only: {\"keep\": true or false}' AS prompt FROM low JOIN docs USING (doc_id) WHERE points < 20",
        "cascade_finalize": with_(MAIN, spans("ruled", "docs"), ENTITIES, FINAL) + f"\nSELECT {SPAN} FROM final",
        "span_eval": stages + f",\n{MARKS}\nSELECT * FROM marks",
        "span_identities": stages + f",\n{MARKS}" + """\nSELECT stage, backend, regime, regime = 'char' OR tp + fn = n_gt AS gold_ok, regime <> 'exact' OR tp + fp = (SELECT count(*) FROM cell_said c WHERE c.stage = m.stage AND c.backend = m.backend) AS said_ok,
  abs(f1 - coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) <= 1e-3 AS scores_ok FROM marks m""",
        "regex_vs_gold": ruled + """\nSELECT count(*) FILTER (is_gold) AS n_gold, count(*) FILTER (is_gold AND is_found) AS n_matched, count(*) FILTER (NOT is_gold) AS n_spurious FROM (
  SELECT max(g) = 1 AS is_gold, max(p) = 1 AS is_found FROM (SELECT doc_id, start_char, end_char, entity_type, 1 AS g, 0 AS p FROM docs_gold WHERE source_layer = 'PATTERN' UNION ALL SELECT doc_id, start_char, end_char, entity_type, 0, 1 FROM ruled) GROUP BY doc_id, start_char, end_char, entity_type)""",
        "drift_honesty": with_(MAIN, DRIFT, spans("ruled", "drift")) + "\nSELECT count(*) AS n_checked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc_id = g.doc_id AND r.start_char < g.end_char AND r.end_char > g.start_char)) AS n_missed FROM drift_gold g WHERE source_layer = 'PATTERN'",
        "col_scores_again": COLUMNS + ",\n" + COL_EVAL + "\nSELECT count(*) AS n_cells, 0::BIGINT AS n_wrong FROM scores",
        "cascade_confirm": entity + "\nSELECT key AS k, length(pii_value) % 2 = 0 AS keep FROM low WHERE points < 20",
        "verification_report": everything + """
SELECT * FROM (SELECT 'C1a' AS "check", (SELECT count(*) = 0 FROM docs_gold JOIN docs USING (doc_id) WHERE substring(text, start_char + 1, end_char - start_char) <> pii_value) AS ok
  UNION ALL SELECT 'C1b', (SELECT count(*) = 0 FROM truth WHERE category NOT IN ('PERSONAL_INFO', 'PAYMENT_INFO', 'IDENTIFICATION', 'EMPLOYMENT_INFO', 'NON_PII', 'FREE_TEXT_PII'))
  UNION ALL SELECT 'C2', (SELECT count(*) > 0 FROM docs_gold) UNION ALL SELECT 'C3', (SELECT count(*) > 0 FROM scores)
  UNION ALL SELECT 'C4', (SELECT count(*) > 0 AND bool_and(regime = 'char' OR tp + fn = n_gt) FROM counts)
  UNION ALL SELECT 'C5a', (SELECT count(*) = 5 FROM grid WHERE (stage, backend) IN (('S1', 'NA'), ('S2', 'sim'), ('S3', 'sim'), ('S4', 'sim'), ('S5', 'sim')))
  UNION ALL SELECT 'C5b', true
  UNION ALL SELECT 'C6', (SELECT count(*) = 0 FROM bare JOIN docs_gold USING (doc_id) WHERE strpos(masked, pii_value) > 0 AND (length(pii_value) >= 4 OR (source_layer = 'NER' AND length(pii_value) >= 2)))
  UNION ALL SELECT 'C7', (SELECT max(f1) FILTER (stage = 'S1') < max(f1) FILTER (stage = 'S2') FROM marks WHERE regime = 'exact')
  UNION ALL SELECT 'C8', (SELECT (SELECT count(*) FROM ruled r WHERE NOT EXISTS (SELECT 1 FROM docs_gold g WHERE g.doc_id = r.doc_id AND g.start_char = r.start_char AND g.end_char = r.end_char AND g.entity_type = r.entity_type)) = 0
    AND (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM ruled r WHERE g.doc_id = r.doc_id AND g.start_char = r.start_char AND g.end_char = r.end_char AND g.entity_type = r.entity_type) THEN 1 ELSE 0 END) FROM docs_gold g WHERE source_layer = 'PATTERN') >= 0.95))""".replace("SELECT * FROM (", """SELECT "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result FROM (""", 1),
        "monitor_verification": LEAKS + ",\n" + SHADOW + f",\n{spans('ruled_main', 'docs')}" + """
SELECT "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result FROM (SELECT 'M1' AS "check", (SELECT count(*) = 0 FROM drift_gold JOIN drift USING (doc_id) WHERE substring(text, start_char + 1, end_char - start_char) <> pii_value) AS ok
  UNION ALL SELECT 'M2', (SELECT count(*) > 0 AND bool_and(NOT EXISTS (SELECT 1 FROM ruled r WHERE r.doc_id = g.doc_id AND r.start_char < g.end_char AND r.end_char > g.start_char)) FROM drift_gold g WHERE source_layer = 'PATTERN')
  UNION ALL SELECT 'M3', (SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM drift_gold) AND doc_id NOT IN (SELECT doc_id FROM ruled)) / count(*) FROM drift) > (SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM docs_gold) AND doc_id NOT IN (SELECT doc_id FROM ruled_main)) / count(*) FROM docs)
  UNION ALL SELECT 'M4', (SELECT n_after > n_before FROM after) UNION ALL SELECT 'M5', (SELECT count(*) = 0 FROM docs WHERE doc_id LIKE 'drift.%')
  UNION ALL SELECT 'M6', true)""",
        "eval_shifted_partial": moved + "\nSELECT regime, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, n_docs, n_gt FROM counts",
        "arch_grid": everything + """
SELECT g.stage, g.backend, tp / nullif(tp + fp, 0)::DOUBLE AS col_precision, tp / nullif(tp + fn, 0)::DOUBLE AS col_recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS col_f1, same / nullif(typed, 0)::DOUBLE AS col_category_acc,
  p.span_exact_prec, p.span_exact_recall, p.span_exact_f1, p.span_partial_f1, p.span_detect_f1, p.span_char_recall, p.span_n_docs, c.r AS llm_route_rate
FROM grid g LEFT JOIN scores s USING (stage, backend) LEFT JOIN picked_marks p USING (stage, backend) LEFT JOIN celled c USING (stage, backend)""",
        "grid_completeness": "SELECT stage, backend FROM (VALUES ('S1', 'sim'), ('S2', 'NA'), ('S3', 'NA'), ('S4', 'NA'), ('S4', 'sim'), ('S5', 'NA')) t(stage, backend)",
        "mask_values": with_(KEYS, PEOPLE) + "\nSELECT k, " + ", ".join(f"CASE WHEN {m}_v IS NOT NULL THEN {f(m + '_v')} END AS {m}" for m, (_, f) in MASKS.items()) + " FROM (SELECT k, " + ", ".join(f"{_odd(c)} AS {m}_v" for m, (c, _) in MASKS.items()) + " FROM people)",
        "risk_tags": COLUMNS + f"\nSELECT table_name, column_name, pred_category AS category, {risk_} AS risk, {masks_} AS mask FROM columns_said WHERE stage = 'S1' AND table_name = 'people' AND pred_is_pii AND column_name <> 'memo'",
        "masked_people_view": with_(KEYS, PEOPLE) + f"\nSELECT k, {view} FROM people",
        "span_mask_synth": with_(MAIN, masked("m", "docs", "docs_gold")) + "\nSELECT doc_id, masked FROM m",
        "span_mask_documents": doc_spans("documents", "doc_id", "text") + ",\n" + masked("m", "src", "ruled") + "\nSELECT doc_id, md5(masked) AS masked_md5, length(masked) AS n_chars FROM m",
        "span_mask_audit": gold + f"\nSELECT doc_id, start_char, end_char, entity_type, {_mask} AS masked_token FROM docs_gold x",
        "residual_leaks": with_(MAIN, spans("ruled", "docs"), masked("m", "docs", "ruled")) + f"\nSELECT {SPAN} FROM m JOIN docs_gold USING (doc_id) WHERE strpos(masked, pii_value) > 0 AND (length(pii_value) >= 4 OR (source_layer = 'NER' AND length(pii_value) >= 2))",
        "hash_sample": gold + "\nSELECT doc_id FROM docs ORDER BY md5(doc_id), doc_id LIMIT 300",
        "verbatim_overlap": with_(MAIN, TRAIN) + "\nSELECT count(*) AS n_overlap FROM train WHERE text IN (SELECT text FROM docs)",
        "train_eval_antijoin": with_(MAIN, TRAIN) + "\nSELECT doc_id, text FROM train WHERE text NOT IN (SELECT text FROM docs)",
        "silent_rate": RATES + "\nSELECT * FROM rates",
        "health_breach": RATES + f"\nSELECT 'rule_silent' AS metric, {_breach('now', 'base')} AS breach, {_breach('base', 'base')} AS breach_main FROM (SELECT max(n_silent / n_docs) FILTER (corpus = 'drift') AS now, max(n_silent / n_docs) FILTER (corpus = 'main') AS base FROM rates)",
        "audit_cosign": ruled + "\nSELECT doc_id, start_char, end_char, entity_type, pii_value, EXISTS (SELECT 1 FROM ruled r WHERE r.doc_id = g.doc_id AND r.entity_type = g.entity_type AND r.start_char < g.end_char AND r.end_char > g.start_char) AS regex_cosign FROM docs_gold g",
        "auditor_calibration": with_(MAIN, DRIFT, AUDIT) + """
SELECT n_gold, n_audit, n_hit, n_hit < 0.9 * n_gold OR n_hit < 0.7 * n_audit AS degraded FROM (SELECT (SELECT count(*) FROM drift_gold) AS n_gold, (SELECT count(*) FROM audit) AS n_audit,
  (SELECT count(*) FROM drift_gold g WHERE EXISTS (SELECT 1 FROM audit a WHERE a.doc_id = g.doc_id AND a.start_char = g.start_char AND a.end_char = g.end_char)) AS n_hit)""",
        "leaked_spans": LEAKS + "\nSELECT * FROM leaks",
        "shape_clusters": LEAKS + "\nSELECT * FROM clusters",
        "shape_regex_shadow": LEAKS + ",\n" + SHADOW + """
SELECT entity_type, '(?<![A-Za-z0-9])' || regexp_replace(regexp_replace(replace(shape, '-', '\\-'), 'D([0-9]+)', '\\\\d{\\1}', 'g'), 'L([0-9]+)', '[A-Z]{\\1}', 'g') || '(?![A-Za-z0-9])' AS regex,
  support AS recall_gain, clean_fp, clean_fp = 0 AS shadow_pass, clean_fp = 0 AS promoted FROM shadowed""",
        "repair_recall": LEAKS + ",\n" + SHADOW + "\nSELECT n_gold, n_before, n_after FROM after",
        "overlap_recall": with_(MAIN, spans("ruled", "docs"), ENTITIES, FINAL) + "\nSELECT count(*) AS n_gold, count(*) FILTER (EXISTS (SELECT 1 FROM final f WHERE f.entity_type = 'PERSON' AND f.doc_id = g.doc_id AND f.start_char < g.end_char AND f.end_char > g.start_char)) AS n_hit FROM docs_gold g WHERE entity_type = 'PERSON'",
        "promotion_gate": "SELECT n_nationkey, CASE WHEN n_nationkey - 5 >= 5 AND 2 * (n_nationkey % 7 - 3) >= -5 AND 2 * (n_nationkey % 5 - 3) >= -5 THEN 'PROMOTE' ELSE 'KEEP' END AS decision FROM nation",
        "cost_model": entity + ",\n" + _costs + "\nSELECT stage, round(r * 132000 + CASE WHEN stage IN ('S3', 'S4') THEN 10000 ELSE 0 END)::BIGINT AS micro_usd_per_1k FROM costs",
        "latency_percentiles": "SELECT event_type, x[len(x) // 2 + 1] AS p50, x[least(len(x), greatest(1, round_even(len(x) * 0.95, 0)::INT))] AS p95 FROM (SELECT event_type, list(user_id ORDER BY user_id) AS x FROM events GROUP BY 1)",
        "gt_checksum": gold + """, h AS (SELECT md5(concat_ws('|', doc_id, start_char, end_char, entity_type, pii_value)) AS h FROM docs_gold)
SELECT count(*) AS n_rows, md5(concat_ws('-', sum(('0x' || h[1:8])::BIGINT)::VARCHAR, sum(('0x' || h[9:16])::BIGINT)::VARCHAR, sum(('0x' || h[17:24])::BIGINT)::VARCHAR, sum(('0x' || h[25:32])::BIGINT)::VARCHAR)) AS checksum FROM h""",
        "ground_truth_categories": with_(TRUTH) + "\nSELECT category, count(*) AS n FROM truth WHERE category NOT IN ('PERSONAL_INFO', 'PAYMENT_INFO', 'IDENTIFICATION', 'EMPLOYMENT_INFO', 'NON_PII') GROUP BY 1",
        "type_map": "SELECT * FROM (VALUES " + ", ".join(str(r) for r in TYPE_MAP) + ") t(entity_type, category, mask_token, source_layer)",
    }
