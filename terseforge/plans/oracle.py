"""SQL for DuckDB that must give the rows of the registered queries.

Look-behind is missing there, so breaks are marked with chr(1) and wrong ones taken back.
"""

from __future__ import annotations

from terseforge.operators.masking import SENT_MASK
from terseforge.operators.units import BOUNDARY_WORDS
from terseforge.plans.tasks import CHAT

WS = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
RATIOS = (0.2, 0.35, 0.5, 0.65, 0.8)


def _collapse(c: str) -> str:
    return f"regexp_replace({c}, '{WS}+', ' ', 'g')"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _sentences(source: str, keys: str, text: str) -> str:
    """CTEs ending in sent(keys, sent_idx, sentence); ``text`` must be collapsed or free of odd white space."""
    return rf"""
 marked AS (SELECT {keys}, regexp_replace(regexp_replace(regexp_replace({text}, '([.?])({WS})', '\1' || chr(1) || '\2', 'g'),
   '([\p{{L}}\p{{N}}_]\.[\p{{L}}\p{{N}}_].)' || chr(1), '\1', 'g'), '([A-Z][a-z]\.)' || chr(1), '\1', 'g') AS t FROM {source}),
 pieces AS (SELECT {keys}, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM marked),
 sent AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS sent_idx, {_strip('s')} AS sentence FROM pieces WHERE {_strip('s')} <> '')"""


_TOK = r"' ?[\p{L}\p{N}_]+| ?[^\s\p{L}\p{N}_]+|\s+'"
DOCS = f"docs AS (SELECT doc_id, {_collapse('text')} AS body FROM documents)"
SENT = f"{DOCS},{_sentences('docs', 'doc_id', 'body')}"
TOKENS = f"""{SENT},
 toks AS (SELECT doc_id, sent_idx, unnest(regexp_extract_all(sentence, {_TOK})) AS token, generate_subscripts(regexp_extract_all(sentence, {_TOK}), 1) - 1 AS pos FROM sent)"""
MODEL = """counts AS (SELECT token, count(*) AS n FROM toks GROUP BY 1),
 model AS (SELECT token, n, round(-ln((n + 1) / ((SELECT sum(n) FROM counts) + (SELECT count(*) FROM counts))::DOUBLE), 6) AS self_info FROM counts)"""
SCORED = f"""{TOKENS}, {MODEL}, scored AS (SELECT t.*, m.self_info FROM toks t JOIN model m USING (token))"""
_BOUND = ", ".join(f"'{w}'" for w in BOUNDARY_WORDS)
CHUNKS = rf"""hards AS (SELECT *, lower(trim(token)) IN ({_BOUND}) OR NOT regexp_matches(lower(trim(token)), '^[\p{{L}}\p{{N}}_]') AS hard FROM SRC),
 begun AS (SELECT *, CASE WHEN coalesce(lag(hard) OVER w, true) OR hard THEN 1 ELSE 0 END AS starts FROM hards WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY pos)),
 chunks AS (SELECT *, (sum(starts) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT - 1 AS phrase_idx FROM begun)"""
SENT_UNITS = "su AS (SELECT doc_id, sent_idx, string_agg(token, '' ORDER BY pos) AS text, round(avg(self_info) + 1e-9, 6) AS self_info FROM scored GROUP BY 1, 2)"
PHRASE_UNITS = CHUNKS.replace("SRC", "scored") + """, pu AS (SELECT doc_id, sent_idx, phrase_idx, CASE WHEN sent_idx > 0 AND phrase_idx = 0 THEN ' ' ELSE '' END || string_agg(token, '' ORDER BY pos) AS text,
   round(avg(self_info) + 1e-9, 6) AS self_info FROM chunks GROUP BY 1, 2, 3)"""


def _limit(source: str, key: str, ratio: str) -> str:
    """Thresholds by linear interpolation over the sorted, known scores."""
    return f"""sorted AS (SELECT {key}, list_sort(list(self_info) FILTER (WHERE self_info IS NOT NULL AND NOT isnan(self_info))) AS s FROM {source} GROUP BY 1),
 placed AS (SELECT {key}, s, (len(s) - 1) * {ratio}::DOUBLE AS p FROM sorted),
 lim AS (SELECT {key}, CASE WHEN len(s) > 0 THEN s[floor(p)::BIGINT + 1] + (s[least(floor(p)::BIGINT + 1, len(s) - 1) + 1] - s[floor(p)::BIGINT + 1]) * (p - floor(p)) END AS lim FROM placed)"""


_LOW = "coalesce(u.self_info < l.lim AND NOT isnan(u.self_info), false)"


def _mask(source: str, order: str, joint: str, key: str = "doc_id", ratio: str = "0.35", by: str = "''", count: bool = True) -> str:
    n = f", count(*) FILTER (WHERE {_LOW}) AS n_masked" if count else ""
    return f"{_limit(source, key, ratio)} SELECT u.{key}, string_agg(CASE WHEN {_LOW} THEN {by} ELSE u.text END, '{joint}' ORDER BY {order}) AS context{n} FROM {source} u JOIN lim l USING ({key}) GROUP BY 1"


_LEAD = r"array_to_string(list_slice(regexp_extract_all(u.text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+'), 1, 3), ' ') || ' " + SENT_MASK + "'"

LEX = """lex AS (SELECT unit_id, entry_id, unit_type, unnest(text) AS text, unnest(CASE WHEN self_info IS NULL THEN list_transform(text, lambda x: NULL::DOUBLE) ELSE self_info END) AS self_info, generate_subscripts(text, 1) - 1 AS pos
   FROM lexical_units WHERE text IS NOT NULL)"""
LEXS = LEX + ", ls AS (SELECT unit_id, pos, text, self_info FROM lex WHERE unit_type = 'sent' AND self_info IS NOT NULL AND NOT isnan(self_info))"

TURNS = """turns AS (SELECT conv_id, turn::BIGINT AS turn, lower(trim(arg_min(role, turn_id))) AS role, coalesce(first(text ORDER BY turn_id), '') AS text FROM conv_turns GROUP BY 1, 2)"""
LINES = "lines AS (SELECT *, role || ': ' || text AS l FROM turns)"
_LINE = "CASE WHEN right(l, 1) IN ('.', '!', '?') THEN l ELSE l || '.' END"
ROUNDS = "rounds AS (SELECT conv_id, count(*) AS num_rounds, max(turn) AS last FROM turns GROUP BY 1 HAVING count(*) >= 4)"
CUNITS = f"""{TURNS}, kept AS (SELECT t.* FROM turns t JOIN (SELECT conv_id, max(turn) AS last FROM turns GROUP BY 1) USING (conv_id) WHERE turn < last), {_sentences('kept', 'conv_id, turn', 'text')},
 cu AS (SELECT conv_id, turn, sent_idx AS pos, sentence AS text, round(ln(length(sentence) + 1.0), 6) AS self_info FROM sent
   UNION ALL SELECT conv_id, turn, -1, ' ' || role || ': ', 100.0 FROM kept WHERE text <> '')"""

PAIRS = """crows AS (SELECT lower(trim(dataset_type)) AS dataset, entry_id, context_type, mask_ratio, context_id, context FROM contexts WHERE context IS NOT NULL AND dataset_type IS NOT NULL),
 ref AS (SELECT dataset, entry_id, arg_min(context, context_id) AS reference FROM crows WHERE context_type = 'no' GROUP BY 1, 2),
 pairs AS (SELECT m.*, r.reference FROM (SELECT dataset, entry_id, context_type, mask_ratio, arg_min(context, context_id) AS context, min(context_id) AS context_id FROM crows WHERE context_type <> 'no' GROUP BY 1, 2, 3, 4) m
   JOIN ref r ON m.dataset = r.dataset AND m.entry_id = r.entry_id)"""
_SAVED = "round(greatest(length(reference) - length(context), 0) / nullif(length(reference), 0)::DOUBLE, 6)"


def _grams(n: int, toks: str) -> str:
    joined = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
    return f"""SELECT context_id, {n} AS n, side, {joined} AS g FROM (SELECT context_id, side, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM {toks})"""


RTOK = """rt AS (SELECT context_id, 1 AS side, regexp_extract_all(lower(context), '[a-z0-9]+') AS t FROM pairs UNION ALL SELECT context_id, 0, regexp_extract_all(lower(reference), '[a-z0-9]+') FROM pairs)"""


def _rouge(n: int, tag: str) -> str:
    return f"""g{tag} AS ({_grams(n, 'rt')}), c{tag} AS (SELECT context_id, g, sum(side) AS cp, sum(1 - side) AS cr FROM g{tag} GROUP BY 1, 2),
 o{tag} AS (SELECT context_id, sum(cp) AS np, sum(cr) AS nr, sum(least(cp, cr)) AS nb FROM c{tag} GROUP BY 1),
 q{tag} AS (SELECT p.context_id, coalesce(nb / nullif(np, 0)::DOUBLE, 0) AS pr, coalesce(nb / nullif(nr, 0)::DOUBLE, 0) AS rc FROM pairs p LEFT JOIN o{tag} USING (context_id)),
 rouge{tag} AS (SELECT context_id, pr AS precision, rc AS recall, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM q{tag})"""


CELLS = f"""{PAIRS}, {RTOK}, {_rouge(1, '1')}, {_rouge(2, '2')},
 cells AS (SELECT p.context_id, dataset, context_type AS method, mask_ratio AS ratio, a.f1 AS rouge1, b.f1 AS rouge2 FROM pairs p JOIN rouge1 a USING (context_id) JOIN rouge2 b USING (context_id)),
 means AS (SELECT method, dataset, avg(rouge1) AS rouge1, avg(rouge2) AS rouge2 FROM cells GROUP BY 1, 2)"""
GAPS = f"""{CELLS}, gaps AS (SELECT m.method, m.dataset, round(m.rouge1, 6) AS rouge1, round(m.rouge2, 6) AS rouge2, round(b.rouge1 - m.rouge1, 6) AS gap_rouge1, round(b.rouge2 - m.rouge2, 6) AS gap_rouge2
   FROM means m JOIN means b ON b.method = 'no2' AND b.dataset = m.dataset WHERE m.method <> 'no2')"""


def _bleu_tokens(c: str) -> str:
    t = rf"' ' || replace({c}, chr(10), ' ') || ' '"
    for code, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = f"replace({t}, '{code}', '{sign}')"
    for pattern, by in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return f"list_filter(regexp_split_to_array({t}, ' +'), lambda x: x <> '')"


_BLEU = f"""WITH {PAIRS}, bt AS (SELECT context_id, 1 AS side, {_bleu_tokens('context')} AS t FROM pairs UNION ALL SELECT context_id, 0, {_bleu_tokens('reference')} FROM pairs),
 g AS ({' UNION ALL '.join(_grams(n, 'bt') for n in (1, 2, 3, 4))}), c AS (SELECT context_id, n, g, sum(side) AS cp, sum(1 - side) AS cr FROM g GROUP BY 1, 2, 3),
 o AS (SELECT context_type, n, sum(cp) AS np, sum(least(cp, cr)) AS nb FROM c JOIN pairs USING (context_id) GROUP BY 1, 2),
 lens AS (SELECT context_type, sum(CASE WHEN side = 1 THEN len(t) END) AS lp, sum(CASE WHEN side = 0 THEN len(t) END) AS lr FROM bt JOIN pairs USING (context_id) GROUP BY 1),
 w AS (SELECT context_type, {', '.join(f'coalesce(max(CASE WHEN n = {n} THEN nb / nullif(np, 0)::DOUBLE END), 0) AS p{n}' for n in (1, 2, 3, 4))} FROM o GROUP BY 1),
 b AS (SELECT w.*, CASE WHEN lp >= lr THEN 1.0 WHEN lp = 0 THEN 0.0 ELSE exp(1 - lr / lp::DOUBLE) END AS brevity FROM w JOIN lens USING (context_type))
 SELECT context_type, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, round(brevity, 6) AS brevity,
   round(CASE WHEN p1 > 0 AND p2 > 0 AND p3 > 0 AND p4 > 0 THEN brevity * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0 END, 6) AS bleu FROM b"""

_UNIFORM = "(('0x' || substr(md5(KEY || ':' || POS), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _uniform(key: str, pos: str) -> str:
    return _UNIFORM.replace("KEY", key).replace("POS", pos)


def _grid() -> str:
    parts = [f"SELECT r.unit_id, 'self-info' AS method, {r} AS ratio, CASE WHEN r.unit_type = 'sent' THEN string_agg(CASE WHEN coalesce(u.self_info < t.lim AND NOT isnan(u.self_info), false) THEN '' ELSE u.text END, ' ' ORDER BY pos) ELSE string_agg(CASE WHEN coalesce(u.self_info < t.lim AND NOT isnan(u.self_info), false) THEN '' ELSE u.text END, '' ORDER BY pos) END AS context, count(*) FILTER (WHERE coalesce(u.self_info < t.lim AND NOT isnan(u.self_info), false)) AS n_masked FROM rows0 r JOIN lex u USING (unit_id) JOIN lims t ON t.unit_id = r.unit_id AND t.ratio = {r} GROUP BY r.unit_id, r.unit_type" for r in RATIOS]
    parts += [f"SELECT r.unit_id, 'Random', {r}, string_agg(CASE WHEN {_uniform('r.unit_id', 'pos')} < {r} THEN '' ELSE u.text END, ' ' ORDER BY pos), NULL::BIGINT FROM rows0 r JOIN lex u USING (unit_id) GROUP BY 1" for r in RATIOS]
    parts += ["SELECT r.unit_id, 'no', 0.0, CASE WHEN r.unit_type = 'sent' THEN string_agg(u.text, ' ' ORDER BY pos) ELSE string_agg(u.text, '' ORDER BY pos) END, 0 FROM rows0 r JOIN lex u USING (unit_id) GROUP BY r.unit_id, r.unit_type"]
    methods = [("self-info", r) for r in RATIOS] + [("Random", r) for r in RATIOS] + [("no", 0.0)]
    every = ", ".join(f"('{m}', {r})" for m, r in methods)
    return f"""WITH {LEX}, rows0 AS (SELECT unit_id, unit_type FROM lexical_units WHERE text IS NOT NULL), {_lims('lex')}, made AS ({' UNION ALL '.join(parts)}),
 cells AS (SELECT r.unit_id, r.unit_type AS level, m.col0 AS method, m.col1::DOUBLE AS ratio FROM rows0 r, (VALUES {every}) m)
 SELECT c.unit_id, c.level, c.method, c.ratio, coalesce(d.context, '') AS context, CASE WHEN c.method = 'Random' THEN NULL ELSE coalesce(d.n_masked, 0) END AS n_masked
 FROM cells c LEFT JOIN made d ON d.unit_id = c.unit_id AND d.method = c.method AND d.ratio::DOUBLE = c.ratio"""


def _lims(source: str) -> str:
    ratios = ", ".join(f"({r}::DOUBLE)" for r in RATIOS)
    return f"""ratios AS (SELECT col0 AS ratio FROM (VALUES {ratios})), srt AS (SELECT unit_id, list_sort(list(self_info) FILTER (WHERE self_info IS NOT NULL AND NOT isnan(self_info))) AS s FROM {source} GROUP BY 1),
 pls AS (SELECT unit_id, ratio, s, (len(s) - 1) * ratio AS p FROM srt, ratios),
 lims AS (SELECT unit_id, ratio, CASE WHEN len(s) > 0 THEN s[floor(p)::BIGINT + 1] + (s[least(floor(p)::BIGINT + 1, len(s) - 1) + 1] - s[floor(p)::BIGINT + 1]) * (p - floor(p)) END AS lim FROM pls)"""


_FAMILY = "CASE WHEN lower(model_type) LIKE '%flan%' THEN 'flan' WHEN lower(model_type) LIKE '%vicuna%' THEN 'vicuna' WHEN regexp_matches(lower(model_type), 'gpt|alpaca|instruct') THEN 'instruct' ELSE 'base' END"
CTX = "ctx AS (SELECT context_id, context, (['flan', 'vicuna', 'instruct', 'base'])[(context_id % 4)::BIGINT + 1] AS family FROM contexts WHERE context IS NOT NULL)"
_CHAT = CHAT.replace("'", "''")
_NL = "chr(10)"


def _last(c: str, mark: str) -> str:
    return f"CASE WHEN contains({c}, {mark}) THEN left({c}, length({c}) - strpos(reverse({c}), {mark}) - length({mark}) + 1) ELSE {c} END"


_CLEAN = f"""CASE WHEN family = 'base' THEN CASE WHEN task_name = 'summarisation' THEN {_strip(_last('answer', _NL))} WHEN task_name = 'qa' THEN {_last('answer', f'{_NL} || {_NL}')} ELSE {_last('answer', _NL)} END
 WHEN contains(answer, 'ASSISTANT:') THEN {_strip("substr(answer, strpos(answer, 'ASSISTANT:') + 10)")} ELSE answer END"""

APAIRS = """ar AS (SELECT answer_id, lower(trim(dataset_type)) AS dataset, entry_id, context_type, mask_ratio, task_name, model_type, question, answer FROM qa_answers WHERE answer IS NOT NULL AND question IS NOT NULL AND dataset_type IS NOT NULL),
 aref AS (SELECT dataset, entry_id, task_name, model_type, question, arg_min(answer, answer_id) AS reference FROM ar WHERE context_type = 'no' GROUP BY ALL),
 aoth AS (SELECT dataset, entry_id, task_name, model_type, question, context_type, mask_ratio, arg_min(answer, answer_id) AS answer, min(answer_id) AS answer_id FROM ar WHERE context_type <> 'no' GROUP BY ALL)"""

ACELLS = f"""{APAIRS}, pairs AS (SELECT o.answer_id AS context_id, o.dataset, o.task_name, o.context_type, o.mask_ratio, o.answer AS context, r.reference FROM aoth o
   JOIN aref r ON o.dataset = r.dataset AND o.entry_id = r.entry_id AND o.task_name = r.task_name AND o.model_type = r.model_type AND o.question = r.question), {RTOK}, {_rouge(1, '1')}"""

HEAT = f"""WITH {LEXS}, hp AS (SELECT *, CASE WHEN self_info <> 100 THEN pow(self_info, 1.2) END AS p FROM ls),
 hw AS (SELECT *, min(p) OVER (PARTITION BY unit_id) AS lo, max(p) OVER (PARTITION BY unit_id) AS hi, quantile_cont(self_info, 0.5) OVER (PARTITION BY unit_id) AS med FROM hp),
 heated AS (SELECT unit_id, pos, text, CASE WHEN self_info = 100 THEN 100.0 WHEN hi > lo THEN 100 * (p - lo) / (hi - lo) ELSE 0.0 END AS heat, self_info > med AS high FROM hw)"""


def _article_contexts() -> str:
    body = _collapse("replace(replace(sections[1], '<cit.>', ''), '<ref>', '')")
    toks = f"list_sum(list_transform(ss, lambda x: len(regexp_extract_all(x, {_TOK}))))"
    first = f"fs AS (SELECT row_id, {body} AS body FROM articles WHERE len(sections) > 0), first AS (SELECT * FROM fs WHERE {_strip('body')} <> '')"
    rows = f"""toks AS (SELECT row_id, sent_idx, unnest(regexp_extract_all(sentence, {_TOK})) AS token, generate_subscripts(regexp_extract_all(sentence, {_TOK}), 1) - 1 AS pos FROM sent WHERE row_id IN (SELECT row_id FROM short))"""
    return f"""WITH {first},{_sentences('first', 'row_id', 'body')}, lists AS (SELECT row_id, list(sentence) AS ss FROM sent GROUP BY 1), short AS (SELECT row_id FROM lists WHERE {toks} <= 1800),
 {rows}, {MODEL}, scored AS (SELECT t.*, m.self_info FROM toks t JOIN model m USING (token)),
 su AS (SELECT row_id, sent_idx, string_agg(token, '' ORDER BY pos) AS text, avg(self_info) AS self_info FROM scored GROUP BY 1, 2),
 masked AS (WITH {_mask('su', 'u.sent_idx', ' ', key='row_id', by=_LEAD)})
 SELECT row_id, 'no' AS context_type, body AS context, false AS context_masked, -1 AS n_masked FROM first JOIN short USING (row_id)
 UNION ALL SELECT row_id, 'self-info', context, true, n_masked FROM masked"""


def statements() -> dict[str, str]:
    """SQL by query name."""
    return {
        "beautify": f"SELECT doc_id, {_collapse('text')} AS body FROM documents",
        "strip_citations": f"SELECT row_id, {_collapse('''replace(replace(text, '<cit.>', ''), '<ref>', '')''')} AS body FROM articles",
        "latex_comment_strip": rf"SELECT row_id, regexp_replace(regexp_replace(replace(text, 'percent', '% of'), '(^|[^\\])%[^\n]*', '\1', 'g'), '(^|[^\\])%[^\n]*', '\1', 'g') AS body FROM articles",
        "section_split": "SELECT row_id, generate_subscripts(sections, 1) - 1 AS section_no, unnest(sections) AS section FROM articles",
        "doc_id_tail": "SELECT row_id, string_split(entry_id, '/')[-1] AS id FROM articles",
        "published_range": "WITH a AS (SELECT row_id, entry_id, published FROM articles WHERE length(published) = 14 AND regexp_matches(published, '^[0-9]{14}$') AND published >= '20230301000000' AND published < '20230401000000') SELECT * FROM a ORDER BY published DESC, row_id LIMIT 8000",
        "sentence_split": f"WITH {SENT} SELECT doc_id, sent_idx, sentence FROM sent",
        "sentence_counts": f"WITH {SENT} SELECT d.doc_id, count(sentence) AS n_sentences FROM documents d LEFT JOIN sent s ON s.doc_id = d.doc_id GROUP BY 1",
        "tokenize": f"WITH {TOKENS} SELECT doc_id, sent_idx, pos, token FROM toks",
        "token_offsets": f"WITH {TOKENS}, o AS (SELECT *, (sum(length(token)) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS end_off FROM toks) SELECT doc_id, sent_idx, pos, end_off - length(token) AS start_off, end_off FROM o",
        "length_filter": f"WITH {TOKENS} SELECT d.doc_id, count(token) AS n_tokens FROM documents d LEFT JOIN toks USING (doc_id) GROUP BY 1 HAVING count(token) <= 300",
        "limit_after_filter": f"WITH {TOKENS} SELECT d.doc_id, count(token) AS n_tokens FROM documents d LEFT JOIN toks USING (doc_id) GROUP BY 1 HAVING count(token) <= 300 ORDER BY 1 LIMIT 200",
        "unigram_self_info": f"WITH {TOKENS}, {MODEL} SELECT token, n, self_info FROM model",
        "bigram_self_info": f"""WITH {TOKENS}, pv AS (SELECT coalesce(lag(token) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos), '<s>') AS prev, token FROM toks),
 b AS (SELECT prev, token, count(*) AS n FROM pv GROUP BY 1, 2), c AS (SELECT prev, sum(n) AS np FROM b GROUP BY 1), u AS (SELECT token, sum(n) AS nt FROM b GROUP BY 1)
 SELECT prev, token, n, round(-ln(0.7::DOUBLE * n / np + (1 - 0.7::DOUBLE) * (nt + 1) / ((SELECT sum(nt) FROM u) + (SELECT count(*) FROM u))), 6) AS self_info FROM b JOIN c USING (prev) JOIN u USING (token)""",
        "token_units": f"WITH {SCORED} SELECT doc_id, sent_idx, pos, token, self_info FROM scored",
        "sent_units": f"WITH {SCORED}, {SENT_UNITS} SELECT * FROM su",
        "phrase_units": f"WITH {SCORED}, {PHRASE_UNITS} SELECT * FROM pu",
        "align_tokens": f"""WITH {TOKENS}, pc AS (SELECT doc_id, sent_idx, i AS pos, substr(sentence, i * 5 + 1, 5) AS token FROM (SELECT *, unnest(range(0, ((length(sentence) + 4) // 5)::BIGINT)) AS i FROM sent)),
 ps AS (SELECT *, length(regexp_replace(token, '[^a-z]', '', 'g')) + 1.0 AS si, sum(length(token)) OVER w AS e, sum(length(token)) OVER w - length(token) AS s FROM pc WINDOW w AS (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 un AS (SELECT doc_id, sent_idx, pos AS unit, sum(length(token)) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) AS e, sum(length(token)) OVER (PARTITION BY doc_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(token) AS s FROM toks),
 hit AS (SELECT u.doc_id, u.sent_idx, u.unit, p.pos, p.si, count(*) OVER (PARTITION BY u.doc_id, u.sent_idx, p.pos) AS k FROM un u JOIN ps p ON p.doc_id = u.doc_id AND p.sent_idx = u.sent_idx AND p.s < u.e AND u.e <= p.e),
 free AS (SELECT u.doc_id, u.sent_idx, u.unit, p.si FROM (SELECT p.* FROM ps p ANTI JOIN hit h ON h.doc_id = p.doc_id AND h.sent_idx = p.sent_idx AND h.pos = p.pos) p JOIN un u ON p.doc_id = u.doc_id AND p.sent_idx = u.sent_idx AND u.s < p.e AND p.e <= u.e WHERE p.token <> ' '),
 cr AS (SELECT doc_id, sent_idx, unit, si / k AS c FROM hit UNION ALL SELECT doc_id, sent_idx, unit, si FROM free)
 SELECT doc_id, sent_idx, unit, round(avg(c) + 1e-9, 6) AS self_info FROM cr GROUP BY 1, 2, 3""",
        "dataset_stats": f"""WITH {TOKENS}, {CHUNKS.replace('SRC', 'toks')}, ps AS (SELECT doc_id, sent_idx, max(phrase_idx) + 1 AS ph, count(*) AS tk FROM chunks GROUP BY 1, 2), pd AS (SELECT doc_id, count(*) AS s, sum(ph) AS p, sum(tk) AS t FROM ps GROUP BY 1)
 SELECT count(*) AS n_docs, round(avg(s), 6) AS mean_sents, round(avg(p), 6) AS mean_phrases, round(avg(t), 6) AS mean_tokens FROM pd""",
        "mask_sent": f"WITH {SCORED}, {SENT_UNITS}, {_mask('su', 'u.sent_idx', ' ')}",
        "mask_phrase": f"WITH {SCORED}, {PHRASE_UNITS}, {_mask('pu', 'u.sent_idx, u.phrase_idx', '')}",
        "mask_token": f"WITH {SCORED}, tu AS (SELECT doc_id, sent_idx, pos, token AS text, self_info FROM scored), {_mask('tu', 'u.sent_idx, u.pos', '')}",
        "masked_units": f"WITH {SCORED}, {SENT_UNITS}, {_limit('su', 'doc_id', '0.35')} SELECT u.doc_id, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.sent_idx) - 1 AS place, u.text FROM su u JOIN lim l USING (doc_id) WHERE {_LOW}",
        "mask_sent_lead3": f"WITH {SCORED}, {SENT_UNITS}, {_mask('su', 'u.sent_idx', ' ', by=_LEAD, count=False)}",
        "mask_random": f"WITH {SCORED}, {PHRASE_UNITS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, phrase_idx) - 1 AS i FROM pu) SELECT doc_id, string_agg(CASE WHEN {_uniform('doc_id', 'i')} < 0.35 THEN '' ELSE text END, ' ' ORDER BY i) AS context FROM n GROUP BY 1",
        "threshold_by_ratio": f"WITH {LEX}, {_lims('lex')} SELECT u.unit_id, r.ratio, round(l.lim, 6) AS threshold FROM (SELECT unit_id FROM lexical_units WHERE text IS NOT NULL) u CROSS JOIN ratios r LEFT JOIN lims l ON l.unit_id = u.unit_id AND l.ratio = r.ratio",
        "context_grid": _grid(),
        "reduced_ratio": f"WITH {PAIRS} SELECT context_id, dataset, context_type, mask_ratio, {_SAVED} AS reduced FROM pairs",
        "reduced_ratio_means": f"WITH {PAIRS}, r AS (SELECT dataset, context_type, mask_ratio, {_SAVED} AS reduced FROM pairs) SELECT dataset, context_type, mask_ratio, round(avg(reduced) + 1e-9, 6) AS reduced FROM r GROUP BY 1, 2, 3",
        "experiment_grid": "SELECT d.dataset, t.col0 AS task, m.col0 AS model, r.col0::DOUBLE AS ratio FROM (SELECT DISTINCT lower(trim(dataset_type)) AS dataset FROM contexts WHERE dataset_type IS NOT NULL) d, (VALUES ('summarisation'), ('qa'), ('reconstruction')) t, (VALUES ('gpt-a'), ('llama-x-7b')) m, (VALUES (0.2), (0.35), (0.5), (0.65), (0.8)) r",
        "article_contexts": _article_contexts(),
        "unit_slice": "SELECT unit_id, array_to_string(list_concat(list_slice(text, 1, 50), list_slice(text, 361, 421)), '|') AS shown FROM lexical_units WHERE text IS NOT NULL",
        "task_ratio_table": f"WITH {ACELLS} SELECT context_type AS method, task_name AS task, mask_ratio AS ratio, round(avg(f1), 6) AS rouge1 FROM pairs JOIN rouge1 USING (context_id) GROUP BY 1, 2, 3",
        "source_ratio_table": f"WITH {ACELLS} SELECT context_type AS method, dataset, mask_ratio AS ratio, round(avg(f1), 6) AS rouge1 FROM pairs JOIN rouge1 USING (context_id) GROUP BY 1, 2, 3",
        "conversation_lines": f"WITH {TURNS}, {LINES} SELECT conv_id, turn, {_LINE} AS line FROM lines",
        "conversation_articles": f"WITH {TURNS}, {LINES}, {ROUNDS} SELECT conv_id, num_rounds, string_agg({_LINE}, chr(10) ORDER BY turn) AS text FROM lines JOIN rounds USING (conv_id) GROUP BY 1, 2",
        "conversation_prompt": f"WITH {TURNS}, {LINES}, {ROUNDS} SELECT conv_id, coalesce(string_agg(l || chr(10), '' ORDER BY turn) FILTER (WHERE turn < last), '') || 'gpt: ' AS prompt FROM lines JOIN rounds USING (conv_id) GROUP BY 1",
        "conversation_last_response": f"WITH {TURNS}, {ROUNDS} SELECT conv_id, text AS response FROM turns JOIN rounds USING (conv_id) WHERE turn = last",
        "conversation_roles": f"WITH {TURNS} SELECT conv_id, turn, ' ' || role || ': ' AS text, 100.0::DOUBLE AS self_info FROM turns WHERE text <> ''",
        "conversation_units": f"WITH {CUNITS} SELECT conv_id, turn, pos, text, self_info::DOUBLE AS self_info FROM cu",
        "conversation_mask": f"WITH {CUNITS}, cd AS (SELECT conv_id, turn, pos, text, self_info::DOUBLE AS self_info FROM cu), {_mask('cd', 'u.turn, u.pos', ' ', key='conv_id', ratio='0.5', count=False)}",
        "prompts_summarise": f"WITH {CTX} SELECT context_id, family, CASE family WHEN 'flan' THEN 'Summarize: ' || context WHEN 'vicuna' THEN '{_CHAT} USER: Here is the text.' || {_NL} || '----' || {_NL} || context || {_NL} || '----' || {_NL} || 'Summarise it in a few sentences. ASSISTANT:' WHEN 'instruct' THEN context || {_NL} || '---' || {_NL} || 'Summarise the text above.' ELSE context || {_NL} || 'Tl;dr' END AS prompt FROM ctx",
        "prompts_reconstruct": f"WITH {CTX} SELECT context_id, family, CASE family WHEN 'vicuna' THEN '{_CHAT} USER: Parts of the text were left out. Rebuild the original text.' || {_NL} || context || ' ASSISTANT: The original text is:' WHEN 'base' THEN 'Noisy paragraph:' || {_NL} || context || {_NL} || 'The original paragraph:' || {_NL} ELSE 'Parts of the text were left out. Rebuild the original text.' || {_NL} || '---' || {_NL} || context END AS prompt FROM ctx",
        "generated_reconstructions": f"WITH {CTX} SELECT context_id, CASE family WHEN 'vicuna' THEN '{_CHAT} USER: Parts of the text were left out. Rebuild the original text.' || {_NL} || context || ' ASSISTANT: The original text is:' WHEN 'base' THEN 'Noisy paragraph:' || {_NL} || context || {_NL} || 'The original paragraph:' || {_NL} ELSE 'Parts of the text were left out. Rebuild the original text.' || {_NL} || '---' || {_NL} || context END AS answer FROM ctx",
        "prompts_continue": f"WITH {TURNS}, {LINES}, {ROUNDS} SELECT conv_id, '{_CHAT}' || {_NL} || coalesce(string_agg(l || chr(10), '' ORDER BY turn) FILTER (WHERE turn < last), '') || 'gpt: ' AS prompt FROM lines JOIN rounds USING (conv_id) GROUP BY 1",
        "prompts_qa": f"""WITH q AS (SELECT entry_id, question, row_number() OVER (PARTITION BY entry_id ORDER BY question) AS i FROM (SELECT DISTINCT entry_id, question FROM qa_answers WHERE question IS NOT NULL AND entry_id IS NOT NULL)),
 ql AS (SELECT entry_id, string_agg(i || '. ' || question, {_NL} ORDER BY i) AS questions FROM q GROUP BY 1)
 SELECT context_id, 'Passage: ' || context || {_NL} || 'Questions: ' || questions || {_NL} || 'Answers:' AS prompt FROM contexts JOIN ql USING (entry_id) WHERE context IS NOT NULL""",
        "postprocess_answers": f"WITH a AS (SELECT answer_id, task_name, answer, {_FAMILY} AS family FROM qa_answers WHERE answer IS NOT NULL) SELECT answer_id, family, {_CLEAN} AS answer FROM a",
        "pending_work": "SELECT w.* FROM (SELECT DISTINCT entry_id, context_type, mask_ratio FROM contexts WHERE entry_id IS NOT NULL) w ANTI JOIN (SELECT * FROM qa_answers WHERE answer IS NOT NULL) d ON d.entry_id = w.entry_id AND d.context_type = w.context_type AND d.mask_ratio = w.mask_ratio",
        "answer_pairs": f"WITH {APAIRS} SELECT o.answer_id, o.dataset, o.task_name, o.context_type, o.mask_ratio, o.answer, r.reference FROM aoth o JOIN aref r ON o.dataset = r.dataset AND o.entry_id = r.entry_id AND o.task_name = r.task_name AND o.model_type = r.model_type AND o.question = r.question",
        "rouge1": f"WITH {PAIRS}, {RTOK}, {_rouge(1, '1')} SELECT context_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rouge1",
        "rouge2": f"WITH {PAIRS}, {RTOK}, {_rouge(2, '2')} SELECT context_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rouge2",
        "bleu": _BLEU,
        "by_ratio_table": f"WITH {CELLS} SELECT method, ratio, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2 FROM cells GROUP BY 1, 2",
        "method_task_avg": f"WITH {CELLS} SELECT method, dataset, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM means UNION ALL SELECT method, 'avg', round(avg(rouge1), 6), round(avg(rouge2), 6) FROM means GROUP BY 1",
        "gap_table": f"WITH {GAPS} SELECT * FROM gaps",
        "gap_table_fmt": f"WITH {GAPS} SELECT method, dataset, substr(printf('%.3f', rouge1), 2) || ' (' || substr(printf('%.2f', gap_rouge1), 2) || ')' AS rouge1 FROM gaps",
        "transpose_metrics": f"WITH {CELLS}, mm AS (SELECT method, avg(rouge1) AS rouge1, avg(rouge2) AS rouge2 FROM cells GROUP BY 1), " + "lg AS (SELECT 'rouge1' AS metric, method, rouge1 AS v FROM mm UNION ALL SELECT 'rouge2', method, rouge2 FROM mm) SELECT metric, round(max(CASE WHEN method = 'self-info' THEN v END), 6) AS self_info, round(max(CASE WHEN method = 'Random' THEN v END), 6) AS random, round(max(CASE WHEN method = 'no2' THEN v END), 6) AS no2 FROM lg GROUP BY 1",
        "random_repair": f"WITH {PAIRS}, rr AS (SELECT * FROM pairs WHERE context_type = 'Random'), ot AS (SELECT dataset, entry_id, arg_min(context, context_id) AS other FROM rr WHERE mask_ratio = 0.5 GROUP BY 1, 2) SELECT context_id, coalesce(other, context) AS context FROM rr LEFT JOIN ot USING (dataset, entry_id)",
        "unit_score_stats": f"WITH {LEXS} SELECT unit_id, round(min(self_info), 6) AS low, round(max(self_info), 6) AS high, round(quantile_cont(self_info, 0.5), 6) AS median, count(*) AS n FROM ls GROUP BY 1",
        "heat_units": f"{HEAT} SELECT unit_id, pos, round(heat, 3) AS heat, high FROM heated",
        "heatmap_latex": f"{HEAT} SELECT unit_id, string_agg(CASE WHEN high THEN '\\colorize{{' || printf('%.1f', heat) || '}}{{' || text || '}}' ELSE '\\sout{{' || text || '}}' END, '' ORDER BY pos) AS latex FROM heated GROUP BY 1",
        "low_score_runs": f"""WITH {LEXS}, m AS (SELECT *, quantile_cont(self_info, 0.5) OVER (PARTITION BY unit_id) AS lim, max(pos) OVER (PARTITION BY unit_id) AS e FROM ls),
 r AS (SELECT *, sum(CASE WHEN self_info < lim THEN 0 ELSE 1 END) OVER (PARTITION BY unit_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)
 SELECT unit_id, min(pos) AS first, max(pos) AS last, count(*) AS n FROM r WHERE self_info < lim GROUP BY unit_id, run, e HAVING max(pos) < e""",
        "conversation_contexts": f"""WITH {TURNS}, {LINES}, {ROUNDS}, ca AS (SELECT conv_id, string_agg({_LINE}, chr(10) ORDER BY turn) AS text FROM lines JOIN rounds USING (conv_id) GROUP BY 1), {_sentences('ca', 'conv_id', 'text')},
 cn AS (SELECT conv_id, sum(len(regexp_extract_all(sentence, {_TOK}))) AS n FROM sent GROUP BY 1), kept AS (SELECT conv_id FROM ca LEFT JOIN cn USING (conv_id) WHERE coalesce(n, 0) <= 1800)
 SELECT conv_id, 'no' AS context_type, text AS context, false AS context_masked FROM turns JOIN rounds USING (conv_id) JOIN kept USING (conv_id) WHERE turn = last
 UNION ALL SELECT conv_id, 'no2', coalesce(string_agg(l || chr(10), '' ORDER BY turn) FILTER (WHERE turn < last), '') || 'gpt: ', true FROM lines JOIN rounds USING (conv_id) JOIN kept USING (conv_id) GROUP BY 1""",
        "prompts_question": f"SELECT context_id, 'Write questions about the context below, each with its answer, as a table with tabs between the columns Question and Answer and nothing else.' || {_NL} || '---' || {_NL} || context AS prompt FROM contexts WHERE context IS NOT NULL AND context_type = 'no'",
        "question_tables": "SELECT task_name, row_number() OVER (PARTITION BY task_name ORDER BY question_id) - 1 AS place, question, question_id::VARCHAR AS answer FROM question_bank",
        "pooled_table": f"WITH {ACELLS}, {_rouge(2, '2')} SELECT context_type AS method, round(avg(a.f1) + 1e-9, 6) AS rouge1, round(avg(b.f1) + 1e-9, 6) AS rouge2 FROM pairs JOIN rouge1 a USING (context_id) JOIN rouge2 b USING (context_id) WHERE mask_ratio = 0.35 GROUP BY 1",
        "task_table": f"WITH {ACELLS}, {_rouge(2, '2')} SELECT context_type AS method, task_name AS task, round(avg(a.f1) + 1e-9, 6) AS rouge1, round(avg(b.f1) + 1e-9, 6) AS rouge2 FROM pairs JOIN rouge1 a USING (context_id) JOIN rouge2 b USING (context_id) WHERE mask_ratio = 0.35 AND NOT (context_type = 'no2' AND task_name = 'reconstruction') GROUP BY 1, 2",
        "metrics_file": f"WITH {PAIRS}, r AS (SELECT dataset, context_type, mask_ratio, {_SAVED} AS reduced FROM pairs) SELECT dataset, context_type, mask_ratio, round(avg(reduced) + 1e-9, 6) AS reduced FROM r GROUP BY 1, 2, 3",
        "conversation_file": f"WITH {TURNS}, {ROUNDS} SELECT conv_id, num_rounds, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM turns JOIN rounds USING (conv_id)",
        "news_file": "SELECT title, link AS entry_id, content AS text FROM news",
        "token_file": f"WITH {TOKENS}, {MODEL} SELECT token, self_info FROM model",
        "article_file": "SELECT entry_id, published, title, primary_category, text, array_to_string(authors, '|') AS authors, array_to_string(categories, '|') AS categories FROM articles",
        "question_file": "SELECT task_name, string_agg(question, '|' ORDER BY question_id) AS questions, string_agg(question_id::VARCHAR, '|' ORDER BY question_id) AS answers FROM question_bank GROUP BY 1",
        "compress_tokens": f"WITH {SCORED}, tu AS (SELECT doc_id, sent_idx, pos, token AS text, self_info FROM scored), made AS (WITH {_mask('tu', 'u.sent_idx, u.pos', '')}) SELECT doc_id, context, n_masked, round(greatest(length(body) - length(context), 0) / nullif(length(body), 0)::DOUBLE, 6) AS reduced FROM made JOIN docs USING (doc_id)",
        "chat_table": f"WITH {TURNS} SELECT conv_id, string_agg(role || '|' || text, chr(10) ORDER BY turn) AS chat FROM turns GROUP BY 1",
        "resume_scoring": "SELECT row_id, entry_id FROM articles a ANTI JOIN (SELECT * FROM lexical_units WHERE unit_type = 'sent') l ON l.entry_id = a.entry_id",
    }
