"""The queries of :mod:`quern.queries` in SQL, for the engine that checks them."""

from __future__ import annotations

from quern.operators import annotation
from quern.plans import prompts
from quern.queries import LETTERS

# vectors
_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-10))"
_VEC = f"""v AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, q.label AS ql, c.label AS cl, list_dot_product(q.u, c.u) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS rank FROM pairs)"""
_TOP = f"WITH {_VEC}, top AS (SELECT * FROM ranked WHERE rank < {{k}})"
_MARKED = _TOP.format(k=5) + ", m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top_score FROM top), s AS (SELECT *, score >= 0.35 AND score >= 0.85 * top_score AS selected FROM m)"


def _multi_k() -> str:
    cols = []
    for k in (1, 3, 5, 10):
        hits = f"count(*) FILTER (WHERE hit AND rank < {k})"
        ideal = f"list_sum(list_transform(range(1, least(n_gold, {k}) + 1), lambda i: 1 / log2(i + 1)))"
        cols += [
            f"round({hits}::DOUBLE / n_gold, 6) AS recall_at_{k}", f"round({hits}::DOUBLE / {k}, 6) AS precision_at_{k}",
            f"CASE WHEN {hits} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_{k}",
            f"round(coalesce(1.0::DOUBLE / (min(rank) FILTER (WHERE hit AND rank < {k}) + 1), 0), 6) AS mrr_at_{k}",
            f"round(coalesce(sum(1 / log2(rank + 2)) FILTER (WHERE hit AND rank < {k}), 0) / {ideal}, 6) AS ndcg_at_{k}",
        ]
    return _TOP.format(k=10) + ", g AS (SELECT query_id, count(*) FILTER (WHERE ql = cl) AS n_gold FROM pairs GROUP BY query_id), h AS (SELECT query_id, rank, ql = cl AS hit, n_gold FROM top JOIN g USING (query_id)) SELECT query_id, " + ", ".join(cols) + " FROM h GROUP BY query_id, n_gold"


_GRID = _TOP.format(k=10) + """, g AS (SELECT query_id, max(ql) < 8 AS answerable, count(*) FILTER (WHERE ql = cl) AS n_gold FROM pairs GROUP BY query_id),
mx AS (SELECT query_id, max(score) AS top FROM top GROUP BY query_id),
cells AS (SELECT k, threshold, relative_floor FROM (SELECT unnest([1, 3, 5, 10]) AS k), (SELECT unnest([0.0, 0.25, 0.3, 0.35, 0.4, 0.45])::DOUBLE AS threshold), (SELECT unnest([0.0, 0.75, 0.85, 0.95])::DOUBLE AS relative_floor)),
kept AS (SELECT c.k, c.threshold, c.relative_floor, g.query_id, g.answerable, g.n_gold, t.chunk_id, t.ql = t.cl AS hit, row_number() OVER (PARTITION BY c.k, c.threshold, c.relative_floor, g.query_id ORDER BY t.rank NULLS LAST) AS pos
  FROM cells c CROSS JOIN g JOIN mx USING (query_id) LEFT JOIN top t ON t.query_id = g.query_id AND t.rank < c.k AND t.score >= c.threshold AND t.score >= c.relative_floor * mx.top),
per AS (SELECT k, threshold, relative_floor, query_id, answerable, n_gold, count(chunk_id) AS n, count(*) FILTER (WHERE hit) AS hits, coalesce(sum(1 / log2(pos + 1)) FILTER (WHERE hit), 0) / list_sum(list_transform(range(1, least(n_gold, k) + 1), lambda i: 1 / log2(i + 1))) AS gain FROM kept GROUP BY k, threshold, relative_floor, query_id, answerable, n_gold)
SELECT k, threshold, relative_floor, round(avg(hits::DOUBLE / n_gold) FILTER (WHERE answerable), 6) AS recall, round(avg(hits::DOUBLE / greatest(n, 1)) FILTER (WHERE answerable), 6) AS precision, round(avg(gain) FILTER (WHERE answerable), 6) AS ndcg,
round(avg(n), 6) AS mean_k, round(avg((n = 0)::INT), 6) AS abstention_rate FROM per GROUP BY k, threshold, relative_floor"""

_CALIBRATE = _TOP.format(k=1) + """, t AS (SELECT query_id, score AS top_score, ql < 8 AS answerable FROM top),
c AS (SELECT i * 0.05 AS threshold, count(*) FILTER (WHERE top_score >= round(i * 0.05, 2)::DOUBLE AND answerable) AS tp, count(*) FILTER (WHERE top_score >= round(i * 0.05, 2)::DOUBLE AND NOT answerable) AS fp,
 count(*) FILTER (WHERE top_score < round(i * 0.05, 2)::DOUBLE AND answerable) AS fn, count(*) FILTER (WHERE top_score < round(i * 0.05, 2)::DOUBLE AND NOT answerable) AS tn FROM t, range(0, 20) r(i) GROUP BY i),
f AS (SELECT *, coalesce(round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 4), 0) AS f1 FROM c)
SELECT round(threshold, 6)::DOUBLE AS threshold, tp, fp, fn, tn, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM f"""

# text
_WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{000B}]"


def _strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{_WS}+', ''), '{_WS}+$', '')"


def _normal(t: str) -> str:
    t = rf"regexp_replace(nfc_normalize({t}), '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}\x{{FEFF}}\x{{00AD}}\x{{200B}}\x{{2060}}]', '', 'g')"
    t = f"replace(replace({t}, '||', '॥'), '|', '।')"
    t = rf"regexp_replace({t}, '[\t\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}} ]+', ' ', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(t)


def _toks(t: str, numerals: bool = True) -> str:
    raw = rf"regexp_extract_all(nfc_normalize({t}), '[\x{{0C80}}-\x{{0CFF}}\x{{200C}}\x{{200D}}]+|[A-Za-z]+|[0-9\x{{0CE6}}-\x{{0CEF}}]+')"
    out = f"list_filter(list_transform({raw}, lambda t: replace(replace(lower(t), chr(8204), ''), chr(8205), '')), lambda t: t <> '')"
    return out if numerals else rf"list_filter({out}, lambda t: NOT regexp_full_match(t, '[0-9\x{{0CE6}}-\x{{0CEF}}]+'))"


def _sents(t: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({_normal(t)}, '([।॥.!?]){_WS}+', '\1' || chr(30), 'g'), chr(30)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _ratio(t: str) -> str:
    ink = f"length(regexp_replace({t}, '{_WS}', '', 'g'))"
    return rf"CASE WHEN {ink} = 0 THEN 0 ELSE length(regexp_replace({t}, '[^\x{{0C80}}-\x{{0CFF}}]', '', 'g'))::DOUBLE / {ink} END"


_GRAMS = "CASE WHEN length(j) = 0 THEN [] WHEN length(j) < {n} THEN [j] ELSE list_transform(range(1, length(j) - {n} + 2), lambda i: substr(j, i, {n})) END"

# pairs of an answer and each reference of its question
_REFS = "q AS (SELECT question_id, list_sort(list_distinct(list_filter(flatten(list(reference_texts)), lambda x: x IS NOT NULL))) AS refs FROM questions WHERE len(reference_texts) > 0 GROUP BY question_id)"
_PAIRS = f"""{_REFS}, e AS (SELECT seq, answer, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS ref_no FROM answers JOIN q USING (question_id) WHERE answer IS NOT NULL),
p AS (SELECT seq, ref_no::INT AS ref_no, answer, ref, {_toks('answer')} AS h, {_toks('ref')} AS r FROM e)"""
_PRF = "SELECT seq, ref_no, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM s"


def _met(sides: str, keys: str) -> str:
    """CTEs x, y, m over g(keys, a, b): how many items the lists a and b share as multisets."""
    return f"""x AS (SELECT {keys}, t, count(*) AS c FROM (SELECT {keys}, unnest(a) AS t FROM {sides}) GROUP BY ALL), y AS (SELECT {keys}, t, count(*) AS c FROM (SELECT {keys}, unnest(b) AS t FROM {sides}) GROUP BY ALL),
m AS (SELECT {keys}, sum(least(x.c, y.c)) AS m FROM x JOIN y USING ({keys}, t) GROUP BY ALL)"""


def _rouge(n: int) -> str:
    grams = lambda c: f"list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n - 1}], chr(31)))"
    return f"""WITH {_PAIRS}, g AS (SELECT seq, ref_no, {grams('h')} AS a, {grams('r')} AS b FROM p), {_met('g', 'seq, ref_no')},
s AS (SELECT seq, ref_no, coalesce(m, 0)::DOUBLE / greatest(len(a), 1) AS precision, coalesce(m, 0)::DOUBLE / greatest(len(b), 1) AS recall FROM g LEFT JOIN m USING (seq, ref_no)) {_PRF}"""


# A row of the table of common subsequences from the row before (o) and what matches in it (m); both are lists as long as the reference.
_LCS = "list_reduce(list_transform(h, lambda x: list_transform(r, lambda y: (x = y)::INT)), lambda o, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(o[i], CASE WHEN m[i] = 1 THEN coalesce(o[i - 1], 0) + 1 ELSE 0 END)))), list_transform(r, lambda y: 0))"
_ROUGE_L = f"""WITH {_PAIRS}, d AS (SELECT DISTINCT h, r FROM p), l AS (SELECT h, r, CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0 ELSE list_last({_LCS}) END AS m FROM d),
s AS (SELECT seq, ref_no, m::DOUBLE / greatest(len(h), 1) AS precision, m::DOUBLE / greatest(len(r), 1) AS recall FROM p JOIN l USING (h, r))"""


def _meteor(keys: str = "seq, ref_no") -> str:
    return f"""WITH {_PAIRS},
h AS (SELECT {keys}, tok, pos, row_number() OVER (PARTITION BY {keys}, tok ORDER BY pos) AS k FROM (SELECT {keys}, unnest(h) AS tok, generate_subscripts(h, 1) AS pos FROM p)),
r AS (SELECT {keys}, tok, pos, row_number() OVER (PARTITION BY {keys}, tok ORDER BY pos) AS k FROM (SELECT {keys}, unnest(r) AS tok, generate_subscripts(r, 1) AS pos FROM p)),
a AS (SELECT {keys}, h.pos AS hp, r.pos AS rp FROM h JOIN r USING ({keys}, tok, k)),
b AS (SELECT {keys}, CASE WHEN hp - lag(hp) OVER w = 1 AND rp - lag(rp) OVER w = 1 THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY {keys} ORDER BY hp)),
c AS (SELECT {keys}, count(*) AS matches, sum(fresh)::BIGINT AS chunks FROM b GROUP BY ALL),
d AS (SELECT p.*, coalesce(matches, 0) AS matches, coalesce(chunks, 0) AS chunks, coalesce(matches, 0)::DOUBLE / greatest(len(h), 1) AS pr, coalesce(matches, 0)::DOUBLE / greatest(len(r), 1) AS re FROM p LEFT JOIN c USING ({keys})),
me AS (SELECT *, coalesce(pr * re / nullif(0.9 * pr + 0.1 * re, 0), 0) AS f_mean, 0.5 * power(coalesce(chunks::DOUBLE / nullif(matches, 0), 0), 3) AS penalty FROM d)"""


_METEOR = _meteor() + " SELECT seq, ref_no, matches, chunks, round(f_mean * (1 - penalty), 6) AS meteor FROM me"


def _chrf_ctes() -> str:
    parts = " UNION ALL ".join(f"SELECT seq, ref_no, {k} AS o, {_GRAMS.format(n=k).replace('j', 'hj')} AS a, {_GRAMS.format(n=k).replace('j', 'rj')} AS b FROM z" for k in range(1, 7))
    return f"""z AS (SELECT seq, ref_no, array_to_string(h, '') AS hj, array_to_string(r, '') AS rj FROM p), cg AS ({parts}),
cx AS (SELECT seq, ref_no, o, t, count(*) AS c FROM (SELECT seq, ref_no, o, unnest(a) AS t FROM cg) GROUP BY ALL), cy AS (SELECT seq, ref_no, o, t, count(*) AS c FROM (SELECT seq, ref_no, o, unnest(b) AS t FROM cg) GROUP BY ALL),
cm AS (SELECT seq, ref_no, o, sum(least(cx.c, cy.c)) AS m FROM cx JOIN cy USING (seq, ref_no, o, t) GROUP BY ALL),
cs AS (SELECT seq, ref_no, avg(coalesce(m, 0)::DOUBLE / len(a)) FILTER (WHERE len(a) > 0 AND len(b) > 0) AS p, avg(coalesce(m, 0)::DOUBLE / len(b)) FILTER (WHERE len(a) > 0 AND len(b) > 0) AS r FROM cg LEFT JOIN cm USING (seq, ref_no, o) GROUP BY ALL),
ch AS (SELECT seq, ref_no, coalesce(5 * p * r / nullif(4 * p + r, 0), 0) AS chrf FROM cs)"""


def _chrf() -> str:
    return f"WITH {_PAIRS}, {_chrf_ctes()} SELECT seq, ref_no, round(chrf, 6) AS chrf FROM ch"


_CONTAIN = f"""WITH {_PAIRS}, z AS (SELECT seq, ref_no, array_to_string(h, '') AS hj, array_to_string(r, '') AS rj FROM p), g AS (SELECT seq, ref_no, {_GRAMS.format(n=4).replace('j', 'hj')} AS a, {_GRAMS.format(n=4).replace('j', 'rj')} AS b FROM z),
{_met('g', 'seq, ref_no')} SELECT seq, ref_no, round(coalesce(m, 0)::DOUBLE / greatest(len(a), 1), 6) AS containment FROM g LEFT JOIN m USING (seq, ref_no)"""


def _support() -> str:
    own = _toks("t").replace("nfc_normalize(t)", "t", 1)
    return f"""WITH {_PAIRS}, st AS (SELECT seq, ref_no, array_to_string(r, '') AS rj, {_sents('answer')} AS l FROM p), si AS (SELECT seq, ref_no, rj, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM st),
sj AS (SELECT seq, ref_no, i, rj, array_to_string({own}, '') AS hj FROM si), g AS (SELECT seq, ref_no, i, {_GRAMS.format(n=4).replace('j', 'hj')} AS a, {_GRAMS.format(n=4).replace('j', 'rj')} AS b FROM sj),
{_met('g', 'seq, ref_no, i')}, v AS (SELECT seq, ref_no, coalesce(m, 0)::DOUBLE / greatest(len(a), 1) AS v FROM g LEFT JOIN m USING (seq, ref_no, i))
SELECT seq, ref_no, round(coalesce(avg(v), 0), 6) AS support_mean, round(coalesce(min(v), 0), 6) AS support_min, count(v)::DOUBLE AS n_sentences, (count(*) FILTER (WHERE v < 0.5))::DOUBLE AS n_unsupported_sentences FROM p LEFT JOIN v USING (seq, ref_no) GROUP BY seq, ref_no"""


def _best() -> str:
    two = lambda c: f"list_transform(range(1, len({c})), lambda i: array_to_string({c}[i:i + 1], chr(31)))"
    prf = lambda m, k="": f"coalesce({m}, 0)::DOUBLE / greatest(len(h) - {k or 0}, 1) AS p, coalesce({m}, 0)::DOUBLE / greatest(len(r) - {k or 0}, 1) AS r"
    f1 = "coalesce(2 * @p * @r / nullif(@p + @r, 0), 0)"
    met = lambda n, sides: _met(sides, "seq, ref_no").replace("x AS", f"x{n} AS").replace("y AS", f"y{n} AS").replace("m AS", f"m{n} AS", 1).replace("FROM x JOIN y", f"FROM x{n} x JOIN y{n} y").replace("sum(least", "sum(least")
    l = f"ld AS (SELECT DISTINCT h, r FROM p), ll AS (SELECT h, r, CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0 ELSE list_last({_LCS}) END AS m FROM ld)"
    return f"""{_meteor()}, {_chrf_ctes()}, {l}, g1 AS (SELECT seq, ref_no, h AS a, r AS b FROM p), {met(1, 'g1')}, g2 AS (SELECT seq, ref_no, {two('h')} AS a, {two('r')} AS b FROM p), {met(2, 'g2')},
s1 AS (SELECT seq, ref_no, {prf('m')} FROM p LEFT JOIN m1 USING (seq, ref_no)), s2 AS (SELECT seq, ref_no, {prf('m', 1)} FROM p LEFT JOIN m2 USING (seq, ref_no)), sl AS (SELECT seq, ref_no, {prf('m')} FROM p JOIN ll USING (h, r)),
al AS (SELECT me.seq, f_mean * (1 - penalty) AS meteor, f_mean, penalty, chunks, len(h) AS nh, len(me.r) AS nr, chrf, {f1.replace('@', 's1.')} AS f1, s1.p AS p1, s1.r AS r1, {f1.replace('@', 's2.')} AS f2, {f1.replace('@', 'sl.')} AS fl, sl.p AS pl, sl.r AS rl FROM me JOIN ch USING (seq, ref_no) JOIN s1 USING (seq, ref_no) JOIN s2 USING (seq, ref_no) JOIN sl USING (seq, ref_no))
SELECT seq, round(max(f1), 6) AS rouge1_f1, round(max(p1), 6) AS rouge1_precision, round(max(r1), 6) AS rouge1_recall, round(max(f2), 6) AS rouge2_f1, round(max(fl), 6) AS "rougeL_f1", round(max(pl), 6) AS "rougeL_precision", round(max(rl), 6) AS "rougeL_recall",
round(max(meteor), 6) AS meteor, round(max(f_mean), 6) AS meteor_f_mean, round(max(penalty), 6) AS meteor_penalty, max(chunks)::DOUBLE AS meteor_chunks, round(max(chrf), 6) AS chrf, max(nh)::DOUBLE AS hyp_tokens, max(nr)::DOUBLE AS ref_tokens, count(*)::DOUBLE AS n_references FROM al GROUP BY seq"""


# pages
_LAST = "lp AS (SELECT * FROM page_records WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_file, page ORDER BY page_key DESC) = 1)"
_FIXED = f"""WITH {_LAST}, n AS (SELECT source_file, page, text, unnest(range(0, ceil(length(text) / 500.0)::BIGINT)) AS i FROM lp WHERE length({_strip('text')}) > 0),
r AS (SELECT source_file, page, i, substr(text, i * 500 + 1, 500) AS piece FROM n),
o AS (SELECT *, coalesce(right(lag(piece) OVER w, 50), '') || piece AS t FROM r WINDOW w AS (PARTITION BY source_file, page ORDER BY i))
SELECT source_file || '#p' || page || '#c' || i AS chunk_id, coalesce(sum(greatest(length(t) - 50, 1)) OVER (PARTITION BY source_file, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS char_start, length(t)::INT AS char_len, md5(t) AS digest FROM o"""


def _length_stats() -> str:
    def of(c: str) -> str:
        s = f"list_sort(list({c}))"
        return f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_stdev, min({c})::INT AS {c}_min, max({c})::INT AS {c}_max, {s}[(count(*) // 2) + 1]::INT AS {c}_median, {s}[floor(0.25 * (count(*) - 1))::BIGINT + 1]::INT AS {c}_p25, {s}[floor(0.75 * (count(*) - 1))::BIGINT + 1]::INT AS {c}_p75"

    return f"WITH c AS (SELECT length(text) AS chars, len({_toks('text')}) AS toks, used_ocr FROM chunks WHERE text IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (WHERE used_ocr) AS n_ocr, {of('chars')}, {of('toks')} FROM c"


# the record log
def _value(m: str) -> str:
    return f"CASE WHEN isnan({m}) THEN NULL ELSE {m} END"


def _means(metrics: tuple[str, ...], by: str, where: str) -> str:
    inner = ", ".join(f"avg({_value(m)}) AS {m}" for m in metrics)
    outer = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics)
    group = f"{by}, " if by else ""
    return f"SELECT {group}count(*) AS n, {outer} FROM (SELECT {group}question_id, {inner} FROM answers WHERE {where} GROUP BY {group}question_id)" + (f" GROUP BY {by}" if by else "")


_ANSWER = "coalesce(answer, '')"
_M3 = ("rouge1_f1", "meteor", "chrf")
_TOPK = ("top_score", "k_effective")


def _tiers() -> str:
    m = _means(tuple(c for c in ("top_score", "k_effective")), "difficulty", "use_retrieval").replace("isnan(k_effective)", "isnan(k_effective::DOUBLE)")
    t = _means(tuple(c for c in ("top_score", "k_effective")), "", "use_retrieval AND answerable").replace("isnan(k_effective)", "isnan(k_effective::DOUBLE)")
    return f"SELECT difficulty, n, top_score, k_effective, list_position(['easy', 'medium', 'hard', 'unanswerable'], difficulty)::INT AS position FROM ({m}) WHERE difficulty IN ('easy', 'medium', 'hard', 'unanswerable') UNION ALL SELECT 'all (answerable)', n, top_score, k_effective, 5 FROM ({t}) WHERE n > 0"


_QM = "SELECT model, use_retrieval, question_id, avg(chrf) AS value FROM answers WHERE answerable AND chrf IS NOT NULL AND NOT isnan(chrf) GROUP BY ALL"
_EFFECT = "CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END"
_SHARED = f"m AS (SELECT model, question_id, value FROM ({_QM}) WHERE use_retrieval), sh AS (SELECT question_id FROM m GROUP BY question_id HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM m)), mp AS (SELECT x.model AS name_a, y.model AS name_b, question_id, x.value AS a, y.value AS b FROM m x JOIN m y USING (question_id) JOIN sh USING (question_id) WHERE x.model < y.model)"
_RAG = f"rp AS (SELECT model, question_id, max(value) FILTER (WHERE use_retrieval) AS a, max(value) FILTER (WHERE NOT use_retrieval) AS b FROM ({_QM}) GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"
_JUDGED = "j AS (SELECT * FROM (SELECT question_id, condition_id, claim_index, regexp_replace(regexp_replace(lower(verdict), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS verdict FROM claim_judgements) WHERE verdict IN ('supported', 'contradicted', 'not_in_context', 'unverifiable'))"
_TRANS = """tp AS (SELECT source_file, page, list_sort(list(DISTINCT lpad(char_start::VARCHAR, 10, '0') || text) FILTER (WHERE text IS NOT NULL)) AS pieces FROM chunks WHERE used_ocr GROUP BY ALL),
tc AS (SELECT source_file, page, list_reduce(pieces, lambda t, x: t || repeat(' ', greatest(substr(x, 1, 10)::INT - length(t), 0)) || substr(x, 11 + greatest(length(t) - substr(x, 1, 10)::INT, 0)), '') AS transcription FROM tp),
tr AS (SELECT * FROM tc UNION ALL SELECT source_file || '.missing', page, transcription FROM tc)"""
# Edit distance of the lists h and r: a row of its table from the row before (o, whose first entry is the first column's) and what matches (m).
_EDITS = "list_last(list_reduce(list_transform(h, lambda x: list_transform(r, lambda y: (x <> y)::INT)), lambda o, m: list_transform(range(0, len(m) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda i: (CASE WHEN i = 0 THEN o[1] + 1 ELSE least(o[i + 1] + 1, o[i] + m[i]) END) + j - i))), range(0, len(r) + 1)::INT[]))"
_NG = "len(coalesce({c}, [])) < 1"


def _q(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _prompt_sql() -> str:
    def filled(template: str) -> str:
        out, rest = [], template.replace("{n_sentences}", "2-3")
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            out += [_q(before), name]
        return " || ".join([*out, _q(rest)])

    return f"""WITH c AS (SELECT chunk_id, min(source_file) AS file, min(page) AS page, min(text) AS text FROM chunks GROUP BY chunk_id),
q AS (SELECT question_id, min(question) AS question, min(gold_chunk_ids) AS gold FROM questions GROUP BY question_id HAVING min(question) IS NOT NULL),
it AS (SELECT question_id, i, file, page, text, row_number() OVER (PARTITION BY question_id ORDER BY i) AS k FROM (SELECT question_id, unnest(gold) AS chunk_id, generate_subscripts(gold, 1) AS i FROM q) JOIN c USING (chunk_id)),
cx AS (SELECT question_id, string_agg('[' || k || '] (' || file || ' p.' || page || ') ' || text, chr(10) || chr(10) ORDER BY i) AS context FROM it GROUP BY question_id),
pr AS (SELECT question_id, CASE WHEN context IS NULL THEN {filled(prompts.UNGROUNDED)} ELSE {filled(prompts.GROUNDED)} END AS prompt FROM q LEFT JOIN cx USING (question_id))"""


_FIRST = f"fa AS (SELECT * FROM answers WHERE length({_strip('answer')}) > 0 QUALIFY row_number() OVER (PARTITION BY question_id, condition_id ORDER BY seq) = 1)"

_LOG = "SELECT seq, question_id, condition_id AS condition, repeat_no AS repeat, status, md5(answer) AS digest, round(CASE WHEN NOT isnan(chrf) THEN chrf END, 6) AS chrf FROM answers"


def _reconciled(tier: str) -> str:
    tiers = ("easy", "medium", "hard", "unanswerable")
    parts = []
    for m in _M3:
        means = ", ".join(f"avg({_value(m)}) FILTER (WHERE t = '{t}') AS {t}" for t in tiers)
        parts.append(f"SELECT model, '{m}' AS metric, sum(list_sum(l)) / sum(len(l)) AS w, avg(o) AS o FROM (SELECT model, o, list_filter([{', '.join(tiers)}], lambda x: x IS NOT NULL) AS l FROM (SELECT model, question_id, avg({_value(m)}) FILTER (WHERE answerable) AS o, {means} FROM (SELECT *, {tier} AS t FROM answers WHERE use_retrieval) GROUP BY ALL) WHERE o IS NOT NULL) GROUP BY model HAVING sum(len(l)) > 0")
    return f"SELECT model, metric, round(w, 6) AS weighted, round(o, 6) AS overall FROM ({' UNION ALL '.join(parts)})"


def _rendered() -> str:
    metrics = ", ".join(f"CASE WHEN {m} IS NULL THEN '--' ELSE printf('%.3f', {m}) END" for m in _M3)
    inner = ", ".join(f"avg({_value(m)}) AS {m}" for m in _M3)
    rows = f"SELECT row_number() OVER (ORDER BY model) AS i, [model, n::VARCHAR, {metrics}] AS l FROM (SELECT model, count(*) AS n, " + ", ".join(f"avg({m}) AS {m}" for m in _M3) + f" FROM (SELECT model, question_id, {inner} FROM answers WHERE answerable AND use_retrieval GROUP BY ALL) GROUP BY model)"
    names = ["model", "n", *_M3]
    md = ["**Quality**", "", "| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    tex = ["\\begin{table}[t]", "\\centering", "\\caption{Quality}", "\\label{tab:q}", "\\begin{tabular}{lcccc}", "\\hline", " & ".join(names) + " \\\\", "\\hline"]
    foot = ["\\hline", "\\end{tabular}", "\\footnotesize{A note}", "\\end{table}"]
    fixed = lambda kind, lines, at: " UNION ALL ".join(f"SELECT '{kind}' AS kind, {at} + {i} AS line_no, {_q(x)} AS line" for i, x in enumerate(lines))
    n = "(SELECT count(*) FROM r)"
    return f"""WITH r AS ({rows}) SELECT kind, line_no::INT AS line_no, line FROM ({fixed('markdown', md, 0)} UNION ALL SELECT 'markdown', 3 + i, '| ' || array_to_string(l, ' | ') || ' |' FROM r UNION ALL {fixed('markdown', ['', '_A note_'], f'4 + {n}')}
UNION ALL {fixed('latex', tex, 0)} UNION ALL SELECT 'latex', 7 + i, array_to_string(l, ' & ') || ' \\\\' FROM r UNION ALL {fixed('latex', foot, f'8 + {n}')})"""


_COUNTS = lambda c: "[" + ", ".join(f"(length({c}) - length(replace({c}, '{x}', '')))::DOUBLE" for x in LETTERS) + "]"
_ASK = f"""WITH c AS (SELECT chunk_id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id), cv AS (SELECT chunk_id, {_UNIT.replace('embedding', 'e')} AS u FROM (SELECT chunk_id, {_COUNTS('text')} AS e FROM c)),
q AS (SELECT query_id::VARCHAR AS question_id, raw_query, {_normal('raw_query')} AS nq FROM retrieval_results WHERE query_id % 50 = 0 AND raw_query IS NOT NULL),
g AS (SELECT *, ({_ratio('raw_query')}) >= 0.5 AS ok FROM q), qv AS (SELECT question_id, {_UNIT.replace('embedding', 'e')} AS u FROM (SELECT question_id, {_COUNTS('nq')} AS e FROM g WHERE ok)),
r AS (SELECT question_id, list_dot_product(qv.u, cv.u) AS score, row_number() OVER (PARTITION BY question_id ORDER BY list_dot_product(qv.u, cv.u) DESC) AS k FROM qv, cv), t AS (SELECT *, max(score) OVER (PARTITION BY question_id) AS top FROM r WHERE k <= 5),
n AS (SELECT question_id, max(top) AS top, count(*) FILTER (WHERE score >= 0.8 AND score >= 0.85 * top)::INT AS n FROM t GROUP BY question_id)
SELECT question_id, CASE WHEN NOT ok THEN 'rejected_language' WHEN n = 0 THEN 'abstained' ELSE 'ok' END AS status, round(top, 6) AS top_score, n AS k_effective FROM g LEFT JOIN n USING (question_id)"""

ORACLE = {
    "cosine_topk": _TOP.format(k=5) + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top",
    "cosine_topk_blocked": _TOP.format(k=5) + " SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM top",
    "l2_normalise": f"WITH v AS (SELECT vec_id, {_UNIT.replace('embedding', 'e')} AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)) SELECT vec_id, len(u)::INT AS n, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * i)), 6) AS weighed, round(sqrt(list_dot_product(u, u)), 6) AS norm FROM v",
    "adaptive_select": _MARKED + " SELECT query_id, chunk_id, rank, selected FROM s",
    "abstain_status": _MARKED + " SELECT query_id, round(max(score), 6) AS top_score, count(*) FILTER (WHERE selected)::INT AS k_effective, count(*) FILTER (WHERE selected) = 0 AS abstained, CASE WHEN count(*) FILTER (WHERE selected) = 0 THEN 'below_similarity_threshold' END AS abstain_reason FROM s GROUP BY query_id",
    "retrieval_metrics_multi_k": _multi_k(),
    "grid_sweep": _GRID,
    "calibrate_threshold": _CALIBRATE,
    "script_ratio_guard": f"SELECT page_key, round({_ratio('text')}, 6) AS ratio, ({_ratio('text')}) >= 0.5 AS ok FROM page_records",
    "normalise_text": f"SELECT page_key, md5({_normal('text')}) AS digest FROM page_records",
    "metric_tokens": f"SELECT seq, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT seq, {_toks('answer')} AS t FROM answers WHERE answer IS NOT NULL)",
    "metric_tokens_without_numerals": f"SELECT seq, md5(array_to_string({_toks('answer', False)}, ' ')) AS digest FROM answers WHERE answer IS NOT NULL",
    "char_ngrams": f"SELECT seq, len(g)::INT AS n, md5(array_to_string(g, ' ')) AS digest FROM (SELECT seq, {_GRAMS.format(n=4)} AS g FROM (SELECT seq, array_to_string({_toks('answer')}, '') AS j FROM answers WHERE answer IS NOT NULL))",
    "sentence_split": f"SELECT seq, len(s)::INT AS n, md5(array_to_string(s, chr(31))) AS digest FROM (SELECT seq, {_sents('answer')} AS s FROM answers WHERE answer IS NOT NULL)",
    "excerpt_and_citation": "SELECT DISTINCT chunk_id, md5(CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END) AS digest, source_file || ' p.' || page AS citation FROM chunks",
    "ocr_choice": f"""WITH p AS (SELECT page_key, {_strip("substr(text, 1, native_chars)")} AS n, {_strip("CASE WHEN ocr_chars > 0 THEN text END")} AS o FROM page_records WHERE text IS NOT NULL),
q AS (SELECT *, length(n) < 50 AS tried, length(n) < 50 AND o IS NOT NULL AND length(o) > length(n) AS used FROM p)
SELECT page_key, used AS used_ocr, tried AS ocr_attempted, tried AND NOT used AS ocr_rejected, length(n)::INT AS native_chars, CASE WHEN tried THEN coalesce(length(o), 0) ELSE 0 END::INT AS ocr_chars, md5(CASE WHEN used THEN o ELSE n END) AS digest FROM q""",
    "ingest_summary": "SELECT count(*) AS n_pages, count(*) FILTER (WHERE used_ocr) AS n_ocr_pages, count(*) FILTER (WHERE ocr_attempted) AS n_ocr_attempted, count(*) FILTER (WHERE ocr_rejected) AS n_ocr_rejected, round(count(*) FILTER (WHERE used_ocr)::DOUBLE / count(*), 6) AS ocr_page_fraction, count(*) FILTER (WHERE coalesce(length(trim(text)), 0) = 0) AS n_empty_pages, coalesce(sum(length(text)), 0)::BIGINT AS total_chars, round(avg(length(coalesce(text, ''))), 6) AS mean_chars, round(avg(kannada_ratio), 6) AS mean_ratio FROM page_records",
    "last_page_wins": f"WITH {_LAST} SELECT source_file, page, page_key FROM lp",
    "chunk_fixed": _FIXED,
    "chunk_length_stats": _length_stats(),
    "rouge_1": _rouge(1),
    "rouge_2": _rouge(2),
    "meteor_exact": _METEOR,
    "meteor_batched": _METEOR,
    "chrf": _chrf(),
    "ngram_containment": _CONTAIN,
    "log_filter_values": "SELECT question_id, round(chrf, 6) AS chrf FROM answers WHERE difficulty = 'hard' AND is_local IS NULL AND chrf IS NOT NULL AND NOT isnan(chrf)",
    "question_means": "SELECT model, question_id, round(avg(chrf), 6) AS value FROM answers WHERE use_retrieval AND chrf IS NOT NULL AND NOT isnan(chrf) GROUP BY ALL",
    "quality_overall": _means(_M3, "model", "answerable AND use_retrieval"),
    "quality_by_tier": _means(_M3, "model", "difficulty = 'medium' AND use_retrieval"),
    "retrieval_table": _tiers(),
    "latency_table": f"WITH a AS (SELECT *, retrieval_latency_s + generation_latency_s AS total_latency_s, len({_toks(_ANSWER)})::DOUBLE AS hyp_tokens FROM answers WHERE use_retrieval) SELECT model, CASE WHEN coalesce(arg_min(coalesce(is_local, false), seq), false) THEN 'local' ELSE 'hosted API' END AS deployment, count(*) AS n, " + ", ".join(f"round(avg({_value(c)}), 6) AS {c}" for c in ("retrieval_latency_s", "generation_latency_s", "total_latency_s", "hyp_tokens")) + " FROM a GROUP BY model",
    "consistency_gate": _reconciled("CASE WHEN difficulty = 'hard' THEN 'bonus' ELSE difficulty END") + " WHERE abs(w - o) > 1e-9",
    "version_problems": "SELECT array_to_string(list_sort(list(DISTINCT reference_version) FILTER (WHERE reference_version IS NOT NULL)), ',') AS versions, count(*) FILTER (WHERE reference_version IS NULL) AS missing FROM answers WHERE answerable HAVING count(DISTINCT reference_version) > 1 OR count(*) FILTER (WHERE reference_version IS NULL) > 0",
    "distinct_conditions": "SELECT DISTINCT condition_id AS condition FROM answers",
    "rag_pairs": f"WITH {_RAG} SELECT model, question_id, round(a, 6) AS a, round(b, 6) AS b FROM rp",
    "model_pairs_shared": f"WITH {_SHARED} SELECT name_a, name_b, question_id, round(a, 6) AS a, round(b, 6) AS b FROM mp",
    "cliffs_delta": f"WITH {_RAG}, d AS (SELECT x.model, avg(sign(x.a - y.b)) AS delta FROM rp x JOIN rp y USING (model) GROUP BY x.model) SELECT model, round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM d",
    "holm_adjustment": "WITH q AS (SELECT condition_id AS condition, question_id, avg(chrf) FILTER (WHERE NOT isnan(chrf)) AS v FROM answers GROUP BY ALL), p AS (SELECT condition, round(avg(v) / 17, 6) AS p FROM q GROUP BY condition HAVING avg(v) IS NOT NULL), s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, condition) + 1) * p) AS sc FROM p), a AS (SELECT condition, p, max(sc) OVER (ORDER BY p, condition ROWS UNBOUNDED PRECEDING) AS adj FROM s) SELECT condition, p, round(adj, 6) AS p_adjusted, adj <= 0.05 AS significant FROM a",
    "paired_statistics": f"WITH {_RAG}, r AS (SELECT model, round(round(a, 6) - round(b, 6), 6) AS d FROM rp), k AS (SELECT *, (rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0)::DOUBLE AS rank FROM r WHERE d <> 0), w AS (SELECT model, count(*) AS n, round(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), 6) AS w_plus FROM k GROUP BY model), t AS (SELECT model, round(avg(d) * sqrt(count(*)) / nullif(stddev_samp(d), 0), 4) AS t FROM r GROUP BY model) SELECT model, coalesce(n, 0) AS n, coalesce(w_plus, 0) AS w_plus, t FROM t LEFT JOIN w USING (model)",
    "sample_sizes": "WITH z AS (SELECT 1.959963984540054 AS z), n AS (SELECT config_id, chunk_size, z * z * 0.12 * 0.88 / 0.0009 AS n0 FROM pipeline_configs, z) SELECT config_id, ceil(n0)::INT AS plain, greatest(1, ceil(n0 / (1 + (n0 - 1) / chunk_size)))::INT AS finite, ceil(power(([1.959963984540054, 2.241402727604945, 2.393979800338395, 2.497705474413083, 2.575829303548901, 2.638257273476751][config_id] + 0.8416212335729143) * 0.12 / 0.05, 2))::INT AS paired FROM n",
    "abstention_scores": """WITH r AS (SELECT model, coalesce(answerable, true) AS can, coalesce(status = 'abstained', false) AS gone FROM answers),
c AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE NOT can AND gone) AS correct_abstentions, count(*) FILTER (WHERE NOT can AND NOT gone) AS missed_abstentions, count(*) FILTER (WHERE can AND gone) AS false_abstentions, count(*) FILTER (WHERE can AND NOT gone) AS answered FROM r GROUP BY model)
SELECT *, CASE WHEN correct_abstentions + missed_abstentions > 0 THEN round(correct_abstentions::DOUBLE / (correct_abstentions + missed_abstentions), 6) ELSE 'nan'::DOUBLE END AS abstention_recall, CASE WHEN false_abstentions + answered > 0 THEN round(false_abstentions::DOUBLE / (false_abstentions + answered), 6) ELSE 'nan'::DOUBLE END AS false_abstention_rate FROM c""",
    "human_judgement_rates": f"WITH {_JUDGED} SELECT condition_id, count(*) AS n, " + ", ".join(f"round(avg((verdict = '{v}')::INT), 6) AS {v}_rate" for v in ("supported", "contradicted", "not_in_context", "unverifiable")) + ", round(avg((verdict IN ('contradicted', 'not_in_context'))::INT), 6) AS hallucination_rate FROM j GROUP BY condition_id",
    "verdict_problems": "SELECT judgement_id, verdict FROM claim_judgements WHERE verdict IS NULL OR verdict NOT IN ('supported', 'contradicted', 'not_in_context', 'unverifiable')",
    "nominal_alpha": f"""WITH {_JUDGED}, c AS (SELECT question_id, condition_id, claim_index, verdict, count(*) AS c FROM j GROUP BY ALL), u AS (SELECT question_id, condition_id, claim_index, sum(c) AS m, sum(c * (c - 1)) AS same FROM c GROUP BY ALL HAVING sum(c) > 1),
t AS (SELECT count(*) AS n_units, sum(m)::DOUBLE AS n, sum(same / (m - 1)) AS agree FROM u), v AS (SELECT sum(v * (v - 1)) AS pairs FROM (SELECT verdict, sum(c)::DOUBLE AS v FROM c JOIN u USING (question_id, condition_id, claim_index) GROUP BY verdict)), o AS (SELECT n_units, agree / n AS o, pairs / (n * (n - 1)) AS e FROM t, v)
SELECT n_units, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS alpha FROM o""",
    "transcription_join": f"WITH {_LAST}, {_TRANS} SELECT source_file, page, length(transcription)::INT AS ref_len, length(text)::INT AS hyp_len FROM tr JOIN lp USING (source_file, page)",
    "transcription_unmatched": f"WITH {_LAST}, {_TRANS} SELECT source_file, page FROM tr ANTI JOIN lp USING (source_file, page)",
    "benchmark_provenance": "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE difficulty = '{t}') AS n_{t}" for t in ("easy", "medium", "hard", "unanswerable")) + ", count(*) FILTER (WHERE answerable) AS n_answerable, round(avg(coalesce(author_independent, false)::INT), 6) AS independent_fraction, round(avg((len(coalesce(validated_by, [])) > 0)::INT), 6) AS validated_fraction, array_to_string(list_sort(list(DISTINCT reference_version) FILTER (WHERE reference_version IS NOT NULL)), ',') AS versions FROM questions",
    "benchmark_validate": f"SELECT question_id, 'duplicate id' AS problem FROM questions GROUP BY question_id HAVING count(*) > 1 UNION ALL SELECT question_id, 'answerable without gold' FROM questions WHERE answerable AND {_NG.format(c='gold_chunk_ids')} AND {_NG.format(c='gold_pages')} UNION ALL SELECT question_id, 'answerable without validator' FROM questions WHERE answerable AND {_NG.format(c='validated_by')} UNION ALL SELECT NULL, 'mixed reference versions' FROM (SELECT count(DISTINCT reference_version) AS n FROM questions) WHERE n > 1",
    "benchmark_constraints": f"WITH q AS (SELECT question_id, difficulty, answerable OR author IS NULL AS answerable, CASE WHEN reference_version IS NULL THEN [] ELSE reference_texts END AS refs FROM questions) SELECT question_id, 'answerable without reference' AS problem FROM q WHERE answerable AND {_NG.format(c='refs')} UNION ALL SELECT question_id, 'unanswerable tier marked answerable' FROM q WHERE difficulty = 'unanswerable' AND answerable",
    "gold_ids": "SELECT DISTINCT question_id, array_to_string(CASE WHEN len(gold_pages) > 0 AND source_file IS NOT NULL THEN list_transform(gold_pages, lambda p: source_file || '#p' || p) ELSE coalesce(gold_chunk_ids, []) END, ',') AS gold FROM questions",
    "gold_evidence_join": "SELECT question_id, count(*) AS n_found FROM (SELECT DISTINCT question_id, unnest(gold_chunk_ids) AS chunk_id FROM questions) WHERE chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY question_id",
    "status_routing": f"SELECT query_id, CASE WHEN ({_ratio('raw')}) < 0.5 THEN 'rejected_language' WHEN abstained THEN 'abstained' ELSE 'ok' END AS status FROM (SELECT *, coalesce(raw_query, '') AS raw FROM retrieval_results)",
    "build_prompt": _prompt_sql() + " SELECT question_id, md5(prompt) AS digest FROM pr",
    "echo_answer": _prompt_sql() + f" SELECT question_id, md5(CASE WHEN strpos(prompt, {_q(prompts.MARKER)}) = 0 THEN '' ELSE string_split({_strip(f'substr(prompt, strpos(prompt, {_q(prompts.MARKER)}) + {len(prompts.MARKER)})')}, chr(10) || chr(10))[1] END) AS digest FROM pr",
    "keep_first_answer": f"WITH {_FIRST} SELECT question_id, condition_id AS condition, seq FROM fa",
    "annotation_claims": f"WITH {_FIRST}, s AS (SELECT question_id, condition_id, question, {_sents('answer')} AS l FROM fa), c AS (SELECT question_id, condition_id, question, unnest(l) AS claim, generate_subscripts(l, 1) - 1 AS i FROM s) SELECT question_id, condition_id AS condition, i::INT AS claim_index, md5(claim) AS digest, CASE WHEN i = 0 THEN question ELSE {_q(annotation.POINTER)} END AS context FROM c",
    "shared_questions": "SELECT question_id FROM answers WHERE use_retrieval INTERSECT SELECT question_id FROM answers WHERE NOT use_retrieval",
    "union_of_conditions": "SELECT condition, count(*) AS n, count(status) AS n_status FROM (SELECT condition_id AS condition, status FROM answers UNION ALL SELECT condition_id, NULL FROM generation_outputs) GROUP BY condition",
    "rouge_l": f"{_ROUGE_L} {_PRF}",
    "support_score": _support(),
    "best_over_references": _best(),
    "external_scores": f"WITH {_REFS}, e AS (SELECT seq, length(answer)::DOUBLE AS h, length(unnest(refs))::DOUBLE AS r FROM answers JOIN q USING (question_id) WHERE answer IS NOT NULL) SELECT seq, round(max(least(h, r) / greatest(h, 1)), 6) AS bert_precision, round(max(least(h, r) / greatest(r, 1)), 6) AS bert_recall, round(max(2 * least(h, r) / greatest(h + r, 1)), 6) AS bert_f1 FROM e GROUP BY seq",
    "evidence_hits": _MARKED + " SELECT query_id, CASE WHEN bool_or(selected AND ql = cl) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS evidence_hit FROM s GROUP BY query_id",
    "retrieved_page_ids": _TOP.format(k=5) + " SELECT query_id, string_agg('f#p' || (chunk_id % 7), ',' ORDER BY rank) AS ids FROM top GROUP BY query_id",
    "quality_intervals": " UNION ALL ".join(f"SELECT model, '{m}' AS metric, round(avg(v), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS std, count(*) AS n FROM (SELECT model, question_id, avg({m}) AS v FROM answers WHERE answerable AND use_retrieval AND {_value(m)} IS NOT NULL GROUP BY ALL) GROUP BY model" for m in _M3),
    "consistency_reconciled": _reconciled("difficulty"),
    "paired_effects": f"WITH {_RAG}, d AS (SELECT x.model, avg(sign(x.a - y.b)) AS delta FROM rp x JOIN rp y USING (model) GROUP BY x.model), n AS (SELECT model, count(*) AS n_pairs, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_difference FROM rp GROUP BY model) SELECT model, n_pairs, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_difference, 6) AS mean_difference, round(delta, 6) AS cliffs_delta, {_EFFECT} AS effect_label FROM n JOIN d USING (model) WHERE n_pairs > 1",
    "pairwise_effects": f"WITH {_SHARED}, d AS (SELECT x.name_a, x.name_b, avg(sign(x.a - y.b)) AS delta FROM mp x JOIN mp y USING (name_a, name_b) GROUP BY ALL), n AS (SELECT name_a, name_b, count(*) AS n_pairs, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS mean_difference FROM mp GROUP BY ALL) SELECT name_a, name_b, n_pairs, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_difference, 6) AS mean_difference, round(delta, 6) AS cliffs_delta, {_EFFECT} AS effect_label FROM n JOIN d USING (name_a, name_b) WHERE n_pairs > 1",
    "power_analysis": f"WITH q AS ({_QM}), two AS (SELECT list_sort(list(DISTINCT model))[1:2] AS l FROM answers), p AS (SELECT question_id, max(value) FILTER (WHERE model = l[1]) AS a, max(value) FILTER (WHERE model = l[2]) AS b FROM q, two WHERE use_retrieval GROUP BY question_id), s AS (SELECT count(*) AS n, stddev_samp(a - b) AS sd FROM p WHERE a IS NOT NULL AND b IS NOT NULL) SELECT l[1] AS name_a, l[2] AS name_b, n, round(sd, 6) AS sd, ceil(power((1.959963984540054 + 0.8416212335729143) * sd / 0.05, 2))::INT AS pairs FROM s, two WHERE n > 2",
    "bootstrap_means": "SELECT model, round(avg(v), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS std, count(*) AS n FROM (SELECT model, question_id, avg(chrf) AS v FROM answers WHERE chrf IS NOT NULL AND NOT isnan(chrf) GROUP BY ALL) GROUP BY model",
    "word_error_rates": f"WITH {_LAST}, {_TRANS}, w AS (SELECT source_file, page, {_toks('text')} AS h, {_toks('transcription')} AS r FROM tr JOIN lp USING (source_file, page)) SELECT source_file, page, round(CASE WHEN len(r) = 0 THEN 'nan'::DOUBLE WHEN len(h) = 0 THEN 1 ELSE {_EDITS}::DOUBLE / len(r) END, 6) AS wer FROM w",
    "benchmark_selections": "SELECT question_id, 'hard' AS selection FROM questions WHERE difficulty = 'hard' UNION ALL SELECT question_id, 'answerable' FROM questions WHERE answerable",
    "grapheme_clusters": r"SELECT seq, length(regexp_replace(answer, '[\p{M}\x{200C}\x{200D}\x{0E33}]', '', 'g'))::INT AS n FROM answers WHERE answer IS NOT NULL",  # what isn't attached to a character before
    "ask_status": _ASK,
    "foreign_log": _LOG,
    "own_log": _LOG,
    "saved_index": "SELECT vec_id, label, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "annotation_sheet": f"WITH {_FIRST}, s AS (SELECT *, {_sents('answer')} AS l FROM fa), c AS (SELECT *, unnest(l) AS claim, generate_subscripts(l, 1) - 1 AS i FROM s) SELECT question_id, condition_id AS condition, i::INT AS claim_index, md5(claim) AS digest, md5(CASE WHEN i = 0 THEN '[1] (f p.' || repeat_no || ') ' || question ELSE {_q(annotation.POINTER)} END) AS context, 'f p.' || repeat_no AS citations FROM c",
    "ingest_report": "SELECT count(*) AS n_pages, count(*) FILTER (WHERE used_ocr) AS n_ocr_pages, count(*) FILTER (WHERE coalesce(length(trim(text)), 0) = 0) AS n_empty_pages, coalesce(sum(length(text)), 0)::BIGINT AS total_chars FROM page_records",
    "transcription_source": f"WITH {_TRANS} SELECT source_file, page, md5(transcription) AS digest, 'a' AS transcriber FROM tr",
    "nonempty_pages": f"SELECT page_key FROM page_records WHERE length({_strip('text')}) > 0",
    "rendered_tables": _rendered(),
    "recent_queries": "SELECT question FROM (SELECT trim(raw_query, ' ') AS question, max(logged_at) AS t FROM retrieval_results WHERE raw_query IS NOT NULL AND logged_at IS NOT NULL GROUP BY 1 ORDER BY t DESC, question LIMIT 40)",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
