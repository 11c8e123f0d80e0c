"""Queries of the operators and of the pipeline, with SQL where SQL can say the same."""

from __future__ import annotations

from tessera.llm import bayes_minhash, contextual_pii, hilbert_shards, line_quality, lpf_dedup, prefix_counts, quality_classifier, secret_ledger, soft_mixing, spelling_variants, tier_packing, token_alignment, vantage_search
from tessera.llm.common import stored, table


def op1_soft_mixing(spark, sf_dir):
    return soft_mixing.soft_rates(table(spark, sf_dir, "documents"), soft_mixing.domains(table(spark, sf_dir, "labels")))


def op2_hilbert_shards(spark, sf_dir):
    return hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op3_contextual_pii(spark, sf_dir):
    return contextual_pii.report(*contextual_pii.find(table(spark, sf_dir, "documents")))


def op4_lpf_dedup(spark, sf_dir):
    return lpf_dedup.report(table(spark, sf_dir, "documents"))


def op5_tier_packing(spark, sf_dir):
    return tier_packing.pack(table(spark, sf_dir, "documents"))


def op6_secret_ledger(spark, sf_dir):
    return secret_ledger.report(secret_ledger.update(table(spark, sf_dir, "documents")))


def op7_line_quality(spark, sf_dir):
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op8_bayes_minhash(spark, sf_dir):
    return bayes_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op9_vantage_search(spark, sf_dir):
    rows = stored(vantage_search.vectors(table(spark, sf_dir, "embeddings")), "op9-vectors")
    return vantage_search.search(rows, rows.where("id % 20 = 0"))


def op10_quality_rff(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_counts(spark, sf_dir):
    return prefix_counts.report(stored(prefix_counts.index(table(spark, sf_dir, "documents")), "op11-index"))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return token_alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_soft_mixing, op2_hilbert_shards, op3_contextual_pii, op4_lpf_dedup, op5_tier_packing, op6_secret_ledger, op7_line_quality, op8_bayes_minhash, op9_vantage_search, op10_quality_rff, op11_prefix_counts, op12_spelling_variants, op13_token_alignment)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')".replace("\\\\", "\\")
_SPAN = "SELECT doc_id, {n} AS kind_no, '{k}' AS kind, {least} AS least, unnest(list_zip(range(1, 1 + len(h)), g[:len(h)], h, o)) AS m FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), {p}) AS g, regexp_extract_all(coalesce(text, ''), {p}, 0) AS h, regexp_extract_all(coalesce(text, ''), {p}, {g}) AS o FROM documents)"
_ASSIGN = """'((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_HITS = " UNION ALL ".join(_SPAN.format(k=k, n=n, p=p, g=g, least=least) for n, (k, p, g, least) in enumerate((("assign", _ASSIGN.replace("\\\\", "\\"), 2, 6), ("access", "'AKIA[A-Z0-9]+'", 0, 20), ("hex", "'[0-9a-f]+'", 0, 24))))

_OP6 = f"""WITH hits AS ({_HITS}),
placed AS (SELECT doc_id, kind_no, kind, least, length(m[4]) AS n, length(m[3]) AS size, sum(length(m[2]) + length(m[3])) OVER (PARTITION BY doc_id, kind_no ORDER BY m[1]) AS e FROM hits),
told AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS a, count(*) FILTER (kind_no = 1) AS b, count(*) FILTER (kind_no = 2) AS c, string_agg(kind || ':' || CAST(e - size AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY e - size, kind_no) AS spans FROM placed WHERE n >= least GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN told USING (doc_id)"""

_OP7 = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM d, unnest(range(1, len(w) - 3)) t(i)), rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) t(k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, md5(text) AS h, unnest(l) AS x FROM d), nl AS (SELECT doc_id, host, h, length(x) AS n, regexp_replace(regexp_replace(lower(trim(x)), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS k FROM ln),
held AS (SELECT host, k, count(DISTINCT h) AS docs FROM nl GROUP BY ALL), alls AS (SELECT host, count(DISTINCT md5(text)) AS n FROM d GROUP BY host),
common AS (SELECT host, k FROM held JOIN alls USING (host) WHERE docs > {line_quality.LEAST_DOCS} AND docs > {line_quality.SHARE} * n),
lef AS (SELECT doc_id, 1 - coalesce(sum(n) FILTER (c.k IS NOT NULL), 0) / sum(n) AS r FROM nl LEFT JOIN common c USING (host, k) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(r, 1.0) AS left_share FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lef USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_share >= {line_quality.LEAST_LEFT} AS kept, left_share FROM f"""

_OP8 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 75 * (na.n + nb.n - n_both)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""

_OP9 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

# a checksum takes its text bit by bit: each byte comes with seven zeros behind it
_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, unicode(c) - 64, 0, 0, 0, 0, 0, 0, 0] END))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"

_OP12 = f"""WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00c0-\u00ff]+')) AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS k FROM t WHERE length(w) >= 5 GROUP BY ALL), h AS (SELECT w, k, {_CRC} AS h FROM u),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
x AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
del AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM x, unnest(range(1, length(word) + 1)) r(i)),
one AS (SELECT DISTINCT del.word AS a, del.n AS na, x.word AS b, x.n AS nb FROM del JOIN x ON del.rest = x.word),
near AS (SELECT a, b, nb FROM one UNION ALL SELECT b, a, na FROM one UNION ALL SELECT p.word, q.word, q.n FROM del p JOIN del q ON p.rest = q.rest AND p.i = q.i AND p.word <> q.word),
best AS (SELECT a AS word, count(*) AS n_near, max(nb) AS most, arg_min(b, (-nb, b)) AS b FROM near GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN b END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM x LEFT JOIN best USING (word)),
way AS (SELECT word, word AS last FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.last WHERE f.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, last AS root FROM f JOIN way USING (word) WHERE last NOT IN (SELECT word FROM f WHERE form IS NOT NULL)"""

ORACLE_SQL = {"op12_spelling_variants": _OP12, "op9_vantage_search": _OP9, "op6_secret_ledger": _OP6, "op7_line_quality": _OP7, "op8_bayes_minhash": _OP8}
