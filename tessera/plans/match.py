"""Keys, blocking, fuzzy matches and duplicate decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import alike
from tessera.operators import matching as M
from tessera.operators.graph import components
from tessera.operators.products import few_item_pairs, item_sets
from tessera.operators.relational import small, top_per_key
from tessera.operators.similarity import half_alike
from tessera.plans.registry import query, table

_R4 = "floor(({}) * 10000 + 0.5) / 10000"
# The fold of names, said in SQL: accents off, then the letters that have none.
_FOLD = "replace(replace(replace(replace(replace(strip_accents(lower({})), 'ß', 'ss'), 'ø', 'o'), 'æ', 'ae'), 'œ', 'oe'), 'ł', 'l')"
_NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part)"


_KEY = f"nullif(regexp_replace({_FOLD.format('text')}, '[^a-z0-9]', '', 'g'), '')"


@query(f"SELECT doc_id, {_KEY} AS search_key FROM documents")
def search_key_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", X.search_key(F.col("text")).alias("search_key"))


@query(f"""WITH t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all({_FOLD.format('text')}, '([a-z0-9]{{3,}})', 1)) AS item FROM documents), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
s AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM t x JOIN t y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, shared, {_R4.format("shared / (na.n + nb.n - shared)")} AS jaccard FROM s JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE shared / (na.n + nb.n - shared) >= 0.5""")
def token_jaccard_blocked(spark, d):
    """All pairs of all languages."""
    words = F.transform(X.tokens(F.col("text"), 3), lambda w: F.xxhash64(w))
    return half_alike(table(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("items"))).withColumn("jaccard", X.round4(F.col("jaccard")))


def _name_pairs(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    blocks = names.withColumn("keys", M.block_keys(F.col("name"), 1, 3))
    return M.blocked_pairs(blocks, "name", "keys")


_BLOCK = """b AS (SELECT name, 'p:' || left(name, 1) AS key FROM n UNION SELECT name, 't:' || unnest(list_filter(string_split(name, ' '), lambda w: length(w) >= 3)) FROM n),
c AS (SELECT DISTINCT x.name AS a, y.name AS b FROM b x JOIN b y USING (key) WHERE x.name < y.name)"""
_TRI = "list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))"


@query(f"""WITH {_NAMES}, k AS (SELECT name, '  ' || regexp_replace(name, '[^a-z0-9]', '', 'g') || ' ' AS p FROM n), g AS (SELECT name, {_TRI} AS g FROM k), s AS (SELECT x.name AS a, y.name AS b, len(list_intersect(x.g, y.g)) AS c, len(x.g) + len(y.g) AS n FROM g x JOIN g y ON x.name < y.name)
SELECT a, b, {_R4.format("c / (n - c)")} AS similarity FROM s""")
def trigram_similarity(spark, d):
    """All pairs of names and their similarity, without blocks or a least one."""
    return alike.trigram_scores(table(spark, d, "part"), "p_name", X.search_key(F.col("p_name"))).withColumn("similarity", X.round4(F.col("similarity")))


@query(f"""WITH {_NAMES}, {_BLOCK}, w AS (SELECT a, b, list_sort(list_intersect(string_split(a, ' '), string_split(b, ' '))) AS s, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM c),
j AS (SELECT a, b, x, y, s, list_aggregate(s, 'string_agg', ' ') AS sh FROM w), r AS (SELECT *, coalesce(sh, '') AS shared,
trim(concat_ws(' ', coalesce(sh, ''), coalesce(list_aggregate(list_sort(list_filter(x, lambda e: NOT list_contains(y, e))), 'string_agg', ' '), ''))) AS l,
trim(concat_ws(' ', coalesce(sh, ''), coalesce(list_aggregate(list_sort(list_filter(y, lambda e: NOT list_contains(x, e))), 'string_agg', ' '), ''))) AS r FROM j)
SELECT a, b, {_R4.format('''greatest((greatest(length(shared), length(l)) - levenshtein(shared, l)) / greatest(length(shared), length(l)), (greatest(length(shared), length(r)) - levenshtein(shared, r)) / greatest(length(shared), length(r)),
 (greatest(length(l), length(r)) - levenshtein(l, r)) / greatest(length(l), length(r)))''')} AS token_set, {_R4.format("2 * len(s) / (len(x) + len(y))")} AS f1 FROM r""")
def levenshtein_token_set(spark, d):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, d).select("a", "b", X.round4(X.token_set_ratio(a, b)).alias("token_set"), X.round4(X.token_f1(a, b)).alias("f1"))


@query(f"WITH {_NAMES}, {_BLOCK} SELECT a, b, {_R4.format('jaro_winkler_similarity(a, b)')} AS similarity FROM c WHERE jaro_winkler_similarity(a, b) >= 0.8200001")
def jaro_winkler_floored(spark, d):
    return M.jaro_winkler_pairs(_name_pairs(spark, d), 0.8200001, True).withColumn("similarity", X.round4(F.col("similarity")))


@query()
def jaro_winkler_blocked(spark, d):
    return M.jaro_winkler_pairs(_name_pairs(spark, d), 0.82).withColumn("similarity", X.round4(F.col("similarity")))


_MAIL = r"m AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1))) AS email FROM documents)"


@query(f"WITH {_MAIL} SELECT email, count(*) AS docs, min(doc_id) AS first_doc FROM m GROUP BY email HAVING count(*) < 4")
def email_posting_suppressed(spark, d):
    m = table(spark, d, "documents").where(F.col("text").contains("@")).select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))
    return m.groupBy("email").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs < 4")


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_texts(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"""WITH pool AS (SELECT doc_id AS id, md5(text) AS digest, md5({_KEY}) AS folded FROM documents), req AS (SELECT item_id, md5(text) AS digest, md5({_KEY}) AS folded FROM benchmark),
d AS (SELECT item_id, count(DISTINCT id) AS n, min(id) AS m FROM req JOIN pool USING (digest) GROUP BY 1),
s AS (SELECT item_id, count(DISTINCT id) AS n, min(id) AS m FROM req r JOIN pool USING (folded) WHERE item_id NOT IN (SELECT item_id FROM d) GROUP BY 1)
SELECT item_id, CASE WHEN d.n = 1 THEN 'digest' WHEN d.n > 1 THEN 'digest_ambiguous' WHEN s.n = 1 THEN 'folded' WHEN s.n > 1 THEN 'folded_ambiguous' ELSE 'unmatched' END AS method,
CASE WHEN d.n = 1 THEN d.m WHEN d.n IS NULL AND s.n = 1 THEN s.m END AS matched_id, coalesce(d.n, s.n, 0) AS candidates FROM req LEFT JOIN d USING (item_id) LEFT JOIN s USING (item_id)""")
def cascade_match(spark, d):
    """The second key is of the whole folded text."""
    keys = lambda f, i, n: f.select(F.col(i).alias(n), F.md5("text").alias("digest"), F.md5(X.search_key(F.col("text"))).alias("folded"))
    return M.cascade(keys(table(spark, d, "benchmark"), "item_id", "item_id"), keys(table(spark, d, "documents"), "doc_id", "id"), "item_id", [("digest", "digest"), ("folded", "folded")])


@query("""WITH q(q, ours) AS (VALUES (1, 'red bolt'), (2, 'blue gear'), (3, 'small zzz'), (4, 'hot rod')), n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1),
c AS (SELECT q, ours, name, id, CASE WHEN split_part(name, ' ', 1) = split_part(ours, ' ', 1) THEN 0.96 ELSE 0.5 END AS score FROM q, n WHERE split_part(name, ' ', 1) = split_part(ours, ' ', 1) OR split_part(name, ' ', 2) = split_part(ours, ' ', 2)),
t AS (SELECT *, name = ours AS exact, length(name) AS len FROM c QUALIFY score = max(score) OVER (PARTITION BY q)),
w AS (SELECT *, count(*) OVER p AS n, sum(exact::INT) OVER p AS exacts, min(len) OVER p AS shortest FROM t WINDOW p AS (PARTITION BY q)),
v AS (SELECT *, count(*) FILTER (len = shortest) OVER (PARTITION BY q) AS shorts, row_number() OVER (PARTITION BY q ORDER BY exact DESC, len, id) AS r FROM w)
SELECT q, n AS tied, id AS chosen, score::DOUBLE AS score, CASE WHEN score < 0.95 THEN 'below' WHEN n = 1 THEN 'best' WHEN exacts = 1 THEN 'exact' WHEN exacts = 0 AND shorts = 1 THEN 'shortest' ELSE 'tie' END AS status FROM v WHERE r = 1""")
def tie_break_status(spark, d):
    asked = spark.createDataFrame([(1, "red bolt"), (2, "blue gear"), (3, "small zzz"), (4, "hot rod")], "q int, ours string")
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    word = lambda c, i: F.split_part(F.col(c), F.lit(" "), F.lit(i))
    first = word("name", 1) == word("ours", 1)
    # each word is a join of its own; a name that shares both words is found by the first
    on = lambda i: names.withColumn("w", word("name", i)).join(asked.withColumn("w", word("ours", i)), "w").drop("w")
    found = on(1).withColumn("score", F.lit(0.96)).unionByName(on(2).where(~first).withColumn("score", F.lit(0.5)))
    return M.break_ties(found, "q", "score", "name", "ours", "id")


@query()
def duplicate_score_bands(spark, d):
    part = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.collect_set("p_brand").alias("brands"), F.collect_set("p_type").alias("types"))
    side = lambda n, x: part.select(F.col("name").alias(n), F.col("brands").alias(f"brands_{x}"), F.col("types").alias(f"types_{x}"))
    both = _name_pairs(spark, d).join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("jw", M.jaro_winkler(F.col("a"), F.col("b")))
    zero, name = F.lit(0.0), F.when(F.col("jw") >= 0.82, F.col("jw")).otherwise(0.0)
    score = M.duplicate_score(F.lit(False), zero, zero, name, X.jaccard(F.col("brands_x"), F.col("brands_y")), F.arrays_overlap("types_x", "types_y"))
    return both.select("a", "b", X.round4(score).alias("score"), M.band(score).alias("band")).where("score >= 0.6")


@query("""WITH w(label, word) AS (VALUES ('en', 'the'), ('en', 'and'), ('en', 'of'), ('en', 'that'), ('fr', 'le'), ('fr', 'et'), ('fr', 'les'), ('fr', 'dans'), ('de', 'der'), ('de', 'und'), ('de', 'die'), ('de', 'mit'), ('es', 'que'), ('es', 'los'), ('es', 'por'), ('es', 'con')),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9_]+)', 1)) AS word FROM documents), h AS (SELECT doc_id, label, count(*) AS hits, count(DISTINCT word) AS present FROM t JOIN w USING (word) GROUP BY ALL),
s AS (SELECT doc_id, label, hits, present, CAST(sum(hits) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM h)
SELECT * FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, present DESC, label) = 1) WHERE hits / total >= 0.8""")
def label_set_dominance(spark, d):
    sets = {"en": ("the", "and", "of", "that"), "fr": ("le", "et", "les", "dans"), "de": ("der", "und", "die", "mit"), "es": ("que", "los", "por", "con")}
    return M.dominant_label(table(spark, d, "documents"), "doc_id", "text", sets)


@query(r"""WITH RECURSIVE k AS (SELECT doc_id, md5(text) AS key FROM documents WHERE text IS NOT NULL UNION SELECT doc_id, lower(unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1))) FROM documents),
s AS MATERIALIZED (SELECT DISTINCT m.a, k.doc_id AS b FROM k JOIN (SELECT key, min(doc_id) AS a FROM k GROUP BY 1) m USING (key)), e AS MATERIALIZED (SELECT a, b FROM s UNION SELECT b, a FROM s),
r AS (SELECT DISTINCT a AS id, a AS low FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.low = e.a) SELECT id AS doc_id, min(low) AS component FROM r GROUP BY 1""")
def fixpoint_components(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest"), X.emails(F.col("text")).alias("mails"))
    keyed = docs.select("doc_id", F.explode(F.concat(F.array("digest"), "mails")).alias("key"))
    stars = keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("a")), "key").select("a", F.col("doc_id").alias("b"))
    return components(stars).select(F.col("id").alias("doc_id"), "component")


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment || '/' || c_nationkey AS item FROM customer UNION SELECT o_custkey, o_orderpriority || '/' || year(o_orderdate) FROM orders),
n AS (SELECT id, count(*) AS n FROM c GROUP BY 1), s AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM c x JOIN c y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2)
SELECT a, b FROM s JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE shared >= 2 AND shared / (na.n + nb.n - shared) >= 0.4""")
def internal_duplicates(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("item"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.concat("o_orderpriority", F.lit("/"), F.year("o_orderdate").cast("string")).alias("item"))
    return few_item_pairs(item_sets(c.union(o)), 2, 400).select("a", "b")


@query("""SELECT n_name, p_name FROM (SELECT n_name, p_name, row_number() OVER (PARTITION BY n_name ORDER BY levenshtein(lower(n_name), p_name), p_name) AS r FROM nation, (SELECT DISTINCT p_name FROM part)) WHERE r = 1""")
def best_match(spark, d):
    # the nations are a query set against all distinct names of the catalogue; their number is checked
    nations, names = table(spark, d, "nation").select("n_name"), table(spark, d, "part").select("p_name").distinct()
    scored = names.crossJoin(small(nations)).withColumn("away", F.levenshtein(F.lower("n_name"), "p_name"))
    return top_per_key(scored, ["n_name"], [F.col("away"), F.col("p_name")]).select("n_name", "p_name")
