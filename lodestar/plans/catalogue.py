"""The registered queries of the engine itself, and the SQL that checks them.

The engine's roles are played by the given tables: documents are functions with texts, embeddings their vectors (vec_id
= doc_id), source and lang the file and class; parts are the nodes of the call graph, and a part calls the one that
follows it in an order.  Scores are rounded to four places and every order has a last key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as names
from ..operators import embedding, graph, incremental, parse, render, resolve, retrieval, symbols
from ..operators.lineage import cut
from ..sources import ignore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The search that the retrieval queries run.
QUERY = "thatBle of_andThe Onand the with_12th thened"
IGNORED = ("build/", "*.log", "src7/**/gen_*", "!src7/en/gen_1*", "/src3", "doc_5?.py")


def query(oracle: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- incremental

_OLD = "SELECT doc_id AS k, sha256(text) AS h FROM documents"
_NEW = "SELECT CASE WHEN lang = 'de' THEN -1 - doc_id ELSE doc_id END AS k, sha256(CASE WHEN lang = 'es' THEN text || ' edited' ELSE text END) AS h FROM documents"


@query(f"""SELECT coalesce(o.k, n.k) AS path, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS change
    FROM ({_OLD}) o FULL OUTER JOIN ({_NEW}) n ON o.k = n.k""")
def q01_hash_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.select(F.when(F.col("lang") == "de", -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("path"), F.when(F.col("lang") == "es", F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("content"))
    old = d.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return incremental.diff(old, new.select("path", F.sha2("content", 256).alias("hash")))


_DOC_PATH = "CASE WHEN doc_id % 5 = 0 THEN 'build/' WHEN doc_id % 7 = 0 THEN 'pkg/venvx/lib/' ELSE '' END || source || '/' || lang || '/' || CASE WHEN doc_id % 3 = 0 THEN 'gen_' ELSE 'doc_' END || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 THEN '.log' ELSE '.py' END"


def _paths(d: DataFrame):
    i = F.col("doc_id")
    top = F.when(i % 5 == 0, "build/").when(i % 7 == 0, "pkg/venvx/lib/").otherwise("")
    return F.concat(top, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.when(i % 3 == 0, "gen_").otherwise("doc_"), i.cast("string"), F.when(i % 11 == 0, ".log").otherwise(".py"))


@query(f"""WITH p AS (SELECT {_DOC_PATH} AS path FROM documents)
    SELECT path, {ignore.sql("path", IGNORED)} AS ignored, regexp_matches(path, '{ignore.EXCLUDED_PATTERN}') AS excluded, starts_with(path, 'pkg/venvx/') AS in_venv FROM p""")
def q02_ignored_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.select(_paths(d).alias("path"))
    return d.select("path", ignore.ignored(F.col("path"), IGNORED).alias("ignored"), ignore.excluded(F.col("path")).alias("excluded"), ignore.in_venv(F.col("path"), ["pkg/venvx"]).alias("in_venv"))


@query("""WITH m AS (SELECT 'repo.' || source || '.' || lang || CASE WHEN doc_id % 10 = 0 THEN '.__init__' ELSE '.m' || CAST(doc_id % 10 AS VARCHAR) END AS module FROM documents),
    d AS (SELECT DISTINCT module, string_split(module, '.') AS p FROM m),
    s AS (SELECT module, p, i, j FROM d, generate_series(1, len(p)) a(i), generate_series(1, len(p)) b(j) WHERE i <= j),
    x AS (SELECT array_to_string(p[i:j], '.') AS sub_path, module FROM s)
    SELECT sub_path, module FROM (SELECT sub_path, module, row_number() OVER (PARTITION BY sub_path ORDER BY CASE WHEN ends_with(module, '__init__') THEN 0 ELSE 1 END, module DESC) AS r FROM (SELECT DISTINCT sub_path, module FROM x)) WHERE r = 1""")
def q03_module_paths(spark, sf_dir):
    i = F.col("doc_id")
    module = F.concat(F.lit("repo."), F.col("source"), F.lit("."), F.col("lang"), F.when(i % 10 == 0, ".__init__").otherwise(F.concat(F.lit(".m"), (i % 10).cast("string"))))
    return symbols.sub_paths(table(spark, sf_dir, "documents").select(module.alias("module")))


_TEST_PATH = "CASE WHEN doc_id % 4 = 0 THEN 'tests/' WHEN doc_id % 9 = 0 THEN 'a/Test_' || lang || '/' ELSE 'lib/' END || source || CASE WHEN doc_id % 6 = 1 THEN '_test.py' ELSE '/conftest' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '2' END || '.py' END"
_TEST_IDENT = "CASE WHEN doc_id % 5 = 0 THEN 'test_' WHEN doc_id % 5 = 1 THEN 'a.testing.' WHEN doc_id % 5 = 2 THEN 'test.' ELSE 'm.' END || source"


@query(f"""WITH t AS (SELECT doc_id, {_TEST_PATH} AS path, {_TEST_IDENT} AS ident FROM documents)
    SELECT doc_id, regexp_matches(path, '{names.TEST_PATH}') OR regexp_matches(ident, '{names.TEST_ID_SEARCH}') AS search_test, regexp_matches(path, '{names.TEST_PATH}') OR regexp_matches(ident, '{names.TEST_ID_GRAPH}') AS graph_test FROM t""")
def q04_test_code(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 4 == 0, "tests/").when(i % 9 == 0, F.concat(F.lit("a/Test_"), F.col("lang"), F.lit("/"))).otherwise("lib/"), F.col("source"), F.when(i % 6 == 1, "_test.py").otherwise(F.concat(F.lit("/conftest"), F.when(i % 2 == 0, "").otherwise("2"), F.lit(".py"))))
    ident = F.concat(F.when(i % 5 == 0, "test_").when(i % 5 == 1, "a.testing.").when(i % 5 == 2, "test.").otherwise("m."), F.col("source"))
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), ident.alias("ident"))
    return d.select("doc_id", names.is_test(F.col("path"), F.col("ident")).alias("search_test"), names.is_test(F.col("path"), F.col("ident"), True).alias("graph_test"))


# ---------------------------------------------------------------- texts

_IDENT = "p_type || 'HTTPServer' || CAST(p_size AS VARCHAR) || 'v_' || replace(p_name, ' ', '_') || '__X' || CAST(p_partkey AS VARCHAR)"


def _words_sql(x: str) -> str:
    s = f"regexp_replace(regexp_replace({x}, '([a-zA-Z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zA-Z])', '\\1 \\2', 'g')"
    s = f"regexp_replace(regexp_replace(replace({s}, '_', ' '), '([A-Z]+)', ' \\1', 'g'), '([A-Z][a-z]+)', ' \\1', 'g')"
    return f"list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> '')"


def _ident():
    return F.concat(F.col("p_type"), F.lit("HTTPServer"), F.col("p_size").cast("string"), F.lit("v_"), F.translate("p_name", " ", "_"), F.lit("__X"), F.col("p_partkey").cast("string"))


@query(f"SELECT p_partkey, array_to_string({_words_sql(_IDENT)}, ' ') AS words FROM part")
def q05_split_identifier(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.spaced(_ident()).alias("words"))


_TWICE = lambda x: f"list_concat(list_concat([replace({x}, '_', ''), replace({x}, '_', '')], {_words_sql(x)}), {_words_sql(x)})"


def _functions(spark, sf_dir) -> DataFrame:
    """Parts as rows of functions."""
    params = F.array(F.struct(F.translate("p_name", " ", "_").alias("name"), F.col("p_brand").alias("type"), F.lit(None).cast("string").alias("value")), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value")))
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        _ident().alias("name"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("Big"), F.initcap("p_type"), F.lit("_Box"))).alias("class"),
        F.concat(F.lit("lib//"), F.lower("p_type"), F.lit("/s"), F.col("p_size").cast("string"), F.lit(".py")).alias("path"),
        params.alias("parameters"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("List["), F.col("p_type"), F.lit("]"))).alias("returns"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit('"""Makes a '), F.col("p_name"), F.lit('.\nMore."""'))).alias("doc"),
        F.when(F.col("p_size") > 30, F.lit("'''Boxes.'''")).alias("class_doc"),
        F.when(F.col("p_size") % 5 == 0, F.lit("Module of parts.")).alias("module_doc"),
        F.concat(F.lit("def "), _ident(), F.lit("():\n    x = 1\n\n    return x")).alias("code"),
    )


_FUNCTIONS = f"""f AS (SELECT p_partkey, {_IDENT} AS name, CASE WHEN p_size > 25 THEN 'Big' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || '_Box' END AS cls, 'lib//' || lower(p_type) || '/s' || CAST(p_size AS VARCHAR) || '.py' AS path,
    replace(p_name, ' ', '_') AS pn, p_brand AS pt, CASE WHEN p_size % 2 = 0 THEN 'List[' || p_type || ']' END AS returns,
    CASE WHEN p_size % 3 = 0 THEN '\"\"\"Makes a ' || p_name || '.' || chr(10) || 'More.\"\"\"' END AS doc, CASE WHEN p_size > 30 THEN '''''''Boxes.''''''' END AS class_doc, CASE WHEN p_size % 5 = 0 THEN 'Module of parts.' END AS module_doc,
    'def ' || {_IDENT} || '():' || chr(10) || '    x = 1' || chr(10) || chr(10) || '    return x' AS code FROM part)"""
_PLAIN = lambda x: f"replace(replace(trim({x}), '\"\"\"', ''), '''''''', '')"
_OR = lambda x: f"CASE WHEN {x} IS NULL THEN CAST([] AS VARCHAR[]) ELSE {{}} END"


@query(f"""WITH {_FUNCTIONS}, w AS (SELECT *, {_TWICE('name')} AS a, {_OR('cls').format(_TWICE('cls'))} AS b, list_filter(string_split(replace(path, '.py', ''), '/'), lambda w: w <> '') AS c, list_concat({_words_sql('pn')}, {_words_sql('pt')}) AS d, {_OR('returns').format(_words_sql('returns'))} AS e FROM f)
    SELECT p_partkey, array_to_string(list_concat(list_concat(list_concat(list_concat(a, b), c), d), e), ' ') || chr(10) || concat_ws(' ', {_PLAIN('class_doc')}, {_PLAIN('doc')}, {_PLAIN('module_doc')}) AS search_text FROM w""")
def q06_search_text(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return f.select("p_partkey", names.search_text(*(F.col(c) for c in ("name", "class", "path", "parameters", "returns", "doc", "class_doc", "module_doc"))).alias("search_text"))


@query(f"""WITH c AS (SELECT c_custkey, c_name || '_x HTTPGet ' || c_mktsegment || ' get_Ids c_name' AS q FROM customer),
    r AS (SELECT c_custkey, list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '') AS ws FROM c),
    u AS (SELECT c_custkey, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM r),
    t AS (SELECT c_custkey, i, unnest(list_concat(CASE WHEN contains(w, '_') THEN [replace(w, '_', '')] ELSE CAST([] AS VARCHAR[]) END, {_words_sql('w')})) AS t, generate_subscripts(list_concat(CASE WHEN contains(w, '_') THEN [replace(w, '_', '')] ELSE CAST([] AS VARCHAR[]) END, {_words_sql('w')}), 1) AS j FROM u),
    d AS (SELECT c_custkey, lower(t) AS t, min(i * 1000 + j) AS o FROM t GROUP BY ALL)
    SELECT c_custkey, string_agg(t, ' ' ORDER BY o) AS tokens FROM d GROUP BY c_custkey""")
def q07_query_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    q = F.concat("c_name", F.lit("_x HTTPGet "), "c_mktsegment", F.lit(" get_Ids c_name"))
    return c.select("c_custkey", F.array_join(names.query_tokens(q), " ").alias("tokens"))


@query(f"""WITH {_FUNCTIONS} SELECT p_partkey, concat_ws(chr(10), '# ' || path, '\"\"\"' || module_doc || '\"\"\"', '', CASE WHEN cls IS NULL THEN code ELSE concat_ws(chr(10), 'class ' || cls || ':', '    \"\"\"' || class_doc || '\"\"\"',
    array_to_string(list_transform(string_split(code, chr(10)), lambda l: CASE WHEN trim(l) = '' THEN '' ELSE '    ' || l END), chr(10))) END) AS embed_text FROM f""")
def q12_embed_text(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return f.select("p_partkey", names.embed_text(*(F.col(c) for c in ("path", "class", "code", "class_doc", "module_doc"))).alias("embed_text"))


_SPACED = lambda x: f"array_to_string({_words_sql(x)}, ' ')"


@query(f"""WITH {_FUNCTIONS} SELECT p_partkey, concat_ws(chr(10), '# ' || path, '\"\"\"' || module_doc || '\"\"\"', 'class ' || {_SPACED('cls')} || ':', CASE WHEN cls IS NOT NULL THEN '    \"\"\"' || class_doc || '\"\"\"' END,
    'def ' || {_SPACED('name')} || '(' || {_SPACED('pn')} || ': ' || {_SPACED('pt')} || ')' || coalesce(' -> ' || {_SPACED('returns')}, '') || ':',
    CASE WHEN doc IS NOT NULL THEN '    \"\"\"' || trim(string_split(trim(doc), chr(10))[1]) || '\"\"\"' ELSE code END) AS rerank_text FROM f""")
def q13_rerank_text(spark, sf_dir):
    f = _functions(spark, sf_dir)
    return f.select("p_partkey", names.rerank_text(*(F.col(c) for c in ("name", "class", "path", "parameters", "returns", "code", "doc", "class_doc", "module_doc"))).alias("rerank_text"))


_ANNOTATION = "CASE p_size % 9 WHEN 0 THEN 'Iterator[' || initcap_type || ']' WHEN 1 THEN 'Optional[List[' || initcap_type || ']]' WHEN 2 THEN 'Dict[str, ' || initcap_type || ']' WHEN 3 THEN 'Union[None, ' || initcap_type || ']' WHEN 4 THEN 'Generator[' || initcap_type || ', int, Dict[str, int]]' WHEN 5 THEN 'int' WHEN 6 THEN initcap_type WHEN 7 THEN 'List[int]' ELSE 'Tuple[' || initcap_type || ', ...]' END"


@query(f"""WITH p AS (SELECT p_partkey, p_size, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS initcap_type FROM part)
    SELECT p_partkey, {_ANNOTATION} AS annotation, CASE WHEN p_size % 9 IN (0, 1, 3, 4, 6) THEN initcap_type END AS inner_class FROM p""")
def q42_generic_unwrap(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.initcap(F.lower("p_type")).alias("initcap_type"))
    p = p.select("p_partkey", F.expr(_ANNOTATION).alias("annotation"))
    return p.select("p_partkey", "annotation", names.inner_class_of(F.col("annotation")).alias("inner_class"))


# ---------------------------------------------------------------- retrieval

_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 1)"
_SEMANTIC = f"""sem0 AS (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_VECTOR} AS DOUBLE[])), 9) AS s FROM embeddings),
    sem AS (SELECT id, round(s, 4) AS similarity, row_number() OVER (ORDER BY s DESC, id) AS semantic_rank FROM sem0 WHERE s >= {{t}} ORDER BY s DESC, id LIMIT {{k}})"""


def _vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 1").first()["embedding"]]


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def _bm25_sql(corpus: str) -> str:
    """CTEs q (tokens), bm (id, score) of a corpus query with id and text."""
    return f"""q0 AS (SELECT unnest(list_filter(string_split_regex('{QUERY}', '\\s+'), lambda w: w <> '')) AS w),
    q AS (SELECT DISTINCT lower(unnest(list_concat(CASE WHEN contains(w, '_') THEN [replace(w, '_', '')] ELSE CAST([] AS VARCHAR[]) END, {_words_sql('w')}))) AS term FROM q0),
    docs AS (SELECT id, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS t FROM ({corpus}) WHERE text IS NOT NULL),
    st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
    tok AS (SELECT id, unnest(t) AS term FROM docs), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
    raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    bm AS (SELECT tf.id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(docs.t) / avgdl))), 9) AS score FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN docs ON docs.id = tf.id, st GROUP BY tf.id HAVING round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(docs.t) / avgdl))), 9) > 0)"""


@query(f"WITH {_SEMANTIC.format(t=0.1, k=100)} SELECT id, similarity FROM sem")
def q08_cosine_top_k(spark, sf_dir):
    return retrieval.semantic(_vectors(spark, sf_dir), _vector(spark, sf_dir), 100, 0.1).select("id", "similarity")


@query(f"WITH {_bm25_sql('SELECT doc_id AS id, text FROM documents')} SELECT id, round(score, 4) AS score FROM bm")
def q09_bm25(spark, sf_dir):
    return retrieval.bm25(_corpus(spark, sf_dir), QUERY).select("id", F.round("score", 4).alias("score"))


_NOT_TEST = f"NOT regexp_matches(CASE WHEN source = 'src3' THEN 'tests/' ELSE 'lib/' END || lang || '.py', '{names.TEST_PATH}')"


@query(f"WITH {_bm25_sql(f'SELECT doc_id AS id, text FROM documents WHERE {_NOT_TEST}')} SELECT id, round(score, 4) AS score FROM bm")
def q10_bm25_without_tests(spark, sf_dir):
    path = F.concat(F.when(F.col("source") == "src3", "tests/").otherwise("lib/"), F.col("lang"), F.lit(".py"))
    return retrieval.bm25(_corpus(spark, sf_dir).where(~names.is_test(path, F.col("lang"))), QUERY).select("id", F.round("score", 4).alias("score"))


_FUSED = f"""WITH {_SEMANTIC.format(t=0.1, k=100)}, {_bm25_sql('SELECT doc_id AS id, text FROM documents')},
    kw AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS bm25_rank FROM bm),
    fused AS (SELECT coalesce(sem.id, kw.id) AS id, coalesce(similarity, round(score, 4)) AS similarity, semantic_rank, bm25_rank, coalesce(3.0 / (60 + semantic_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0) AS rrf FROM sem FULL OUTER JOIN kw ON sem.id = kw.id)"""


@query(f"{_FUSED} SELECT id, similarity, semantic_rank, bm25_rank, round(rrf, 6) AS rrf_score FROM (SELECT * FROM fused ORDER BY rrf DESC, id LIMIT 100)")
def q11_rrf_hybrid(spark, sf_dir):
    h = retrieval.hybrid(_corpus(spark, sf_dir), _vectors(spark, sf_dir), QUERY, _vector(spark, sf_dir), 100, 0.1)
    return h.select("id", "similarity", F.col("semantic_rank").cast("long").alias("semantic_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("rrf_score", 6).alias("rrf_score"))


# ---------------------------------------------------------------- graph

_CALLS = """seq AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
    calls AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY l_orderkey, l_linenumber, l_suppkey, dst) AS pos FROM seq WHERE dst IS NOT NULL)"""
_NODES = "nodes AS (SELECT p_partkey AS id, p_type || '/' || CAST(p_size AS VARCHAR) AS file, CASE WHEN p_size > 10 THEN p_brand END AS class, CAST(p_partkey * 7919 % 1000 AS DOUBLE) / 1000 AS similarity, p_size % 4 = 0 AS is_bridge FROM part)"
_EDGES = f"""{_CALLS}, {_NODES}, deg AS (SELECT dst AS id, count(*) AS in_degree FROM calls GROUP BY dst),
    edges AS (SELECT c.src, c.dst, (ln(in_degree + 1) + 1) * CASE WHEN a.file = b.file AND a.class = b.class THEN 0.5 WHEN a.file = b.file THEN 0.7 ELSE 1.0 END AS weight
        FROM (SELECT DISTINCT src, dst FROM calls) c JOIN nodes a ON a.id = c.src JOIN nodes b ON b.id = c.dst JOIN deg ON deg.id = c.dst)"""
#: The hits of a query: the hundred dearest parts.
_HITS = "hits AS (SELECT n.* FROM nodes n JOIN part ON p_partkey = id ORDER BY p_retailprice DESC, id LIMIT 100)"
_INNER = "inner_calls AS (SELECT src, dst, pos FROM calls WHERE src IN (SELECT id FROM hits) AND dst IN (SELECT id FROM hits)), dag AS (SELECT * FROM inner_calls WHERE src < dst)"


def calls_table(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("src"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src", "l_suppkey")
    seq = line.withColumn("dst", F.lead("src").over(w)).where("dst IS NOT NULL")
    return seq.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "dst")).alias("pos"))


def nodes_table(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(key.alias("id"), F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("file"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("class"), ((key * 7919 % 1000).cast("double") / 1000).alias("similarity"), (F.col("p_size") % 4 == 0).alias("is_bridge"), "p_retailprice")


def hits_table(spark, sf_dir) -> DataFrame:
    return nodes_table(spark, sf_dir).orderBy(F.desc("p_retailprice"), "id").limit(100).drop("p_retailprice")


def _dag(calls: DataFrame) -> DataFrame:
    return calls.where("src < dst")


@query(f"WITH {_CALLS} SELECT dst AS id, count(*) AS in_degree FROM calls GROUP BY dst")
def q14_in_degree(spark, sf_dir):
    return graph.in_degrees(calls_table(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT src, dst, round(weight, 4) AS weight FROM edges")
def q15_weighted_edges(spark, sf_dir):
    return graph.weighted_edges(calls_table(spark, sf_dir), nodes_table(spark, sf_dir)).select("src", "dst", F.round("weight", 4).alias("weight"))


@query(f"WITH {_CALLS} SELECT dst AS id, count(DISTINCT src) AS n_callers, string_agg(DISTINCT CAST(src AS VARCHAR), ',' ORDER BY CAST(src AS VARCHAR)) AS callers FROM calls GROUP BY dst")
def q16_callers(spark, sf_dir):
    c = graph.callers(calls_table(spark, sf_dir))
    return c.select("id", "n_callers", F.array_join(F.array_sort(F.transform("callers", lambda x: x.cast("string"))), ",").alias("callers"))


@query(f"""WITH {_CALLS}, {_NODES}, seeds AS (SELECT id FROM nodes JOIN part ON p_partkey = id ORDER BY p_retailprice DESC, id LIMIT 30), good AS (SELECT id, file FROM nodes WHERE NOT is_bridge),
    around AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls),
    hop1 AS (SELECT DISTINCT b AS id, file FROM around JOIN good ON good.id = b WHERE a IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM seeds)),
    close AS (SELECT id FROM hop1 WHERE file IN (SELECT file FROM nodes WHERE id IN (SELECT id FROM seeds))),
    hop2 AS (SELECT DISTINCT b AS id FROM around WHERE a IN (SELECT id FROM close) AND b IN (SELECT id FROM good) AND b NOT IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM hop1))
    SELECT id, 1 AS hop FROM hop1 UNION ALL SELECT id, 2 FROM hop2""")
def q17_expansion(spark, sf_dir):
    n = nodes_table(spark, sf_dir)
    seeds = n.orderBy(F.desc("p_retailprice"), "id").limit(30).select("id")
    return graph.expand(seeds, calls_table(spark, sf_dir), n, F.col("is_bridge"))


@query(f"""WITH RECURSIVE {_CALLS}, {_NODES}, {_HITS}, {_INNER}, r AS (SELECT id AS start, id FROM hits UNION SELECT r.start, c.dst FROM r JOIN inner_calls c ON c.src = r.id) SELECT start, id FROM r""")
def q18_closure(spark, sf_dir):
    hits = hits_table(spark, sf_dir)
    return graph.reachable(hits, graph.within(hits, calls_table(spark, sf_dir)))


@query(f"""WITH {_CALLS}, {_NODES}, {_HITS}, {_INNER}, e AS (SELECT h.id, is_bridge, similarity, (SELECT count(DISTINCT dst) FROM inner_calls c WHERE c.src = h.id) AS out_degree FROM hits h WHERE h.id NOT IN (SELECT dst FROM inner_calls))
    SELECT id, out_degree, row_number() OVER (ORDER BY is_bridge, similarity DESC, id) AS rank FROM e""")
def q19_entry_points(spark, sf_dir):
    hits = hits_table(spark, sf_dir)
    e = graph.entry_points(hits, graph.within(hits, calls_table(spark, sf_dir))).join(hits, "id")
    return e.select("id", "out_degree", F.row_number().over(Window.orderBy("is_bridge", F.desc("similarity"), "id")).alias("rank"))


_PREORDER = f"""WITH RECURSIVE {_CALLS}, {_NODES}, {_HITS}, {_INNER}, ent AS (SELECT id FROM hits WHERE id NOT IN (SELECT dst FROM dag)), de AS (SELECT src, dst, min(pos) AS pos FROM dag GROUP BY src, dst),
    r AS (SELECT id AS entry, id, CAST([] AS BIGINT[]) AS path FROM ent UNION ALL SELECT r.entry, de.dst, list_append(r.path, de.pos) FROM r JOIN de ON de.src = r.id),
    b AS (SELECT entry, id, min(path) AS path FROM r GROUP BY entry, id), chain AS (SELECT entry AS chain, row_number() OVER (PARTITION BY entry ORDER BY path, id) - 1 AS pos, id FROM b)"""


@query(f"{_PREORDER} SELECT chain AS entry, pos, id FROM chain")
def q20_preorder(spark, sf_dir):
    hits = hits_table(spark, sf_dir)
    calls = _dag(graph.within(hits, calls_table(spark, sf_dir)))
    return graph.preorder(graph.entry_points(hits, calls), calls)


def _chain_rows(spark, sf_dir):
    hits = hits_table(spark, sf_dir)
    calls = _dag(graph.within(hits, calls_table(spark, sf_dir)))
    return graph.chains(hits, calls).join(hits, "id").select("chain", "pos", "id", "similarity", "is_bridge"), calls


@query(f"""{_PREORDER}, cs AS (SELECT chain, pos, chain.id, similarity FROM chain JOIN hits USING (id)),
    lk AS (SELECT a.chain, avg(a.similarity * b.similarity) AS l FROM cs a JOIN dag ON dag.src = a.id JOIN cs b ON b.chain = a.chain AND b.id = dag.dst GROUP BY a.chain)
    SELECT chain, count(*) AS n, round(sum(similarity) + coalesce(max(l), 0) - 0.3 * (count(*) - 1), 4) AS score FROM cs LEFT JOIN lk USING (chain) GROUP BY chain""")
def q21_chain_scores(spark, sf_dir):
    rows, calls = _chain_rows(spark, sf_dir)
    return graph.chain_scores(rows, calls).select("chain", "n", F.round("score", 4).alias("score"))


@query(f"""{_PREORDER}, cs AS (SELECT chain, chain.id, similarity, count(*) OVER (PARTITION BY chain) AS n FROM chain JOIN hits USING (id)),
    reach AS (SELECT chain, id, id AS top FROM cs WHERE similarity >= 0.4 OR n = 1 UNION SELECT x.chain, de.src, x.top FROM reach x JOIN de ON de.dst = x.id JOIN cs y ON y.chain = x.chain AND y.id = de.src)
    SELECT DISTINCT chain, id FROM reach""")
def q22_prune(spark, sf_dir):
    rows, calls = _chain_rows(spark, sf_dir)
    return graph.prune(rows, calls, 0.4).select("chain", "id")


@query(f"""{_PREORDER}, cs AS (SELECT chain, id, count(*) OVER (PARTITION BY chain) AS n FROM chain), p AS (SELECT a.chain AS a, b.chain AS b, count(*) AS shared, least(min(a.n), min(b.n)) AS m FROM cs a JOIN cs b ON a.id = b.id AND a.chain < b.chain WHERE a.n > 1 AND b.n > 1 GROUP BY a.chain, b.chain)
    SELECT a, b, shared, round(shared / m, 4) AS ratio FROM p WHERE shared / m >= 0.3""")
def q23_overlaps(spark, sf_dir):
    rows, _ = _chain_rows(spark, sf_dir)
    return graph.overlaps(rows, 0.3).select("a", "b", "shared", F.round("ratio", 4).alias("ratio"))


@query(f"""{_PREORDER}, cs AS (SELECT chain, id, count(*) OVER (PARTITION BY chain) AS n FROM chain), p AS (SELECT a.chain AS a, b.chain AS b, count(*) AS shared, least(min(a.n), min(b.n)) AS m FROM cs a JOIN cs b ON a.id = b.id AND a.chain < b.chain WHERE a.n > 1 AND b.n > 1 GROUP BY a.chain, b.chain),
    l AS (SELECT a, b FROM p WHERE shared / m >= 0.3 UNION SELECT b, a FROM p WHERE shared / m >= 0.3), g AS (SELECT DISTINCT chain, chain AS other FROM cs UNION SELECT g.chain, l.b FROM g JOIN l ON l.a = g.other), gr AS (SELECT chain, min(other) AS grp FROM g GROUP BY chain)
    SELECT gr.grp AS "group", cs.id FROM cs JOIN gr USING (chain) GROUP BY gr.grp, cs.id HAVING count(DISTINCT chain) >= 2""")
def q24_merge_cores(spark, sf_dir):
    rows, _ = _chain_rows(spark, sf_dir)
    return graph.cores(rows, graph.merge_groups(rows, 0.3))


@query(f"""WITH RECURSIVE {_EDGES}, {_HITS}, home AS (SELECT id, id % 10 AS chain FROM hits),
    ins AS (SELECT a.chain, e.src, e.dst FROM edges e JOIN home a ON a.id = e.src JOIN home b ON b.id = e.dst AND a.chain = b.chain WHERE src <> dst),
    bound AS (SELECT id FROM home WHERE id NOT IN (SELECT src FROM ins) OR id NOT IN (SELECT dst FROM ins)),
    r AS (SELECT id AS source, id, 0.0::DOUBLE AS dist, [id] AS path FROM bound UNION ALL SELECT r.source, e.dst, r.dist + e.weight, list_append(r.path, e.dst) FROM r JOIN edges e ON e.src = r.id WHERE r.dist + e.weight <= 9.0 AND NOT list_contains(r.path, e.dst)),
    best AS (SELECT source, id, arg_min(path, {{'d': dist, 'p': path}}) AS path FROM r GROUP BY source, id),
    t AS (SELECT best.path FROM best JOIN home a ON a.id = best.id JOIN home b ON b.id = best.source WHERE a.chain <> b.chain AND len(best.path) > 2)
    SELECT DISTINCT id FROM (SELECT unnest(path[2:len(path) - 1]) AS id FROM t) WHERE id NOT IN (SELECT id FROM home)""")
def q25_bridges(spark, sf_dir):
    hits = hits_table(spark, sf_dir)
    rows = hits.select((F.col("id") % 10).alias("chain"), "id")
    return graph.bridges(rows, graph.weighted_edges(calls_table(spark, sf_dir), nodes_table(spark, sf_dir)), 9.0)


@query(f"WITH {_NODES}, n AS (SELECT file, count(*) AS functions FROM nodes GROUP BY file ORDER BY functions DESC, file LIMIT 30) SELECT file, functions, row_number() OVER (ORDER BY functions DESC, file) AS rank FROM n")
def q26_modules(spark, sf_dir):
    return graph.modules(nodes_table(spark, sf_dir))


@query(f"""WITH {_NODES}, n AS (SELECT id % 97 AS community, file, count(*) AS n FROM nodes GROUP BY ALL), r AS (SELECT community, file, n, row_number() OVER (PARTITION BY community ORDER BY n DESC, file) AS r, sum(n) OVER (PARTITION BY community) AS members FROM n)
    SELECT community, file, CAST(members AS BIGINT) AS members FROM r WHERE r = 1 AND members >= 3""")
def q27_dominant_files(spark, sf_dir):
    n = nodes_table(spark, sf_dir)
    return graph.dominant_files(n.select("id", (F.col("id") % 97).alias("community")), n)


@query()
def q28_communities(spark, sf_dir):
    edges = graph.weighted_edges(calls_table(spark, sf_dir), nodes_table(spark, sf_dir))
    return graph.communities(edges)


# ---------------------------------------------------------------- lookups and views

_WANTED = "(VALUES ('Customer#000000012', NULL), ('Customer#000000033', 'BUILDING'), ('Customer#000000040', 'MACHINERY'), ('Customer#000000007', 'FURNITURE')) w(name, class)"


@query(f"""SELECT c_custkey FROM (SELECT c_custkey, c_mktsegment FROM customer c WHERE EXISTS (SELECT 1 FROM {_WANTED} WHERE w.name = c.c_name AND (w.class IS NULL OR w.class = c.c_mktsegment)) OR contains(lower(c_mktsegment || '/' || c_name), lower('BUILD'))) ORDER BY c_mktsegment, c_custkey LIMIT 50""")
def q29_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("class"), F.concat("c_mktsegment", F.lit("/"), "c_name").alias("path"), F.col("c_mktsegment").alias("file_path"), F.col("c_custkey").alias("start_line"))
    wanted = ["Customer#000000012", "BUILDING.Customer#000000033", "x.MACHINERY.Customer#000000040", "FURNITURE.Customer#000000007"]
    return render.lookup(c, wanted, "BUILD").select("c_custkey")


@query(f"WITH {_CALLS}, {_NODES} SELECT c.pos, n.id, n.file, EXISTS (SELECT 1 FROM calls d WHERE d.src = n.id) AS deeper FROM calls c JOIN nodes n ON n.id = c.dst WHERE c.src = 5")
def q30_callees(spark, sf_dir):
    return render.callees(5, nodes_table(spark, sf_dir), calls_table(spark, sf_dir)).select("pos", "id", "file", "deeper")


@query(f"""WITH {_CALLS}, n AS (SELECT count(*) AS functions, count(*) FILTER (WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS embedded, count(*) FILTER (WHERE doc_id IN (SELECT src FROM calls)) AS with_calls FROM documents)
    SELECT functions, embedded, with_calls, round(100.0 * embedded / functions, 1)::DOUBLE AS coverage FROM n""")
def q31_stats(spark, sf_dir):
    functions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return render.stats(functions, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), calls_table(spark, sf_dir))


@query(f"""WITH {_CALLS}, {_NODES}, {_HITS}, {_INNER}, free AS (SELECT id, similarity FROM hits WHERE id NOT IN (SELECT dst FROM inner_calls)),
    roots AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS root FROM (SELECT * FROM free UNION ALL (SELECT id, similarity FROM hits WHERE NOT EXISTS (SELECT 1 FROM free) ORDER BY similarity DESC, id LIMIT 1))),
    kids AS (SELECT c.dst AS id, r.root, min(c.pos) AS pos FROM roots r JOIN inner_calls c ON c.src = r.id WHERE c.dst NOT IN (SELECT id FROM roots) GROUP BY c.dst, r.root), one AS (SELECT id, root, pos, row_number() OVER (PARTITION BY id ORDER BY root, pos) AS k FROM kids)
    SELECT root, 0 AS pos, id, 0 AS depth FROM roots UNION ALL SELECT root, pos, id, 1 FROM one WHERE k = 1""")
def q32_shallow_tree(spark, sf_dir):
    hits = hits_table(spark, sf_dir)
    return render.shallow_tree(hits, graph.within(hits, calls_table(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CALLS}, {_NODES}, {_HITS}, {_INNER}, r AS (SELECT src AS start, dst AS id FROM inner_calls UNION SELECT r.start, c.dst FROM r JOIN inner_calls c ON c.src = r.id)
    SELECT h.id, (SELECT count(*) FROM r WHERE r.start = h.id) AS descendants FROM hits h""")
def q33_descendants(spark, sf_dir):
    hits = hits_table(spark, sf_dir)
    return graph.descendants(hits, graph.within(hits, calls_table(spark, sf_dir)))


@query(f"""WITH {_CALLS}, {_NODES}, {_HITS}, {_INNER} SELECT (SELECT count(*) FROM hits) AS functions, (SELECT count(*) FROM hits WHERE id NOT IN (SELECT dst FROM inner_calls WHERE src <> dst)) AS entry_points,
    (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM inner_calls)) AS internal_calls, (SELECT count(*) FROM hits WHERE is_bridge) AS bridges""")
def q34_chain_stats(spark, sf_dir):
    return graph.chain_stats(hits_table(spark, sf_dir), calls_table(spark, sf_dir))


# ---------------------------------------------------------------- symbols

#: A fixed table of classes: name, line of ancestors in resolution order.
_MRO = "(VALUES ('ECONOMY', 0, 'ECONOMY'), ('ECONOMY', 1, 'SMALL'), ('ECONOMY', 2, 'LARGE'), ('STANDARD', 0, 'STANDARD'), ('STANDARD', 1, 'LARGE'), ('SMALL', 0, 'SMALL'), ('SMALL', 1, 'LARGE'), ('LARGE', 0, 'LARGE')) m(class, pos, ancestor)"


@query(f"""WITH own AS (SELECT DISTINCT p_type AS class, p_name AS method FROM part WHERE p_size > 40), c AS (SELECT m.class, o.method, m.ancestor, row_number() OVER (PARTITION BY m.class, o.method ORDER BY m.pos) AS r FROM {_MRO} JOIN own o ON o.class = m.ancestor)
    SELECT class, method, ancestor FROM c WHERE r = 1""")
def q35_mro_methods(spark, sf_dir):
    mro = spark.sql(f"SELECT * FROM {_MRO.replace('m(class', 'AS m(class')}")
    own = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_type").alias("class"), F.col("p_name").alias("method")).distinct()
    return symbols.methods_in_mro(mro, own)


@query("""WITH e AS (SELECT DISTINCT 'pkg.' || source AS export_key, 'pkg.' || source || '._impl' AS real_path FROM documents UNION SELECT DISTINCT 'pkg.' || source || '.' || lang, 'other.' || lang FROM documents WHERE lang <> 'de'),
    p AS (SELECT doc_id, 'pkg.' || source || '.__init__.' || lang || '.f' || CAST(doc_id % 3 AS VARCHAR) AS path FROM documents), n AS (SELECT doc_id, path, replace(replace(path, '.__init__.', '.'), '.__init__', '') AS norm FROM p),
    m AS (SELECT doc_id, real_path || substr(norm, length(export_key) + 1) AS target, row_number() OVER (PARTITION BY doc_id ORDER BY length(export_key) DESC) AS r FROM n JOIN e ON norm = export_key OR starts_with(norm, export_key || '.'))
    SELECT n.doc_id, coalesce(m.target, n.path) AS target FROM n LEFT JOIN m ON m.doc_id = n.doc_id AND m.r = 1""")
def q36_exports(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.select(F.concat(F.lit("pkg."), "source").alias("export_key"), F.concat(F.lit("pkg."), "source", F.lit("._impl")).alias("real_path"))
    b = d.where("lang <> 'de'").select(F.concat(F.lit("pkg."), "source", F.lit("."), "lang").alias("export_key"), F.concat(F.lit("other."), "lang").alias("real_path"))
    paths = d.select("doc_id", F.concat(F.lit("pkg."), "source", F.lit(".__init__."), "lang", F.lit(".f"), (F.col("doc_id") % 3).cast("string")).alias("path"))
    return symbols.through_exports(paths, a.unionByName(b).distinct(), "doc_id")


@query("""WITH f AS (SELECT p_brand || '.' || p_name AS id, p_name || CASE WHEN p_size = 7 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS name FROM part), u AS (SELECT name, min(id) AS id FROM f GROUP BY name HAVING count(*) = 1) SELECT name, id FROM u WHERE name NOT IN ('append', 'get', 'update')""")
def q37_unique_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("."), "p_name").alias("id"), F.concat("p_name", F.when(F.col("p_size") == 7, F.col("p_partkey").cast("string")).otherwise("")).alias("name"))
    return symbols.unique_names(p)


@query("""WITH d AS (SELECT p_partkey AS id, ['@' || p_brand, 'staticmethod', p_type || '(1)'] AS ds FROM part), u AS (SELECT id, generate_subscripts(ds, 1) AS i, trim(string_split(replace(unnest(ds), '@', ''), '(')[1]) AS d FROM d),
    k AS (SELECT * FROM u WHERE d NOT IN ('staticmethod', 'classmethod', 'property', 'abstractmethod', 'dataclass', 'contextmanager', 'lru_cache', 'cached_property'))
    SELECT id, d AS caller, coalesce(lead(d) OVER (PARTITION BY id ORDER BY i), CAST(id AS VARCHAR)) AS callee FROM k""")
def q38_decorator_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array(F.col("p_brand"), F.lit("staticmethod"), F.concat("p_type", F.lit("(1)"))).alias("decorators"))
    return symbols.decorator_edges(p).select(F.col("id").cast("long").alias("id"), "caller", "callee")


# ---------------------------------------------------------------- changes

@query("""WITH e AS (SELECT ts, CAST(user_id AS VARCHAR) AS path, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'changed' END AS change, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) < INTERVAL 100 SECOND THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e), b AS (SELECT *, min(ts) OVER (PARTITION BY g) AS started FROM s)
    SELECT started, path, arg_max(change, ts) AS change FROM b GROUP BY started, path""")
def q39_debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("changed").alias("change"))
    return incremental.debounced(e, "100 seconds")


@query(f"""WITH {_CALLS}, gone AS (SELECT p_partkey AS id FROM part WHERE p_size = 13) SELECT src, count(*) AS n, count(DISTINCT dst) AS n_distinct FROM calls WHERE dst NOT IN (SELECT id FROM gone) GROUP BY src""")
def q40_reverse_edges(spark, sf_dir):
    gone = table(spark, sf_dir, "part").where("p_size = 13").select(F.col("p_partkey").alias("id"))
    kept = incremental.without_calls_to(calls_table(spark, sf_dir), gone)
    return kept.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("n_distinct"))


@query()
def q41_search(spark, sf_dir):
    """The whole search: hybrid hits, rerank, expansion, bridges, chains, pruning, merging."""
    from .search import search_tables

    return search_tables(spark, sf_dir, QUERY)


# ---------------------------------------------------------------- parsing and resolution


def _sources(spark, sf_dir, template: str) -> DataFrame:
    """A Python file for each part, with its key and size put in."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    return p.select(F.concat(F.lit("lib/p"), key, F.lit(".py")).alias("path"), F.replace(F.replace(F.lit(template), F.lit("KEY"), key), F.lit("SIZE"), size).alias("content"))


@query("""SELECT 'lib.p' || p_partkey || '.C' || p_size || '.run' AS id, 'Helper' || p_size || ',len,x.__len__,h.step,self.done,self.done.forward' AS calls, 'Helper' || p_size AS type_of_h, '@iter:xs' AS source_of_x, 'Base' || p_size AS bases, 2 AS line FROM part""")
def q43_parse(spark, sf_dir):
    files = _sources(spark, sf_dir, "class CSIZE(BaseSIZE):\n    def run(self, xs):\n        h = HelperSIZE()\n        for x in xs:\n            h.step(len(x))\n        return self.done(h)\n")
    rows = parse.parsed(files)
    f, c = F.col("functions")[0], F.col("classes")[0]
    return rows.select(f["id"].alias("id"), F.array_join(f["calls"], ",").alias("calls"), f["var_types"]["h"][0].alias("type_of_h"), f["var_sources"]["x"].alias("source_of_x"), c["superclasses"][0].alias("bases"), f["start_line"].alias("line"))


@query("""SELECT 'lib.p' || p_partkey || '.f' || p_partkey AS id, 'lib.p' || p_partkey || '.g' || p_partkey || ',lib.p' || p_partkey || '.K' || p_partkey || '.only_' || p_partkey || ',lib.p' || p_partkey || '.K' || p_partkey || '.__init__' AS calls FROM part
    UNION ALL SELECT 'lib.p' || p_partkey || '.g' || p_partkey, '' FROM part UNION ALL SELECT 'lib.p' || p_partkey || '.K' || p_partkey || '.only_' || p_partkey, 'lib.p' || p_partkey || '.K' || p_partkey || '.__init__' FROM part
    UNION ALL SELECT 'lib.p' || p_partkey || '.K' || p_partkey || '.__init__', 'lib.p' || p_partkey || '.g' || p_partkey FROM part""")
def q44_resolve(spark, sf_dir):
    files = _sources(spark, sf_dir, "def fKEY(a):\n    gKEY()\n    a.b.only_KEY()\n    KKEY()\n\ndef gKEY():\n    pass\n\nclass KKEY:\n    def __init__(self):\n        gKEY()\n    def only_KEY(self):\n        self.__init__()\n")
    return _resolved(files)


@query("""SELECT 'pkg' || p_partkey || '.b' || p_size AS export_key, 'pkg' || p_partkey || '.m' || p_size || '.a' AS real_path FROM part UNION ALL SELECT 'pkg' || p_partkey || '.c', 'pkg' || p_partkey || '.m' || p_size || '.c' FROM part""")
def q45_package_exports(spark, sf_dir):
    files = _sources(spark, sf_dir, "from .mSIZE import (a as bSIZE,  # kept\n    c)\nfrom ..up import d\n")
    return symbols.package_exports(files.withColumn("path", F.regexp_replace("path", r"^lib/p(\d+)\.py$", r"pkg$1/__init__.py")))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'r.' || source || '.u' WHEN doc_id % 4 = 1 THEN 'r.u' WHEN doc_id % 4 = 2 THEN 'r' END AS target FROM documents""")
def q46_relative_imports(spark, sf_dir):
    i = F.col("doc_id") % 4
    text = F.when(i == 0, ".u").when(i == 1, "..u").when(i == 2, "..").otherwise(".....u")
    return table(spark, sf_dir, "documents").select("doc_id", symbols.relative_module(text, F.concat(F.lit("r."), "source", F.lit("."), "lang")).alias("target"))


@query()
def q47_merged_chains(spark, sf_dir):
    rows, calls = _chain_rows(spark, sf_dir)
    return graph.merge(rows, calls, 0.3)


@query()
def q48_topological(spark, sf_dir):
    rows, calls = _chain_rows(spark, sf_dir)
    return graph.topological(rows, calls)


@query()
def q49_embedding(spark, sf_dir):
    return embedding.embedded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), embedding.HashEmbedder())


@query(f"""WITH w AS (SELECT list_distinct(string_split('{QUERY.lower()}', ' ')) AS ws), d AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ts FROM documents)
    SELECT id, round(len(list_intersect(ws, ts))::DOUBLE / len(ws), 4) AS similarity FROM d, w""")
def q50_rerank(spark, sf_dir):
    return embedding.reranked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document")), QUERY)


#: Fixed value: files that one task parses.
FILES_A_TASK = 4_000


def _resolved(files: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """id, calls of the functions in files(path, content)."""
    # A small table makes many files: they are dealt out, and parsed once.
    tasks = -(-files.count() // FILES_A_TASK)
    done = resolve.calls_of_files(files.repartition(max(1, tasks), "path"), exports)
    return done.select("id", F.array_join("calls", ",").alias("calls"))


def _expected(*rows: tuple[str, str]) -> str:
    """SQL of one row a part for each (id, calls); KEY is the part's key."""
    put = lambda t: "replace('" + t + "', 'KEY', CAST(p_partkey AS VARCHAR))"
    return " UNION ALL ".join(f"SELECT {put(i)} AS id, {put(c)} AS calls FROM part" for i, c in rows)


@query("""WITH p AS (SELECT 'lib.p' || p_partkey AS m, CAST(p_size AS VARCHAR) AS s FROM part), x AS (SELECT m, s, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos FROM p)
    SELECT m || '.f' AS id, pos, ['a', 'b', NULL, 'c', '*args', 'd', 'e', '**kw'][pos + 1] AS name, [NULL, 'int', NULL, NULL, 'str', NULL, 'list[int]', 'float'][pos + 1] AS type, [NULL, s, NULL, '"x' || s || '"', NULL, NULL, 'None', NULL][pos + 1] AS value FROM x
    UNION ALL SELECT m || '.g', pos, ['p', NULL, 'q'][pos + 1], NULL, [NULL, NULL, s][pos + 1] FROM x WHERE pos < 3""")
def q51_parameters(spark, sf_dir):
    files = _sources(spark, sf_dir, 'def f(a, b: int = SIZE, /, c="xSIZE", *args: str, d, e: list[int] = None, **kw: float):\n    pass\n\nasync def g(p, *, q=SIZE):\n    pass\n')
    rows = parse.functions_of(parse.parsed(files)).select("id", F.posexplode("parameters").alias("pos", "p"))
    return rows.select("id", "pos", "p.name", "p.type", "p.value")


@query("""WITH p AS (SELECT 'lib.p' || p_partkey AS m, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS s FROM part), d AS (SELECT *, 'About ' || s || '.' AS doc FROM p)
    SELECT m || '.C' || k || '.run' AS id, 'C' || k AS class_name, NULL AS nested, 'staticmethod;deco(' || s || ')' AS decorators, doc AS module_docstring, repeat('"', 3) || 'Class ' || s || '.' || repeat('"', 3) AS class_docstring FROM d
    UNION ALL SELECT m || '.C' || k || '.run.inner', 'C' || k, 'run', '', doc, repeat('"', 3) || 'Class ' || s || '.' || repeat('"', 3) FROM d UNION ALL SELECT m || '.top', NULL, NULL, '', doc, NULL FROM d UNION ALL SELECT m || '.top.low', NULL, 'top', '', doc, NULL FROM d""")
def q52_context(spark, sf_dir):
    files = _sources(spark, sf_dir, '"""About SIZE."""\n\nclass CKEY:\n    """Class SIZE."""\n    @staticmethod\n    @deco(SIZE)\n    def run():\n        def inner():\n            pass\n\nasync def top():\n    def low():\n        pass\n')
    rows = parse.functions_of(parse.parsed(files))
    return rows.select("id", "class_name", "nested", F.array_join("decorators", ";").alias("decorators"), "module_docstring", "class_docstring")


@query("""WITH p AS (SELECT 'lib/p' || p_partkey || '.py' AS file_path, CAST(p_partkey AS VARCHAR) AS k FROM part) SELECT file_path, unnest(['np' || k, 'c', 'e' || k, 'x', 'y' || k, 'z' || k, 'w' || k]) AS alias, unnest(['numpy', 'a.b.c', 'a.b.d', 'lib.sib.x', 'up.y' || k, 'lib.z' || k, 'late.w' || k]) AS target FROM p""")
def q53_imports(spark, sf_dir):
    files = _sources(spark, sf_dir, "import os\nimport numpy as npKEY\nfrom a.b import c, d as eKEY\nfrom .sib import x\nfrom ..up import yKEY\nfrom . import zKEY\nfrom ... import far\nfrom m import *\n\ndef f():\n    from late import wKEY\n")
    return parse.imports_of(parse.parsed(files)).select("file_path", "alias", "target")


@query("""SELECT 'lib.p' || p_partkey || '.C.run' AS id, 'open_' || p_size || ',apply,handle_' || p_partkey || ',mod.hook_' || p_size || ',rank_' || p_size || ',self.on_done' AS calls, 'open_' || p_size AS type_of_fh FROM part""")
def q54_references(spark, sf_dir):
    files = _sources(spark, sf_dir, "class C:\n    def run(self, items, cb):\n        with open_SIZE(items) as fh:\n            apply(cb, handle_KEY, mod.hook_SIZE, key=rank_SIZE, other=skip)\n        return self.on_done, self.limit > SIZE\n")
    f = F.col("functions")[0]
    return parse.parsed(files).select(f["id"].alias("id"), F.array_join(f["calls"], ",").alias("calls"), f["var_types"]["fh"][0].alias("type_of_fh"))


@query(_expected(("lib.pKEY.BaseKEY.go", "lib.pKEY.BaseKEY.get_it"), ("lib.pKEY.BaseKEY.get_it", ""), ("lib.pKEY.SubKEY.go", "lib.pKEY.BaseKEY.go,lib.pKEY.SubKEY.get_it"), ("lib.pKEY.SubKEY.get_it", "")))
def q55_super(spark, sf_dir):
    """The parent's method, and the child's override of what that calls on self."""
    return _resolved(_sources(spark, sf_dir, "class BaseKEY:\n    def go(self):\n        self.get_it()\n    def get_it(self):\n        pass\n\nclass SubKEY(BaseKEY):\n    def go(self):\n        super().go()\n    def get_it(self):\n        pass\n"))


@query(_expected(("lib.pKEY.CKEY.__init__", ""), ("lib.pKEY.CKEY.make", "lib.pKEY.CKEY.load,lib.pKEY.CKEY.__init__"), ("lib.pKEY.CKEY.load", "")))
def q56_cls(spark, sf_dir):
    return _resolved(_sources(spark, sf_dir, "class CKEY:\n    def __init__(self):\n        pass\n    @classmethod\n    def make(cls):\n        cls.load()\n        return cls()\n    @classmethod\n    def load(cls):\n        pass\n"))


@query(_expected(("lib.pKEY.WKEY.__init__", ""), ("lib.pKEY.WKEY.spin", ""), ("lib.pKEY.VKEY.__init__", ""), ("lib.pKEY.VKEY.spin", ""), ("lib.pKEY.all_KEY", ""), ("lib.pKEY.use_KEY", "lib.pKEY.WKEY.__init__,lib.pKEY.WKEY.spin,lib.pKEY.all_KEY,lib.pKEY.WKEY.spin,lib.pKEY.WKEY.__init__,lib.pKEY.VKEY.__init__")))
def q57_variables(spark, sf_dir):
    """Variables of a known type, items of a call's annotated result, a class chosen by a condition."""
    classes = "".join(f"class {c}KEY:\n    def __init__(self):\n        pass\n    def spin(self):\n        pass\n\n" for c in "WV")
    return _resolved(_sources(spark, sf_dir, classes + "def all_KEY() -> list[WKEY]:\n    pass\n\ndef use_KEY(flag):\n    v = WKEY()\n    v.spin()\n    for u in all_KEY():\n        u.spin()\n    g = WKEY if flag else VKEY\n    g()\n"))


@query(_expected(("lib.pKEY.use_KEY", "lib.qKEY.help_KEY,lib.qKEY.TKEY.__init__,lib.qKEY.help_KEY,lib.gKEY.impl.real_KEY"), ("lib.qKEY.help_KEY", ""), ("lib.qKEY.TKEY.__init__", ""), ("lib.gKEY.impl.real_KEY", "")))
def q58_imported_calls(spark, sf_dir):
    """Imports under another name, of a class, of a module, and through a package's re-export."""
    at = lambda path, text: _sources(spark, sf_dir, text).withColumn("path", F.regexp_replace("path", r"^lib/p(\d+)\.py$", path))
    use = at("lib/p$1.py", "from lib.qKEY import help_KEY as h_KEY, TKEY as UKEY\nfrom lib import qKEY as qq\nfrom lib.gKEY import shown_KEY as s_KEY\n\ndef use_KEY():\n    h_KEY()\n    UKEY()\n    qq.help_KEY()\n    s_KEY()\n")
    files = use.unionByName(at("lib/q$1.py", "def help_KEY():\n    pass\n\nclass TKEY:\n    def __init__(self):\n        pass\n"))
    files = files.unionByName(at("lib/g$1/__init__.py", "from .impl import real_KEY as shown_KEY\n")).unionByName(at("lib/g$1/impl.py", "def real_KEY():\n    pass\n"))
    return _resolved(files, symbols.package_exports(files))


@query(_expected(("lib.pKEY.AKEY.get_it", ""), ("lib.pKEY.CKEY.get_it", ""), ("lib.pKEY.DKEY.run", "lib.pKEY.CKEY.get_it"), ("lib.pKEY.BKEY.run", "lib.pKEY.AKEY.get_it")))
def q59_linear_order(spark, sf_dir):
    """A diamond of classes: the second parent comes before the ancestor that both share."""
    return _resolved(_sources(spark, sf_dir, "class AKEY:\n    def get_it(self):\n        pass\n\nclass BKEY(AKEY):\n    def run(self):\n        self.get_it()\n\nclass CKEY(AKEY):\n    def get_it(self):\n        pass\n\nclass DKEY(BKEY, CKEY):\n    def run(self):\n        self.get_it()\n"))


@query(f"""WITH {_CALLS}, n AS (SELECT p_partkey AS id, p_partkey % 97 AS community FROM part), own AS (SELECT DISTINCT c.src, c.dst FROM calls c JOIN n a ON a.id = c.src JOIN n b ON b.id = c.dst WHERE a.community = b.community),
    f AS (SELECT n.community, n.id, (SELECT count(*) FROM own WHERE src = n.id) AS out_degree FROM n WHERE n.id NOT IN (SELECT dst FROM own)), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY out_degree DESC, id) AS rank FROM f)
    SELECT community, rank, id, out_degree FROM r WHERE rank <= 5""")
def q60_module_entries(spark, sf_dir):
    n = nodes_table(spark, sf_dir)
    return graph.module_entries(n.select("id", (F.col("id") % 97).alias("community")), n, calls_table(spark, sf_dir))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || p_size END AS name FROM part")
def q61_superclass_name(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" [list[T]]"))).otherwise(F.concat(F.lit(" "), "p_brand", size))
    return table(spark, sf_dir, "part").select("p_partkey", names.superclass_name(text).alias("name"))
