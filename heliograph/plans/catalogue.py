"""Named queries over the test tables, each with the same thing said in SQL where SQL can say it.

Roles of the tables: documents are annotated items (text: summary, lang: scene, source: style), embeddings are their
vectors (vec_id = doc_id), benchmark items are queries, labels are judgments, events are logs, conversations stories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.functions.aliases import Catalog
from heliograph.functions.payloads import as_list, strict
from heliograph.functions.vectors import dot, l2_normalize, norm, truncated
from heliograph.operators import adapters, delivery, dense, documents, filters, fusion, judging, lexical, manifest, metrics, parsing, rerank, routing, story
from heliograph.plans.search import Searcher
from heliograph.sources import readers, tables
from heliograph.streaming import incremental

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
K = 10
WEIGHTS = {"image": 0.4, "text": 0.3, "bm25": 0.3}
#: An example catalog over the test tables' languages and sources.
CATALOG = Catalog(
    aliases={"english": ["en"], "french": ["fr"], "german": ["de"], "spanish": ["es"], "zero": ["src0"], "one": ["src1"]},
    fields={"scene": ["english", "french", "german", "spanish"], "style": ["zero", "one"]},
    prefixes=["no", "without"], exceptions=["nota"],
)


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def annotations(spark, sf) -> DataFrame:
    """Documents in the shape of annotations; time and weather, counts and colors follow from the id."""
    d = read(spark, sf, "documents")
    times, weathers = F.array(*map(F.lit, ("morning", "noon", "evening", "night"))), F.array(*map(F.lit, ("sunny", "rain")))
    none = T.none_of_strings()
    return d.select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("summary"), F.array(F.concat(F.lit("thing"), (F.col("doc_id") % 5).cast("string"))).alias("objects"),
        F.array(F.struct(F.concat(F.lit("thing"), (F.col("doc_id") % 5).cast("string")).alias("name"), (F.col("doc_id") % 4).cast("int").alias("count"))).alias("object_counts"),
        none.alias("actions"), F.col("lang").alias("scene"), F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.lit("time_of_day:"), F.get(times, (F.col("doc_id") % 4).cast("int"))), F.concat(F.lit("weather:"), F.get(weathers, (F.col("doc_id") % 2).cast("int"))))).otherwise(none).alias("attributes"),
        none.alias("spatial_relations"), F.array("source").alias("style"), none.alias("mood"), F.array(F.concat(F.lit("c"), (F.col("doc_id") % 7).cast("string"))).alias("colors"), none.alias("ocr_text"),
    )


_ANN_SQL = """ann AS (SELECT doc_id AS item_id, text AS summary, 'thing' || (doc_id % 5) AS object, doc_id % 4 AS cnt, lang AS scene, source AS style, 'c' || (doc_id % 7) AS color,
  CASE WHEN doc_id % 3 <> 0 THEN (['morning','noon','evening','night'])[doc_id % 4 + 1] END AS tod, CASE WHEN doc_id % 3 <> 0 THEN (['sunny','rain'])[doc_id % 2 + 1] END AS weather FROM documents)"""


def items(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")


def asked(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf) -> DataFrame:
    return tables.spread(read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")))


def query_vectors(spark, sf) -> DataFrame:
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    return b.join(vectors(spark, sf).withColumnRenamed("item_id", "query_id"), "query_id")


# --- manifests ---------------------------------------------------------------------------------------------------


def _manifest(spark, sf) -> DataFrame:
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("split"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").cast("long").alias("size_bytes"), (F.col("doc_id") % 50 != 7).alias("valid"))
    return manifest.mark_duplicates(d)


_MAN_SQL = """m0 AS (SELECT doc_id AS item_id, lang AS split, sha256(text) AS sha256, length(text)::BIGINT AS size_bytes, doc_id % 50 <> 7 AS valid FROM documents),
m AS (SELECT *, nullif(min(item_id) OVER (PARTITION BY sha256), item_id) AS duplicate_of FROM m0)"""


@query("dedup_first_by_hash", f"WITH {_MAN_SQL} SELECT item_id, sha256, duplicate_of FROM m")
def _(spark, sf):
    """WIN-02, SRC-03, HSH-01."""
    return _manifest(spark, sf).select("item_id", "sha256", "duplicate_of")


@query("dedup_cross_split", f"""WITH {_MAN_SQL}, r AS (SELECT *, min(item_id) OVER (PARTITION BY sha256, split) AS i,
 first_value(item_id) OVER (PARTITION BY sha256 ORDER BY CASE split WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, item_id) AS o FROM m0)
 SELECT item_id, split, coalesce(nullif(i, item_id), nullif(o, item_id)) AS duplicate_of FROM r""")
def _(spark, sf):
    """WIN-03."""
    rank = F.when(F.col("split") == "en", 0).when(F.col("split") == "fr", 1).when(F.col("split") == "de", 2).otherwise(3)
    return manifest.mark_across(_manifest(spark, sf).drop("duplicate_of"), rank).select("item_id", "split", "duplicate_of")


@query("manifest_quality", f"WITH {_MAN_SQL} SELECT count(*)::BIGINT AS items, count_if(valid)::BIGINT AS valid, count_if(NOT valid)::BIGINT AS invalid, count(duplicate_of)::BIGINT AS duplicates, sum(size_bytes)::BIGINT AS bytes FROM m")
def _(spark, sf):
    """AGG-20, SNK-01."""
    return manifest.quality(_manifest(spark, sf))


@query("image_only_scan", f"WITH {_MAN_SQL} SELECT item_id, sha256, '' AS summary FROM m WHERE valid AND duplicate_of IS NULL AND split = 'en'")
def _(spark, sf):
    """SRC-06, PRJ-07, DRV-05."""
    kept = manifest.usable(_manifest(spark, sf), "en")
    return kept.select("item_id", "sha256").join(documents.placeholders(kept).select("item_id", "summary"), "item_id")


@query("reconcile_full_outer", """SELECT item_id, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a <> b THEN 'mismatched' ELSE 'matched' END AS status FROM
 (SELECT coalesce(x.doc_id, y.doc_id) AS item_id, x.q AS a, y.q AS b FROM (SELECT doc_id, n_chars % 2 AS q FROM documents) x FULL JOIN (SELECT doc_id, quality::BIGINT AS q FROM labels) y ON x.doc_id = y.doc_id)""")
def _(spark, sf):
    """JOI-04, SET-01, SET-02."""
    a = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") % 2).alias("q"))
    b = read(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").cast("long").alias("q"))
    return manifest.reconcile(a, b, ("q",))


@query("resume_anti_join", f"WITH {_MAN_SQL} SELECT item_id FROM m WHERE valid AND item_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    """FLT-12."""
    return manifest.pending(_manifest(spark, sf), read(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))).select("item_id")


@query("explicit_selection", "SELECT p.p_partkey AS item_id, d.doc_id IS NOT NULL AS found FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey")
def _(spark, sf):
    """FLT-13, FLT-14: ids that are asked for, those that exist and those that don't."""
    wanted = read(spark, sf, "part").select(F.col("p_partkey").alias("item_id"))
    there, lacking = manifest.selected(items(spark, sf), wanted)
    return there.select("item_id", F.lit(True).alias("found")).unionByName(lacking.select("item_id", F.lit(False).alias("found")))


@query("import_join", """WITH r AS (SELECT 'raw_' || doc_id AS raw_id, doc_id AS line, doc_id % 97 AS n FROM labels), k AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY line) AS k FROM r)
 SELECT 'x' || n AS raw_id, line, CASE WHEN n >= 90 THEN 'not in manifest' WHEN k > 1 THEN 'repeated' ELSE 'imported' END AS status FROM k""")
def _(spark, sf):
    """JOI-03, SNK-11: raw rows meet items by the number in their ids."""
    raw = read(spark, sf, "labels").select(F.concat(F.lit("x"), (F.col("doc_id") % 97).cast("string")).alias("raw_id"), F.col("doc_id").alias("line"))
    man = spark.range(90).select(F.concat(F.lit("item-"), F.col("id").cast("string")).alias("item_id"))
    good, bad = manifest.imported(raw, man)
    return good.select("raw_id", "line", F.lit("imported").alias("status")).unionByName(bad.select("raw_id", "line", F.col("error").alias("status")))


@query("id_order", "SELECT c_name AS item_id, row_number() OVER (ORDER BY regexp_replace(c_name, '[0-9]+$', ''), TRY_CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), c_name)::BIGINT AS place FROM customer")
def _(spark, sf):
    """TOP-07. The place is what a test can see of an order."""
    c = read(spark, sf, "customer").select(F.col("c_name").alias("item_id"))
    return manifest.placed(manifest.in_id_order(c)).select("item_id", "place")


@query("id_digest", "SELECT sha256(string_agg(item_id::VARCHAR, chr(10) ORDER BY item_id::VARCHAR)) AS digest, count(*)::BIGINT AS n FROM benchmark")
def _(spark, sf):
    """AGG-19, SNK-05."""
    return manifest.id_digest(read(spark, sf, "benchmark"))


@query("mock_rotation", """WITH n AS (SELECT count(*) AS n FROM documents), q AS (SELECT item_id AS query_id, ('0x' || substr(sha256(text), 1, 8))::BIGINT AS h FROM benchmark), i AS (SELECT unnest(range(0, 10)) AS i)
 SELECT query_id, (h % n.n + i) % n.n AS item_id, (i + 1)::BIGINT AS rank, round(1.0::DOUBLE / (i + 1), 6) AS score FROM q, n, i""")
def _(spark, sf):
    """SRC-12; ids are the places here."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("position"))
    return readers.rotated(d, asked(spark, sf), d.count()).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# --- projections and text ----------------------------------------------------------------------------------------


@query("label_document", f"""WITH {_ANN_SQL} SELECT item_id, '摘要:' || summary || ' ' || rest AS dense, rest || ' 摘要:' || summary AS sparse FROM (SELECT *,
 concat_ws(' ', '主体:' || object, '数量:' || object || ':' || cnt, '场景:' || scene, '时间:' || tod, '天气:' || weather, '属性:' || ('time_of_day:' || tod || ' weather:' || weather), '风格:' || style, '颜色:' || color) AS rest FROM ann)""")
def _(spark, sf):
    """PRJ-01 to PRJ-05."""
    f = documents.fields(annotations(spark, sf))
    return f.select("item_id", documents.dense_document().alias("dense"), documents.sparse_document().alias("sparse"))


def _sentences(spark, sf) -> DataFrame:
    """Documents as query sentences, with a phrase that depends on the id."""
    phrase = F.get(F.array(*map(F.lit, ("no english", "without any thing", "'quoted term'", "zero one", "nota en"))), (F.col("doc_id") % 5).cast("int"))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", F.col("source"), phrase).alias("text"))


_SEN_SQL = """s AS (SELECT doc_id AS query_id, source || ' ' || (['no english', 'without any thing', '''quoted term''', 'zero one', 'nota en'])[doc_id % 5 + 1] AS text FROM documents),
 t AS (SELECT *, replace(regexp_replace(lower(text), '\\s+', '', 'g'), 'nota', '') AS low FROM s)"""


@query("alias_find", f"""WITH {_SEN_SQL} SELECT query_id, concat_ws(',', CASE WHEN low LIKE '%english%' OR low LIKE '%en%' THEN 'english' END, CASE WHEN low LIKE '%french%' OR low LIKE '%fr%' THEN 'french' END, CASE WHEN low LIKE '%german%' OR low LIKE '%de%' THEN 'german' END,
 CASE WHEN low LIKE '%spanish%' OR low LIKE '%es%' THEN 'spanish' END, CASE WHEN low LIKE '%zero%' OR low LIKE '%src0%' THEN 'zero' END, CASE WHEN low LIKE '%one%' OR low LIKE '%src1%' THEN 'one' END) AS terms FROM t""")
def _(spark, sf):
    """STR-01 to STR-04."""
    return _sentences(spark, sf).select("query_id", F.array_join(CATALOG.find(F.col("text")), ",").alias("terms"))


@query("negation_find", f"""WITH {_SEN_SQL} SELECT query_id, CASE WHEN regexp_matches(low, '(no|without)(有|任何|的)?(english|en)') THEN 'english' ELSE '' END AS excluded FROM t""")
def _(spark, sf):
    """STR-05."""
    return _sentences(spark, sf).select("query_id", F.array_join(CATALOG.find_excluded(F.col("text")), ",").alias("excluded"))


@query("negation_remove", f"""WITH {_SEN_SQL} SELECT query_id, CASE WHEN regexp_matches(low, '(no|without)(有|任何|的)?(english|en)') THEN trim(regexp_replace(text, '(?i)(no|without)\\s*(有|任何|的)?\\s*(english|en)', '', 'g')) ELSE text END AS semantic FROM t""")
def _(spark, sf):
    """STR-06."""
    s = _sentences(spark, sf)
    return s.select("query_id", CATALOG.remove_negative(F.col("text"), CATALOG.find_excluded(F.col("text"))).alias("semantic"))


@query("quoted_terms", f"WITH {_SEN_SQL} SELECT query_id, array_to_string(regexp_extract_all(text, '''([^'']+)''', 1), '|') AS quoted FROM s")
def _(spark, sf):
    """STR-07."""
    return _sentences(spark, sf).select("query_id", F.array_join(T.quoted_terms(F.col("text")), "|").alias("quoted"))


def _counts(spark, sf) -> DataFrame:
    p = F.get(F.array(*map(F.lit, ("至少{}辆车", "{}个人在户外", "最多 {} 只狗", "蓝天下的高楼", "二十三张汽车", "三名游客"))), (F.col("doc_id") % 6).cast("int"))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.replace(p, F.lit("{}"), (F.col("doc_id") % 17).cast("string")).alias("text"))


@query("count_phrase", """SELECT doc_id AS query_id, (['车','人','狗',NULL,'汽车','游客'])[doc_id % 6 + 1] AS target, (CASE doc_id % 6 WHEN 3 THEN NULL WHEN 4 THEN 23 WHEN 5 THEN 3 ELSE doc_id % 17 END)::INTEGER AS value, (['gte','eq','lte',NULL,'eq','eq'])[doc_id % 6 + 1] AS operator FROM documents""")
def _(spark, sf):
    """STR-08, STR-09."""
    return _counts(spark, sf).select("query_id", T.count_phrase(F.col("text")).alias("c")).select("query_id", "c.target", "c.value", "c.operator")


@query("query_type", """SELECT doc_id AS query_id, (['count','count','count','simple','count','count'])[doc_id % 6 + 1] AS query_type, (['汽车','人物','狗','','汽车','人物'])[doc_id % 6 + 1] AS objects, CASE WHEN doc_id % 6 = 1 THEN '室外' ELSE '' END AS scene FROM documents""")
def _(spark, sf):
    """STR-10, SEA-08."""
    return parsing.parse(_counts(spark, sf)).select("query_id", "query_type", F.array_join("objects", ",").alias("objects"), F.array_join("scene", ",").alias("scene"))


@query("query_document", """SELECT doc_id AS query_id, t || CASE doc_id % 6 WHEN 3 THEN ' 颜色:蓝色' ELSE ' 主体:' || (['汽车','人物','狗','','汽车','人物'])[doc_id % 6 + 1] || ' 数量:' || (['汽车:gte:','人物:eq:','狗:lte:','','汽车:eq:','人物:eq:'])[doc_id % 6 + 1] || (CASE doc_id % 6 WHEN 4 THEN 23 WHEN 5 THEN 3 ELSE doc_id % 17 END) || CASE WHEN doc_id % 6 = 1 THEN ' 场景:室外' ELSE '' END END AS document
 FROM (SELECT doc_id, replace((['至少{}辆车', '{}个人在户外', '最多 {} 只狗', '蓝天下的高楼', '二十三张汽车', '三名游客'])[doc_id % 6 + 1], '{}', (doc_id % 17)::VARCHAR) AS t FROM documents)""")
def _(spark, sf):
    """PRJ-06."""
    parsed = parsing.parse(_counts(spark, sf))
    return parsed.select("query_id", documents.query_document(parsed.columns).alias("document"))


@query("intent_route", """SELECT conv_id, turn, CASE WHEN regexp_matches(t, '游记|故事|日记|朋友圈文案') THEN 'story' WHEN regexp_matches(t, '补图|生成图片|画一张|插图') THEN 'generate' WHEN regexp_matches(t, '什么|哪些|是否|有没有|为什么') THEN 'qa' ELSE 'search' END AS intent
 FROM (SELECT conv_id, turn, text || (['写成故事', '画一张', '什么', ''])[(conv_id + turn) % 4 + 1] AS t FROM conversations)""")
def _(spark, sf):
    """STR-12."""
    add = F.get(F.array(*map(F.lit, ("写成故事", "画一张", "什么", ""))), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    return read(spark, sf, "conversations").select("conv_id", "turn", T.intent(F.concat("text", add)).alias("intent"))


_BUCKET = "CASE WHEN regexp_matches({0}, '黎明|凌晨|日出|dawn|sunrise') THEN 0 WHEN regexp_matches({0}, '早晨|清晨|上午|morning') THEN 1 WHEN regexp_matches({0}, '中午|正午|noon|midday') THEN 2 WHEN regexp_matches({0}, '下午|afternoon') THEN 3 WHEN regexp_matches({0}, '黄昏|傍晚|日落|dusk|sunset|evening') THEN 4 WHEN regexp_matches({0}, '夜晚|夜间|夜景|深夜|night') THEN 5 ELSE 6 END"


@query("time_bucket", f"WITH {_ANN_SQL} SELECT item_id, ({_BUCKET.format('t')})::INTEGER AS bucket FROM (SELECT item_id, lower(concat_ws(' ', scene, summary, tod)) AS t FROM ann)")
def _(spark, sf):
    """STR-13."""
    a = documents.fields(annotations(spark, sf))
    return a.select("item_id", story.bucket_of(F.col("scene"), F.col("summary"), F.array_join("f.time_of_day", " ")).alias("bucket"))


@query("citations", "SELECT conv_id, turn, CASE WHEN conv_id = turn THEN turn::VARCHAR ELSE turn || ',' || conv_id END AS cited, CASE WHEN conv_id <> turn AND conv_id % 2 = 1 THEN 'outside the evidence' END AS error FROM conversations ")
def _(spark, sf):
    """STR-14."""
    c = read(spark, sf, "conversations")
    a, b = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    said = F.concat("text", F.lit("[img_"), a, F.lit("] again [img_"), b, F.lit("][img_"), a, F.lit("]"))
    allowed = F.when(F.col("conv_id") % 2 == 1, F.array(a)).otherwise(F.array(a, b))
    return c.select("conv_id", "turn", T.checked_citations(said, F.array().cast("array<string>"), allowed, F.lit(False)).alias("r")).select("conv_id", "turn", F.array_join("r.cited", ",").alias("cited"), "r.error")


@query("tokenize_counts", r"SELECT token, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)) AS token FROM documents) GROUP BY 1")
def _(spark, sf):
    """STR-11. A document gives its tokens and, once more, its distinct ones; one aggregation merges both on the map side."""
    t = tables.spread(items(spark, sf)).select(T.tokens(F.col("text")).alias("t"))
    entry = lambda n, docs: lambda x: F.struct(x.alias("token"), F.lit(n).alias("n"), F.lit(docs).alias("docs"))
    each = t.select(F.inline(F.concat(F.transform("t", entry(1, 0)), F.transform(F.array_distinct("t"), entry(0, 1)))))
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


@query("localize", "SELECT event_id, CASE event_type WHEN 'click' THEN '点击' WHEN 'view' THEN '浏览' ELSE event_type END AS name FROM events")
def _(spark, sf):
    """STR-17."""
    return read(spark, sf, "events").select("event_id", T.localized(F.col("event_type"), {"click": "点击", "view": "浏览"}).alias("name"))


@query("json_lists", "SELECT event_id, 'k:' || (props->>'k') AS listed, true AS strict FROM events")
def _(spark, sf):
    """JSN-03, JSN-05: payload fields in list shape; strictness of the grammar."""
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit('{"a": '), "props", F.lit("}")).alias("j"))
    return e.select("event_id", F.array_join(as_list(F.col("j"), "a"), ",").alias("listed"), strict(F.col("j")).alias("strict"))


@query("ordered_unique", "SELECT doc_id AS item_id, lang || '|x' AS kept FROM documents")
def _(spark, sf):
    """STR-02, ARR-01."""
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.array_join(T.unique_strings(F.array("lang", F.upper("lang"), F.lit(" x"), F.lit("X "), F.lit(""))), "|").alias("kept"))


# --- vectors -----------------------------------------------------------------------------------------------------


@query("l2_normalize", "SELECT vec_id AS item_id, round(list_sum(list_transform(v, lambda x: (x / n) * (x / n))), 6) AS square, round(v[1] / n, 6) AS first FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def _(spark, sf):
    """MTH-01."""
    u = vectors(spark, sf).select("item_id", l2_normalize(F.col("vector")).alias("u"))
    return u.select("item_id", F.round(F.pow(norm(F.col("u")), 2), 6).alias("square"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def _knn_sql(v: str) -> str:
    return f"""WITH e AS (SELECT vec_id, {v} AS v FROM embeddings), s AS (SELECT b.item_id AS query_id, x.vec_id AS item_id, round(list_cosine_similarity(q.v, x.v), 6) AS score FROM benchmark b JOIN e q ON q.vec_id = b.item_id, e x),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, item_id, score, rank FROM r WHERE rank <= {K}"""


@query("vector_topk", _knn_sql("embedding::DOUBLE[]"))
def _(spark, sf):
    """TOP-02, TOP-03, MTH-02, JOI-10, SEA-05, SEA-06."""
    found = dense.search(dense.prepared(vectors(spark, sf)), query_vectors(spark, sf), K)
    return found.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("matryoshka_topk", _knn_sql("embedding[1:32]::DOUBLE[]"))
def _(spark, sf):
    """MTH-03."""
    cut = lambda df: df.withColumn("vector", truncated(F.col("vector"), 32))
    found = dense.search(dense.prepared(cut(vectors(spark, sf))), cut(query_vectors(spark, sf)), K)
    return found.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


_ROUTE_SQL = """p AS (SELECT label AS category, (row_number() OVER (PARTITION BY label ORDER BY vec_id)) AS k, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT category, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM p WHERE k <= 2),
 c AS (SELECT category, list(m ORDER BY i) AS m FROM (SELECT category, i, avg(v[i] / n) AS m FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT vec_id AS item_id, category, round(list_cosine_similarity(embedding::DOUBLE[], m), 6) AS score FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, category) AS place FROM s)"""


def _routed(spark, sf) -> DataFrame:
    """Categories are labels, with their first two vectors as prompts."""
    e = read(spark, sf, "embeddings")
    first = e.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("_k <= 2")
    prompts = first.select(F.col("label").alias("category"), F.col("label").alias("ordinal"), F.col("embedding").alias("vector"))
    return routing.route(vectors(spark, sf), routing.centroids(prompts), 3, digits=6)


@query("scene_route", f"WITH {_ROUTE_SQL} SELECT item_id, category, score, place::BIGINT AS place FROM r WHERE place <= 3")
def _(spark, sf):
    """SEA-11, AGG-18, TOP-06."""
    return _routed(spark, sf).select("item_id", "category", "score", F.col("place").cast("long").alias("place"))


@query("route_distribution", f"WITH {_ROUTE_SQL} SELECT category, count(*)::BIGINT AS n FROM r WHERE place = 1 GROUP BY 1")
def _(spark, sf):
    """AGG-15."""
    return routing.distribution(_routed(spark, sf))


# --- BM25, fusion, search ----------------------------------------------------------------------------------------

def _bm25_sql(text: str) -> str:
    """The ranking of all documents for queries of the expression ``text``."""
    return _BM25_OF.replace("QUERY_TEXT", text)


_BM25_OF = r"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)) AS term FROM documents), po AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
 dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 dr AS (SELECT term, count(*) AS df FROM po GROUP BY 1), iw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dr, st), idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM iw) ELSE raw END AS idf FROM iw),
 qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(QUERY_TEXT), '[\p{L}\p{N}]+', 0)) AS term FROM benchmark), qc AS (SELECT query_id, term, count(*) AS q FROM qt GROUP BY 1, 2),
 sc AS (SELECT query_id, doc_id, sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qc JOIN idf USING (term) JOIN po USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
 bm AS (SELECT b.item_id AS query_id, d.doc_id AS item_id, round(coalesce(s, 0), 6) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.query_id = b.item_id AND sc.doc_id = d.doc_id),
 br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bm)"""

_BM25_SQL = _bm25_sql("text")
_INDEXES: dict[tuple, str] = {}


def bm25_index(spark, sf) -> lexical.Index:
    """The documents' index: built once in a Spark application, into the shared folder, and loaded from there as long as the table is the same."""
    key = (spark.sparkContext.applicationId, *tables.fingerprint(spark, f"{sf}/documents.parquet"))
    if key not in _INDEXES:
        path = tables.scratch(spark)
        lexical.build(tables.spread(items(spark, sf)), path)
        _INDEXES[key] = path
    return lexical.Index.load(spark, _INDEXES[key])


def _bm25(spark, sf, k: int) -> DataFrame:
    """A few rows a query, which most queries read more than once: so the search runs once."""
    return tables.kept(lexical.search(bm25_index(spark, sf), asked(spark, sf), k))


@query("bm25_topk", f"WITH {_BM25_SQL} SELECT query_id, item_id, score, rank FROM br WHERE rank <= {K}")
def _(spark, sf):
    """SEA-04, TOP-01."""
    return _bm25(spark, sf, K).select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_stats", r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)) AS term FROM documents), st AS (SELECT count(*) AS n FROM documents), dr AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1),
 iw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dr, st) SELECT term, df::BIGINT AS df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM iw) ELSE raw END, 6) AS idf FROM iw""")
def _(spark, sf):
    """AGG-04."""
    return bm25_index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def branches(spark, sf) -> dict[str, Callable]:
    prepared, index = dense.prepared(vectors(spark, sf)), bm25_index(spark, sf)
    qv = query_vectors(spark, sf)
    cut = lambda df: df.withColumn("vector", truncated(F.col("vector"), 32))
    return {
        "image": lambda q, k: dense.search(prepared, qv.join(q.select("query_id"), "query_id", "left_semi"), k),
        "text": lambda q, k: dense.search(dense.prepared(cut(vectors(spark, sf))), cut(qv.join(q.select("query_id"), "query_id", "left_semi")), k),
        "bm25": lambda q, k: lexical.search(index, q.select("query_id", "text"), k),
    }


DEPTH = 50


def _rankings(spark, sf, k: int = DEPTH) -> DataFrame:
    q = asked(spark, sf)
    out = None
    for name, search in branches(spark, sf).items():
        one = search(q, k).select("query_id", F.lit(name).alias("branch"), "item_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return tables.kept(out)


def _vec_cte(name: str, v: str) -> str:
    return f"""{name}e AS (SELECT vec_id, {v} AS v FROM embeddings), {name}s AS (SELECT b.item_id AS query_id, x.vec_id AS item_id, round(list_cosine_similarity(q.v, x.v), 6) AS score FROM benchmark b JOIN {name}e q ON q.vec_id = b.item_id, {name}e x),
 {name}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {name}s)"""


def _all_sql(text: str = "text") -> str:
    return f"""{_bm25_sql(text)}, {_vec_cte('im', 'embedding::DOUBLE[]')}, {_vec_cte('tx', 'embedding[1:32]::DOUBLE[]')},
 al AS (SELECT 'image' AS branch, * FROM imr WHERE rank <= {DEPTH} UNION ALL SELECT 'text', * FROM txr WHERE rank <= {DEPTH} UNION ALL SELECT 'bm25', query_id, item_id, score, rank FROM br WHERE rank <= {DEPTH})"""


_ALL_SQL = _all_sql()
#: What the searcher asks with: a query's text and its labelled slots.
_ASKED_SQL = _all_sql("trim(text) || CASE WHEN item_id % 3 = 0 THEN ' 时间:night' ELSE '' END")


def _fuse_sql(source: str, n: int) -> str:
    return f"""fu AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS f, max(CASE branch WHEN 'image' THEN rank END) AS image_rank, max(CASE branch WHEN 'text' THEN rank END) AS text_rank, max(CASE branch WHEN 'bm25' THEN rank END) AS bm25_rank FROM {source} GROUP BY 1, 2),
 fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, item_id) AS rank FROM fu), ft AS (SELECT * FROM fr WHERE rank <= {n})"""


def _ranks(df: DataFrame) -> list:
    return [F.col("branch_ranks")[b].cast("long").alias(f"{b}_rank") for b in fusion.BRANCHES]


@query("rrf_fusion", f"WITH {_ALL_SQL}, {_fuse_sql('al', K)} SELECT query_id, item_id, rank, round(f, 6) AS fused_score, image_rank, text_rank, bm25_rank FROM ft")
def _(spark, sf):
    """AGG-01, JOI-02, WIN-01, TOP-04, SET-07, MAP-01."""
    best = fusion.top(fusion.rrf(_rankings(spark, sf)), K)
    return best.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("fused_score", 6).alias("fused_score"), *_ranks(best))


_WEIGHTED = "nm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM {0} WINDOW w AS (PARTITION BY query_id, branch)), wf AS (SELECT query_id, item_id, sum(CASE branch WHEN 'image' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * norm) / 1.0 AS f FROM nm GROUP BY 1, 2), wr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 6) DESC, item_id) AS rank FROM wf)"


@query("weighted_fusion", f"WITH {_ALL_SQL}, {_WEIGHTED.format('al')} SELECT query_id, item_id, rank, round(f, 6) AS fused_score FROM wr WHERE rank <= {K}")
def _(spark, sf):
    """AGG-02, AGG-03."""
    best = fusion.top(fusion.weighted(_rankings(spark, sf), WEIGHTS), K, digits=6)
    return best.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("fused_score", 6).alias("fused_score"))


# --- filters -----------------------------------------------------------------------------------------------------


def _pairs(spark, sf) -> DataFrame:
    """Each annotation with one query's slots, by its id."""
    a = documents.normalized_fields(documents.fields(annotations(spark, sf)))
    one = lambda *xs: F.array(*map(F.lit, xs))
    none = T.none_of_strings()
    return a.withColumn("q", F.col("item_id") % 6).select(
        "item_id", "q", "f", "n", "object_counts",
        F.when(F.col("q") == 0, one("english")).when(F.col("q") == 5, one("zero", "french")).otherwise(none).alias("excluded_terms"),
        F.when(F.col("q") == 1, one("one")).otherwise(none).alias("required_terms"),
        F.when(F.col("q") == 2, F.lit("thing2")).alias("count_target"), F.when(F.col("q") == 2, F.lit(2)).alias("count_value"), F.when(F.col("q") == 2, F.lit("gte")).alias("count_operator"),
        F.when(F.col("q") == 3, one("night")).otherwise(none).alias("time_of_day"), F.when(F.col("q") == 4, one("c3")).otherwise(none).alias("colors"),
    )


def _filter_sql(mode: str) -> str:
    strict = {"soft": "false", "hard": "true", "hybrid": "true"}[mode]
    color = {"soft": "false", "hard": "true", "hybrid": "false"}[mode]
    norm_ = "regexp_replace(lower({0}), '\\s+', '', 'g')"
    every = " OR ".join(f"{norm_.format(c)} LIKE '%{{0}}%'" for c in ("coalesce(summary,'')", "object", "object || ':' || cnt", "coalesce(scene,'')", "coalesce('time_of_day:' || tod, '')", "coalesce('weather:' || weather, '')", "coalesce(style,'')", "color"))
    return f"""WITH {_ANN_SQL}, j AS (SELECT *, item_id % 6 AS q FROM ann) SELECT item_id, CASE q
 WHEN 0 THEN NOT (coalesce(scene LIKE '%en%', false)) WHEN 5 THEN NOT (coalesce(style LIKE '%zero%' OR style LIKE '%src0%', false) OR coalesce(scene LIKE '%fr%', false))
 WHEN 1 THEN ({every.format('one')}) OR ({every.format('src1')}) WHEN 2 THEN coalesce(object = 'thing2' AND cnt >= 2, false)
 WHEN 3 THEN NOT ({strict} AND tod IS NOT NULL AND tod <> 'night') WHEN 4 THEN NOT ({color} AND color <> 'c3') END AS allowed FROM j"""


for _mode in filters.MODES:

    @query(f"filter_{_mode}", _filter_sql(_mode))
    def _(spark, sf, mode=_mode):
        """FLT-01 to FLT-07."""
        return filters.decide(_pairs(spark, sf), CATALOG, mode).select("item_id", "allowed")


@query("filter_reasons", f"""WITH {_ANN_SQL} SELECT item_id, CASE WHEN item_id % 6 = 2 AND object = 'thing2' AND cnt >= 2 THEN 'object_counts' WHEN item_id % 6 = 3 AND tod = 'night' THEN 'time_of_day' WHEN item_id % 6 = 4 AND color = 'c3' THEN 'colors' WHEN item_id % 6 = 1 THEN concat_ws(',', CASE WHEN summary_has THEN 'summary' END, CASE WHEN object LIKE '%one%' THEN 'objects' END, CASE WHEN object LIKE '%one%' THEN 'object_counts' END, CASE WHEN style LIKE '%src1%' OR style LIKE '%one%' THEN 'style' END) ELSE '' END AS matched
 FROM (SELECT *, regexp_matches(regexp_replace(lower(coalesce(summary, '')), '\\s+', '', 'g'), 'one|src1') AS summary_has FROM ann)""")
def _(spark, sf):
    """FLT-07: where a query's terms were found."""
    return filters.decide(_pairs(spark, sf), CATALOG).select("item_id", F.array_join("matched_fields", ",").alias("matched"))


def _parsed(spark, sf) -> DataFrame:
    """Benchmark items as parsed queries: odd ones exclude English, multiples of 3 ask for the night."""
    one, none = (lambda *xs: F.array(*map(F.lit, xs))), T.none_of_strings()
    q = asked(spark, sf)
    return q.select("query_id", "text", F.when(F.col("query_id") % 2 == 1, one("english")).otherwise(none).alias("excluded_terms"), F.when(F.col("query_id") % 3 == 0, one("night")).otherwise(none).alias("time_of_day"))


def searcher(spark, sf) -> Searcher:
    return Searcher(annotations(spark, sf), branches(spark, sf), CATALOG, keep=tables.kept)


def _kept_sql(night: str = "(query_id % 3 = 0 AND tod IS NOT NULL AND tod <> 'night')") -> str:
    return f"""{_ANN_SQL}, ke AS (SELECT al.branch, al.query_id, al.item_id, al.score, al.rank AS old FROM al JOIN ann USING (item_id) WHERE NOT (query_id % 2 = 1 AND coalesce(scene LIKE '%en%', false)) AND NOT {night}),
 kr AS (SELECT branch, query_id, item_id, score, row_number() OVER (PARTITION BY query_id, branch ORDER BY old, item_id) AS rank FROM ke)"""


@query("filter_then_compact_rank", f"WITH {_ASKED_SQL}, {_kept_sql()} SELECT branch, query_id, item_id, rank FROM kr")
def _(spark, sf):
    """FLT-08, FLT-09, JOI-01."""
    s, q = searcher(spark, sf), _parsed(spark, sf)
    kept = s.compacted(s.decided(s.recall(q, DEPTH), q))
    return kept.select("branch", "query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("hybrid_search", f"WITH {_ASKED_SQL}, {_kept_sql()}, {_fuse_sql('kr', K)} SELECT query_id, item_id, rank, round(f, 6) AS fused_score, image_rank, text_rank, bm25_rank FROM ft")
def _(spark, sf):
    """SEA-01, SEA-02, TOP-05."""
    found = searcher(spark, sf).search(_parsed(spark, sf), DEPTH, K)
    return found.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("fused_score", 6).alias("fused_score"), *_ranks(found))


@query("soft_fallback", f"""WITH {_ASKED_SQL}, {_kept_sql()}, {_fuse_sql('kr', 20)}, so AS (SELECT ft.*, count(*) OVER (PARTITION BY query_id) AS n FROM ft),
 k2 AS (SELECT al.branch, al.query_id, al.item_id, al.rank AS old FROM al JOIN ann USING (item_id) WHERE NOT (query_id % 2 = 1 AND coalesce(scene LIKE '%en%', false))), k3 AS (SELECT branch, query_id, item_id, row_number() OVER (PARTITION BY query_id, branch ORDER BY old, item_id) AS rank FROM k2),
 f2 AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS f FROM k3 GROUP BY 1, 2), f3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(f, 9) DESC, item_id) AS rank FROM f2)
 SELECT query_id, item_id, rank, 'hybrid' AS mode FROM so WHERE n >= 20 UNION ALL SELECT query_id, item_id, rank, 'soft' FROM f3 WHERE rank <= 20 AND query_id NOT IN (SELECT query_id FROM so WHERE n >= 20)""")
def _(spark, sf):
    """FLT-10."""
    found = searcher(spark, sf).with_fallback(_parsed(spark, sf), DEPTH, 20)
    return found.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), "mode")


@query("ablation_a5", f"""WITH {_ASKED_SQL}, {_kept_sql()}, {_fuse_sql('kr', K)}, {_WEIGHTED.format('kr')} SELECT variant, query_id, item_id, rank FROM (SELECT branch AS variant, query_id, item_id, rank FROM kr WHERE rank <= {K} UNION ALL SELECT 'rrf', query_id, item_id, rank FROM ft UNION ALL SELECT 'weighted', query_id, item_id, rank FROM wr WHERE rank <= {K})""")
def _(spark, sf):
    """SEA-20."""
    out = searcher(spark, sf).ablation(_parsed(spark, sf), DEPTH, K, WEIGHTS)
    return out.select("variant", "query_id", "item_id", F.col("rank").cast("long").alias("rank"))


# --- evaluation --------------------------------------------------------------------------------------------------


def _judged(spark, sf) -> DataFrame:
    """A query's judgments are the labels of items of its residue class."""
    l = read(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, F.col("quality")).otherwise(F.col("quality") * 2).alias("grade"))
    n = read(spark, sf, "benchmark").count()
    return l.withColumn("query_id", F.pmod("item_id", F.lit(n)))


_JUDGED_SQL = "ju AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id AS item_id, CASE WHEN toxic = 1 THEN quality ELSE quality * 2 END AS grade FROM labels)"
_METRICS_SQL = f"""{_JUDGED_SQL}, rk AS (SELECT query_id, item_id, rank FROM br WHERE rank <= {DEPTH}), jr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item_id) AS r FROM ju),
 id AS (SELECT query_id, count_if(grade > 0) AS rel, coalesce(sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) END), 0) AS ideal FROM jr GROUP BY 1),
 hi AS (SELECT rk.*, grade, row_number() OVER (PARTITION BY rk.query_id ORDER BY rank) AS seen FROM rk JOIN ju ON ju.query_id = rk.query_id AND ju.item_id = rk.item_id WHERE grade > 0),
 hq AS (SELECT query_id, count_if(rank <= 1) AS h1, count_if(rank <= 5) AS h5, count_if(rank <= 10) AS h10, min(rank) AS fst, sum(seen / rank) AS pr, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) END) AS dcg FROM hi GROUP BY 1),
 me AS (SELECT id.query_id, CASE WHEN rel > 0 THEN coalesce(h1, 0) / rel ELSE 0 END AS recall_1, CASE WHEN rel > 0 THEN coalesce(h5, 0) / rel ELSE 0 END AS recall_5, CASE WHEN rel > 0 THEN coalesce(h10, 0) / rel ELSE 0 END AS recall_10,
 coalesce(1.0::DOUBLE / fst, 0) AS mrr, CASE WHEN rel > 0 THEN coalesce(pr, 0) / rel ELSE 0 END AS ap, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg FROM id LEFT JOIN hq USING (query_id))"""
_NAMES = ["recall_1", "recall_5", "recall_10", "mrr", "ap", "ndcg"]


def _details(spark, sf) -> DataFrame:
    return metrics.per_query(_bm25(spark, sf, DEPTH), _judged(spark, sf))


@query("query_metrics", f"WITH {_BM25_SQL}, {_METRICS_SQL} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM me")
def _(spark, sf):
    """MTH-04 to MTH-07, AGG-05."""
    return _details(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in _NAMES])


@query("eval_summary", f"WITH {_BM25_SQL}, {_METRICS_SQL} SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS scope, category, count(*)::BIGINT AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _NAMES)} FROM (SELECT *, 'c' || (query_id % 4) AS category FROM me) GROUP BY GROUPING SETS ((), (category))")
def _(spark, sf):
    """AGG-06, SEA-21, JOI-05."""
    s = metrics.summary(_details(spark, sf).withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string"))), "category", _NAMES)
    return s.select("scope", "category", "n", *[F.round(c, 6).alias(c) for c in _NAMES])


@query("latency_summary", """SELECT CASE WHEN grouping(event_type) = 1 THEN 'overall' ELSE 'category' END AS scope, event_type AS category, count(*)::BIGINT AS n, round(avg(value), 6) AS latency_mean, round(quantile_cont(value, 0.5), 6) AS latency_p50, round(quantile_cont(value, 0.95), 6) AS latency_p95,
 count_if(event_type = 'error')::BIGINT AS failures, round(count_if(event_type = 'error') / count(*), 6) AS failure_rate FROM events GROUP BY GROUPING SETS ((), (event_type))""")
def _(spark, sf):
    """AGG-07, AGG-08, AGG-10."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("category"), "value", (F.col("event_type") != "error").alias("success"))
    s = metrics.summary(e, "category", [], "value", "success")
    return s.select("scope", "category", "n", *[F.round(c, 6).alias(c) for c in ("latency_mean", "latency_p50", "latency_p95")], "failures", F.round("failure_rate", 6).alias("failure_rate"))


@query("latency_suite", """WITH r AS (SELECT event_id AS run, event_type AS category, user_id % 3 AS top_k, value AS v, event_type <> 'error' AS ok, event_id = min(event_id) OVER () AS cold FROM events),
 s AS (SELECT 'overall' AS scope, 'all' AS "group", v, ok FROM r UNION ALL SELECT 'phase', CASE WHEN cold THEN 'cold' ELSE 'warm' END, v, ok FROM r UNION ALL SELECT 'top_k', top_k::VARCHAR, v, ok FROM r UNION ALL SELECT 'category', category, v, ok FROM r)
 SELECT scope, "group", count(*)::BIGINT AS runs, count_if(NOT ok)::BIGINT AS failures, round(avg(CASE WHEN ok THEN v END), 6) AS mean, round(quantile_cont(CASE WHEN ok THEN v END, 0.95), 6) AS p95 FROM s GROUP BY 1, 2""")
def _(spark, sf):
    """AGG-11, WIN-04, DRV-02, DRV-03."""
    e = read(spark, sf, "events").select(F.col("event_id").alias("run"), F.col("user_id").alias("query_id"), F.col("event_type").alias("category"), (F.col("user_id") % 3).alias("top_k"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"))
    return rerank.latency_suite(e).select("scope", "group", "runs", "failures", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"))


@query("method_speed_up", """WITH q AS (SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN value END) AS p, sum(CASE WHEN event_id % 2 = 1 THEN value END) AS l FROM events GROUP BY 1)
 SELECT round(avg(p), 6) AS pointwise_ms, round(avg(l), 6) AS listwise_ms, round(avg(p) / nullif(avg(l), 0), 6) AS speed_up FROM q""")
def _(spark, sf):
    """AGG-14, DRV-04."""
    e = read(spark, sf, "events").select(F.when(F.col("event_id") % 2 == 0, "pointwise").otherwise("listwise").alias("method"), F.col("user_id").alias("query_id"), F.col("value").alias("latency_ms"), F.lit(True).alias("success"))
    out = rerank.speed_up(e)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("fusion_comparison", f"""WITH {_ALL_SQL}, {_fuse_sql('al', K)}, {_WEIGHTED.format('al')}, b AS (SELECT query_id, item_id, rank FROM wr WHERE rank <= {K}),
 j AS (SELECT coalesce(ft.query_id, b.query_id) AS query_id, ft.rank AS a, b.rank AS b FROM ft FULL JOIN b ON ft.query_id = b.query_id AND ft.item_id = b.item_id)
 SELECT query_id, round(count_if(a IS NOT NULL AND b IS NOT NULL) / greatest(1, least({K}, count(*))), 6) AS overlap, round(coalesce(avg(abs(a - b)), greatest(count(a), count(b))), 6) AS rank_shift FROM j GROUP BY 1""")
def _(spark, sf):
    """SEA-22, WIN-05, WIN-06."""
    r = _rankings(spark, sf)
    out = metrics.overlap(fusion.top(fusion.rrf(r), K), fusion.top(fusion.weighted(r, WEIGHTS), K, digits=6), K)
    return out.select("query_id", F.round("overlap", 6).alias("overlap"), F.round("rank_shift", 6).alias("rank_shift"))


# --- reranking, delivery, stories, sets --------------------------------------------------------------------------


@query("pointwise_rerank", f"""WITH {_BM25_SQL}, c AS (SELECT query_id, item_id, score, rank, (item_id * 37) % 131 - 10 AS resp, item_id % 13 = 5 AS failed FROM br WHERE rank <= {K}), r AS (SELECT *, CASE WHEN failed THEN 0 ELSE greatest(0, least(100, resp)) END::DOUBLE AS rs FROM c),
 s AS (SELECT *, 0.35::DOUBLE * score / (CASE WHEN max(score) OVER w = 0 THEN 1 ELSE max(score) OVER w END) + 0.65::DOUBLE * rs / 100 AS cb FROM r WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, item_id, rs AS rerank_score, round(cb, 6) AS combined, row_number() OVER (PARTITION BY query_id ORDER BY round(cb, 9) DESC, item_id) AS new_rank FROM s""")
def _(spark, sf):
    """SEA-09, MTH-08, MTH-09."""
    c = _bm25(spark, sf, K).withColumnRenamed("score", "fused_score")
    c = c.withColumn("error", F.when(F.col("item_id") % 13 == 5, "timeout")).withColumn("response", ((F.col("item_id") * 37) % 131 - 10).cast("double"))
    return rerank.pointwise(c).select("query_id", "item_id", "rerank_score", F.round("combined", 6).alias("combined"), F.col("new_rank").cast("long").alias("new_rank"))


@query("listwise_repair", f"""WITH {_BM25_SQL}, c AS (SELECT query_id, 'val-' || item_id AS item_id, rank FROM br WHERE rank <= 5), p AS (SELECT *, CASE WHEN query_id % 3 = 2 THEN NULL WHEN rank = 3 THEN 1 WHEN rank = 1 THEN 2 WHEN rank = 5 AND query_id % 3 = 1 THEN 4 END AS place FROM c)
 SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, rank) AS new_rank, round(CASE WHEN place IS NULL THEN 0 WHEN place = 1 THEN 90 ELSE 100.0 * (5 - place) / 4 END, 6)::DOUBLE AS score, query_id % 3 <> 2 AS degraded, CASE WHEN query_id % 3 = 2 THEN 'no valid ranking' END AS error FROM p""")
def _(spark, sf):
    """SEA-10, JOI-11, MTH-10, JSN-01: answers name items by place, repeat some and leave some out."""
    c = _bm25(spark, sf, 5).withColumn("item_id", F.concat(F.lit("val-"), F.col("item_id").cast("string")))
    good = F.when(F.col("query_id") % 3 == 0, 'ok {"ranking": [{"index": 3, "score": 90}, 1, "3"]} end').when(F.col("query_id") % 3 == 1, '{"ranking": [{"index": "3", "score": 90}, 1, 3, 5]}').otherwise('{"ranking": ["nobody"]}')
    out = rerank.listwise(c, asked(spark, sf).select("query_id", good.alias("answer")))
    return out.select("query_id", "item_id", F.col("new_rank").cast("long").alias("new_rank"), F.round("score", 6).alias("score"), "degraded", "error")


@query("delivery_batch", f"WITH {_ALL_SQL}, {_fuse_sql('al', 20)}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ft) SELECT query_id, item_id, rank FROM n WHERE n = 20")
def _(spark, sf):
    """TOP-09."""
    full, _ = delivery.batches(fusion.top(fusion.rrf(_rankings(spark, sf)), 20))
    return full.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("delivery_errors", f"""WITH l AS (SELECT item_id AS line FROM benchmark), e AS (
 SELECT line, NULL::INTEGER AS candidate, 'E_JSON_PARSE' AS code FROM l WHERE line % 8 = 0 UNION ALL SELECT line, NULL, 'E_UNKNOWN_FIELD' FROM l WHERE line % 8 = 1 UNION ALL SELECT line, NULL, 'E_TOP_K' FROM l WHERE line % 8 = 2
 UNION ALL SELECT line, 2, 'E_RANK_SEQUENCE' FROM l WHERE line % 8 = 3 UNION ALL SELECT line, 20, 'E_DUPLICATE_IMAGE_ID' FROM l WHERE line % 8 = 4 UNION ALL SELECT line, 20, 'E_MANIFEST_MISMATCH' FROM l WHERE line % 8 = 4
 UNION ALL SELECT line, 1, 'E_PATH_FORMAT' FROM l WHERE line % 8 = 5 UNION ALL SELECT line, 1, 'E_BRANCH_KEYS' FROM l WHERE line % 8 = 6 UNION ALL SELECT line, 1, 'E_BRANCH_NAME' FROM l WHERE line % 8 = 6)
 SELECT line, candidate, code FROM e""")
def _(spark, sf):
    """SEA-23, WIN-09, JOI-12, SET-05, JSN-05."""
    ids = F.sequence(F.lit(1), F.lit(20))
    k = F.col("line") % 8

    def candidate(i):
        image = F.when((k == 4) & (i == 20), F.lit("i1")).otherwise(F.concat(F.lit("i"), i.cast("string")))
        path = F.when((k == 5) & (i == 1), F.lit("/abs/1.jpg")).otherwise(F.concat(F.lit("val/"), i.cast("string"), F.lit(".jpg")))
        rank = F.when((k == 3) & (i == 2), F.lit(7)).otherwise(i)
        ranks = F.when((k == 6) & (i == 1), F.lit('{"other":1}')).otherwise(F.lit('{"image":1}'))
        return F.concat(F.lit('{"rank":'), rank.cast("string"), F.lit(',"image_id":"'), image, F.lit('","relative_path":"'), path, F.lit('","fused_score":0.5,"branch_scores":{"image":0.5},"branch_ranks":'), ranks, F.lit(',"matched_fields":[]}'))

    top_k = F.when(k == 2, "19").otherwise("20")
    extra = F.when(k == 1, ',"more":1').otherwise("")
    value = F.concat(F.lit('{"schema_version":"m5-to-m6-v1.0","query_id":"q'), F.col("line").cast("string"), F.lit('","query":"x","category":"c","split":"val","fusion_method":"rrf","annotation_version":"v","index_manifest_sha256":"a","config_sha256":"b","top_k":'), top_k, extra, F.lit(',"candidates":['), F.array_join(F.transform(ids, candidate), ","), F.lit("]}"))
    lines = read(spark, sf, "benchmark").select(F.col("item_id").alias("line")).withColumn("value", F.when(k == 0, F.lit("{not json")).otherwise(value))
    man = spark.range(1, 21).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("image_id"), F.concat(F.lit("val/"), F.col("id").cast("string"), F.lit(".jpg")).alias("relative_path"), F.lit("s").alias("sha256"))
    return delivery.validate(lines, man, {"index_manifest_sha256": "a", "config_sha256": "b", "annotation_version": "v"}, {"val": "val", "train": "train"}).select("line", "candidate", "code")


def _stories(spark, sf) -> DataFrame:
    """Conversations of 3 to 8 turns as stories: a turn is an item, its role the scene."""
    c = read(spark, sf, "conversations").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("conv_id"))).filter("_n between 3 and 8")
    bucket = ((F.col("turn") * 5 + F.col("conv_id")) % 7).cast("int")
    scene = F.concat("role", (F.col("turn") % 2).cast("string"))
    feats = story.features(scene, F.array(F.concat(F.lit("f"), (F.col("turn") % 3).cast("string"))))
    return c.select(F.col("conv_id").alias("story_id"), F.col("turn").alias("item_id"), F.col("turn").alias("position"), F.col("turn").alias("place"), scene.alias("scene"), bucket.alias("bucket"), feats.alias("features"))


_STORY_SQL = """c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), st AS (SELECT conv_id AS story_id, turn, role || (turn % 2) AS scene, (turn * 5 + conv_id) % 7 AS bucket, [lower(role || (turn % 2)), 'f' || (turn % 3)] AS fs FROM c WHERE n BETWEEN 3 AND 8),
 nx AS (SELECT *, lead(turn) OVER w AS t2, lead(scene) OVER w AS s2, lead(bucket) OVER w AS b2, lead(fs) OVER w AS f2 FROM st WINDOW w AS (PARTITION BY story_id ORDER BY turn))"""


@query("story_gaps", f"""WITH {_STORY_SQL}, g AS (SELECT *, bucket < 6 AND b2 < 6 AND b2 - bucket >= 2 AS jump, scene <> s2 AND len(list_intersect(fs, f2)) / len(list_distinct(list_concat(fs, f2))) < 0.15 AS cut FROM nx WHERE t2 IS NOT NULL)
 SELECT story_id, gap, after_item_id, before_item_id FROM (SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY turn) AS gap, turn AS after_item_id, t2 AS before_item_id FROM g WHERE jump OR cut) WHERE gap <= 2""")
def _(spark, sf):
    """WIN-07, JOI-08, SEA-17."""
    return story.gaps(_stories(spark, sf)).select("story_id", F.col("gap").cast("long").alias("gap"), "after_item_id", "before_item_id")


@query("story_order")
def _(spark, sf):
    """WIN-08: a greedy chain, which SQL can't say; tests hold it against brute force."""
    return story.order(_stories(spark, sf))


@query("jaccard_neighbours", f"WITH {_STORY_SQL} SELECT story_id, turn AS item_id, round(len(list_intersect(fs, f2)) / len(list_distinct(list_concat(fs, f2))), 6) AS similarity FROM nx WHERE t2 IS NOT NULL")
def _(spark, sf):
    """SET-03."""
    w = Window.partitionBy("story_id").orderBy("place")
    s = _stories(spark, sf).withColumn("n", F.lead("features").over(w)).filter("n is not null")
    return s.select("story_id", "item_id", F.round(story.jaccard(F.col("features"), F.col("n")), 6).alias("similarity"))


@query("evidence_fallback_answer", """WITH e AS (SELECT conv_id AS question_id, turn, turn % 3 <> 0 AS relevant, CASE WHEN turn % 4 = 1 THEN '' ELSE role || '; ' || turn END AS facts FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3)
 SELECT question_id, coalesce(string_agg(CASE WHEN relevant AND facts <> '' THEN facts || '[img_' || turn || ']' END, ' ' ORDER BY turn), 'insufficient evidence') AS answer, count_if(relevant AND facts <> '') = 0 AS refused, coalesce(string_agg(CASE WHEN relevant AND facts <> '' THEN turn::VARCHAR END, ',' ORDER BY turn), '') AS citations FROM e GROUP BY 1""")
def _(spark, sf):
    """SEA-15."""
    c = read(spark, sf, "conversations")
    facts = F.when(F.col("turn") % 4 == 1, T.none_of_strings()).otherwise(F.array("role", F.col("turn").cast("string")))
    return story.fallback_answers(c.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("item_id"), (F.col("turn") % 3 != 0).alias("relevant"), facts.alias("facts")))


@query("judgment_parse", """WITH l AS (SELECT DISTINCT conv_id AS query_id FROM conversations) SELECT query_id, item_id, relevance, error FROM (SELECT query_id, 'a' || query_id AS item_id, 2 AS relevance, NULL AS error FROM l UNION ALL SELECT query_id, 'b', 1, NULL FROM l UNION ALL SELECT query_id, 'b', 1, 'repeated' FROM l UNION ALL SELECT query_id, NULL, NULL, 'form' FROM l)""")
def _(spark, sf):
    """STR-15."""
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    return judging.parse_judgments(c.withColumn("judgments", F.concat(F.lit("a"), F.col("query_id").cast("string"), F.lit(":2； b:1;b:1\nc:0;what")))).select("query_id", "item_id", "relevance", "error")


@query("judgment_replace", """SELECT query_id, item_id, relevance FROM (SELECT doc_id % 40 AS query_id, doc_id AS item_id, quality + 1 AS relevance FROM labels) WHERE query_id >= 3 UNION ALL SELECT item_id, item_id, 2 FROM benchmark WHERE item_id < 3""")
def _(spark, sf):
    """SET-06, DRV-12, SRC-07."""
    old = read(spark, sf, "labels").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("item_id"), (F.col("quality") + 1).alias("relevance"))
    new = read(spark, sf, "benchmark").filter("item_id < 3").select(F.col("item_id").alias("query_id"), "item_id", F.lit(2).alias("relevance"))
    return judging.replace_query(old, new)


@query("qrels_last_wins", "SELECT o_custkey AS query_id, o_orderkey % 3 AS item_id, arg_max(o_orderkey % 2, o_orderkey) AS relevance FROM orders GROUP BY 1, 2")
def _(spark, sf):
    """SRC-07."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).alias("item_id"), (F.col("o_orderkey") % 2).alias("relevance"), "o_orderkey")
    return judging.last_wins(o, "o_orderkey")


@query("set_validation", """WITH t AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 2 THEN '' ELSE text END AS text, item_id % 5 <> 1 AS reviewed, 'me' AS annotator FROM benchmark), j AS (SELECT doc_id % 50 AS query_id, doc_id AS item_id, CASE WHEN doc_id % 9 = 0 THEN 3 ELSE quality + 1 END AS relevance FROM labels)
 SELECT query_id, 'no text' AS error FROM t WHERE text = '' UNION SELECT query_id, 'not reviewed' FROM t WHERE NOT reviewed UNION SELECT query_id, 'grade' FROM j WHERE relevance NOT IN (1, 2) UNION SELECT query_id, 'unknown query' FROM j WHERE query_id NOT IN (SELECT query_id FROM t) UNION SELECT query_id, 'no grade 2' FROM t WHERE query_id NOT IN (SELECT query_id FROM j WHERE relevance = 2)""")
def _(spark, sf):
    """SEA-24, FLT-11, AGG-16."""
    t = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 7 == 2, "").otherwise(F.col("text")).alias("text"), (F.col("item_id") % 5 != 1).alias("reviewed"), F.lit("me").alias("annotator"))
    j = read(spark, sf, "labels").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 9 == 0, 3).otherwise(F.col("quality") + 1).alias("relevance"))
    return judging.set_errors(t, j, items(spark, sf).select("item_id"))


@query("eval_seed", f"WITH {_MAN_SQL}, s AS (SELECT item_id FROM m WHERE valid AND duplicate_of IS NULL ORDER BY item_id LIMIT 25) SELECT 'q' || lpad(row_number() OVER (ORDER BY item_id)::VARCHAR, 3, '0') AS query_id, item_id, 2 AS relevance, 'auto_seed' AS annotator FROM s")
def _(spark, sf):
    """SEA-27."""
    return judging.seeded(manifest.usable(_manifest(spark, sf)).select("item_id"), 25)


@query("seeded_sample")
def _(spark, sf):
    """TOP-08: a sample by Spark's own hash, which SQL elsewhere doesn't have."""
    return judging.sample(items(spark, sf).select("item_id"), 100)


@query("training_pairs", """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT d.doc_id AS item_id, q.k::INTEGER AS k, CASE WHEN q.k = 0 AND s.n > 1 THEN 'hard' ELSE 'random' END AS negative_kind, true AS differs, true AS scene_ok FROM documents d JOIN s USING (lang), (SELECT unnest([0, 1]) AS k) q""")
def _(spark, sf):
    """SEA-13, JOI-13, DRV-07: which kind each pair has, and that its negative fits it."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("scene"), F.array(F.lit("0"), F.lit("1")).alias("queries"))
    p = judging.training_pairs(d)
    other = d.select(F.col("item_id").alias("negative_item_id"), F.col("scene").alias("s2"))
    met = p.join(other, "negative_item_id").join(d.select("item_id", "scene"), "item_id")
    return met.select("item_id", F.col("query").cast("int").alias("k"), "negative_kind", (F.col("item_id") != F.col("negative_item_id")).alias("differs"), ((F.col("negative_kind") == "random") | (F.col("scene") == F.col("s2"))).alias("scene_ok"))


@query("rerank_geometry", """SELECT p_partkey AS item_id, greatest(1, floor(w * k))::BIGINT AS width, greatest(1, floor(h * k))::BIGINT AS height, ceil(p_size / 5.0)::BIGINT AS sheet_rows, (ceil(p_size / 5.0) * 192)::BIGINT AS sheet_height
 FROM (SELECT *, p_size * 100.0::DOUBLE AS w, p_retailprice::DOUBLE AS h, least(1.0::DOUBLE, sqrt(1000000.0::DOUBLE / (p_size * 100.0::DOUBLE * p_retailprice))) AS k FROM part)""")
def _(spark, sf):
    """MTH-11: sizes under a pixel cap, and a contact sheet's."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), rerank.image_size(F.col("p_size") * 100.0, F.col("p_retailprice"), 1_000_000).alias("i"), rerank.sheet_size(F.col("p_size")).alias("s"))
    return p.select("item_id", "i.width", "i.height", F.col("s.rows").alias("sheet_rows"), F.col("s.height").alias("sheet_height"))


def _payloads(spark, sf) -> DataFrame:
    """Documents as canonical payloads: two cars, a shop, and a relation between a car and the shop or an unknown entity."""
    d, i = read(spark, sf, "documents"), F.col("doc_id")
    names = [*T.RELATIONS, "beside_it"]
    predicate = F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    entity = lambda n, name, count, exact: F.struct(F.lit(n).alias("entity_id"), F.lit(name).alias("name_zh"), count.cast("int").alias("count"), exact.alias("count_exact"), F.struct(F.lit("Red").alias("colors_zh"), F.when(i % 2 == 0, "停着").alias("action_zh")).alias("attributes"))
    body = F.struct(
        F.struct(F.concat(F.lit("s"), i.cast("string")).alias("short_zh")).alias("captions"), F.array(entity("e1", "汽车", F.lit(2), F.lit(True)), entity("e2", "汽车", i % 3, i % 2 == 0), entity("e3", "商店", F.lit(1), F.lit(False))).alias("entities"),
        F.array(F.struct(F.lit("e1").alias("subject_id"), predicate.alias("predicate"), F.when(i % 5 == 0, "e9").otherwise("e3").alias("object_id"))).alias("relations"), F.struct(F.lit("food").alias("primary_type"), F.lit("outdoor").alias("environment")).alias("scene"),
    )
    whole = F.struct(F.when(i % 10 == 3, "other").otherwise(i.cast("string")).alias("image_id"), F.when(i % 10 == 4, "x").alias("processed_sha256"), body.alias("annotation"))
    return d.select(i.alias("item_id"), F.when(i % 10 == 6, "{cut").when(i % 10 == 7, '{"n": 1}').otherwise(F.to_json(whole)).alias("payload"))


_PREDICATES_SQL = "(CASE doc_id % 17 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate([*T.RELATIONS.values(), "beside_it"])) + " END)"


@query("adapt_canonical", f"""SELECT doc_id AS item_id, 's' || doc_id AS summary, '汽车,商店' AS objects, '汽车=' || (2 + CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 ELSE 0 END) AS counts, '汽车' || {_PREDICATES_SQL} || CASE WHEN doc_id % 5 = 0 THEN '未知实体' ELSE '商店' END AS relations, '美食 室外' AS scene, '红色' AS colors,
 CASE WHEN doc_id % 2 = 0 THEN '汽车停着,商店停着' ELSE '' END AS actions, 's' || doc_id || '|汽车 商店 美食 室外 红色|美食 室外' AS queries FROM documents WHERE doc_id % 10 NOT IN (3, 4, 6, 7)""")
def _(spark, sf):
    """JSN-06, JSN-08, JOI-06, AGG-17, STR-17, STR-18. Payloads of others' and of unknown shapes are failures (adapt_failures)."""
    rows = _payloads(spark, sf)
    good, _ = adapters.adapt(rows, rows.select("item_id", F.lit("s").alias("sha256")))
    counts = F.array_join(F.transform("object_counts", lambda c: F.concat_ws("=", c["name"], c["count"].cast("string"))), ",")
    return good.select("item_id", "summary", F.array_join("objects", ",").alias("objects"), counts.alias("counts"), F.array_join("spatial_relations", ",").alias("relations"), "scene", F.array_join("colors", ",").alias("colors"), F.array_join("actions", ",").alias("actions"), F.array_join("search_queries", "|").alias("queries"))


@query("adapt_failures", """SELECT doc_id AS item_id, CASE doc_id % 10 WHEN 3 THEN 'another item' WHEN 4 THEN 'another file' WHEN 6 THEN 'not JSON' ELSE 'unknown shape' END AS error FROM documents WHERE doc_id % 10 IN (3, 4, 6, 7)""")
def _(spark, sf):
    """JSN-06, JSN-08: identity and digest checks."""
    rows = _payloads(spark, sf)
    return adapters.adapt(rows, rows.select("item_id", F.lit("s").alias("sha256")))[1]


@query("adapt_nested", """SELECT doc_id AS item_id, 'cap ' || doc_id AS summary, CASE WHEN doc_id % 3 > 0 THEN '猫,树,人物' ELSE '猫,树' END AS objects, '猫=' || (doc_id % 4) || ',人物=' || (doc_id % 3) AS counts, 'park' AS scene,
 'count:猫=' || (doc_id % 4) || ',fur:soft,count:人物=' || (doc_id % 3) || ',weather:rain,indoor_outdoor:outdoor,person_activity:walking' AS attributes, 'walking' AS actions, 'OPEN' AS ocr, 'calm' AS mood FROM documents""")
def _(spark, sf):
    """JSN-07: the nested shape, with persons."""
    i = F.col("doc_id")
    payload = F.concat(F.lit('{"caption_dense": "cap '), i.cast("string"), F.lit('", "scene": {"type": "park", "indoor_outdoor": "outdoor"}, "capture": {"weather": "rain"}, "objects": [{"name": "猫", "count": '), (i % 4).cast("string"), F.lit(', "attrs": {"fur": "soft"}}, "树"], "persons": {"count": '), (i % 3).cast("string"), F.lit(', "activity": "walking"}, "ocr": [{"text": "OPEN"}, "open"], "affect": {"mood": "calm"}}'))
    good, _ = adapters.adapt(read(spark, sf, "documents").select(i.alias("item_id"), payload.alias("payload")))
    counts = F.array_join(F.transform("object_counts", lambda c: F.concat_ws("=", c["name"], c["count"].cast("string"))), ",")
    return good.select("item_id", "summary", F.array_join("objects", ",").alias("objects"), counts.alias("counts"), "scene", *[F.array_join(c, ",").alias(c) for c in ("attributes", "actions")], F.array_join("ocr_text", ",").alias("ocr"), F.array_join("mood", ",").alias("mood"))


@query("normalize_text", "SELECT doc_id AS item_id, 'abc' || (doc_id % 10) || 'ss' || lower(lang) AS key FROM documents")
def _(spark, sf):
    """STR-01: full-width letters and digits, a ligature and case folding."""
    wide = F.translate(F.concat(F.lit(" A bC"), (F.col("doc_id") % 10).cast("string")), "ABCabc0123456789", "ＡＢＣａｂｃ０１２３４５６７８９")
    return read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), T.normalize(F.concat(wide, F.lit("\u3000ß\t"), F.upper("lang"))).alias("key"))


@query("filter_ocr", f"""WITH {_ANN_SQL} SELECT item_id, object LIKE '%thing3%' AS allowed, CASE WHEN object LIKE '%thing3%' THEN 'ocr_text' ELSE '' END AS matched FROM ann""")
def _(spark, sf):
    """FLT-03: terms that must be read in the item."""
    a = annotations(spark, sf).withColumn("ocr_text", F.transform("objects", lambda o: F.concat(F.lit("sign "), F.upper(o))))
    pairs = documents.normalized_fields(documents.fields(a)).select("item_id", "f", "n", "object_counts", F.array(F.lit("Thing3")).alias("ocr_terms"))
    return filters.decide(pairs, CATALOG).select("item_id", "allowed", F.array_join("matched_fields", ",").alias("matched"))


@query("judgment_format", """SELECT doc_id % 40 AS query_id, string_agg(doc_id || ':' || (quality + 1), chr(10) ORDER BY doc_id) AS judgments FROM labels GROUP BY 1""")
def _(spark, sf):
    """STR-16."""
    return judging.format_judgments(read(spark, sf, "labels").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("item_id"), (F.col("quality") + 1).alias("relevance")))


@query("set_facts", """WITH t AS (SELECT item_id % 5 AS c, 'a' || (item_id % 2) AS annotator FROM benchmark) SELECT (SELECT count(*) FROM t)::BIGINT AS tasks, (SELECT string_agg(DISTINCT annotator, ',' ORDER BY annotator) FROM t) AS annotators,
 (SELECT string_agg(c || '=' || n, ',' ORDER BY c) FROM (SELECT c, count(*) AS n FROM t GROUP BY 1)) AS categories, (SELECT count(*) FROM labels)::BIGINT AS judgments""")
def _(spark, sf):
    """AGG-16."""
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).cast("string").alias("category"), F.concat(F.lit("a"), (F.col("item_id") % 2).cast("string")).alias("annotator"))
    return judging.set_facts(b, read(spark, sf, "labels"))


@query("benchmark_summary", """WITH r AS (SELECT event_type AS method, user_id % 4 AS repeat, value, event_id % 7 <> 0 AS ok, event_id % 5 = 0 AS degraded, event_id AS peak FROM (SELECT * REPLACE (value::DECIMAL(28, 6) AS value) FROM events)), t AS (SELECT method, repeat, sum(value) AS t FROM r GROUP BY 1, 2)
 SELECT method, count(*)::BIGINT AS runs, count_if(NOT ok)::BIGINT AS failures, round(count_if(NOT ok) / count(*), 6) AS failure_rate, round(count_if(degraded) / count(*), 6) AS degraded_rate, round(sum(value)::DOUBLE / count(value), 6) AS mean_ms, round(sum(value), 4)::DOUBLE AS total_ms, max(peak)::BIGINT AS peak_bytes,
 (SELECT string_agg(round(t, 2)::DOUBLE::VARCHAR, ',' ORDER BY repeat) FROM t WHERE t.method = r.method) AS repeats FROM r GROUP BY 1""")
def _(spark, sf):
    """AGG-12, AGG-13: sums, each repeat's total, degraded ones and the peak. Sums are of decimals, here and in SQL: those of doubles differ by their order."""
    e = read(spark, sf, "events")
    runs = e.select(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("repeat"), F.col("value").alias("latency_ms"), (F.col("event_id") % 7 != 0).alias("success"), (F.col("event_id") % 5 == 0).alias("degraded"), F.col("event_id").alias("peak_bytes"))
    b = rerank.benchmark(runs)
    plain = lambda t: F.regexp_replace(F.round(t, 2).cast("decimal(38,2)").cast("string"), "0$", "")  # noqa: E731  not 1.5E7
    repeats = F.array_join(F.transform("repeat_total_ms", plain), ",")
    return b.select("method", "runs", "failures", *[F.round(c, 6).alias(c) for c in ("failure_rate", "degraded_rate", "mean_ms")], F.round("total_ms", 4).alias("total_ms"), "peak_bytes", repeats.alias("repeats"))


@query("fusion_summary", f"""WITH {_ALL_SQL}, {_fuse_sql('al', K)}, {_WEIGHTED.format('al')}, b AS (SELECT query_id, item_id, rank FROM wr WHERE rank <= {K}), j AS (SELECT coalesce(ft.query_id, b.query_id) AS query_id, ft.rank AS a, b.rank AS b FROM ft FULL JOIN b ON ft.query_id = b.query_id AND ft.item_id = b.item_id),
 o AS (SELECT query_id, 'c' || (query_id % 4) AS category, count_if(a IS NOT NULL AND b IS NOT NULL) / greatest(1, least({K}, count(*))) AS overlap, coalesce(avg(abs(a - b)), greatest(count(a), count(b))) AS rank_shift FROM j GROUP BY 1)
 SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE 'category' END AS scope, category, count(*)::BIGINT AS n, round(avg(overlap), 6) AS overlap, round(avg(rank_shift), 6) AS rank_shift FROM o GROUP BY GROUPING SETS ((), (category))""")
def _(spark, sf):
    """AGG-09."""
    r = _rankings(spark, sf)
    per = metrics.overlap(fusion.top(fusion.rrf(r), K), fusion.top(fusion.weighted(r, WEIGHTS), K, digits=6), K)
    s = metrics.overlap_summary(per.withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string"))))
    return s.select("scope", "category", "n", F.round("overlap", 6).alias("overlap"), F.round("rank_shift", 6).alias("rank_shift"))


@query("manifest_faults", f"WITH {_MAN_SQL} SELECT item_id, 'invalid' AS fault, NULL AS detail FROM m WHERE NOT valid UNION ALL SELECT item_id, 'duplicate', duplicate_of::VARCHAR FROM m WHERE duplicate_of IS NOT NULL")
def _(spark, sf):
    """SNK-01, AGG-20: what a manifest's report lists."""
    return manifest.faults(_manifest(spark, sf))


@query("route_prompts", f"WITH {_ROUTE_SQL} SELECT d.doc_id AS item_id, 'Describe.' || coalesce(chr(10) || CASE category % 2 WHEN 0 THEN 'even' WHEN 1 THEN 'odd' END, '') AS prompt FROM documents d LEFT JOIN (SELECT item_id, category FROM r WHERE place = 1) x ON x.item_id = d.doc_id")
def _(spark, sf):
    """JOI-07, SEA-11: an item's prompt follows its route."""
    routed = _routed(spark, sf)
    labels = [r[0] for r in read(spark, sf, "embeddings").select("label").distinct().collect()]  # a short list of categories
    named = routed.withColumn("category", F.col("category").cast("string"))
    return routing.prompts_for(items(spark, sf).select("item_id"), named, {str(c): "even" if c % 2 == 0 else "odd" for c in labels}, "Describe.").select("item_id", "prompt")


@query("story_sections", f"""WITH {_STORY_SQL}, g AS (SELECT *, bucket < 6 AND b2 < 6 AND b2 - bucket >= 2 AS jump, scene <> s2 AND len(list_intersect(fs, f2)) / len(list_distinct(list_concat(fs, f2))) < 0.15 AS cut FROM nx WHERE t2 IS NOT NULL),
 gp AS (SELECT story_id, turn, row_number() OVER (PARTITION BY story_id ORDER BY turn) AS gap FROM g WHERE jump OR cut) SELECT st.story_id, string_agg(st.turn || CASE WHEN gp.gap <= 2 THEN '!' ELSE '' END, ' ' ORDER BY st.turn) AS plan, count_if(gp.gap <= 2)::INTEGER AS gaps FROM st LEFT JOIN gp ON gp.story_id = st.story_id AND gp.turn = st.turn GROUP BY 1""")
def _(spark, sf):
    """JOI-09, SEA-17: each section of a story with the gap that follows it."""
    s = _stories(spark, sf)
    plan = F.array_join(F.transform("sections", lambda x: F.concat(x["item_id"].cast("string"), F.when(x["gap"].isNotNull(), "!").otherwise(""))), " ")
    return story.written(s, story.gaps(s)).select("story_id", plan.alias("plan"), "gaps")


@query("latency_windows", "SELECT time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, max(value) AS slowest FROM events GROUP BY 1, 2")
def _(spark, sf):
    """The same plan as the stream's, over a table."""
    return incremental.latency_windows(read(spark, sf, "events")).withColumn("total", F.round("total", 4))


__all__ = ["dot", "oracle_sql", "queries"]
