"""More named queries, of the service's parts: cited answers and their cache, staged runs, ledgers, measured rerankers, indexes.

Generators are stand-ins that answer by rule, so that SQL can say what must come out; all else is as in production.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.text import tokens
from heliograph.operators import ann, lexical, parsing, rerank
from heliograph.plans import answers, catalogue, clients, generation, measured, sql, stages
from heliograph.plans.catalogue import _BM25_SQL, _bm25, asked, items, query, read
from heliograph.plans.generation import AGAIN
from heliograph.sources import images, tables
from heliograph.streaming import ledger

# --- cited answers -----------------------------------------------------------------------------------------------


def _requests(spark, sf, most: int = answers.MOST) -> DataFrame:
    """The best items of each question, with their places."""
    found = _bm25(spark, sf, most).select("query_id", "item_id", F.col("rank").alias("place"))
    return found.join(asked(spark, sf).withColumnRenamed("text", "question"), "query_id")


def _witness(rows: DataFrame) -> DataFrame:
    """An item says one thing about itself; some have nothing to say, or nothing that bears on the question."""
    name = F.col("item_id").cast("string")
    facts = F.when(F.col("item_id") % 5 == 2, "[]").otherwise(F.concat(F.lit('["fact '), name, F.lit('", " "]')))
    said = F.concat(F.lit('Well: {"relevant": '), (F.col("item_id") % 4 != 1).cast("string"), F.lit(', "facts": '), facts, F.lit(', "uncertainty": "age"} so.'))
    return rows.withColumn("raw", said).withColumn("error", F.lit(None).cast("string"))


def _writer(rows: DataFrame) -> DataFrame:
    """Answers well, cites an item that isn't there until asked again, claims without citing, or refuses."""
    kind, first, last = F.col("query_id") % 4, F.col("allowed")[0], F.element_at("allowed", -1)
    again = F.col("prompt").endswith(AGAIN)
    said = (
        F.when(kind == 0, F.concat(F.lit('{"answer": "It is so [img_'), first, F.lit(']", "citations": ["'), last, F.lit('"], "confidence": 0.9}')))
        .when((kind == 1) & ~again, F.lit('{"answer": "No doubt [img_nobody]", "citations": [], "confidence": 1}'))
        .when(kind == 1, F.concat(F.lit('{"answer": "Now right [img_'), last, F.lit(']", "confidence": 0.5}')))
        .when(kind == 2, F.lit('{"answer": "Everybody knows", "citations": [], "confidence": 0.7}'))
        .otherwise(F.lit('{"answer": " ", "refused": true, "confidence": 0}'))
    )
    return rows.withColumn("raw", said).withColumn("error", F.lit(None).cast("string"))


@query("cited_answers", f"""WITH {_BM25_SQL}, u AS (SELECT query_id, rank, item_id::VARCHAR AS i FROM br WHERE rank <= {answers.MOST} AND item_id % 4 <> 1 AND item_id % 5 <> 2),
 g AS (SELECT query_id, list(i ORDER BY rank) AS ids, string_agg('fact ' || i || '[img_' || i || ']', '{answers.BETWEEN}' ORDER BY rank) || '{answers.END}' AS facts FROM u GROUP BY 1)
 SELECT b.item_id AS query_id, CASE WHEN g.ids IS NULL THEN '{answers.REFUSAL}' WHEN b.item_id % 4 = 0 THEN 'It is so [img_' || ids[1] || ']' WHEN b.item_id % 4 = 1 THEN 'Now right [img_' || ids[-1] || ']' WHEN b.item_id % 4 = 2 THEN facts ELSE '{answers.REFUSAL}' END AS answer,
 CASE WHEN g.ids IS NULL OR b.item_id % 4 = 3 THEN '' WHEN b.item_id % 4 = 0 THEN CASE WHEN ids[1] = ids[-1] THEN ids[1] ELSE ids[-1] || ',' || ids[1] END WHEN b.item_id % 4 = 1 THEN ids[-1] ELSE array_to_string(ids, ',') END AS citations,
 (CASE WHEN g.ids IS NULL OR b.item_id % 4 = 3 THEN 0 WHEN b.item_id % 4 = 0 THEN 0.9 ELSE 0.5 END)::DOUBLE AS confidence, g.ids IS NULL OR b.item_id % 4 = 3 AS refused,
 CASE WHEN g.ids IS NULL THEN 'refusal' WHEN b.item_id % 4 = 2 THEN 'evidence' ELSE 'generator' END AS source, (CASE WHEN g.ids IS NULL THEN 0 WHEN b.item_id % 4 IN (1, 2) THEN 2 ELSE 1 END)::INTEGER AS attempts FROM benchmark b LEFT JOIN g ON g.query_id = b.item_id""")
def _(spark, sf):
    """SEA-15: evidence of the best items, answers with checked citations, repairs, what stands in for an answer, refusals."""
    requests = _requests(spark, sf)
    questions = asked(spark, sf).withColumnRenamed("text", "question")
    store = answers.cache(spark, tables.scratch(spark), "long", buckets=16)
    found, _ = answers.answer(questions, requests.select("query_id", "item_id", "place"), _witness, _writer, store, "cited")
    return found.withColumn("citations", F.array_join("citations", ","))


@query("evidence_cache", f"""WITH {_BM25_SQL}, rq AS (SELECT br.*, trim(b.text) AS q FROM br JOIN benchmark b ON b.item_id = br.query_id), k1 AS (SELECT DISTINCT item_id, q FROM rq WHERE rank <= 2), k2 AS (SELECT DISTINCT item_id, q FROM rq WHERE rank <= 3), had AS (SELECT * FROM k1 WHERE item_id % 7 <> 3)
 SELECT 1 AS run, (SELECT count(*) FROM had)::BIGINT AS learned, 0::BIGINT AS reused, (SELECT count(*) FROM rq WHERE rank <= 2 AND item_id % 7 = 3)::BIGINT AS failed
 UNION ALL SELECT 2, (SELECT count(*) FROM k2 WHERE (item_id, q) NOT IN (SELECT (item_id, q) FROM had))::BIGINT, (SELECT count(*) FROM k2 SEMI JOIN had USING (item_id, q))::BIGINT, 0
 UNION ALL SELECT 3, 0, (SELECT count(*) FROM k2)::BIGINT, 0""")
def _(spark, sf):
    """SEA-16: the first run asks about all, and fails at some; the second only about what is new or failed; the third, whose generator fails at everything, about nothing."""
    store = answers.cache(spark, tables.scratch(spark), "long", buckets=16)
    down = lambda rows: rows.withColumn("raw", F.lit(None).cast("string")).withColumn("error", F.lit("down"))
    patchy = lambda rows: _witness(rows).withColumn("error", F.when(F.col("item_id") % 7 == 3, "timeout"))
    requests, out = _requests(spark, sf, 3), None
    for run, (generate, most) in enumerate(((patchy, 2), (_witness, 3), (down, 3)), 1):
        found, failed = answers.evidence(requests.filter(F.col("place") <= most), generate, store, f"run{run}")
        keys = found.groupBy("asked").agg(F.countDistinct("item_id", "question").alias("n"))
        told = keys.agg(F.coalesce(F.sum(F.when(F.col("asked"), F.col("n"))), F.lit(0)).alias("learned"), F.coalesce(F.sum(F.when(~F.col("asked"), F.col("n"))), F.lit(0)).alias("reused"))
        one = told.crossJoin(failed.agg(F.count(F.lit(1)).alias("failed"))).select(F.lit(run).alias("run"), "learned", "reused", "failed")  # a row each
        out = one if out is None else out.unionByName(one)
    return out


# --- staged runs, ledgers, clients, suites -----------------------------------------------------------------------


@query("staged_run", r"""WITH n AS (SELECT count(*)::BIGINT AS docs FROM documents), t AS (SELECT count(DISTINCT w)::BIGINT AS terms FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)) AS w FROM documents)),
 s AS (SELECT * FROM (VALUES (1, 'manifest', 'completed'), (1, 'tokens', 'completed'), (1, 'terms', 'failed'), (2, 'manifest', 'resumed'), (2, 'tokens', 'resumed'), (2, 'terms', 'made')) v(run, stage, outcome))
 SELECT run, stage, outcome, CASE WHEN stage <> 'terms' THEN docs WHEN run = 2 THEN terms END AS rows FROM s, n, t""")
def _(spark, sf):
    """A run of three stages whose last one dies, taken up again: what was done stays done. Fingerprints are of contents."""
    folder = tables.scratch(spark)

    def plan(dies: bool) -> list[stages.Stage]:
        def terms(made, _):
            if dies:
                raise RuntimeError("died")
            return made["tokens"].select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))

        return [
            stages.Stage("manifest", lambda _, __: items(spark, sf), source=True),
            stages.Stage("tokens", lambda made, _: made["manifest"].select("item_id", tokens(F.col("text")).alias("t")), ("manifest",)),
            stages.Stage("terms", terms, ("tokens",)),
        ]

    first = stages.Run(spark, folder, {"table": "documents"})
    try:
        first.run(plan(True))
    except RuntimeError:
        pass  # as planned
    told = [(1, name, s["status"], s.get("rows")) for name, s in first.state["stages"].items()]
    second = stages.Run(spark, folder, {"table": "documents"}, resume=True)
    told += [(2, name, what, second.state["stages"][name]["rows"]) for name, what in second.run(plan(False)).items()]
    return spark.createDataFrame(told, "run int, stage string, outcome string, rows long")  # a row a stage


@query("annotation_ledger", """WITH k AS (SELECT DISTINCT doc_id AS item_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)
 SELECT item_id, sha256, CASE WHEN item_id % 10 = 7 THEN 'failed' ELSE 'done' END AS status, (CASE WHEN item_id % 10 = 7 THEN 3 WHEN item_id % 10 = 3 THEN 2 ELSE 1 END)::INTEGER AS attempt FROM k""")
def _(spark, sf):
    """SNK-02, FLT-12, SEA-12: a stream annotates each version of an item once; what fails is tried again by later starts, three times in all."""
    folder = tables.scratch(spark)
    shape = read(spark, sf, "documents").schema
    prepare = lambda d: d.select(F.col("doc_id").alias("item_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("text").isNotNull().alias("valid"))

    def annotate(batch: DataFrame) -> DataFrame:
        fails = (F.col("item_id") % 10 == 7) | ((F.col("item_id") % 10 == 3) & (F.col("attempt") == 1))
        return batch.withColumn("answer", F.when(~fails, F.col("sha256"))).withColumn("error", F.when(fails, "timeout"))

    for _ in range(4):  # the last start finds nothing to do; as a pattern, the table may be a file or a folder
        ledger.annotate_new(spark, f"{sf}/documents.parque[t]", shape, prepare, annotate, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    good, bad = ledger.done(spark, f"{folder}/out"), ledger.failures(spark, f"{folder}/out")
    shaped = lambda df, s: df.select("item_id", "sha256", F.lit(s).alias("status"), "attempt")
    return shaped(good, "done").unionByName(shaped(bad, "failed"))


@query("client_backoff", "SELECT doc_id AS item_id, CASE WHEN doc_id % 4 < 3 THEN 'ok ' || doc_id END AS raw, CASE WHEN doc_id % 4 = 3 THEN 'failed after 3 attempts: TimeoutError' END AS error, least(doc_id % 4 + 1, 3)::INTEGER AS calls, ([0, 1, 3, 3])[doc_id % 4 + 1]::DOUBLE AS seconds FROM documents")
def _(spark, sf):
    """A service that is down for some prompts' first calls; waits are on a clock that only they move."""

    class Service:
        now, tries = 0.0, 0

        def clock(self):
            return self.now

        def sleep(self, seconds):
            self.now += seconds

        def call(self, prompts):
            k = int(prompts[0])
            self.tries += 1
            if self.tries <= k % 4:
                self.tries *= self.tries < 3  # the third failure is the last
                raise TimeoutError
            self.tries = 0
            return [f"ok {k}"]

    s = Service()
    ask = clients.client(s.call, clients.Policy(retries=2, tasks=8), s.clock, s.sleep)
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").cast("string").alias("prompt"))
    return ask(rows).drop("prompt")


_SUITE_SQL = f"""{_BM25_SQL}, k AS (SELECT unnest([3, 5]) AS top_k), m AS (SELECT unnest(['pointwise', 'listwise']) AS method),
 r AS (SELECT b.item_id AS q, top_k, method, row_number() OVER (ORDER BY top_k, b.item_id, method DESC) AS run, 'c' || (b.item_id % 3) AS category, NOT (method = 'listwise' AND b.item_id % 9 = 4) AS ok,
 CASE WHEN method = 'listwise' THEN length('list ' || b.item_id) % 5 + 1 ELSE (SELECT sum(length(br.query_id || ':' || br.item_id) % 5 + 1) FROM br WHERE br.query_id = b.item_id AND rank <= top_k) END AS ms FROM benchmark b, k, m)"""


@query("measured_suite", f"""WITH {_SUITE_SQL}, s AS (SELECT *, unnest(['overall', 'phase', 'top_k', 'category']) AS scope, unnest(['all', CASE WHEN run = 1 THEN 'cold' ELSE 'warm' END, top_k::VARCHAR, category]) AS part FROM r)
 SELECT scope, part, count(*)::BIGINT AS runs, count_if(NOT ok)::BIGINT AS failures, round(avg(CASE WHEN ok THEN ms END), 3) AS mean, round(quantile_cont(CASE WHEN ok THEN ms END, 0.95), 3)::DOUBLE AS p95 FROM s GROUP BY ALL""")
def _(spark, sf):
    """DRV-02, DRV-03, DRV-04: candidates once at the largest number, runs of both methods in one order, timed in their tasks."""

    class Ticks:
        now = 0

        def __call__(self):
            return self.now / 1000

    clock = Ticks()

    def call(prompt: str) -> str:
        clock.now += len(prompt) % 5 + 1
        if prompt.startswith("list ") and int(prompt[5:]) % 9 == 4:
            raise TimeoutError
        return prompt

    wanted = asked(spark, sf).select("query_id", F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")).alias("category"))
    sets, _ = measured.collected(_bm25(spark, sf, 5), wanted, (3, 5))
    name = F.col("query_id").cast("string")
    runs = measured.measured(sets, call, lambda i: F.concat(name, F.lit(":"), i.cast("string")), lambda _: F.concat(F.lit("list "), name), workers=4, most_failures=1 << 30, clock=clock, warm=None)
    told = rerank.latency_suite(runs)
    return told.select("scope", F.col("group").alias("part"), "runs", "failures", F.round("mean", 3).alias("mean"), F.round("p95", 3).alias("p95"))


# --- rankings with scores below zero, and answers that are no numbers --------------------------------------------


@query("bm25_negative", """WITH s AS (SELECT count(*) AS n, count_if(coalesce(lang, '') = 'en') AS df FROM documents), i AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS raw, df / n AS avgdl FROM s),
 sc AS (SELECT b.item_id AS query_id, d.doc_id AS item_id, round(CASE WHEN b.item_id % 2 = 0 AND coalesce(lang, '') = 'en' THEN CASE WHEN raw < 0 THEN 0.25 * raw ELSE raw END * 2.5 / (1 + 1.5 * (0.25 + 0.75 / avgdl)) ELSE 0 END, 6) AS score FROM benchmark b, documents d, i),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 10""")
def _(spark, sf):
    """SEA-04, TOP-01: a collection whose only term is in most items scores them below zero, so that items without it come first."""
    one = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.when(F.col("lang") == "en", "english").otherwise("").alias("text"))
    wanted = asked(spark, sf).select("query_id", F.when(F.col("query_id") % 2 == 0, "english").otherwise("others").alias("text"))
    found = lexical.search(lexical.build(one, tables.scratch(spark)), wanted, 10)
    return found.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("pointwise_answers", f"""WITH {_BM25_SQL}, c AS (SELECT query_id, item_id, score, rank, item_id % 5 AS k FROM br WHERE rank <= 10), r AS (SELECT *, (CASE k WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 40 ELSE 0 END)::DOUBLE AS rs FROM c),
 s AS (SELECT *, 0.35::DOUBLE * score / (CASE WHEN max(score) OVER w = 0 THEN 1 ELSE max(score) OVER w END) + 0.65::DOUBLE * rs / 100 AS cb FROM r WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, item_id, rs AS rerank_score, CASE k WHEN 2 THEN 'seen|twice' WHEN 0 THEN 'one' ELSE '' END AS evidence, CASE k WHEN 2 THEN 'age' WHEN 3 THEN 'rerank failed: names nobody' WHEN 4 THEN 'rerank failed: score is no number' ELSE '' END AS mismatch, row_number() OVER (PARTITION BY query_id ORDER BY round(cb, 9) DESC, item_id) AS new_rank FROM s""")
def _(spark, sf):
    """SEA-09, MTH-09: NaN is 0 and infinity 100; an answer's evidence and mismatch are told, and so is what failed."""
    found = _bm25(spark, sf, 10).withColumnRenamed("score", "fused_score")
    k = F.col("item_id") % 5
    said = (
        F.when(k == 0, '{"score": "NaN", "evidence": " one "}').when(k == 1, '{"score": "Infinity", "mismatch": null}').when(k == 2, 'So: {"score": 40, "evidence": ["seen", " ", "twice"], "mismatch": ["age"]}')
        .when(k == 3, '{"image_id": "nobody", "score": 90}').otherwise('{"score": "high"}')
    )
    out = rerank.pointwise(rerank.pointwise_answers(found, found.select("query_id", "item_id", said.alias("answer"))))
    return out.select("query_id", "item_id", "rerank_score", F.array_join("evidence", "|").alias("evidence"), F.array_join("mismatch", "|").alias("mismatch"), F.col("new_rank").cast("long").alias("new_rank"))


# --- inverted lists, SQL -----------------------------------------------------------------------------------------


@query("ivf_exact_topk", catalogue._knn_sql("embedding::DOUBLE[]"))
def _(spark, sf):
    """Inverted lists whose second pass makes them exact: a few cells first, then those that can still hold something better."""
    index = ann.build(catalogue.vectors(spark, sf), tables.scratch(spark), cells=16)
    found = ann.search(index, catalogue.query_vectors(spark, sf), catalogue.K, probes=4, exact=True)
    return found.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("sql_hybrid_search", catalogue.oracle_sql()["hybrid_search"].replace("SELECT query_id, item_id, rank, round(f, 6) AS fused_score, image_rank, text_rank, bm25_rank FROM ft", "SELECT query_id, item_id, rank, round(f, 6) AS fused_score FROM ft"))
def _(spark, sf):
    """The flagship search, said in SQL."""
    sql.register(catalogue.searcher(spark, sf), catalogue._parsed(spark, sf), catalogue.DEPTH, "shop_")
    return spark.sql(f"SELECT query_id, item_id, CAST(rank AS LONG) AS rank, round(fused_score, 6) AS fused_score FROM shop_hybrid_search(results => {catalogue.K})")


@query("sql_metrics", catalogue.oracle_sql()["query_metrics"])
def _(spark, sf):
    """Metrics of a ranking by a table function."""
    sql.register_metrics(spark, "long", "shop_")
    _bm25(spark, sf, catalogue.DEPTH).createOrReplaceTempView("shop_ranked")
    catalogue._judged(spark, sf).createOrReplaceTempView("shop_judged")
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in catalogue._NAMES)
    return spark.sql(f"""SELECT query_id, {rounded} FROM shop_ranking_metrics(TABLE(
        SELECT j.query_id, r.rank, j.grade FROM shop_judged j LEFT JOIN shop_ranked r ON r.query_id = j.query_id AND r.item_id = j.item_id) PARTITION BY query_id)""")


# --- image headers -----------------------------------------------------------------------------------------------


@query("image_facts", """WITH d AS (SELECT doc_id AS item_id, doc_id % 4000 AS w, length(coalesce(text, '')) + 1 AS h, ([0, 2, 3, 4, 6, 5])[doc_id % 6 + 1] AS color FROM documents),
 e AS (SELECT *, CASE WHEN color = 5 THEN 'no PNG header' WHEN w = 0 THEN 'an image without pixels' END AS error FROM d)
 SELECT item_id, error IS NULL AS valid, CASE WHEN error IS NULL THEN w END::INTEGER AS width, CASE WHEN error IS NULL THEN h END::INTEGER AS height, CASE WHEN error IS NULL THEN CASE color WHEN 0 THEN 'L' WHEN 2 THEN 'RGB' WHEN 3 THEN 'P' WHEN 4 THEN 'LA' ELSE 'RGBA' END END AS mode, error FROM e""")
def _(spark, sf):
    """SRC-01, SRC-02: sizes and modes from headers, here those of PNG files as wide as an id and as high as a text is long."""
    four = lambda n: F.lpad(F.hex(n), 8, "0")
    color = F.element_at(F.array(*map(F.lit, ("00", "02", "03", "04", "06", "05"))), (F.col("doc_id") % 6 + 1).cast("int"))
    made = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(F.col("doc_id") % 4000), four((F.length(F.coalesce("text", F.lit(""))) + 1).cast("long")), F.lit("08"), color))
    found = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), images.facts(made).alias("f"))
    return found.select("item_id", F.col("f.error").isNull().alias("valid"), "f.width", "f.height", "f.mode", "f.error")


# --- branches and parsers ----------------------------------------------------------------------------------------


@query("active_branches", catalogue.oracle_sql()["hybrid_search"].replace("SELECT query_id, item_id, rank, round(f, 6) AS fused_score, image_rank, text_rank, bm25_rank FROM ft", "SELECT query_id, count(*)::BIGINT AS items, 'image,text,bm25' AS branches FROM ft GROUP BY 1"))
def _(spark, sf):
    """SEA-03: branches are told in one order, whatever order they were given in, and one that fails isn't among them."""
    given = catalogue.branches(spark, sf)

    def broken(queries, k):
        raise OSError("no such index")

    s = catalogue.Searcher(catalogue.annotations(spark, sf), {"bm25": given["bm25"], "broken": broken, "text": given["text"], "image": given["image"]}, catalogue.CATALOG, keep=tables.kept)
    found = s.search(catalogue._parsed(spark, sf), catalogue.DEPTH, catalogue.K)
    return found.groupBy("query_id", F.array_join("active_branches", ",").alias("branches")).agg(F.count(F.lit(1)).alias("items"))


@query("parsed_by_generator", """SELECT item_id AS query_id, (['generator', 'rules_fallback', 'rules_fallback', 'rules_fallback'])[item_id % 4 + 1] AS backend, ([NULL, 'query_type', 'no JSON object', 'timeout'])[item_id % 4 + 1] AS error, CASE WHEN item_id % 4 = 0 THEN 'calm' ELSE '' END AS mood FROM benchmark""")
def _(spark, sf):
    """JSN-04: a generator's parse is merged into the rules' one; what can't be used leaves it as it was, and says why."""
    k = F.col("query_id") % 4

    def says(rows: DataFrame) -> DataFrame:
        said = F.when(k == 0, 'So: {"mood": ["calm"]}').when(k == 1, '{"query_type": "odd"}').when(k == 2, "prose")
        return rows.withColumn("raw", said).withColumn("error", F.when(k == 3, "timeout"))

    out = generation.parsed_with(parsing.parse(asked(spark, sf)), "Parse.", says)
    return out.select("query_id", "backend", "error", F.array_join("mood", ",").alias("mood"))
