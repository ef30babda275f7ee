"""Gap sessionisation: clicks of a client in sessions cut by final clicks, gaps and a greatest length.

Final clicks and gaps cut a client's clicks into islands at once; only islands longer than a session may be need iteration,
because each length cut depends on the one before. These hard islands form a frontier: in each round all of them find their
next length cut by an as-of join (the first click after the current session's first by more than the greatest length), the
round's cuts are written to the shared folder, and islands whose rest is short enough are dropped, until none is left. There
are as many rounds as the longest island has cuts.

No client is ever in one task. Time is cut in blocks as long as a gap, and work is dealt by client and block: a click's
predecessor matters only if it lies in the same block or in the one before (from earlier ones there is a gap anyway), and so
does the next click within an island. What must be handed on further (the last start before a block) goes up a tree of
blocks, with one row a client and stretch of FAN blocks at its top, however many clicks these have.

Rows: clicks with a null id, client or time are passed over; of rows that share an id one counts, the least by time, arrival,
client, finality and value; a null arrival isn't late, a null kind not final; null, NaN and infinite values are 0; ties in time go
by id; clients without a timely click have no session; further columns, whatever their names, are left out; an empty table
gives an empty result. A session's path is one value, as long as the session; nothing else is gathered. Times without a zone
count as UTC, whatever the session's zone is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import materialize, shared_folder, table

MINUTE = 60_000_000
#: Blocks of a stretch at the top of the tree.
FAN = 64


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970, UTC."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(F.col(name))
    return F.expr(f"cast(cast(cast(`{name}` - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6)) * 1000000 as bigint)")


def _floor(us: Column, width: int) -> Column:
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def _clean(clicks: DataFrame, late: int, final_kind: str, final_value: float) -> DataFrame:
    """click_id, client_id, us, late, fin, cents: a row a click."""
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    us, arrived = micros(clicks, "ts"), micros(clicks, "arrived_at")
    rows = clicks.filter("click_id is not null and client_id is not null and ts is not null").select(
        "click_id",
        F.struct(
            us.alias("us"),
            arrived.alias("arrived"),
            F.col("client_id").alias("client_id"),
            F.coalesce((F.col("kind") == final_kind) & (value >= final_value), F.lit(False)).alias("fin"),
            F.coalesce(F.floor(value * 100 + F.lit(0.5)).cast("long"), F.lit(0)).alias("cents"),
        ).alias("r"),
    )
    # few rows repeat a click: they are sorted where they arrive, not before and after
    one = rows.repartition("click_id").groupBy("click_id").agg(F.min("r").alias("r")).select("click_id", "r.*")
    return one.select("click_id", "client_id", "us", F.coalesce(F.col("arrived") - F.col("us") > late, F.lit(False)).alias("late"), "fin", "cents")


def _before(blocks: DataFrame, key: str) -> DataFrame:
    """key, block, before: the greatest ``mark`` of the key's earlier blocks; ``blocks`` may have several rows a block."""
    heads = blocks.groupBy(key, "block").agg(F.max("mark").alias("mark")).withColumn("stretch", _floor(F.col("block"), FAN))
    earlier = Window.partitionBy(key, "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = heads.groupBy(key, "stretch").agg(F.max("mark").alias("top"))
    above = Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("above", F.max("top").over(above)).drop("top")
    heads = heads.withColumn("within", F.max("mark").over(earlier)).drop("mark")
    return heads.join(tops.hint("merge"), [key, "stretch"]).select(key, "block", F.coalesce("within", "above").alias("before"))


def _filled(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``rows`` whose null ``mark`` is the last one of the earlier blocks; these are found once, however often the result is read."""
    whole, open_ = rows.filter("mark is not null"), rows.filter("mark is null").drop("mark")
    found = open_.join(_before(blocks, key).hint("merge"), [key, "block"], "left").withColumnRenamed("before", "mark")
    return whole.unionByName(materialize(found))


def _islands(timely: DataFrame, gap: int) -> DataFrame:
    """Each click with ``mark``: (us, click_id) of its island's first."""
    timely = timely.withColumn("block", _floor(F.col("us"), gap))
    lasts = timely.groupBy("client_id", "block").agg(F.max(F.struct("us", "click_id", "fin")).alias("last"))
    guests = lasts.select("client_id", (F.col("block") + 1).alias("block"), "last.us", F.lit(None).cast("long").alias("click_id"), "last.fin", F.lit(0).cast("long").alias("cents"))
    by = Window.partitionBy("client_id", "block").orderBy("us", "click_id")  # a guest from the block before comes first
    rows = timely.select(*guests.columns).unionByName(guests)
    rows = rows.withColumn("ago", F.col("us") - F.lag("us").over(by)).withColumn("cut", F.lag("fin").over(by))
    first = F.col("click_id").isNotNull() & (F.col("ago").isNull() | F.col("cut") | (F.col("ago") >= gap))
    rows = rows.withColumn("mark", F.max(F.when(first, F.struct("us", "click_id"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = materialize(rows.filter("click_id is not null").drop("ago", "cut"))
    return _filled(rows, rows, "client_id")


def _length_cuts(rest: DataFrame, gap: int, span: int) -> DataFrame | None:
    """island, us, click_id, previous: the starts that length cuts make among ``rest``, the clicks past their island's first session."""
    spark, at = rest.sparkSession, f"{shared_folder(rest.sparkSession)}/cuts-{uuid.uuid4().hex}"
    found = rest.groupBy("island").agg(F.min(F.struct("us", "click_id")).alias("cut"), F.max("us").alias("end_us"), F.first("island").alias("previous"))
    n = 0
    while True:
        found.select("island", "cut.us", "cut.click_id", "previous", "end_us").write.parquet(f"{at}/round={n}")
        frontier = spark.read.parquet(f"{at}/round={n}")
        live = frontier.filter(F.col("end_us") - F.col("us") > span)
        if live.isEmpty():
            return spark.read.parquet(at).drop("round", "end_us")
        reach = _floor(F.col("reach"), gap)
        probes = live.select("island", "end_us", F.col("click_id").alias("previous"), (F.col("us") + span).alias("reach"))
        probes = probes.withColumn("block", F.explode(F.array(reach, reach + 1)))  # inside an island the next click is no gap away
        asof = rest.select("island", "block", "us", "click_id").join(probes.hint("merge"), ["island", "block"]).filter("us > reach")
        found = asof.groupBy("island", "end_us", "previous").agg(F.min(F.struct("us", "click_id")).alias("cut"))
        n += 1


def _dealt(rest: DataFrame, cuts: DataFrame, gap: int, span: int) -> DataFrame:
    """``rest`` with ``session_id``: the last cut that isn't after the click. A cut is a guest in all blocks that its session reaches."""
    spread = cuts.select("island", F.explode(F.sequence(_floor(F.col("us"), gap), _floor(F.col("us") + span, gap))).alias("block"), "us", "click_id", F.struct("us", "click_id").alias("cut"))
    rows = rest.withColumn("own", F.lit(1)).unionByName(spread.withColumn("own", F.lit(0)), allowMissingColumns=True)
    by = Window.partitionBy("island", "block").orderBy("us", "click_id", "own").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session_id", F.max("cut").over(by)["click_id"]).filter("own = 1").drop("own", "cut")


def sessions(clicks: DataFrame, gap_minutes: int = 30, span_minutes: int = 120, late_minutes: int = 60, final_kind: str = "purchase", final_value: float = 60.0) -> DataFrame:
    """client_id, session_id, start_us, end_us, n_clicks, n_late, value_cents, closed_by, path (click ids in order)."""
    gap, span = gap_minutes * MINUTE, span_minutes * MINUTE
    clean = materialize(_clean(clicks, late_minutes * MINUTE, final_kind, final_value))
    timely, late = clean.filter("not late").drop("late"), materialize(clean.filter("late").select("client_id", "us"))  # the few late ones are read four times

    clicks = _islands(timely, gap).withColumn("island", F.col("mark.click_id")).withColumn("past", F.col("us") - F.col("mark.us") > span).drop("mark")
    rest = materialize(clicks.filter("past").drop("past"))
    dealt = clicks.filter("not past").drop("past").withColumn("session_id", F.col("island"))
    by_length = None
    if not rest.isEmpty():
        cuts = _length_cuts(rest, gap, span)
        dealt = dealt.unionByName(_dealt(rest, cuts, gap, span))
        by_length = cuts.select(F.col("previous").alias("session_id"), F.lit(True).alias("by_length"))

    found = dealt.groupBy("client_id", "session_id").agg(
        F.min("us").alias("start_us"),
        F.max(F.struct("us", "click_id", "fin")).alias("last"),
        F.count(F.lit(1)).alias("n_clicks"),
        F.sum("cents").alias("value_cents"),
        F.sort_array(F.collect_list(F.struct("us", "click_id")))["click_id"].alias("path"),
    )
    found = materialize(found)
    lasts = found.groupBy("client_id").agg(F.max("last")["click_id"].alias("last_id")).select("last_id", F.lit(True).alias("is_last"))

    # late clicks belong to the last session that begins no later
    at = F.struct(F.col("start_us").alias("us"), F.col("session_id").alias("click_id")).alias("mark")
    marks = found.select("client_id", _floor(F.col("start_us"), gap).alias("block"), F.col("start_us").alias("us"), at, F.lit(0).alias("late"))
    both = marks.unionByName(late.select("client_id", _floor(F.col("us"), gap).alias("block"), "us", F.lit(1).alias("late")), allowMissingColumns=True)
    by = Window.partitionBy("client_id", "block").orderBy("us", "late").rowsBetween(Window.unboundedPreceding, 0)
    asof = both.withColumn("mark", F.max("mark").over(by)).filter("late = 1")
    n_late = _filled(asof, both, "client_id").filter("mark is not null").groupBy(F.col("mark.click_id").alias("session_id")).agg(F.count(F.lit(1)).alias("n_late"))

    out = found.withColumn("last_id", F.col("last.click_id")).join(lasts.hint("merge"), "last_id", "left").join(n_late.hint("merge"), "session_id", "left")
    out = out.join(by_length.hint("merge"), "session_id", "left") if by_length is not None else out.withColumn("by_length", F.lit(None).cast("boolean"))
    closed = F.when(F.col("last.fin"), "end").when(F.col("by_length"), "length").when(F.col("is_last"), "none").otherwise("gap")
    return out.select("client_id", "session_id", "start_us", F.col("last.us").alias("end_us"), "n_clicks", F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"), "value_cents", closed.alias("closed_by"), "path")


def op11(spark, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "clicks"))
    return found.withColumn("path_sha256", F.sha2(F.array_join(F.col("path").cast("array<string>"), ","), 256)).drop("path")


def op11_sql() -> str:
    return """
    WITH RECURSIVE one AS (
      SELECT DISTINCT ON (click_id) click_id, client_id, epoch_us(ts) AS us,
             coalesce(epoch_us(arrived_at) - epoch_us(ts) > 3600000000, false) AS late,
             coalesce(kind = 'purchase' AND value >= 60, false) AS fin,
             coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
      FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL ORDER BY click_id, ts, arrived_at, client_id, kind, value),
    prior AS (
      SELECT *, lag(us) OVER w AS before_us, lag(fin) OVER w AS before_fin FROM one WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
    numbered AS (
      SELECT *, sum(CASE WHEN before_us IS NULL OR before_fin OR us - before_us >= 1800000000 THEN 1 ELSE 0 END) OVER w AS k FROM prior
      WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
    isled AS (SELECT *, first_value(click_id) OVER w AS island, first_value(us) OVER w AS island_us FROM numbered WINDOW w AS (PARTITION BY client_id, k ORDER BY us, click_id)),
    hard AS (SELECT * FROM isled WHERE island IN (SELECT island FROM isled WHERE us - island_us > 7200000000)),
    cuts AS (
      SELECT island, island AS session_id, island_us AS us FROM isled WHERE click_id = island
      UNION ALL
      SELECT island, nxt.click_id, nxt.us FROM (
        SELECT c.island, min(struct_pack(us := h.us, click_id := h.click_id)) AS nxt
        FROM cuts c JOIN hard h ON h.island = c.island AND h.us > c.us + 7200000000 GROUP BY c.island)),
    dealt AS (
      SELECT i.*, arg_max(c.session_id, struct_pack(us := c.us, click_id := c.session_id)) AS session_id
      FROM isled i JOIN cuts c ON c.island = i.island AND (c.us, c.session_id) <= (i.us, i.click_id) GROUP BY ALL),
    found AS (
      SELECT client_id, session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents,
             arg_max(fin, struct_pack(us := us, click_id := click_id)) AS fin,
             sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY us, click_id)) AS path_sha256
      FROM dealt GROUP BY client_id, session_id),
    following AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY start_us, session_id) AS next_us FROM found),
    lates AS (
      SELECT f.session_id, count(*) AS n_late FROM following f JOIN one o
      ON o.late AND o.client_id = f.client_id AND o.us >= f.start_us AND (f.next_us IS NULL OR o.us < f.next_us) GROUP BY f.session_id)
    SELECT client_id, f.session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents,
           CASE WHEN fin THEN 'end' WHEN next_us IS NULL THEN 'none' WHEN next_us - end_us >= 1800000000 THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
    FROM following f LEFT JOIN lates l ON l.session_id = f.session_id"""
