"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. Only pairs (blob, rule version) that the ledger
doesn't hold are scanned, each distinct blob once however many paths have it, and the findings are joined back to
all paths.

Rows: a null text counts as an empty one (no findings); a null path is kept; repeated rows each get their findings;
an empty table gives an empty result; further columns of the input, of any names, are ignored by ``scan`` and kept by ``redact``.
Positions count code points, and ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import fresh, hot_keys, materialize, salted_join, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, non-overlapping; matches whose group ``group`` has under ``least`` characters drop.

    ``hint``: a literal that every match contains, tested first; ``version`` changes whenever the rule does.
    """

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The words of the assignment rule, in either case of each letter.
ASSIGN_WORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"

BASE_RULES = (
    Rule("assign", 1, ASSIGN_WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2),
    # runs that are long enough: the same matches as those of the open runs that aren't dropped as too short
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: What the ledger's rule set adds to the base ones.
MORE_RULES = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
RULES = BASE_RULES + MORE_RULES
# Private keys as a whole, where pem@1 finds their first line: to the END line if no other such line is before it, else
# header lines and base64 that follow. Possessive, so that Java matches long keys without recursion.
_PEM = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_PEM_GAP = r"""(?:\s|\\[nrt]|["'+>,|*#;])*+"""
_PEM_END = f"[^-]*+(?:-{{1,4}}[^-]++)*+-----END {_PEM}"
_PEM_REST = rf"(?:\s*+[A-Za-z][A-Za-z-]*+: [^\n]*+\n)*+(?:(?:{_PEM_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_PEM_GAP}[A-Za-z0-9+/]++={{1,2}}|\s*+[A-Za-z0-9+/]++(?=\s*+(?:\n|$)))?+)?+"
#: What is redacted. RULES, and the SQL that states them, keep pem@1.
REDACTED_RULES = tuple(Rule("pem", 2, f"-----BEGIN {_PEM}(?:{_PEM_END}|{_PEM_REST})", hint="PRIVATE KEY") if r.kind == "pem" else r for r in RULES)
FINDING = "struct<kind:string,start:int,end:int,value:string>"


def _quick(rule: Rule, text: Column) -> Column:
    """A cheap test that holds wherever the rule has a match that stays."""
    if rule.hint:
        return text.contains(rule.hint)
    return text.rlike(rule.pattern)


def _matches(rule: Rule, text: Column) -> Column:
    """Array of findings. Split at the matches; the pieces' and the matches' lengths add up to the positions."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.struct(
        found.alias("found"),
        F.split(text, rule.pattern, -1).alias("gaps"),
        (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found).alias("kept"),
    )

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(acc["of"]["gaps"], i))
        value = F.element_at(acc["of"]["found"], i)
        end = start + F.length(value)
        item = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
        long_enough = F.length(F.element_at(acc["of"]["kept"], i)) >= rule.least
        return F.struct(end.alias("at"), F.when(long_enough, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"), acc["of"].alias("of"))

    none = F.array().cast(f"array<{FINDING}>")
    walked = F.transform(
        F.array(parts),
        lambda p: F.aggregate(
            F.when(F.size(p["found"]) > 0, F.sequence(F.lit(1), F.size(p["found"]))).otherwise(F.array().cast("array<int>")),
            F.struct(F.lit(0).alias("at"), none.alias("out"), p.alias("of")),
            step,
            lambda acc: acc["out"],
        ),
    )
    return F.when(_quick(rule, text), F.element_at(walked, 1)).otherwise(none)


def find(text: Column, rules: tuple[Rule, ...] = RULES, todo: Column | None = None) -> Column:
    """Findings of ``text`` by start, then by the rules' order; of rules whose key is in ``todo`` if that is given."""
    none = F.array().cast(f"array<{FINDING}>")
    each = [F.when(F.array_contains(todo, r.key), _matches(r, text)).otherwise(none) if todo is not None else _matches(r, text) for r in rules]
    order = F.array(*[F.lit(r.kind) for r in rules])

    def compare(a: Column, b: Column) -> Column:
        by_kind = F.array_position(order, a["kind"]) - F.array_position(order, b["kind"])
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(by_kind.cast("int"))

    return F.array_sort(F.concat(*each), compare)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """One row a distinct blob with work left: blob, n (its versions), todo (rule keys scanned now), findings.

    ``ledger`` has (blob, rule) pairs already scanned. Texts of blobs with no pair left are dropped before they are
    shuffled where the list of blobs with work left is small enough to be broadcast, else after map-side merging.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    each = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("_seen"))  # at most one entry a rule
        left = each.select("blob").distinct().join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("_seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0).select("blob", "todo")
        left = materialize(left)
        if left.count() <= 100_000:  # 64 characters and a few rule keys a row: under 20 MB
            each = each.join(F.broadcast(left.select("blob")), "blob", "left_semi")
        blobs = each.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.first("_text").alias("_text")).join(left, "blob")
    else:
        blobs = each.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.first("_text").alias("_text")).withColumn("todo", keys)
    return blobs.select("blob", "n", "todo", find(F.col("_text"), rules, F.col("todo") if ledger is not None else None).alias("findings"))


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by path, findings by blob, new ledger).

    ``earlier`` has the findings by blob of earlier runs. By path: path, blob, findings - one row for each row of
    ``versions``. Both other results are to be kept for the next run.
    """
    scanned = materialize(scan_blobs(versions, text, rules, ledger))
    ours = scanned.select("blob", F.explode("findings").alias("finding"))
    fresh = scanned.select("blob", F.explode("todo").alias("rule"))
    current = [r.kind for r in rules]
    if earlier is not None:
        old = earlier.select("blob", F.explode("findings").alias("finding")).filter(F.col("finding.kind").isin(current))
        # a rule that was scanned anew replaces what its earlier version found
        redone = fresh.select("blob", F.substring_index("rule", "@", 1).alias("kind"))
        old = old.withColumn("kind", F.col("finding.kind")).join(redone, ["blob", "kind"], "left_anti").select("blob", "finding")
        ours = ours.unionByName(old)
        order = F.array(*[F.lit(k) for k in current])
        merged = ours.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(F.col("finding.start").alias("s"), F.array_position(order, F.col("finding.kind")).alias("k"), "finding"))).alias("f"))
        found = merged.select("blob", F.transform("f", lambda x: x["finding"]).alias("findings"))
    else:
        found = scanned.filter(F.size("findings") > 0).select("blob", "findings")
    paths = versions.select(F.col(path).alias("path"), blob_of(F.col(text)).alias("blob"))
    counted = paths.groupBy("blob").count() if ledger is not None else scanned.select("blob", F.col("n").alias("count"))
    hot = hot_keys(counted, "blob", "count")
    by_path = salted_join(paths, found, "blob", hot, "left", spread="path").withColumn("findings", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")))
    ledgered = fresh if ledger is None else ledger.select("blob", "rule").unionByName(fresh).distinct()
    return by_path, found, ledgered


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "[REDACTED]", rules: tuple[Rule, ...] = REDACTED_RULES) -> DataFrame:
    """``docs`` with each stretch of overlapping findings in its text replaced by ``mark``; other rows are as they were.

    Each distinct blob is scanned once; the redacted text is made beside the row's own text, from its blob's spans.
    """
    blob, spans = fresh(docs, "blob"), fresh(docs, "spans")
    scanned = materialize(scan_blobs(docs, text, rules))
    found = scanned.filter(F.size("findings") > 0).select("blob", F.transform("findings", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(spans)).withColumnRenamed("blob", blob)
    hot = hot_keys(scanned, "blob", "n")

    def step(acc: Column, x: Column) -> Column:
        start, end = F.greatest(x["start"], acc["at"]), F.greatest(x["end"], acc["at"])
        piece = F.concat(F.substring(acc["of"], acc["at"] + 1, start - acc["at"]), F.when(x["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(end.alias("at"), F.concat(acc["out"], piece).alias("out"), acc["of"].alias("of"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.col(text).alias("of"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(acc["of"], acc["at"] + 1, F.length(acc["of"]))))
    hit = salted_join(docs.withColumn(blob, blob_of(F.col(text))), found, blob, hot, "left", spread=id)
    return hit.withColumn(text, F.when(F.col(spans).isNotNull(), clean).otherwise(F.col(text))).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents: counts and spans of secrets, in two runs over the ledger.

    The first scans each distinct blob once. The second has the first one's ledger and findings, as a run over the same
    history has after new versions came in: it scans the pairs of blob and rule that the ledger lacks (none here), and joins
    the findings kept for the blobs back to all paths.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found, ledger = scan(docs)
    by_path, _, _ = scan(docs, ledger=ledger, earlier=found)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    return by_path.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    """DuckDB: the same walk over pieces and matches."""
    p = pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda i: {{
        's': list_sum(list_transform(string_split_regex(t, '{p}')[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:i-1], lambda g: length(g))), 0)::BIGINT,
        'l': length(regexp_extract_all(t, '{p}')[i])::BIGINT, 'g': length(regexp_extract_all(t, '{p}', {group})[i])::BIGINT}}), lambda x: x.g >= {least})"""


def op1_sql() -> str:
    parts, names = [], []
    # the base rules as they are stated: open runs, of which short ones drop
    base = {"access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}
    for n, r in enumerate(RULES):
        pattern, least = base.get(r.kind, (r.pattern, r.least))
        quoted = pattern.replace("'", "''")
        hint = f"t LIKE '%{r.hint}%'" if r.hint else f"regexp_matches(t, '[0-9a-f]{{{least}}}')" if r.kind == "hex" else f"regexp_matches(t, '{quoted}')"
        parts.append(f"CASE WHEN {hint} THEN {_sql_spans(r.kind, pattern, r.group, least)} ELSE [] END AS f{n}")
        names.append(f"list_transform(f{n}, lambda x: {{'s': x.s, 'k': {n}, 'v': '{r.kind}:' || x.s || ':' || (x.s + x.l)}})")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT doc_id, {', '.join(parts)} FROM d),
    a AS (SELECT doc_id, len(f0)::BIGINT AS n_assign, len(f1)::BIGINT AS n_access, len(f2)::BIGINT AS n_hex,
        list_sort(list_concat({names[0]}, list_concat({names[1]}, {names[2]}))) AS base,
        list_sort(list_concat({names[0]}, list_concat({names[1]}, list_concat({names[2]}, list_concat({names[3]}, list_concat({names[4]}, list_concat({names[5]}, {names[6]}))))))) AS spans FROM m)
    SELECT doc_id, n_assign, n_access, n_hex,
        sha256(coalesce(array_to_string(list_transform(base, lambda x: x.v), ','), '')) AS base_sha256,
        coalesce(array_to_string(list_transform(spans, lambda x: x.v), ','), '') AS spans FROM a"""
