"""Secret scans over an incremental blob ledger.

Each version of a document is addressed by the SHA-256 of its text (a blob). A ledger records every
(blob, rule, version of the rule) that was scanned, with the spans found, so that a later run scans
only pairs that it has not seen; copies of a text are scanned once. Beside it lie all paths (documents)
with every blob that they ever held, so that findings are joined back to all paths of all runs
(``history``) or to the rows at hand (``scan``, ``redact``). All of it is DataFrame expressions.

Defined cases: a null text is the empty text; an empty text has no span; repeated rows stay; a very long text is
scanned whole, in time linear in it; a null id has no path in the history; an empty table gives no rows; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.arrays import bound, emitted
from brindle.llm.common import scratch, whole


@dataclass(frozen=True)
class Rule:
    """``group`` of a match needs ``least`` characters; a match that has fewer is dropped.
    ``hint`` is a cheaper pattern that every text with a match has."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds, in their order. The run lengths of `access` and `hex` are in
#: the pattern, which finds the same spans as dropping short runs, as a run has one leftmost match.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

SPAN = "struct<start:int,stop:int>"
LEDGER = f"blob binary, spans array<{SPAN}>, rule string"
PATHS = "path string, blob binary, seen bigint"
#: Tasks that the rows of one blob are dealt to; characters of the windows that texts are cut by.
SALTS, WIDE = 16, 4096


def spans_of(text: Column, rule: Rule) -> Column:
    """Code-point spans of the matches: pieces between matches and matches, laid end to end."""
    none = F.array().cast(f"array<{SPAN}>")
    pattern = F.lit(rule.pattern)
    steps = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, 0), F.char_length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, rule.group), F.char_length).alias("part"),
    )

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), end.alias("stop"))
        return F.coalesce(end, at), F.when(x["part"] >= rule.least, F.array(span)).otherwise(none)

    return F.when(text.rlike(rule.pattern), emitted(steps, F.lit(0), f"array<{SPAN}>", step)).otherwise(none)


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(whole(text), 256))


def addressed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", whole("text").alias("text")).withColumn("blob", blob_of(F.col("text")))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """``blob, rule, spans`` of everything that was ever scanned."""
    return _read(spark, f"{path}/scans", LEDGER)


def read_paths(spark: SparkSession, path: str) -> DataFrame | None:
    """``path, blob, seen``: every text that a path (document) ever had, and the run that saw it first."""
    return _read(spark, f"{path}/paths", PATHS)


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES) -> None:
    """Scan the (blob, rule version) pairs that the ledger at ``path`` lacks, and append them; note which
    paths hold which blobs now, without forgetting what they held before.

    One row of each blob is kept before the shuffle (partial ``first``), so that thousands of copies of
    a text send one row from each task. Scans lie by rule, so those of other rules aren't read; what is
    known of the others is grouped by blob, the key of the join, so that it is shuffled once."""
    spark = docs.sparkSession
    blobs = addressed(docs).groupBy("blob").agg(F.first("text").alias("text"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if (ledger := read_ledger(spark, path)) is not None:
        known = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("known"))
        blobs = blobs.join(known, "blob", "left").withColumn("due", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))))
    else:
        blobs = blobs.withColumn("due", keys)
    blobs = blobs.where(F.size("due") > 0)
    scans = [F.when(F.array_contains("due", r.key), F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("text"), r).alias("spans"))) for r in rules]
    blobs.select("blob", F.inline(F.array_compact(F.array(*scans)))).write.mode("append").partitionBy("rule").parquet(f"{path}/scans")

    held = docs.select(F.col("doc_id").cast("string").alias("path"), blob_of(F.col("text")).alias("blob")).where("path is not null").distinct()
    if (before := read_paths(spark, path)) is not None:
        run = (before.agg(F.max("seen")).first()[0] or 0) + 1
        held = held.join(before.select("path", "blob"), ["path", "blob"], "left_anti").withColumn("seen", F.lit(run).cast("bigint"))
    else:
        held = held.withColumn("seen", F.lit(1).cast("bigint"))
    held.select("path", "blob", "seen").write.mode("append").parquet(f"{path}/paths")


def findings(docs: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``blob`` and ``found``, an array of (start, order, stop, kind) by start, then the rules' order."""
    ledger = read_ledger(docs.sparkSession, path)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    rows = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).select("blob", "rule", order[F.col("rule")].alias("nth"), F.inline("spans"))
    return rows.distinct().groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "nth", "stop", F.substring_index("rule", "@", 1).alias("kind")))).alias("found"))


def _with_found(rows: DataFrame, docs: DataFrame, path: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (blob, mix and others) with ``found``. A blob that many rows hold is dealt to ``SALTS`` tasks by
    ``mix``; only findings, of few blobs, are repeated for that."""
    found = findings(docs, path, rules).select("blob", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod("mix", F.lit(SALTS)).cast("int")).join(found, ["blob", "salt"], "left")


def scan(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``doc_id``, ``blob`` and ``found`` (null: none) of every row of ``docs``."""
    path = path or scratch(docs.sparkSession, "secret-ledger")
    update_ledger(docs, path, rules)
    rows = docs.select("doc_id", blob_of(F.col("text")).alias("blob"), F.xxhash64("doc_id").alias("mix"))
    return _with_found(rows, docs, path, rules).select("doc_id", "blob", "found")


def history(spark: SparkSession, path: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``path, blob, seen, found``: every version of every path ever seen that holds a secret by ``rules``. A
    version that a rule hasn't scanned, since its text was gone when the rule came, shows the others' findings."""
    paths = read_paths(spark, path).withColumn("mix", F.xxhash64("path"))
    return _with_found(paths, paths, path, rules).where("found is not null").select("path", "blob", "seen", "found")


def _cut(text: Column, found: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of its spans. The text is laid in windows first, so that a piece is
    taken from its own windows and not looked for from the text's beginning."""
    piece = "struct<low:int,high:int>"

    def gap(at: Column, x: Column) -> tuple[Column, Column]:
        own = F.array(F.struct(at.alias("low"), x["start"].alias("high")))
        return F.greatest(at, x["stop"]), F.when(x["start"] >= at, own).otherwise(F.array().cast(f"array<{piece}>"))

    gaps = emitted(found, F.lit(0), f"array<{piece}>", gap, lambda at: F.array(F.struct(at.alias("low"), F.greatest(at, F.char_length(text)).alias("high"))))

    def taken(windows: Column) -> Column:
        def one(k: Column, p: Column) -> Column:
            low = F.greatest(p["low"] - k * WIDE, F.lit(0))
            return F.get(windows, k).substr(low + 1, F.least(p["high"] - k * WIDE, F.lit(WIDE)) - low)

        whole_piece = lambda p: F.array_join(F.transform(F.sequence(F.floor(p["low"] / WIDE).cast("int"), F.floor((p["high"] - 1) / WIDE).cast("int")), lambda k: one(k, p)), "")
        return F.array_join(F.transform(gaps, lambda p: F.when(p["high"] > p["low"], whole_piece(p)).otherwise("")), mark)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDE}}}"), F.lit(0)), taken)


def redact(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret of ``text`` replaced by ``mark``; overlapping spans are one. Null stays null; other
    columns stay as they are, whatever their names."""
    path = path or scratch(docs.sparkSession, "secret-ledger")
    update_ledger(docs, path, rules)
    rows = docs.select(F.struct("*").alias("row")).select("row", blob_of(F.col("row")["text"]).alias("blob"), F.xxhash64(F.col("row")["doc_id"]).alias("mix"))
    text = F.col("row")["text"]
    clean = F.when(F.size("found") > 0, _cut(text, F.col("found"), mark)).otherwise(text)
    return _with_found(rows, docs, path, rules).select(F.col("row").withField("text", clean).alias("row")).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``scan`` returns."""
    of = F.coalesce("found", F.array().cast("array<struct<start:int,nth:int,stop:int,kind:string>>"))
    joined = F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    count = lambda kind: F.size(F.filter(of, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


_ASSIGN, _ACCESS, _HEX = (r.pattern.replace("'", "''") for r in BASE_RULES)


def _sql_spans(kind: str, nth: int, pattern: str, group: int, least: int) -> str:
    return f"""
 {kind}_raw AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS g,
   list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS m,
   list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS p
  FROM texts WHERE regexp_matches(t, '{pattern}')),
 {kind}_found AS (SELECT doc_id, {nth} AS nth, '{kind}' AS kind,
   (list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))::BIGINT AS s, m[i] AS n
  FROM {kind}_raw, unnest(range(1, len(m) + 1)) AS u(i) WHERE p[i] >= {least})"""


ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans("assign", 0, _ASSIGN, 2, 6)},{_sql_spans("access", 1, _ACCESS, 0, 1)},{_sql_spans("hex", 2, _HEX, 0, 1)},
 spans_of AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
   count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, nth) AS spans
  FROM (FROM assign_found UNION ALL FROM access_found UNION ALL FROM hex_found) GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
 sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN spans_of USING (doc_id)"""
