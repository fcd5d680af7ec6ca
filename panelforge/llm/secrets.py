r"""Secret scans with an incremental blob ledger.

Every version of a document is a blob, addressed by the SHA-256 of its text. The
ledger holds, for every blob, which rules in which version have scanned it and
the spans that they found. A run scans only blobs with rules that the ledger
does not have for them, each blob once however many documents carry it, and
joins the findings back to all documents. Raising the version of a rule scans
all blobs with that rule again and with no other.

Edge cases: a null text is an empty blob; documents with equal texts share one
scan; repeated rows come out repeated; null ids are kept; an empty table gives
an empty result and ledger. Positions are code points, ends exclusive. Further
columns of the documents are not read. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost matches that do not overlap; least: characters that group must have, else the match is dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base rules of the contract, then the rules added to them.
# Runs of at least 32 (or AKIA and 12 more) are what remains of all runs after the length test.
BASE = (
    Rule("assign", 1, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("private", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED

LEDGER = "blob string, found array<struct<rule:string,spans:array<struct<start:int,end:int>>>>"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the matches: a running sum of what lies between them and of their own lengths gives the positions."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matched = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    # what lies between matches and they themselves, one after the other; behind the last match there is no further one
    parts = F.filter(F.zip_with(F.zip_with(between, matched, lambda b, m: F.struct(b.alias("b"), m.alias("m"))), values, lambda x, v: F.struct(x["b"].alias("b"), x["m"].alias("m"), v.alias("v"))), lambda x: x["m"].isNotNull())

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["b"]
        span = F.struct(start.alias("start"), (start + x["m"]).alias("end"))
        return F.struct((start + x["m"]).alias("at"), F.when(x["v"] >= rule.least, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda state: state["found"])
    # one cheap test first: nearly all texts have no match
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def blob(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, found) for every blob of docs and the rules that the ledger lacks for it."""
    versions = docs.select("doc_id", text_or_empty().alias("text"))
    addressed = versions.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id"), blob(F.col("text")).alias("blob"))
    owners = addressed.groupBy("blob").agg(F.min("_id").alias("_id"))
    names = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        pending = owners.withColumn("_rules", names)
    else:
        seen = ledger.select("blob", F.explode("found.rule").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        pending = owners.join(seen, "blob", "left").withColumn("_rules", F.array_except(names, F.coalesce("_seen", F.array().cast("array<string>")))).drop("_seen")
        pending = pending.where(F.size("_rules") > 0)
    texts = versions.select(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("_id"), "text", blob(F.col("text")).alias("blob"))
    unseen = texts.join(pending, ["_id", "blob"])
    text = F.col("text")
    nothing = F.lit(None).cast("struct<rule:string,spans:array<struct<start:int,end:int>>>")
    scans = [F.when(F.array_contains("_rules", r.name), F.struct(F.lit(r.name).alias("rule"), spans(text, r).alias("spans"))).otherwise(nothing) for r in rules]
    found = unseen.select("blob", F.filter(F.array(*scans), lambda x: x.isNotNull()).alias("found"))
    return found.dropDuplicates(["blob"])  # an owner's row may be repeated


def merged(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with the rows of a further run: one row for each blob, with every rule that has scanned it."""
    every = ledger.unionByName(new).select("blob", F.explode("found").alias("f"))
    return every.groupBy("blob").agg(F.array_sort(F.collect_set("f")).alias("found"))


def append_ledger(spark: SparkSession, path: str, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger table at path lacks for docs, append it to the table, and return the whole ledger.

    docs are all versions that are known, however old: rows of one id with
    different texts are versions of one document. A run that dies before its rows
    are written leaves the ledger as it was.
    """
    try:
        seen = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        seen = None
    stored(scan_unseen(docs, seen, rules)).write.mode("append").parquet(path)
    return merged(spark.read.schema(LEDGER).parquet(path), spark.createDataFrame([], LEDGER))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): every document with all spans of the current rules, by start, then by the order of the rules."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    current = F.filter("found", lambda f: F.try_element_at(order, f["rule"]).isNotNull())
    flat = F.flatten(
        F.transform(
            current,
            lambda f: F.transform(f["spans"], lambda s: F.struct(s["start"].alias("start"), order[f["rule"]].alias("rank"), s["end"].alias("end"), kinds[f["rule"]].alias("kind"))),
        )
    )
    hits = ledger.select("blob", flat.alias("spans")).where(F.size("spans") > 0)
    # a blob's rules may have been scanned by several runs
    hits = hits.select("blob", F.explode("spans").alias("s")).groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    paths = docs.select("doc_id", blob(text_or_empty()).alias("blob"))
    return paths.join(hits, "blob", "left").select("doc_id", "spans")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the contract, from (doc_id, spans)."""
    every = F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    base = F.filter(every, lambda s: s["rank"] < len(BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(rank: int) -> Column:
        return F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = stored(scan_unseen(docs))
    return report(findings(docs, ledger))


def _oracle() -> str:
    """All rules over every text, without a ledger."""
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, ms, vs, bs, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS vs,
         string_split_regex(text, '{pattern}') AS bs FROM t WHERE regexp_matches(text, '{pattern}'))"""
        )
    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT doc_id, rank, kind, len(vs[i]) AS n, length(array_to_string(bs[1:i], '')) + length(array_to_string(ms[1:i-1], '')) AS s, length(ms[i]) AS size FROM m),
s AS (SELECT *, kind || ':' || s || ':' || (s + size) AS span FROM p WHERE n >= CASE rank {least} END),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""


ORACLE = _oracle()
