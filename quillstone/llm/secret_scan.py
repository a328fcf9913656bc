"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.frames import edit_texts, materialise, pick, unpack_row, with_rows


@dataclass(frozen=True)
class Rule:
    """A pattern of the common subset of Java, RE2 and Python syntax.

    ``keywords``: literals of which every match holds at least one; a text
    without any of them is settled without running the pattern.
    """

    rule_id: str
    version: int
    pattern: str
    keywords: tuple[str, ...]


_BEGIN = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: A body holds single dashes at most (header fields, lines of a diff), so that no other key's BEGIN is passed.
_TO_END = r"[^-]*(?:-[^-]+){0,250}-{5,}END [A-Z ]{0,20}PRIVATE KEY-----"
#: Where END is missing: header fields, then lines of nothing but base64, indented, quoted or with escaped ends; more lines than keys have, and plain lines beyond.
_EOL = r"(?:[\r\n]+|(?:\\r)?\\n(?:\\n)?)"
_KEY_LINES = (
    rf"(?:[ \t\x22\x27,+]*{_EOL}(?:[ \t]*[A-Z][A-Za-z]+-[A-Za-z]+:[^\r\n\\]*{_EOL}){{0,20}}"
    rf"(?:[ \t>#*|\x22\x27-]*[0-9A-Za-z+/]+={{0,2}}[ \t\x22\x27,;]*(?:{_EOL}|$)){{1,500}}(?:[0-9A-Za-z+/=\r\n]+(?:[\r\n]|$))?)?"
)

RULES = (
    Rule("aws_access_key", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"gh[pousr]_[0-9A-Za-z]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("jwt", 1, r"eyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", ("eyJ",)),
    Rule("password_assignment", 2, r"(?:password|passwd|Password|PASSWORD)[ ]?[=:][ ]?[\x22\x27]?[0-9A-Za-z_!@#$%^&*+/-]{8,}", ("password", "passwd", "Password", "PASSWORD")),
    Rule("private_key", 2, rf"{_BEGIN}(?:{_TO_END}|{_KEY_LINES})", ("PRIVATE KEY-----",)),
    Rule("secret_assignment", 2, r"(?:api_key|apikey|API_KEY|secret|SECRET|token|TOKEN)[ ]?[=:][ ]?[\x22\x27]?[0-9A-Za-z_+/-]{16,}={0,2}", ("api_key", "apikey", "API_KEY", "secret", "SECRET", "token", "TOKEN")),
    Rule("slack_token", 2, r"xox[abprs]-[0-9A-Za-z-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("stripe_key", 2, r"[rs]k_live_[0-9A-Za-z]{16,}", ("k_live_",)),
)


def blob_id(text: Column | str) -> Column:
    """SHA-256 of the bytes; null for null."""
    return F.unhex(F.sha2(F.col(text) if isinstance(text, str) else text, 256))


def _hit(rule: Rule, text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in rule.keywords]) if rule.keywords else F.lit(True)


_SPAN = "array<struct<rule_id:string,rule_version:int,k:int,gap:int,match:string>>"


def _found(rule: Rule, text: Column) -> Column:
    """All matches of a rule as structs, each with the length of the text between it and the one before."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    spans = F.transform(F.arrays_zip(hits.alias("m"), F.slice(gaps, 1, F.size(hits)).alias("g")), lambda x, i: F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.version).alias("rule_version"), i.alias("k"), F.length(x["g"]).alias("gap"), x["m"].alias("match")))
    return F.when(_hit(rule, text), spans).otherwise(F.array().cast(_SPAN))


@dataclass
class Scan:
    """What a run found and what the next run needs.

    findings: one row for each finding and each path that has its blob.
    ledger: (blob_id, rules ARRAY<STRUCT<rule_id, rule_version>>) that are settled by now.
    blob_findings: (blob_id, rule_id, rule_version, start, match) so far.
    scanned: (blob_id, rules) of the blobs whose text this run looked at.
    """

    findings: DataFrame
    ledger: DataFrame
    blob_findings: DataFrame
    scanned: DataFrame


def secret_scan(versions: DataFrame, path_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, known: DataFrame | None = None) -> Scan:
    """Scan every historical version once for each rule version.

    ``versions`` has one row for each version of each path. Each text is
    addressed by its SHA-256; equal contents are one blob. Pairs of blob and
    rule version that ``ledger`` holds are not scanned again: their findings
    come from ``known`` (blob_findings of an earlier run). Findings are then
    joined to every path of their blob, as (path_cols..., rule_id,
    rule_version, start, stop, match), offsets in characters from 0.

    Texts are read once: paths, addresses and the texts that hold a keyword of
    some rule are written to the shared folder, from where ledger, scan and
    paths go on. Only these texts move between executors, and once for each
    blob; all others are settled where they are read.

    Null text: no blob, no findings. Empty text: a blob without findings. Long
    texts are searched in whole. Repeated rows: each is a path of its own.
    Matches of one rule don't overlap, the first from the left is taken; those
    of different rules may. Null path columns stay null. An empty table has no
    findings and leaves the ledger as it was. Columns other than path_cols and
    text_col are ignored, whatever their names.
    """
    spark = versions.sparkSession
    text = F.col("_text")
    any_hit = reduce(lambda a, b: a | b, [_hit(r, text) for r in rules])
    base = pick(versions, *path_cols, text_col).select(F.struct(*path_cols).alias("_path"), F.col(text_col).alias("_text")).filter(text.isNotNull())
    base = materialise(base.select("_path", blob_id(text).alias("blob_id"), F.when(any_hit, text).alias("_text")), "blobs")
    every = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version")) for r in rules])
    candidates = base.filter(text.isNotNull())
    blobs = candidates.groupBy("blob_id").agg(F.any_value("_text").alias("_text"))
    if ledger is None:
        todo = blobs.withColumn("_rules", every)
    else:
        seen = ledger.groupBy("blob_id").agg(F.flatten(F.collect_list("rules")).alias("_seen"))
        todo = blobs.join(seen, "blob_id", "left").withColumn("_rules", F.array_except(every, F.coalesce("_seen", F.array().cast("array<struct<rule_id:string,rule_version:int>>"))))
        todo = todo.filter(F.size("_rules") > 0).select("blob_id", "_text", "_rules")
    wanted = lambda r: F.array_contains("_rules", F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("rule_version")))
    spans = todo.select("blob_id", F.explode(F.flatten(F.array(*[F.when(wanted(r), _found(r, text)).otherwise(F.array().cast(_SPAN)) for r in rules]))).alias("f")).select("blob_id", "f.*")
    upto = Window.partitionBy("blob_id", "rule_id", "rule_version").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    found = spans.select("blob_id", "rule_id", "rule_version", (F.sum(F.col("gap") + size).over(upto) - size).cast("int").alias("start"), "match")
    if known is not None:
        current = spark.createDataFrame([(r.rule_id, r.version) for r in rules], "rule_id string, rule_version int")
        # what was settled before stays as it was; only rule versions in force are reported
        found = found.unionByName(known.join(F.broadcast(current), ["rule_id", "rule_version"], "left_semi").select(found.columns))
    findings = candidates.select("_path", "blob_id").join(found, "blob_id").select("_path.*", "rule_id", "rule_version", "start", (F.col("start") + F.length("match")).alias("stop"), "match")
    settled = base.select("blob_id").distinct().withColumn("rules", every)
    if ledger is not None:
        settled = settled.unionByName(ledger.select("blob_id", "rules")).groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
    return Scan(findings, settled, found, todo.select("blob_id", F.col("_rules").alias("rules")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each found secret replaced by ``[rule_id]``.

    Of secrets that overlap, the one that begins first is replaced, of those
    that begin together the shorter, then the one whose rule sorts first, and
    what the others have beyond it goes too. Every row and column stays, whatever their
    names; null and empty texts and those without findings are unchanged, and
    are not exchanged where they hold no keyword. Long texts are searched in
    whole. Findings belong to (id, content), so that different texts under one
    id don't mix; rows that repeat both are edited alike; ids may be null. An
    empty table stays empty.
    """
    d = with_rows(docs, did=id_col, text=text_col)
    hit = F.coalesce(reduce(lambda a, b: a | b, [_hit(r, F.col("text")) for r in rules]), F.lit(False))
    some = d.filter(hit).withColumn("key", F.xxhash64("text"))
    found = secret_scan(some.select(F.col("did").alias("_sid"), F.col("key").alias("_skey"), F.col("text").alias("_stext")), ["_sid", "_skey"], "_stext", rules).findings.distinct()
    spans = found.groupBy("_sid", "_skey").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "rule_id"))).alias("_spans"))
    joined = some.join(spans, F.col("did").eqNullSafe(F.col("_sid")) & (F.col("key") == F.col("_skey")), "left")
    edited = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(edit_texts(_redact)(F.when(F.col("_spans").isNotNull(), F.col("text")), F.col("_spans")))
    return unpack_row(docs, d.filter(~hit).select("row", F.col("text").alias("new")).unionByName(joined.select("row", edited.alias("new"))), text_col, F.col("new"))


def _redact(text: str, spans) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['rule_id']}]"]
        at = max(at, s["stop"])
    return "".join(out) + text[at:]


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The findings of a first run over ``documents`` in DuckDB's SQL."""
    one = """SELECT doc_id, source, '{id}' AS rule_id, {v}::INT AS rule_version,
        unnest(list_transform(range(1, len(m) + 1), lambda i: {{'k': i, 'm': m[i], 's': list_sum(list_transform(g[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)}})) AS f
        FROM (SELECT doc_id, source, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g
              FROM documents WHERE text IS NOT NULL)"""
    parts = " UNION ALL ".join(one.format(id=r.rule_id, v=r.version, p=r.pattern.replace("'", "''")) for r in rules)
    return f"""SELECT doc_id, source, rule_id, rule_version, f.s::INT AS start, (f.s + length(f.m))::INT AS stop, f.m AS "match" FROM ({parts})"""
