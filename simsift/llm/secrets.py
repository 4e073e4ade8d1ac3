"""Secret scan over an incremental ledger of blobs.

Every version of a text is named by the SHA-256 of its content. The ledger holds, for each blob, the
rules (with their versions) that have seen it and the spans they found. A run scans a blob only with
the rules that have not seen it yet, appends what it found, and joins the findings back to all paths
that hold the blob. DataFrame functions only.

Plan: text moves once, to bring equal blobs together (partial aggregation first, so a blob that makes
up a third of the rows arrives once per map task); the way back joins 32-byte names only, and only
with blobs that have findings. Both sides of that join are plain exchanges, so Spark can split a hot
name at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

SPANS = "array<struct<start:int,rule:string,end:int>>"
#: Matches of a text that are put into one array at a time.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Spans of pattern count where capture group `group` has at least `least` characters."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Runs of a minimum length are written into the pattern where that can't change the leftmost
#: matches: a run of hex digits, or of capitals after AKIA, is matched to its end either way.
#: A short value of `assign` does consume its text, so its length is checked after matching.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def _spans(text: Column, rule: Rule) -> Column:
    """All spans of a rule in code points. The gaps between matches give the positions; they are added up in blocks of
    matches, so that the work doesn't grow as the square of their number."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(
        F.transform(gaps, F.length).alias("gap"),
        F.transform(whole, F.length).alias("len"),
        F.transform(value, F.length).alias("value"),
    )
    blocks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK)), lambda i: F.slice(steps, i, F.lit(BLOCK)))
    length = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, s: n + s["gap"] + F.coalesce(s["len"], F.lit(0))))
    before = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(length, before, lambda x, n: F.struct((x["at"] + n).alias("at"), F.concat(x["out"], F.array(x["at"])).alias("out")), lambda x: x["out"])

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + s["gap"]
        end = begin + F.coalesce(s["len"], F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), F.lit(rule.key).alias("rule"), end.alias("end")))
        keep = s["len"].isNotNull() & (s["value"] >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], hit)).otherwise(state["out"]).alias("out"))

    def spans_of(b: Column, at: Column) -> Column:
        return F.aggregate(b, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda s: s["out"])

    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("at")), lambda x: spans_of(x["b"], x["at"])))


def scan(text: Column, rules=RULES, unseen: Column | None = None) -> Column:
    """Spans of all rules, or of those whose key is in the array `unseen`. A first look keeps texts without a match cheap."""
    none = F.array().cast(SPANS)
    each = []
    for rule in rules:
        wanted = text.rlike(rule.pattern)
        if unseen is not None:
            wanted = F.array_contains(unseen, rule.key) & wanted
        each.append(F.when(wanted, _spans(text, rule)).otherwise(none))
    return F.concat(*each)


def read_ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def update_ledger(versions: DataFrame, ledger_path: str, text_col: str = "text", rules=RULES) -> DataFrame:
    """Scan what the ledger at ledger_path has not seen, append it, and return the whole ledger.

    Ledger: blob binary, rules array<string>, spans array<struct<start, rule, end>>. Null texts are empty texts.
    """
    spark = versions.sparkSession
    every = F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    known = read_ledger(spark, ledger_path)
    if known is None:
        blobs = blobs.withColumn("unseen", every)
    else:
        seen = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        blobs = blobs.select("blob", "text", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("unseen"))
        blobs = blobs.where(F.size("unseen") > 0)
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("unseen").alias("unseen"))
    new = once.select("blob", F.col("unseen").alias("rules"), scan(F.col("text"), rules, F.col("unseen") if known is not None else None).alias("spans"))
    new.write.mode("append").parquet(ledger_path)
    return spark.read.parquet(ledger_path)


def find_secrets(versions: DataFrame, ledger_path: str | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """Every row of versions with its blob and its secrets.

    Adds `blob` (lowercase hex SHA-256 of the text) and `spans` (array of struct<start, kind, end>, code
    points, end exclusive, by start, then kind in the order of rules). All other columns stay as they are;
    a column of versions called blob or spans is replaced. Null texts count as empty and have no spans.
    Equal texts share one scan, repeated rows stay repeated, and an empty table gives an empty result.
    ledger_path: kept between runs to scan only what is new; None starts an empty ledger in the shared folder.
    """
    spark = versions.sparkSession
    ledger = update_ledger(versions, ledger_path or scratch(spark, "secret-ledger"), text_col, rules)
    names, kinds = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    place = lambda s: F.array_position(names, s["rule"]).cast("int")
    current = F.filter("spans", lambda s: F.array_contains(names, s["rule"]))
    found = ledger.select("blob", current.alias("spans")).where(F.size("spans") > 0)
    found = found.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ordered = F.array_sort(F.array_distinct(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end")))))
    found = found.select(
        F.col("blob").alias("found"),
        F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["place"]).alias("kind"), s["end"].alias("end"))).alias("spans"),
    )
    found = stored(found, "secret-findings")  # read back, so that both sides of the join are plain exchanges
    own = [F.col(f"`{c}`") for c in versions.columns if c.lower() not in ("blob", "spans")]
    rows = versions.select(F.struct(*own).alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))
    out = rows.join(found, F.col("blob") == F.col("found"), "left")
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return out.select("row.*", F.lower(F.hex("blob")).alias("blob"), F.coalesce("spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = find_secrets(docs).drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    """All spans by splitting at the matches, as in the operator, in another engine."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    lengths = lambda parts, n: f"coalesce(list_sum(list_transform({parts}[1:{n}], lambda x: length(x))), 0)"
    lists = []
    for k, rule in enumerate(RULES):
        p = quoted(rule.pattern)
        start = f"({lengths('g', 'i')} + {lengths('m', 'i - 1')})::BIGINT"
        span = f"struct_pack(a := {start}, k := {k}, b := ({start} + length(m[i]))::BIGINT, n := length(v[i]))"
        found = f"list_transform(range(1, len(m) + 1), lambda i: {span})"
        source = f"(select regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {rule.group}) as v, regexp_split_to_array(t, {p}) as g)"
        lists.append(f"(select list_filter({found}, lambda s: s.n >= {rule.least}) from {source})")
    kinds = ", ".join(quoted(r.kind) for r in RULES)
    shown = "list_transform({s}, lambda s: [" + kinds + "][s.k + 1] || ':' || s.a || ':' || s.b)"
    base = "list_filter(spans, lambda s: s.k < 3)"
    count = lambda k, name: f"len(list_filter(spans, lambda s: s.k = {k})) as n_{name}"
    return (
        f"with d as (select doc_id, coalesce(text, '') as t from documents), f as (select doc_id, list_sort(flatten([{', '.join(lists)}])) as spans from d) "
        f"select doc_id, {count(0, 'assign')}, {count(1, 'access')}, {count(2, 'hex')}, sha256(array_to_string({shown.format(s=base)}, ',')) as base_sha256, "
        f"array_to_string({shown.format(s='spans')}, ',') as spans from f"
    )


SECRETS_SQL = _sql()
