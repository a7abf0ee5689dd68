"""Secret scans with an incremental blob ledger (operator 6), DataFrame functions only.

Every version of a text is a blob named by its content (SHA-256).  The ledger in
a shared folder says which pairs of blob and rule version were scanned and what
was found.  A scan reads one copy of each blob that has unseen pairs, runs only
those rules, appends to the ledger, and joins the findings to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, whole_text


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern; those whose group is shorter than least are dropped.

    hint: a plain string that every match holds in this spelling, or none.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: Fixed patterns of the base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*"),
)
#: What this scan knows besides.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    # a header of at most 400 letters: without a bound, a text of beginnings only would take time with the square of its length
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,400}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", version=2, hint="eyJ"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)
RULES = BASE + MORE


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def matches(text: Column, rule: Rule) -> Column:
    """An array of (gap, size, checked): lengths of the text before each match since the last, of the match, and of its group."""
    p = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x))
    checked = F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), lambda x: F.length(x)) if rule.group else sizes
    found = text.rlike(rule.pattern)
    if rule.hint:
        found = text.contains(rule.hint) & found
    zipped = F.zip_with(F.slice(gaps, 1, F.size(sizes)), sizes, lambda g, n: F.struct(g.alias("gap"), n.alias("size")))
    return F.when(found, F.zip_with(zipped, checked, lambda x, c: F.struct(x.gap.alias("gap"), x.size.alias("size"), c.alias("checked"))))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, kind, start, end) of (blob, text, todo): spans in code points, of the rules that todo names."""
    runs = [
        F.when(
            F.array_contains("todo", rule.key),
            F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), matches(F.col("text"), rule).alias("found")),
        )
        for rule in rules
    ]
    each = blobs.select("blob", F.explode(F.array(*runs)).alias("r")).filter("r.found is not null")
    rows = each.select("blob", "r.rule", "r.kind", "r.least", F.posexplode("r.found").alias("k", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("k")
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    return rows.withColumn("end", end).filter("m.checked >= least").select("blob", "rule", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")


class Ledger:
    """Folders below path: scanned (blob, rule) and findings (blob, rule, kind, start, end)."""

    SCANNED = "blob string, rule string"
    FINDINGS = "blob string, rule string, kind string, start long, end long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings").distinct()

    def update(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is new in docs (doc_id, text).

        Findings are appended before the pairs are, so a run that breaks off is
        made up for by the next, and findings written twice count once.
        """
        named = docs.select("doc_id", blob_id(whole_text()).alias("blob"), whole_text().alias("text"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        one = named.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
        pairs = saved(one.select("blob", "doc_id", F.explode(keys).alias("rule")).join(self.scanned(), ["blob", "rule"], "left_anti"))
        todo = pairs.groupBy("blob", "doc_id").agg(F.collect_set("rule").alias("todo"))
        todo = todo.select(F.col("blob").alias("new_blob"), F.col("doc_id").alias("new_id"), "todo")
        # rows of one doc_id, or of none, may repeat a text
        fresh = named.join(todo, named.doc_id.eqNullSafe(F.col("new_id")) & (named.blob == F.col("new_blob"))).dropDuplicates(["blob"])
        scan(fresh.select("blob", "text", "todo"), rules).write.mode("append").parquet(f"{self.path}/findings")
        pairs.select("blob", "rule").write.mode("append").parquet(f"{self.path}/scanned")


def report(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) of every row of docs: spans are (start, place, end, kind), by start and then kind.

    The ledger must have been updated with docs.  A null text is an empty one;
    rows without findings have no spans; repeated rows stay.
    """
    place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    kinds = F.col("rule").isin([r.key for r in rules])
    found = ledger.findings().filter(kinds).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", place[F.col("kind")].alias("place"), "end", "kind"))).alias("spans"))
    named = docs.select("doc_id", blob_id(whole_text()).alias("blob"))
    return named.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def scan_sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """DuckDB SQL for the scan of documents: counts of the base kinds, the digest of their spans, and all spans."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    each = [
        f"select doc_id, {quote(r.kind)} kind, {k} place, {r.least} least, regexp_split_to_array(x, {quote(r.pattern)}) s, regexp_extract_all(x, {quote(r.pattern)}) m, "
        f"regexp_extract_all(x, {quote(r.pattern)}, {r.group}) c from t where regexp_matches(x, {quote(r.pattern)})"
        for k, r in enumerate(rules)
    ]
    kinds = ", ".join(quote(r.kind) for r in base)
    counts = ", ".join(f"count(*) filter (kind = {quote(r.kind)}) as n_{r.kind}" for r in base)
    span, order = "kind || ':' || a || ':' || b", "order by a, place"
    return f"""
with t as (select doc_id, coalesce(text, '') x from documents),
f as ({" union all ".join(each)}),
g as (select doc_id, kind, place, least, s, m, c, unnest(range(1, len(m) + 1)) i from f),
p as (select doc_id, kind, place, length(m[i]) n, list_sum(list_transform(s[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) a from g where length(c[i]) >= least),
q as (select doc_id, kind, place, cast(a as bigint) a, cast(a + n as bigint) b from p),
r as (select doc_id, {counts}, string_agg({span}, ',' {order}) filter (kind in ({kinds})) base, string_agg({span}, ',' {order}) spans from q group by doc_id)
select t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in base)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join r using (doc_id)
"""
