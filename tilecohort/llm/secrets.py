"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text. The ledger
holds a row for each pair of blob and rule version that was ever scanned, with
the spans found; only unseen pairs are scanned, each distinct text once, and
findings go back to all paths by their blob.

Positions come without a Python function: cutting a text at a pattern gives the
pieces between its matches, so running sums of piece and match lengths are the
matches' ends (in code points).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, free_name, hot_joined, written


@dataclass(frozen=True)
class Rule:
    """group: what least is measured on; gate: a cheap test that every match passes; base: one of the three fixed kinds."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    gate: str
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules of the contract, and public token formats.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}", True),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}", True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, r"\.eyJ"),
)
LEDGER = "blob binary, rule string, spans array<struct<start:int,end:int>>"


def addressed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob): the content address of each version; a null text counts as empty."""
    return docs.select(doc_id, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("blob"))


def _hits(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, i, before, size, measured) of the raw matches of texts (blob, text, todo)."""

    def matches(r: Rule) -> Column:
        found = F.arrays_zip(
            F.split("text", r.pattern, -1).alias("piece"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("part"),
        )
        lengths = F.transform(found, lambda x: F.struct(F.length(x["piece"]).alias("before"), F.length(x["whole"]).alias("size"), F.length(x["part"]).alias("measured")))
        wanted = F.array_contains("todo", r.name) & F.col("text").rlike(r.gate)
        return F.struct(F.lit(r.name).alias("rule"), F.when(wanted, lengths).alias("at"))

    each = texts.select("blob", F.explode(F.filter(F.array(*map(matches, rules)), lambda x: x["at"].isNotNull())).alias("m"))
    flat = each.select("blob", F.col("m.rule").alias("rule"), F.posexplode("m.at").alias("i", "x"))
    return flat.select("blob", "rule", "i", "x.before", "x.size", "x.measured").filter("size IS NOT NULL")


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger at a path has not seen and appends to it: (addresses of docs, ledger).

    An absent ledger is an empty one. A run over the same texts and rule versions scans nothing.
    """
    spark = docs.sparkSession
    addresses = written(addressed(docs, doc_id, text), "addresses")
    try:
        seen = spark.read.schema(LEDGER).parquet(ledger)
        seen.take(0)
    except AnalysisException:
        seen = spark.createDataFrame([], LEDGER)
    names = F.array(*[F.lit(r.name) for r in rules])
    pairs = addresses.select("blob").distinct().select("blob", F.explode(names).alias("rule"))
    unseen = written(pairs.join(seen.select("blob", "rule"), ["blob", "rule"], "left_anti"), "unseen")
    todo = unseen.groupBy("blob").agg(F.collect_set("rule").alias("todo"))
    blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("blob")
    # each distinct text once; the ledger join finds it already dealt out by blob
    once = docs.select(blob, F.col(text).alias("text")).filter(F.length("text") > 0).dropDuplicates(["blob"]).join(todo, "blob")
    gate = "|".join(f"(?:{r.gate})" for r in rules)
    hits = _hits(once.filter(F.col("text").rlike(gate)), rules)
    run = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("before") + F.col("size")).over(run).cast("int"))
    least = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(r.least)) for r in rules])
    spans = placed.filter(F.col("measured") >= least).groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "end"))).alias("spans"))
    unseen.join(spans, ["blob", "rule"], "left").select("blob", "rule", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")).write.mode("append").parquet(ledger)
    return addresses, spark.read.schema(LEDGER).parquet(ledger)


def by_blob(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): the spans (start, kind number, end) of the current rule versions, ordered; blobs without any are left out."""
    number = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(i)) for i, r in enumerate(rules)])
    rows = ledger.filter(F.col("rule").isin([r.name for r in rules])).filter(F.size("spans") > 0)
    flat = rows.select("blob", number.alias("kind"), F.explode("spans").alias("s")).select("blob", F.struct("s.start", "kind", "s.end").alias("x"))
    return flat.distinct().groupBy("blob").agg(F.array_sort(F.collect_list("x")).alias("found"))


def _classes(addresses: DataFrame, held: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, found, n) of the blobs with findings, and of those that a HOT-th of all rows share; n: rows that share it."""
    counts = addresses.groupBy("blob").agg(F.count("*").alias("n"))
    joined = counts.join(by_blob(held, rules), "blob", "left")
    return written(joined.filter(F.col("found").isNotNull() | (F.col("n") * HOT > F.lit(addresses.count()))).select("blob", "found", "n"), "classes")


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every row of docs, by way of the ledger.

    Returns doc_id, n_assign, n_access, n_hex (long), base_sha256 (of the base spans) and spans (all of them),
    both as kind:start:end by start, then kind as in RULES, joined by commas. A null or empty text has none.
    Repeated rows and copies share one scan and get the same findings; other columns are not read.
    """
    addresses, held = scan(docs, ledger, rules, doc_id, text)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r.base]

    def spelled(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = hot_joined(addresses, _classes(addresses, held, rules), ["blob"], "n").withColumn("found", F.coalesce("found", nothing))

    def count(number: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == number)).cast("long")

    own = F.filter("found", lambda x: x["kind"].isin(base))
    return rows.select(doc_id, *[count(i).alias(f"n_{rules[i].kind}") for i in base], F.sha2(spelled(own).cast("binary"), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by a mark (overlapping ones by one mark).

    All rows and columns stay, whatever their names; null and empty texts and repeated rows stay as they are, an empty table empty.
    Copies of a blob that many rows share get its findings where they are; other rows meet theirs by a shuffle.
    """
    addresses, held = scan(docs, ledger, rules, doc_id, text)
    blob, found, n = (free_name(c, docs) for c in ("_blob", "_found", "_n"))
    keyed = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    classes = _classes(addresses, held, rules).select(F.col("blob").alias(blob), F.col("found").alias(found), F.col("n").alias(n))
    rows = hot_joined(keyed, classes, [blob], n)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        piece = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        fresh = F.struct(x["end"].alias("at"), F.concat(state["out"], F.array(F.concat(piece, F.lit(mark)))).alias("out"))
        return F.when(x["start"] >= state["at"], fresh).otherwise(F.struct(F.greatest(state["at"], x["end"]).alias("at"), state["out"].alias("out")))

    done = F.aggregate(found, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(done)).select(*docs.columns)
