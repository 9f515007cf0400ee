"""Secret scan over a content-addressed ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger holds a row for each (blob, rule
version) already scanned, with what was found. A scan takes only the pairs the ledger lacks, appends them, and
findings are joined back to every row (path, version) that holds the blob. Copies are scanned once: the partial
aggregation keeps one text a blob in each map task, so a hot blob sends one row a task.

Main path: DataFrame functions only. Spans count code points, the end is exclusive.

Defined results: a null text is the empty text and has no findings; equal rows get equal findings; an empty
table leaves the ledger as it was; extra columns pass through, in ``redacted`` whatever their names, in
``findings_of`` but for one named ``spans``, which holds the findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
LEDGER = f"blob binary, rule_version string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hint``: a cheap pattern that every match contains; texts without it are not searched further.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base kinds, in their fixed order, then the further ones.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: A PEM key runs to its END line, if that is the next marker of five dashes. Where it is missing, the key runs over its
#: header fields and what is base64: runs of 16 characters or more and a shorter last one. A newline may be written as \n.
#: Bodies have any length: repeated groups are possessive, for which Java takes no stack.
_BREAK = r"\s*(?:\\r)?(?:\\n)?\s*"
_TO_END = r"[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]*PRIVATE KEY-----"
_FIELDS = rf"(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*+"
_RUNS = rf"(?:{_BREAK}[A-Za-z0-9+/]{{16,}}[A-Za-z0-9+/=]*)*+(?:{_BREAK}[A-Za-z0-9+/]+(?:==?|\r?\n|\\n|\z))?"
MORE = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_FIELDS}{_RUNS})", version=3, hint="PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    # Version 2 is what the tests call a rule of their own.
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]+@", version=3, hint="://"),
)
RULES = BASE + MORE


def spans_of(text: Column, rule: Rule, kind_no: int) -> Column:
    """The rule's spans in ``text``: match lengths and the lengths of what lies between add up to the positions."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = hits if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    cut = F.zip_with(F.arrays_zip(hits.alias("hit"), judged.alias("judged")), F.slice(between, 1, F.size(hits)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m["hit"]).alias("chars"), F.length(m["judged"]).alias("judged")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        start, end = acc["at"] + m["gap"], acc["at"] + m["gap"] + m["chars"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(m["judged"] >= rule.least, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(cut, begin, step)["spans"]
    likely = text.rlike(rule.pattern)
    if rule.hint:
        likely = text.contains(rule.hint) & likely
    return F.when(likely, found).otherwise(F.array().cast(SPANS))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if nothing was ever written there."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as e:  # noqa: BLE001  the reader's own class differs between classic and connect sessions
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LEDGER)
        raise


def addressed(docs: DataFrame, name: str = "blob") -> DataFrame:
    """``docs`` with ``blob``, the SHA-256 of the text's UTF-8 bytes."""
    return docs.withColumn(name, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))


def unseen(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, text, needed): one row for each blob with rule versions that the ledger lacks."""
    blobs = addressed(docs.select(F.coalesce("text", F.lit("")).alias("text"))).groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    every = F.array(*[F.lit(r.key) for r in rules])
    needed = F.when(F.col("seen").isNull(), every).otherwise(F.array_except(every, F.col("seen")))
    return blobs.join(seen, "blob", "left").select("blob", "text", needed.alias("needed")).filter(F.size("needed") > 0)


def scan(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> None:
    """Scan what the ledger at ``path`` lacks and append it. Run again over the same versions, it scans nothing."""
    ledger = open_ledger(docs.sparkSession, path)
    todo = unseen(docs, ledger, rules)
    found = F.array(
        *[
            F.struct(
                F.lit(r.key).alias("rule_version"),
                F.when(F.array_contains("needed", r.key), spans_of(F.col("text"), r, i)).alias("spans"),
            )
            for i, r in enumerate(rules)
        ]
    )
    rows = todo.select("blob", F.explode(found).alias("f")).filter("f.spans is not null")
    rows.select("blob", "f.rule_version", "f.spans").write.mode("append").parquet(path)


def findings_of(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, name: str = "spans") -> DataFrame:
    """``docs`` with ``spans``: all findings under the given rule versions, by start, then kind as listed."""
    hits = (
        open_ledger(docs.sparkSession, path)
        .filter(F.col("rule_version").isin([r.key for r in rules]) & (F.size("spans") > 0))
        .groupBy(F.col("blob").alias("__blob"))
        .agg(F.sort_array(F.flatten(F.collect_set("spans"))).alias("__found"))
    )
    found = addressed(docs.drop(name), "__blob").join(hits, "__blob", "left")
    return found.withColumn(name, F.coalesce("__found", F.array().cast(SPANS))).drop("__blob", "__found")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span (overlapping ones as one) replaced by ``[SECRET]``."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        add = F.when(fresh, F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise("")
        return F.struct(F.concat(acc["out"], add).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, state, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs``, with all their columns, scanned through the ledger at ``path`` and every finding replaced."""
    scan(docs, path, rules)
    found = F.col("__spans")
    out = findings_of(docs, path, rules, "__spans").withColumn("text", redact(F.col("text"), found))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
