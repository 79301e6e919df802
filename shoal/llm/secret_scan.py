"""Secret scans with a ledger of blobs: every distinct content is scanned once per rule version.

A blob is a text, addressed by its SHA-256. The ledger has one row per blob and rule version
already scanned, with the spans found. A scan takes all historical versions of all files,
drops the pairs that the ledger holds, scans the rest, adds its rows to the ledger and joins the ledger's findings
back to every path that ever had the blob. A ledger is a folder of Parquet tables, one per scan, that grows from
run to run. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.session import scratch_path

# ``reach`` is the largest end of the earlier spans.
SPANS = "array<struct<start:int,rank:int,kind:string,end:int,reach:int>>"
LEDGER_SCHEMA = f"blob string, rule_version string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` finds it; a match counts if ``group`` has ``least`` characters.

    ``hint`` is a cheap condition on (text, lower-cased text) that every text with a match meets.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    lower: bool = False
    seen: str | None = None

    def may_match(self, text: Column, low: Column) -> Column:
        if self.seen:
            return F.regexp_like(text, F.lit(self.seen))
        return reduce(lambda a, b: a | b, [(low if self.lower else text).contains(h) for h in self.hints])


# Fixed values of the base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"

BASE_RULES = (
    Rule("assign", ASSIGN, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), lower=True),
    Rule("access", ACCESS, 0, 16, ("AKIA",)),
    Rule("hex", HEX, 0, 32, seen="[0-9a-f]{32}"),
)
# Kinds with a form of their own that no other text has.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("PRIVATE KEY-----",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, (".eyJ",)),
)
RULES = BASE_RULES + MORE_RULES


def rule_version(rules: tuple[Rule, ...]) -> str:
    """Changes whenever a rule changes."""
    from hashlib import sha256

    return sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


# Session setting with the folder of a ledger that outlives the run; without it each call starts a new one.
LEDGER_SETTING = "spark.shoal.secretLedger"


def ledger_folder(spark: SparkSession) -> str:
    return spark.conf.get(LEDGER_SETTING, None) or scratch_path(spark, "secret-ledger")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the finished scans in ``folder``; none where there is no such folder yet.

    A scan that did not finish has no ``_SUCCESS`` file: its blobs count as not scanned.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/scan=*/_SUCCESS")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    done = sorted(f.getPath().getParent().toString() for f in files or [])
    return spark.read.schema(LEDGER_SCHEMA).parquet(*done) if done else empty_ledger(spark)


def scan_into_ledger(
    versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """Scans the blobs that the ledger in ``folder`` does not hold, adds them, and returns the whole ledger.

    Two scans at once may both add a blob; its rows are equal, and readers take one.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, folder)
    update_ledger(versions, known, rules, text_col).write.parquet(f"{folder}/scan={uuid4().hex}")
    return read_ledger(spark, folder)


def unseen_blobs(versions: DataFrame, text_col: str, ledger: DataFrame | None, version: str) -> DataFrame:
    """One row ``(blob, text)`` per content without a ledger entry for this rule version.

    Copies meet in the partial aggregation, so a content that fills a third of the table
    is shuffled once per task.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if ledger is not None:
        # After the copies have met, so that a hot content is one row; the blobs are dealt by their address already.
        known = ledger.where(F.col("rule_version") == version).select("blob").distinct()
        blobs = blobs.join(known, "blob", "left_anti")
    return blobs


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)`` of every blob; ``spans`` is ordered by start, then by rule, and empty without a finding.

    The offsets come from the pieces between the matches: a match starts after all earlier pieces and
    matches. They are code points, the end exclusive.
    """
    text, low = F.col("text"), F.lower(F.col("text"))

    def pieces(rank: int, r: Rule) -> Column:
        found = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        secret = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))
        gaps = F.split(text, r.pattern, -1)
        rows = F.transform(
            F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), secret.alias("own")),
            lambda x: F.struct(
                F.lit(rank).alias("rank"),
                F.length(x["gap"]).alias("gap"),
                F.length(x["hit"]).alias("hit"),
                (F.length(x["own"]) >= r.least).alias("holds"),
            ),
        )
        return F.when(r.may_match(text, low), rows).otherwise(F.array().cast(rows_type))

    rows_type = "array<struct<rank:int,gap:int,hit:int,holds:boolean>>"
    marked = blobs.select("blob", F.array(*[pieces(k, r) for k, r in enumerate(rules)]).alias("by_rule"))
    some = F.filter("by_rule", lambda x: F.size(x) > 0)
    listed = marked.select("blob", F.explode_outer(some).alias("found")).select("blob", F.posexplode_outer("found"))
    listed = listed.select("blob", "pos", "col.*")
    upto = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = listed.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(upto).cast("int"))
    earlier = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("start", F.col("end") - F.col("hit"))
    ends = ends.withColumn("reach", F.coalesce(F.max(F.when(F.col("holds"), F.col("end"))).over(earlier), F.lit(0)))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", "rank", F.element_at(kinds, F.col("rank") + 1).alias("kind"), "end", "reach")
    return ends.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("holds"), span))).alias("spans"))


def update_ledger(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """New ledger rows ``(blob, rule_version, spans)``: those blobs not yet scanned by these rules.

    A blob without findings gets a row with an empty list, so that it is not scanned again.
    """
    version = rule_version(rules)
    scanned = scan_blobs(unseen_blobs(versions, text_col, ledger, version), rules)
    return scanned.select("blob", F.lit(version).alias("rule_version"), F.col("spans").cast(SPANS).alias("spans"))


def known_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = ledger.where(F.col("rule_version") == rule_version(rules)).where(F.size("spans") > 0)
    return rows.select("blob", "spans").dropDuplicates(["blob"])


def findings_by_path(
    versions: DataFrame,
    folder: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, blob, spans)`` for every row of ``versions``; ``spans`` is null without a finding.

    The ledger in ``folder`` (see ``ledger_folder``) first gets the blobs that it lacks; all findings are read from it. A null text is the
    empty blob and has no findings. Repeated rows and ids each get a row; other columns are
    not read; an empty table gives no rows. Long texts are scanned whole. A blob that very many
    paths share is a skewed key of one large and one small side: adaptive execution splits the paths.
    """
    ledger = scan_into_ledger(versions, folder or ledger_folder(versions.sparkSession), rules, text_col)
    paths = versions.select(F.col(f"`{id_col}`").alias("doc_id"), blob_of(F.col(f"`{text_col}`")).alias("blob"))
    return paths.join(known_findings(ledger, rules), "blob", "left").select("doc_id", "blob", "spans")


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans in order, comma-joined; empty for none."""
    said = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.coalesce(F.array_join(said, ","), F.lit(""))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with ``mask`` in place of every span; spans that overlap share one mask.

    A null text stays null, and a text without spans (null or none) stays as it is.
    """
    apart = F.filter(spans, lambda s: s["start"] >= s["reach"])
    gaps = F.transform(apart, lambda s: F.substring(text, s["reach"] + 1, s["start"] - s["reach"]))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.substring(text, last + 1, F.length(text))
    return F.when(F.size(F.coalesce(spans, F.array().cast(SPANS))) > 0, F.concat(F.array_join(gaps, mask), F.lit(mask), rest)).otherwise(text)


def mask_secrets(
    docs: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> DataFrame:
    """``docs`` with all their columns and rows, the secrets of ``text_col`` masked.

    The findings come from the ledger, as in ``findings_by_path``. A null text stays null, a text without findings (the empty one too) stays
    as it is; texts are masked whole; repeated rows stay; an empty table gives an empty one. Columns are carried inside a
    struct, so none of their names can clash with the join's.
    """
    text = F.col(f"row.`{text_col}`")
    ledger = scan_into_ledger(docs, folder or ledger_folder(docs.sparkSession), rules, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.withColumn("blob", blob_of(text)).join(known_findings(ledger, rules), "blob", "left")
    return joined.select(
        *[
            (redacted(text, F.col("spans")) if c == text_col else F.col(f"row.`{c}`")).alias(c)
            for c in docs.columns
        ]
    )
