"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob named by its SHA-256. The ledger, a Parquet table, has a
row for each pair of blob and rule version that has been scanned. A scan takes the blobs
of the pairs that the ledger lacks, each once however many paths hold it, appends their
findings, and joins the ledger back to all paths. Copies are folded together before the
shuffle, so a text that a third of the table repeats is neither moved nor scanned twice.

Defined results: a null text counts as empty; a text without findings has counts 0 and the
empty span string; repeated rows and repeated or null ids give one row each; an empty
table gives an empty table; other columns are dropped by :func:`scan` and kept by
:func:`redact`. Keywords match in either ASCII case only. The pem span of a scan is the
line that opens a private key, as in the SQL twin; a redaction takes the key with it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.common import columns, fresh, table_path, text_of
from arborspark.llm.spans import labelled, matches, merged, replaced, written

#: Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Kinds that this operator adds to the base ones.
MORE = {
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN "),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
}
KINDS = ["assign", "access", "hex", *MORE]
#: Least length of an assigned value.
ASSIGNED = 6
#: A digest of all rules, so that a ledger never takes findings of other rules for these.
RULE_VERSION = hashlib.sha256(repr((KINDS, ASSIGN, ASSIGNED, ACCESS, HEX, MORE)).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def findings(blobs: DataFrame) -> DataFrame:
    """``blob, version, base, spans`` (arrays of ``struct<s, k, e>``) from ``blob, version, text``."""
    t = F.col("text")
    assign = matches(t, ASSIGN, F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")))
    assign = F.filter(assign, lambda m: F.length(F.regexp_extract(m["t"], ASSIGN, 2)) >= ASSIGNED)
    base = [assign, matches(t, ACCESS, F.contains(t, F.lit("AKIA"))), matches(t, HEX)]
    more = [matches(t, p, F.contains(t, F.lit(part))) for p, part in MORE.values()]
    parts = [labelled(m, k).alias(f"k{k}") for k, m in enumerate([*base, *more])]
    rows = blobs.select("blob", "version", *parts)
    joined = lambda ks: F.sort_array(F.concat(*[f"k{k}" for k in ks]))
    return rows.select("blob", "version", joined(range(3)).alias("base"), joined(range(len(KINDS))).alias("spans"))


class Ledger:
    """Findings by blob and rule version, in a folder that all executors share."""

    SCHEMA = "blob string, version string, base array<struct<s:int,k:int,e:int>>, spans array<struct<s:int,k:int,e:int>>"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.shared = spark, path is not None
        self.path = path or table_path(spark, "blob-ledger")
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)

    def _written(self, version: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("version") == version)

    def rows(self, version: str) -> DataFrame:
        """One row for each blob, also where two scanners that ran at once have both appended it to a shared ledger."""
        rows = self._written(version)
        if not self.shared:
            return rows.select("blob", "base", "spans")
        return rows.groupBy("blob").agg(F.min(F.struct("base", "spans")).alias("found")).select("blob", "found.base", "found.spans")

    def update(self, texts: DataFrame, version: str) -> None:
        """Scan what is unseen of ``blob, text``."""
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("version", F.lit(version))
        unseen = blobs.join(self._written(version).select("blob"), "blob", "left_anti")
        findings(unseen).write.mode("append").parquet(self.path)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None, version: str = RULE_VERSION) -> DataFrame:
    """``id_col, blob, base, spans`` of every row; a ledger of this run only unless a path is given."""
    ledger = Ledger(df.sparkSession, ledger_path)
    texts = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("blob", blob_of(F.col("text")))
    ledger.update(texts.select("blob", "text"), version)
    found = ledger.rows(version).select(F.col("blob").alias("found"), "base", "spans")
    out = texts.select("id", "blob").join(found, F.col("blob") == F.col("found"), "left")
    return out.select(F.col("id").alias(id_col), "blob", "base", "spans")


def scan_query(df: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every document."""
    rows = scan(df)
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(3)], F.sha2(written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))


def key_end(t: Column, m: Column) -> Column:
    """Where the private key ends that the pem span ``m`` opens: after its END line, else after its base64 lines.

    An END line counts only if no other block begins before it. Base64 lines have 16 characters
    or more, but for a last one; the two headers of an encrypted key and blank lines may stand between.
    """
    mark = F.replace(F.substring(t, m["s"] + 1, m["e"] - m["s"]), F.lit("-----BEGIN "), F.lit("-----END "))
    shut, other = F.position(mark, t, m["e"] + 1), F.position(F.lit("-----BEGIN "), t, m["e"] + 1)
    lines = F.split(F.substring(t, m["e"] + 1, F.length(t)), "\n")
    # ``at`` counts the characters read, ``end`` those that belong to the key; ``long``: the line before was a full one.
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("long"), F.lit(True).alias("on"))

    def step(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"\s+$", "")
        long = bare.rlike(r"^\s*+[A-Za-z0-9+/]{16,}+={0,2}$") | bare.rlike("^(?:Proc-Type|DEK-Info): ")
        part = long | (acc["long"] & bare.rlike(r"^\s*+[A-Za-z0-9+/]{1,15}={0,2}$"))
        end = F.when(acc["on"] & part, acc["at"] + F.length(bare)).otherwise(acc["end"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), end.alias("end"), long.alias("long"), (acc["on"] & (part | (bare == ""))).alias("on"))

    closed = (shut > 0) & ((other == 0) | (other > shut))
    return F.when(closed, shut - 1 + F.length(mark)).otherwise(m["e"] + F.aggregate(lines, start, step, lambda acc: acc["end"]))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", ledger_path: str | None = None, version: str = RULE_VERSION) -> DataFrame:
    """All rows and columns of ``df``, the union of each text's spans, private keys whole, replaced by ``mark``; null texts stay null."""
    blob, found_blob, found_spans = fresh(df, "blob", "found_blob", "found_spans")
    ledger = Ledger(df.sparkSession, ledger_path)
    texts = df.withColumn(blob, blob_of(text_of(text_col)))
    ledger.update(texts.select(F.col(blob).alias("blob"), text_of(text_col).alias("text")), version)
    found = ledger.rows(version).where(F.size("spans") > 0).select(F.col("blob").alias(found_blob), F.col("spans").alias(found_spans))
    t, pem = text_of(text_col), KINDS.index("pem")
    whole = F.transform(found_spans, lambda m: F.struct(m["s"].alias("s"), F.when(m["k"] == pem, key_end(t, m)).otherwise(m["e"]).alias("e")))
    clean = replaced(t, merged(whole), mark)
    out = texts.join(found, F.col(blob) == F.col(found_blob), "left")
    return out.withColumn(text_col, F.when(F.col(found_spans).isNull(), F.col(text_col)).otherwise(clean)).select(columns(df.columns))
