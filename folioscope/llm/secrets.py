"""Secret scans over a ledger of content-addressed versions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import packed, scratch_folder, text_of
from folioscope.llm.spans import SPAN, find_spans, in_order

BASE = ["assign", "access", "hex"]
# The rules. Repetitions that nothing follows are possessive, which changes no match and keeps long runs cheap.
RULES = {
    "assign": "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]++)",
    "access": "AKIA[A-Z0-9]{16,}+",
    "hex": "[0-9a-f]{24,}+",
    "pem": "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "jwt": "eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+",
    "hub": "gh[pousr]_[A-Za-z0-9]{36,}+",
}
LEAST_VALUE = 6


def rules_version() -> str:
    """Names the rules by their content."""
    return hashlib.sha256(repr((sorted(RULES.items()), LEAST_VALUE)).encode()).hexdigest()[:16]


def scan(text: Column) -> Column:
    """All spans of all rules in one text; of assignments those with a value of LEAST_VALUE characters."""
    found = {kind: find_spans(text, kind, rule) for kind, rule in RULES.items()}
    found["assign"] = F.filter(found["assign"], lambda s: F.length(F.regexp_extract(s["hit"], RULES["assign"], 2)) >= LEAST_VALUE)
    return in_order(F.concat(*found.values()), list(RULES))


def new_ledger(spark: SparkSession) -> str:
    """A ledger folder of its own in the shared folder, for this process."""
    return scratch_folder(spark, "ledger")


def read_ledger(spark: SparkSession, path: str, rules: str) -> DataFrame | None:
    """(blob, spans) scanned under one rule version; None where nothing is stored yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rules={rules}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(f"blob binary, spans {SPAN}").parquet(folder.toString()).dropDuplicates(["blob"])


def find_secrets(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """Columns row (the input), blob, spans; one row per input row, be it a document, a path or a version of a path.

    A text is named by its SHA-256. Blobs that the ledger, a Parquet folder in a file system that driver and executors
    share, does not hold under this version of the rules are scanned once each and appended; findings then go to every row
    with that text. An append that is repeated after a failure adds equal rows, of which one is read. Null is empty text;
    repeated rows share a blob; an empty table leaves the ledger as it is. Texts are matched as a whole.

    A text moves once; copies are dropped in each task before that. The join back moves names and findings, and columns
    of the row that are asked for.
    """
    spark, rules = docs.sparkSession, rules_version()
    base = packed(docs, text=text).withColumn("blob", F.unhex(F.sha2(text_of(), 256)))
    blobs = base.select("blob", text_of().alias("text")).dropDuplicates(["blob"])
    seen = read_ledger(spark, ledger, rules)
    if seen is not None:
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    blobs.select("blob", scan(F.col("text")).alias("spans")).write.mode("append").parquet(f"{ledger}/rules={rules}")
    found = read_ledger(spark, ledger, rules).withColumnRenamed("blob", "of")
    return base.select("row", "blob").join(found, F.col("blob") == F.col("of")).select("row", "blob", "spans")
