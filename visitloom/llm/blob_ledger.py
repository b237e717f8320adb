"""Secret scan with a ledger: each distinct text is scanned once per version of the rules.

Every row is a path (or a historical version of one) to a blob, addressed by the SHA-256 of its text. The ledger
holds the findings of scanned (blob, rules version) pairs; a run scans only pairs that it lacks, adds them,
and joins findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import folder, kept

#: Kinds in the order in which spans that start together are listed. Fixed values.
KINDS = ("assign", "access", "hex", "pem", "jwt", "token")
VERSION = "base3+3, whole pem"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: From BEGIN through headers and body to the END line of the same label, with line ends also written as backslash n; where END
#: is missing, to the end of the headers and base64 lines.
PEM_GAP = r"(?:[\x20\t\r\n]|\\[nrt])"
PEM = re.compile(
    rf"-----BEGIN ([A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?)-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1-----|"
    rf"(?:{PEM_GAP}+(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n\\]*|[A-Za-z0-9+/=]{{16,}}|[A-Za-z0-9+/]*=+[A-Za-z0-9+/]*|"
    rf"(?<=[A-Za-z0-9+/]{{16}}\n)[A-Za-z0-9+/]+(?=[\x20\t\r]*(?:\n|\Z))))*)")
MORE = {
    "pem": ("PRIVATE KEY", PEM),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "token": ("_", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}|[sr]k_live_[A-Za-z0-9]{16,}")),
}
SPANS = "array<struct<kind: string, start: long, end: long>>"


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, place in ``KINDS``, end) of every finding of one text, in order; offsets are code points."""
    found = []
    low = text.lower()
    if any(word in low for word in ("password", "passwd", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for place, (kind, (needle, rule)) in enumerate(MORE.items(), 3):
        if needle in text:
            found += [(m.start(), place, m.end()) for m in rule.finditer(text)]
    return sorted(found)


def _scan(blobs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(t)]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["blob", "spans"])

    return blobs.mapInArrow(run, f"blob binary, spans {SPANS}")


def blob_of(text: Column) -> Column:
    """Address of a text; NULL is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, version, spans) of all earlier runs; empty for a new path."""
    schema = f"blob binary, version string, spans {SPANS}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan_history(paths: DataFrame, *, text: str = "text", ledger: str | None = None,
                 version: str = VERSION) -> DataFrame:
    """``paths`` with ``blob`` and ``spans``; columns of those names are replaced.

    Each row keeps its place however often its text occurs. NULL and empty texts are one blob without
    findings. ``ledger`` is a folder that later runs share (a new one when None); equal blobs of this run
    are scanned once, blobs that it has under ``version`` not at all. Whole texts are scanned. spans are
    in order of start, then kind. An empty table gives no rows.
    """
    spark = paths.sparkSession
    ledger = ledger or folder(spark, "ledger")
    keep = [c for c in paths.columns if c not in ("blob", "spans")]
    addressed = paths.select(*keep, blob_of(F.col(text)).alias("blob"))
    seen = kept(read_ledger(spark, ledger).filter(F.col("version") == version).select("blob", "spans"), "seen")
    fresh = addressed.select("blob", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(
        seen.select("blob").distinct(), "blob", "left_anti").dropDuplicates(["blob"])
    _scan(fresh).select("blob", F.lit(version).alias("version"), "spans").write.mode("append").parquet(ledger)
    known = read_ledger(spark, ledger).filter((F.col("version") == version) & (F.size("spans") > 0))
    known = known.groupBy("blob").agg(F.first("spans").alias("spans"))
    return addressed.join(known, "blob", "left").select(
        *keep, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(found: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``scan_history`` with every span of ``text`` replaced by ``mark``; overlapping spans by one."""
    @F.pandas_udf("string")
    def cleaned(texts, spans):
        out = []
        for t, found_in in zip(texts, spans):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for a, b in sorted((s["start"], s["end"]) for s in found_in):
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]))
        return type(texts)(out, dtype=object)

    hit = F.size("spans") > 0     # other texts do not go through Python
    return found.withColumn(text, F.coalesce(
        cleaned(F.when(hit, F.col(text)), F.when(hit, F.col("spans"))), F.col(text)))
