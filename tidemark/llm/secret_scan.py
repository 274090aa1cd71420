"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger is a table (blob, rule_version, spans) with a row
for each blob that was scanned by a version of the rules, whether or not anything was found. Only pairs of blob and rule
version that the ledger lacks are scanned, each once, whatever the number of paths that hold the blob; then the findings
are joined back to all paths. A span is the place of a match in code points, its end exclusive. The version of the rules is
a digest of all patterns, so changed rules scan anew. A ledger may hold a pair twice (two writers, a job that was run again
after it failed); it is read as one row each, and only rows of blobs that are present leave it.

What is broadcast is bounded by its bytes (common.BROADCAST_BYTES): the blobs that a row may have to be skipped for (those with
several paths, or known ones) and the findings. Beyond that bound joins shuffle: the first with the texts, once.

Defined cases: a null text is an empty text. Repeated rows share one blob and each gets its findings. A null doc_id is a path
like any other. An empty table gives an empty table. Only doc_id and text are read, so other columns can't clash; `redact` gives
back all columns, whatever their names. Matches of one kind don't overlap (leftmost first); those of two kinds may. A private
key's match holds its body, not just its first line.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, kept, let, running, shared_dir, temporary

#: A private key from its first line on, in steps that can't be taken back, so that long texts need no deep stack: all up to
#: its end, or, where the next line of dashes is not that end, its headers and what follows them of base64 (runs of 16 or
#: more, whole lines, and pieces between line breaks written as \n).
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-{5,}+END [A-Z ]*PRIVATE KEY-----"
    r"|(?:(?:\\[nr]|\s)*+(?:Proc-Type|DEK-Info)\x20*:[^\n\\]*+)*+"
    r"(?:(?:\\[nr]|\s)*+[A-Za-z0-9+/]{16,}+=*+|[\x20\t\r]*+\n[\x20\t]*+[A-Za-z0-9+/]++=*+(?=\s*?(?:\n|\z))|(?:\\r)?\\n[A-Za-z0-9+/]++=*+(?=[\\\s\"']|\z))*+)"
)
#: Kind, pattern, the group whose length counts, and the length it needs. The first three are the base.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", PEM, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]
BASE = 3
RULE_VERSION = hashlib.sha256(repr(KINDS).encode()).hexdigest()[:16]
#: Texts without this string hold no match of the kind.
NEEDS = {"access": "AKIA", "pem": "PRIVATE KEY", "jwt": "eyJ"}
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _of_kind(text: Column, rank: int) -> Column:
    """Spans of one kind: places are sums of the lengths of what lies between matches and of the matches."""
    kind, pattern, group, least = KINDS[rank]
    none = F.array().cast(SPANS)

    def placed(between: Column, hits: Column, counted: Column) -> Column:
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda x, y: F.length(x) + F.length(y))
        ends = running(sizes, F.lit(0), lambda at, n: at + n)
        some = F.zip_with(ends, hits, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.filter(some, lambda x, i: F.length(F.get(counted, i)) >= least)

    def counted(between: Column, hits: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda c: placed(between, hits, c)) if group else placed(between, hits, hits)

    some = text.rlike(pattern)
    if kind in NEEDS:
        some = F.contains(text, F.lit(NEEDS[kind])) & some
    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(some, let(F.split(text, pattern, -1), lambda between: let(every, lambda hits: counted(between, hits)))).otherwise(none)


def spans(text: Column) -> Column:
    """All spans in `text`, by start, then by the kinds' order."""
    return F.sort_array(F.concat(*[_of_kind(text, rank) for rank in range(len(KINDS))]))


def blob() -> Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """(doc_id, blob, spans) for each row of `docs`. `ledger`: the folder of the ledger; a new one if none is given."""
    spark = docs.sparkSession
    known = None
    if ledger:
        try:
            known = spark.read.parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
        except AnalysisException as e:  # the first scan of a ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
    own = not ledger
    ledger = ledger or f"{shared_dir(spark)}/tidemark/ledger-{uuid.uuid4().hex}"
    paths = kept(docs.select("doc_id", F.unhex(blob()).alias("blob")))
    present = paths.groupBy("blob").agg(F.min("doc_id").alias("holder"), F.count("*").alias("n"))
    # One path of each unseen blob gives its text: the smallest. Only blobs of several paths and known ones must be told to the rows.
    if known is None:
        marks = present.where("n > 1").select("blob", "holder", F.lit(False).alias("seen"))
    else:
        old = known.select(F.unhex("blob").alias("blob")).distinct().withColumn("seen", F.lit(True))
        marks = present.join(old, "blob", "left").where("n > 1 or seen").select("blob", "holder", F.coalesce("seen", F.lit(False)).alias("seen"))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    one = attach(texts, kept(marks.withColumn("marked", F.lit(True))), "blob").where("marked is null or not seen and doc_id <=> holder")
    scanned = one.select("blob", spans(F.col("text")).alias("spans")).dropDuplicates(["blob"])  # rows with equal ids too
    scanned.select(F.lower(F.hex("blob")).alias("blob"), F.lit(RULE_VERSION).alias("rule_version"), "spans").write.mode("append").parquet(ledger)
    if own:
        temporary(spark, ledger)
    findings = spark.read.parquet(ledger).where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select(F.unhex("blob").alias("blob"), "spans")
    if known is not None:
        findings = findings.join(present.select("blob"), "blob", "left_semi")
    findings = kept(findings.groupBy("blob").agg(F.first("spans").alias("spans")))  # one row for each blob, however often it was written
    empty = F.array().cast(SPANS)
    return attach(paths, findings, "blob").select("doc_id", F.lower(F.hex("blob")).alias("blob"), F.coalesce("spans", empty).alias("spans"))


def joined(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, s: Column, mark: str = "[SECRET]") -> Column:
    """`text` with `mark` in place of its spans (sorted by start); where they overlap, of their union."""

    def cut(reach: Column) -> Column:  # how far the spans up to each reach
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        firsts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= before(i)))
        parts = F.transform(firsts, lambda i: text.substr(before(i) + 1, F.get(s, i)["start"] - before(i)))
        return F.array_join(F.concat(parts, F.array(text.substr(F.element_at(reach, -1) + 1, F.length(text)))), mark)

    return F.when(F.size(s) == 0, text).otherwise(let(running(s, F.lit(0), lambda at, x: F.greatest(at, x["end"])), cut))


def redact(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """`docs` with secrets masked and n_chars, if there is such a column, brought up to date where the text changed; every row stays. Only texts with
    findings are joined."""
    hits = scan(docs.select("doc_id", "text"), ledger).where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*place.values())  # names that no column of ours has
    text = F.col(place["text"])
    got = attach(plain.withColumn("blob", F.sha2(F.coalesce(text, F.lit("")), 256)), kept(hits), "blob")
    got = got.withColumn("masked", F.when(F.col("spans").isNotNull(), redacted(text, F.col("spans"))))
    cols = {c: F.col(k) for c, k in place.items()}
    cols["text"] = F.coalesce("masked", text)
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("masked").isNull(), cols["n_chars"]).otherwise(F.length("masked")).cast(docs.schema["n_chars"].dataType)
    return got.select(*[x.alias(c) for c, x in cols.items()])
