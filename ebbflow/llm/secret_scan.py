"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of a file (here: a document) is addressed by the SHA-256 of its text.  A ledger keeps the
(blob, rule version) pairs that were scanned; `scan_increment` scans only pairs that the ledger lacks, each blob
once however many paths hold it, and `findings_by_path` joins the ledger's findings back to all paths.  `Ledger` keeps
the pairs as Parquet in a folder, a part for each increment: an increment that is run again after a failure writes
its own part again, and a change of the rules scans old blobs anew under the new version's name.

Defined results: a null text is the empty blob; a null id keeps its own row; repeated rows are kept, one result
each; an empty table gives an empty result; a very long text is scanned whole; a path with several texts has findings
for each; extra columns of the input are ignored, or kept where documents are, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import free_name, shared_folder, small_batches

#: Name of the rules below; a change of a pattern needs a new name, so that old blobs are scanned again.
RULE_VERSION = "base-1"
#: Kinds in their fixed order. (fixed values)
KINDS = ("assign", "access", "hex")
#: The base patterns; letters of `assign` in either case, ASCII only. (fixed values)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of [0-9a-f]+ of 32 or more characters

#: Parts that the documents of one blob are dealt to where their findings are joined back to whole documents.
SALTS = 16

LEDGER_SCHEMA = "blob_id string, rule_version string, n_assign long, n_access long, n_hex long, spans string"


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All (start, end, kind) of one text, by start and then kind in the order of KINDS; ends are exclusive."""
    found = []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if any(word in low for word in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


@dataclass(frozen=True)
class Rules:
    """A version of the rules: its name, and the spans that it finds in a text, of the kinds of KINDS."""

    version: str
    find: Callable[[str], list[tuple[int, int, str]]]


BASE = Rules(RULE_VERSION, find_spans)


def _scan(rules: Rules) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = {k: [] for k in KINDS}, []
            for text in batch.column("text"):
                got = rules.find(text.as_py() or "")
                for k in KINDS:
                    counts[k].append(sum(x[2] == k for x in got))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in got))
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob_id"), pa.array([rules.version] * len(spans), pa.string()), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(spans, pa.string())],
                names=["blob_id", "rule_version", "n_assign", "n_access", "n_hex", "spans"],
            )

    return scan


def address(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, holder, blob_id, text): every version with the address of its content; holder is the path as text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    small_batches(versions)
    path = F.col(f"`{path_col}`")
    holder = F.coalesce(path.cast("string"), F.lit("\0"))
    return versions.select(path.alias("path"), holder.alias("holder"), F.sha2(text.cast("binary"), 256).alias("blob_id"), text.alias("text"))


def scan_increment(addressed: DataFrame, ledger: DataFrame | None = None, rules: Rules = BASE) -> DataFrame:
    """Ledger rows of the blobs that `ledger` lacks under the rules' version; append them to the ledger.

    The smallest path of each unseen blob stands for it: texts move once, dealt by path, never by blob, so a blob
    that a third of all paths hold does not meet in one task.
    """
    holders = addressed.groupBy("blob_id").agg(F.min("holder").alias("holder"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rules.version).select("blob_id").distinct()
        holders = holders.join(seen, "blob_id", "left_anti")
    texts = addressed.join(holders.hint("shuffle_hash"), ["holder", "blob_id"], "left_semi")
    scanned = texts.select("blob_id", "text").mapInArrow(_scan(rules), LEDGER_SCHEMA)
    return scanned.dropDuplicates(["blob_id", "rule_version"])  # a path may be listed twice with one content


def findings_by_path(addressed: DataFrame, ledger: DataFrame, rules: Rules = BASE) -> DataFrame:
    """Join the findings of a rule version back to all paths: one row for each version of a path.

    Blobs with findings, few beside all, are laid out once for each of SALTS parts that their paths are dealt to, so a blob that
    a third of all paths hold meets them in as many tasks; a blob without any needs no partner.  All blobs must have
    been scanned under the version.
    """
    current = ledger.filter(F.col("rule_version") == rules.version)
    n = [f"n_{k}" for k in KINDS]
    found = current.filter("spans <> ''").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = addressed.select("path", "blob_id", F.pmod(F.xxhash64("holder", "text"), F.lit(SALTS)).cast("int").alias("salt"))
    out = dealt.join(found, ["blob_id", "salt"], "left").drop("salt")
    return out.select("path", "blob_id", F.lit(rules.version).alias("rule_version"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in n], F.coalesce("spans", F.lit("")).alias("spans"))


class Ledger:
    """A ledger in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, rules: Rules = BASE):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def rows(self, increments: int) -> DataFrame | None:
        """What the first increments scanned; None before the first."""
        if not increments:
            return None
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(*[f"{self.folder}/increment={i}" for i in range(increments)])

    def append(self, addressed: DataFrame, increment: int) -> None:
        """Scan what the earlier increments have not scanned under these rules, as part number `increment`."""
        scan_increment(addressed, self.rows(increment), self.rules).write.mode("overwrite").parquet(f"{self.folder}/increment={increment}")

    def scan_history(self, versions: Sequence[DataFrame]) -> DataFrame:
        """The ledger's rows after all increments of a history: addressed frames, the oldest first."""
        for i, addressed in enumerate(versions):
            self.append(addressed, i)
        return self.rows(len(versions))


def history(addressed: DataFrame, increments: int) -> list[DataFrame]:
    """A table as a history of increments, dealt by path: each version is in one of them."""
    part = F.pmod(F.xxhash64("holder"), F.lit(increments))
    return [addressed.filter(part == i) for i in range(increments)]


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, increments: int = 2, rules: Rules = BASE) -> DataFrame:
    """Findings of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob_id, rule_version.

    Without a ledger the documents come as a history of so many increments over a ledger of its own.
    """
    addressed = address(docs, "doc_id", "text")
    if ledger is None:
        whole = Ledger(docs.sparkSession, shared_folder(docs.sparkSession, "ledger"), rules).scan_history(history(addressed, increments))
    else:
        fresh = scan_increment(addressed, ledger, rules)
        whole = ledger.select(*fresh.columns).unionByName(fresh)
    return findings_by_path(addressed, whole, rules).select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans", "blob_id", "rule_version",
    )


def digest(spans: list[tuple[int, int, str]]) -> str:
    """SHA-256 of the span list, as `scan_documents` returns it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def mask_secrets(docs: DataFrame, ledger: DataFrame | None = None, mark: str = "*", rules: Rules = BASE) -> DataFrame:
    """Documents with each character of a finding replaced by `mark`; all columns and all rows stay.

    Findings are few beside texts: blobs that many documents hold meet their findings in as many parts as it takes.
    """
    blob, held = free_name(docs, "blob"), free_name(docs, "spans")

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, (text, spans) in enumerate(zip(texts, batch.column(held).to_pylist(), strict=True)):
                for span in (spans or "").split(",") if spans and text else ():
                    _, a, b = span.split(":")
                    text = text[: int(a)] + mark * (int(b) - int(a)) + text[int(b) :]
                texts[i] = text
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch.select([n for n in batch.schema.names if n != held])

    addressed = address(docs, "doc_id", "text")
    fresh = scan_increment(addressed, ledger, rules)
    found = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    salt = free_name(docs, "salt")
    spans = found.filter((F.col("rule_version") == rules.version) & (F.col("spans") != "")).select(F.col("blob_id").alias(blob), F.col("spans").alias(held), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    keyed = docs.withColumns({blob: F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), salt: F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")})
    joined = keyed.join(spans, [blob, salt], "left").select(*[f"`{c}`" for c in docs.columns], held)
    return joined.mapInArrow(mask, docs.schema)
