"""Secret scan with corpus-wide ownership frequency. DataFrame functions only.

Four detectors run over each whole text; the first three are the base. Hashes of the found
values are counted by distinct documents and distinct owners over the corpus. A value that
more than `max_owners` owners or more than `max_documents` documents hold is a widely copied
example; one that few hold and that looks random is a live credential. Base spans are always reported; a span of the fourth
detector only if it is live and overlaps no base span.

Defined results: a null text is empty and has no span; a null owner counts as one owner, a
null id as one document; repeated rows are reported each and counted once; extra columns are
ignored (`secret_report`) or kept (`mask_secrets`); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.runtime import materialise
from .common import numbered, private

# The base detectors, their smallest lengths, and the tokens that can hold a bare value.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BARE = r"[A-Za-z0-9+/_=-]+"
LEAST = {"assign": 6, "access": 20, "hex": 24, "owned": 20}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "owned")

# The same matches as above but for those that are too short: says which texts need a closer look.
# A run starts where no character of its class stands before it, which spares retries inside runs.
_LONG_ASSIGN = r"(?i)(?=[psta])" + ASSIGN[4:-1].removesuffix("+") + "{6})"
_LONG_ACCESS = r"AKIA[A-Z0-9]{16}"
_LONG_HEX = r"(?<![0-9a-f])[0-9a-f]{24}"
_LONG_BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
_DETECTORS = (
    ("assign", _LONG_ASSIGN, ASSIGN, 2), ("access", _LONG_ACCESS, ACCESS, 0),
    ("hex", _LONG_HEX, HEX, 0), ("owned", _LONG_BARE, _LONG_BARE, 0),
)
MASK = "[SECRET]"
MAX_OWNERS = 3
MAX_DOCUMENTS = 50


def looks_live(value: Column, least: int = 16, variety: int = 8) -> Column:
    """Random rather than written: long, letters and digits, many distinct characters."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (
        (F.length(value) >= least) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (distinct >= variety)
        & ~value.rlike("(?i)example|sample|placeholder|changeme|x{6}|0{6}|1234567")
    )


def _matches(text: Column, quick: str, pattern: str, group: int, kind: str) -> Column:
    """Gap before, length, hash and liveness of each match, in order; an empty array for most texts."""
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    kept = F.transform(found, lambda x: F.struct(
        x["gap"].alias("gap"), F.length(x["whole"]).alias("length"),
        F.coalesce(F.length(x["value"]) >= LEAST[kind], F.lit(False)).alias("holds"),
        F.sha2(x["value"], 256).alias("hash"), F.coalesce(looks_live(x["value"]), F.lit(False)).alias("random"),
    ))
    return F.when(text.rlike(quick), kept)


@dataclass
class Scan:
    """rows: what was scanned, with a row number; spans: one row per reported span."""

    rows: DataFrame
    spans: DataFrame
    number: str


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         max_owners: int = MAX_OWNERS, max_documents: int = MAX_DOCUMENTS, keep: list[str] | None = None) -> Scan:
    """Spans (number, kind, order, start, end, owners, documents, live, copied) of every document."""
    keep = [id_col] if keep is None else keep
    number, owner, document, *found = private(docs, "row_number_", "owner_", "document_", *(f"found_{k}" for k in KINDS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = numbered(docs.select(
        *keep, F.col(owner_col).alias(owner), F.col(id_col).alias(document),
        *(_matches(text, quick, pattern, group, kind).alias(name)
          for name, (kind, quick, pattern, group) in zip(found, _DETECTORS)),
    ), "secret-rows", number)
    whole = None
    for order, (kind, name) in enumerate(zip(KINDS, found)):
        part = rows.where(F.col(name).isNotNull()).select(
            F.col(number).alias("number"), F.col(owner).alias("owner"), F.col(document).alias("document"),
            F.lit(kind).alias("kind"), F.lit(order).alias("order"), F.posexplode(name).alias("at", "m"))
        whole = part if whole is None else whole.unionByName(part)
    so_far = Window.partitionBy("number", "order").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce(F.col("m.length"), F.lit(0))).over(so_far)
    placed = whole.withColumn("end", end).where("m.holds").select(
        "number", "owner", "document", "kind", "order", (F.col("end") - F.col("m.length")).alias("start"), "end",
        F.col("m.hash").alias("hash"), F.col("m.random").alias("random"))
    # Which bare values overlap a base span: the furthest end before, the nearest start behind.
    base = F.col("order") < len(BASE)
    by_start = Window.partitionBy("number").orderBy("start")
    behind = Window.partitionBy("number").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    covered = (
        (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1)) > F.col("start"))
        | (F.coalesce(F.min(F.when(base, F.col("start"))).over(behind), F.col("end")) < F.col("end")))
    candidates = materialise(placed.withColumn("covered", covered).where(base | ~F.col("covered")).drop("covered"),
                             "secret-candidates")
    # A hot value is reduced to one line per document, then per owner, before it meets itself.
    owners = materialise(
        candidates.select("hash", "owner", "document").distinct()
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("documents"))
        .groupBy("hash").agg(F.sum("documents").alias("documents"), F.count(F.lit(1)).alias("owners")), "secret-owners")
    spans = (
        candidates.join(owners, "hash")
        .withColumn("copied", (F.col("owners") > max_owners) | (F.col("documents") > max_documents))
        .withColumn("live", F.col("random") & ~F.col("copied"))
        .where(base | F.col("live"))
        .select("number", "kind", "order", "start", "end", "owners", "documents", "live", "copied"))
    return Scan(rows, spans, number)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                  max_owners: int = MAX_OWNERS, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """One row per document: counts, the spans of all kinds, a hash of the base ones, and the greatest frequencies of their values."""
    done = scan(docs, id_col, text_col, owner_col, max_owners, max_documents)
    shown = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("start", "order", "end", shown.alias("shown"), "live", "copied", "owners", "documents")))
    per_row = done.spans.groupBy("number").agg(ordered.alias("found"))
    found = F.coalesce("found", F.array().cast(per_row.schema["found"].dataType))
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda order: lambda x: x["order"] == order
    joined = F.array_join(F.transform("found", lambda x: x["shown"]), ",")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["order"] < len(BASE)), lambda x: x["shown"]), ",")
    rows = done.rows.select(F.col(done.number).alias("number"), F.col(id_col).alias(id_col))
    return rows.join(per_row, "number", "left").withColumn("found", found).select(
        id_col, *(count(of_kind(order)).alias(f"n_{kind}") for order, kind in enumerate(BASE)),
        F.sha2(base, 256).alias("base_sha256"), joined.alias("spans"),
        count(lambda x: x["live"]).alias("n_live"), count(lambda x: x["copied"]).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["documents"])), F.lit(0)).alias("most_documents"))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 max_owners: int = MAX_OWNERS, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """All documents with every reported span replaced by MASK; spans that overlap become one."""
    done = scan(docs, id_col, text_col, owner_col, max_owners, max_documents, keep=docs.columns)
    by_start = Window.partitionBy("number").orderBy("start", "order", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0)
    stretches = (
        done.spans.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(by_start))
        .groupBy("number", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("number").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")))
    number, cuts = private(docs, done.number, "cuts_")
    text = F.col(text_col)
    from_ = lambda i: F.when(i > 0, F.element_at(F.col(cuts), i)["end"]).otherwise(F.lit(0))
    kept = F.concat(
        F.transform(cuts, lambda x, i: F.substr(text, (from_(i) + 1).cast("int"), (x["start"] - from_(i)).cast("int"))),
        F.array(F.substr(text, (F.element_at(F.col(cuts), -1)["end"] + 1).cast("int"))))
    holds = F.lit(False)
    for name in done.rows.columns:
        if name.lower().lstrip("_").startswith("found_") and name not in docs.columns:
            holds = holds | F.col(name).isNotNull()
    hit = done.rows.where(holds).select(*docs.columns, number).join(
        stretches.withColumnsRenamed({"number": number, "cuts": cuts}), number, "left")
    masked = hit.withColumn(text_col, F.when(F.col(cuts).isNull(), text).otherwise(F.array_join(kept, MASK)))
    return done.rows.where(~holds).select(*docs.columns).unionByName(masked.select(*docs.columns))
