"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern. Their hashes are counted over distinct repositories and
owners: a value that many owners hold is an example that was copied around, one that a
single owner holds is a live-looking credential of that owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import row_key, stored, table, whole_text

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs, so the same matches as [0-9a-f]+ of 24 and more
BASE_KINDS = ("assign", "access", "hex")
# Kinds that the scan adds: (kind, pattern, group of the value, text that must occur).
ADDED = (
    ("vcs", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, "gh"),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, "xox"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, "eyJ"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "PRIVATE KEY"),
    ("login", r"://[A-Za-z0-9._%-]+:([^\s:/@]{6,})@", 1, "://"),
)
NO_SPANS = "array<struct<kind:string,rank:int,start:int,end:int,from:int,to:int,value:string>>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in there."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, join, first: int) -> Column:
    """The running ``join`` of an array of whole numbers, from ``first`` on.

    The array is cut into about as many parts as a part has numbers, so that n numbers
    take n to the power of 1.5 steps, and nothing grows by copies of itself.
    """

    def fold(part: Column, start: Column) -> Column:
        return F.aggregate(part, start, join)

    def each(part: Column, start: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: fold(F.slice(part, F.lit(1), i), start))

    def whole(n: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(n))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / width).cast("int")), lambda i: F.slice(n, i * width + 1, width))
        return bound(cut, lambda parts: bound(F.transform(parts, lambda p: fold(p, F.lit(first))), lambda ends: inner(parts, ends)))

    def inner(parts: Column, ends: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: F.when(i == 0, F.lit(first)).otherwise(fold(F.slice(ends, F.lit(1), F.greatest(i, F.lit(1))), F.lit(first))))
        return F.flatten(F.zip_with(parts, starts, each))

    return bound(numbers, lambda n: F.when(F.size(n) == 0, F.array().cast("array<int>")).otherwise(whole(n)))


def located(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, might: Column) -> Column:
    """Spans of all matches, in code points (start, end) and bytes (from, to).

    The text between matches gives the offsets, as running sums. ``least`` is the least
    length of the value; shorter matches are dropped after the search, as a matched place
    is not tried again. Texts without a match are scanned once.
    """

    def spans(found: Column, gaps: Column) -> Column:
        ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b, 0)
        stops = running(F.zip_with(gaps, found, lambda g, m: F.octet_length(g) + F.octet_length(m)), lambda a, b: a + b, 0)
        return F.transform(F.arrays_zip(found.alias("match"), ends.alias("end"), stops.alias("to")), span)

    def span(m: Column) -> Column:
        match, end, to = m["match"], m["end"], m["to"]
        value = F.regexp_extract(match, pattern, group) if group else match
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(rank).alias("rank"),
            (end - F.length(match)).alias("start"),
            end.alias("end"),
            (to - F.octet_length(match)).alias("from"),
            to.alias("to"),
            value.alias("value"),
        )

    all_found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = lambda found: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    kept = bound(all_found, lambda found: bound(gaps(found), lambda g: F.filter(spans(found, g), lambda s: F.length(s["value"]) >= least)))
    return F.when(might & text.rlike(pattern), kept).otherwise(F.array()).cast(NO_SPANS)


def candidate_spans(text: Column) -> Column:
    """All candidate spans of a text: base kinds, and added ones, which may overlap them."""
    base = [
        located(text, "assign", 0, ASSIGN, 2, 6, text.contains(":") | text.contains("=")),
        located(text, "access", 1, ACCESS, 0, 20, text.contains("AKIA")),
        located(text, "hex", 2, HEX, 0, 24, F.lit(True)),
    ]
    more = [located(text, k, 3 + i, p, g, 1, text.contains(m)) for i, (k, p, g, m) in enumerate(ADDED)]
    return F.concat(*base, *more)


def _found(docs: DataFrame, doc_id: str, text: str, owner: str | None, repository: Column | None) -> DataFrame:
    """Candidates of each row with hashed values, evaluated once."""
    hashed = lambda s: s.dropFields("value").withField("hash", F.xxhash64(s["value"]))
    none = F.lit(None).cast("string")
    return stored(
        docs.select(
            row_key(doc_id, text).alias("_key"),
            F.col(doc_id).alias("doc_id"),
            (F.col(owner).cast("string") if owner else none).alias("_owner"),
            (repository.cast("string") if repository is not None else none).alias("_repository"),
            F.transform(candidate_spans(whole_text(text)), hashed).alias("_spans"),
        ),
        "secrets",
    )


def _judged(found: DataFrame, widely: int) -> DataFrame:
    """(_key, spans): the spans of each key that has any, with their ownership and verdict."""
    flat = found.select("_key", "_owner", "_repository", F.explode("_spans").alias("_s")).withColumn("_hash", F.col("_s.hash"))
    held = flat.groupBy("_hash", "_owner", "_repository").agg(F.count("*").alias("_n"))
    owners = held.groupBy("_hash", "_owner").agg(F.count("*").alias("_n"))
    counts = owners.groupBy("_hash").agg(F.count("*").alias("n_owners"), F.sum("_n").alias("n_repositories"))
    several = counts.where((F.col("n_owners") > 1) | (F.col("n_repositories") > 1))
    one = F.lit(1).cast("long")
    judged = (
        flat.join(several, "_hash", "left")
        .withColumn("n_owners", F.coalesce("n_owners", one))
        .withColumn("n_repositories", F.coalesce("n_repositories", one))
        .withColumn("verdict", F.when(F.col("n_owners") >= widely, "example").when(F.col("n_owners") == 1, "live").otherwise("shared"))
    )
    span = F.struct("_s.start", "_s.rank", "_s.end", "_s.kind", "n_owners", "n_repositories", "verdict", "_s.from", "_s.to")
    return judged.groupBy("_key").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str | None = "source", repository: Column | None = None, widely: int = 3) -> DataFrame:
    """One row per document: doc_id, spans (start, rank, end, kind, n_owners, n_repositories, verdict,
    and the offsets in bytes: from, to).

    A candidate is an ``example`` if at least ``widely`` owners hold its value, else
    ``live`` if it belongs to one owner, else ``shared``. Without an owner column, or
    where it is null, the owner is unknown, and all unknown owners count as one.

    Rows stay rows: repeated ones and null ids give one result each. Null and empty texts
    have no spans. Columns other than those named are not looked at.

    Values are hashed before they move. (hash, owner, repository) is made distinct
    within each task before the shuffle, and only values that recur are joined back, so
    a value in a third of all documents costs a row per task and repository.
    """
    found = _found(docs, doc_id, text, owner, repository)
    judged = _judged(found, widely)
    none = F.array().cast(judged.schema["spans"].dataType)
    return found.join(judged, "_key", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """Text with each run of overlapping spans, given in order of start, replaced by ``mark``.

    A run starts where no earlier span reaches; the text is cut there by byte offsets.
    """
    reach = running(F.transform(spans, lambda s: s["to"]), lambda a, b: F.greatest(a, b), 0)
    before = bound(reach, lambda r: F.concat(F.array(F.lit(0)), F.slice(r, F.lit(1), F.size(r) - 1)))
    starts = F.filter(F.zip_with(spans, before, lambda s, b: F.struct(b.alias("after"), s["from"].alias("at"))), lambda p: p["at"] >= p["after"])

    def cut(data: Column, start: Column, size: Column) -> Column:
        return F.substring(data, start + 1, size).cast("string")

    def rest(data: Column) -> Column:
        end = F.array_max(F.transform(spans, lambda s: s["to"]))
        kept = F.transform(starts, lambda p: cut(data, p["after"], p["at"] - p["after"]))
        return F.array_join(F.concat(kept, F.array(cut(data, end, F.octet_length(data)))), mark)

    return F.when(F.size(spans) == 0, text).otherwise(bound(text.cast("binary"), rest))


def redact_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str | None = "source", repository: Column | None = None, widely: int = 3, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs``, with candidates that are not widely copied examples replaced.

    Texts without such a candidate stay as they are, null ones included.
    """
    found = _found(docs, doc_id, text, owner, repository)
    real = _judged(found, widely).select(F.col("_key").alias("_secret_key"), F.filter("spans", lambda s: s["verdict"] != "example").alias("_real"))
    real = real.where(F.size("_real") > 0)
    key = row_key(doc_id, text)
    clean = F.when(real["_real"].isNull(), docs[text]).otherwise(without_spans(docs[text], real["_real"], mark))
    columns = [clean.alias(text) if c == text else docs[c] for c in docs.columns]
    return docs.join(real, key == real["_secret_key"], "left").select(*columns)


def joined(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of the scan's spans."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    verdict = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return scanned.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        verdict("live").alias("n_live"),
        verdict("shared").alias("n_shared"),
        verdict("example").alias("n_example"),
    )


def op5_secret_ownership(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return digest(scan_secrets(docs, repository=F.concat_ws("/", "source", "lang")))
