"""WARC archives: written as splittable text, read back with boundary-chain verification.

Writing: a page's payload is its HTML in UTF-8.  Of equal payloads of at least ``min_bytes`` the page with the smallest id
becomes a ``response``; the others become ``revisit`` records that refer to it and hold no payload.

Reading: every place in a file where the magic line stands is a candidate record, wherever the splits fall.  The scan
emits for each candidate its offset and, from its Content-Length, that of its successor.  Offsets are sums inside a split, moved
by the total of the splits before it (one row for each split), so an archive of any size is no task of its own.  A candidate
is a record only if the chain from the file's first byte leads to it, so a magic line inside a payload is rejected.
Candidates of a split whose successor is the next candidate form a run; pointer jumping over the runs, from the file's start
on, doubles the reach in each round until nothing is added.  Payloads never leave the scan unless a magic line cuts them.

Defined results for odd inputs: null or empty HTML is a payload of 0 bytes; a null URL gives a record without target URI; page ids
are of any type that has text (percent-encoded in the record id), a null one gives a record id of no page and orders last; of
repeated rows with the smallest id one is the response.  An empty table gives no archive rows.  A truncated last record (no
complete block) ends the chain before it.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .scratch import cut, stored, type_of

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + GAP
ID_PREFIX, NO_ID = "urn:kinlink:page:", "urn:kinlink:no-page"
#: Digits of base 32 as ``conv`` writes them, and the alphabet of the digest (fixed values).
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base-32 SHA-1: 160 bits are four groups of ten hex or eight base-32 digits."""
    h = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), CONV_DIGITS, BASE32)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to for every page."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", sha1_base32(F.col("html").cast("binary")))
    per_page = base.where(F.octet_length("html") >= min_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    per = per_page.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("n"))).alias("f"))
    # only payloads that occur again; the planner sees the table's true size
    again = stored(per.where("n > 1").select("digest", F.lit(True).alias("_again"), F.col("f.page_id").alias("_first"), F.col("f.n").alias("_ties")), "payloads")
    rows = base.join(again, "digest", "left")
    is_first = F.col("_again").isNull() | F.col("page_id").eqNullSafe(F.col("_first"))
    if not again.where("_ties > 1").isEmpty():
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
        tied = rows.where("_ties > 1").where(is_first)
        chosen = tied.groupBy(F.col("digest").alias("_d")).agg(F.min("_row").alias("_one"))
        rows = rows.join(chosen, F.col("digest") == F.col("_d"), "left")
        is_first = is_first & (F.col("_one").isNull() | (F.col("_row") == F.col("_one")))
    return rows.select("page_id", "url", "html", "digest", F.when(is_first, "response").otherwise("revisit").alias("record_type"), F.when(~is_first, F.col("_first")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One archive for each partition of ``records`` (of ``plan_records``)."""
    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    urn = lambda c: F.concat(F.lit("<"), F.coalesce(F.concat(F.lit(ID_PREFIX), F.url_encode(F.col(c).cast("string"))), F.lit(NO_ID)), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        F.when(revisit, line("WARC-Refers-To", urn("refers_to"))).otherwise(""),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"))).otherwise(""),
        line("WARC-Date", date),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    # the writer's line end is the last byte of the gap after the block
    records.select(F.concat(head, block, F.lit(GAP[:-1])).alias("value")).write.option("lineSep", "\n").text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)


def _page(text: Column) -> Column:
    """The page id in a record id, as text."""
    return F.when(text.rlike(f"<{ID_PREFIX}"), F.url_decode(F.regexp_extract(text, rf"<{ID_PREFIX}([^>]*)>", 1)))


def _parse(df: DataFrame) -> DataFrame:
    """Header fields, block and payload of ``value``, which begins after the magic line."""
    df = df.withColumn("head", F.substring_index("value", GAP, 1)).withColumn("head_bytes", F.octet_length("head").cast("long"))
    df = df.withColumn("block_bytes", F.when(F.col("head_bytes") < F.octet_length("value"), _field("Content-Length").try_cast("bigint")))
    df = df.withColumn("record_type", F.lower(_field("WARC-Type"))).withColumn("digest", F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", ""))
    df = df.withColumn("page_id", _page(_field("WARC-Record-ID"))).withColumn("refers_to", _page(_field("WARC-Refers-To")))
    block = F.expr("substring(cast(value as binary), cast(head_bytes + 5 as int), cast(block_bytes as int))")
    df = df.withColumn("block", block)
    http = "octet_length(substring_index(cast(block as string), '\\r\\n\\r\\n', 1))"
    return df.withColumn("payload", F.when(F.col("record_type") == "response", F.expr(f"substring(block, {http} + 5)")).otherwise(F.col("block")))


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))


def _over_splits(per_split: DataFrame, value: Column) -> DataFrame:
    """(file, split, ahead): ``value`` over the splits before each split of a file; one row for each split."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select("file", "split", value.over(before).alias("ahead"))


def _inside() -> WindowSpec:
    """Order of the candidates of a split."""
    return Window.partitionBy("file", "split").orderBy("at")


def chain(cand: DataFrame) -> DataFrame:
    """Candidates (file, split, at, bytes of the chunk, span of the record from its first header byte) with ``offset`` and ``record``.

    ``record``: whether the chain of records from the file's first byte reaches the candidate.
    """
    step = len(MAGIC)
    size = F.col("bytes") + step
    totals = _over_splits(cand.groupBy("file", "split").agg(F.sum(size).alias("total")), F.sum("total"))
    c = cand.withColumn("inside", F.coalesce(F.sum(size).over(_inside().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(totals, ["file", "split"]).withColumn("offset", F.coalesce("ahead", F.lit(0)) + F.col("inside") - step).drop("ahead", "inside")
    c = c.withColumn("next", F.when(F.col("offset") >= 0, F.col("offset") + step + F.col("span")))
    # a run is named by its first candidate
    begins = F.when(F.lag("next").over(_inside()) == F.col("offset"), None).otherwise(F.col("at"))
    c = c.withColumn("begins", begins)
    c = stored(c.withColumn("run", F.last("begins", ignorenulls=True).over(_inside().rowsBetween(Window.unboundedPreceding, 0))).drop("begins"), "candidates")
    # the last candidate of a run points into another run, or to the end of the file
    ends = c.where("next is not null").groupBy("file", "run").agg(F.max(F.struct("offset", "next")).alias("e")).select("file", "run", F.col("e.next").alias("entry"))
    jump = ends.join(c.select("file", F.col("offset").alias("entry"), F.col("run").alias("to")), ["file", "entry"]).select("file", "run", "to", "entry")
    jump = stored(jump.where("run <> to"), "jumps")
    reach = cut(c.where("offset = 0").select("file", "run", F.col("offset").alias("from")))
    have = reach.count()
    while True:
        hop = reach.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), F.col("entry").alias("from"))
        reach = cut(reach.unionByName(hop).distinct())
        now = reach.count()
        if now == have:
            break
        have = now
        on = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = cut(jump.join(on, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")))
    return c.join(reach, ["file", "run"], "left").withColumn("record", F.coalesce(F.col("offset") >= F.col("from"), F.lit(False))).drop("from", "run", "next")


def _with_owner(found: DataFrame) -> DataFrame:
    """``found`` (of ``chain``) with ``owner``: the offset of the record in which a chunk lies (null: in none)."""
    own = F.when(F.col("record"), F.col("offset"))
    carried = _over_splits(found.groupBy("file", "split").agg(F.max(own).alias("last")), F.max("last"))
    here = F.last(own, ignorenulls=True).over(_inside().rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("_here", here).join(carried, ["file", "split"]).withColumn("owner", F.coalesce("_here", "ahead")).drop("_here", "ahead")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives below ``path``: file, offset, record_type, page_id, refers_to, digest (as the header has it),
    payload_bytes and payload_digest (of the payload read), and with ``payloads`` the payload itself."""
    raw = _candidates(spark, path)
    read = _parse(raw).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
    fields = ["record_type", "page_id", "refers_to", "digest", "payload_bytes", "payload_digest"] + ["payload"] * payloads
    span = F.col("head_bytes") + F.col("block_bytes") + 2 * len(GAP)
    narrow = read.select("file", "split", "at", F.octet_length("value").cast("long").alias("bytes"), span.alias("span"), *[c for c in fields if c != "payload"])
    found = stored(chain(narrow), "chain")
    whole = found.where("record and bytes >= span")
    if payloads:
        whole = whole.drop("payload").join(read.select("file", "at", "payload"), ["file", "at"])
    out = whole.select("file", "offset", *fields)
    cut_up = found.where("record and bytes < span")
    if not cut_up.isEmpty():
        # payloads with a magic line inside: their chunks are brought together, in order
        owners = cut_up.select("file", F.col("offset").alias("owner"), F.col("span").alias("need"))
        parts = _with_owner(found).join(owners, ["file", "owner"]).select("file", "at", "owner", "offset", "need").join(raw.select("file", "at", "value"), ["file", "at"])
        whole = parts.groupBy("file", "owner", "need").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("p"))
        whole = whole.withColumn("value", F.array_join(F.transform("p", lambda x: x["value"]), MAGIC))
        again = _parse(whole.where(F.octet_length("value") >= F.col("need"))).withColumns({"offset": F.col("owner"), "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
        out = out.unionByName(again.select("file", "offset", *fields))
    return out


def resolve(records: DataFrame) -> DataFrame:
    """Give each revisit the size of the payload that it refers to, found by its digest among the responses."""
    first = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("_d")).agg(F.first("payload_bytes").alias("_n"))
    visits = records.where("record_type = 'revisit'").drop("payload_digest", "payload_bytes").join(first, F.col("digest") == F.col("_d"))
    visits = visits.withColumns({"payload_bytes": F.col("_n"), "payload_digest": F.col("digest")}).drop("_d", "_n")
    return records.where("record_type = 'response'").unionByName(visits)


def roundtrip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the pages below ``path`` and read them back; ids get the pages' type again."""
    write_warc(plan_records(pages, min_bytes), path)
    kind = type_of(pages, "page_id")
    return resolve(read_warc(pages.sparkSession, path)).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
