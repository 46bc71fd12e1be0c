"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

A record is one row of text that the writer ends with two line ends, as the format asks; files have no size
bound of their own. Reading cuts the files at the record magic, so each task reads one split of a file and
never a whole one. A cut is a candidate record: its offset is the sum of all bytes before it, its successor
follows from its Content-Length. The magic may also stand inside a payload. So only candidates that can be
reached from the start of the file along the successors are records; they are found by pointer jumping, in
as many rounds as the logarithm of the records of a file. Candidates not reached are payload and are put back.

Of records with equal payloads of ``least`` bytes or more, that with the largest page_id is a response, the
others are revisits without payload; reading takes their length and digest from the record they refer to.

Hot payloads (a third of all pages) are combined before the shuffle. The digests of repeated payloads are counted: a
list within ``broadcast_bytes`` is broadcast and payloads stay where they are, a longer one is joined. Defined results: a null page is an empty payload; rows that repeat a page_id give a
record each; of equal payloads all rows with the largest page_id are responses; a null page_id is smaller
than any other and revisits the largest one; line ends in a url are written as %0D and %0A.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeimpact.llm.common import stage

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"  # fixed by the format
LEAST, DATE = 1000, "2000-01-01T00:00:00Z"


def records(pages: DataFrame, least: int = LEAST, date: str = DATE, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, record): the text of every page's record, without the two line ends that close it."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"), F.sha1(F.encode(payload, "utf-8")).alias("digest"),
    )
    groups = sized.filter(F.col("bytes") >= least).groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").drop("n")
    groups = stage(groups, "repeated")
    if groups.count() * 100 <= broadcast_bytes:
        groups = F.broadcast(groups)
    return sized.join(groups, "digest", "left").select("page_id", record_text(date).alias("record"))


def record_text(date: str) -> Column:
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END), F.when(again, "").otherwise(F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    return F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))
        .otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write(pages: DataFrame, path: str, **options) -> None:
    records(pages, **options).select("record").write.option("lineSep", END).text(path)


def candidates(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """Every piece that follows a magic: file, split, place, sizes, header fields, and the payload's length and digest
    where the piece ends as its record does. ``more`` may ask for the piece's own text, ``value``."""
    pieces = spark.read.text(path, lineSep=MAGIC).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value",
    )
    head = F.substring_index("value", END, 1)

    def field(name: str) -> Column:
        return F.regexp_extract(head, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)

    length = F.try_to_number(field("Content-Length"), F.lit("999999999999999999")).cast("long")
    parsed = pieces.withColumns(
        {
            "bytes": F.octet_length("value").cast("long"), "head": F.octet_length(head).cast("long"), "length": length,
            "kind": field("WARC-Type"), "page": F.regexp_extract(field("WARC-Record-ID"), "^<urn:page:(.*)>$", 1),
            "refers": F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1),
            "stated": F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1),
        }
    )
    whole = F.col("length").isNotNull() & (F.col("bytes") == F.col("head") + F.col("length") + 2 * len(END))
    return parsed.select(
        "file", "block", "place", "bytes", "head", "length", "kind", "page", "refers", "stated",
        *[F.when(whole, c).alias(n) for n, c in payload_sums(F.col("value")).items()],
        *more,
    )


def payload_sums(value: Column) -> dict[str, Column]:
    """Length and digest of the payload that follows the record's and the response's own header."""
    data = value.cast("binary")
    http = F.octet_length(F.substring_index(F.substr(value, F.instr(value, END) + len(END)), END, 1))
    start = F.col("head") + 2 * len(END) + http
    size = (F.col("head") + len(END) + F.col("length") - start).cast("int")
    return {"payload_bytes": size.cast("long"), "payload_digest": F.sha1(F.substr(data, (start + 1).cast("int"), size))}


def offsets(pieces: DataFrame) -> DataFrame:
    """Adds offset (of the magic before each piece) and successor; sums run within splits, then over a file's splits."""
    size = F.col("bytes") + len(MAGIC)
    in_split = Window.partitionBy("file", "block").orderBy("place")
    splits = pieces.groupBy("file", "block").agg(F.sum(size).alias("all"))
    splits = splits.withColumn("base", F.sum("all").over(Window.partitionBy("file").orderBy("block")) - F.col("all"))
    at = F.sum(size).over(in_split) - size + F.col("base") - len(MAGIC)
    placed = pieces.join(splits.drop("all"), ["file", "block"]).withColumn("offset", at)
    return placed.withColumn("successor", F.col("offset") + len(MAGIC) + F.col("head") + F.col("length") + 2 * len(END))


def reachable(chain: DataFrame, rounds: int = 64) -> DataFrame:
    """(file, offset) of the candidates that the successors lead to from offset 0."""
    jump = stage(chain.select("file", "offset", F.col("successor").alias("to")).filter("`to` IS NOT NULL"), "jump")
    reached = stage(chain.filter("offset = 0").select("file", "offset"), "reached")
    known = reached.count()
    for _ in range(rounds):
        # What is 2^k records behind a reached one is reached, too; then jumps double.
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = stage(reached.unionByName(ahead).distinct(), "reached")
        now = reached.count()
        if now == known:
            return chain.select("file", "offset").join(reached, ["file", "offset"], "left_semi")
        known = now
        far = jump.select("file", F.col("offset").alias("to"), F.col("to").alias("further"))
        jump = stage(jump.join(far, ["file", "to"]).select("file", "offset", F.col("further").alias("to")), "jump")
    raise RuntimeError("chains longer than 2^rounds records")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pieces = stage(offsets(candidates(spark, path)).filter("offset >= 0"), "pieces")
    records = stage(pieces.join(reachable(pieces), ["file", "offset"]), "records")
    broken = records.filter("payload_digest IS NULL").select("file", F.col("offset").alias("at"), "successor")
    if broken.isEmpty():
        fixed = broken.selectExpr("file", "at AS offset", "successor AS own_bytes", "CAST(NULL AS STRING) AS own_digest")
    else:
        texts = offsets(candidates(spark, path, "value").join(broken, "file", "left_semi"))
        fixed = rejoined(texts, owners(pieces, broken))
    filled = records.join(fixed, ["file", "offset"], "left").select(
        "page", "kind", "refers", "stated",
        F.coalesce("payload_bytes", "own_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "own_digest").alias("payload_digest"),
    )
    own = filled.filter("kind = 'response'").groupBy(F.col("page").alias("refers"), F.col("payload_digest").alias("stated")).agg(
        F.max("payload_bytes").alias("full_bytes")
    )
    again = F.col("kind") == "revisit"
    out = filled.join(own, ["refers", "stated"], "left")
    return out.select(
        F.when(F.col("page") != "none", F.col("page").cast("long")).alias("page_id"),
        F.when(again, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("stated")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(again, F.col("refers").cast("long")).alias("refers_to"),
    )


def owners(pieces: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, offset, first) of the pieces of ``broken`` records: each belongs to the last one that starts at or before it.

    No text takes part. A record that begins in an earlier split is looked up among one row per split.
    """
    marks = pieces.select("file", "block", F.col("offset").alias("at")).join(broken, ["file", "at"], "left")
    start = F.when(F.col("successor").isNotNull(), F.struct("at", "successor"))
    last = marks.groupBy("file", "block").agg(F.max(start).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.last("last", True).over(before).alias("earlier"))
    here = F.last(start, True).over(Window.partitionBy("file", "block").orderBy("at"))
    met = marks.withColumn("here", here).join(last, ["file", "block"]).withColumn("of", F.coalesce("here", "earlier"))
    return met.filter("at < of.successor").select("file", F.col("at").alias("offset"), F.col("of.at").alias("first"))


def rejoined(texts: DataFrame, owned: DataFrame) -> DataFrame:
    """Payload sums of records whose payload holds a magic: their pieces, put together in order.

    Pieces are dealt by their place and then by their record, so a file's other records go nowhere.
    """
    held = texts.select("file", "offset", "head", "length", "value").join(owned, ["file", "offset"])
    whole = held.groupBy("file", "first").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x.value), MAGIC).alias("value"),
        F.min_by("head", "offset").alias("head"), F.min_by("length", "offset").alias("length"),
    ).withColumnRenamed("first", "offset")
    sums = payload_sums(F.col("value"))
    return whole.select("file", "offset", sums["payload_bytes"].alias("own_bytes"), sums["payload_digest"].alias("own_digest"))
