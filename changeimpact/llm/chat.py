"""Conversations from messages that quote each other.

Lines that start with > are quoted, each further > one level deeper. Runs of lines of one level are
passages; their normalised text is hashed, whole and by paragraphs, lines and sentences of four words or more, shorter
lines by the run they stand in. The
messages' own passages are hashed alike, and the hashes are joined: the original of a passage is the first
message that says it, in the same conversation and before the reply if there is one, elsewhere otherwise.
The parent of a message is the original that most words of its shallowest linked level come from. Following
parents by pointer jumping gives the thread (its first message) and the depth of each message; ordered by
conversation, thread and turn, every message stands after the one it answers. Quoted runs are taken out of the text, each
with the line that announces it and the blank lines right before it. With ``keep_unlinked`` only runs of which a passage is
linked are; a run that nobody said (a shell session, a quotation of something outside) then stays as it was written.

A passage said by a third of all messages, or a conversation that holds a third of them, is combined to its
first message before the shuffle, and only passages that somebody quotes are looked at. No conversation is
collected: the result has one row per message.

Messages are told apart by SHA-256 of their four columns.

Defined results: messages equal in conversation, turn, role and text are one; a null text or role is an empty
one; messages with a null conversation or turn neither quote nor are quoted (their quoted runs count as unlinked); quoted lines without a word
are taken out; of several messages of one turn
the thread is that of the turn; input columns beyond the four are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeimpact.llm.common import row_key, ship, stage

QUOTE = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
#: Lines that announce a quotation, in the languages of the tables.
ANNOUNCE = re.compile(r"^(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)\s*:\s*$", re.I)
SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|(?<=[。！？])")
LEAST_WORDS = 4


def normal(text: str) -> str:
    return " ".join(re.sub(r"[^\w]+", " ", text.lower()).split())


def pieces(lines: list[str]) -> dict[int, int]:
    """Hashes of a passage, its paragraphs, lines, sentences and runs of short lines, with their numbers of words."""
    out: dict[int, int] = {}
    whole = "\n".join(lines)
    paragraphs = re.split(r"\n\s*\n", whole)
    sentences = [x for p in paragraphs for x in SENTENCE.split(p)]
    runs: list[str] = [""]
    for line in lines:
        n = len(normal(line).split())
        if 0 < n < LEAST_WORDS:
            runs[-1] += f"{line}\n"
        elif runs[-1]:
            runs.append("")
    for part, least in ((whole, 1), *((x, LEAST_WORDS) for x in (*paragraphs, *lines, *sentences, *runs))):
        plain = normal(part)
        count = plain.count(" ") + 1 if plain else 0
        if count >= least:
            h = xxhash.xxh64_intdigest(plain.encode("utf-8"))
            out[h - 2**64 if h >= 2**63 else h] = count
    return out


def parse(text: str) -> tuple[list[tuple[int, str]], list[int], list[tuple[int, int, int, int]]]:
    """A message's parts in order, the hashes of what it says, and (part, level, hash, words) of what it quotes.

    A part is its quoted run's number and its text; own words have number -1, what announces a run has the run's number.
    """
    runs: list[tuple[int, list[str], list[str]]] = []
    for line in re.split(r"\r\n|\r|\n", text):
        found = QUOTE.match(line)
        level = found[0].count(">") if found else 0
        if not runs or runs[-1][0] != level:
            runs.append((level, [], []))
        runs[-1][1].append(line)
        runs[-1][2].append(line[found.end() :] if found else line)
    parts: list[tuple[int, str]] = []
    says: list[str] = []
    quoted: list[tuple[int, int, int, int]] = []
    for i, (level, lines, plain) in enumerate(runs):
        if level:
            found_here = pieces(plain)
            if found_here:
                parts.append((i, "\n".join(lines)))
            quoted += [(i, level, h, n) for h, n in found_here.items()]
            continue
        end = len(lines)
        if i + 1 < len(runs):
            while end and not lines[end - 1].strip():
                end -= 1
            if end and ANNOUNCE.match(lines[end - 1].strip()):
                end -= 1
        if end:
            parts.append((-1, "\n".join(lines[:end])))
            says += lines[:end]
        if end < len(lines):
            parts.append((i + 1, "\n".join(lines[end:])))
    return parts, list(pieces(says)), quoted


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, mid, parts, says, quotes) of each distinct message."""
    ship(messages.sparkSession)
    rows = messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("mid", row_key(*[F.col(c) for c in rows.columns])).dropDuplicates(["mid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = pa.list_(pa.struct([("part", pa.int32()), ("text", pa.string())]))
        quotes = pa.list_(pa.struct([("part", pa.int32()), ("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))
        for batch in batches:
            done = [parse(t) for t in batch.column(3).to_pylist()]
            added = [
                pa.array([[{"part": a, "text": b} for a, b in d[0]] for d in done], pieces_of),
                pa.array([d[1] for d in done], pa.list_(pa.int64())),
                pa.array([[{"part": a, "level": b, "hash": c, "words": n} for a, b, c, n in d[2]] for d in done], quotes),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.select([0, 1, 2, 4]).columns, *added], names=["conv_id", "turn", "role", "mid", "parts", "says", "quotes"]
            )

    shape = ("conv_id long, turn long, role string, mid string, parts array<struct<part:int,text:string>>, says array<long>, "
             "quotes array<struct<part:int,level:int,hash:long,words:int>>")
    return rows.mapInArrow(run, shape)


def own_words(parts: Column, gone: Column | None = None) -> Column:
    """The text of the parts whose quoted run is not in ``gone`` (of own words alone without it), without runs of empty
    lines and space at its ends."""
    own = F.filter(parts, lambda p: p["part"] < 0)
    kept = own if gone is None else F.filter(parts, lambda p: ~F.array_contains(gone, p["part"]))
    joined = F.array_join(F.transform(kept, lambda p: p["text"]), "\n")
    return F.regexp_replace(F.regexp_replace(joined, "\n{3,}", "\n\n"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def linked(spoken: DataFrame) -> DataFrame:
    """(mid, part, level, hash, words, to_conv, to_turn): every quoted passage with its original, null where there is none."""
    named = spoken.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = named.select("conv_id", "turn", "mid", F.inline("quotes"))
    wanted = quotes.select("hash").distinct()
    said = named.select("conv_id", "turn", F.explode("says").alias("hash")).join(wanted, "hash", "left_semi")
    here = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("turn_here"))
    # The two smallest conversations: one of them is not that of the quotation.
    first = here.groupBy("hash").agg(F.min(F.struct("conv_id", "turn_here")).alias("one"))
    later = here.join(first, "hash").filter("conv_id > one.conv_id")
    second = later.groupBy("hash").agg(F.min(F.struct("conv_id", "turn_here")).alias("two"))
    met = quotes.join(here, ["conv_id", "hash"], "left").join(first, "hash", "left").join(second, "hash", "left")
    other = F.when(F.col("one.conv_id") == F.col("conv_id"), F.col("two")).otherwise(F.col("one"))
    met = met.withColumns({"conv_there": other["conv_id"], "turn_there": other["turn_here"]})
    inside = F.col("turn_here") < F.col("turn")
    outside = ~F.coalesce(inside, F.lit(False)) & (F.col("conv_there") != F.col("conv_id"))
    return met.select(
        "mid", "conv_id", "turn", "part", "level", "hash", "words",
        F.when(inside, F.col("conv_id")).when(outside, F.col("conv_there")).alias("to_conv"),
        F.when(inside, F.col("turn_here")).when(outside, F.col("turn_there")).alias("to_turn"),
    )


def threads(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """(conv_id, turn, thread, depth) of turns with a parent in their conversation, by pointer jumping."""
    now = stage(parents.select("conv_id", "turn", F.col("to_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(rounds):
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        new = now.join(above, ["conv_id", "up"], "left").select(
            "conv_id", "turn", F.coalesce("further", "up").alias("up"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"),
        )
        new = stage(new, "threads")
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now.withColumnRenamed("up", "thread")
    raise RuntimeError("reply chains longer than 2^rounds messages")


def conversations(messages: DataFrame, keep_unlinked: bool = False) -> DataFrame:
    """One row per message: conv_id, thread, turn, depth, role, text (own words), parent_conv, parent_turn, n_quoted,
    n_linked (passages) and formatted (the chat form of the message)."""
    spoken = stage(parsed(messages), "spoken")
    links = stage(linked(spoken), "links")
    votes = links.filter("to_turn IS NOT NULL").groupBy("mid", "conv_id", "turn", "to_conv", "to_turn", "level").agg(F.sum("words").alias("words"))
    # The shallowest level first, then the most words, then the latest original of the same conversation.
    best = F.struct(-F.col("level"), F.col("words"), (F.col("to_conv") == F.col("conv_id")).cast("int"), "to_turn", -F.col("to_conv"))
    parents = votes.groupBy("mid", "conv_id", "turn").agg(F.max_by(F.struct("to_conv", "to_turn"), best).alias("to"))
    parents = parents.select("mid", "conv_id", "turn", "to.to_conv", "to.to_turn")
    own = parents.filter("to_conv = conv_id").groupBy("conv_id", "turn").agg(F.min("to_turn").alias("to_turn"))
    # A message's quoted runs are no more than its lines.
    runs = F.collect_set(F.when(F.col("to_turn").isNotNull(), F.col("part"))).alias("gone")
    counts = links.groupBy("mid").agg(F.count(F.lit(1)).alias("q"), F.count("to_turn").alias("l"), runs)
    out = (
        spoken.join(parents.select("mid", "to_conv", "to_turn"), "mid", "left")
        .join(counts, "mid", "left")
        .join(threads(own), ["conv_id", "turn"], "left")
    )
    gone = F.coalesce("gone", F.array().cast("array<int>")) if keep_unlinked else None
    out = out.withColumn("own", own_words(F.col("parts"), gone))
    return out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "role", F.col("own").alias("text"), F.col("to_conv").alias("parent_conv"), F.col("to_turn").alias("parent_turn"),
        F.coalesce("q", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("l", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own")).alias("formatted"),
    )


def write_conversations(messages: DataFrame, path: str, **options) -> None:
    """Files in reply order; a large conversation may span files."""
    order = ["conv_id", "thread", "turn"]
    conversations(messages, **options).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
