"""Operators against plain versions, on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeimpact.llm import (
    chat, common, decontaminate, html_text, neardup, pii, quality_rules, sentencepiece_codec, sharding, substrings, warc,
)
from changeimpact.llm.queries import vocabulary
from tests.llm import brute

DOCS = "doc_id long, text string, lang string"


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(ours, theirs):
    assert sorted(map(tuple, ours), key=key) == sorted(map(tuple, theirs), key=key)


@pytest.fixture(scope="module")
def draw():
    return random.Random(11)


@pytest.fixture(scope="module")
def docs(draw):
    """(doc_id, text): copies, near copies, shared passages, one long text, blanks, nulls, repeated rows."""
    names = [f"w{i}" for i in range(400)]
    some = lambda n: [draw.choice(names) for _ in range(n)]
    passages = [some(draw.randint(40, 130)) for _ in range(8)]
    rows = []
    for i in range(120):
        ws = some(draw.randint(0, 60))
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            ws += p[draw.randint(0, 9) : len(p) - draw.randint(0, 9)] + some(draw.randint(0, 9))
        rows.append((i, " ".join(ws)))
    base = some(150)
    for i in range(200, 230):  # a group of near copies
        ws = base[:]
        for _ in range(draw.randint(0, 9)):
            ws[draw.randrange(150)] = draw.choice(names)
        rows.append((i, " ".join(ws)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "One"), (304, "one"), (305, "ÉtÉ É"), (306, "x " * 30_000)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (3, rows[5][1])]  # repeats, no ids, one id twice
    return rows


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en") for d, t in docs], DOCS).repartition(5)


def clashing(df, *names):
    return df.withColumns({n: F.lit("old") for n in names})


def test_decontamination(spark, frame, docs, draw):
    items = [(1, docs[210 - 90][1][:200]), (2, "One"), (3, None), (None, docs[0][1]), (4, ""), (5, docs[7][1].upper()), (5, docs[8][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"broadcast_bytes": 0}):
        judged = decontaminate.contamination(clashing(frame, "n_hit", "items"), table, **options)
        got = judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
        same(got, brute.contamination(docs, items))
    clean = decontaminate.remove_documents(frame, table)
    assert clean.columns == frame.columns
    dirty = {(d, t) for (d, t), row in zip(docs, brute.contamination(docs, items)) if row[-1]}
    same(clean.select("doc_id", "text").collect(), [x for x in docs if x not in dirty])
    left = decontaminate.remove_spans(judged).select("doc_id", "text")
    again = decontaminate.contamination(left, table).filter("n_hit > 0").count()
    assert again <= judged.filter("n_hit > 0").count()
    assert decontaminate.contamination(frame, table.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(frame.limit(0), table).count() == 0


def test_near_duplicates(frame, docs):
    for width in (2, 5):
        got = neardup.near_duplicates(clashing(frame, "n", "node"), shingle=width)
        same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), brute.near_duplicates(docs, width))
    stay = neardup.keep_one(frame)
    want = {d for d, _, _, kept in brute.near_duplicates(docs, 5) if kept and d is not None}
    ids = [r[0] for r in stay.select("doc_id").collect() if r[0] is not None]
    assert sorted(ids) == sorted(want) and stay.filter("doc_id IS NULL").count() == 2
    assert neardup.keep_one(frame.limit(0)).count() == 0


def test_an_id_on_several_texts_links_their_groups(spark):
    a, b, c = ("alpha one two three four", "beta five six seven eight", "gamma nine ten eleven twelve")
    rows = [(3, a), (5, b), (10, a), (10, b), (11, b), (11, c), (12, c), (4, c), (13, c), (13, " "), (20, "x y z"), (20, None), (21, None), (None, a), (None, "x y z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(table).select("doc_id", "n_shingles", "component_id", "kept").collect()
    same(got, brute.near_duplicates(rows, 5))
    assert {r["component_id"] for r in got if r["doc_id"] == 10} == {3}
    assert sorted(r["doc_id"] for r in neardup.keep_one(table).filter("doc_id IS NOT NULL").collect()) == [3, 20, 21]


def test_a_large_group_of_near_copies_gives_no_pairs(spark, draw, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        ws = base[:]
        for _ in range(2):
            ws[draw.randrange(100)] = f"x{draw.randrange(30)}"
        rows.append((i, " ".join(ws)))
    compared = []
    agreements = neardup.agreements
    monkeypatch.setattr(neardup, "agreements", lambda pairs, reps: compared.append(pairs.count()) or agreements(pairs, reps))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    same(got.select("doc_id", "n_shingles", "component_id", "kept").collect(), brute.near_duplicates(rows, 2))
    assert sum(compared) < 300 * 299 / 4


def test_repeated_passages(frame, docs):
    got = substrings.remove_repeats(clashing(frame, "n_words", "d", "t")).select("doc_id", "n_words", "n_removed", "kept")
    same(got.collect(), brute.repeats(docs))
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_quality_counts(frame, docs):
    got = quality_rules.measures(clashing(frame, "n_words", "kept")).select("doc_id", *quality_rules.BASE, "base_failed")
    same(got.collect(), brute.quality_counts(docs))


def test_certified_cutoffs_hold_their_risk(spark, draw):
    rows, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        ws = [f"w{draw.randrange(5000)}" + ("$$" if bad and draw.random() < 0.9 else "") for _ in range(60)]
        rows.append((i, " ".join(ws), "en" if i % 2 else None))
        labels.append((i, int(not bad), 0))
    labels += [(None, 1, 0), (5, None, 0), (99_999, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = quality_rules.quality(spark.createDataFrame(rows, DOCS), table).select("doc_id", "kept", "failed_rules").collect()
    good = [r for r in judged if r["doc_id"] % 4]
    assert sum(not r["kept"] for r in good) <= quality_rules.RISK * len(good)
    assert sum(not r["kept"] for r in judged if r["doc_id"] % 4 == 0) > 800
    few = quality_rules.quality(spark.createDataFrame(rows[:80], DOCS), table).collect()
    assert all(r["kept"] for r in few)  # too few labels to reject anybody


def test_binomial_tail(spark):
    from math import comb

    cases = [(n, k, p) for n, k, p in ((10, 0, 0.3), (50, 2, 0.1), (400, 1, 0.01), (3000, 10, 0.005), (3000, 14, 0.005))]
    for n, k, p in cases:
        ours = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        exact = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert abs(ours - exact) < 1e-9 * max(exact, 1e-3)


def test_sharding(frame, docs):
    for size in (1 << 24, 3000):
        got = sharding.shuffled(clashing(frame, "slot", "Size"), bucket_bytes=size).collect()
        counts = collections.Counter(r["shard"] for r in got)
        assert len(got) == len(docs) and max(counts.values()) - min(counts.values()) <= 1
        for shard, n in counts.items():
            assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
        data = [(d, t or "") for d, t in docs]
        same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in data])
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["shard"]))]
    assert order != [d for d, _ in docs]
    assert sharding.shuffled(frame.limit(0)).count() == 0


def test_sharding_order_is_that_of_the_seed_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 100)  # a block boundary inside the copies
    copies = [(None, None, "x")] * 450 + [(7, "same", "x")] * 201 + [(7, "same", "y")] * 3
    rows = [(i, f"text {i % 40}", "x") for i in range(900)] + copies
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for order, parts, width in ((rows, 3, "3"), (rows[::-1], 7, "8")):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            given = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(parts)
            out = sharding.shuffled(given, bucket_bytes=2000).collect()
            got.append(sorted((r["shard"], r["slot"], r["doc_id"] is None, r["doc_id"] or 0, r["lang"]) for r in out))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert len({g[:2] for g in got[0]}) == len(rows)
    assert sum(g[2] for g in got[0]) == 450 and sum(g[4] == "y" for g in got[0]) == 3
    # Copies are spread: no shard has more than twice its part of them.
    per_shard = collections.Counter(g[0] for g in got[0] if g[2])
    assert len(per_shard) == 24 and max(per_shard.values()) <= 2 * 450 / 24
    other = sharding.shuffled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), seed=1, bucket_bytes=2000)
    assert sorted((r["shard"], r["slot"], r["doc_id"] is None, r["doc_id"] or 0, r["lang"]) for r in other.collect()) != got[0]


def test_personal_data_base(spark, draw):
    bits = ["a@b.c", "@", ".", "+", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "1", "23", "255", "256.", "0", "999", "x_", "é",
            "\U0001f600", "+1 (743) 555-3824", "(", ")", "foo", "bar@x.y.z", "_d@e.f", "10.0.0.1", "1.2.3.4.", "5.6.7.8", "\n", "00", "%"]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randint(0, 14)))) for i in range(3000)]
    rows += [(i, "".join(draw.choice("0123456789 -.+()@aZ_") for _ in range(draw.randint(0, 40)))) for i in range(3000, 6000)]
    rows += [(None, "call +49 30 1234567 now"), (7000, None), (7001, ""), (7002, "1 " * 20_000)]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "base_spans", "kind")
    got = pii.personal_data(table).select("doc_id", pii.written(F.col("base_spans")).alias("s")).collect()
    same([(r["doc_id"], r["s"]) for r in got], [(d, brute.base_spans(t)) for d, t in rows])
    assert pii.redact(table.limit(0)).count() == 0


def test_personal_data_learned_from_context(spark, draw):
    rows = [(i, f"foo bar {draw.choice(['Please write to', 'My mail address'])} user{i}@mail{i}.org thanks a lot") for i in range(300)]
    rows += [(1000 + i, f"hm Please write to john{i}-at-mail{i}com thanks dear") for i in range(5)]
    rows += [(2000 + i, f"the part number{i} is not personal {i}-abcdef{i}") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = pii.personal_data(table).filter("size(added_spans) > 0").select("doc_id", pii.written(F.col("added_spans")).alias("s")).collect()
    assert sorted(map(tuple, found)) == [(1000 + i, "email:19:36") for i in range(5)]
    texts = {r["doc_id"]: r for r in pii.redact(table).collect()}
    assert texts[1001]["text"] == "hm Please write to <email> thanks dear" and texts[1001]["n_chars"] == len(texts[1001]["text"])
    assert texts[2001]["text"] == rows[306][1] and len(texts) == len(rows)


def test_personal_data_learned_from_one_word_and_in_groups(spark, draw):
    rows = [(i, f"aa{i} bb{i} email: user{i}@mail{i}.org cc{i} dd{i}") for i in range(40)]
    rows += [(100 + i, f"aa{i} bb{i} call +1 743 555 {3000 + i} cc{i} dd{i}") for i in range(40)]
    rows += [(200 + i, f"aa{i} +49 30 12345{100 + i} mobile cc{i}") for i in range(40)]
    odd = [
        ("zz yy email: john-at-mail7com cc", "email:13:29"), ("zz yy call 555 123 4567 cc", "phone:11:23"), ("zz yy call (555) 123-4567.", "phone:11:25"),
        ("zz (555 765 4321) mobile", "phone:4:16"), ("zz yy call DE89 3704 0044 0532 0130 00 cc", "phone:11:38"), ("zz yy count 555 123 4568 cc", ""),
        ("zz yy 1.2.3.4 12345678 mobile", "phone:14:22"),
    ]
    rows += [(1000 + i, t) for i, (t, _) in enumerate(odd)]
    rows += [(2000, "call " + "123 4567 " * 20_000), (2001, "call 1234-5678-abcdef")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(table).select("doc_id", pii.written(F.col("added_spans")).alias("s")).collect()
    got = {r["doc_id"]: r["s"] for r in found}
    assert [got[1000 + i] for i in range(len(odd))] == [s for _, s in odd]
    assert got[2000] == "" and got[2001] == "phone:5:21" and not any(got[i] for i in range(40))
    texts = {r["doc_id"]: r["text"] for r in pii.redact(table).collect()}
    assert texts[1002] == "zz yy call <phone>."


def test_personal_data_is_learned_along_a_long_chain(spark):
    rows = []
    for k, c in enumerate("abcde"):  # each cue is trusted once the value of the one before is known
        seen = [f"u{c}{i}@mail.org" for i in range(4)] + [f"value-0{k}-x" if k else "uz@mail.org", f"value-0{k + 1}-x"]
        rows += [(10 * k + i, f"foo cue{c} {v} bar{c}") for i, v in enumerate(seen)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(table).filter("size(added_spans) > 0").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(d for d, t in rows if "value-" in t)
    with pytest.raises(RuntimeError):
        pii.personal_data(table, rounds=2)


def test_sentencepiece_equals_the_library(spark, frame, docs, draw):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    odd = ["", "  ", "▁", " a", "a▁▁b", "\n\n x", "<s></s><unk>", "\x00", "İé ﬁ　x", "a" * 5000, "日本語 テスト\U0001f600 x", "a ", "<0x41>", "﻿ x"]
    odd += ["".join(draw.choice("ab ▁\n\té日<>0x_.thein") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    rows = list(enumerate(odd)) + [(90_000 + i, t) for i, (_, t) in enumerate(docs)]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "ids")
    for r in sentencepiece_codec.encode(table, vocabulary()).collect():
        ids = library.encode(r["text"] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)


def test_warc_round_trip(spark, tmp_path):
    magic = warc.MAGIC
    evil = [
        magic, magic * 3, f"x{magic}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "", None, "\r\n\r\n", "é" * 600 + magic + "😀",
        f"{magic}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n{magic}",
        f"{magic}Content-Length: 99999999\r\n\r\n", "a" * 1500 + magic,
    ]
    pages = [(i, "u", evil[i % len(evil)]) for i in range(60)] + [(None, None, "q" * 2000), (None, "v", "q" * 2000), (99, "z\r\n", "q" * 2000), (99, "z", "q" * 2000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # splits cut records and magics
    try:
        for n, rows in enumerate((pages, [])):
            path = f"{tmp_path}/w{n}"
            table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
            warc.write(table, path, **({} if n else {"broadcast_bytes": 0}))
            same(warc.read(spark, path).collect(), brute.archived(rows))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, ok?</div>
<div class="wrap"><div class="sidebar"><p>Side text, with, commas, many, here and there long.</p></div><div class="post"><h2>Title &eacute;</h2>
<p>Para one, with some words, and more of it than that.</p>loose text<p>Two <a href=x>link</a> more<br>next</p><ul><li>item a<li>item b</ul>
<form><p>Name, please, enter</p></form></div><div class="comments"><p>Nice post, really, really, long comment.</p></div></div>
<footer>c</footer></body></html>"""


def test_main_text(spark):
    want = "Title é\nPara one, with some words, and more of it than that.\nloose text\nTwo link more next\nitem a\nitem b"
    long = "<article>" + "<p>many, words, here and there.</p>" * 3000 + "</article>"
    rows = [(1, "u", PAGE), (2, None, None), (None, "", ""), (4, "x", "just text"), (5, "x", "<p>open <b>x"), (6, "x", "<div" * 3), (7, "x", long), (1, "u", PAGE)]
    table = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"), "text")
    got = {r["page_id"]: r["text"] for r in html_text.extract(table).collect()}
    assert got == {1: want, 2: "", None: "", 4: "just text", 5: "open x", 6: "", 7: "\n".join(["many, words, here and there."] * 3000)}
    assert html_text.extract(table.limit(0)).count() == 0
    # the given pages hold their article in one element
    import html
    import re

    pages = common.table(spark, "/root/testdata/sf0.001", "pages")
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>(?=<p>)", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_dropped_elements_end_like_others():
    words = "Words of the article, and more of them."
    pages = [
        f"<body><div><p class=notice>We use cookies<p>{words}</div>", f"<body><ul><li class=share>Share<li>{words}</ul>",
        f"<body><ul><li class=share>Share</ul><p>{words}", f"<table><tr><td class=sidebar>Side<td>{words}</table>",
        f"<table><tr class=ad><td>Buy<tr><td>{words}</table>", f"<table><tbody class=ad><tr><td>Buy<tbody><tr><td>{words}</table>",
        f"<table><tr><td class=ad>Buy</table><p>{words}", f"<article><div><div class=ad>Buy</div></article><p>{words}",
        f"<div><div class=ad>Buy</div></div><p>{words}", f"<div><section class=ad>Buy</div><p>{words}", f"<article><aside>Side</article><p>{words}",
        f"<head><title>T</title><body><p>{words}", f"<head><meta charset=x><p>{words}", f"<head>\n{words}", f"<p>{words}<svg class=x /></p>",
        f"<dl><dt class=ad>Buy<dd>{words}</dl>", f"<h3 class=related>Related</h2><p>{words}", f"<span><nav>Menu</span>Menu</nav><p>{words}",
        f"<ul><li>{words}<aside><li>Side</li></aside></ul>", f"<nav><ul><li>a<li>b</ul><p>c<p>d</nav><p>{words}",
    ]
    assert [html_text.main_text(p) for p in pages] == [words] * len(pages)


def test_pages_without_an_article_element_keep_all_their_text():
    long = ", ".join(["words of a long paragraph"] * 40)
    links = "".join(f"<li><a href=x>page {i}</a>" for i in range(9))
    pages = {
        "<h1>Title</h1><div><p>Some words, long enough to be read.</p></div>": "Title\nSome words, long enough to be read.",
        f"<div><p>{long}</div><div><h2>Second</h2><p>Some words, long enough, to be read.</div><p>The end.": f"{long}\nSecond\nSome words, long enough, to be read.\nThe end.",
        f"<div><p>{long}</div><ul><li>one<li>two</ul><blockquote>Said.</blockquote>": f"{long}\none\ntwo\nSaid.",
        f"<div><ul>{links}</ul></div><h1><a href=x>Title</a></h1><div><p>{long}</div><div>More: <a href=x>another page of it</a></div>": f"Title\n{long}",
        f"<div><a href=x>a link</a> <a href=x>and one</a><p>Short.</div><div><p>{long}</div>": f"Short.\n{long}",
        f"<div>About<ul>{links}</ul></div><div><p>{long}</div>": f"About\n{long}",
    }
    assert [html_text.main_text(f"<body>{p}</body>") for p in pages] == list(pages.values())


def test_linked_lists_of_an_article_are_kept():
    links = "".join(f"<li><a href=x>page {i}</a>" for i in range(4))
    table = "<table>" + "".join(f"<tr><td><a href=x>name {i}</a>" for i in range(4)) + "</table>"
    text, names = "Some words, long enough to be read.", "\n".join(f"name {i}" for i in range(4))
    listed = "\n".join(f"page {i}" for i in range(4))
    pages = {
        f"<article><p>{text}<ol>{links}</ol></article>": f"{text}\n{listed}", f"<main><p>{text}<section>{table}</section></main>": f"{text}\n{names}",
        f"<div><p>{text}<ul>{links}</ul></div>": f"{text}\n{listed}",
        f"<article><p>{text}<ul class=menu>{links}</ul><div role=navigation>{table}</div></article>": text,
    }
    assert [html_text.main_text(p) for p in pages] == list(pages.values())


def test_conversations(spark):
    rows = [
        (1, 0, "user", "Hello there my good friend.\n\nHow is the weather in town today?"),
        (1, 1, "assistant", "> How is the weather in town today?\nIt is very sunny right now"),
        (1, 2, "user", "On Monday, A wrote:\n> > How is the weather in town today?\n> It is very sunny right now\n\nThanks so much"),
        (1, 3, "user", "> Hello there my good friend.\nhi"), (1, 4, "x", "> nobody ever said this here\nyes"),
        (2, 0, "user", "> It is very sunny right now\nquoting elsewhere"), (2, 0, "user", "> It is very sunny right now\nquoting elsewhere"),
        (None, 3, None, "> Thanks so much"), (2, None, "user", None), (2, 5, "user", ""),
    ]
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "thread")
    got = chat.conversations(table).select("conv_id", "turn", "thread", "depth", "text", "parent_conv", "parent_turn").collect()
    same(got, [
        (1, 0, 0, 0, rows[0][3], None, None), (1, 1, 0, 1, "It is very sunny right now", 1, 0), (1, 2, 0, 2, "Thanks so much", 1, 1),
        (1, 3, 0, 1, "hi", 1, 0), (1, 4, 4, 0, "yes", None, None), (2, 0, 0, 0, "quoting elsewhere", 1, 1),
        (None, 3, 3, 0, "", None, None), (2, None, None, 0, "", None, None), (2, 5, 5, 0, "", None, None),
    ])
    chain = [(7, 0, "a", "first message of all")] + [(7, i, "a", f"> {'first message of all' if i == 1 else f'reply number {i - 1} to it'}\nreply number {i} to it") for i in range(1, 40)]
    deep = chat.conversations(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string"))
    assert {(r["turn"], r["depth"], r["thread"]) for r in deep.collect()} == {(i, i, 0) for i in range(40)}
    assert chat.conversations(table.limit(0)).count() == 0


def test_quotations_of_parts_and_from_the_second_conversation(spark):
    rows = [
        (1, 0, "u", "> The same words are said here\nhm"), (1, 1, "u", "The same words are said here"), (2, 5, "u", "The same words are said here"),
        (3, 0, "u", "Hello to you. How is the weather in town? I would like to know."), (3, 1, "u", "> How is the weather in town?\nfine"),
        (4, 0, "u", "This is a longer line here\nyes\nI do so\nThat is another longer line"), (4, 1, "u", "> yes\n> I do so\nwell"),
    ]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in got.collect() if r["parent_conv"] is not None}
    assert got == {(1, 0): (2, 5), (3, 1): (3, 0), (4, 1): (4, 0)}


def test_quotations_that_nobody_said_are_kept(spark):
    said = "The train leaves at nine from the old station"
    rows = [
        (1, 0, "u", said),
        (1, 1, "u", f"Try this:\n\n>>> print(1)\n1\n\n\n> {said}\nthanks  \n"),
        (1, 2, "u", f"On Monday, A wrote:\n> a line that nobody ever said\nfine\n\nOn Tuesday, B wrote:\n> {said}\n>> deeper words nobody said\nok"),
        (None, 3, "u", f"> {said}\nhm"), (1, 4, "u", ">\n> \nonly empty quoted lines"),
        (5, 0, "u", "x y\n" * 3000 + f"> {said}\n" + "> never said before this\n"), (5, 0, "u", "a second text of that turn"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"], len(r["text"]) > 9000): r["text"] for r in chat.conversations(table, keep_unlinked=True).collect()}
    assert got[1, 1, False] == "Try this:\n\n>>> print(1)\n1\nthanks"
    assert got[1, 2, False] == "On Monday, A wrote:\n> a line that nobody ever said\nfine\n\n>> deeper words nobody said\nok"
    assert got[None, 3, False] == f"> {said}\nhm" and got[1, 4, False] == "only empty quoted lines"
    assert got[5, 0, True] == ("x y\n" * 3000).strip() and got[5, 0, False] == "a second text of that turn"
    dropped = {(r["conv_id"], r["turn"]): r["text"] for r in chat.conversations(table).collect()}
    assert dropped[1, 1] == "Try this:\n1\nthanks" and dropped[None, 3] == "hm"


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, sf, "documents").collect()}
    items = [tuple(r) for r in common.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    left = [(d, t) for d, t in docs.items() if not next(iter(brute.quality_counts([(d, t)])))[-1]]
    left = [x for x, r in zip(left, brute.near_duplicates(left, 5)) if r[-1]]
    left = [x for x, r in zip(left, brute.contamination(left, items)) if not r[-1]]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {d for d, _ in left}  # too few labels for any further cutoff
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    for doc, text in left:
        if not brute.base_spans(text):
            assert got[doc]["ids"] == library.encode(text)


def test_steps_are_certified_by_the_number_of_strata(spark):
    """217 good labels without a rejection are enough with four strata: 0.98^217 <= 0.05 / 4; 216 are not."""
    rows = [(i, " ".join(f"w{j}" for j in range(60)), lang) for lang, start, n in (("a", 0, 217), ("b", 300, 216), ("c", 600, 5), (None, 700, 5))
            for i in range(start, start + n)]
    frame = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    certified = quality_rules.calibrate(quality_rules.measures(frame), labels).collect()
    assert [(r["stratum"], r["step"], r["n_good"], r["n_rejected"]) for r in certified] == [("a", quality_rules.STEPS - 1, 217, 0)]


def test_sentencepiece_table_is_small_and_in_step(monkeypatch):
    """What a worker keeps between batches: 511 bytes a unit as strings and lists before."""
    import tracemalloc

    own = sentencepiece_codec.Merger(vocabulary())
    library = own.library
    texts = [" ".join(f"w{i * 97 + j}ord{j * 7919 % 1000}" for j in range(97)) + " " + "y" * 50 for i in range(100)]
    tracemalloc.start()
    own.encode(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / len(own.table) < 300
    again = ["new " + texts[3], "", "y" * 50 + " " + texts[0], "ö " + "z" * 60]
    assert own.encode(again) == [library.encode(t) for t in again]
    monkeypatch.setattr(own, "learn", lambda units: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        own.encode(["unseen words"])
    monkeypatch.undo()
    assert own.encode(again) == [library.encode(t) for t in again]


def test_sentencepiece_workers_keep_little_after_a_task(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "KEPT_ROWS", 5)
    monkeypatch.setattr(sentencepiece_codec, "LEARNED", 3)
    own = sentencepiece_codec.Merger(vocabulary())
    texts = ["the first units met " + "x" * 50, "some more words follow here", "", "the words met"]
    before = own.encode(texts)
    assert before == own.library.encode(texts)
    own.rest()
    assert len(own.known) == len(own.table) == 5
    assert all(own.known[n] for n in own.table.values())
    assert own.encode(texts[::-1]) == before[::-1]
    own.rest()
    assert list(own.table) == ["▁the", "▁first", "▁units", "▁met", "▁some"]


def test_sentencepiece_tasks_end_with_a_release(spark, tmp_path):
    def done():
        (tmp_path / str(random.SystemRandom().random())).touch()

    def fill(texts):
        return [pa.array([len(t) for t in texts], pa.int64())]

    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string").coalesce(1)
    sized = sentencepiece_codec.per_batch(docs, {"size": T.LongType()}, fill, done)
    assert sorted(map(tuple, sized.collect())) == [(1, "ab", 2), (2, None, 0)]
    assert len(list(tmp_path.iterdir())) == 1
    assert sentencepiece_codec.per_batch(docs.filter("doc_id > 2"), {"size": T.LongType()}, fill, done).count() == 0
    assert len(list(tmp_path.iterdir())) == 1
