"""Tokenizer alignment against a version that compares all token spans."""

import collections
import hashlib

import numpy as np
import pytest

from changeimpact.llm import alignment
from changeimpact.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary()


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    odd = [
        (1, None), (None, ""), (None, "a"), (7, "▁mark <|endoftext|> <s> </s> <0x41> 😀 ﬁ"), (8, " "), (9, "\x00"), (9, "same"), (9, "same"),
        (10, "日本語テキスト é é"), (11, "<|endoftext|> <s> </s> <0x41>"), (12, "two  spaces\n\ttab 😀"), (13, "ab " * 4000),
    ]
    return [(r["doc_id"], (r["text"] or "")[:500]) for r in docs] + odd


def plain(texts):
    """Of every text its links and its groups, then n_best and count_sum over all."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    byte = alignment.byte_of_character()
    read = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        spans = []
        for ids, raw in ((a, lambda i: bytes(byte[c] for c in a_side.id_to_token(i))),
                         (b, lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode())):
            own, at = [], 0
            for i in ids:
                own.append((i, at, at + len(raw(i))))
                at += len(raw(i))
            spans.append(own if b"".join(map(raw, ids)) == whole else None)
        read.append(spans if None not in spans else [[], []])
    links, cuts = [], []
    for a, b in read:
        first, own = 0, []
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                own.append((i, b[k][0]))
                k += 1
        links.append(own)
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        inside = lambda side, low, high: ",".join(str(i) for i, _, e in side if low < e <= high)
        if len(a) > 2000:  # quadratic otherwise
            both = both[:0]
        cuts.append(";".join(inside(a, low, high) + "|" + inside(b, low, high) for low, high in zip([0, *both], both)))
    count = collections.Counter(x for own in links for x in own)
    best = collections.Counter()
    for (_, b), c in count.items():
        best[b] = max(best[b], c)
    return [
        (len(a), len(b), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), groups)
        for (a, b), own, groups in zip(read, links, cuts)
    ], count


def test_alignment_equals_comparing_all_spans(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, N_A string").repartition(5)
    aligned, pairs = alignment.align(frame, A, B)
    expected, count = plain([r[1] for r in rows])
    got = collections.defaultdict(list)
    for r in aligned.collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (doc_id, _), (n_a, n_b, n_links, n_best, count_sum, groups) in zip(rows, expected):
        own = next(r for r in got[doc_id] if (r["n_a"], r["n_b"], r["n_links"], r["n_best"], r["count_sum"]) == (n_a, n_b, n_links, n_best, count_sum))
        assert own["n_groups"] == (len(own["groups"].split(";")) if own["groups"] else 0)
        assert own["groups"] == groups or not groups and n_a > 2000
        got[doc_id].remove(own)
    assert {(r["a_id"], r["b_id"]): r["count"] for r in pairs.collect()} == count
    digests = alignment.align(frame.filter("doc_id IN (1, 11)"), A, B, digest=True)[0].collect()
    known = {r[0]: x[5] for r, x in zip(rows, expected)}
    assert {r["doc_id"]: r["groups"] for r in digests} == {1: "", 11: hashlib.sha256(known[11].encode()).hexdigest()}


def test_counts_do_not_depend_on_batches(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sums = lambda df: sorted((r["doc_id"] or -1, r["n_best"], r["count_sum"]) for r in df.collect())
    assert sums(alignment.align(frame.repartition(1), A, B, digest=True)[0]) == sums(alignment.align(frame.repartition(40), A, B, digest=True)[0])


def test_no_documents(spark):
    aligned, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert aligned.collect() == [] and pairs.collect() == []


def test_terminals_of_long_chains():
    a = np.array([2, 4, 6, 8, 9, 12])
    b = np.array([1, 3, 5, 7, 9, 10, 12])
    groups_a, groups_b = alignment.terminals(a, b)
    assert groups_a.tolist() == [0, 0, 0, 0, 0, 1] and groups_b.tolist() == [0, 0, 0, 0, 0, 1, 1]


def test_units_give_what_whole_texts_give():
    """Words are read once for many texts; runs of white space, space marks and texts a side does not give back too."""
    own = alignment.sides(A, B)
    assert own.separable
    texts = [
        "", " ", "  ", "a ", " a", "a  b", "a \n b\u2003 c\x1c d", "it's  'so' we're 12 34.5 %%% x", "▁ a▁ b a▁b", "tail \n", "a b \u180e c",
        "\u0301 é e\u0301 \u0308x", "日本 語 テ\u3000キ", "<s> </s> <unk> <0x41> <|endoftext|> x", "ﬁ ½ \x00 \x85 x", "same word same word", "x" * 90 + " y", "\n",
    ]
    assert own.units("a  b c \n d ") == ["a", " b", "c", "\n d "] and own.units("a b") == ["a", "b"]
    assert all(" " + " ".join(own.units(t)) == " " + t for t in texts if t)
    got, whole = alignment.Batch(own, texts), [own.read([t])[0] for t in texts]
    assert got.n_a.tolist() == [len(a) if same else 0 for a, _, same in whole]
    assert got.n_b.tolist() == [len(b) if same else 0 for _, b, same in whole]
    for groups, (a, b, same) in zip(got.groups, whole):
        sides = [g.split("|") for g in groups.split(";")] if groups else []
        for side, ids in ((0, a), (1, b)):
            assert ",".join(s[side] for s in sides) == ",".join(map(str, ids if same else []))
    assert (got.total > 0).all() and got.total.sum() == got.n_links.sum()


def test_distinct_words_are_read_once(monkeypatch):
    own, seen = alignment.sides(A, B), []
    read = type(own).read
    monkeypatch.setattr(type(own), "read", lambda self, texts: seen.extend(texts) or read(self, texts))
    batch = alignment.Batch(own, ["some words come again"] * 300)
    assert sum(map(len, seen)) < 100 and batch.n_a.tolist() == [batch.n_a[0]] * 300
    assert batch.times.tolist() == [1] * len(batch.times) and set(batch.total.tolist()) == {300}


def test_cut_only_where_both_tokenizers_cut():
    import json

    known = json.loads(open(A, encoding="utf-8").read())
    assert alignment.cuts_at_spaces(known, ["▁a", "b", "▁▁"]) and not alignment.cuts_at_spaces(known, ["▁a▁b"])
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}}):
        assert not alignment.cuts_at_spaces({**known, **change}, ["▁a"])
