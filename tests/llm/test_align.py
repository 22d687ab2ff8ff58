import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import align
from graphloom.llm.queries import llm_queries

A, B = (f"{align.FOLDER}/{n}" for n in (align.BYTE_BPE, align.PIECES))


@pytest.fixture(scope="module")
def pair():
    return align.Pair(open(A, "rb").read(), open(B, "rb").read())


def spans(ids, table):
    out, at = [], 0
    for k in ids:
        out.append((at, at + len(table[k])))
        at += len(table[k])
    return out


def brute(texts, pair):
    """Whole texts at once, every A token against every B token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    docs, counts = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        if not t or b"".join(pair.bytes_a[k] for k in x) != raw or b"".join(pair.bytes_b[k] for k in y) != raw:
            docs.append(None)
            continue
        sx, sy = spans(x, pair.bytes_a), spans(y, pair.bytes_b)
        links = [(x[i], y[j]) for i, p in enumerate(sx) for j, q in enumerate(sy) if p[0] < q[1] and q[0] < p[1]]
        ends = sorted({p[1] for p in sx} & {q[1] for q in sy})
        groups = ";".join(",".join(str(k) for k, p in zip(x, sx, strict=True) if lo <= p[0] < hi) + "|" + ",".join(str(k) for k, q in zip(y, sy, strict=True) if lo <= q[0] < hi) for lo, hi in zip([0, *ends], ends, strict=False))
        counts.update(links)
        docs.append((len(x), len(y), len(ends), links, groups))
    best = Counter()
    for (_, k), n in counts.items():
        best[k] = max(best[k], n)
    empty = (0, 0, 0, 0, 0, 0, "")
    return [empty if d is None else (*d[:3], len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]), hashlib.sha256(d[4].encode()).hexdigest()) for d in docs]


ODD = [None, "", " ", "  ", "a", " lead", "trail ", "two  spaces", "tab\tand\nlines\r\n\n x", "naïve café – “quoted” … 東京タワー и ещё", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "a▁ b", "nul\x00byte \x85 next", "a\xa0b \xa0 c", "it's we'll 'tis ' s", "1234567 89,000.50", "é ́x a ​ b ﻿ c", "🙂🙂 👩‍👩‍👧 ok", "x" * 3000, "same text here", "same text here", "a᠎ b ᠎c", "ﬁ ½ ① ﷺ", "퟿  \U0010ffff"]


def test_against_whole_texts(spark, pair):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect() if len(r.text or "") < 8000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, n_a int").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in align.align_tokenizers(docs, stripes=50).collect()}
    want = brute(texts, pair)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] > 0 for w in want) >= 35


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ab'.▁\t\n\xa0é"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_cuts_change_no_token(pair, text):
    if text:
        whole_a = pair.a.encode(" " + text, add_special_tokens=False).ids
        whole_b = pair.b.encode(text)
        cut = align._CUT.split(" " + text)
        if "▁" not in text:
            assert whole_a == [k for e in pair.a.encode_batch(cut, add_special_tokens=False) for k in e.ids]
            assert whole_b == [k for s in cut for k in pair.b.encode(s[1:])]


def test_salts_chunks_and_stripes_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted(map(tuple, align.align_tokenizers(docs).collect()), key=str)
    monkeypatch.setattr(align, "CELLS", 500)
    two = sorted(map(tuple, align.align_tokenizers(docs.repartition(7), stripes=13).collect()), key=str)
    assert one == two and len(one) == docs.count()


def test_null_ids_and_no_rows(spark):
    kind = "doc_id long, text string"
    assert align.align_tokenizers(spark.createDataFrame([], kind)).collect() == []
    rows = align.align_tokenizers(spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None)], kind)).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in rows) == [(0, 2), (0, 2), (1, 0)]


def test_query_holds_every_document(spark):
    sf = "/root/testdata/sf0.01"
    rows = llm_queries()["op13_align_tokenizers"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.n_links >= max(r.n_a, r.n_b) >= r.n_groups and r.n_best <= r.n_links for r in rows)


def test_segments_are_encoded_in_parts_of_bounded_length():
    class Told:
        sizes: list = []

        def segments(self, part):
            self.sizes.append((len(part), sum(map(len, part))))
            none = np.zeros(len(part), dtype=np.int64)
            return align.Aligned(none == 0, none, none, none, none, none[:0], none[:0], [b""] * len(part))

    pair = Told()
    known = align._Known(pair)
    known.meet([f" {k:06d}" + "x" * 5000 for k in range(400)] + [" " + "y" * 1_000_000] + [f" {k}" for k in range(20_000)])
    assert len(known.number_of) == sum(n for n, _ in pair.sizes) == 20_401
    assert max(n for n, _ in pair.sizes) <= 8192
    assert max(size for _, size in pair.sizes if size < 1_000_000) <= 1 << 18
