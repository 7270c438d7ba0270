"""Token alignment against a plain computation by byte offsets, on small and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabkit.llm import token_alignment as ta

SCHEMA = "doc_id long, text string, batch long, stripe int, links long, salt int, docs string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def odd_texts(seed=1):
    r = random.Random(seed)
    letters = "abcdefgh éüßñ \n\t .,'<>|_-0123456789 中文字 \U0001f600\U0001f468‍ ½ﬁ"
    texts = [None, "", " ", "  ", "a▁b", "<|endoftext|> and <s> </s> <unk> <0x41>", "don't we'll I'm", " " * 700 + "x" + " " * 301, "\n" * 500, "　" * 300, "中" * 400, "\x00\x01\x1f", "one  two   three ", "é" * 900, "﻿x", "a" * 3000, "é ﬁ Å", "\r\n\r\n", "x  y"]
    for _ in range(120):
        texts.append("".join(r.choice(letters) for _ in range(r.randint(1, 120))))
        texts.append(" ".join(r.choice(["the", "of", "and", "Straße", "naïve", "tokenization", "x1y2", "don't"]) for _ in range(r.randint(1, 60))))
    return [*texts, *texts[20:30]]


def spelled(tokenizers, text):
    a, b = tokenizers
    letters = ta.byte_letters()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    one = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
    two = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", b.id_to_piece(i))) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    return x, y, one, two


def brute(tokenizers, texts):
    all_, pairs = [], Counter()
    for text in texts:
        groups = []
        if text:
            x, y, one, two = spelled(tokenizers, text)
            if b"".join(one) == b"".join(two) == (" " + text).encode():
                i = j = p = q = 0
                own = ([], [])
                while i < len(x) or j < len(y):
                    if p <= q and i < len(x):
                        p += len(one[i])
                        own[0].append(x[i])
                        i += 1
                    else:
                        q += len(two[j])
                        own[1].append(y[j])
                        j += 1
                    if p == q:
                        groups.append(own)
                        own = ([], [])
        all_.append(groups)
        pairs.update({(u, v) for g in groups for u in g[0] for v in g[1]})
    top = {}
    for (u, _), n in pairs.items():
        top[u] = max(top.get(u, 0), n)
    out = []
    for groups in all_:
        links = [(u, v) for g in groups for u in g[0] for v in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(pairs[x] == top[x[0]] for x in links), sum(pairs[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, pairs, top


@pytest.mark.parametrize(("part", "wide", "stripes"), [(4_000_000, 4096, 256), (1, 2, 7)])
def test_alignment(spark, tokenizers, monkeypatch, part, wide, stripes):
    monkeypatch.setattr(ta, "WIDE", wide)
    texts = odd_texts()
    rows = [(i, t, 1, 2, 3, 4, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, pairs, top = brute(tokenizers, texts)
    got = {r.doc_id: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in ta.token_alignment(df, stripes=stripes, part=part).collect()}
    assert got == dict(enumerate(want))
    assert sum(x[0] > 0 for x in want) > 200 and any(t and not x[0] for t, x in zip(texts, want, strict=True))
    if part == 1:
        best = {(r.a_id, r.b_id): r.n for r in ta.best_partners(df, stripes=stripes, part=part).collect()}
        assert best == {x: n for x, n in pairs.items() if n == top[x[0]]}


def test_long_texts_in_parts(tokenizers, monkeypatch):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        aligner = ta.Aligner(ta.ByteLevel(f.read()), ta.Pieces(g.read()), 256)
    assert aligner.a.fast is not None and aligner.b.cuts
    r = random.Random(4)
    texts = [t for t in odd_texts(3) if t] + [" ".join(r.choice(odd_texts(5)[30:]) for _ in range(40)) for _ in range(20)]
    whole = [aligner.tokens(t) for t in texts]
    monkeypatch.setattr(ta, "LONG", 16)
    assert max(len(ta.parts_of(" " + t, 16)) for t in texts) > 20
    assert [aligner.tokens(t) for t in texts] == whole
    for text in (" " * 1_500_000 + "x", "word " * 300_000, "中" * 300_000):
        counts, digest, links = aligner.align([text.encode()])
        assert counts[0, 0] > 0 and counts[3, 0] == links[2].sum() and digest[0]


def test_odd_tables(spark):
    assert ta.token_alignment(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, 1, 1, 1, 1, ""), (None, "", 1, 1, 1, 1, ""), (5, "x▁", 1, 1, 1, 1, "")]
    assert {tuple(r) for r in ta.token_alignment(spark.createDataFrame(rows, SCHEMA)).collect()} == {(None, 0, 0, 0, 0, 0, 0, ""), (5, 0, 0, 0, 0, 0, 0, "")}


def test_packing_of_numbers():
    for top in (0, 200, 60_000, 1 << 20, 1 << 40):
        x = np.array([0, top // 2, top])
        assert (ta.unpacked(ta.packed(x)) == x).all()
