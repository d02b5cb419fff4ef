from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from relaykit.llm import alignment
from relaykit.llm.queries import op13_token_alignment

A = alignment.Side("byte_level", public_tokenizers.path("byte_bpe_50k.json"), before=" ")
B = alignment.Side("pieces", public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n\x0b", "<|endoftext|> <s>[INST]</s> <unk> <0x41>", "naïve 你好 \U0001f600‍♂ é", "▁ is a mark", " no break", "\x00\x01",
    "long " * 30_000, "tail \n", "tail \n ", "a\n b\u3000 c \u2028 d\u180e e \x1c f", "it's we'LL 12 34 ... !? \t x", "x" * 3000, "你" * 700, "a b", "﻿bom",
]


def brute(texts):
    """Each document by plain loops over byte offsets."""
    one = Tokenizer.from_file(A.path)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B.path)
    names, shown = {i: n for n, i in one.get_vocab().items()}, [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    docs = []
    for text in texts:
        if not text:
            docs.append(([], [], []))
            continue
        a = [(i, bytes(byte_of[c] for c in names[i])) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if len(p := two.id_to_piece(i)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i in two.encode(text)]
        if {b"".join(t for _, t in a), b"".join(t for _, t in b)} != {(" " + text).encode()}:
            docs.append(([], [], []))
            continue
        ends = [np.cumsum([len(t) for _, t in x]).tolist() for x in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for cut in cuts:
            groups.append([[i for (i, _), e in zip(x, ends[k]) if before < e <= cut] for k, x in enumerate((a, b))] if len(cuts) < 3000 else None)
            before = cut
        last = [dict(zip(ends[k], [i for i, _ in x])) for k, x in enumerate((a, b))]
        links = [(last[0][c], last[1][c]) for c in cuts]
        docs.append(([i for i, _ in a], [i for i, _ in b], [groups, links]))
    counts = Counter(p for _, _, d in docs if d for p in d[1])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, d in docs:
        groups, links = d or ([], [])
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) if None not in groups else None
        digest = "" if not a else hashlib.sha256(text.encode()).hexdigest() if text is not None else None
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


def figures(r):
    return r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]


def check(found, rows):
    want = brute([t for _, t in rows])
    got = sorted(((r["doc_id"] is None, r["doc_id"], figures(r)) for r in found), key=repr)
    want = sorted(((i is None, i, w) for (i, _), w in zip(rows, want)), key=repr)
    assert len(got) == len(want)
    assert all(g[:2] == w[:2] and g[2][:6] == w[2][:6] and w[2][6] in (None, g[2][6]) for g, w in zip(got, want))
    assert all(r["n_overlaps"] == max(0, r["n_a"] + r["n_b"] - r["n_groups"]) for r in found)


@pytest.mark.parametrize("head", [1 << 16, 4])
def test_query_equals_plain_loops(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    path = "/root/testdata/sf0.001"
    found = op13_token_alignment(spark, path)
    assert found.columns[:2] == ["doc_id", "n_a"]
    check(found.collect(), duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall())


def test_odd_texts_and_columns(spark):
    rows = [*enumerate(ODD), (1, "again"), (1, "again"), (None, "no id"), (None, None)]
    frame = spark.createDataFrame([(*r, "c", 7) for r in rows], "doc_id long, text string, pairs string, key int")
    check(alignment.align_and_score(frame, A, B).collect(), rows)
    empty = alignment.align_and_score(frame.limit(0), A, B)
    assert empty.count() == 0 and set(empty.columns) == {"doc_id", "text", "key", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_overlaps", "n_best", "count_sum"}


def test_all_outputs(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in alignment.align(frame, A, B).collect():
        ends = [np.cumsum([len(alignment._load(A, B).bytes_of[k][i]) for i in r[c]]).astype(int).tolist() for k, c in enumerate(("a_ids", "b_ids"))]
        assert [ends[0][i] for i in r["a_last"]] == [ends[1][i] for i in r["b_last"]] == sorted(set(ends[0]) & set(ends[1]))
        assert sum(r["times"]) == r["n_groups"] == len(r["a_last"]) and len(r["pairs"]) == len(set(r["pairs"]))
        groups = [tuple([int(i) for i in x.split(",")] for x in g.split("|")) for g in r["groups"].split(";") if g]
        assert [i for g in groups for i in g[0]] == r["a_ids"] and [i for g in groups for i in g[1]] == r["b_ids"]
        assert np.cumsum([len(g[0]) for g in groups]).astype(int).tolist() == [i + 1 for i in r["a_last"]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 60), max_size=80), st.lists(st.integers(1, 60), max_size=80)), max_size=6))
def test_common_ends_of_any_lists(docs):
    a, b, sizes, offset = [], [], ([], []), 0
    for x, y in docs:
        total = max(x + y, default=0) + 1 if x or y else 0
        x, y = (sorted({*v, total}) if total else [] for v in (x, y))
        a += [offset + v for v in x]
        b += [offset + v for v in y]
        sizes[0].append(len(x))
        sizes[1].append(len(y))
        offset += total
    ia, ib = alignment.common_ends(np.array(a, np.int64), np.array(b, np.int64), np.array(sizes[0], np.int64), np.array(sizes[1], np.int64))
    assert [a[i] for i in ia] == [b[i] for i in ib] == sorted(set(a) & set(b))
