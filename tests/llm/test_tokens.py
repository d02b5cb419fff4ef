from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from relaykit.llm import bpe, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = bpe.Vocabulary(bpe.read_ranks(PATH), PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
PIECES = st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\t", "é", "12", "'s", "!", "…", "\x1c", "\xa0", "日", "²", " word", "x" * 40])


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12).map("".join))
def test_equals_the_library(text):
    packed = VOCABULARY.encode(text)
    assert ids(packed) == LIBRARY.encode_ordinary(text)
    assert VOCABULARY.decode(packed).decode() == text


@pytest.mark.parametrize("text", ["a \xa0 \xa0 b", "a" + "\xa0 " * 4, "\xa0 \xa0 \xa0 \xa0", " \xa0 \xa0 ", "a \u3000 \n \xa0b", "x \n y \xa0 z   ", "\xa0 " * 9 + "b  c \xa0"])
def test_alternating_white_space_is_one_match(text):
    assert ids(VOCABULARY.encode(text)) == LIBRARY.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab1! \xa0\n\t\r\u3000\x1c'", max_size=14))
def test_dense_white_space_equals_the_library(text):
    assert ids(VOCABULARY.encode(text)) == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40).map(lambda b: bytes(97 + x % 8 for x in b)), st.integers(0, 40), st.integers(0, 6), st.binary(max_size=5).map(lambda b: bytes(97 + x % 8 for x in b)))
def test_appends_and_edits_are_exact(data, at, length, new):
    table = bpe.PrefixEncoding(VOCABULARY, data)
    table.append(new)
    at = min(at, len(table.data))
    table.replace(at, min(len(table.data), at + length), new)
    assert table.last == bpe.PrefixEncoding(VOCABULARY, table.data).last


def test_an_edit_near_the_start_computes_few_entries():
    table = bpe.PrefixEncoding(VOCABULARY, b"thing and other words " * 100)
    assert table.replace(5, 6, b"x") < 400


def test_a_vocabulary_without_a_byte_raises():
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0}, r"\w+").encode("ab")


def test_documents(spark):
    rows = [(1, None, "old"), (2, "", None), (3, "word " * 30_000, "x"), (4, "twice", "x"), (4, "twice", "x"), (None, "id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, PATH, PATTERN).collect()
    assert [r["n_tokens"] for r in got] == [len(LIBRARY.encode_ordinary(t or "")) for _, t, _ in rows]
    assert all(r["decoded"].decode() == (r["text"] or "") for r in got)
    assert bpe.encode_documents(df.limit(0), PATH, PATTERN).count() == 0
    back = bpe.decode_ids(bpe.encode_documents(df, PATH, PATTERN).drop("decoded"), PATH).collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [t or "" for _, t, _ in rows]


def test_workers_keep_no_vocabulary(spark):
    """Idle workers outnumber the cores; each held what its last task had learnt."""
    df = spark.range(64).selectExpr("id AS doc_id", "repeat('some words ', 20) AS text").repartition(8)
    coded = bpe.encode_documents(df, PATH, PATTERN)
    assert bpe.decode_ids(coded.drop("decoded"), PATH).filter("decoded = text").count() == 64

    def alive(batches):
        import gc

        import pyarrow as pa

        n = sum(type(x).__name__ == "Vocabulary" for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    assert df.select("doc_id").mapInArrow(alive, "n bigint").filter("n > 0").count() == 0


def test_query_against_the_library(spark):
    from relaykit.llm.queries import op2_bpe

    got = {r["doc_id"]: r for r in op2_bpe(spark, "/root/testdata/sf0.001").collect()}
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        text = row["text"] or ""
        want = np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()
        assert got[row["doc_id"]]["ids_sha256"] == hashlib.sha256(want).hexdigest()
        assert got[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def plain_count(word: bytes, prices: dict[bytes, int]) -> int:
    best = [0]
    for end in range(1, len(word) + 1):
        best.append(min(best[s] + prices[word[s:end]] for s in range(end) if word[s:end] in prices))
    return best[-1] & token_counts.COUNT_MASK


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="\x00ab\xe9", min_size=1, max_size=40), max_size=12))
def test_nodes_of_one_depth_together(words):
    chances = {b"\x00": 0.1, b"a": 0.2, b"b": 0.1, b"ab": 0.2, b"ba": 0.1, b"bab": 0.1, b"a\x00": 0.05, "\xe9".encode(): 0.05, b"\xc3": 0.05, b"ab" * 17: 0.05}
    prices = token_counts.prices_of({t: float(np.log(p)) for t, p in chances.items()})
    got = token_counts.count_all(words, prices, 34, token_counts.Suffixes(prices))
    assert got == {w: plain_count(w.encode(), prices) for w in words}


def test_a_missing_byte_raises_at_once():
    prices = token_counts.prices_of({b"a": -1.0, b"ab": -1.0})
    with pytest.raises(ValueError):
        token_counts.count_all({"ab", "abb"}, prices, 2, token_counts.Suffixes(prices))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab1! \xa0\n\t\r\u3000\x1c'\xe9", max_size=14))
def test_chunks_hold_the_matches_of_the_text(text):
    for pattern in (PATTERN, r"\w+ ?\w*"):
        cut_up, pretokens = token_counts._cutter(pattern)
        find = bpe.Vocabulary({}, pattern).pattern.findall
        assert [p for chunk in cut_up(text) for p in pretokens(chunk)] == find(text)


def plain_round(words: dict[bytes, int], logs: dict[bytes, float], prior: dict[bytes, float], weight: float) -> dict[bytes, float]:
    """One round of expectation-maximisation, each word alone, forward and backward."""
    add, expected = np.logaddexp, {}
    for word, n in words.items():
        edges = [(s, e) for e in range(1, len(word) + 1) for s in range(max(0, e - 128), e) if word[s:e] in logs]
        ahead, back = [0.0] + [-np.inf] * len(word), [-np.inf] * len(word) + [0.0]
        for s, e in edges:
            ahead[e] = add(ahead[e], ahead[s] + logs[word[s:e]])
        for s, e in sorted(edges, key=lambda x: -x[0]):
            back[s] = add(back[s], logs[word[s:e]] + back[e])
        for s, e in edges:
            token = word[s:e]
            expected[token] = expected.get(token, 0.0) + n * np.exp(ahead[s] + logs[token] + back[e] - ahead[-1])
    total = sum(expected.values()) + weight
    return {t: float(np.log((expected.get(t, 0.0) + weight * np.exp(p)) / total)) for t, p in prior.items()}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=7).map(str.encode), st.integers(1, 9), max_size=8))
def test_expected_counts_of_all_segmentations(words):
    chances = {b"a": 0.3, b"b": 0.2, b"ab": 0.2, b"ba": 0.1, b"aab": 0.15, b"bb": 0.05}
    logs = {t: float(np.log(p)) for t, p in chances.items()}

    def ways(word):
        return [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in chances for rest in ways(word[n:])] if word else [[]]

    want = {}
    for word, n in words.items():
        each = [(w, np.prod([chances[t] for t in w])) for w in ways(word)]
        for way, chance in each:
            for token in way:
                want[token] = want.get(token, 0.0) + n * chance / sum(c for _, c in each)
    got = token_counts.expected_counts(words.items(), logs, 3)
    assert {t: pytest.approx(v) for t, v in want.items()} == got


def test_long_and_short_sums_agree(ranks, monkeypatch):
    logs, longest = token_counts.zipf_logs(ranks), max(map(len, ranks))
    words = {w.encode(): n + 1 for n, w in enumerate(["the", "then", " thing", "\u65e5\u672c" * 5, "x" * 30, "\x00" * 32, "z" * 33, " " * 40])}
    short = token_counts.expected_counts(words.items(), logs, longest)
    monkeypatch.setattr(token_counts, "SHORT", 0)
    whole = token_counts.expected_counts(words.items(), logs, longest)
    assert short.keys() == whole.keys() and all(short[t] == pytest.approx(whole[t], rel=1e-9) for t in whole)


def test_long_runs_keep_their_bytes(ranks):
    logs = token_counts.zipf_logs(ranks)
    words = {b" " * 30_000: 2, b"x" * 3000: 1, b" the": 5, b" then": 1}
    found = token_counts.expected_counts(words.items(), logs, max(map(len, ranks)))
    assert sum(len(t) * n for t, n in found.items()) == pytest.approx(sum(len(w) * n for w, n in words.items()))


def test_query_against_plain_estimation(spark, ranks):
    from relaykit.llm.queries import op9_token_counts

    path, words = "/root/testdata/sf0.001", {}
    texts = {r["doc_id"]: VOCABULARY.pattern.findall(r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for found in texts.values():
        for word in found:
            words[word.encode()] = words.get(word.encode(), 0) + 1
    logs = prior = token_counts.zipf_logs(ranks)
    for _ in range(2):
        logs = plain_round(words, logs, prior, 10_000.0)
    prices = token_counts.prices_of(logs)
    counts = {w: plain_count(w, prices) for w in words}
    got = {r["doc_id"]: (r["n_tokens"], r["n_pretokens"]) for r in op9_token_counts(spark, path).collect()}
    assert got == {i: (sum(counts[w.encode()] for w in found), len(found)) for i, found in texts.items()}


def test_token_counts_against_each_word_alone(spark, ranks):
    logs = token_counts.zipf_logs(ranks)
    prices = token_counts.prices_of(logs)
    texts = [None, "", "the thing, the things and the thin 12  \n é", "thing " * 2000, "thing"]
    df = spark.createDataFrame([(n, t, 0) for n, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, logs, PATTERN).collect()}
    for n, text in enumerate(texts):
        words = VOCABULARY.pattern.findall(text or "")
        assert got[n]["n_pretokens"] == len(words)
        assert got[n]["n_tokens"] == sum(plain_count(w.encode(), prices) for w in words)
    assert token_counts.count_tokens(df.limit(0), logs, PATTERN).count() == 0
    assert token_counts.estimate(df.limit(0), PATH, PATTERN) == pytest.approx(logs)
    learnt = token_counts.estimate(df, PATH, PATTERN)
    assert learnt[b"thing"] > logs[b"thing"] and sum(np.exp(list(learnt.values()))) == pytest.approx(1)
