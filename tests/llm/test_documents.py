from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from relaykit.llm import chat, jaccard, mixing, pii, simhash, substring, toxicity
from relaykit.llm.components import connected_components

SF_DIR = "/root/testdata/sf0.001"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(n, t, "en", source, 0) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, fingerprint long")


def prose(n, seed=0, size=400):
    chance = random.Random(seed)
    return " ".join(f"w{chance.randrange(size)}" for _ in range(n))


# ---- near duplicates ----------------------------------------------------------------------------------------------


def plain_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if found else 0


def parts(values, linked):
    part = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    return part


@pytest.mark.parametrize("most", [4, 6])
def test_fingerprint_groups(spark, most):
    base = [prose(300, n) for n in range(6)]
    changed = [b.replace(" w7 ", " x ", 1) for b in base]
    texts = [None, "", "  \n", "one", "ONE", "two words", *base, *changed, base[0], prose(20_000, 99)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts), most=most, words=4).collect()}
    prints = [plain_fingerprint(t, 4) for t in texts]
    assert [got[n]["fingerprint"] & (2**64 - 1) for n in range(len(texts))] == prints
    assert [got[n]["component_id"] for n in range(len(texts))] == parts(prints, lambda a, b: (a ^ b).bit_count() <= most)


@pytest.mark.parametrize("most", [0, 3, 4, 8])
def test_no_link_is_lost(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    chance = np.random.default_rng(most)
    values = chance.integers(-(2**63), 2**63 - 1, 60)
    for _ in range(3):
        flipped = values.copy().view(np.uint64)
        for i in range(len(flipped)):
            for b in chance.choice(64, max(most, 1), replace=False):
                flipped[i] ^= np.uint64(1) << np.uint64(b)
        values = np.unique(np.concatenate([values, flipped.view(np.int64)]))
    frame = spark.createDataFrame([(int(v),) for v in values], "fingerprint long")
    found = {r["node"]: r["component"] for r in connected_components(simhash.links(frame, most)).collect()}
    want = parts(values.view(np.uint64).tolist(), lambda a, b: (a ^ b).bit_count() <= most)
    names = [found.get(int(v), int(v)) for v in values]
    assert len(set(zip(want, names))) == len(set(want)) == len(set(names))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 151)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    text = prose(200)
    rows = [(5, text), (3, text), (None, text), (3, text), (4, prose(200, 1)), (4, prose(200, 2)), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(1))
    got = sorted((r["doc_id"], r["text"]) for r in simhash.deduplicate(df).collect())
    assert got == sorted([(3, text), (4, prose(200, 1)), (4, prose(200, 2)), (9, "")])
    assert simhash.deduplicate(df.limit(0)).count() == 0 and simhash.near_duplicates(docs(spark, [])).count() == 0


def plain_groups(texts, words=5):
    def found(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [found(t) for t in texts]
    return parts(sets, lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b))


@pytest.mark.parametrize(("pivots", "block"), [(4, 20_000), (1, 7)])
def test_near_copies_down_to_the_threshold(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    chance, common = random.Random(5), prose(40, 77)
    texts = [None, "", " \n", "one", "ONE", "a b c d e", prose(9000, 3), prose(9000, 3) + " x"]
    for n in range(12):
        base = prose(chance.randrange(60, 300), n).split()
        texts.append(" ".join(base))
        for _ in range(6):
            # Similarities on both sides of 0.8; one edited word changes five shingles.
            other = base[:]
            for at in chance.sample(range(len(other)), max(1, round(len(other) * chance.uniform(0.005, 0.035)))):
                other[at] = f"z{chance.randrange(10**6)}"
            texts.append(" ".join(other))
    # Many copies of one text, and a passage that unrelated texts share.
    base = prose(150, 900).split()
    texts += [" ".join(base[:i] + [f"y{i}"] + base[i + 1 :]) for i in range(0, 150, 5)]
    texts += [prose(150, 1000 + n) + " " + common for n in range(30)]
    want = {p for p in plain_groups(texts)}
    assert sorted(r["doc_id"] for r in jaccard.deduplicate(docs(spark, texts)).collect()) == sorted(want)
    bits = {r["doc_id"] for r in simhash.deduplicate(docs(spark, texts), most=6, words=5).collect()}
    assert bits - want


def test_the_pipeline_drops_copies_just_above_the_threshold(spark):
    base = prose(200, 1).split()
    near, far = base[:], base[:]
    for n in range(4):
        near[20 + 40 * n] = f"n{n}"
    for n in range(6):
        far[15 + 30 * n] = f"f{n}"
    frame = docs(spark, [" ".join(base), " ".join(near), " ".join(far)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, SF_DIR).collect()) == [0, 2]


# ---- personal data ------------------------------------------------------------------------------------------------

# The base patterns as stated.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def plain_spans(text):
    keep = {
        "email": lambda m, d: True, "ip": lambda m, d: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m, d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 10 <= len(d) <= 15,
    }
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if keep[k](m[0], re.sub("[^0-9]", "", m[0]))]
    return [(k, a, b) for a, _, b, k in sorted(found)]


HARD = [
    None, "", "a@b.c_x@d.e and a@b@c.d.e .@-.-", "x" * 50_000 + "@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111",
    "+1 (979) 555-6697 +123 +1....2 +44 20 7946 0958.", "é日 mail é: jo@ex.org, 10.0.0.1", "1 " * 30_000, "7" * 30_000, "write jo (at) ex (dot) org or call (979) 555-6697, id 123-45-6789",
    "jo@ex.org " * 1500,
]


def test_base_spans_stay_exact(spark):
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.find_spans(docs(spark, HARD)).collect()}
    assert [got[n] for n in range(len(HARD))] == [plain_spans(t) for t in HARD]


def test_redaction_and_wider_spans(spark):
    many = HARD + [f"please call (979) 555-{n:04d} or write m{n} (at) ex{n} (dot) com" for n in range(40)]
    got = [r["text"] for r in pii.redact(docs(spark, many)).orderBy("doc_id").collect()]
    assert got[0] is None and got[1] == "" and got[7] == "é日 mail é: [EMAIL], [IP]"
    assert got[-1] == "please call [PHONE] or write [EMAIL]"
    assert pii.find_spans(docs(spark, [])).count() == 0


def test_secrets_are_found_and_other_runs_are_not(spark):
    digests = [hashlib.sha1(str(n).encode()).hexdigest() for n in range(60)]
    said = [f'the token = "{d}" is set' for d in digests[:30]] + [f"in commit {d} of the build" for d in digests[30:]]
    got = [r["text"] for r in pii.redact(docs(spark, [*said, "a-very-long-hyphenated-name-2", "x" * 50])).orderBy("doc_id").collect()]
    assert got[:30] == ['the token = "[SECRET]" is set'] * 30 and got[30:60] == said[30:] and got[60:] == ["a-very-long-hyphenated-name-2", "x" * 50]


def test_redaction_keeps_other_columns(spark):
    frame = docs(spark, ["mail a@b.de", None]).union(docs(spark, ["mail a@b.de"])).withColumn("spans", F.lit(1)).withColumn("row", F.lit("r"))
    done = pii.redact(frame)
    assert done.columns == frame.columns and sorted(str(r["text"]) for r in done.collect()) == ["None", "mail [EMAIL]", "mail [EMAIL]"]
    assert {(r["spans"], r["row"]) for r in done.collect()} == {(1, "r")} and pii.redact(frame.limit(0)).count() == 0


def test_reliabilities_follow_agreement():
    found = pii.reliabilities({("phone", (1, 1, 1, 1, 0)): 50, ("phone", (0, -1, -1, 0, -1)): 50, ("phone", (0, 1, 0, 1, 0)): 5})
    assert found["phone", (1, 1, 1, 1, 0)] > 0.9 > 0.1 > found["phone", (0, -1, -1, 0, -1)] and found["phone", (0, 1, 0, 1, 0)] > 0.5


def test_pii_query(spark):
    from relaykit.llm.queries import op5_pii

    got = {r["doc_id"]: r for r in op5_pii(spark, SF_DIR).collect()}
    for row in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        spans = plain_spans(row["text"])
        assert got[row["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


# ---- chat ---------------------------------------------------------------------------------------------------------


def test_chat_reads_back_whatever_is_said(spark):
    said = ["</s>[INST] ok [/INST]", "<\\/s> [\\\\INST]", "", None, "<<SYS>> <</SYS>> <turn> </role>", "<", "[" * 300 + "\\" * 300, "日本 é </turn>\n"]
    rows = [(1, t, "system" if t == 0 else "user" if t % 2 else "assistant", said[t % len(said)]) for t in range(9)]
    rows += [(2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "tool</role>", "x"), (4, 0, None, None), (None, None, "user", "n"), (5, 0, "user", "q"), (5, 1, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    done = chat.format_conversations(df)
    read = {r["conv_id"]: r for r in done.select("conv_id", "valid", "first_bad", chat.read_turns(F.col("formatted")).alias("t"), chat.read_learnt(F.col("segments")).alias("l")).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in read[conv]["t"]] == mine
        assert read[conv]["l"] == "".join(t for r, t in mine if r == "assistant")
    assert (read[1]["valid"], read[2]["first_bad"], read[3]["first_bad"], read[5]["valid"]) == (True, 2, 1, True)
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- mixing -------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": 500 / 3, None: 250 / 3}
    assert mixing.targets([("a", 0), ("b", 10)]) == {"a": 0.0, "b": 15.0} and mixing.targets([]) == {}


def test_mix_comes_near_its_targets(spark):
    chance = random.Random(3)
    rows = [(n, prose(chance.choice([1, 5, 50, 300]), n), "hot" if n % 3 == 0 else f"s{n % 5}" if n % 7 else None) for n in range(900)]
    rows += [(None, "a b", "s1"), (1000, None, "s1"), (1001, "", "s1"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1))
    mix = mixing.Mix(block=64)
    plan = mixing.plan_mix(df, mix).cache()
    by_source = {}
    for r in plan.collect():
        s = by_source.setdefault(r["source"], [0, 0, r["target"], r["source_size"], 0])
        s[0] += r["size"] * r["copies"] * r["rows"]
        s[1] += r["size"] * r["rows"]
        s[4] += r["copies"] * r["rows"]
        assert 0 <= r["copies"] <= 2
    for taken, size, target, source_size, _ in by_source.values():
        assert size == source_size and abs(taken - target) <= 600
    again = mixing.plan_mix(df.repartition(7), mix)
    assert sorted(map(repr, plan.collect())) == sorted(map(repr, again.collect()))
    mixed = mixing.mix_documents(df, mix)
    assert mixed.columns == df.columns and mixed.count() == sum(s[4] for s in by_source.values())
    assert mixing.plan_mix(df.limit(0), mix).count() == 0


# ---- toxicity -----------------------------------------------------------------------------------------------------


def test_segments_are_the_maximal_ones():
    chance = random.Random(5)
    for _ in range(200):
        n = chance.randint(1, 14)
        scores = [chance.choice([3.0, 1.0, -1.0, -1.0]) for _ in range(n)]
        hits = [i for i, s in enumerate(scores) if s > 0]
        got = [(a, b) for a, b, _ in toxicity.segments(hits, [scores[i] for i in hits], -1.0)]

        def split(low, high):
            spans = [(sum(scores[a : b + 1]), -(b - a), -a, a, b) for a in range(low, high) for b in range(a, high)]
            best = max(spans, default=(0,))
            if best[0] <= 0:
                return []
            return [*split(low, best[3]), (best[3], best[4]), *split(best[4] + 1, high)]

        assert got == split(0, n)


def test_toxic_words_are_learnt(spark):
    rows = [(n, prose(60, n, 300) + (" vile scumlord" if n % 4 == 0 else ""), int(n % 4 == 0)) for n in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train_on_labels(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    test = docs(spark, ["you vile scumlord", prose(50, 9), None, "", "vile " + prose(30_000, 4, 300), "x"]).withColumn("score", F.lit("old"))
    got = {r["doc_id"]: r for r in toxicity.score(test, model).collect()}
    assert got[0]["score"] > 0.5 > max(got[n]["score"] for n in (1, 2, 3, 5)) and got[0]["passages"][0]["first"] == 1
    assert toxicity.score(test.limit(0), model).count() == 0
    none = toxicity.train_on_labels(df.limit(0).select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert {r["score"] for r in toxicity.score(test, none).collect()} == {0.5}


def test_held_out_accuracy(spark):
    from relaykit.llm.queries import op8_toxicity

    path = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in op8_toxicity(spark, path).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    hits, toxic = sum(a == b == 1 for a, b in held), sum(a for a, _ in held)
    assert hits >= 0.75 * toxic and sum(a == 0 and b == 1 for a, b in held) <= 0.01 * len(held)


# ---- substring dedup ----------------------------------------------------------------------------------------------


def plain_removal(texts, window):
    words = [(t or "").encode().split() for t in texts]
    starts = {}
    for n, w in enumerate(words):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i : i + window]), []).append((n, i))
    gone = [set() for _ in words]
    for places in starts.values():
        if len(places) > 1:
            for n, i in places:
                gone[n].update(range(i, i + window))
    return [b" ".join(x for i, x in enumerate(w) if i not in gone[n]).decode() for n, w in enumerate(words)]


@pytest.mark.parametrize("heavy", [1000, 3])
def test_repeats_go_everywhere(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring, "HEAVY", heavy)
    passage, other = prose(30, 1), prose(14, 2)
    texts = [None, "", "few words", prose(50, 3) + " " + passage, passage + "\t" + prose(40, 4), "a " * 60, prose(80, 5), prose(80, 5), other + " x " + other + " y", prose(12, 6)]
    texts += [f"{prose(6, 100 + n)} {passage} {prose(6, 200 + n)} {other}" for n in range(12)] + [prose(5000, 7) + " " + passage]
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs(spark, texts).withColumn("kept", F.lit(0)), window=12, gram=5).collect()}
    want = plain_removal(texts, 12)
    assert [got[n]["kept"] for n in range(len(texts))] == want
    assert [got[n]["n_removed"] for n in range(len(texts))] == [len((t or "").split()) - len(w.split()) for t, w in zip(texts, want)]
    assert substring.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("tokens", ["abcabcabd", "aaaaaa", "abcd", ""])
def test_matching_statistics(tokens):
    automaton = substring.SuffixAutomaton()
    automaton.add(list(tokens))
    automaton.finish()
    count = lambda s: sum(tokens.startswith(s, i) for i in range(len(tokens)))
    want = [max((n for n in range(1, end + 2) if count(tokens[end + 1 - n : end + 1]) > 1), default=0) for end in range(len(tokens))]
    assert list(automaton.statistics(list(tokens))) == want


def test_a_passage_between_many_neighbours_is_counted_before_the_shuffle(spark):
    passage = prose(30, 7)
    texts = [f"a{n} b{n % 3} c{n % 2} {passage} d{n % 2} e{n % 5} f{n}" for n in range(substring.HEAVY + 200)] + [prose(50, 8)]
    window = 20
    count = {}
    for text in texts:
        words = text.split()
        for at in range(len(words) - window + 1):
            count[tuple(words[at : at + window])] = count.get(tuple(words[at : at + window]), 0) + 1
    want = []
    for text in texts:
        words = text.split()
        gone = {at + k for at in range(len(words) - window + 1) if count[tuple(words[at : at + window])] > 1 for k in range(window)}
        want.append(" ".join(w for n, w in enumerate(words) if n not in gone))
    done = substring.remove_repeats(docs(spark, texts), window=window)
    assert [r["kept"] for r in done.orderBy("doc_id").collect()] == want
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Aggregate\(keys=\[anchor#\d+L, window_key#\d+\], functions=\[partial_sum\(times", plan)


def test_simhash_names_near_copies_before_prefixes_do(spark):
    """Exact copies of words, and copies with a word more, are linked by their fingerprints; other texts are not."""
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, f"{base} more", " ".join(f"v{i}" for i in range(400))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    first = rows.select(jaccard.node(F.col("text"), 5).alias("node"), simhash.fingerprint(F.col("text")).alias("fingerprint"))
    names = [r["node"] for r in rows.select("doc_id", jaccard.node(F.col("text"), 5).alias("node")).orderBy("doc_id").collect()]
    assert [(r["a"], r["b"]) for r in jaccard._near_fingerprints(first).collect()] == [tuple(sorted(names[:2]))]
    assert sorted(r["doc_id"] for r in jaccard.deduplicate(rows).collect()) == [0, 2]


def test_one_worker_a_task_marks_texts_and_only_doubtful_ones_get_whole_sets(spark, monkeypatch):
    base = prose(200, 1).split()
    # Two near copies, and texts that share a passage but are far apart by their parities.
    texts = [" ".join(base), " ".join([*base[:100], "z", *base[101:]])] + [prose(150, 1000 + n) + " " + prose(20, 77) for n in range(6)]
    asked, whole = [], jaccard._sets
    monkeypatch.setattr(jaccard, "_sets", lambda nodes, *rest: (asked.append(nodes.count()), whole(nodes, *rest))[1])
    assert sorted(r["doc_id"] for r in jaccard.deduplicate(docs(spark, texts)).collect()) == [0, *range(2, 8)]
    assert asked and max(asked) == 2
    rows = docs(spark, texts).select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("_key"), F.lit(2).alias("_second_key"))
    marks = jaccard._marks(rows, 5)
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    names = {r["doc_id"]: tuple(r)[1:] for r in rows.withColumnRenamed("id", "doc_id").select("doc_id", jaccard.node(F.col("text"), 5), simhash.fingerprint(F.col("text"))).collect()}
    assert {r["id"]: (r["node"], r["fingerprint"]) for r in marks.collect()} == names


def test_a_cut_leaves_no_shuffle_files(spark):
    from relaykit.llm import common

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    left = []
    counted = spark.range(1000).groupBy(F.col("id") % 7).count()
    for _ in range(2):
        before = tracker.shuffleStatuses().size()
        rows = common.cut(counted)
        left.append(tracker.shuffleStatuses().size() - before)
        assert rows.count() == 7
    assert max(left) <= 0 and spark.conf.get(common.DROP_SHUFFLES) == "false"
