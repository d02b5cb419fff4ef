"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaykit.llm import alignment, ann, bpe, chat, mixing, pii, simhash, substring, token_counts, topk, toxicity, urls, whitening
from relaykit.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, F.col("vec_id") % 100 == 0, 10)


OP1_SQL = """
WITH v AS (
    SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), most=4, words=4)
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(pii.of_kind(base, k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.describe(base), 256).alias("base_sha256"), pii.describe(F.col("spans")).alias("spans"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    done = chat.format_conversations(turns)
    read = done.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.read_learnt(F.col("segments")))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", "first_bad",
    )


# Fixed: the template's marks, counted, and its escape as a pattern without look-ahead.
OP6_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
    SELECT *, lag(role) OVER w AS earlier, lead(role) OVER w AS later, row_number() OVER w AS n,
           CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 9 ELSE 20 + length(role) END
           + length(regexp_replace(text, '([<\[])(\\*)(<SYS>>|</SYS>>|/?INST\]|/?s>|/?turn>|/role>)', '\1\\\2\3', 'g')) AS chars
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (
    SELECT *, CASE WHEN NOT coalesce((earlier IS NULL AND role IN ('system', 'user')) OR (earlier = 'system' AND role = 'user')
                        OR (earlier = 'user' AND role = 'assistant') OR (earlier = 'assistant' AND role = 'user'), false)
                   THEN n WHEN later IS NULL AND role <> 'assistant' THEN n + 1 END AS bad FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, min(bad) IS NULL AS valid, min(bad)::INTEGER AS first_bad
FROM g GROUP BY conv_id"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    every = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = token_counts.estimate(docs, RANKS, public_tokenizers.PATTERN)
    return token_counts.count_tokens(docs, model, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "n_pretokens")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substring.remove_repeats(docs, window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# Words of valid UTF-8 never split inside a character, so DuckDB's regular expression gives the same ones.
OP10_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT s.r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM s JOIN d USING (r)),
c AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g JOIN c USING (h)),
kept AS (
    SELECT u.r, count(*) AS n, string_agg(x, ' ' ORDER BY u.p) AS t
    FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) u
    LEFT JOIN gone ON gone.r = u.r AND gone.p = u.p WHERE gone.p IS NULL GROUP BY u.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


OP11_RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), OP11_RULES, urls.declared_links(pages)).drop("url")


# Fixed: the normal form, the addresses that pages declare and how they are resolved, as patterns.
_HOST = r"translate(coalesce(regexp_extract({0}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '')"
_PARAMETERS = r"""list_sort(list_filter(string_split(regexp_extract({0}, '://[^?#]*\?([^#]*)', 1), '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[ce]id|igshid)(=|\z)')))"""
_NODE = f"""CASE WHEN {_HOST} <> '' THEN regexp_replace(regexp_replace({_HOST}, '^www\\.', ''), ':(80|443)\\z', '') || regexp_replace({_PATH}, '/+\\z', '')
    || CASE WHEN len({_PARAMETERS}) > 0 THEN '?' || array_to_string({_PARAMETERS}, '&') ELSE '' END END"""
_FITS = """CASE WHEN ({h} = 'example.net' OR {h} LIKE '%.example.net') AND starts_with({p}, '/en/') THEN 'example.net/en/'
    WHEN ({h} = 'example.com' OR {h} LIKE '%.example.com') AND starts_with({p}, '/de/') THEN 'example.com/de/'
    WHEN ({h} = 'org' OR {h} LIKE '%.org') AND starts_with({p}, '/fr/') THEN 'org/fr/'
    WHEN ({h} = 'net' OR {h} LIKE '%.net') AND starts_with({p}, '/') THEN 'net/' END"""


def _judged(url: str) -> str:
    return f"{_NODE.format(url)} AS node, {_FITS.format(h=_HOST.format(url), p=_PATH.format(url))} AS rule"


OP11_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_judged('url')} FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)(<(?:link|meta)\s[^>]*>)', 1)) AS tag FROM pages),
found AS (
    SELECT url, trim(replace(CASE
        WHEN regexp_matches(tag, '(?i)^<link\s') AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?\s*canonical\b')
        THEN regexp_extract(tag, '(?i)\shref\s*=\s*(?:"([^">]*)|''([^''>]*)|([^\s"''>]+))', 1) || regexp_extract(tag, '(?i)\shref\s*=\s*(?:"([^">]*)|''([^''>]*)|([^\s"''>]+))', 2)
            || regexp_extract(tag, '(?i)\shref\s*=\s*(?:"([^">]*)|''([^''>]*)|([^\s"''>]+))', 3)
        WHEN regexp_matches(tag, '(?i)^<meta\s') AND regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?\s*refresh\b')
        THEN regexp_extract(tag, '(?i)\scontent\s*=\s*(?:"[^">]*?url\s*=\s*([^">]*)|''[^''>]*?url\s*=\s*([^''>]*))', 1)
            || regexp_extract(tag, '(?i)\scontent\s*=\s*(?:"[^">]*?url\s*=\s*([^">]*)|''[^''>]*?url\s*=\s*([^''>]*))', 2) END, '&amp;', '&')) AS link,
        regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) AS base, regexp_extract(url, '^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)', 1) AS folder FROM tags),
links AS (
    SELECT url AS source, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
        WHEN starts_with(link, '//') THEN regexp_extract(url, '^([^:/?#]*:)//', 1) || link WHEN base = '' THEN NULL WHEN starts_with(link, '/') THEN base || link
        WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN folder = base THEN base || '/' || link ELSE folder || link END AS target
    FROM found WHERE link IS NOT NULL),
e AS (SELECT DISTINCT source, target, {_NODE.format('source')} AS a, {_NODE.format('target')} AS b FROM links),
marks AS (SELECT node, rule FROM p UNION ALL SELECT {_judged('url')} FROM (SELECT source AS url, a, b FROM e UNION ALL SELECT target, a, b FROM e) WHERE a <> b),
near AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
named AS (SELECT node, rule, coalesce((SELECT min(b) FROM reach WHERE a = node), node) AS component FROM marks),
grp AS (SELECT component, bool_or(rule IN ('example.net/en/', 'org/fr/')) AS allowed, bool_or(rule IN ('net/', 'example.com/de/')) AS blocked FROM named WHERE node IS NOT NULL GROUP BY 1),
decided AS (SELECT DISTINCT node, allowed, blocked FROM named JOIN grp USING (component) WHERE allowed OR blocked)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.net/en/', 'org/fr/') OR (rule IS NULL AND (allowed OR blocked IS NOT TRUE)) THEN 'allow' ELSE 'block' END AS verdict,
    CASE WHEN rule IS NOT NULL THEN 'rule' WHEN allowed OR blocked THEN 'alias' ELSE 'default' END AS reason
FROM p LEFT JOIN decided USING (node)"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, factor=256, keep=["vec_id"])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alignment.Side("byte_level", public_tokenizers.path("byte_bpe_50k.json"), before=" ")
    b = alignment.Side("pieces", public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align_and_score(table(spark, sf_dir, "documents"), a, b, keep=["doc_id"])


QUERIES = {
    "op1_voronoi_knn": (op1_voronoi_knn, OP1_SQL),
    "op2_bpe": (op2_bpe, None),
    "op3_graph_ann": (op3_graph_ann, None),
    "op4_simhash": (op4_simhash, None),
    "op5_pii": (op5_pii, None),
    "op6_chat_format": (op6_chat_format, OP6_SQL),
    "op7_mixing": (op7_mixing, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_token_counts": (op9_token_counts, None),
    "op10_substring_dedup": (op10_substring_dedup, OP10_SQL),
    "op11_url_filter": (op11_url_filter, OP11_SQL),
    "op12_whitening": (op12_whitening, None),
    "op13_token_alignment": (op13_token_alignment, None),
}
