"""Field transforms on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaykit.operators.transforms import apply_transforms, cast_failures, transform_stats
from suite.inputs import LINE_ORDER, LINES_CTE, order_structs, table

SALT = "pepper"


def on(name: str, columns: list[str], *specs: dict, out: list[str] | None = None):
    """Query: select columns of a table, apply the transforms, keep the output expressions."""
    def query(spark, sf_dir):
        df = apply_transforms(table(spark, sf_dir, name).selectExpr(*columns), list(specs))
        return df.selectExpr(*(out or ["*"]))

    return query


def op(name: str, path: str, **args) -> dict:
    return {"op": name, "path": path, "args": args}


def contact(spark, sf_dir):
    """Customers as nested records."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "struct(c_name as name, struct(c_mktsegment as segment, c_nationkey as nation) as market) as profile",
        "array(c_mktsegment, cast(null as string), c_name) as notes",
    )


def nested(spark, sf_dir, specs, max_matches=None):
    docs = order_structs(spark, sf_dir).select(F.col("_id"), F.col("doc.items").alias("items"), F.col("doc.tags").alias("tags"))
    return apply_transforms(docs, specs, max_matches)


def tf_array_elements(spark, sf_dir):
    changed = nested(spark, sf_dir, [op("lower", "items[].sku"), op("upper", "items[0].name"), op("drop", "items[].discount")])
    return changed.select("_id", F.posexplode("items").alias("elem_idx", "i")).select("_id", "elem_idx", "i.sku", "i.name", "i.qty")


def tf_match_cap(spark, sf_dir):
    changed = nested(spark, sf_dir, [op("mask", "items[].sku")], max_matches=2)
    return changed.select("_id", F.posexplode("items").alias("elem_idx", "i")).select("_id", "elem_idx", "i.sku")


def tf_match_cap_sparse(spark, sf_dir):
    changed = nested(spark, sf_dir, [op("mask", "items[].discount.$numberDecimal")], max_matches=1)
    return changed.select("_id", F.posexplode("items").alias("elem_idx", "i")).select(
        "_id", "elem_idx", F.col("i.discount")["$numberDecimal"].alias("discount")
    )


STAT_SPECS = [
    op("trim", "text"), op("default_if_missing", "lang2", value="x"), op("lower", "missing"),
    op("mask", "words[]"), {"op": "upper", "path": "text", "phase": "load_only"},
]


def tf_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "case when lang <> 'fr' then lang end as lang2", "split(text, ' ') as words"
    )
    return transform_stats(docs, STAT_SPECS)


def tf_cast_failures(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "c_mktsegment", "array(cast(c_acctbal as string), c_mktsegment) as amounts"
    )
    specs = [op("cast", "c_name", type="int"), op("cast", "c_mktsegment", type="double"), op("to_decimal", "amounts[]", scale=1)]
    return cast_failures(docs, specs, "c_custkey")


def tf_to_timestamp(spark, sf_dir):
    """Order dates written in the accepted shapes, some of them not dates at all."""
    shapes = """case cast(o_orderkey % 9 as int)
        when 0 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'+0000'")
        when 1 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss.SSS'-04:00'")
        when 2 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss.SSS'+07:00'")
        when 3 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        when 4 then date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss")
        when 5 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
        when 6 then 'not-a-date'
        when 7 then date_format(o_orderdate, 'yyyy-MM-dd') end as stamp"""
    by_format = "date_format(o_orderdate, 'dd/MM/yyyy HH:mm') as written"
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", shapes, by_format)
    done = apply_transforms(
        orders,
        [
            op("to_timestamp", "stamp"),
            op("to_timestamp", "written", format="dd/MM/yyyy HH:mm", formatRegex=r"\d\d/\d\d/\d{4} \d\d:\d\d", timezone="Asia/Tokyo"),
        ],
    )
    return done.selectExpr("o_orderkey", "cast(stamp as timestamp_ntz) as stamp", "cast(written as timestamp_ntz) as written")


NESTED_ITEMS = f"WITH {LINES_CTE} "
UUID_HEX = "lower(lpad(to_hex(c_custkey), 8, '0'))"

QUERIES = {
    "tf_drop": (
        lambda spark, sf_dir: apply_transforms(
            contact(spark, sf_dir), [op("drop", "profile.market.nation"), op("drop", "notes[1]"), op("drop", "absent.path")]
        ).selectExpr("c_custkey", "to_json(profile) as profile", "array_join(notes, ';') as notes"),
        """SELECT c_custkey, '{"name":"' || c_name || '","market":{"segment":"' || c_mktsegment || '"}}' AS profile,
                  c_mktsegment || ';' || c_name AS notes FROM customer""",
    ),
    "tf_rename": (
        lambda spark, sf_dir: apply_transforms(
            contact(spark, sf_dir), [op("rename", "profile.market.segment", to="profile.area"), op("rename", "c_custkey", to="id")]
        ).selectExpr("id", "to_json(profile) as profile"),
        """SELECT c_custkey AS id, '{"name":"' || c_name || '","market":{"nation":' || c_nationkey || '},"area":"' || c_mktsegment || '"}' AS profile
           FROM customer""",
    ),
    "tf_cast": (
        on(
            "customer", ["c_custkey", "c_name as n", "c_acctbal as whole", "cast(c_acctbal as string) as amount", "c_mktsegment as bad", "cast(c_custkey % 2 = 0 as string) as flag"],
            op("cast", "n", type="int"), op("cast", "whole", type="int"), op("cast", "amount", type="double"),
            op("cast", "bad", type="int"), op("cast", "flag", type="bool"), op("cast", "c_custkey", type="string"),
        ),
        """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(regexp_replace(c_name, '[^0-9.-]', '', 'g') AS BIGINT) AS n,
                  CAST(trunc(c_acctbal) AS BIGINT) AS whole, c_acctbal AS amount, CAST(NULL AS BIGINT) AS bad, c_custkey % 2 = 0 AS flag
           FROM customer""",
    ),
    "tf_cast_failures": (
        tf_cast_failures,
        """SELECT c_custkey, 'cast' AS op, 'c_mktsegment' AS path, c_mktsegment AS value FROM customer
           UNION ALL SELECT c_custkey, 'to_decimal', 'amounts[]', c_mktsegment FROM customer""",
    ),
    "tf_coalesce": (
        on(
            "orders", ["o_orderkey", "case when o_orderstatus = 'F' then o_orderpriority end as pick", "case when o_orderstatus <> 'O' then o_orderstatus end as status", "'none' as last"],
            op("coalesce", "pick", values=["status", "absent", "last"]),
        ),
        """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, 'none') AS pick,
                  CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status, 'none' AS last FROM orders""",
    ),
    "tf_default": (
        on(
            "documents", ["doc_id", "case when source <> 'web' then source end as source", "struct(case when lang = 'en' then lang end as lang) as meta"],
            op("default_if_missing", "source", value="unknown"), op("default_if_missing", "added", value=7), op("default_if_missing", "meta.lang", value="xx"),
            out=["doc_id", "source", "added", "meta.lang as lang"],
        ),
        """SELECT doc_id, coalesce(CASE WHEN source <> 'web' THEN source END, 'unknown') AS source, 7 AS added,
                  coalesce(CASE WHEN lang = 'en' THEN lang END, 'xx') AS lang FROM documents""",
    ),
    "tf_trim": (
        on("documents", ["doc_id", r"concat('\t ', text, ' \n') as text"], op("trim", "text"), out=["doc_id", "md5(text) as digest", "length(text) as n"]),
        """SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS n
           FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t FROM documents)""",
    ),
    "tf_lower": (
        on("documents", ["doc_id", "text"], op("lower", "text"), out=["doc_id", "md5(text) as digest"]),
        "SELECT doc_id, md5(lower(text)) AS digest FROM documents",
    ),
    "tf_upper": (
        on("conversations", ["conv_id", "turn", "text", "role"], op("upper", "text"), op("upper", "role"), out=["conv_id", "turn", "role", "md5(text) as digest"]),
        "SELECT conv_id, turn, upper(role) AS role, md5(replace(upper(replace(text, 'ß', 'SS')), 'ẞ', 'SS')) AS digest FROM conversations",
    ),
    "tf_substring": (
        on("pages", ["page_id", "url as host", "html"], op("substring", "host", start=7, length=12), op("substring", "html", start=15), out=["page_id", "host", "md5(html) as digest"]),
        "SELECT page_id, substr(url, 8, 12) AS host, md5(substr(html, 16)) AS digest FROM pages",
    ),
    "tf_regex_extract": (
        on("pages", ["page_id", "url as section", "url as query", "html as title"],
           op("regex_extract", "section", pattern="https?://[^/]+/([a-z]+)/", group=1), op("regex_extract", "query", pattern=r"page=\d+"),
           op("regex_extract", "title", pattern="<title>([^<]*)</title>", group=1)),
        r"""SELECT page_id, CASE WHEN regexp_matches(url, 'https?://[^/]+/([a-z]+)/') THEN regexp_extract(url, 'https?://[^/]+/([a-z]+)/', 1) END AS section,
                   CASE WHEN regexp_matches(url, 'page=\d+') THEN regexp_extract(url, 'page=\d+', 0) END AS query,
                   CASE WHEN regexp_matches(html, '<title>([^<]*)</title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages""",
    ),
    "tf_concat": (
        on("part", ["p_partkey", "p_brand", "case when p_size > 10 then p_type end as kind", "struct(p_name as name) as d", "'' as full"],
           op("concat", "full", paths=["p_brand", "kind", "d.name", "absent"], sep="|"), out=["p_partkey", "full"]),
        "SELECT p_partkey, p_brand || '|' || coalesce(CASE WHEN p_size > 10 THEN p_type END, '') || '|' || p_name || '|' AS full FROM part",
    ),
    "tf_to_uuid": (
        on("customer", ["c_custkey", "upper(concat(lpad(hex(c_custkey), 8, '0'), '-abcd-4000-8000-0000', lpad(hex(c_custkey), 8, '0'))) as u", "c_name as bad", "concat(hex(c_custkey), '-1-2-3-4') as short"],
           op("to_uuid", "u"), op("to_uuid", "bad"), op("to_uuid", "short")),
        f"""SELECT c_custkey, {UUID_HEX} || '-abcd-4000-8000-0000' || {UUID_HEX} AS u, CAST(NULL AS VARCHAR) AS bad,
                   {UUID_HEX} || '-0001-0002-0003-000000000004' AS short FROM customer""",
    ),
    "tf_to_decimal": (
        on("lineitem", [*LINE_ORDER[:4], "l_orderkey", "cast(l_extendedprice as string) as price", "l_discount as rate", "l_returnflag as bad"],
           op("to_decimal", "price", scale=1), op("to_decimal", "rate", scale=3), op("to_decimal", "bad", scale=2),
           out=["l_orderkey", *LINE_ORDER[:4], "cast(price as double) as price", "cast(rate as double) as rate", "cast(bad as double) as bad"]),
        f"""SELECT l_orderkey, {', '.join(LINE_ORDER[:4])}, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS price,
                   CAST(CAST(l_discount AS DECIMAL(18,3)) AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS bad FROM lineitem""",
    ),
    "tf_to_timestamp": (
        tf_to_timestamp,
        """SELECT o_orderkey, CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 4 HOUR
                  WHEN 2 THEN o_orderdate - INTERVAL 7 HOUR WHEN 3 THEN o_orderdate WHEN 4 THEN o_orderdate WHEN 5 THEN o_orderdate END AS stamp,
                  o_orderdate - INTERVAL 9 HOUR AS written FROM orders""",
    ),
    "tf_parse_json": (
        lambda spark, sf_dir: apply_transforms(
            table(spark, sf_dir, "events").select("event_id", "props", "event_type"), [op("parse_json", "props"), op("parse_json", "event_type")]
        ).selectExpr("event_id", "try_variant_get(props, '$.k', 'bigint') as k", "try_variant_get(event_type, '$', 'string') as event_type"),
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events",
    ),
    "tf_mask_hash": (
        on("customer", ["c_custkey", "c_name", "case when c_custkey % 3 > 0 then c_mktsegment end as seg", "array(c_mktsegment, cast(null as string)) as notes"],
           op("mask", "c_name", strategy="hash", salt=SALT), op("mask", "seg", strategy="hash"), op("mask", "notes[]", strategy="hash", salt=SALT),
           out=["c_custkey", "c_name", "seg", "array_join(notes, ',') as notes"]),
        f"""SELECT c_custkey, sha256(c_name || '{SALT}') AS c_name, CASE WHEN c_custkey % 3 > 0 THEN sha256(c_mktsegment) END AS seg,
                   sha256(c_mktsegment || '{SALT}') || ',' || sha256('{SALT}') AS notes FROM customer""",
    ),
    "tf_mask_redact": (
        on("customer", ["c_custkey", "c_name", "c_mktsegment", "case when c_custkey % 2 = 0 then c_name end as alias"],
           op("mask", "c_name"), op("mask", "c_mktsegment", strategy="null"), op("mask", "alias")),
        "SELECT c_custkey, '*****' AS c_name, CAST(NULL AS VARCHAR) AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '*****' END AS alias FROM customer",
    ),
    "tf_array_elements": (
        tf_array_elements,
        NESTED_ITEMS + """SELECT oid AS _id, CAST(elem_idx AS INTEGER) AS elem_idx, 'sku-' || l_partkey AS sku,
            CASE WHEN elem_idx = 0 THEN 'PART ' ELSE 'Part ' END || l_partkey AS name, CAST(l_quantity AS INTEGER) AS qty FROM ordered_lines""",
    ),
    "tf_match_cap": (
        tf_match_cap,
        NESTED_ITEMS + "SELECT oid AS _id, CAST(elem_idx AS INTEGER) AS elem_idx, CASE WHEN elem_idx < 2 THEN '*****' ELSE 'SKU-' || l_partkey END AS sku FROM ordered_lines",
    ),
    "tf_match_cap_sparse": (
        tf_match_cap_sparse,
        NESTED_ITEMS + """, ranked AS (SELECT *, count(*) FILTER (l_discount > 0) OVER (PARTITION BY oid ORDER BY elem_idx) AS nth FROM ordered_lines)
            SELECT oid AS _id, CAST(elem_idx AS INTEGER) AS elem_idx,
            CASE WHEN l_discount > 0 THEN CASE WHEN nth <= 1 THEN '*****' ELSE CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) END END AS discount FROM ranked""",
    ),
    "tf_stats": (
        tf_stats,
        """SELECT 0 AS step, 'trim' AS op, 'text' AS path, count(text) AS matches FROM documents
           UNION ALL SELECT 1, 'default_if_missing', 'lang2', count(*) FILTER (lang = 'fr') FROM documents
           UNION ALL SELECT 2, 'lower', 'missing', 0
           UNION ALL SELECT 3, 'mask', 'words[]', CAST(sum(len(string_split(text, ' '))) AS BIGINT) FROM documents""",
    ),
}
