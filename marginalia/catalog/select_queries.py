"""Selection, scalar functions and text keys over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.catalog.corpus import table
from marginalia.catalog.registry import query
from marginalia.functions import text as X
from marginalia.operators import select as SEL
from marginalia.schema import SD


@query("require_columns", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    orders = SEL.require_columns(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus"])
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "normalize_cell",
    r"""SELECT cell, count(*) AS n, sum(length(cell)) AS chars FROM (
      SELECT coalesce(trim(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1
        THEN chr(9) || ' ' || c_mktsegment || chr(10) ELSE c_mktsegment END, ' ' || chr(9) || chr(10)), '') AS cell
      FROM customer) GROUP BY cell""",
)
def _(spark, sf):
    raw = F.expr(
        "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 "
        "THEN concat('\\t ', c_mktsegment, '\\n') ELSE c_mktsegment END"
    )
    cells = table(spark, sf, "customer").select(X.normalize_cell(raw).alias("cell"))
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.length("cell")).alias("chars"))


@query(
    "slice_offset",
    "SELECT count(*) AS n, sum(o_orderkey) AS keys FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 500)",
)
def _(spark, sf):
    rest = SEL.slice_offset(table(spark, sf, "orders"), "o_orderkey", 500)
    return rest.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "filter_id_list",
    """SELECT o_orderpriority, count(*) AS n FROM orders
       WHERE CAST(o_custkey AS VARCHAR) IN ('7', '11', '58', '120') GROUP BY ALL""",
)
def _(spark, sf):
    rows = SEL.filter_ids(table(spark, sf, "orders"), "o_custkey", ["7", "11", "58", "120"])
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "skip_processed",
    """SELECT lang, count(*) AS n, sum(doc_id) AS ids FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY ALL""",
)
def _(spark, sf):
    rest = SEL.skip_processed(table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), "doc_id")
    return rest.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "limit_rows",
    """SELECT doc_id, source FROM (SELECT * FROM documents ORDER BY doc_id OFFSET 20) d
       WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 25""",
)
def _(spark, sf):
    return SEL.select_rows(
        table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "doc_id", start=20,
        done=table(spark, sf, "labels"), done_key="doc_id", limit=25,
    )


@query(
    "row_contract",
    """WITH rows AS (
      SELECT CASE WHEN doc_id % 50 = 3 THEN '' ELSE 'k' || (doc_id - CASE WHEN doc_id % 20 = 1 THEN 1 ELSE 0 END) END AS k,
        doc_id % 40 = 7 AS empty_date, doc_id % 30 = 4 AS empty_text FROM documents),
    checked AS (SELECT *, k <> '' AND count(*) OVER (PARTITION BY k) > 1 AS dup FROM rows),
    long AS (
      SELECT 'empty id' AS error FROM checked WHERE k = ''
      UNION ALL SELECT 'duplicate id' FROM checked WHERE dup
      UNION ALL SELECT 'empty date' FROM checked WHERE empty_date
      UNION ALL SELECT 'empty text' FROM checked WHERE empty_text)
    SELECT error, count(*) AS n FROM long GROUP BY error""",
)
def _(spark, sf):
    notes = table(spark, sf, "documents").select(
        F.expr("CASE WHEN doc_id % 50 = 3 THEN '  ' ELSE concat(' k', doc_id - CASE WHEN doc_id % 20 = 1 THEN 1 ELSE 0 END) END").alias("id"),
        F.expr("CASE WHEN doc_id % 40 = 7 THEN '' ELSE '1990-01-05' END").alias("fecha"),
        F.expr("CASE WHEN doc_id % 30 = 4 THEN NULL ELSE concat(text, '.') END").alias("texto"),
    )
    checked = SEL.row_contract(notes, "id", "fecha", "texto")
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@query(
    "dup_ids",
    """SELECT user_id, count(*) AS copies FROM events GROUP BY user_id HAVING count(*) > 1 ORDER BY user_id LIMIT 10""",
)
def _(spark, sf):
    return SEL.duplicate_ids(table(spark, sf, "events"), "user_id")


@query(
    "user_header_once",
    """SELECT headers, count(*) AS n FROM (
      SELECT (length(t) - length(replace(t, 'FECHA DE EDICIÓN DE LA NOTA:', ''))) // 28 AS headers FROM (
        SELECT repeat('FECHA DE EDICIÓN DE LA NOTA: x' || chr(10), CAST(doc_id % 4 AS INTEGER)) || text AS t FROM documents))
    WHERE headers <> 1 GROUP BY headers""",
)
def _(spark, sf):
    text = F.concat(F.expr(f"repeat('{X.HEADER} x\\n', CAST(doc_id % 4 AS INT))"), F.col("text"))
    counted = table(spark, sf, "documents").select(X.header_count(text).cast("long").alias("headers"))
    return counted.where(F.col("headers") != 1).groupBy("headers").agg(F.count("*").alias("n"))


@query(
    "input_text",
    """SELECT lang, count(*) AS n, sum(length(t)) AS chars, min(md5(t)) AS first_md5, max(md5(t)) AS last_md5 FROM (
      SELECT lang, concat('FECHA DE EDICIÓN DE LA NOTA: ', source, chr(10), chr(10), text) AS t FROM documents)
    GROUP BY lang""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("lang", X.input_text(F.col("source"), F.col("text")).alias("t"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"),
        F.min(F.md5("t")).alias("first_md5"), F.max(F.md5("t")).alias("last_md5"),
    )


@query(
    "norm_date",
    r"""SELECT norm, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 13 IN (7, 8) THEN 'S/D'
        ELSE strftime(o_orderdate, '%d/%m/%Y') END AS norm FROM orders) GROUP BY norm""",
)
def _(spark, sf):
    written = F.expr(
        "CASE o_orderkey % 13 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "WHEN 1 THEN date_format(o_orderdate, 'yyyy_M_d') WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy') "
        "WHEN 3 THEN concat(' ', date_format(o_orderdate, 'd-M-yyyy')) WHEN 4 THEN date_format(o_orderdate, 'yyyy/MM/dd') "
        "WHEN 5 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 6 THEN date_format(o_orderdate, 'yyyyMMdd') "
        "WHEN 7 THEN 'sin fecha' WHEN 9 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 10 THEN date_format(o_orderdate, 'EEE dd MMM yyyy') "
        "WHEN 11 THEN date_format(o_orderdate, 'yyyy.MM.dd HH:mm') WHEN 12 THEN date_format(o_orderdate, 'MMM-dd-yy') ELSE '' END"
    )
    return table(spark, sf, "orders").select(X.norm_date(written).alias("norm")).groupBy("norm").agg(F.count("*").alias("n"))


@query(
    "date_to_iso",
    """SELECT iso, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'S/D'
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders) GROUP BY iso""",
)
def _(spark, sf):
    stored = F.when(F.col("o_orderkey") % 10 == 0, F.lit(SD)).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf, "orders").select(X.date_to_iso(stored).alias("iso")).groupBy("iso").agg(F.count("*").alias("n"))


_MESSY_SQL = """CASE part.p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN ' ' || p_type || '  '
   WHEN 2 THEN replace(p_type, 'E', 'É') ELSE p_type END"""
_MESSY = (
    "CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN concat(' ', p_type, '  ') "
    "WHEN 2 THEN replace(p_type, 'E', 'É') ELSE p_type END"
)


@query(
    "norm_match",
    f"""SELECT count(*) AS n, sum(CASE WHEN strip_accents(lower(trim({_MESSY_SQL}))) = lower(p_type) THEN 1 ELSE 0 END) AS same,
        count(DISTINCT strip_accents(lower(trim({_MESSY_SQL})))) AS keys FROM part""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_type", X.norm_match(F.expr(_MESSY)).alias("k"))
    return parts.agg(
        F.count("*").alias("n"),
        F.sum((F.col("k") == X.norm_match(F.col("p_type"))).cast("long")).alias("same"),
        F.count_distinct("k").alias("keys"),
    )


@query(
    "enum_match_join",
    f"""SELECT matched, count(*) AS n FROM (
      SELECT m.p_type AS matched FROM part LEFT JOIN (SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO') m
        ON strip_accents(lower(trim({_MESSY_SQL.replace('p_type', 'part.p_type')}))) = lower(m.p_type)) GROUP BY matched""",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    members = part.where(F.col("p_type") != "PROMO").select("p_type").distinct()
    joined = SEL.enum_match(part.select(F.expr(_MESSY).alias("value")), "value", members, "p_type")
    return joined.groupBy("matched").agg(F.count("*").alias("n"))


@query(
    "content_hash",
    """SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS distinct_texts, min(sha256(text)) AS first_hash,
         max(sha256(text)) AS last_hash FROM documents GROUP BY source""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("source", X.content_hash(F.col("text")).alias("h"))
    # distinct hashes are counted from (source, hash) groups: both steps combine map-side
    per_hash = docs.groupBy("source", "h").agg(F.count("*").alias("copies"))
    return per_hash.groupBy("source").agg(
        F.sum("copies").alias("n"), F.count("*").alias("distinct_texts"), F.min("h").alias("first_hash"),
        F.max("h").alias("last_hash"),
    )


@query(
    "gen_budget",
    """SELECT reason, count(*) AS n, sum(budget) AS budget FROM (
      SELECT CASE WHEN p >= 20480 THEN 'too long' WHEN b < 256 THEN 'too small' ELSE 'fits' END AS reason, b AS budget FROM (
        SELECT p, least(8192, greatest(0, 20480 - p - 16)) AS b FROM (SELECT length(text) AS p FROM documents)))
    GROUP BY reason""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.length("text").cast("long").alias("p"))
    rows = docs.select(X.token_budget(F.col("p")).alias("budget"), X.budget_block(F.col("p")).alias("block"))
    reason = (
        F.when(F.col("block").contains(" >= "), F.lit("too long"))
        .when(F.col("block").isNotNull(), F.lit("too small")).otherwise(F.lit("fits"))
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("budget").alias("budget"))


@query(
    "get_path",
    """SELECT k, present, count(*) AS n FROM (
      SELECT coalesce(json_extract_string(props, '$.k'), '') AS k, json_extract(props, '$.a.b') IS NOT NULL AS present FROM events)
    GROUP BY ALL""",
)
def _(spark, sf):
    from marginalia.functions.render import scalar_at

    events = table(spark, sf, "events").select(F.try_parse_json("props").alias("v"))
    return events.groupBy(scalar_at("v", "k").alias("k"), (scalar_at("v", "a.b") != "").alias("present")).agg(
        F.count("*").alias("n")
    )
