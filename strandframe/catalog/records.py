"""Registered queries on literature records and execution logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.operators import literature as W
from strandframe.operators import oplog as O
from strandframe.streaming.oplog import usage_by_window

_WORD = r"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}]){w}($|[^\p{{L}}\p{{N}}])')"


@query(
    "boolean_search",
    f"SELECT doc_id, lang, source FROM documents WHERE {_WORD.format(w='the')} AND ({_WORD.format(w='an')} OR {_WORD.format(w='le')}) AND NOT {_WORD.format(w='hein')} AND contains(lower(text), 'er')",
)
def _(x):
    return W.boolean_search(x.table("documents"), every=["the"], some=["an", "le"], none=["hein"], phrases=["er"], fields=["text"]).select("doc_id", "lang", "source")


_LIT = """lit AS (SELECT o_orderkey AS pmid, concat(o_orderpriority, ' Study: ', o_custkey % 700, CASE WHEN o_orderkey % 2 = 0 THEN '!' ELSE '' END) AS title, concat('J ', o_orderstatus) AS journal, year(o_orderdate) AS year,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('10.1/', o_custkey) ELSE '' END AS doi, (o_custkey % 12 + 1)::INT AS na, concat(o_custkey % 90, '(', o_custkey % 9, ')') AS volume, concat(o_custkey, '-', o_custkey + 9) AS pages FROM orders)"""


def _lit(x):
    o = x.table("orders")
    c = F.col("o_custkey")
    names = F.transform(F.sequence(F.lit(1), (c % 12 + 1).cast("int")), lambda i: F.concat(F.lit("Fam"), i, F.lit(" Given")))
    return o.select(
        F.col("o_orderkey").alias("pmid"),
        F.concat("o_orderpriority", F.lit(" Study: "), c % 700, F.when(F.col("o_orderkey") % 2 == 0, "!").otherwise("")).alias("title"),
        F.concat(F.lit("J "), "o_orderstatus").alias("journal"), F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("10.1/"), c)).otherwise("").alias("doi"),
        names.alias("authors"), F.concat(c % 90, F.lit("("), c % 9, F.lit(")")).alias("volume"), F.concat(c, F.lit("-"), c + 9).alias("pages"),
    )


@query("literature_records", f"WITH {_LIT} SELECT pmid, title, journal, year::VARCHAR AS date, least(na, 10) AS n_authors, doi FROM lit")
def _(x):
    raw = _lit(x).withColumn("ids", F.when(F.col("doi") != "", F.create_map(F.lit("doi"), F.col("doi"))).otherwise(F.create_map(F.lit("pii"), F.col("pages")))).withColumn("date", F.col("year").cast("string"))
    r = W.literature_records(raw)
    return r.select("pmid", "title", "journal", "date", F.size("authors").alias("n_authors"), "doi")


_DEDUP = f"{_LIT}, dd AS (SELECT * FROM lit QUALIFY row_number() OVER (PARTITION BY CASE WHEN doi <> '' THEN 'doi:' || lower(doi) ELSE 'title:' || trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) END ORDER BY pmid) = 1)"


@query("dedupe_records", f"WITH {_DEDUP} SELECT pmid, title, doi FROM dd")
def _(x):
    return W.dedupe_records(_lit(x)).select("pmid", "title", "doi")


@query("screening_funnel", f"WITH {_DEDUP} SELECT (SELECT count(*) FROM lit) AS identified, count(*) AS deduplicated, count(*) FILTER (year >= 1995) AS screened, count(*) FILTER (year >= 1995 AND journal = 'J F') AS included FROM dd")
def _(x):
    return W.screening_funnel(_lit(x), F.col("year") >= 1995, F.col("journal") == "J F")


@query("rank_by_citations", "SELECT o_orderkey AS pmid, count(*) AS cited FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(x):
    cites = x.table("lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_partkey").alias("cited_by"))
    return W.rank_by_citations(_lit(x).select("pmid"), cites)


_AUTH = "list_transform(range(1, na + 1), lambda i: concat('Fam', i, '{sep}G{dot}'))"
_LAST = "CASE WHEN na > 1 THEN array_to_string(list_transform(range(1, na), lambda i: concat('Fam', i, ', G.')), ', ') || '{last}' || concat('Fam', na, ', G.') ELSE concat('Fam', na, ', G.') END"


@query(
    "format_citation",
    f"""WITH {_LIT} SELECT pmid, concat(array_to_string({_AUTH.format(sep=' ', dot='')}, ', '), '. ', title, '. ', journal, '. ', year, ';', volume, ':', pages, '. doi:', doi) AS vancouver,
    concat({_LAST.format(last=' & ')}, ' ', title, '. ', journal, ' ', volume, ', ', pages, ' (', year, ').') AS nature,
    concat({_LAST.format(last=', & ')}, ' (', year, '). ', title, '. ', journal, ', ', volume, ', ', pages, '. https://doi.org/', doi) AS apa FROM lit""",
)
def _(x):
    lit = _lit(x)
    out = None
    for style in ("vancouver", "nature", "apa"):
        one = W.format_citation(lit, style).withColumnRenamed("citation", style)
        out = one if out is None else out.join(one, "pmid")
    return out


@query("id_batches", "WITH r AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS batch FROM customer) SELECT batch, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS ids FROM r GROUP BY batch")
def _(x):
    return W.id_batches(x.table("customer"), "c_custkey")


@query("log_recent", "SELECT event_id, op, ok, duration_ms FROM oplog ORDER BY ts DESC, event_id DESC LIMIT 20", ["oplog"])
def _(x):
    return O.log_recent(x.oplog).select("event_id", "op", "ok", "duration_ms")


@query("log_search", """SELECT event_id, op, props FROM oplog WHERE contains(lower(op), 'purch') ORDER BY ts DESC, event_id DESC LIMIT 20""", ["oplog"])
def _(x):
    return O.log_search(x.oplog, "PURCH").select("event_id", "op", "props")


@query("op_usage", "SELECT op, count(*) AS calls, sum(ok::INT)::BIGINT AS succeeded, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM oplog GROUP BY op", ["oplog"])
def _(x):
    return O.op_usage(x.oplog).withColumn("mean_ms", F.round("mean_ms", 6))


@query("op_duration_quantiles", "SELECT op, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM oplog GROUP BY op", ["oplog"])
def _(x):
    return O.op_duration_quantiles(x.oplog).select("op", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("latest_by_signature", "SELECT signature, event_id, op FROM (SELECT * FROM oplog QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ts DESC, event_id DESC) = 1) t ORDER BY ts DESC, event_id DESC LIMIT 50", ["oplog"])
def _(x):
    return O.latest_by_signature(x.oplog).select("signature", "event_id", "op")


@query(
    "failure_fixes",
    """WITH l AS (SELECT *, lag(ok) OVER w AS pok, lag(event_id) OVER w AS pid, lag(op) OVER w AS pop FROM oplog WINDOW w AS (PARTITION BY signature ORDER BY ts, event_id))
    SELECT signature, pid AS failed_id, pop AS failed_op, event_id AS fixed_id, op FROM l WHERE ok AND NOT pok""",
    ["oplog"],
)
def _(x):
    return O.failure_fixes(x.oplog)


@query(
    "code_signatures",
    """SELECT event_id, left(sha256(concat('from Bio import X', event_id)), 16) AS code_hash, concat('Bio :: Bio.', event_type, '.run|', event_type, '.*') AS signature,
    concat('ValueError: bad ', event_type, ' ', user_id) AS error FROM events""",
)
def _(x):
    e = x.table("events")
    code = F.concat(F.lit("from Bio import "), F.col("event_type"), F.lit("\nBio."), F.col("event_type"), F.lit(".run(1)\nBio."), F.col("event_type"), F.lit(".run (2)\n"))
    err = F.concat(F.lit("Traceback (most recent call last):\nKeyError: x\nValueError: bad "), F.col("event_type"), F.lit(" "), F.col("user_id"), F.lit("\n"))
    return e.select("event_id", O.code_hash(F.concat(F.lit("from Bio import X"), F.col("event_id"))).alias("code_hash"), O.code_signature(code).alias("signature"), O.error_signature(err).alias("error"))


@query(
    "usage_by_window",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, op, count(*) AS calls, count(*) FILTER (NOT ok) AS failures, round(avg(duration_ms), 6) AS mean_ms FROM oplog GROUP BY ALL""",
    ["oplog"],
)
def _(x):
    u = usage_by_window(x.oplog)
    return u.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "op", "calls", "failures", F.round("mean_ms", 6).alias("mean_ms"))
