"""Registered queries on primers, assemblies and plasmids."""

from __future__ import annotations

from strandframe.catalog.base import query
from strandframe.catalog.sequences import _NN, GC
from strandframe.operators import design

_TM = """round(1000 * (h{i} + a{i} * 2.3 + (2 - a{i}) * 0.1) / (s{i} + a{i} * 4.1 - (2 - a{i}) * 2.8 + 0.368 * (ln - 1) * ln(0.05) + 1.987 * ln(12.5e-9)) - 273.15, 9)"""


@query(
    "primer_pairs",
    f"""WITH nn(pair, dh, ds) AS (VALUES {_NN}), b AS (SELECT seq_id, seq, length(seq) AS n FROM seqs WHERE length(seq) > 25),
    st AS (SELECT seq_id, seq, n, unnest(range(0, least(50, n - 25))) AS st FROM b), c0 AS (SELECT *, unnest(range(18, 26)) AS ln FROM st), c1 AS (SELECT *, least(st + 500, n) - ln AS rs FROM c0),
    c AS (SELECT seq_id, st, ln, rs, substr(seq, st + 1, ln) AS f, reverse(translate(substr(seq, rs + 1, ln), 'ACGT', 'TGCA')) AS r FROM c1 WHERE rs >= st + ln),
    u AS (SELECT DISTINCT f AS p FROM c UNION SELECT DISTINCT r FROM c), up AS (SELECT p, substr(p, i, 2) AS pair FROM (SELECT p, unnest(range(1, length(p))) AS i FROM u) q),
    e AS (SELECT p, sum(dh) AS h, sum(ds) AS s, (p[1] IN ('A', 'T'))::INT + (p[-1] IN ('A', 'T'))::INT AS a, {GC.replace('seq', 'p')} / length(p)::DOUBLE * 100 AS g FROM up JOIN nn USING (pair) GROUP BY p),
    j AS (SELECT c.*, x.h AS h1, x.s AS s1, x.a AS a1, x.g AS g1, y.h AS h2, y.s AS s2, y.a AS a2, y.g AS g2 FROM c JOIN e x ON x.p = f JOIN e y ON y.p = r),
    t AS (SELECT *, {_TM.format(i=1)} AS t1, {_TM.format(i=2)} AS t2 FROM j),
    k AS (SELECT *, round(greatest(0, 10 - abs(t1 - t2)) + greatest(0, 10 - abs(g1 - g2)) + greatest(0, 10 - abs(ln - 20)), 2) AS score FROM t WHERE abs(t1 - t2) < 5 AND abs(g1 - g2) < 10),
    z AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, st, ln) AS rank, count(*) OVER (PARTITION BY seq_id) AS n_candidates FROM k)
    SELECT seq_id, rank, f AS forward, r AS reverse, round(t1, 1) AS fwd_tm, round(t2, 1) AS rev_tm, round(g1, 1) AS fwd_gc, round(g2, 1) AS rev_gc, ln AS length, rs - st + ln AS product_size,
    st AS fwd_position, rs AS rev_position, score, n_candidates FROM z WHERE rank <= 5""",
    ["seqs"],
)
def _(x):
    return design.primer_pairs(x.seqs)


@query(
    "assembly_plan",
    """WITH c AS (SELECT construct, count(*) AS n_fragments, sum(length(seq))::BIGINT AS total_length FROM turns GROUP BY construct HAVING count(*) >= 2)
    SELECT *, CASE WHEN total_length < 15000 AND n_fragments <= 6 THEN 'gibson' WHEN n_fragments > 6 THEN 'golden_gate' ELSE 'restriction' END AS method FROM c""",
    ["turns"],
)
def _(x):
    return design.assembly_plan(x.turns)


@query("fragment_summary", f"SELECT construct, ord, length(seq) AS length, CASE WHEN length(seq) > 0 THEN round({GC} / length(seq)::DOUBLE * 100, 1) ELSE 0 END AS gc, left(seq, 30) || CASE WHEN length(seq) > 30 THEN '...' ELSE '' END AS preview FROM turns", ["turns"])
def _(x):
    return design.fragment_summary(x.turns)


_NEXT = "n AS (SELECT *, lead(ord) OVER (PARTITION BY construct ORDER BY ord) AS nx FROM turns)"


@query("gibson_overlaps", f"WITH {_NEXT} SELECT construct, ord AS junction, 20 AS overlap_length, right(seq, 20) AS overlap FROM n WHERE nx IS NOT NULL", ["turns"])
def _(x):
    return design.gibson_overlaps(x.turns)


_LONG = "n AS (SELECT *, lead(ord) OVER (PARTITION BY construct ORDER BY ord) AS nx FROM turns WHERE length(seq) > 150)"


@query("gibson_overlaps_gaps", f"WITH {_LONG} SELECT construct, ord AS junction, 20 AS overlap_length, right(seq, 20) AS overlap FROM n WHERE nx IS NOT NULL", ["turns"])
def _(x):
    """Fragments of some length only, so that numbers are left out between them."""
    return design.gibson_overlaps(x.turns.where("length(seq) > 150"))


@query(
    "golden_gate_overhangs",
    f"""WITH {_NEXT}, o AS (SELECT construct, ord AS junction, CASE WHEN length(seq) >= 4 THEN right(seq, 4) ELSE 'NNNN' END AS overhang FROM n WHERE nx IS NOT NULL)
    SELECT *, count(*) OVER (PARTITION BY construct, overhang) > 1 AS duplicated FROM o""",
    ["turns"],
)
def _(x):
    return design.golden_gate_overhangs(x.turns)


@query(
    "feature_map_summary",
    """WITH p AS (SELECT plasmid_id, max(fend) AS size, count(*) AS n_features, sum(fend - fstart)::BIGINT AS feature_bp FROM features GROUP BY plasmid_id)
    SELECT *, size - feature_bp AS unannotated_bp, round((size - feature_bp) / size::DOUBLE * 100, 1) AS unannotated_pct FROM p""",
    ["features"],
)
def _(x):
    return design.feature_map_summary(x.features)


@query(
    "feature_map_text",
    """WITH l AS (SELECT plasmid_id, fstart, name, printf('%6d..%-6d %s %s (%s, %dbp)', fstart, fend, CASE WHEN direction = '+' THEN '->' ELSE '<-' END, name, ftype, fend - fstart) AS line FROM features)
    SELECT plasmid_id, string_agg(line, chr(10) ORDER BY fstart, name, line) AS map_text FROM l GROUP BY plasmid_id""",
    ["features"],
)
def _(x):
    return design.feature_map_text(x.features)
