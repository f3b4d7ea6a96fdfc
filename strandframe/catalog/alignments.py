"""Registered queries on alignments, motifs and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.catalog.base import query
from strandframe.catalog.sequences import CHARS, _kmers_sql
from strandframe.operators import alignment as A
from strandframe.operators import phylogeny as P


def _turn_pairs(x):
    a = x.turns.select((F.col("construct") * 1000 + F.col("ord")).alias("pair_id"), "construct", "ord", F.col("seq").alias("a"))
    b = x.turns.select("construct", (F.col("ord") - 1).alias("ord"), F.col("seq").alias("b"))
    return a.join(b, ["construct", "ord"]).select("pair_id", "a", "b")


@query("pairwise_align")
def _(x):
    return A.pairwise_align(_turn_pairs(x))


@query("local_align")
def _(x):
    return A.pairwise_align(_turn_pairs(x), mode="local")


def _path_code():
    """One number for the whole path: digits 1 (pair), 2 (gap in a), 3 (gap in b) to base 5."""
    kind = lambda x, y: F.when(x == "-", 2).when(y == "-", 3).otherwise(1)
    kinds = F.zip_with(F.split("aligned_a", ""), F.split("aligned_b", ""), kind)
    return F.aggregate(kinds, F.lit(0).cast("long"), lambda code, k: (code * 5 + k) % 2147483629)


_NONE = "{'s': -1e18, 'k': 0::BIGINT, 'e': 0, 'l': 0, 'x': 0, 'y': 0}"


def _align_sql(local: bool) -> str:
    """Recursion over anti-diagonals: score, path code, equal letters, columns and start of the best path into every cell."""
    gap = lambda v, cost, op: f"{{'s': {v}.s - {cost}, 'k': ({v}.k * 5 + {op}) % 2147483629, 'e': {v}.e, 'l': {v}.l + 1, 'x': {v}.x, 'y': {v}.y}}"
    longer = lambda h, g, op: f"CASE WHEN {h} IS NULL THEN {_NONE} WHEN {h}.s - 5 >= {g}.s - 2 THEN {gap(h, 5, op)} ELSE {gap(g, 2, op)} END"
    same = "CASE WHEN a[i] = b[d - i] THEN {} ELSE {} END"
    stop = "WHEN greatest(coalesce(g.s, -1e18), e.s, f.s) <= 0 THEN {'s': 0.0::DOUBLE, 'k': 0::BIGINT, 'e': 0, 'l': 0, 'x': i, 'y': d - i}" if local else ""
    return f"""WITH bare AS (SELECT seq_id, replace(aligned, '-', '') AS s FROM msa),
    pr AS (SELECT x.seq_id AS pair_id, x.s AS a, y.s AS b, length(x.s) AS n, length(y.s) AS m FROM bare x JOIN bare y ON y.seq_id = x.seq_id + 1),
    dp AS (
        SELECT pair_id, 0 AS d, 0 AS i, {_NONE.replace('-1e18', '0.0::DOUBLE')} AS h, {_NONE} AS e, {_NONE} AS f, NULL::STRUCT(s DOUBLE, k BIGINT, e INTEGER, l INTEGER, x INTEGER, y INTEGER) AS p FROM pr
        UNION ALL
        SELECT pair_id, d, i, CASE {stop} WHEN g.s >= greatest(e.s, f.s) THEN g WHEN e.s >= f.s THEN e ELSE f END, e, f, p FROM (
            SELECT q.pair_id, d, i, p, {longer('lh', 'le', 2)} AS e, {longer('uh', 'uf', 3)} AS f,
                CASE WHEN up IS NOT NULL THEN {{'s': up.s + {same.format(2, -1)}, 'k': (up.k * 5 + 1) % 2147483629, 'e': up.e + {same.format(1, 0)}, 'l': up.l + 1, 'x': up.x, 'y': up.y}} END AS g
            FROM (
                SELECT pair_id, d + 1 AS d, i + z AS i, any_value(h) FILTER (z = 0) AS lh, any_value(e) FILTER (z = 0) AS le, any_value(h) FILTER (z = 1) AS uh,
                    any_value(f) FILTER (z = 1) AS uf, any_value(p) FILTER (z = 1) AS up, any_value(h) FILTER (z = 0) AS p
                FROM (SELECT *, unnest([0, 1]) AS z FROM dp) GROUP BY pair_id, d, i + z
            ) q JOIN pr ON pr.pair_id = q.pair_id AND i <= n AND d - i <= m
        ) c
    ),
    best AS (SELECT pair_id, d, i, h, row_number() OVER (PARTITION BY pair_id ORDER BY {'h.s DESC, i, d' if local else 'd DESC'}) AS r FROM dp)
    SELECT pair_id, h.s AS score, h.x AS a_start, i AS a_end, h.y AS b_start, d - i AS b_end, h.e AS matches, h.l AS columns, round(100.0 * h.e / nullif(least(n, m), 0), 4) AS identity_pct,
        h.k AS path_code, true AS texts_agree
    FROM best JOIN pr USING (pair_id) WHERE r = 1"""


def _aligned_rows(x, mode: str):
    bare = x.msa.select("seq_id", F.replace("aligned", F.lit("-"), F.lit("")).alias("s"))
    pairs = bare.select(F.col("seq_id").alias("pair_id"), F.col("s").alias("a")).join(bare.select((F.col("seq_id") - 1).alias("pair_id"), F.col("s").alias("b")), "pair_id")
    found = A.pairwise_align(pairs, mode).join(pairs, "pair_id")
    part = lambda c: F.substring(c, F.col(f"{c}_start") + 1, F.col(f"{c}_end") - F.col(f"{c}_start"))
    agree = [F.replace(f"aligned_{c}", F.lit("-"), F.lit("")) == part(c) for c in "ab"]
    return found.select(
        "pair_id", "score", "a_start", "a_end", "b_start", "b_end", "matches", "columns", F.round("identity_pct", 4).alias("identity_pct"),
        F.when(F.col("columns") == 0, F.lit(0).cast("long")).otherwise(_path_code()).alias("path_code"), (agree[0] & agree[1]).alias("texts_agree"),
    )


@query("align_rows_global", _align_sql(False), ["msa"])
def _(x):
    return _aligned_rows(x, "global")


@query("align_rows_local", _align_sql(True), ["msa"])
def _(x):
    return _aligned_rows(x, "local")


_ROWPAIRS = """rp AS (SELECT a.seq_id AS pair_id, a.aligned AS a, b.aligned AS b FROM msa a JOIN msa b ON b.seq_id = a.seq_id + 1),
    rc AS (SELECT pair_id, unnest(string_split(a, '')) AS a, unnest(string_split(b, '')) AS b, unnest(range(1, length(a) + 1)) AS pos FROM rp)"""


def _row_pairs(x):
    return x.msa.select(F.col("seq_id").alias("pair_id"), F.col("aligned").alias("a")).join(x.msa.select((F.col("seq_id") - 1).alias("pair_id"), F.col("aligned").alias("b")), "pair_id")


@query(
    "identity_percent",
    f"WITH {_ROWPAIRS} SELECT pair_id, round(count(*) FILTER (a = b AND a <> '-') / least(count(*) FILTER (a <> '-'), count(*) FILTER (b <> '-'))::DOUBLE * 100, 2) AS identity_pct FROM rc GROUP BY pair_id",
    ["msa"],
)
def _(x):
    return A.identity_percent(_row_pairs(x))


@query("diff_positions", f"WITH {_ROWPAIRS} SELECT pair_id, pos, a, b FROM rc WHERE a <> b", ["msa"])
def _(x):
    return A.diff_positions(_row_pairs(x))


@query(
    "seed_candidates",
    f"""WITH chars AS (SELECT construct * 1000 + ord AS seq_id, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM turns WHERE length(seq) > 0),
    k AS (SELECT DISTINCT seq_id, kmer FROM ({_kmers_sql(8)}) q), n AS (SELECT seq_id, count(*) AS n FROM k GROUP BY 1)
    SELECT a.seq_id AS query, b.seq_id AS subject, count(*) AS shared, any_value(n.n) AS n_kmers FROM k a JOIN k b USING (kmer) JOIN n ON n.seq_id = a.seq_id GROUP BY a.seq_id, b.seq_id HAVING count(*) >= ceil(any_value(n.n) * 0.5)""",
    ["turns"],
)
def _(x):
    t = x.turns.select((F.col("construct") * 1000 + F.col("ord")).alias("seq_id"), "seq")
    return A.seed_candidates(t, t, k=8, min_share=0.5)


_COLS = """cr AS (SELECT aln_id, seq_id, unnest(string_split(aligned, '')) AS ch, unnest(range(length(aligned))) AS col FROM msa),
    cc AS (SELECT aln_id, col, ch, count(*) AS n, min(seq_id) AS f FROM cr GROUP BY ALL),
    cb AS (SELECT aln_id, col, coalesce(arg_min(ch, (-n, f)) FILTER (ch <> '-'), '-') AS letter, count(*) FILTER (ch <> '-') = 1 AS conserved FROM cc GROUP BY ALL)"""


@query("msa_pssm", f"WITH {_COLS} SELECT aln_id, col, ch, n FROM cc", ["msa"])
def _(x):
    return A.msa_pssm(x.msa)


@query(
    "msa_conservation",
    f"WITH {_COLS} SELECT aln_id, (SELECT count(*) FROM msa m WHERE m.aln_id = cb.aln_id) AS sequences, count(*) AS length, round(count(*) FILTER (conserved) / count(*)::DOUBLE * 100, 2) AS conserved_pct FROM cb GROUP BY aln_id",
    ["msa"],
)
def _(x):
    return A.msa_conservation(x.msa)


@query("msa_consensus", f"WITH {_COLS} SELECT aln_id, string_agg(letter, '' ORDER BY col) AS consensus FROM cb GROUP BY aln_id", ["msa"])
def _(x):
    return A.msa_consensus(x.msa)


_COARSE = "cm AS (SELECT seq_id // 2 AS aln_id, seq_id, translate(aligned, 'ACGT-', 'AAGG-') AS aligned FROM msa)"


@query(
    "conserved_runs",
    f"WITH {_COARSE}, {_COLS.replace('FROM msa', 'FROM cm')}, r AS (SELECT aln_id, col, col - row_number() OVER (PARTITION BY aln_id ORDER BY col) AS g FROM cb WHERE conserved) SELECT aln_id, min(col) + 1 AS start, max(col) + 1 AS \"end\", count(*) AS length FROM r GROUP BY aln_id, g HAVING count(*) >= 5 AND max(col) < 63",
    ["msa"],
)
def _(x):
    coarse = x.msa.select(F.floor(F.col("seq_id") / 2).alias("aln_id"), "seq_id", F.translate("aligned", "ACGT-", "AAGG-").alias("aligned"))
    return A.conserved_runs(coarse, 5)


@query(
    "identity_distance",
    """WITH b AS (SELECT aln_id, seq_id, aligned FROM msa), p AS (SELECT x.aln_id, x.seq_id AS a, y.seq_id AS b, x.aligned AS xa, y.aligned AS ya FROM b x JOIN b y ON x.aln_id = y.aln_id AND x.seq_id < y.seq_id)
    SELECT aln_id, a, b, round(1 - len(list_filter(range(1, 65), lambda i: xa[i] = ya[i])) / 64.0, 6)::DOUBLE AS distance FROM p""",
    ["msa"],
)
def _(x):
    return A.identity_distance(x.msa).withColumn("distance", F.round("distance", 6))


_INST = "inst AS (SELECT aln_id AS motif_id, translate(aligned, '-', 'A') AS instance FROM msa)"
_MOTIF = f"""{_INST}, ic AS (SELECT motif_id, unnest(string_split(instance, '')) AS letter, unnest(range(64)) AS pos FROM inst), mn AS (SELECT motif_id, pos, letter, count(*) AS c FROM ic GROUP BY ALL),
    mf AS (SELECT g.motif_id, g.pos, g.letter, coalesce(c, 0) AS count, (coalesce(c, 0) + 0.5) / (sum(coalesce(c, 0)) OVER (PARTITION BY g.motif_id, g.pos) + 2) AS probability
        FROM (SELECT motif_id, pos, unnest(['A', 'C', 'G', 'T']) AS letter FROM (SELECT DISTINCT motif_id, pos FROM mn) q) g LEFT JOIN mn USING (motif_id, pos, letter))"""


def _instances(x):
    return x.msa.select(F.col("aln_id").alias("motif_id"), F.translate("aligned", "-", "A").alias("instance"))


@query("motif_build", f"WITH {_MOTIF} SELECT motif_id, pos, letter, count, round(probability, 6) AS probability, round(log2(probability / 0.25), 6) AS weight FROM mf", ["msa"])
def _(x):
    m = A.motif_build(_instances(x))
    return m.select("motif_id", "pos", "letter", "count", F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"))


@query("motif_consensus", f"WITH {_MOTIF}, b AS (SELECT motif_id, pos, arg_min(letter, (-count, letter)) AS l FROM mf GROUP BY ALL) SELECT motif_id, string_agg(l, '' ORDER BY pos) AS consensus FROM b GROUP BY motif_id", ["msa"])
def _(x):
    return A.motif_consensus(A.motif_build(_instances(x)))


@query("motif_reverse_complement", f"WITH {_MOTIF} SELECT motif_id, 63 - pos AS pos, translate(letter, 'ACGT', 'TGCA') AS letter, count FROM mf", ["msa"])
def _(x):
    return A.motif_reverse_complement(A.motif_build(_instances(x))).select("motif_id", "pos", "letter", "count")


#: All 64 columns of every motif, on the ungapped rows of the alignments.
_LEAST = 12.0


@query(
    "motif_scan",
    f"""WITH {_MOTIF}, m AS (SELECT motif_id, pos AS p, letter, log2(probability / 0.25) AS w FROM mf), bs AS (SELECT seq_id, repeat(replace(aligned, '-', ''), 3) AS seq FROM msa),
    ch AS (SELECT seq_id, unnest(string_split(seq, '')) AS ch, unnest(range(length(seq))) AS pos FROM bs),
    both2 AS (SELECT motif_id, '+' AS strand, p, letter, w FROM m UNION ALL SELECT motif_id, '-', 63 - p, translate(letter, 'ACGT', 'TGCA'), w FROM m),
    s AS (SELECT motif_id, seq_id, strand, pos - p AS pos, sum(w) AS s, count(*) AS n FROM ch JOIN both2 ON ch = letter GROUP BY ALL)
    SELECT motif_id, seq_id, pos, strand, round(s, 2) AS score FROM s WHERE n = 64 AND pos >= 0 AND s >= {_LEAST}""",
    ["msa"],
)
def _(x):
    bare = x.msa.select("seq_id", F.expr("repeat(replace(aligned, '-', ''), 3)").alias("seq"))
    return A.motif_scan(bare, A.motif_build(_instances(x)), _LEAST, both_strands=True)


@query(
    "near_rows",
    """WITH b AS (SELECT label AS aln_id, vec_id AS seq_id, array_to_string(list_transform(embedding, lambda v: CASE WHEN v::DOUBLE < 0 THEN 'A' ELSE 'G' END), '') AS aligned FROM embeddings),
    p AS (SELECT x.aln_id, x.seq_id AS a, y.seq_id AS b, len(list_filter(range(1, 65), lambda i: x.aligned[i] = y.aligned[i])) AS same FROM b x JOIN b y ON x.aln_id = y.aln_id AND x.seq_id < y.seq_id)
    SELECT aln_id, a, b, round(1 - same / 64.0, 6)::DOUBLE AS distance FROM p WHERE 1 - same / 64.0 <= 0.3""",
)
def _(x):
    signs = F.array_join(F.transform("embedding", lambda v: F.when(v < 0, "A").otherwise("G")), "")
    rows = x.table("embeddings").select(F.col("label").alias("aln_id"), F.col("vec_id").alias("seq_id"), signs.alias("aligned"))
    return A.near_rows(rows, 0.3).withColumn("distance", F.round("distance", 6))


@query("terminals", "SELECT t1.child AS leaf, blen FROM tree t1 WHERE NOT EXISTS (SELECT 1 FROM tree p WHERE p.parent = t1.child)", ["tree"])
def _(x):
    return P.terminals(x.tree).select(F.col("child").alias("leaf"), "blen")


@query("tree_length", "SELECT tree_id, round(sum(blen), 6) AS total_length, count(*) AS n_edges FROM tree GROUP BY tree_id", ["tree"])
def _(x):
    return P.tree_length(x.tree).withColumn("total_length", F.round("total_length", 6))


_DEPTH = """dp AS (SELECT 'root' AS node, 0 AS level, 0.0::DOUBLE AS depth UNION ALL SELECT child, level + 1, depth + blen FROM tree JOIN dp ON parent = node)"""


@query("tree_depths", f"WITH {_DEPTH} SELECT node, level, round(depth, 6) AS depth FROM dp", ["tree"])
def _(x):
    return P.tree_depths(x.tree).select("node", "level", F.round("depth", 6).alias("depth"))


_ANC = f"""{_DEPTH}, an AS (SELECT child AS node, child AS anc FROM tree UNION ALL SELECT node, parent FROM an JOIN tree ON child = anc),
    pr AS (SELECT concat('c', o_custkey) AS a, concat('c', (o_custkey + o_orderkey) % (SELECT count(*) FROM customer)) AS b FROM orders)"""


@query(
    "patristic_distance",
    f"""WITH {_ANC}, u AS (SELECT DISTINCT a, b FROM pr WHERE a <> b), c AS (SELECT u.a, u.b, x.anc, d.depth AS dm, d.level FROM u JOIN an x ON x.node = a JOIN an y ON y.node = b AND y.anc = x.anc JOIN dp d ON d.node = x.anc),
    m AS (SELECT a, b, arg_max(anc, level) AS mrca, max(dm) AS dm FROM c GROUP BY ALL)
    SELECT a, b, mrca, round(p.depth + q.depth - 2 * dm, 6) AS distance FROM m JOIN dp p ON p.node = a JOIN dp q ON q.node = b""",
    ["tree"],
)
def _(x):
    n = x.table("customer").agg(F.count(F.lit(1)).alias("n"))
    o = x.table("orders").join(F.broadcast(n), F.lit(True))
    pairs = o.select(F.lit("t1").alias("tree_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("a"), F.concat(F.lit("c"), (F.col("o_custkey") + F.col("o_orderkey")) % F.col("n")).alias("b")).where("a <> b").distinct()
    return P.patristic_distance(x.tree, pairs).select("a", "b", "mrca", F.round("distance", 6).alias("distance"))


@query(
    "prune_tree",
    """WITH k AS (SELECT concat('c', c_custkey) AS leaf FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 12 AND c_acctbal > 8500),
    up AS (SELECT leaf AS node FROM k UNION SELECT parent FROM tree JOIN up ON child = node), e AS (SELECT child, parent, blen FROM tree WHERE child IN (SELECT node FROM up)),
    deg AS (SELECT parent, count(*) AS n FROM e GROUP BY parent), keepn AS (SELECT DISTINCT child AS node FROM e WHERE child IN (SELECT leaf FROM k) UNION SELECT parent FROM deg WHERE n > 1 UNION SELECT 'root'),
    w AS (SELECT child, parent AS up_to, blen FROM e WHERE child IN (SELECT node FROM keepn) UNION ALL SELECT w.child, e.parent, w.blen + e.blen FROM w JOIN e ON e.child = w.up_to WHERE w.up_to NOT IN (SELECT node FROM keepn))
    SELECT child, up_to AS parent, round(blen, 6) AS blen FROM w WHERE up_to IN (SELECT node FROM keepn)""",
    ["tree"],
)
def _(x):
    keep = x.table("customer").where("c_mktsegment = 'BUILDING' AND c_nationkey < 12 AND c_acctbal > 8500").select(F.lit("t1").alias("tree_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    return P.prune(x.tree, keep).select("child", "parent", F.round("blen", 6).alias("blen"))


@query(
    "reroot_tree",
    """WITH pa AS (SELECT 'n7' AS node UNION ALL SELECT parent FROM tree JOIN pa ON child = node)
    SELECT CASE WHEN child IN (SELECT node FROM pa) THEN parent ELSE child END AS child, CASE WHEN child IN (SELECT node FROM pa) THEN child ELSE parent END AS parent, blen FROM tree""",
    ["tree"],
)
def _(x):
    return P.reroot(x.tree, "n7").select("child", "parent", "blen")


@query(
    "midpoint_reroot",
    f"""WITH {_DEPTH}, an AS (SELECT child AS node, child AS anc FROM tree UNION ALL SELECT node, parent FROM an JOIN tree ON child = anc),
    lv AS (SELECT node, depth FROM dp WHERE node NOT IN (SELECT parent FROM tree)), a AS (SELECT node, depth AS da FROM lv ORDER BY depth DESC, node LIMIT 1),
    pa AS (SELECT anc FROM an JOIN a USING (node)),
    m AS (SELECT lv.node, lv.depth, arg_max(an.anc, dp.level) AS m, max(dp.depth) AS dm FROM lv JOIN an USING (node) JOIN dp ON dp.node = an.anc WHERE an.anc IN (SELECT anc FROM pa) GROUP BY ALL),
    e AS (SELECT m.node AS b, a.node AS a, da - dm AS la, m.depth - dm AS lb, dm FROM m, a WHERE m.node <> a.node ORDER BY da + m.depth - 2 * dm DESC, m.node LIMIT 1),
    sp AS (SELECT CASE WHEN la >= lb THEN a ELSE b END AS node, dm + greatest(la, lb) - (la + lb) / 2 AS mid FROM e),
    ct AS (SELECT child, parent, c.depth - mid AS below, mid - p.depth AS above FROM tree JOIN dp c ON c.node = child JOIN dp p ON p.node = parent, sp
        WHERE child IN (SELECT anc FROM an WHERE node = sp.node) AND p.depth <= mid AND mid < c.depth),
    gr AS (SELECT child, parent, blen FROM tree WHERE child NOT IN (SELECT child FROM ct WHERE above > 0) UNION ALL SELECT child, 'midpoint', below FROM ct WHERE above > 0
        UNION ALL SELECT 'midpoint', parent, above FROM ct WHERE above > 0),
    tp AS (SELECT CASE WHEN above > 0 THEN 'midpoint' ELSE parent END AS node FROM ct UNION ALL SELECT parent FROM gr JOIN tp ON child = node),
    tu AS (SELECT CASE WHEN child IN (SELECT node FROM tp) THEN parent ELSE child END AS child, CASE WHEN child IN (SELECT node FROM tp) THEN child ELSE parent END AS parent, blen FROM gr),
    un AS (SELECT u.child AS low, t.parent AS high, u.blen + t.blen AS blen FROM tu t JOIN (SELECT parent, min(child) AS child, min(blen) AS blen FROM tu GROUP BY parent HAVING count(*) = 1) u ON u.parent = t.child WHERE t.child = 'root')
    SELECT child, parent, round(blen, 6) AS blen FROM tu WHERE child NOT IN (SELECT low FROM un UNION ALL SELECT 'root' FROM un) UNION ALL SELECT low, high, round(blen, 6) FROM un""",
    ["tree"],
)
def _(x):
    return P.midpoint_reroot(x.tree).select("child", "parent", F.round("blen", 6).alias("blen"))


@query(
    "longest_path",
    f"""WITH {_DEPTH}, an AS (SELECT child AS node, child AS anc FROM tree UNION ALL SELECT node, parent FROM an JOIN tree ON child = anc),
    lv AS (SELECT node, depth FROM dp WHERE node NOT IN (SELECT parent FROM tree)), a AS (SELECT node, depth AS da FROM lv ORDER BY depth DESC, node LIMIT 1),
    m AS (SELECT lv.node, lv.depth, max(dp.depth) AS dm FROM lv JOIN an USING (node) JOIN dp ON dp.node = an.anc WHERE an.anc IN (SELECT anc FROM an JOIN a USING (node)) GROUP BY ALL)
    SELECT a.node AS a, m.node AS b, round((da + m.depth - 2 * dm) / 2, 6) AS half_distance FROM m, a WHERE m.node <> a.node ORDER BY da + m.depth - 2 * dm DESC, m.node LIMIT 1""",
    ["tree"],
)
def _(x):
    return P.midpoint_node(x.tree).select("a", "b", F.round("half_distance", 6).alias("half_distance"))
