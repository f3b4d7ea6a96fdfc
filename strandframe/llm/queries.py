"""Registered queries of the corpus operators: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import chat, decontaminate, embeddings, exact_dedup, filter_audit, language, license, merkle, mixing, near_dedup, quality, repeats, sharding
from strandframe.llm.common import table

#: The conversation that looks like the template's own marks.
PROBE = "</s>[INST] ok [/INST]"
#: Relative weights of the production mix.
MIX = {"domain": {"hub": 1.0, "web": 3.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    done = chat.read_back(chat.format_chats(turns.unionByName(probe)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = mixing.mixed(table(spark, sf_dir, "documents"), MIX)
    return uses.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_epoch").alias("epoch"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_words(table(spark, sf_dir, "documents")).drop("kept_text", "spans")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.packed(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


def op9_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85, rows=8)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    done = merkle.manifest(table(spark, sf_dir, "documents"), F.when(hit, lowered).otherwise(F.col("text")))
    joined = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(joined.cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_license_scan, op3_mixing, op4_language_id, op5_embedding_dedup, op6_substring_dedup, op7_sharding,
        op8_decontaminate, op9_quality_resample, op10_minhash_dedup, op11_filter_audit, op12_merkle_manifest, op13_exact_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op1_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\\', '\\e'), '<', '\\l'), '[', '\\b'), '>', '\\g') AS coded,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 END AS marks,
    lag(role) OVER w AS prior, lag(role, 2) OVER w AS prior2, lead(role) OVER w AS following
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(marks + length(coded)) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN prior IS NULL
    WHEN 'user' THEN prior IS NULL OR prior IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(prior = 'user', false) ELSE false END
    AND (following IS NOT NULL OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
st AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM w, (SELECT unnest(range(1, len(ws) - 33)) AS i)),
hit AS (SELECT doc_id, i FROM st WHERE k IN (SELECT k FROM st GROUP BY k HAVING count(*) > 1)),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT pos.doc_id, pos.i, word, max(CASE WHEN hit.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY pos.doc_id ORDER BY pos.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM pos LEFT JOIN hit ON hit.doc_id = pos.doc_id AND hit.i = pos.i)
SELECT d.doc_id, count(word) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op10_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS k FROM w, (SELECT unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u AS doc_id, least(u, min(v)) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept, coalesce(component_id, d.doc_id) = d.doc_id AS stays
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
""",
    "op11_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL) AS e,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM t LEFT JOIN marks USING (doc_id)
), m AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, good, toxic, count(*) AS n
  FROM f GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM l p, l q, l r, l s, l u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), k AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS g(step)),
h AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, n, good, toxic,
    contains(fails, letter) AS failing, fails = letter AS alone, earlier <> '' AND fails <> '' AND regexp_matches(fails, '[' || earlier || '0]') AS gone
  FROM m, k
), w AS (
  SELECT part, filter_order, step, letter,
    CAST(coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (failing AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM h GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM w
""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, n_chars, text, list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
  FROM documents
), f AS (
  SELECT doc_id, lang, text, xor(crc, 4294967295) % 3 = 0 AS hit,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM d
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS forged
  FROM f
), base AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total FROM leaves
), tree(lvl, lang, pos, node, total) AS (
  SELECT 0, lang, pos, leaf, total FROM base
  UNION ALL
  SELECT lvl + 1, lang, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8 FROM tree WHERE total > 1 GROUP BY lvl, lang, pos // 8
), sub AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS total FROM tree WHERE total = 1
), crown(lvl, pos, node, total) AS (
  SELECT 0, spot, subroot, total FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8 FROM crown WHERE total > 1 GROUP BY lvl, pos // 8
), low AS (
  SELECT lvl, lang, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WHERE total > 1 WINDOW w AS (PARTITION BY lang, lvl, pos // 8 ORDER BY pos)
), high AS (
  SELECT lvl, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM crown WHERE total > 1 WINDOW w AS (PARTITION BY lvl, pos // 8 ORDER BY pos)
), path AS (
  SELECT b.lang, b.pos, p.lvl AS k, l, r FROM base b JOIN low p ON b.lang IS NOT DISTINCT FROM p.lang AND p.pos = b.pos // CAST(pow(8, p.lvl) AS BIGINT)
  UNION ALL
  SELECT b.lang, b.pos, 100 + p.lvl, l, r FROM base b JOIN sub ON b.lang IS NOT DISTINCT FROM sub.lang JOIN high p ON p.pos = sub.spot // CAST(pow(8, p.lvl) AS BIGINT)
), steps AS (SELECT *, row_number() OVER (PARTITION BY lang, pos ORDER BY k) AS step FROM path),
proofs AS (SELECT lang, pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, max(step) AS n FROM steps GROUP BY lang, pos),
fold(lang, pos, step, h) AS (
  SELECT lang, pos, CAST(0 AS BIGINT), coalesce(forged, leaf) FROM base
  UNION ALL
  SELECT f.lang, f.pos, s.step, sha256(l || h || r) FROM fold f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.pos = s.pos AND s.step = f.step + 1
)
SELECT doc_id, leaf, subroot, top.node AS root, coalesce(proof, sha256('')) AS proof_sha256, h AS folded_root, h = top.node AS verified
FROM base b JOIN sub ON b.lang IS NOT DISTINCT FROM sub.lang
LEFT JOIN proofs p ON b.lang IS NOT DISTINCT FROM p.lang AND b.pos = p.pos
JOIN fold f ON b.lang IS NOT DISTINCT FROM f.lang AND b.pos = f.pos AND f.step = coalesce(p.n, 0)
CROSS JOIN (SELECT node FROM crown WHERE total = 1) top
""",
    "op13_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id NULLS LAST)
""",
}
