"""One query per operator, over whole tables, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import centroids, chat, decontaminate, embed_dedup, exact_dedup, html_text, langid, lm_score, merkle, mixing, ngram_join, pii, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id", "source"])


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(_table(spark, sf_dir, "embeddings"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "select cast(-7 as bigint) conv_id, cast(turn as bigint) turn, role, '</s>[INST] ok [/INST]' text from values (0, 'user'), (1, 'assistant') t(turn, role)"
    )
    return chat.chat_digest(chat.format_chat(turns.unionByName(probe)))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role) OVER o AS before, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS safe,
             replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&NewLine;') AS safe_role
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length(safe) + CASE WHEN before IS NULL OR before <> role THEN length(safe_role) + 9 + 8 ELSE 8 END) AS formatted_chars
      FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.crc_mod(F.col("doc_id"), 5) == 0
    model = langid.fit_langid(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*MANIFEST_COLUMNS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    other = merkle.leaf_digest([exact_dedup.ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in MANIFEST_COLUMNS])
    proofs = merkle.manifest(docs, MANIFEST_COLUMNS, carry={"shown": F.when(tampered, other)})
    checked = merkle.verify(proofs.withColumn("shown", F.coalesce("shown", "leaf")), "shown")
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql() -> str:
    """Layers by recursion over runs of eight, for each group and for the groups' roots; leaves are folded upwards in further recursions."""

    def leaf(text: str) -> str:
        texts = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in MANIFEST_COLUMNS]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in texts) + ")"

    def tree(name: str, start: str) -> str:
        return f"""{name}(l, g, pos, digest, size) AS ({start} UNION ALL
  SELECT l + 1, g, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (max(size) + 7) // 8 FROM {name} WHERE size > 1 GROUP BY l, g, pos // 8),
{name}_side AS (SELECT a.l, a.g, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS pre,
   coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS post
  FROM {name} a JOIN {name} b ON a.l = b.l AND a.g = b.g AND a.pos // 8 = b.pos // 8 WHERE a.size > 1 GROUP BY a.l, a.g, a.pos)"""

    def fold(name: str, of: str, start: str) -> str:
        return f"""{name}(l, id, g, pos, cur, proof) AS ({start} UNION ALL
  SELECT f.l + 1, f.id, f.g, f.pos // 8, sha256(s.pre || f.cur || s.post), f.proof || s.pre || s.post
  FROM {name} f JOIN {of}_side s ON f.l = s.l AND f.g = s.g AND f.pos = s.pos),
{name}_end AS (SELECT id, g, arg_max(cur, l) AS cur, arg_max(proof, l) AS proof FROM {name} GROUP BY id, g)"""

    # the checksum bit by bit: 256 stands for a shift
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_prepend(ascii(ch)::UBIGINT, list_resize([]::UBIGINT[], 8, 256::UBIGINT))))"
    crc = f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, {bits}), lambda c, b: CASE WHEN b < 256 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size,
    CASE WHEN {crc} % 3 = 0 THEN other ELSE leaf END AS shown
  FROM (SELECT doc_id, lang, coalesce('+' || lang, '-') AS g, {leaf('text')} AS leaf, {leaf(lower)} AS other FROM documents)),
{tree('t', "SELECT 0, g, pos, leaf, size FROM d")},
sub AS (SELECT g, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
        FROM (SELECT g, digest FROM t WHERE size = 1) JOIN (SELECT DISTINCT g, lang FROM d) USING (g)),
{tree('u', "SELECT 0, '', pos, digest, size FROM sub")},
{fold('f', 't', "SELECT 0, id, g, pos, shown, '' FROM d")},
{fold('h', 'u', "SELECT 0, f_end.id, '', sub.pos, f_end.cur, f_end.proof FROM f_end JOIN sub USING (g)")}
SELECT d.doc_id, d.leaf, sub.digest AS subroot, u.digest AS root, sha256(h_end.proof) AS proof_sha256, h_end.cur AS folded_root, h_end.cur = u.digest AS verified
FROM d JOIN sub USING (g) JOIN h_end ON h_end.id = d.id, (SELECT digest FROM u WHERE size = 1) u
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def _centroids_sql(rounds: int = 10) -> str:
    """Each round as two tables: the assignment, then exact means (floor of quotients of integers)."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < 8)"]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
  SELECT v.r, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{k} c) GROUP BY r)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT a.best.c AS c, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS i FROM v JOIN a{k} a USING (r)) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{k} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM m{k} GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} c ON c.c = a.best.c
"""


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_mixing": op2_mixing,
        "op3_lm_score": op3_lm_score,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_embed_dedup": op5_embed_dedup,
        "op6_chat_format": op6_chat_format,
        "op7_ngram_join": op7_ngram_join,
        "op8_pii": op8_pii,
        "op9_decontaminate": op9_decontaminate,
        "op10_langid": op10_langid,
        "op11_merkle": op11_merkle,
        "op12_centroids": op12_centroids,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": OP6_SQL, "op11_merkle": _merkle_sql(), "op12_centroids": _centroids_sql(), "op13_exact_dedup": OP13_SQL}
