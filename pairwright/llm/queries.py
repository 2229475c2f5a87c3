"""The registered queries of this subpackage: thin wrappers that derive result digests from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import chat, embedding_join, exact_dedup, line_dedup, mixing, ngram_join, packing, substring_dedup, token_counts, toxicity
from pairwright.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two tokenizers after four batches over all documents: insert every document under both; replay that
    batch; revise every word count by an end mark; delete every document that a smaller doc_id repeats exactly."""
    import public_tokenizers as public

    scratch = Scratch(spark, "rollup")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = token_counts.count_tokens(docs, tokenizer_path(), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    counted = counted.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "word_tokens", "byte_tokens")
    counted = scratch.table(counted, "counted")

    def versions(df: DataFrame, end: int, which: tuple[str, ...] = ("word_bpe_49k", "byte_bpe_50k")) -> DataFrame:
        count = {"word_bpe_49k": F.col("word_tokens") + end, "byte_bpe_50k": F.col("byte_tokens")}
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("tokenizer"), count[k].alias("tokens")) for k in which])).alias("v")
        return df.select("source", "lang", each).select("source", "lang", "v.*")

    roll = token_counts.Rollup(spark, scratch.path("rollup"))
    insert = token_counts.deltas(None, versions(counted, 0))
    roll.commit("0001-insert", insert)
    roll.commit("0001-insert", insert)
    roll.commit("0002-revise", token_counts.deltas(versions(counted, 0, ("word_bpe_49k",)), versions(counted, 1, ("word_bpe_49k",))))
    roll.compact()
    first = counted.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    first = scratch.table(first, "first")  # so that both sides of the join are exchanges, whose hot keys can be split
    gone = counted.join(first, "sha").filter("doc_id > first")
    roll.commit("0003-delete", token_counts.deltas(versions(gone, 1), None))
    return roll.totals()


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = chat.format_trees(chat.chain(turns.unionByName(extra)))
    back, loss = chat.read_back(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    made = made.select(F.col("tree_id").alias("conv_id"), "formatted", back.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix_sources, op2_toxicity, op3_lexical_packing, op4_ngram_join, op5_substring_dedup, op6_exact_dedup, op7_line_dedup, op8_token_rollup, op9_chat_format, op10_embedding_join)}

#: White space of the contracts, for DuckDB.
_SP, _WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&#91;'), ']', '&#93;')"

ORACLES: dict[str, str] = {
    "op1_mix_sources": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2.0::DOUBLE AS ceiling,
   (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
 f AS (SELECT *, coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
   sum(w) OVER (ORDER BY ceiling / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM w),
 l AS (SELECT *, max((total - held) / open_w) OVER () AS level FROM f),
 t AS (SELECT source, source_size, least(ceiling, level * w) AS target FROM l),
 r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
   ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op6_exact_dedup": f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SP}', ' ', 'g') AS norm FROM documents),
 g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op7_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 w AS (SELECT doc_id, unnest(range(1, len(ls) - 1)) AS i, ls FROM d WHERE len(ls) >= 3),
 k AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS key FROM w),
 r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM k),
 c AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1),
 l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM d),
 o AS (SELECT l.doc_id, l.line, l.p, c.p IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.p = c.p)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM o GROUP BY doc_id
""",
    "op9_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
 a AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 9)::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
""",
    "op4_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), []) AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
 k AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 l AS (SELECT a AS x, b AS y FROM k UNION ALL SELECT b, a FROM k),
 r(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.low FROM r JOIN l ON l.x = r.id WHERE r.low < l.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(low) AS component_id FROM r GROUP BY id) m USING (doc_id)
""",
    "op5_substring_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 399)) AS i, h FROM d WHERE length(h) >= 800),
 s AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM p),
 f AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
 e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 400 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
 c AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM r GROUP BY doc_id, run),
 o AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM c),
 t AS (SELECT o.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM o JOIN d USING (doc_id) GROUP BY o.doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
""",
    "op10_embedding_join": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 k AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
 l AS (SELECT a AS x, b AS y FROM k UNION ALL SELECT b, a FROM k),
 r(id, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.low FROM r JOIN l ON l.x = r.id WHERE r.low < l.y),
 m AS (SELECT id AS vec_id, min(low) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = m.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m
""",
}
