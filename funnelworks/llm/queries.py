"""Registered queries of the corpus operators, with SQL oracles where SQL expresses them.

Every query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.chat_format import format_chats, log_of, read_back
from funnelworks.llm.common import table
from funnelworks.llm.conversation_repair import damage, repair
from funnelworks.llm.decontamination import contaminated
from funnelworks.llm.hilbert_sharding import hilbert_shards
from funnelworks.llm.html_extraction import extract_text
from funnelworks.llm.jaccard_join import similarity_classes
from funnelworks.llm.line_dedup import dedup_lines
from funnelworks.llm.lm_scoring import score_documents
from funnelworks.llm.mixing import mix_sources
from funnelworks.llm.token_output import encode_corpus, read_checksums
from funnelworks.llm.topk_search import top_k
from funnelworks.llm.toxicity import score_toxicity
from funnelworks.llm.vector_codes import encode_vectors
from funnelworks.session import shared_path


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file on this machine (the same on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    encode_corpus(table(spark, sf_dir, "documents"), tokenizer_file(), path)
    return read_checksums(spark, path)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


# A conversation whose texts hold the template's control strings.
TRICKY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(log_of(rows.unionByName(spark.createDataFrame(TRICKY, rows.schema))))
    return read_back(chats).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hilbert_sharding,
        op2_html_extraction,
        op3_line_dedup,
        op4_source_mixing,
        op5_topk_search,
        op6_token_output,
        op7_benchmark_decontamination,
        op8_ngram_jaccard_join,
        op9_lm_scoring,
        op10_toxicity,
        op11_conversation_repair,
        op12_vector_codes,
        op13_chat_formatting,
        pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        repeated AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        marked AS (
            SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> r.first, false) AS dropped
            FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op4_source_mixing": r"""
        WITH docs AS (
            SELECT doc_id, coalesce('s' || source, 't') AS key,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 12) AS BIGINT) AS place
            FROM documents),
        sizes AS (
            SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS BIGINT) AS w
            FROM docs GROUP BY key),
        levels AS (
            SELECT *, CAST(sum(source_size) OVER () - (sum(3 * source_size) OVER up - 3 * source_size) AS DOUBLE)
                      / CAST(sum(w) OVER down AS DOUBLE) AS level
            FROM sizes
            WINDOW up AS (ORDER BY (3 * source_size) / CAST(w AS DOUBLE), key ROWS UNBOUNDED PRECEDING),
                   down AS (ORDER BY (3 * source_size) / CAST(w AS DOUBLE), key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        targets AS (
            SELECT key, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * w) AS target FROM levels),
        budgets AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM targets),
        places AS (
            SELECT key, place, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY key ORDER BY place) AS up_to
            FROM docs GROUP BY key, place),
        extra AS (
            SELECT p.key, p.place,
                   CASE WHEN up_to <= target - repeats * source_size THEN 1
                        WHEN up_to - words <= target - repeats * source_size
                             AND 2 * (target - repeats * source_size - (up_to - words)) >= words THEN 1
                        ELSE 0 END AS more
            FROM places p JOIN budgets b ON p.key = b.key)
        SELECT doc_id, size, source_size, target, CAST(size * (repeats + more) AS BIGINT) AS taken
        FROM docs JOIN budgets USING (key) JOIN extra USING (key, place)
    """,
    "op5_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE bits AS (
            SELECT list(v ORDER BY b) AS t FROM (
                SELECT b, list_reduce(list_concat([b], range(8)),
                       lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
                FROM range(256) r(b))),
        marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
            FROM conversations),
        kinds AS (
            SELECT m.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind
            FROM marked m, bits),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM damaged),
        faults AS (
            SELECT *, left(role, 1) AS init, bare = '' AS blank,
                   bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
            FROM placed),
        judged AS (
            SELECT *, NOT blank AND NOT duplicate AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
                   before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au') AS illegal
            FROM faults),
        gaps(s, t, ins, made) AS (
            VALUES (0, 0, '', ''), (0, 2, 'I', 'user:'), (0, 3, 'II', 'user:' || chr(10) || 'assistant:'),
                   (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
                   (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (2, 2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'),
                   (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:'), (3, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        edits(s, t, letter, cost, init, given) AS (
            VALUES (0, 0, 'D', 4, NULL, NULL), (1, 1, 'D', 4, NULL, NULL), (2, 2, 'D', 4, NULL, NULL), (3, 3, 'D', 4, NULL, NULL),
                   (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL),
                   (0, 2, 'R', 3, NULL, 'user'), (1, 2, 'R', 3, NULL, 'user'), (2, 3, 'R', 3, NULL, 'assistant'), (3, 2, 'R', 3, NULL, 'user')),
        ways AS (
            SELECT g.s, g.ins || e.letter AS letters, 3 * length(ins) + e.cost AS cost, e.letter, e.init, e.given, e.t, g.t AS mid, made
            FROM gaps g JOIN edits e ON e.s = g.t),
        -- cost, audit and repaired text as one string whose least is the best
        paths AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, '000000000' || chr(1) AS best FROM conversations
            UNION ALL
            SELECT p.conv_id, r.pos, w.t AS state,
                   min(lpad(CAST(CAST(left(best, 9) AS INT) + w.cost + CASE WHEN r.truncated AND w.letter <> 'D' THEN 3 ELSE 0 END AS VARCHAR), 9, '0')
                       || substr(best, 10, instr(best, chr(1)) - 10) || w.letters || substr(best, instr(best, chr(1))) || w.made
                       || CASE WHEN w.letter = 'D' THEN ''
                               ELSE CASE WHEN w.mid = 0 THEN '' ELSE chr(10) END || coalesce(w.given, r.role) || ':' || r.text END) AS best
            FROM paths p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos + 1
            JOIN ways w ON w.s = p.state AND (w.letter = 'D' OR NOT (r.blank OR r.duplicate)) AND (w.init IS NULL OR w.init = r.init)
            GROUP BY p.conv_id, r.pos, w.t),
        counts AS (
            SELECT c.conv_id, count(j.pos) AS n,
                   CAST(coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0) AS BIGINT) AS gaps,
                   count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
                   count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id
            GROUP BY c.conv_id),
        ends AS (
            SELECT c.conv_id, min(lpad(CAST(CAST(left(best, 9) AS INT) + 3 * length(ins) AS VARCHAR), 9, '0')
                   || substr(best, 10, instr(best, chr(1)) - 10) || ins || substr(best, instr(best, chr(1))) || made) AS best
            FROM counts c JOIN paths p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.pos = c.n
            JOIN gaps g ON g.s = p.state AND g.t IN (0, 3) GROUP BY c.conv_id)
        SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(left(best, 9) AS BIGINT) AS cost,
               substr(best, 10, instr(best, chr(1)) - 10) AS audit, sha256(substr(best, instr(best, chr(1)) + 1)) AS repaired_sha256
        FROM counts c JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
    "op12_vector_codes": r"""
        WITH RECURSIVE kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS (
            SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM kept, range(16) r(p)),
        books AS (
            SELECT 0 AS round, p, e, v FROM (
                SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 64
            UNION ALL
            SELECT b.round + 1, b.p, b.e, coalesce(m.v, b.v)
            FROM books b LEFT JOIN (
                SELECT p, e, list(mean ORDER BY i) AS v FROM (
                    SELECT p, e, i, CAST(floor(sum(v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS mean
                    FROM (SELECT s.p, s.v, arg_min(o.e, {d: list_sum(list_transform(list_zip(s.v, o.v), lambda z: (z[1] - z[2]) ** 2)), e: o.e}) AS e
                          FROM parts s JOIN books o ON o.p = s.p GROUP BY s.vec_id, s.p, s.v) a,
                         (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) n
                    GROUP BY p, e, i)
                GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
            WHERE b.round < 2),
        final AS (SELECT p, e, v FROM books WHERE round = 2),
        coded AS (
            SELECT vec_id, p, min({d: list_sum(list_transform(list_zip(s.v, o.v), lambda z: (z[1] - z[2]) ** 2)), e: o.e}) AS best
            FROM parts s JOIN final o USING (p) GROUP BY vec_id, p),
        codes AS (
            SELECT vec_id, string_agg(printf('%02x', CAST(best.e AS INT)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
            FROM coded GROUP BY vec_id)
        SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM final) AS codebooks_sha256
        FROM codes JOIN kept USING (vec_id)
    """,
    "op13_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -7, n, role, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, role)),
        sized AS (
            SELECT *, md5(role || chr(10) || text) AS name,
                   length(text) + length(text) - length(replace(text, chr(92), '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
                   + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0) AS shown,
                   length(role) + length(role) - length(replace(role, chr(92), '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7
                   + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda r: length(r) - 2)), 0)
                   + length(role) - length(replace(role, chr(10), '')) AS shown_role
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, name)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, name) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(4 + shown_role + 1 + shown + 8) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
}
