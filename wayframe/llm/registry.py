"""Queries of the dealt operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .apportionment import mixed, taken_words
from .exact_dedup import exact_groups
from .fill_in_middle import fill_in_middle, restored
from .jaccard_join import near_duplicates
from .nearest import nearest
from .packing import packed
from .prefix_trie import prefix_trie
from .pseudo_likelihood import pseudo_likelihood
from .quality import quality_scores
from .substring_dedup import repeated_words
from .toxicity import toxicity
from .unigram import Pieces, round_trips
from .warc import archived_pages


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; every worker has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_words(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"))


def op4_unigram(spark: SparkSession, folder: str) -> DataFrame:
    return round_trips(table(spark, folder, "documents"), Pieces.load(tokenizer_file("piece_bpe_32k.model")))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op6_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return pseudo_likelihood(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(table(spark, folder, "pages"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op11_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    out = fill_in_middle(table(spark, folder, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_packing, op3_exact_dedup, op4_unigram, op5_jaccard_join, op6_pseudo_likelihood, op7_warc, op8_toxicity, op9_quality, op10_nearest,
    op11_source_mixing, op12_prefix_trie, op13_fill_in_middle,
)}

#: Queries without SQL, and what is checked instead (tests).
WITHOUT_SQL = {
    "op2_packing": "tokenizer and dynamic program: round trip of every id, cost near the least",
    "op4_unigram": "Viterbi: brute force and the library's own unigram model",
    "op6_pseudo_likelihood": "trained network: brute-force probabilities, better than word shares",
    "op8_toxicity": "trained regression: held-out labels",
    "op9_quality": "trained classifiers: held-out labels",
    "pipeline": "trained classifier and tokenizer: brute force stage by stage",
}

SQL = {
    "op1_substring_dedup": """
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM split),
        windows AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS content FROM places),
        numbered AS (SELECT doc_id, p, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS nth FROM windows),
        gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM numbered WHERE nth > 1),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_jaccard_join": """
        WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM split WHERE len(w) > 0),
        grams AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS gram FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        meetings AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        wordless AS (SELECT doc_id FROM split WHERE len(w) = 0),
        links AS (
            SELECT a, b FROM meetings JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE common / (x.n + y.n - common) >= 0.8
            UNION ALL SELECT x.doc_id, y.doc_id FROM wordless x JOIN wordless y ON x.doc_id <> y.doc_id),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
        classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a),
        degrees AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
        SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n, 0) AS n_grams
        FROM classes LEFT JOIN degrees USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op7_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        digests AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first_page FROM payloads),
        fifths AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM digests)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_page THEN first_page END AS refers_to
        FROM fifths
    """,
    "op10_nearest": """
        WITH vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, r.vec_id,
                   sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, r.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), lambda x, y: x + y)) AS score
            FROM vectors q JOIN vectors r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_source_mixing": """
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS digest FROM documents),
        copies AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS copy FROM sized),
        placed AS (SELECT *, sha256(concat_ws(':', '11', coalesce(CAST(doc_id AS VARCHAR), ''), digest, CAST(copy // 64 AS VARCHAR))) AS place FROM copies),
        sharded AS (
            SELECT *, CAST('0x' || substr(place, 1, 8) AS BIGINT) % greatest(1, CAST(ceil((SELECT sum(size) FROM sized) / 4194304) AS BIGINT)) AS shard FROM placed),
        streams AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS stream, CAST(sum(size) + 63 AS BIGINT) // 64 AS blocks FROM sharded GROUP BY ALL),
        sources AS (
            SELECT source, CAST(sum(stream) AS BIGINT) AS source_size, CAST(sum(blocks) AS BIGINT) AS blocks,
                   row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM streams GROUP BY source),
        shared AS (
            SELECT 0 AS step, rank, source, source_size, blocks, CAST([2, 3, 1][1 + rank % 3] AS DOUBLE) AS weight, false AS capped, 0.0::DOUBLE AS target FROM sources
            UNION ALL
            SELECT step + 1, rank, source, source_size, blocks, weight, capped OR 2 * source_size <= offered,
                   CASE WHEN capped OR 2 * source_size <= offered THEN CAST(2 * source_size AS DOUBLE) ELSE offered END
            FROM (SELECT *, weight * CAST(1.5 * sum(source_size) OVER () - sum(CASE WHEN capped THEN 2 * source_size ELSE 0 END) OVER () AS DOUBLE)
                            / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS offered FROM shared)
            WHERE step <= (SELECT count(*) FROM sources)),
        votes AS (
            SELECT source, source_size, target, blocks, rank, target * blocks / greatest(source_size, 1) AS votes FROM shared WHERE step = (SELECT count(*) FROM sources) + 1),
        asked AS (SELECT source, rank, votes / (2 * unnest(range(0, 2 * blocks)) + 1) AS quotient FROM votes WHERE votes > 0),
        given AS (
            SELECT source, count(*) AS seats
            FROM (SELECT source, row_number() OVER (ORDER BY quotient DESC, rank) AS nth FROM asked) WHERE nth <= (SELECT floor(sum(votes) + 0.5) FROM votes) GROUP BY source),
        shard_asked AS (
            SELECT source, shard, blocks / (2 * unnest(range(0, 2 * blocks)) + 1) AS quotient FROM streams),
        quotas AS (
            SELECT source, shard, count(*) AS quota
            FROM (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard) AS nth FROM shard_asked) a
            JOIN given USING (source) WHERE nth <= seats GROUP BY ALL),
        chosen AS (
            SELECT s.*, coalesce(quota, 0) AS quota,
                   CASE WHEN blocks > 0 THEN CAST('0x' || substr(sha256(concat_ws(':', '11', s.source, CAST(s.shard AS VARCHAR))), 1, 8) AS BIGINT) % blocks END AS turn
            FROM streams s LEFT JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source AND s.shard = q.shard),
        begun AS (
            SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, digest, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
            FROM sharded),
        met AS (
            SELECT b.*, c.stream, c.blocks, c.quota, c.turn FROM begun b JOIN chosen c ON b.source IS NOT DISTINCT FROM c.source AND b.shard = c.shard),
        blocks_of AS (
            SELECT doc_id, source, digest, copy, begin, size, stream, blocks, quota, turn,
                   unnest(range(((begin + 1) * blocks - 1) // stream, ((begin + size) * blocks - 1) // stream + 1)) AS k FROM met WHERE size > 0),
        sums AS (
            SELECT doc_id, source, digest, copy, sum((least((k + 1) * stream // blocks, begin + size) - greatest(k * stream // blocks, begin))
                   * (((k + 1) * quota + turn) // blocks - (k * quota + turn) // blocks)) AS taken FROM blocks_of GROUP BY ALL)
        SELECT m.doc_id, CAST(m.size AS BIGINT) AS size, v.source_size, v.target, CAST(coalesce(s.taken, 0) AS BIGINT) AS taken
        FROM met m JOIN votes v ON m.source IS NOT DISTINCT FROM v.source
        LEFT JOIN sums s ON m.doc_id IS NOT DISTINCT FROM s.doc_id AND m.source IS NOT DISTINCT FROM s.source AND m.digest = s.digest AND m.copy = s.copy
    """,
    "op12_prefix_trie": """
        WITH numbered AS (
            SELECT conv_id AS c, {'name': sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'size': strlen(coalesce(text, ''))} AS t,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        listed AS (SELECT c, list(t ORDER BY pos) AS own FROM numbered GROUP BY c),
        sums AS (
            SELECT c, own, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
                   lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(0, 8)), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h FROM listed),
        rebuilt AS (
            SELECT s.c, list_concat(coalesce(b.own, [])[1:s.h], s.own[s.h + 1:]) AS path FROM sums s LEFT JOIN listed b ON b.c = s.c - s.c % 5),
        members AS (SELECT c, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt),
        nodes AS (
            SELECT list_transform(path[1:depth], lambda t: t.name) AS node, min(c) AS conv_id, depth, count(*) AS n_convs, any_value(path[depth].size) AS size,
                   sha256(coalesce(string_agg(CASE WHEN len(path) = depth THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM members GROUP BY node, depth),
        kin AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kin USING (node)),
        above AS (SELECT node[1:up] AS node, n_children = 0 AS leaf, (n_convs - 1) * coalesce(size, 0) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM whole)),
        subtrees AS (SELECT node, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY node)
        SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
        FROM whole w JOIN subtrees s ON w.node = s.node LEFT JOIN nodes p ON w.depth > 0 AND p.node = w.node[1:w.depth - 1]
    """,
    "op13_fill_in_middle": """
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
        numbers AS (SELECT *, len(units) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT)) AS r FROM split),
        places AS (
            SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
                        WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
        parts AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM places)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
}
