"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies an operator with production parameters to its whole table
and derives the columns of its contract.  Operators that SQL cannot express
have no entry in :func:`oracle_sql`; ``tests/llm`` holds them against brute
force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import bpe, chat, class_lm, embed_dedup, fill_middle, filter_audit, langid, license_scan, merkle, packing, sharding, simhash, suffix_dedup


def vocabulary() -> str:
    """The public vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir)).drop("spans")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary())


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), vocabulary())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id", "class_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(_documents(spark, sf_dir))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_documents(spark, sf_dir))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edit(_documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_documents(spark, sf_dir))


OP11 = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (w.doc_id > min(w.doc_id) OVER (PARTITION BY t))::INT AS m
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
 c AS (SELECT part, m, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM f GROUP BY 1, 2),
 b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(ch, bit)),
 p AS (SELECT a.ch || b2.ch || c3.ch || d.ch || e.ch AS filter_order FROM b a, b b2, b c3, b d, b e WHERE a.bit | b2.bit | c3.bit | d.bit | e.bit = 31),
 s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS filter, (SELECT sum(bit) FROM b WHERE contains(filter_order[:step - 1], ch)) AS before, (SELECT bit FROM b WHERE ch = filter_order[step]) AS bit FROM p, range(1, 6) r(step)),
 r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN m & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN m & coalesce(before, 0)::INT = 0 AND m & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN m & coalesce(before, 0)::INT > 0 AND m & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN m & coalesce(before, 0)::INT = 0 AND m & bit > 0 THEN g ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN m & coalesce(before, 0)::INT = 0 AND m & bit > 0 THEN x ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
 SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""

_ESCAPED = r"regexp_replace(coalesce(text, ''), '([<\[])(\\*(?:/?s>|\||/?INST\]))', '\1\\\2', 'g')"

OP12 = f"""WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
 t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM a),
 c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
  sum(length(url_encode(role)) + length({_ESCAPED}) + 10)::BIGINT AS formatted_chars FROM t GROUP BY 1)
 SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 1::BIGINT AS n_branches FROM c"""

OP13 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
 u AS (SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
 v AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
 x AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM v)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""


OP2 = r"""WITH tb AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce(list_concat([i], [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
 by_ AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] WHEN unicode(x) < 2048 THEN [192 + unicode(x) // 64, 128 + unicode(x) % 64]
   WHEN unicode(x) < 65536 THEN [224 + unicode(x) // 4096, 128 + unicode(x) // 64 % 64, 128 + unicode(x) % 64] ELSE [240 + unicode(x) // 262144, 128 + unicode(x) // 4096 % 64, 128 + unicode(x) // 64 % 64, 128 + unicode(x) % 64] END)) AS b FROM documents),
 d AS (SELECT doc_id, source, size, xor(list_reduce(list_concat([4294967295::BIGINT], CASE WHEN size > 1 THEN b ELSE [] END), lambda c, x: xor(c >> 8, tb[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32,
   ('0x' || md5('42' || chr(31) || doc_id)[1:8])::BIGINT & 2147483647 AS pl, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS src FROM by_, tb),
 r AS (SELECT *, floor((row_number() OVER (PARTITION BY src ORDER BY pl, doc_id, text_crc32, size) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY src) * 4503599627370496) AS f FROM d),
 o AS (SELECT *, row_number() OVER (ORDER BY f, pl, src, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r)
 SELECT doc_id, source, size::BIGINT AS size, text_crc32, 'rows' AS law, (place * 8 // n)::INT AS shard, (place - (place * 8 // n * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM o"""

OP7 = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
 v AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS t FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS s FROM w WHERE len(w) >= 50)),
 g AS (SELECT t, min({'d': doc_id, 's': s}) AS f FROM v GROUP BY t HAVING min(doc_id) <> max(doc_id)),
 p AS (SELECT doc_id, s, f.d AS first_, f.d <> doc_id OR f.s <> s AS removed FROM v JOIN g USING (t)),
 i AS (SELECT *, sum(CASE WHEN s <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, removed ORDER BY s) AS k FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id, removed ORDER BY s) AS before FROM p))
 SELECT doc_id, min(s)::INT AS start_word, (max(s) + 50 - min(s))::INT AS n_words, min(first_) AS first_doc_id, removed FROM i GROUP BY doc_id, removed, k"""

OP8 = r"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS n FROM embeddings),
 u AS (SELECT vec_id, label, list_transform(e, lambda x: x / n) AS e FROM v WHERE label IS NOT NULL AND n > 0 AND isfinite(n) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) >= 0.98),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id)::BIGINT AS n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS component_id, vec_id = least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS kept FROM embeddings"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_sharding": op2_sharding,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_bpe": op4_bpe,
        "op5_simhash": op5_simhash,
        "op6_language_id": op6_language_id,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_class_lm": op9_class_lm,
        "op10_merkle_fingerprints": op10_merkle_fingerprints,
        "op11_filter_audit": op11_filter_audit,
        "op12_chat_format": op12_chat_format,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2, "op7_suffix_array_dedup": OP7, "op8_embedding_dedup": OP8, "op11_filter_audit": OP11, "op12_chat_format": OP12, "op13_fill_middle": OP13}
