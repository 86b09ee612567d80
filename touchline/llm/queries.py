"""The registered opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, embed_dedup, langid, warc
from .hard_negatives import mine
from .importance import resample
from .mixing import mix
from .packing import pack
from .secrets import report
from .sharding import shard
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~apart))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts are control strings, formatted with those of the table.
PROBE = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_back(*chat.tree(rows))
    return back.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0)


# ---------------------------------------------------------------- parts of the above that SQL can express


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op1_mixing, and how often its limits are broken."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") > 3 * F.col("size")).alias("too_often"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base kinds of op4_secrets."""
    return report(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards of op6_sharding hold together; shards whose bytes are off the mean by more than 3 % and one row, and their slots that are missing or taken twice."""
    out = op6_sharding(spark, sf_dir)
    mean = out.agg((F.sum("size") / 16).alias("mean"), F.max("size").alias("largest"))
    shards = out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    off = F.abs(F.col("bytes") - F.col("mean")) > 0.03 * F.col("mean") + F.col("largest")
    gaps = F.abs(F.col("last") + 1 - F.col("n")) + F.col("n") - F.col("slots")
    return shards.crossJoin(F.broadcast(mean)).agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n_rows"), F.max("largest").alias("largest"), F.count_if(off).alias("off"), F.sum(gaps).alias("gaps"))


QUERIES: dict[str, Query] = {
    "mixing_targets": mixing_targets,
    "secret_counts": secret_counts,
    "shard_balance": shard_balance,
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_langid": op5_langid,
    "op6_sharding": op6_sharding,
    "op7_topk": op7_topk,
    "op8_embed_dedup": op8_embed_dedup,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
    "op11_importance": op11_importance,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_TEXT, _ROLE = "coalesce(text, '')", "coalesce(role, '')"
#: The control strings as one pattern of RE2.
_MARKS = "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", c) for c in chat.CONTROL)


def _escaped(text: str) -> str:
    """Length of an escaped text: one more for each backslash and control string."""
    return f"(length({text}) + length({text}) - length(replace({text}, '\\', '')) + len(regexp_extract_all({text}, '{_MARKS}')))"


_TEMPLATE = len(chat.TURN) + len(chat.TEXT) + len(chat.END)

ORACLES: dict[str, str] = {
    "mixing_targets": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
        w AS (SELECT *, 3.0::DOUBLE * n AS cap, CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
        l AS (SELECT i.cap / i.weight AS ratio, ((SELECT sum(n) FROM s) - coalesce(sum(j.cap) FILTER (WHERE j.cap / j.weight < i.cap / i.weight), 0)) / sum(j.weight) FILTER (WHERE j.cap / j.weight >= i.cap / i.weight) AS level
        FROM w AS i CROSS JOIN w AS j GROUP BY i.r, i.cap, i.weight), x AS (SELECT min_by(level, ratio) AS level FROM l WHERE level <= ratio)
        SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, round(least(cap, coalesce(level * weight, cap)), 4) AS target, false AS too_often FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN x""",
    "secret_counts": r"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) AS d""",
    "shard_balance": """SELECT CAST(16 AS BIGINT) AS shards, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, count(*) AS n_rows, CAST(max(strlen(coalesce(text, '')) + 1) AS BIGINT) AS largest,
        CAST(0 AS BIGINT) AS off, CAST(0 AS BIGINT) AS gaps FROM documents""",
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        f AS (SELECT body, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY body)
        SELECT page_id, n AS payload_bytes, sha256(p.body) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.body = f.body""",
    "op7_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_GOOD}),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_embed_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_GOOD} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT a AS id, b AS other FROM l UNION SELECT r.id, l.b FROM reach AS r JOIN l ON r.other = l.a),
        c AS (SELECT id, min(other) AS least FROM reach GROUP BY id), n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
        SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id""",
    "op9_chat": f"""WITH t AS (SELECT conv_id, turn, {_ROLE} AS role, {_TEXT} AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
        CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS loss_sha256,
        CAST(sum({_TEMPLATE} + {_escaped("role")} + {_escaped("text")}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op11_importance": r"""WITH tab AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
        w AS (SELECT true AS doc, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
        x AS (SELECT doc, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM w),
        f AS (SELECT doc, r, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: concat(a[i], ' ', a[i + 1])))) AS f FROM x),
        d AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
        b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda k: CAST(concat('0x', substr(h, 2 * k + 1, 2)) AS BIGINT))),
            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d CROSS JOIN tab),
        n AS (SELECT doc, r, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
        c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE doc), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT doc), 0) AS t FROM n GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c),
        m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM n JOIN g USING (bucket) WHERE doc GROUP BY r),
        z AS (SELECT doc_id, len(a) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('7:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x LEFT JOIN m USING (r) WHERE doc),
        o AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS place FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) FROM z WHERE able) * 25 // 100 THEN place END AS rank FROM o""",
    "op12_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
        o AS (SELECT doc_id, o, least(500, n - 49 - o) AS c, substr(h, 2 * o + 1, 1098) AS h FROM (SELECT *, unnest(range(0, greatest(0, n - 49), 500)) AS o FROM d)),
        w AS (SELECT doc_id, o + p AS p, hash(substr(h, 2 * p + 1, 100)) AS k, md5_number(substr(h, 2 * p + 1, 100)) AS k2 FROM (SELECT *, unnest(range(c)) AS p FROM o)),
        m AS (SELECT k, k2, min(doc_id) AS least FROM w GROUP BY k, k2 HAVING count(*) > 1), g AS (SELECT doc_id, p FROM w JOIN m USING (k, k2) WHERE least < doc_id),
        l AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM g),
        s AS (SELECT doc_id, p, sum(CASE WHEN b IS NULL OR p > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM l),
        r AS (SELECT doc_id, s, min(p) AS lo, max(p) + 50 AS hi FROM s GROUP BY doc_id, s),
        k AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS past FROM r),
        a AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) AS head, max(hi) AS last FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(concat(coalesce(head, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op13_hard_negatives": f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_GOOD}),
        s AS (SELECT q.vec_id AS anchor_id, c.vec_id AS other, q.label = c.label AS same, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
}
