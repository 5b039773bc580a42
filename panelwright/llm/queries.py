"""Queries over the text tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_tools, compression_rules, decontaminate, license_scan, mixing, personal_data, resampling, secret_scan, simhash_dedup, suffix_dedup, token_counts, warc
from .license_texts import SPELLINGS, STATEMENTS, WHOLE
from .shared import exists, fresh_path, gone_at_exit

Query = Callable[[SparkSession, str], DataFrame]

#: Tokenizer of op2; its files are looked up at run time.
TOKENIZER = "word_bpe_49k.json"
OVER_LIMIT = 2048
#: Setting of the session with the folder of counts that op2 keeps from run to run; unset, a run starts without any.
TOKEN_CACHE = "spark.panelwright.tokenCache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_text(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_repeated", "n_removable", spans_text("repeated").alias("repeated_spans"), spans_text("removable").alias("removable_spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer, kept = token_counts.JsonTokenizer.from_path(public_tokenizers.path(TOKENIZER)), spark.conf.get(TOKEN_CACHE, None)
    cache = kept or fresh_path(spark, "token-cache")
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer, cache)
    if not kept:
        gone_at_exit(spark, cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op4_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tools.link_tools(*chat_tools.turns_as_tools(table(spark, sf_dir, "conversations")), (chat_tools.REPLY,))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secret_counts(docs, secret_scan.train(words=secret_scan.corpus_words(docs)))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document in training order; position: of its first epoch, position_again: of its second, if any."""
    ordered = mixing.in_order(mixing.mixed(table(spark, sf_dir, "documents")))
    positions = [F.try_element_at("positions", F.lit(k)).alias(n) for k, n in ((1, "position"), (2, "position_again"))]
    return ordered.select("doc_id", "size", "source_size", "target", "taken", *positions)


def quality_limits(spark: SparkSession, docs: DataFrame, sf_dir: str) -> compression_rules.CompressionRules:
    """The rules with low limits fitted to the folder's labels, where it has any."""
    if not exists(spark, f"{sf_dir}/labels.parquet"):
        return compression_rules.CompressionRules()
    return compression_rules.fitted_rules(docs, table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compression_rules.quality_rules(docs, rules=quality_limits(spark, docs, sf_dir)).drop("text")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    counted = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(counted) - F.size(F.array_remove(counted, k))).cast("long").alias(f"n_{k}") for k in personal_data.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.spans_text(base), 256).alias("base_sha256"), personal_data.spans_text(F.col("spans")).alias("spans"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat_tools": op4_chat_tools,
    "op5_secret_scan": op5_secret_scan,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_warc": op10_warc,
    "op11_resample": op11_resample,
    "op12_personal_data": op12_personal_data,
    "op13_centroids": op13_centroids,
}

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
grams AS (
  SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
met AS (SELECT r, n, k, item FROM grams JOIN phrases USING (n, phrase)),
hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS word FROM met) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

OP4_SQL = r"""
WITH calls AS (
  SELECT conv_id, turn, concat(CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR)) AS call_id, text FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, turn, concat(CAST(conv_id AS VARCHAR), ':', CAST(turn - 1 AS VARCHAR)) AS call_id, text FROM conversations WHERE role = 'assistant'),
firsts AS (SELECT conv_id, call_id, min(turn) AS linked_turn FROM calls GROUP BY ALL),
answers AS (SELECT conv_id, call_id, min(turn) AS linked_turn FROM results GROUP BY ALL),
rows AS (
  SELECT conv_id, turn, 'call' AS kind, call_id, linked_turn, text IS NOT NULL AS args_valid, turn AS since, 0 AS level,
         concat('{"arguments":{"text":', CAST(to_json(text) AS VARCHAR), ',"turn":', turn, '},"id":', CAST(to_json(call_id) AS VARCHAR), ',"name":"reply","type":"call"}') AS canonical
  FROM calls LEFT JOIN answers USING (conv_id, call_id)
  UNION ALL
  SELECT conv_id, turn, 'result', call_id, linked_turn, NULL, greatest(turn, linked_turn), CASE WHEN linked_turn IS NULL THEN 0 ELSE 1 END,
         concat('{"content":', CAST(to_json(text) AS VARCHAR), ',"id":', CAST(to_json(call_id) AS VARCHAR), ',"type":"result"}')
  FROM results LEFT JOIN firsts USING (conv_id, call_id)
  UNION ALL
  SELECT conv_id, turn, 'message', NULL, NULL, NULL, turn, 0, concat('{"role":', CAST(to_json(role) AS VARCHAR), ',"text":', CAST(to_json(text) AS VARCHAR), ',"type":"message"}')
  FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'tool'))
SELECT conv_id, turn, kind, call_id, linked_turn, args_valid, FALSE AS in_cycle,
       row_number() OVER (PARTITION BY conv_id ORDER BY since, level, turn, kind, md5(canonical), canonical) AS position, canonical
FROM rows
"""

def demand_time_sql(share: str, rank: str, schedules: tuple[tuple[float, ...], ...] = mixing.Mix().schedules) -> str:
    """Time at which a source's schedule, by its rank from 0, has given this share of its target, in SQL."""
    kinds = []
    for k, weights in enumerate(schedules):
        step = 1.0 / (len(weights) - 1)
        done, pieces = 0.0, []
        for i, (a, b) in enumerate(zip(weights, weights[1:], strict=False)):
            slope, rest = (b - a) / step, f"({{need}} - {done!r}::DOUBLE)"
            time = f"{rest} / {a!r}::DOUBLE" if slope == 0 else f"(sqrt(greatest({a * a!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE)) - {a!r}::DOUBLE) / {slope!r}::DOUBLE"
            done += (a + b) / 2 * step
            pieces.append(f"WHEN {{need}} < {done!r}::DOUBLE THEN {i * step!r}::DOUBLE + {time}")
        need = f"({share} * {done!r}::DOUBLE)"
        kinds.append(f"WHEN {rank} % {len(schedules)} = {k} THEN CASE {' '.join(pieces).format(need=need)} ELSE 1.0::DOUBLE END")
    return f"CASE {' '.join(kinds)} END"


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS cap, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank, CAST(sum(source_size) OVER () AS DOUBLE) * 3 / 2 AS total
  FROM per_source),
filled AS (
  SELECT *, row_number() OVER o AS fill_rank,
         (total - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), rank)),
levels AS (SELECT arg_min(level, fill_rank) FILTER (WHERE level * weight <= cap) AS fill_level FROM filled),
targets AS (
  SELECT source, source_size, rank - 1 AS place, CASE WHEN fill_level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), fill_level * weight) END AS target
  FROM filled, levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY order_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
given AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - start)) AS once, greatest(0, least(size, CAST(round(target) AS BIGINT) - start - source_size)) AS again FROM placed),
timed AS (
  SELECT *, CASE WHEN once > 0 THEN @once END AS first_time, CASE WHEN again > 0 THEN @again END AS second_time FROM given)
SELECT doc_id, size, source_size, target, once + again AS taken, coalesce(first_time, second_time) AS position,
       CASE WHEN first_time IS NOT NULL THEN second_time END AS position_again
FROM timed
""".replace("@once", demand_time_sql("(start / target)", "place")).replace("@again", demand_time_sql("((start + source_size) / target)", "place"))


def _canonical_sql(column: str) -> str:
    """The canonical form of a text, in DuckDB's SQL."""
    lower = f"regexp_replace(lower(coalesce({column}, '')), '{license_scan.COPYRIGHT_LINE}', '', 'g')"
    words = f"' ' || regexp_replace({lower}, '{license_scan.PUNCTUATION}', '  ', 'g') || ' '"
    for variant, word in SPELLINGS:
        words = f"replace({words}, ' {variant} ', ' {word} ')"
    return f"sha256(trim(replace({words}, '  ', ' ')))"


def op9_sql() -> str:
    known = ", ".join("('{}', '{}', {})".format(name, text.replace("'", "''"), str(whole).lower()) for texts, whole in ((WHOLE, True), (STATEMENTS, False)) for name, text in texts)
    quoted = {n: getattr(license_scan, n).replace("'", "''") for n in ("DEFINED_TERM", "WHERE_TO_FIND", "IDENTIFIERS", "IDENTIFIER_ENDS")}
    operators = ", ".join(f"'{o}'" for o in license_scan.OPERATORS)
    return f"""
WITH known AS (
  SELECT digest, coalesce(min(licence) FILTER (WHERE whole), min(licence)) AS licence, bool_or(whole) AS whole
  FROM (SELECT licence, whole, {_canonical_sql("licence_text")} AS digest FROM (VALUES {known}) AS t(licence, licence_text, whole)) GROUP BY digest),
texts AS (SELECT doc_id, row_number() OVER () AS r, text, {_canonical_sql("text")} AS digest FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM texts),
shorter AS (
  SELECT r, line, regexp_replace(regexp_replace(line, '{quoted["DEFINED_TERM"]}', '', 'g'), '{quoted["WHERE_TO_FIND"]}', '') AS short FROM lines WHERE trim(line) <> ''),
parted AS (SELECT r, line, short, regexp_extract(short, '{quoted["IDENTIFIERS"]}', 1) AS expression FROM shorter),
said AS (
  SELECT r, unnest(CASE WHEN expression = '' THEN list_distinct([line, short]) ELSE list_distinct(list_concat([line], list_transform(
    list_filter(regexp_split_to_array(expression, '{quoted["IDENTIFIER_ENDS"]}'), lambda t: regexp_matches(t, '[A-Za-z0-9]') AND lower(t) NOT IN ({operators})),
    lambda t: 'SPDX-License-Identifier: ' || t))) END) AS line FROM parted),
stated AS (
  SELECT r, licence FROM (SELECT r, {_canonical_sql("line")} AS digest FROM said) JOIN known USING (digest)
  UNION ALL SELECT r, licence FROM texts JOIN known USING (digest) WHERE NOT whole),
notices AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM stated GROUP BY r)
SELECT doc_id, digest, CASE WHEN whole THEN licence END AS licence, coalesce(notices, '') AS notices FROM texts LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)
"""


def op11_sql(how: resampling.Draw = resampling.Draw()) -> str:
    """The checksum of a feature is folded over its bytes with the table that the polynomial gives."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT b, 0, b FROM range(256) AS t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
step AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
of_d AS MATERIALIZED (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
of_b AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
names AS (SELECT DISTINCT f FROM (SELECT f FROM of_d UNION ALL SELECT f FROM of_b)),
hexed AS (SELECT f, hex(encode(f)) AS h FROM names),
bytes AS (SELECT f, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) AS bs FROM hexed),
crcs AS (SELECT f, list_reduce(bs, lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8), CAST(4294967295 AS BIGINT)) AS c FROM bytes, step),
places AS MATERIALIZED (SELECT f, xor(c, 4294967295) % {how.buckets} AS bucket FROM crcs),
s AS (SELECT bucket, count(*) AS n FROM of_d JOIN places USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM of_b JOIN places USING (f) GROUP BY bucket),
totals AS (SELECT CAST((SELECT count(*) FROM of_d) AS DOUBLE) + {how.buckets} AS s_all, CAST((SELECT count(*) FROM of_b) AS DOUBLE) + {how.buckets} AS t_all),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + CAST(1 AS DOUBLE)) * s_all / ((s.n + CAST(1 AS DOUBLE)) * t_all))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM of_d JOIN places USING (f) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
         CAST('0x' || substr(sha256('{how.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT *, n_words >= {how.min_words} AS eligible,
         row_number() OVER (PARTITION BY n_words >= {how.min_words} ORDER BY score DESC, doc_id NULLS LAST, n_features, n_words) AS place,
         count(*) FILTER (WHERE n_words >= {how.min_words}) OVER () * {how.percent} // 100 AS draws
  FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN eligible AND place <= draws THEN CAST(place AS BIGINT) END AS rank
FROM ranked
"""


def op13_sql(how: centroids.Clustering = centroids.Clustering()) -> str:
    """The rounds one after another; components, centroids and distances as rows."""
    assign = lambda k: f"""
a{k} AS MATERIALIZED (
  SELECT r, arg_min(c, far * {how.k} + c) AS c, min(far) AS far
  FROM (SELECT v.r, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS far FROM v JOIN c{k} m USING (d) GROUP BY v.r, m.c) GROUP BY r)"""  # noqa: E731
    move = lambda k: f"""
c{k + 1} AS MATERIALIZED (
  SELECT m.c, m.d, coalesce((s - ((s % n) + n) % n) // n, m.x) AS x
  FROM c{k} m LEFT JOIN (SELECT a.c, v.d, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{k} a USING (r) GROUP BY a.c, v.d) USING (c, d))"""  # noqa: E731
    rounds = ",".join(f"{assign(k)},{move(k)}" for k in range(how.rounds))
    last = how.rounds
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({how.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {how.dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(range({how.dims})) AS d, unnest(v) AS x FROM kept),
firsts AS (SELECT r, row_number() OVER (ORDER BY sha256('{how.seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id NULLS LAST, v) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, d, x FROM firsts JOIN v USING (r) WHERE c < {how.k}),{rounds},{assign(last)},
digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{last} USING (r) JOIN digests USING (c)
"""


ORACLES: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op4_chat_tools": OP4_SQL, "op6_mix_sources": OP6_SQL, "op9_license_scan": op9_sql(), "op11_resample": op11_sql(), "op13_centroids": op13_sql()}
