"""DuckDB statements of the corpus queries that SQL can express."""

from __future__ import annotations

from skewline.llm import fim, mixing

_QUOTA = """
  SELECT {keys}, max(sure) + sum(CASE WHEN won THEN 1 ELSE 0 END) AS quota FROM (
    SELECT *, votes > 0 AND row_number() OVER ({part} ORDER BY votes / (2 * j + 1) DESC, {cell}, j) <= open_seats AS won
    FROM (
      SELECT *, unnest(generate_series(sure, near + reach)) AS j FROM (
        SELECT *, seats - sum(sure) OVER ({part}) AS open_seats FROM (
          SELECT *, greatest(0, near - reach) AS sure FROM (
            SELECT *, CAST(floor(share + 0.5) AS BIGINT) AS near,
              CAST(CASE WHEN seats > 0 THEN ceil(share * n / (2 * seats)) ELSE 0 END + 1 AS BIGINT) AS reach FROM (
              SELECT *, CASE WHEN sum(votes) OVER ({part}) > 0 THEN votes * seats / sum(votes) OVER ({part}) ELSE 0.0 END
                AS share, count(*) OVER ({part}) AS n FROM {source}
            ))))))
  GROUP BY {keys}
"""


def mixing_sql() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    by_source = _QUOTA.format(keys="rank", cell="rank", part="PARTITION BY 0", source="seated")
    by_shard = _QUOTA.format(keys="rank, shard", cell="shard", part="PARTITION BY rank", source="cells")
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(text, '')) AS digest, count(*) AS n
  FROM documents GROUP BY ALL),
items AS (SELECT *, least({mixing.COPIES}, n - item * {mixing.COPIES}) AS copies, size * least({mixing.COPIES}, n - item * {mixing.COPIES}) AS words
  FROM (SELECT *, unnest(generate_series(0, (n - 1) // {mixing.COPIES})) AS item FROM sized)),
ranked AS (
  SELECT source, docs, size, rank, 1.0::DOUBLE * list_extract([{weights}], CAST(rank % {len(mixing.WEIGHTS)} + 1 AS INT)) AS weight,
    CAST(size * {mixing.MAX_REPEAT} AS DOUBLE) AS cap FROM (
    SELECT source, count(*) AS docs, CAST(sum(words) AS BIGINT) AS size,
      row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1 AS rank
    FROM items GROUP BY source)),
leveled AS (
  SELECT *, (sum(CAST(size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER b, 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS lv
  FROM ranked WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(lv, (cap / weight, rank)) AS level FROM leveled WHERE NOT cap <= lv * weight),
targets AS (
  SELECT source, rank, docs, size, CASE WHEN cap <= lv * weight THEN cap ELSE least(cap, level * weight) END AS target
  FROM leveled, final),
seated AS (SELECT *, target AS votes,
  CAST(round(sum(target) OVER () / {mixing.BLOCK_WORDS}) AS BIGINT) AS seats FROM targets),
quotas AS ({by_source}),
plan AS (
  SELECT t.source, t.rank, t.size AS source_size, target, quota AS source_quota,
    CAST(greatest(1, ceil(docs / {mixing.SHARD_DOCS}.0)) AS BIGINT) AS shards FROM targets t JOIN quotas USING (rank)),
drawn AS (
  SELECT d.doc_id, d.size, d.digest, d.item, d.copies, d.words, p.*,
    md5('{mixing.SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || '|' || digest || '|' || item) AS draw
  FROM items d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
sharded AS (SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % shards AS shard FROM drawn),
cells AS (
  SELECT rank, shard, CAST(sum(words) AS BIGINT) AS shard_size, CAST(sum(words) AS DOUBLE) AS votes,
    max(source_quota) AS seats FROM sharded GROUP BY rank, shard),
shard_quotas AS ({by_shard}),
filled AS (
  SELECT s.*, shard_size, least(quota * {mixing.BLOCK_WORDS}, shard_size * {mixing.MAX_REPEAT}) AS quota,
    coalesce(sum(s.words) OVER (PARTITION BY s.rank, s.shard ORDER BY draw, doc_id, s.size, digest, item
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sharded s JOIN cells USING (rank, shard) JOIN shard_quotas USING (rank, shard)),
rounds AS (SELECT *, CASE WHEN shard_size > 0 THEN CAST(floor(quota / shard_size) AS BIGINT) ELSE 0 END AS rounds FROM filled),
taken AS (SELECT *, CAST(rounds * words + greatest(0, least(words, quota - rounds * shard_size - start)) AS BIGINT) AS taken FROM rounds)
SELECT doc_id, size, source_size, target, CAST(taken * (c + 1) // copies - taken * c // copies AS BIGINT) AS taken
FROM (SELECT *, unnest(generate_series(0, copies - 1)) AS c FROM taken)"""


ORACLES: dict[str, str] = {
    "op10_sainte_lague_mix": mixing_sql(),
}


def _components(edges: str) -> str:
    """CTEs ``reach`` and ``least``: least id reachable over the pairs (a, b) of ``edges``."""
    return f"""
reach(a, b) AS (SELECT a, b FROM {edges} UNION SELECT r.a, e.b FROM reach r JOIN {edges} e ON r.b = e.a),
least_of AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""


ORACLES["op2_int8_neardup"] = f"""
WITH RECURSIVE vectors AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (
  SELECT * FROM vectors WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {0.98}),
{_components("pairs")},
links AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id,
  coalesce(component, vec_id) = vec_id AS kept
FROM vectors LEFT JOIN links ON vec_id = links.id LEFT JOIN least_of ON vec_id = least_of.id"""


ORACLES["op8_chosen_path_join"] = f"""
WITH RECURSIVE members AS (
  SELECT DISTINCT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(list_slice(w, i, i + 4), 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS i FROM members)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
pairs AS (
  SELECT a, b FROM shared JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE c >= 0.8 * (p.n + q.n - c)),
{_components("pairs")},
links AS (SELECT a AS id, count(*) AS n FROM pairs GROUP BY a)
SELECT doc_id, coalesce(component, doc_id) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
  coalesce(component, doc_id) = doc_id AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN links ON d.doc_id = links.id LEFT JOIN least_of ON d.doc_id = least_of.id"""


def fim_sql() -> str:
    draw = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
drawn AS (SELECT *, len(units) AS n, {draw} FROM cut),
formed AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '{fim.PREFIX}') OR contains(text, '{fim.SUFFIX}')
      OR contains(text, '{fim.MIDDLE}') OR h3 % 100 >= {fim.RATE} THEN 'plain'
      WHEN h4 % 100 < {fim.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle
    ELSE '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM formed"""


ORACLES["op12_repeated_capture_fim"] = fim_sql()
