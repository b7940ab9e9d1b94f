"""DuckDB SQL of the training-data queries that SQL can express."""

from speechframe.llm.sharding import PRIME, ROUNDS, round_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32: the table of its polynomial, as a list in a one-row relation.
CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
             CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))
"""


def crc(text: str) -> str:
    """Checksum of a text's UTF-8 bytes; ``crc_table`` must be in scope."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    octets = f"list_transform({pairs}, lambda p: ('0x' || p)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
        f"lambda c, b: xor(c >> 8, crc_table.t[xor(c, b) % 256 + 1])), 4294967295)"
    )


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


_WORDS = rf"regexp_extract_all({lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLE = f"""
WITH {CRC_TABLE},
texts AS (
  SELECT 's' AS side, doc_id, {_WORDS} AS ws FROM documents
  UNION ALL
  SELECT 't', NULL, {_WORDS} FROM benchmark),
words AS (SELECT side, doc_id, unnest(ws) AS w FROM texts),
buckets AS (
  SELECT w, {crc("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words), crc_table),
placed AS (SELECT side, doc_id, bucket FROM words JOIN buckets USING (w)),
counts AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t
  FROM placed GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
         / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts),
weights AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket)
  WHERE side = 's' GROUP BY doc_id),
scored AS (
  SELECT x.doc_id, len(x.ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((
           ('0x' || substr(sha256('2024:' || x.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts x LEFT JOIN weights USING (doc_id) WHERE x.side = 's'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
         count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank
FROM ranked
"""

NAMING = f"""
WITH texts AS (SELECT doc_id, {lowered("text")} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY text)
"""


def _field(column: str) -> str:
    text = f"({column})::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_NOW = f"CASE WHEN {crc('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"


def _tree(name: str, leaves: str, starts: str) -> str:
    """Relations of trees with runs of three: nodes by level, runs, and for each row of ``starts`` (key, grp, i,
    now) the walk to the root of its tree with the digest there and the siblings on the way."""
    before = "array_to_string(hs[1 : (w.i % 3)::BIGINT], '')"
    after = "array_to_string(hs[(w.i % 3)::BIGINT + 2 :], '')"
    return f"""
{name}_nodes AS (
  SELECT 0 AS level, grp, i, h, count(*) OVER (PARTITION BY grp) AS n FROM {leaves}
  UNION ALL
  SELECT level, grp, i, h, count(*) OVER (PARTITION BY grp) AS n FROM (
    SELECT level + 1 AS level, grp, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h
    FROM {name}_nodes WHERE n > 1 GROUP BY level, grp, i // 3)),
{name}_runs AS (
  SELECT level, grp, i // 3 AS run, list(h ORDER BY i) AS hs FROM {name}_nodes WHERE n > 1
  GROUP BY level, grp, i // 3),
{name}_walk AS (
  SELECT 0 AS level, key, grp, i, now, '' AS proof FROM {starts}
  UNION ALL
  SELECT w.level + 1, w.key, w.grp, w.i // 3, sha256({before} || now || {after}),
         proof || {before} || {after}
  FROM {name}_walk w
  JOIN {name}_runs r ON r.level = w.level AND r.grp = w.grp AND r.run = w.i // 3),
{name}_ends AS (
  SELECT key, grp, arg_max(now, level) AS now, arg_max(proof, level) AS proof
  FROM {name}_walk GROUP BY key, grp)"""


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT doc_id, coalesce(':' || source, '') AS grp, sha256({_LEAF} || {_field("text")}) AS h,
         sha256({_LEAF} || {_field(_NOW)}) AS now
  FROM documents, crc_table),
leaves AS (
  SELECT *, doc_id AS key, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS i FROM hashed),
{_tree("low", "leaves", "leaves")},
subroots AS (
  SELECT grp AS member, h, 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS i
  FROM low_nodes WHERE n = 1),
tops AS (
  SELECT e.key, e.now, s.grp, s.i FROM low_ends e JOIN subroots s ON s.member = e.grp),
{_tree("top", "subroots", "tops")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(a.proof || b.proof) AS proof_sha256,
       b.now AS folded_root, b.now = r.h AS verified
FROM leaves l
JOIN subroots s ON s.member = l.grp
JOIN low_ends a ON a.key = l.key
JOIN top_ends b ON b.key = l.key
CROSS JOIN (SELECT h FROM top_nodes WHERE n = 1) r
"""


def _sharding(shards: int, seed: int) -> str:
    """Rounds of the network one by one; a number outside goes on with another pass."""
    keys = [f"{k}" for k in round_keys(seed)]
    once = f"((v + [{', '.join(keys)}][2 * k + 1]) % {PRIME})"
    twice = f"(({once} * {once} + [{', '.join(keys)}][2 * k + 2]) % {PRIME})"
    even = f"(i % {ROUNDS}) % 2 = 0"
    return f"""
WITH RECURSIVE {CRC_TABLE},
sizes AS (SELECT n, high, (n + high - 1) // high AS low FROM (
  SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS high FROM documents)),
numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents),
walk AS (
  SELECT number, number // low AS l, number % low AS r, 0 AS i FROM numbered, sizes
  UNION ALL
  SELECT number, CASE WHEN {even} THEN (l + mixed) % high ELSE l END,
         CASE WHEN {even} THEN r ELSE (r + mixed) % low END, i + 1
  FROM (
    SELECT *, {twice} * {twice} % {PRIME} AS mixed FROM (
      SELECT *, CASE WHEN {even} THEN r ELSE l END AS v, i % {ROUNDS} AS k FROM walk, sizes
      WHERE i = 0 OR i % {ROUNDS} > 0 OR l * low + r >= n))),
places AS (
  SELECT number, l * low + r AS place FROM walk, sizes WHERE i > 0 AND i % {ROUNDS} = 0 AND l * low + r < n)
SELECT d.doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc("coalesce(text, '')")} AS text_crc32,
       'rows' AS law, (place % {shards})::INT AS shard, place // {shards} AS slot,
       NULL::INT AS grown_shard, number AS row_number
FROM documents d JOIN numbered USING (doc_id) JOIN places USING (number), crc_table
"""


EMBEDDINGS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings
  UNION
  SELECT l.b, reached.r FROM reached JOIN links l ON l.a = reached.v),
roots AS (SELECT v, min(r) AS root FROM reached GROUP BY v),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, v = root AS kept
FROM roots LEFT JOIN degrees ON a = v
"""

ORACLES = {
    "op1_sharding": _sharding(24, 2024),
    "op8_embeddings": EMBEDDINGS,
    "op11_resample": RESAMPLE,
    "op12_naming": NAMING,
    "op13_merkle": MERKLE,
}
