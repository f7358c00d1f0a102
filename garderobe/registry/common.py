"""SQL fragments of the table bindings, shared by the oracle statements."""

from __future__ import annotations

from garderobe import vocab as v
from garderobe.plans.bindings import PALETTE, TYPE_SLOT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    def cell(x):
        return quoted(x) if isinstance(x, str) else ("NULL" if x is None else repr(x))

    return ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in rows)


def case_map(column: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(x) if isinstance(x, str) else repr(x)}" for k, x in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def sql_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


SLOT_CASE = case_map("p_type", TYPE_SLOT, "'accessory'")
PALETTE_NAMES = "[" + ", ".join(quoted(n) for n, _ in PALETTE) + "]"
PALETTE_HEX = "[" + ", ".join(quoted(h) for _, h in PALETTE) + "]"
STYLE_NAMES = "[" + ", ".join(quoted(s) for s in v.STYLES) + "]"

DOTS = ", ".join(f"100.0 * list_dot_product(q[{i}], b.vec)" for i in range(1, 8))

ITEMS = f"""
item_base AS (
  SELECT e.vec_id % 20 AS wardrobe_id, 'it' || e.vec_id AS item_id, e.vec_id AS seq,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(e.vec_id) AS created_at,
    {SLOT_CASE} AS category, p_name AS label, p_size,
    CASE p_size % 10 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'user' ELSE 'auto' END
      AS review_status,
    CASE WHEN p_size % 11 <> 0 THEN (p_size % 10)::DOUBLE / 10.0 END AS confidence,
    {PALETTE_NAMES}[p_size % 17 + 1] AS color, {PALETTE_HEX}[p_size % 17 + 1] AS hex,
    {PALETTE_NAMES}[(p_size * 3 + 5) % 17 + 1] AS color2,
    'w' || (e.vec_id % 20) || '_' || (e.vec_id // 100) AS source_image,
    p_size % 3 * 60 AS x1, p_size % 4 * 70 AS y1, p_size % 3 * 60 + 100 + p_size % 5 * 10 AS x2,
    p_size % 4 * 70 + 150 AS y2,
    CASE WHEN e.vec_id % 50 = 7 THEN 'old' ELSE 'enc64' END AS embedding_model,
    CASE WHEN e.vec_id % 53 <> 5 THEN c.embedding::DOUBLE[] END AS embedding, c.embedding::DOUBLE[] AS vec
  FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey JOIN embeddings c
    ON c.vec_id = CASE WHEN e.vec_id % 25 = 3 AND e.vec_id >= 20 THEN e.vec_id - 20 ELSE e.vec_id END),
prompts AS (SELECT list(embedding::DOUBLE[] ORDER BY vec_id) AS q FROM embeddings WHERE vec_id < 7),
item_logits AS (
  SELECT b.*, CASE WHEN b.embedding IS NOT NULL THEN [{DOTS}] END AS lg FROM item_base b, prompts),
item_scores AS (
  SELECT * EXCLUDE (lg), list_transform(lg, lambda z: round(exp(z - list_max(lg)) /
    list_sum(list_transform(lg, lambda y: exp(y - list_max(lg)))), 4)) AS style_scores FROM item_logits),
items AS (
  SELECT *, {STYLE_NAMES}[list_position(style_scores, list_max(style_scores))] AS style,
    CASE WHEN embedding IS NULL THEN 'missing' WHEN embedding_model <> 'enc64' THEN 'stale' ELSE 'ok' END AS health,
    CASE WHEN review_status = 'needs_review' THEN 'needs review (uncertain detection)'
      WHEN embedding IS NULL OR embedding_model <> 'enc64' THEN 'missing or invalid embedding' END AS reason
  FROM item_scores)
"""

OUTFITS = """
outfit_items AS (
  SELECT split, l_orderkey AS set_id, l_partkey AS ord,
    CASE WHEN l_partkey % 40 = 0 THEN 'p' || l_partkey ELSE split || '_' || l_partkey END AS item_id
  FROM (SELECT l_orderkey, l_partkey, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'valid' ELSE 'train' END AS split
    FROM (SELECT DISTINCT l_orderkey, l_partkey,
      ('0x' || substr(sha1('42:' || l_orderkey), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS u FROM lineitem)))
"""

CATEGORIES = f"""
item_cats AS (
  SELECT unnest(CASE WHEN p_partkey % 40 = 0 THEN ['p' || p_partkey]
    ELSE ['train_' || p_partkey, 'valid_' || p_partkey, 'test_' || p_partkey] END) AS item_id, {SLOT_CASE} AS category
  FROM part)
"""

VECTORS = """
item_vecs AS (
  SELECT unnest(CASE WHEN vec_id % 40 = 0 THEN ['p' || vec_id]
    ELSE ['train_' || vec_id, 'valid_' || vec_id, 'test_' || vec_id] END) AS item_id, embedding::DOUBLE[] AS vector
  FROM embeddings)
"""

DETECTIONS = f"""
raw_detections AS (
  SELECT l_orderkey AS image_id, 400 AS width, 600 AS height,
    [{", ".join(quoted(x) for x in (*v.LABELS, "spoon", "lamp"))}][l_partkey % 28 + 1] AS label,
    ((l_partkey * 7 + l_suppkey * 13) % 100)::DOUBLE / 100.0 AS confidence,
    l_suppkey % 4 * 70 - 20 AS x1, l_partkey % 5 * 80 AS y1,
    CASE WHEN l_partkey % 97 = 0 THEN l_suppkey % 4 * 70 - 10 ELSE l_suppkey % 4 * 70 + 80 + l_partkey % 3 * 40 END
      AS x2,
    l_partkey % 5 * 80 + 120 + l_suppkey % 3 * 60 AS y2
  FROM lineitem),
clipped AS (
  SELECT image_id, label, confidence, {case_map("label", v.LABEL_SLOT)} AS slot,
    greatest(0, least(x1, 400))::INT AS bx1, greatest(0, least(y1, 600))::INT AS by1,
    greatest(0, least(x2, 400))::INT AS bx2, greatest(0, least(y2, 600))::INT AS by2
  FROM raw_detections),
valid_detections AS (
  SELECT * FROM clipped WHERE slot IS NOT NULL AND bx2 - bx1 >= 16 AND by2 - by1 >= 16
    AND (bx2 - bx1) * (by2 - by1) >= 0.002 * 400 * 600)
"""


def with_items(sql: str) -> str:
    return f"WITH {ITEMS} {sql}"


def with_outfits(sql: str) -> str:
    return f"WITH {OUTFITS}, {CATEGORIES} {sql}"


NEUTRAL_SQL = sql_list(v.NEUTRALS)
