"""DuckDB SQL for the Merkle manifest query, with its levels written out one by one."""

from __future__ import annotations

#: Levels written out: trees of up to 16 ** LEVELS rows, up to 16 ** OVER trees.
LEVELS, OVER = 6, 3


def _encoded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({value} AS VARCHAR))), ':', {value}) END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(_encoded, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


def _crc32(text: str) -> str:
    """Of a text of digits and signs, bit by bit."""
    bits = f"[CAST(xor(a, ord(substr({text}, CAST(i AS INTEGER), 1))) AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8]"
    byte = f"list_reduce({bits}, lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), range(1, length({text}) + 1)), lambda a, i: {byte}), 4294967295)"


def _levels(name: str, first: str, count: int) -> str:
    """name0 (tree, pos, n, node, l, r), name1, ...: nodes with what stands before and after them in their run."""
    parts, below = [], f"SELECT tree, pos, n, node FROM {first}"
    for k in range(count + 1):
        run = "OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        left, right = f"string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING)", f"string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        parts.append(f"{name}{k} AS MATERIALIZED (SELECT tree, pos, n, node, coalesce({left}, '') AS l, coalesce({right}, '') AS r FROM ({below}))")
        up = "CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END"
        below = f"SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, {up} AS node FROM {name}{k} GROUP BY tree, pos // 16, n"
    return ",\n".join(parts)


def _folds(name: str, count: int, rows: str, kept: str) -> tuple[list[str], str]:
    """The fold in steps, a query a level, so that no expression is written twice; with the proof so far."""
    steps, last = [], rows
    for k in range(count):
        at, step = f"{name}{k}", f"{name}_fold{k}"
        one = f"CASE WHEN t.n > 1 THEN sha256(t.l || x.end || t.r) ELSE x.end END AS end, x.proof || CASE WHEN t.n > 1 THEN t.l || t.r ELSE '' END AS proof"
        steps.append(f"{step} AS (SELECT {kept}, x.tree, x.pos, {one} FROM {last} x JOIN {at} t ON t.tree = x.tree AND t.pos = x.pos // {16**k})")
        last = step
    return steps, last


def manifest_sql() -> str:
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tampered = f"doc_id IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0"
    kept = "x.doc_id, x.leaf"
    inner, last = _folds("a", LEVELS, "x0", kept)
    outer, top = _folds("b", OVER, "y0", f"{kept}, x.subroot")
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS node, CASE WHEN {tampered} THEN {_leaf(lowered)} END AS other FROM documents),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_levels('a', 'x', LEVELS)},
s AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, node, tree AS name FROM a{LEVELS}),
{_levels('b', 's', OVER)},
x0 AS (SELECT doc_id, node AS leaf, tree, pos, coalesce(other, node) AS end, '' AS proof FROM x),
{', '.join(inner)},
y0 AS (SELECT f.doc_id, f.leaf, s.node AS subroot, s.tree, s.pos, f.end, f.proof FROM {last} f JOIN s ON s.name = f.tree),
{', '.join(outer)}
SELECT doc_id, leaf, subroot, b{OVER}.node AS root, sha256(proof) AS proof_sha256, f.end AS folded_root, f.end = b{OVER}.node AS verified FROM {top} f, b{OVER}"""
