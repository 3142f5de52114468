"""SQL twins of the manifest and of resharding, from plain rules: recursion over levels, running sums over rows."""

from __future__ import annotations

from recloom.llm import merkle, resharding

# The reversed polynomial of crc32.
POLYNOMIAL = 0xEDB88320


def crc32_of(data: str) -> str:
    """SQL for the crc32 of a BLOB, byte by byte and bit by bit."""
    listed = f"list_transform(regexp_extract_all(hex({data}), '..'), lambda y: ('0x' || y)::UBIGINT)"
    bits = ", ".join("0" * 8)
    shift = f"list_reduce([xor(c, b), {bits}], lambda e, z: xor(e >> 1, {POLYNOMIAL}::UBIGINT * (e & 1)))"
    full = (1 << 32) - 1
    return f"xor(list_reduce(list_prepend({full}::UBIGINT, {listed}), lambda c, b: {shift}), {full}::UBIGINT)::BIGINT"


def _leaf(text: str) -> str:
    told = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || ({t}), '-')" for t in told) + ")"


def _climb(name: str, leaves: str) -> str:
    """Recursive levels above ``leaves`` (tree, pos, d, n), and each node's siblings."""
    return f"""
    {name}_up AS (
      SELECT tree, 0 AS lvl, pos, d, n FROM {leaves}
      UNION ALL
      SELECT tree, lvl + 1, pos // {merkle.FANOUT}, sha256(string_agg(d, '' ORDER BY pos)),
        (any_value(n) + {merkle.FANOUT - 1}) // {merkle.FANOUT}
      FROM {name}_up WHERE n > 1 GROUP BY tree, lvl, pos // {merkle.FANOUT}),
    {name}_sibs AS (
      SELECT a.tree, a.lvl, a.pos,
        coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
      FROM {name}_up a JOIN {name}_up b
        ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // {merkle.FANOUT} = b.pos // {merkle.FANOUT}
      WHERE a.n > 1 GROUP BY ALL),
    {name}_steps AS (
      SELECT x.tree, x.pos, s.lvl, s.l, s.r FROM {leaves} x JOIN {name}_sibs s
        ON s.tree = x.tree AND s.pos = x.pos // ({merkle.FANOUT} ** s.lvl)::BIGINT)"""


def manifest() -> str:
    chosen = crc32_of("encode(doc_id::VARCHAR)")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE hashed AS (
      SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS d,
        CASE WHEN {chosen} % 5 = 0 THEN {_leaf(lower)} END AS altered
      FROM documents),
    leaves AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
      FROM hashed),
    {_climb("g", "leaves")},
    subroots AS (
      SELECT '' AS tree, tree AS own, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
      FROM g_up WHERE n = 1),
    {_climb("t", "subroots")},
    steps AS (
      SELECT tree, pos, l, r, row_number() OVER (PARTITION BY tree, pos ORDER BY part, lvl) AS k FROM (
        SELECT tree, pos, lvl, l, r, 0 AS part FROM g_steps
        UNION ALL
        SELECT x.tree, x.pos, s.lvl, s.l, s.r, 1 FROM leaves x JOIN subroots o ON o.own = x.tree
          JOIN t_steps s ON s.pos = o.pos)),
    folded AS (
      SELECT tree, pos, 0::BIGINT AS k, coalesce(altered, d) AS d FROM leaves
      UNION ALL
      SELECT f.tree, f.pos, f.k + 1, sha256(s.l || f.d || s.r)
      FROM folded f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.k = f.k + 1),
    ends AS (SELECT tree, pos, arg_max(d, k) AS d FROM folded GROUP BY tree, pos),
    proofs AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY k) AS p FROM steps GROUP BY tree, pos)
    SELECT x.doc_id, x.d AS leaf, o.d AS subroot, t.d AS root, sha256(coalesce(p.p, '')) AS proof_sha256,
      e.d AS folded_root, e.d = t.d AS verified
    FROM leaves x JOIN subroots o ON o.own = x.tree JOIN ends e ON e.tree = x.tree AND e.pos = x.pos
      LEFT JOIN proofs p ON p.tree = x.tree AND p.pos = x.pos
      CROSS JOIN (SELECT d FROM t_up WHERE n = 1) t"""


def _round(k: int, rows: str, order: str) -> str:
    """One round: what a shard has over its share goes, in order, to those that lack some."""
    shards = resharding.NEW_SHARDS
    upto = "ROWS UNBOUNDED PRECEDING"
    return f"""
    laid{k} AS (
      SELECT *, sum(size) OVER w - size AS before, row_number() OVER w - 1 AS pos FROM {rows}
      WINDOW w AS (PARTITION BY shard ORDER BY {order} {upto})),
    has{k} AS (
      SELECT i AS shard, coalesce(sum(size), 0) AS has, any_value(t) // {shards} + (i < any_value(t) % {shards})::BIGINT AS cap
      FROM range({shards}) r(i) CROSS JOIN (SELECT sum(size) AS t FROM {rows}) LEFT JOIN {rows} x ON x.shard = i GROUP BY i),
    bal{k} AS (
      SELECT shard, least(has, cap) AS stay, greatest(has - cap, 0) AS gives, greatest(cap - has, 0) AS takes,
        sum(greatest(has - cap, 0)) OVER (ORDER BY shard {upto}) AS g, sum(greatest(cap - has, 0)) OVER (ORDER BY shard {upto}) AS t
      FROM has{k}),
    blocks{k} AS (
      SELECT shard AS old, shard AS new_shard, 0 AS low, stay AS high FROM bal{k}
      UNION ALL
      SELECT a.shard, b.shard, a.stay + greatest(a.g - a.gives, b.t - b.takes) - (a.g - a.gives),
        a.stay + least(a.g, b.t) - (a.g - a.gives)
      FROM bal{k} a JOIN bal{k} b ON a.g > b.t - b.takes AND b.t > a.g - a.gives AND a.gives > 0 AND b.takes > 0),
    placed{k} AS (
      SELECT l.*, b.new_shard FROM laid{k} l JOIN blocks{k} b
        ON b.old = l.shard AND 2 * l.before + l.size >= 2 * b.low AND 2 * l.before + l.size < 2 * b.high)"""


def reshard() -> str:
    data = "encode(coalesce(text, ''))"
    parts, rows = [], "sharded"
    for k in range(1, resharding.ROUNDS + 1):
        order = "size DESC, text_crc32, doc_id" if k == resharding.ROUNDS else "text_crc32, doc_id"
        parts.append(_round(k, rows, order))
        rows = f"after{k}"
        parts.append(f"{rows} AS (SELECT doc_id, size, text_crc32, old_shard, new_shard AS shard FROM placed{k})")
    return f"""
    WITH sized AS MATERIALIZED (
      SELECT doc_id, octet_length({data}) + 1 AS size, coalesce({crc32_of(data)}, 0) AS text_crc32 FROM documents),
    sharded AS (
      SELECT *, text_crc32 % {resharding.OLD_SHARDS} AS old_shard, text_crc32 % {resharding.OLD_SHARDS} AS shard FROM sized),
    {", ".join(parts)}
    SELECT doc_id, size, text_crc32, 'bytes' AS law, new_shard AS shard,
      row_number() OVER (PARTITION BY new_shard ORDER BY shard, pos) - 1 AS slot, NULL::INTEGER AS grown_shard, old_shard
    FROM placed{resharding.ROUNDS}"""
