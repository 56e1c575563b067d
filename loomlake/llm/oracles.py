"""The operators of this subpackage that DuckDB's SQL can express, written out in it."""

from __future__ import annotations

from .mixing import CAP, MERITS, ROUNDS, SLACK, WEIGHTS

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
#: The unsigned CRC-32 of a short ASCII text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_transform(range(length({0})), lambda k: ascii(substr({0}, CAST(k + 1 AS BIGINT), 1))::BIGINT),
    lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT))"""


def mix() -> str:
    weight = f"CAST([{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE)"
    rank = "CASE WHEN odds > 0 THEN u * (1 - odds) / (u * (1 - odds) + odds * (1 - u)) ELSE 1 + u END"
    u = "(CAST('0x' || md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(coalesce(text, ''))))[:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
    parts = [
        f"w AS MATERIALIZED (SELECT doc_id, source, {WORDS.format('coalesce(text, chr(32))')} AS w, {u} AS u FROM documents)",
        f"i AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS s, source, CAST(len(w) AS BIGINT) AS size, CASE WHEN len(w) > 0 THEN ({MERITS} * len(list_distinct(w)) + len(w) - 1) // len(w) ELSE 1 END AS merit, u FROM w)",
        f"src AS (SELECT source, source_size, {weight} AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM i GROUP BY source))",
        # sources by how soon they are full: the first j of them are, where the unit of the rest leaves the next one below its cap
        f"o AS (SELECT *, {CAP} * source_size / weight AS brim, CAST((sum(source_size) OVER ()) AS DOUBLE) - CAST(coalesce(sum({CAP} * source_size) OVER before, 0) AS DOUBLE) AS mass, (sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0) AS rest FROM src WINDOW before AS (ORDER BY {CAP} * source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        "unit AS (SELECT min_by(mass / rest, brim) AS unit FROM o WHERE mass / rest <= brim)",
        f"t AS MATERIALIZED (SELECT source, source_size, least(CAST({CAP} * source_size AS DOUBLE), weight * unit) AS target FROM src, unit)",
        "lv AS (SELECT source, merit, CAST(sum(size) AS BIGINT) AS words FROM i GROUP BY source, merit)",
        f"ks AS (SELECT lv.source, merit, words, target, (target - {CAP} * coalesce(sum(words) OVER before, 0)) / nullif((sum(merit * words) OVER (PARTITION BY lv.source)) - coalesce(sum(merit * words) OVER before, 0), 0) AS k FROM lv JOIN t ON lv.source IS NOT DISTINCT FROM t.source WINDOW before AS (PARTITION BY lv.source ORDER BY merit DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"k AS (SELECT source, coalesce(max_by(k, merit) FILTER (k * merit <= {CAP}), 'inf'::DOUBLE) AS k FROM ks GROUP BY source)",
        f"e AS MATERIALIZED (SELECT ks.source, merit, words, target, least({CAP}::DOUBLE, k.k * merit) AS e FROM ks JOIN k ON ks.source IS NOT DISTINCT FROM k.source)",
        "r0 AS (SELECT e.source, greatest(0, CAST(floor(any_value(target) + 0.5) AS BIGINT) - CAST(sum(CAST(floor(e) AS BIGINT) * words) AS BIGINT)) AS room FROM e GROUP BY source)",
        "d AS (SELECT i.*, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS odds FROM i JOIN e ON i.source IS NOT DISTINCT FROM e.source AND i.merit = e.merit)",
        f"p0 AS MATERIALIZED (SELECT doc_id, d.source, size, whole, {rank} AS rank, room, source_size // {SLACK} AS slack, false AS chosen FROM d JOIN r0 ON d.source IS NOT DISTINCT FROM r0.source JOIN t ON d.source IS NOT DISTINCT FROM t.source)",
    ]
    for n in range(ROUNDS):
        able = f"NOT chosen AND size > 0 AND whole < {CAP} AND size <= room"
        parts.append(f"q{n} AS (SELECT *, {able} AND (sum(CASE WHEN {able} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank)) <= room AND (SELECT count(*) FROM p{n} WHERE room > slack OR {n} = 0) > 0 AS now FROM p{n})")
        parts.append(f"p{n + 1} AS MATERIALIZED (SELECT doc_id, source, size, whole, rank, slack, room - (sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source)) AS room, chosen OR now AS chosen FROM q{n})")
    return f"WITH {', '.join(parts)} SELECT doc_id, size, source_size, target, CAST(size * (whole + CAST(chosen AS INT)) AS BIGINT) AS taken, CAST(whole + CAST(chosen AS INT) AS INT) AS copies, p.source FROM p{ROUNDS} p JOIN t ON p.source IS NOT DISTINCT FROM t.source"


def trie() -> str:
    crc = CRC32.format("CAST(conv_id AS VARCHAR)")
    return f"""WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT conv_id, conv_id - conv_id % 20 AS family, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
  rebuilt AS (SELECT ids.conv_id, 0 AS part, n, role, text FROM ids JOIN turns ON family = turns.conv_id WHERE n <= h UNION ALL SELECT ids.conv_id, 1, n, role, text FROM ids JOIN turns USING (conv_id) WHERE n > h),
  numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS depth, role, text FROM rebuilt),
  whole AS (SELECT conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY depth) FILTER (depth > 0), []) AS path, coalesce(max(depth), 0) AS depth, list({{'d': depth, 'w': len({WORDS.format("text")})}}) FILTER (depth > 0) AS words FROM ids LEFT JOIN numbered USING (conv_id) GROUP BY conv_id),
  prefixes AS (SELECT conv_id, d AS depth, path[:d] AS path, d = whole.depth AS ends, coalesce(list_filter(words, lambda x: x.d = d)[1].w, 0) AS w FROM whole, unnest(range(whole.depth + 1)) AS u(d)),
  nodes AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY depth, path),
  kids AS (SELECT p.depth, p.path, count(*) AS n_children FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND c.path[:p.depth] = p.path GROUP BY ALL),
  held AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
  sums AS (SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens FROM held a JOIN held b ON b.depth >= a.depth AND b.path[:a.depth] = a.path GROUP BY ALL)
  SELECT h.conv_id, h.depth, p.conv_id AS parent_conv_id, h.n_convs, h.n_children, n_leaves, saved_tokens, h.ends_sha256 FROM held h JOIN sums USING (depth, path) LEFT JOIN nodes p ON p.depth = h.depth - 1 AND p.path = h.path[:h.depth - 1]"""


def audit(levels: int = 24) -> str:
    """The manifest with all levels unrolled: as many as trees of 2 to that power of leaves have."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field(n)} || {field('text')})"
    odd = f"{CRC32.format('CAST(doc_id AS VARCHAR)')} % 7 = 0"

    def tower(name: str, first: str) -> list[str]:
        """name0 to nameN (tree, i, h, n) and name_p0 to name_pN (tree, leaf, i, sides)."""
        out = [f"{name}0 AS MATERIALIZED ({first})"]
        for k in range(levels):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 2 AS i, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (n + 1) // 2 AS n FROM {name}{k} GROUP BY tree, i // 2, n)")
        return out

    def fold(name: str, first: str) -> list[str]:
        """Each leaf's claim, raised level by level, and its proof so far."""
        out = [f"{name}_f0 AS ({first})"]
        for k in range(levels):
            out.append(f"""{name}_f{k + 1} AS (SELECT f.tree, f.i // 2 AS i, f.id, f.proof || coalesce(s.h, '') AS proof, CASE WHEN {name}{k}.n = 1 THEN f.claim WHEN f.i % 2 = 0 THEN sha256(f.claim || coalesce(s.h, '')) ELSE sha256(s.h || f.claim) END AS claim
    FROM {name}_f{k} f JOIN {name}{k} ON {name}{k}.tree = f.tree AND {name}{k}.i = f.i LEFT JOIN {name}{k} s ON s.tree = f.tree AND s.i = xor(f.i, 1))""")
        return out

    parts = [
        f"leaves AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {odd} THEN {leaf('n_chars + 1')} END AS changed FROM documents)",
        "placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
        *tower("a", "SELECT tree, i, leaf AS h, n FROM placed"),
        f"subroots AS MATERIALIZED (SELECT tree, h FROM a{levels})",
        *tower("b", "SELECT 0 AS tree, tree AS i, h, (SELECT count(*) FROM subroots) AS n FROM subroots"),
        *fold("a", "SELECT tree, i, id, '' AS proof, coalesce(changed, leaf) AS claim FROM placed"),
        *fold("b", f"SELECT 0 AS tree, tree AS i, id, proof, claim FROM a_f{levels}"),
    ]
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroots.h AS subroot, b{levels}.h AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = b{levels}.h AS verified FROM placed JOIN subroots USING (tree) JOIN b_f{levels} USING (id) CROSS JOIN b{levels}"""


ORACLE_SQL = {"op11_source_mix": mix(), "op12_prefix_trie": trie(), "op13_merkle_manifest": audit()}
