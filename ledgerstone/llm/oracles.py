"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

from ledgerstone.llm.sharding import Topology, grow, topology
from ledgerstone.plans.fixtures import crc_sql

# Words are runs of bytes outside 0x20 and 0x09-0x0D; lower() is kept to A-Z by translate().
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


def _words(lower: bool) -> str:
    text = f"translate(text, '{_UPPER}', '{_LOWER}')" if lower else "text"
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SPACE}'), lambda x: x <> '')"


OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(True)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, both_.y FROM reach JOIN both_ ON reach.b = both_.x),
k AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN k ON a = doc_id
"""

_TOKENS = r"""regexp_extract_all(coalesce(text, ''), '\p{L}[\p{L}\p{N}]*|[0-9]+(?:[.,][0-9]+)*')"""


def op3(window: int, coverage: float, units: list[str], plain: int) -> str:
    """Template windows of documents and items, equal in template and in slot pattern, that agree with their diagonal's binding; items of at least a window."""
    known = ", ".join(f"'{u}'" for u in units)

    def windows(table: str, key: str) -> str:
        return f"""
{table}_k AS (SELECT DISTINCT {key}, {_TOKENS} AS k FROM {table}),
{table}_t AS (SELECT {key}, list_transform(k, lambda x: lower(x)) AS v, list_transform(range(1, len(k) + 1), lambda i: CASE WHEN k[i][1] BETWEEN '0' AND '9' THEN '@d' WHEN i > 1 AND k[greatest(i - 1, 1)][1] BETWEEN '0' AND '9' AND lower(k[i]) IN ({known}) THEN '@u' WHEN k[i][1] <> lower(k[i][1]) THEN '@n' ELSE lower(k[i]) END) AS t FROM {table}_k),
{table}_x AS (SELECT {key}, v, t, unnest(range(1, len(t) - {window} + 2)) AS pos FROM {table}_t WHERE len(t) >= {window}),
{table}_z AS (SELECT {key}, pos, v[pos:pos + {window - 1}] AS v, t[pos:pos + {window - 1}] AS t FROM {table}_x),
{table}_y AS (SELECT {key}, pos, v, array_to_string(t, ' ') AS h, array_to_string(v, ' ') AS words, list_transform(range(1, {window + 1}), lambda j: CASE WHEN t[j] IN ('@d', '@n', '@u') THEN list_position(v, v[j]) ELSE 0 END) AS slots, len(list_filter(t, lambda x: x NOT IN ('@d', '@n', '@u'))) * {plain} < {window} AS bare FROM {table}_z)"""

    return f"""WITH {windows('documents', 'doc_id')},{windows('benchmark', 'item_id')},
pair AS (SELECT d.doc_id, b.item_id, b.pos, d.pos - b.pos AS diagonal, b.v AS iv, d.v AS dv, b.slots FROM documents_y d JOIN benchmark_y b ON d.h = b.h AND d.slots = b.slots WHERE NOT b.bare
UNION ALL SELECT d.doc_id, b.item_id, b.pos, d.pos - b.pos, b.v, d.v, []::BIGINT[] FROM documents_y d JOIN benchmark_y b ON d.words = b.words WHERE b.bare),
slot AS (SELECT * FROM (SELECT doc_id, item_id, diagonal, pos, unnest(range(1, len(slots) + 1)) AS j, iv, dv, slots FROM pair) s WHERE slots[j] > 0),
vote AS (SELECT doc_id, item_id, diagonal, iv[j] AS a, dv[j] AS b, count(DISTINCT pos + j) AS n FROM slot GROUP BY ALL),
bound AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, diagonal, a ORDER BY n DESC, b) = 1 AND row_number() OVER (PARTITION BY doc_id, item_id, diagonal, b ORDER BY n DESC, a) = 1 AS ok FROM vote),
off AS (SELECT DISTINCT slot.doc_id, slot.item_id, slot.diagonal, slot.pos FROM slot JOIN bound ON slot.doc_id = bound.doc_id AND slot.item_id = bound.item_id AND slot.diagonal = bound.diagonal AND iv[j] = a AND dv[j] = b WHERE NOT ok),
hit AS (SELECT doc_id, item_id, count(DISTINCT pos) AS n_windows FROM pair WHERE (doc_id, item_id, diagonal, pos) NOT IN (SELECT (doc_id, item_id, diagonal, pos) FROM off) GROUP BY doc_id, item_id),
total AS (SELECT item_id, count(DISTINCT pos) AS item_windows FROM benchmark_y GROUP BY item_id)
SELECT doc_id, hit.item_id, n_windows, item_windows, n_windows / item_windows AS coverage FROM hit JOIN total ON hit.item_id = total.item_id WHERE n_windows / item_windows >= {coverage}"""


OP5 = f"""
WITH w AS (SELECT doc_id, {_words(False)} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM w WHERE len(w) >= 20),
y AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(w[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS nth FROM x),
gone AS (SELECT DISTINCT doc_id, pos + j AS place FROM (SELECT doc_id, pos FROM y WHERE nth > 1) z, (SELECT unnest(range(0, 20)) AS j) s),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM w),
kept AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.place) FILTER (WHERE gone.place IS NULL) AS t, count(gone.place) AS n_removed FROM v LEFT JOIN gone ON v.doc_id = gone.doc_id AND v.place = gone.place GROUP BY v.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP9 = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS pos FROM b WHERE octet_length(b) >= 50),
y AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY b[pos:pos + 49]) AS first_doc FROM x),
z AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn, max(pos) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM y WHERE first_doc < doc_id),
r AS (SELECT doc_id, pos, sum(CASE WHEN before_ IS NULL OR pos > before_ + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM z),
spans AS (SELECT doc_id, min(pos) AS lo, max(pos) + 49 AS hi FROM r GROUP BY doc_id, run),
cuts AS (SELECT doc_id, CAST(sum(hi - lo + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, lo AS gap_end, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS gap_start FROM spans UNION ALL SELECT s.doc_id, octet_length(b) + 1, max(hi) FROM spans s JOIN b ON s.doc_id = b.doc_id GROUP BY s.doc_id, b),
kept AS (SELECT e.doc_id, string_agg(hex(b[gap_start + 1:gap_end - 1]), '' ORDER BY gap_start) AS h FROM edges e JOIN b ON e.doc_id = b.doc_id WHERE gap_end > gap_start + 1 GROUP BY e.doc_id)
SELECT b.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM b LEFT JOIN cuts ON b.doc_id = cuts.doc_id LEFT JOIN kept ON b.doc_id = kept.doc_id
"""


def op6(tree: Topology) -> str:
    """The descent as one join a level with the children of the node that the level before chose; slots as number_within() deals them."""
    number = lambda text: f"CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT)"
    name = "coalesce(CAST(doc_id AS VARCHAR), '')"

    def levels(tree: Topology, tag: str) -> str:
        leaves = ", ".join(f"('{region}', '{region}/{rack}', '{region}/{rack}/{shard}', CAST({weight} AS DOUBLE))" for region, rack, shard, weight in tree if weight > 0)
        out, before = [f"{tag}leaf AS (SELECT * FROM (VALUES {leaves}) t(l1, l2, l3, w))", f"{tag}0 AS (SELECT DISTINCT doc_id, '' AS l0 FROM documents)"], "''"
        for k in (1, 2, 3):
            out.append(f"{tag}w{k} AS (SELECT {before} AS parent, l{k} AS child, sum(w) AS w FROM {tag}leaf GROUP BY {before}, l{k})")
            draw = f"-ln((CAST({number(f"concat({name}, '|', child)")} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE)) / w"
            out.append(f"{tag}{k} AS (SELECT doc_id, child AS l{k} FROM (SELECT doc_id, child, row_number() OVER (PARTITION BY doc_id ORDER BY {draw}, child) AS nth FROM {tag}{k - 1} JOIN {tag}w{k} ON parent = l{k - 1}) x WHERE nth = 1)")
            before = f"l{k}"
        return ",\n".join([*out, f"{tag} AS (SELECT doc_id, CAST(split_part(l3, '/', 3) AS INT) AS shard FROM {tag}3)"])

    return f"""WITH {levels(tree, 'old')},
{levels(grow(tree), 'new')},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, {crc_sql('h')} AS text_crc32 FROM d),
p AS (SELECT *, {number(f"concat({name}, '|', text_crc32, '|', size)")} % greatest(16, least(4096, (SELECT count(*) FROM documents) // 2000)) AS cell FROM c)
SELECT p.doc_id, size, text_crc32, 'key' AS law, o.shard, row_number() OVER (PARTITION BY o.shard ORDER BY cell, p.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, g.shard AS grown_shard
FROM p JOIN old o ON p.doc_id IS NOT DISTINCT FROM o.doc_id JOIN new g ON p.doc_id IS NOT DISTINCT FROM g.doc_id"""


OP6 = op6(topology())
