"""SQL that gives the same rows as the queries it is registered with, computed another way."""

CRC32 = """list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), list_transform(range(8), lambda bit: 0::BIGINT)),
        lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_TAMPERED = "CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END"


def _tree(name: str, leaves: str, group: str, of: str) -> str:
    """Nodes of all levels, the digests of each run, and every leaf's fold up to its root."""
    return f"""
{name}_nodes AS (
    SELECT {group} AS grp, 0 AS level, idx, digest FROM {leaves}
    UNION ALL
    SELECT grp, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS nodes FROM {name}_nodes) WHERE nodes > 1
    GROUP BY grp, level, idx // 3
),
{name}_runs AS (
    SELECT grp, level, idx // 3 AS run, list(digest ORDER BY idx) AS digests
    FROM (SELECT *, count(*) OVER (PARTITION BY grp, level) AS nodes FROM {name}_nodes) WHERE nodes > 1
    GROUP BY grp, level, idx // 3
),
{name}_walk AS (
    SELECT {of} AS item, {group} AS grp, 0 AS level, idx, claimed AS folded, '' AS proof FROM {leaves}
    UNION ALL
    SELECT w.item, w.grp, w.level + 1, w.idx // 3,
        sha256(array_to_string(digests[:w.idx % 3] || [w.folded] || digests[w.idx % 3 + 2:], '')),
        w.proof || array_to_string(digests[:w.idx % 3] || digests[w.idx % 3 + 2:], '')
    FROM {name}_walk w JOIN {name}_runs r ON w.grp IS NOT DISTINCT FROM r.grp AND w.level = r.level AND w.idx // 3 = r.run
),
{name}_ends AS (SELECT * FROM {name}_walk QUALIFY row_number() OVER (PARTITION BY item ORDER BY level DESC) = 1),
{name}_roots AS (SELECT grp, digest FROM {name}_nodes QUALIFY row_number() OVER (PARTITION BY grp ORDER BY level DESC) = 1)"""


MERKLE = f"""
WITH RECURSIVE marked AS (
    SELECT *, xor({CRC32.format(text="doc_id::VARCHAR")}, 4294967295::BIGINT) % 2 = 0 AS tampered FROM documents
),
hashed AS (SELECT doc_id, source, {_leaf("text")} AS digest, {_leaf(_TAMPERED)} AS claimed FROM marked),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, row_number() OVER () AS item FROM hashed
),
{_tree("low", "leaves", "source", "item")},
subroots AS (SELECT grp AS source, digest, digest AS claimed, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx FROM low_roots),
{_tree("high", "subroots", "0", "idx")},
-- The fold goes on from the folded subroot, with the siblings of the subroot's own way up.
onward AS (
    SELECT e.item, s.idx, e.folded, e.proof, 0 AS level FROM low_ends e JOIN subroots s ON e.grp IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT o.item, o.idx // 3,
        sha256(array_to_string(digests[:o.idx % 3] || [o.folded] || digests[o.idx % 3 + 2:], '')),
        o.proof || array_to_string(digests[:o.idx % 3] || digests[o.idx % 3 + 2:], ''), o.level + 1
    FROM onward o JOIN high_runs r ON o.level = r.level AND o.idx // 3 = r.run
),
ends AS (SELECT * FROM onward QUALIFY row_number() OVER (PARTITION BY item ORDER BY level DESC) = 1)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(e.proof) AS proof_sha256,
    e.folded AS folded_root, e.folded = t.digest AS verified
FROM leaves l JOIN ends e USING (item) JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN high_roots t
"""


def _escaped(text: str) -> str:
    angle = rf"regexp_replace({text}, '<(\\*)(s>|/s>|\|text\|>)', '<\\\1\2', 'g')"
    return rf"regexp_replace({angle}, '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"


CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (length('<s>') + sum(length({_escaped("text")}) + CASE WHEN role = 'assistant' THEN length('</s>')
        ELSE length('[INST]' || {_escaped("role")} || '<|text|>' || '[/INST]') END))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

COLLOCATIONS = r"""
WITH texts AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
pieces AS (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM texts
),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM starts, range(1, 6) AS sizes(m) WHERE i + m - 1 <= len(w)
),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE m > 1 AND f >= 100),
inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longest
    FROM candidates, range(2, 5) AS sizes(s), range(1, 5) AS places(i) WHERE s < m AND i + s - 1 <= m GROUP BY ALL
),
kept AS (
    SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.longest IS NULL OR 100 * i.longest < 100 * c.a
),
cuts AS (
    SELECT k.lang, k.phrase, k.a, k.m, cut, t.n, array_to_string(k.w[:cut], ' ') AS head, array_to_string(k.w[cut + 1:], ' ') AS tail
    FROM kept k JOIN totals t ON k.lang = t.lang, range(1, 5) AS places(cut) WHERE cut < k.m
),
scored AS (
    SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.n, cut,
        ((1000::HUGEINT * c.a * c.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON c.lang = x.lang AND c.head = x.phrase JOIN counts y ON c.lang = y.lang AND c.tail = y.phrase
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored QUALIFY rank <= 2000
"""
