"""SQL twins, for DuckDB, of the queries that SQL can express.

They take the plain way: no sketches or bands, every pair of sets that share a shingle is compared; words and seeds are
compared as texts instead of hashes; payloads are grouped by themselves.
"""

from __future__ import annotations

from returns_risk.llm.decontaminate import EQUAL, MASKS, WINDOW
from returns_risk.llm.licenses import RULES, SENTENCES
from returns_risk.llm.phrases import COVERED, FACTOR, LEAST, TOP

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _leaks() -> str:
    words = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    masks = []
    for k, mask in enumerate(MASKS):
        key = ", ' ', ".join(f"words[i + {at + 1}]" for at, on in enumerate(mask) if on == "1")
        masks.append(
            f"SELECT id, {k} AS mask, i, concat({key}) AS seed"
            f" FROM (SELECT id, words, unnest(range(0, len(words) - {len(mask) - 1})) AS i FROM {{0}})"
        )
    seeds = " UNION ALL ".join(masks)
    equal = "list_transform(range(1, len(b.words) + 1), lambda j: CASE WHEN shift + j > 0 AND d.words[shift + j] = b.words[j] THEN 1 ELSE 0 END)"
    width = f"least({WINDOW}, len(words))"
    sums = f"list_transform(range(1, len(words) - {width} + 2), lambda i: list_sum(list_slice(e, i, i + {width} - 1)))"
    return f"""
    WITH d AS (SELECT doc_id AS id, {words} AS words FROM documents),
    b AS (SELECT item_id AS id, {words} AS words FROM benchmark),
    hits AS (
        SELECT DISTINCT x.id AS doc, y.id AS item, x.i - y.i AS shift
        FROM ({seeds.format('d')}) x JOIN ({seeds.format('b')}) y ON x.mask = y.mask AND x.seed = y.seed
    ),
    laid AS (SELECT doc, item, b.words AS words, {equal} AS e FROM hits JOIN d ON d.id = doc JOIN b ON b.id = item),
    found AS (SELECT DISTINCT doc, item FROM laid WHERE list_max({sums}) * {WINDOW} >= {EQUAL} * {width}),
    listed AS (SELECT doc, count(*) AS n, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM found GROUP BY doc)
    SELECT doc_id, items IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items
    FROM documents LEFT JOIN listed ON doc = doc_id
    """


_NEAR = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
s AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 2 THEN words
        ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS found FROM w
),
sets AS (SELECT min(doc_id) AS node, len(found) AS n, found FROM s WHERE len(found) > 0 GROUP BY found),
parts AS (SELECT node, n, unnest(found) AS shingle FROM sets),
links AS (
    SELECT x.node AS a, y.node AS b FROM parts x JOIN parts y
        ON x.shingle = y.shingle AND x.node <> y.node AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
),
reach AS (
    SELECT node, node AS label FROM sets
    UNION
    SELECT links.b, reach.label FROM reach JOIN links ON links.a = reach.node WHERE reach.label < links.b
),
classes AS (SELECT found, min(label) AS label FROM reach JOIN sets USING (node) GROUP BY found)
SELECT doc_id, len(s.found)::BIGINT AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept
FROM s LEFT JOIN classes USING (found)
"""

_DIGIT = " + ".join(f"{16 >> k} * substr(bits, 5 * i + {k + 1}, 1)::INT" for k in range(5))
_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first, unhex(sha1(html))::BIT::VARCHAR AS bits FROM p GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('{_LETTERS}234567', ({_DIGIT} + 1)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.html = f.html
"""


def _licenses() -> str:
    normal = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    known = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in SENTENCES.items())
    cut = r"regexp_split_to_array({0}, '[\n\r;!?]+|\.[ \t]+|\.$')"
    unwrapped = r"regexp_replace(regexp_replace(text, '\n[ \t\r]*\n', ';', 'g'), '[\n\r]+', ' ', 'g')"

    def occurs(ids: tuple[str, ...]) -> str:
        pattern = "%" + "%".join(f"<{name}>" for name in ids) + "%"
        return f"(coalesce(lined, '') LIKE '{pattern}' OR coalesce(joined, '') LIKE '{pattern}')"

    def within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
        places = [long.index(name) for name in short if name in long]
        return len(short) < len(long) and len(places) == len(short) and places == sorted(places)

    rules = []
    for name, ids in RULES:
        longer = "".join(f" AND NOT {occurs(other)}" for _, other in RULES if within(ids, other))
        rules.append(f"CASE WHEN {occurs(ids)}{longer} THEN '{name}' END")
    return f"""
    WITH known AS (SELECT name, {normal.format('sentence')} AS form FROM (VALUES {known}) v(name, sentence)),
    cut AS (
        SELECT doc_id, 0 AS way, {cut.format("coalesce(text, '')")} AS parts FROM documents
        UNION ALL SELECT doc_id, 1, {cut.format(unwrapped)} FROM documents WHERE text IS NOT NULL
    ),
    parts AS (SELECT doc_id, way, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
    ids AS (SELECT doc_id, way, name, pos FROM parts JOIN known ON form = {normal.format('part')}),
    tagged AS (
        SELECT doc_id, string_agg('<' || name || '>', '' ORDER BY pos) FILTER (way = 0) AS lined,
            string_agg('<' || name || '>', '' ORDER BY pos) FILTER (way = 1) AS joined,
            string_agg(name, ',' ORDER BY pos) FILTER (way = 0) AS sentences, count(*) FILTER (way = 0) AS n
        FROM ids GROUP BY doc_id
    )
    SELECT doc_id,
        coalesce(array_to_string(list_sort(list_distinct([{', '.join(rules)}])), ','), '') AS licenses,
        coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentences, '') AS sentences
    FROM documents LEFT JOIN tagged USING (doc_id)
    """


def _trie() -> str:
    bits = "lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"lambda c, b: xor(c >> 8, list_reduce(list_concat([xor(c, b) & 255], range(8)), {bits}))"
    codes = "list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)"
    return f"""
    WITH own AS (
        SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ),
    cut AS (SELECT c, turns, (xor(list_reduce(list_concat([4294967295], {codes}), {byte}), 4294967295) % 9)::INT AS h FROM own),
    rebuilt AS (
        SELECT x.c, list_concat(CASE WHEN y.turns IS NULL THEN [] ELSE y.turns[1:h] END, x.turns[h + 1:]) AS turns
        FROM cut x LEFT JOIN own y ON y.c = x.c - x.c % 5
    ),
    steps AS (SELECT c, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
    nodes AS (
        SELECT depth, turns[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, sum((n > depth)::INT) AS further,
            coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '') AS ends
        FROM steps GROUP BY 1, 2
    ),
    sized AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].text) END AS saved FROM nodes),
    below AS (
        SELECT x.depth, x.path, sum((y.depth = x.depth + 1)::INT) AS n_children, sum((y.further = 0)::INT) AS n_leaves, sum(y.saved) AS saved_tokens
        FROM sized x JOIN sized y ON y.depth >= x.depth AND y.path[1:x.depth] = x.path GROUP BY 1, 2
    )
    SELECT s.conv_id, s.depth, up.conv_id AS parent_conv_id, s.n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
        saved_tokens::BIGINT AS saved_tokens, sha256(s.ends) AS ends_sha256
    FROM sized s JOIN below b ON b.depth = s.depth AND b.path = s.path
    LEFT JOIN sized up ON up.depth = s.depth - 1 AND up.path = s.path[1:s.depth - 1]
    """


_PHRASES = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(size)),
f AS (
    SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM g
    GROUP BY ALL HAVING count(*) >= {LEAST}
),
cuts AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM f WHERE size > 1
),
scored AS (
    SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, (a::HUGEINT * {FACTOR}) // (x.f + y.f) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')
),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
    SELECT * FROM worst c WHERE NOT EXISTS (
        SELECT 1 FROM f o WHERE o.lang = c.lang AND o.size > c.size AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ')
            AND 100 * o.f >= {COVERED} * a
    )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}
"""


ORACLE_SQL = {
    "op2_benchmark_decontamination": _leaks(),
    "op3_minhash_near_dedup": _NEAR,
    "op7_warc": _WARC,
    "op8_license_scans": _licenses(),
    "op11_conversation_trie": _trie(),
    "op13_phrase_collocations": _PHRASES,
}
