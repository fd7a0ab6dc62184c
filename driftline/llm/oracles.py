"""DuckDB counterparts of the queries that SQL can express."""

_CHAT = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
marked AS (
    SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens, role IS DISTINCT FROM lead(role) OVER w AS closes,
        regexp_replace(regexp_replace(replace(text, '\', '\\'), '<\|', '<\\|', 'g'), '\|>', '|\\>', 'g') AS shown
    FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(shown) + CASE WHEN opens THEN 4 + length(role) ELSE 8 END + CASE WHEN closes THEN 7 ELSE 0 END) AS BIGINT)
        AS formatted_chars
FROM marked GROUP BY conv_id
"""

_TOPK = """
WITH ints AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM ints q JOIN ints c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

# CRC-32 of a list of bytes, bit by bit.
_CRC32 = """
    xor(list_reduce(list_prepend(4294967295::UBIGINT, {bytes}), lambda c, b:
        list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, x:
            CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)), 4294967295::UBIGINT)
"""


def _field(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return f"sha256({' || '.join(map(_field, fields))})"


_MERKLE = f"""
WITH RECURSIVE marked AS (
    SELECT *, CASE WHEN {_CRC32.format(bytes="list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))")} % 2 = 0
        THEN replace(text, chr(10), '') ELSE text END AS claimed
    FROM documents
),
leaves AS (
    SELECT doc_id, coalesce('+' || source, '') AS g, {_leaf("text")} AS h, {_leaf("claimed")} AS presented FROM marked
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
    FROM leaves
),
up AS (
    SELECT 0 AS level, g, pos, n, h FROM placed
    UNION ALL
    SELECT level + 1, g, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM up WHERE n > 1 GROUP BY level, g, pos // 3, (n + 2) // 3
),
subroots AS (
    SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
),
top AS (
    SELECT 0 AS level, place AS pos, n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM top WHERE n > 1 GROUP BY level, pos // 3, (n + 2) // 3
),
steps AS (
    SELECT p.g, p.pos, u.level, u.g IS NULL AS none,
        coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < p.pos // CAST(3 ** u.level AS BIGINT)), '') AS l,
        coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > p.pos // CAST(3 ** u.level AS BIGINT)), '') AS r
    FROM placed p JOIN up u ON u.g = p.g AND u.n > 1 AND u.pos // 3 = p.pos // CAST(3 ** (u.level + 1) AS BIGINT)
    GROUP BY ALL
    UNION ALL
    SELECT p.g, p.pos, 1000 + t.level, false,
        coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.place // CAST(3 ** t.level AS BIGINT)), ''),
        coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.place // CAST(3 ** t.level AS BIGINT)), '')
    FROM placed p JOIN subroots s USING (g) JOIN top t ON t.n > 1 AND t.pos // 3 = s.place // CAST(3 ** (t.level + 1) AS BIGINT)
    GROUP BY ALL
),
proofs AS (
    SELECT g, pos, list(l || '|' || r ORDER BY level) AS proof FROM steps GROUP BY g, pos
),
folded AS (
    SELECT p.doc_id, p.h AS leaf, s.subroot, (SELECT h FROM top WHERE n = 1) AS root,
        sha256(replace(array_to_string(coalesce(f.proof, []), ''), '|', '')) AS proof_sha256,
        list_reduce(list_prepend(p.presented, coalesce(f.proof, [])),
            lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root
    FROM placed p JOIN subroots s USING (g) LEFT JOIN proofs f ON f.g = p.g AND f.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""

# UTF-8 bytes of a text of code points up to U+00FF.
_BYTES = """flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS UBIGINT)]
    ELSE [CAST(192 + unicode(x) // 64 AS UBIGINT), CAST(128 + unicode(x) % 64 AS UBIGINT)] END))"""

_SPELLING = f"""
WITH RECURSIVE found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
),
counted AS (
    SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY doc_id, run
),
hashed AS (
    SELECT *, {_CRC32.format(bytes=_BYTES.format(text="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM counted
),
words AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word,
        CAST(sum(n) AS BIGINT) AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
),
variants AS (
    SELECT word, n, unnest(range(length(word))) AS i FROM words
),
opened AS (
    SELECT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS open, left(word, i) || substr(word, i + 2) AS less FROM variants
),
near AS (
    SELECT a.word, b.word AS near, b.n FROM opened a JOIN opened b USING (i, open) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM opened a JOIN words b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM opened a JOIN words b ON a.less = b.word
),
best AS (
    SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
),
named AS (
    SELECT b.word, b.n_near, b.most, min(near.near) AS name FROM best b JOIN near ON near.word = b.word AND near.n = b.most GROUP BY ALL
),
forms AS (
    SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near,
        CASE WHEN m.most >= 5 * w.n THEN m.name END AS form, CASE WHEN m.most >= 5 * w.n THEN m.most END AS form_n
    FROM words w LEFT JOIN named m ON m.word = w.word
),
ways AS (
    SELECT word, word AS root FROM forms
    UNION ALL
    SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
),
roots AS (
    SELECT w.word, w.root FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""

ORACLES = {"op3_chat": _CHAT, "op6_topk": _TOPK, "op11_spelling": _SPELLING, "op13_merkle": _MERKLE}
