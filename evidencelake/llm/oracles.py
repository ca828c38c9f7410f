"""DuckDB SQL of the operators on conversations and manifests, and its parts."""

from __future__ import annotations

#: CRC-32 of a short ASCII text, by the byte table; crc_table has one row, t.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i)) AS t)"


def crc(text: str) -> str:
    """Where crc_table is among what is read from."""
    bytes_of = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({bytes_of}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _levels(name: str, leaves: str, tree: str) -> str:
    """The nodes of all levels of the trees over leaves (tree, idx, n, d), 16 to a run."""
    return f"""{name}({tree}, lvl, idx, n, d) AS (
            SELECT {tree}, 0::BIGINT, idx, n, d FROM {leaves}
            UNION ALL
            SELECT {tree}, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY {tree}, lvl, idx // 16, n)"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""
    WITH RECURSIVE {CRC_TABLE},
        raw AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({_HEAD} || {_field('text')}) AS leaf,
                CASE WHEN {crc('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN sha256({_HEAD} || {_field(_LOWER)}) END AS changed FROM documents, crc_table),
        row_of AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS d FROM raw),
        {_levels('low', 'row_of', 'tree')},
        sub AS (SELECT tree, d, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
        {_levels('high', "(SELECT '' AS top, * FROM sub)", 'top')},
        step AS (
            SELECT r, lvl AS k, coalesce(string_agg(l.d, '' ORDER BY l.idx) FILTER (l.idx < o.idx // CAST(16 ** lvl AS BIGINT)), '') AS before, coalesce(string_agg(l.d, '' ORDER BY l.idx) FILTER (l.idx > o.idx // CAST(16 ** lvl AS BIGINT)), '') AS after
            FROM row_of o JOIN low l ON l.tree = o.tree AND l.n > 1 AND l.idx // 16 = o.idx // CAST(16 ** (lvl + 1) AS BIGINT) GROUP BY r, lvl
            UNION ALL
            SELECT r, 1000 + lvl, coalesce(string_agg(h.d, '' ORDER BY h.idx) FILTER (h.idx < s.idx // CAST(16 ** lvl AS BIGINT)), ''), coalesce(string_agg(h.d, '' ORDER BY h.idx) FILTER (h.idx > s.idx // CAST(16 ** lvl AS BIGINT)), '')
            FROM row_of o JOIN sub s ON s.tree = o.tree JOIN high h ON h.n > 1 AND h.idx // 16 = s.idx // CAST(16 ** (lvl + 1) AS BIGINT) GROUP BY r, lvl),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS place FROM step),
        fold(r, place, own) AS (
            SELECT r, 0::BIGINT, coalesce(changed, leaf) FROM row_of
            UNION ALL
            SELECT f.r, o.place, sha256(o.before || f.own || o.after) FROM fold f JOIN ordered o ON o.r = f.r AND o.place = f.place + 1),
        ended AS (SELECT r, arg_max(own, place) AS folded_root FROM fold GROUP BY r),
        proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY place)) AS p FROM ordered GROUP BY r)
    SELECT doc_id, leaf, s.d AS subroot, h.d AS root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root = h.d AS verified
    FROM row_of o JOIN sub s ON s.tree = o.tree JOIN ended USING (r) JOIN high h ON h.n = 1 LEFT JOIN proof USING (r)"""

_ESCAPED = r"(length({0}) * 2 - length(replace({0}, '\', '')) + len(regexp_extract_all({0}, '<s>|</s>|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|\[OUT\]|\[ROLE\]|\[TEXT\]|\[/ROLE\]')))"

CHAT = f"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
    marked AS (SELECT *, {_ESCAPED.format('text')} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 13 ELSE 23 + {_ESCAPED.format('role')} END AS n FROM said)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(3 + sum(n) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id"""

TRIE = f"""
    WITH {CRC_TABLE},
    said AS (SELECT conv_id, turn, strlen(coalesce(text, '')) AS n_bytes, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS said FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS pos FROM said),
    convs AS (SELECT conv_id, {crc('CAST(conv_id AS VARCHAR)')} % 9 AS h, conv_id - ((conv_id % 5) + 5) % 5 AS lender FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
    rebuilt AS (
        SELECT c.conv_id, 0 AS part, pos, said, n_bytes FROM convs c JOIN turns t ON t.conv_id = lender AND pos < h
        UNION ALL SELECT c.conv_id, 1, pos, said, n_bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h),
    whole AS (SELECT conv_id, coalesce(string_agg(said, '' ORDER BY part, pos), '') AS key, count(said) AS length, list(n_bytes ORDER BY part, pos) AS sizes FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
    member AS (SELECT conv_id, d, left(key, 64 * d) AS key, d = length AS ended, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS n_bytes FROM (SELECT *, unnest(range(length + 1)) AS d FROM whole)),
    node AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM member GROUP BY key, d),
    kids AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
    own AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
    sums AS (SELECT o.key, count(*) FILTER (x.n_children = 0) AS n_leaves, CAST(sum((x.n_convs - 1) * x.n_bytes) AS BIGINT) AS saved_tokens FROM own o JOIN own x ON starts_with(x.key, o.key) GROUP BY o.key)
    SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(o.ends) AS ends_sha256
    FROM own o JOIN sums USING (key) LEFT JOIN own p ON o.d > 0 AND p.key = left(o.key, 64 * (o.d - 1))"""

#: Runs outside the six white space characters.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: The quality rules' ledger: every measurement and the failed bits.
_MEASURES = rf"""
w AS (
    SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
triples AS (
    SELECT uid, i, count(*) OVER (PARTITION BY uid, triple) AS n
    FROM (SELECT uid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS triple FROM w)),
repeats AS (SELECT uid, count(DISTINCT i + k) AS n FROM triples, unnest([0, 1, 2]) AS t(k) WHERE n > 1 GROUP BY uid),
measures AS (
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(repeats.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(w, lambda x: strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
        len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_shout_words,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]') OR strlen(x) > length(x))) AS n_letter_words
    FROM w LEFT JOIN repeats USING (uid)),
failures AS (
    SELECT *, n_words < 50 AS too_short, 100 * n_repeat_words > 50 * n_words AS repeats_itself, 10 * n_symbols > 3 * n_words AS symbols,
        100 * n_upper_words > 60 * n_words AS upper_case, n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines AS repeated_lines,
        word_chars > 20 * n_words AS word_length, 100 * n_shout_words > 40 * n_words AS shouting, 100 * n_letter_words < 60 * n_words AS few_letters
    FROM measures),
ledger AS (
    SELECT *, (too_short::INT + 2 * repeats_itself::INT + 4 * symbols::INT + 8 * upper_case::INT + 16 * repeated_lines::INT
        + 32 * word_length::INT + 64 * shouting::INT + 128 * few_letters::INT)::BIGINT AS failed FROM failures)"""

RULES = f"""
WITH {_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, too_short OR repeats_itself AS base_failed, failed = 0 AS kept,
    failed AS failed_bits, n_lines, n_upper_words, n_shout_words, n_letter_words FROM ledger"""

ABLATION = f"""
WITH {_MEASURES},
rules AS (SELECT unnest(['too_short', 'repeats_itself', 'symbols', 'upper_case', 'repeated_lines', 'word_length', 'shouting', 'few_letters']) AS rule, unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS bit)
SELECT count(failed) AS n_docs, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_failed_alone
FROM rules LEFT JOIN ledger ON true GROUP BY rule"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reached AS (
    SELECT DISTINCT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY ALL"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
blocks AS (SELECT doc_id, k, substr(h, 512 * k + 1, 610) AS h FROM d, unnest(range((n_bytes + 206) // 256)) AS t(k)),
starts AS (
    SELECT doc_id, 256 * k + i AS p, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM blocks, unnest(range(256)) AS t(i) WHERE 2 * i + 100 <= strlen(h)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
again AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM starts JOIN firsts USING (s) WHERE doc_id > first),
runs AS (SELECT doc_id, p, sum(CASE WHEN before + 50 >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM again),
spans AS (SELECT doc_id, run, min(p) AS b, max(p) + 50 AS e FROM runs GROUP BY ALL),
gaps AS (
    SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS b, b AS e FROM spans
    UNION ALL SELECT doc_id, max(e), 1e15::BIGINT FROM spans GROUP BY doc_id UNION ALL SELECT doc_id, 0, 1e15::BIGINT FROM d ANTI JOIN spans USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (least(e, n_bytes) - b)), '' ORDER BY b))) AS kept_sha256 FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

WORD_SCORES = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i, len(w) AS size FROM w, unnest(range(1, len(w) + 1)) AS t(i)),
n1 AS (SELECT a, count(*) AS n FROM g GROUP BY ALL), n2 AS (SELECT a, b, count(*) AS n FROM g WHERE i < size GROUP BY ALL),
n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE i + 1 < size GROUP BY ALL),
s AS (
    SELECT n3.a, n3.b, n3.c, ln(CASE WHEN n3.n >= 2 THEN n3.n / ab.n WHEN bc.n >= 2 THEN 0.4::DOUBLE * bc.n / b.n ELSE 0.4::DOUBLE * 0.4::DOUBLE * c.n / (SELECT sum(n) FROM n1) END) AS s
    FROM n3 JOIN n2 ab ON ab.a = n3.a AND ab.b = n3.b JOIN n2 bc ON bc.a = n3.b AND bc.b = n3.c JOIN n1 b ON b.a = n3.b JOIN n1 c ON c.a = n3.c),
d AS (SELECT doc_id, count(*) AS n_grams, sum(s.s) AS total FROM g JOIN s USING (a, b, c) WHERE i + 1 < size GROUP BY doc_id)
SELECT doc_id, coalesce(n_grams, 0) AS n_grams, round(total / n_grams, 6) AS score FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN d USING (doc_id)"""
