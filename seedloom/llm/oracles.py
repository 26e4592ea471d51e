"""SQL twins of the queries that DuckDB can follow."""

from __future__ import annotations

from seedloom.llm.licenses import LEAST_COSINE, LEAST_LEAD, SPELLINGS, TEMPLATES, TRIGGER, VARIANT
from seedloom.llm.quality import RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

CHAT = r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), rendered AS (
        SELECT *, '### ' || upper(role[1]) || role[2:] || ': '
            || regexp_replace(text, '(### [A-Za-z0-9%=._~-]+: |</turn>)', '\\\1', 'g')
            || chr(10) || '</turn>' || chr(10) AS piece
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
    FROM rendered GROUP BY conv_id
"""

URLS = r"""
    WITH parsed AS (
        SELECT page_id, url,
            DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS INTEGER) % 366 AS INTEGER) AS fetched,
            lower(regexp_replace(regexp_replace(
                regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(?::[0-9]*)?$', '')) AS host,
            list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segments
        FROM pages
    ), known AS (
        SELECT DISTINCT pattern FROM (
            SELECT unnest([host,
                CASE WHEN len(string_split(host, '.')) >= 3
                    THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END,
                CASE WHEN len(segments) > 0 THEN host || '/' || segments[1] END]) AS pattern, host
            FROM parsed WHERE host <> '')
        WHERE pattern IS NOT NULL
    ), digests AS (
        SELECT pattern, md5(pattern) AS m FROM known
    ), listed AS (
        SELECT pattern,
            CAST('0x' || substr(m, 5, 4) AS INTEGER) % 240 AS since,
            CAST('0x' || substr(m, 9, 4) AS INTEGER) % 3 = 0 AS lifted,
            CAST('0x' || substr(m, 13, 4) AS INTEGER) % 5 <> 0 AS blocks
        FROM digests WHERE CAST('0x' || substr(m, 1, 4) AS INTEGER) % 3 = 0
    ), held AS (
        SELECT pattern, blocks, DATE '2024-01-01' + since AS since,
            CASE WHEN lifted THEN DATE '2024-01-01' + since + 60 END AS until
        FROM listed
        UNION ALL
        SELECT pattern, true, DATE '2024-01-01' + since + 100, NULL FROM listed WHERE lifted
    ), asked AS (
        SELECT DISTINCT page_id, url, pattern FROM (
            SELECT page_id, url, unnest(list_concat(
                list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                    lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                CASE WHEN len(segments) > 0 THEN [host || '/' || segments[1]] ELSE [] END)) AS pattern
            FROM parsed)
    ), found AS (
        SELECT a.page_id, a.url, h.*,
            row_number() OVER (PARTITION BY a.page_id, a.url ORDER BY len(string_split(h.pattern, '/')) DESC,
                len(string_split(h.pattern, '.')) DESC, h.pattern DESC) AS best,
            count(*) OVER (PARTITION BY a.page_id, a.url) AS n
        FROM asked a JOIN held h USING (pattern) JOIN parsed p ON p.page_id = a.page_id AND p.url = a.url
        WHERE h.since <= p.fetched AND (h.until IS NULL OR p.fetched < h.until)
    )
    SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, p.host, coalesce(f.n, 0) AS n_active,
        f.pattern AS entry, CAST(f.since AS VARCHAR) AS since,
        coalesce(f.blocks, false) AS blocked
    FROM parsed p LEFT JOIN found f ON f.page_id = p.page_id AND f.url = p.url AND f.best = 1
"""

CONTAMINATION = rf"""
    WITH item_words AS (
        SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
            translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ), grams AS (
        SELECT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
            SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
            FROM item_words WHERE len(w) > 0)
    ), doc_words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), windows AS (
        SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM doc_words, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)
    ), hits AS (
        SELECT doc_id, windows.n, i, item FROM windows JOIN grams USING (n, gram)
    ), covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _quality() -> str:
    names = [m for m, *_ in RULES.measures]
    spread, margin = (" ".join(f"WHEN '{m[0]}' THEN {m[n]}" for m in RULES.measures) for n in (1, 2))
    quantiles = ("q1", "q25", "q75", "q99")

    def quartiles(table: str, keys: str) -> str:
        comma = f"{keys}, " if keys else ""
        return rf"""
            SELECT {comma}measure, any_value(total) AS total,
                {", ".join(f"min(value) FILTER (100 * upto >= {q[1:]} * total) AS {q}" for q in quantiles)}
            FROM (SELECT {comma}measure, value, sum(n) OVER (PARTITION BY {comma}measure ORDER BY value) AS upto,
                    sum(n) OVER (PARTITION BY {comma}measure) AS total
                FROM (SELECT {comma}measure, value, sum(n) AS n FROM {table} GROUP BY {comma}measure, value))
            GROUP BY {comma}measure"""

    return rf"""
    WITH w AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), grams AS (
        SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
    ), twice AS (
        SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
    ), repeated AS (
        SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
    ), counts AS (
        SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
            length(array_to_string(words, '')) AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            coalesce(repeated.n, 0) AS n_repeat_words, len(lines) AS n_lines,
            length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals
        FROM w LEFT JOIN repeated USING (doc_id)
    ), measured AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
            CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END AS capitals,
            CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
            CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
            CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END AS word_length
        FROM counts
    ), long AS (
        UNPIVOT (SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, base_failed,
            {", ".join(f"CAST({m} AS BIGINT) AS {m}" for m in names)} FROM measured)
        ON {", ".join(names)} INTO NAME measure VALUE value
    ), sketch AS (
        SELECT lang, source, measure, value - value % (1 << greatest(length(bin(value)) - 6, 0)) AS value, count(*) AS n
        FROM long WHERE NOT base_failed GROUP BY ALL
    ), own AS ({quartiles("sketch", "lang, source")}
    ), per_lang AS ({quartiles("sketch", "lang")}
    ), every AS ({quartiles("sketch", "")}
    ), picked AS (
        SELECT o.lang, o.source, o.measure,
            {", ".join(f"CASE WHEN o.total >= {RULES.least_rows} THEN o.{q} WHEN l.total >= {RULES.least_rows} THEN l.{q} ELSE e.{q} END AS {q}" for q in quantiles)}
        FROM own o JOIN per_lang l USING (lang, measure) JOIN every e USING (measure)
    ), widths AS (
        SELECT *, {RULES.reach} * greatest(q75 - q25, CASE measure {spread} END) AS reach, CASE measure {margin} END AS margin FROM picked
    ), fences AS (
        SELECT lang, source, measure, least(q75 + reach, q99 + greatest(q99 // 4, margin)) AS high,
            CASE WHEN measure = 'word_length' THEN greatest(q25 - reach, q1 - greatest(q1 // 4, margin)) END AS low FROM widths
    ), outside AS (
        SELECT DISTINCT m.doc_id FROM long m JOIN fences f USING (lang, source, measure)
        WHERE m.value > f.high OR m.value < f.low
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
    FROM measured
    """


def _licenses() -> str:
    rows = ", ".join(
        "('{}', {}, '{}')".format(name, n, text.replace("'", "''")) for name, texts in TEMPLATES.items() for n, text in enumerate(texts)
    )

    def tokens(x: str) -> str:
        said = f"lower({x})"
        for pattern, instead in SPELLINGS:
            said = "regexp_replace({}, '{}', '{}', 'g')".format(said, pattern, instead.replace("$", "\\"))
        return f"regexp_extract_all({said}, '[a-z0-9]+(?:\\.[0-9]+)*')"

    def marks(x: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda k: regexp_matches(k, '{VARIANT}')))), ' ')"

    return rf"""
    WITH paths AS (
        SELECT doc_id, text, 'corpus/' || (doc_id // 100) || '/' || (doc_id // 10) || '/' ||
            CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path,
            'corpus/' || (doc_id // 100) || '/' || (doc_id // 10) AS folder
        FROM documents
    ), parts AS (
        SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))
            || string_split_regex(text, '\n[ \t]*\n') || [text]) AS s
        FROM paths WHERE regexp_matches(text, '{TRIGGER}')
    ), units AS (
        SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id) AS unit, {marks("t")} AS marks
        FROM (SELECT DISTINCT doc_id, {tokens("s")} AS t FROM parts WHERE regexp_matches(s, '{TRIGGER}'))
    ), terms AS (
        SELECT doc_id, unit, marks, token, count(*) AS tf FROM (SELECT doc_id, unit, marks, unnest(t) AS token FROM units) GROUP BY ALL
    ), df AS (SELECT token, count(*) AS df FROM terms GROUP BY token
    ), total AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, unit FROM terms)
    ), templates AS (
        SELECT license, variant, marks, token, count(*) AS tf FROM (
            SELECT license, variant, {marks("t")} AS marks, unnest(t) AS token
            FROM (SELECT license, variant, {tokens("text")} AS t FROM (VALUES {rows}) t(license, variant, text)))
        GROUP BY ALL
    ), weights AS (
        SELECT doc_id, unit, marks, token, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM terms JOIN df USING (token), total
    ), asked AS (
        SELECT license, variant, marks, token, tf * (ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0) AS tw
        FROM templates LEFT JOIN df USING (token), total
    ), norms AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL
    ), sizes AS (SELECT license, variant, sqrt(sum(tw * tw)) AS size FROM asked GROUP BY ALL
    ), scored AS (
        SELECT doc_id, unit, license, max(round(dot / (norm * size), 6)) AS cosine
        FROM (SELECT doc_id, unit, license, variant, sum(w * tw) AS dot FROM weights JOIN asked USING (token, marks) GROUP BY ALL)
        JOIN norms USING (doc_id, unit) JOIN sizes USING (license, variant)
        WHERE round(dot / (norm * size), 6) >= {LEAST_COSINE} GROUP BY doc_id, unit, license
    ), own AS (
        SELECT doc_id, license AS own_license, cosine AS own_score FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS r FROM (
                SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY cosine DESC, license) AS place,
                    lead(cosine) OVER (PARTITION BY doc_id, unit ORDER BY cosine DESC, license) AS second
                FROM scored)
            WHERE place = 1 AND (second IS NULL OR cosine - second >= {LEAST_LEAD})) WHERE r = 1
    ), granted AS (
        SELECT folder AS above, min(own_license) AS granted FROM paths JOIN own USING (doc_id)
        WHERE path LIKE '%/LICENSE' GROUP BY folder
    ), nearest AS (
        SELECT folder, above, granted FROM (
            SELECT f.folder, above, granted, row_number() OVER (PARTITION BY f.folder ORDER BY length(above) DESC) AS r
            FROM (SELECT DISTINCT folder FROM paths) f JOIN granted ON f.folder = above OR f.folder LIKE above || '/%')
        WHERE r = 1
    )
    SELECT doc_id, path, own_license, own_score, coalesce(own_license, granted) AS license,
        CASE WHEN own_license IS NULL THEN above END AS inherited_from
    FROM paths LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (folder)
    """


MERKLE = r"""
    WITH RECURSIVE fields AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree,
            coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
            || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
            n_chars, coalesce(strlen(text) || ':' || text, '-') AS back,
            list_transform(range(length(CAST(doc_id AS VARCHAR))),
                lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS UBIGINT)) AS bytes
        FROM documents
    ), leaves AS (
        SELECT r, doc_id, tree,
            sha256(front || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || back) AS leaf,
            sha256(front || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || back) AS other,
            coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, b:
                list_reduce(list_prepend(xor(c, b), CAST(range(8) AS UBIGINT[])), lambda v, k:
                    CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)),
                4294967295::UBIGINT) % 7 = 0, false) AS tampered
        FROM fields
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
    ), nodes AS (
        SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM placed
        UNION ALL
        SELECT tree, level, pos, node, n FROM (
            SELECT tree, level + 1 AS level, pos // 2 AS pos, pos AS old, (n + 1) // 2 AS n,
                sha256(node || coalesce(lead(node) OVER (PARTITION BY tree ORDER BY pos), '')) AS node
            FROM nodes WHERE n > 1)
        WHERE old % 2 = 0
    ), subroots AS (
        SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1
    ), over_nodes AS (
        SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subroots
        UNION ALL
        SELECT level, pos, node, n FROM (
            SELECT level + 1 AS level, pos // 2 AS pos, pos AS old, (n + 1) // 2 AS n,
                sha256(node || coalesce(lead(node) OVER (ORDER BY pos), '')) AS node
            FROM over_nodes WHERE n > 1)
        WHERE old % 2 = 0
    ), low_path AS (
        SELECT r, tree, 0 AS level, pos, CASE WHEN tampered THEN other ELSE leaf END AS folded, '' AS proof FROM placed
        UNION ALL
        SELECT p.r, p.tree, p.level + 1, p.pos // 2,
            CASE WHEN p.pos % 2 = 1 THEN sha256(s.node || p.folded) ELSE sha256(p.folded || coalesce(s.node, '')) END,
            p.proof || coalesce(s.node, '')
        FROM low_path p JOIN nodes own ON own.tree = p.tree AND own.level = p.level AND own.pos = p.pos AND own.n > 1
        LEFT JOIN nodes s ON s.tree = p.tree AND s.level = p.level AND s.pos = xor(p.pos, 1)
    ), low AS (
        SELECT r, tree, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM low_path GROUP BY r, tree
    ), high_path AS (
        SELECT l.r, 0 AS level, s.pos, l.folded, l.proof FROM low l JOIN subroots s USING (tree)
        UNION ALL
        SELECT p.r, p.level + 1, p.pos // 2,
            CASE WHEN p.pos % 2 = 1 THEN sha256(s.node || p.folded) ELSE sha256(p.folded || coalesce(s.node, '')) END,
            p.proof || coalesce(s.node, '')
        FROM high_path p JOIN over_nodes own ON own.level = p.level AND own.pos = p.pos AND own.n > 1
        LEFT JOIN over_nodes s ON s.level = p.level AND s.pos = xor(p.pos, 1)
    ), high AS (
        SELECT r, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM high_path GROUP BY r
    )
    SELECT p.doc_id, p.leaf, s.subroot, o.node AS root, sha256(h.proof) AS proof_sha256,
        h.folded AS folded_root, h.folded = o.node AS verified
    FROM placed p JOIN high h USING (r) JOIN subroots s USING (tree), (SELECT node FROM over_nodes WHERE n = 1) o
"""


def _kmeans() -> str:
    rounds = [
        """kept AS (
        SELECT row_number() OVER () AS r, vec_id,
            list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ), flat AS (
        SELECT r, d, v[d] AS x FROM kept, range(1, 65) t(d)
    ), c0 AS (
        SELECT c, d, v[d] AS m FROM (
            SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM kept
            QUALIFY c < 16), range(1, 65) t(d)
    )"""
    ]
    for n in range(4):
        rounds.append(
            f"""s{n} AS (
        SELECT r, c, sum((x - m) * (x - m)) AS distance FROM flat JOIN c{n} USING (d) GROUP BY r, c
    ), a{n} AS (
        SELECT r, c, distance FROM s{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1
    )"""
        )
        if n < 3:
            rounds.append(
                f"""u{n} AS (
        SELECT c, d, sum(x) AS s, count(*) AS n FROM flat JOIN a{n} USING (r) GROUP BY c, d
    ), c{n + 1} AS (
        SELECT c, d, CASE WHEN n IS NULL THEN m ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS m
        FROM c{n} LEFT JOIN u{n} USING (c, d)
    )"""
            )
    return f"""WITH {", ".join(rounds)}, digests AS (
        SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c
    )
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
        CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a3 JOIN kept USING (r) JOIN digests USING (c)
"""


KMEANS = _kmeans()


ORACLES: dict[str, str] = {
    "op1_chat_formatting": CHAT,
    "op5_url_filters": URLS,
    "op6_decontamination": CONTAMINATION,
    "op7_quality_rules": _quality(),
    "op8_license_scans": _licenses(),
    "op11_merkle_manifest": MERKLE,
    "op12_centroid_clustering": KMEANS,
}
