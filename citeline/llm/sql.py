"""DuckDB SQL for the queries that it can express."""

SQL = {
    "op1_decontaminate": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        i AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        t AS (
            SELECT DISTINCT item, least(len(w), 10) AS m,
                   unnest([list_slice(w, p, p + least(len(w), 10) - 1)
                           FOR p IN range(1, len(w) - least(len(w), 10) + 2)]) AS key
            FROM i WHERE len(w) > 0),
        lengths AS (SELECT DISTINCT m FROM t),
        p AS (
            SELECT r, m, unnest(range(1, len(w) - m + 2)) AS pos, w FROM d, lengths WHERE len(w) >= m),
        hits AS (
            SELECT r, pos, p.m, item FROM (SELECT r, m, pos, list_slice(w, pos, pos + m - 1) AS key FROM p) p
            JOIN t USING (m, key)),
        places AS (
            SELECT r, count(DISTINCT place) AS n_hit
            FROM (SELECT r, unnest(range(pos, pos + m)) AS place FROM hits) GROUP BY r),
        found AS (
            SELECT r, count(DISTINCT item) AS n_items,
                   string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)""",
    "op9_mixing": """
        WITH sizes AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
        sums AS (SELECT sum(n) AS all_rows, CAST(sum(CAST(w AS DECIMAL(38, 9))) AS DOUBLE) AS weight FROM sizes),
        rates AS (
            SELECT source, 1.0::DOUBLE * CAST(all_rows AS DOUBLE) * w / weight / n AS mean FROM sizes, sums),
        rows_ AS (
            SELECT d.*, mean, greatest(1, CAST(ceil(mean / 4.0) AS INTEGER)) AS draws
            FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
        parts AS (
            SELECT *, unnest(range(1, draws + 1)) AS j FROM rows_),
        drawn AS (
            SELECT *, mean / draws AS m,
                   (CAST(('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || j), 1, 13))::UBIGINT AS DOUBLE) + 0.5)
                   / 4503599627370496.0::DOUBLE AS u
            FROM parts),
        counted AS (
            SELECT doc_id, text, lang, source, n_chars, j,
                   (SELECT count(*) FROM (
                       SELECT sum(p) OVER (ORDER BY k) AS cdf FROM (
                           SELECT k, exp(-m) * pow(m, k) / factorial(CAST(k AS INTEGER)) AS p FROM range(0, 20) t(k)))
                    WHERE cdf <= u) AS k
            FROM drawn),
        total AS (
            SELECT doc_id, text, lang, source, n_chars, sum(k) AS times
            FROM counted GROUP BY ALL),
        repeated AS (
            SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(0, CAST(times AS BIGINT))) AS INTEGER) AS copy FROM total)
        SELECT *, md5('20 order:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS order_key FROM repeated""",
    "op7_chat": """
        WITH c AS (
            SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        n AS (
            SELECT *, (length(text) + 3) // 4 + 4 AS t,
                   24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\\|'), chr(10), '\' || chr(10)))
                      + length(replace(replace(text, '\', '\\'), '<|', '<\\|')) AS chars,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos
            FROM c),
        s AS (SELECT conv_id, t AS st, chars AS sc FROM n WHERE pos = 0 AND role = 'system'),
        p AS (
            SELECT n.*, s.st IS NOT NULL AND pos = 0 AS lead, greatest(256, 768 - coalesce(st, 0)) AS step,
                   coalesce(sum(CASE WHEN s.st IS NOT NULL AND pos = 0 THEN 0 ELSE t END)
                       OVER (PARTITION BY n.conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
            FROM n LEFT JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
        w AS (
            SELECT *, 2 * (place // step) + CASE WHEN NOT lead AND (place + t - 1) // step > place // step THEN 1 ELSE 0 END AS win
            FROM p),
        starts AS (SELECT conv_id, win, min(place) AS start FROM w GROUP BY ALL),
        sizes AS (
            SELECT conv_id, sum(chars) AS chars FROM (
                SELECT conv_id, chars FROM w
                UNION ALL
                SELECT w.conv_id, w.chars FROM w JOIN starts x ON w.conv_id IS NOT DISTINCT FROM x.conv_id
                WHERE NOT lead AND start > place AND start - place <= 256
                UNION ALL
                SELECT x.conv_id, sc FROM starts x JOIN s ON x.conv_id IS NOT DISTINCT FROM s.conv_id WHERE win > 0)
            GROUP BY conv_id),
        texts AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
                   coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss
            FROM n GROUP BY conv_id)
        SELECT x.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
               sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
        FROM texts x JOIN sizes y ON x.conv_id IS NOT DISTINCT FROM y.conv_id""",
    "op3_pii": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        m AS (
            SELECT r, 1 AS rank, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS f, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+') AS g FROM d UNION ALL
            SELECT r, 2 AS rank, 'ip' AS kind, regexp_extract_all(t, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS f, string_split_regex(t, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS g FROM d UNION ALL
            SELECT r, 3 AS rank, 'card' AS kind, regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+') AS f, string_split_regex(t, '[0-9](?:[ -]?[0-9])+') AS g FROM d UNION ALL
            SELECT r, 4 AS rank, 'phone' AS kind, regexp_extract_all(t, '\\+[0-9][ ().0-9-]+[0-9]') AS f, string_split_regex(t, '\\+[0-9][ ().0-9-]+[0-9]') AS g FROM d UNION ALL
            SELECT r, 5 AS rank, 'iban' AS kind, regexp_extract_all(t, '\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b') AS f, string_split_regex(t, '\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b') AS g FROM d UNION ALL
            SELECT r, 6 AS rank, 'national_id' AS kind, regexp_extract_all(t, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b') AS f, string_split_regex(t, '\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b') AS g FROM d),
        u AS (SELECT r, rank, kind, f, g, unnest(range(1, len(f) + 1)) AS i FROM m),
        e AS (
            SELECT r, rank, kind, f[i] AS x, lower(right(g[i], 40)) AS near,
                   list_sum([length(y) FOR y IN f[1:i]]) + list_sum([length(y) FOR y IN g[1:i]]) AS stop,
                   regexp_replace(f[i], '[^0-9]', '', 'g') AS digits,
                   replace(f[i], ' ', '') AS plain
            FROM u),
        v AS (
            SELECT *, CASE kind
                WHEN 'email' THEN true
                WHEN 'ip' THEN regexp_full_match(x, '0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}')
                WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(
                    [CASE WHEN (length(digits) - i) % 2 = 1
                          THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(digits[i] AS INTEGER) + 1]
                          ELSE CAST(digits[i] AS INTEGER) END FOR i IN range(1, length(digits) + 1)]) % 10 = 0
                WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
                WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND list_reduce(
                    list_prepend(0::BIGINT, [CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT
                                     FOR c IN string_split(plain[5:] || plain[:4], '')]),
                    lambda a, b: (a * CASE WHEN b > 9 THEN 100 ELSE 10 END + b) % 97) = 1
                ELSE NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$')
                     AND regexp_matches(near, 'ssn|social|security') END AS good
            FROM e),
        spans AS (
            SELECT r, rank, kind, stop - length(x) AS start, kind || ':' || (stop - length(x)) || ':' || stop AS span
            FROM v WHERE good),
        found AS (
            SELECT r, count(*) FILTER (rank = 1) AS n_email, count(*) FILTER (rank = 2) AS n_ip,
                   count(*) FILTER (rank = 3) AS n_card, count(*) FILTER (rank = 4) AS n_phone,
                   string_agg(span, ',' ORDER BY start, rank) FILTER (rank <= 4) AS base,
                   string_agg(span, ',' ORDER BY start, rank) AS spans
            FROM spans GROUP BY r)
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
               coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN found USING (r)""",
    "op4_passages": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        k AS (
            SELECT r, p, array_to_string(w[p:p + 34], ' ') AS key
            FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
        again AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1),
        gone AS (
            SELECT DISTINCT r, i FROM (SELECT r, unnest(range(p, p + 35)) AS i FROM k SEMI JOIN again USING (key))),
        words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        kept AS (
            SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t
            FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)""",
    "op11_runs": """
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS name,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        bytes AS (
            SELECT name, 4294967295::BIGINT AS init, [ascii(c) FOR c IN string_split(name, '')] AS b
            FROM (SELECT DISTINCT name FROM t WHERE name IS NOT NULL)),
        sums AS (
            SELECT name, xor(list_reduce(list_prepend(init, b::BIGINT[]),
                       lambda x, y: list_reduce([xor(x, y), 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
                           lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), init) AS h
            FROM bytes),
        d AS (
            SELECT r, doc_id, w, len(w) AS n, h, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a,
                   3 + (h // 10) % 8 AS parts
            FROM t LEFT JOIN sums USING (name)),
        v AS (
            SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
                       [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END + 1] FOR i IN range(0, n)] END AS w
            FROM d),
        word AS (SELECT r, unnest(w) AS x, unnest(range(0, n)) AS i FROM v),
        same AS (
            SELECT p.r, p.i, q.i - p.i AS q FROM word p JOIN word q ON p.r = q.r AND p.x = q.x AND q.i > p.i
            JOIN v ON v.r = p.r WHERE 3 * (q.i - p.i) <= v.n),
        stretch AS (
            SELECT r, q, min(i) AS s, max(i) + 1 + q AS e
            FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same)
            GROUP BY r, q, island HAVING count(*) >= greatest(24 - q, 2 * q)),
        run AS (SELECT r, s, e - s AS n, min(q) AS q FROM stretch GROUP BY r, s, e),
        best AS (
            SELECT r, s, n, q FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY n / q DESC, s, q) = 1),
        listed AS (
            SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines
            FROM run GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM run),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period,
               1000 * b.n // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
               sha256(coalesce(t, '')) AS collapsed_sha256
        FROM v LEFT JOIN best b USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)""",
    "op12_repeats": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x,
                   octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        k AS (
            SELECT r, 400 * b + i AS p, md5_number(substr(y, 2 * i + 1, 800)) AS key
            FROM (SELECT r, b, y, unnest(range(0, least(400, n - 399 - 400 * b))) AS i
                  FROM (SELECT r, n, b, substr(x, 800 * b + 1, 1600) AS y
                        FROM (SELECT r, x, n, unnest(range(0, n // 400)) AS b FROM d WHERE n >= 400)))),
        again AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1),
        found AS (SELECT r, p FROM k SEMI JOIN again USING (key)),
        marked AS (
            SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS opens FROM found),
        runs AS (SELECT r, p, sum(opens) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
        spans AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM runs GROUP BY r, run),
        edges AS (
            SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
            UNION ALL SELECT r, max(b), NULL FROM spans GROUP BY r),
        kept AS (
            SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS t
            FROM edges JOIN d USING (r) GROUP BY r),
        sums AS (SELECT r, sum(b - a) AS removed, count(*) AS n_spans FROM spans GROUP BY r)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
               coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, x))) AS kept_sha256
        FROM d LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)""",
    "op13_trie": """
        WITH t AS (
            SELECT conv_id, turn, length(coalesce(text, '')) AS size,
                   substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(size ORDER BY turn NULLS FIRST, k) AS ls
            FROM t GROUP BY conv_id),
        bytes AS (SELECT conv_id, 4294967295::BIGINT AS init, [ascii(x) FOR x IN string_split(conv_id::VARCHAR, '')] AS b FROM c),
        sums AS (
            SELECT conv_id, xor(list_reduce(list_prepend(init, b::BIGINT[]),
                       lambda x, y: list_reduce([xor(x, y), 1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
                           lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), init) % 6 AS h
            FROM bytes),
        r AS (
            SELECT c.conv_id, list_concat(coalesce(d.ks, [])[1:h], c.ks[h + 1:]) AS ks,
                   list_concat(coalesce(d.ls, [])[1:h], c.ls[h + 1:]) AS ls
            FROM c JOIN sums USING (conv_id) LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % 100),
        p AS (
            SELECT conv_id, d, array_to_string(ks[1:d], ',') AS key, array_to_string(ks[1:d - 1], ',') AS up,
                   coalesce(ls[d], 0) AS size, d = len(ks) AS ends
            FROM (SELECT conv_id, ks, ls, unnest(range(0, len(ks) + 1)) AS d FROM r)),
        node AS (
            SELECT d, key, min(conv_id) AS conv_id, min(CASE WHEN d > 0 THEN up END) AS up, count(*) AS n, min(size) AS size,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
            FROM p GROUP BY d, key),
        kids AS (SELECT d - 1 AS d, up AS key, count(*) AS children FROM node WHERE d > 0 GROUP BY ALL),
        whole AS (SELECT n.*, coalesce(children, 0) AS children FROM node n LEFT JOIN kids USING (d, key)),
        below AS (
            SELECT a.d, a.key, sum((w.children = 0)::INTEGER) AS leaves, sum((w.n - 1) * w.size) AS saved
            FROM whole w JOIN p a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.key)
        SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n AS n_convs, w.children AS n_children,
               leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
        FROM whole w JOIN below USING (d, key) LEFT JOIN node q ON q.d = w.d - 1 AND q.key = w.up""",
}
