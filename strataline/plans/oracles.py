"""The same queries as SQL on the same tables, written apart from the Spark ones."""

from __future__ import annotations

#: White space that the driver's tables hold; words are what it separates.
_WORDS = "len(list_filter(string_split_regex({0}, '[ \\t\\n\\r\\x0b\\f\\x1c-\\x1f]+'), lambda w: w <> ''))"
_FIRST_LINE = "string_split_regex({0}, '\\r\\n|\\r|\\n')[1]"
_COLLAPSED = "trim(regexp_replace({0}, '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g'))"

_SEGMENTS = f"""
    seg AS (
        SELECT source, doc_id, 'Document ' || doc_id AS title,
               row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seg_ord,
               length('=== Document ' || doc_id || ' ===' || chr(10) || text || chr(10) || chr(10)) AS n,
               {_WORDS.format('text')} + 4 AS words
        FROM documents)"""

_CAP = """
    RECURSIVE d AS (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    f(source, n, total, kept, doc_id) AS (
        SELECT source, n, size, true, doc_id FROM d WHERE n = 1
        UNION ALL
        SELECT d.source, d.n, CASE WHEN f.total + d.size > 60000 THEN f.total ELSE f.total + d.size END, f.total + d.size <= 60000, d.doc_id
        FROM f JOIN d ON d.source = f.source AND d.n = f.n + 1)"""

_CUES = """
    e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events),
    c0 AS (SELECT user_id, event_id, event_type, CAST((us - min(us) OVER (PARTITION BY user_id)) // 3600000000 * 10 AS BIGINT) AS start_s FROM e),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_s, event_id) AS ord FROM c0)"""

_DURATION = "dur AS (SELECT user_id, CAST(max(start_s) + 1 AS BIGINT) AS duration_s FROM c GROUP BY user_id)"
_WINDOWS = "win AS (SELECT user_id, CAST(s // 600 + 1 AS BIGINT) AS seg_ord, 'Part ' || (s // 600 + 1) AS title, CAST(s AS BIGINT) AS start_s FROM (SELECT user_id, unnest(range(0, duration_s, 600)) AS s FROM dur))"

_TREE = f"""
    RECURSIVE n AS (
        SELECT conv_id AS thread_id, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent_id, turn % 3 = 1 AS deleted,
               role, text, lpad(CAST(turn AS VARCHAR), 8, '0') AS step FROM conversations),
    t(thread_id, id, deleted, depth, root_id, path) AS (
        SELECT thread_id, id, deleted, CASE WHEN deleted THEN 0 ELSE 1 END, CASE WHEN deleted THEN NULL ELSE id END, step FROM n WHERE parent_id IS NULL
        UNION ALL
        SELECT n.thread_id, n.id, n.deleted, t.depth + CASE WHEN n.deleted THEN 0 ELSE 1 END,
               coalesce(t.root_id, CASE WHEN n.deleted THEN NULL ELSE n.id END), t.path || '/' || n.step
        FROM t JOIN n ON n.thread_id = t.thread_id AND n.parent_id = t.id),
    own AS (
        SELECT t.thread_id, t.id, t.depth - 1 AS depth, t.root_id, row_number() OVER (PARTITION BY t.thread_id ORDER BY path) AS pos,
               repeat('  ', CAST(t.depth - 1 AS INTEGER)) || role || ': ' || {_FIRST_LINE.format('text')} AS line
        FROM t JOIN n ON n.thread_id = t.thread_id AND n.id = t.id WHERE NOT t.deleted)"""

#: A page's article, cut out by the markup the driver's pages have.
_PAGES = """
    p AS (
        SELECT page_id, url, html,
               replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS title,
               regexp_extract(html, '<html lang="([^"]*)"', 1) AS language,
               replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(
                   regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '(?s)<(script|style|footer|nav)[^>]*>.*?</(script|style|footer|nav)>', ' ', 'g'),
                   '</?(p|h1|div|br|article|li|ul)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'),
                   '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS body
        FROM pages)"""

_SOURCES = """
    s AS (
        SELECT DISTINCT source FROM (
            SELECT url AS source FROM pages UNION ALL
            SELECT unnest(['https://www.youtube.com/watch?v=abc', 'https://www.youtube.com/watch?v=abc&list=PL1', 'https://www.youtube.com/watch?list=PL1',
                'https://youtu.be/abc', 'https://www.youtube.com/playlist?list=PL1', 'https://www.youtube.com/@name/videos', 'youtube.com/channel/UC1',
                'https://docs.example.org/llms.txt', 'https://docs.example.org/a/llms-full.txt?x=1', 'https://feeds.example.org/show', 'https://example.org/feed',
                'https://podcasts.apple.com/us/podcast/x/id1', 'https://example.org/a.mp3?x=1', 'https://arxiv.org/abs/1706.03762', 'https://github.com/owner/repo.git',
                'https://github.com/owner/repo/tree/main', 'https://news.ycombinator.com/item?id=1', 'https://old.reddit.com/r/x/comments/abc/title', 'https://redd.it/abc',
                'paper.pdf', 'book.EPUB', 'talk.wav', 'deck.pptx', 'old.doc', 'cues.srt', 'unknown.bin']))),
    k AS (
        SELECT source, starts_with(source, 'http') AS web, CASE
            WHEN contains(source, 'youtube.com/watch?') AND contains(source, 'list=') AND NOT contains(source, 'v=') THEN ['playlist']
            WHEN contains(source, 'youtube.com/watch?') AND contains(source, 'list=') THEN ['youtube', 'playlist']
            WHEN contains(source, 'youtube.com/watch?') OR contains(source, 'youtu.be/') THEN ['youtube']
            WHEN contains(source, 'youtube.com/') THEN ['playlist']
            WHEN contains(source, '/llms') THEN ['docs']
            WHEN contains(source, '//feeds.') OR ends_with(source, '/feed') THEN ['playlist']
            WHEN contains(source, 'podcasts.apple.com') OR contains(source, '.mp3') THEN ['audio']
            WHEN contains(source, 'arxiv.org/abs/') THEN ['paper']
            WHEN ends_with(source, 'repo.git') THEN ['repo']
            WHEN contains(source, 'ycombinator') OR contains(source, 'reddit.com') OR contains(source, 'redd.it') THEN ['thread']
            WHEN starts_with(source, 'http') THEN ['article', 'audio', 'docs']
            WHEN ends_with(source, '.pdf') THEN ['paper', 'book'] WHEN ends_with(lower(source), '.epub') THEN ['book']
            WHEN ends_with(source, '.wav') THEN ['audio'] WHEN ends_with(source, '.pptx') OR ends_with(source, '.doc') THEN ['document']
            WHEN ends_with(source, '.srt') THEN ['transcript'] ELSE [] END AS own FROM s),
    poss AS (
        SELECT source, CASE WHEN web AND own <> ['article', 'audio', 'docs']
            THEN list_concat(own, list_filter(['article', 'audio'], lambda t: NOT list_contains(own, t))) ELSE own END AS possible FROM k)"""

_INDEX = """
    site AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, strlen(html) AS size, page_id % 3 = 0 AS optional FROM pages)"""

ORACLES: dict[str, str] = {
    "q01_words_per_doc": f"SELECT doc_id, {_WORDS.format('text')} AS words FROM documents",
    "q02_est_tokens_per_doc": f"SELECT doc_id, CAST(floor({_WORDS.format('text')} * 1.333) AS BIGINT) AS est_tokens FROM documents",
    "q03_segment_offsets_by_source": f"""WITH {_SEGMENTS}
        SELECT source, seg_ord, doc_id, title, words, CAST(floor(words * 1.333) AS BIGINT) AS est_tokens,
               CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM seg""",
    "q04_source_summary": f"""WITH {_SEGMENTS}
        SELECT source, count(*) AS n_segments, CAST(sum(words) AS BIGINT) AS words, CAST(sum(n) AS BIGINT) AS chars,
               CAST(floor(sum(words) * 1.333) AS BIGINT) AS est_tokens FROM seg GROUP BY source""",
    "q05_unique_keys_by_lang": """
        SELECT doc_id, source, CASE WHEN n = 1 THEN lang ELSE lang || ' (' || n || ')' END AS key
        FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""",
    "q06_greedy_text_cap": f"WITH {_CAP} SELECT source, doc_id FROM f WHERE kept",
    "q07_dropped_log": f"""WITH {_CAP}
        SELECT source, count(*) AS n_dropped, min(doc_id) AS first_dropped, max(doc_id) AS last_dropped, 'over text cap' AS reason FROM f WHERE NOT kept GROUP BY source""",
    "q08_page_limit_cap": "SELECT source, doc_id, position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents) WHERE position <= 15",
    "q09_exact_dedupe_first_wins": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "q10_stub_flag": "SELECT doc_id, length(text) < 200 AS stub FROM documents",
    "q11_clean_lines": f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_COLLAPSED.format('x')}), lambda x: x <> ''), chr(10)) AS cleaned FROM documents",
    "q12_snippet_titles": f"""
        SELECT conv_id, turn, role || ': ' || CASE WHEN length(x) <= 60 THEN x ELSE regexp_replace(substring(x, 1, 60), ' [^ ]*$', '') || '...' END AS title
        FROM (SELECT conv_id, turn, role, {_COLLAPSED.format(_FIRST_LINE.format('text'))} AS x FROM conversations)""",
    "q13_segment_slice_roundtrip": f"WITH {_CAP} SELECT source, doc_id, CAST(length('=== Document ' || doc_id || ' ===') + length(text) + 3 AS BIGINT) AS n_chars, true AS same FROM documents JOIN (SELECT source, doc_id FROM f WHERE kept) USING (source, doc_id)",
    "q14_tag_counts_sources": """
        WITH t AS (SELECT source, unnest(list_distinct([lang, 'd' || doc_id % 3])) AS tag FROM documents),
        n AS (SELECT source, tag, count(*) AS n FROM t GROUP BY source, tag)
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, tag) AS rank FROM n""",
    "q15_detect_source_type": f"WITH {_SOURCES} SELECT source, possible[1] AS source_type FROM poss",
    "q16_possible_types_and_forced": f"""WITH {_SOURCES},
        w AS (SELECT *, CASE length(source) % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'audio' END AS forced FROM poss)
        SELECT source, array_to_string(possible, ',') AS possible,
               CASE WHEN len(possible) = 0 THEN NULL WHEN forced IS NULL THEN possible[1] WHEN list_contains(possible, forced) THEN forced END AS source_type,
               len(possible) = 0 OR (forced IS NOT NULL AND NOT list_contains(possible, forced)) AS refused FROM w""",
    "q17_page_title_slug": f"""WITH {_PAGES}, t AS (SELECT page_id, {_COLLAPSED.format('title')} AS title FROM p)
        SELECT page_id, title, coalesce(nullif(rtrim(substring(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-'), ''), 'untitled') AS slug FROM t""",
    "q18_article_words": f"WITH {_PAGES} SELECT page_id, CAST({_WORDS.format('body')} AS BIGINT) AS words FROM p",
    "q19_readable_gate": f"""WITH {_PAGES}, w AS (SELECT page_id, {_WORDS.format('body')} AS n FROM p)
        SELECT page_id, CAST(n + 2 AS BIGINT) AS words, CAST(floor((n + 2) * 1.333) AS BIGINT) AS est_tokens FROM w WHERE n >= 100""",
    "q20_article_language": f"WITH {_PAGES} SELECT page_id, language FROM p",
    "q21_sections_from_headings": f"""WITH {_PAGES}
        SELECT page_id, CAST(1 AS BIGINT) AS seg_ord, CAST(0 AS BIGINT) AS "offset", {_COLLAPSED.format("replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', chr(34)), '&amp;', '&')")} AS title FROM p""",
    "q22_url_defrag_dedupe": "SELECT min(page_id) AS page_id, regexp_replace(url, '[?#].*$', '') AS address FROM pages GROUP BY 2",
    "q23_md_twin_candidates": """
        WITH s AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS plain, regexp_replace(url, '[?#].*$', '') AS stem FROM pages),
        c AS (SELECT page_id, [stem || CASE WHEN ends_with(stem, '/') THEN 'index.html.md' ELSE '.md' END, plain] AS cs FROM s)
        SELECT page_id, CAST(unnest([0, 1]) AS BIGINT) AS ord, unnest(cs) AS candidate FROM c""",
    "q24_llms_candidates": """
        WITH s AS (
            SELECT page_id, regexp_extract(url, '^https?://[^/?#]+') AS site,
                   list_filter(string_split(regexp_replace(regexp_extract(url, '^[^?#]*'), '^https?://[^/]*', ''), '/'), lambda p: p <> '') AS parts FROM pages),
        f AS (SELECT page_id, site, CASE WHEN len(parts) > 0 AND contains(parts[len(parts)], '.') THEN parts[1:len(parts) - 1] ELSE parts END AS folders FROM s),
        x AS (SELECT page_id, site, folders, unnest(range(0, len(folders) + 1)) AS up FROM f),
        y AS (SELECT page_id, up, site || array_to_string(list_transform(folders[1:len(folders) - up], lambda p: '/' || p), '') AS base FROM x)
        SELECT page_id, CAST(up * 2 + k AS BIGINT) AS ord, base || CASE k WHEN 0 THEN '/llms-full.txt' ELSE '/llms.txt' END AS candidate FROM y, (SELECT unnest([0, 1]) AS k)""",
    "q25_cues_from_rendered_vtt": f"WITH {_CUES} SELECT user_id, ord, start_s, event_type || ' & more' AS text FROM c",
    "q26_consecutive_dedupe": f"""WITH {_CUES}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ord) AS last FROM c)
        SELECT user_id, ord, event_type FROM l WHERE event_type IS DISTINCT FROM last""",
    "q27_fixed_windows": f"WITH {_CUES}, {_DURATION}, {_WINDOWS} SELECT * FROM win",
    "q28_cue_to_segment_range_join": f"""WITH {_CUES}, {_DURATION}, {_WINDOWS},
        r AS (SELECT *, lead(start_s) OVER (PARTITION BY user_id ORDER BY seg_ord) AS stop FROM win)
        SELECT c.user_id, seg_ord, count(*) AS n_cues, min(ord) AS first_cue, max(ord) AS last_cue
        FROM c JOIN r ON c.user_id = r.user_id AND c.start_s >= r.start_s AND (stop IS NULL OR c.start_s < stop) GROUP BY c.user_id, seg_ord""",
    "q29_marker_fold": f"""WITH RECURSIVE {_CUES},
        f(user_id, ord, start_s, last, marked) AS (
            SELECT user_id, ord, start_s, CASE WHEN start_s >= 300 THEN start_s ELSE 0 END, start_s >= 300 FROM c WHERE ord = 1
            UNION ALL
            SELECT c.user_id, c.ord, c.start_s, CASE WHEN c.start_s - f.last >= 300 THEN c.start_s ELSE f.last END, c.start_s - f.last >= 300
            FROM f JOIN c ON c.user_id = f.user_id AND c.ord = f.ord + 1)
        SELECT user_id, ord, start_s FROM f WHERE marked""",
    "q30_speakers": """
        WITH s AS (SELECT conv_id % 50 AS source_id, conv_id * 1000 + turn AS ord, upper(role[1]) || role[2:] AS name FROM conversations),
        n AS (SELECT source_id, name, count(*) AS n, min(ord) AS first FROM s GROUP BY source_id, name HAVING count(*) >= 2)
        SELECT source_id, name, n, row_number() OVER (PARTITION BY source_id ORDER BY first) AS position FROM n""",
    "q31_duration_rule": f"WITH {_CUES}, {_DURATION} SELECT * FROM dur",
    "q32_deep_links": """
        WITH b AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', '') AS path FROM pages)
        SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=v' || page_id || '&t=' || page_id * 7 || 's'
            WHEN 1 THEN CASE WHEN path <> '' THEN 'https://vimeo.com' || path || '#t=' || page_id * 7 || 's' END
            WHEN 2 THEN 'https://cdn.example.org' || path || '.mp3#t=' || page_id * 7 END AS link FROM b""",
    "q33_promote_deleted": f"WITH {_TREE} SELECT thread_id, id, CAST(depth AS BIGINT) AS depth, root_id FROM own",
    "q34_dfs_render_order": f"WITH {_TREE} SELECT thread_id, pos, id, line FROM own",
    "q35_comment_budget": f"""WITH {_TREE},
        b AS (SELECT thread_id, pos, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY thread_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM own)
        SELECT thread_id, pos, pos <= 4 AND before < 900 AS taken FROM b""",
    "q36_root_ranking": """
        SELECT conv_id % 10 AS thread_id, conv_id * 1000 + turn AS id,
               row_number() OVER (PARTITION BY conv_id % 10 ORDER BY CASE WHEN turn % 2 = 0 THEN length(text) % 50 ELSE 0 END DESC, conv_id * 1000 + turn) AS rank FROM conversations""",
    "q37_thread_segments": f"WITH {_TREE} SELECT thread_id, root_id, count(*) AS n_comments, md5(string_agg(line, chr(10) ORDER BY pos)) AS body_md5 FROM own GROUP BY thread_id, root_id",
    "q38_comment_counts": "SELECT conv_id AS thread_id, count(*) FILTER (turn % 3 <> 1) AS n_comments, count(*) AS n_all FROM conversations GROUP BY conv_id",
    "q39_rendered_note_links": """
        WITH t AS (SELECT doc_id, ['note' || doc_id // 10 * 10, 'note' || doc_id * 3 % 50, 'note' || doc_id] AS ts FROM documents),
        u AS (SELECT doc_id, unnest(ts) AS target, unnest([1, 2, 3]) AS k FROM t),
        f AS (SELECT doc_id, target, min(k) AS k FROM u GROUP BY doc_id, target)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ord, target FROM f""",
    "q40_hubs_topk": """
        WITH n AS (SELECT doc_id, lang AS vault_id, 'f' || doc_id % 7 || '/note' || doc_id || '.md' AS path FROM documents),
        l AS (SELECT doc_id AS src, vault_id, unnest([doc_id // 10 * 10, doc_id * 3 % 50, doc_id]) AS dst FROM n),
        c AS (SELECT l.vault_id, n.path, count(DISTINCT src) AS inbound FROM l JOIN n ON n.vault_id = l.vault_id AND n.doc_id = l.dst WHERE l.src <> l.dst GROUP BY l.vault_id, n.path HAVING count(DISTINCT src) >= 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY vault_id ORDER BY inbound DESC, path) AS rank FROM c)
        SELECT * FROM r WHERE rank <= 10""",
    "q41_frontmatter_roundtrip": "SELECT doc_id, 'Note ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE lang || ',' || source || '  # why' END AS tags, 'Body ' || n_chars AS body FROM documents",
    "q42_fence_aware_headings": """
        SELECT doc_id, CAST(0 AS BIGINT) AS line, CAST(1 AS BIGINT) AS level, 'Doc ' || doc_id AS title FROM documents
        UNION ALL SELECT doc_id, 5, 2, 'Part ' || source FROM documents UNION ALL SELECT doc_id, 7, 2, 'Empty' FROM documents""",
    "q43_llms_index_links": f"""WITH {_INDEX}
        SELECT site, row_number() OVER (PARTITION BY site ORDER BY optional, page_id) AS ord, CASE WHEN optional THEN 'Optional' ELSE 'Docs' END AS section, 'Page ' || page_id AS name,
               'https://' || site || '/p' || page_id || '.md' AS url, 'note ' || size AS notes, optional FROM site""",
    "q44_docs_caps_required_optional": f"""WITH RECURSIVE {_INDEX},
        r AS (
            SELECT page_id % 5 AS site, page_id AS ord, optional, CASE WHEN page_id % 11 <> 0 THEN size END AS size, row_number() OVER (PARTITION BY page_id % 5 ORDER BY optional, page_id) AS n,
                   row_number() OVER (PARTITION BY page_id % 5, optional ORDER BY page_id) AS k FROM site),
        f(site, n, ord, total, fetched, ended, outcome) AS (
            SELECT site, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, '' FROM (SELECT DISTINCT site FROM r)
            UNION ALL
            SELECT site, n, ord, total + CASE WHEN o = 'kept' THEN size ELSE 0 END, fetched + CASE WHEN o = 'kept' THEN 1 ELSE 0 END, ended OR o = 'optional skipped', o
            FROM (SELECT r.site, r.n, r.ord, f.total, f.fetched, f.ended, r.size, CASE
                    WHEN NOT r.optional AND r.k > 20 THEN 'over page cap'
                    WHEN r.optional AND (f.ended OR f.total >= 50000 OR f.fetched >= 20) THEN 'optional skipped'
                    WHEN r.size IS NULL THEN 'failed' WHEN r.size = 0 THEN 'empty page'
                    WHEN f.fetched > 0 AND f.total + r.size > 60000 THEN 'over text cap' ELSE 'kept' END AS o
                  FROM f JOIN r ON r.site = f.site AND r.n = f.n + 1))
        SELECT site, ord, outcome FROM f WHERE n > 0""",
    "q45_llms_full_split": "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, 'Page ' || doc_id AS title, 'body ' || n_chars AS body FROM documents WHERE doc_id % 5 < 4",
    "q46_pipe_table": """
        SELECT CAST(n_regionkey AS BIGINT) AS region, '| key | na\\|me |' || chr(10) || '| --- | --- |' || chr(10)
               || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS rendered FROM nation GROUP BY n_regionkey""",
    "q47_manifest_diff_added": "SELECT source, key, position FROM (SELECT source, doc_id, 'k' || doc_id AS key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM documents WHERE doc_id % 7 <> 0) WHERE doc_id % 10 = 0",
    "q47_manifest_diff_removed": "SELECT source, 'k' || doc_id AS key FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0",
    "q47_manifest_diff_unchanged": "SELECT source, count(DISTINCT doc_id) AS unchanged FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0 GROUP BY source",
    "q48_refresh_due": """
        WITH a AS (SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '1998-08-02 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS age_days,
                          ['youtube', 'playlist', 'audio', 'paper', 'book', 'article', 'repo', 'docs', 'notes', 'document', 'thread', 'transcript'][o_orderkey % 12 + 1] AS t FROM orders)
        SELECT o_orderkey, age_days, t IN ('playlist', 'docs', 'repo', 'notes', 'thread') AND age_days >= 400 AS due FROM a""",
    "q49_inventory_topics": f"""
        WITH s AS (SELECT lang, source, sum(floor({_WORDS.format('text')} * 1.333)) AS est, count(*) AS n FROM documents GROUP BY lang, source)
        SELECT lang, count(*) AS n_sources, count(*) > 1 AS topic, CAST(sum(est) AS BIGINT) AS est_tokens, max(n) AS most_segments FROM s GROUP BY lang""",
    "q50_validate_rules": """
        SELECT doc_id, 'name differs from folder' AS error FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 'description missing' FROM documents WHERE doc_id % 6 = 0 OR text = ''
        UNION ALL SELECT doc_id, 'description too long' FROM documents WHERE doc_id % 6 <> 0 AND length(text) > 1024""",
    "q51_eval_score": "SELECT doc_id % 20 AS skill, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS score FROM labels GROUP BY 1",
    "q52_leitner_schedule": """
        WITH b AS (SELECT doc_id, CASE WHEN quality = 1 THEN least(doc_id % 5 + 2, 5) ELSE 1 END AS box FROM labels)
        SELECT doc_id, CAST(box AS BIGINT) AS box, CAST(DATE '2024-01-01' + [1, 3, 7, 14, 30][box] AS DATE) AS due FROM b""",
    "q53_rate_limit_run": f"""WITH {_CUES}, l AS (SELECT user_id, ord, event_type IN ('error', 'view') AS bad FROM c),
        g AS (SELECT *, bad AND lag(bad, 1, false) OVER w AND lag(bad, 2, false) OVER w AS third FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ord))
        SELECT user_id, min(ord) FILTER (third) AS aborted_at FROM g GROUP BY user_id""",
    "q54_caption_track_choice": """
        WITH t AS (SELECT doc_id % 40 AS video, CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'auto' END AS kind, CASE WHEN doc_id % 3 = 0 THEN lang || '-x' ELSE lang END AS lang, doc_id AS fmt_ord FROM documents WHERE doc_id % 5 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY kind <> 'manual', NOT (lang = 'en' OR starts_with(lang, 'en-')), lang, fmt_ord) AS n FROM t)
        SELECT video, kind, lang, fmt_ord FROM r WHERE n = 1""",
    "q55_year_and_doi": """
        SELECT doc_id, '10.' || 1000 + doc_id % 9000 || '/abc.' || doc_id AS doi, CAST(2000 + doc_id % 25 AS INTEGER) AS arxiv_year,
               CAST(CASE WHEN 1990 + doc_id % 40 <= year(current_date) + 1 THEN 1990 + doc_id % 40 END AS INTEGER) AS creation_year FROM documents""",
    "q56_listing_entries": """
        WITH p AS (SELECT page_id % 40 AS listing, page_id, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id) AS number, CASE WHEN page_id % 5 <> 0 THEN 'T ' || page_id END AS t,
                          CASE WHEN page_id % 3 = 0 THEN nullif(url, '') END AS own, CASE WHEN page_id % 7 <> 0 THEN 'https://www.youtube.com/watch?v=v' || page_id END AS video FROM pages)
        SELECT listing, page_id, number, coalesce(t, 'Video ' || number) AS title, coalesce(own, video) AS url,
               CASE WHEN own IS NULL AND video IS NULL THEN 'playlist entry has no url or id' END AS reason FROM p WHERE number <= 20""",
    "q57_transcript_choice": """
        WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 8 <> 2 THEN source END AS told, CASE WHEN doc_id % 4 <> 1 THEN lang END AS said FROM documents)
        SELECT doc_id AS video_id, CASE WHEN told IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'manual' ELSE 'auto' END WHEN said IS NOT NULL THEN 'whisper' END AS label,
               coalesce(told, said) AS text, CASE WHEN told IS NULL AND said IS NULL THEN 'no captions and no transcription' END AS reason FROM v""",
    "q58_source_captures": """
        SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN (1000 + doc_id % 9000) || '.' || (10000 + doc_id % 90000) || 'v2' END AS arxiv_id,
               CASE WHEN doc_id % 6 = 1 THEN 'owner' || doc_id END AS owner, CASE WHEN doc_id % 6 = 1 THEN 'repo-' || doc_id END AS repo,
               CASE WHEN doc_id % 6 = 2 THEN 'https://www.youtube.com/@name' || doc_id || '/videos' END AS videos_url,
               CASE doc_id % 6 WHEN 3 THEN 'hackernews' WHEN 4 THEN 'reddit' END AS platform, CASE doc_id % 6 WHEN 3 THEN '' || doc_id WHEN 4 THEN 'a' || doc_id END AS thread_id,
               CAST(CASE doc_id % 6 WHEN 2 THEN 20 WHEN 5 THEN 5 END AS BIGINT) AS default_limit FROM documents""",
    "q59_skill_file_problems": """
        SELECT 's' || doc_id % 30 AS skill, 'a/f' || doc_id || '.md' AS path, 'empty' AS problem FROM documents WHERE doc_id % 9 = 0
        UNION ALL SELECT 's' || doc_id % 30, 'a/f' || doc_id || '.md', 'no file f' || (doc_id + 30) || '.md' FROM documents WHERE doc_id % 9 <> 0 AND doc_id + 30 NOT IN (SELECT doc_id FROM documents)""",
    "q60_evaluation_files": """
        SELECT 's' || doc_id AS skill, 'skill_name differs from folder' AS error FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT 's' || doc_id, CASE doc_id % 6 WHEN 1 THEN 'no prompt in item 1' WHEN 2 THEN 'no expectations in item 1' ELSE 'no evals' END FROM documents WHERE doc_id % 6 IN (1, 2, 3)""",
    "q61_listing_outcome": """
        WITH k AS (SELECT page_id % 40 AS listing, page_id, (page_id // 40 * 7 + page_id % 40) % 5 AS kind FROM pages WHERE page_id % 6 <> 0),
        b AS (SELECT *, kind <= 2 OR listing > 35 AS limited, kind <= 3 OR listing > 35 AS failed FROM k),
        r AS (SELECT *, sum(CAST(limited AS INTEGER)) OVER (PARTITION BY listing ORDER BY page_id ROWS 2 PRECEDING) = 3 AS run FROM b)
        SELECT listing, bool_or(run) AS aborted, bool_and(failed) AS all_failed FROM r GROUP BY listing""",
    "q62_citation_strings": """
        SELECT doc_id, CAST(2000 + doc_id % 24 AS INTEGER) AS venue_year, '1706.' || lpad('' || doc_id % 99999, 5, '0') AS stamped_id,
               CASE doc_id % 3 WHEN 0 THEN 'Ann A' || doc_id || '|Bo B|Cy C' WHEN 1 THEN 'Ada L' || doc_id || '|Alan T' ELSE 'L' || doc_id || ', Ada' END AS authors,
               CAST(CASE WHEN doc_id % 4 <> 0 THEN 1990 + doc_id % 30 ELSE 2014 END AS INTEGER) AS text_year FROM documents""",
    "q63_options_hints_paths": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN 'limit applies to playlists only'
                            WHEN doc_id % 2 = 0 AND doc_id % 3 = 2 THEN 'transcribe applies to videos and playlists only' END AS option_error,
               CASE doc_id % 4 WHEN 2 THEN 'bot check: retry later or from another network' WHEN 3 THEN 'check the source and retry' ELSE 'rate limited: wait and retry' END AS hint,
               CASE WHEN doc_id % 7 = 0 THEN '~' WHEN doc_id % 3 = 0 THEN '~/' || doc_id WHEN doc_id % 3 = 1 THEN '/home/u2/' || doc_id ELSE '/srv/home/u/' || doc_id END AS path FROM documents""",
}
