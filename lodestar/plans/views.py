"""The engine's tables as views over the driver's."""

from __future__ import annotations

from lodestar.plans.base import View

NOW = "TIMESTAMP '1996-06-01 00:00:00'"

VIEWS = {
    "folders": View("region", {"id": "r_regionkey", "display_name": "r_name", "enabled": "r_regionkey <> 4", "last_scan_at": "CASE WHEN r_regionkey = 3 THEN NULL WHEN r_regionkey = 2 THEN TIMESTAMP '1996-05-31 23:58:00' ELSE TIMESTAMP '1996-05-31 20:00:00' END"}),
    "projects": View("nation", {"id": "n_nationkey", "folder_id": "n_regionkey", "name": "n_name"}),
    "users": View("customer", {"id": "c_custkey", "role": "CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END", "active": "c_acctbal >= 0", "expires_at": "CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1996-05-01 00:00:00' ELSE TIMESTAMP '1996-07-01 00:00:00' END"}),
    "grants": View("customer", {"user_id": "c_custkey", "project_id": "c_nationkey"}),
    "requests": View("customer", {"user_id": "c_custkey", "requested": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey % 7 END"}),
    "files": View(
        "part",
        {
            "id": "p_partkey", "project_id": "CAST(p_partkey % 25 AS INT)", "folder_id": "CAST(p_partkey % 5 AS INT)", "rel_path": "concat(p_brand, '/', p_name, '-', p_partkey)",
            "file_name": "concat(CASE WHEN p_partkey % 23 = 0 THEN '~$' WHEN p_partkey % 29 = 0 THEN '.' ELSE '' END, p_name, CASE p_partkey % 9 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.md' WHEN 4 THEN '.pptx' WHEN 5 THEN '.exe' WHEN 6 THEN '' WHEN 7 THEN '.part' ELSE '.pdf' END)",
            "size_bytes": "CAST(p_size AS BIGINT) * 100000", "mtime": "CAST(p_retailprice AS DOUBLE)", "sha256": "concat('h', p_size)",
            "status": "CASE p_partkey % 5 WHEN 0 THEN 'indexed' WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN 'failed' ELSE 'deleted' END",
            "model": "CASE WHEN p_partkey % 3 = 0 THEN 'bge-m3' ELSE 'multilingual-e5-small' END",
        },
    ),
    "found": View("part", {"rel_path": "concat(p_brand, '/', p_name, '-', p_partkey)", "size_bytes": "CAST(p_size AS BIGINT) * 100000 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END", "mtime": "CAST(p_retailprice AS DOUBLE)", "kind": "CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' ELSE 'office' END"}, "p_partkey % 11 <> 0"),
    "known": View("part", {"id": "p_partkey", "rel_path": "concat(p_brand, '/', p_name, '-', p_partkey)", "size_bytes": "CAST(p_size AS BIGINT) * 100000", "mtime": "CAST(p_retailprice AS DOUBLE)", "status": "CASE p_partkey % 5 WHEN 0 THEN 'indexed' WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN 'indexed' ELSE 'deleted' END", "model": "CASE WHEN p_partkey % 3 = 0 THEN 'bge-m3' ELSE 'multilingual-e5-small' END"}, "p_partkey % 17 <> 0"),
    "jobs": View(
        "orders",
        {
            "id": "o_orderkey", "lane": "CASE o_orderkey % 3 WHEN 0 THEN 'doc' WHEN 1 THEN 'media' ELSE 'system' END", "status": "CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'running' END",
            "priority": "CAST(substring(o_orderpriority, 1, 1) AS INT)", "attempts": "CAST(o_orderkey % 4 AS INT)", "max_attempts": "3", "file_id": "o_custkey", "dedupe_key": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('index:', o_custkey) END",
            "run_after": "o_orderdate", "heartbeat_at": "o_orderdate", "progress": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END",
            "payload": "CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE concat('{\"file_id\":', o_custkey, ',\"pages\":[1,', o_orderkey, ']', CASE WHEN o_orderkey % 4 = 1 THEN ',\"force\":false' ELSE '' END, '}') END",
        },
    ),
    "heartbeats": View("events", {"id": "event_id", "service": "event_type", "user_id": "user_id", "seen_at": "ts", "value": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END"}),
    "observations": View("events", {"id": "event_id", "file_id": "user_id", "seen_at": "ts", "size_bytes": "CAST(event_id % 2 AS BIGINT)", "mtime": "CAST(event_id % 3 AS DOUBLE)", "forced": "event_id % 50 = 0"}),
    "messages": View("conversations", {"conv_id": "conv_id", "turn": "turn", "role": "role", "content": "text"}),
    "models": View("supplier", {"id": "s_suppkey", "name": "s_name", "enabled": "s_acctbal > 0", "is_default": "s_suppkey % 40 = 7"}),
    "citations": View("lineitem", {"message_id": "l_orderkey", "marker": "l_linenumber", "file_id": "l_partkey", "page": "CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity AS INT) END", "sha256": "concat('h', CAST(l_quantity AS INT))"}),
    "chunk_files": View("lineitem", {"file_id": "l_partkey", "ordinal": "l_linenumber", "chunk": "l_orderkey"}),
    "documents": View("documents", {"id": "doc_id", "project": "source", "lang": "lang", "text": "text"}),
    "pages": View("pages", {"id": "page_id", "url": "url", "html": "html"}),
    "questions": View("benchmark", {"id": "item_id", "text": "text"}),
    "vectors": View("embeddings", {"id": "vec_id", "project": "label", "embedding": "embedding"}),
    "passages": View(
        "pages",
        {
            "chunk": "page_id", "project": "CAST(page_id % 5 AS INT)", "heading": "regexp_extract(html, '<h1>(.*?)</h1>', 1)",
            "text": ("trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' '))", "trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'))"),
        },
    ),
    "page_files": View("pages", {"file": "page_id", "status": "CASE WHEN page_id % 7 = 0 THEN 'processing' ELSE 'indexed' END"}),
    "asked": View("benchmark", {"question": "item_id", "text": "text"}),
    "prompts": View("part", {"id": "p_partkey", "text": "concat(CASE p_partkey % 6 WHEN 0 THEN 'What is ' WHEN 1 THEN 'how do I call ' WHEN 2 THEN '  Tell me about ' WHEN 3 THEN 'Overview of ' WHEN 4 THEN 'What does it cover: ' ELSE 'Explain, in as many words as one can possibly need, what this is: ' END, p_name)"}),
    "definitions": View("nation", {"question": "n_nationkey", "text": "concat('What is ', n_name, '? ', n_regionkey)"}),
    "marked": View("documents", {"id": "doc_id", "text": ("regexp_replace(text, '\\\\n(Th|En|De|La)', '\\n## $1')", "regexp_replace(text, '\\n(Th|En|De|La)', chr(10) || '## \\1', 'g')")}),
    "spaced": View("documents", {"id": "doc_id", "text": ("replace(text, '.\\n', '.\\n \\n')", "replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10))")}),
    "places": View("lineitem", {"place": "l_orderkey * 10 + l_linenumber", "file": "l_partkey % 50", "section": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_linestatus END", "page": "l_linenumber - 1"}),
    "logins": View("orders", {"id": "o_orderkey", "user_id": "o_custkey", "happened_at": "CAST(o_orderdate AS TIMESTAMP)"}),
    "headed": View("lineitem", {"file_id": "l_partkey", "heading": "CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 5 THEN '' ELSE concat(l_returnflag, ' ', l_linenumber) END"}),
    "file_events": View("events", {"file_id": "user_id", "happened_at": "ts", "id": "event_id", "event": "CASE WHEN event_id % 23 = 0 THEN 'removed' WHEN event_id % 11 = 0 THEN 'requeued' WHEN event_id % 3 = 0 THEN 'claimed' WHEN event_id % 3 = 1 THEN 'indexed' ELSE 'failed' END"}),
    "labels": View("labels", {"id": "doc_id", "quality": "quality", "toxic": "toxic"}),
}
