"""DuckDB SQL with the same results as the queries, written from the tables up."""

from __future__ import annotations

from skeinwork.plans import cases

from skeinwork.functions.matcher import BUNDLED
from skeinwork.plans.corpus import NOW, PACK, PROMPT



def _spelt(pattern: str) -> str:
    """A pattern whose word boundaries at either end are Unicode's: DuckDB's are ASCII only."""
    return r"(?:^|[^\pL\pN_])" + pattern.removeprefix(r"\b").removesuffix(r"\b") + r"(?:$|[^\pL\pN_])"


#: Tables that the statements build on; a statement takes those that it names, and what they name.
TABLES = {
    "msgs": """
      SELECT user_id AS dialog_id, CAST(event_id AS INTEGER) AS msg_id, CAST(floor(epoch(ts)) AS BIGINT) AS date, user_id AS from_id, event_id % 2 = 0 AS outgoing,
        CAST(CASE WHEN event_id % 7 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS INTEGER) AS reply_to,
        CASE WHEN event_id % 5 = 0 THEN event_id // 40 END AS grouped_id,
        CASE WHEN event_type = 'view' AND event_id % 10 = 0 THEN 'voice_message' END AS media_type,
        event_type || ' ' || coalesce(props, '') AS text, event_type = 'signup' AND event_id % 3 = 0 AS protected,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos
      FROM events""",
    "dlgs": """
      SELECT user_id AS id, CASE user_id % 10 WHEN 0 THEN 'megagroup' WHEN 1 THEN 'chat' WHEN 2 THEN 'channel' ELSE 'user' END AS kind,
        CASE WHEN user_id % 4 <> 0 THEN user_id * 31 END AS access_hash, 'user ' || user_id AS title, count(*) AS msg_count
      FROM events GROUP BY user_id""",
    "aged": f"""
      SELECT *, CASE WHEN {NOW} - date <= 0 THEN 0 ELSE ({NOW} - date) // 86400 END AS days,
        CASE WHEN days <= 180 THEN 'T0' WHEN days <= 365 THEN 'T1' ELSE 'T2' END AS tier,
        CASE tier WHEN 'T0' THEN 1.0::DOUBLE WHEN 'T1' THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END AS mult
      FROM msgs""",
    "kw": " UNION ALL ".join(
        f"SELECT dialog_id, msg_id, '{r.axis}' AS axis, '{r.rule_id}' AS rule_id, '{r.rule_id}' AS term, regexp_extract(text, '{r.pattern}') AS surface, 'regex' AS layer, tier, "
        f"{r.weight}::DOUBLE * mult AS priority, FALSE AS protected FROM aged WHERE regexp_matches(text, '{r.pattern}')"
        for r in PACK
    ),
    "ties": """
      SELECT m.dialog_id, m.msg_id, CASE
          WHEN EXISTS (SELECT 1 FROM kw h JOIN msgs x ON x.dialog_id = h.dialog_id AND x.msg_id = h.msg_id WHERE x.dialog_id = m.dialog_id AND x.grouped_id = m.grouped_id) THEN 'same_album'
          WHEN EXISTS (SELECT 1 FROM kw h JOIN msgs x ON x.dialog_id = h.dialog_id AND x.msg_id = h.msg_id WHERE x.dialog_id = m.dialog_id AND x.reply_to = m.msg_id) THEN 'replied_by_hit'
          WHEN EXISTS (SELECT 1 FROM kw h WHERE h.dialog_id = m.dialog_id AND h.msg_id = m.reply_to) THEN 'reply_to_hit' END AS tie, m.tier, m.mult
      FROM aged m WHERE NOT EXISTS (SELECT 1 FROM kw h WHERE h.dialog_id = m.dialog_id AND h.msg_id = m.msg_id)""",
    "st": "SELECT dialog_id, msg_id, 'ties' AS axis, tie AS rule_id, tie AS term, CAST(NULL AS VARCHAR) AS surface, 'structural' AS layer, tier, 0.5::DOUBLE * mult AS priority, FALSE AS protected FROM ties WHERE tie IS NOT NULL",
    "hits": "SELECT * FROM kw UNION ALL SELECT * FROM st",
    "mh": """
      SELECT m.dialog_id, m.msg_id, m.date, m.protected, m.pos, coalesce(round(sum(h.priority), 9), 0) AS priority,
        coalesce(list_sort(list(DISTINCT h.axis) FILTER (h.axis IS NOT NULL)), []) AS axes, coalesce(list_sort(list(DISTINCT h.rule_id) FILTER (h.rule_id IS NOT NULL)), []) AS rules, min(h.tier) AS tier
      FROM msgs m LEFT JOIN hits h ON h.dialog_id = m.dialog_id AND h.msg_id = m.msg_id GROUP BY ALL""",
    "anch": """
      SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY dialog_id ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM mh
      WHERE NOT protected AND priority >= 2.0 AND dialog_id IN (SELECT id FROM dlgs WHERE kind NOT IN ('megagroup', 'chat'))""",
    "clus": "SELECT *, sum(fresh) OVER (PARTITION BY dialog_id ORDER BY pos) AS cluster FROM anch",
    "spans": """
      SELECT dialog_id, cluster, greatest(min(pos) - 2, 0) AS lo, least(max(pos) + 2, (SELECT max(pos) FROM msgs m WHERE m.dialog_id = clus.dialog_id)) AS hi,
        list(msg_id ORDER BY msg_id) AS anchors, list_sort(list_distinct(flatten(list(axes)))) AS axes, list_sort(list_distinct(flatten(list(rules)))) AS rules,
        greatest(max(date), 0) AS newest, coalesce(min(tier), 'T2') AS tier
      FROM clus GROUP BY dialog_id, cluster""",
    "wins": """
      SELECT s.dialog_id, min(m.msg_id) AS from_id, max(m.msg_id) AS to_id, any_value(s.anchors) AS anchors, any_value(s.axes) AS axes, any_value(s.tier) AS tier,
        coalesce(list(m.msg_id ORDER BY m.msg_id) FILTER (m.media_type = 'voice_message'), []) AS voices, count(*) AS total, CAST(sum(length(m.text)) AS BIGINT) AS chars,
        any_value(s.newest) AS newest, any_value(s.rules) AS rules
      FROM spans s JOIN msgs m ON m.dialog_id = s.dialog_id AND m.pos BETWEEN s.lo AND s.hi GROUP BY s.dialog_id, s.cluster""",
    "runs": f"""
      SELECT dialog_id, from_id AS window_from, to_id AS window_to, 'alpha' AS model, '{PROMPT}' AS prompt_id, dialog_id % 11 <> 0 AS fine, 1 AS claims, chars + 10 AS prompt_tokens,
        total AS completion_tokens, total * 0.25::DOUBLE AS cost, CASE WHEN dialog_id % 5 = 0 THEN 2 ELSE 1 END AS passes FROM wins
      UNION ALL SELECT dialog_id, from_id, to_id, 'beta', '{PROMPT}', TRUE, 0, chars + 10, total, total * 0.25::DOUBLE, 1 FROM wins""",
    "ranges": f"""
      SELECT dialog_id, from_id AS window_from, to_id AS window_to, 'alpha' AS model, '{PROMPT}' AS prompt_id, 0 AS nth, anchors[1] AS lo, anchors[-1] AS hi, axes[1] AS axis, 'r' || (from_id % 3) AS reason
      FROM wins WHERE dialog_id % 11 <> 0
      UNION ALL SELECT dialog_id, from_id, to_id, 'beta', '{PROMPT}', 0, from_id + (to_id - from_id) // 2, to_id, axes[1], 'half' FROM wins WHERE dialog_id % 3 <> 0
      UNION ALL SELECT dialog_id, from_id, to_id, 'beta', '{PROMPT}', 1, to_id, to_id, axes[1], 'beyond' FROM wins WHERE dialog_id % 3 <> 0""",
    "inr": "SELECT r.*, m.msg_id, m.protected, m.pos FROM ranges r JOIN msgs m ON m.dialog_id = r.dialog_id AND m.msg_id BETWEEN r.lo AND r.hi",
    "cutm": "SELECT DISTINCT dialog_id, window_from, window_to, model, prompt_id, msg_id, protected FROM inr",
    "plan": """
      SELECT dialog_id, msg_id, reason, axis, 0.5::DOUBLE AS confidence, FALSE AS approved FROM
        (SELECT *, row_number() OVER (PARTITION BY dialog_id, msg_id ORDER BY window_from, window_to, nth) AS r FROM inr WHERE model = 'alpha' AND NOT protected) WHERE r = 1""",
    "appr": "SELECT * REPLACE (axis = 'ops' AS approved) FROM plan",
    "dlog": "SELECT dialog_id, msg_id, CASE msg_id % 13 WHEN 0 THEN 'done' WHEN 1 THEN 'pending' ELSE 'error' END AS state FROM appr",
    "dele": """
      SELECT a.dialog_id, a.msg_id, d.kind, d.title, d.kind IN ('chat', 'saved_messages') OR d.access_hash IS NOT NULL AS peer_ok, m.date, m.pos
      FROM appr a JOIN dlgs d ON d.id = a.dialog_id JOIN msgs m ON m.dialog_id = a.dialog_id AND m.msg_id = a.msg_id LEFT JOIN dlog x ON x.dialog_id = a.dialog_id AND x.msg_id = a.msg_id
      WHERE a.approved AND (x.msg_id IS NULL OR x.state = 'error')""",
    "isl": "SELECT *, pos - row_number() OVER (PARTITION BY dialog_id ORDER BY pos) AS island FROM dele",
    "part": "SELECT *, (row_number() OVER (PARTITION BY dialog_id, island ORDER BY pos) - 1) // 3 AS part FROM isl",
    "chun": """
      SELECT dialog_id, row_number() OVER (PARTITION BY dialog_id ORDER BY min(pos)) AS chunk, min(msg_id) AS first_id, max(msg_id) AS last_id, count(*) AS messages, any_value(peer_ok) AS peer_ok
      FROM part GROUP BY dialog_id, island, part""",
    "old": "SELECT dialog_id, count(*) AS messages, min(date) AS oldest, any_value(kind) AS kind, any_value(title) AS title, any_value(peer_ok) AS peer_ok FROM dele GROUP BY dialog_id",
    "marka": "SELECT * FROM (SELECT dialog_id, msg_id, reason, row_number() OVER (PARTITION BY dialog_id, msg_id ORDER BY window_from DESC, window_to DESC, nth DESC) AS r FROM inr WHERE model = 'alpha') WHERE r = 1",
    "markb": "SELECT * FROM (SELECT dialog_id, msg_id, reason, row_number() OVER (PARTITION BY dialog_id, msg_id ORDER BY window_from DESC, window_to DESC, nth DESC) AS r FROM inr WHERE model = 'beta') WHERE r = 1",
    "mark2": "SELECT coalesce(a.dialog_id, b.dialog_id) AS dialog_id, coalesce(a.msg_id, b.msg_id) AS msg_id, a.reason AS ra, b.reason AS rb FROM marka a FULL JOIN markb b ON a.dialog_id = b.dialog_id AND a.msg_id = b.msg_id",
    "cnts": """
      SELECT dialog_id, window_from, window_to, count(*) AS u, count(*) FILTER (k = 2) AS c FROM (
        SELECT dialog_id, window_from, window_to, msg_id, count(*) AS k FROM cutm GROUP BY ALL) GROUP BY ALL""",
    "prs": """
      SELECT a.dialog_id, a.window_from, a.window_to, a.model || ' @ ' || a.prompt_id AS run_a, b.model || ' @ ' || b.prompt_id AS run_b, CASE WHEN coalesce(u, 0) = 0 THEN 1.0::DOUBLE ELSE c / u END AS jaccard
      FROM runs a JOIN runs b ON a.dialog_id = b.dialog_id AND a.window_from = b.window_from AND a.window_to = b.window_to AND a.model = 'alpha' AND b.model = 'beta'
      LEFT JOIN cnts ON cnts.dialog_id = a.dialog_id AND cnts.window_from = a.window_from AND cnts.window_to = a.window_to WHERE a.fine AND b.fine""",
    "exps": "SELECT c.conv_id + 100 AS dialog_id, CAST(turn AS INTEGER) AS msg_id, role, turn, conv_id, coalesce(text, '') AS text FROM conversations c",
    "docm": f"""
      SELECT doc_id, coalesce(text, '') AS text, (doc_id * 40000) // 86400 AS days, CASE WHEN days <= 180 THEN 'T0' WHEN days <= 365 THEN 'T1' ELSE 'T2' END AS tier,
        CASE tier WHEN 'T0' THEN 1.0::DOUBLE WHEN 'T1' THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END AS mult FROM documents""",
    "doch": " UNION ALL ".join(f"SELECT doc_id, '{r.axis}' AS axis, '{r.rule_id}' AS rule_id, tier, {r.weight}::DOUBLE * mult AS priority FROM docm WHERE regexp_matches(text, '{_spelt(r.pattern)}')" for r in BUNDLED),
    "spent": "SELECT model, prompt_id, round(sum(cost), 9) AS cost, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(CASE WHEN passes > 1 THEN 1 ELSE 0 END) AS BIGINT) AS expanded FROM runs GROUP BY model, prompt_id",
}


def _named(text: str) -> list[str]:
    words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
    return [t for t in TABLES if t in words]


def statement(body: str) -> str:
    """``body`` with the tables that it needs, in the order in which they are defined."""
    need, todo = set(), _named(body)
    while todo:
        t = todo.pop()
        if t not in need:
            need.add(t)
            todo += [x for x in _named(TABLES[t]) if x != t]
    # Each is computed once; the lists above are in an order that suits.
    tables = ",\n".join(f"{t} AS MATERIALIZED ({TABLES[t].strip()})" for t in TABLES if t in need)
    return f"WITH {tables}\n{body.strip()}" if need else body.strip()


def _listed(source: str) -> str:
    lists = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("anchors", "axes", "voices", "rules"))
    return f"SELECT dialog_id, from_id, to_id, {lists}, tier, total, chars, newest FROM {source}"


_FNV = "list_reduce([2166136261::UBIGINT, " + ", ".join([f"((dialog_id >> {8 * k}) & 255)::UBIGINT" for k in range(8)] + [f"((from_id::BIGINT >> {8 * k}) & 255)::UBIGINT" for k in range(4)]) + "], lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
_FNV_HIT = "list_reduce([2166136261::UBIGINT, " + ", ".join([f"((h.dialog_id >> {8 * k}) & 255)::UBIGINT" for k in range(8)] + [f"((h.msg_id::BIGINT >> {8 * k}) & 255)::UBIGINT" for k in range(4)]) + "], lambda a, b: (xor(a, b) * 16777619) % 4294967296)"
_IN_RUN = "x.dialog_id = r.dialog_id AND x.window_from = r.window_from AND x.window_to = r.window_to AND x.model = r.model"

STATEMENTS = {
    "regex_scan": "SELECT axis, rule_id, tier, count(*) AS hits, count(DISTINCT doc_id) AS messages, round(sum(priority), 6) AS priority FROM doch GROUP BY ALL",
    "regex_surfaces": "SELECT doc_id AS dialog_id, 'card_number' AS rule_id, regexp_extract(text, '" + next(r.pattern for r in BUNDLED if r.rule_id == "card_number") + "') AS surface, 3.0::DOUBLE AS priority FROM docm WHERE surface <> ''",
    "age_tiers": """
      SELECT tier, count(*) AS orders, round(sum(CASE tier WHEN 'T0' THEN 1.0::DOUBLE WHEN 'T1' THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END), 6) AS weight FROM (
        SELECT CASE WHEN d <= 180 THEN 'T0' WHEN d <= 365 THEN 'T1' ELSE 'T2' END AS tier FROM (
          SELECT greatest(996624000 - CAST(floor(epoch(o_orderdate)) AS BIGINT), 0) // 86400 AS d FROM orders)) GROUP BY tier""",
    "positions": "SELECT dialog_id, msg_id, date, from_id, outgoing, reply_to, grouped_id, media_type, text, protected, pos FROM msgs",
    "ingest_messages": """
      SELECT dialog_id, msg_id, conv_id * 3600 + turn * 60 AS date, CASE WHEN role = 'user' THEN 1 ELSE conv_id + 100 END AS from_id, FALSE OR role = 'user' AS outgoing,
        CAST(CASE WHEN turn > 0 THEN turn - 1 END AS INTEGER) AS reply_to, CAST(NULL AS VARCHAR) AS fwd_from, CASE WHEN turn % 3 = 2 THEN 'photo' END AS media_type, CASE WHEN turn % 3 = 2 THEN 'p.jpg' END AS file_path,
        CASE WHEN turn % 2 = 0 THEN text ELSE '> ' || text || ' http://a.b' END AS text
      FROM exps WHERE role <> 'system'""",
    "ingest_dialogs": "SELECT dialog_id AS id, 'user' AS kind, 'id' || dialog_id AS title, count(*) FILTER (role <> 'system') AS msg_count FROM exps GROUP BY dialog_id",
    "upsert_dialogs": """
      SELECT coalesce(n.id + 40, o.id) AS id, coalesce(n.kind, o.kind) AS kind, o.access_hash, coalesce('new ' || n.title, o.title) AS title, greatest(n.msg_count - n.id % 5 + 2, o.msg_count) AS msg_count
      FROM dlgs o FULL JOIN dlgs n ON n.id + 40 = o.id""",
    "replace_messages": """
      SELECT dialog_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN protected THEN 1 ELSE 0 END) AS BIGINT) AS protected FROM (
        SELECT dialog_id, CASE WHEN msg_id % 4 = 0 THEN 'again ' || text ELSE text END AS text, protected AND msg_id % 4 <> 0 AS protected FROM msgs
        UNION ALL SELECT dialog_id, 'again ' || text, FALSE FROM msgs WHERE msg_id % 4 <> 0) GROUP BY dialog_id""",
    "enrich_access_hash": "SELECT id, h AS access_hash, kind IN ('chat', 'saved_messages') OR h IS NOT NULL AS peer_ok FROM (SELECT *, CASE WHEN id % 8 = 0 THEN id + 7 ELSE access_hash END AS h FROM dlgs)",
    "keyword_hits": "SELECT * FROM kw",
    "structural_hits": "SELECT * FROM st",
    "scan_totals": "SELECT *, round(marked / messages, 6) AS share FROM (SELECT (SELECT count(*) FROM msgs) AS messages, count(DISTINCT dialog_id || ':' || msg_id) AS marked, CAST(count(*) FILTER (protected) AS BIGINT) AS protected_hits FROM hits)",
    "scan_by_axis_tier": "SELECT axis, tier, count(*) AS hits, count(DISTINCT dialog_id || ':' || msg_id) AS messages FROM hits GROUP BY axis, tier",
    "scan_top_rules": "SELECT rule_id, term, count(*) AS n FROM hits GROUP BY rule_id, term ORDER BY n DESC, rule_id, term LIMIT 25",
    "scan_density": "SELECT dialog_id, title, marked, msg_count, round(100.0::DOUBLE * marked / msg_count, 6) AS percent FROM (SELECT dialog_id, count(DISTINCT msg_id) AS marked FROM hits GROUP BY dialog_id) JOIN dlgs ON id = dialog_id ORDER BY marked DESC, dialog_id LIMIT 20",
    "message_hits": "SELECT dialog_id, msg_id, priority, array_to_string(axes, ',') AS axes, array_to_string(rules, ',') AS rules, tier FROM mh",
    "windows": _listed("wins"),
    "windows_report": """
      SELECT count(*) AS windows, CAST(sum(total) AS BIGINT) AS messages, CAST(sum(len(voices)) AS BIGINT) AS voices, CAST(sum(chars) AS BIGINT) AS chars,
        list_sort(list(total))[CAST(floor((count(*) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, list_sort(list(total))[CAST(floor((count(*) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90,
        list_sort(list(total))[CAST(floor((count(*) - 1) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99, max(total) AS max, CAST(sum(chars) // 2 + count(*) * 1950 AS BIGINT) AS tokens,
        CAST((sum(chars) // 2 + count(*) * 1950) // count(*) AS BIGINT) AS tokens_a_call FROM wins""",
    "windows_by_tier": "SELECT tier, count(*) AS windows FROM wins GROUP BY tier",
    "windows_by_axis": "SELECT axis, count(*) AS windows FROM (SELECT unnest(axes) AS axis FROM wins) GROUP BY axis",
    "windows_limit": _listed("(SELECT * FROM wins ORDER BY tier, len(anchors) DESC, dialog_id, from_id LIMIT 25)"),
    "windows_sample": _listed(f"(SELECT * FROM (SELECT *, coalesce(axes[1], '') AS ax, row_number() OVER (PARTITION BY coalesce(axes[1], '') ORDER BY {_FNV}, tier, len(anchors) DESC, dialog_id, from_id) AS turn FROM wins) ORDER BY turn, ax LIMIT 25)"),
    "windows_cutoff": _listed("wins WHERE newest >= epoch(TIMESTAMP '2024-01-20') OR list_contains(rules, 'purchases')"),
    "windows_expand": """
      SELECT w.dialog_id, w.window_from, w.window_to, min(m.msg_id) AS from_id, max(m.msg_id) AS to_id, count(*) AS total, CAST(sum(length(m.text)) AS BIGINT) AS chars FROM (
        SELECT x.dialog_id, x.from_id AS window_from, x.to_id AS window_to, a.pos - (x.from_id % 4) * greatest(12 - total, 0) // greatest(x.from_id % 4 + x.to_id % 3, 1) AS lo, b.pos + (x.to_id % 3) * greatest(12 - total, 0) // greatest(x.from_id % 4 + x.to_id % 3, 1) AS hi
        FROM wins x JOIN msgs a ON a.dialog_id = x.dialog_id AND a.msg_id = x.from_id JOIN msgs b ON b.dialog_id = x.dialog_id AND b.msg_id = x.to_id) w
      JOIN msgs m ON m.dialog_id = w.dialog_id AND m.pos BETWEEN w.lo AND w.hi GROUP BY w.dialog_id, w.window_from, w.window_to""",
    "windows_not_judged": "SELECT dialog_id, from_id, to_id FROM wins WHERE dialog_id % 2 <> 0",
    "window_text": """
      SELECT w.dialog_id, w.from_id, w.to_id, 'Chat: ' || any_value(d.title) || chr(10) || 'Age: ' || CASE any_value(w.tier) WHEN 'T0' THEN 'recent' WHEN 'T1' THEN 'within a year' ELSE 'older than a year' END || chr(10)
        || 'Axes: ' || array_to_string(any_value(w.axes), ', ') || chr(10) || chr(10) || 'Messages:' || chr(10)
        || string_agg('[' || m.msg_id || '] ' || strftime(make_timestamp(m.date * 1000000), '%Y-%m-%d %H:%M') || ' ' || CASE WHEN m.outgoing THEN 'me' ELSE 'them' END || ': '
             || CASE WHEN m.media_type IS NOT NULL AND m.msg_id % 20 = 0 THEN '[voice] said' ELSE m.text END || chr(10)
             || CASE WHEN m.protected THEN '    (keep-list: do not remove)' || chr(10) WHEN f.fired IS NOT NULL THEN '    (rules: ' || f.fired || ')' || chr(10) ELSE '' END, '' ORDER BY m.pos)
        || 'Which ranges, if any?' AS text
      FROM wins w JOIN dlgs d ON d.id = w.dialog_id JOIN msgs m ON m.dialog_id = w.dialog_id AND m.msg_id BETWEEN w.from_id AND w.to_id
      LEFT JOIN (SELECT dialog_id, msg_id, string_agg(DISTINCT axis || '/' || rule_id, ',' ORDER BY axis || '/' || rule_id) AS fired FROM hits GROUP BY dialog_id, msg_id) f ON f.dialog_id = m.dialog_id AND f.msg_id = m.msg_id
      GROUP BY w.dialog_id, w.from_id, w.to_id""",
    "verdict_check": """
      SELECT o_orderkey AS id, n IN (0, 6, 8) AS fine, CAST(CASE n WHEN 0 THEN 1 WHEN 6 THEN 1 WHEN 8 THEN 0 END AS INTEGER) AS ranges, CAST(CASE n WHEN 0 THEN 0 WHEN 6 THEN 0 WHEN 8 THEN 1 END AS INTEGER) AS claims,
        CASE n WHEN 0 THEN o_orderkey WHEN 6 THEN 764667000000 END AS first_from FROM (SELECT o_orderkey, o_orderkey % 9 AS n FROM orders)""",
    "plan": "SELECT * FROM plan",
    "plan_beta": """
      SELECT dialog_id, msg_id, reason, axis, 0.5::DOUBLE AS confidence, FALSE AS approved FROM
        (SELECT *, row_number() OVER (PARTITION BY dialog_id, msg_id ORDER BY window_from, window_to, nth) AS r FROM inr WHERE model = 'beta' AND NOT protected) WHERE r = 1""",
    "plan_approved": "SELECT dialog_id, approved AND dialog_id <> 3 AS approved, count(*) AS n FROM appr GROUP BY ALL",
    "plan_budget": """
      SELECT *, round(planned / corpus, 6) AS share, round(planned / corpus, 6) <= 0.05 AS share_ok, worst_dialog <= 0.4 AS dialog_ok FROM (
        SELECT count(*) AS planned, CAST(count(*) FILTER (approved) AS BIGINT) AS approved, (SELECT count(*) FROM msgs) AS corpus,
          (SELECT max(round(n / msg_count, 6)) FROM (SELECT dialog_id, count(*) AS n FROM appr GROUP BY dialog_id) JOIN dlgs ON id = dialog_id) AS worst_dialog FROM appr)""",
    "plan_worst_dialogs": "SELECT dialog_id, planned, title, msg_count, round(planned / msg_count, 6) AS share FROM (SELECT dialog_id, count(*) AS planned FROM plan GROUP BY dialog_id) JOIN dlgs ON id = dialog_id ORDER BY share DESC, dialog_id LIMIT 8",
    "eval_runs": f"""
      SELECT q.*, cost, prompt_tokens, completion_tokens, expanded, q.model || ' @ ' || q.prompt_id AS run FROM (
        SELECT model, prompt_id, count(*) AS windows, CAST(sum(total) AS BIGINT) AS in_windows, CAST(sum(cut) AS BIGINT) AS cut, CAST(sum(violations) AS BIGINT) AS violations,
          CAST(sum(CASE WHEN cut / total > 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS cut_whole, CAST(sum(CASE WHEN nr = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, CAST(sum(claims) AS BIGINT) AS claims,
          CAST(sum(anchors) AS BIGINT) AS anchors, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(edge) AS BIGINT) AS edge, CAST(0 AS BIGINT) AS unmatched FROM (
          SELECT r.model, r.prompt_id, w.total, r.claims, len(w.anchors) AS anchors, (SELECT count(*) FROM cutm x WHERE {_IN_RUN}) AS cut, (SELECT count(*) FROM cutm x WHERE {_IN_RUN} AND protected) AS violations,
            (SELECT count(*) FROM ranges x WHERE {_IN_RUN}) AS nr, (SELECT count(*) FROM cutm x WHERE {_IN_RUN} AND list_contains(w.anchors, x.msg_id)) AS covered,
            CASE WHEN (SELECT count(*) FROM cutm x WHERE {_IN_RUN} AND x.msg_id IN (w.from_id, w.to_id)) > 0 THEN 1 ELSE 0 END AS edge
          FROM runs r JOIN wins w ON w.dialog_id = r.dialog_id AND w.from_id = r.window_from AND w.to_id = r.window_to WHERE r.fine) GROUP BY model, prompt_id) q JOIN spent ON spent.model = q.model AND spent.prompt_id = q.prompt_id""",
    "eval_spend": "SELECT * FROM spent",
    "eval_agreement": "SELECT run_a, run_b, round(avg(jaccard), 6) AS mean, count(*) AS windows, CAST(count(*) FILTER (jaccard < 0.5) AS BIGINT) AS far_apart FROM prs GROUP BY run_a, run_b",
    "eval_split_windows": "SELECT DISTINCT dialog_id, window_from, window_to FROM prs WHERE jaccard < 0.5 ORDER BY ALL LIMIT 15",
    "diff_summary": """
      SELECT *, round(agreed / (agreed + only_base + only_against), 6) AS undisputed FROM (
        SELECT (SELECT count(*) FROM wins) AS windows, CAST(count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS BIGINT) AS agreed, CAST(count(*) FILTER (rb IS NULL) AS BIGINT) AS only_base, CAST(count(*) FILTER (ra IS NULL) AS BIGINT) AS only_against FROM mark2)""",
    "diff_tails": """
      SELECT o.reason, n, nth, o.dialog_id, o.msg_id, strftime(make_timestamp(date * 1000000), '%Y-%m-%d') AS day, title, left(replace(text, chr(10), ' '), 100) AS head FROM (
        SELECT dialog_id, msg_id, rb AS reason, count(*) OVER (PARTITION BY rb) AS n, row_number() OVER (PARTITION BY rb ORDER BY dialog_id, msg_id) AS nth FROM mark2 WHERE ra IS NULL) o
      JOIN msgs m ON m.dialog_id = o.dialog_id AND m.msg_id = o.msg_id JOIN dlgs d ON d.id = o.dialog_id WHERE nth <= 3""",
    "audit_terms": """
      SELECT axis, rule_id, term, count(*) AS n, count(DISTINCT dialog_id) AS dialogs, max(here) AS most, round(max(here) / count(*), 6) AS share FROM (
        SELECT axis, rule_id, term, dialog_id, count(*) OVER (PARTITION BY rule_id, term, dialog_id) AS here FROM hits) GROUP BY axis, rule_id, term HAVING count(*) >= 5 AND contains(axis || ' ' || rule_id || ' ' || term, 's')""",
    "audit_samples": f"""
      SELECT rule_id, term, CAST(nth AS INTEGER) AS nth, x.dialog_id, x.msg_id, coalesce(surface, '') AS surface, left(replace(text, chr(10), ' '), 110) AS head FROM (
        SELECT rule_id, term, h.dialog_id, h.msg_id, surface, row_number() OVER (PARTITION BY rule_id, term ORDER BY {_FNV_HIT}, h.dialog_id, h.msg_id) AS nth FROM hits h) x
      JOIN msgs m ON m.dialog_id = x.dialog_id AND m.msg_id = x.msg_id WHERE nth <= 3""",
    "audit_rules": """
      SELECT rule_id, term, count(*) AS n, CAST(count(*) FILTER (cut) AS BIGINT) AS cut, round(count(*) FILTER (cut) / count(*), 6) AS share FROM (
        SELECT h.*, EXISTS (SELECT 1 FROM cutm x WHERE x.model = 'alpha' AND x.dialog_id = h.dialog_id AND x.msg_id = h.msg_id) AS cut FROM hits h
        WHERE EXISTS (SELECT 1 FROM wins w WHERE w.dialog_id = h.dialog_id AND h.msg_id BETWEEN w.from_id AND w.to_id)) GROUP BY rule_id, term HAVING count(*) >= 3""",
    "deletable": "SELECT dialog_id, msg_id, kind, title, peer_ok, date FROM dele",
    "log_states": "SELECT state, count(*) AS messages FROM dlog GROUP BY state",
    "chunks": "SELECT dialog_id, chunk, first_id, last_id, messages FROM chun",
    "chunk_dialogs": "SELECT * FROM old",
    "chunk_budget": "SELECT row_number() OVER (ORDER BY oldest, c.dialog_id, chunk) AS number, c.dialog_id, chunk, first_id, c.messages, c.peer_ok FROM chun c JOIN old ON old.dialog_id = c.dialog_id ORDER BY number LIMIT 40",
    "chunk_estimate": "SELECT *, round(chunks * 30.0::DOUBLE + dialogs * 135.0::DOUBLE + messages * 0.475::DOUBLE + chunks / 75.0::DOUBLE * 450.0::DOUBLE, 6) AS seconds FROM (SELECT count(DISTINCT dialog_id) AS dialogs, count(*) AS chunks, CAST(sum(messages) AS BIGINT) AS messages FROM chun)",
    "scan_axis_only": """
      SELECT axis, tier, count(*) AS hits, count(DISTINCT dialog_id || ':' || msg_id) AS messages FROM (
        SELECT axis, tier, dialog_id, msg_id FROM kw WHERE axis = 'ops' UNION ALL
        SELECT 'ties', m.tier, m.dialog_id, m.msg_id FROM aged m WHERE NOT EXISTS (SELECT 1 FROM kw h WHERE h.axis = 'ops' AND h.dialog_id = m.dialog_id AND h.msg_id = m.msg_id) AND (
          EXISTS (SELECT 1 FROM kw h WHERE h.axis = 'ops' AND h.dialog_id = m.dialog_id AND h.msg_id = m.reply_to)
          OR EXISTS (SELECT 1 FROM kw h JOIN msgs x ON x.dialog_id = h.dialog_id AND x.msg_id = h.msg_id WHERE h.axis = 'ops' AND x.dialog_id = m.dialog_id AND (x.reply_to = m.msg_id OR x.grouped_id = m.grouped_id)))) GROUP BY axis, tier""",
}


def oracle_sql() -> dict[str, str]:
    return {name: statement(body) for name, body in STATEMENTS.items()} | cases.oracle_sql()
