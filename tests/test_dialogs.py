"""Ingest, scan, windows, plan, chunks, triage and store on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from skeinwork import schemas
from skeinwork.functions.matcher import Dictionary, Rule
from skeinwork.operators import chunks, evaluate, plan, scan, windows
from skeinwork.operators.positions import bounded, members, with_positions
from skeinwork.params import DAY, Params
from skeinwork.plans.policy import ENGLISH, build_prompt
from skeinwork.plans.provider import Reply, read_reply
from skeinwork.plans.triage import Archive, triage
from skeinwork.sources import export
from skeinwork.sources.store import Store
from skeinwork.streaming.scan import counts_by_time, hits_of, store_hits

NOW = 1_700_000_000
P = Params(now=NOW, pad=5, gap=10)


def messages(spark, rows, **every):
    base = {"from_id": 1, "outgoing": False, "reply_to": None, "grouped_id": None, "fwd_from": None, "media_type": None, "file_path": None, "text": "", "protected": False, "date": NOW, "dialog_id": 1}
    names = [f.split()[0] for f in schemas.MESSAGES.split(", ")]
    return spark.createDataFrame([tuple((base | every | r)[n] for n in names) for r in rows], schemas.MESSAGES)


def hits(spark, rows):
    base = {"dialog_id": 1, "axis": "a", "rule_id": "r", "term": "r", "surface": None, "layer": "regex", "tier": "T0", "priority": 1.0, "protected": False}
    names = [f.split()[0] for f in schemas.HITS.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schemas.HITS)


def dialogs(spark, ids=(1,), kind="user"):
    return spark.createDataFrame([(i, kind, 5, f"d{i}", None, False, 100) for i in ids], schemas.DIALOGS)


def spans(w):
    return sorted((r["from_id"], r["to_id"]) for r in w.collect())


def built(spark, n, anchors, p=P, **hit):
    return windows.build(messages(spark, [{"msg_id": i} for i in range(n)]), hits(spark, [{"msg_id": a} | hit for a in anchors]), dialogs(spark), p)


def test_near_anchors_make_one_window(spark):
    w = built(spark, 100, [20, 25, 28]).collect()
    assert [(r["from_id"], r["to_id"], r["anchors"], r["total"]) for r in w] == [(15, 33, [20, 25, 28], 19)]


def test_far_anchors_make_two(spark):
    assert spans(built(spark, 100, [20, 60])) == [(15, 25), (55, 65)]


def test_windows_end_with_the_dialog(spark):
    assert spans(built(spark, 10, [1], Params(now=NOW, pad=30))) == [(0, 9)]


def test_protected_weak_and_ignored_do_not_anchor(spark):
    assert spans(built(spark, 10, [1], priority=0.6)) == []
    m = messages(spark, [{"msg_id": i, "protected": True} for i in range(5)])
    strong = hits(spark, [{"msg_id": 2, "priority": 9.0, "axis": "crypto_hard"}])
    assert spans(windows.build(m, strong, dialogs(spark), P)) == []
    assert spans(windows.build(m, strong, dialogs(spark), Params(now=NOW, honour_hard_axes=True))) == [(0, 4)]
    assert spans(windows.build(m, strong, dialogs(spark, kind="chat"), P)) == []


def test_the_threshold_is_inclusive_over_a_sum(spark):
    m = messages(spark, [{"msg_id": 1}])
    h = hits(spark, [{"msg_id": 1, "rule_id": f"r{k}", "priority": 0.1} for k in range(10)])
    assert spans(windows.build(m, h, dialogs(spark), P)) == [(1, 1)]


def test_positions_over_gaps_and_blocks(spark):
    ids = [5, 70_000, 70_001, 200_000, 9]
    got = {r["msg_id"]: r["pos"] for r in with_positions(messages(spark, [{"msg_id": i} for i in ids])).collect()}
    assert got == {5: 0, 9: 1, 70_000: 2, 70_001: 3, 200_000: 4}


def test_members_of_ranges_whose_ends_are_no_messages(spark):
    placed = with_positions(messages(spark, [{"msg_id": i} for i in (2, 4, 6, 8)]))
    r = spark.createDataFrame([(1, 0, 3), (1, 4, 7), (1, 5, 5), (1, 9, 20)], "dialog_id long, lo int, hi int")
    got = sorted((x["lo"], x["msg_id"]) for x in members(r, placed).collect())
    assert got == [(0, 2), (4, 4), (4, 6)]
    assert bounded(r, placed).count() == 2


def test_range_ends_between_blocks_of_ids(spark):
    # Ids in several blocks, one of them empty, and ends in blocks with and without messages before them.
    ids = {1: [10, 65_535, 65_536, 140_000, 330_000], 2: [200_000]}
    placed = with_positions(messages(spark, [{"dialog_id": d, "msg_id": i} for d, own in ids.items() for i in own]))
    spots = [(d, lo, hi) for d in ids for lo in (0, 11, 65_530, 65_537, 196_700, 329_999, 400_000) for hi in (5, 65_534, 65_536, 139_999, 262_150, 330_001)]
    got = sorted((x["dialog_id"], x["lo"], x["hi"], x["msg_id"]) for x in members(spark.createDataFrame(spots, "dialog_id long, lo int, hi int"), placed).collect())
    assert got == sorted((d, lo, hi, i) for d, lo, hi in spots for i in ids[d] if lo <= i <= hi)


def sample_of(spark):
    rows = [(1, 1, ["a"]), (1, 50, ["a"]), (2, 1, ["a"]), (3, 1, ["b"])]
    return spark.createDataFrame([(d, f, f + 9, [f], x, "T0", [], 10, 100, 50 * (k + 1), ["old"] if k else ["new"]) for k, (d, f, x) in enumerate(rows)],
        "dialog_id long, from_id int, to_id int, anchors array<int>, axes array<string>, tier string, voices array<int>, total long, chars long, newest long, rules array<string>")


def test_samples_take_turns_and_go_before_limits(spark):
    got = windows.select(sample_of(spark), limit=1, sample=3).collect()
    axes = [r["axes"][0] for r in got]
    assert sorted(axes) == ["a", "a", "b"]


def test_cutoff_keeps_new_material_and_new_rules(spark):
    got = windows.select(sample_of(spark), cutoff=windows.Cutoff(150, ("new",))).collect()
    assert len(got) == 3
    with pytest.raises(ValueError, match="date"):
        windows.Cutoff.of(None, ("x",))


def test_expansion_shares_the_room(spark):
    m = messages(spark, [{"msg_id": i} for i in range(200)])
    w = built(spark, 200, [100]).withColumns({"before": F.lit(300), "after": F.lit(100)})
    got = windows.expand(w, m, Params(now=NOW, max_window=51)).first()
    assert (got["from_id"], got["to_id"], got["total"]) == (65, 115, 51)


def test_structural_ties_prefer_the_later(spark):
    rows = [
        {"msg_id": 1},
        {"msg_id": 2, "reply_to": 1, "grouped_id": 7},
        {"msg_id": 3, "reply_to": 2},
        {"msg_id": 4, "grouped_id": 7},
        {"msg_id": 5, "grouped_id": 7, "reply_to": 2},
        {"msg_id": 6, "reply_to": 99},
        {"msg_id": 7, "dialog_id": 2, "reply_to": 2},
    ]
    m = messages(spark, rows)
    got = {r["msg_id"]: (r["rule_id"], r["priority"]) for r in scan.structural_pass(m, hits(spark, [{"msg_id": 2}]), P).collect()}
    assert got == {1: ("replied_by_hit", 0.5), 3: ("reply_to_hit", 0.5), 4: ("same_album", 0.5), 5: ("same_album", 0.5)}


def test_keyword_pass_scores_protects_and_filters(spark):
    d = Dictionary((Rule("a", "stem", 2.0, "term", "мост"), Rule("crypto_hard", "hex", 3.0, "regex", r"\b0x[a-f]{4}\b")), keep=("отпуск",))
    rows = [{"msg_id": 1, "text": "мост и 0xabcd в отпуск", "date": NOW - 200 * DAY}, {"msg_id": 2, "text": ""}, {"msg_id": 3, "text": "отпуск"}]
    got = scan.keyword_pass(messages(spark, rows), d, P)
    assert sorted((r["rule_id"], round(r["priority"], 6), r["protected"], r["tier"]) for r in got.hits.collect()) == [("hex", 2.55, False, "T1"), ("stem", 1.7, True, "T1")]
    assert [r["protected"] for r in got.messages.orderBy("msg_id").collect()] == [True, False, True]
    assert [r["rule_id"] for r in scan.keyword_pass(messages(spark, rows), d, P, "a").hits.collect()] == ["stem"]


def runs(spark, rows):
    return spark.createDataFrame([(1, f, t, m, "p", raw, 1, 1, 0.5, 1, 0) for f, t, m, raw in rows], schemas.TRIAGE_RUNS)


def cut(*ranges):
    return json.dumps({"delete_ranges": [{"from": a, "to": b, "axis": "a", "confidence": 1, "reason": r} for a, b, r in ranges]})


def test_plan_swaps_clips_keeps_first_and_spares_protected(spark):
    placed = with_positions(messages(spark, [{"msg_id": i, "protected": i == 13} for i in range(10, 20)]))
    r = runs(spark, [(10, 15, "m", cut((14, 12, "first"), (0, 10, "edge"), (14, 99, "second"))), (12, 19, "m", cut((500, 600, "beyond"), (14, 14, "late"))), (10, 19, "m", "broken")])
    got = {x["msg_id"]: x["reason"] for x in plan.build_plan(r, placed, "m").collect()}
    assert got == {10: "edge", 12: "first", 14: "first", 15: "second", 19: "beyond"}
    with pytest.raises(ValueError, match="no runs"):
        plan.build_plan(r, placed, "other")


def test_approval_is_explicit(spark):
    p = spark.createDataFrame([(1, 1, "", "a", 1.0, False), (2, 1, "", "b", 1.0, False)], schemas.PLAN)
    assert [x["approved"] for x in plan.approve(p, dialog=2).orderBy("dialog_id").collect()] == [False, True]
    with pytest.raises(ValueError, match="all"):
        plan.approve(p)


def test_agreement_counts_empty_pairs_as_one(spark):
    placed = with_positions(messages(spark, [{"msg_id": i} for i in range(10)]))
    r = runs(spark, [(0, 4, "m", cut()), (0, 4, "n", cut()), (5, 9, "m", cut((5, 6, ""))), (5, 9, "n", cut((6, 7, "")))])
    got = evaluate.pairs(r, placed)
    assert sorted(round(x["jaccard"], 6) for x in got.collect()) == [0.333333, 1.0]
    assert [x["window_from"] for x in evaluate.split_windows(got).collect()] == [5]


def test_chunks_break_at_gaps_and_at_the_limit(spark):
    placed = with_positions(messages(spark, [{"msg_id": 3 * i} for i in range(210)]))
    p = spark.createDataFrame([(1, 3 * i, "", "a", 1.0, True) for i in range(206) if i != 205] + [(1, 3 * 207, "", "a", 1.0, True), (1, 1, "", "a", 1.0, True)], schemas.PLAN)
    log = spark.createDataFrame([], schemas.DELETIONS)
    got = chunks.chunked(chunks.deletable(p, dialogs(spark), placed, log), Params(now=NOW)).orderBy("chunk").collect()
    assert [r["messages"] for r in got] == [100, 100, 5, 1]


def test_a_stretch_over_blocks_of_positions_is_cut_from_its_start(spark):
    rows = spark.range(131_100).filter("id <> 7").selectExpr("1L AS dialog_id", "id AS pos", "CAST(id AS INT) AS msg_id")
    got = chunks.chunked(rows, Params(now=NOW)).orderBy("chunk").collect()
    size = Params(now=NOW).max_range
    firsts = [0, *range(8, 131_100, size)]
    assert [(r["chunk"], r["first_id"]) for r in got] == list(enumerate(firsts, 1))
    assert sum(r["messages"] for r in got) == 131_099


def test_only_open_and_failed_messages_are_deletable(spark):
    placed = with_positions(messages(spark, [{"msg_id": i} for i in range(5)]))
    p = spark.createDataFrame([(1, i, "", "a", 1.0, i != 4) for i in range(5)], schemas.PLAN)
    log = spark.createDataFrame([(1, 1, "b", "error", 0, None), (1, 2, "b", "pending", 0, None), (1, 3, "b", "done", 0, None)], schemas.DELETIONS)
    assert sorted(r["msg_id"] for r in chunks.deletable(p, dialogs(spark), placed, log).collect()) == [0, 1]


EXPORT = {
    "chats": {
        "list": [
            {"id": 777, "type": "personal_chat", "name": "Ann", "messages": [
                {"id": 1, "type": "message", "date_unixtime": "1577836800", "from_id": "user777", "text": "hello"},
                {"id": 2, "type": "message", "date": "2020-01-01T00:00:05", "from_id": "user42", "text": ["look", {"type": "link", "text": " here", "href": "https://x"}, " done", 5], "forwarded_from": "Bob"},
                {"id": 3, "type": "service"},
                {"id": 4, "type": "message", "date_unixtime": "7", "from_id": "user42", "text": "[1] looks like json", "photo": "a.jpg", "forwarded_from": False},
                {"id": 5, "type": "message", "date_unixtime": "8", "from_id": "junk", "text": {"a": 1}, "file": "f", "mime_type": "audio/x", "reply_to_message_id": 4},
            ]},
            {"id": 9, "type": "private_group", "messages": []},
            {"type": "personal_chat", "messages": []},
        ]
    }
}


def test_ingest(spark, tmp_path):
    path = tmp_path / "result.json"
    path.write_text(json.dumps(EXPORT, indent=1))
    got = export.ingest(export.read_files(spark, str(path)))
    m = {r["msg_id"]: r for r in got.messages.collect()}
    assert {k: r["text"] for k, r in m.items()} == {1: "hello", 2: "look here https://x done", 4: "[1] looks like json", 5: ""}
    assert [m[k]["date"] for k in (1, 2)] == [1_577_836_800, 1_577_836_805]
    assert [m[k]["outgoing"] for k in (1, 2, 4, 5)] == [False, True, True, False]
    assert [m[k]["media_type"] for k in (1, 4, 5)] == [None, "photo", "audio/x"]
    assert [m[k]["fwd_from"] for k in (1, 2, 4)] == [None, "Bob", None]
    assert {r["id"]: (r["kind"], r["title"], r["msg_count"]) for r in got.dialogs.collect()} == {777: ("user", "Ann", 4), 9: ("chat", "id9", 0)}
    stats = got.stats.first()
    assert (stats["dialogs"], stats["messages"], stats["skipped_service"], stats["my_id"]) == (2, 4, 1, 42)


def test_ingest_single_chat_saved_messages_and_errors(spark):
    one = lambda x: export.read_texts(spark.createDataFrame([(json.dumps(x),)], "json string"))
    saved = {"id": 555, "type": "saved_messages", "messages": [{"id": 1, "date_unixtime": "5", "text": "x"}]}
    assert export.ingest(one(saved)).stats.first()["my_id"] == 555
    with pytest.raises(Exception, match="neither"):
        export.ingest(one({"about": 1}), owner=1).dialogs.collect()
    with pytest.raises(Exception, match="no date"):
        export.ingest(one({"id": 1, "messages": [{"id": 3, "text": "x"}]}), owner=1).messages.collect()


def test_store_replaces_upserts_and_checks_its_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.table("messages").count() == 0
    s.replace("messages", messages(spark, [{"msg_id": 1, "text": "old", "protected": True}, {"msg_id": 2}]))
    s.replace("messages", messages(spark, [{"msg_id": 1, "text": "new"}]))
    assert {r["msg_id"]: (r["text"], r["protected"]) for r in s.table("messages").collect()} == {1: ("new", False), 2: ("", False)}
    s.upsert_dialogs(dialogs(spark, (1, 2)))
    s.upsert_dialogs(spark.createDataFrame([(1, "chat", None, "again", "nick", False, 3)], schemas.DIALOGS))
    got = {r["id"]: (r["kind"], r["access_hash"], r["title"], r["username"], r["msg_count"]) for r in s.table("dialogs").collect()}
    assert got == {1: ("chat", 5, "again", "nick", 100), 2: ("user", 5, "d2", None, 100)}
    s.log_intent(messages(spark, [{"msg_id": 1}]), "b", "pending", 1)
    s.log_intent(messages(spark, [{"msg_id": 1}]), "b", "error", 2, "lost")
    assert [r["state"] for r in s.table("deletions").collect()] == ["error"]
    s.clear("messages")
    assert Store(spark, str(tmp_path / "store")).table("messages").count() == 0


def asked():
    """A provider that asks for context on the first sight of a window, refuses dialog 2, and answers badly on dialog 3."""
    from skeinwork.plans.provider import Refused, Reply

    class Asked:  # in a function, so that workers get it by value
        model = "test"

        def complete(self, system, user, schema):
            if "Chat: d2" in user:
                raise Refused("no")
            if "Chat: d3" in user:
                return Reply("broken", 1, 1, 1.0)
            need = None if user.count("] 20") > 11 else {"before": 2, "after": 2}
            return Reply(json.dumps({"delete_ranges": [{"from": 1, "to": 2}], "need_context": need}), 10, 5, 2.0)

    return Asked()


def test_triage_widens_once_keeps_keys_and_resumes(spark):
    m = messages(spark, [{"dialog_id": d, "msg_id": i, "text": "t"} for d in (1, 2, 3) for i in range(40)])
    h = hits(spark, [{"dialog_id": d, "msg_id": 20} for d in (1, 2, 3)])
    ds = dialogs(spark, (1, 2, 3))
    w = windows.build(m, h, ds, P)
    archive = Archive(ds, with_positions(m), h, spark.createDataFrame([], schemas.TRANSCRIPTS))
    none = spark.createDataFrame([], schemas.TRIAGE_RUNS)
    prompt = build_prompt("en")
    got = triage(w, archive, none, asked(), prompt, ENGLISH, ("a",), P, at=9, jobs=2).collect()
    assert [(r["dialog_id"], r["window_from"], r["window_to"], r["passes"], r["cost"], r["total_cost"]) for r in got] == [(1, 15, 25, 2, 2.0, 4.0)]
    done = spark.createDataFrame([tuple(r)[:11] for r in got], schemas.TRIAGE_RUNS)
    assert plan.not_judged(w, done, "test", prompt.id).count() == 2


def test_replies_are_read_strictly():
    assert read_reply('{"choices": [{"message": {"content": "{}"}}], "usage": {"cost": 0.5, "prompt_tokens": 3}}') == Reply("{}", 3, 0, 0.5)
    for bad in ('{"choices": []}', '{"choices": [{"message": {"content": "  "}}]}', '{"error": {"message": "x"}}', "oops"):
        with pytest.raises(ValueError):
            read_reply(bad)


def test_streams(spark, tmp_path):
    d = Dictionary((Rule("a", "x", 1.0, "regex", "boom"),))
    messages(spark, [{"msg_id": i, "text": "boom" if i % 2 else "calm", "date": NOW + i} for i in range(6)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.MESSAGES).parquet(str(tmp_path / "in"))
    assert hits_of(stream, d, P).isStreaming
    s = Store(spark, str(tmp_path / "store"))
    q = store_hits(stream, d, P, s, str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert s.table("hits").count() == 3
    q = counts_by_time(stream, d).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(hits) FROM counts").first()[0] == 3
