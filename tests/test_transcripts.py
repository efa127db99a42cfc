"""Transcripts through landing, assembly, rounds and the read API, against counts known from how they were built."""

from __future__ import annotations

import hashlib
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tests.builder import SESSION, Transcript, agent_id
from threadloom import config
from threadloom.__main__ import main as command
from threadloom.plans import rounds
from threadloom.plans.assembly import assemble
from threadloom.plans.view import Conversations
from threadloom.plans.vocabulary import rendered
from threadloom.sources import transcripts
from threadloom.storage import exclusive, shared_dir, write_table


def built(spark, tmp_path, *steps, **options):
    """The assembly of a transcript that the steps build."""
    t = Transcript(tmp_path / "src")
    for step in steps:
        step(t)
    return assemble(write_table(transcripts.land(spark, t.flush())[0], "landed"), **options)


def kinds(made) -> dict[str, int]:
    return {r["kind"]: r["count"] for r in made.nodes.groupBy("kind").count().collect()}


def edges(made) -> list[tuple]:
    return sorted((r["type"], r["from"], r["to"], r["quality"]) for r in made.relations.collect())


def opens(made) -> set[tuple]:
    return {(r.kind, r.ref) for r in made.unresolved.collect()}


def test_turns_with_a_child(spark, tmp_path):
    made = built(spark, tmp_path, lambda t: t.turn("one"), lambda t: t.turn("two"), lambda t: t.turn("three", agent=True), lambda t: t.compaction())
    found = kinds(made)
    child = agent_id(3)
    assert (found["session"], found["stream"], found["epoch"], found["talk"], found["run"]) == (1, 2, 3, 5, 6)
    assert (found["tool"], found["agent.call"], found["agent.launch_ack"], found["runtime.notification"], found["agent.output"]) == (3, 1, 1, 1, 1)
    assert (found["epoch.boundary"], found["epoch.summary"], found["message.external"]) == (1, 1, 3)
    got = edges(made)
    assert ("starts", "tool/t3-agent", f"stream/{child}", "exact_unique") in got
    assert ("follows", "epoch/main/t4-cut", "epoch/main/0", "exact_unique") in got
    assert [e[0] for e in got].count("summarizes") == 1 and [e[0] for e in got].count("reports") == 1
    assert opens(made) == set()
    # days apart, so each talk is its own segment, and only the last is open
    states = [json.loads(r.attrs)["state"] for r in made.nodes.where("kind = 'segment'").orderBy("ref.seq", "ref.row").collect()]
    assert states == ["candidate"] * 3 + ["open"]
    call = made.nodes.where("id = 'call/t1-call'").first()
    assert len(call.refs) == 2 and json.loads(call.attrs)["usage_at"] == {"seq": 1, "row": 3}
    tool = made.nodes.where("id = 'tool/t1-tool'").first()
    assert [(r.seq, r.row, r.block) for r in tool.refs] == [(1, 3, 0), (1, 4, 0)] and tool.parent == "call/t1-call"


def test_notification_stays_in_its_talk(spark, tmp_path):
    made = built(spark, tmp_path, lambda t: t.turn("one", agent=True))
    talks = {r.id: json.loads(r.attrs) for r in made.nodes.where("kind = 'talk'").collect()}
    assert talks["talk/main/t1-run"]["runs"] == 2 and talks[f"talk/{agent_id(1)}"]["trigger"] == "unknown"
    assert made.nodes.where("id = 'msg/1/8:0'").first().parent == "call/t1-final"
    assert made.nodes.where("id = 'call/t1-final'").first().parent == "run/talk_main_t1-run/t1-run2"


def test_missing_and_repeated_results(spark, tmp_path):
    def orphan(t):
        t.says("o", "ocall", [{"type": "tool_use", "id": "lost", "name": "Shell", "input": {}}], None, 50)

    def twice(t):
        t.result("r1", "t1-tool", "t1-run", 51)

    def unasked(t):
        t.result("r2", "never", "t1-run", 52)

    made = built(spark, tmp_path, lambda t: t.turn("one"), orphan, twice, unasked)
    assert opens(made) == {("tool_result", "lost"), ("tool_result", "t1-tool"), ("tool_use", "never")}
    joins = {r.id: json.loads(r.attrs)["result_join"] for r in made.nodes.where("kind = 'tool'").collect()}
    assert joins == {"tool/lost": "unresolved", "tool/t1-tool": "exact_ambiguous"}


def test_replay_changes_nothing(spark, tmp_path):
    plain = kinds(built(spark, tmp_path / "a", lambda t: t.turn("one"), lambda t: t.turn("two")))

    def replay(t):
        for line in list(t.main[:6]):
            t.raw(json.dumps({**json.loads(line), "promptId": "other"}))

    again = built(spark, tmp_path / "b", lambda t: t.turn("one"), lambda t: t.turn("two"), replay)
    assert kinds(again) == plain and again.stats.first().duplicates == 6


def test_workflow_children(spark, tmp_path):
    made = built(spark, tmp_path, lambda t: t.turn("one"), lambda t: t.workflow(3))
    started = [e for e in edges(made) if e[0] == "starts"]
    assert len(started) == 3 and {e[1] for e in started} == {"tool/t2-wftool"} and {e[3] for e in started} == {"strong_inference"}
    assert opens(made) == set()


def test_inputs_and_control_records(spark, tmp_path):
    def more(t):
        for i, (kind, mode) in enumerate([("queued_command", "prompt"), ("queued_command", "task"), ("odd_kind", None)]):
            t.add(f"q{i}", type="attachment", timestamp=t.at(50 + i), attachment={"type": kind, "commandMode": mode, "content": "now"})
        for sub in ("turn_duration", "local_command", "unheard_of", "api_error"):
            t.add(f"s-{sub}", type="system", subtype=sub, timestamp=t.at(55), durationMs=7)
        t.says("syn", "syncall", [{"type": "text", "text": "lost"}], None, 58, model="<synthetic>")

    found = kinds(built(spark, tmp_path, lambda t: t.turn("one"), more))
    assert (found["message.external"], found["context.injection"]) == (2, 2)
    assert (found["turn.duration"], found["control.command"], found["control.notice"], found["error.api"]) == (1, 1, 1, 1)
    assert found["message.synthetic"] == 1


def test_odd_records_are_kept(spark, tmp_path):
    t = Transcript(tmp_path / "src")
    t.turn("one")
    for line in ("not json", "", "null", json.dumps({"type": "user", "uuid": "x", "message": "text"}), json.dumps({"type": "user", "uuid": "y", "message": {"content": '{"a": 1}'}})):
        t.raw(line)
    blocks = [{"type": "novel", "x": 1}, "bare", {"type": "tool_result", "tool_use_id": "z", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "is_error": True}, {"type": "thinking", "thinking": "", "signature": "SIG"}, {"type": "image", "source": {"media_type": "image/png", "data": "QQ=="}}]
    t.raw(json.dumps({"type": "user", "uuid": "w", "message": {"content": blocks}, "toolUseResult": "plain"}))
    rows = transcripts.land(spark, t.flush())[0].where("row > 5").orderBy("row").collect()
    assert [[p.k for p in r.parts] for r in rows] == [["unknown"], ["unknown"], ["data"], ["unknown"], ["text"], ["unknown", "unknown", "result", "reasoning", "media"]]
    odd = rows[-1]
    assert odd.parts[2].text == "a\nb" and odd.parts[2].failed is True and odd.parts[2].data is None
    assert odd.parts[3].state == "unavailable" and odd.dropped[0].bytes == 3 and odd.parts[4].media == "image/png"
    assert rows[-2].parts[0].text == '{"a": 1}'


def test_discovery(spark, tmp_path):
    t = Transcript(tmp_path / "src")
    t.turn("one", agent=True)
    t.flush()
    other = tmp_path / "src" / "-elsewhere"
    (other / SESSION / "workflows" / "scripts").mkdir(parents=True)
    (other / SESSION / "workflows" / "scripts" / "a-wf_b-wf_c1.js").write_text("x")
    (other / f"{SESSION}.jsonl").write_text("{}\n")
    (other / "no-session.jsonl").write_text("{}\n")
    found = transcripts.discover(spark, str(tmp_path / "src"))
    row = transcripts.sessions(found).first()
    assert (row.dirs, row.n_main, row.n_agent, row.n_script) == (["-elsewhere", "-work"], 2, 1, 1)
    assert found.where("source_kind = 'script'").first().batch == "wf_c1"
    assert transcripts.collisions(found).select("target", "refused").collect() == [("main", 1)]


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """A chain of three rounds: a turn; one with a child and a compaction; a replay that adds nothing."""
    tmp_path = tmp_path_factory.mktemp("grown")
    t, root = Transcript(tmp_path / "src"), str(tmp_path / "root")
    t.turn("one")
    t.says("o", "ocall", [{"type": "tool_use", "id": "late", "name": "Shell", "input": {}}], None, 50)
    rounds.collect(spark, t.flush(), root)
    rounds.publish(spark, root)
    t.result("o-res", "late", "t1-run", 55)
    t.turn("two", agent=True)
    t.compaction()
    rounds.collect(spark, t.flush(), root)
    rounds.publish(spark, root)
    t.raw(t.main[0])
    rounds.collect(spark, t.flush(), root)
    rounds.publish(spark, root)
    return t, root


def test_rounds(spark, grown):
    t, root = grown
    done = rounds.rounds_of(spark, root).orderBy("round").collect()
    assert [r.round for r in done] == [1, 2, 3] and [r.from_seq for r in done] == [1, 2, 4] and done[2].n_nodes + done[2].n_relations + done[2].n_unresolved == 0
    # nothing new: no record, no round
    assert rounds.collect(spark, t.flush(), root) == 0 and rounds.publish(spark, root).count() == 0
    # the fold of all rounds is the assembly of everything
    made = assemble(rounds.landed_of(spark, root))
    for kind in ("nodes", "relations"):
        now, folded = getattr(made, kind), rounds.fold(spark, root, kind).drop("round")
        assert now.exceptAll(folded.select(now.columns)).count() == 0 and folded.select(now.columns).exceptAll(now).count() == 0
    # the late result closes the open reference, and an earlier state can still be read
    assert [(r.kind, r.state) for r in rounds.fold(spark, root, "unresolved").collect()] == [("tool_result", "resolved")]
    assert [r.state for r in rounds.fold(spark, root, "unresolved", 1).collect()] == ["open"]
    assert rounds.audit_chain(spark, root).count() == 0 and rounds.audit_rounds(spark, root).count() == 0
    with pytest.raises(ValueError, match="policy|under"):
        rounds.publish(spark, root, idle_gap_s=60)


def forged(spark, root, to, kind, change):
    """A copy of a root in which one table's rows are changed."""
    shutil.copytree(root, to)
    table = spark.read.parquet(f"{root}/{kind}")
    parts = ["attempt"] if kind == "landed" else []
    shutil.rmtree(f"{to}/{kind}")
    change(table).write.partitionBy(*parts).parquet(f"{to}/{kind}")
    return str(to)


def test_forged_rows_are_found(spark, grown, tmp_path):
    _, root = grown
    body = forged(spark, root, tmp_path / "a", "nodes", lambda df: df.withColumn("attrs", F.when(F.col("kind") == "tool", F.lit("{}")).otherwise(F.col("attrs"))))
    assert {(r["round"], r.problem) for r in rounds.audit_chain(spark, body).collect()} == {(1, "digest"), (2, "digest")}
    record = forged(spark, root, tmp_path / "b", "landed", lambda df: df.withColumn("label", F.when((F.col("seq") == 2) & (F.col("row") == 1), F.lit("other")).otherwise(F.col("label"))))
    assert {(r["round"], r.problem) for r in rounds.audit_chain(spark, record).collect()} == {(2, "input_digest")}
    lost = forged(spark, root, tmp_path / "c", "landed", lambda df: df.where("not (source_kind = 'main' and ord = 3)"))
    found = rounds.audit_landed(spark, lost).where("source_kind = 'main'").first()
    assert (found.gaps, found.byte_gaps, found.relanded) == (1, 1, 0)
    assert rounds.audit_sessions(spark, lost).first().problems == 1
    cut = forged(spark, root, tmp_path / "d", "rounds", lambda df: df.where("round <> 2"))
    assert {r.problem for r in rounds.audit_chain(spark, cut).collect()} >= {"number", "from_seq", "previous"}


def test_landed_is_whole(spark, grown):
    t, root = grown
    found = rounds.audit_landed(spark, root).orderBy("src").collect()
    assert [(r.gaps, r.relanded, r.byte_gaps) for r in found] == [(0, 0, 0)] * 2
    assert sum(r.bytes + r.records for r in found) == sum(f.stat().st_size for f in t.root.rglob("*.jsonl"))
    row = rounds.audit_sessions(spark, root).first()
    assert (row.session, row.n_main, row.n_agent, row.problems, row.conflicts) == (SESSION, 1, 1, 0, 0)
    files = rounds.landed_files(spark, root).collect()
    assert [r.seq for r in files] == [1, 2, 3, 4] and files[0].first_ord == 1


def test_conflicts_stay(spark, tmp_path):
    t, root = Transcript(tmp_path / "src"), str(tmp_path / "root")
    t.turn("one")
    assert rounds.collect_pass(spark, t.flush(), root).complete
    whole, t.main = t.main, t.main[:3]
    t.flush()
    seen = rounds.collect_pass(spark, str(t.root), root)
    assert (seen.records, seen.conflicts, seen.complete) == (0, 1, False)
    t.main = [*whole, whole[0]]
    assert rounds.collect(spark, t.flush(), root) == 0 and rounds.cursors_of(spark, root).first().state == "conflict: truncated"
    other = Transcript(tmp_path / "src2")
    other.turn("one")
    root = str(tmp_path / "root2")
    rounds.collect(spark, other.flush(), root)
    other.main[1] = other.main[1].replace("working", "WORKING")
    other.main.append(other.main[0])
    assert rounds.collect_pass(spark, other.flush(), root).conflicts == 1
    assert rounds.cursors_of(spark, root).first().state == "conflict: rewritten"


def test_windows_leave_the_rest_pending(spark, tmp_path):
    t, root = Transcript(tmp_path / "src"), str(tmp_path / "root")
    for i in range(12):
        t.turn(f"turn {i}")
    t.raw("x" * 5000)  # a line longer than a window
    path = t.root / t.folder / f"{t.session}.jsonl"
    t.flush()
    with path.open("ab") as f:
        f.write(b'{"type": "user"\xff}\n{"type": "us')  # no valid text, and a line that is still being written
    passes = []
    while True:
        seen = rounds.collect_pass(spark, str(t.root), root, window=1500, windows=4)
        passes.append(seen.records)
        if not seen.pending:
            break
    assert len(passes) > 3 and sum(passes) == len(t.main) + 1
    with path.open("ab") as f:
        f.write(b'er"}\n')
    assert rounds.collect(spark, str(t.root), root) == 1
    landed = rounds.landed_of(spark, root).orderBy("ord").collect()
    assert [r.ord for r in landed] == list(range(1, len(t.main) + 3)) and sum(r.bytes + 1 for r in landed) == path.stat().st_size
    raw = path.read_bytes()
    assert all(hashlib.sha256(raw[r.off : r.off + r.bytes]).hexdigest()[:12] == r.sha for r in landed)
    whole = transcripts.land(spark, str(t.root))[0].orderBy("ord").collect()
    assert [(r.ord, r.off, r.sha, r.parts) for r in whole] == [(r.ord, r.off, r.sha, r.parts) for r in landed]


def test_snapshots_gone_and_filters(spark, tmp_path):
    root = str(tmp_path / "root")
    a, b = Transcript(tmp_path / "src"), Transcript(tmp_path / "src", SESSION.replace("0003", "0004"), "-other")
    for t in (a, b):
        t.turn("one")
        t.flush()
    meta = tmp_path / "src" / "-work" / SESSION / "subagents" / f"agent-{agent_id(1)}.meta.json"
    meta.parent.mkdir(parents=True)
    meta.write_text('{"description": "first"}')
    seen = rounds.collect_pass(spark, str(tmp_path / "src"), root, exclude=["-other"])
    assert (seen.sessions, seen.sources_landed) == (1, 2)
    assert rounds.collect_pass(spark, str(tmp_path / "src"), root, include=["/work"]).records == 0
    meta.write_text('{"description": "second"}')
    assert rounds.collect_pass(spark, str(tmp_path / "src"), root, include=["/work"]).records == 1
    assert [r.label for r in rounds.landed_of(spark, root).where("source_kind = 'meta'").orderBy("seq").collect()] == ["first", "second"]
    meta.unlink()
    seen = rounds.collect_pass(spark, str(tmp_path / "src"), root)
    assert seen.sources_gone == 1 and seen.sessions == 1 and seen.records == len(b.main)
    assert transcripts.gone(transcripts.discover(spark, str(tmp_path / "src")), rounds.landed_of(spark, root)).count() == 1


def test_a_root_has_one_writer(spark, tmp_path):
    t, root = Transcript(tmp_path / "src"), str(tmp_path / "root")
    t.turn("one")
    with exclusive(spark, root) as mine:
        assert mine and rounds.collect_pass(spark, t.flush(), root).busy == 1
        with pytest.raises(RuntimeError, match="holds"):
            rounds.publish(spark, root)
    assert rounds.collect(spark, t.flush(), root) > 0
    (tmp_path / "root" / ".lock").touch()
    os.utime(tmp_path / "root" / ".lock", (1, 1))  # left by a pass that was lost
    assert rounds.publish(spark, root).count() == 1


def test_only_changed_sessions_are_read(spark, tmp_path, monkeypatch):
    root, read = str(tmp_path / "root"), []
    a, b = Transcript(tmp_path / "src"), Transcript(tmp_path / "src", SESSION.replace("0003", "0004"))
    for t in (a, b):
        t.turn("one")
        t.flush()
    rounds.collect(spark, str(tmp_path / "src"), root)
    assert rounds.publish(spark, root).count() == 2
    plain = rounds.assemble
    monkeypatch.setattr(rounds, "assemble", lambda landed, *rest: read.append([r.session for r in landed.select("session").distinct().collect()]) or plain(landed, *rest))
    b.turn("two")
    rounds.collect(spark, b.flush(), root)
    assert [r.session for r in rounds.publish(spark, root).collect()] == [b.session] and read == [[b.session]]
    assert rounds.publish(spark, root).count() == 0 and len(read) == 1
    assert rounds.audit_chain(spark, root).count() == 0


def test_view(spark, grown):
    _, root = grown
    view = Conversations(spark, root)
    row = view.list().first()
    assert (row.session, row.talks, row.streams, row.open) == (SESSION, 4, 2, 0)
    talks = view.talks(SESSION).collect()
    assert [r["name"] for r in talks if r.stream == "main"] == ["one", "two", None] and talks[0].reply == "turn 1 complete" and talks[0].tools == 2
    steps = {r.id: r for r in view.talk(SESSION, "talk/main/t1-run").collect()}
    assert steps["tool/t1-tool"].result == "done" and steps["tool/t1-tool"].took_ms == 1000 and steps["input/1/1"].text == "one"
    assert view.flow(SESSION).count() == row.steps
    assert [r.stream for r in view.streams(SESSION).collect()] == ["main", agent_id(2)]
    assert view.streams(SESSION).collect()[1].openers[0]["from"] == "tool/t2-agent"
    assert view.segments(SESSION).count() == row.segments
    assert view.record(SESSION, 1, 1).first().id == "t1-in"
    assert view.tree(SESSION).where("level = 0").count() == 1
    assert view.counts(SESSION).where("what = 'kind' and name = 'talk'").first().n == 4
    view.register()
    assert spark.sql("SELECT count(*) AS n FROM conv_nodes WHERE kind = 'talk'").first().n == 4
    assert [(r.kind, r.name) for r in view.tool_blocks(SESSION, "t1-tool").collect()] == [("tool_use", "Shell"), ("tool_result", None)]
    assert view.entries_where(SESSION, run="t1-run").count() == 3 and view.entries_where(SESSION, child=agent_id(2)).count() == 2 and [r.stream for r in view.stream_names(SESSION).collect()] == [agent_id(2), "main"]
    report = {(r.what, r["name"]): r.n for r in view.index_report(SESSION).collect()}
    assert report[("blocks", "tool_use")] == report[("blocks", "tool_result")] == 4 and report[("tool", "Shell")] == 3
    assert view.index_sample(SESSION).count() == 4
    assert view.open_references(SESSION).count() == 0 and view.of_kind(SESSION, "epoch").count() == 3
    assert [r.id for r in view.children(SESSION).collect()] == [f"session/{SESSION}"] and view.children(SESSION, "talk/main/t1-run").count() > 0
    assert view.overview(SESSION).where("what = 'kind' and name = 'talk'").first().n == 4
    both = view.of_kind(SESSION, "epoch.summary").select(*[rendered(F.col("kind"), x).alias(x) for x in ("unified", "native", "both")]).first()
    assert tuple(both) == ("epoch.summary", "isCompactSummary", "epoch.summary  (isCompactSummary)")
    unknown = view.nodes.select("kind").distinct().join(view.glossary().select(F.col("unified").alias("kind")), "kind", "left_anti")
    assert unknown.count() == 0


def test_tree_is_sound(spark, grown):
    _, root = grown
    nodes = rounds.fold(spark, root, "nodes")
    lost = nodes.where("parent is not null").join(nodes.select("session", F.col("id").alias("parent")), ["session", "parent"], "left_anti")
    assert lost.count() == 0 and nodes.where("parent is null").count() == 1


def test_empty_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    root = str(tmp_path / "root")
    assert rounds.collect(spark, str(tmp_path / "src"), root) == 0
    assert rounds.publish(spark, root).count() == 0


def test_names_without_words_from_outside(spark, tmp_path):
    """A queued prompt is read out of its envelope; a child without input is named by its first injections, and by its journal."""
    def more(t):
        t.add("q", type="attachment", timestamp=t.at(50), promptId="q-run", attachment={"type": "queued_command", "commandMode": "prompt", "prompt": [{"text": "typed"}, {"text": ""}, {"text": "meanwhile"}]})

    t, root = Transcript(tmp_path / "src"), str(tmp_path / "root")
    t.turn("one")
    more(t)
    t.workflow(3)
    child, where = agent_id(1000 * t.n), f"{t.session}/subagents/workflows/wf_{t.n}"
    for result in ({"verdict": "fine", "refuted_claims": [{"claim": "it fails"}]}, {"surface": "later"}):
        t.raw(json.dumps({"type": "result", "agentId": child, "result": result}), f"{where}/journal.jsonl")
    for i, text in enumerate(["  ", "the roster", "second", "third"]):
        t.add(f"inj{i}", f"{where}/agent-{agent_id(1000 * t.n + 1)}.jsonl", type="attachment", timestamp=t.at(6), promptId="c-run", agentId=agent_id(1000 * t.n + 1), attachment={"type": "skills", "text": text})
    rounds.collect(spark, t.flush(), root)
    rounds.publish(spark, root)
    view = Conversations(spark, root)
    texts = {r.text for r in view._texts().collect()}
    assert "typed\nmeanwhile" in texts
    talks = {r.talk: r["name"] for r in view.talks(SESSION).collect()}
    assert talks[f"talk/{agent_id(1000 * t.n + 1)}"] == "the roster"
    assert {r.stream: r.label for r in view.streams(SESSION).collect()}[child] == "fine · it fails"


def test_configuration(tmp_path):
    assert config.source_root("/x") == "/x"
    assert [config.source_root("", e) for e in ({"CLAUDE_CONFIG_DIR": "/c", "XDG_CONFIG_HOME": "/d"}, {"XDG_CONFIG_HOME": "/d"}, {"HOME": "/h"})] == ["/c/projects", "/d/claude/projects", "/h/.claude/projects"]
    whole = config.load()
    assert [(s.name, s.interval_s, s.window, s.mode, s.exclude) for s in whole.sources] == [(config.SOURCE, 5, 8 << 20, "watch", config.EXCLUDE)]
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"storage": {"root": "/r"}, "adapters": [{"name": "a", "enabled": True, "source_root": "/s", "include": ["/w/**"], "collector": {"mode": "once", "interval": "1m30s", "max_delta_bytes": -1}}, {"name": "b"}]}))
    found = config.load(str(path))
    assert found.root == "/r" and [(s.name, s.source_root, s.root, s.interval_s, s.window, s.mode, s.include) for s in found.sources] == [("a", "/s", "/r", 90, 8 << 20, "once", ("/w/**",))]
    for wrong in ([{"name": ""}], [{"name": "a"}, {"name": "a"}], [{"name": "a", "collector": {"mode": "sometimes"}}]):
        path.write_text(json.dumps({"adapters": wrong}))
        with pytest.raises(ValueError):
            config.load(str(path))
    with pytest.raises(ValueError):
        config.seconds("5 parsecs")


def test_command_line(spark, tmp_path, capsys):
    t = Transcript(tmp_path / "src")
    t.turn("one")
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"storage": {"root": str(tmp_path / "root")}, "adapters": [{"name": "a", "enabled": True, "source_root": t.flush(), "collector": {"mode": "once"}}]}))

    def told(*args) -> list[dict]:
        assert command([*args, "-config", str(path)], spark) == 0
        return [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    assert told("sources")[0]["n_main"] == 1
    assert told("collect")[0] == {"source": "a", "records": 5}
    assert told("view")[0]["talks"] == 1 and told("view", SESSION)[0]["name"] == "one"
    assert any(x["id"] == "tool/t1-tool" and x["kind"] == "tool_use + tool_result" for x in told("view", SESSION, "talk/main/t1-run", "-terms", "native"))
    assert told("show", SESSION, "1", "1")[0]["id"] == "t1-in" and len(told("show", SESSION, "t1-tool")) == 2
    assert told("conversation", SESSION) and told("index", SESSION) and told("glossary") and told("fields")
    assert told("verify") == [] and told("parse") == []


def test_no_table_is_left_behind(spark, grown):
    t, root = grown
    place = shared_dir(spark).removeprefix("file://") + "/threadloom"

    def held() -> set:
        return set(os.listdir(place)) if os.path.isdir(place) else set()

    before = held()
    t.turn("three")
    rounds.collect(spark, t.flush(), root)
    rounds.publish(spark, root)
    view = Conversations(spark, root)
    view.talks(SESSION).collect()
    view.flow(SESSION).collect()
    rounds.publish(spark, root)
    assert held() == before
