"""Snapshots, logs, and file sources."""

from __future__ import annotations

import json

import pytest

from webloom.sources import files
from webloom.streaming import state, wal


def event(seq, kind, phase=None, **more):
    return {"seq": seq, "timestamp": f"t{seq}", "type": kind, "phase": phase, **more}


def test_compaction_keeps_the_state(spark, tmp_path):
    at, log = f"file://{tmp_path}/state", f"file://{tmp_path}/run.log"
    assert state.can_resume(spark, at, log) == "begin"
    state.append(spark, log, [event(1, "phase:start", "scrape"), event(2, "phase:complete", "scrape")])
    state.append(spark, log, [event(3, "phase:start", "extract")])
    assert state.can_resume(spark, at, log) == "resume" and state.compact(spark, at, log, "now") == 3
    want = {("scrape", "completed", "t1", "t2", 3), ("extract", "in_progress", "t3", None, 3)}
    phases, events = state.load_state(spark, at, log)
    assert {(r["phase"], r["status"], r["started_at"], r["completed_at"], min(r["last_seq"], 3)) for r in phases.collect()} == want
    assert [r["type"] for r in events.collect()] == ["wal:compacted"]
    state.append(spark, log, [event(5, "phase:complete", "extract")])
    phases, _ = state.load_state(spark, at, log)
    assert {(r["phase"], r["status"], r["started_at"], r["completed_at"]) for r in phases.collect()} == {("scrape", "completed", "t1", "t2"), ("extract", "completed", "t3", "t5")}


def test_corrupt_logs_are_refused(spark, tmp_path):
    at, log = f"file://{tmp_path}/state", f"file://{tmp_path}/run.log"
    (tmp_path / "run.log").write_text(json.dumps(event(1, "phase:start", "scrape")) + "\n{broken\n" + json.dumps(event(3, "phase:complete", "scrape")) + "\n")
    assert state.can_resume(spark, at, log) == "repair"
    with pytest.raises(ValueError, match="corrupt"):
        state.compact(spark, at, log, "now")
    phases, _ = state.load_state(spark, at, log)
    assert [(r["phase"], r["status"]) for r in phases.collect()] == [("scrape", "in_progress")]
    assert wal.read_lines(spark, log).count() == 3


def test_file_scans(spark, tmp_path):
    for name, text in {"a/x y.ts": "é", "a/b+c%.js": "1", "node_modules/n.js": "", ".git/o.js": "", "_own/p.js": "", "site/_server/fixtures/f.json": '{"id": "f1", "request": {"method": "GET"}}', "site/_server/fixtures/_index.json": "{}", "other/z.css": "a{}", "m/a.js.map": '{"version": 3, "sources": ["s"], "mappings": ""}', "m/names.json": '{"mod": {"a": "a_1"}}'}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    root = f"file://{tmp_path}"
    assert {(r["path"], r["content"]) for r in files.scan_files(spark, root, files.CODE).collect()} == {("a/x y.ts", "é"), ("a/b+c%.js", "1")}
    assert [r["path"] for r in files.scan_files(spark, str(tmp_path), files.STYLES).collect()] == ["other/z.css"]
    assert [(r["path"], r["id"], r["request"]["method"]) for r in files.fixtures(spark, f"{root}/site").collect()] == [("f.json", "f1", "GET")]
    assert [r["site"] for r in files.captured_sites(spark, root).collect()] == ["site"]
    assert [(r["map_id"], r["version"], r["sources"]) for r in files.parsed_maps(files.source_maps(spark, root)).collect()] == [("m/a.js.map", 3, ["s"])]
    assert [tuple(r) for r in files.class_maps(spark, f"{root}/m").collect()] == [("names.json", "mod", "a", "a_1")]
