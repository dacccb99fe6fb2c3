import json

import pytest

from termloom import logs


def test_where_the_log_goes(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    a, b, c = (str(tmp_path / x) for x in "abc")
    assert logs.log_file(c, {logs.ENV_PATH: f"{a}/x.log", logs.ENV_DIR: b}) == tmp_path / "a" / "x.log"
    assert logs.log_file(c, {logs.ENV_DIR: b}) == tmp_path / "b" / "termloom.jsonl"
    assert logs.log_file(c, {}) == tmp_path / "c" / "termloom.jsonl"
    (tmp_path / "file").write_text("")
    assert logs.log_file(None, {"XDG_DATA_HOME": a}, system_dir=str(tmp_path / "file")) == tmp_path / "a" / "termloom" / "logs" / "termloom.jsonl"
    assert logs.log_file(None, {"XDG_DATA_HOME": str(tmp_path / "file")}, system_dir=str(tmp_path / "file")) == tmp_path / "termloom.jsonl"
    with pytest.raises(OSError):
        logs.log_file(str(tmp_path / "file" / "x"), {})


def test_lines_are_json(tmp_path, monkeypatch):
    monkeypatch.setenv(logs.ENV_PATH, str(tmp_path / "l.jsonl"))
    log = logs.start("info")
    log.info("said %s", "é")
    log.debug("hidden")
    for h in log.handlers:
        h.flush()
    lines = [json.loads(x) for x in (tmp_path / "l.jsonl").read_text().splitlines()]
    assert [(x["level"], x["message"]) for x in lines] == [("info", "said é")]


def test_reasoning(tmp_path):
    path = tmp_path / "r.md"
    logs.write_reasoning(path, "", "t", False)
    assert not path.exists()
    logs.write_reasoning(path, "first", "t", False)
    logs.write_reasoning(path, "second", "2026-01-01T00:00:00Z", True)
    assert path.read_text() == "first\n---\n## Incremental update 2026-01-01T00:00:00Z\n\nsecond\n"
