import json

import pytest

from termloom import cli, config
from termloom.operators.keywords import tfidf
from termloom.plans import pipeline
from termloom.sources import files

TEXTS = {
    "auth.md": "---\ntitle: x\n---\n# Auth\n\nOAuth is a delegation protocol. OAuth tokens prove identity to the gateway.",
    "api.md": "The API key is a secret. OAuth guards the API gateway. Rate limits protect the gateway.",
    "security.typ": "= Security\n\nTransport security uses certificates. Certificates expire. See #link(\"x\")[OAuth notes].",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    return tmp_path


def answer(system, user):
    return json.dumps({
        "terms": [
            {"term": "OAuth", "definition": "Delegation.", "parent": "security", "aliases": [], "see_also": ["security"], "main_files": ["auth.md"]},
            {"term": "security", "definition": "Being safe @all.", "parent": None, "aliases": ["certificates"], "see_also": [], "main_files": []},
        ],
        "suggested": [{"term": "zero trust", "definition": "No trust.", "parent": "security"}],
    })


def conf():
    made = config.Config()
    made.extract.max_doc_pct = 1.0
    return made


def test_extract_curate_render(spark, folder):
    found, number = pipeline.extract(spark, conf(), folder / "src")
    rows = found.collect()
    assert number == 3 and [r.term.lower() for r in rows] == sorted(r.term.lower() for r in rows)
    assert any(r.term.lower() == "oauth" for r in rows) and all(0 <= r.score <= 1 for r in rows)
    terms = pipeline.curate_full(spark, found, conf(), answer).cache()
    by = {r.term: r for r in terms.collect()}
    assert by["security"].children == ["OAuth", "zero trust"]
    assert {x.file: x.main for x in by["OAuth"].locations} == {"auth.md": True, "api.md": False, "security.typ": False}
    done = pipeline.render(spark, terms, folder / "src", folder / "out", ["md", "typ"])
    assert done["files"] == 3 and done["main_markers"] == 1
    text = (folder / "out" / "auth.md").read_text()
    assert text.startswith("#import") and 'OAuth#index-main("security", "OAuth") is' in text
    glossary = (folder / "out" / "glossary.typ").read_text()
    assert "  terms.item([security <term-security>], [Being safe \\@all.\n    #terms(tight: true,\n      terms.item([OAuth" in glossary
    report, suggested = pipeline.check(terms, files.with_prose(files.read_documents(spark, folder / "src")))
    assert report["checked"] == report["resolved"] + report["unresolved"]


def test_incremental_asks_only_for_new_candidates(spark, folder, caplog):
    found, _ = pipeline.extract(spark, conf(), folder / "src")
    found = found.cache()
    terms = pipeline.curate_full(spark, found, conf(), answer).cache()
    known = found.where("lower(term) in ('oauth', 'certificates')")
    notes = {}
    same = pipeline.curate_incremental(spark, terms, known, conf(), lambda s, u: pytest.fail("asked"), notes)
    assert notes["new"] == 0 and notes["warning"] is None
    assert {r.term for r in same.collect()} == {"OAuth", "security", "zero trust"}

    def delta(system, user):
        assert "OAuth | parent: security" in user
        return json.dumps({"additions": [{"term": "API key", "definition": "Secret.", "parent": "nowhere", "aliases": [], "see_also": [], "main_files": []}], "modifications": [{"term": "oauth", "definition": "New.", "reason": "x"}], "removals": [{"term": "zero trust", "reason": "x"}]})

    with caplog.at_level("WARNING", "termloom"):
        rows = {r.term: r for r in pipeline.curate_incremental(spark, terms, found, conf(), delta, notes).collect()}
    assert "full rebuild advised" in caplog.text and notes["ratio"] >= 0.7 and notes["estimate"]["input_tokens"] > 300
    assert set(rows) == {"API key", "OAuth", "security"} and rows["API key"].parent is None and rows["OAuth"].definition == "New."
    assert {x.file: x.main for x in rows["OAuth"].locations}["auth.md"] is True


def test_bad_output_and_budget(spark, folder):
    found, _ = pipeline.extract(spark, conf(), folder / "src")
    with pytest.raises(pipeline.CurateError):
        pipeline.curate_full(spark, found, conf(), lambda s, u: "not json")
    dear = conf()
    dear.curate.model, dear.curate.max_budget_usd = "opus", 0.01
    with pytest.raises(pipeline.CurateError, match="budget"):
        pipeline.curate_full(spark, found, dear, answer)


def test_estimates_count_the_schema_and_stale_terms_are_told(spark, folder):
    full, delta = pipeline.output_schema(False), pipeline.output_schema(True)
    assert set(json.loads(delta)["required"]) == {"additions", "modifications", "removals"}
    told = pipeline.gate(conf(), "system", "text")["input_tokens"]
    assert told == 2 + 1 + 300 + -(-len(full) // 4)
    assert "gone: x, y" in pipeline.user_prompt(conf(), "p", "index", ["x", "y"]) and "gone" not in pipeline.user_prompt(conf(), "p", "index")


def test_patches_match_ascii_case_alone(spark):
    from termloom.operators import curate

    prior = spark.createDataFrame([("Ärmel", "old", None, [], [], [], 0), ("Knopf", "old", None, [], [], [], 1)], f"term string, definition string, parent string, aliases array<string>, see_also array<string>, locations {curate.LOCATIONS}, ord int")
    shape = "term string, definition string, parent string, aliases array<string>, see_also array<string>"
    none, patches = spark.createDataFrame([], shape), spark.createDataFrame([(0, "ärmel", "new", None, None, None), (1, "KNOPF", "new", None, None, None)], f"ord int, {shape}")
    gone, more = spark.createDataFrame([], "term string, reason string"), spark.createDataFrame([], "term string, definition string, parent string")
    assert {r.term: r.definition for r in curate.merge_delta(prior, none, patches, gone, more).collect()} == {"Ärmel": "old", "Knopf": "new"}
    assert curate.merge_log(prior, none, patches, gone, more).first().modified == 1


def test_no_documents(spark, tmp_path):
    with pytest.raises(files.NoDocuments):
        pipeline.extract(spark, conf(), tmp_path)


def test_tfidf_scores(spark):
    docs = spark.createDataFrame([("1", "oauth secures apis"), ("2", "apis need limits"), ("3", "plain words")], "file string, prose string")
    got = {r.term: r.score for r in tfidf(docs).collect()}
    assert got["oauth"] > got["apis"] and max(got.values()) == 1.0
    assert tfidf(docs.limit(0)).count() == 0 and tfidf(docs.where("file = '1'")).count() == 0


def test_config_layers(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    (tmp_path / "home" / "termloom").mkdir(parents=True)
    (tmp_path / "home" / "termloom" / "config.toml").write_text('log_level = "debug"\n[extract]\nmin_score = 0.2\n')
    project = tmp_path / "project"
    (project / "sub" / ".git").mkdir(parents=True)
    (project / ".config").mkdir()
    (project / "termloom.toml").write_text("[extract]\nmax_candidates = 7\n")
    (project / ".config" / "termloom.yaml").write_text("extract: {max_candidates: 9}\n")
    (tmp_path / "own.json").write_text('{"extract": {"exclude": {"terms": ["x"]}}, "unknown": 1}')
    got = config.load(project / "sub", tmp_path / "own.json")
    assert (got.log_level, got.extract.min_score, got.extract.max_candidates, got.extract.exclude.terms) == ("debug", 0.2, 7, ["x"])
    (project / ".git").mkdir()
    (project / "sub" / "deep").mkdir()
    assert config.project_file(project / "sub" / "deep") is None  # a repository's top is the last folder looked at
    with pytest.raises(ValueError):
        config.build(config.ExtractConfig, {"known_terms": [{"term": "a", "variants": [""]}]})


def test_command_line(spark, folder, monkeypatch, capsys):
    monkeypatch.chdir(folder)
    monkeypatch.setenv("TERMLOOM_LOG_DIR", str(folder / "log"))
    assert cli.main(["--json", "extract", "src", "-o", "c.yaml"]) == 0
    assert json.loads(capsys.readouterr().out)["documents"] == 3
    assert cli.main(["--json", "curate", "c.yaml", "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["mode"] == "full"
    (folder / "model.py").write_text(f"import sys\nopen('sent.json', 'w').write(sys.stdin.read())\nprint({json.dumps({**json.loads(answer('', '')), 'thinking': 'Weighed it.'})!r})\n")
    assert cli.main(["--json", "curate", "c.yaml", "-o", "t.yaml", "--model-command", "python", "model.py"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["terms"] == 3 and said["suggested"] == ["OAuth", "zero trust"]  # OAuth stands in too many files to be a candidate
    assert said["validation"]["checked"] == said["validation"]["resolved"] + said["validation"]["unresolved"] > 0
    assert (folder / "t-thinking.md").read_text() == "Weighed it."
    sent = json.loads((folder / "sent.json").read_text())
    assert set(sent["schema"]["required"]) == {"terms"} and "main_files" in sent["schema"]["properties"]["terms"]["items"]["properties"]
    assert cli.main(["--json", "curate", "c.yaml", "-o", "t.yaml", "--dry-run"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["mode"] == "incremental" and 0 < said["new"] <= said["total"] and said["input_tokens"] > 300 and said["warning"]
    assert cli.main(["--json", "render", "t.yaml", "-o", "out"]) == 0
    assert json.loads(capsys.readouterr().out)["markers"] >= 1
    assert cli.main(["--json", "doctor"]) == 0
    capsys.readouterr()
    assert cli.main(["curate", "c.yaml", "-o", "t.yaml", "--dry-run"]) == 0
    told = capsys.readouterr()
    assert not told.out and "incremental" in told.err
