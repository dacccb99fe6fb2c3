"""What large inputs take other paths for: the same results as the plain ones."""

import json
import random

import yaml

from termloom import queries
from termloom.operators import events, keywords
from termloom.sources import files
from termloom.streaming import incremental


def written(spark, tmp_path, name, number):
    rows = [(f"term {i} é\u2028", "- a\n- b: c\n\n# d" if i % 3 else "", None if i % 2 else "'p\": {", [f"a{i}", "- x"] if i % 2 else [], [], [], [(f"f{j}.md", j == 1, "x\ny" * j) for j in range(i % 4)], i) for i in range(number)]
    made = spark.createDataFrame(rows, f"{files.TERMS}, ord int").repartitionByRange(7, "ord").sortWithinPartitions("ord")
    files.write_table(made.drop("ord"), tmp_path / name, "terms", version=1, generated="now")
    return made, tmp_path / name


def test_large_tables_are_written_and_read_in_parts(spark, tmp_path, monkeypatch):
    for name in ("t.yaml", "t.json"):
        made, path = written(spark, tmp_path, name, 300)
        data = {"version": 1, "generated": "now", "terms": [files._plain(r.asDict(recursive=True)) for r in made.drop("ord").sort("term").collect()]}
        data["terms"].sort(key=lambda x: int(x["term"].split()[1]))
        want = json.dumps(data, indent=2, ensure_ascii=False) if name == "t.json" else yaml.safe_dump(data, sort_keys=False, allow_unicode=True)
        assert path.read_text(newline="") == want
        monkeypatch.setattr(files, "WHOLE_BYTES", 0)
        monkeypatch.setattr(files, "_read", None)  # the driver reads none of it
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert sorted(files.read_terms(spark, path).collect(), key=lambda r: r.ord) == sorted(made.collect(), key=lambda r: r.ord)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
            monkeypatch.undo()


def test_tables_of_another_layout_are_read_as_a_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 0)
    term = {"term": "a", "locations": []}
    (tmp_path / "a.json").write_text(json.dumps({"terms": [term, term], "version": 1}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "terms": [term, term]}))
    (tmp_path / "c.yaml").write_text("terms:\n- term: a\n- term: a\nversion: 1\n")
    (tmp_path / "d.yaml").write_text("terms:\n  - term: a\n  - term: a\n")
    for path in tmp_path.iterdir():
        assert [(r.term, r.ord) for r in files.read_terms(spark, path).collect()] == [("a", 0), ("a", 1)]
    for name in ("e.json", "e.yaml"):
        _, path = written(spark, tmp_path, name, 0)
        assert files.read_terms(spark, path).count() == 0 and files._read(path) == {"version": 1, "generated": "now", "terms": []}


def test_folders_are_listed_by_the_executors_in_the_same_order(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    for i in range(200):
        path = tmp_path.joinpath(*(rng.choice(["a", "a-b", "b", ".h", "é"]) for _ in range(rng.randrange(4))), f"{rng.randrange(60)}{rng.choice(['.md', '.txt', '-x.md'])}")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"text {i}")
    want = files.list_files(tmp_path, ["md"], ["7.md"])
    monkeypatch.setattr(files, "list_files", None)
    got = files.numbered(files.listed(spark, tmp_path, ["md"], ["7.md"])).collect()
    assert [r.file for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, len(want) + 1))
    assert {r.file: r.content for r in files.read_documents(spark, tmp_path, ["md"], ["7.md"]).collect()} == {p: (tmp_path / p).read_text() for p in want}


def test_many_texts_have_the_keywords_of_each_one():
    texts = ["", None, "the of and", "Indigo", "A. B. C!", "ΣΑΣ ΟΔΟΣ. İstanbul İ dotted", "1 2 3 4.5 1,000 x", "we'll-known e.g. U.S.A. x2 __ a_b", "\n\n\n", "...", "word " * 50, "Of the The of Of", "x y z. a b c. The Red of Roots the Red of Roots"]
    rng = random.Random(7)
    words = ["Red", "root", "roots", "of", "the", "DNA", "madder", "Madder-root", "it's", "plant", "7", ".", "!", "?\n\n", ","]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(300))) for _ in range(40)]
    for limit in (0, 3, 20, 500):
        assert keywords.yake_all(texts, 3, limit) == [keywords.yake(t or "", 3, limit) for t in texts]


def test_features_of_a_row_are_not_shuffled(spark):
    rows = [(f"f{i % 9}" if i < 12 else None, t) for i, t in enumerate(["One two. Two Three! two\nÉté 4x", "", None, "a a A. A"] * 4)]
    docs = spark.createDataFrame(rows, "file string, prose string").repartition(8)
    want = sorted(map(tuple, keywords._file_features(docs).collect()), key=repr)
    assert sorted(map(tuple, keywords.yake_features(docs).collect()), key=repr) == want
    plan = keywords.yake_features(docs.where("file > 'f2'"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_events_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(40).selectExpr("id event_id", "id % 3 user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for sql in (queries.LOG_SQL, queries.CHANGES_LOG_SQL):
        assert queries.log_lines(spark, str(tmp_path), sql).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_stream_goes_on_within_a_turn(spark, tmp_path):
    event = lambda kind, **delta: json.dumps({"type": "stream_event", "event": {"type": kind, "delta": delta}})
    first = [event("message_start"), event("d", partial_json='{"terms": '), event("d", text="a")]
    then = [event("d", partial_json="[1]}", text="b"), event("message_delta"), event("message_stop"), event("message_start"), event("d", partial_json="{"), event("message_stop")]
    rows = [("s", i, line) for i, line in enumerate(first + then)]
    source = tmp_path / "in"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "session string, seq long, line string").coalesce(1).write.parquet(f"{source}/{i}")
    found, name = [], "stream_within_a_turn"
    lines = spark.readStream.schema("session string, seq long, line string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    incremental.fold_events(lines, ["terms"]).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = sorted(spark.table(name).select("turns", "last_valid_turn", "output", "text", "json").collect())
    assert [tuple(r) for r in found] == [(1, None, None, "a", '{"terms": '), (2, 1, '{"terms": [1]}', "ab", "{")]


def test_a_line_is_parsed_once(spark):
    lines = spark.range(3).selectExpr("'s' session", "id seq", "concat('{\"type\":\"stream_event\",\"event\":{\"type\":\"t', id, '\"}}') line")
    parsed = events.parse_events(lines)
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(r.kind for r in parsed.collect()) == ["t0", "t1", "t2"]
