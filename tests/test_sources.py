import json

import pytest
from pyspark.sql import functions as F

from deltaloom.sources import readers, sinks
from deltaloom.streaming import streams


def test_ticket_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("序号;问题;问题单编号\n1;first;A-01\n2;second;\n1;again;A-09\nx;none;\n", "utf-8")
    assert [tuple(r) for r in readers.read_tickets(spark, str(tmp_path / "t.csv")).orderBy("seq").collect()] == [(1, "again", "A-09"), (2, "second", "")]
    (tmp_path / "t.json").write_text(json.dumps({"items": [{"no": "3", "problem": "p", "ticket": "T-3"}]}), "utf-8")
    assert [tuple(r) for r in readers.read_tickets(spark, str(tmp_path / "t.json")).collect()] == [(3, "p", "T-3")]


def test_json_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"functions": {"f": "start"}, "x": "flat"}))
    assert sorted(tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "d.json")).collect()) == [("f", "start", "functions"), ("x", "flat", "symbols")]
    (tmp_path / "f.json").write_text(json.dumps({"failures": [{"func_name": "a", "error_type": "E"}, {"task": {"func_name": "b", "source_file": "s.c"}}]}))
    assert sorted((r.func_name, r.file_path, r.error_type) for r in readers.read_failures(spark, str(tmp_path / "f.json")).collect()) == [("a", "", "E"), ("b", "s.c", "unknown")]
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 2, "decisions": []}))
    try:
        readers.read_decisions(spark, str(tmp_path / "r.json"))
    except ValueError:
        pass
    else:
        raise AssertionError("another version is refused")


def test_tree(spark, tmp_path):
    for path, raw in {"a/x.c": b"int f(){}", "a/.hid.c": b"", "build/y.c": b"", "b/z.h": "中".encode("gb18030"), "n.txt": b""}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    assert sorted((r.rel_path, r.content) for r in readers.read_tree(spark, str(tmp_path)).collect()) == [("a/x.c", "int f(){}"), ("b/z.h", "中")]


def test_markdown(spark):
    doc = "## Module\n### `Init`\nint Init(int a);\n| name | type | text |\n|---|---|---|\n| a | int | left |\n#define LIMIT 3 // most\n| LIMIT | | again |\n| OTHER | 7 | note |"
    docs = spark.createDataFrame([("d", doc)], "doc string, text string")
    found = {r.function: r for r in readers.markdown_functions(docs).collect()}
    assert found["Init"].prototype == "int Init(int a)" and found["Init"].params[0].name == "a"
    assert {r.name: (r.value, r.note) for r in readers.markdown_macros(docs).collect()} == {"LIMIT": ("3", "most"), "OTHER": ("7", "note")}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 300, None)], "k int, old_body string, new_body string")
    sinks.write_json(sinks.preview(rows), str(tmp_path / "o"))
    back = spark.read.json(str(tmp_path / "o")).first()
    assert len(back.old_preview) == 200 and back.new_preview == ""
    assert [r.ticket_no for r in sinks.ticket_template(spark, 2, "AB").collect()] == ["AB-WT-01", "AB-WT-02"]


def test_streams(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    query = streams.distinct_events(streams.read_events(spark, source)).writeStream.format("memory").queryName("seen").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").count() == events.select("event_id").distinct().count()
    query = streams.tumbling(streams.read_events(spark, source)).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    wanted = events.groupBy(F.window("ts", "1 hour"), "event_type").count().count()
    assert spark.table("hours").count() == wanted


def test_fingerprint_stream(spark, tmp_path):
    from deltaloom.operators.incremental import read_state

    source, state = str(tmp_path / "docs"), str(tmp_path / "state")
    for bodies in ([(1, "a"), (2, "b")], [(1, "a2"), (2, "b"), (3, "c")]):
        spark.createDataFrame(bodies, "k int, body string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, body string").parquet(source)
        query = streams.track_fingerprints(stream, state, str(tmp_path / "cp"), ["k"], "body").trigger(availableNow=True).start()
        query.awaitTermination()
    assert {r.k: r.version for r in read_state(spark, state).collect()} == {1: 2, 2: 1, 3: 1}


def test_writer_killed_between_its_renames(spark, tmp_path, monkeypatch):
    """The old files are put back by the next writer or by recover; a second rename that is refused leaves them in place."""
    from deltaloom.sources import sinks

    path, rows = str(tmp_path / "out"), lambda x: spark.createDataFrame([(x,)], "t string")
    read = lambda p=path: [r.t for r in spark.read.parquet(p).collect()]
    sinks.write_parquet(rows("a"), path)
    real, calls = sinks.rename_new, []

    def second(outcome):
        def rename(spark_, made, target):
            calls.append(target)
            if len(calls) == 2:
                if outcome is False:
                    return False
                raise outcome
            return real(spark_, made, target)

        return rename

    monkeypatch.setattr(sinks, "rename_new", second(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        sinks.write_parquet(rows("b"), path)
    monkeypatch.setattr(sinks, "rename_new", real)
    assert sinks.recover(spark, path) and read() == ["a"] and not sinks.recover(spark, path)
    calls.clear()
    monkeypatch.setattr(sinks, "rename_new", second(False))
    with pytest.raises(OSError):
        sinks.write_parquet(rows("c"), path)
    monkeypatch.setattr(sinks, "rename_new", real)
    assert read() == ["a"]
    sinks.write_parquet(rows("d"), path)
    assert read() == ["d"] and read(f"{path}.bak") == ["a"]
