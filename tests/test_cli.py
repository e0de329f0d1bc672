"""Settings, command line and the pipeline on a small folder."""

import json
import os

import pytest

from chunkloom import cli
from chunkloom.config import Settings, parse_sidecar, parse_toml
from chunkloom.model import DocError
from chunkloom.plans import pipeline


def test_all_problems_are_named():
    got = Settings(overlap=600, debug_output="x", workers=0, gpu=True, mode="fast").problems()
    assert len(got) == 6


def test_argument_files(tmp_path):
    f = tmp_path / "args"
    f.write_text("--input\n# no\n\na b\n")
    assert cli.expand([f"@{f}", "--strict"]) == ["--input", "a b", "--strict"]


def test_given_options_win(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('max_tokens = 100\nformat = "jsonl"\n')
    s = cli.settings(["--config", str(f), "--max-tokens", "512"])
    assert (s.max_tokens, s.format, s.overlap) == (512, "jsonl", 50)
    with pytest.raises(DocError):
        parse_toml("unknown = 1")


def test_sidecars():
    assert parse_sidecar('max_tokens = 8\nchunk_strategy = "fixed"') == {"chunk_strategy": "fixed", "max_tokens": 8}
    assert parse_sidecar("no toml [") is None
    for bad in ("max_tokens = 0", "max_tokens = 9999999999", "overlap = -1", "overlap = 4294967296"):
        with pytest.raises(DocError):
            parse_sidecar(bad)
    assert parse_sidecar("max_tokens = true") is None


def test_bad_configuration_is_exit_3():
    assert cli.main(["--input", "x"]) == cli.BAD_CONFIG


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in" / "sub"
    d.mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# T\n\npara\n\n- x\n")
    (tmp_path / "in/a.md.chunkloom.toml").write_text('max_tokens = 1\noverlap = 0\nchunk_strategy = "by-title"\n')
    (d / "a.txt").write_text("one\n\ntwo\n")
    (d / "noext").write_bytes(b"<?xml version='1.0'?><r><p>hi</p></r>")
    (d / "book.epub").write_bytes(b"x")
    (d / "what").write_bytes(b"zzz")
    return tmp_path


def test_pipeline(spark, folder):
    s = Settings(input=str(folder / "in"), output=str(folder / "out"), format="jsonl")
    got = pipeline.run(spark, s)
    assert (got["total_files"], got["succeeded"], got["failed"], got["total_chunks"]) == (4, 3, 1, 5)
    rows = [json.loads(x) for p in os.listdir(folder / "out") if p.startswith("part") for x in open(folder / "out" / p)]
    assert sorted(r["text"] for r in rows) == ["T", "hi", "one\ntwo", "para", "x"]
    assert set(rows[0]) == {"id", "text", "token_count", "source_blocks", "page_start", "page_end", "overlap_prefix", "confidence"}
    assert cli.main(["-i", str(folder / "in"), "-o", str(folder / "md"), "-f", "markdown"]) == cli.PARTIAL
    names = os.listdir(folder / "md")
    assert len(names) == 3 and any("**Chunk 1 / 3**" in (folder / "md" / n).read_text() for n in names)


def test_stream(spark, folder):
    from chunkloom import streaming

    chunks = streaming.stream_chunks(streaming.stream_files(spark, str(folder / "in")), Settings())
    streaming.start(chunks, str(folder / "s"), str(folder / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(folder / "s")).count() == 3


def test_settings_out_of_range_are_that_row(spark, folder):
    (folder / "in/a.md.chunkloom.toml").write_text("max_tokens = 9999999999\n")
    got = pipeline.run(spark, Settings(input=str(folder / "in"), output=str(folder / "o"), format="jsonl"))
    assert (got["total_files"], got["succeeded"]) == (4, 2) and {c for _, c, _ in got["errors"]} == {"E1001", "E5001"}


def test_elements_output(spark, folder):
    assert cli.main(["-i", str(folder / "in"), "-o", str(folder / "e"), "--output-compat", "elements"]) == cli.PARTIAL
    by = {n: json.loads((folder / "e" / n).read_text()) for n in os.listdir(folder / "e")}
    assert len(by) == 3
    (own,) = (v for k, v in by.items() if k.endswith("a.md.json"))
    assert [(x["type"], x["text"]) for x in own] == [("Title", "T"), ("NarrativeText", "para"), ("ListItem", "x")]
    assert own[0]["metadata"]["page_number"] == 1 and own[0]["metadata"]["filename"].endswith("a.md")
    with pytest.raises(SystemExit):
        cli.main(["-i", "x", "-o", "y", "--output-compat", "other"])


@pytest.mark.parametrize("fmt", ["json", "markdown"])
def test_documents_of_a_cluster(spark, folder, monkeypatch, fmt):
    # by Spark's writer: the same texts as the files of one machine
    s = Settings(input=str(folder / "in"), output=str(folder / "one"), format=fmt)
    pipeline.run(spark, s)
    monkeypatch.setattr(pipeline, "on_this_machine", lambda *_: False)
    s.output = str(folder / "many")
    pipeline.run(spark, s)
    one = {n: (folder / "one" / n).read_text() for n in os.listdir(folder / "one")}
    many = {d.name.removeprefix("document="): "".join(p.read_text() for p in d.glob("part*")) for d in (folder / "many").iterdir() if d.is_dir()}
    assert {k: v.rstrip("\n") for k, v in many.items()} == {k: v.rstrip("\n") for k, v in one.items()} and len(one) == 3


def test_lines_are_in_the_order_of_paths(spark, folder):
    for i in range(30):
        (folder / f"in/f{29 - i:02}.txt").write_text(f"text {29 - i:02}\n")
    pipeline.run(spark, Settings(input=str(folder / "in"), output=str(folder / "o"), format="jsonl"))
    lines = [json.loads(x)["text"] for p in sorted(os.listdir(folder / "o")) if p.startswith("part") for x in open(folder / "o" / p)]
    assert [x for x in lines if x.startswith("text")] == [f"text {i:02}" for i in range(30)]


def test_debug_output(spark, folder):
    out = folder / "debug"
    code = cli.main(["-i", str(folder / "in"), "-o", str(folder / "o"), "-f", "parquet", "--debug", "--debug-output", str(out), "--log-level", "error"])
    assert code == cli.PARTIAL
    read = lambda name: [json.loads(x) for p in sorted((out / name).glob("part*")) for x in open(p)]
    steps = {r["input_file"].rsplit("/", 1)[1]: r for r in read("format")}
    assert steps["a.md"] | {"input_file": 0} == {"input_file": 0, "format_key": "text", "parser_routed_to": "text", "needs_vision": False, "block_count": 3, "chunk_count": 3, "error_code": None, "error_message": None}
    assert steps["book.epub"]["chunk_count"] == 0 and steps["book.epub"]["error_code"] == "E1001"
    assert len(read("blocks")) == 3 and len(read("chunks")) == 5
    (summary,) = read("summary")
    assert summary["total_chunks"] == 5 and summary["errors"][0][1] == "E1001"
    assert "writing parquet" in (out / "chunkloom.log").read_text() and "E1001" in (out / "chunkloom.log").read_text()


@pytest.mark.parametrize("shell", ["bash", "zsh", "fish"])
def test_completions(shell, capsys):
    assert cli.main(["--completions", shell]) == cli.OK
    text = capsys.readouterr().out
    assert "output-compat" in text and "by-structure" in text
