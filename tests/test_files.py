"""Files as tables: pieces of any size give the lines of the file, whole values stay whole, folders are pruned, projects are named."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tracewell.sources import files, traces


def rows(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@given(st.lists(st.one_of(st.just(""), st.just("  "), st.just("not json"), st.just('{"a": 1}'), st.just('"é日😀"'), st.just("[1, 2]")), max_size=12), st.booleans(), st.integers(1, 40))
@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_pieces_of_any_size_give_each_line_once(tmp_path, lines, end, split):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(['{"first": 0}', '{"second": 1}', *lines]) + "\n" * end)
    found = rows(files._TraceLinesReader({"path": str(path), "split": str(split)}))
    texts = [r for r in found if r["text"] is not None]
    text = path.read_bytes()
    assert [r["text"] for r in texts] == [x.strip() for x in text.decode().split("\n") if x.strip()]
    before = lambda r: sum(x["line"] for x in found if x["text"] is None and x["start"] < r["start"])
    for r in texts:
        assert text[r["at"] :].decode().split("\n")[0].strip() == r["text"]
        assert r["line"] + before(r) == text[: r["at"]].count(b"\n") + 1


@pytest.mark.parametrize(("text", "lines"), [('{\n "a": 1\n}\n', False), ("[\n1,\n2]", False), ('{"a": 1}', False), ('{"a": 1}\n\n', False), ('{"a": 1}\n{"a": 2}', True), ('bad line\n{"a": 2}', True), ('{"a": "open\n{"a": 2}', True), ("", False), ("\n \n", False), ('\n\n{"a": 1}\nx', True)])
def test_whether_a_file_has_a_value_a_line(tmp_path, text, lines):
    (tmp_path / "f").write_text(text)
    assert files.by_line(files.fs.LocalFileSystem(), str(tmp_path / "f")) is lines


def test_a_whole_value_is_one_row_whatever_the_pieces(tmp_path):
    value = json.dumps([{"n": i} for i in range(50)], indent=1)
    (tmp_path / "v.json").write_text(value)
    found = rows(files._TraceLinesReader({"path": str(tmp_path), "split": "16"}))
    assert [(r["whole"], r["text"]) for r in found] == [(True, value)]


def test_files_come_in_order_and_folders_in_them_do_not(spark, tmp_path):
    for name, text in (("b.json", '[{"n": 3}, {"n": 4}]'), ("a.jsonl", '{"n": 5}\n\nbroken\n{"n": 6}\n'), ("a.json", '{\n"n": 2}'), ("c.txt", '{"n": 9}'), ("d.json", " \n"), ("e.json", '{"n": 7}\n[oops\n')):
        (tmp_path / name).write_text(text)
    (tmp_path / "sub.json").mkdir()
    (tmp_path / "sub.json" / "x.json").write_text('{"n": 8}')
    found = traces.load(spark, str(tmp_path), split=9).orderBy("file_ord", "ord").collect()
    assert [(r["file"].rsplit("/", 1)[1], r["entry"] and json.loads(r["entry"])["n"]) for r in found] == [("a.json", 2), ("b.json", 3), ("b.json", 4), ("e.json", 7), ("e.json", None), ("a.jsonl", 5), ("a.jsonl", None), ("a.jsonl", 6)]
    wrong = files.problems(files.trace_lines(spark, str(tmp_path), split=9)).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"] or 0, r["problem"]) for r in wrong) == [("a.jsonl", 3, "invalid"), ("d.json", 0, "empty"), ("e.json", 2, "invalid")]
    # one file, by its address
    assert traces.load(spark, f"file://{tmp_path}/a.jsonl").count() == 3


def test_a_folder_without_files_is_an_empty_table_and_a_missing_one_an_error(spark, tmp_path):
    assert traces.load(spark, str(tmp_path)).count() == 0
    assert files.source_tree(spark, str(tmp_path)).count() == 0
    assert files.projects(spark, str(tmp_path / "nowhere")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        traces.load(spark, str(tmp_path / "nowhere")).count()


def test_the_format_may_be_told(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"trace_id": "t", "model": "m"}\n{"trace_id": "u", "model": "m"}\n')
    entries = traces.load(spark, str(tmp_path))
    assert traces.normalize(entries).count() == 0 and traces.unknown_files(entries).count() == 1
    assert sorted(r["trace_id"] for r in traces.normalize(entries, "raw").select("trace_id").collect()) == ["t", "u"]
    with pytest.raises(ValueError, match="no such format"):
        traces.normalize(entries, "xml")


def test_skipped_folders_are_not_entered(spark, tmp_path, monkeypatch):
    for inside in ("a.py", "src/b.PY", "src/c.ts", "src/d.md", "node_modules/e.js", "src/build/deep/f.py", "pkg.egg-info/g.py", "fixtures.py", "src/tests/h.mjs"):
        (tmp_path / inside).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / inside).write_text(f"# {inside} é")
    entered = []
    monkeypatch.setattr(files, "_listed", lambda fs, folder, listed=files._listed: entered.append(folder) or listed(fs, folder))
    reader = files._CodeTreeReader({"path": str(tmp_path)})
    assert sorted(r["inside"] for r in rows(reader)) == ["a.py", "fixtures.py", "src/b.PY", "src/c.ts", "src/tests/h.mjs"]
    assert not any("node_modules" in x or "build" in x or "egg-info" in x for x in entered)
    monkeypatch.undo()
    found = files.source_tree(spark, str(tmp_path)).collect()
    assert {r["inside"]: r["text"] for r in found}["src/c.ts"] == "# src/c.ts é"


def test_projects_are_named_by_their_sessions_or_their_folder(spark, tmp_path):
    logs = {"-Users-x-Downloads-shop": ["{}\n", '{"cwd": "/elsewhere"}\n'], "-home-y-app": ['\n{"a": 1}\n{"cwd": "/home/y/my-tool"}\n'], "-Users-z": ["oops\n" + '{"cwd": "/no"}\n'], "-home-.hidden": ["[]\n"], "none": []}
    for folder, texts in logs.items():
        (tmp_path / folder).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / folder / f"{i}.jsonl").write_text(text)
    got = {r["raw_name"]: (r["display_name"], r["cwd"], r["prefix"], r["n_sessions"], r["n_bytes"]) for r in files.projects(spark, str(tmp_path)).collect()}
    assert got == {
        "-Users-x-Downloads-shop": ("shop", "/Users/x/Downloads/shop", "/Users/x/Downloads/shop/", 2, 25), "-home-y-app": ("my-tool", "/home/y/my-tool", "/home/y/my-tool/", 1, 37), "-Users-z": ("z", "/Users/z", "/Users/z/", 1, 20), "-home-.hidden": ("-home-.hidden", "/home/.hidden", "/home/.hidden/", 1, 3),
    }


def test_a_project_is_named_though_the_first_task_has_none_of_its_rows(spark, tmp_path):
    """The larger file is read first and has turns of one project alone; of two projects there are none."""
    from tracewell import catalog

    for ids, text in (([1] * 50, "x" * 1000), ([4, 5, 8], "y")):
        spark.createDataFrame([(c, i, "user", f"{text}{i}") for i, c in enumerate(ids)], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    got = {r["raw_name"]: (r["display_name"], r["cwd"], r["n_bytes"]) for r in catalog.project_list(spark, str(tmp_path)).collect()}
    assert got == {"-home-ann-shop": ("store", "/srv/ann/store/", 2 * 35), "-Users-bo-Downloads-web": ("web", "/Users/bo/Downloads/web", 10 * 11 + 40 * 12 + 11)}
