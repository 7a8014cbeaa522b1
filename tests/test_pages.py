"""The stream of landed pages: new pages only, changed pages again, a window of days, and broken pages counted."""

import json
import os

from quillstream.sources import sinks
from quillstream.streaming import pages

SCHEMA = "id long, v long, name string"


def put(folder, day, name, content, at=None):
    path = folder / f"day={day}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(content if isinstance(content, str) else json.dumps({"items": content}))
    if at:
        os.utime(path / name, (at, at))


def test_runs_read_new_pages_only(spark, tmp_path):
    folder, base = tmp_path / "pages", f"file://{tmp_path}"
    run = lambda back=3: pages.ingest(spark, f"{base}/pages", f"{base}/t", f"{base}/state", SCHEMA, ["id"], ["v"], back)
    table = lambda: sorted(map(tuple, sinks.current(spark, f"{base}/t").select("id", "v", "name").collect()))
    put(folder, "2024-01-01", "a.json", [{"id": 1, "v": 1, "name": "long ago"}], 1000)
    put(folder, "2024-01-10", "a.json", [{"id": 2, "v": 1, "name": "é"}, {"id": 3, "v": 1}], 2000)
    put(folder, "2024-01-10", "_ignored.json", "x", 2000)
    assert run() == {"pages": 2, "items": 3, "broken": 0}
    assert table() == [(1, 1, "long ago"), (2, 1, "é"), (3, 1, None)]
    assert run() == {"pages": 0, "items": 0, "broken": 0}
    # a page of the same time, a changed page, a broken one, one with lines of which one is broken, and one that is too late for the window
    put(folder, "2024-01-10", "b.json", [{"id": 4, "v": 1, "name": "same time"}], 2000)
    put(folder, "2024-01-09", "a.json", [{"id": 2, "v": 2, "name": "newer"}, {"id": 3, "v": 0, "name": "older"}], 3000)
    put(folder, "2024-01-11", "broken.json", '{"items": [{"id": 9', 3000)
    put(folder, "2024-01-11", "lines.json", '{"items":[{"id":5,"v":1,"name":"line"}]}\nnot json\n{"items":[{"id":6,"v":1,"name":"line"}]}\n{"other":1}\n', 3000)
    put(folder, "2024-01-02", "late.json", [{"id": 7, "v": 1, "name": "late"}], 3000)
    assert run() == {"pages": 4, "items": 5, "broken": 3}
    assert table() == [(1, 1, "long ago"), (2, 2, "newer"), (3, 1, None), (4, 1, "same time"), (5, 1, "line"), (6, 1, "line")]
    errors = sinks.current(spark, f"{base}/t-errors")
    assert sorted((str(r["day"]), r["page"]) for r in errors.collect()) == [("2024-01-11", "broken.json"), ("2024-01-11", "lines.json"), ("2024-01-11", "lines.json")]
    put(folder, "2024-01-11", "broken.json", [{"id": 9, "v": 1, "name": "mended"}], 4000)
    assert run() == {"pages": 1, "items": 1, "broken": 0} and (9, 1, "mended") in table()


def test_no_pages(spark, tmp_path):
    base = f"file://{tmp_path}"
    run = lambda: pages.ingest(spark, f"{base}/none", f"{base}/t", f"{base}/s", SCHEMA, ["id"], ["v"])
    assert run() == {"pages": 0, "items": 0, "broken": 0} and sinks.current(spark, f"{base}/t") is None
    put(tmp_path / "none", "2024-01-01", "a.json", [{"id": 1, "v": 1, "name": "x"}])
    assert run() == {"pages": 1, "items": 1, "broken": 0}


def test_a_large_file_of_pages_is_read_page_by_page(tmp_path):
    """A file of many lines isn't held whole; one document over several lines is one page, and a broken first line leaves the others."""
    import tracemalloc

    folder = tmp_path / "day=2024-01-01"
    folder.mkdir()
    line = json.dumps({"items": [{"id": i, "text": "x" * 90} for i in range(500)]})
    (folder / "many").write_text((line + "\n") * 400)
    (folder / "one").write_text(json.dumps({"items": [1, 2]}, indent=2))
    (folder / "broken").write_text("{\n" + line + "\n")
    (folder / "empty").write_text("")
    read = lambda name: pages.PageStream({"path": str(tmp_path)}).read(pages.Page(str(tmp_path), "2024-01-01", str(folder / name)))
    tracemalloc.start()
    n = sum(1 for _ in read("many"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 5e6
    assert [r[2] for r in read("one")] == ["1", "2"] and list(read("empty")) == []
    broken = list(read("broken"))
    assert len(broken) == 501 and broken[0][3].startswith("page 0") and broken[1][3] is None
    assert [r[3] for r in read("gone")] == ["not read: FileNotFoundError"]
