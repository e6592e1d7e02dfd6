"""A tree of files as a table and as a stream of created and modified files."""

import hashlib
import os
import time

from weftgraph.sources import tree
from weftgraph.streaming import changes, gate


def put(root, path, text, ago=10):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(text.encode() if isinstance(text, str) else text)
    then = time.time() - ago
    os.utime(file, (then, then))


def test_which_files_count(spark, tmp_path):
    for path in ("a.py", "__init__.py", "pkg/b.py", "pkg/__pycache__/c.py", ".git/d.py", ".hidden/e.py", "node_modules/f.py", "venv/g.py", "pkg/h.txt", "x/y/z/.i.py"):
        put(tmp_path, path, f"# {path}")
    paths = lambda df: sorted(r["path"] for r in df.collect())
    assert paths(tree.source_tree(spark, str(tmp_path))) == [".hidden/e.py", "__init__.py", "a.py", "pkg/b.py", "venv/g.py", "x/y/z/.i.py"]
    assert paths(tree.source_tree(spark, f"file://{tmp_path}", skipped=tree.SKIPPED_BEFORE, dot_folders=False)) == ["__init__.py", "a.py", "pkg/b.py", "x/y/z/.i.py"]
    assert paths(tree.source_tree(spark, f"{tmp_path}/missing")) == []
    row = tree.source_tree(spark, str(tmp_path)).where("path = 'pkg/b.py'").first()
    assert row["source"] == "# pkg/b.py" and row["checksum"] == hashlib.sha256(b"# pkg/b.py").hexdigest()


def test_shares_of_a_large_folder(spark, tmp_path, monkeypatch):
    for i in range(40):
        put(tmp_path, f"big/f{i}.py", str(i))
        put(tmp_path, f"d{i % 7}/g{i}.py", str(i))
    put(tmp_path, "bad.py", b"\xff\xfe text")
    monkeypatch.setattr(tree, "FILES_A_TASK", 9)
    reader = tree.TreeReader({"path": str(tmp_path)})
    tasks = reader.partitions()
    assert len(tasks) > 8 and sum(t.shares > 1 for t in tasks) == 5
    found = sorted(b.column(0)[0].as_py() for t in tasks for b in reader.read(t))
    assert found == sorted(["bad.py", *[f"big/f{i}.py" for i in range(40)], *[f"d{i % 7}/g{i}.py" for i in range(40)]])


def test_created_modified_and_unchanged(spark, tmp_path):
    """Three starts of one stream: each hands on what changed since; touched files without a change stop at the gate."""
    root, out = tmp_path / "repo", str(tmp_path / "out")

    def run(settle=0, out=out):
        stream = tree.source_changes(spark, str(root), settle=settle)
        return sorted((r["path"], r["source"]) for r in changes.written_stream(stream, "tree", path=out).collect())

    put(root, "a.py", "1", ago=100)
    put(root, "sub/b.py", "1", ago=90)
    put(root, "sub/c.txt", "no", ago=90)
    assert run() == [("a.py", "1"), ("sub/b.py", "1")]
    put(root, "a.py", "2", ago=0)  # modified
    put(root, "new/d.py", "1", ago=0)  # created
    put(root, ".cache/e.py", "1", ago=0)
    second = run()
    assert second == [("a.py", "1"), ("a.py", "2"), ("new/d.py", "1"), ("sub/b.py", "1")]
    (root / "new/d.py").unlink()  # a deletion brings nothing back
    assert run() == second
    put(root, "sub/b.py", "2", ago=0)
    assert run(60_000, str(tmp_path / "settled")) == []  # a.py and sub/b.py changed less than a minute ago
    assert run() == sorted([*second, ("sub/b.py", "2")])


def test_tree_to_gate(spark, tmp_path):
    """Changes of files through the gate: a file that is written anew with the same content is no change.

    Each start is one micro-batch, and what it reads is settled by the next one.
    """
    root, out = tmp_path / "repo", str(tmp_path / "out")

    def run():
        found = changes.as_file_changes(tree.source_changes(spark, str(root), settle=0))
        return [r["path"] for r in changes.written_stream(gate.settled(found, gap=0, late=0), "tree", path=out).orderBy("ts").collect()]

    put(root, "a.py", "1", ago=100)
    put(root, "b.py", "1", ago=90)
    assert run() == []
    put(root, "a.py", "1", ago=0)
    put(root, "b.py", "2", ago=0)
    assert run() == ["a.py", "b.py"]
    assert run() == ["a.py", "b.py", "b.py"]
