"""Files below a folder, listed by tasks, against a plain walk."""

import os

from pyspark.sql import functions as F

from codeterra.sources import git
from codeterra.sources.folder import FolderReader, FolderSource


def make(root):
    for k in range(60):
        folder = os.path.join(root, f"a{k % 3}", f"b{k % 7}" if k % 4 else "", "c" if k % 5 == 0 else "")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"f{k}.ts"), "w") as f:
            f.write("x" * k)
    os.makedirs(os.path.join(root, "a0", "node_modules", "in"))
    os.makedirs(os.path.join(root, "empty"))
    for name in ("a0/node_modules/in/x.ts", "a0/y.min.js", "a0.txt", "ünï.md", ".env", "new\nline.py"):
        with open(os.path.join(root, name), "w") as f:
            f.write("text")
    os.symlink(os.path.join(root, "a1"), os.path.join(root, "link"))
    os.symlink(os.path.join(root, "a0.txt"), os.path.join(root, "a2", "link.txt"))


def walked(root):
    """In os.walk's order: a folder's files, then its folders."""
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(f for f in folders if f != "node_modules" and not os.path.islink(os.path.join(folder, f)))
        for name in sorted(files):
            full = os.path.join(folder, name)
            if not os.path.islink(full) and not name.endswith(".min.js"):
                yield os.path.relpath(full, root), os.path.getsize(full)


def test_as_a_walk_finds_them(spark, tmp_path):
    root = str(tmp_path)
    make(root)
    want = list(walked(root))
    spark.dataSource.register(FolderSource)
    for folders in (1, 4, 256):  # dealt whole, some opened, all opened
        found = spark.read.format("repository_folder").option("folders", folders).load(root)
        assert sorted(map(tuple, found.collect())) == sorted(want)
        assert FolderReader(root, folders).partitions()[0].folder == ""
    assert {tuple(r) for r in git.listed(spark, root, 17).collect()} == set(want[:17])  # the first of the walk
    read = {r["path"]: (r["bytes"], r["n"]) for r in git.tree(spark, root, max_bytes=50).select("path", "bytes", F.length("content").alias("n")).collect()}
    assert read == {path: (size, size if size <= 50 else None) for path, size in want}


def test_names_that_are_not_utf8_and_nothing_at_all(spark, tmp_path):
    assert git.tree(spark, str(tmp_path)).count() == 0
    with open(os.path.join(os.fsencode(tmp_path), b"\xff.py"), "w") as f:
        f.write("x")
    (tmp_path / "ok.py").write_text("y")
    assert [r["path"] for r in git.tree(spark, str(tmp_path)).collect()] == ["ok.py"]
