"""Folder scans against a plain walk, in batch and as a stream."""

import hashlib
import os
import time

import pytest

import sourceloom as sl
from sourceloom.sources import listing
from sourceloom.sources.files import scan_files
from tests.test_java import FOO, N


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for folder in ("_x", ".git/deep", "a b/_generated/c", "empty"):
        (root / folder).mkdir(parents=True)
    (root / "_x" / ".a.java").write_text(FOO)
    (root / ".git" / "deep" / "Foo.JAVA").write_text(N)
    (root / "a b" / "_generated" / "c" / "%20 é.java").write_text("class Odd { }")
    (root / "a b" / "_generated" / "_Blank.java").write_text("")
    (root / "N.java").write_text(N)
    (root / "readme.txt").write_text("class NotJava { }")
    (root / ".java").write_text("class Bare { }")
    os.symlink(root / "N.java", root / "Link.java")
    os.symlink(root, root / "empty" / "loop")
    return root


def walked(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.lower().endswith(".java"):
                path = os.path.join(folder, name)
                with open(path, "rb") as file:
                    found[path] = hashlib.md5(file.read()).hexdigest()
    return found


def hashes(store):
    return {r.file_path: r.hash for r in store.file_hashes().collect()}


@pytest.mark.parametrize("folders", [1, 500])
def test_scan_matches_a_walk(spark, tree, monkeypatch, folders):
    monkeypatch.setattr(listing, "FOLDERS", folders)
    got = {r.file_path: hashlib.md5(bytes(r.content)).hexdigest() for r in scan_files(spark, str(tree)).collect()}
    assert got == walked(tree) and len(got) == 7
    sizes = {r.file_path: (r.size, r.modified) for r in listing.list_files(spark, f"file://{tree}/", ".java").collect()}
    assert sizes == {p: (os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in got}


def test_roots(spark, tree, tmp_path):
    assert scan_files(spark, str(tree / "N.java")).count() == 1
    assert scan_files(spark, str(tree / "readme.txt")).count() == 0
    assert scan_files(spark, str(tree / "empty")).count() == 0
    with pytest.raises(FileNotFoundError):
        scan_files(spark, str(tmp_path / "nothing"))


def test_counters_and_hashes_in_batch(spark, tree, tmp_path):
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    sl.index_folder(store, str(tree))
    row = store.runs().first()
    assert (row.discovered, row.skipped, row.processed) == (7, 0, 7) and hashes(store) == walked(tree)
    sl.index_folder(store, str(tree))
    row = store.runs().where("run = 2").first()
    assert (row.discovered, row.skipped, row.processed) == (7, 7, 0)


def test_stream_sees_hidden_empty_and_rewritten_files(spark, tree, tmp_path):
    store = sl.CorpusStore(spark, str(tmp_path / "store"))

    def run(**options):
        sl.index_stream(store, str(tree), str(tmp_path / "checkpoint"), **options).awaitTermination()

    run(max_files_per_batch=3)
    assert hashes(store) == walked(tree) and store.last_run() == 3
    (tree / "N.java").write_text(N.replace("a()", "zz()"))
    (tree / "_x" / ".a.java").write_text("")
    run(max_files_per_batch=3)
    # The link to the rewritten file has changed as well.
    assert hashes(store) == walked(tree) and store.runs().where("run = 4").first().processed == 3
    run()
    assert store.last_run() == 4


def test_stream_that_goes_on(spark, tree, tmp_path):
    store = sl.CorpusStore(spark, str(tmp_path / "store"))
    query = sl.index_stream(store, str(tree), str(tmp_path / "checkpoint"), processingTime="1 second")
    try:
        for wanted in ("class Later { }", "class Later2 { }"):
            (tree / "Later.java").write_text(wanted)
            end = time.monotonic() + 90
            while hashes(store) != walked(tree) and time.monotonic() < end and query.isActive:
                time.sleep(1)
            assert hashes(store) == walked(tree), query.exception()
    finally:
        query.stop()


def test_file_that_goes_away(spark, tree):
    listed = listing.list_files(spark, str(tree), ".java")
    (tree / ".java").unlink()
    assert listing.read_files(listed, missing_ok=True).count() == 6
    with pytest.raises(Exception, match="java"):
        listing.read_files(listed).collect()
