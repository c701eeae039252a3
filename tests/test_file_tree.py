"""Every file is listed, whatever its name, on the executors."""

import os

from peerscope.sources import file_tree
from peerscope.sources.corpus import build_corpus, scan_corpus


def _write(root, rel, text="text"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_hidden_names_are_found_with_their_authors(spark, tmp_dir):
    for rel in ("a/_draft.pdf", "_b/y.pdf", ".c/z.pdf", "d/x.pdf", ".top.pdf", "d/_deep/.er/w.pdf", "d/no.txt", "d/q.PDF"):
        _write(tmp_dir, rel)
    got = sorted((r.author, r.paper) for r in scan_corpus(spark, tmp_dir).collect())
    assert got == [(".", ".top.pdf"), (".c", "z.pdf"), ("_b", "y.pdf"), ("a", "_draft.pdf"), ("d", "w.pdf"), ("d", "x.pdf")]


def test_the_driver_lists_the_root_only(tmp_dir, monkeypatch):
    for i in range(40):
        _write(tmp_dir, f"author {i}/deep/deeper/p.pdf")
    asked = []
    listed = file_tree.LocalFolders.entries
    monkeypatch.setattr(file_tree.LocalFolders, "entries", lambda self, f: asked.append(f) or listed(self, f))
    reader = file_tree.FileTreeReader("file:" + tmp_dir, "*.pdf", 7)
    parts = reader.partitions()
    assert asked == [tmp_dir] and len(parts) == 7
    found = [row for p in parts for row in reader.read(p)]
    assert len(found) == 40 and len({r[0] for r in found}) == 40


def test_partitions_walk_many_folders(spark, tmp_dir):
    for i in range(300):
        _write(tmp_dir, f"f{i % 30}/g{i}/x.pdf")
    files = file_tree.list_files(spark, tmp_dir, "*.pdf", tasks=9)
    assert files.rdd.getNumPartitions() == 9 and files.count() == 300
    assert file_tree.list_files(spark, tmp_dir, "*.doc").count() == 0


def test_empty_root_and_links(spark, tmp_dir):
    assert file_tree.list_files(spark, tmp_dir).count() == 0
    _write(tmp_dir, "real/x.pdf")
    os.symlink(os.path.join(tmp_dir, "real"), os.path.join(tmp_dir, "linked"))
    os.symlink(os.path.join(tmp_dir, "real", "x.pdf"), os.path.join(tmp_dir, "real", "y.pdf"))
    os.symlink(os.path.join(tmp_dir, "nowhere.pdf"), os.path.join(tmp_dir, "real", "gone.pdf"))
    names = sorted(r.path.rsplit("/", 2)[-2:] for r in file_tree.list_files(spark, tmp_dir, "*.pdf").collect())
    assert names == [["real", "gone.pdf"], ["real", "x.pdf"], ["real", "y.pdf"]]
    errors = [r.read_error for r in scan_corpus(spark, tmp_dir).collect()]
    assert sum(e is not None for e in errors) == 1


def test_what_cannot_be_read_is_a_failed_document(spark, tmp_dir, monkeypatch):
    _write(tmp_dir, "a/ok.pdf", "Graph paper")
    listing = file_tree.list_files(spark, "file:" + tmp_dir, "*.pdf")
    lost = listing.selectExpr("concat(path, '.gone') AS path", "length", "error").unionByName(
        listing.selectExpr("path", "CAST(NULL AS long) AS length", "'PermissionError: denied' AS error"))
    rows = file_tree.read_files(lost, "file:" + tmp_dir).collect()
    assert sorted(r.error.split(":")[0] for r in rows) == ["FileNotFoundError", "PermissionError"]
    assert all(r.content is None for r in rows)

    from peerscope.sources import corpus as module
    monkeypatch.setattr(module, "list_files", lambda *a: listing.unionByName(lost))
    kept, failed = build_corpus(spark, tmp_dir)
    assert [r.processed_text for r in kept.collect()] == ["graph paper"]
    assert sorted(r.reason for r in failed.collect()) == ["unreadable", "unreadable"]
