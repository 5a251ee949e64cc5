"""Chunk borders and line windows against plain loops written from their descriptions; archives; BLEU by hand."""

import io
import math
import random
import tarfile

import numpy as np
import pytest

from corpusloom.operators import bleu, chunking
from corpusloom.sources import snapshots


def plain_chunks(text, most):
    """Paragraphs, split where too long, merged while two neighbours fit."""
    units, now = [], ""
    for line in text.splitlines(keepends=True) if text.isascii() else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else []):
        now += line
        if not line.strip():
            units.append(now)
            now = ""
    units = [u for u in [*units, now] if u]
    parts = []
    for u in units:
        while len(u.encode()) > most:
            n = max((k for k in range(1, len(u)) if u[k - 1] == "\n" and len(u[:k].encode()) <= most), default=0)
            n = n or max(k for k in range(1, len(u)) if len(u[:k].encode()) <= most)
            parts.append(u[:n])
            u = u[n:]
        parts.append(u)
    out = []
    for p in parts:
        if out and len((out[-1] + p).encode()) <= most:
            out[-1] += p
        else:
            out.append(p)
    return out


def test_chunks(spark):
    rng = random.Random(3)
    texts = ["", "a", "\n\n", "one\n\ntwo\n", "x" * 500, "é漢😀" * 60, "a b\n" * 80]
    for _ in range(60):
        texts.append("".join(rng.choice(["word ", "line\n", "\n", "  \n", "é漢 ", "long" * 9, "\n\n"]) for _ in range(rng.randint(1, 80))))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None)], "doc_id long, text string")
    for most in (40, 90):
        got = {}
        for r in chunking.chunk_text(docs, most).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append(r)
        for i, t in enumerate(texts):
            mine = got.get(i, [])
            assert [r.chunk for r in mine] == plain_chunks(t, most)
            at = 0
            for r in mine:
                n = len(r.chunk.encode())
                assert (r.byte_start, r.byte_end, r.total_chunks) == (at, at + n, len(mine)) and n <= most
                assert r.line_start == t.encode()[:at].count(b"\n") + 1 and r.line_end == t.encode()[: at + n - 1].count(b"\n") + 1
                at += n


def test_line_windows_cover_and_overlap():
    rng = random.Random(5)
    for _ in range(200):
        sizes = np.array([rng.randint(1, 60) for _ in range(rng.randint(1, 60))])
        target = rng.choice([20, 100, 400])
        ranges = chunking.window_lines(sizes, target, 0.2)
        assert ranges[0][0] == 0 and ranges[-1][1] == sizes.size
        for (a, b), (c, d) in zip(ranges, ranges[1:], strict=False):
            n = sizes[a:b].sum()
            assert a < c <= b and (n <= target or b == a + 1) and (b == sizes.size or n + sizes[b] > target)
            need = max(round(float(n) * 0.2), 1)
            if c < b:
                assert sizes[c:b].sum() >= need or c == a + 1
                assert sizes[c + 1 : b].sum() < need
            else:
                assert b == a + 1


def archive(names):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in names:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "README.md"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(archive([("./root/src/a.py", b"print('hi')"), ("root/README.md", b"hello"), ("root/link", None), ("top.txt", b"")]))
    got = snapshots.read_archives(spark, f"{tmp_path}/a.tar.gz").orderBy("path").collect()
    assert [(r.path, r["size"], bytes(r.content)) for r in got] == [("README.md", 5, b"hello"), ("src/a.py", 11, b"print('hi')")]
    bad = {"up": [("r/../escape", b"x")], "abs": [("/r/x", b"x")], "two": [("r/x", b""), ("s/x", b"")], "twice": [("r/x", b""), ("r/x", b"")], "none": [("r/l", None)]}
    for name, entries in bad.items():
        (tmp_path / f"{name}.tar").write_bytes(archive(entries))
        with pytest.raises(Exception, match="unsafe|root|duplicate|no files"):
            snapshots.read_archives(spark, f"{tmp_path}/{name}.tar").collect()
    manifest = spark.createDataFrame([(r.path, r["size"], r.sha256) for r in got], "path string, size long, sha256 string")
    entries = snapshots.read_archives(spark, f"{tmp_path}/a.tar.gz")
    assert snapshots.differences(entries, manifest).count() == 0 and snapshots.differences(entries, manifest.limit(1)).count() == 1
    (tmp_path / "m.json").write_text('{"version": 1, "files": [{"path": "a", "size": 1, "sha256": "x"}]}')
    assert snapshots.read_manifest(spark, f"{tmp_path}/m.json").collect()[0].path == "a"


def test_manifests_are_published_and_verified(spark, tmp_path, monkeypatch):
    (tmp_path / "a.tar.gz").write_bytes(archive([("r/b.py", b"bb"), ("r/a.py", b"a"), ("r/c/d", b"")]))
    for batch in (1, 16 << 20):  # members come in batches of any size
        monkeypatch.setattr(snapshots, "BATCH", batch)
        entries = snapshots.read_archives(spark, f"{tmp_path}/a.tar.gz")
        assert snapshots.publish_manifest(entries, f"{tmp_path}/manifest") == (3, 3)
    assert [(r.path, r["size"]) for r in snapshots.read_manifest(spark, f"{tmp_path}/manifest").collect()] == [("a.py", 1), ("b.py", 2), ("c/d", 0)]
    assert snapshots.verified(spark, f"{tmp_path}/a.tar.gz", f"{tmp_path}/manifest").count() == 3
    (tmp_path / "b.tar.gz").write_bytes(archive([("r/b.py", b"bx"), ("r/a.py", b"a"), ("r/c/d", b"")]))
    with pytest.raises(ValueError, match="snapshot_manifest_mismatch"):
        snapshots.verified(spark, f"{tmp_path}/b.tar.gz", f"{tmp_path}/manifest")
    with pytest.raises(ValueError, match="empty_archive"):
        snapshots.publish_manifest(entries.limit(0), f"{tmp_path}/none")


def test_files_are_loaded_with_a_reason(spark):
    rows = [("a.py", 3, b"abc"), ("../x", 1, b"a"), ("b", 1, b" "), ("c", 23, b"# Code generated by x.\n"), ("d", 2, b"\xff\xfe"), ("e", 5, b"abc"), ("f", None, None)]
    got = {r.path: (r.text, r.reason) for r in snapshots.loaded(spark.createDataFrame(rows, "path string, size long, content binary"), 99).collect()}
    assert got["a.py"] == ("abc", None) and got["b"] == (" ", "empty_file") and got["c"][1] == "generated_file"
    assert [got[k] for k in ("../x", "d", "e")] == [(None, "unsafe_path"), (None, "invalid_utf8"), (None, "manifest_size_mismatch")] and got["f"][0] is None


def test_file_problems(spark):
    rows = [("a.py", 3, b"abc"), ("../x", 1, b"a"), ("a\\b", 1, b"a"), ("", 0, b""), ("/x", 1, b"a"), ("b", 4, b"abc"), ("c", 2, b"\xff\xfe"), ("d", 9, b"123456789")]
    t = spark.createDataFrame(rows, "path string, size long, content binary")
    got = [r[0] for r in t.select(snapshots.file_problem(t.path, t["size"], t.content, 5)).collect()]
    assert got == [None, "unsafe_path", "unsafe_path", "unsafe_path", "unsafe_path", "manifest_size_mismatch", "invalid_utf8", "file_too_large_for_chunking"]


def test_bleu_by_hand():
    assert bleu.sentence_bleu("a b c d e", "a b c d e") == 1.0
    assert bleu.sentence_bleu("", "a") == bleu.sentence_bleu("x y", "a b") == 0.0
    # 4 of 5 words, 3 of 4 pairs, 2 of 3 and 1 of 2; equally long
    assert math.isclose(bleu.sentence_bleu("a b c d x", "a b c d e"), (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25)
    assert math.isclose(bleu.sentence_bleu("a b c d", "a b c d e"), math.exp(1 - 5 / 4))
