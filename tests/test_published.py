"""Publishing snapshots: twice, with a failure between, with files shared and then dropped; readers see whole snapshots."""

import random

import pytest

from corpusloom.operators.sourcecode import Options
from corpusloom.sources import published
from corpusloom.sources.published import ChunkStore

SCHEMA = "path string, text string, status string"
ONE = [("a.py", "def a\n\nimport b\n" * 30, "c"), ("b/c.zz", "text only", "c"), ("dist/x.py", "def skipped", "c"), ("e.py", "  \n", "c"), ("n.py", None, "c"), (None, "no path", "c")]
TWO = [("a.py", "def a\n\nimport b\n" * 30, "c"), ("b/c.zz", "changed text", "c"), ("new.rs", "fn main() {\n}\n", "c")]


def state(store, snapshot):
    return sorted(map(tuple, store.members(snapshot).collect()), key=str), sorted(map(tuple, store.chunks(snapshot).collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"file://{tmp_path}/store", Options(most=200))


def test_publish_and_publish_again(spark, store):
    one = spark.createDataFrame(ONE, SCHEMA)
    assert store.publish("one", one) == {"succeeded": 2, "skipped": 3, "failed": 0, "chunks": state(store, "one")[1].__len__(), "reused": 0}
    members, chunks = state(store, "one")
    assert {m[0]: (m[1], m[2]) for m in members} == {
        "a.py": ("succeeded", None), "b/c.zz": ("succeeded", None), "dist/x.py": ("skipped", "generated_or_dependency_path"), "e.py": ("skipped", "empty_file"), "n.py": ("skipped", "empty_file")
    }
    assert "".join(c[9] for c in sorted((c for c in chunks if c[1] == "a.py"), key=lambda c: c[4])) == ONE[0][1] and len({c[3] for c in chunks}) == len(chunks)
    counts = store.publish("one", one)  # a replay
    assert counts["chunks"] == 0 and counts["reused"] == 2
    again = state(store, "one")
    assert again[1] == chunks and [m[:5] for m in again[0]] == [m[:5] for m in members]
    assert store.manifest().number == 2


def test_a_publish_that_dies_changes_nothing(spark, store, monkeypatch):
    store.publish("one", spark.createDataFrame(ONE, SCHEMA))
    before = state(store, "one")

    def dies(change):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(store, "_commit", dies)
        store.publish("one", spark.createDataFrame(TWO, SCHEMA))
    assert state(store, "one") == before and store.manifest().number == 1
    store.publish("one", spark.createDataFrame(TWO, SCHEMA))
    assert {m[0] for m in state(store, "one")[0]} == {"a.py", "b/c.zz", "new.rs"}
    assert store.collect_garbage() == 1  # the first b/c.zz; the folders of the lost publish go too
    folders = [s.getPath().getName() for s in store._fs.listStatus(store._path(f"{store.folder}/members"))]
    assert len(folders) == 1


def test_files_are_shared_until_no_snapshot_has_them(spark, store):
    store.publish("one", spark.createDataFrame(ONE, SCHEMA))
    assert store.publish("two", spark.createDataFrame(TWO, SCHEMA))["reused"] == 1
    two = state(store, "two")
    store.drop("one")
    assert store.collect_garbage() == 1 and state(store, "two") == two and list(store.manifest().snapshots) == ["two"]
    assert store.collect_garbage() == 0
    store.drop("two")
    assert store.collect_garbage() == len(two[1]) and store._chunks(store.manifest()).count() == 0


def test_a_snapshot_without_chunked_files_is_not_published(spark, store):
    for rows in ([("dist/x.py", "def a", "c")], []):
        with pytest.raises(ValueError, match="no_chunkable_files"):
            store.publish("none", spark.createDataFrame(rows, SCHEMA))
    assert store.manifest().number == 0


def test_two_publishers_both_get_in(spark, store):
    """The second commits between the first's look at the manifest and its rename: its number is taken and it goes on from there."""
    real, other = store.manifest, ChunkStore(spark, store.folder, Options(most=200))
    state_ = {"raced": False}

    def late():
        now = real()
        if state_.pop("armed", False):
            state_["raced"] = True
            other._commit(lambda m: m)
        return now

    store.manifest = late
    commit = store._commit

    def armed(change):
        state_["armed"] = True
        return commit(change)

    store._commit = armed
    store.publish("one", spark.createDataFrame(ONE, SCHEMA))
    assert state_["raced"] and real().number == 2 and list(real().snapshots) == ["one"]


def test_what_does_not_fit_is_told(spark, tmp_path):
    tight = ChunkStore(spark, f"file://{tmp_path}/t", Options(most=128), budget=140)
    counts = tight.publish("one", spark.createDataFrame([("a.zz", "short", "c"), ("long/name/of/" + "x" * 90 + ".zz", "word " * 60, "c")], SCHEMA))
    assert counts["failed"] == 1 and {m[2] for m in state(tight, "one")[0]} == {None, "embedding_input_too_large"}


def test_texts_are_kept_once(spark, store, monkeypatch):
    """A chunk's text isn't written again with its context, nor stored beside the chunks; folders without garbage stay as they are."""
    kept, real = [], published.stored
    monkeypatch.setattr(published, "stored", lambda df: kept.extend(df.columns) or real(df))
    rng = random.Random(4)
    text = lambda: "".join(f"{rng.getrandbits(256):064x}\n" for _ in range(300))
    files = [(f"f{i}.zz", text(), "c") for i in range(40)]
    store.publish("one", spark.createDataFrame(files, SCHEMA))
    size = store._fs.getContentSummary(store._path(store.folder)).getLength()
    assert "text" not in kept and size < 1.1 * sum(len(f[1]) for f in files)
    two = [*files[:30], *((p, t + "more\n", s) for p, t, s in files[30:])]
    assert store.publish("two", spark.createDataFrame(two, SCHEMA))["reused"] == 30
    store.drop("one")
    before, state_ = store.manifest().chunks, state(store, "two")
    assert store.collect_garbage() > 0 and state(store, "two") == state_
    after = store.manifest().chunks
    assert len(after) == 2 and after[0] != before[0] and after[1] == before[1]
    assert store.collect_garbage() == 0 and store.manifest().chunks == after
    assert not list(store._fs.listStatus(store._path(f"{store.folder}/work")))
    parts = {}
    for c in sorted(state_[1], key=lambda c: c[4]):
        assert c[10].endswith(c[9]) and len(c[10].encode()) == c[11]
        parts[c[1]] = parts.get(c[1], "") + c[9]
    assert parts == {p: t for p, t, _ in two}


def test_chunks_written_with_their_context_are_read(spark, store):
    store.publish("one", spark.createDataFrame(ONE, SCHEMA))
    before, m = state(store, "one"), store.manifest()
    store._chunks(m).write.parquet(f"{store.folder}/chunks/older")  # has all of contextualized
    store._commit(lambda m: published.Manifest(m.number, m.snapshots, [f"{store.folder}/chunks/older"]))
    assert state(store, "one") == before
    store.publish("two", spark.createDataFrame(TWO, SCHEMA))
    two = state(store, "two")
    store.drop("one")
    assert store.collect_garbage() == 1 and state(store, "two") == two


def test_a_file_in_two_folders_is_kept_once(spark, store):
    """Two publishers had the same file at once."""
    store.publish("one", spark.createDataFrame(ONE, SCHEMA))
    one, m = state(store, "one"), store.manifest()
    store._chunks(m).write.parquet(f"{store.folder}/chunks/again")
    store._commit(lambda m: published.Manifest(m.number, m.snapshots, [*m.chunks, f"{store.folder}/chunks/again"]))
    assert store.collect_garbage() == len(one[1]) and state(store, "one") == one
