"""The stored index: ranges of paths, changes and marks, merging, writers beside each other, and refreshes that write what differs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.operators import index as ix
from mediasift.plans.media_index import MediaIndex
from mediasift.sources import store as st
from mediasift.sources.store import INDEX, IndexStore
from test_codecs import png_file


def rows_of(spark, rows):
    return spark.createDataFrame([(p, 1.0, 1, "h", [float(v)], d) for p, v, d in rows], INDEX)


def content(df):
    return {r["filepath"]: (r["vector"][0], r["deleted"]) for r in df.collect()}


@pytest.fixture
def many(spark, tmp_path, monkeypatch):
    """An index whose base has files of ten rows each."""
    monkeypatch.setattr(st, "FILE_ROWS", 10)
    store = IndexStore(spark, f"file://{tmp_path}/index")
    store.write(rows_of(spark, [(f"/lib/{'AbCd'[i // 25]}/{i:03d}.jpg", i, None) for i in range(100)]))
    return store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scope_is_pushed_down_and_skips_files(many):
    m = many.manifest()
    assert len(m["base"]) >= 10 and sum(f[3] for f in m["base"]) == 100
    found = many.read(scope="/lib/b")
    assert sorted(content(found)) == [f"/lib/b/{i:03d}.jpg" for i in range(25, 50)]
    assert "StringStartsWith(path_key,/lib/b/)" in plan(found)
    assert len(found.inputFiles()) == len(many.files(m, "/lib/b")[0]) < len(m["base"]) / 2
    assert content(many.read(scope="/LIB/A")) == content(many.read(scope="/lib/a")) and len(content(many.read(scope="/lib/a"))) == 25
    assert content(many.read(scope="/lib/a", case_sensitive=True)) == {} and len(content(many.read(scope="/lib/A", case_sensitive=True))) == 25
    assert content(many.read(scope="/none")) == {} and many.files(m, "/none") == [[]]
    assert content(many.read(path="/lib/b/030.jpg")) == {"/lib/b/030.jpg": (30.0, None)}
    assert sum(map(len, many.files(m, path="/lib/b/030.jpg"))) == 1
    # vectors are not read where they are not asked for
    assert "vector" not in plan(many.read(scope="/lib/b").select("filepath", "size")).split("ReadSchema:")[1]


def test_changes_and_marks_are_merged_in(spark, many, monkeypatch):
    want = {k: v for k, v in content(many.read()).items()}
    rng, n = np.random.default_rng(0), 0
    monkeypatch.setattr(st, "MOST_CHANGES", 3)
    merges = 0
    for _ in range(12):
        paths = sorted(rng.choice([f"/lib/b/{i:03d}.jpg" for i in range(25, 60)], 4, replace=False))
        rows = {p: float(1000 + n) for p in paths[:2]}
        marks = {p: bool(rng.integers(2)) or None for p in paths[2:]}
        n += 1
        before = many.manifest()
        many.add(rows_of(spark, [(p, v, None) for p, v in rows.items()]), marks=spark.createDataFrame(list(marks.items()), "filepath string, deleted boolean"))
        want |= {p: (v, None) for p, v in rows.items()}
        want |= {p: (want[p][0], d) for p, d in marks.items() if p in want}
        assert content(many.read()) == want
        assert content(many.read(scope="/lib/b")) == {p: v for p, v in want.items() if p.startswith("/lib/b/")}
        after = many.manifest()
        if not after["changes"]:
            merges += 1
            # files that no change overlaps stay as they are
            kept = {f[0] for f in before["base"]} & {f[0] for f in after["base"]}
            assert any(f[1].startswith("/lib/a") for f in after["base"] if f[0] in kept) and any(f[1].startswith("/lib/d") for f in after["base"] if f[0] in kept)
            assert sum(f[3] for f in after["base"]) == len(want)
            bounds = [(f[1], f[2]) for f in after["base"]]
            assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert merges >= 2
    many.add(marks=spark.createDataFrame([("/lib/nowhere.jpg", True)], "filepath string, deleted boolean"))
    assert content(many.read()) == want


def test_cases_of_one_path_survive_merging(spark, many, monkeypatch):
    monkeypatch.setattr(st, "FILE_ROWS", 1)
    monkeypatch.setattr(st, "MOST_SHARE", 0.0)
    store = IndexStore(spark, many.root + "-2")
    store.write(rows_of(spark, [(p, i, None) for i, p in enumerate(("/a/X.jpg", "/a/x.jpg", "/a/y.jpg", "/b/z.jpg"))]))
    store.add(rows_of(spark, [("/a/x.jpg", 9, None), ("/A/x.jpg", 8, None)]))
    assert content(store.read()) == {"/a/X.jpg": (0.0, None), "/a/x.jpg": (9.0, None), "/a/y.jpg": (2.0, None), "/b/z.jpg": (3.0, None), "/A/x.jpg": (8.0, None)}
    assert len(content(store.read(path="/a/X.JPG"))) == 3 and not store.manifest()["changes"]


def test_writers_beside_each_other(spark, many, tmp_path, monkeypatch):
    other = IndexStore(spark, many.root)
    held = other.hold(rows_of(spark, [("/lib/new.jpg", 7, None)]))
    seen = other.manifest()
    for k in range(3):
        many.add(rows_of(spark, [(f"/lib/k{k}.jpg", k, None)]))
    assert held.count() == 1  # another writer's rows stay
    with pytest.raises(st.Conflict):
        other.add(held, based_on=seen)
    assert other.add(held, batch=("s", 4)) and not other.add(held, batch=("s", 4)) and not other.add(held, batch=("s", 3)) and other.add(batch=("t", 0))
    assert other.manifest()["batches"] == {"s": 4, "t": 0} and len(content(other.read())) == 104
    other.release()
    assert not list((tmp_path / "index").glob("held-*"))
    monkeypatch.setattr(st, "GRACE_SECONDS", -1)
    many.hold(held.limit(0))
    many.add(rows_of(spark, [("/lib/last.jpg", 1, None)]))
    kept = {f[0].split("/")[0] for v in (0, -1) for part in (lambda m: [m["base"], *m["changes"]])(many.manifest(many.manifest()["version"] + v)) for f in part}
    assert {p.name for p in (tmp_path / "index").glob("rows-*")} == kept and not list((tmp_path / "index").glob("held-*"))


def test_delta_equals_refresh(spark):
    index = rows_of(spark, [("/a/same", 1, None), ("/a/gone", 2, None), ("/b/out", 3, None), ("/a/dead", 4, True), ("/a/fails", 5, None), ("/a/gone-before", 6, True)])
    listing = spark.createDataFrame([("/a/same", 1.0, 1, "h"), ("/a/dead", 1.0, 1, "h"), ("/a/fails", 2.0, 1, "bad"), ("/a/new", 1.0, 1, "n"), ("/a/copy", 1.0, 1, "h"), ("/a/none", 1.0, 1, "empty")], "filepath string, modified_at double, size long, hash string")
    by_path = {r["filepath"]: r["hash"] for r in listing.collect()}
    look = F.create_map(*[F.lit(x) for kv in by_path.items() for x in kv])
    load = lambda r: r.withColumn("hash", look[F.col("filepath")]).where("hash <> 'bad'")
    encode = lambda r: r.withColumn("vector", F.when(F.col("hash") != "empty", F.array(F.lit(9.0).cast("float"))))
    for restore in (True, False):
        want = content(ix.refresh(listing, index, "/a", load, encode, restore_deleted=restore))
        rows, marks, counts = ix.delta(listing.drop("hash"), index, "/a", load, encode, restore_deleted=restore)
        got = content(index)
        got |= {r["filepath"]: (got[r["filepath"]][0], r["deleted"]) for r in marks.collect()}
        got |= content(rows)
        assert got == want
        assert counts == {"visited": 6, "gone": 1, "restored": int(restore), "unchanged": 2, "new": 3, "changed": 1, "written": 2, "marked": 2 + restore}
    nothing = ix.delta(listing.limit(0), index.where("filepath = '/b/out'"), "/a", load, encode)
    assert nothing[:2] == (None, None) and set(nothing[2].values()) == {0}


def test_refresh_writes_what_differs(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    draw = lambda name, colour: (lib / name).write_bytes(png_file(4, 4, 8, 2, b"".join(b"\0" + bytes(colour) * 4 for _ in range(4))))
    for i in range(20):
        draw(f"p{i:02d}.png", (i * 12, 255 - i * 12, 40))
    index = MediaIndex(spark, f"file://{tmp_path}/index", lambda: lambda x: x.mean(axis=(2, 3)) + 3, lambda q: [1.0, 0.0, 0.0])
    data = lambda: {p.name for p in (tmp_path / "index").glob("rows-*/*.parquet")}
    index.refresh(str(lib))
    assert index.counts == {"visited": 20, "gone": 0, "restored": 0, "unchanged": 0, "new": 20, "changed": 0, "written": 20, "marked": 0, "skipped": 0}
    first, version = data(), index.store.manifest()["version"]
    index.refresh(str(lib))
    assert data() == first and index.store.manifest()["version"] == version and index.counts["unchanged"] == 20 and index.counts["written"] == 0
    draw("p03.png", (1, 2, 3))
    (lib / "p04.png").unlink()
    (lib / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nbad")
    index.refresh(str(lib))
    assert {k: v for k, v in index.counts.items() if v} == {"visited": 20, "gone": 1, "unchanged": 18, "new": 1, "changed": 1, "written": 1, "marked": 1, "skipped": 1}
    change = index.store.manifest()["changes"]
    assert [sum(f[3] for f in c) for c in change] == [2]
    assert index.store.read().where("deleted").count() == 1 and index.store.read().count() == 20
    draw("p04.png", (48, 207, 40))
    index.refresh(str(lib))
    assert index.store.read().where("deleted").count() == 0 and not list((tmp_path / "index").glob("held-*"))
