"""Listing, index, images, encoders and the library as a whole, on generated files."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.functions import media, terms, text, vectors
from mediasift.operators import encode as en
from mediasift.operators import evaluate as ev
from mediasift.operators import images as im
from mediasift.operators import index as ix
from mediasift.operators import search as sr
from mediasift.codecs import decode_png
from mediasift.plans.media_index import MediaIndex
from mediasift.sources import content
from mediasift.sources.walk import list_library
from mediasift.sources.store import INDEX, IndexStore, migrate


def png(path, pixels):
    """Writes height x width x 3 bytes as a PNG."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def names(df):
    return sorted(r["filepath"].rsplit("/", 1)[-1] for r in df.collect())


@pytest.fixture
def library(tmp_path):
    for f in ("photo.jpg", "B.JPG", "_c.jpg", ".d.jpg", "notes.txt", "raw.cr2"):
        (tmp_path / f).write_bytes(f.encode())
    for d in (".Trashes", "System Volume Information", "node_modules/x", "sub/deep", "_ok"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / f"in-{d.split('/')[0].strip('.')}.png").write_bytes(d.encode())
    (tmp_path / "sub" / "loop").symlink_to(tmp_path / "sub")
    return tmp_path


def test_listing(spark, library):
    found = list_library(spark, str(library))
    assert names(found) == ["B.JPG", "_c.jpg", "in-_ok.png", "in-sub.png", "photo.jpg"]
    row = found.where("name = 'photo.jpg'").first()
    info = os.stat(library / "photo.jpg")
    assert (row["modified_at"], row["size"]) == (info.st_mtime, info.st_size)
    assert ".d.jpg" in names(list_library(spark, str(library), hidden=True))
    assert "in-sub.png" not in names(list_library(spark, str(library), exclude_dirs=["sub"]))
    assert "raw.cr2" in names(list_library(spark, str(library), raw_support=True))


def test_listing_of_unreadable_file(spark, tmp_path):
    (tmp_path / "gone.jpg").symlink_to(tmp_path / "missing")
    row = list_library(spark, str(tmp_path)).first()
    assert row["modified_at"] is None and row["reason"]


def test_listing_in_few_and_many_partitions(spark, library, monkeypatch):
    from mediasift.sources import listing as li

    (library / "locked").mkdir()
    want = names(list_library(spark, str(library)))
    for n in (1, 3, 1000):
        monkeypatch.setattr(li, "PARTITIONS", n)
        reader = li.LibraryReader({"root": str(library)})
        found = [r for p in reader.partitions() for r in reader.read(p)]
        assert sorted(r[1] for r in found) == want
    missing = list(li.LibraryReader({"root": str(library)}).read(li.SubTree(f"{library}/none", True)))
    assert len(missing) == 1 and missing[0][2] is None and missing[0][4]


def test_listing_in_steps(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    from mediasift.sources import walk
    from mediasift.sources.files import Place

    lib = tmp_path / "a b%20c"
    for d in ("x/y/z", "x/w", "v", ".hid/in", "node_modules/m"):
        (lib / d).mkdir(parents=True)
        (lib / d / "one.jpg").write_bytes(b"1" * len(d))
    (lib / "x/up").symlink_to(lib)  # back to the root
    (lib / "v/across").symlink_to(lib / "x/y")  # the same folder on the same level: the smaller path counts
    (lib / "x/w/deep").symlink_to(lib / "x/y/z")
    (lib / "v/lost").symlink_to(lib / "none")
    want = ["v/across/z/one.jpg", "v/one.jpg", "x/w/one.jpg"]
    below = lambda df, head: sorted(r["filepath"].removeprefix(f"{head}/") for r in df.collect())
    # x/w/deep and v/across/z are one folder on one level
    assert below(list_library(spark, str(lib)), str(lib)) == want
    assert below(list_library(spark, f"file://{lib}/"), f"file://{lib}") == want
    hidden = below(list_library(spark, str(lib), hidden=True), str(lib))
    assert ".hid/in/one.jpg" in hidden and ".hid/one.jpg" not in hidden

    # a file system of Arrow's that is not the local one: no links are known there
    (lib / "x/up").unlink()
    base = str(lib)

    def find(path):
        return Place(fs.SubTreeFileSystem(base, fs.LocalFileSystem()), "", "box://far/")

    far = list_library(spark, "box://far/", find=find)
    assert below(far.where("size > 0"), "box://far") == ["v/across/z/one.jpg", "v/one.jpg", "x/w/deep/one.jpg", "x/w/one.jpg", "x/y/z/one.jpg"]
    row = far.where("name = 'one.jpg' and size = 3").first()
    assert abs(row["modified_at"] - os.stat(lib / "x/w/one.jpg").st_mtime) < 1e-3
    assert list_library(spark, f"{tmp_path}/none").first()["reason"]
    monkeypatch.setattr(walk, "MOST_LEVELS", 2)
    with pytest.raises(OSError):
        list_library(spark, str(lib))


def test_listing_of_a_large_flat_folder(spark, tmp_path):
    from mediasift.sources import walk

    for i in range(100_000):
        os.close(os.open(f"{tmp_path}/f{i:06d}.jpg", os.O_CREAT | os.O_WRONLY))
    assert list_library(spark, str(tmp_path)).where("modified_at is not null and size = 0").count() == 100_000
    paths = spark.createDataFrame([(f"{tmp_path}/f{i:06d}.jpg", f"f{i:06d}.jpg") for i in range(0, 100_000, 20)], "filepath string, name string")
    found = walk.looked_up(paths, 5).groupBy(F.spark_partition_id().alias("task")).agg(F.min("filepath").alias("lo"), F.max("filepath").alias("hi"), F.count("size").alias("n")).orderBy("lo").collect()
    assert len(found) == 5 and all(a["hi"] < b["lo"] for a, b in zip(found, found[1:])) and max(r["n"] for r in found) < 2 * 1000


def test_fingerprint_of_large_content(spark, tmp_path):
    data = os.urandom(media.HEAD + 5000)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(b"x" * 1024)
    rows = spark.createDataFrame([(f"{tmp_path}/a.bin",), (f"file://{tmp_path}/b.bin",), (f"{tmp_path}/none",)], "filepath string")
    got = {r["filepath"][-5:]: r["h"] for r in content.read_bytes(rows).withColumn("h", media.fingerprint(F.col("content"))).collect()}
    found = content.fingerprints(rows).collect()
    assert {r["filepath"][-5:]: r["hash"] for r in found} == got and [r["filepath"][-5:] for r in found if r["error"]] == ["/none"]
    assert got["a.bin"] == hashlib.sha256(data[: media.HEAD] + data[-1024:]).hexdigest()
    assert got["b.bin"] == hashlib.sha256(b"x" * 1024).hexdigest()


def index_rows(spark, rows):
    return spark.createDataFrame([(p, float(m), s, h, [float(v)], d) for p, m, s, h, v, d in rows], INDEX)


def listing_rows(spark, rows):
    return spark.createDataFrame([(p, float(m), s, h) for p, m, s, h in rows], "filepath string, modified_at double, size long, hash string")


def refreshed(spark, listing, index, **options):
    out = ix.refresh(listing, index, "/a", lambda r: r.where("hash <> 'bad'"), lambda r: r.withColumn("vector", F.array(F.lit(9.0).cast("float"))), **options)
    return {r["filepath"]: (r["vector"][0], r["deleted"]) for r in out.collect()}


def test_refresh_semantics(spark):
    index = index_rows(spark, [("/a/same", 1, 1, "s", 1, None), ("/a/gone", 1, 1, "g", 2, None), ("/b/out", 1, 1, "o", 3, None), ("/a/dead", 1, 1, "d", 4, True), ("/a/fails", 1, 1, "f", 5, None), ("/a/size", 1, 100, "z", 6, None)])
    listing = listing_rows(spark, [("/a/same", 1, 1, "s"), ("/a/moved", 2, 1, "g"), ("/a/dead", 1, 1, "d"), ("/a/fails", 2, 1, "bad"), ("/a/new", 1, 1, "n"), ("/a/other", 1, 200, "z"), ("/a/size", 1, 100, "z")])
    got = refreshed(spark, listing, index)
    assert got == {"/a/same": (1, None), "/a/gone": (2, True), "/a/moved": (2, None), "/b/out": (3, None), "/a/dead": (4, None), "/a/fails": (5, True), "/a/new": (9, None), "/a/other": (9, None), "/a/size": (6, None)}
    assert refreshed(spark, listing, index, restore_deleted=False)["/a/dead"] == (4, True)


def test_refresh_twice_changes_nothing(spark, tmp_path):
    listing = listing_rows(spark, [("/a/x", 1, 1, "s"), ("/a/y", 1, 1, "s"), ("/a/z", 1, 2, None)])
    store = IndexStore(spark, f"file://{tmp_path}/index")
    assert not store.exists() and not store.has_rows()
    for _ in range(2):
        store.write(ix.refresh(listing, store.read(), "/a", lambda r: r, lambda r: r.withColumn("vector", F.array(F.lit(1.0).cast("float")))))
        rows = sorted(store.read().select("filepath", "vector", "deleted").collect())
        assert [r[0] for r in rows] == ["/a/x", "/a/y"] and all(r[2] is None for r in rows)
    assert store.manifest()["version"] == 2


def test_store_changes_conflicts_and_expiry(spark, tmp_path, monkeypatch):
    from mediasift.sources import store as st

    monkeypatch.setattr(st, "MOST_CHANGES", 2)
    monkeypatch.setattr(st, "GRACE_SECONDS", -1)
    store = IndexStore(spark, f"file://{tmp_path}/index")
    row = lambda p, v: index_rows(spark, [(p, 1, 1, "h", v, None)])
    want = {}
    for k in range(7):
        name = f"/a/{k % 3}"
        store.add(row(name, k))
        want[name] = k
        assert {r["filepath"]: r["vector"][0] for r in store.read().collect()} == want
    assert len(store.manifest()["changes"]) <= 2 and store.manifest()["version"] == 7
    assert len(list((tmp_path / "index").glob("manifest-*"))) == 2 and len(list((tmp_path / "index").glob("rows-*"))) <= 5
    seen = store.manifest()
    store.add(row("/a/x", 1), based_on=seen)
    for late in (store.add, store.write):
        with pytest.raises(st.Conflict):
            late(row("/a/y", 2), based_on=seen)
    assert sorted(r[0] for r in store.read().select("filepath").collect()) == ["/a/0", "/a/1", "/a/2", "/a/x"]


def test_migration(spark):
    old = index_rows(spark, [("/a", 1, 1, None, 1, None)])
    assert migrate(old.drop("hash"), 3).count() == 1 and migrate(old, 2).count() == 0
    for version, reset in ((5, True), (1, False)):
        with pytest.raises(ValueError):
            migrate(old, version, allow_reset=reset)


def test_scope(spark):
    from mediasift.functions.paths import in_scope

    df = spark.createDataFrame([("/photos/a.jpg",), ("/photos-archive/a.jpg",), ("/PHOTOS/b.jpg",), ("/100% real/a.jpg",), ("/100_ real/a.jpg",), ("Y:\\p\\cat.jpg",), ("Y:\\p-archive\\cat.jpg",)], "p string")
    at = lambda prefix, **o: [r[0] for r in df.where(in_scope(F.col("p"), prefix, **o)).collect()]
    assert at("/photos") == ["/photos/a.jpg", "/PHOTOS/b.jpg"] and at("/photos/", case_sensitive=True) == ["/photos/a.jpg"]
    assert at("/100% real") == ["/100% real/a.jpg"] and at("Y:\\p") == ["Y:\\p\\cat.jpg"]


def test_multipliers(spark):
    cases = {"1.5:cat": (1.5, "cat"), "cat": (1.0, "cat"), "1:cat": (1.0, "cat"), "0.5:cat": (0.5, "cat"), ".5:cat": (0.5, "cat"), "1.:cat": (1.0, "cat"), "1..:cat": (1.0, "1..:cat"), "..:cat": (1.0, "..:cat"), "whatever:cat": (1.0, "whatever:cat"), "1.5:complex and long query": (1.5, "complex and long query"), "10:30 train": (10.0, "30 train")}
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    assert {r[0]: (r[1], r[2]) for r in df.select("q", terms.multiplier(F.col("q")), terms.body(F.col("q"))).collect()} == cases


def test_pixel_cap():
    assert media.parse_cap("auto", 0) == media.LEAST_CAP and media.parse_cap("auto", 64 << 30, 8) == (64 << 30) // 64
    assert media.parse_cap("500") == 500_000_000 and media.parse_cap("89.5") == 89_500_000
    assert all(media.parse_cap(x) is None for x in ("none", "OFF", "disable", "disabled", "0"))
    for bad in ("-5", "nan", "inf", "x"):
        with pytest.raises(ValueError):
            media.parse_cap(bad)


def test_images(spark, tmp_path):
    png(tmp_path / "_flat.png", np.full((300, 400, 3), (10, 20, 30)))
    png(tmp_path / "large.png", np.zeros((500, 500, 3)))
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    rows = spark.createDataFrame([(f"{tmp_path}/{n}", k) for k, n in enumerate(("_flat.png", "large.png", "broken.jpg", "absent.png"))], "filepath string, k int")
    found = im.encode_images(rows, lambda: lambda x: x[:, :, 0, 0], cap=200_000, batch=3).collect()
    assert {r["filepath"].rsplit("/", 1)[-1]: r["reason"] for r in found} == {"_flat.png": None, "large.png": "too_large", "broken.jpg": "unreadable", "absent.png": "other"}
    assert next(r["message"] for r in found if r["reason"] == "too_large") == "0 MP is above the cap"
    want = (np.array([10, 20, 30]) / 255 - np.array(media.MEAN)) / np.array(media.STD)
    got = next(r["vector"] for r in found if r["reason"] is None)
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-5) and [r["k"] for r in found if r["reason"] is None] == [0]

    def fails():
        raise RuntimeError("no model")

    assert {r["reason"] for r in im.encode_images(rows, fails).collect()} == {"other", "unreadable"}


def test_png_filters_and_kinds():
    rng = np.random.default_rng(0)
    for kind, n in ((0, 1), (2, 3), (3, 1), (4, 2), (6, 4)):
        x = rng.integers(0, 256, (7, 5, n)).astype(np.int64)
        lines = []
        for y in range(7):
            left = np.vstack([np.zeros((1, n), int), x[y, :-1]])
            up = x[y - 1] if y else np.zeros_like(x[y])
            corner = np.vstack([np.zeros((1, n), int), up[:-1]])
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            how = y % 5
            lines.append(bytes([how]) + ((x[y] - (0, left, up, (left + up) >> 1, paeth)[how]) & 255).astype(np.uint8).tobytes())
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        palette = rng.integers(0, 256, (256, 3)).astype(np.uint8)
        raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 7, 8, kind, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if kind == 3 else b"") + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
        want = palette[x[:, :, 0]] if kind == 3 else np.repeat(x[:, :, :1], 3, axis=2) if n < 3 else x[:, :, :3]
        assert (decode_png(raw) == want).all() and im.image_size(raw) == (5, 7)
    for bad in (b"", b"GIF89a", raw[:40], raw[:60]):
        with pytest.raises(ValueError):
            decode_png(bad)
    assert im.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4) and im.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 9, 8) + b"xx") == (8, 9)


def test_preprocess_invariants():
    x = np.random.default_rng(0).integers(0, 256, (256, 256, 3))
    back = im.preprocess(x).transpose(1, 2, 0) * np.array(media.STD) + np.array(media.MEAN)
    assert np.allclose(back * 255, x, atol=1e-3)
    assert im.preprocess(np.zeros((100, 300, 3), np.uint8)).shape == (3, 256, 256)


def test_padding_and_batches(spark):
    seen = []
    run = en.padded(lambda x: seen.append(len(x)) or x * 2, 4)
    assert np.array_equal(run(np.arange(10.0)[:, None]), np.arange(10.0)[:, None] * 2) and seen == [4, 4, 4]
    zero = en.encode_batches(spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "i long, pixels array<float>"), lambda: lambda x: x, shape=[2])
    assert [r["vector"] for r in zero.orderBy("i").collect()][0] is None
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(20)], "i long, pixels array<float>")
    got = en.encode_batches(df, lambda: lambda x: x * 3, shape=[2]).collect()
    assert all(abs(sum(v * v for v in r["vector"]) - 1) < 1e-5 for r in got)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(vectors.l2_normalise(F.col("v"))).collect()] == [[0.6, 0.8], None, None]
    back = df.select(vectors.vector_from_bytes(vectors.vector_to_bytes("v")))
    assert [r[0] for r in back.collect()] == [[3.0, 4.0], [0.0, 0.0], None]


def test_text(spark):
    df = spark.createDataFrame([(0, " Tom &amp;amp; Jerry's\n12  "), (1, None), (2, "")], "k long, t string")
    assert [r[0] for r in df.select(text.clean(F.col("t"))).collect()] == ["tom & jerry's 12", None, ""]
    assert df.select(text.split_tokens(text.clean(F.col("t")))).first()[0] == ["tom", "&", "jerry", "'s", "1", "2"]
    tokens = {r[0]: r[1] for r in en.tokenise(df, [("t", "o"), ("to", "m</w>")], key="k", text="t").collect()}
    assert [r[1] for r in en.hash_encode(spark.createDataFrame([(None, "b a"), (1, "a b"), (1, "a b"), (2, "12"), (3, None)], "k long, t string"), key="k", text="t").select("k", F.size("vector")).collect()] == [64, 64, 64]
    assert tokens[0][:2] == [514, 513] and len(tokens[0]) == 77 and tokens[1][:3] == tokens[2][:3] == [514, 515, 0]
    long = en.tokenise(spark.createDataFrame([(0, "a " * 200)], "k long, t string"), [], key="k", text="t").first()[1]
    assert len(long) == 77 and long[-1] == 513


def test_tokens_equal_the_public_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from mediasift.plans.queries import bpe_tokenise

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe_tokenise(spark, "/root/testdata/sf0.001").collect():
        import html

        ids = known.encode(html.unescape(html.unescape(docs[r["doc_id"]])), add_special_tokens=False).ids[:75]
        assert r["tokens"] == [49406, *ids, 49407] + [0] * (75 - len(ids))


def test_encoded_batches_equal_numpy(spark):
    from mediasift.plans.queries import encode_batch

    weight = np.random.default_rng(1).normal(size=(64, 16)).astype(np.float32)
    rows = {r["vec_id"]: np.array(r["embedding"], np.float32) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    got = encode_batch(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        v = rows[r["vec_id"]] @ weight
        assert np.allclose(r["vector"], v / np.linalg.norm(v), atol=1e-5)


def test_many_classes_and_repeated_keys(spark):
    rng = np.random.default_rng(6)
    classes, items = rng.normal(size=(3000, 32)), rng.normal(size=(40, 32))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(classes)], "class_id int, cvec array<double>")
    rows = spark.createDataFrame([(i // 2, i, v.tolist()) for i, v in enumerate(items)] + [(7, 99, None)], "vec_id long, label int, vector array<double>")
    got = ev.rank_classes(rows, table, keep=("label",)).collect()
    assert len(got) == 200
    for r in got:
        order = np.argsort(-(classes @ items[r["label"]]))
        assert r["class_id"] == order[r["rk"] - 1] and r["vec_id"] == r["label"] // 2
    assert ev.accuracy(ev.rank_classes(rows, table, keep=("label",))).first()["processed"] == 40
    assert ev.rank_classes(rows, table.limit(0)).count() == 0
    tied = spark.createDataFrame([(i, [1.0]) for i in range(2000, 0, -1)], "class_id int, cvec array<double>")
    one = spark.createDataFrame([(1, [2.0])], "vec_id long, vector array<double>")
    assert [r["class_id"] for r in ev.rank_classes(one, tied, 3).orderBy("rk").collect()] == [1, 2, 3]


def test_search_edges(spark):
    items = spark.createDataFrame([("/p/a", [1.0, 0.0]), ("/p/b", [1.0, 0.0]), ("/p/node_modules/c", [2.0, 0.0]), ("/p/n", [float("nan"), 0.0]), ("/p/0", None)], "filepath string, vector array<float>")
    assert [r[0] for r in sr.search(items, [1.0, 0.0]).collect()] == ["/p/a", "/p/b"]
    assert [r[0] for r in sr.search(items, [1.0, 0.0], top=1, query_files=["/p/a"]).collect()] == ["/p/b"]
    assert sr.search(items.limit(0), [1.0, 0.0]).count() == 0
    assert [r[0] for r in sr.search(items, [1.0, 0.0], query_files=items.where("filepath = '/p/a'")).collect()] == ["/p/b"]
    with pytest.raises(ValueError):
        sr.search(items, [1.0, 0.0], top=0)
    assert sr.combine([], [], 3) == [0.0, 0.0, 0.0]


def test_knn_blocks_give_the_same_rows(spark):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)], "vec_id long, vector array<double>").repartition(5)
    queries = items.where("vec_id % 20 = 0").selectExpr("vec_id as qid", "vector as qvec")
    a = sorted(sr.knn(items, queries, 7).select("qid", "vec_id", "rk").collect())
    assert a == sorted(sr.knn(items, queries, 7, block=4, held_bytes=500).select("qid", "vec_id", "rk").collect()) and len(a) == 15 * 7


def test_knn_ties_go_by_key(spark):
    items = spark.createDataFrame([(f"k{i:02d}", [1.0 if i % 2 else 0.5]) for i in range(40)] + [("nan", [float("nan")])], "vec_id string, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0]), (2, None)], "qid long, qvec array<double>")
    assert [r["vec_id"] for r in sr.knn(items, queries, 3).orderBy("rk").collect()] == ["k01", "k03", "k05"]
    assert sr.knn(items, queries.limit(0), 3).count() == 0 and sr.knn(items.limit(0), queries, 3).count() == 0


def test_precision_divides_by_returned_rows(spark):
    items = spark.createDataFrame([(0, [1.0], 0), (1, [0.5], 0), (2, [0.1], 1)], "vec_id long, vector array<double>, label int")
    queries = items.where("vec_id = 0").selectExpr("vec_id as qid", "vector as qvec", "label as qlabel")
    assert abs(ev.precision(items, queries, 100).first()["precision"] - 2 / 3) < 1e-12


def test_library_end_to_end(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    for name, colour in (("red", (250, 10, 10)), ("_green", (10, 250, 10)), ("blue", (10, 10, 250))):
        png(lib / f"{name}.png", np.full((20, 30, 3), colour))
    log = tmp_path / "opened"
    log.write_text("")

    def read(path):
        with log.open("a") as f:
            f.write(path.rsplit("/", 1)[-1] + "\n")
        with open(path, "rb") as f:
            return f.read()

    def opened():
        found = sorted(log.read_text().split())
        log.write_text("")
        return found

    def make():
        # the mean colour, back from the encoder's input
        return lambda x: x.mean(axis=(2, 3)) * np.array(media.STD) + np.array(media.MEAN)

    words = {"red": [1.0, 0.0, 0.0], "green": [0.0, 1.0, 0.0], "blue": [0.0, 0.0, 1.0]}
    index = MediaIndex(spark, f"file://{tmp_path}/index", make, lambda q: words[q], read=read)
    first = lambda *a, **k: [r[0].rsplit("/", 1)[-1] for r in index.search(str(lib), *a, **k).collect()]
    assert first("red")[0] == "red.png" and opened() == ["_green.png", "blue.png", "red.png"]
    assert first("green")[0] == "_green.png" and opened() == []
    assert first("red", add=["2:green"], refresh=False)[0] == "_green.png"
    assert first("red", subtract=["2:red"], refresh=False)[-1] == "red.png"
    assert f"{lib}/red.png" not in [r[0] for r in index.search(str(lib), f"{lib}/red.png", refresh=False).collect()]
    # a query image that is not in the index, and one of a URL
    png(tmp_path / "other.png", np.full((9, 9, 3), (20, 240, 20)))
    assert first(f"{tmp_path}/other.png", refresh=False)[0] == "_green.png"
    assert first("https://e.com/x", refresh=False, images={"https://e.com/x": (tmp_path / "other.png").read_bytes()})[0] == "_green.png"
    with pytest.raises(ValueError):
        first("https://e.com/x", refresh=False)
    opened()
    (lib / "copy.png").write_bytes((lib / "blue.png").read_bytes())
    assert set(first("blue")[:2]) == {"blue.png", "copy.png"} and opened() == []  # known by content
    (lib / "copy.png").unlink()
    (lib / "bad.jpg").write_bytes(b"no image")
    (lib / "gone.jpg").symlink_to(lib / "missing")
    skipped = index.refresh(str(lib)).collect()
    assert sorted((r["filepath"].rsplit("/", 1)[-1], r["reason"]) for r in skipped) == [("bad.jpg", "unreadable"), ("gone.jpg", "unreadable")] and all(r["message"] for r in skipped)
    assert "copy.png" not in first("blue", refresh=False)
    small = MediaIndex(spark, f"file://{tmp_path}/small", make, lambda q: words[q], max_image_megapixels="0.0005")
    assert {r["reason"] for r in small.refresh(str(lib)).collect()} == {"too_large", "unreadable"}
    assert index.search(str(tmp_path / "lib" / "none"), "red", refresh=False).count() == 0


def test_stream_of_a_library(spark, tmp_path):
    lib, log = tmp_path / "lib", tmp_path / "opened"
    (lib / "sub").mkdir(parents=True)
    log.write_text("")

    def read(path):
        with log.open("a") as f:
            f.write(path.rsplit("/", 1)[-1] + "\n")
        with open(path, "rb") as f:
            return f.read()

    def opened():
        found = sorted(log.read_text().split())
        log.write_text("")
        return found

    index = MediaIndex(spark, f"file://{tmp_path}/index", lambda: lambda x: x.mean(axis=(2, 3)) + 3, lambda q: [1.0, 0.0, 0.0], read=read)
    run = lambda: index.follow(str(lib), f"file://{tmp_path}/checkpoint", lag=0.0).awaitTermination()
    live = lambda: sorted(r["filepath"].rsplit("/", 1)[-1] for r in index.store.read().where("deleted is null").collect())
    png(lib / "a.png", np.full((5, 5, 3), 9))
    png(lib / "sub" / "b.png", np.full((5, 5, 3), 90))
    (lib / "bad.png").write_bytes(b"no image")
    run()
    assert live() == ["a.png", "b.png"] and opened() == ["a.png", "b.png", "bad.png"]
    # a new query from the same checkpoint goes on where the first ended
    png(lib / "c.png", np.full((5, 5, 3), 40))
    png(lib / "a.png", np.full((6, 6, 3), 77))
    run()
    assert live() == ["a.png", "b.png", "c.png"] and opened() == ["a.png", "c.png"]
    # old files in a folder that is moved in, and one that is renamed
    aside = tmp_path / "aside"
    aside.mkdir()
    png(aside / "d.png", np.full((5, 5, 3), 120))
    run()
    version = index.store.manifest()["version"]
    aside.rename(lib / "moved")
    (lib / "c.png").rename(lib / "e.png")
    run()
    assert opened() == ["d.png"] and {"d.png", "e.png"} < set(live())
    # a batch that comes again is known by its number
    from mediasift.streaming.upsert import upsert_batch

    name, last = next(iter(index.store.manifest()["batches"].items()))
    assert name == f"file://{tmp_path}/checkpoint" and last >= 2 and index.store.manifest()["version"] > version
    rows = spark.createDataFrame([("/lib/never.png", 1.0, 1, "h")], "filepath string, modified_at double, size long, hash string")
    before = index.store.manifest()
    upsert_batch(index.store, rows, lambda r: r.withColumn("vector", F.array(F.lit(1.0).cast("float"))), number=(name, last))
    assert index.store.manifest() == before
    index.refresh(str(lib))
    assert live() == ["a.png", "b.png", "d.png", "e.png"] and opened() == ["bad.png"]


def test_result_file(spark, tmp_path):
    from mediasift.sources.results import write_results

    rows = spark.createDataFrame([("/p/b", 0.25), ("/p/ä \"x\"", 0.9996), ("/p/c", -0.0625)], "filepath string, score double")
    target = tmp_path / "found.tsv"
    write_results(sr.top_k(rows, 10), str(target))
    assert target.read_text() == 'score\tfilepath\n1.000\t"/p/ä "x""\n0.250\t"/p/b"\n-0.062\t"/p/c"\n'
    write_results(sr.top_k(rows, 2), f"file://{target}", paths_only=True)
    assert target.read_text() == '/p/ä "x"\n/p/b\n'
    many = spark.range(1000).selectExpr("concat('/p/', id) as filepath", "double(id) as score").repartition(7).orderBy(F.col("score").desc())
    write_results(many, str(target))
    assert [x.split("\t")[0] for x in target.read_text().splitlines()[1:]] == [f"{i}.000" for i in range(999, -1, -1)]
    # an empty library gives the header alone
    (tmp_path / "none").mkdir()
    index = MediaIndex(spark, f"file://{tmp_path}/index", lambda: lambda x: x, lambda q: [1.0])
    write_results(index.search(str(tmp_path / "none"), "cat"), str(target))
    assert target.read_text() == "score\tfilepath\n" and [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []


def test_merging_is_exact_and_fast():
    import time

    def slow(token, ranks):
        letters = [en.byte_letters()[b] for b in token.encode()]
        parts = [*letters[:-1], letters[-1] + "</w>"]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: ranks.get(p, 1 << 60))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(parts):
                two = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                out.append(parts[i] + parts[i + 1] if two else parts[i])
                i += 1 + two
            parts = out
        return parts

    rng = np.random.default_rng(4)
    for _ in range(300):
        # merges in any order, so that later ones may outrank those they build on
        pieces = ["a", "b", "c", "c</w>", "ab", "aa", "abc", "ba", "bab", "aab"]
        pairs = list(dict.fromkeys(zip(rng.choice(pieces, 12), rng.choice(pieces, 12))))
        ranks = {(str(a), str(b)): i for i, (a, b) in enumerate(pairs)}
        token = "".join(rng.choice(list("abc"), int(rng.integers(1, 25))))
        assert en.merge(token, ranks) == slow(token, ranks), (token, ranks)
    from mediasift.plans.queries import vocabulary_merges

    ranks = {m: i for i, m in enumerate(vocabulary_merges())}
    token = "".join(rng.choice(list("etaoinshrdlu"), 100_000))
    began = time.process_time()
    assert "".join(en.merge(token, ranks)) == token + "</w>" and time.process_time() - began < 3


def test_special_tokens(spark):
    df = spark.createDataFrame([(0, "a <START_OF_TEXT>b<end_of_text> <end_of_texts>")], "k long, t string")
    assert df.select(text.split_tokens(text.clean(F.col("t")))).first()[0] == ["a", "<start_of_text>", "b", "<end_of_text>", "<", "end", "_", "of", "_", "texts", ">"]
    ids = en.tokenise(df, [], key="k", text="t").first()[1]
    assert ids[0] == ids[2] == 512 and ids[4] == 513 and ids.count(513) == 2


def test_weighted_vectors(spark):
    rows = [(i % 7 if i % 7 else None, 1 if i % 3 else -1, 0.5 * (1 + i % 4), None if i == 8 else [float(i), float(i * i), 1.0][: 2 + i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "qid int, sign int, multiplier double, tvec array<float>").repartition(9)
    want = {}
    for q, s, m, v in rows:
        if v is not None:
            x = np.array([*v, 0.0][:3]) * s * m
            want[q] = want.get(q, 0) + x
    found = sr.weighted_vectors(df)
    got = {r["qid"]: r["qvec"] for r in found.collect()}
    assert set(got) == set(want) and all(np.allclose([*got[q], 0.0][:3], want[q]) for q in want)
    holes = spark.createDataFrame([(1, 1, 2.0, [1.0, None, float("inf")]), (1, 1, 1.0, [None, None, 1.0])], "qid int, sign int, multiplier double, tvec array<double>")
    assert sr.weighted_vectors(holes).first()["qvec"] == [2.0, 0.0, float("inf")]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString() and sr.weighted_vectors(df.limit(0)).count() == 0


def test_hashed_vectors_of_many_rows(spark):
    import hashlib as hl
    import re

    rng = np.random.default_rng(2)
    rows = [(i, None if i % 11 == 0 else " ".join(rng.choice(["Alpha", "be1ta", "ÄÖ", "x", "ß-straße", "", "12", "omega"], int(rng.integers(0, 30)))) + "end" * (i % 2)) for i in range(300)]
    got = {r[0]: r[1] for r in en.hash_encode(spark.createDataFrame(rows, "k long, t string").repartition(3), key="k", text="t").collect()}
    for i, t in rows:
        v = np.zeros(64)
        for token in re.findall("[a-z]+", (t or "").lower()):
            digest = hl.md5(token.encode()).hexdigest()
            v[int(digest[:4], 16) % 64] += 1 - 2 * (int(digest[4], 16) % 2)
        assert (i in got) == bool(v.any()) and (i not in got or np.allclose(got[i], v / np.linalg.norm(v)))
    assert en.hash_encode(spark.createDataFrame([], "k long, t string"), key="k", text="t").count() == 0


class Captured:
    """Stands for a table, to get the function that tasks run."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    toDF = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


def test_hashed_vectors_in_bounded_memory(spark):
    import tracemalloc

    import pyarrow as pa

    def words(k, n):  # distinct runs of letters
        return " ".join(np.base_repr(26**4 + k * n + i, 26).translate(str.maketrans("0123456789", "qrstuvwxyz")).lower() for i in range(n)) + " "

    table = Captured(spark.createDataFrame([], "k long, t string").schema)
    en.hash_encode(table, key="k", text="t")
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array([words(k, 400) for k in range(2_000)])], names=["key", "text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in table.run(iter([batch]))) == 2_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_hashed_vectors_by_pieces(spark, monkeypatch):
    import pyarrow as pa

    table = Captured(spark.createDataFrame([], "k long, t string").schema)
    en.hash_encode(table, key="k", text="t")
    texts = ["ab cd ", "x" * 50 + " y ", None, " ", "12 zz", "é", *["lm no p " * 20] * 3, "longer" * 30 + " "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([None if t is None else t + " " for t in texts])], names=["key", "text"]).slice(1)
    whole = [b.to_pydict() for b in table.run(iter([batch, batch.slice(0, 0)]))]
    monkeypatch.setattr(en, "KNOWN", 1)
    for piece in (1, 3, 7, 64):
        monkeypatch.setattr(en, "PIECE", piece)
        assert [b.to_pydict() for b in table.run(iter([batch, batch.slice(0, 0)]))] == whole
    assert whole[0]["key"] == [1, 4, 6, 7, 8, 9]


def test_text_of_any_length_in_bounded_memory(spark):
    """A single text, as searches of long documents have it, is cut up as well."""
    import tracemalloc

    import pyarrow as pa

    table = Captured(spark.createDataFrame([], "k long, t string").schema)
    en.hash_encode(table, key="k", text="t")
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["ab cd ef gh " * 500_000])], names=["key", "text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in table.run(iter([batch]))) == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20, peak


def test_automatic_cap_is_of_the_session(spark, tmp_path):
    from mediasift.plans.media_index import executor

    memory, workers = executor(spark)
    assert memory == 4 << 30 and workers == 4
    make = lambda **k: MediaIndex(spark, f"file://{tmp_path}/i", lambda: lambda x: x, lambda q: [1.0], **k).cap
    assert make() == media.parse_cap("auto", 4 << 30, 4) and make(memory=64 << 30, workers=8) == (64 << 30) // 64 and make(max_image_megapixels="none") is None
