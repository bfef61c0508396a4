"""A tree of matrix files, from text to deduplicated frames."""

from unitwise.operators import dedup as D
from unitwise.sources import tree as T


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def matrix(seed, delimiter=",", rows=3, cols=4):
    return "\n".join(delimiter.join(str(-60 - (seed * 7 + r * cols + c) % 11) for c in range(cols)) for r in range(rows))


def test_tree(spark, tmp_path):
    root = tmp_path / "cars_study" / "data"  # what stands above the root names no class
    write(root / "Drones/12-41/99.Csv", matrix(99))
    for i in range(20):
        write(root / f"Drones/12-41/{i}.csv", matrix(i))
        write(root / f"copy/Drones/12-41/{i}.csv", matrix(i))
    for i in range(12):
        write(root / f"Drones/old/12-41/{i}.csv", matrix(i))
    write(root / "Cars/15-55a/1.txt", matrix(1, " "))
    write(root / "Cars/15-55a/2.dat", matrix(2, ";"))
    write(root / "Cars/15-55a/3.csv", "1,2\n3")
    write(root / "Cars/15-55a/4.csv", "")
    write(root / "Cars/15-55a/5.csv", "1,2,3")
    write(root / "Cars/15-55a/6.csv", matrix(1, rows=2))
    write(root / "Other/1.csv", matrix(1))
    write(root / "Cars/15-55a/readme.md", "no data")
    files = T.read_tree(spark, str(root))
    assert files.count() == 58  # Spark passes over empty files
    assert [(r.path.rsplit('/', 1)[1], r.error) for r in T.empty_files(spark, str(root)).collect()] == [("4.csv", "empty")]
    assert {(r["class"], r.unit) for r in files.select("class", "unit").distinct().collect()} == {("drone", "12-41"), ("car", "15-55")}
    frames, rest = T.frames_of(files)
    assert frames.count() == 55 and rest.count() == 3
    assert {(r.n_rows, r.n_cols) for r in frames.collect()} == {(3, 4)}
    kept = D.dedupe_folders(D.folder_digests(D.file_digests(files.where("class = 'drone'"))))
    dropped = sorted((r.n, r.reason) for r in kept.collect() if not r.kept)
    assert dropped == [(12, "partial (12 of 21 files)"), (20, "partial (20 of 21 files)")]
    out = str(tmp_path / "frames")
    T.write_frames(frames, out)
    assert spark.read.parquet(out).where("class = 'car'").count() == 2


def test_reports(spark, tmp_path):
    write(tmp_path / "r/b.json", '{"x": 1}')
    write(tmp_path / "r/c.json", '{"x": 2}')
    got = T.read_reports(spark, str(tmp_path / "r"), {"one": ["a.json", "b.json"], "two": ["c.json", "b.json"], "none": ["z.json"]})
    assert {r.name: r.x for r in got.selectExpr("name", "variant_get(body, '$.x', 'int') AS x").collect()} == {"one": 1, "two": 2}


def test_manifest_and_dataset(spark, tmp_path):
    root = tmp_path / "data"
    for u in range(8):
        for i in range(45):
            write(root / f"Cars/10-0{u}/{i:02d}.csv", matrix(u * 50 + i) if i else "1,x\n2,3")
            write(root / f"Drones/20-0{u}/{i:02d}.csv", matrix(900 + u * 50 + i))
    files = T.read_tree(spark, str(root)).cache()
    shapes, failures = T.shapes_and_failures(files, 40)
    assert {(r.n_rows, r.n_cols, r.n) for r in shapes.where("folder like 'Cars%'").collect()} == {(3, 4, 39)}
    assert {r.error for r in failures.collect()} == {"no matrix of numbers"} and failures.count() == 8
    places = sorted(r.place for r in T.probe(files, "folder", "path", 40).where("folder = 'Cars/10-00'").collect())
    assert places == [j * 44 // 39 for j in range(40)]
    assert T.manifest(files, None).count() == files.count() == 720
    units = files.select("class", "unit").distinct()
    from unitwise.operators import splits as P

    frames, rest, straddling = T.dataset(files, P.grouped_split(units, 0.25, 1))
    assert rest.count() == 8 and straddling.count() == 0
    got = {(r["class"], r.side): r.n for r in frames.groupBy("class", "side").agg({"unit": "count"}).withColumnRenamed("count(unit)", "n").collect()}
    assert got == {("car", "test"): 88, ("car", "val"): 44, ("car", "train"): 220, ("drone", "test"): 90, ("drone", "val"): 45, ("drone", "train"): 225}
    out = str(tmp_path / "splits")
    for _ in range(2):
        T.write_split(frames.select("path", "side"), out, "grouped", 1)
    T.write_split(frames.select("path", "side").limit(3), out, "random", 1)
    assert T.read_split(spark, out, "grouped", 1).count() == 712 and T.read_split(spark, out, "random", 1).count() == 3
