"""The folder data source on generated folders."""

import os

import pytest

from sievecrest.sources import folders


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "assets"
    files = {
        "a.png": b"1", "b.JPG": b"22", "notes": b"", "cats/c.png": b"333", "cats/c_mask.png": b"4444",
        "cats/deep/d.jpeg": b"5" * 50, "dogs/e.png": b"6" * 6, "dogs/.hidden.png": b"x", "_SUCCESS": b"", "_tmp/f.png": b"x",
    }
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "empty").mkdir()
    return str(root)


SEEN = {"a.png", "b.JPG", "notes", "c.png", "c_mask.png", "d.jpeg", "e.png"}


def names(df):
    return {r["name"] for r in df.select("name").collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_and_content(spark, tree):
    rows = {r.name: r for r in folders.read_folder(spark, tree, content=True).collect()}
    assert set(rows) == SEEN
    assert (rows["b.JPG"].suffix, rows["b.JPG"].folder, rows["notes"].suffix) == (".jpg", "", "")
    assert rows["d.jpeg"].folder == "cats/deep" and rows["d.jpeg"].path == os.path.join(tree, "cats/deep/d.jpeg")
    assert all(r.bytes == len(r.content) for r in rows.values()) and bytes(rows["c.png"].content) == b"333"
    assert "content" not in folders.read_folder(spark, tree).columns
    assert names(folders.read_folder(spark, "file:" + tree)) == SEEN


@pytest.mark.parametrize(
    ("test", "expected"),
    [
        ("suffix = '.png'", {"a.png", "c.png", "c_mask.png", "e.png"}),
        ("suffix IN ('.jpg', '.jpeg')", {"b.JPG", "d.jpeg"}),
        ("folder = 'cats'", {"c.png", "c_mask.png"}),
        ("endswith(name, '_mask.png')", {"c_mask.png"}),
        ("startswith(folder, 'cats') AND suffix = '.png'", {"c.png", "c_mask.png"}),
        ("contains(name, 'c') AND bytes > 3", {"c_mask.png"}),
        ("suffix = '.jpg' OR name = 'a.png'", {"a.png", "b.JPG"}),
        ("folder = 'none'", set()),
    ],
)
def test_filters(spark, tree, test, expected):
    assert names(folders.read_folder(spark, tree).where(test)) == expected


def test_pushed_filters_stand_in_the_plan_and_spare_the_files(spark, tree):
    df = folders.read_folder(spark, tree, content=True).where("suffix = '.png'")
    assert "Filter (" not in plan(df)  # Spark has nothing left to filter
    reader = folders.FolderReader({"path": tree, "content": "true"})
    other = folders.ds.GreaterThan(("bytes",), 3)
    assert list(reader.pushFilters([folders.ds.EqualTo(("suffix",), ".png"), other])) == [other]
    assert {f[1] for p in reader.partitions() for f in p.files} == {"a.png", "c.png", "c_mask.png", "e.png"}


def test_partitions_are_cut_by_bytes_and_files(spark, tree):
    df = folders.read_folder(spark, tree, content=True, partition_bytes=10)
    assert df.rdd.getNumPartitions() >= 3 and names(df) == SEEN
    assert folders.read_folder(spark, tree, partition_files=2).rdd.getNumPartitions() == 4
    rows = [(f"p{i:02d}", "", "", "", 5, None) for i in range(10)]
    assert [len(p.files) for p in folders.planned(rows, 12, 100)] == [2] * 5
    assert [len(p.files) for p in folders.planned(rows, 1, 100)] == [1] * 10 and folders.planned([], 1, 1) == []


def test_empty_and_missing_folders(spark, tree):
    assert folders.read_folder(spark, tree + "/empty").count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        folders.read_folder(spark, tree + "/nothing").count()
