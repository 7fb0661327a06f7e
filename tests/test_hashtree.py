"""The stored hash tree against the fingerprint and the diff of whole snapshots."""

import shutil
from random import Random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import changes as X
from tallyloom.operators.hashtree import NODE, HashTree

SCHEMA = "path string, digest string"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _root(tree, version=None):
    return [tuple(r) for r in tree.root(version).collect()]


def _want(spark, live, rows):
    return [(r.fingerprint, len(live)) for r in X.fingerprint(_df(spark, list(live.items())), rows=rows).collect()]


def _diff(old, new):
    return {(p, "added" if p not in old else "deleted" if p not in new else "changed", old.get(p), new.get(p)) for p in old.keys() | new.keys() if old.get(p) != new.get(p)}


def test_tree_follows_change_sets(spark, tmp_path):
    random, live, kept = Random(5), {}, []
    tree = HashTree(spark, f"file://{tmp_path}/t", rows=1, fan=3)
    sets = [{f"d/{i}": f"h{i}" for i in range(200)}, {"d/3": "new", "d/4": None, "none": None, "é/1": "x"}, {f"d/{i}": "late" for i in random.sample(range(400), 30)}]
    sets += [{f"e/{i}": "y" for i in range(90)}, {"e/1": None, "d/7": "z"}]  # passes 256 files: a deeper tree
    for version, change in enumerate(sets):
        tree.update(_df(spark, list(change.items())), version)
        live = {p: d for p, d in (live | change).items() if d is not None}
        kept.append(live)
        assert _root(tree) == _want(spark, live, 1)
    assert {tuple(r) for r in tree.files().collect()} == set(live.items())
    assert [digits for _, digits in tree.versions().values()] == [2, 2, 2, 4, 4]
    for a, b in ((0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (1, 1)):  # 2 to 3 crosses the new tree
        got = tree.diff(a, b, "g")
        assert {tuple(r)[:4] for r in got.collect()} == {(p, op, x, y) for p, op, x, y in _diff(kept[a], kept[b])}
    whole = X.diff_snapshots(_df(spark, list(kept[0].items())), _df(spark, list(kept[2].items())), "g")
    assert {tuple(r) for r in tree.diff(0, 2, "g").collect()} == {tuple(r) for r in whole.collect()}


def test_only_nodes_above_changes_are_written(spark, tmp_path):
    tree = HashTree(spark, f"file://{tmp_path}/t", rows=4)
    many = spark.range(3_000).select(F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), F.md5(F.col("id").cast("string")).alias("digest"))
    tree.update(many, 1)
    tree.update(many.limit(3).withColumn("digest", F.lit("other")).unionByName(many.filter("path = 'p/9999'")), 2)
    built, digits = tree.versions()[2]
    runs = {r.number: r.rows for r in tree._table(built).manifest(2)}
    assert digits == 4 and runs[1] > 2_000 and runs[2] == 3 + 3 + 1  # leaves, their parents, the root; an equal digest changes nothing
    assert tree.diff(1, 2, "g").count() == 3
    tree.update(many.limit(5).withColumn("digest", F.lit("late")), 2)  # a version that is there already is left
    assert tree.diff(1, 2, "g").count() == 3


@pytest.mark.parametrize("rows", [[], [(None, "x"), (None, None)], [("a", None)]])
def test_empty_trees(spark, tmp_path, rows):
    tree = HashTree(spark, f"file://{tmp_path}/t")
    tree.update(_df(spark, rows), 1)
    assert _root(tree) == [] and tree.files().count() == 0
    tree.update(_df(spark, [("a", "1"), ("a", "2"), ("a", None), (None, "z")]), 2)
    assert _root(tree) == _want(spark, {"a": "2"}, 256) and [tuple(r)[:4] for r in tree.diff(1, 2, "g").collect()] == [("a", "added", None, "2")]
    tree.update(_df(spark, [("a", None)]), 3)
    assert _root(tree) == [] and tree.files().count() == 0
    assert NODE.names == tree._table(1).read(3).columns


def test_build_that_was_cut_off_is_taken_up(spark, tmp_path):
    tree = HashTree(spark, f"file://{tmp_path}/t")
    tree.update(_df(spark, [("a", "1"), ("b", "2")]), 1)
    whole = _root(tree)
    shutil.rmtree(tmp_path / "t" / "trees")  # written last: without it there is no version
    assert tree.versions() == {}
    tree.update(_df(spark, [("a", "1"), ("b", "2")]), 1)
    assert _root(tree) == whole
