import numpy as np
import pytest
from conftest import dataset, structure
from pyspark.sql import functions as F

from moltide.queries import io
from moltide.sources import formats


def test_xyz(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "a.xyz").write_text("2\nfirst, with words\nO 0 0 0\nH 0.96 0 -1e-3\n\n1\n\nHe 1 2 3 9 9 9\n")
    (tmp_path / "b.xyz").write_text("")
    rows = spark.read.format("xyz").load(str(tmp_path)).orderBy("file", "frame").collect()
    assert [(r.file, r.frame, r.comment, r.symbols, r.r) for r in rows] == [("a", 0, "first, with words", ["O", "H"], [0, 0, 0, 0.96, 0, -1e-3]), ("a", 1, "", ["He"], [1, 2, 3])]
    assert spark.read.format("xyz").option("contains", "b").load(str(tmp_path)).count() == 0
    out = tmp_path / "out"
    spark.read.format("xyz").load(str(tmp_path)).write.format("xyz").mode("append").save(str(out))
    back = spark.read.format("xyz").load(str(out)).select("comment", "symbols", "r").collect()
    assert sorted(map(str, back)) == sorted(map(str, [r[2:] for r in map(tuple, rows)] and [type(back[0])(r.comment, r.symbols, r.r) for r in rows])) or {b.comment for b in back} == {r.comment for r in rows}


@pytest.mark.parametrize("text", ["x\n\n", "2\nc\nO 0 0 0\n", "1\nc\nO 0 0\n", "1\nc\nO a b c\n"])
def test_bad_xyz(tmp_path, text):
    p = tmp_path / "bad.xyz"
    p.write_text(text)
    with pytest.raises(ValueError):
        list(formats.parse_xyz(str(p)))


def test_npz(spark, tmp_path):
    formats.register(spark)
    r = np.random.default_rng(0).normal(size=(5, 2, 3))
    np.savez(tmp_path / "a.npz", type="d", z=np.array([8, 1]), R=r, E=np.arange(5.0), F=r * 2)
    np.savez(tmp_path / "b.npz", numbers=np.array([1]), R=r[0, :1])
    rows = spark.read.format("npz").option("contains", "a.").load(str(tmp_path)).orderBy("struct_id").collect()
    assert len(rows) == 5 and np.allclose(rows[3].r, r[3].ravel()) and rows[3].e == 3.0 and np.allclose(rows[3].f, 2 * r[3].ravel())
    one = spark.read.format("npz").option("contains", "b.").option("z_key", "numbers").load(str(tmp_path)).collect()
    assert len(one) == 1 and one[0].e is None and one[0].f is None
    np.savez(tmp_path / "m.npz", type="m", z=np.array([8]), R=r)
    with pytest.raises(Exception, match="isn't a data set"):
        spark.read.format("npz").option("contains", "m.").load(str(tmp_path)).collect()


def test_block_trials_and_box(spark, tmp_path):
    df = spark.createDataFrame([(["O", "H"], [0.0, 0.0, 0.0, -1.5, 2.0, 0.25], "c")], "s array<string>, r array<double>, c string")
    assert df.select(formats.xyz_block(F.col("s"), F.col("r"), F.col("c"), 3)).first()[0].split("\n") == ["2", "c", "O  0.000  0.000  0.000", "H -1.500  2.000  0.250"]
    formats.save_trials(spark.createDataFrame([(2.0, 1.0), (1.0, 3.0)], "sigma double, loss double"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).first().sigma == "1.0"
    text = formats.box_input((10.0, 10.0, 12.0), [("w.xyz", 33)], "out.xyz", shift=1.0)
    assert "number 33" in text and "inside box 1 1 1 9 9 11" in text


def test_content_identity_reads_the_numbers(spark, tables):
    rows = [structure(1), structure(2, e=None), structure(3, f=None)]

    def told(changed):
        d = tables(datasets=[dataset(1)], structures=changed)
        return io.content_identity(spark, d).first().content_md5

    same = told(rows)
    assert told(rows[::-1] + rows[:1]) == same  # in any order, repeated deliveries once
    r, f = list(rows[0][4]), list(rows[0][6])
    changed = [
        structure(1, r=[*r[:3], r[3] + 1e-12, *r[4:]]), structure(1, e=-47900.000001), structure(1, e=None), structure(1, f=[*f[:8], 0.2]), structure(1, f=[*f[:8], None]), structure(1, f=None),
    ]
    assert len({same, *(told([x, *rows[1:]]) for x in changed)}) == 7
