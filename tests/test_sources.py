import numpy as np
import pytest

from quern.sources import fits, text


def test_delimited_types(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('PERSON_ID\tSTART_DATE\tYEAR_OF_BIRTH\tname\n1\t2020-01-02\t1950\t"a\n2\t\t\tb\n')
    rows = text.read_delimited(spark, str(tmp_path / "t.tsv")).collect()
    assert [tuple(r) for r in rows] == [(1, 1577923200.0, 1950, '"a'), (2, None, None, "b")]


def test_matrices(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a b\n1 2\n\n3 4\n")
    assert [r["values"] for r in text.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("line").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "t.txt").write_text("N_POINTS 2\nDIMENSION 2 # two\nDATA\n1 2\n3 x\n")
    assert [r["values"] for r in text.read_tagged_matrix(spark, str(tmp_path / "t.txt")).orderBy("line").collect()] == [[1, 2], [3, -888]]
    (tmp_path / "bad.txt").write_text("N_POINTS 3\nDATA\n1 2\n")
    with pytest.raises(ValueError):
        text.read_tagged_matrix(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "s.txt").write_text("1 1:0.5 3:2\n-1\n")
    assert [tuple(r) for r in text.read_sparse(spark, str(tmp_path / "s.txt")).collect()] == [(1.0, [1, 3], [0.5, 2.0]), (-1.0, [], [])]


def test_images(spark, tmp_path):
    image = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "a.fits").write_bytes(fits.write_image(image, {"PLATEID": 266, "NAME": "x"}))
    cards, data = fits.read_extensions((tmp_path / "a.fits").read_bytes())[0]
    assert cards["PLATEID"] == 266 and cards["NAME"] == "x" and np.array_equal(data, image)
    rows = fits.read_images(spark, str(tmp_path)).orderBy("row").collect()
    assert [r["values"] for r in rows] == image.tolist()
