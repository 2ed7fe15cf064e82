from pyspark.sql import types as T

from faultline.sources import files


def test_only_lines_with_too_many_fields_are_dropped(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,x,5\n2,y,\n3,,\n,,\n4,"p,q",""\n5,z\n### corrupt ###\n6,w,7,8\n7,w,7,\n8,v,no\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("c", T.IntegerType())])
    back = files.read_csv_tolerant(spark, str(tmp_path), schema)
    got = sorted(((r.a, r.b or None, r.c) for r in back.collect()), key=str)
    assert got == sorted([(1, "x", 5), (2, "y", None), (3, None, None), (None, None, None), (4, "p,q", None), (5, "z", None), (None, None, None), (8, "v", None)], key=str)
    assert back.count() == 8 and back.select("b").count() == 8
    strict = files.read_csv_tolerant(spark, str(tmp_path), schema, strict=True)
    assert strict.count() == 6
