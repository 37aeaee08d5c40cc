import pytest
from pyspark.sql import functions as F

from colscope.functions import text, types, vectors
from colscope.functions.constants import FAMILIES, WORDINGS
from colscope.functions.embedding import LetterCounts, TransformerMean, encode_distinct, letter_counts, masked_mean


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("FECHA_NACIMIENTO", "fecha nacimiento"), ("fechaNacimiento", "fecha Nacimiento"), ("XMLParser", "xml Parser"), ("tbl_employees", "employees"), ("fkDeptoId", "foreign key Depto identifier"), ("EMP_ID", "employee identifier"), ("id,", "identifier"), ("COL_001", "001"), ("", ""), ("__", "")])
def test_names(spark, name, want):
    assert one(spark, text.clean_name(F.col("n")), n=name) == want


def test_name_with_table_and_comment(spark):
    got = one(spark, text.full_name(F.col("n"), F.col("t"), F.col("c")), n="FECHA", t="LECTORES", c=" dia ")
    assert got == "lectores: fecha | dia"
    assert one(spark, text.full_name(F.col("n"), F.col("t"), F.col("c")), n="FECHA", t=None, c="  ") == "fecha"


@pytest.mark.parametrize(("owner", "want"), [("app", "APP"), (' "App" ', "App"), ("APP", "APP")])
def test_owner(spark, owner, want):
    assert one(spark, text.owner_name(F.col("o")), o=owner) == want


@pytest.mark.parametrize(("declared", "want"), [("VARCHAR2(10)", "VARCHAR"), ("timestamp(6) with zone", "TIMESTAMP"), ("LONG RAW", "OTHER"), ("NUMERIC", "OTHER"), (None, "OTHER"), ("uROWID", "ROWID"), ("INT", "NUMBER")])
def test_canonical(spark, declared, want):
    assert one(spark, types.canonical_type(F.col("t")), t=declared) == want


@pytest.mark.parametrize(("declared", "want"), [("number", "number"), ("NUMBER(1)", None), ("TIMESTAMP(6)", "date"), (" CLOB ", "text"), ("", None)])
def test_category(spark, declared, want):
    assert one(spark, types.category(F.col("t")), t=declared) == want


@pytest.mark.parametrize(("name", "want"), [("ID", True), ("C1", True), ("COL_001", True), ("CLIENTE", False), ("c1", False), ("ABCDE", False)])
def test_generic(spark, name, want):
    assert one(spark, types.generic_name(F.col("n")), n=name) is want


def row(spark, **values):
    base = dict(data_type="NUMBER", data_precision=None, data_scale=None, char_length=None, data_length=None, is_foreign_key=False)
    schema = "data_type string, data_precision int, data_scale int, char_length int, data_length int, is_foreign_key boolean"
    return spark.createDataFrame([tuple((base | values).values())], schema)


@pytest.mark.parametrize(("values", "want"), [(dict(data_precision=1), ["amount", "boolean"]), (dict(data_precision=1, data_scale=2), ["amount"]), (dict(data_type="CHAR", data_length=4, char_length=1), ["text", "boolean"]), (dict(data_type="VARCHAR2", data_length=1), ["text", "boolean"]), (dict(is_foreign_key=True), ["amount", "reference"]), (dict(data_type="XMLTYPE"), []), (dict(data_type="BOOLEAN"), ["boolean"])])
def test_families(spark, values, want):
    got = row(spark, **values).select(types.declared_family().alias("f")).first()["f"]
    assert sorted(n for n, x in zip(FAMILIES, got, strict=True) if x) == sorted(want)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [0.2, 0.9, 0.9, 0.1, 0.0, 0.0])], "a array<double>, z array<double>, s array<double>")
    got = df.select(vectors.norm(F.col("a")).alias("n"), vectors.unit(F.col("z")).alias("z"), vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.first_argmax(F.col("s")).alias("i"), vectors.margin(F.col("s")).alias("m"), vectors.softmax(F.col("s"), 0.05).alias("p"), vectors.expectation(F.col("s")).alias("e")).first()
    assert (got["n"], got["z"], got["c"], got["i"], got["m"]) == (5.0, [0.0, 0.0], 0.0, 1, 0.0)
    assert abs(sum(got["p"]) - 1) < 1e-12 and got["e"] == [0, 1, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        vectors.expectation(F.col("s"), "soft", 0.0)
    with pytest.raises(ValueError):
        vectors.expectation(F.col("s"), "odd")


def test_conflicts_of_references(spark):
    sims = [0.1, 0.2, 0.9, 0.0, 0.0, 0.0]
    rows = [(sims, [0, 1, 0, 0, 0, 0], True, False), (sims, [0, 1, 0, 0, 0, 0], False, False), (sims, [0, 1, 1, 0, 0, 0], False, True), (sims, [1, 0, 0, 0, 0, 0], False, False)]
    df = spark.createDataFrame([(s, [float(x) for x in d], p, f) for s, d, p, f in rows], "s array<double>, d array<double>, p boolean, f boolean")
    got = [r["b"] for r in df.select(vectors.conflict_block(F.col("s"), F.col("d"), F.col("p"), F.col("f")).alias("b")).collect()]
    assert got[0][:6] == [0] * 6 and got[0][13] == 0
    assert got[1][:6] == [0] * 6 and got[1][13] == 1
    assert got[2][:6] == [0, -1, 0, 0, 0, 0] and got[2][13] == 0
    assert got[3][:6] == [-1, 0, 1, 0, 0, 0] and got[3][13] == 0
    assert all(len(b) == 14 and abs(b[12] - 0.7) < 1e-12 for b in got)


def test_encoders(spark):
    df = spark.createDataFrame([("Abba",), ("zz",), (None,), ("Abba",)], "t string")
    got = encode_distinct(df.where("t is not null"), "t", LetterCounts, "v").withColumn("w", letter_counts(F.col("t"))).collect()
    assert len(got) == 3 and all(r["v"] == r["w"] for r in got)
    mean = masked_mean(__import__("numpy").array([[[3.0, 0.0], [9.0, 9.0]]]), __import__("numpy").array([[1, 0]]))
    assert mean.tolist() == [[1.0, 0.0]]
    assert TransformerMean().encode([]).shape == (0, 0)
    assert list(WORDINGS) == ["orig", "W2", "W3"] and all(list(w) == FAMILIES for w in WORDINGS.values())
