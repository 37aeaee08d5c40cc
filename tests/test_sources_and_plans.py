import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from colscope.errors import CatalogError, ClusteringError, ConfigError, ConnectionFailed, EncodingError, SchemaQualityError
from colscope.functions.constants import CONFLICT_WEIGHTS, DEFAULT_WEIGHTS, FUSED_WEIGHTS, GRID
from colscope.functions.embedding import LetterCounts, TransformerMean
from colscope.operators import kernels, reduction
from colscope.operators.reduction import Reducer
from colscope.plans import admin, blind, cli, experiments, fixtures, queries, report
from colscope.plans.features import build_blocks, use_wording
from colscope.sources import catalog, config, labels, sinks

SF = "/root/testdata/sf0.001"


def test_config(tmp_path):
    good = tmp_path / "c.yaml"
    good.write_text("database:\n  user: app\n  password: 'x y'\n  dsn: host:1521/db\n")
    options = config.jdbc_options(config.load_config(str(good)))
    assert options["url"] == "jdbc:oracle:thin:@host:1521/db" and options["password"] == "x y"
    for text in ("", "just words", "[1, 2"):
        good.write_text(text)
        with pytest.raises(ConfigError):
            config.load_config(str(good))
    with pytest.raises(ConfigError):
        config.load_config(str(tmp_path / "none.yaml"))
    with pytest.raises(ConfigError):
        config.jdbc_options({"database": {"user": "a"}})


def test_catalog(spark, tmp_path):
    views = fixtures.views(spark)
    rows = catalog.catalog(views, "APP")
    got = {(r["table_name"], r["column_name"]): r for r in rows.collect()}
    assert len(got) == 24 and ("VISTA_X", "ID") not in got
    assert [r["pos"] for r in rows.orderBy("table_name", "column_id").collect()] == list(range(24))
    assert got["BIBLIOTECAS", "SOCIO_ID"]["fk_references_table"] == "SOCIOS"
    assert got["LECTORES", "EMP_ID"]["is_primary_key"] and got["LECTORES", "EMP_ID"]["is_indexed"] and not got["LECTORES", "EMP_ID"]["is_unique"]
    assert got["LECTORES", "CUOTA"]["char_length"] is None and got["LECTORES", "CUOTA"]["comments"] == "Bruto al mes. "
    catalog.snapshot(views, str(tmp_path))
    assert catalog.catalog(catalog.parquet_views(spark, str(tmp_path)), "APP").count() == 24
    with pytest.raises(CatalogError):
        catalog.catalog({k: v for k, v in views.items() if k != "all_tables"}, "APP")
    with pytest.raises(ConnectionFailed):
        catalog.jdbc_views(spark, {"url": "jdbc:none:x", "driver": "no.Such"}, "APP")
    assert catalog.catalog_json(rows).where(F.col("json").contains('"column_name":"CUOTA"')).count() == 1
    assert catalog.catalog(views, "NOBODY").count() == 0


def test_labels(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("table,column,data_type,label\nt,a,NUMBER, CLEAN \nt,b,DATE,eav\nt,a,NUMBER,eav\n")
    got = {(r["table_name"], r["column_name"]): r["label"] for r in labels.load_labels(spark, str(path)).collect()}
    assert got == {("T", "A"): "eav", ("T", "B"): "eav"}
    columns = spark.createDataFrame([("t", "a"), ("t", "c")], "table_name string, column_name string")
    assert [tuple(r) for r in labels.missing_labels(columns, labels.load_labels(spark, str(path))).collect()] == [("t", "c")]
    with pytest.raises(CatalogError, match="t.c"):
        labels.align_labels(columns, labels.load_labels(spark, str(path)))
    for text in ("table,column,data_type,label\n", "table,column,data_type,label\nt,a,X,\n", "table,column,data_type,label\nt,a,X,pretty\n", "table,column\nt,a\n"):
        path.write_text(text)
        with pytest.raises(CatalogError):
            labels.load_labels(spark, str(path))


def dataset(spark):
    return queries.dataset(spark)


def test_feature_job_and_sinks(spark, tmp_path):
    rows = catalog.catalog(fixtures.views(spark), "APP")
    blocks = build_blocks(rows, LetterCounts, mismatch=True, prefix="query: ")
    got = {r["column_name"]: r for r in blocks.collect()}
    assert got["CUOTA"]["document"] == "query: tabla lectores, columna cuota, tipo numero decimal con 12 digitos y 2 decimales, admite nulos, indexada. La tabla contiene: Personas que leen aqui. Bruto al mes."
    widths = {c: len(got["CUOTA"][c]) for c in ("e_text", "e_type", "e_rest", "e_stat", "e_table", "e_conflict", "e_name", "name_intrinsic")}
    assert widths == {"e_text": 27, "e_type": 12, "e_rest": 5, "e_stat": 1, "e_table": 5, "e_conflict": 14, "e_name": 26, "name_intrinsic": 2}
    assert use_wording(blocks, "W3").first()["e_conflict"] is not None
    assert len(build_blocks(rows, LetterCounts, text="anchors").first()["e_text"]) == 12
    sinks.write_blocks(blocks, str(tmp_path / "b"), {"encoder": "letters"})
    assert sinks.read_blocks(spark, str(tmp_path / "b")).count() == 24
    keys = catalog.choose_primary_key(rows)
    sinks.write_ddl(rows, keys, catalog.infer_foreign_keys(rows, keys), str(tmp_path / "ddl"))
    assert spark.read.text(str(tmp_path / "ddl")).where(F.col("value").startswith("CREATE TABLE")).count() == 5
    health = spark.createDataFrame([("k", "eav", float("nan"), 3, True, "x"), ("l", "clean", 0.123456, 0, False, "y")], "key string, predicted_label string, confidence double, severity int, low_support boolean, recommendation string")
    assert [r["confidence"] for r in sinks.health_rows(health).orderBy("key").collect()] == [None, 0.1235]
    assert sinks.first_documents(blocks.select("pos", "document")).count() == 5


def test_experiments(spark):
    ds = dataset(spark)
    found = kernels.cluster(experiments.reduced(ds, DEFAULT_WEIGHTS, 5), "agglomerative", k=4)
    assert experiments.score(ds.join(found, "key"), "label", "cluster", "key", "table_name").first()["n_groups"] == 4
    for algorithm in ("ward", "hdbscan"):
        assert experiments.blind_partition(ds, CONFLICT_WEIGHTS, algorithm).count() == 24
    with pytest.raises(ClusteringError):
        experiments.blind_partition(ds, CONFLICT_WEIGHTS, "odd")
    with pytest.raises(CatalogError):
        experiments.over_wordings(ds.drop("e_conflict_variants"))
    drawn = experiments.resamples(ds, 4, 0.5)
    assert {r["n"] for r in drawn.groupBy("resample").agg(F.count("*").alias("n")).collect()} == {12}
    with pytest.raises(CatalogError):
        experiments.resamples(ds, 4, 1.5)
    whole = experiments.bootstrap_pipeline(ds.select("key", "label"), {"const": lambda pdf: {"ari": float(len(pdf))}}, 3, 0.5)
    assert [r["ari"] for r in whole.collect()] == [12.0] * 3
    cells = spark.createDataFrame([(0, float("nan")), (1, 0.4), (2, 0.4)], "cell int, validity double")
    assert [r["cell"] for r in experiments.choose_cell(cells).collect()] == [1]
    assert experiments.choose_cell(cells.limit(1)).count() == 0


def test_bootstrap_runs_the_pipeline_again(spark):
    ds = dataset(spark)
    drawn = ds.join(experiments.resamples(ds, 2).where("resample = 1").select("key"), "key")
    scorers = {a: blind.blind_scorer(FUSED_WEIGHTS, a) for a in ("ward", "hdbscan", "two-level")}
    rows = {r["config"]: r for r in experiments.bootstrap_pipeline(blind.inputs(ds), scorers, 2).where("resample = 1").collect()}
    whole = {r["config"]: r for r in experiments.point_estimates(blind.inputs(ds), scorers).collect()}
    for algorithm in scorers:
        for rows_of, got in ((drawn, rows), (ds, whole)):
            rows_of = experiments.clustering.checkpoint(rows_of)
            want = experiments.score(rows_of.join(experiments.blind_partition(rows_of, FUSED_WEIGHTS, algorithm), "key"), "label", "cluster", "key", "table_name").first()
            assert [got[algorithm][m] for m in blind.METRICS] == pytest.approx([want[m] for m in blind.METRICS], abs=1e-9)
    mean = experiments.point_estimates(blind.inputs(ds), {"mean": blind.wordings_scorer(FUSED_WEIGHTS)}).first()
    each = [r["ari"] for r in experiments.over_wordings(ds, FUSED_WEIGHTS).collect()]
    assert len(each) == 3 and mean["ari"] == pytest.approx(sum(each) / 3, abs=1e-9)


def test_bootstrap_verb_compares_all_configurations(spark):
    out = cli.resampled(dataset(spark), 2, 0.8)
    assert all(name in out for name in ("document / ward", "conflict default / ward", "conflict mean / hdbscan", "two-level mean - conflict mean / ward"))
    assert cli.parser().parse_args(["experiment", "--blocks", "b", "--labels", "l", "--bootstrap", "2"]).bootstrap_mode == "subsample"


def test_flags_run_every_configuration(spark, tmp_path, monkeypatch):
    ds = experiments.clustering.checkpoint(dataset(spark).withColumn("label", F.when(F.col("pos") % 2 == 0, "clean").otherwise("eav")))
    conflict = cli.conflicts(ds)
    assert all(f"{name} / {a}" in conflict[0] for name in ("document", "conflict", "conflict fused") for a in ("ward", "hdbscan")) and "top_labels" in conflict[1]
    assert all(f"{w} / hdbscan" in cli.wordings(ds, "hdbscan")[0] for w in ("orig", "W2", "W3"))
    assert "conflict fused / two-level" in cli.two_levels(ds)[0]
    rows = cli.verdicts(ds).collect()
    assert len(rows) == 24 and set(rows[0].asDict()) == {"key", "truth", "cluster_id", "predicted"} and len({r["key"] for r in rows}) == 24
    found = []
    monkeypatch.setattr(cli, "labelled", lambda spark, blocks, labels, without: ds)
    monkeypatch.setattr(experiments, "ablation", lambda sets, weights: found.extend(sets) or experiments.evaluate("x", ds, weights))
    monkeypatch.setattr(cli.forest, "baseline", lambda rows, label, pos: found.append("forest") or rows.select(F.lit(0).alias("fold")).limit(1))
    monkeypatch.setattr(experiments, "compare_algorithms", lambda ds, points: points.limit(1))
    cli.experiment(spark, cli.parser().parse_args(["experiment", "--blocks", "a", "--labels", "l", "--baselines", "--ablation", "x/b", "x/c"]))
    assert found == ["full", "b", "c", "forest"]


def test_queries_run_with_default_settings(spark, monkeypatch):
    assert queries.QUERIES["hdbscan_grid"](spark, SF).select("min_cluster_size", "min_samples").distinct().count() == len(GRID)
    seen = {}
    monkeypatch.setattr(queries.forest, "baseline", lambda *a, **k: seen.setdefault("baseline", k))
    monkeypatch.setattr(queries.forest, "out_of_fold", lambda rows, *a, **k: (seen.update(oof=k), rows.withColumns({c: F.lit(0) for c in ("predicted", "confidence", "fold")}))[1])
    monkeypatch.setattr(queries.experiments, "reduced", lambda ds, *a: seen.setdefault("reduced", a) and ds)
    monkeypatch.setattr(queries.experiments, "compare_algorithms", lambda ds, points: points)
    monkeypatch.setattr(queries, "dataset", lambda spark: spark.range(1))
    for name in ("forest_baseline", "forest_oof", "algorithm_comparison"):
        queries.QUERIES[name](spark, SF)
    assert seen == {"baseline": {}, "oof": {}, "reduced": (DEFAULT_WEIGHTS,)}
    assert queries.QUERIES["bootstrap_fixed_200"](spark, SF).select("resample").distinct().count() == 200


def test_reports():
    text = report.render(["a", "bb"], [["x", 0.5], ["yy", float("nan")]])
    assert text.splitlines() == ["a   bb", "--  ------", "x   0.5000", "yy  n/a"]
    with pytest.raises(ValueError):
        report.render(["a"], [["x", "y"]])
    assert issubclass(ConfigError, SchemaQualityError)


def test_command_line(spark, tmp_path, capsys):
    rows = build_blocks(catalog.catalog(fixtures.views(spark), "APP"), LetterCounts)
    sinks.write_blocks(rows, str(tmp_path / "b"), {})
    lines = [f"{r['table_name']},{r['column_name']},{r['data_type']},{'eav' if r['pos'] % 2 else 'clean'}" for r in rows.select("table_name", "column_name", "data_type", "pos").collect()]
    (tmp_path / "l.csv").write_text("\n".join(["table,column,data_type,label", *[x.replace("None", "") for x in lines]]) + "\n")
    assert cli.main(["experiment", "--blocks", str(tmp_path / "b"), "--labels", str(tmp_path / "l.csv"), "--conflict", "--bootstrap", "3", "--csv", str(tmp_path / "out")]) == 0
    assert "structure only" in capsys.readouterr().out
    assert cli.main(["score", "--reference", str(tmp_path / "b"), "--labels", str(tmp_path / "l.csv"), "--folds", "3"]) == 0
    assert "Health" in capsys.readouterr().out
    (tmp_path / "few.csv").write_text("table,column,data_type,label\n")
    assert cli.main(["score", "--reference", str(tmp_path / "b"), "--labels", str(tmp_path / "few.csv")]) == 1


def run(capsys, *argv):
    code = cli.main(list(argv))
    return code, capsys.readouterr()


def test_catalog_verbs(spark, tmp_path, capsys):
    folder, form = str(tmp_path / "views"), str(tmp_path / "form")
    catalog.snapshot(fixtures.views(spark), folder)
    source = ["--views", folder, "--owner", "app"]
    code, said = run(capsys, "build", *source, "--dry-run", "--query-prefix", "query: ")
    assert code == 0 and said.out.count("query: ") == 5 and "24 columns" in said.out
    code, _ = run(capsys, "build", *source, "--model", "letters", "--out", str(tmp_path / "b"), "--mismatch", "--no-table-comment")
    blocks = sinks.read_blocks(spark, str(tmp_path / "b"))
    assert code == 0 and blocks.count() == 24 and len(blocks.first()["e_text"]) == 27
    assert dict(tuple(r) for r in spark.read.parquet(str(tmp_path / "b" / "meta")).collect())["model"] == "letters"
    assert run(capsys, "build", *source, "--model", "letters")[0] == 1 and run(capsys, "build", "--views", folder)[0] == 1
    assert run(capsys, "labels", *source, "--out", form)[0] == 0
    rows = spark.read.csv(form, header=True)
    assert rows.count() == 24 and rows.columns == ["table", "column", "data_type", "label"]
    filled = rows.withColumn("label", F.lit("clean")).toPandas()
    filled.to_csv(tmp_path / "l.csv", index=False)
    code, said = run(capsys, "ddl", "--labels", str(tmp_path / "l.csv"), "--out", str(tmp_path / "ddl"))
    assert code == 0 and "CREATE TABLE" in spark.read.text(str(tmp_path / "ddl"), wholetext=True).first()[0]
    upper = filled.assign(table=filled["table"].str.upper(), column=filled["column"].str.upper())
    upper.iloc[1:].to_csv(tmp_path / "less.csv", index=False)
    code, said = run(capsys, "verify", *source, "--labels", str(tmp_path / "less.csv"))
    assert code == 1 and f"extra columns: {filled['table'][0]}.{filled['column'][0]}" in said.out and "24 columns" in said.out
    table = filled["table"][0]
    (tmp_path / "c.csv").write_text(f"table,column,comment\n{table},,The table's own\n{table},{filled['column'][0]},A column\nNOWHERE,,x\n")
    code, said = run(capsys, "comments", *source, "--comments", str(tmp_path / "c.csv"))
    assert code == 0 and "skipped: no table NOWHERE" in said.out and "'The table''s own'" in said.out and said.out.count("COMMENT ON") == 2
    assert run(capsys, "comments", *source, "--comments", str(tmp_path / "c.csv"), "--apply")[0] == 1


def test_verify_agrees(spark, tmp_path, capsys):
    names = {c: df for c, df in fixtures.views(spark).items()}
    upper = {v: df.withColumns({c: F.upper(c) for c in ("table_name", "column_name") if c in df.columns}) for v, df in names.items()}
    catalog.snapshot(upper, str(tmp_path / "v"))
    rows = catalog.catalog(upper, "APP")
    rows.select(F.col("table_name").alias("table"), F.col("column_name").alias("column"), "data_type", F.lit("clean").alias("label")).toPandas().to_csv(tmp_path / "l.csv", index=False)
    code, said = run(capsys, "verify", "--views", str(tmp_path / "v"), "--owner", '"APP"', "--labels", str(tmp_path / "l.csv"))
    assert code == 0 and "the schema is that of the label file" in said.out


def test_views_and_statements_over_jdbc(spark, tmp_path, capsys):
    """The dictionary in an embedded database, with the session's own owner, and statements run in it."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    options = {"url": url, "driver": driver, "user": "APP", "password": "x"}
    kinds, made = {"string": "VARCHAR(200)", "bigint": "BIGINT", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}, []
    value = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if not isinstance(x, int) else str(x)
    for view, df in [*fixtures.views(spark).items(), ("dual", spark.createDataFrame([("X",)], "dummy string"))]:
        made.append(f"CREATE TABLE {view} ({', '.join(f'{f.name} {kinds[f.dataType.simpleString()]}' for f in df.schema.fields)})")
        made += [f"INSERT INTO {view} VALUES ({', '.join(map(value, r))})" for r in df.collect()]
    admin.run_statements(spark, made, options)
    found, owner = catalog.jdbc_views(spark, options)
    assert owner == "APP"
    key = ["table_name", "column_name", "pos", "is_primary_key", "fk_name"]
    want = catalog.catalog(fixtures.views(spark), "APP").select(*key).collect()
    assert sorted(map(str, catalog.catalog(found, owner).select(*key).collect())) == sorted(map(str, want))
    admin.run_statements(spark, ["CREATE TABLE noted (x INTEGER)", "INSERT INTO noted VALUES (7)"], options)
    assert spark.read.format("jdbc").options(**options, dbtable="NOTED").load().first()[0] == 7
    with pytest.raises(SchemaQualityError):
        admin.run_statements(spark, ["INSERT INTO noted VALUES (8)", "NOT A STATEMENT"], options)
    assert spark.read.format("jdbc").options(**options, dbtable="NOTED").load().count() == 1
    with pytest.raises(SchemaQualityError):
        catalog.jdbc_views(spark, options | {"url": f"jdbc:derby:{tmp_path}/nowhere"})


class _Words:
    """A tokenizer and network that know words by their length: states are (length, length squared)."""

    def __init__(self):
        self.cut = []

    def __call__(self, texts, padding, truncation, max_length, return_tensors):
        rows = [[len(w) for w in t.split()][:max_length] for t in texts]
        self.cut.append(max_length)
        width = max(map(len, rows), default=0)
        return {"ids": np.array([r + [0] * (width - len(r)) for r in rows], float), "attention_mask": np.array([[1] * len(r) + [0] * (width - len(r)) for r in rows])}


class _States:
    def __init__(self, x):
        self.last_hidden_state = self
        self.x = x

    def detach(self):
        return self

    cpu = detach

    def __array__(self, dtype=None, copy=None):
        return self.x


def test_encoder_over_a_stub_network():
    words = _Words()
    e = TransformerMean(tokenizer=words, network=lambda ids, attention_mask: _States(np.stack([ids, ids**2], axis=-1)), longest=3)
    got = e.encode(["a bb", "ccc", "a a a aaaa"] * 20, batch=7)
    assert got.shape == (60, 2) and set(words.cut) == {3} and len(words.cut) == 9
    mean = np.array([[1.5, 2.5], [3, 9], [1, 1]])
    assert np.allclose(got[:3], mean / np.linalg.norm(mean, axis=1, keepdims=True), atol=1e-6) and np.allclose(got[3:6], got[:3])
    assert np.allclose(e.encode_single("ccc"), got[1]) and e.encode([]).shape == (0, 0)
    e.unload()
    assert e.network is None
    with pytest.raises(EncodingError):
        TransformerMean(tokenizer=words, network=lambda **_: 1 / 0).encode(["x"])


def test_umap_through_its_library(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0 * i]) for i in range(20)], "key long, vector array<double>")
    with pytest.warns(UserWarning, match="pca"):
        assert len(Reducer("umap", 2).fit_transform(df).first()["reduced"]) == 2
    monkeypatch.setattr(reduction, "has_umap", lambda: True)
    monkeypatch.setattr(reduction, "_umap", lambda x, k, seed: x[:, :k] * 2)
    got = Reducer("umap", 2).fit_transform(df).collect()
    assert len(got) == 20 and all(r["reduced"] == [2 * x for x in r["vector"][:2]] for r in got)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gather_reads_every_document(spark):
    got = queries.QUERIES["whole_gather"](spark, SF)
    ids = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    times = got.groupBy("doc_id").agg(F.countDistinct("out_pos").alias("n"))
    assert ids.count() > 100 and [tuple(r) for r in ids.join(times, "doc_id", "left").select("n").distinct().collect()] == [(3,)]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(float(r[i]), 5) + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    out = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(out.fetchall(), columns)
