"""Files: labels and formats, folders of PDFs, libraries; functions that no query covers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import text as tx
from tessera.operators import analysis, gates, tables, workflow
from tessera.operators.fixed_effects import demeaned, shared_cells
from tessera.sources import files


def test_inspection_names_labels_and_format(spark, tmp_path):
    pd.DataFrame({"firm": [1, 2], "y": [0.5, np.nan]}).to_stata(tmp_path / "a.dta", write_index=False, variable_labels={"firm": "the firm"})
    got = files.inspect_file(spark, str(tmp_path / "a.dta")).orderBy("seq").collect()
    assert [(r.name, r.label, r.format, r.sheets) for r in got] == [("firm", "the firm", "dta", []), ("y", None, "dta", [])]
    (tmp_path / "a.csv").write_text("firm,y\n1,2.5\n")
    assert [(r.name, r.type, r.format) for r in files.inspect_file(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()] == [("firm", "int", "csv"), ("y", "double", "csv")]


def test_folder_of_pdfs(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1 x"), ("b.PDF", b"no pdf"), ("c.pdf", b""), ("d.txt", b"%PDF"), ("e.pdf", b"%PDF" + b"x" * 100), ("z.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.problem, r.content is not None) for r in files.scan_folder(spark, str(tmp_path), most_files=3, most_bytes=50).collect()}
    assert got == {"a.pdf": (None, True), "b.PDF": ("not_a_pdf", False), "e.pdf": ("too_large", False)}


def test_library_lines_of_wrong_types(spark):
    lines = ['{"title": "A", "year": 2000, "authors": ["x", "y\\" z"]}', '{"title": "A", "authors": "x"}', '{"title": "A", "authors": [1]}', '{"title": "A", "venue": 3}', '{"title": " "}', '{"title": "A", "year": 1.5}', "{broken", "7", '{"title": "B", "year": null}']
    read = files.read_library(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    assert [r.line for r in read.where("valid").orderBy("line").collect()] == [0, 8]
    assert sorted(r.line for r in files.bad_lines(read).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_written_tables_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(EngineError):
        tables.shared_path(Session(), "x")


def test_texts_and_identifiers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.json_set(F.lit('{"a": "1"}'), {"b": F.lit("2"), "a": F.lit("3")})) in ('{"b":"2","a":"3"}', '{"a":"3","b":"2"}')
    assert one(tx.json_remove(F.lit('{"a": "1"}'), ["a"])) == "{}" and one(tx.json_remove(F.lit("[1]"), ["a"])) == "[1]"
    rows = workflow.identified(spark.createDataFrame([("x", None), ("y", "kept")], "name string, id string"), "run").orderBy("name").collect()
    assert rows[0].id.startswith("run_") and rows[1].id == "kept" and rows[0].created_at is not None
    assert one(tx.hash_pick(F.lit("abc"), ["p", "q", "r"])) == "pqr"[(((97 * 31) + 98) * 31 + 99) % 3]


def test_reasons_of_a_verdict(spark):
    schema = "coef double, p double, pretrend_p double, n_checks long, n_same_sign long, permutation_p double, consistent boolean, method_family string, real_assignment boolean, semantics string"
    rows = [(0.3, 0.01, 0.5, 4, 4, 0.01, True, "policy_causal", True, "real_assignment"), (0.3, 0.01, None, 0, 0, None, True, "policy_causal", False, "peer_exposure"), (None, None, None, 4, 4, 0.01, True, "panel_association", True, "real_assignment")]
    got = [r.blockers for r in gates.blockers(spark.createDataFrame(rows, schema)).collect()]
    assert [len(b) for b in got] == [0, 4, 1]


def test_effects_of_unbalanced_panels_by_both_ways(spark):
    rng = np.random.default_rng(1)
    rows = [(u, float(t), u % 5, float(rng.normal() + u + t), float(rng.normal() + 0.1 * u)) for u in range(40) for t in range(9) if (u * t) % 4 != 1]
    df = spark.createDataFrame(rows, "unit long, time double, cluster long, y double, x double").persist()
    free = demeaned(df, ["y", "x"], ["unit", "time"]).toPandas()
    assert free.groupby("unit").y.mean().abs().max() < 1e-9 and free.groupby("time").x.mean().abs().max() < 1e-9
    for effects in ([], ["unit"], ["time"], ["unit", "time"]):
        moments, freed, _ = analysis._eliminated(df, ["y", "x"], effects)
        own = demeaned(df, ["y", "x"], effects).toPandas()
        assert np.allclose(moments, [[own.y @ own.y, own.y @ own.x], [own.x @ own.y, own.x @ own.x]])
        again = freed(df).toPandas()
        assert np.isclose(again.y @ again.x, own.y @ own.x)
    cells = pd.DataFrame(rows).groupby([0, 1]).size().unstack(fill_value=0)
    n = cells.to_numpy(float)
    want = n.T @ (n / n.sum(1, keepdims=True))
    for r in shared_cells(df, "unit", "time"):
        assert np.isclose(r.v, want[int(r.s), int(r.r)])


def test_library_types_are_those_of_the_values(spark):
    """Nested fields of a field's name, escaped quotes, and whole numbers given otherwise."""
    good = {
        '{"x": {"title": 7, "year": "no"}, "title": "A"}': None, '{"title": "say \\"year\\": \\"x\\"", "year": 1999}': 1999, '{"title": "A", "year": "2001"}': 2001, '{"title": "A", "year": 2002.0}': 2002,
        '{"title": "A", "year": true}': 1, '{"title": "A", "authors": [], "doi": null, "extra": [1]}': None, '{"title": "a:b", "concepts": ["\\"title\\": 1"]}': None, '{"title": "' + "t" * 2000 + '"}': None,
    }
    bad = ['{"x": {"title": "A"}}', '{"title": null}', '{"title": ["A"]}', '{"title": "A", "venue": null}', '{"title": "A", "authors": ["x", null]}', '{"title": "A", "authors": [null]}', '{"title": "A", "authors": null}', '{"title": "A", "authors": ["x", 1]}', '{"title": "A", "year": "MM"}', '{"title": "A", "year": 1.5}', '{"title": "A", "doi": 10.1}', '{"title": "' + "t" * 2001 + '"}', '["title"]', '"title"', "null"]
    lines = [*good, *bad]
    read = files.read_library(spark.createDataFrame(list(enumerate(lines)), "line long, value string")).collect()
    assert {r.line for r in read if r.valid} == set(range(len(good)))
    assert [r.year for r in sorted(read, key=lambda r: r.line) if r.valid] == list(good.values())
    quoted = next(r for r in read if r.line == 1)
    assert quoted.title == 'say "year": "x"'


def test_limits_of_a_library(spark, monkeypatch):
    lines = spark.createDataFrame([(i, "" if i == 5 else '{"title": "T"}') for i in range(2001)], "line long, value string")
    records, problems = files.library_of(lines)
    assert records.count() == 1999 and [tuple(r) for r in problems.collect()] == [(2000, "beyond_limit")]
    assert files.library_of(lines.where("line < 2000"))[1].count() == 0
    monkeypatch.setattr(files, "MOST_LIBRARY_BYTES", 2000)
    with pytest.raises(EngineError, match="library_too_large"):
        files.library_of(lines)


def test_data_plan_says_what_is_to_be_done(spark):
    from tessera.plans import cases

    roles = {"unit": ["u"], "time": ["t"], "outcome": ["y"], "treatment": ["d"]}
    rows = [(u, t, float(u + t * t), int(u < 3 and t >= 2)) for u in range(6) for t in range(4)]
    df = spark.createDataFrame(rows, "u long, t long, y double, d int")
    own = {k: k for k in "utyd"}
    assert cases.readiness(df, roles, own, True, True)["status"] == "ready"
    none = cases.readiness(df, roles, None, True, True, plan_stale=True)
    assert (none["todo"], none["missing"], none["sample"]) == (["confirm the plan", "choose data and bind: u, t, y, d"], ["u", "t", "y", "d"], None)
    part = cases.readiness(df, roles, own | {"y": "nothing + 1"}, False, False, plan_fits=False)
    assert part["todo"] == ["revise the plan to fit its case", "confirm the plan", "confirm the binding", "bind y"] and part["bound"] == ["d", "t", "u", "y"]
    flat = cases.readiness(df.withColumn("y", df["d"] * 0.0), roles, own, True, True)
    assert flat["todo"] == ["the outcome does not vary"]


def test_metadata_is_merged_as_one_commit(spark, tmp_path):
    from tessera.sources import metadata as md

    path = str(tmp_path / "table")
    assert md.latest(path) == 0
    with pytest.raises(Exception, match="metadata_empty"):
        md.read_metadata(spark, path).collect()
    rows = lambda *x: spark.createDataFrame(list(x), "id long, version long, name string").repartition(3)
    assert md.merge_into(rows((1, 1, "a"), (2, 1, None)), path, "id", "version") == 1
    held = md.read_metadata(spark, path)
    assert md.merge_into(rows((2, 2, "b"), (3, 1, "c"), (1, 0, "old")), path, "id", "version") == 2
    want = {(1, 1, "a"), (2, 2, "b"), (3, 1, "c")}
    assert {tuple(r) for r in md.read_metadata(spark, path).collect()} == want
    assert {tuple(r) for r in held.collect()} == {(1, 1, "a"), (2, 1, None)}  # the snapshot it was
    assert md.read_metadata(spark, path).select("name").where("id = 3").first().name == "c"
    # a writer that began from an older snapshot is refused, and leaves nothing
    parts = set((tmp_path / "table/parts").iterdir())
    with pytest.raises(Exception, match="metadata_conflict"):
        md.merge_into(rows((9, 9, "late")), path, "id", "version", base=1)
    assert md.latest(path) == 2 and set((tmp_path / "table/parts").iterdir()) == parts
    # so does a write that fails in a task
    from pyspark.sql import functions as F

    broken = rows((4, 4, "x"), (5, 5, "y")).withColumn("name", F.when(F.col("id") == 5, F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        md.write_metadata(broken, path, 2)
    assert md.latest(path) == 2 and {tuple(r) for r in md.read_metadata(spark, path).collect()} == want
    md.write_metadata(rows().where("false"), path, 2)
    assert md.read_metadata(spark, path).count() == 0 and md.latest(path) == 3
