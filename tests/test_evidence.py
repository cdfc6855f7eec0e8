"""Records, landscape, gates, workflow, sources, streaming."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.functions import text as tx
from tessera.operators import gates, landscape, records, workflow
from tessera.sources import files
from tessera.streaming import usage


def test_provider_payloads_merge(spark):
    a = spark.createDataFrame([(json.dumps({"title": "Green Paper", "doi": "https://doi.org/10.1/AB", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"we": [0, 2], "see": [1]}, "concepts": [{"display_name": "Policy"}]}),), (json.dumps({"title": "Other", "publication_year": 2019}),)], "json string")
    b = spark.createDataFrame([(json.dumps({"title": ["Green paper!"], "DOI": "10.1/ab", "issued": {"date-parts": [[2020, 5]]}, "abstract": "<p>x &amp; y</p>", "is-referenced-by-count": 9, "author": [{"given": "A", "family": "B"}]}),)], "json string")
    both = records.openalex_records(a).unionByName(records.crossref_records(b)).withColumn("position", F.monotonically_increasing_id())
    out = {r.doi: r for r in records.merge(both).collect()}
    assert len(out) == 2 and out["10.1/ab"].sources == ["crossref", "openalex"] and out["10.1/ab"].cited_by == 9
    assert out["10.1/ab"].abstract == "we see we" and out["10.1/ab"].concepts == ["Policy"] and out[None].title == "Other"


def resolved(rows):
    """Positions of the clusters, one record after the other, by searching all clusters."""
    clusters = []  # lists of (position, doi, key), and what took each key last
    for n, (position, doi, key) in enumerate(rows):
        of_doi = [c for c in clusters if doi and any(d == doi for _, d, _ in c)]
        of_key = sorted((c for c in clusters if any(k == key for _, _, k in c)), key=lambda c: max(i for i, (p, _, k) in enumerate(rows[:n]) if k == key and any(p == q for q, _, _ in c)))
        home = of_doi or [c for c in of_key[-1:] if not doi or not any(d for _, d, _ in c)]
        if not home:
            clusters.append(home := [[]])
            clusters[-1] = home[0]
        home[0].append((position, doi, key))
    return {p: c[0][0] for c in clusters for p, _, _ in c}


def test_clusters_equal_a_search_record_by_record(spark):
    rnd = random.Random(4)
    for seed in range(4):
        rows = []
        for i in range(150):
            rows.append((i, "s", [rnd.choice("st")], rnd.choice([None, f"10.1/{rnd.randrange(25)}"]), f"T{rnd.randrange(20)}", None, rnd.choice([2000, 2001]), rnd.choice(["", "v"]), rnd.choice([None, *range(9)]), None, None, ["c"], rnd.choice([None, 1.0])))
        d = spark.createDataFrame(rows, records.RECORD).repartition(5)
        home = resolved([(r[0], r[3], (r[4], r[6])) for r in rows])
        got = {r.position: r for r in records.merge(d).collect()}
        assert set(got) == set(home.values())
        for p, r in got.items():
            own = [x for x in rows if home[x[0]] == p]
            known = lambda k: [x[k] for x in own if x[k]]  # noqa: E731, B023
            assert (r.members, r.doi, r.venue, r.sources) == (len(own), (known(3) or [None])[0], (known(7) or [""])[0], sorted({s for x in own for s in x[2]}))
            assert r.relevance == (sum(known(12)) or None) and r.cited_by == max((x[8] for x in own if x[8] is not None), default=None)


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_clusters_where_one_key_holds_all_records(spark, share):
    """As untitled records without a year do; ranges of the key pass on what they know."""
    rnd = random.Random(int(share * 100))
    rows = [(i, f"10.1/{rnd.randrange(40)}" if rnd.random() < share else None, ":" if i % 17 else "rare") for i in rnd.sample(range(5000), 600)]
    got = records.clusters(spark.createDataFrame(rows, "position long, doi string, key string").repartition(7)).collect()
    assert len(got) == len(rows)
    assert {r.position: r.cluster for r in got} == resolved(sorted(rows))


def test_top_forty_are_included(spark):
    d = spark.range(55).select(F.col("id").alias("position"), (F.col("id") % 50).cast("double").alias("relevance"))
    got = records.include_top(d).where("included").collect()
    assert len(got) == 40 and {r.position for r in got} >= {49, 48}


def test_landscape_golden(spark):
    rows = [(0, "Policy innovation DID", ["policy", "innovation"], 2020, "A"), (1, "碳市场 effects", ["policy", " Innovation "], 2020, "A"), (2, "event study of floods", ["policy"], 2021, "B"), (3, "rivers mediating water-flow", [], 2022, ""), (4, "x", ["z"], None, "B")]
    d = spark.createDataFrame(rows, "position long, title string, concepts array<string>, year int, venue string")
    terms = landscape.keyword_rows(d)
    assert [tuple(r) for r in landscape.top_keywords(terms).limit(3).collect()] == [("policy", 3), ("innovation", 2), ("碳市场", 1)]
    assert tuple(landscape.keyword_edges(terms).first()) == ("innovation", "policy", 2)
    assert {r.method: r.n for r in landscape.method_counts(d, F.col("title")).collect()} == {"DID": 1, "事件研究": 1, "中介分析": 1, "工具变量": 0, "门槛模型": 0, "固定效应": 0}
    assert landscape.unknown_years(d).first().unknown_year == 1
    assert {r.term for r in terms.where("position = 3").collect()} == {"rivers", "mediating", "water-flow"}


GRID = "coef double, p double, pretrend_p double, n_checks long, n_same_sign long, permutation_p double, consistent boolean, method_family string, real_assignment boolean, semantics string"


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, ("supportive", "associational")),
        ({"pretrend_p": 0.01}, ("mixed", "preliminary")),
        ({"coef": -0.3}, ("not_supportive", "insufficient")),
        ({"consistent": False}, ("insufficient", "insufficient")),
        ({"real_assignment": True, "semantics": "real_assignment"}, ("supportive", "causal_cautious")),
        ({"real_assignment": True, "semantics": "real_assignment", "method_family": "panel_association"}, ("supportive", "associational")),
        ({"n_same_sign": 2}, ("mixed", "preliminary")),
        ({"permutation_p": None}, ("mixed", "preliminary")),
    ],
)
def test_decision_table(spark, change, want):
    base = {"coef": 0.3, "p": 0.01, "pretrend_p": 0.5, "n_checks": 4, "n_same_sign": 4, "permutation_p": 0.01, "consistent": True, "method_family": "policy_causal", "real_assignment": False, "semantics": "peer_exposure"}
    r = gates.verdicts(spark.createDataFrame([tuple((base | change).values())], GRID)).first()
    assert (r.verdict, r.max_strength) == want


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("政策促进创新", ["促进"]),
        ("结果不能解释为因果关系。", []),
        ("这不代表因果关系，但政策导致下降", ["导致"]),
        ("不能否认因果关系", ["因果"]),
        ("机制是否存在因果效应有待讨论", []),
        ("The policy caused growth and promotes it", ["caused", "promotes"]),
        ("This does not imply causality", []),
        ("论文《What drives growth》讨论了它", []),
        ("because of rain", []),
    ],
)
def test_wording(spark, text, words):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(gates.causal_words(F.col("t"))).first()[0] == words
    assert d.select(gates.causal_words(F.col("t"), F.lit("causal_cautious"))).first()[0] == []


@pytest.mark.parametrize(
    ("text", "flagged"),
    [("系数为0.3", True), ("样本有三百家企业", True), ("about seven firms", True), ("系数为{{num:main.coef}}", False), ("使用 log(1 + x2) 变换", False), ("变量 size_2 与 lag1", False), ("一方面，另一方面", False), ("`x = 3`", False), ("a1 + 2 * b", False), ("1 + 2", True), ("翻倍增长", True), ("log(3", True), ("两者一致", False)],
)
def test_numbers_in_prose(text, flagged):
    assert gates.states_quantity(text) == flagged


def test_issues_and_reasons(spark):
    d = spark.createDataFrame([(1, "好的段落。\n\n导致增长 5 个\n\n{{num:x}}")], "id long, text string")
    parts = gates.accepted_paragraphs(d, "text", ["main.coef"], "associational")
    assert [len(r.issues) for r in parts.orderBy("paragraph").collect()] == [0, 2, 1]
    r = gates.failure_reasons(parts, "id").first()
    assert r.reasons.count("；") == 2 and r.snippet == "导致增长 5 个"
    assert parts.select(gates.without_metadata(F.lit("Li（2020） found 10.1/x but 10.1/xy"), ["10.1/x"], [("Li", "2020")])).first()[0] == "  found   but 10.1/xy"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.doi_normalise(F.lit(" DOI: 10.1/AB "))) == "10.1/ab" and one(tx.doi_normalise(F.lit("https://dx.doi.org/"))) is None
    assert one(tx.title_key(F.lit("Ａ—Green, 论文 1!"))) == "agreen论文1"
    assert one(tx.inject(F.lit("a {{num:x.y}} b"), F.create_map(F.lit("x.y"), F.lit("3")))) == "a 3 b"
    assert one(tx.same_placeholders(F.lit("{{num:a}} {{num:b}}"), F.lit("{{num:b}} {{num:a}}"))) is False
    assert tx.format_number(None) == "未估计" and tx.format_number(0.0717) == "0.0717" and tx.format_number(3) == "3"
    assert tx.display_number(12345678.9) == "1.235e+07" and tx.display_number(0.00012) == "1.200e-04" and tx.display_number(2.0) == "2"
    assert one(tx.mask_secrets(F.lit("key sk-abc_1 end"))) == "key [redacted] end"
    assert one(tx.citation_year(F.lit("Li （2019） x"))) == 2019 and one(tx.quoted_titles(F.lit('“A”《B》 "C"'))) == ["A", "B", "C"]
    got = one(tx.sections(F.lit("intro\n## One\nbody 1\n## Two\nbody\n2")))
    assert [(s.title, s.body) for s in got] == [("One", "body 1"), ("Two", "body\n2")]
    assert one(tx.strip_repeated_heading(F.lit("## 七、方法论\n\ntext"), F.lit("方法论"))) == "text"
    assert one(tx.prefixed_list(F.array(F.lit("变量：a、b, c")), "变量：")) == ["a", "b", "c"]
    assert one(tx.valid_base_url(F.lit("https://h.x/v1"))) and not one(tx.valid_base_url(F.lit("https://u@h/")))


def test_workflow(spark):
    e = spark.createDataFrame([(1, "proposals", 7, False), (2, "study_plans", 7, False), (3, "study_plans", 8, True)], "id long, table string, project_id long, stale boolean")
    ev = spark.createDataFrame([(7, "data")], "project_id long, event string")
    assert {r.id: r.stale for r in workflow.cascade(ev, e).collect()} == {1: True, 2: False, 3: True}
    plans = spark.createDataFrame([("p", 1, "confirmed", {"a": "x", "b": "y"}, True), ("p", 2, "confirmed", {"a": "x"}, True), ("q", 1, "draft", {"a": "x"}, False)], "id string, version int, status string, binding map<string,string>, confirmed boolean")
    assert {(r.id, r.version): r.status for r in workflow.supersede(plans, "id", "version").collect()} == {("p", 1): "superseded", ("p", 2): "confirmed", ("q", 1): "draft"}
    edited = workflow.edited_copy(plans.where("version = 1"), spark.createDataFrame([("p", ["a"]), ("q", [])], "id string, names array<string>"), "id").collect()
    assert sorted((r.id, r.version, r.status, tuple(r.binding)) for r in edited) == [("p", 1, "confirmed", ("a", "b")), ("p", 2, "draft", ("a",)), ("q", 1, "draft", ())]
    once = workflow.add_columns(plans, {"n": F.lit(0)})
    assert workflow.add_columns(once, {"n": F.lit(1)}).first().n == 0
    cited = spark.createDataFrame([("c", ["e1", "e9", "e1"]), ("d", [])], "k string, refs array<string>")
    got = {r.k: (r.n_valid, r.n_invalid) for r in workflow.citations(cited, spark.createDataFrame([("e1",)], "id string"), "k", "refs").collect()}
    assert got == {"c": (1, 1), "d": (0, 0)}


def test_sources(spark, tmp_path):
    import pandas as pd

    pdf = pd.DataFrame({"firm_id": [1, 1, 2, 2], "year": [2000, 2001, 2000, 2001], "outcome": [1.0, None, 3.0, 4.0], "unused": [1, 2, 3, 4]})
    pdf.to_csv(tmp_path / "a.csv", index=False)
    pdf.to_stata(tmp_path / "a.dta", write_index=False)
    for name in ("a.csv", "a.dta"):
        d = files.read_selected(spark, str(tmp_path / name), ["outcome", "firm_id"])
        assert d.columns == ["outcome", "firm_id"] and d.where("outcome is null").count() == 1 and d.count() == 4
    assert [r.name for r in files.inspect(spark, str(tmp_path / "a.csv")).collect()] == list(pdf.columns)
    for bad in (["firm_id", "firm_id"], [], ["nope"]):
        with pytest.raises(EngineError):
            files.read_selected(spark, str(tmp_path / "a.csv"), bad)
    with pytest.raises(EngineError):
        files.read(spark, "x.pdf")
    row = files.save(spark.read.csv(str(tmp_path / "a.csv"), header=True), str(tmp_path / "t"), "t").first()
    assert row.n_rows == 4 and files.file_facts(spark, str(tmp_path / "a.csv")).first().length == (tmp_path / "a.csv").stat().st_size
    with pytest.raises(EngineError, match="storage_limit"):
        files.stored_bytes(spark, [str(tmp_path / "a.csv")], most=1)
    lines = spark.createDataFrame([(1, "3"), (2, "[1]"), (3, '{"title": 5}'), (4, '{"title": "Good", "year": 2000}'), (5, " ")], "line int, value string")
    assert {r.line: r.valid for r in files.read_library(lines).collect()} == {1: False, 2: False, 3: False, 4: True}
    doc = files.document_record(spark.createDataFrame([("/x/a.pdf", "ab\nA long title\n10.1234/AbC in 1998", "")], "path string, text string, title string")).first()
    assert (doc.title, doc.doi, doc.year) == ("A long title", "10.1234/abc", 1998)
    files.write_markdown(spark.createDataFrame([("D", 1, "One", "x"), ("D", 2, "Two", "y")], "document string, seq int, title string, body string"), str(tmp_path / "md"))
    assert "## Two" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "md")).collect())


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 5}:0{i % 7}:00", f"k{i % 2}", float(i)) for i in range(40)]
    calls = spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    q = usage.usage_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("usage_w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("usage_w").collect())) == sorted(map(str, usage.usage_by_window(calls).collect()))
    batch = spark.createDataFrame([(i, "s", ["s"], f"10.1/{i % 4}", f"T{i}", None, 2000, "", 1, None, None, [], 1.0) for i in range(12)], records.RECORD)
    run = usage.merge_into(str(tmp_path / "m"))
    for e in (0, 1, 1, 2):
        run(batch.where(F.col("position") % 3 == e), e)
    got = spark.read.parquet(str(tmp_path / "m/merged")).select("position", "members").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, records.merge(batch).select("position", "members").collect()))


def test_flow_and_locks(spark):
    rows = [(1, i, s, st, v, e, ls, ok) for i, (s, st, v, e, ls, ok) in enumerate([("direction", "completed", 1, False, False, False), ("literature", "completed", 0, False, False, False), ("candidates", "stale", 0, False, False, False), ("plan", "draft", 0, False, False, False), ("data", "not_started", 0, False, False, False), ("proposal", "not_started", 0, False, False, False)])]
    d = spark.createDataFrame(rows, "project_id long, seq int, stage string, status string, confirmed_version int, editing boolean, local_stale boolean, data_ok boolean")
    got = workflow.derive_flow(d).orderBy("seq").collect()
    assert [r.flow for r in got] == ["confirmed", "confirmed", "stale", "active", "locked", "locked"] and got[0].downstream == 2
    assert {(r.stage, r.blocker) for r in workflow.lock_reasons(d).collect()} == {("data", "plan"), ("proposal", "plan")}
    f = workflow.flow(d).first()
    assert f.n_done == 2 and f.next_stage == "candidates"


def test_candidates_and_validation(spark):
    from tessera.operators import candidates, validation

    c = spark.createDataFrame([("s", 1, "a", "Alpha study", ["e"] * 9, "iv", "balanced", [], "take Beta now"), ("s", 2, "b", "Beta now and later", [], None, "x", ["r"] * 9, "take Beta now"), ("t", 1, "c", "G", [], None, "x", ["r"] * 9, "none"), ("t", 2, "d", "H", [], "iv", "x", [], "none")], "set_id string, seq int, id string, title string, evidence_ids array<string>, identification string, positioning string, risks array<string>, recommendation_text string")
    assert {r.set_id: (r.id, r.score) for r in candidates.recommended(c).collect()} == {"s": ("b", 29), "t": ("d", 57)}
    card = candidates.direction_card(spark.createDataFrame([(1, ["变量：a、b", "地区：EU", "note", " "])], "id int, constraints array<string>")).first()
    assert (card.variables, card.region, card.keywords, card.other) == (["a", "b"], "EU", [], ["note"])
    cards = spark.createDataFrame([("p", 0, False, "a b"), ("p", 1, True, "x"), ("p", 2, True, "a")], "project_id string, position int, included boolean, t string")
    assert [r.position for r in candidates.ranked_cards(cards, F.col("t"), ["A", "b"]).orderBy("place").collect()] == [2, 1, 0]
    good = {"method_family": "policy_causal", "variables": [("outcome", "y"), ("treatment", "d"), ("unit", "u"), ("time", "t")], "robustness": [("r",)], "claims": [("c",)], "boundary_notes": "n", "binding": {"y": "f"}}
    schema = "method_family string, variables array<struct<role: string, name: string>>, robustness array<struct<id: string>>, claims array<struct<id: string>>, boundary_notes string, binding map<string, string>"
    plans = [good, good | {"binding": {"zz": "f"}}, good | {"claims": []}, good | {"variables": [*good["variables"], ("outcome", "1y")]}]
    got = validation.check_plans(spark.createDataFrame([tuple(p.values()) for p in plans], schema)).collect()
    assert [r.problems for r in got] == [[], ["binding"], ["claims"], ["variables", "outcome_once"]]
    assert validation.valid(validation.check_queries(spark.createDataFrame([(["a"],), ([],), (["a"] * 7,), ([" "],)], "queries array<string>"))).count() == 1


def test_case_and_readiness(spark):
    from tessera.plans import cases
    from tessera.plans.spec import compile_spec

    spec = compile_spec(cases.CASE_ROLES, cases.CASE_BINDING, list(cases.CASE_CHECKS))
    assert len(cases.COLUMNS) == 21 and spec.robustness[1].args["controls"] == ["log(total_assets)", "leverage", "return_on_assets"]
    rows = [(u, 2010 + t, float(u * t), int(u < 3 and t >= 3)) for u in range(6) for t in range(8)]
    d = spark.createDataFrame(rows, "firm long, year long, y double, d int")
    roles, binding = {"unit": ["u"], "time": ["t"], "outcome": ["o"], "treatment": ["x"]}, {"u": "firm", "t": "year", "o": "log1p(y)", "x": "d"}
    assert cases.readiness(d, roles, binding, True, True)["status"] == "ready"
    out = cases.readiness(d, roles, binding | {"o": "nope"}, False, True)
    assert out["missing"] == ["o"] and out["todo"] == ["confirm the plan", "bind o"]
    assert "the treatment is not 0 or 1" in cases.readiness(d, roles, binding | {"x": "year"}, True, True)["todo"]


def test_flow_of_projects_equals_that_of_their_stages(spark):
    rows = spark.range(400).selectExpr("id % 390 AS project_id", "if(id % 7 = 0, ' ', 'x') AS direction", "int(id % 4) AS n_included", "'failed' AS search_status", "if(id % 5 = 0, null, 'ready') AS set_status", "id % 13 = 0 AS set_stale", "id % 2 = 0 AS selected", "id % 17 = 0 AS selected_stale", "if(id % 4 = 0, 'confirmed', null) AS plan_status", "id % 11 = 0 AS plan_stale", "if(id % 6 = 0, 'succeeded', null) AS run_status", "id % 19 = 0 AS run_stale", "id % 23 = 0 AS step_failed", "id % 3 = 1 AS binding_confirmed", "id % 5 = 1 AS proposal", "id % 10 = 1 AS proposal_stale", "id % 2 = 1 AS proposal_confirmed", "array('none') AS active")
    assert sorted(workflow.project_flow(rows).collect()) == sorted(workflow.flow(workflow.stage_status(rows)).collect())
