import re

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_brute_force_keeps(spark):
    from .test_operators import brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from rankloom.llm.common import cut

    clean = cut(p.drop_toxic(spark, docs, SF))
    assert clean.columns == docs.columns and clean.count() > 0.7 * docs.count()
    once = cut(p.drop_copies(spark, clean, SF))
    keep = {}
    for r in clean.collect():
        keep[r.text] = max(keep.get(r.text, -1), r.doc_id)
    rows = once.collect()
    assert sorted(r.doc_id for r in rows) == sorted(keep.values()) and once.columns == docs.columns
    apart = cut(p.drop_near_copies(spark, once, SF))
    want = brute_components([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    fair = cut(p.drop_contaminated(spark, apart, SF))
    plain = lambda t: " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in fair.collect()) == sorted(r.doc_id for r in apart.collect() if not any(x in plain(r.text) for x in items))
    packed = p.pack(spark, fair, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in fair.collect()}


def test_toxicity_sends_a_text_once(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(p.toxicity, "score", lambda docs, training: sent.append(docs) or docs.selectExpr("*", "0.1D score"))
    docs = spark.createDataFrame([(1, "a", 2, "x"), (2, None, 3, "y")], "doc_id long, Text string, whole int, `_Text` string")
    kept = p.drop_toxic(spark, docs, SF)
    assert sent[0].columns == ["_doc_id", "text", "_whole", "__Text"]
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())


def test_near_dedup_repeats_no_step_within_a_plan(spark):
    """What the driver describes and plans of a query: 36,000 characters and more where a plan held a step once for each reader."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    rows = [(k, " ".join(f"w{k // 4}x{j}" for j in range(40 + k % 4))) for k in range(40)]
    from rankloom.llm.common import cut

    docs = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    bus.waitUntilEmpty(60_000)
    first = store.executionsList().last().executionId()
    kept = p.drop_near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 4))
    bus.waitUntilEmpty(60_000)
    ran = store.executionsList()
    long = [len(x.physicalPlanDescription()) for x in map(ran.apply, range(ran.size())) if x.executionId() > first]
    assert len(long) > 10 and max(long) < 30_000, max(long)
