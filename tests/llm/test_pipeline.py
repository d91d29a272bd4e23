import pytest

import corpus_pipeline as cp
from test_op9_superminhash import shingles
from tradetally.llm import op1_decontam, op9_superminhash, op10_toxicity
from tradetally.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stored(spark, stage(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for df in steps[1:-1]:
        assert df.schema.simpleString() == steps[0].schema.simpleString()


def test_toxic_documents_go(spark, steps):
    net = op10_toxicity.train(spark, steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in op10_toxicity.score(spark, steps[0], net, keep=["doc_id"]).collect()}
    assert ids(steps[1]) == {i for i, s in score.items() if s < 0.5} and len(ids(steps[1])) < len(score)
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in lab if lab[i] == 0]
    assert sum(i in ids(steps[1]) for i in clean[:50]) >= 45


def test_one_of_each_group_stays(spark, steps):
    groups = op9_superminhash.near_duplicates(spark, steps[1], num=80).collect()
    assert ids(steps[2]) == {r.doc_id for r in groups if r.kept} and any(not r.kept for r in groups)


def test_near_duplicates_go_from_08_on(spark):
    """Against all pairs that share a shingle, on whole texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    sets = {i: shingles(t) for i, t in rows}
    holders, up, between = {}, {i: i for i in sets}, 0

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    for a, b in {(a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k]}:
        common = len(sets[a] & sets[b])
        union = len(sets[a]) + len(sets[b]) - common
        if 100 * common >= 80 * union:
            between += 100 * common < 85 * union
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    assert between > 5
    assert ids(cp.near_dedup(spark, docs, SF)) == {i for i in sets if top(i) == i}


def test_contaminated_documents_go(spark, steps):
    leaks = op1_decontam.find_leaks(spark, steps[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert ids(steps[3]) == {r.doc_id for r in leaks if not r.contaminated} and any(r.contaminated for r in leaks)


def test_personal_data_is_masked(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    after = {r.doc_id: r for r in steps[4].collect()}
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i].text]
    assert changed and all("<" in after[i].text for i in changed)
    assert not any("@mail" in (r.text or "") for r in after.values())
    assert all(r.n_chars == len(r.text or "") for r in after.values())


def test_packing_holds_all(steps):
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == ids(steps[4])
    filled = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert sum(filled.values()) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_edges_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", None, "s", 5), (3, "same words here now ok", "en", "s", 3),
            (3, "same words here now ok", "en", "s", 3), (4, "same words here now ok", "en", "s", 3)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in cp.STAGES:
            docs = stored(spark, stage(spark, docs, SF), "test-edges")
        assert docs.where("doc_id = 4").count() == 0 and (docs.count() > 0) == bool(data)


def test_toxicity_needs_labels(spark):
    docs = spark.createDataFrame([(10**9, "a b c")], "doc_id long, text string")
    net = op10_toxicity.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert net is None
