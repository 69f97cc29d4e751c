import corpus_pipeline
from tests.llm.test_near_copies import brute_components


def run_stages(spark, docs, sf_dir):
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        kept.append(docs)
    return kept


def test_stages_and_run(spark, sf_dir, docs):
    stages = run_stages(spark, docs, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert all(set(s.columns) == set(docs.columns) for s in stages[:-1])
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] and len(ids[4]) > 0.7 * docs.count()
    found = brute_components({r.doc_id: r.text or "" for r in stages[1].select("doc_id", "text").collect()})
    assert ids[2] == set(found.values())
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[4].select("doc_id", "piece", "ids_crc32").collect()))


def test_awkward_tables_pass_through(spark, sf_dir, awkward, nothing):
    last = run_stages(spark, awkward, sf_dir)
    assert {r.doc_id for r in last[1].collect()} <= {1, 5, 7, 8, 9, None}
    near = last[2].collect()
    assert len([r for r in near if r.doc_id == 1]) == 1 and sum(r.doc_id is None for r in near) == 1
    assert last[4].count() >= len(near)
    assert all(s.count() == 0 for s in run_stages(spark, nothing, sf_dir))
