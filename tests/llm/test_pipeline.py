"""Each stage of the pipeline against SQL or a plain version over what the stage before it kept."""

import corpus_pipeline as cp
import duckdb
from test_packing import check
from tidemark.llm import oracles, queries, toxicity
from tidemark.llm.common import stored

SF = "/root/testdata/sf0.001"


def sql(name, docs):
    con = duckdb.connect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    con.execute("create table documents (doc_id bigint, text varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?)", rows)
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    return con.execute(oracles.ORACLE[name]).to_arrow_table().to_pylist()


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append(docs)
    model = toxicity.trained(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels").where(toxicity.fold() != 2))
    clean = {r.doc_id for r in queries.table(spark, SF, "documents").collect() if model.score((r.text or "").encode()) < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept[0].collect()} == clean
    lines = {r["doc_id"]: r["kept_sha256"] for r in sql("op9_line_dedup", kept[0])}
    import hashlib

    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept[1].collect()} == lines
    assert all(r.n_chars == len(r.text) for r in kept[1].collect())
    assert {r.doc_id for r in kept[2].collect()} == {r["doc_id"] for r in sql("op6_near_dedup", kept[1]) if r["kept"]}
    assert {r.doc_id for r in kept[3].collect()} == {r["doc_id"] for r in sql("op7_decontaminate", kept[2]) if not r["contaminated"]}
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert check(last, {r.doc_id: r.text for r in docs.collect()}) < 0.05
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(cp.run(spark, SF).collect()) == key(last)
