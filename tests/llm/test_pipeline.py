import duckdb
import pytest

import corpus_pipeline
from shelfmark.llm import checks

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in checks.queries()) == list(range(1, 14))
    assert checks.oracle_sql().keys() <= checks.queries().keys()


def test_run_against_brute_force(spark):
    """Every stage of the pipeline beside its brute-force version, each on what the one before kept."""
    from test_jaccard import brute as groups
    from test_linededup import brute as cut
    from test_packing import check
    from test_quality import brute as judged
    from shelfmark.llm.quality import MAX_AVOIDED_MILLI, THRESHOLD

    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    good = {r[0] for r in duckdb.sql(f"select doc_id from '{SF}/labels.parquet' where quality = 1 and toxic = 0").fetchall()}
    items = [r[0] for r in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    keep = {r[0] for r in judged(docs, good) if not r[6] and r[7] >= THRESHOLD and 1000 * r[8] <= MAX_AVOIDED_MILLI * r[1]}
    docs = [x for x in docs if x[0] in keep]
    docs = [(i, t) for i, t, n in cut(docs) if not n or t.strip()]
    docs = [x for x, g in zip(docs, groups(docs)) if g[0] == g[2]]
    docs = [x for x in docs if not any(item in x[1] for item in items)]
    check(corpus_pipeline.run(spark, SF).collect(), docs, 2048)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(checks.oracle_sql()))
def test_sql(spark, name):
    with duckdb.connect() as duck:
        for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
            duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        frame, relation = checks.queries()[name](spark, SF), duck.sql(checks.oracle_sql()[name])
        assert canonical(frame.columns, frame.collect()) == canonical(relation.columns, relation.fetchall())
