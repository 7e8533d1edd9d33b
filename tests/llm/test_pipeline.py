"""The pipeline against plain Python, stage by stage on the same rows."""

from collections import Counter

import corpus_pipeline
from tests.llm import brute
from threadloom.llm import bpe, quality
from threadloom.llm.queries import vocabulary_path

TABLES = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import pyarrow as pa

    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect() if r["quality"] == 1}
    judged = brute.quality(docs, trusted, quality.BUCKETS, quality.PSEUDO, quality.THRESHOLD)
    docs = [r for r in docs if judged[r[0]][-1]]
    same = brute.exact(docs)
    docs = [r for r in docs if same[r[0]][2]]
    near = brute.near(docs)
    docs = [r for r in docs if near[r[0]][2]]
    mix = brute.mix(docs)
    texts, want = dict((d, t) for d, t, _ in docs), Counter()
    v = bpe.vocabulary(vocabulary_path())
    for d, (size, _, _, taken) in mix.items():
        ids = bpe.encode(pa.array([texts[d]]), v)
        told = brute.sha(bpe.decode(ids, v)[0].as_py())
        want[(d, len(ids[0]), told)] += taken // size
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, TABLES).collect())
    assert got == +want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_stages_on_odd_rows(spark, make, odd_texts):
    """Null, empty, very long and repeated texts, repeated and missing ids, and clashing names pass through every stage."""
    prose = " ".join(f"w{k} the of and" for k in range(40))
    rows = [(k, t, [None, "", "s"][k % 3]) for k, t in enumerate(odd_texts)]
    rows += [(100, prose, "s"), (101, prose, "s"), (101, prose, "s"), (102, prose + " more", None), (None, prose, "s"), (None, None, None), (100, prose[::-1], "s")]
    docs = make(rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TABLES)
        assert out.columns == docs.columns, name
        kept[name] = sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=repr)
        assert set(kept[name]) <= {(d, t or "") for d, t, _ in rows}, name
        assert stage(spark, make([]), TABLES).count() == 0, name
    # Of equal texts the largest id stays, as often as it stands there; rows without an id stay; an id's other text is its own.
    exact = [r for r in kept["exact_dedup"] if r[1] in (prose, prose[::-1])]
    assert exact == sorted([(101, prose), (101, prose), (None, prose), (100, prose[::-1])], key=repr)
    near = {d for d, t in kept["near_dedup"] if t.startswith(prose)}
    assert near == {100, None}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert last.count() == len(rows) and corpus_pipeline.STAGES[-1][1](spark, make([]), TABLES).count() == 0
