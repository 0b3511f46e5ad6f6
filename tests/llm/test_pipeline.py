"""The corpus pipeline, stage by stage and as a whole, against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from tessera.llm import pieces, quality, secrets
from tests.llm.test_operators import brute_components, brute_contamination, pairs_of


def test_stages(spark, sf_dir, documents):
    docs, columns = documents, documents.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert len(by_name) == 5

    good = by_name["quality classifier"](spark, docs, sf_dir)
    scores = quality.classify(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}

    one = by_name["MinHash near-dedup"](spark, good, sf_dir)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, (_, c) in brute_components(pairs_of(good), 80).items() if c == i}

    clean = by_name["benchmark decontamination"](spark, one, sf_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, n, h, _ in brute_contamination(pairs_of(one), items) if not (h and 20 * h >= n)}

    safe = by_name["secret scan"](spark, clean, sf_dir)
    before, after = dict(pairs_of(clean)), dict(pairs_of(safe))
    assert safe.columns == columns and before.keys() == after.keys()
    planted = re.compile(r'token = "[0-9a-f]{40}"', re.I)
    assert not any(planted.search(t or "") for t in after.values())
    assert all(after[i] == t for i, t in before.items() if not re.search(r"[A-Za-z0-9+/=_.-]{8,}", t or ""))

    last = by_name["SentencePiece"](spark, safe, sf_dir)
    assert last.count() == safe.count() and last.where("NOT exact").count() == 0


def brute_redacted(text, source, forest):
    """Candidates one by one, each with its own vote; a secret's characters become the mark."""
    _, found = secrets.candidates(pa.array([text], pa.string()))
    raw, out, at = (text or "").encode(), b"", 0
    for c in found:
        if forest.score(np.array([secrets.features(c.text, c.before, c.after, source or "")]))[0] >= 0.5:
            out, at = out + raw[at : c.start] + secrets.MARK.encode(), c.end
    return (out + raw[at:]).decode()


def test_run(spark, sf_dir, documents):
    """Row by row: scores of one text at a time, components and windows by brute force, ids from the library."""
    model = quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: r for r in documents.collect()}
    good = [i for i, r in rows.items() if model.score(quality.statistics(pa.array([r.text], pa.string())))[0] >= 0.3]
    one = [i for i, (_, c) in brute_components([(i, rows[i].text) for i in good], 80).items() if c == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [i for i, n, h, _ in brute_contamination([(i, rows[i].text) for i in one], items) if not (h and 20 * h >= n)]
    forest, lib = secrets.train(spark), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {}
    for i in clean:
        text = brute_redacted(rows[i].text, rows[i].source, forest)
        ids = lib.encode(text)
        want[i] = (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert 0 < len(clean) < len(one) < len(good) < len(rows)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
