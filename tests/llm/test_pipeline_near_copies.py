import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidepool.llm import similar_sets  # noqa: E402

from .test_simhash import classes, fingerprint  # noqa: E402


def test_the_stage_links_by_simhash(spark, tmp_path):
    """Texts whose fingerprints lie more than 2 bits apart stay, whatever else they share."""
    rnd = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"w{rnd.randrange(4000)}" for _ in range(40)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join([*words, "more", "than", "that"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = classes([fingerprint(t) for t in texts])
    kept = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(len(texts)) if root[i] == i}
    assert kept != {r["component_id"] for r in similar_sets.near_copies(docs).collect()}
