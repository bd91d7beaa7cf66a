"""64-bit ids beside nulls in one batch, through every operator; other types of ids are refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import byte_bpe, hmm_lm, order_minhash, packing, pii, quality_classifier, quality_rules, similar_sets, simhash, suffix_dedup, toxicity
from tidepool.llm.common import cut
from tidepool.llm.hashed_text import BITS

BIG = (1 << 62) + 12346
TEXT = "a passage of well over fifty bytes that stands in several documents alike, word for word"

OPERATORS = {
    "op1": quality_rules.measure,
    "op2": lambda d: packing.pack(cut(packing.pieces(d))),
    "op3": simhash.near_duplicates,
    "op4 digests": suffix_dedup.digests,
    "op4": suffix_dedup.deduplicate,
    "op5": order_minhash.compare,
    "op5 fingerprints": order_minhash.fingerprints,
    "op6": lambda d: toxicity.score(d, ({}, 0.0)),
    "op7": lambda d: quality_classifier.score(d, (np.zeros(1 << BITS), 0.0)),
    "op8 digests": byte_bpe.digests,
    "op8": byte_bpe.encode,
    "op9": pii.redact,
    "op10": lambda d: hmm_lm.train_and_score(d, F.lit(True), states=2, rounds=1),
    "near copies": similar_sets.near_copies,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, TEXT + " and more of it, number one", "en", None), (None, "no id here", "en", BIG), (7, TEXT, None, 3), (BIG + 1, None, "en", 4), (BIG, "", "en", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").coalesce(1)


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_keep_their_values(docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 7, BIG, BIG, BIG + 1]
    if "n_chars" in got[0]:
        kept = {r["doc_id"]: r["n_chars"] for r in got}
        assert name.startswith(("op1", "op5")) or kept[None] == BIG  # columns that pass through keep theirs


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op8", "op10"])
def test_other_types_of_ids_are_refused(docs, name):
    with pytest.raises(TypeError, match="integers"):
        OPERATORS[name](docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_a_shared_folder_is_needed_on_a_cluster():
    from tidepool.llm.common import scratch_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session)
