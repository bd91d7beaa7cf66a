import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidepool.llm import packing, pii, quality_classifier, suffix_dedup  # noqa: E402
from tidepool.llm.hashed_text import Runs  # noqa: E402

from .test_pii import brute as base_spans  # noqa: E402
from .test_simhash import classes, fingerprint  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, pii_spans string, tkey int"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    top = f"file://{tmp_path_factory.mktemp('sf')}"
    good = [f"the committee of town {i} met on day {i * 7} and spoke of the bridge over river {i * 3} with care" for i in range(40)]
    bad = [f"buy now {i} cheap click here {i} best price {i} click here" for i in range(20)]
    shared = "this passage of well over fifty bytes stands in several documents of the corpus alike"
    texts = [*good, good[3], good[3], good[5] + " and mail a.b@c.org please", good[6] + " " + shared, good[7] + " " + shared, *bad, None, "", "river " * 9000]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", "own", 4) for i, t in enumerate(texts)], COLUMNS)
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 45)) for i in range(65) if i % 3], "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    return top


def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = packing.cut(stage(spark, docs, sf_dir))
        yield name, before, docs


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0]))


def test_each_stage_against_brute_force(spark, sf_dir):
    coder = Tokenizer.from_file(packing.default_tokenizer())
    for name, before, after in stages(spark, sf_dir):
        rows = table(before)
        if name != "packing":
            assert after.columns == before.columns
        if name == "quality_classifier":
            w, bias = quality_classifier.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            keep = []
            for r in rows:
                at, x = quality_classifier.features(r[1] or "", Runs())
                if 1 / (1 + np.exp(-(w.astype(np.float32)[at] @ x + bias))) >= corpus_pipeline.MIN_QUALITY:
                    keep.append(r)
            assert table(after) == keep and 0 < len(keep) < len(rows)
        elif name == "simhash":
            root = classes([fingerprint(r[1]) for r in rows])
            assert table(after) == [r for i, r in enumerate(rows) if root[i] == i] and len(set(root)) < len(rows)
        elif name == "suffix_dedup":
            got, changed = table(after), 0
            for r, g in zip(rows, got, strict=True):
                raw = (r[1] or "").encode()
                earlier = {b[i : i + 50] for o in rows if o[0] < r[0] for b in [(o[1] or "").encode()] for i in range(len(b) - 49)}
                gone = np.zeros(len(raw), dtype=bool)
                for i in range(len(raw) - 49):
                    if raw[i : i + 50] in earlier:
                        gone[i : i + 50] = True
                rest = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
                assert (g[1] or "") == rest and g[4] == (None if r[1] is None else len(rest)) and g[5:] == r[5:]
                changed += gone.any()
            assert changed
        elif name == "pii":
            got = table(after)
            assert [g[0] for g in got] == [r[0] for r in rows]
            for r, g in zip(rows, got, strict=True):
                assert bool(base_spans(r[1] or "")) <= (g[1] != r[1]) and not base_spans(g[1] or "")
            assert any("<EMAIL>" in (g[1] or "") for g in got)
        else:
            sequences = defaultdict(list)
            tokens = defaultdict(int)
            for r in after.collect():
                sequences[r["sequence_id"]].append((r["offset"], r["length"]))
                tokens[r["doc_id"]] += r["length"]
            assert tokens == {r[0]: len(coder.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
            for own in sequences.values():
                ends = [a + n for a, n in sorted(own)]
                assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY


def test_run_is_the_stages_in_turn(spark, sf_dir):
    last = [x for x in stages(spark, sf_dir)][-1][2]
    digest = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, sf_dir)) == digest(last)
    assert [re.sub("_.*", "", name) for name, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix", "pii", "packing"]


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_modules_are_those_of_the_operators():
    assert suffix_dedup.WIDTH == 50 and pii.KINDS[:4] == ("email", "ip", "card", "phone")
